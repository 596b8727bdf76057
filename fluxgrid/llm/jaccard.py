"""N-gram Jaccard join with prefix trees.

A document's set holds the hashes of its distinct word n-grams in one global order: n-grams that are frequent anywhere come last
(by count), all others by hash. Two sets with similarity t or more share one of their first n - ceil(t * n) + 1 members, so sets
meet by the members of that prefix. In a group of sets that share a member, pairs whose sizes, positions or parity bitmaps rule
out the similarity are dropped; of the rest, a spanning forest is checked first, then pairs between classes that stayed apart.
The check is a trie join: partners of one set are ordered as paths of a prefix tree, overlaps counted on a shared path are kept
for the next one, and a path is left as soon as its misses exceed what the lengths allow.

The number of links of a document is counted afterwards over all pairs of sets of its class, since a link never leaves a class:
n-grams of many sets by products of 0/1 matrices, rare ones pair by pair. That work is quadratic in the different sets of a class.

Equal sets are one set throughout. Any global order is right; the list of frequent n-grams (``MAX_FREQUENT`` at most) only
keeps groups small. Groups are dealt out in blocks of ``BLOCK`` sets, and pairs of blocks are compared where more than one class
is left, so that no task holds an unbounded group.

Edge cases: a text with fewer than n words has its whole word sequence as its only n-gram; null and wordless texts have the empty
set, are linked with nothing and are their own class. Repeated rows and rows with equal ids fall together. Ids can't be null
in a class: a null id is ignored when the smallest is sought.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxgrid.llm import common

#: n-grams that go last in the global order, at most, and the share of a partition's texts that makes one a candidate for that.
MAX_FREQUENT, LOCAL_SHARE = 50_000, 0.002
#: Sets of a group that one task compares.
BLOCK = 2048
#: Bits of a bitmap that goes with a set into its groups, at least and at most; pairs are held against wider ones before they are checked.
BITS, WIDE = (64, 1024), 65536


def shingles(raw: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    out = []
    for _, part in common.pieces(raw):
        h, per = common.word_hashes(part)
        x = np.full(len(h), n, np.uint64)
        for i in range(n):
            x = x * np.uint64(0x9E3779B97F4A7C15) + np.concatenate([h[i:], np.zeros(min(i, len(h)), np.uint64)])
            x ^= x >> np.uint64(29)
        x = common.mix64(x)
        at = 0
        for k in per.tolist():
            if k >= n:
                s = np.sort(x[at : at + k - n + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif k:  # fewer words than n: the whole sequence
                whole = np.uint64(k)
                for w in h[at : at + k]:
                    whole = np.uint64((int(whole) * 0x9E3779B97F4A7C15 + int(w)) & 0xFFFFFFFFFFFFFFFF)
                    whole ^= whole >> np.uint64(29)
                out.append(common.mix64(np.array([whole])))
            else:
                out.append(np.zeros(0, np.uint64))
            at += k
    return out


def ordered(s: np.ndarray, rank: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A sorted set in the global order: what isn't in rank by hash, the rest behind it by rank."""
    keys, place = rank
    if not len(keys) or not len(s):
        return s
    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
    often = keys[at] == s
    last = np.flatnonzero(often)
    return np.concatenate([s[~often], s[last[np.argsort(place[at[last]], kind="stable")]]])


def prefix_length(n: int, t: float) -> int:
    """Members of a set of n that a partner of similarity t must share one of."""
    return n - math.ceil(t * n - 1e-9) + 1 if n else 0


def bitmap(s: np.ndarray, most: int = BITS[1]) -> bytes:
    """Parity bitmap with about as many bits as s has members; the bits in which two differ are a lower bound of the members not shared."""
    m = min(max(BITS[0], 1 << max(len(s) - 1, 1).bit_length()), most)
    bits = np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def fold_to(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps brought to fewer words; parity lets halves be combined."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def required(a: np.ndarray | int, b: np.ndarray | int, t: float) -> np.ndarray | int:
    """Smallest overlap of sets of sizes a and b with similarity t; t is taken in hundredths, so that limits are exact."""
    p = round(100 * t)
    return -(-p * (np.asarray(a) + np.asarray(b)) // (100 + p))


def trie_join(a: np.ndarray, partners: list[tuple[int, np.ndarray]], t: float) -> list[int]:
    """Ids of the partners (in one global order each) whose similarity with the set a is t or more."""
    a = np.sort(a)
    paths = sorted(((s.astype(">u8").tobytes(), i, s) for i, s in partners), key=lambda x: x[0])
    found: list[int] = []
    before, overlap = np.zeros(0, np.uint64), np.zeros(1, np.int64)  # the path before, and the overlap at each of its nodes as far as it was followed
    for _, i, s in paths:
        k = min(len(before), len(s), len(overlap) - 1)
        same = np.flatnonzero(before[:k] != s[:k])
        depth = int(same[0]) if len(same) else k
        overlap = overlap[: depth + 1]
        need = int(required(len(a), len(s), t))
        while True:
            if overlap[-1] + min(len(s) - depth, len(a) - overlap[-1]) < need:
                break  # what is left of this path, and of all that share it with this length, can't reach the bound
            if depth == len(s):
                found.append(i)
                break
            part = s[depth : depth + 64]
            at = np.minimum(np.searchsorted(a, part), len(a) - 1)
            overlap = np.concatenate([overlap, overlap[-1] + np.cumsum(a[at] == part)])
            depth += len(part)
        before = s
    return found


def _popcount_block(maps: np.ndarray, row: np.ndarray) -> np.ndarray:
    return np.bitwise_count(maps ^ row).sum(1, dtype=np.int64)


def near(i: int, others: np.ndarray, n: np.ndarray, pos: np.ndarray, maps: dict[int, np.ndarray], size: np.ndarray, t: float) -> np.ndarray:
    """Those of `others` that sizes, positions and bitmaps allow to be similar to i."""
    need = required(n[i], n[others], t)
    ok = (np.minimum(n[i], n[others]) >= need) & (1 + np.minimum(n[i] - pos[i], n[others] - pos[others]) + np.minimum(pos[i], pos[others]) >= need)
    others, need = others[ok], need[ok]
    w = np.minimum(size[others], size[i])
    keep = np.zeros(len(others), bool)
    for words in np.unique(w):
        at = np.flatnonzero(w == words)
        keep[at] = _popcount_block(maps[int(words)][others[at]], maps[int(words)][i]) <= n[i] + n[others[at]] - 2 * need[at]
    return others[keep]


def _bitmaps(raw: list[bytes]) -> tuple[dict[int, np.ndarray], np.ndarray]:
    size = np.array([len(r) // 8 for r in raw])
    maps: dict[int, np.ndarray] = {}
    for words in np.unique(size):
        out = np.zeros((len(raw), words), np.uint64)
        for own in np.unique(size[size >= words]):
            rows = np.flatnonzero(size == own)
            out[rows] = fold_to(np.frombuffer(b"".join(raw[r] for r in rows), np.uint64).reshape(len(rows), own), words)
        maps[int(words)] = out
    return maps, size


def _small_forest(sid: list[int], n: list[int], pos: list[int], raw: list[bytes], t: float) -> Iterator[tuple[int, int]]:
    """The spanning forest of a small group; plain integers are quicker here."""
    p = round(100 * t)
    left = sorted(range(len(sid)), key=sid.__getitem__)
    maps: dict[tuple[int, int], int] = {}

    def bits(i: int, size: int) -> int:
        if (i, size) not in maps:
            x, m = int.from_bytes(raw[i], "little"), 8 * len(raw[i])
            while m > size:
                m //= 2
                x = (x >> m) ^ (x & ((1 << m) - 1))
            maps[i, size] = x
        return maps[i, size]

    while left:
        queue, left = [left[0]], left[1:]
        while queue and left:
            i, stay = queue.pop(), []
            for j in left:
                need = -(-p * (n[i] + n[j]) // (100 + p))
                if min(n[i], n[j]) >= need and 1 + min(n[i] - pos[i], n[j] - pos[j]) + min(pos[i], pos[j]) >= need:
                    size = 8 * min(len(raw[i]), len(raw[j]))
                    if (bits(i, size) ^ bits(j, size)).bit_count() <= n[i] + n[j] - 2 * need:
                        yield sid[i], sid[j]
                        queue.append(j)
                        continue
                stay.append(j)
            left = stay


def group_pairs(sid: np.ndarray, n: np.ndarray, pos: np.ndarray, raw: list[bytes], label: np.ndarray, side: np.ndarray, t: float, per_pair: int) -> Iterator[tuple[int, int]]:
    """Pairs of a group to check. per_pair 0: a spanning forest of all that may be similar; k: k pairs between any two labels at most; -1: all pairs between labels.

    side tells apart the two blocks of a pair of blocks (0 and 1; 2 is one block, compared within).
    """
    if per_pair == 0 and len(sid) <= 12:
        yield from _small_forest(sid.tolist(), n.tolist(), pos.tolist(), raw, t)
        return
    maps, size = _bitmaps(raw)
    order = np.argsort(sid)
    if per_pair == 0:
        left = order
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                i = queue.pop()
                hit = near(i, left, n, pos, maps, size, t)
                for j in hit:
                    yield int(sid[i]), int(sid[j])
                queue += hit.tolist()
                left = left[~np.isin(left, hit)]
        return
    count: dict[tuple[int, int], int] = {}
    for k, i in enumerate(order):
        rest = order[k + 1 :]
        rest = rest[(label[rest] != label[i]) & ((side[rest] != side[i]) | (side[i] == 2))]
        for j in near(i, rest, n, pos, maps, size, t):
            key = (min(label[i], label[j]), max(label[i], label[j]))
            count[key] = count.get(key, 0) + 1
            if per_pair < 0 or count[key] <= per_pair:
                yield int(min(sid[i], sid[j])), int(max(sid[i], sid[j]))


def _frequent(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams of all texts, sorted, with their rank by count: those frequent in a partition, summed over partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, total = [], 0, 0

        def out() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= max(4, LOCAL_SHARE * rows)
            return pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array(counts[often])], ["key", "n"])

        for batch in batches:
            for own in shingles(common.as_bytes(batch.column("text")), n):
                held.append(own)
                total += len(own)
                rows += 1
                if total > 6_000_000:
                    yield out()
                    held, rows, total = [], 0, 0
        if held:
            yield out()

    counts = common.map_rows(docs.select("text"), run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "key").limit(MAX_FREQUENT).toArrow()
    keys, number = top.column("key").to_numpy().astype(np.int64).view(np.uint64), top.column("n").to_numpy()
    place = np.empty(len(keys), np.int64)
    place[np.lexsort((keys, number))] = np.arange(len(keys))
    order = np.argsort(keys)
    return keys[order], place[order]


def _check(edges: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """The edges (a, b) that have similarity t, by a trie join of all partners of one set at a time."""
    partner = edges.join(sets, F.col("b") == F.col("sid")).select("a", "b", "members")
    center = edges.select("a").distinct().join(sets, F.col("a") == F.col("sid")).select("a", F.lit(None).cast("long").alias("b"), "members")
    rows = partner.unionByName(center).repartition("a").sortWithinPartitions("a", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, held = None, None, []

        def out() -> pa.RecordBatch:
            hits = trie_join(own, held, t)
            return pa.RecordBatch.from_arrays([pa.array([at] * len(hits), pa.int64()), pa.array(hits, pa.int64())], ["a", "b"])

        for batch in batches:
            for a, b, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "members"))):
                if b is None or len(held) >= 256:
                    if held:
                        yield out()
                    held = []
                if b is None:
                    at, own = a, np.frombuffer(raw, np.uint64)
                else:
                    held.append((b, np.frombuffer(raw, np.uint64)))
        if held:
            yield out()

    return common.map_rows(rows, run, "a long, b long")


def _still_near(edges: DataFrame, wide: DataFrame, t: float) -> DataFrame:
    """The edges (a, b) that wider bitmaps of large sets don't rule out; wide has (sid, n, wide)."""
    p = round(100 * t)
    side = lambda c: wide.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("wide").alias(f"w_{c}"))
    both = edges.join(side("a"), "a", "left").join(side("b"), "b", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n_a, n_b, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "w_a", "w_b"))):
                if x is None or y is None:
                    keep.append(True)
                    continue
                size = min(len(x), len(y)) // 8
                x, y = (fold_to(np.frombuffer(m, np.uint64)[None, :], size) for m in (x, y))
                need = -(-p * (n_a + n_b) // (100 + p))
                keep.append(int(np.bitwise_count(x ^ y).sum()) <= n_a + n_b - 2 * need)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return common.map_rows(both.select("a", "b", "n_a", "n_b", "w_a", "w_b"), run, "a long, b long")


def _pairs(rows: DataFrame, t: float, per_pair: int) -> DataFrame:
    """(token, a, b) to check from rows(part, token, sid, n, pos, bits, label, side); a part of a token's group is compared as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        found: list[tuple[int, int, int]] = []

        def compare() -> None:
            if len(held) > 1:
                sid, n, pos, raw, label, side = zip(*held)
                pairs = group_pairs(np.array(sid), np.array(n), np.array(pos), list(raw), np.array(label), np.array(side), t, per_pair)
                found.extend((key[0], min(p), max(p)) for p in pairs)

        def out() -> pa.RecordBatch:
            cols = list(zip(*found)) or [[]] * 3
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["token", "a", "b"])

        for batch in batches:
            for token, part, *row in zip(*(batch.column(c).to_pylist() for c in ("token", "part", "sid", "n", "pos", "bits", "label", "side"))):
                if (token, part) != key:
                    compare()
                    if len(found) > 10_000:
                        yield out()
                    key, held = (token, part), []
                held.append(row)
        compare()
        yield out()

    dealt = rows.repartition("token", "part").sortWithinPartitions("token", "part", "sid")
    return common.map_rows(dealt.select("token", "part", "sid", "n", "pos", "bits", "label", "side"), run, "token long, a long, b long")


def count_links(n: np.ndarray, times: np.ndarray, members: list[np.ndarray], side: np.ndarray, t: float, often: int = 64) -> np.ndarray:
    """For each set, how often the sets that are linked with it occur; only pairs of sides 0 and 1 count, or all where side is 2."""
    row, inside = np.repeat(np.arange(len(n)), [len(s) for s in members]), bool(side[0] == 2)
    _, col, count = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
    a = np.arange(len(n)) if inside else np.flatnonzero(side == 0)
    b = a if inside else np.flatnonzero(side == 1)
    place = np.zeros(len(n), np.int64)
    place[a], place[b] = np.arange(len(a)), np.arange(len(b))
    overlap = np.zeros((len(a), len(b)), np.float32)  # exact for sets of less than 2 ** 24
    many = np.flatnonzero(count > often)
    to = np.full(len(count), -1)
    to[many] = np.arange(len(many))
    at = to[col]
    for lo in range(0, len(many), 512):
        own = (at >= lo) & (at < lo + 512)
        x = np.zeros((len(n), min(512, len(many) - lo)), np.float32)
        x[row[own], at[own] - lo] = 1
        overlap += x[a] @ x[b].T
    rare = np.flatnonzero((count[col] > 1) & (count[col] <= often))
    rare = rare[np.argsort(col[rare], kind="stable")]
    r, c = row[rare], col[rare]
    for k in range(1, often):
        same = np.flatnonzero(c[k:] == c[:-k])
        if not len(same):
            break
        i, j = r[same], r[same + k]
        if inside:
            np.add.at(overlap, (i, j), 1)
            np.add.at(overlap, (j, i), 1)
        else:
            i, j = np.where(side[i] == 0, i, j), np.where(side[i] == 0, j, i)
            cross = (side[i] == 0) & (side[j] == 1)
            np.add.at(overlap, (place[i[cross]], place[j[cross]]), 1)
    out = np.zeros(len(n), np.int64)
    for lo in range(0, len(a), 256):
        own = a[lo : lo + 256]
        link = overlap[lo : lo + 256] >= required(n[own][:, None], n[b][None, :], t)
        if inside:
            link[np.arange(len(own)), np.arange(lo, lo + len(own))] = False
        out[own] += link @ times[b]
        if not inside:
            out[b] += times[own] @ link
    return out


def _links(rows: DataFrame, t: float) -> DataFrame:
    """(sid, n_links) from rows(component, part, sid, n, times, members, side), to be summed by sid; a part of a class is compared as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        done: list[tuple[list, list]] = []

        def compare() -> None:
            if len(held) > 1:
                sid, n, times, raw, side = zip(*held)
                done.append((list(sid), count_links(np.array(n), np.array(times), [np.frombuffer(x, np.uint64) for x in raw], np.array(side), t).tolist()))

        def out() -> pa.RecordBatch:
            cols = [[x for d in done for x in d[k]] for k in (0, 1)]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["sid", "n_links"])

        for batch in batches:
            for class_, part, *row in zip(*(batch.column(c).to_pylist() for c in ("component", "part", "sid", "n", "times", "members", "side"))):
                if (class_, part) != key:
                    compare()
                    if len(done) > 1000:
                        yield out()
                    key, held = (class_, part), []
                held.append(row)
        compare()
        yield out()

    dealt = rows.repartition("component", "part").sortWithinPartitions("component", "part")
    return common.map_rows(dealt.select("component", "part", "sid", "n", "times", "members", "side"), run, "sid long, n_links long")


def similar_sets(docs: DataFrame, n: int = 5, t: float = 0.8, block: int = BLOCK, count: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row of docs(doc_id, text); n_links only if count is set.

    component_id is the smallest doc_id that is reachable over pairs of similarity t or more; the row's own where there is none.
    n_links is the number of other rows of similarity t or more.
    """
    scratch = common.Scratch(docs.sparkSession)
    rank = _frequent(docs, n)
    docs = docs.withColumn("rid", F.xxhash64("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for s in shingles(common.as_bytes(batch.column("text")), n):
                sid = int.from_bytes(xxhash.xxh3_64_digest(s.tobytes()), "big", signed=True)
                known = not len(s) or sid in seen
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(sid)
                first = None if known else ordered(s, rank)[: prefix_length(len(s), t)].view(np.int64)
                rows.append((len(s), sid, first, None if known else bitmap(s), None if known or len(s) <= BITS[1] // 2 else bitmap(s, WIDE)))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), *(pa.array(c, pa.int64()) for c in cols[:2]), pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.binary())], ["doc_id", "rid", "n", "sid", "first", "bits", "wide"])

    all_sets = scratch.put(common.map_rows(docs.select("doc_id", "rid", "text"), make, "doc_id long, rid long, n long, sid long, first array<long>, bits binary, wide binary"), "sets")
    rows = all_sets.where("first is not null").select("sid", "n", F.posexplode("first").alias("pos", "token"))
    often = rows.groupBy("token").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("low <> high").select("token")
    by_size = Window.partitionBy("token").orderBy("n", "sid")
    p = round(100 * t)
    shared = rows.join(often, "token").distinct().withColumns({"below": F.lag("n").over(by_size), "above": F.lead("n").over(by_size)})
    shared = shared.where(f"100 * below >= {p} * n or 100 * n >= {p} * above").drop("below", "above")  # a partner has to be of about that size
    shared = scratch.put(shared.withColumn("blocks", F.ceil(F.count("*").over(Window.partitionBy("token")) / block).cast("int")), "shared")
    bits = all_sets.where("bits is not null").groupBy("sid").agg(F.first("bits").alias("bits"))

    wide = all_sets.where("wide is not null").groupBy("sid").agg(F.first("n").alias("n"), F.first("wide").alias("wide"))

    def remake(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [ordered(s, rank).tobytes() for s in shingles(common.as_bytes(batch.column("text")), n)]
            yield pa.RecordBatch.from_arrays([batch.column("sid"), pa.array(made, pa.binary())], ["sid", "members"])

    def checked(edges: DataFrame, name: str) -> DataFrame:
        """Those of the edges (a, b) that are links; the sets they need are made from the texts again."""
        edges = scratch.put(_still_near(edges, wide, t), f"near-{name}")
        needed = edges.select(F.col("a").alias("sid")).union(edges.select("b")).distinct().join(all_sets.where("bits is not null").groupBy("sid").agg(F.min("rid").alias("rid")), "sid")
        texts = docs.groupBy("rid").agg(F.first("text").alias("text")).join(needed, "rid").select("sid", "text")
        sets = scratch.put(common.map_rows(texts, remake, "sid long, members binary"), f"members-{name}")
        held.append(sets)
        return scratch.put(_check(edges, sets, t), f"links-{name}")

    # Round 1: a spanning forest of what may be similar, within each block of a group.
    placed = shared.join(bits, "sid").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    first = placed.select("token", "sid", "n", "pos", "bits", F.col("own").alias("part"), F.col("sid").alias("label"), F.lit(2).alias("side"))
    forest = scratch.put(_pairs(first, t, 0), "forest")
    tried = scratch.put(forest.select("a", "b").distinct(), "tried-0")
    held: list[DataFrame] = []  # members of all sets that were checked
    links = checked(tried, "0")
    vertices = tried.select(F.col("a").alias("v")).union(tried.select("b")).distinct()
    # Further rounds, for groups of which an edge failed or which have several blocks: pairs between classes that are still
    # apart; a few of each two classes first, then all.
    several = shared.where("blocks > 1")
    label = None
    for k, per_pair in ((1, 2), (2, -1)):
        label = scratch.put(common.connected_components(vertices, links), f"labels-{k}")
        of = lambda c: label.select(F.col("v").alias(c), F.col("component").alias(f"of_{c}"))  # noqa: B023, E731
        failed = forest.join(of("a"), "a").join(of("b"), "b").where("of_a <> of_b").select("token").distinct()
        split = several.join(label, F.col("sid") == F.col("v"), "left").groupBy("token").agg(F.min(F.coalesce("component", "sid")).alias("low"), F.max(F.coalesce("component", "sid")).alias("high")).where("low <> high").select("token")
        open_ = shared.join(failed.union(split).distinct(), "token").join(label, F.col("sid") == F.col("v"), "left").withColumn("label", F.coalesce("component", "sid")).drop("v", "component")
        rest = open_.withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rest = rest.join(bits, "sid").select("token", "sid", "n", "pos", "bits", "label", (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).alias("part"), F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"))
        found = scratch.put(_pairs(rest, t, per_pair), f"found-{k}")
        more = scratch.put(found.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), f"tried-{k}")
        if more.isEmpty():
            if per_pair < 0:
                break
            continue  # the few pairs of each two classes may all have been tried; others are left
        tried, forest = tried.unionByName(more), forest.unionByName(found)
        links = links.unionByName(checked(more, str(k)))
        vertices = tried.select(F.col("a").alias("v")).union(tried.select("b")).distinct()
    else:
        label = scratch.put(common.connected_components(vertices, links), "labels")
    classes = all_sets.join(label, F.col("sid") == F.col("v"), "left").select("doc_id", "sid", "n", F.coalesce("component", "sid").alias("class"))
    # Written, so that the join with a class of a third of all rows can be split.
    lowest = scratch.put(classes.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("lowest")), "lowest")
    joined = classes.join(lowest, "class", "left")
    own = ("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("lowest")).otherwise(F.col("doc_id")).alias("component_id"))
    if not count:
        return joined.select(*own)
    # Links: all pairs of sets of one class, in pairs of blocks. Every set of a class of several was checked, so its members are at hand.
    times = all_sets.where("n > 0").groupBy("sid").agg(F.first("n").alias("n"), F.count("*").alias("times"))
    sizes = scratch.put(label.groupBy("component").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    sized = label.join(sizes, "component").withColumn("blocks", F.ceil(F.col("size") / (2 * block)).cast("int"))
    members = held[0]
    for more in held[1:]:
        members = members.unionByName(more.join(members.select("sid"), "sid", "left_anti"))
    dealt = sized.select(F.col("v").alias("sid"), "component", "blocks").join(times, "sid").join(members, "sid")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("part", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).withColumn("side", F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1))
    linked = scratch.put(_links(dealt, t).groupBy("sid").agg(F.sum("n_links").alias("n_links")), "linked")
    number = times.join(linked, "sid", "left").select(F.col("sid").alias("class_sid"), (F.col("times") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"))
    return joined.join(number, F.col("sid") == F.col("class_sid"), "left").select(*own, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, n: int = 5, t: float = 0.8) -> DataFrame:
    """One row of docs for each class of similar texts: that with the smallest doc_id; of rows with one doc_id, one stays where its text is in a class of more than itself."""
    classes = similar_sets(common.texts(docs), n, t, count=False).select("doc_id", "component_id").distinct()
    stay = classes.where("doc_id = component_id or doc_id is null").select("doc_id")
    numbered = docs.join(stay, docs["doc_id"].eqNullSafe(stay["doc_id"]), "left_semi")
    order = Window.partitionBy("doc_id", "__text").orderBy("__row")
    once = numbered.withColumn("__text", F.xxhash64("text")).withColumn("__row", F.lit(0)).withColumn("__k", F.row_number().over(order))
    return once.where("__k = 1").drop("__text", "__row", "__k")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and numbers of links of all documents by similarity 0.9 of their 3-word shingles."""
    return similar_sets(common.texts(common.table(spark, sf_dir, "documents")), 3, 0.9)
