"""Substring dedup with suffix arrays: every byte under a string of ``LENGTH`` bytes that also starts elsewhere goes.

Strings of ``SHORT`` bytes (about 50 words of prose) that also start elsewhere are found beside them, by the same common
prefixes; they are counted and listed, not removed.

Equal strings have to meet. Each window of ``SHORT`` bytes picks an anchor by its content alone, the last of the smallest
hashes of the ``GRAM``-byte strings in it, so that equal windows pick equal anchors at the same offset. Windows that picked one
anchor lie together and form a record, which has the ``LENGTH`` bytes from each of them (about ``LENGTH`` + 110 bytes of text);
records with equal anchors form a group, and only groups of two records or more can hold a repeated string.

Within a task, the texts of some groups are joined and get a suffix array in two stages: suffixes smaller than their successors
are sorted directly, the others are induced by one scan over the buckets. Common prefixes of neighbours then tell which windows
are repeated, at both lengths. Only those smaller suffixes are ever sorted. Equal texts, and equal records of a group, are counted before they are shuffled and sorted once;
all counts are partial sums that come back by joins. Groups of more than ``HOT`` different records are split: blocks of
``BLOCK_WINDOWS`` windows are dealt out again by the bytes that all windows of a block share, then by single windows, so that no
task holds an unbounded group and no string is missed.

Edge cases: null and empty texts, and texts shorter than ``LENGTH``, lose nothing. Repeated rows count as documents of their
own, so that texts of ``LENGTH`` bytes or more lose all bytes in each of them. Overlapping repeats within one text count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.llm import common

#: Bytes of a string that is removed; of one that is reported; of the strings that are hashed for anchors.
LENGTH, SHORT, GRAM = 400, 300, 80
#: Different records of a group beyond which it is split, and windows of a block then.
HOT, BLOCK_WINDOWS = 512, 16
#: Bytes of text that get one suffix array, about.
CHUNK = 1 << 20
#: Ranks of the suffixes that are sorted take this many bits, so that three of them fit one sort key.
RANK_BITS = 21
#: What replaces the bytes behind the first k of a word: 255, which is in no text.
BEHIND = np.array([(1 << (64 - 8 * k)) - 1 for k in range(9)], np.uint64)
PIECE = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    if not _POWERS:
        n = PIECE + LENGTH
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            _POWERS.append(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]), dtype=np.uint64))
    return _POWERS[0], _POWERS[1]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each w neighbours, from running minima within blocks of w."""
    n = len(x)
    padded = np.concatenate([x, np.full(-n % w, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    back = np.minimum.accumulate(padded, axis=1).ravel()
    return np.minimum(ahead[: n - w + 1], back[w - 1 : n])


def records(b: np.ndarray, length: int = SHORT, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor position, anchor hash) of each run of windows with one anchor."""
    found: list[tuple] = []
    up, down = powers()
    mask = np.uint64((1 << 20) - 1)
    for at in range(0, max(len(b) - length + 1, 0), PIECE):
        part = b[at : at + PIECE + length - 1].astype(np.uint64) + np.uint64(1)
        n = len(part)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * up[:n], dtype=np.uint64)])
        h = common.mix64((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
        key = (h & ~mask) | (mask - np.arange(len(h), dtype=np.uint64))  # of equal hashes the last is the smallest
        anchor = (mask - (sliding_min(key, length - gram + 1) & mask)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(anchor) - 1]])
        found.append((first + at, last + at, anchor[first] + at, h[anchor[first]]))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


ROW = "anchor long, d1 long, d2 long, rid long, firsts array<int>, windows int, lead int, size int"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each different text of a partition, without their bytes; equal records of a text are one row with all their places."""
    seen: set[int] = set()
    for batch in batches:
        out: list[tuple] = []
        for rid, b in zip(batch.column("rid").to_pylist(), common.as_bytes(batch.column("text"))):
            if len(b) < SHORT or rid in seen:
                continue
            if len(seen) > 1_000_000:
                seen.clear()
            seen.add(rid)
            first, last, at, h = records(np.frombuffer(b, np.uint8))
            size = np.minimum(last + LENGTH, len(b)) - first
            d = np.array([_halves(xxhash.xxh3_128_digest(b[x : x + z], w)) for x, z, w in zip(first.tolist(), size.tolist(), (last - first).tolist())], np.int64).reshape(-1, 2)
            order = np.lexsort((d[:, 1], d[:, 0], h))  # stable, so that equal records stay in order of the text
            h, d, first, last, at, size = (x[order] for x in (h, d, first, last, at, size))
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]).any(1)])
            own = np.flatnonzero(new)
            times = np.diff(np.concatenate([own, [len(h)]]))
            out.append((h[own].view(np.int64), d[own], np.full(len(own), rid), (last - first + 1)[own], (at - first)[own], size[own], first, times))
        if not out:
            continue
        anchor, d, rids, windows, lead, size, first, times = (np.concatenate(x) for x in zip(*out))
        firsts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(times)]).astype(np.int32)), pa.array(first.astype(np.int32)))
        cols = [pa.array(anchor), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(rids), firsts, *(pa.array(x.astype(np.int32)) for x in (windows, lead, size))]
        yield pa.RecordBatch.from_arrays(cols, ["anchor", "d1", "d2", "rid", "firsts", "windows", "lead", "size"])


SLICE = "kind int, anchor long, d1 long, d2 long, windows int, slice binary, core long, s1 long, off int, marks array<long>"
_SLICE = pa.schema([
    ("kind", pa.int32()), ("anchor", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("windows", pa.int32()), ("slice", pa.binary()),
    ("core", pa.int64()), ("s1", pa.int64()), ("off", pa.int32()), ("marks", pa.list_(pa.int64())),
])


def _blocks(b: bytes, r: dict, length: int) -> Iterator[tuple]:
    """(windows, core, digest, offset, digests of windows) of each block of a record's windows of `length` bytes."""
    x, first, last = r["first"], r["first"], min(r["first"] + r["windows"], len(b) - length + 1) - 1
    while x <= last:
        q = (r["at"] - x) // BLOCK_WINDOWS
        end = r["at"] - q * BLOCK_WINDOWS  # the last window with this number; every window of this block, of whatever record, holds these bytes
        y = min(last, end)
        core = _signed(xxhash.xxh3_64_intdigest(b[end : end - BLOCK_WINDOWS + 1 + length], q))
        marks = [_signed(xxhash.xxh3_64_intdigest(b[i : i + length], r["at"] - i)) for i in range(x, y + 1)]
        yield y - x + 1, core, _signed(xxhash.xxh3_64_intdigest(b[x : y + length], r["at"] - y)), x - first, marks
        x = y + 1


def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Bytes of the records that stand for a group's different ones (kind 0); of a hot group, blocks of both lengths instead."""
    for batch in batches:
        for b, wanted in zip(common.as_bytes(batch.column("text")), batch.column("wanted").to_pylist()):
            out = []
            for r in wanted:
                key = (r["anchor"], r["d1"], r["d2"])
                if r["m"] <= most:
                    out.append((0, *key, r["windows"], b[r["first"] : r["first"] + r["size"]], None, None, None, None))
                    continue
                for length in (SHORT, LENGTH):
                    out += [(length, *key, n, None, core, s1, off, marks) for n, core, s1, off, marks in _blocks(b, r, length)]
            for i in range(0, len(out), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[i : i + 4096]), _SLICE)], schema=_SLICE)


def _words(t: np.ndarray) -> np.ndarray:
    """The 8 bytes at each position as one number, zeros behind the end; one more position for all that lie beyond."""
    n = len(t)
    wide = np.concatenate([t, np.zeros(9, np.uint8)]).astype(np.uint64)
    word = np.zeros(n + 1, np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | wide[i : i + n + 1]
    return word


def _refined(rank: np.ndarray, live: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """Sorts the tied entries `live` by keys (the first one orders most) within their ranks, which are updated; returns those still tied."""
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    live, keys = live[order], [k[order] for k in keys]
    edges = lambda *xs: np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([x[1:] != x[:-1] for x in xs])]))
    group, new = edges(rank[live]), edges(*keys)
    group_sizes, sizes = np.diff(np.concatenate([group, [len(live)]])), np.diff(np.concatenate([new, [len(live)]]))
    rank[live] += np.repeat(new, sizes) - np.repeat(group, group_sizes)
    return live[np.repeat(sizes > 1, sizes)]


def direct_order(t: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Order of the suffixes at `own`, the positions whose suffix is smaller than its successor. Nothing else is sorted.

    The bytes from one such position to the next are a letter (where one letter begins another, the longer one is smaller, because
    its suffix falls where the other's rises). Letters are ranked from the text; then suffixes that still tie are compared by
    the ranks of three times as many letters in each round, until none tie.
    """
    m, n = len(own), len(t)
    rank, live = np.zeros(m, np.int64), np.arange(m)
    word = _words(t)
    length = np.diff(np.concatenate([own, [own[-1] + n]])) + 1 if m else own  # the last letter runs over the end
    at = 0
    while len(live):
        w = word[np.minimum(own[live] + at, n)] | BEHIND[np.clip(length[live] - at, 0, 8)]
        live = _refined(rank, live, [rank[live], w] if at else [w])
        at += 8
        live = live[length[live] >= at]  # one that ends here is told from longer ones by what stands behind it
    tied = np.bincount(rank, minlength=m)[rank] > 1 if m else np.zeros(0, bool)
    live, k = np.flatnonzero(tied), 1
    ahead = lambda i: np.where(i < m, rank[np.minimum(i, m - 1)], 0)
    while len(live):
        live = _refined(rank, live, [(((rank[live] << RANK_BITS) | ahead(live + k)) << RANK_BITS) | ahead(live + 2 * k)])
        k *= 3
    out = np.empty(m, np.int64)
    out[rank] = own
    return out


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffixes of t (no byte 255, last byte 0 and no smaller one) in order. t has less than 2 ** RANK_BITS bytes."""
    n = len(t)
    if n >= 1 << RANK_BITS:
        raise ValueError(f"a text of {n} bytes is too long for one suffix array")
    # Stage 1: types, then a direct sort of the suffixes that are smaller than their successors.
    change = np.flatnonzero(np.concatenate([t[1:] != t[:-1], [True]]))  # last position of each run of one byte
    rises = np.concatenate([t[1:], [0]])[change] > t[change]
    small = np.repeat(rises, np.diff(np.concatenate([[-1], change])))
    own = direct_order(t, np.flatnonzero(small))
    # Stage 2: one scan over the buckets of first bytes; each suffix puts its larger predecessor at the front of its bucket.
    sizes = np.bincount(t, minlength=256)
    start = np.concatenate([[0], np.cumsum(sizes)])
    head = start[:-1].copy()
    sa = np.empty(n, np.int64)
    own_sizes = np.bincount(t[own], minlength=256)
    from_ = 0
    tails: list[np.ndarray] = []
    for c in range(256):
        tails.append(own[from_ : from_ + own_sizes[c]])
        sa[start[c + 1] - own_sizes[c] : start[c + 1]] = tails[c]
        from_ += own_sizes[c]
    sa[head[0]] = n - 1  # the last suffix has no successor and is the smallest of its bucket
    head[0] += 1

    def induce(batch: np.ndarray) -> None:
        before = batch[batch > 0] - 1
        before = before[~small[before]]
        chars = t[before]
        order = np.argsort(chars, kind="stable")
        before, counts = before[order], np.bincount(chars, minlength=256)
        i = 0
        for d in np.flatnonzero(counts):
            sa[head[d] : head[d] + counts[d]] = before[i : i + counts[d]]
            head[d] += counts[d]
            i += counts[d]

    for c in np.flatnonzero(sizes):
        done = start[c]
        while done < head[c]:
            batch = sa[done : head[c]].copy()
            done = head[c]
            induce(batch)
        if len(tails[c]):
            induce(tails[c])
    return sa


def common_prefixes(t: np.ndarray, sa: np.ndarray, limit: int = LENGTH) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in sa, up to limit (0 for the first).

    A position's common prefix is at most one byte shorter than that of the position before. So every 64th position is compared
    from its start, and those halfway between known ones from what their left neighbour leaves them.
    """
    n = len(t)
    word = _words(t)
    before = np.full(n, n)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int64)

    def extend(at: np.ndarray, have: np.ndarray) -> None:
        other, live = before[at], np.arange(len(at))
        while len(live):
            x, y = at[live] + have[live], other[live] + have[live]
            differ = word[np.minimum(x, n)] ^ word[np.minimum(y, n)]
            whole = differ == 0
            part, some = live[~whole], differ[~whole]
            for i in range(1, 8):
                have[part] += some < np.uint64(1 << (64 - 8 * i))
            live = live[whole]
            have[live] += 8
            live = live[have[live] < limit]
        out[at] = np.minimum(np.minimum(have, limit), n - np.maximum(at, other))

    step = 64
    extend(np.arange(0, n, step), np.zeros(-(-n // step), np.int64))
    while step > 1:
        half = step // 2
        at = np.arange(half, n, step)
        extend(at, np.maximum(out[at - half] - half, 0))
        step = half
    return out[sa]


def longest_repeats(slices: list[bytes], windows: list[int], limit: int = LENGTH) -> list[np.ndarray]:
    """For the first windows[i] positions of each text, how many bytes from there on also start at such a position elsewhere, up
    to limit. Positions behind them only lend their bytes: records of one text overlap there.

    Near a text's end the figure may run over it; callers look at positions with room for what they ask.
    """
    t = np.concatenate([np.concatenate([np.frombuffer(s, np.uint8) + np.uint8(1), np.zeros(1, np.uint8)]) for s in slices])
    starts = np.cumsum([0, *(len(s) + 1 for s in slices[:-1])])
    edge = np.zeros(len(t) + 1, np.int8)
    edge[starts] += 1
    np.add.at(edge, starts + np.array(windows), -1)
    asked = np.cumsum(edge[:-1]).astype(bool)
    sa = suffix_array(t)
    lcp = common_prefixes(t, sa, limit)
    at = np.flatnonzero(asked[sa])
    most = np.zeros(len(t), np.int64)
    if len(at):
        between = np.minimum.reduceat(lcp[: at[-1] + 1], at[:-1] + 1) if len(at) > 1 else lcp[:0]  # smallest from one asked suffix to the next
        most[sa[at]] = np.maximum(np.concatenate([[0], between]), np.concatenate([between, [0]]))
    return [most[at : at + n] for at, n in zip(starts.tolist(), windows)]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of each run of True."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()))


FOUND = "kind int, anchor long, d1 long, d2 long, lo int, hi int"


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix arrays over whole groups, which arrive one after the other."""
    held: list[tuple] = []
    size, last = 0, None

    def flush() -> pa.RecordBatch:
        out = []
        for (*key, _, slice_), most in zip(held, longest_repeats([row[4] for row in held], [row[3] for row in held])):
            for length in (SHORT, LENGTH):
                out += [(length, *key, lo, hi) for lo, hi in _runs(most[: max(0, len(slice_) - length + 1)] >= length)]
        cols = list(zip(*out)) or [[]] * 6
        whole = [pa.array(c, pa.int64()) for c in cols[1:4]]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *whole, *(pa.array(c, pa.int32()) for c in cols[4:])], ["kind", "anchor", "d1", "d2", "lo", "hi"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "d1", "d2", "windows", "slice"))):
            if size >= CHUNK and row[0] != last:
                yield flush()
                held, size = [], 0
            held.append(row)
            size, last = size + len(row[4]) + 1, row[0]
    if held:
        yield flush()


def _merged(row: np.ndarray, s: np.ndarray, e: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes under spans (s, e) of n rows: index of each row's first run and of the last row's end, starts, ends."""
    base = row.astype(np.int64) << 32
    order = np.argsort(base | s)
    row, first, reach = row[order], (base | s)[order], np.maximum.accumulate((base | e)[order])
    new = np.flatnonzero(np.concatenate([[True], first[1:] > reach[:-1]])) if len(order) else order
    low = np.int64((1 << 32) - 1)
    ends = reach[np.concatenate([new[1:] - 1, [len(order) - 1]])] & low if len(order) else order
    return np.searchsorted(row[new], np.arange(n + 1)), first[new] & low, ends


def _pairs(at: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.Array:
    both = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(s) + 1, 2, dtype=np.int32)), pa.array(np.stack([s, e], 1).ravel().astype(np.int32)))
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), both)


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long, n_passages long, spans array<array<int>>, passages array<array<int>>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, spans = common.as_bytes(batch.column("text")), batch.column("spans")
        row, flat = spans.value_parent_indices().to_numpy(zero_copy_only=False), spans.flatten()
        kind, s, e = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in flat.flatten())
        (at, first, last), shared = (_merged(row[own], s[own], e[own], len(raw)) for own in (kind == LENGTH, kind == SHORT))
        digests = []
        for b, i, j in zip(raw, at[:-1].tolist(), at[1:].tolist()):
            kept, done = hashlib.sha256(), 0
            for x, y in zip(first[i:j].tolist(), last[i:j].tolist()):
                kept.update(b[done:x])
                done = y
            kept.update(b[done:])
            digests.append(kept.hexdigest())
        covered = [np.diff(np.concatenate([[0], np.cumsum(y - x)])[k]) for k, x, y in ((at, first, last), shared)]
        counts = [pa.array(x.astype(np.int64)) for x in (np.array([len(b) for b in raw]), covered[0], np.diff(at), covered[1], np.diff(shared[0]))]
        arrays = [*counts[:3], pa.array(digests, pa.string()), *counts[3:], _pairs(at, first, last), _pairs(*shared)]
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared", "n_passages", "spans", "passages"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *names])


def _members(scratch: common.Scratch, rows: DataFrame) -> DataFrame:
    """Records whose anchor occurs at least twice (a text that is there in several partitions may give its records several
    times, which adds equal spans of that text and no others), with n, the occurrences of their bytes, m, the different records of their
    group, and first, whether they stand for all equal ones. Every count is summed partially and written, and comes back by a
    join that adaptive execution can split, so that an anchor that most texts share isn't gathered anywhere."""
    rows = scratch.put(rows, "rows")
    often = scratch.put(rows.groupBy("anchor").agg(F.sum(F.size("firsts")).alias("c")).where("c >= 2").select("anchor"), "often")
    some = scratch.put(rows.join(often.hint("shuffle_hash"), "anchor"), "some")
    scratch.drop("rows")
    key = ["anchor", "d1", "d2"]
    kinds = scratch.put(some.groupBy(key).agg(F.sum(F.size("firsts")).alias("n"), F.min("rid").alias("low")), "kinds")
    sizes = scratch.put(kinds.groupBy("anchor").agg(F.count("*").alias("m")), "sizes")
    members = scratch.put(some.join(kinds.join(sizes, "anchor"), key).selectExpr("* except (low)", "rid = low as first"), "members")
    scratch.drop("often", "some", "kinds", "sizes")
    return members


def _split(scratch: common.Scratch, slices: DataFrame) -> DataFrame:
    """Repeated windows of hot groups: blocks with equal digests whole, what is left of a core window by window."""
    key = ["kind", "core", "s1"]
    blocks = slices.where("kind > 0").select("kind", "anchor", "d1", "d2", "windows", "core", "s1", "off", "marks")
    same = scratch.put(blocks.groupBy(key).agg(F.count("*").alias("n"), F.min(F.struct("anchor", "d1", "d2", "off", "marks")).alias("r")), "same")
    twice = blocks.join(same.where("n >= 2").select(key), key).selectExpr("kind", "anchor", "d1", "d2", "off as lo", "off + windows - 1 as hi")
    shared = scratch.put(same.groupBy("kind", "core").agg(F.count("*").alias("k")).where("k >= 2").select("kind", "core"), "shared")
    single = same.join(shared, ["kind", "core"]).selectExpr("kind", "core", "n", "r.anchor", "r.d1", "r.d2", "r.off", "posexplode(r.marks) as (i, mark)")
    again = scratch.put(single.groupBy("kind", "core", "mark").agg(F.count("*").alias("k")).where("k >= 2").select("kind", "core", "mark"), "again")
    return twice.unionByName(single.where("n = 1").join(again, ["kind", "core", "mark"]).selectExpr("kind", "anchor", "d1", "d2", "off + i as lo", "off + i as hi"))


def repeated_spans(docs: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text) with rid, a 64-bit hash of the text, and (rid, kind, s, e): byte spans of repeated strings of kind
    (``SHORT`` or ``LENGTH``) bytes, by text.

    Texts are told apart by rid; among n different texts the odds that two share one are n * n / 2**65.
    """
    scratch = common.Scratch(docs.sparkSession)
    docs = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("rid", F.xxhash64("text"))
    rows = common.map_rows(docs.where(F.octet_length("text") >= SHORT).select("rid", "text"), _rows, ROW)
    members = _members(scratch, rows)
    one = F.struct("anchor", "d1", "d2", F.col("firsts")[0].alias("first"), "windows", (F.col("firsts")[0] + F.col("lead")).alias("at"), "size", "m")
    wanted = members.where("first and m >= 2").groupBy("rid").agg(F.collect_set(one).alias("wanted"))
    texts = docs.join(wanted.select("rid"), "rid", "semi").groupBy("rid").agg(F.first("text").alias("text"))
    slices = scratch.put(common.map_rows(texts.join(wanted, "rid").select("text", "wanted"), lambda batches: _slices(batches, hot), SLICE), "slices")
    cold = slices.where("kind = 0").select("anchor", "d1", "d2", "windows", "slice").repartition("anchor").sortWithinPartitions("anchor", "d1", "d2")
    found = scratch.put(common.map_rows(cold, _sorted_groups, FOUND).unionByName(_split(scratch, slices)), "found")
    scratch.drop("slices", "same", "shared", "again")
    shared = members.where("n = 1").join(found, ["anchor", "d1", "d2"]).selectExpr("rid", "kind", "firsts[0] + lo as s", "firsts[0] + hi + kind as e")
    whole = members.where("n >= 2").selectExpr("rid", "windows", "size", "explode(firsts) as s").selectExpr("rid", "s", "s + windows - 1 as last", "s + size as end")
    twice = docs.groupBy("rid").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("end")).where("n >= 2").selectExpr("rid", "0 as s", "end")
    parts = [shared]
    for kind in (SHORT, LENGTH):
        parts.append(whole.where(f"end - s >= {kind}").selectExpr("rid", f"{kind} as kind", "s", f"least(last + {kind}, end) as e"))
        parts.append(twice.where(f"end >= {kind}").selectExpr("rid", f"{kind} as kind", "s", "end as e"))
    spans = parts[0]
    for p in parts[1:]:
        spans = spans.unionByName(p)
    spans = scratch.put(spans, "spans")
    scratch.drop("members", "found")
    return docs, spans


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """For every row of docs(doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared and n_passages (bytes under
    strings of ``SHORT`` bytes that also start elsewhere, and their maximal runs), and both kinds of runs as byte spans."""
    docs, spans = repeated_spans(docs, hot)
    per_text = spans.groupBy("rid").agg(F.collect_list(F.struct("kind", "s", "e")).alias("spans"))
    return common.map_rows(docs.join(per_text, "rid", "left").select("doc_id", "text", "spans"), _cut, CUT)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 400-byte strings of every whole text of documents, removed."""
    return remove_repeats(common.texts(common.table(spark, sf_dir, "documents"))).drop("spans", "passages")
