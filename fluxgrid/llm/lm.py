"""Language-model scores by context-tree weighting over bytes.

A text is the byte string of its lower-cased words joined by single spaces and closed by an end byte. Each byte is eight binary
decisions, and each decision has a context tree of its own over the ``DEPTH`` bytes before. Every node holds a
Krichevsky-Trofimov estimate; a node's weight against its children comes from the block probabilities of the training data, so
that estimates of all depths are mixed. Counts cover every training document and no node is left out.

The tree is a table: byte (DEPTH+1)-grams are counted per partition and dealt by a hash of their ``TOP`` + 1 latest context bytes
into buckets whose number follows the training bytes, so that a bucket holds whole subtrees. Only the nodes of depth 0 to ``TOP``
(at most 256 ** (TOP + 1) grams, whatever the corpus) go to the driver and to all workers. Documents are dealt into blocks; a
block asks the buckets for its distinct grams, and what they answer comes back to the block in a shuffle.

The word base model needs the exact count of every token. Counts of the ``MAX_FREQUENT`` most frequent tokens are broadcast;
all other tokens meet their counts in a shuffled join by the 64-bit hash of the token.

Edge cases: null is an empty text, which has the end token only. Without training documents the tree is empty (every decision
1/2) and all counts are 0. Repeated rows give repeated result rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.llm import common

DEPTH = 5
#: Deepest nodes that go to all workers; deeper ones are in a bucket with all that share TOP + 1 context bytes.
TOP = 2
#: Tokens whose counts are broadcast; all others are joined.
MAX_FREQUENT = 300_000
#: Training bytes a bucket of the tree, and bytes of documents that ask for their grams together.
BUCKET_BYTES, ASK_BYTES = 4 << 20, 16 << 20
#: Sums of block probabilities are taken in whole parts of this size, so that their order doesn't matter.
PARTS = 1 << 24
END, PAD = b"\n", b"\x0b"
#: Bytes of text that a worker turns into grams at once, and entries of its counters before it hands them on.
BLOCK, FLUSH = 1 << 20, 1_000_000
END_KEY = np.uint64(xxhash.xxh3_64_intdigest(END))


def row_key(doc_id: int | None, raw: bytes) -> int:
    """Signed 64-bit key of a row; rows with equal doc_id and text have one."""
    k = xxhash.xxh3_64_intdigest(f"{doc_id}\0".encode() + raw)
    return k - (1 << 64) if k >> 63 else k


def grams(texts_: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all positions of some texts, and the text each belongs to. A key has the latest byte of the context on top, the coded byte last."""
    texts = [b" ".join(t.lower().split()) + END for t in texts_]
    buf = np.frombuffer(b"".join(PAD * DEPTH + t for t in texts), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths + DEPTH) - lengths
    owner = np.repeat(np.arange(len(texts)), lengths)
    at = np.arange(len(owner)) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    key = np.zeros(len(at), np.uint64)
    wide = buf.astype(np.uint64)
    for d in range(1, DEPTH + 1):
        key = (key << np.uint64(8)) | wide[at - d]
    return (key << np.uint64(8)) | wide[at], owner


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class _Sums:
    """Counts by key that are merged as they grow."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        self.held.append(np.unique(keys, return_counts=True))
        self.size += len(self.held[-1][0])
        if self.size > 4 * FLUSH:
            self.held = [_summed(*(np.concatenate(x) for x in zip(*self.held)))]
            self.size = len(self.held[0][0])

    def take(self, least: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.held and self.size > least:
            keys, counts = _summed(*(np.concatenate(x) for x in zip(*self.held)))
            self.held, self.size = [], 0
            yield keys, counts


def _tokens(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the tokens of some texts, the end tokens last, and the text each belongs to."""
    h, per = common.word_hashes(raw)
    return np.concatenate([h, np.full(len(raw), END_KEY)]), np.concatenate([np.repeat(np.arange(len(raw)), per), np.arange(len(raw))])


def _packed(x: np.ndarray) -> bytes:
    """Eight-byte values with equal bytes of all values side by side, which compress well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(b: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(kind).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(b, np.uint64), dtype=np.uint64)


def _dealt(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket of sorted gram keys with the places of its keys, in order."""
    of = (common.mix64(keys >> np.uint64(8 * (DEPTH - TOP))) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else []:
        yield int(of[at[0]]), at


def _count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Partial counts: a row for each token, and a row for all grams of a bucket."""
    tokens, whole = _Sums(), _Sums()

    def out(sums: _Sums, least: int = 0) -> Iterator[pa.RecordBatch]:
        for keys, counts in sums.take(least):
            if sums is tokens:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.int32()), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64)), pa.nulls(len(keys), pa.binary()), pa.nulls(len(keys), pa.binary())], names)
                continue
            rows = [(b, _pack_keys(keys[at]), _packed(counts[at].astype(np.int64))) for b, at in _dealt(keys, buckets)]
            b, k, n = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.nulls(len(b), pa.int64()), pa.nulls(len(b), pa.int64()), pa.array(k, pa.binary()), pa.array(n, pa.binary())], names)

    names = ["bucket", "key", "n", "keys", "counts"]
    for batch in batches:
        for _, raw in common.pieces(common.as_bytes(batch.column("text")), BLOCK):
            tokens.add(_tokens(raw)[0])
            whole.add(grams(raw)[0])
            yield from out(tokens, 3 * FLUSH)
            yield from out(whole, 3 * FLUSH)
    yield from out(tokens)
    yield from out(whole)


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function, by Stirling's series at x + 8."""
    y = x + 8.0
    s = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3)
    for i in range(8):
        s = s - np.log(x + i)
    return s


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability of n0 zeros and n1 ones."""
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - lgamma(n0 + n1 + 1.0) - np.log(np.pi)


def shorter(keys: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram keys with `depth` context bytes and their counts, from those of all DEPTH."""
    context = (keys >> np.uint64(8 * (DEPTH - depth) + 8)) << np.uint64(8) if depth else np.uint64(0)
    return _summed(context | (keys & np.uint64(255)), counts)


@dataclass
class Tree:
    """Nodes by depth (from `first` on) and level of the binary decomposition, in order of their keys (context bytes, then the bits so far)."""

    keys: list[list[np.ndarray]] = field(default_factory=list)
    one: list[list[np.ndarray]] = field(default_factory=list)  # estimate of bit 1
    own: list[list[np.ndarray]] = field(default_factory=list)  # weight of a node's estimate against its children's
    roots: list[np.ndarray] = field(default_factory=list)  # log block probability of the nodes of the first depth, by level
    first: int = 0

    @classmethod
    def build(cls, by_depth: list[tuple[np.ndarray, np.ndarray]], first: int = 0, below_: list[tuple[np.ndarray, np.ndarray]] | None = None) -> Tree:
        """From sorted (context bytes, byte) keys and counts at each depth from `first` on.

        below_ has, for each level, nodes of the last depth (sorted keys) and the sums of the log block probabilities of their children.
        """
        tree = cls(first=first)
        nodes: list[list[tuple]] = []
        for keys, counts in by_depth:
            levels = []
            for j in range(8):
                node, bit = keys >> np.uint64(8 - j), (keys >> np.uint64(7 - j)) & np.uint64(1)
                start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
                sums = [np.add.reduceat(counts * (bit == b), start).astype(float) if len(start) else np.zeros(0) for b in (0, 1)]
                levels.append((node[start], *sums))
            nodes.append(levels)
        tree.keys = [[x[0] for x in levels] for levels in nodes]
        tree.one = [[((n1 + 0.5) / (n0 + n1 + 1)).astype(np.float32) for _, n0, n1 in levels] for levels in nodes]
        tree.own = [[np.ones(len(x[0]), np.float32) for x in levels] for levels in nodes]
        for j in range(8):
            below = None  # log block probability of the nodes one deeper
            for d in range(len(nodes) - 1, -1, -1):
                key, n0, n1 = nodes[d][j]
                e = kt_log(n0, n1)
                if below is not None:
                    k = nodes[d + 1][j][0]
                    low = np.uint64((1 << j) - 1)
                    parent = ((k >> np.uint64(8 + j)) << np.uint64(j)) | (k & low)
                    children = np.bincount(np.searchsorted(key, parent), below, len(key))
                elif below_ is not None:
                    children = np.bincount(np.searchsorted(key, below_[j][0]), below_[j][1], len(key))
                else:
                    below = e
                    continue
                below = np.log(0.5) + np.logaddexp(e, children)
                tree.own[d][j] = np.exp(np.log(0.5) + e - below).astype(np.float32)
            tree.roots.append(below if below is not None else np.zeros(0))
        return tree

    def bits(self, keys: np.ndarray, above: Tree | None = None) -> np.ndarray:
        """log10 probability of each gram's last byte after its context, all depths mixed, those of the tree above included."""
        total = np.zeros(len(keys))
        byte = keys & np.uint64(255)
        for j in range(8):
            bit = (byte >> np.uint64(7 - j)) & np.uint64(1)
            p, seen = np.full(len(keys), 0.5), np.zeros(len(keys), bool)
            for tree in (self, above) if above is not None else (self,):
                for i in range(len(tree.keys) - 1, -1, -1):
                    d = tree.first + i
                    node = ((keys >> np.uint64(8 * (DEPTH - d) + 8)) << np.uint64(j)) | (byte >> np.uint64(8 - j)) if d else byte >> np.uint64(8 - j)
                    have = tree.keys[i][j]
                    if not len(have):
                        continue
                    at = np.minimum(np.searchsorted(have, node), len(have) - 1)
                    here = have[at] == node
                    w = np.where(seen, tree.own[i][j][at], 1.0)
                    p = np.where(here, w * tree.one[i][j][at] + (1 - w) * p, p)
                    seen |= here
            total += np.log10(np.where(bit == 1, p, 1 - p))
        return total


def _subtree(keys: np.ndarray, counts: np.ndarray) -> Tree:
    """The nodes deeper than TOP of the grams of a bucket."""
    return Tree.build([shorter(keys, counts, d) for d in range(TOP + 1, DEPTH + 1)], TOP + 1)


def _frequent(counted: DataFrame, limit: int) -> DataFrame:
    """The rows with the largest n, `limit` at most, by a threshold from a histogram of log2(n)."""
    bin_ = F.floor(F.log2("n") * 64).cast("int")
    total, least = 0, None
    for r in sorted(counted.groupBy(bin_.alias("b")).count().collect(), reverse=True):
        if total + r["count"] > limit:
            break
        total, least = total + r["count"], r["b"]
    return counted.where(bin_ >= least) if least is not None else counted.limit(0)


@dataclass
class Model:
    top: Tree  # nodes of depth 0 to TOP
    grams: DataFrame  # bucket, keys, counts of all grams
    buckets: int
    frequent: tuple[np.ndarray, np.ndarray]  # keys, in order, and counts of the most frequent tokens
    counts: DataFrame  # key, n of all tokens
    total: int  # N
    distinct: int  # V


def _merged(part: pa.Table) -> pa.Table:
    """One row for all grams of a bucket; for the nodes of depth TOP above them, sums of the log block probabilities below (levels 0 to 7) and gram counts (level 8)."""
    keys, counts = _summed(np.concatenate([_unpack_keys(k) for k in part["keys"].to_pylist()]), np.concatenate([_unpacked(n, np.int64) for n in part["counts"].to_pylist()]))
    tree = _subtree(keys, counts)
    level, node, value = [], [], []
    for j in range(8):
        k = tree.keys[0][j]
        parent = ((k >> np.uint64(8 + j)) << np.uint64(j)) | (k & np.uint64((1 << j) - 1))
        node_, value_ = _summed(parent, np.rint(tree.roots[j] * PARTS).astype(np.int64))
        level.append(np.full(len(node_), j)), node.append(node_), value.append(value_)
    node_, value_ = shorter(keys, counts, TOP)
    level.append(np.full(len(node_), 8)), node.append(node_), value.append(value_)
    n = sum(map(len, node))
    cols = [pa.array([part["bucket"][0].as_py()] + [None] * n, pa.int32()), pa.array([_pack_keys(keys)] + [None] * n, pa.binary()), pa.array([_packed(counts)] + [None] * n, pa.binary())]
    more = (pa.array(np.concatenate([[0], *x]).astype(np.int64)) for x in (level, node, value))
    return pa.Table.from_arrays([*cols, *more], names=["bucket", "keys", "counts", "level", "node", "value"])


def fit(docs: DataFrame) -> Model:
    """Counts every document of docs."""
    scratch = common.Scratch(docs.sparkSession)
    buckets = -(-int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // BUCKET_BYTES)
    partial = scratch.put(common.map_rows(docs.select("text"), lambda batches: _count(batches, buckets), "bucket int, key long, n long, keys binary, counts binary"), "partial")
    tokens = partial.where("bucket is null").groupBy("key").agg(F.sum("n").alias("n")).checkpoint()
    merged = scratch.put(partial.where("bucket is not null").select("bucket", "keys", "counts").groupBy("bucket").applyInArrow(_merged, "bucket int, keys binary, counts binary, level long, node long, value long"), "grams")
    scratch.drop("partial")
    distinct, total = tokens.agg(F.count("*"), F.sum("n")).first()
    top = _frequent(tokens, MAX_FREQUENT).toArrow()
    frequent = _summed(top.column("key").to_numpy().astype(np.int64).view(np.uint64), top.column("n").to_numpy().astype(np.int64))
    sums = merged.where("bucket is null").groupBy("level", "node").agg(F.sum("value").alias("value")).toArrow()
    level, node, value = (sums.column(c).to_numpy().astype(np.int64) for c in ("level", "node", "value"))
    by_level = [_summed(node[level == j].astype(np.uint64), value[level == j]) for j in range(9)]
    keys, counts = by_level[8]
    by_depth = [shorter(keys << np.uint64(8 * (DEPTH - TOP)) | (keys & np.uint64(255)), counts, d) for d in range(TOP + 1)]
    tree = Tree.build(by_depth, 0, [(k, v / PARTS) for k, v in by_level[:8]])
    return Model(tree, merged.where("bucket is not null").select("bucket", "keys", "counts"), buckets, frequent, tokens, int(total or 0), int(distinct))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the block they ask in: neighbours in a partition, ASK_BYTES or one text beyond."""
    size, start = 0, TaskContext.get().partitionId() << 32
    for batch in batches:
        block = []
        for b in common.as_bytes(batch.column("text")):
            block.append(start + size // ASK_BYTES)
            size += len(b)
        yield batch.append_column("block", pa.array(block, pa.int64()))


def _asked(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """A row for all distinct grams of a block that are in one bucket."""
    sums, at = _Sums(), None

    def out() -> Iterator[pa.RecordBatch]:
        for keys, _ in sums.take():
            b, k = zip(*((b, _pack_keys(keys[own])) for b, own in _dealt(keys, buckets)))
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array([at] * len(b), pa.int64()), pa.array(k, pa.binary()), pa.nulls(len(b), pa.binary())], ["bucket", "block", "keys", "counts"])

    for batch in batches:
        blocks = batch.column("block").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)] if len(blocks) else []
        for a, b in zip(edges, edges[1:]):
            if int(blocks[a]) != at:
                yield from out()
                at = int(blocks[a])
            for _, raw in common.pieces(common.as_bytes(batch.column("text").slice(a, b - a)), BLOCK):
                sums.add(grams(raw)[0])
    yield from out()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out as given, n_tokens, n_known, train_tokens, base_score, score and bits per byte for every row of docs(doc_id, text, held_out)."""
    spark = docs.sparkSession
    scratch = common.Scratch(spark)
    top, sent = spark.sparkContext.broadcast(model.top), spark.sparkContext.broadcast(model.frequent)
    floor = model.total + 0.5 * (model.distinct + 1)
    buckets = model.buckets

    def answer(part: pa.Table) -> pa.Table:
        blocks, asked, train = [], [], []
        for block, keys, counts in zip(*(part[c].to_pylist() for c in ("block", "keys", "counts"))):
            if block is None:
                train.append((_unpack_keys(keys), _unpacked(counts, np.int64)))
            else:
                blocks.append(block), asked.append(_unpack_keys(keys))
        if not asked:
            return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.binary()), pa.array([], pa.binary())], names=["block", "keys", "scores"])
        own = np.unique(np.concatenate(asked))
        tree = _subtree(*_summed(*(np.concatenate(x) for x in zip(*train)))) if train else Tree()
        known = np.concatenate([tree.bits(own[i : i + 200_000], top.value) for i in range(0, len(own), 200_000)]).astype(np.float32)
        scores = [known[np.searchsorted(own, k)].tobytes() for k in asked]
        return pa.Table.from_arrays([pa.array(blocks, pa.int64()), pa.array([_pack_keys(k) for k in asked], pa.binary()), pa.array(scores, pa.binary())], names=["block", "keys", "scores"])

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        often, counts = sent.value
        value = np.log10((counts + 0.5) / floor)
        asked = np.concatenate([_unpack_keys(k) for k in answers["keys"].to_pylist()] or [np.zeros(0, np.uint64)])
        order = np.argsort(asked)
        asked, known_score = asked[order], np.concatenate([np.frombuffer(x, np.float32) for x in answers["scores"].to_pylist()] or [np.zeros(0, np.float32)])[order].astype(float)
        out = []
        for batch in rows.combine_chunks().to_batches():
            ids, held = batch.column("doc_id"), batch.column("held_out")
            for first, raw in common.pieces(common.as_bytes(batch.column("text")), BLOCK):
                n = len(raw)
                keys, owner = grams(raw)
                own, back = np.unique(keys, return_inverse=True)
                scores, sizes = np.bincount(owner, known_score[np.searchsorted(asked, own)][back], n), np.bincount(owner, minlength=n)
                token, of = _tokens(raw)
                at = np.minimum(np.searchsorted(often, token), max(len(often) - 1, 0))
                known = often[at] == token if len(often) else np.zeros(len(token), bool)
                base = np.bincount(of[known], value[at[known]], n) if known.any() else np.zeros(n)
                main = pa.StructArray.from_arrays([ids.slice(first, n), held.slice(first, n), *(pa.array(x) for x in (np.bincount(of, minlength=n), np.bincount(of[known], minlength=n), base, scores, sizes))], fields=list(MAIN))
                rare, of = token[~known], of[~known]
                order = np.lexsort((of, rare))
                rare, of = rare[order], of[order]
                new = np.flatnonzero(np.concatenate([[True], (rare[1:] != rare[:-1]) | (of[1:] != of[:-1])])) if len(rare) else np.zeros(0, np.int64)
                rid = np.array([row_key(d, b) for d, b in zip(ids.slice(first, n).to_pylist(), raw)], np.int64)
                # the row with a text's results joins nothing; its key spreads it
                out.append(pa.RecordBatch.from_arrays([pa.array(np.concatenate([rid, rid[of[new]]])), pa.array(np.concatenate([rid, rare[new].view(np.int64)])), pa.array(np.concatenate([np.ones(n, np.int64), np.diff(np.concatenate([new, [len(rare)]]))])), pa.concat_arrays([main, pa.nulls(len(new), MAIN)])], ["rid", "key", "tf", "main"]))
        return pa.Table.from_batches(out)

    dealt = scratch.put(common.map_rows(docs.select("doc_id", "text", "held_out"), _blocks, "doc_id long, text string, held_out boolean, block long"), "blocks")
    asked = common.map_rows(dealt.select("block", "text"), lambda batches: _asked(batches, buckets), "bucket int, block long, keys binary, counts binary")
    both = asked.unionByName(model.grams.withColumn("block", F.lit(None).cast("long")))
    answers = scratch.put(both.groupBy("bucket").applyInArrow(answer, "block long, keys binary, scores binary"), "answers")
    rows = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "rid long, key long, tf long, main struct<doc_id:long,held_out:boolean,n_tokens:long,n_known:long,base:double,score:double,n_bytes:long>")
    joined = rows.join(model.counts, "key", "left")
    c = F.coalesce("n", F.lit(0))
    rare = F.col("main").isNull()
    per = joined.groupBy("rid").agg(
        F.max("main").alias("m"), F.sum(F.when(rare, 0).otherwise(1)).cast("int").alias("times"),
        F.sum(F.when(rare & (c > 0), F.col("tf")).otherwise(0)).alias("known"),
        F.sum(F.when(rare, F.col("tf") * F.log10((c + 0.5) / F.lit(float(floor)))).otherwise(0.0)).alias("base"),
    )
    return per.select(
        "m.doc_id", "m.held_out", "m.n_tokens", (F.col("m.n_known") + F.expr("known div times")).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("m.base") + F.col("base") / F.col("times")).alias("base_score"), F.col("m.score").alias("score"), (-F.col("m.score") / F.lit(float(np.log10(2))) / F.col("m.n_bytes")).alias("bits_per_byte"), F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy"),
    ).drop("copy")


MAIN = pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())])


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text of documents; the held-out fold takes no part in the counts."""
    docs = common.texts(common.table(spark, sf_dir, "documents")).withColumn("held_out", common.fold(5) == 1)
    return score(docs, fit(docs.where(~F.col("held_out"))))
