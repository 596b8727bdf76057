"""Benchmark decontamination by latent semantic retrieval.

Documents are read as overlapping passages of three blocks of ``STEP`` words. Passages and benchmark items become TF-IDF vectors
over the benchmark's informative words; a distributed randomised SVD of all passages, with the items among them, gives the
latent space: every task adds its passages' part of A'(A X) for a thin random matrix X, the parts are summed in a shuffle, and what
is left spans the leading right singular vectors. Passages whose cosine with an item reaches ``MIN_COSINE`` are candidates.
A candidate is a leak if the longest common subsequence of words covers ``SURE`` of the item, or ``MAYBE`` of it and the answer
(what follows "answer:", else the item's last words) is there too; and if the item's informative words alone are covered by
``INFORMATIVE``, so that frequent words don't make a leak.

An item longer than a passage is sought by parts of ``PART`` words or less; the text around a candidate that is held against the whole
item grows with the item, by what lies before and behind the part and a margin.

Items are taken in blocks of ``MAX_ITEMS`` parts, so that what is sent to the workers is bounded whatever the benchmark's size. Words
are compared in lower case without marks at either end; only words of the block's items are kept of a document.

Edge cases: null and empty texts and items have no words and leak nothing. A document shorter than a passage is one passage.
Repeated documents are each reported; repeated items too, one row each. A null doc_id stays null. An empty benchmark or an empty
table gives no row. Of one item in one document, the best passage is reported; ties go to the first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.llm import common

STEP, WIDTH = 24, 3
MAX_ITEMS, RANK, SPARE, STEPS = 256, 192, 16, 1
#: Words in a part of an item that is longer than a passage; and the margin of its text, as a share of the item.
PART, MARGIN = 48, 0.25
#: A word in more than this share of blocks says little; of an item that would keep too few words, the rarest ones stay.
COMMON, LEAST_WORDS = 0.0007, 8
MIN_COSINE, MAYBE, SURE, INFORMATIVE = 0.35, 0.5, 0.7, 0.5
ANSWER_WORDS, ANSWER_SHARE = 5, 0.6
EDGES = b".,;:!?\"'()[]"
ANSWER = re.compile(rb"(?i)\banswer\s*[:=]\s*")


def split(raw: bytes) -> list[bytes]:
    return [w for w in (x.strip(EDGES) for x in raw.lower().split()) if w]


def common_subsequence(item: list[int], text: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over the item's words."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in text.tolist():
        m = masks.get(w)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(item) - row.bit_count()


def n_parts(n: int) -> int:
    """Parts by which an item of n words is sought."""
    return 1 if n <= STEP * WIDTH else -(-n // PART)


class Items:
    """One block of benchmark items: vocabulary, words, answers, and the parts (item, first word, words) by which they are sought."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        words = [(i, split(raw), split(raw[m.end() :]) if (m := ANSWER.search(raw)) else None) for i, raw in rows]
        words = [x for x in words if x[1]]
        vocabulary = sorted({w for _, ws, _ in words for w in ws})
        self.number = {w: i for i, w in enumerate(vocabulary)}
        self.ids = [i for i, _, _ in words]
        self.words = [[self.number[w] for w in ws] for _, ws, _ in words]
        self.answers = [[self.number[w] for w in a] if a else ws[-ANSWER_WORDS:] for (_, _, a), ws in zip(words, self.words)]
        self.parts: list[tuple[int, int, list[int]]] = []
        for i, ws in enumerate(self.words):
            edges = [len(ws) * k // n_parts(len(ws)) for k in range(n_parts(len(ws)) + 1)]
            self.parts += [(i, a, ws[a:b]) for a, b in zip(edges, edges[1:])]


def _numbered(docs: DataFrame, items: Items) -> DataFrame:
    """Each document as the numbers of its words, -1 for a word that no item has."""
    number = items.number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for raw in common.as_bytes(batch.column("text")):
                made.append(np.array([number.get(w, -1) for w in split(raw)], np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.binary())], ["doc_id", "words"])

    return common.map_rows(docs.select("doc_id", "text"), run, "doc_id long, words binary")


class Batch:
    """Blocks of the documents of one batch. Each document has WIDTH - 1 empty blocks behind it, so that passages don't run into the next."""

    def __init__(self, batch: pa.RecordBatch):
        self.docs = [np.frombuffer(x, np.int32) for x in batch.column("words").to_pylist()]
        n = np.array([len(d) for d in self.docs], np.int64)
        per = -(-n // STEP)
        self.first = np.concatenate([[0], np.cumsum(per + WIDTH - 1)])  # a document's first block
        self.n_blocks = int(self.first[-1])
        self.filled = int(per.sum())
        word = np.concatenate(self.docs) if self.docs else np.zeros(0, np.int32)
        at = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
        block = np.repeat(self.first[:-1], n) + at // STEP
        known = word >= 0
        self.word, self.block = word[known], block[known]

    def passages(self, rows: np.ndarray, word: np.ndarray, block: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """First blocks of the passages with `least` of the given words or more, and the sum over each of rows[word]."""
        n = np.bincount(block, minlength=self.n_blocks + WIDTH)
        many = n[: self.n_blocks].copy()
        for k in range(1, WIDTH):
            many += n[k : self.n_blocks + k]
        own = np.flatnonzero(many >= least)
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
        e = np.zeros((len(first) + 1, rows.shape[1]), np.float32)  # the last row is that of an empty block
        place = np.full(self.n_blocks + WIDTH, len(first))
        if len(first):
            e[:-1] = np.add.reduceat(rows[word], first, axis=0)
            place[block[first]] = np.arange(len(first))
        y = e[place[own]]
        for k in range(1, WIDTH):
            y += e[place[own + k]]
        return own, y


def _document_frequency(numbered: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """Number of blocks, and of blocks that hold each word, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts = 0, np.zeros(size, np.int64)
        for batch in batches:
            b = Batch(batch)
            total += b.filled
            counts += np.bincount(np.unique(b.block * size + b.word) % size, minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, size)), pa.array(np.concatenate([[total], counts]))], ["word", "n"])

    rows = common.map_rows(numbered, run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size + 1, np.int64)
    out[rows.word.to_numpy(int) + 1] = rows.n.to_numpy(int)
    return int(out[0]), out[1:]


def _gram_times(numbered: DataFrame, column: np.ndarray, weight: np.ndarray, x: np.ndarray, slices: int = 16) -> np.ndarray:
    """A'(A x), A being the weighted passages of all documents; column gives a word's column in A or -1."""
    sent = numbered.sparkSession.sparkContext.broadcast((column, weight.astype(np.float32), (weight[:, None] * x).astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column, weight, rows = sent.value
        z = np.zeros(rows.shape)
        for batch in batches:
            b = Batch(batch)
            c = column[b.word]
            word, block = c[c >= 0], b.block[c >= 0]
            if not len(word):
                continue
            own, y = b.passages(rows, word, block)
            place = np.full(b.n_blocks + WIDTH, len(own))
            place[own + WIDTH - 1] = np.arange(len(own))
            y = np.concatenate([y, np.zeros((1, y.shape[1]), np.float32)])
            held = np.unique(block)
            g = y[place[held]]  # sums over the passages that hold each block
            for k in range(1, WIDTH):
                g += y[place[held + k]]
            row = np.searchsorted(held, block)
            order = np.argsort(word, kind="stable")
            at = np.flatnonzero(np.concatenate([[True], word[order][1:] != word[order][:-1]]))
            own = word[order][at]
            z[own] += weight[own, None] * np.add.reduceat(g[row[order]], at, axis=0)
        parts = np.array_split(z, slices)
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "z"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, z in zip(batch.column("slice").to_pylist(), batch.column("z").to_pylist()):
                z = np.frombuffer(z)
                sums[s] = sums[s] + z if s in sums else z
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([z.tobytes() for z in sums.values()], pa.binary())], ["slice", "z"])

    parts = common.map_rows(numbered.select("words"), run, "slice int, z binary").repartition(slices, "slice")
    rows = sorted(common.map_rows(parts, add, "slice int, z binary").collect())
    return np.concatenate([np.frombuffer(r.z) for r in rows]).reshape(x.shape) if rows else np.zeros(x.shape)


def latent_space(numbered: DataFrame, items: Items, rank: int = RANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column of each word or -1, rows of the projection with idf in them, unit vectors of the items' parts)."""
    size = len(items.number)
    total, df = _document_frequency(numbered, size)
    idf = np.log((total + 1) / (df + 1)) + 1
    keep = df <= COMMON * total
    for _, _, ws in items.parts:
        own = np.unique(ws)
        keep[own[np.argsort(df[own], kind="stable")[:LEAST_WORDS]]] = True
    column = np.where(keep, np.cumsum(keep) - 1, -1)
    weight = idf[keep]
    b = np.zeros((len(items.parts), len(weight)))
    for i, (_, _, ws) in enumerate(items.parts):
        c = column[np.array(ws)]
        np.add.at(b[i], c[c >= 0], 1.0)
    b *= weight
    share = np.sqrt(max(total, 1) / max(len(b), 1))  # the items weigh as much as the passages together
    rng = np.random.default_rng(11)
    x = rng.normal(size=(len(weight), min(rank + SPARE, len(weight))))
    for _ in range(STEPS):
        x = np.linalg.qr(x)[0]
        x = _gram_times(numbered, column, weight, x) + share**2 * (b.T @ (b @ x))
    v = np.linalg.svd(x, full_matrices=False)[0][:, :rank]
    q = b @ v
    return column, weight[:, None] * v, q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)


def _search(numbered: DataFrame, items: Items, space: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    column, rows, q = space
    sent = numbered.sparkSession.sparkContext.broadcast((column, rows.astype(np.float32), q.astype(np.float32), items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column, rows, q, items = sent.value
        telling = [[w for w in ws if column[w] >= 0] for ws in items.words]
        words, tells = [set(ws) for ws in items.words], [set(ws) for ws in telling]
        # A common subsequence has no more words than both have, repeats counted; that is cheap to see first.
        enough = [(MAYBE * len(ws) - (len(ws) - len(w)), INFORMATIVE * len(ts) - (len(ts) - len(t))) for ws, w, ts, t in zip(items.words, words, telling, tells)]
        least = max(1, int(np.ceil(0.8 * INFORMATIVE * min(sum(column[w] >= 0 for w in ws) for _, _, ws in items.parts))))  # no leak has fewer informative words of some part, four in five of them in one passage
        for batch in batches:
            b = Batch(batch)
            out: dict[tuple[int, int], tuple] = {}
            c = column[b.word]
            word, block = c[c >= 0], b.block[c >= 0]
            own, y = b.passages(rows, word, block, least)
            y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
            cosine = y @ q.T
            last = None
            checked: set[tuple[int, int, int]] = set()  # texts that were held against an item of several parts
            for p, part in zip(*(x.tolist() for x in np.nonzero(cosine >= MIN_COSINE))):
                i, start, own_words = items.parts[part]
                d = int(np.searchsorted(b.first, own[p], side="right")) - 1
                at = int(own[p] - b.first[d]) * STEP
                before, behind = start, len(items.words[i]) - start - len(own_words)
                if before or behind:
                    before, behind = (x + int(MARGIN * len(items.words[i])) for x in (before, behind))
                    if (d, i, at - before) in checked:
                        continue
                    checked.add((d, i, at - before))
                if (p, before, behind) != last:
                    text = b.docs[d][max(0, at - STEP - before) : at + (WIDTH + 1) * STEP + behind]
                    held, last = set(text.tolist()), (p, before, behind)
                if len(tells[i] & held) < enough[i][1] or len(words[i] & held) < enough[i][0]:
                    continue
                item = items.words[i]
                share = common_subsequence(item, text) / len(item)
                answer = items.answers[i]
                found = common_subsequence(answer, text) >= ANSWER_SHARE * len(answer)
                if (share >= SURE or share >= MAYBE and found) and common_subsequence(telling[i], text) >= INFORMATIVE * len(telling[i]):
                    old = out.get((d, i))
                    if old is None or (share, cosine[p, part]) > (old[1], old[0]):
                        out[d, i] = (float(cosine[p, part]), share, found, at)
            docs = batch.column("doc_id").to_pylist()
            cols = [[docs[d] for d, _ in out], [items.ids[i] for _, i in out], *([v[k] for v in out.values()] for k in range(4))]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], ["doc_id", "item_id", "cosine", "covered", "answer_found", "at_word"])

    return common.map_rows(numbered, run, "doc_id long, item_id long, cosine double, covered double, answer_found boolean, at_word long")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, covered, answer_found, at_word) of each item that a document of docs(doc_id, text) holds."""
    scratch = common.Scratch(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, cosine double, covered double, answer_found boolean, at_word long")
    ranked = items.repartitionByRange(8, "item_id", F.xxhash64("text")).sortWithinPartitions("item_id", F.xxhash64("text"))
    held: list[tuple[int, bytes]] = []
    k = size = 0

    def block(rows: list[tuple[int, bytes]]) -> DataFrame:
        own = Items(rows)
        if not own.words:
            return out.limit(0)
        numbered = scratch.put(_numbered(docs, own), f"words-{k}")
        return scratch.put(_search(numbered, own, latent_space(numbered, own)), f"leaks-{k}")

    for r in ranked.toLocalIterator():  # partition by partition: one block of items is held at a time
        raw = r.text.encode()
        own = n_parts(len(split(raw)))
        if held and size + own > MAX_ITEMS:
            out, held, k, size = out.unionByName(block(held)), [], k + 1, 0
        held.append((r.item_id, raw))
        size += own
    return out.unionByName(block(held)) if held else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns."""
    found = leaks(common.texts(docs), benchmark).select(F.col("doc_id").alias("__leak")).distinct()
    return docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("__leak")), "left_anti")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in every whole text of documents."""
    return leaks(common.texts(common.table(spark, sf_dir, "documents")), common.table(spark, sf_dir, "benchmark"))
