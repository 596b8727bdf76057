"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

A text is lower-cased, everything but letters becomes one space, and every byte n-gram of ``SIZES`` is hashed to one of
``BUCKETS`` embeddings. The mean embedding goes through a linear softmax. A temperature, and a score below which a prediction
counts as rejected, are calibrated on training chunks that were left out of the descent.

Edge cases: a text that is null or has no letter is ``und`` with score 0 and rejected. Without training rows every text is
``und``. Ties go to the language that sorts first. Repeated rows give repeated result rows; rows with one doc_id and different
languages are learned as they stand. Languages written without spaces are learned from pieces of ``PIECE`` characters. Columns
other than doc_id, text and lang are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.llm import common

BUCKETS = 1 << 16
SIZES = (1, 2, 3, 4)
#: Bounds on what the model is fitted to: labelled documents, and chunks of CHUNK words of their whole texts.
MAX_DOCS, MAX_CHUNKS, CHUNK = 4_000, 16_000, 40
#: Characters of a piece of a chunk that has few white spaces or none.
PIECE = 8 * CHUNK
BLOCK = 1 << 20
#: Share of right predictions that those which aren't rejected reach on the chunks left out.
PRECISION = 0.99
#: Byte classes after lower-casing: letters and bytes of longer code points stay, others become a space.
TABLE = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def subwords(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text, in blocks of bounded size; n-grams don't span two words but hold the space at either end."""
    raw = b" " + text.lower().encode("utf-8", "replace").translate(TABLE) + b" "
    for at in range(0, len(raw), BLOCK):
        b = np.frombuffer(raw[at : at + BLOCK + SIZES[-1] - 1], np.uint8)
        gap = b == 32
        if at == 0 or len(b) > SIZES[-1]:
            twice = np.concatenate([[False], gap[1:] & gap[:-1]])
            b = b[~twice]
            gap = b == 32
        x = b.astype(np.uint64)
        out = []
        h = np.zeros(len(x), np.uint64)
        inner = np.zeros(len(x), bool)
        for n in range(1, SIZES[-1] + 1):
            h = h[: len(x) - n + 1] * np.uint64(0x100000001B3) + x[n - 1 :] + np.uint64(n)
            if n > 2:
                inner = inner[: len(h)] | gap[n - 2 : n - 2 + len(h)]
                out.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48))[~inner])
            else:
                inner = inner[: len(h)]
                if n in SIZES:
                    out.append((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48))
        yield np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray  # embeddings already carried through the linear layer: a row of logits for each bucket
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and calibrated probability."""
        if not text or not self.langs or not has_letter(text):
            return "und", 0.0
        total, n = np.zeros(len(self.langs)), 0
        for ids in subwords(text):
            total += self.logits.take(ids, axis=0).sum(0, dtype=np.float64)
            n += len(ids)
        z = (total / max(n, 1) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, lang, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "text"))):
            words = (text or "").split()
            for k in range(0, len(words), CHUNK):
                part = " ".join(words[k : k + CHUNK])
                cuts = [0] if len(part) < 5 * PIECE else range(0, len(part), PIECE)
                for s in cuts:
                    piece = part if len(cuts) == 1 else part[s : s + PIECE]
                    if has_letter(piece):
                        rows.append((i, k + (s << 32), lang, piece))
        cols = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], ["doc_id", "at", "lang", "part"])


def fit(docs: DataFrame, max_docs: int = MAX_DOCS, max_chunks: int = MAX_CHUNKS, dim: int = 16, epochs: int = 4, rate: float = 0.1, seed: int = 7) -> Model:
    """Learns from docs(doc_id, text, lang): chunks of at most `max_docs` whole texts, `max_chunks` of them, reach the driver."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).where("lang is not null and doc_id is not null")
    chosen = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    rows = common.texts(docs, F.col("lang").cast("string").alias("lang")).where("lang is not null").join(F.broadcast(chosen), "doc_id")
    chunks = common.map_rows(rows.select("doc_id", "lang", "text"), _chunks, "doc_id long, at long, lang string, part string")
    rows = chunks.orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at", "part").limit(max_chunks).toArrow()
    return train(rows.column("part").to_pylist(), rows.column("lang").to_pylist(), dim, epochs, rate, seed)


def train(parts: list[str], labels: list[str], dim: int = 16, epochs: int = 4, rate: float = 0.1, seed: int = 7) -> Model:
    """Stochastic gradient descent over chunks of text with their languages.

    Each parameter of the linear layer, and each embedding, divides its rate by the root of its summed squared gradients, so that
    a step is at most `rate` whatever the scale of embeddings or the number of chunks; every eighth chunk is left out for the
    calibration. Raises FloatingPointError if a weight isn't finite.
    """
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    y = np.searchsorted(langs, labels)
    bags = [np.unique(np.concatenate(list(subwords(p))), return_counts=True) for p in parts]
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    w, bias = rng.normal(0, 0.1, (dim, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    sums = [np.full(x, 1e-8, np.float32) for x in (w.shape, bias.shape, BUCKETS)]
    held = np.arange(len(bags)) % 8 == 0 if len(bags) >= 64 else np.zeros(len(bags), bool)
    used = np.flatnonzero(~held)

    def mean(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids = np.concatenate([bags[i][0] for i in own])
        row = np.repeat(np.arange(len(own)), [len(bags[i][0]) for i in own])
        share = np.concatenate([bags[i][1] / bags[i][1].sum() for i in own]).astype(np.float32)
        hidden = np.add.reduceat(emb[ids] * share[:, None], np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1]), axis=0)
        return ids, row, share, hidden

    step = 0
    steps = max(1, epochs * -(-len(used) // 64))
    for _ in range(epochs):
        for own in np.array_split(rng.permutation(used), max(1, -(-len(used) // 64))):
            if not len(own):
                continue
            ids, row, share, hidden = mean(own)
            z = hidden @ w + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            p /= len(own)
            lr = rate * (1 - step / steps)
            back = p @ w.T
            for value, slope, total in ((w, hidden.T @ p, sums[0]), (bias, p.sum(0), sums[1])):
                total += slope**2
                value -= lr * slope / np.sqrt(total)
            order = np.argsort(ids, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(ids[order]) > 0]))
            slope = np.add.reduceat((back[row] * share[:, None])[order], first, axis=0)
            at = ids[order][first]
            sums[2][at] += (slope**2).mean(1)
            emb[at] -= lr * slope / np.sqrt(sums[2][at])[:, None]
            step += 1
    if not all(np.isfinite(x).all() for x in (emb, w, bias)):
        raise FloatingPointError("the descent left the finite numbers")
    model = Model(langs, (emb @ w).astype(np.float32), bias.astype(float))
    check = np.flatnonzero(held) if held.any() else used
    z = mean(check)[3] @ w + bias
    losses = []
    grid = np.geomspace(0.5, 8, 25)  # no sharper: chunks that are all right would ask for any sharpness
    for t in grid:
        a = z / t
        a = a - a.max(1, keepdims=True)
        losses.append(-(a[np.arange(len(check)), y[check]] - np.log(np.exp(a).sum(1))).mean())
    model.temperature = float(grid[int(np.argmin(losses))])
    a = np.exp((z - z.max(1, keepdims=True)) / model.temperature)
    p = a / a.sum(1, keepdims=True)
    best, right = p.max(1), p.argmax(1) == y[check]
    order = np.argsort(-best, kind="stable")
    precise = np.flatnonzero(np.cumsum(right[order]) >= PRECISION * np.arange(1, len(order) + 1))
    if len(precise) == len(order):  # no chunk calls for a rejection
        model.reject_below = min(0.5, float(best.min()))
    else:
        model.reject_below = float(best[order][precise[-1]]) if len(precise) else float(best.max())
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in batch.column("text").to_pylist()]
            langs, scores = [x for x, _ in found], np.array([s for _, s in found], float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores), pa.array((scores < model.reject_below) | np.array([x == "und" for x in langs], bool))], ["doc_id", "lang_pred", "score", "rejected"])

    return common.map_rows(common.texts(docs), run, "doc_id long, lang_pred string, score double, rejected boolean")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of documents, learned from those outside the held-out fold."""
    docs = common.table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs.where(common.fold(4) != 2)))
    return found.select("doc_id", (common.fold(4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
