"""Toxicity by maximum-scoring segments.

Every token has a log-odds score of toxic against other documents with an informative Dirichlet prior. A linear scan finds all
maximal scoring segments of a text; unknown tokens cost ``DRIFT``. The best segment's score is calibrated by the extreme-value
law of such maxima (expected number of chance segments: K * tokens * exp(-lambda * score)), and a logistic curve over that
turns it into the probability of label 1. Every segment of which less than ``LEVEL`` are expected by chance in a text of its
length is a significant passage and is returned with that figure.

Edge cases: a null or empty text has no token and gets the score of a text without segments. Without labelled rows, or with
one class only, every text gets the share of label 1 (0 without any). Repeated rows give repeated result rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.llm import common

#: Bound on the labelled documents that the model is fitted to; every token of theirs that has a z-score of MIN_Z is kept.
MAX_TRAIN = 20_000
#: Prior weight as a share of all counted tokens, and the z-score a token needs.
PRIOR, MIN_Z = 0.02, 2.5
#: Expected number of chance segments below which a segment is significant.
LEVEL = 0.05
DRIFT = 0.15
THRESHOLD = 0.3
EDGES = b".,;:!?\"'()[]|*-_"


def tokens(raw: bytes) -> list[bytes]:
    """Lower-cased words without marks at either end."""
    return [w.strip(EDGES) for w in raw.lower().split()]


def segments(hits: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[float, int, int]]:
    """(score, first, last) of all maximal scoring segments of a sequence in which unlisted positions score -drift.

    The linear scan keeps candidate segments with their cumulative score before (left) and at the end (right); a new one is
    merged into the last earlier one with a smaller left and smaller right sum.
    """
    out: list[list[float]] = []  # left sum, right sum, first, last
    total, at = 0.0, 0
    for i, s in hits:
        total -= drift * (i - at)
        at = i + 1
        if s <= 0:
            total += s
            continue
        new = [total, total + s, i, i]
        total += s
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][0] >= new[0]:
                j -= 1
            if j < 0 or out[j][1] >= new[1]:
                out.append(new)
                break
            new = [out[j][0], new[1], out[j][2], new[3]]
            del out[j:]
    return [(r - l, int(a), int(b)) for l, r, a, b in out]


@dataclass
class Model:
    score: dict[bytes, float] = field(default_factory=dict)
    rate: float = 1.0  # lambda of the extreme-value law
    log_k: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def measure(self, raw: bytes) -> tuple[int, float, float, int, int, int, list[tuple[int, int, float, float]]]:
        """Tokens, best score, sum of the others, number of significant segments, the best segment's first and last token, and
        first token, last token, score and expected number of chance segments of each significant one, in order of the text."""
        get = self.score.get
        words = tokens(raw)
        hits = [(i, s) for i, s in enumerate(map(get, words)) if s is not None]
        found = segments(hits)
        if not found:
            return len(words), 0.0, 0.0, 0, -1, -1, []
        best = max(found, key=lambda x: (x[0], -x[1]))
        base = self.log_k + math.log(len(words))
        chance = [math.exp(min(base - self.rate * x, 700.0)) for x, _, _ in found]
        listed = [(first, last, x, e) for (x, first, last), e in zip(found, chance) if e < LEVEL]
        return len(words), best[0], sum(x[0] for x in found) - best[0], len(listed), best[1], best[2], listed

    def inputs(self, n: np.ndarray, best: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """What the logistic curve reads: minus the log of the expected number of chance segments, and how much the others add."""
        evidence = np.where(best > 0, self.rate * best - self.log_k - np.log(np.maximum(n, 1)), -5.0)
        return np.stack([np.ones(len(n)), np.clip(evidence, -5, 15), np.log1p(np.minimum(rest, 100.0))], 1)

    def probability(self, n: np.ndarray, best: np.ndarray, rest: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(n, best, rest) @ self.weights, -30, 30)))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct tokens of each text, with two keys that near copies mostly share: smallest hashes of its word triples."""
    for batch in batches:
        rows = []
        for raw in common.as_bytes(batch.column("text")):
            words = tokens(raw)
            triples = [b" ".join(t) for t in zip(words, words[1:], words[2:])] or [raw]
            keys = [min(xxhash.xxh64_intdigest(t, s) for t in triples) >> 1 for s in (1, 2)]
            rows.append((*keys, [t.decode("utf-8", "replace") for t in set(words) if t]))
        cols = list(zip(*rows)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label").cast(pa.int32()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.string()))], ["doc_id", "label", "k1", "k2", "tokens"])


def fit(docs: DataFrame, labels: DataFrame, where=None, max_train: int = MAX_TRAIN) -> Model:
    """Learns from at most `max_train` labelled documents; near copies count once, so that their words aren't taken for toxic."""
    sample = common.label_sample(docs, labels, "toxic", max_train, where)
    keyed = common.map_rows(sample, _keyed, "doc_id long, label int, k1 long, k2 long, tokens array<string>")
    for k in ("k1", "k2"):
        keyed = keyed.groupBy("label", k).agg(F.min_by(F.struct("doc_id", "k1", "k2", "tokens"), "doc_id").alias("r")).select("label", "r.doc_id", "r.k1" if k != "k1" else k, "r.k2" if k != "k2" else k, "r.tokens")
    counts = keyed.select("label", F.explode("tokens").alias("token")).groupBy("token").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")).checkpoint()
    n_t, n_c = (float(x or 0) for x in counts.agg(F.sum("t"), F.sum("c")).first())
    model = Model()
    if n_t and n_c:
        prior = PRIOR * (n_t + n_c)
        a = prior * (F.col("t") + F.col("c")) / (n_t + n_c)
        odds = lambda y, n: F.log((F.col(y) + a) / (n + prior - F.col(y) - a))
        delta = odds("t", n_t) - odds("c", n_c)
        z = delta / F.sqrt(1 / (F.col("t") + a) + 1 / (F.col("c") + a))
        kept = counts.select("token", delta.alias("s"), z.alias("z")).where(F.abs("z") >= MIN_Z)
        model.score = {r.token.encode(): r.s for r in kept.collect()}
    measured = _measure(sample, model, ["label"]).select("label", "n_tokens", "best", "rest").toPandas()
    y, n, best, rest = (measured[c].to_numpy(float) for c in ("label", "n_tokens", "best", "rest"))
    if len(y) == 0 or y.min() == y.max():
        model.weights = np.array([-30.0 if len(y) == 0 or y[0] == 0 else 30.0, 0, 0])
        return model
    chance = (y == 0) & (best > 0)
    if chance.sum() >= 20:  # moments of the extreme-value law, after the length's part is taken off
        spread = best[chance].std()
        model.rate = float(np.clip(np.pi / (np.sqrt(6) * max(spread, 1e-3)), 0.1, 2.0))
        model.log_k = float(np.mean(model.rate * best[chance] - np.log(np.maximum(n[chance], 1))) - 0.5772)
        model.log_k += float(np.log(chance.sum() / (y == 0).sum()))
    else:
        model.log_k = -float(np.log(np.maximum(n[y == 0], 1).mean() + 1))
    order = np.lexsort((rest, best, n, y))
    x, y = model.inputs(n, best, rest)[order], y[order]
    w, ridge = np.zeros(3), np.diag([1e-6, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    model.weights = w
    return model


_SEGMENT = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])
_FOUND = ["n_tokens", "best", "rest", "n_segments", "first_token", "last_token", "score", "segments"]
_KINDS = "n_tokens long, best double, rest double, n_segments long, first_token long, last_token long, score double, segments array<struct<first:long,last:long,score:double,expected:double>>"


def _measure(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [model.measure(raw) for raw in common.as_bytes(batch.column("text"))]
            cols = list(zip(*rows)) or [[]] * 7
            n, best, rest = (np.array(c, float) for c in cols[:3])
            listed = pa.array([[dict(zip(("first", "last", "score", "expected"), x)) for x in r] for r in cols[6]], pa.list_(_SEGMENT))
            whole = [pa.array(cols[k], pa.int64()) for k in (0, 3, 4, 5)]
            found = [whole[0], pa.array(best), pa.array(rest), *whole[1:], pa.array(model.probability(n, best, rest)), listed]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *found], [*keep, *_FOUND])

    kinds = dict(docs.dtypes)
    return common.map_rows(docs.select(*keep, "text"), run, ", ".join([*(f"{k} {kinds[k]}" for k in keep), _KINDS]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, the probability of label 1, the most toxic segment (token positions, -1 without one) and all significant segments,
    for every row of docs."""
    return _measure(common.texts(docs), model, ["doc_id"])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of documents; the held-out fold takes no part in the fit."""
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs, common.table(spark, sf_dir, "labels"), common.fold(4) != 2)
    found = score(docs, model)
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return found.select("doc_id", (common.fold(4) == 2).alias("held_out"), "score", predicted, "n_segments", "first_token", "last_token")
