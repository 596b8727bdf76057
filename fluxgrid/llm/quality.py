"""Quality rules: boosted trees over document statistics, scored from flat node arrays.

Statistics come from every whole text. The trees are grown in numpy on a bounded sample of labelled documents
(``MAX_TRAIN``); chosen features are held monotonic, so that more symbols, repeats or repeated lines never raise a score.

Edge cases: a null or empty text has no words, all counts are 0, it fails the base rule and is not kept. Repeated rows give
repeated result rows. Without labelled documents, or with one class only, the trees are empty and the base rule decides.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.llm import common

#: Labelled documents that the trees are grown on, at most.
MAX_TRAIN = 20_000
#: A document is rejected when its probability of good quality is below this.
MIN_QUALITY = 0.5

UPPER, DIGITS = bytes(range(65, 91)), b"0123456789"
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features in order, with the sign of their constraint: -1 never raises the score as it grows, 0 is free.
FEATURES = {"words": 0, "word_length": 0, "symbol_rate": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "digit_share": 0, "mark_rate": -1, "letter_share": 1, "distinct_share": 0, "line_words": 0, "pipe_rate": -1}


def measure(b: bytes) -> tuple[list[int], list[float]]:
    """The five counts of the contract and the features of one text."""
    words = b.split()
    n, size = len(words), len(b)
    lacking = lambda chars: size - len(b.translate(None, chars))
    points = size - lacking(CONTINUATION) - lacking(common.SPACE)
    symbols = lacking(SYMBOLS)
    seen: set[bytes] = set()
    n_lines = dup_lines = 0
    for line in b.split(b"\n"):
        if line in seen:
            n_lines += 1
            dup_lines += 1
        elif line.strip():
            n_lines += 1
            seen.add(line)
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) < len(windows):
        until = 0
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeated += i + 3 - max(i, until)
                until = i + 3
    per = max(n, 1)
    letters = lacking(LETTERS)
    marks = lacking(b"!?")
    features = [np.log1p(n), points / per, symbols / per, dup_lines / max(n_lines, 1), repeated / per, lacking(UPPER) / max(letters, 1), lacking(DIGITS) / max(size, 1), marks / per, letters / max(size, 1), len(set(words)) / per, n / max(n_lines, 1), lacking(b"|") / per]
    return [n, points, symbols, dup_lines, repeated], features


@dataclass
class Trees:
    """Complete trees of one depth in flat arrays: node i of a tree has children 2i+1 and 2i+2; leaves follow the inner nodes."""

    depth: int
    bias: float = 0.0
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves that each row reaches, all rows of a tree level at once."""
        out, rows, inner = np.full(len(x), self.bias), np.arange(len(x)), (1 << self.depth) - 1
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, signs: list[int], n_trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, min_rows: int = 20) -> Trees:
    """Boosted trees for logistic loss, from histograms of quantile bins, with monotonic constraints by bounds on leaf values."""
    if len(y) == 0 or y.min() == y.max():
        return Trees(depth, 0.0 if len(y) == 0 else float(np.where(y[0] > 0, 4.0, -4.0)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], 1)
    share = y.mean()
    out = Trees(depth, float(np.log(share / (1 - share))))
    margin = np.full(len(y), out.bias)
    inner = (1 << depth) - 1
    features, thresholds, leaves = [], [], []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        f, t, leaf = np.zeros(inner, np.int32), np.full(inner, np.inf), np.zeros(inner + 1)
        rows, bounds = {0: np.arange(len(y))}, {0: (-np.inf, np.inf)}
        for node in range(inner):
            own, (low, high) = rows[node], bounds[node]
            best = (1e-6, None)
            g_all, h_all = grad[own].sum(), hess[own].sum()
            for j, c in enumerate(cuts):
                if len(own) < 2 * min_rows or not len(c):
                    continue
                b = binned[own, j]
                g, h, m = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (grad[own], hess[own], np.ones(len(own))))
                lv, rv = np.clip(g / (h + ridge), low, high), np.clip((g_all - g) / (h_all - h + ridge), low, high)
                gain = (2 * g * lv - (h + ridge) * lv**2) + (2 * (g_all - g) * rv - (h_all - h + ridge) * rv**2)
                gain = gain - g_all**2 / (h_all + ridge)
                gain[(m < min_rows) | (len(own) - m < min_rows) | (signs[j] * (rv - lv) < 0)] = -np.inf
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (j, k, lv[k], rv[k]))
            left, right = own, own[:0]
            sides = [(low, high), (low, high)]
            if best[1]:
                j, k, lv, rv = best[1]
                f[node], t[node] = j, cuts[j][k]
                goes = binned[own, j] <= k
                left, right = own[goes], own[~goes]
                if signs[j]:
                    middle = (lv + rv) / 2
                    sides = [(low, middle), (middle, high)] if signs[j] > 0 else [(middle, high), (low, middle)]
            for child, (own_rows, side) in zip((2 * node + 1, 2 * node + 2), ((left, sides[0]), (right, sides[1]))):
                rows[child], bounds[child] = own_rows, side
                if child >= inner:
                    value = grad[own_rows].sum() / (hess[own_rows].sum() + ridge) if len(own_rows) else 0.0
                    leaf[child - inner] = rate * np.clip(value, *side)
                    margin[own_rows] += leaf[child - inner]
        features.append(f), thresholds.append(t), leaves.append(leaf)
    out.feature, out.threshold, out.leaf = np.stack(features), np.stack(thresholds), np.stack(leaves)
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(b)[1] for b in common.as_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("label").cast(pa.int32()), pa.array(rows, pa.list_(pa.float64()))], ["label", "x"])


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Trees:
    """Trees from at most `max_train` labelled documents; only their feature rows reach the driver."""
    sample = common.label_sample(docs, labels, "quality", max_train)
    rows = common.map_rows(sample.select("text", "label"), _features, "label int, x array<double>").toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = rows.column("label").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the same trees whatever the order in which rows arrive
    return grow(x[order], y[order], list(FEATURES.values()))


def _verdict(found: list, trees: Trees, min_quality: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts, base_failed, kept and probability of measured texts."""
    counts = np.array([c for c, _ in found], np.int64).reshape(-1, len(COUNTS))
    p = trees.probability(np.array([x for _, x in found], float).reshape(-1, len(FEATURES)))
    failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
    return counts, failed, ~failed & (p >= min_quality), p


def score(docs: DataFrame, trees: Trees, min_quality: float = MIN_QUALITY) -> DataFrame:
    """doc_id, the five counts, base_failed, kept and the probability of good quality, for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, failed, kept, p = _verdict([measure(b) for b in common.as_bytes(batch.column("text"))], trees, min_quality)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(kept), pa.array(p)], ["doc_id", *COUNTS, "base_failed", "kept", "quality"])

    return common.map_rows(common.texts(docs), run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, quality double")


def keep_good(docs: DataFrame, labels: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns. The trees learn from the labelled texts of `labelled`, by default docs."""
    trees = fit(docs if labelled is None else labelled, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(b) for b in common.as_bytes(batch.column("text"))]
            yield batch.filter(pa.array(_verdict(found, trees, MIN_QUALITY)[2]))

    return common.map_rows(docs, run, docs.schema)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the quality rules on every whole text of documents."""
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
