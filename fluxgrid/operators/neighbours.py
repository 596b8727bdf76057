"""Approximate nearest neighbours: a neighbour graph that gets better in rounds of local joins.

A start puts vectors on the same side of random planes together. Then, round by round, the neighbours of a vector, and the vectors that
have it as a neighbour, are compared with each other, since two neighbours of one vector are likely to be neighbours themselves. Only
pairs of which one is new in its list are compared, and only pairs that improve a list are sent on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxgrid.operators.graph import cut_lineage, distances

#: Vectors that share their planes at the start, about; a larger group is dealt to blocks of four times as many.
LEAF = 128
#: Independent deals of the start; with one alone no neighbour of a neighbour would be of another group.
TREES = 4
#: Vectors whose local joins a task does together.
BUCKET = 128


def _start(vectors: DataFrame, n: int, keep: int, metric: str, seed: int) -> DataFrame:
    """(i, j, d): the nearest within groups by random planes through the mean of the groups' vectors."""
    bits = max(0, int(np.ceil(np.log2(max(1.0, n / LEAF)))))
    dim = len(vectors.select("x").first()[0])
    mean = np.array(vectors.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m")).orderBy("k").toPandas().m, float)
    planes = np.random.default_rng(seed).normal(size=(max(bits, 1), dim))

    def leaf(batches):
        for b in batches:
            x = np.array(b.column("x").to_pylist(), float).reshape(-1, dim)
            code = ((x - mean) @ planes.T > 0).astype(np.int64) @ (1 << np.arange(len(planes))) if bits else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([b.column("i"), b.column("x"), pa.array(code)], names=["i", "x", "leaf"])

    coded = cut_lineage(vectors.mapInArrow(leaf, "i long, x array<double>, leaf long"))
    size = coded.groupBy("leaf").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / (4 * LEAF)).cast("long")
    dealt = coded.join(size, "leaf").withColumn("part", F.pmod(F.xxhash64("i"), parts))

    def nearest(t: pa.Table) -> pa.Table:
        ids, x = t.column("i").to_numpy(), np.array(t.column("x").to_pylist(), float)
        d = distances(x, x, metric)
        np.fill_diagonal(d, np.inf)
        m = min(keep, len(ids) - 1)
        at = np.argpartition(d, m - 1, axis=1)[:, :m] if m > 0 else np.zeros((len(ids), 0), int)
        return pa.table({"i": np.repeat(ids, m), "j": ids[at].ravel(), "d": np.take_along_axis(d, at, 1).ravel()})

    return dealt.groupBy("leaf", "part").applyInArrow(nearest, "i long, j long, d double")


def _best(rows: DataFrame, keep: int) -> DataFrame:
    """The `keep` nearest of each vector, one row a pair; a pair that was there before isn't new."""
    once = rows.groupBy("i", "j").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    w = Window.partitionBy("i").orderBy("d", "j")  # a list and what improves it
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def descend(vectors: DataFrame, k: int, metric: str = "l2", connections: int = 40, accuracy: int = 75, rounds: int = 12, least: float = 0.001, seed: int = 11) -> DataFrame:
    """(i, j, d, rank): about the k nearest of all vectors(i, x) for each one, itself included with rank 1.

    Lists hold `accuracy` neighbours (k at least) while the graph is made; a vector takes part in the local join of another with at
    most `connections` of the new and as many of the old ones in either direction, chosen anew in each round by hash. It stops when fewer
    than a share `least` of all places changed, or after `rounds`. Metrics are those of graph.nearest(). Null vectors have to be
    left out before.
    """
    keep = max(k - 1, accuracy)
    vectors = cut_lineage(vectors.select(F.col("i").cast("long").alias("i"), "x"))
    n = vectors.count()
    if not n:
        return vectors.selectExpr("i", "i as j", "0.0D as d", "1 as rank")
    begun = _start(vectors, n, keep, metric, seed)
    for t in range(1, TREES):
        begun = begun.unionByName(_start(vectors, n, keep, metric, seed + t))
    state = cut_lineage(_best(begun.withColumn("new", F.lit(1)), keep))
    for turn in range(rounds):
        state = state.withColumn("chosen", F.row_number().over(Window.partitionBy("i", "new").orderBy(F.xxhash64("i", "j", F.lit(turn)))) <= connections)
        ahead = state.where("chosen").select(F.col("i").alias("v"), F.col("j").alias("u"), "new")
        back = ahead.select(F.col("u").alias("v"), F.col("v").alias("u"), "new")
        back = back.withColumn("r", F.row_number().over(Window.partitionBy("v", "new").orderBy(F.xxhash64("u", "v", F.lit(turn))))).where(F.col("r") <= connections).drop("r")
        worst = state.groupBy("i").agg(F.max("d").alias("worst"), F.count("*").alias("n"))
        worst = worst.select(F.col("i").alias("u"), F.when(F.col("n") < keep, F.lit(float("inf"))).otherwise(F.col("worst")).alias("worst"))
        members = ahead.unionByName(back).groupBy("v", "u").agg(F.max("new").alias("new"))
        members = members.join(vectors.select(F.col("i").alias("u"), "x"), "u").join(worst, "u", "left").fillna(float("inf"), ["worst"])

        def local(t: pa.Table) -> pa.Table:
            v, u, new, worst = (t.column(c).to_numpy() for c in ("v", "u", "new", "worst"))
            x = t.column("x").combine_chunks().values.to_numpy().reshape(len(v), -1)
            order = np.lexsort((u, v))
            cuts = np.flatnonzero(np.diff(v[order])) + 1
            out = []
            for own in np.split(order, cuts):
                d = distances(x[own], x[own], metric)
                either = (new[own][:, None] + new[own]) > 0
                np.fill_diagonal(either, False)
                a, b = np.nonzero(either & (d < worst[own][:, None]))
                out.append((u[own][a], u[own][b], d[a, b]))
            i, j, d = (np.concatenate(c) for c in zip(*out))
            order = np.lexsort((d, j, i))
            once = order[np.concatenate([[True], (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)])] if len(order) else order
            return pa.table({"i": i[once], "j": j[once], "d": d[once]})

        bucket = F.pmod(F.xxhash64("v"), F.lit(max(1, n // BUCKET)))
        better = members.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(local, "i long, j long, d double").withColumn("new", F.lit(1))
        # of the old ones, those that had their turn are new no more
        before = state.select("i", "j", "d", F.when(F.col("chosen"), 0).otherwise(F.col("new")).alias("new"))
        state = cut_lineage(_best(before.withColumn("had", F.lit(1)).unionByName(better.withColumn("had", F.lit(0))).drop("had"), keep))
        if state.where("new = 1").count() < least * n * keep:
            break
    own = vectors.selectExpr("i", "i as j", "0.0D as d", "1 as rank")
    if metric == "ip":
        own = vectors.selectExpr("i", "i as j", "1 - aggregate(x, 0.0D, (s, v) -> s + v * v) as d", "1 as rank")
    return state.where(F.col("rank") < k).select("i", "j", "d", (F.col("rank") + 1).alias("rank")).unionByName(own)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(recall): share of the exact neighbours(i, j) that were found."""
    hits = exact.select("i", "j").join(found.select("i", "j").distinct().withColumn("hit", F.lit(1)), ["i", "j"], "left")
    return hits.agg((F.count("hit") / F.count("*")).alias("recall"))
