"""Traces(roi, frame, v) of regions, their baselines, noise, activity and statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mean_trace(regions: DataFrame, frames: DataFrame) -> DataFrame:
    """Mean of a region's pixels in each frame."""
    return regions.select("roi", "pixel").join(frames.select("pixel", "frame", "v"), "pixel").groupBy("roi", "frame").agg(F.avg("v").alias("v"))


def corrected(traces: DataFrame, surround: DataFrame) -> DataFrame:
    """Traces less those of the surround, where there is one."""
    return traces.join(surround.select("roi", "frame", F.col("v").alias("s")), ["roi", "frame"]).select("roi", "frame", (F.col("v") - F.col("s")).alias("v"))


def relative_change(traces: DataFrame, key: str | list[str] = "roi", share: float = 0.1) -> DataFrame:
    """(v - b) / b, b being the mean of the samples strictly below a percentile; the trace itself if b is 0, null if no sample is below."""
    low = traces.groupBy(key).agg(F.expr(f"percentile(v, {share})").alias("p"))
    base = traces.join(low, key).groupBy(key).agg(F.avg(F.expr("case when v < p then v end")).alias("b"))
    return traces.join(base, key).withColumn("dff", F.expr("case when b = 0 then v else (v - b) / b end"))


def relative(traces: DataFrame) -> DataFrame:
    return relative_change(traces).select("roi", "frame", F.col("dff").alias("v"))


def all_kinds(regions: DataFrame, surround: DataFrame, frames: DataFrame, denoised: DataFrame | None = None) -> DataFrame:
    """(roi, frame, kind, v) of all kinds in the table of kinds (functions.registry). denoised is (roi, frame, v); without it the
    denoised kinds equal their plain ones."""
    from fluxgrid.functions.registry import TRACES

    mean, around = mean_trace(regions, frames), mean_trace(surround, frames)
    out = None
    for kind, build in TRACES.items():
        t = build(mean, around, mean if denoised is None else denoised).select("roi", "frame", F.lit(kind).alias("kind"), "v")
        out = t if out is None else out.unionByName(t)
    return out


def pad_to_median(traces: DataFrame) -> DataFrame:
    """(roi, trial, frame, v): trials brought to the median length (whole part) of all, with 0 behind the shorter; longer ones are cut."""
    length = traces.groupBy("trial").agg((F.max("frame") + 1).alias("n")).agg(F.expr("cast(percentile(n, 0.5) as long)").alias("n"))
    slots = traces.select("roi", "trial").distinct().join(F.broadcast(length)).select("roi", "trial", F.explode(F.expr("sequence(0L, n - 1)")).alias("frame"))
    return slots.join(traces.select("roi", "trial", "frame", "v"), ["roi", "trial", "frame"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def scale_by_first(traces: DataFrame, first: str, factor: float = 6.0) -> DataFrame:
    """traces(roi, kind, frame, v) of all kinds over factor times the deviation of one kind of the same region."""
    spread = traces.where(F.col("kind") == first).groupBy("roi").agg((factor * F.stddev_pop("v")).alias("s"))
    return traces.join(spread, "roi").withColumn("y", F.col("v") / F.col("s")).drop("s")


def lookup(stored: DataFrame, roi: int, kind: str, trials: list[str] | None = None) -> DataFrame:
    """(at, trial, frame, v): one region's trace of a kind, the chosen trials (all, if None) one behind the other."""
    own = stored.where((F.col("roi") == roi) & (F.col("kind") == kind))
    if trials is not None:
        own = own.where(F.col("trial").isin(trials))
    return concatenate(own).select("at", "trial", "frame", "v")


def stale(stored: DataFrame, regions: DataFrame) -> DataFrame:
    """roi of regions whose stored traces (roi, version, ...) belong to other pixels, or that have none; version is pixel_version()."""
    now = pixel_version(regions)
    have = stored.select("roi", "version").distinct()
    return now.join(have, ["roi", "version"], "left_anti").select("roi")


def pixel_version(regions: DataFrame) -> DataFrame:
    """(roi, version): a number that changes with a region's pixels, whatever their order."""
    return regions.groupBy("roi").agg(F.sum(F.xxhash64("pixel").cast("decimal(38,0)")).cast("string").alias("version"))


def statistics(traces: DataFrame) -> DataFrame:
    return traces.groupBy("roi").agg(F.stddev_pop("v").alias("std"), F.avg("v").alias("mean"), F.max("v").alias("max"))


def standardise(traces: DataFrame, gap: float = 5.0) -> DataFrame:
    """(v - mean) / (gap * std) + the trace's number, for stacked plots."""
    w = Window.partitionBy("roi")
    return traces.withColumn("y", (F.col("v") - F.avg("v").over(w)) / (gap * F.stddev_pop("v").over(w)) + F.col("roi"))


def correlation(traces: DataFrame, block: int = 512) -> DataFrame:
    """Pearson correlation of each two traces over the frames that both have, a < b; null if one is constant there.

    Blocks of traces meet blocks of traces as matrices of (trace, frame), so that a task holds two blocks and no pair of rows is joined.
    """
    n = max(1, -(-traces.select("roi").distinct().count() // block))
    rows = traces.groupBy("roi").agg(F.collect_list("frame").alias("frames"), F.collect_list("v").alias("vs")).withColumn("own", F.pmod(F.xxhash64("roi"), F.lit(n)).cast("int"))
    # block pairs p <= q; a row goes to those of its own block
    other = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = rows.withColumn("o", other).select("roi", "frames", "vs", "own", F.least("own", "o").alias("p"), F.greatest("own", "o").alias("q"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        frames = np.unique(np.concatenate(pdf.frames.to_numpy()))
        x, there = np.zeros((len(pdf), len(frames))), np.zeros((len(pdf), len(frames)))
        for k, (f, v) in enumerate(zip(pdf.frames, pdf.vs)):
            at = np.searchsorted(frames, f)
            x[k, at], there[k, at] = v, 1
        x = x - (x.sum(1, keepdims=True) / there.sum(1, keepdims=True)) * there  # a shift changes no correlation
        left, right = (pdf.own == pdf.p.iloc[0]).to_numpy(), (pdf.own == pdf.q.iloc[0]).to_numpy()
        a, b, ma, mb = x[left], x[right], there[left], there[right]
        m = ma @ mb.T
        with np.errstate(divide="ignore", invalid="ignore"):
            cov = a @ b.T - (a @ mb.T) * (ma @ b.T) / m
            va, vb = (a * a) @ mb.T - (a @ mb.T) ** 2 / m, ma @ (b * b).T - (ma @ b.T) ** 2 / m
            corr = cov / np.sqrt(va * vb)
        corr[(va <= 1e-12 * np.maximum((a * a) @ mb.T, 1e-300)) | (vb <= 1e-12 * np.maximum(ma @ (b * b).T, 1e-300))] = np.nan
        ra, rb = pdf.roi.to_numpy()[left], pdf.roi.to_numpy()[right]
        i, j = np.nonzero((m > 0) & ((ra[:, None] < rb) if pdf.p.iloc[0] == pdf.q.iloc[0] else np.ones(m.shape, bool)))
        return pd.DataFrame({"a": np.minimum(ra[i], rb[j]), "b": np.maximum(ra[i], rb[j]), "corr": corr[i, j]})

    out = dealt.groupBy("p", "q").applyInPandas(run, "a long, b long, corr double")
    return out.withColumn("corr", F.when(~F.isnan("corr"), F.col("corr")))


def noise(traces: DataFrame, width: int = 25, step: int = 10, share: float = 0.25) -> DataFrame:
    """Of sliding windows over the order of samples, that with the nearest-rank percentile of standard deviations: (roi, start, std, mean)."""
    w = Window.partitionBy("roi")
    at = traces.withColumns({"k": F.row_number().over(w.orderBy("frame")) - 1, "n": F.count("*").over(w)})
    starts = F.expr(f"filter(sequence(greatest(0, cast(ceil((k - {width - 1}) / {step}) as int)), k div {step}), s -> s * {step} + {width} <= n)")
    stats = at.withColumn("s", F.explode(starts)).groupBy("roi", (F.col("s") * step).alias("start")).agg(F.stddev_pop("v").alias("std"), F.avg("v").alias("mean"))
    ranked = stats.withColumns({"r": F.row_number().over(w.orderBy("std", "start")) - 1, "m": F.count("*").over(w)})
    return ranked.where(f"r = cast(bround((m - 1) * {share}) as int)").select("roi", "start", "std", "mean")


def peak_to_noise(traces: DataFrame, noise_: DataFrame) -> DataFrame:
    return traces.groupBy("roi").agg(F.max("v").alias("peak")).join(noise_, "roi").select("roi", (F.col("peak") / F.col("std")).alias("psnr"))


def active_runs(traces: DataFrame, noise_: DataFrame, deviations: float = 1.0, least: int = 4) -> DataFrame:
    """Runs of `least` samples or more above the noise's mean + deviations * std: (roi, first, last, n)."""
    w = Window.partitionBy("roi").orderBy("frame")
    above = traces.withColumn("k", F.row_number().over(w)).join(noise_.select("roi", "std", "mean"), "roi").where(f"v > mean + {deviations} * std")
    island = above.withColumn("g", F.col("k") - F.row_number().over(w))
    return island.groupBy("roi", "g").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("n")).where(f"n >= {least}").drop("g")


def activity(traces: DataFrame, peaks: int = 5, threshold: float = 0.3, before: int = 3, after: int = 10) -> DataFrame:
    """Distinct frames around the highest peaks that reach a share of a trace's range."""
    w = Window.partitionBy("roi").orderBy("frame")
    ends = Window.partitionBy("roi")
    p = traces.withColumns({"l": F.lag("v").over(w), "r": F.lead("v").over(w), "lo": F.min("v").over(ends), "hi": F.max("v").over(ends), "f0": F.min("frame").over(ends), "f1": F.max("frame").over(ends)})
    p = p.where(f"v > l and v >= r and v >= lo + {threshold} * (hi - lo)").withColumn("k", F.row_number().over(Window.partitionBy("roi").orderBy(F.desc("v"), "frame"))).where(f"k <= {peaks}")
    return p.select("roi", F.explode(F.sequence(F.greatest("f0", F.col("frame") - before), F.least("f1", F.col("frame") + after - 1))).alias("frame")).distinct()


def concatenate(traces: DataFrame) -> DataFrame:
    """Trials one behind the other: traces(roi, trial, frame, v) numbered anew."""
    return traces.withColumn("at", (F.row_number().over(Window.partitionBy("roi").orderBy("trial", "frame")) - 1).cast("long"))


def overlap_traces(a: DataFrame, b: DataFrame, frames: DataFrame) -> DataFrame:
    """(part, frame, v): mean traces of the pixels in one region only, in the other only, and in both; a and b have a column pixel."""
    parts = {"a only": a.select("pixel").join(b, "pixel", "left_anti"), "b only": b.select("pixel").join(a, "pixel", "left_anti"), "both": a.select("pixel").join(b, "pixel", "left_semi")}
    out = None
    for name, pixels in parts.items():
        t = pixels.distinct().join(frames.select("pixel", "frame", "v"), "pixel").groupBy("frame").agg(F.avg("v").alias("v")).select(F.lit(name).alias("part"), "frame", "v")
        out = t if out is None else out.unionByName(t)
    return out


def embedding_image(blocks: DataFrame) -> DataFrame:
    """(pixel, norm, scaled) from vectors(pixel, block, x): largest norm over the time blocks, and that between its 5th and 95th percentile."""
    norm = blocks.groupBy("pixel").agg(F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))).alias("norm"))
    ends = norm.agg(F.expr("percentile(norm, 0.05)").alias("a"), F.expr("percentile(norm, 0.95)").alias("b"))
    return norm.join(F.broadcast(ends)).select("pixel", "norm", F.expr("greatest(0, least(1, (norm - a) / nullif(b - a, 0)))").alias("scaled"))


def percentile_ladder(traces: DataFrame, shares: list[float]) -> DataFrame:
    """(roi, share, v): exact percentiles of each trace."""
    at = ", ".join(map(str, shares))
    return traces.groupBy("roi").agg(F.expr(f"percentile(v, array({at}))").alias("p")).select("roi", F.posexplode("p").alias("k", "v")).select("roi", F.element_at(F.array(*map(F.lit, shares)), F.col("k") + 1).alias("share"), "v")
