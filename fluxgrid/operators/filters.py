"""Filters of stacks: offset, z-score, equalisation, medians, local denoising, correlation and contrast."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The 8 neighbours of a cell, and the 4.
EIGHT = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
FOUR = [(-1, 0), (1, 0), (0, -1), (0, 1)]
#: Samples that a tile has, about: a task's memory is a few dozen bytes for each.
TILE_SAMPLES = 1 << 20


def trial_key(df: DataFrame) -> list[str]:
    """The column trial where a stack has one; every filter then works on each trial by itself."""
    return ["trial"] if "trial" in df.columns else []


def remove_offset(frames: DataFrame, offset: float, tolerance: float) -> DataFrame:
    """Subtracts offset, not below 0, if the first frame's mean is near it."""
    first = frames.where("frame = 0").agg(F.avg("v").alias("m"))
    return frames.join(F.broadcast(first)).withColumn("v", F.expr(f"case when abs(m - {offset}) <= {tolerance} then greatest(v - {offset}, 0) else v end")).drop("m")


def zscore(frames: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Each sample less its pixel's mean, over its standard deviation, within its trial."""
    w = Window.partitionBy(*trial_key(frames), "pixel")
    return frames.withColumn("z", (F.col("v") - F.avg("v").over(w)) / (F.stddev_pop("v").over(w) + eps))


def offsets(df: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """df once for each step, with the cell (nrow, ncol) that is the step away."""
    arr = F.array(*(F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i, j in steps))
    return df.withColumn("o", F.explode(arr)).withColumns({"nrow": F.col("row") + F.col("o.di"), "ncol": F.col("col") + F.col("o.dj")}).drop("o")


def reflect(c: F.Column, n: F.Column | int) -> F.Column:
    """Index with the edge sample repeated beyond either end."""
    n = F.lit(n) if isinstance(n, int) else n
    m = F.pmod(c, 2 * n)
    return F.when(m < n, m).otherwise(2 * n - 1 - m)


def gaussian(image: DataFrame, column: str, sigma: float, nrows: int, ncols: int) -> DataFrame:
    """image(row, col, column, perhaps trial) smoothed by a Gaussian cut off at 4 sigma, rows first and then columns; 0 changes nothing."""
    if sigma <= 0:
        return image
    keys = trial_key(image)
    radius = int(4 * sigma + 0.5)
    taps = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    kernel = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(t / sum(taps)).alias("t")) for k, t in zip(range(-radius, radius + 1), taps)))
    for axis, n in (("row", nrows), ("col", ncols)):
        other = [*keys, "col" if axis == "row" else "row"]
        spread = image.select(*other, axis, column, F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("k"))
        # every output cell asks for the cells under its kernel
        source = reflect(F.col(axis) + F.col("k"), n).cast("long").alias(axis)
        asked = spread.select(*other, F.col(axis).alias("at"), source, F.element_at(kernel, F.col("k") + radius + 1)["t"].alias("t"))
        summed = asked.join(image.select(*other, axis, column), [*other, axis]).groupBy(*other, "at").agg(F.sum(F.col("t") * F.col(column)).alias(column))
        image = summed.withColumnRenamed("at", axis)
    return image


def equalise(frames: DataFrame, sigma: float, nrows: int, ncols: int) -> DataFrame:
    """Each pixel between its smoothed 5th and 95th percentile, clipped to 0..1, squared, then the median of three frames, within its trial."""
    at = [*trial_key(frames), "row", "col"]
    ends = frames.groupBy(*at).agg(F.expr("percentile(v, 0.05)").alias("p5"), F.expr("percentile(v, 0.95)").alias("p95"))
    low, high = (gaussian(ends.select(*at, c), c, sigma, nrows, ncols) for c in ("p5", "p95"))
    scaled = frames.join(low, at).join(high, at).withColumn("x", F.expr("pow(greatest(0, least(1, coalesce((v - p5) / (p95 - p5 + 1e-8), 0))), 2)"))
    w = Window.partitionBy(*trial_key(frames), "pixel").orderBy("frame")
    before, after = F.coalesce(F.lag("x").over(w), F.col("x")), F.coalesce(F.lead("x").over(w), F.col("x"))
    return scaled.withColumn("eq", F.col("x") + before + after - F.greatest(F.col("x"), before, after) - F.least(F.col("x"), before, after))


def by_tile(frames: DataFrame, halo: int, nframes: int, column: str, kernel: Callable[..., tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(trial, pixel, row, col, frame, column): a kernel over tiles of about TILE_SAMPLES samples, with a margin of halo cells.

    Only samples within a margin are sent twice. kernel(cube, known, first) gets the samples as (row, col, frame), which of them
    are there, and the place of the tile within the cube, (row, col, end row, end col); it returns values and which are there.
    """
    side, keys = max(8, int((TILE_SAMPLES / max(nframes, 1)) ** 0.5)), trial_key(frames)
    held = frames.select(*keys, "pixel", "row", "col", "frame", F.col("v").cast("double").alias("v"))
    for axis, tile in (("row", "tr"), ("col", "tc")):
        held = held.withColumn(tile, F.explode(F.expr(f"sequence(greatest(0, ({axis} - {halo}) div {side}), ({axis} + {halo}) div {side})")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c, f = (pdf[k].to_numpy() for k in ("row", "col", "frame"))
        r0, c0, f0 = r.min(), c.min(), f.min()
        shape = (r.max() - r0 + 1, c.max() - c0 + 1, f.max() - f0 + 1)
        cube, known, pixel = np.zeros(shape), np.zeros(shape, bool), np.full(shape[:2], -1, np.int64)
        cube[r - r0, c - c0, f - f0], known[r - r0, c - c0, f - f0], pixel[r - r0, c - c0] = pdf.v.to_numpy(), True, pdf.pixel.to_numpy()
        top, left = pdf.tr.iloc[0] * side, pdf.tc.iloc[0] * side
        own = (max(top - r0, 0), max(left - c0, 0), min(top + side - r0, shape[0]), min(left + side - c0, shape[1]))
        values, there = kernel(cube, known, own)
        there = there & (pixel[own[0] : own[2], own[1] : own[3]] >= 0)[..., None]
        i, j, k = np.nonzero(there)
        out = {"pixel": pixel[i + own[0], j + own[1]], "row": i + own[0] + r0, "col": j + own[1] + c0, "frame": k + f0, column: values[i, j, k]}
        return pd.DataFrame({**{x: pdf[x].iloc[0] for x in keys}, **out})

    kinds = dict(held.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "pixel long, row long, col long, frame long", f"{column} double"])
    return held.groupBy(*keys, "tr", "tc").applyInPandas(run, schema)


def median3d(dense: DataFrame, nrows: int, ncols: int, nframes: int, size: int = 3) -> DataFrame:
    """Median of the cube around each sample of a dense stack, edges reflected; of an even number the upper one."""
    half = size // 2
    rest = size - half - 1

    def kernel(cube: np.ndarray, known: np.ndarray, own: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray]:
        top, left, bottom, right = own
        pads = [(max(0, half - top), max(0, rest - (cube.shape[0] - bottom))), (max(0, half - left), max(0, rest - (cube.shape[1] - right))), (half, rest)]
        wide = np.pad(cube, pads, mode="symmetric")
        r0, c0, n = top + pads[0][0] - half, left + pads[1][0] - half, cube.shape[2]
        out = np.empty((bottom - top, right - left, n))
        step = max(1, (1 << 22) // max(1, out.shape[0] * out.shape[1] * size**3))
        for t in range(0, n, step):
            m = min(step, n - t)
            near = [
                wide[r0 + i : r0 + i + out.shape[0], c0 + j : c0 + j + out.shape[1], t + k : t + k + m]
                for i in range(size) for j in range(size) for k in range(size)
            ]
            out[..., t : t + m] = np.partition(np.stack(near), size**3 // 2, axis=0)[size**3 // 2]
        return out, known[top:bottom, left:right]

    return by_tile(dense, half, nframes, "med", kernel)


def local_denoise(frames: DataFrame, nframes: int = 256) -> DataFrame:
    """Each trace becomes the average of itself and its 8 neighbours, weighted by the cosine of the traces; nframes only sizes the tiles."""

    def kernel(cube: np.ndarray, known: np.ndarray, own: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray]:
        top, left, bottom, right = own
        energy = (cube * cube).sum(2) + 1e-7
        x, e, k = cube[top:bottom, left:right], energy[top:bottom, left:right], known[top:bottom, left:right]
        total, out, there = np.ones(e.shape), x.copy(), k.copy()
        for di, dj in EIGHT:
            a, b = max(top, -di), max(left, -dj)
            z, y = min(bottom, cube.shape[0] - di), min(right, cube.shape[1] - dj)
            if a >= z or b >= y:
                continue
            here, there_ = (slice(a - top, z - top), slice(b - left, y - left)), (slice(a + di, z + di), slice(b + dj, y + dj))
            u = np.einsum("ijk,ijk->ij", x[here], cube[there_]) / np.sqrt(e[here] * energy[there_])
            common = (k[here] & known[there_]).any(2)
            u = np.where(common, u, 0)
            total[here] += u
            out[here] += u[..., None] * cube[there_]
            there[here] |= known[there_] & common[..., None]
        return out / (total + 1e-9)[..., None], there

    return by_tile(frames, 1, nframes, "smooth", kernel)


def temporal_correlation(frames: DataFrame) -> DataFrame:
    """Mean over time of a cell times the mean of its 4 neighbours; what is outside counts 0."""
    near = offsets(frames.select("pixel", "row", "col", "frame", "v"), FOUR)
    other = frames.select(F.col("row").alias("nrow"), F.col("col").alias("ncol"), "frame", F.col("v").alias("w"))
    sums = near.join(other, ["nrow", "ncol", "frame"], "left").groupBy("pixel", "frame").agg(F.sum(F.col("v") * F.coalesce("w", F.lit(0.0)) / 4).alias("c"))
    return sums.groupBy("pixel").agg(F.avg("c").alias("corr"))


def contrast(image: DataFrame, column: str, low: float = 0.01, high: float = 0.97) -> DataFrame:
    """0..255 between two percentiles of an image of non-negative values."""
    base = image.withColumn("x", F.greatest(F.col(column), F.lit(0.0)))
    ends = base.agg(F.expr(f"percentile(x, {low})").alias("a"), F.expr(f"percentile(x, {high})").alias("b"))
    return base.join(F.broadcast(ends)).withColumn("scaled", F.expr("greatest(0, least(255, (x - a) / (b - a) * 255))")).drop("a", "b", "x")


def display_stretch(image: DataFrame, column: str, intensity: float = 7.0) -> DataFrame:
    """Background of a view: between the 2nd and 98th percentile, times intensity / 7 * 255; an image of one value divides by 1."""
    ends = image.agg(F.expr(f"percentile({column}, 0.02)").alias("a"), F.expr(f"percentile({column}, 0.98)").alias("b"))
    shown = F.lit(intensity / 7) * (F.col(column) - F.col("a")) * 255 / F.expr("case when b = a then 1 else b - a end")
    return image.join(F.broadcast(ends)).withColumn("shown", shown).drop("a", "b")


def blend(layers: list[DataFrame], share: float = 0.45) -> DataFrame:
    """(pixel, shown): the sum of layers(pixel, shown), each weighted by share; a pixel without one counts 0 there."""
    out = layers[0]
    for x in layers[1:]:
        out = out.unionByName(x)
    return out.groupBy("pixel").agg(F.sum(F.col("shown") * share).alias("shown"))


def saved_image(image: DataFrame, column: str) -> DataFrame:
    """level, 0..255, and its whole part byte: between the 1st and 99th percentile of the non-negative part; if the 30th percentile of that is above a
    quarter, between the 10th and 99th of the values as they are."""
    p = lambda c, q: F.expr(f"percentile({c}, {q})")
    base = image.withColumn("x", F.greatest(F.col(column), F.lit(0.0)))
    ends = base.agg(p("x", 0.01).alias("a"), p("x", 0.99).alias("b"), p("x", 0.3).alias("m"), p(column, 0.1).alias("c"), p(column, 0.99).alias("d"))
    scaled = F.expr(f"case when (m - a) / (b - a) > 0.25 then ({column} - c) / (d - c) else (x - a) / (b - a) end")
    return base.join(F.broadcast(ends)).withColumn("level", F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled)) * 255).withColumn("byte", F.floor("level")).drop("a", "b", "c", "d", "m", "x")


def smooth_by_spread(image: DataFrame, column: str, nrows: int, ncols: int) -> DataFrame:
    """An image smoothed by a Gaussian whose sigma is the image's own standard deviation (one number to the driver)."""
    sigma = float(image.agg(F.stddev_pop(column)).first()[0] or 0.0)
    return gaussian(image.select("row", "col", column), column, sigma, nrows, ncols)
