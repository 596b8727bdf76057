"""Region extraction by local selective spectral clustering, one tile a task, and the demixing kernels."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgrid.operators.graph import Sparse, elbow_value


@dataclass(frozen=True)
class Settings:
    """Parameters of the extraction, with their usual values."""

    num_rois: int = 60
    max_iter: int = 100
    roi_size_min: int = 30
    roi_size_max: int = 2000
    num_vectors: int = 1
    eigen_threshold: float | None = 0.9
    elbow_share: float | None = 0.95
    eccentricity: float = 0.9
    fill: bool = True
    refine: bool = True
    area_stop: float = 0.95
    local_max: bool = False


def label_component(rows: np.ndarray, cols: np.ndarray, start: int) -> np.ndarray:
    """Indices of the 8-connected cells that hold the cell `start`; a wave of cells at a time."""
    wide = int(cols.max() - cols.min()) + 3
    at = (rows - rows.min() + 1) * wide + cols - cols.min() + 1
    open_ = np.zeros((int(rows.max() - rows.min()) + 3) * wide, bool)
    open_[at] = True
    steps = np.array([-wide - 1, -wide, -wide + 1, -1, 1, wide - 1, wide, wide + 1])
    wave = at[start : start + 1]
    open_[wave] = False
    seen = [wave]
    while len(wave):
        wave = (wave[:, None] + steps).ravel()
        wave = np.unique(wave[open_[wave]])
        open_[wave] = False
        seen.append(wave)
    return np.flatnonzero(np.isin(at, np.concatenate(seen)))


def eccentricity(rows: np.ndarray, cols: np.ndarray) -> float:
    """0 for a circle, 1 for a line, from second moments."""
    a, c, b = rows.var(), cols.var(), ((rows - rows.mean()) * (cols - cols.mean())).mean()
    q = np.sqrt(4 * b * b + (a - c) ** 2) / 2
    top = (a + c) / 2 + q
    return float(np.sqrt(max(0.0, 1 - ((a + c) / 2 - q) / top))) if top > 0 else 0.0


def select(x: np.ndarray, own: np.ndarray, least: int, threshold: float | None) -> np.ndarray:
    """Columns whose squared sum over the cells `own` is near the best, `least` at least."""
    score = x[own].sum(0) ** 2
    kept = np.flatnonzero(score > (1 - threshold) * score.max()) if threshold is not None else np.zeros(0, int)
    return kept if len(kept) >= least else np.argsort(-score, kind="stable")[:least]


def fill(rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells with the holes that the outside doesn't reach over 4-neighbours."""
    r0, c0 = rows.min() - 1, cols.min() - 1
    solid = np.zeros((rows.max() - r0 + 2, cols.max() - c0 + 2), bool)
    solid[rows - r0, cols - c0] = True
    out = np.zeros_like(solid)
    out[[0, -1]] = True
    out[:, [0, -1]] = True
    while True:
        grown = out.copy()
        grown[1:] |= out[:-1]
        grown[:-1] |= out[1:]
        grown[:, 1:] |= out[:, :-1]
        grown[:, :-1] |= out[:, 1:]
        grown &= ~solid
        if (grown == out).all():
            r, c = np.nonzero(~out)
            return r + r0, c + c0
        out = grown


def grow_region(x: np.ndarray, rows: np.ndarray, cols: np.ndarray, seed: int, s: Settings) -> np.ndarray:
    """Cells of the region around one seed: growth in the selected vectors, component of the seed, refinement from its strongest cell."""
    cols_of = select(x, np.array([seed]), s.num_vectors, s.eigen_threshold)
    y = x[:, cols_of]
    own = np.flatnonzero(((y - y[seed]) ** 2).sum(1) <= (y * y).sum(1))
    if seed not in own:
        return own[:0]
    own = own[label_component(rows[own], cols[own], int(np.searchsorted(own, seed)))]
    if not s.refine or not len(own):
        return own
    cols_of = select(x, own, s.num_vectors, s.eigen_threshold)
    y = x[:, cols_of]
    norm = (y * y).sum(1)
    seed = int(own[np.argmax(norm[own])])
    d = ((y - y[seed]) ** 2).sum(1)
    if s.elbow_share is None:
        near = np.flatnonzero(d <= norm)
    else:
        near = np.flatnonzero(d < s.elbow_share * elbow_value(np.sort(d)[: max(1, len(d) // 2)]))
    if seed not in near:
        return own
    return near[label_component(rows[near], cols[near], int(np.searchsorted(near, seed)))]


def smoothed(image: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian filter cut off at 4 sigma, the edge sample repeated."""
    radius = int(4 * sigma + 0.5)
    taps = np.exp(-0.5 * (np.arange(-radius, radius + 1) / max(sigma, 1e-9)) ** 2)
    for axis in (0, 1):
        wide = np.pad(image, [(radius, radius) if k == axis else (0, 0) for k in (0, 1)], mode="symmetric")
        image = sum(t * np.take(wide, np.arange(i, i + image.shape[axis]), axis) for i, t in enumerate(taps / taps.sum()))
    return image


def peaks(norm: np.ndarray, rows: np.ndarray, cols: np.ndarray, distance: int) -> list[int]:
    """Cells that are the highest within `distance` cells in the norm image smoothed by its own deviation, away from its edges, best first."""
    r, c = rows - rows.min(), cols - cols.min()
    image = np.zeros((r.max() + 1, c.max() + 1))
    image[r, c] = norm
    image = smoothed(image, float(image.std()))
    side = 2 * distance + 1
    if min(image.shape) < side:
        return []
    most = np.lib.stride_tricks.sliding_window_view(image, (side, side)).max((2, 3))
    inner = image[distance : image.shape[0] - distance, distance : image.shape[1] - distance]
    top = np.zeros(image.shape, bool)
    top[distance : image.shape[0] - distance, distance : image.shape[1] - distance] = (inner == most) & (inner > image.min())
    at = np.flatnonzero(top[r, c])
    return at[np.argsort(-norm[at], kind="stable")].tolist()


def filled(rows: np.ndarray, cols: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Cells of a region and of its holes, as far as they are cells of the tile."""
    if not len(own):
        return own
    r, c = fill(rows[own], cols[own])
    wide = cols.max() + 2
    return np.flatnonzero(np.isin(rows * wide + cols, r * wide + c))


def extract(x: np.ndarray, rows: np.ndarray, cols: np.ndarray, s: Settings) -> list[np.ndarray]:
    """Regions of one tile, as indices of cells. Seeds go by descending norm, or are peaks of the norm image; a failed seed goes to the
    back of the queue. Holes are filled before size and shape are judged. Ends when enough regions are found, max_iter seeds in a row
    failed, or more than a share of the cells is taken."""
    norm = (x * x).sum(1)
    quarter = s.roi_size_min * 0.25
    queue = peaks(np.sqrt(norm), rows, cols, max(1, int(quarter) if quarter < 2 else 2)) if s.local_max else np.argsort(-norm, kind="stable").tolist()
    taken, found, failed = np.zeros(len(x), bool), [], 0
    while queue and len(found) < s.num_rois and failed < s.max_iter and taken.mean() <= s.area_stop:
        seed = queue.pop(0)
        if taken[seed]:
            continue
        own = grow_region(x, rows, cols, seed, s)
        if s.fill:
            own = filled(rows, cols, own)
        if s.roi_size_min < len(own) < s.roi_size_max and eccentricity(rows[own], cols[own]) <= s.eccentricity:
            found.append(own)
            taken[own] = True
            taken[seed] = True
            failed = 0
        else:
            queue.append(seed)
            failed += 1
    return found


def spectral_regions(evec: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(box, roi, row, col) from evec(box, row, col, x); a box is a task and has a bounded number of cells."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"])
        rows, cols = pdf.row.to_numpy(), pdf.col.to_numpy()
        out = []
        for k, own in enumerate(extract(np.stack(pdf.x.to_numpy()), rows, cols, s)):
            out.append(pd.DataFrame({"box": pdf.box.iloc[0], "roi": k + 1, "row": rows[own], "col": cols[own]}))
        return pd.concat(out) if out else pd.DataFrame({"box": [], "roi": [], "row": [], "col": []})

    return evec.select("box", "row", "col", "x").groupBy("box").applyInPandas(run, "box long, roi long, row long, col long")


def magic_wand(evec: DataFrame, row: int, col: int, s: Settings = Settings(roi_size_min=0, roi_size_max=1000, eccentricity=1.0)) -> DataFrame:
    """(row, col) of the region around one cell, joined over the boxes that hold it."""
    held = evec.where((F.col("row") == row) & (F.col("col") == col)).select("box").distinct()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"])
        rows, cols = pdf.row.to_numpy(), pdf.col.to_numpy()
        own = grow_region(np.stack(pdf.x.to_numpy()), rows, cols, int(np.flatnonzero((rows == row) & (cols == col))[0]), s)
        inside = ((rows[own] == row) & (cols[own] == col)).any() if len(own) else False
        return pd.DataFrame({"row": rows[own] if inside else [], "col": cols[own] if inside else []})

    return evec.join(held, "box", "left_semi").select("box", "row", "col", "x").groupBy("box").applyInPandas(run, "row long, col long").distinct()


def rank_one(v: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative rank-1 factors under the Kullback-Leibler loss; row and column means start it, and one round is exact."""
    v = np.maximum(v, 0)
    w, h = v.mean(1), v.mean(0)
    for _ in range(rounds):
        q = v / np.maximum(np.outer(w, h), 1e-11)
        w = w * (q @ h) / max(h.sum(), 1e-11)
        q = v / np.maximum(np.outer(w, h), 1e-11)
        h = h * (w @ q) / max(w.sum(), 1e-11)
    return w, h


def demix(data: np.ndarray, weights: np.ndarray, rounds: int = 100, background: np.ndarray | None = None) -> np.ndarray:
    """Non-negative traces C with data ~ weights' C + b background, by multiplicative updates of C and of the background's weights b in
    turn; data is (pixel, time), weights (region, pixel), background (time), none at all if it isn't given."""
    data = np.maximum(data, 0)
    a = weights.astype(float)
    c = np.maximum(a @ data / np.maximum(a.sum(1, keepdims=True), 1), 1e-11)
    f = np.maximum(background, 1e-11) if background is not None else np.zeros(data.shape[1])
    b = np.maximum(data.mean(1) / f.mean() / 2, 1e-11) if background is not None else np.zeros(len(data))
    top, square = a @ data, a @ a.T
    for _ in range(rounds):
        c = np.maximum(c * top / np.maximum(square @ c + np.outer(a @ b, f), 1e-11), 1e-11)
        if background is None:
            continue
        b = np.maximum(b * (data @ f) / np.maximum(a.T @ (c @ f) + b * (f @ f), 1e-11), 1e-11)
    return c


def demix_entries(data: np.ndarray, roi: np.ndarray, pixel: np.ndarray, weight: np.ndarray, rounds: int, background: np.ndarray) -> np.ndarray:
    """What demix() does, with weights as entries (region, pixel, weight), so that memory follows the regions' pixels."""
    data = np.maximum(data, 0)
    order = np.argsort(roi, kind="stable")
    roi, pixel, weight = roi[order], pixel[order], weight[order]
    n, first = int(roi[-1]) + 1, np.flatnonzero(np.concatenate([[True], np.diff(roi) > 0]))
    top = np.add.reduceat(weight[:, None] * data[pixel], first, axis=0)
    own = pd.DataFrame({"pixel": pixel, "r": roi, "w": weight})
    both = own.merge(own, on="pixel")
    both = both.assign(w=both.w_x * both.w_y).groupby(["r_x", "r_y"], as_index=False).w.sum()
    square = Sparse(both.r_x.to_numpy(), both.r_y.to_numpy(), both.w.to_numpy(), n)
    c = np.maximum(top / np.maximum(np.bincount(roi, weight, n), 1)[:, None], 1e-11)
    f = np.maximum(background, 1e-11)
    b, df, ff = np.maximum(data.mean(1) / f.mean() / 2, 1e-11), data @ f, f @ f
    for _ in range(rounds):
        ab = np.bincount(roi, weight * b[pixel], n)
        c = np.maximum(c * top / np.maximum(square.dot(c) + np.outer(ab, f), 1e-11), 1e-11)
        cf = np.bincount(pixel, weight * (c @ f)[roi], len(data))
        b = np.maximum(b * df / np.maximum(cf + b * ff, 1e-11), 1e-11)
    return c


def denoised_traces(regions: DataFrame, frames: DataFrame, rounds: int = 100, weights: DataFrame | None = None, margin: int = 6) -> DataFrame:
    """(roi, frame, v) of overlapping regions taken apart, with a background of their own.

    The background's course is the time factor of a rank-one fit to the pixels around the regions (those within `margin` cells that are
    in no region; to the regions' own where there are none), which is their mean in each frame; its weight in each pixel is solved
    together with the traces. weights is (roi, pixel, weight), 1 for each pixel where it isn't given.

    In a round a region's trace changes by those of the regions that overlap it. So a task solves the regions that begin in one tile,
    together with all that are within `rounds` overlaps of them, and a class of overlapping regions is dealt to many tasks.
    """
    from fluxgrid.operators.graph import cut_lineage
    from fluxgrid.operators.regions import components, overlaps

    group = components(regions.select(F.col("roi").alias("v")), overlaps(regions).select("a", "b")).withColumnRenamed("component", "grp")
    own = regions.join(group, F.col("roi") == F.col("v")).select("grp", "roi", "pixel", "row", "col")
    own = own.join(weights.select("roi", "pixel", "weight"), ["roi", "pixel"], "left") if weights is not None else own.withColumn("weight", F.lit(1.0))
    own = cut_lineage(own.withColumn("weight", F.coalesce("weight", F.lit(0.0))).dropDuplicates(["roi", "pixel"]))
    wide = own.groupBy("grp").agg(*(f(c).alias(n) for f, c, n in ((F.min, "row", "a"), (F.max, "row", "b"), (F.min, "col", "c"), (F.max, "col", "d"))))
    span = lambda lo, hi: F.explode(F.sequence(F.col(lo) - margin, F.col(hi) + margin))
    cells = wide.withColumn("row", span("a", "b")).withColumn("col", span("c", "d")).select("grp", "row", "col")
    free = frames.select("pixel", "row", "col").distinct().join(regions.select("pixel").distinct(), "pixel", "left_anti")
    around = cells.join(free, ["row", "col"]).select("grp", "pixel", F.lit(False).alias("own"))
    pixels = cut_lineage(own.select("grp", "pixel").distinct().withColumn("own", F.lit(True)).unionByName(around))

    # the course: sums over the pixels with a sample, in the frames that the group has
    samples = pixels.join(frames.select("pixel", "frame", "v"), "pixel")
    sums = samples.groupBy("grp", "frame").agg(*(F.sum(F.when(c, F.greatest("v", F.lit(0.0))).otherwise(0.0)).alias(n) for c, n in ((~F.col("own"), "out"), (F.col("own"), "in"))))
    sampled = pixels.join(frames.select("pixel").distinct(), "pixel", "left_semi").groupBy("grp").agg(F.count(F.when(~F.col("own"), 1)).alias("n_out"), F.count(F.when(F.col("own"), 1)).alias("n_in"))
    course = sums.join(sampled, "grp").select("grp", "frame", F.when(F.col("n_out") > 0, F.try_divide("out", "n_out")).otherwise(F.try_divide("in", "n_in")).alias("v"))

    def listed(rows: DataFrame, *keys: str) -> DataFrame:
        of = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("frame", "v"))).alias("s"))
        return of.select(*keys, F.col("s.frame").alias("fs"), F.col("s.v").alias("vs"))

    corner = own.groupBy("grp", "roi").agg(F.min("row").alias("r"), F.min("col").alias("c"), F.max("row").alias("r1"), F.max("col").alias("c1"))
    most = corner.agg(F.max(F.expr("r1 - r")), F.max(F.expr("c1 - c"))).first()
    reach = [max(1, rounds * int(m or 0)) for m in most]  # as far as `rounds` overlaps go
    at = lambda c, k: F.explode(F.sequence(*(F.floor((F.col(c) + d * reach[k]) / reach[k]) for d in (-1, 1))))
    member = corner.withColumn("tr", at("r", 0)).withColumn("tc", at("c", 1))
    held = (F.floor(F.col("r") / reach[0]) == F.col("tr")) & (F.floor(F.col("c") / reach[1]) == F.col("tc"))
    member = member.select("grp", "roi", "tr", "tc", held.alias("held"))
    tiles = member.where("held").select("grp", "tr", "tc").distinct()
    member = cut_lineage(member.join(tiles, ["grp", "tr", "tc"], "left_semi"))
    left = member.join(own.select("roi", "pixel", "weight"), "roi").select("grp", "tr", "tc", "roi", "pixel", "weight", "held")
    vectors = listed(samples.where("own"), "grp", "pixel")
    right = left.select("grp", "tr", "tc", "pixel").distinct().join(vectors, ["grp", "pixel"]).select("grp", "tr", "tc", "pixel", "fs", "vs")
    right = right.unionByName(tiles.join(listed(course, "grp"), "grp").select("grp", "tr", "tc", F.lit(None).cast("long").alias("pixel"), "fs", "vs"))
    right = right.toDF("of", "r", "c", "cell", "fs", "vs")

    def run(inside: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        background = given[given.cell.isna()]
        given = given[given.cell.notna()].sort_values("cell")
        inside = inside[inside.pixel.isin(given.cell)]
        if inside.empty or background.empty:
            return pd.DataFrame({"roi": [], "frame": [], "v": []})
        frames_, f = np.asarray(background.fs.iloc[0]), np.asarray(background.vs.iloc[0], float)
        data = np.zeros((len(given), len(frames_)))
        for k, (fs, vs) in enumerate(zip(given.fs, given.vs)):
            data[k, np.searchsorted(frames_, fs)] = vs
        rois = np.sort(inside.roi.unique())
        c = demix_entries(data, np.searchsorted(rois, inside.roi), np.searchsorted(given.cell.to_numpy().astype(np.int64), inside.pixel), inside.weight.to_numpy(float), rounds, f)
        mine = np.isin(rois, inside.roi[inside.held])
        rois, c = rois[mine], c[mine]
        return pd.DataFrame({"roi": np.repeat(rois, c.shape[1]).astype(np.int64), "frame": np.tile(frames_, len(rois)), "v": c.ravel()})

    keys = ("grp", "tr", "tc")
    return left.groupBy(*keys).cogroup(right.groupBy("of", "r", "c")).applyInPandas(run, "roi long, frame long, v double")


def poisson_noise(frames: DataFrame, factor: float, replicas: int, seed: int = 5) -> DataFrame:
    """frames with a column `replica`; each sample gains Poisson noise whose mean is the pixel's standard deviation times factor.

    The draw inverts the distribution at a hash of seed, replica, pixel and frame, so that a rerun gives the same noise.
    """
    spread = frames.groupBy("pixel").agg((F.stddev_pop("v") * factor).alias("mean"))
    rows = frames.join(spread, "pixel").withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
    u = F.pmod(F.xxhash64(F.lit(seed), "replica", "pixel", "frame"), F.lit(1 << 52)).cast("double") / float(1 << 52)

    def draw(batches):
        import pyarrow as pa

        for b in batches:
            mean, p = b.column("mean").to_numpy(zero_copy_only=False), b.column("u").to_numpy(zero_copy_only=False)
            out = np.zeros(len(p))
            term = np.exp(-mean)
            total, k = term.copy(), 0
            while (live := total < p).any() and k < mean.max(initial=0) * 20 + 100:
                k += 1
                out[live] = k
                term = term * mean / k
                total = total + term
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("replica", "pixel", "frame", "v")), pa.array(out)], ["replica", "pixel", "frame", "v", "noise"])

    drawn = rows.select("replica", "pixel", "frame", "v", "mean", u.alias("u")).mapInArrow(draw, "replica int, pixel long, frame long, v double, noise double")
    return drawn.withColumn("noisy", F.col("v") + F.col("noise"))
