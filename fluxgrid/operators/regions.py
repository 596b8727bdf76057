"""Region sets (roi, pixel, row, col): seeds, growth, acceptance, overlaps, set algebra and morphology."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxgrid.operators.filters import EIGHT, FOUR, offsets
from fluxgrid.operators.graph import components, cut_lineage  # noqa: F401
from fluxgrid.operators.spectrum import Tables, numbered


def seeds(norms: DataFrame) -> DataFrame:
    """Cells by descending norm; ties by number. Ranks come from a sort by ranges, so that no task holds all cells."""
    return numbered(norms, [F.desc("norm2"), F.col("i")], Tables(norms.sparkSession), "seeds").withColumn("seed", F.col("at") + 1).drop("at")


def local_maxima(image: DataFrame, column: str) -> DataFrame:
    """Cells that no 8-neighbour exceeds."""
    near = offsets(image.select("pixel", "row", "col", column), EIGHT)
    other = image.select(F.col("row").alias("nrow"), F.col("col").alias("ncol"), F.col(column).alias("w"))
    return near.join(other, ["nrow", "ncol"]).groupBy("pixel", column).agg(F.max("w").alias("w")).where(F.col(column) >= F.col("w")).select("pixel", column)


def select_vectors(members: DataFrame, keep: float) -> DataFrame:
    """(roi, k, score): squared sum of each vector over a region; those above (1 - keep) of the region's best stay. members has (roi, x)."""
    scores = members.select("roi", F.posexplode("x").alias("k", "x")).groupBy("roi", "k").agg(F.sum("x").alias("s")).withColumn("score", F.col("s") * F.col("s"))
    return scores.withColumn("best", F.max("score").over(Window.partitionBy("roi"))).where(F.col("score") > (1 - keep) * F.col("best")).select("roi", "k", "score")


def seed_distance(vectors: DataFrame, seed: int) -> DataFrame:
    """(i, d, norm2): squared distance to the seed's vector and own squared norm."""
    one = vectors.where(f"i = {seed}").select(F.col("x").alias("y"))
    d = F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return vectors.join(F.broadcast(one)).select("i", d.alias("d"), F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v).alias("norm2"))


def elbow(values: DataFrame, column: str, half: bool = False) -> DataFrame:
    """The value farthest from the line from the smallest to the largest; of the first half only if asked for.

    Ranks come from counts of distinct values in ranges of values, so that no task holds all of them.
    """
    counts = values.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    ranged = cut_lineage(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranged.groupBy("part").agg(F.sum("c").alias("n")).select("part", before.alias("start"))  # a row for each partition
    inside = F.sum("c").over(Window.partitionBy("part").orderBy("v")) - F.col("c")
    ranked = ranged.withColumn("k", inside).join(F.broadcast(starts), "part").select("v", "c", (F.col("k") + F.col("start")).alias("k"))
    if half:
        ranked = ranked.join(F.broadcast(counts.agg((F.sum("c") / 2).cast("long").alias("n")))).where("k < n").withColumn("c", F.expr("least(c, n - k)")).drop("n")
    ends = ranked.agg(F.min("v").alias("v0"), F.max("v").alias("v1"), (F.sum("c") - 1).alias("l"))
    d = F.expr("abs(l * (v - v0) - k * (v1 - v0)) / sqrt(l * l + (v1 - v0) * (v1 - v0))")
    last = F.expr("abs(l * (v - v0) - (k + c - 1) * (v1 - v0)) / sqrt(l * l + (v1 - v0) * (v1 - v0))")
    return ranked.join(F.broadcast(ends)).withColumn("d", F.greatest(d, last)).orderBy(F.desc("d"), "v").limit(1).select(F.col("v").alias("elbow"))


def shape(regions: DataFrame) -> DataFrame:
    """Area, bounding box, extent, centre and eccentricity (0 circle, 1 line) of each region."""
    m = regions.groupBy("roi").agg(F.count("*").alias("area"), F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"), F.avg("row").alias("cr"), F.avg("col").alias("cc"), F.var_pop("row").alias("a"), F.var_pop("col").alias("c"), F.covar_pop("row", "col").alias("b"))
    m = m.withColumn("extent", F.expr("case when (r1 - r0) * (c1 - c0) = 0 then null else area / ((r1 - r0) * (c1 - c0)) end"))
    m = m.withColumn("q", F.expr("sqrt(4 * b * b + (a - c) * (a - c)) / 2"))
    return m.withColumn("eccentricity", F.expr("case when (a + c) / 2 + q = 0 then 0.0 else sqrt(greatest(0, 1 - ((a + c) / 2 - q) / ((a + c) / 2 + q))) end")).drop("a", "b", "c", "q")


def accept(shapes: DataFrame, least: int, most: int, eccentricity: float) -> DataFrame:
    return shapes.where((F.col("area") > least) & (F.col("area") < most) & (F.col("eccentricity") <= eccentricity))


def overlaps(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """(a, b, shared, size_a, size_b) of regions with common pixels; within one set, of a < b."""
    own = b is None
    b = a if b is None else b
    x, y = a.select(F.col("roi").alias("a"), "pixel"), b.select(F.col("roi").alias("b"), "pixel")
    pairs = x.join(y, "pixel")
    pairs = (pairs.where("a < b") if own else pairs).groupBy("a", "b").agg(F.count("*").alias("shared"))
    return pairs.join(a.groupBy(F.col("roi").alias("a")).agg(F.count("*").alias("size_a")), "a").join(b.groupBy(F.col("roi").alias("b")).agg(F.count("*").alias("size_b")), "b").select("a", "b", "shared", "size_a", "size_b")


def merge_pairs(regions: DataFrame, traces: DataFrame, share: float | None, coefficient: float) -> DataFrame:
    """Pairs whose overlap is above a share of both (None: any common pixel) and whose traces (roi, frame, v) correlate; only
    overlapping pairs are correlated."""
    near = overlaps(regions)
    if share is not None:
        near = near.where((F.col("shared") > share * F.col("size_a")) & (F.col("shared") > share * F.col("size_b")))
    x, y = traces.select(F.col("roi").alias("a"), "frame", F.col("v").alias("x")), traces.select(F.col("roi").alias("b"), "frame", F.col("v").alias("y"))
    both = near.join(x, "a").join(y, ["b", "frame"]).groupBy("a", "b", "shared").agg(F.corr("x", "y").alias("corr"))
    return both.where(F.col("corr") >= coefficient)


def merge(regions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Regions joined along pairs; a merged region has the smallest number of its parts."""
    label = components(regions.select(F.col("roi").alias("v")), pairs.select("a", "b"))
    return regions.join(label, F.col("roi") == F.col("v")).select(F.col("component").alias("roi"), "pixel", "row", "col").distinct()


def connected(pixels: DataFrame, steps: list[tuple[int, int]] = EIGHT) -> DataFrame:
    """(pixel, component) of a set of pixels(pixel, row, col)."""
    other = pixels.select(F.col("pixel").alias("b"), F.col("row").alias("nrow"), F.col("col").alias("ncol"))
    edges = offsets(pixels.select(F.col("pixel").alias("a"), "row", "col"), steps).join(other, ["nrow", "ncol"]).select("a", "b")
    return components(pixels.select(F.col("pixel").alias("v")), edges).select(F.col("v").alias("pixel"), "component")


def resolve(regions: DataFrame, centres: DataFrame) -> DataFrame:
    """Each shared pixel goes to the region with the nearer centre (roi, cr, cc); a tie to the smaller number."""
    d = F.expr("(row - cr) * (row - cr) + (col - cc) * (col - cc)")
    w = Window.partitionBy("pixel").orderBy(F.round(d, 9), "roi")
    return regions.join(centres.select("roi", "cr", "cc"), "roi").withColumn("k", F.row_number().over(w)).where("k = 1").select("roi", "pixel", "row", "col")


def dilate(regions: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """One step of the 4-neighbour dilation within the image."""
    near = offsets(regions.select("roi", "row", "col"), [*FOUR, (0, 0)]).where(f"nrow between 0 and {nrows - 1} and ncol between 0 and {ncols - 1}")
    return near.select("roi", F.expr(f"cast(nrow * {ncols} + ncol as long)").alias("pixel"), F.col("nrow").cast("long").alias("row"), F.col("ncol").cast("long").alias("col")).distinct()


def ring(regions: DataFrame, nrows: int, ncols: int, steps: int, guard: int = 2) -> DataFrame:
    """Surround of each region: dilated `guard + steps` times, without any region or guard band."""
    wide, inner = regions, regions
    for k in range(guard + steps):
        wide = dilate(wide, nrows, ncols)
        if k + 1 == guard:
            inner = wide
    return wide.join(inner.select("pixel").distinct(), "pixel", "left_anti").select("roi", "pixel", "row", "col")


def sized_ring(regions: DataFrame, nrows: int, ncols: int, least: int, guard: int = 2, reach: int = 6) -> DataFrame:
    """Surround of each region, as wide as it takes: dilated until `least` pixels and its own size are free of every region and of its
    own guard band. k dilations with the 4-neighbour cross reach all pixels within k steps, so the width is a rank of distances.

    Distances up to `reach` are tried first; regions that need more get twice as many, up to the whole image.
    """
    taken, size = regions.select("pixel").distinct(), regions.groupBy("roi").agg(F.count("*").alias("size"))
    edge = outline(regions).select("roi", "row", "col")
    out, open_ = None, size
    while True:
        steps = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if guard < abs(i) + abs(j) <= reach]
        inner = [(i, j) for i in range(-guard, guard + 1) for j in range(-guard, guard + 1) if abs(i) + abs(j) <= guard]
        cells = offsets(edge.join(open_.select("roi"), "roi", "left_semi"), [*inner, *steps])
        cells = cells.where(f"nrow between 0 and {nrows - 1} and ncol between 0 and {ncols - 1}").selectExpr(
            "roi", f"cast(nrow * {ncols} + ncol as long) as pixel", "cast(nrow as long) as r", "cast(ncol as long) as c", "abs(nrow - row) + abs(ncol - col) as d"
        )
        free = cells.groupBy("roi", "pixel", "r", "c").agg(F.min("d").alias("d")).where(f"d > {guard}").join(taken, "pixel", "left_anti")
        count = free.groupBy("roi", "d").agg(F.count("*").alias("n"))
        upto = count.withColumn("n", F.sum("n").over(Window.partitionBy("roi").orderBy("d"))).join(size, "roi").where(f"n >= {least} + size")
        width = upto.groupBy("roi").agg(F.min("d").alias("width"))
        whole = reach >= nrows + ncols
        if whole:
            width = open_.select("roi").join(width, "roi", "left").select("roi", F.coalesce("width", F.lit(reach)).alias("width"))
        part = cut_lineage(free.join(width, "roi").where("d <= width").select("roi", "pixel", F.col("r").alias("row"), F.col("c").alias("col")))
        out = part if out is None else out.unionByName(part)
        open_ = cut_lineage(open_.join(width, "roi", "left_anti"))
        if whole or open_.isEmpty():
            return out
        reach *= 2


def outline(regions: DataFrame) -> DataFrame:
    """Pixels with a 4-neighbour outside the region."""
    near = offsets(regions, FOUR)
    other = regions.select(F.col("roi").alias("o"), F.col("row").alias("nrow"), F.col("col").alias("ncol"))
    inside = near.join(other, (near["roi"] == other["o"]) & (near["nrow"] == other["nrow"]) & (near["ncol"] == other["ncol"])).groupBy("roi", "pixel").count().where("count = 4")
    return regions.join(inside, ["roi", "pixel"], "left_anti")


def brush(points: DataFrame, size: int, nrows: int, ncols: int) -> DataFrame:
    """Pixels of the squares of side 2 * size + 1 around points(row, col), within the image."""
    span = F.sequence(F.lit(-size), F.lit(size))
    cells = points.withColumn("dr", F.explode(span)).withColumn("dc", F.explode(span)).selectExpr("cast(row + dr as long) as row", "cast(col + dc as long) as col")
    return cells.where(f"row between 0 and {nrows - 1} and col between 0 and {ncols - 1}").distinct().withColumn("pixel", F.expr(f"row * {ncols} + col"))


def fill_holes(regions: DataFrame) -> DataFrame:
    """Regions with the background that their outside doesn't reach over 4-neighbours; one region a task, on its bounding box."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf.row.to_numpy(), pdf.col.to_numpy()
        r0, c0 = r.min() - 1, c.min() - 1
        solid = np.zeros((r.max() - r0 + 2, c.max() - c0 + 2), bool)
        solid[r - r0, c - c0] = True
        out = np.zeros_like(solid)
        out[0] = out[-1] = out[:, 0] = out[:, -1] = True
        while True:
            grown = out.copy()
            grown[1:] |= out[:-1]
            grown[:-1] |= out[1:]
            grown[:, 1:] |= out[:, :-1]
            grown[:, :-1] |= out[:, 1:]
            grown &= ~solid
            if (grown == out).all():
                break
            out = grown
        rr, cc = np.nonzero(~out)
        return pd.DataFrame({"roi": pdf.roi.iloc[0], "row": rr + r0, "col": cc + c0})

    return regions.select("roi", "row", "col").groupBy("roi").applyInPandas(fill, "roi long, row long, col long")


def circularity(regions: DataFrame) -> DataFrame:
    """4 pi area / perimeter squared, in hundredths of the best, the perimeter being counted in pixel edges (another measure than a circle fit)."""
    other = regions.select(F.col("roi").alias("o"), F.col("row").alias("nrow"), F.col("col").alias("ncol"))
    near = offsets(regions, FOUR)
    joined = near.join(other, (near["roi"] == other["o"]) & (near["nrow"] == other["nrow"]) & (near["ncol"] == other["ncol"]), "left")
    per = joined.groupBy("roi").agg(F.sum(F.when(F.col("o").isNull(), 1).otherwise(0)).alias("perimeter"), (F.count("*") / 4).alias("area"))
    score = per.withColumn("s", 4 * np.pi * F.col("area") / (F.col("perimeter") * F.col("perimeter")))
    return score.join(F.broadcast(score.agg(F.max("s").alias("best")))).select("roi", "area", "perimeter", (100 * F.col("s") / F.col("best")).alias("circularity"))


def assign_unassigned(regions: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """Regions grown by one step into free pixels: to the only neighbour, or to that with the nearer centre (a tie to the smaller number)."""
    free = dilate(regions, nrows, ncols).join(regions.select("pixel").distinct(), "pixel", "left_anti")
    return resolve(free.select("roi", "pixel", "row", "col"), shape(regions))


def footprint_correlation(regions: DataFrame, frames: DataFrame, active: DataFrame, margin: int = 2) -> DataFrame:
    """(roi, n_frames, corr): mask against the mean image of the frames in which a region is active and no region that overlaps it is.

    active is (roi, frame). The image is the region's bounding box with a margin; a region of less than 3 pixels scores 0.
    """
    near = overlaps(regions)
    both = near.select("a", "b").union(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    busy = both.join(active, both["b"] == active["roi"]).select(F.col("a").alias("roi"), "frame").distinct()
    own = active.join(busy, ["roi", "frame"], "left_anti")
    box = shape(regions).select("roi", "area", (F.col("r0") - margin).alias("r0"), (F.col("r1") + margin).alias("r1"), (F.col("c0") - margin).alias("c0"), (F.col("c1") + margin).alias("c1"))
    cells = box.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1"))).select("roi", "area", "row", "col")
    image = own.join(cells, "roi").join(frames.select("row", "col", "frame", "v"), ["row", "col", "frame"]).groupBy("roi", "area", "row", "col").agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    mask = image.join(regions.select("roi", "row", "col", F.lit(1.0).alias("one")), ["roi", "row", "col"], "left")
    one = F.coalesce("one", F.lit(0.0))
    flat = (F.stddev_pop("m") == 0) | (F.stddev_pop(one) == 0)  # an image of one value correlates with nothing
    out = mask.groupBy("roi", "area").agg(F.max("n").alias("n_frames"), F.when(~flat, F.try_divide(F.covar_pop("m", one), F.stddev_pop("m") * F.stddev_pop(one))).alias("corr"))
    return out.select("roi", "n_frames", F.expr("case when area < 3 then 0.0 else corr end").alias("corr"))


def component_count(pixels: DataFrame, steps: list[tuple[int, int]] = EIGHT) -> DataFrame:
    """n: connected components of a set of pixels, and one for the background."""
    return connected(pixels, steps).agg((F.countDistinct("component") + 1).alias("n"))


def at_pixel(regions: DataFrame, row: int, col: int) -> DataFrame:
    """(turn, roi): regions under a cell, in the order in which repeated picks go through them."""
    own = regions.where(f"row = {row} and col = {col}").select("roi").distinct()
    return own.select(F.row_number().over(Window.orderBy("roi")).alias("turn"), "roi")  # as many rows as regions overlap in one cell


def eigen_centres(regions: DataFrame, spectra: DataFrame) -> DataFrame:
    """(roi, x): mean vector of each region's pixels; spectra is (pixel, x)."""
    values = regions.select("roi", "pixel").join(spectra.select("pixel", F.posexplode("x").alias("k", "v")), "pixel")
    means = values.groupBy("roi", "k").agg(F.avg("v").alias("v"))
    return means.groupBy("roi").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("x"))


def resolve_in_spectrum(regions: DataFrame, spectra: DataFrame) -> DataFrame:
    """Each shared pixel goes to the region whose mean vector is nearer to its own; a tie to the smaller number."""
    centre = eigen_centres(regions, spectra).select("roi", F.col("x").alias("m"))
    d = F.aggregate(F.zip_with("x", "m", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    near = regions.join(spectra.select("pixel", "x"), "pixel").join(centre, "roi").withColumn("d", F.round(d, 9))
    return near.withColumn("k", F.row_number().over(Window.partitionBy("pixel").orderBy("d", "roi"))).where("k = 1").select("roi", "pixel", "row", "col")


def blob(regions: DataFrame, colours: list[tuple[int, int, int]]) -> DataFrame:
    """(pixel, red, green, blue, alpha): regions in turn of their numbers in the colours given; a later one covers an earlier one."""
    rank = regions.select("roi").distinct().select("roi", (F.row_number().over(Window.orderBy("roi")) - 1).alias("k"))  # one row a region
    table = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(c, ("red", "green", "blue")))) for c in colours))
    top = regions.join(rank, "roi").groupBy("pixel").agg(F.max("k").alias("k"))
    return top.select("pixel", F.element_at(table, (F.col("k") % len(colours) + 1).cast("int")).alias("c")).select("pixel", "c.*", F.lit(255).alias("alpha"))


def zoom(regions: DataFrame, nrows: int, ncols: int, margin: int = 50) -> DataFrame:
    """(roi, r0, r1, c0, c1): bounding box with a margin, within the image, half open."""
    limits = [F.min("row"), F.max("row"), F.min("col"), F.max("col")]
    box = regions.groupBy("roi").agg(*(x.alias(n) for x, n in zip(limits, ("a", "b", "c", "d"))))
    return box.selectExpr("roi", f"greatest(0, a - {margin}) as r0", f"least({nrows}, b + {margin} + 1) as r1", f"greatest(0, c - {margin}) as c0", f"least({ncols}, d + {margin} + 1) as c1")


def contour(regions: DataFrame) -> DataFrame:
    """(roi, r0, c0, r1, c1): unit edges between a region's pixels and the outside, as grid points; chained, they are its contour lines."""
    near = offsets(regions.select("roi", "row", "col"), FOUR)
    inside = regions.select("roi", F.col("row").alias("nrow"), F.col("col").alias("ncol"))
    rim = near.join(inside, ["roi", "nrow", "ncol"], "left_anti")
    r0, c0 = F.greatest("row", "nrow"), F.greatest("col", "ncol")
    flat = F.col("row") != F.col("nrow")  # an edge between two rows runs along the columns
    ends = [r0, c0, F.when(flat, r0).otherwise(r0 + 1), F.when(flat, c0 + 1).otherwise(c0)]
    return rim.select("roi", *(x.cast("long").alias(n) for x, n in zip(ends, ("r0", "c0", "r1", "c1"))))
