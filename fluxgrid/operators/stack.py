"""Projections, slices, crops, tiles, masks and coordinates of stacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def project(frames: DataFrame, kind: str, keys: tuple[str, ...] = ("pixel",)) -> DataFrame:
    """Image over time: max, mean or median (exact, linear between ranks) of each pixel."""
    agg = {"max": F.max("v"), "mean": F.avg("v"), "median": F.expr("percentile(v, 0.5)")}[kind]
    return frames.groupBy(*keys).agg(agg.alias(kind))


def project_trials(frames: DataFrame) -> DataFrame:
    """Mean of the trials' means and maximum of their maxima; trials weigh the same whatever their length."""
    per = frames.groupBy("trial", "pixel").agg(F.avg("v").alias("m"), F.max("v").alias("x"))
    return per.groupBy("pixel").agg(F.avg("m").alias("mean_of_means"), F.max("x").alias("max_of_maxes"))


def slice_frames(frames: DataFrame, start: int, every: int) -> DataFrame:
    """Every n-th frame from start on, numbered from 0."""
    return frames.where(f"frame >= {start} and (frame - {start}) % {every} = 0").withColumn("frame", F.expr(f"(frame - {start}) div {every}"))


def crop(frames: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Half-open ranges of rows and columns; plain predicates, so that they reach the scan."""
    return frames.where((F.col("row") >= rows[0]) & (F.col("row") < rows[1]) & (F.col("col") >= cols[0]) & (F.col("col") < cols[1]))


def cropped(frames: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """A crop as a stack of its own: rows, columns and pixels are numbered from its corner."""
    inner = crop(frames, rows, cols).withColumns({"row": F.col("row") - rows[0], "col": F.col("col") - cols[0]})
    return inner.withColumn("pixel", (F.col("row") * (cols[1] - cols[0]) + F.col("col")).cast("long"))


def auto_crop_range(frames: DataFrame, axis: str, n: int) -> tuple[int, int]:
    """Half-open range of an axis inside the borders of every trial, each held against its own minimum; all of it if no line is inside."""
    keys = ["trial"] if "trial" in frames.columns else []
    if not keys:
        frames, keys = frames.withColumn("trial", F.lit(0)), ["trial"]
    low = frames.groupBy(*keys).agg(F.min("v").alias("low"))
    line = frames.join(F.broadcast(low), keys).groupBy(*keys, "frame", axis).agg(F.expr("bool_and(v <= low)").alias("flat"))
    border = line.groupBy(axis).agg(F.expr("bool_or(flat)").alias("border"))
    inner = border.where("not border").agg(F.min(axis), F.max(axis)).first()
    return (0, n) if inner[0] is None else (int(inner[0]), int(inner[1]) + 1)


def join_trials(frames: DataFrame) -> DataFrame:
    """Trials one behind the other in time, in order of their names: each frame gains the lengths of the trials before."""
    length = frames.groupBy("trial").agg((F.max("frame") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("trial").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = length.select("trial", before.alias("start"))  # one row a trial
    return frames.join(F.broadcast(start), "trial").withColumn("frame", (F.col("frame") + F.col("start")).cast("long")).drop("start", "trial")


def even_frames(frames: DataFrame, n: int, total: int) -> DataFrame:
    """n slices at equal distances: frames 0, s, 2 s and so on with s = total div n."""
    step = max(1, total // n)
    return frames.where(f"frame % {step} = 0 and frame div {step} < {n}")


def auto_crop(frames: DataFrame, axis: str) -> DataFrame:
    """First and last line of an axis that isn't border. A line is border if all of its pixels are at the stack's minimum in some frame."""
    low = frames.agg(F.min("v").alias("low"))
    line = frames.join(F.broadcast(low)).groupBy("frame", axis).agg(F.expr("bool_and(v <= low)").alias("flat"))
    inner = line.groupBy(axis).agg(F.expr("bool_or(flat)").alias("border")).where("not border")
    return inner.agg(F.min(axis).alias("first"), F.max(axis).alias("last"))


def split_trials(frames: DataFrame, length: int) -> DataFrame:
    """Blocks of a number of frames; the last may be short."""
    return frames.withColumn("block", F.expr(f"frame div {length}")).withColumn("frame", F.expr(f"frame % {length}"))


def time_boxes(frames: DataFrame, n: int) -> DataFrame:
    """n blocks of equal length; what is left over goes."""
    total = frames.agg((F.max("frame") + 1).alias("total"))
    return frames.join(F.broadcast(total)).withColumn("box", F.expr(f"frame div (total div {n})")).where(f"box < {n}").drop("total")


def pixel_vectors(frames: DataFrame, keys: tuple[str, ...] = ("pixel",)) -> DataFrame:
    """Samples of each pixel in order of time."""
    return frames.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "v"))), lambda s: s["v"]).alias("vec"))


def tiles(nrows: int, ncols: int, per_side: int, overlap: int) -> list[tuple[int, int, int, int, int]]:
    """(box, r0, r1, c0, c1), half open: per_side x per_side tiles, widened by overlap and kept inside; the last reaches the edge."""
    h, w = nrows // per_side, ncols // per_side
    out = []
    for i in range(per_side):
        for j in range(per_side):
            r1, c1 = nrows if i == per_side - 1 else (i + 1) * h + overlap, ncols if j == per_side - 1 else (j + 1) * w + overlap
            out.append((i * per_side + j, max(0, i * h - overlap), min(nrows, r1), max(0, j * w - overlap), min(ncols, c1)))
    return out


def tile(pixels: DataFrame, boxes: list[tuple[int, int, int, int, int]], closed: bool = False) -> DataFrame:
    """Pixels with each box that holds them; the boxes are a constant of the plan. Ends are outside of a box, or inside if closed."""
    rows = F.array(*(F.struct(*(F.lit(v).cast("long").alias(n) for n, v in zip(("box", "r0", "r1", "c0", "c1"), b))) for b in boxes))
    more = int(closed)
    held = F.filter(rows, lambda b: (F.col("row") >= b["r0"]) & (F.col("row") < b["r1"] + more) & (F.col("col") >= b["c0"]) & (F.col("col") < b["c1"] + more))
    return pixels.withColumn("b", F.explode(held)).select("*", "b.*").drop("b")


def box_pixel(tiled: DataFrame) -> DataFrame:
    """Flat pixel number within the box."""
    return tiled.withColumn("box_pixel", F.expr("(row - r0) * (c1 - c0) + col - c0"))


def image_pixel(boxed: DataFrame, ncols: int) -> DataFrame:
    """The way back from a box's flat number to the image's."""
    return boxed.withColumn("image_pixel", F.expr(f"(box_pixel div (c1 - c0) + r0) * {ncols} + c0 + box_pixel % (c1 - c0)"))


def mosaic(tiled: DataFrame, nrows: int, ncols: int, per_side: int) -> DataFrame:
    """Tiles without their overlap: of each box the pixels of its core."""
    h, w = nrows // per_side, ncols // per_side
    side = lambda c, n: f"least({c} div {n}, {per_side - 1})" if n else str(per_side - 1)
    core = f"{side('row', h)} * {per_side} + {side('col', w)}"
    return tiled.where(f"box = {core}")


def masked(frames: DataFrame, mask: DataFrame) -> DataFrame:
    return frames.join(mask, "pixel", "left_semi")


def unmasked(values: DataFrame, grid: DataFrame) -> DataFrame:
    """Values on the whole grid, 0 where the mask has none."""
    return grid.join(values, "pixel", "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def mask_index(mask: DataFrame) -> DataFrame:
    """Compact number of each masked pixel. Masked pixels are counted per block of pixels first, so that no window holds the whole mask."""
    blocks = mask.withColumn("block", F.expr("pixel div 4096"))
    sizes = blocks.groupBy("block").agg(F.count("*").alias("n"))
    before = sizes.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))
    return blocks.withColumn("k", F.row_number().over(Window.partitionBy("block").orderBy("pixel"))).join(before, "block").select("pixel", (F.col("before") + F.col("k") - 1).alias("idx"))


def impute(cells: DataFrame) -> DataFrame:
    """A missing sample becomes the mean of its pixel."""
    return cells.withColumn("v", F.coalesce("v", F.avg("v").over(Window.partitionBy("pixel"))))


def floor_clamp(frames: DataFrame, floor: float) -> DataFrame:
    """Samples below floor become the smallest sample above it."""
    least = frames.agg(F.min(F.when(F.col("v") > floor, F.col("v"))).alias("least"))
    return frames.join(F.broadcast(least)).withColumn("v", F.expr(f"case when v < {floor} then least else v end")).drop("least")


def shift_regions(regions: DataFrame, dr: int, dc: int, nrows: int | None = None, ncols: int | None = None) -> DataFrame:
    """Regions moved; with a size, coordinates stay inside."""
    r, c = F.col("row") + dr, F.col("col") + dc
    if nrows is not None and ncols is not None:
        r, c = F.greatest(F.lit(0), F.least(r, F.lit(nrows - 1))), F.greatest(F.lit(0), F.least(c, F.lit(ncols - 1)))
    return regions.select("roi", r.cast("long").alias("row"), c.cast("long").alias("col"))
