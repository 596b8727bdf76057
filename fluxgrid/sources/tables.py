"""Stacks, vectors and regions from tables. A stack is frames(pixel, row, col, frame, v); a region set is (roi, pixel, row, col)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the event grid, and the day that is frame 0.
NCOLS, DAY0 = 15, "timestamp_ntz'2024-01-01'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_coordinates(df: DataFrame, ncols: int = NCOLS) -> DataFrame:
    """row and col of a flat pixel number."""
    return df.withColumns({"row": F.expr(f"pixel div {ncols}"), "col": F.expr(f"pixel % {ncols}")})


def event_frames(spark: SparkSession, sf_dir: str, by_trial: bool = False) -> DataFrame:
    """One cell for each user and day: pixel = user, frame = day, v = sum of values; the event type is the trial if asked for."""
    keys = ["trial", "pixel", "frame"] if by_trial else ["pixel", "frame"]
    cells = table(spark, sf_dir, "events").selectExpr("event_type as trial", "cast(user_id as long) as pixel", f"timestampdiff(DAY, {DAY0}, ts) as frame", "value")
    return with_coordinates(cells.groupBy(*keys).agg(F.round(F.sum("value"), 4).alias("v")))


def part_frames(spark: SparkSession, sf_dir: str, n_pixels: int = 400, ncols: int = 20) -> DataFrame:
    """Quantities shipped by part (modulo n_pixels) and month."""
    cells = table(spark, sf_dir, "lineitem").selectExpr(f"cast(l_partkey % {n_pixels} as long) as pixel", "cast((year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1 as long) as frame", "l_quantity")
    return with_coordinates(cells.groupBy("pixel", "frame").agg(F.sum("l_quantity").cast("double").alias("v")), ncols)


def block_regions(frames: DataFrame, shift: int = 0, side: int = 5, ncols: int = NCOLS) -> DataFrame:
    """Every side x side block of the grid as a region, moved by (shift, shift) within the grid's pixels."""
    grid = frames.select("pixel", "row", "col").distinct()
    per_row = ncols // side
    return grid.selectExpr(f"cast(((row - {shift}) div {side}) * {per_row} + (col - {shift}) div {side} as long) as roi", "pixel", "row", "col").where(f"row >= {shift} and col >= {shift}")


def supplier_regions(spark: SparkSession, sf_dir: str, n_pixels: int = 400) -> DataFrame:
    """Many-to-many regions: the parts of each supplier."""
    return with_coordinates(table(spark, sf_dir, "lineitem").selectExpr("cast(l_suppkey as long) as roi", f"cast(l_partkey % {n_pixels} as long) as pixel").distinct(), 20)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("cast(vec_id as long) as i", "transform(embedding, x -> cast(x as double)) as x", "cast(label as long) as label")
