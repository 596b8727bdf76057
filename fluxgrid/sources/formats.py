"""Stacks and regions in files: TIFF pages, region documents, parquet stacks."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.operators.filters import trial_key
from fluxgrid.operators.stack import join_trials
from fluxgrid.sources import tiff
from fluxgrid.sources.files import store


#: Frames of a written file.
FRAMES = 256


def read_pages(data: bytes) -> Iterator[np.ndarray]:
    """Pages of a TIFF in memory."""
    f = io.BytesIO(data)
    for _, page in list(tiff.places(f)):
        yield page.samples(f)


def write_pages(pages: np.ndarray) -> bytes:
    """A TIFF with a strip a page; pages is (frame, row, col) of uint8, uint16 or float32."""
    return tiff.write(pages)


def tiff_frames(spark: SparkSession, path: str, one_stack: bool = False, offset: float | None = None, tolerance: float = 4000.0, trials: list[str] | None = None, between: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """frames(trial, frame, row, col, pixel, v) of a TIFF or a folder of them, a range of pages being a task.

    Of the files only those named in trials are read, and of their frames those from between[0] to between[1], where given.
    A file is a trial; with one_stack the files of a folder, in order of their names, are one stack in time, without a trial. If an
    offset is given (2 ** 15, say) and the first frame's mean is within the tolerance of it, the offset is taken off, not below 0.
    """

    try:
        store(path)
    except ValueError:  # only Spark reads this store, and gives whole files
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        frames = files.select("path", "content").mapInPandas(_whole_files, tiff.SCHEMA)
    else:
        spark.dataSource.register(tiff.TiffSource)
        wanted = {"trials": json.dumps(trials) if trials is not None else None, "first": between[0], "last": between[1]}
        frames = spark.read.format("tiff_pages").options(**{k: v for k, v in wanted.items() if v is not None}).load(path)
    if trials is not None:
        frames = frames.where(F.col("trial").isin(trials))
    if between != (None, None):
        frames = frames.where(F.col("frame").between(between[0] or 0, between[1] if between[1] is not None else 1 << 62))
    if one_stack:
        frames = join_trials(frames)
    if offset is not None:
        keys = trial_key(frames)
        first = frames.where("frame = 0").groupBy(*keys).agg(F.avg("v").alias("m"))
        near = F.expr(f"case when abs(m - {offset}) <= {tolerance} then greatest(v - {offset}, 0) else v end")
        frames = (frames.join(F.broadcast(first), keys) if keys else frames.join(F.broadcast(first))).withColumn("v", near).drop("m")
    return frames


def _whole_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for name, data in zip(batch.path, batch.content):
            for k, page in enumerate(read_pages(bytes(data))):
                r, c = np.divmod(np.arange(page.size), page.shape[1])
                yield pd.DataFrame({"trial": name.rsplit("/", 1)[-1], "frame": k, "row": r, "col": c, "pixel": np.arange(page.size), "v": page.ravel().astype(float)})


def sparse_regions(cells: DataFrame, ncols: int) -> DataFrame:
    """Regions from the entries of a sparse pixel x region matrix, cells(row, col, v) numbered from 1; zeros are no entries."""
    own = cells.where("v <> 0").selectExpr("cast(col - 1 as long) as roi", "cast(row - 1 as long) as pixel").distinct()
    return own.selectExpr("roi", "pixel", f"pixel div {ncols} as row", f"pixel % {ncols} as col")


def region_document(regions: DataFrame, row0: int = 0, col0: int = 0) -> DataFrame:
    """One JSON line for each region, coordinates moved back by the crop's origin."""
    at = F.array((F.col("row") + row0).cast("long"), (F.col("col") + col0).cast("long"))
    return regions.groupBy("roi").agg(F.array_sort(F.collect_list(at)).alias("coordinates")).select(F.to_json(F.struct(F.col("roi").alias("id"), "coordinates")).alias("value"))


def read_regions(lines: DataFrame, ncols: int, row0: int = 0, col0: int = 0) -> DataFrame:
    """(roi, pixel, row, col) of region_document() lines; regions are numbered as in the document."""
    one = lines.select(F.from_json("value", "id long, coordinates array<array<long>>").alias("d")).select(F.col("d.id").alias("roi"), F.explode("d.coordinates").alias("c"))
    return one.selectExpr("roi", f"(c[0] - {row0}) * {ncols} + c[1] - {col0} as pixel", f"c[0] - {row0} as row", f"c[1] - {col0} as col")


def write_stack(frames: DataFrame, path: str) -> None:
    """A stack by trial, so that a read of some trials reads no others; FRAMES frames of a trial are a file, written by one task."""
    parts = frames.withColumn("__part", F.expr(f"frame div {FRAMES}")).repartition(int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")), "trial", "__part")
    parts.sortWithinPartitions("trial", "__part", "frame", "row", "col").drop("__part").write.partitionBy("trial").mode("overwrite").parquet(path)


def export_regions(regions: DataFrame, roi_class: DataFrame, row0: int = 0, col0: int = 0) -> DataFrame:
    """(class, roi, value): a JSON line for each region with its class, in order of class and number; those without a class come first."""
    at = F.array((F.col("row") + row0).cast("long"), (F.col("col") + col0).cast("long"))
    own = regions.groupBy("roi").agg(F.array_sort(F.collect_list(at)).alias("coordinates")).join(roi_class.select("roi", "class"), "roi", "left")
    line = F.to_json(F.struct(F.col("roi").alias("id"), "coordinates", "class"))
    return own.select("class", "roi", line.alias("value")).orderBy("class", "roi")


def listing(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder in order: of folders all, of files those with .tif in their name; of a file its own name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.getFileStatus(at).isFile():
        return [at.getName()]
    found = [(f.getPath().getName(), f.isDirectory()) for f in files.listStatus(at)]
    return sorted(name for name, folder in found if folder or ".tif" in name)
