"""Queries of the operators that work over relations of any size: lines and edges, large graphs, demixing, files, sweeps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.operators import demix, edges, filters, graph, neighbours, spectrum, stack
from fluxgrid.plans import pipeline, sweep
from fluxgrid.plans.grid_queries import FOUR, FRAMES, R6, REGION, _a, _apart, _b, _dense, _on_frames, _size
from fluxgrid.plans.registry import register
from fluxgrid.sources import formats, mat, png
from fluxgrid.sources import tables as src

# Lines and edges of the regions of the event grid
_lines = lambda f: edges.contour_lines(_b(f).withColumn("v", F.lit(1.0)))
_on_frames(
    "contour_points", lambda f: _lines(f).select("roi", "row", "col"),
    f"SELECT a.roi, a.row + di / 2 AS row, a.col + dj / 2 AS col FROM rb a, {FOUR} s(di, dj) LEFT JOIN rb b ON b.roi = a.roi AND b.row = a.row + di AND b.col = a.col + dj WHERE b.roi IS NULL",
    REGION,
)
register("contour_lines", lambda s, d: _lines(src.event_frames(s, d)))
register("canny_edges", lambda s, d: edges.canny(_b(src.event_frames(s, d))))
register("circle_fit", lambda s, d: edges.circle_fit(_b(src.event_frames(s, d))).select("roi", R6("votes"), "circularity"))
_on_frames(
    "blend", lambda f: filters.blend([filters.display_stretch(stack.project(f, k), k).select("pixel", "shown") for k in ("max", "mean")], 0.45).select("pixel", R6("shown")),
    """, im AS (SELECT pixel, max(v) AS a, avg(v) AS b FROM frames GROUP BY pixel),
e AS (SELECT quantile_cont(a, 0.02) AS a0, quantile_cont(a, 0.98) AS a1, quantile_cont(b, 0.02) AS b0, quantile_cont(b, 0.98) AS b1 FROM im)
SELECT pixel, round(0.45 * ((a - a0) * 255 / CASE WHEN a1 = a0 THEN 1 ELSE a1 - a0 END + (b - b0) * 255 / CASE WHEN b1 = b0 THEN 1 ELSE b1 - b0 END), 6) AS shown FROM im, e""",
)

# Graphs of all embeddings
def _near(v: DataFrame, k: int) -> DataFrame:
    """Exact neighbours as long as comparing all vectors sends less than a descent; most vectors have no close ones, and of those a descent
    finds the fewer the more vectors there are."""
    return graph.nearest(v, k) if v.count() <= pipeline.EXACT_PIXELS else neighbours.descend(v, k, connections=20, accuracy=30)


register("knn_approx", lambda s, d: _near(src.vectors(s, d), 10).select("i", "j", F.round("d", 5).alias("d"), F.col("rank").cast("long").alias("rank")))


def _spectrum(s: SparkSession, d: str) -> DataFrame:
    near = graph.cut_lineage(_near(src.vectors(s, d), 20))
    weights = graph.cut_lineage(graph.symmetric(graph.affinity(near, 11)).where("w > 0"))
    return spectrum.walk_vectors(weights, 6, 1e-6, block=1024).select("i", F.posexplode("x").alias("k", "x"), F.col("values")).selectExpr("i", "k", "x", "values[k + 1] as value")


register("large_spectrum", _spectrum)


# Demixing: blocks of the grid and blocks moved by one overlap everywhere
def _overlapping(f: DataFrame) -> DataFrame:
    return _apart(f).select("roi", "pixel", F.lit(1.0).alias("weight"))


def _positive(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = _dense(src.event_frames(s, d))
    return _overlapping(f), f.select("pixel", "frame", F.greatest("v", F.lit(0.0)).alias("v"))


register("demixed_traces", lambda s, d: demix.traces(*_positive(s, d), rounds=6).select("roi", "frame", R6("v")))
register("demixed_footprints", lambda s, d: demix.factors(*_positive(s, d), rounds=4)[0].select("roi", "pixel", R6("weight")))


# Files: written into a new folder at every call and read again
def _folder(s: SparkSession) -> str:
    return f"{graph.checkpoint_folder(s)}/files-{uuid.uuid4().hex}"


def _mat(s: SparkSession, d: str) -> DataFrame:
    f, folder = src.event_frames(s, d), _folder(s)
    n = _size(f)[0] * src.NCOLS
    _mkdir(s, folder)
    mat.write_regions(_a(f), f"{folder}/regions.mat", n)
    return formats.sparse_regions(mat.read_mat(s, folder, "A"), src.NCOLS)


def _mkdir(s: SparkSession, folder: str) -> None:
    at = s._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(s._jsc.hadoopConfiguration()).mkdirs(at)


def _png(s: SparkSession, d: str) -> DataFrame:
    """(key, row, col, r): the pixels of one image a frame, as they are in the files."""
    f, folder = _dense(src.event_frames(s, d)), _folder(s)
    nrows, _ = _size(f)
    top = f.agg(F.max("v").alias("top"))
    level = f.join(F.broadcast(top)).withColumn("level", F.floor(F.col("v") * 255 / F.greatest("top", F.lit(1e-9))).cast("int"))
    png.write_png(level.select(F.format_string("frame%04d", "frame").alias("key"), "row", "col", *(F.col("level").alias(c) for c in "rgb"), F.lit(255).alias("a")), folder, nrows, src.NCOLS)
    return png.read_png(s, folder).select("key", "row", "col", "r")


register("mat_regions", _mat)
register("png_frames", _png)


def _sweep(s: SparkSession, d: str) -> DataFrame:
    f = _dense(src.event_frames(s, d))
    nrows, nframes = _size(f)
    base = pipeline.Config.load('{"filter": {"localSpatialDenoising": false}, "eigen": {"num_eig": 8, "knn": 12, "normalize_w_k": 6}, "roi_extraction": {"roi_size_min": 2, "max_iter": 20, "num_rois": 8, "merge": false}, "box": {"total_num_spatial_boxes": 1}}')
    tasks = pipeline.task_list(base, {("roi_extraction", "roi_eccentricity_limit"): [0.9, 1.0]})
    return sweep.sweep(graph.cut_lineage(f), tasks, nrows, src.NCOLS, nframes, _folder(s), _a(f), 2.0)


register("sweep_runs", _sweep)
