"""Queries over stacks made from events and shipments, with the same results in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.operators import evaluate, extract, filters, graph, regions, stack, traces
from fluxgrid.plans import pipeline
from fluxgrid.plans.registry import register
from fluxgrid.sources import tables as src

#: The event stack in SQL; further named parts follow it.
FRAMES = """WITH frames AS (SELECT pixel, frame, v, pixel // 15 AS row, pixel % 15 AS col FROM (SELECT CAST(user_id AS BIGINT) AS pixel, date_diff('day', TIMESTAMP '2024-01-01', ts) AS frame, round(sum(value), 4) AS v FROM events GROUP BY ALL)),
size AS (SELECT max(row) + 1 AS nrows, max(frame) + 1 AS nframes FROM frames)"""
REGION = """,
ra AS (SELECT DISTINCT (row // 5) * 3 + col // 5 AS roi, pixel, row, col FROM frames),
rb AS (SELECT DISTINCT ((row - 1) // 5) * 3 + (col - 1) // 5 AS roi, pixel, row, col FROM frames WHERE row >= 1 AND col >= 1)"""
DENSE = """,
dense AS (SELECT p.pixel, p.row, p.col, g.frame, coalesce(f.v, 0.0) AS v FROM (SELECT r.row * 15 + c.col AS pixel, r.row, c.col FROM (SELECT unnest(generate_series(0, (SELECT nrows - 1 FROM size))) AS row) r, (SELECT unnest(generate_series(0, 14)) AS col) c) p, (SELECT unnest(generate_series(0, (SELECT nframes - 1 FROM size))) AS frame) g LEFT JOIN frames f ON f.pixel = p.pixel AND f.frame = g.frame)"""
TRACE = """,
tr AS (SELECT roi, frame, avg(v) AS v FROM ra JOIN frames USING (pixel) GROUP BY ALL)"""
EIGHT = "(SELECT di, dj FROM (VALUES (-1),(0),(1)) a(di), (VALUES (-1),(0),(1)) b(dj) WHERE di <> 0 OR dj <> 0)"
FOUR = "(VALUES (-1,0),(1,0),(0,-1),(0,1))"


def _size(frames: DataFrame) -> tuple[int, int]:
    r = frames.agg(F.max("row") + 1, F.max("frame") + 1).first()
    return int(r[0] or 1), int(r[1] or 1)


def _dense(frames: DataFrame) -> DataFrame:
    nrows, nframes = _size(frames)
    grid = frames.sparkSession.range(nrows * src.NCOLS).withColumnRenamed("id", "pixel").withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nframes - 1).cast("long"))))
    return src.with_coordinates(grid.join(frames.select("pixel", "frame", "v"), ["pixel", "frame"], "left").withColumn("v", F.coalesce("v", F.lit(0.0))))


def _on_frames(name: str, build: Callable[[DataFrame], DataFrame], sql: str, *parts: str) -> None:
    register(name, lambda spark, d: build(src.event_frames(spark, d)), FRAMES + "".join(parts) + "\n" + sql)


def _a(f: DataFrame) -> DataFrame:
    return src.block_regions(f)


def _b(f: DataFrame) -> DataFrame:
    return src.block_regions(f, 1)


def _trace(f: DataFrame) -> DataFrame:
    return traces.mean_trace(_a(f), f)


R6 = lambda c, name=None: F.round(c, 6).alias(name or c)

# Scans, projections, slices
_on_frames("scan_stack", lambda f: f.select("pixel", "row", "col", "frame", "v"), "SELECT pixel, row, col, frame, v FROM frames")
_on_frames("max_image", lambda f: stack.project(f, "max"), "SELECT pixel, max(v) AS max FROM frames GROUP BY pixel")
_on_frames("mean_image", lambda f: stack.project(f, "mean").select("pixel", R6("mean")), "SELECT pixel, round(avg(v), 6) AS mean FROM frames GROUP BY pixel")
_on_frames("median_image", lambda f: stack.project(f, "median").select("pixel", R6("median")), "SELECT pixel, round(quantile_cont(v, 0.5), 6) AS median FROM frames GROUP BY pixel")
register(
    "mean_of_means", lambda s, d: stack.project_trials(src.event_frames(s, d, True)).select("pixel", R6("mean_of_means"), "max_of_maxes"),
    "WITH f AS (SELECT event_type AS trial, CAST(user_id AS BIGINT) AS pixel, date_diff('day', TIMESTAMP '2024-01-01', ts) AS frame, round(sum(value), 4) AS v FROM events GROUP BY ALL), p AS (SELECT trial, pixel, avg(v) AS m, max(v) AS x FROM f GROUP BY ALL) SELECT pixel, round(avg(m), 6) AS mean_of_means, max(x) AS max_of_maxes FROM p GROUP BY pixel",
)
_on_frames("slice_stride", lambda f: stack.slice_frames(f, 1, 3).select("pixel", "frame", "v"), "SELECT pixel, (frame - 1) // 3 AS frame, v FROM frames WHERE frame >= 1 AND (frame - 1) % 3 = 0")
_on_frames("crop", lambda f: stack.crop(f, (1, 8), (2, 12)).select("pixel", "frame", "v"), "SELECT pixel, frame, v FROM frames WHERE row >= 1 AND row < 8 AND col >= 2 AND col < 12")
_on_frames("slice_crop", lambda f: stack.crop(stack.slice_frames(f, 0, 2), (0, 5), (0, 10)).select("pixel", "frame", "v"), "SELECT pixel, frame // 2 AS frame, v FROM frames WHERE frame % 2 = 0 AND row < 5 AND col < 10")
_on_frames("auto_crop", lambda f: stack.auto_crop(f.withColumn("v", F.expr("case when row = 0 then 0.0 else v end")), "row"), "SELECT min(row) AS first, max(row) AS last FROM (SELECT row, bool_or(flat) AS border FROM (SELECT frame, row, bool_and(w <= (SELECT min(w) FROM z)) AS flat FROM z GROUP BY ALL) GROUP BY row) WHERE NOT border", ",\nz AS (SELECT row, frame, CASE WHEN row = 0 THEN 0.0 ELSE v END AS w FROM frames)")
_on_frames("trial_split", lambda f: stack.split_trials(f, 7).select("block", "pixel", "frame", "v"), "SELECT frame // 7 AS block, pixel, frame % 7 AS frame, v FROM frames")
_on_frames("time_boxes", lambda f: stack.time_boxes(f, 4).select("box", "pixel", "frame", "v"), "SELECT frame // (nframes // 4) AS box, pixel, frame, v FROM frames, size WHERE frame // (nframes // 4) < 4")
_on_frames("pixel_vectors", lambda f: stack.pixel_vectors(f).select("pixel", F.size("vec").cast("long").alias("n"), F.round(F.aggregate(F.transform("vec", lambda v, k: v * (k + 1)), F.lit(0.0), lambda s, v: s + v), 3).alias("checksum")), "SELECT pixel, count(*) AS n, round(sum(v * k), 3) AS checksum FROM (SELECT pixel, v, row_number() OVER (PARTITION BY pixel ORDER BY frame) AS k FROM frames) GROUP BY pixel")
_on_frames("pixel_coords", lambda f: f.select("pixel", "row", "col").distinct(), "SELECT DISTINCT pixel, row, col FROM frames")

#: Four tiles with an overlap of 2, whatever the number of rows.
_BOXES = """,
boxes AS (SELECT i * 2 + j AS box, greatest(0, i * (nrows // 2) - 2) AS r0, CASE WHEN i = 1 THEN nrows ELSE least(nrows, nrows // 2 + 2) END AS r1, greatest(0, j * 7 - 2) AS c0, CASE WHEN j = 1 THEN 15 ELSE 9 END AS c1 FROM size, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)),
grid AS (SELECT DISTINCT pixel, row, col FROM frames)"""


def _tiled(f: DataFrame, closed: bool = False) -> DataFrame:
    return stack.tile(f.select("pixel", "row", "col").distinct(), stack.tiles(_size(f)[0], 15, 2, 2), closed)


_on_frames("spatial_boxes", lambda f: _tiled(f).select("box", "pixel"), "SELECT CAST(box AS BIGINT) AS box, pixel FROM grid JOIN boxes ON row >= r0 AND row < r1 AND col >= c0 AND col < c1", _BOXES)
_on_frames("box_remap", lambda f: stack.image_pixel(stack.box_pixel(_tiled(f)), 15).select("box", "pixel", "box_pixel", "image_pixel"), "SELECT CAST(box AS BIGINT) AS box, pixel, (row - r0) * (c1 - c0) + col - c0 AS box_pixel, pixel AS image_pixel FROM grid JOIN boxes ON row >= r0 AND row < r1 AND col >= c0 AND col < c1", _BOXES)
_on_frames("point_in_box", lambda f: _tiled(f, True).groupBy("pixel").agg(F.count("*").alias("n_boxes")), "SELECT pixel, count(*) AS n_boxes FROM grid JOIN boxes ON row >= r0 AND row <= r1 AND col >= c0 AND col <= c1 GROUP BY pixel", _BOXES)
_on_frames("mosaic", lambda f: stack.mosaic(_tiled(f), _size(f)[0], 15, 2).select("box", "pixel"), "SELECT CAST(CASE WHEN nrows < 2 THEN 1 ELSE least(row // (nrows // 2), 1) END * 2 + least(col // 7, 1) AS BIGINT) AS box, pixel FROM grid, size", _BOXES)
_MASK = ",\nmask AS (SELECT DISTINCT pixel FROM frames WHERE (row + col) % 3 <> 0)"


def _mask(f: DataFrame) -> DataFrame:
    return f.where("(row + col) % 3 <> 0").select("pixel").distinct()


_on_frames("mask_semi", lambda f: stack.masked(f, _mask(f)).select("pixel", "frame", "v"), "SELECT pixel, frame, v FROM frames SEMI JOIN mask USING (pixel)", _MASK)
_on_frames("mask_expand", lambda f: stack.unmasked(stack.project(stack.masked(f, _mask(f)), "max").withColumnRenamed("max", "v"), f.select("pixel").distinct()), "SELECT g.pixel, coalesce(m.v, 0.0) AS v FROM (SELECT DISTINCT pixel FROM frames) g LEFT JOIN (SELECT pixel, max(v) AS v FROM frames SEMI JOIN mask USING (pixel) GROUP BY pixel) m USING (pixel)", _MASK)
_on_frames("mask_index", lambda f: stack.mask_index(_mask(f)), "SELECT pixel, row_number() OVER (ORDER BY pixel) - 1 AS idx FROM mask", _MASK)
_on_frames("nan_impute", lambda f: stack.impute(f.withColumn("v", F.expr("case when (pixel + frame) % 4 = 0 then null else v end"))).select("pixel", "frame", R6("v")), "SELECT pixel, frame, round(coalesce(w, avg(w) OVER (PARTITION BY pixel)), 6) AS v FROM (SELECT pixel, frame, CASE WHEN (pixel + frame) % 4 = 0 THEN NULL ELSE v END AS w FROM frames)")
_on_frames("floor_clamp", lambda f: stack.floor_clamp(f, 5.0).select("pixel", "frame", "v"), "SELECT pixel, frame, CASE WHEN v < 5.0 THEN (SELECT min(v) FROM frames WHERE v > 5.0) ELSE v END AS v FROM frames")
_on_frames("region_shift", lambda f: stack.shift_regions(_a(f), 2, -1), "SELECT roi, row + 2 AS row, col - 1 AS col FROM ra", REGION)
_on_frames("region_clamp", lambda f: stack.shift_regions(_a(f), 3, 3, _size(f)[0], 15), "SELECT roi, greatest(0, least(row + 3, nrows - 1)) AS row, greatest(0, least(col + 3, 14)) AS col FROM ra, size", REGION)
_on_frames("region_explode", lambda f: _a(f).groupBy("roi").agg(F.to_json(F.array_sort(F.collect_list(F.struct("row", "col")))).alias("json")).select("roi", F.explode(F.from_json("json", "array<struct<row:long,col:long>>")).alias("c")).selectExpr("roi", "c.row * 15 + c.col as pixel"), "SELECT roi, pixel FROM ra", REGION)
_on_frames("size_filter", lambda f: _b(f).groupBy("roi").agg(F.count("*").alias("n")).where("n < 20"), "SELECT roi, count(*) AS n FROM rb GROUP BY roi HAVING count(*) < 20", REGION)

# Filters
_on_frames("offset_fix", lambda f: filters.remove_offset(f, 10.0, 1000.0).select("pixel", "frame", R6("v")), "SELECT pixel, frame, round(CASE WHEN abs((SELECT avg(v) FROM frames WHERE frame = 0) - 10.0) <= 1000.0 THEN greatest(v - 10.0, 0) ELSE v END, 6) AS v FROM frames")
_on_frames("zscore", lambda f: filters.zscore(f).select("pixel", "frame", R6("z")), "SELECT pixel, frame, round((v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-6), 6) AS z FROM frames WINDOW w AS (PARTITION BY pixel)")
_on_frames("median3d", lambda f: filters.median3d(_dense(f), *(_size(f)[0], 15, _size(f)[1])).select("pixel", "frame", "med"), "SELECT a.pixel, a.frame, quantile_disc(b.v, 0.5) AS med FROM dense a, size, (VALUES (-1),(0),(1)) x(df), (VALUES (-1),(0),(1)) y(dr), (VALUES (-1),(0),(1)) z(dc) JOIN dense b ON b.frame = greatest(0, least(a.frame + df, nframes - 1)) AND b.row = greatest(0, least(a.row + dr, nrows - 1)) AND b.col = greatest(0, least(a.col + dc, 14)) GROUP BY a.pixel, a.frame", DENSE)
_on_frames("local_denoise", lambda f: filters.local_denoise(f).select("pixel", "frame", F.round("smooth", 5).alias("smooth")), f"""SELECT pixel, frame, round(sum(p * v), 5) AS smooth FROM (SELECT pixel, q, u / (sum(u) OVER (PARTITION BY pixel) + 1e-9) AS p FROM (SELECT d.pixel, d.q, d.dot / sqrt(a.e * b.e) AS u FROM dots d JOIN energy a ON a.pixel = d.pixel JOIN energy b ON b.pixel = d.q UNION ALL SELECT pixel, pixel, 1.0 FROM energy)) w JOIN (SELECT pixel AS q, frame, v FROM frames) f USING (q) GROUP BY pixel, frame""", f""",
energy AS (SELECT pixel, sum(v * v) + 1e-7 AS e FROM frames GROUP BY pixel),
dots AS (SELECT a.pixel, b.pixel AS q, sum(a.v * b.v) AS dot FROM frames a, {EIGHT} s JOIN frames b ON b.row = a.row + s.di AND b.col = a.col + s.dj AND b.frame = a.frame GROUP BY ALL)""")
_on_frames("temporal_corr", lambda f: filters.temporal_correlation(f).select("pixel", F.round("corr", 2).alias("corr")), f"SELECT pixel, round(avg(c), 2) AS corr FROM (SELECT a.pixel, a.frame, sum(a.v * coalesce(b.v, 0.0) / 4) AS c FROM frames a CROSS JOIN {FOUR} s(di, dj) LEFT JOIN frames b ON b.row = a.row + s.di AND b.col = a.col + s.dj AND b.frame = a.frame GROUP BY ALL) GROUP BY pixel")
_on_frames("contrast", lambda f: filters.contrast(stack.project(f, "mean"), "mean").select("pixel", F.round("scaled", 5).alias("scaled")), "SELECT pixel, round(greatest(0, least(255, (x - a) / (b - a) * 255)), 5) AS scaled FROM (SELECT pixel, greatest(avg(v), 0.0) AS x FROM frames GROUP BY pixel) i, (SELECT quantile_cont(x, 0.01) AS a, quantile_cont(x, 0.97) AS b FROM (SELECT greatest(avg(v), 0.0) AS x FROM frames GROUP BY pixel))")
_on_frames("moving_median", lambda f: f.withColumn("med", F.expr("percentile(v, 0.5) over (partition by pixel order by frame rows between 1 preceding and 1 following)")).select("pixel", "frame", R6("med")), "SELECT pixel, frame, round(quantile_cont(v, 0.5) OVER (PARTITION BY pixel ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS med FROM frames")


def _gauss_sql(sigma: float) -> str:
    return f",\nk AS (SELECT k, exp(-0.5 * (k / {sigma}) ** 2) / (SELECT sum(exp(-0.5 * (j / {sigma}) ** 2)) FROM (SELECT unnest(generate_series(-{int(4 * sigma + 0.5)}, {int(4 * sigma + 0.5)})) AS j)) AS t FROM (SELECT unnest(generate_series(-{int(4 * sigma + 0.5)}, {int(4 * sigma + 0.5)})) AS k))"


_REFL = lambda x, n: f"(CASE WHEN (({x}) % (2*({n})) + 2*({n})) % (2*({n})) < ({n}) THEN (({x}) % (2*({n})) + 2*({n})) % (2*({n})) ELSE 2*({n}) - 1 - (({x}) % (2*({n})) + 2*({n})) % (2*({n})) END)"
_SMOOTH = lambda c, out: f",\n{out}_1 AS (SELECT a.row, a.col, sum(t * b.{c}) AS g FROM base a, k, size JOIN base b ON b.col = a.col AND b.row = {_REFL('a.row + k.k', 'nrows')} GROUP BY a.row, a.col), {out} AS (SELECT a.row, a.col, sum(t * b.g) AS {c} FROM {out}_1 a, k JOIN {out}_1 b ON b.row = a.row AND b.col = {_REFL('a.col + k.k', '15')} GROUP BY a.row, a.col)"
_on_frames("gaussian_image", lambda f: filters.gaussian(stack.project(_dense(f), "mean", ("row", "col")), "mean", 2.0, _size(f)[0], 15).select("row", "col", F.round("mean", 5).alias("mean")), "SELECT row, col, round(mean, 5) AS mean FROM s", DENSE, ",\nbase AS (SELECT row, col, avg(v) AS mean FROM dense GROUP BY ALL)", _gauss_sql(2.0), _SMOOTH("mean", "s"))
_on_frames(
    "hist_eq", lambda f: filters.equalise(_dense(f), 2.0, _size(f)[0], 15).select("pixel", "frame", F.round("eq", 5).alias("eq")),
    "SELECT pixel, frame, round(x + l + r - greatest(x, l, r) - least(x, l, r), 5) AS eq FROM (SELECT pixel, frame, x, coalesce(lag(x) OVER w, x) AS l, coalesce(lead(x) OVER w, x) AS r FROM (SELECT pixel, frame, pow(greatest(0, least(1, coalesce((v - p5) / (p95 - p5 + 1e-8), 0))), 2) AS x FROM dense JOIN s5 USING (row, col) JOIN s95 USING (row, col)) WINDOW w AS (PARTITION BY pixel ORDER BY frame))",
    DENSE, ",\nbase AS (SELECT row, col, quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.95) AS p95 FROM dense GROUP BY ALL)", _gauss_sql(2.0), _SMOOTH("p5", "s5"), _SMOOTH("p95", "s95"),
)

# Graphs over the embeddings
_VEC = "WITH e AS (SELECT CAST(vec_id AS BIGINT) AS i, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
_KNN = lambda d, k: f", nn AS (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM (SELECT a.i, b.i AS j, {d} AS d FROM e a, e b) QUALIFY rank <= {k})"
_L2 = "pow(list_distance(a.x, b.x), 2)"
for _name, _metric, _d in (("knn_l2", "l2", _L2), ("knn_ip", "ip", "1 - list_inner_product(a.x, b.x)"), ("knn_cosine", "cosine", "1 - list_cosine_similarity(a.x, b.x)")):
    register(_name, lambda s, d, m=_metric: graph.nearest(src.vectors(s, d), 5, m).select("i", "j", F.round("d", 5).alias("d"), F.col("rank").cast("long").alias("rank")), _VEC + _KNN(_d, 5) + " SELECT i, j, round(d, 5) + 0.0 AS d, rank FROM nn")
_AFF = ", sc AS (SELECT i, d + 1e-9 AS s FROM nn WHERE rank = 8), k AS (SELECT nn.i, nn.j, CASE WHEN nn.i = nn.j THEN 0.0 ELSE exp(-d / sqrt(a.s * b.s)) END AS w FROM nn JOIN sc a ON a.i = nn.i JOIN sc b ON b.i = nn.j), ks AS (SELECT i, j, sum(w) / 2 AS w FROM (SELECT i, j, w FROM k UNION ALL SELECT j, i, w FROM k) GROUP BY ALL), dg AS (SELECT i, sum(w) AS degree FROM ks GROUP BY i)"


def _affinity(s: SparkSession, d: str) -> DataFrame:
    return graph.affinity(graph.cut_lineage(graph.nearest(src.vectors(s, d), 10)), 8)


def _weights(s: SparkSession, d: str) -> DataFrame:
    """The symmetric weights, made once for those that read them several times."""
    return graph.cut_lineage(graph.symmetric(_affinity(s, d)))


register("affinity", lambda s, d: _affinity(s, d).select("i", "j", R6("w")), _VEC + _KNN(_L2, 10) + _AFF + " SELECT i, j, round(w, 6) AS w FROM k")
register("affinity_sym", lambda s, d: graph.symmetric(_affinity(s, d)).select("i", "j", R6("w")), _VEC + _KNN(_L2, 10) + _AFF + " SELECT i, j, round(w, 6) AS w FROM ks")
register("degree", lambda s, d: graph.degree(_weights(s, d)).select("i", *(R6(c) for c in ("degree", "inverse", "root", "inverse_root"))), _VEC + _KNN(_L2, 10) + _AFF + " SELECT i, round(degree, 6) AS degree, round(1 / (degree + 1e-9), 6) AS inverse, round(sqrt(degree), 6) AS root, round(1 / sqrt(degree + 1e-9), 6) AS inverse_root FROM dg")
register("random_walk", lambda s, d: graph.random_walk(_weights(s, d)).select("i", "j", R6("p")), _VEC + _KNN(_L2, 10) + _AFF + " SELECT i, j, round(w / (degree + 1e-9), 6) AS p FROM ks JOIN dg USING (i)")
register("laplacian", lambda s, d: graph.laplacian(_weights(s, d)).select("i", "j", R6("l")), _VEC + _KNN(_L2, 10) + _AFF + " SELECT i, j, round(sum(l), 6) AS l FROM (SELECT i, j, -w / (degree + 1e-9) AS l FROM ks JOIN dg USING (i) UNION ALL SELECT DISTINCT i, i, 1.0 FROM ks) GROUP BY i, j")
register("eigen_spectrum", lambda s, d: graph.squared_norm(graph.eigenvectors(_weights(s, d), 12)))
register("embed_norm", lambda s, d: graph.squared_norm(src.vectors(s, d)).select("i", F.round("norm2", 5).alias("norm2")), _VEC + " SELECT i, round(list_inner_product(x, x), 5) AS norm2 FROM e")
register("seed_rank", lambda s, d: regions.seeds(graph.squared_norm(src.vectors(s, d)).withColumn("norm2", F.round("norm2", 5))).select("i", "seed"), _VEC + " SELECT i, row_number() OVER (ORDER BY n DESC, i) AS seed FROM (SELECT i, round(list_inner_product(x, x), 5) AS n FROM e)")
register("select_eigs", lambda s, d: regions.select_vectors(src.vectors(s, d).select(F.col("label").alias("roi"), "x"), 0.9).select("roi", F.col("k").cast("long").alias("k"), F.round("score", 4).alias("score")), _VEC + ", t AS (SELECT label AS roi, k - 1 AS k, pow(sum(v), 2) AS score FROM (SELECT label, unnest(x) AS v, generate_subscripts(x, 1) AS k FROM e) GROUP BY ALL) SELECT roi, k, round(score, 4) AS score FROM t QUALIFY score > (1 - 0.9) * max(score) OVER (PARTITION BY roi)")
register("pixel_distance", lambda s, d: regions.seed_distance(src.vectors(s, d), 0).select("i", F.round("d", 5).alias("d")), _VEC + " SELECT a.i, round(pow(list_distance(a.x, b.x), 2), 5) AS d FROM e a, e b WHERE b.i = 0")
register("grow", lambda s, d: regions.seed_distance(src.vectors(s, d), 0).where("d <= norm2").select("i"), _VEC + " SELECT a.i FROM e a, e b WHERE b.i = 0 AND pow(list_distance(a.x, b.x), 2) <= list_inner_product(a.x, a.x)")
_on_frames("elbow", lambda f: regions.elbow(stack.project(f, "mean").select(F.round("mean", 6).alias("mean")), "mean"), "SELECT v AS elbow FROM (SELECT v, abs((n - 1) * (v - v0) - k * (v1 - v0)) / sqrt((n - 1) * (n - 1) + (v1 - v0) * (v1 - v0)) AS d FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k, count(*) OVER () AS n, min(v) OVER () AS v0, max(v) OVER () AS v1 FROM (SELECT round(avg(v), 6) AS v FROM frames GROUP BY pixel))) ORDER BY d DESC, v LIMIT 1")
register("pca_elbow", lambda s, d: graph.principal_values(stack.pixel_vectors(_dense(src.event_frames(s, d)))))

# Regions
_on_frames("local_maxima", lambda f: regions.local_maxima(f.groupBy("pixel", "row", "col").agg(F.max("v").alias("m")), "m"), f"SELECT a.pixel, a.m FROM i a, {EIGHT} s JOIN i b ON b.row = a.row + s.di AND b.col = a.col + s.dj GROUP BY a.pixel, a.m HAVING a.m >= max(b.m)", ",\ni AS (SELECT pixel, row, col, max(v) AS m FROM frames GROUP BY ALL)")
_OV = ",\nov AS (SELECT a.roi AS a, b.roi AS b, count(*) AS shared FROM ra a JOIN rb b USING (pixel) GROUP BY ALL), sa AS (SELECT roi, count(*) AS n FROM ra GROUP BY roi), sb AS (SELECT roi, count(*) AS n FROM rb GROUP BY roi)"
_on_frames("roi_overlap", lambda f: regions.overlaps(_a(f), _b(f)), "SELECT a, b, shared, sa.n AS size_a, sb.n AS size_b FROM ov JOIN sa ON sa.roi = a JOIN sb ON sb.roi = b", REGION, _OV)
_on_frames("footprint_overlap", lambda f: regions.overlaps(_a(f), _b(f)).select("a", "b", R6(F.expr("shared / sqrt(size_a * size_b)"), "cosine")), "SELECT a, b, round(shared / sqrt(sa.n * sb.n), 6) AS cosine FROM ov JOIN sa ON sa.roi = a JOIN sb ON sb.roi = b", REGION, _OV)
_on_frames("auto_label", lambda f: regions.overlaps(_a(f), _b(f)).select("a", "b", R6(F.expr("shared / size_a"), "share_a"), R6(F.expr("shared / size_b"), "share_b")), "SELECT a, b, round(shared / sa.n, 6) AS share_a, round(shared / sb.n, 6) AS share_b FROM ov JOIN sa ON sa.roi = a JOIN sb ON sb.roi = b", REGION, _OV)
_BOTH = ",\nrr AS (SELECT roi, pixel, row, col FROM ra UNION ALL SELECT roi + 1000, pixel, row, col FROM rb), tt AS (SELECT roi, frame, avg(v) AS v FROM rr JOIN frames USING (pixel) GROUP BY ALL)"


def _both(f: DataFrame) -> DataFrame:
    return _a(f).unionByName(_b(f).withColumn("roi", F.col("roi") + 1000))


def _apart(f: DataFrame) -> DataFrame:
    """_both() with numbers that no two regions share: up to 1000 blocks those of _both(), whose numbers meet beyond that as in its SQL."""
    last = _a(f).agg(F.max("roi")).first()[0] or 0
    return _a(f).unionByName(_b(f).withColumn("roi", F.col("roi") + max(1000, 10 ** len(str(last)))))


def _merge_pairs(f: DataFrame) -> DataFrame:
    return regions.merge_pairs(_both(f), traces.mean_trace(_both(f), f), 0.1, 0.5)


_on_frames("merge_pairs", lambda f: _merge_pairs(f).select("a", "b", "shared", F.round("corr", 5).alias("corr")), "SELECT o.a, o.b, shared, round(corr(x.v, y.v), 5) AS corr FROM (SELECT p.roi AS a, q.roi AS b, count(*) AS shared FROM rr p JOIN rr q ON p.pixel = q.pixel AND p.roi < q.roi GROUP BY ALL) o JOIN (SELECT roi, count(*) AS n FROM rr GROUP BY roi) na ON na.roi = a JOIN (SELECT roi, count(*) AS n FROM rr GROUP BY roi) nb ON nb.roi = b JOIN tt x ON x.roi = a JOIN tt y ON y.roi = b AND y.frame = x.frame WHERE shared > 0.1 * na.n AND shared > 0.1 * nb.n GROUP BY o.a, o.b, shared HAVING corr(x.v, y.v) >= 0.5", REGION, _BOTH)
_on_frames("roi_frames", lambda f: _a(f).select("roi", "pixel").join(f.select("pixel", "frame", "v"), "pixel"), "SELECT pixel, roi, frame, v FROM ra JOIN frames USING (pixel)", REGION)
_on_frames("roi_semi", lambda f: f.join(_a(f).where("roi % 2 = 0"), "pixel", "left_semi").select("pixel", "frame", "v"), "SELECT pixel, frame, v FROM frames SEMI JOIN (SELECT pixel FROM ra WHERE roi % 2 = 0) USING (pixel)", REGION)
_on_frames("roi_anti", lambda f: f.join(_a(f).where("roi % 2 = 0"), "pixel", "left_anti").select("pixel", "frame", "v"), "SELECT pixel, frame, v FROM frames ANTI JOIN (SELECT pixel FROM ra WHERE roi % 2 = 0) USING (pixel)", REGION)
_on_frames("rect_select", lambda f: _a(f).where("row between 2 and 6 and col between 3 and 11").select("roi").distinct(), "SELECT DISTINCT roi FROM ra WHERE row BETWEEN 2 AND 6 AND col BETWEEN 3 AND 11", REGION)
_on_frames("roi_bbox", lambda f: regions.shape(_b(f)).select("roi", "r0", "r1", "c0", "c1"), "SELECT roi, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM rb GROUP BY roi", REGION)
_ECC = ",\nm AS (SELECT roi, count(*) AS area, (max(row) - min(row)) * (max(col) - min(col)) AS bb, var_pop(row) AS a, var_pop(col) AS c, covar_pop(row, col) AS b FROM rb GROUP BY roi), q AS (SELECT *, sqrt(4 * b * b + (a - c) * (a - c)) / 2 AS q FROM m)"
_on_frames("roi_shape", lambda f: regions.shape(_b(f)).select("roi", "area", R6("extent")), "SELECT roi, area, round(CASE WHEN bb = 0 THEN NULL ELSE area / bb END, 6) AS extent FROM q", REGION, _ECC)
_on_frames("eccentricity", lambda f: regions.shape(_b(f)).select("roi", R6("eccentricity")), "SELECT roi, round(CASE WHEN (a + c) / 2 + q = 0 THEN 0.0 ELSE sqrt(greatest(0, 1 - ((a + c) / 2 - q) / ((a + c) / 2 + q))) END, 6) AS eccentricity FROM q", REGION, _ECC)
_on_frames("roi_accept", lambda f: regions.accept(regions.shape(_b(f)), 15, 30, 0.9).select("roi", "area"), "SELECT roi, area FROM q WHERE area > 15 AND area < 30 AND (CASE WHEN (a + c) / 2 + q = 0 THEN 0.0 ELSE sqrt(greatest(0, 1 - ((a + c) / 2 - q) / ((a + c) / 2 + q))) END) <= 0.9", REGION, _ECC)
_on_frames("overlap_resolve", lambda f: regions.resolve(_both(f), regions.shape(_both(f))).select("roi", "pixel"), "SELECT roi, pixel FROM (SELECT rr.roi, pixel, row_number() OVER (PARTITION BY pixel ORDER BY round(pow(row - cr, 2) + pow(col - cc, 2), 9), rr.roi) AS k FROM rr JOIN (SELECT roi, avg(row) AS cr, avg(col) AS cc FROM rr GROUP BY roi) USING (roi)) WHERE k = 1", REGION, _BOTH)
_on_frames("pixel_owners", lambda f: _both(f).groupBy("pixel").agg(F.count("*").alias("n")), "SELECT pixel, count(*) AS n FROM rr GROUP BY pixel", REGION, _BOTH)
_on_frames("overlay", lambda f: _both(f).groupBy("pixel").agg(F.countDistinct(F.expr("roi >= 1000")).alias("sources"), F.min("roi").alias("lowest")), "SELECT pixel, count(DISTINCT roi >= 1000) AS sources, min(roi) AS lowest FROM rr GROUP BY pixel", REGION, _BOTH)
_on_frames("roi_union", lambda f: _a(f).select("roi", "pixel").union(_b(f).select("roi", "pixel")).distinct(), "SELECT roi, pixel FROM ra UNION SELECT roi, pixel FROM rb", REGION)
_on_frames("roi_intersect", lambda f: _a(f).select("roi", "pixel").intersect(_b(f).select("roi", "pixel")), "SELECT roi, pixel FROM ra INTERSECT SELECT roi, pixel FROM rb", REGION)
_on_frames("roi_except", lambda f: _a(f).select("roi", "pixel").exceptAll(_b(f).select("roi", "pixel")), "SELECT roi, pixel FROM ra EXCEPT SELECT roi, pixel FROM rb", REGION)
_DIL = f",\nod AS (SELECT * FROM ra WHERE roi % 2 = 1), st AS (SELECT * FROM {FOUR} s(di, dj) UNION ALL SELECT 0, 0), d1 AS (SELECT DISTINCT roi, row + di AS row, col + dj AS col FROM od, st, size WHERE row + di BETWEEN 0 AND nrows - 1 AND col + dj BETWEEN 0 AND 14)"
_step = lambda a, b: f", {b} AS (SELECT DISTINCT roi, row + di AS row, col + dj AS col FROM {a}, st, size WHERE row + di BETWEEN 0 AND nrows - 1 AND col + dj BETWEEN 0 AND 14)"


def _odd(f: DataFrame) -> DataFrame:
    return _a(f).where("roi % 2 = 1")


_on_frames("dilate", lambda f: regions.dilate(_odd(f), _size(f)[0], 15).select("roi", "pixel"), "SELECT roi, row * 15 + col AS pixel FROM d1", REGION, _DIL)
_RING = _step("d1", "d2") + _step("d2", "d3") + _step("d3", "d4") + ", ng AS (SELECT roi, row * 15 + col AS pixel FROM d4 WHERE row * 15 + col NOT IN (SELECT row * 15 + col FROM d2))"
_on_frames("neuropil_ring", lambda f: regions.ring(_odd(f), _size(f)[0], 15, 2).select("roi", "pixel"), "SELECT roi, pixel FROM ng", REGION, _DIL, _RING)
_on_frames("outline", lambda f: regions.outline(_a(f)).select("roi", "pixel"), f"SELECT a.roi, a.pixel FROM ra a, {FOUR} s(di, dj) LEFT JOIN ra b ON b.roi = a.roi AND b.row = a.row + di AND b.col = a.col + dj GROUP BY ALL HAVING count(b.roi) < 4", REGION)
_on_frames("brush", lambda f: regions.brush(f.where("pixel % 37 = 0").select("row", "col").distinct(), 1, _size(f)[0], 15).select("pixel"), "SELECT DISTINCT (row + dr) * 15 + col + dc AS pixel FROM frames, size, (VALUES (-1),(0),(1)) a(dr), (VALUES (-1),(0),(1)) b(dc) WHERE pixel % 37 = 0 AND row + dr BETWEEN 0 AND nrows - 1 AND col + dc BETWEEN 0 AND 14")
_on_frames("roi_patch", lambda f: _b(f).join(regions.shape(_b(f)).select("roi", "r0", "c0"), "roi").selectExpr("roi", "pixel", "row - r0 as r", "col - c0 as c"), "SELECT roi, pixel, row - min(row) OVER (PARTITION BY roi) AS r, col - min(col) OVER (PARTITION BY roi) AS c FROM rb", REGION)
register("component", lambda s, d: (lambda f: regions.connected(f.where("v > 30").select("pixel", "row", "col").distinct()))(src.event_frames(s, d)), FRAMES.replace("WITH ", "WITH RECURSIVE ", 1) + f", ps AS (SELECT DISTINCT pixel, row, col FROM frames WHERE v > 30), ed AS (SELECT a.pixel AS a, b.pixel AS b FROM ps a, {EIGHT} s JOIN ps b ON b.row = a.row + s.di AND b.col = a.col + s.dj), reach(root, pixel) AS (SELECT pixel, pixel FROM ps UNION SELECT root, b FROM reach JOIN ed ON a = pixel) SELECT pixel, min(root) AS component FROM reach GROUP BY pixel")
_on_frames("roi_weights", lambda f: _a(f).join(stack.project(f, "max"), "pixel").selectExpr("roi", "pixel", "round((max - min(max) over (partition by roi)) / (max(max) over (partition by roi) - min(max) over (partition by roi)), 6) as w"), "SELECT roi, pixel, round((m - min(m) OVER w) / nullif(max(m) OVER w - min(m) OVER w, 0), 6) AS w FROM ra JOIN (SELECT pixel, max(v) AS m FROM frames GROUP BY pixel) USING (pixel) WINDOW w AS (PARTITION BY roi)", REGION)

# Traces
_on_frames("mean_trace", lambda f: _trace(f).select("roi", "frame", R6("v")), "SELECT roi, frame, round(v, 6) AS v FROM tr", REGION, TRACE)
_on_frames("neuropil_trace", lambda f: traces.mean_trace(regions.ring(_odd(f), _size(f)[0], 15, 2), f).select("roi", "frame", R6("v")), "SELECT roi, frame, round(avg(v), 6) AS v FROM ng JOIN frames USING (pixel) GROUP BY ALL", REGION, _DIL, _RING)
_on_frames("mean_corrected", lambda f: traces.corrected(_trace(f), traces.mean_trace(regions.ring(_odd(f), _size(f)[0], 15, 2), f)).select("roi", "frame", R6("v")), "SELECT roi, frame, round(tr.v - s.v, 6) AS v FROM tr JOIN (SELECT roi, frame, avg(v) AS v FROM ng JOIN frames USING (pixel) GROUP BY ALL) s USING (roi, frame)", REGION, TRACE, _DIL, _RING)
_DFF = lambda t, k: f",\np AS (SELECT {k}, quantile_cont(v, 0.1) AS p FROM {t} GROUP BY {k}), bs AS (SELECT {k}, avg(CASE WHEN v < p THEN v END) AS b FROM {t} JOIN p USING ({k}) GROUP BY {k})"
_on_frames("dff", lambda f: traces.relative_change(f, "pixel").select("pixel", "frame", R6("dff")), "SELECT pixel, frame, round(CASE WHEN b = 0 THEN v ELSE (v - b) / b END, 6) AS dff FROM frames JOIN bs USING (pixel)", _DFF("frames", "pixel"))
_COR = ",\nco AS (SELECT roi, frame, tr.v - s.v AS v FROM tr JOIN (SELECT roi, frame, avg(v) AS v FROM ng JOIN frames USING (pixel) GROUP BY ALL) s USING (roi, frame))"
_on_frames("dff_corrected", lambda f: traces.relative_change(traces.corrected(_trace(f), traces.mean_trace(regions.ring(_odd(f), _size(f)[0], 15, 2), f))).select("roi", "frame", F.round("dff", 5).alias("dff")), "SELECT roi, frame, round(CASE WHEN b = 0 THEN v ELSE (v - b) / b END, 5) AS dff FROM co JOIN bs USING (roi)", REGION, TRACE, _DIL, _RING, _COR, _DFF("co", "roi"))
_on_frames("trace_corr", lambda f: traces.correlation(_trace(f)).select("a", "b", R6("corr")), "SELECT x.roi AS a, y.roi AS b, round(corr(x.v, y.v), 6) AS corr FROM tr x JOIN tr y ON x.frame = y.frame AND x.roi < y.roi GROUP BY ALL", REGION, TRACE)
_on_frames("trace_stats", lambda f: traces.statistics(_trace(f)).select("roi", R6("std"), R6("mean"), R6("max")), "SELECT roi, round(stddev_pop(v), 6) AS std, round(avg(v), 6) AS mean, round(max(v), 6) AS max FROM tr GROUP BY roi", REGION, TRACE)
_on_frames("trace_norm", lambda f: traces.standardise(_trace(f)).select("roi", "frame", R6("y")), "SELECT roi, frame, round((v - avg(v) OVER w) / (5.0 * stddev_pop(v) OVER w) + roi, 6) AS y FROM tr WINDOW w AS (PARTITION BY roi)", REGION, TRACE)
_NOISE = ",\nordered AS (SELECT roi, frame, round(v, 9) AS v, row_number() OVER (PARTITION BY roi ORDER BY frame) - 1 AS k, count(*) OVER (PARTITION BY roi) AS n FROM tr), ws AS (SELECT roi, s * 5 AS start, stddev_pop(v) AS std, avg(v) AS mean FROM ordered, unnest(generate_series(0, 1000)) g(s) WHERE k >= s * 5 AND k < s * 5 + 10 AND s * 5 + 10 <= n GROUP BY ALL), ns AS (SELECT roi, start, std, mean FROM (SELECT *, row_number() OVER (PARTITION BY roi ORDER BY std, start) - 1 AS r, count(*) OVER (PARTITION BY roi) AS m FROM ws) WHERE r = CAST(round_even((m - 1) * 0.25, 0) AS INT))"


def _rounded(f: DataFrame) -> DataFrame:
    return _trace(f).withColumn("v", F.round("v", 9))


_on_frames("noise_stats", lambda f: traces.noise(_rounded(f), 10, 5).select("roi", F.col("start").cast("long").alias("start"), R6("std"), R6("mean")), "SELECT roi, start, round(std, 6) AS std, round(mean, 6) AS mean FROM ns", REGION, TRACE, _NOISE)
_on_frames("psnr", lambda f: traces.peak_to_noise(_rounded(f), traces.noise(_rounded(f), 10, 5)).select("roi", R6("psnr")), "SELECT roi, round(max(ordered.v) / std, 6) AS psnr FROM ordered JOIN ns USING (roi) GROUP BY roi, std", REGION, TRACE, _NOISE)
_on_frames("active_runs", lambda f: traces.active_runs(_rounded(f), traces.noise(_rounded(f), 10, 5), 1.0, 2), "SELECT roi, min(frame) AS first, max(frame) AS last, count(*) AS n FROM (SELECT roi, frame, k - row_number() OVER (PARTITION BY roi ORDER BY frame) AS g FROM ordered JOIN ns USING (roi) WHERE v > mean + 1.0 * std) GROUP BY roi, g HAVING count(*) >= 2", REGION, TRACE, _NOISE)
_on_frames("activity", lambda f: traces.activity(_rounded(f), 3, 0.3, 2, 4), "SELECT DISTINCT roi, u.frame FROM (SELECT *, row_number() OVER (PARTITION BY roi ORDER BY v DESC, frame) AS r FROM (SELECT roi, frame, v, lag(v) OVER w AS l, lead(v) OVER w AS rr, min(v) OVER e AS lo, max(v) OVER e AS hi, min(frame) OVER e AS f0, max(frame) OVER e AS f1 FROM ordered WINDOW w AS (PARTITION BY roi ORDER BY frame), e AS (PARTITION BY roi)) WHERE v > l AND v >= rr AND v >= lo + 0.3 * (hi - lo)) t, unnest(generate_series(greatest(f0, t.frame - 2), least(f1, t.frame + 3))) u(frame) WHERE r <= 3", REGION, TRACE, _NOISE)
_on_frames("trace_concat", lambda f: traces.concatenate(_trace(f).selectExpr("roi", "frame div 10 as trial", "frame % 10 as frame", "v")).select("roi", "trial", "frame", "at"), "SELECT roi, frame // 10 AS trial, frame % 10 AS frame, row_number() OVER (PARTITION BY roi ORDER BY frame) - 1 AS at FROM tr", REGION, TRACE)

# Evaluation
_CEN = ",\nca AS (SELECT roi, avg(row) AS cr, avg(col) AS cc FROM ra GROUP BY roi), cb AS (SELECT roi, avg(row) AS cr, avg(col) AS cc FROM rb GROUP BY roi), mt AS (SELECT a, b, d FROM (SELECT ca.roi AS a, cb.roi AS b, sqrt(pow(ca.cr - cb.cr, 2) + pow(ca.cc - cb.cc, 2)) AS d FROM ca, cb) WHERE d < 2.0 QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(d, 9), b) = 1)"


def _match(f: DataFrame) -> DataFrame:
    return evaluate.match(regions.shape(_a(f)), regions.shape(_b(f)), 2.0)


_on_frames("match_centers", lambda f: _match(f).select("a", "b", R6("d")), "SELECT a, b, round(d, 6) AS d FROM mt", REGION, _CEN)
_SC = "SELECT (SELECT count(*) FROM mt) / (SELECT count(*) FROM ca) AS r, (SELECT count(*) FROM mt) / (SELECT count(*) FROM cb) AS p"
_on_frames("eval_centers", lambda f: evaluate.centre_scores(regions.shape(_a(f)), regions.shape(_b(f)), 2.0).select(R6("recall"), R6("precision")), f"SELECT round(r, 6) AS recall, round(p, 6) AS precision FROM ({_SC})", REGION, _CEN)
_on_frames("eval_f1", lambda f: evaluate.centre_scores(regions.shape(_a(f)), regions.shape(_b(f)), 2.0).select("f1"), f"SELECT CASE WHEN r + p = 0 THEN 0.0 ELSE round(2 * r * p / (r + p), 4) END AS f1 FROM ({_SC})", REGION, _CEN)
_on_frames("eval_shapes", lambda f: evaluate.shape_scores(_match(f), _a(f), _b(f)).select(R6("inclusion"), R6("exclusion")), "SELECT round(avg(coalesce(shared, 0) / sa.n), 6) AS inclusion, round(avg(coalesce(shared, 0) / sb.n), 6) AS exclusion FROM mt LEFT JOIN ov USING (a, b) JOIN sa ON sa.roi = mt.a JOIN sb ON sb.roi = mt.b", REGION, _CEN, _OV)
register(
    "param_grid", lambda s, d: evaluate.grid_by(
        src.event_frames(s, d, True).groupBy("trial").agg(F.expr("percentile(v, array(0.5, 0.9))").alias("levels")), {"median": [False, True], "size": [3, 5, 7], "level": [0, 1]}
    ).select("trial", "config", "median", "size", R6(F.get("levels", "level"), "threshold")),
    """WITH tf AS (SELECT event_type AS trial, round(sum(value), 4) AS v FROM events GROUP BY event_type, user_id, date_diff('day', TIMESTAMP '2024-01-01', ts)),
p AS (SELECT trial, quantile_cont(v, 0.5) AS low, quantile_cont(v, 0.9) AS high FROM tf GROUP BY trial)
SELECT trial, CAST(m * 6 + s * 2 + k AS BIGINT) AS config, m = 1 AS median, 3 + 2 * s AS size, round(CASE k WHEN 0 THEN low ELSE high END, 6) AS threshold
FROM p, (VALUES (0),(1)) a(m), (VALUES (0),(1),(2)) b(s), (VALUES (0),(1)) c(k)""",
)
register("frames_months", lambda s, d: stack.project(src.part_frames(s, d), "mean").select("pixel", R6("mean")), "SELECT pixel, round(avg(v), 6) AS mean FROM (SELECT CAST(l_partkey % 400 AS BIGINT) AS pixel, (year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1 AS frame, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY ALL) GROUP BY pixel")

# Kernels that SQL can't express
register("poisson_noise", lambda s, d: extract.poisson_noise(src.event_frames(s, d), 0.5, 2))


def _embedding_regions(s: SparkSession, d: str) -> DataFrame:
    f = _dense(src.event_frames(s, d))
    nrows, nframes = _size(f)
    return pipeline.find_regions(f, pipeline.Config.load('{"eigen": {"num_eig": 8, "knn": 12, "normalize_w_k": 6}, "roi_extraction": {"roi_size_min": 2, "max_iter": 20, "num_rois": 8, "roi_eccentricity_limit": 1.0}, "box": {"total_num_spatial_boxes": 1}}'), nrows, src.NCOLS, nframes)


register("lssc_rois", _embedding_regions)
register("denoised_traces", lambda s, d: (lambda f: extract.denoised_traces(_apart(f), f))(graph.cut_lineage(src.event_frames(s, d))))
_on_frames("unassigned", lambda f: regions.assign_unassigned(_odd(f), _size(f)[0], 15).select("roi", "pixel"), "SELECT roi, pixel FROM (SELECT f.roi, f.row * 15 + f.col AS pixel, row_number() OVER (PARTITION BY f.row, f.col ORDER BY round(pow(f.row - c.cr, 2) + pow(f.col - c.cc, 2), 9), f.roi) AS k FROM d1 f JOIN (SELECT roi, avg(row) AS cr, avg(col) AS cc FROM od GROUP BY roi) c USING (roi) WHERE f.row * 15 + f.col NOT IN (SELECT pixel FROM od)) WHERE k = 1", REGION, _DIL)
_on_frames("overlap_traces", lambda f: traces.overlap_traces(_a(f).where("roi = 0"), _b(f).where("roi = 0"), f).select("part", "frame", R6("v")), "SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'a only' ELSE 'b only' END AS part, frame, round(avg(v), 6) AS v FROM (SELECT pixel, bool_or(s = 0) AS a, bool_or(s = 1) AS b FROM (SELECT pixel, 0 AS s FROM ra WHERE roi = 0 UNION ALL SELECT pixel, 1 FROM rb WHERE roi = 0) GROUP BY pixel) JOIN frames USING (pixel) GROUP BY ALL", REGION)
_on_frames("embed_image", lambda f: traces.embedding_image(f.withColumn("block", F.expr("frame div 10")).groupBy("pixel", "block").agg(F.collect_list("v").alias("x"))).select("pixel", F.round("norm", 5).alias("norm"), F.round("scaled", 5).alias("scaled")), "SELECT pixel, round(norm, 5) AS norm, round(greatest(0, least(1, (norm - a) / nullif(b - a, 0))), 5) AS scaled FROM nm, (SELECT quantile_cont(norm, 0.05) AS a, quantile_cont(norm, 0.95) AS b FROM nm)", ",\nnm AS (SELECT pixel, max(n) AS norm FROM (SELECT pixel, frame // 10 AS block, sqrt(sum(v * v)) AS n FROM frames GROUP BY ALL) GROUP BY pixel)")
_on_frames("percentile_ladder", lambda f: traces.percentile_ladder(_trace(f), [0.1, 0.5, 0.9]).select("roi", F.col("share").cast("double").alias("share"), R6("v")), "SELECT roi, CAST(share AS DOUBLE) AS share, round(v, 6) AS v FROM (SELECT roi, 0.1 AS share, quantile_cont(v, 0.1) AS v FROM tr GROUP BY roi UNION ALL SELECT roi, 0.5, quantile_cont(v, 0.5) FROM tr GROUP BY roi UNION ALL SELECT roi, 0.9, quantile_cont(v, 0.9) FROM tr GROUP BY roi)", REGION, TRACE)
register("footprint_corr", lambda s, d: (lambda f: (lambda r: regions.footprint_correlation(r, f, traces.activity(traces.mean_trace(r, f), 3, 0.3, 2, 4)))(_apart(f)))(graph.cut_lineage(src.event_frames(s, d))))
