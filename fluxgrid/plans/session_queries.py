"""Queries of sessions, classes, displays, trials and sweeps over the event grid, with the same results in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.operators import evaluate, filters, graph, regions, stack, traces
from fluxgrid.plans import grid_queries as grid
from fluxgrid.plans import pipeline
from fluxgrid.plans.grid_queries import _BOTH, _DIL, _REFL, _RING, _VEC, DENSE, EIGHT, FOUR, FRAMES, R6, REGION, TRACE, _a, _b, _both, _dense, _odd, _on_frames, _size, _trace
from fluxgrid.plans.registry import register
from fluxgrid.sources import formats, session
from fluxgrid.sources import tables as src

_IMAGE = ",\nim AS (SELECT pixel, row, col, avg(v) AS mean FROM frames GROUP BY ALL)"
_TRIALS = """WITH tf AS (SELECT event_type AS trial, CAST(user_id AS BIGINT) AS pixel, date_diff('day', TIMESTAMP '2024-01-01', ts) AS frame, round(sum(value), 4) AS v
FROM events GROUP BY ALL)"""
_RECURSIVE = FRAMES.replace("WITH ", "WITH RECURSIVE ", 1)


def _image(f: DataFrame) -> DataFrame:
    return stack.project(f, "mean", ("pixel", "row", "col"))


# Images for display and export
_on_frames(
    "display_stretch", lambda f: filters.display_stretch(_image(f), "mean", 5.0).select("pixel", F.round("shown", 4).alias("shown")),
    """SELECT pixel, round(5.0 / 7 * (mean - a) * 255 / (CASE WHEN a = b THEN 1 ELSE b - a END), 4) AS shown
FROM im, (SELECT quantile_cont(mean, 0.02) AS a, quantile_cont(mean, 0.98) AS b FROM im)""", _IMAGE,
)
_on_frames(
    "saved_image", lambda f: filters.saved_image(_image(f).withColumn("mean", F.col("mean") - 10), "mean").select("pixel", F.round("level", 3).alias("level")),
    """SELECT pixel, round(greatest(0, least(1, CASE WHEN (m - a) / (b - a) > 0.25 THEN (y - c) / (d - c) ELSE (greatest(y, 0) - a) / (b - a) END)) * 255, 3) AS level
FROM (SELECT pixel, mean - 10 AS y FROM im), (SELECT quantile_cont(greatest(mean - 10, 0), 0.01) AS a, quantile_cont(greatest(mean - 10, 0), 0.99) AS b,
quantile_cont(greatest(mean - 10, 0), 0.3) AS m, quantile_cont(mean - 10, 0.1) AS c, quantile_cont(mean - 10, 0.99) AS d FROM im)""", _IMAGE,
)
_on_frames(
    "even_slices", lambda f: stack.even_frames(f, 4, _size(f)[1]).select("pixel", "frame", "v"),
    "SELECT pixel, frame, v FROM frames, size WHERE frame % greatest(1, nframes // 4) = 0 AND frame // greatest(1, nframes // 4) < 4",
)
_on_frames(
    "smooth_by_spread", lambda f: filters.smooth_by_spread(_image(_dense(f)).withColumn("mean", F.col("mean") / 5), "mean", _size(f)[0], 15).select("row", "col", F.round("mean", 5).alias("mean")),
    f"""SELECT a.row, a.col, round(sum(t * b.g), 5) AS mean FROM g1 a, k, size JOIN g1 b ON b.row = a.row AND b.col = {_REFL("a.col + k.k", "15")} GROUP BY a.row, a.col""",
    DENSE, """,
base AS (SELECT row, col, avg(v) / 5 AS g FROM dense GROUP BY ALL), sg AS (SELECT stddev_pop(g) AS s FROM base),
kk AS (SELECT unnest(generate_series(-CAST(floor(4 * s + 0.5) AS BIGINT), CAST(floor(4 * s + 0.5) AS BIGINT))) AS k FROM sg),
k AS (SELECT k, exp(-0.5 * pow(k / s, 2)) / sum(exp(-0.5 * pow(k / s, 2))) OVER () AS t FROM kk, sg)""",
    f""",
g1 AS (SELECT a.row, a.col, sum(t * b.g) AS g FROM base a, k, size JOIN base b ON b.col = a.col AND b.row = {_REFL("a.row + k.k", "nrows")} GROUP BY a.row, a.col)""",
)
_on_frames(
    "footprint_impute", lambda f: _a(f).join(_image(f).select("pixel", F.expr("case when pixel % 7 = 0 then null else mean end").alias("m")), "pixel")
    .select("roi", "pixel", R6(F.expr("coalesce(m, avg(m) over (partition by roi))"), "m")),
    "SELECT roi, pixel, round(coalesce(m, avg(m) OVER (PARTITION BY roi)), 6) AS m FROM ra JOIN (SELECT pixel, CASE WHEN pixel % 7 <> 0 THEN mean END AS m FROM im) USING (pixel)",
    REGION, _IMAGE,
)
_on_frames(
    "median_projection", lambda f: filters.median3d(_dense(f), _size(f)[0], 15, _size(f)[1]).groupBy("pixel").agg(F.max("med").alias("max"), F.round(F.avg("med"), 6).alias("mean")),
    """SELECT pixel, max(med) AS max, round(avg(med), 6) AS mean FROM (SELECT a.pixel, a.frame, quantile_disc(b.v, 0.5) AS med
FROM dense a, size, (VALUES (-1),(0),(1)) x(df), (VALUES (-1),(0),(1)) y(dr), (VALUES (-1),(0),(1)) z(dc)
JOIN dense b ON b.frame = greatest(0, least(a.frame + df, nframes - 1)) AND b.row = greatest(0, least(a.row + dr, nrows - 1)) AND b.col = greatest(0, least(a.col + dc, 14))
GROUP BY a.pixel, a.frame) GROUP BY pixel""", DENSE,
)


def _crop_median(f: DataFrame) -> DataFrame:
    config = pipeline.Config().with_("dataset", "crop_stack", True).with_("dataset", "crop_x", [0, 6]).with_("dataset", "crop_y", [2, 11])
    config = config.with_("filter", "localSpatialDenoising", False).with_("filter", "median_filter", True)
    nrows, nframes = _size(f)
    return pipeline.preprocess(_dense(f), config, nrows, 15, nframes)[0].select("pixel", "row", "col", "frame", "v")


_on_frames(
    "crop_median", _crop_median,
    """SELECT a.row * 9 + a.col AS pixel, a.row, a.col, a.frame, quantile_disc(b.v, 0.5) AS v
FROM inner_ a, size, (VALUES (-1),(0),(1)) x(df), (VALUES (-1),(0),(1)) y(dr), (VALUES (-1),(0),(1)) z(dc)
JOIN inner_ b ON b.frame = greatest(0, least(a.frame + df, nframes - 1)) AND b.row = greatest(0, least(a.row + dr, least(6, nrows) - 1)) AND b.col = greatest(0, least(a.col + dc, 8))
GROUP BY a.row, a.col, a.frame""", DENSE,
    ",\ninner_ AS (SELECT row, col - 2 AS col, frame, v FROM dense WHERE row < 6 AND col >= 2 AND col < 11)",
)

# Trials
register(
    "trial_zscore", lambda s, d: filters.zscore(src.event_frames(s, d, True)).select("trial", "pixel", "frame", F.round("z", 5).alias("z")),
    _TRIALS + " SELECT trial, pixel, frame, round((v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-6), 5) AS z FROM tf WINDOW w AS (PARTITION BY trial, pixel)",
)
register(
    "trials_in_time", lambda s, d: stack.join_trials(src.event_frames(s, d, True)).select("pixel", "frame", "v"),
    _TRIALS + """, n AS (SELECT trial, max(frame) + 1 AS n FROM tf GROUP BY trial), st AS (SELECT trial, coalesce(sum(n) OVER (ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM n)
SELECT pixel, CAST(frame + start AS BIGINT) AS frame, v FROM tf JOIN st USING (trial)""",
)
register(
    "trial_dff", lambda s, d: traces.relative_change(src.event_frames(s, d, True), ["trial", "pixel"], 0.5).select("trial", "pixel", "frame", F.round("dff", 5).alias("dff")),
    _TRIALS + """, p AS (SELECT trial, pixel, quantile_cont(v, 0.5) AS p FROM tf GROUP BY ALL), b AS (SELECT trial, pixel, avg(CASE WHEN v < p THEN v END) AS b FROM tf JOIN p USING (trial, pixel) GROUP BY ALL)
SELECT trial, pixel, frame, round(CASE WHEN b = 0 THEN v ELSE (v - b) / b END, 5) AS dff FROM tf JOIN b USING (trial, pixel)""",
)


def _trial_traces(s: SparkSession, d: str) -> DataFrame:
    f = src.event_frames(s, d, True)
    return f.groupBy((F.col("pixel") % 5).alias("roi"), "trial", "frame").agg(F.avg("v").alias("v"))


_TT = ", tt AS (SELECT pixel % 5 AS roi, trial, frame, avg(v) AS v FROM tf GROUP BY ALL)"
register(
    "pad_traces", lambda s, d: traces.pad_to_median(_trial_traces(s, d)).select("roi", "trial", "frame", R6("v")),
    _TRIALS + _TT + """, m AS (SELECT CAST(floor(quantile_cont(n, 0.5)) AS BIGINT) AS n FROM (SELECT max(frame) + 1 AS n FROM tt GROUP BY trial))
SELECT s.roi, s.trial, s.frame, round(coalesce(tt.v, 0.0), 6) AS v FROM (SELECT roi, trial, unnest(generate_series(0, n - 1)) AS frame FROM (SELECT DISTINCT roi, trial FROM tt), m) s
LEFT JOIN tt ON tt.roi = s.roi AND tt.trial = s.trial AND tt.frame = s.frame""",
)
register(
    "trace_lookup", lambda s, d: traces.lookup(_trial_traces(s, d).withColumn("kind", F.lit("mean")), 3, "mean", ["click", "purchase"]).select("at", "trial", "frame", R6("v")),
    _TRIALS + _TT + " SELECT row_number() OVER (ORDER BY trial, frame) - 1 AS at, trial, frame, round(v, 6) AS v FROM tt WHERE roi = 3 AND trial IN ('click', 'purchase')",
)

# Traces of all kinds
_KINDS = """,
kd(kind, v, frame, roi) AS (SELECT 'mean', v, frame, roi FROM tr UNION ALL SELECT 'surround', avg(v), frame, roi FROM ng JOIN frames USING (pixel) GROUP BY roi, frame),
cd AS (SELECT 'mean corrected' AS kind, tr.v - s.v AS v, frame, roi FROM tr JOIN (SELECT v, frame, roi FROM kd WHERE kind = 'surround') s USING (roi, frame)),
al AS (SELECT * FROM kd UNION ALL SELECT * FROM cd),
pp AS (SELECT kind, roi, quantile_cont(v, 0.1) AS p FROM al WHERE kind <> 'surround' GROUP BY ALL),
bb AS (SELECT kind, roi, avg(CASE WHEN v < p THEN v END) AS b FROM al JOIN pp USING (kind, roi) GROUP BY ALL),
rl AS (SELECT replace(kind, 'mean', 'relative') AS kind, CASE WHEN b = 0 THEN v ELSE (v - b) / b END AS v, frame, roi FROM al JOIN bb USING (kind, roi)),
nine AS (SELECT * FROM al UNION ALL SELECT * FROM rl UNION ALL SELECT replace(replace(kind, 'mean', 'mean denoised'), 'relative', 'relative denoised'), v, frame, roi
FROM (SELECT * FROM al UNION ALL SELECT * FROM rl) WHERE kind <> 'surround')"""


def _kinds(f: DataFrame) -> DataFrame:
    return traces.all_kinds(_a(f), regions.ring(_odd(f), _size(f)[0], 15, 2), f)


_on_frames("traces_all", lambda f: _kinds(f).select("kind", "roi", "frame", R6("v")), "SELECT kind, roi, frame, round(v, 6) AS v FROM nine", REGION, TRACE, _DIL, _RING, _KINDS)
_on_frames(
    "scale_by_first", lambda f: traces.scale_by_first(_kinds(f), "mean").select("kind", "roi", "frame", F.round("y", 4).alias("y")),
    "SELECT kind, roi, frame, round(v / s, 4) AS y FROM nine JOIN (SELECT roi, 6 * stddev_pop(v) AS s FROM nine WHERE kind = 'mean' GROUP BY roi) USING (roi)",
    REGION, TRACE, _DIL, _RING, _KINDS,
)
_on_frames(
    "stale_traces", lambda f: traces.stale(traces.pixel_version(_a(f)), pipeline.subtract_pixels(_a(f), 2, _a(f).where("row = 0 and col = 10"))),
    "SELECT DISTINCT roi FROM ra WHERE roi = 2", REGION,
)

# Surrounds of a wanted size
_on_frames(
    "sized_ring", lambda f: regions.sized_ring(_odd(f).where("roi in (1, 3)"), _size(f)[0], 15, 20).select("roi", "pixel"),
    """SELECT roi, pixel FROM av JOIN (SELECT roi, min(d) AS width FROM (SELECT DISTINCT av.roi, av.d, size FROM av JOIN sz USING (roi)
WHERE (SELECT count(*) FROM av x WHERE x.roi = av.roi AND x.d <= av.d) >= 20 + size) GROUP BY roi) USING (roi) WHERE d <= width
UNION ALL SELECT roi, pixel FROM av WHERE roi NOT IN (SELECT av.roi FROM av JOIN sz USING (roi) GROUP BY av.roi, size HAVING count(*) >= 20 + size)""",
    REGION, """,
oo AS (SELECT * FROM ra WHERE roi IN (1, 3)), sz AS (SELECT roi, count(*) AS size FROM oo GROUP BY roi),
cells AS (SELECT r.row, c.col FROM (SELECT unnest(generate_series(0, (SELECT nrows - 1 FROM size))) AS row) r, (SELECT unnest(generate_series(0, 14)) AS col) c),
av AS (SELECT o.roi, g.row * 15 + g.col AS pixel, min(abs(g.row - o.row) + abs(g.col - o.col)) AS d FROM cells g, oo o
WHERE NOT EXISTS (SELECT 1 FROM oo x WHERE x.row = g.row AND x.col = g.col) GROUP BY ALL HAVING min(abs(g.row - o.row) + abs(g.col - o.col)) > 2)""",
)

# Regions: holes, merges, measures, pictures
_CARVED = ",\nrc AS (SELECT roi, row, col FROM ra WHERE NOT (row % 5 IN (1, 2) AND col % 5 = 2) AND NOT (roi % 2 = 0 AND row % 5 < 3 AND col % 5 = 3))"


def _carved(f: DataFrame) -> DataFrame:
    return _a(f).where("not (row % 5 in (1, 2) and col % 5 = 2) and not (roi % 2 = 0 and row % 5 < 3 and col % 5 = 3)")


register(
    "fill_holes", lambda s, d: regions.fill_holes(_carved(src.event_frames(s, d))),
    _RECURSIVE + REGION + _CARVED + f""",
bx AS (SELECT roi, min(row) - 1 AS a, max(row) + 1 AS b, min(col) - 1 AS c, max(col) + 1 AS d FROM rc GROUP BY roi),
gr AS (SELECT roi, row, unnest(generate_series(c, d)) AS col, a, b, c, d FROM (SELECT *, unnest(generate_series(a, b)) AS row FROM bx)),
fr AS (SELECT gr.* FROM gr ANTI JOIN rc ON rc.roi = gr.roi AND rc.row = gr.row AND rc.col = gr.col),
outside(roi, row, col) AS (SELECT roi, row, col FROM fr WHERE row IN (a, b) OR col IN (c, d)
UNION SELECT fr.roi, fr.row, fr.col FROM outside o, {FOUR} s(di, dj), fr WHERE fr.roi = o.roi AND fr.row = o.row + di AND fr.col = o.col + dj)
SELECT roi, row, col FROM gr ANTI JOIN outside o ON o.roi = gr.roi AND o.row = gr.row AND o.col = gr.col""",
)
_PAIRS = """,
pr AS (SELECT o.a, o.b FROM (SELECT p.roi AS a, q.roi AS b, count(*) AS shared FROM rr p JOIN rr q ON p.pixel = q.pixel AND p.roi < q.roi GROUP BY ALL) o
JOIN (SELECT roi, count(*) AS n FROM rr GROUP BY roi) na ON na.roi = a JOIN (SELECT roi, count(*) AS n FROM rr GROUP BY roi) nb ON nb.roi = b
JOIN tt x ON x.roi = a JOIN tt y ON y.roi = b AND y.frame = x.frame WHERE shared > {share} * na.n AND shared > {share} * nb.n GROUP BY o.a, o.b HAVING corr(x.v, y.v) >= {least})"""
_CLOSE = """,
cc(v, w) AS (SELECT DISTINCT roi, roi FROM rr UNION SELECT cc.v, e.b FROM cc JOIN (SELECT a, b FROM pr UNION ALL SELECT b, a FROM pr) e ON e.a = cc.w)
SELECT DISTINCT m.c AS roi, pixel, row, col FROM rr JOIN (SELECT v, min(w) AS c FROM cc GROUP BY v) m ON m.v = rr.roi"""
register(
    "merge_rois", lambda s, d: (lambda f: regions.merge(_both(f), grid._merge_pairs(f)))(src.event_frames(s, d)),
    _RECURSIVE + REGION + _BOTH + _PAIRS.format(share=0.1, least=0.5) + _CLOSE,
)
register(
    "merge_any", lambda s, d: (lambda f: regions.merge(_both(f), regions.merge_pairs(_both(f), traces.mean_trace(_both(f), f), None, 0.2)))(src.event_frames(s, d)),
    _RECURSIVE + REGION + _BOTH + _PAIRS.format(share=0, least=0.2) + _CLOSE,
)
_on_frames(
    "circularity", lambda f: regions.circularity(_b(f)).select("roi", R6("area"), "perimeter", R6("circularity")),
    f"""SELECT roi, round(area, 6) AS area, perimeter, round(100 * s / max(s) OVER (), 6) AS circularity FROM (SELECT *, 4 * pi() * area / (perimeter * perimeter) AS s
FROM (SELECT a.roi, count(*) / 4 AS area, count(*) FILTER (b.roi IS NULL) AS perimeter FROM rb a, {FOUR} s(di, dj) LEFT JOIN rb b ON b.roi = a.roi AND b.row = a.row + di AND b.col = a.col + dj GROUP BY a.roi))""",
    REGION,
)
_COMPONENT = """,
px AS (SELECT DISTINCT pixel, row, col FROM frames WHERE v > 30),
rs(v, w) AS (SELECT pixel, pixel FROM px UNION SELECT rs.v, b.pixel FROM rs JOIN px a ON a.pixel = rs.w, {eight} s JOIN px b ON b.row = a.row + s.di AND b.col = a.col + s.dj)
SELECT count(DISTINCT c) + 1 AS n FROM (SELECT v, min(w) AS c FROM rs GROUP BY v)"""
register(
    "component_count", lambda s, d: regions.component_count(src.event_frames(s, d).where("v > 30").select("pixel", "row", "col").distinct()),
    _RECURSIVE + _COMPONENT.format(eight=EIGHT),
)
_on_frames("at_pixel", lambda f: regions.at_pixel(_both(f), 3, 7), "SELECT CAST(row_number() OVER (ORDER BY roi) AS INTEGER) AS turn, roi FROM rr WHERE row = 3 AND col = 7", REGION, _BOTH)
_on_frames(
    "blob", lambda f: regions.blob(_both(f), [(218, 67, 34), (10, 200, 30), (0, 0, 255)]),
    """SELECT pixel, CASE k % 3 WHEN 0 THEN 218 WHEN 1 THEN 10 ELSE 0 END AS red, CASE k % 3 WHEN 0 THEN 67 WHEN 1 THEN 200 ELSE 0 END AS green, CASE k % 3 WHEN 0 THEN 34 WHEN 1 THEN 30 ELSE 255 END AS blue, 255 AS alpha
FROM (SELECT pixel, max(k) AS k FROM rr JOIN (SELECT roi, row_number() OVER (ORDER BY roi) - 1 AS k FROM (SELECT DISTINCT roi FROM rr)) USING (roi) GROUP BY pixel)""", REGION, _BOTH,
)
_on_frames(
    "zoom", lambda f: regions.zoom(_a(f), _size(f)[0], 15, 2),
    "SELECT roi, greatest(0, min(row) - 2) AS r0, least(max(nrows), max(row) + 3) AS r1, greatest(0, min(col) - 2) AS c0, least(15, max(col) + 3) AS c1 FROM ra, size GROUP BY roi", REGION,
)
_on_frames(
    "contour", lambda f: regions.contour(_carved(f)),
    f"""SELECT a.roi, greatest(a.row, a.row + di) AS r0, greatest(a.col, a.col + dj) AS c0, greatest(a.row, a.row + di) + CASE WHEN di <> 0 THEN 0 ELSE 1 END AS r1,
greatest(a.col, a.col + dj) + CASE WHEN di <> 0 THEN 1 ELSE 0 END AS c1 FROM rc a, {FOUR} s(di, dj) LEFT JOIN rc b ON b.roi = a.roi AND b.row = a.row + di AND b.col = a.col + dj WHERE b.roi IS NULL""",
    REGION, _CARVED,
)

# Spectra of saved vectors: the embeddings in two blocks, labels as boxes and regions
_spectra = lambda s, d: src.vectors(s, d)


def _two_blocks(s: SparkSession, d: str) -> DataFrame:
    v = src.vectors(s, d)
    return graph.stack_blocks(
        v.selectExpr("i as pixel", "1 as step", "slice(x, 33, 32) as x").unionByName(v.selectExpr("i as pixel", "0 as step", "slice(x, 1, 32) as x")), "step"
    )


_WEIGHED = "round(list_sum(list_transform(x, lambda v, k: v * k)), 4)"
register(
    "stack_blocks", lambda s, d: _two_blocks(s, d).select("pixel", F.round(F.aggregate(F.transform("x", lambda v, k: v * (k + 1)), F.lit(0.0), lambda a, b: a + b), 4).alias("w")),
    _VEC + f" SELECT i AS pixel, {_WEIGHED} AS w FROM e",
)
register("one_vector", lambda s, d: graph.one_vector(_spectra(s, d).select("i", "x"), 3), _VEC + " SELECT i, x[4] AS v FROM e")
register(
    "saved_norm", lambda s, d: graph.norms(_spectra(s, d), first=1).select("i", F.round("norm", 5).alias("norm")),
    _VEC + " SELECT i, round(sqrt(list_inner_product(x[2:], x[2:])), 5) AS norm FROM e",
)
register(
    "box_scale", lambda s, d: graph.box_scale(graph.norms(_spectra(s, d)).join(_spectra(s, d).select("i", F.col("label").alias("box")), "i")).select("box", "i", F.round("scaled", 5).alias("scaled")),
    _VEC + " SELECT label AS box, i, round(sqrt(list_inner_product(x, x)) * 10 / avg(sqrt(list_inner_product(x, x))) OVER (PARTITION BY label), 5) AS scaled FROM e",
)


def _labelled(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Embeddings as pixels of regions by label; every third is in the next region as well."""
    v = src.vectors(s, d).withColumnRenamed("i", "pixel")
    at = ["pixel", "pixel div 15 as row", "pixel % 15 as col"]
    return v.selectExpr("label as roi", *at).unionByName(v.where("pixel % 3 = 0").selectExpr("label + 1 as roi", *at)), v.select("pixel", "x")


_LAB = _VEC + ", rg AS (SELECT label AS roi, i AS pixel, x FROM e UNION ALL SELECT label + 1, i, x FROM e WHERE i % 3 = 0)"
_CENTRES = ", ct AS (SELECT roi, k, avg(x[k]) AS v FROM rg, (SELECT unnest(generate_series(1, 64)) AS k) GROUP BY roi, k), cv AS (SELECT roi, list(v ORDER BY k) AS m FROM ct GROUP BY roi)"
register(
    "eigen_centres", lambda s, d: regions.eigen_centres(*_labelled(s, d)).select("roi", F.posexplode("x").alias("k", "v")).select("roi", "k", R6("v")),
    _LAB + _CENTRES + " SELECT roi, CAST(k - 1 AS INTEGER) AS k, round(v, 6) AS v FROM ct",
)
register(
    "resolve_in_spectrum", lambda s, d: regions.resolve_in_spectrum(*_labelled(s, d)).select("roi", "pixel"),
    _LAB + _CENTRES + " SELECT roi, pixel FROM (SELECT roi, pixel, row_number() OVER (PARTITION BY pixel ORDER BY round(pow(list_distance(x, m), 2), 9), roi) AS k FROM rg JOIN cv USING (roi)) WHERE k = 1",
)

# Edits, classes, documents
_on_frames(
    "add_region", lambda f: pipeline.add_region(_a(f), f.where("row = 1").select("pixel", "row", "col")),
    "SELECT roi, pixel, row, col FROM ra UNION ALL SELECT DISTINCT (SELECT max(roi) + 1 FROM ra), pixel, row, col FROM frames WHERE row = 1", REGION,
)
_on_frames(
    "delete_region", lambda f: pipeline.delete_region(_a(f), 2, _trace(f))[1].select("roi", "frame", R6("v")),
    "SELECT roi, frame, round(v, 6) AS v FROM tr WHERE roi <> 2", REGION, TRACE,
)
_on_frames(
    "combine_regions", lambda f: pipeline.combine(_both(f), [0, 1, 1000]),
    "SELECT DISTINCT CASE WHEN roi IN (0, 1, 1000) THEN (SELECT max(roi) + 1 FROM rr) ELSE roi END AS roi, pixel, row, col FROM rr", REGION, _BOTH,
)
_CLASS = ",\nrk AS (SELECT DISTINCT roi, CASE WHEN roi IN (1, 2) THEN 4 ELSE CAST(roi % 3 AS INTEGER) END AS class FROM ra WHERE roi % 3 <> 2 OR roi = 2)"


def _classes(f: DataFrame) -> DataFrame:
    links = _a(f).select("roi").distinct().selectExpr("roi", "cast(roi % 3 as int) as class").where("class <> 2")
    return session.assign_class(links, [1, 2], 4)


_on_frames("class_assign", lambda f: _classes(f).where("roi <= 2 or class <> 4"), "SELECT roi, class FROM (SELECT * FROM rk WHERE roi NOT IN (1, 2) UNION ALL SELECT unnest([1, 2]), 4)", REGION, _CLASS)
_on_frames("without_class", lambda f: session.without_class(_a(f), _classes(f)).select("roi", "pixel"), "SELECT roi, pixel FROM ra WHERE roi % 3 = 2 AND roi <> 2", REGION)
_on_frames(
    "export_regions", lambda f: formats.export_regions(_a(f), _classes(f), 5, 6).select("roi", F.coalesce("class", F.lit(-1)).alias("class"), F.get_json_object("value", "$.coordinates[0][0]").cast("long").alias("first_row"), F.expr("json_array_length(get_json_object(value, '$.coordinates'))").alias("n")),
    "SELECT ra.roi, CASE WHEN ra.roi IN (1, 2) THEN 4 WHEN ra.roi % 3 <> 2 THEN CAST(ra.roi % 3 AS INTEGER) ELSE -1 END AS class, min(row) + 5 AS first_row, CAST(count(*) AS INTEGER) AS n FROM ra GROUP BY ra.roi", REGION,
)
_on_frames(
    "auto_class", lambda f: evaluate.auto_class(_a(f), _b(f).where("col < 12"), 2.0, 0.4).fillna(0, ["class"]),
    """SELECT 'found' AS source, f.roi, CASE WHEN m.b IS NULL THEN 3 WHEN shared / nf >= 0.4 AND shared / nt >= 0.4 THEN 1 ELSE 5 END AS class
FROM (SELECT roi, count(*) AS nf, avg(row) AS r, avg(col) AS c FROM fo GROUP BY roi) f
LEFT JOIN (SELECT a, b FROM (SELECT x.roi AS a, y.roi AS b, sqrt(pow(x.r - y.r, 2) + pow(x.c - y.c, 2)) AS d FROM (SELECT roi, avg(row) AS r, avg(col) AS c FROM fo GROUP BY roi) x, (SELECT roi, avg(row) AS r, avg(col) AS c FROM ra GROUP BY roi) y)
WHERE d < 2 QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(d, 9), b) = 1) m ON m.a = f.roi LEFT JOIN (SELECT roi, count(*) AS nt FROM ra GROUP BY roi) t ON t.roi = m.b
LEFT JOIN (SELECT fo.roi AS a, ra.roi AS b, count(*) AS shared FROM fo JOIN ra USING (pixel) GROUP BY ALL) s ON s.a = m.a AND s.b = m.b UNION ALL SELECT DISTINCT 'true', roi, 0 FROM ra""",
    REGION, ",\nfo AS (SELECT * FROM rb WHERE col < 12)",
)
_on_frames(
    "background", lambda f: session.background(
        stack.project(f, "max").selectExpr("'max' as kind", "pixel", "max as v").unionByName(stack.project(f.where("pixel % 2 = 0"), "mean").selectExpr("'mean' as kind", "pixel", "mean as v")), "mean",
    ).select("pixel", R6("v")),
    "SELECT pixel, round(CASE WHEN pixel % 2 = 0 THEN avg(v) ELSE max(v) END, 6) AS v FROM frames GROUP BY pixel",
)
register(
    "sparse_regions", lambda s, d: formats.sparse_regions(src.table(s, d, "lineitem").selectExpr("l_partkey % 400 + 1 as row", "l_suppkey as col", "case when l_linenumber = 1 then 0.0D else 1.0D end as v"), 20),
    "SELECT DISTINCT CAST(l_suppkey - 1 AS BIGINT) AS roi, CAST(l_partkey % 400 AS BIGINT) AS pixel, CAST(l_partkey % 400 // 20 AS BIGINT) AS row, CAST(l_partkey % 400 % 20 AS BIGINT) AS col FROM lineitem WHERE l_linenumber <> 1",
)

# Sweeps: three runs that found the shifted blocks, with more of them missing each time
_RUNS = """,
fd AS (SELECT run, roi, pixel, row, col FROM rb, (VALUES (0), (1), (2)) r(run) WHERE roi % 3 >= run),
ht AS (SELECT DISTINCT run, a.roi FROM (SELECT roi, avg(row) AS r, avg(col) AS c FROM ra GROUP BY roi) a, (SELECT run, roi, avg(row) AS r, avg(col) AS c FROM fd GROUP BY ALL) b
WHERE sqrt(pow(a.r - b.r, 2) + pow(a.c - b.c, 2)) < 2.0),
sc AS (SELECT f.run, nt AS n_true, nf AS n_found, coalesce(h, 0) AS hits, coalesce(h, 0) / nt AS recall, coalesce(h, 0) / nf AS precision
FROM (SELECT run, count(DISTINCT roi) AS nf FROM fd GROUP BY run) f LEFT JOIN (SELECT run, count(*) AS h FROM ht GROUP BY run) USING (run), (SELECT count(DISTINCT roi) AS nt FROM ra))"""


def _runs(f: DataFrame) -> DataFrame:
    return _b(f).withColumn("run", F.explode(F.array(*(F.lit(k) for k in range(3))))).where("roi % 3 >= run")


_on_frames("score_runs", lambda f: evaluate.score_runs(_a(f), _runs(f), 2.0).select("run", "n_true", "n_found", "hits", R6("recall"), R6("precision")), "SELECT run, n_true, n_found, hits, round(recall, 6) AS recall, round(precision, 6) AS precision FROM sc", REGION, _RUNS)
_on_frames(
    "run_table", lambda f: evaluate.run_table(
        evaluate.parameter_grid(f.sparkSession, {"limit": [1.0, 2.0], "side": [5, 7]}), evaluate.score_runs(_a(f), _runs(f), 2.0).select(F.col("run").cast("long").alias("config"), "hits", R6("recall"))
    ).fillna(-1, ["hits"]),
    "SELECT CAST(c AS BIGINT) AS config, CAST(c // 2 + 1 AS DOUBLE) AS limit, CAST(5 + 2 * (c % 2) AS INTEGER) AS side, coalesce(hits, -1) AS hits, round(recall, 6) AS recall FROM (VALUES (0), (1), (2), (3)) g(c) LEFT JOIN sc ON sc.run = c",
    REGION, _RUNS,
)
_on_frames(
    "detect_freq", lambda f: evaluate.detection_frequency(_a(f), evaluate.run_hits(_a(f), _runs(f), 2.0), evaluate.score_runs(_a(f), _runs(f), 2.0), 0.9).select("roi", R6("freq")),
    "SELECT roi, round(count(ht.run) / nullif((SELECT count(*) FROM sc WHERE recall + precision > 0.9), 0), 6) AS freq FROM (SELECT DISTINCT roi FROM ra) LEFT JOIN (SELECT * FROM ht WHERE run IN (SELECT run FROM sc WHERE recall + precision > 0.9)) ht USING (roi) GROUP BY roi",
    REGION, _RUNS,
)
