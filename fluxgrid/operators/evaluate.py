"""Matching of found with true regions, scores, and parameter grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxgrid.operators.regions import overlaps


def match(a: DataFrame, b: DataFrame, limit: float) -> DataFrame:
    """(a, b, d): the nearest centre of b within a distance for each region of a, several of which may match one; both are (roi, cr, cc).

    Centres meet by cells of the grid as wide as the limit, so that only near ones are compared.
    """
    cell = lambda c: F.floor(F.col(c) / limit).cast("long")
    x = a.select(F.col("roi").alias("a"), F.col("cr").alias("ar"), F.col("cc").alias("ac")).withColumns({"gr": cell("ar"), "gc": cell("ac")})
    around = F.sequence(F.lit(-1).cast("long"), F.lit(1).cast("long"))
    x = x.withColumn("dr", F.explode(around)).withColumn("dc", F.explode(around)).selectExpr("a", "ar", "ac", "gr + dr as gr", "gc + dc as gc")
    y = b.select(F.col("roi").alias("b"), F.col("cr").alias("br"), F.col("cc").alias("bc")).withColumns({"gr": cell("br"), "gc": cell("bc")})
    d = x.join(y, ["gr", "gc"]).withColumn("d", F.expr("sqrt((ar - br) * (ar - br) + (ac - bc) * (ac - bc))")).where(f"d < {limit}")
    return d.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.round("d", 9), "b"))).where("k = 1").select("a", "b", "d")


def centre_scores(a: DataFrame, b: DataFrame, limit: float) -> DataFrame:
    """Recall, precision and F1 of matched centres (a is the truth)."""
    hits = match(a, b, limit).agg(F.count("*").alias("hits"))
    out = hits.join(a.agg(F.count("*").alias("n_a"))).join(b.agg(F.count("*").alias("n_b"))).selectExpr("hits / nullif(n_a, 0) as recall", "hits / nullif(n_b, 0) as precision")
    return out.withColumn("f1", F.expr("case when recall + precision = 0 then 0.0 else round(2 * recall * precision / (recall + precision), 4) end"))


def shape_scores(matches: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean share of the true and of the found region that matched pairs have in common."""
    shared = overlaps(a, b)
    both = matches.join(shared, ["a", "b"], "left").join(a.groupBy(F.col("roi").alias("a")).agg(F.count("*").alias("na")), "a").join(b.groupBy(F.col("roi").alias("b")).agg(F.count("*").alias("nb")), "b")
    return both.agg(F.avg(F.coalesce("shared", F.lit(0)) / F.col("na")).alias("inclusion"), F.avg(F.coalesce("shared", F.lit(0)) / F.col("nb")).alias("exclusion"))


def parameter_grid(spark: SparkSession, values: dict[str, list]) -> DataFrame:
    """Every combination of the values given for each parameter, numbered from 0; the last parameter changes fastest."""
    total = 1
    for v in values.values():
        total *= len(v)
    grid, rest = spark.range(total).withColumnRenamed("id", "config"), total
    for name, v in values.items():
        rest //= len(v)
        grid = grid.withColumn(name, F.element_at(F.array(*map(F.lit, v)), (F.expr(f"config div {rest} % {len(v)}") + 1).cast("int")))
    return grid


def grid_by(rows: DataFrame, values: dict[str, list]) -> DataFrame:
    """Every row with each combination of the values given for each parameter and the combination's number, `config`, from 0; for
    parameters that are tried on each trial, or limits that follow from a trial's own samples. Nothing is joined."""
    total = 1
    for v in values.values():
        total *= len(v)
    grid, rest = rows.withColumn("config", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(total - 1).cast("long")))), total
    for name, v in values.items():
        rest //= len(v)
        grid = grid.withColumn(name, F.element_at(F.array(*map(F.lit, v)), (F.expr(f"config div {rest} % {len(v)}") + 1).cast("int")))
    return grid


def run_table(configs: DataFrame, results: DataFrame) -> DataFrame:
    """Configurations with the results of their runs; a configuration that hasn't run keeps null results."""
    return configs.join(results, "config", "left")


def detection_frequency(truth: DataFrame, hits: DataFrame, scores: DataFrame, least: float = 1.43) -> DataFrame:
    """(roi, freq): share of the good runs that found a true region; hits is (run, roi), scores (run, recall, precision), and a run is
    good if the sum of both is above `least`. null without a good run."""
    good = scores.where(F.col("recall") + F.col("precision") > least).select("run")
    found = hits.join(good, "run").select("run", "roi").distinct().groupBy("roi").agg(F.count("*").alias("n"))
    runs = good.agg(F.countDistinct("run").alias("runs"))
    both = truth.select("roi").distinct().join(found, "roi", "left").join(F.broadcast(runs))
    return both.select("roi", (F.coalesce("n", F.lit(0)) / F.expr("nullif(runs, 0)")).alias("freq"))


def score_runs(truth: DataFrame, found: DataFrame, limit: float) -> DataFrame:
    """(run, n_true, n_found, hits, recall, precision) of region sets found(run, roi, pixel, row, col): centres within a limit, run by run."""
    centre = lambda df, *keys: df.groupBy(*keys, "roi").agg(F.avg("row").alias("cr"), F.avg("col").alias("cc"))
    return _scores(centre(truth), centre(found, "run"), run_hits(truth, found, limit))


def run_hits(truth: DataFrame, found: DataFrame, limit: float) -> DataFrame:
    """(run, roi): true regions with a centre of a found one within the limit, run by run."""
    a = truth.groupBy("roi").agg(F.avg("row").alias("ar"), F.avg("col").alias("ac"))
    b = found.groupBy("run", F.col("roi").alias("b")).agg(F.avg("row").alias("br"), F.avg("col").alias("bc"))
    cell = lambda c: F.floor(F.col(c) / limit).cast("long")
    around = F.sequence(F.lit(-1).cast("long"), F.lit(1).cast("long"))
    a = a.withColumn("dr", F.explode(around)).withColumn("dc", F.explode(around)).withColumns({"gr": cell("ar") + F.col("dr"), "gc": cell("ac") + F.col("dc")})
    b = b.withColumns({"gr": cell("br"), "gc": cell("bc")})
    near = a.join(b, ["gr", "gc"]).where(f"sqrt((ar - br) * (ar - br) + (ac - bc) * (ac - bc)) < {limit}")
    return near.select("run", "roi").distinct()


def _scores(truth: DataFrame, found: DataFrame, hits: DataFrame) -> DataFrame:
    n = truth.agg(F.count("*").alias("n_true"))
    per = found.groupBy("run").agg(F.count("*").alias("n_found")).join(hits.groupBy("run").agg(F.count("*").alias("hits")), "run", "left")
    per = per.withColumn("hits", F.coalesce("hits", F.lit(0).cast("long"))).join(F.broadcast(n))
    return per.selectExpr("run", "n_true", "n_found", "hits", "hits / nullif(n_true, 0) as recall", "hits / n_found as precision")


def auto_class(truth: DataFrame, found: DataFrame, limit: float = 5.0, least: float = 0.7) -> DataFrame:
    """(source, roi, class): a found region whose nearest true centre is within the limit is of class 1 if both share at least `least`
    of either, else of class 5; one without a match is of class 3. The true regions are appended without a class."""
    from fluxgrid.operators.regions import shape

    near = match(shape(found), shape(truth), limit)
    shared = overlaps(found, truth)
    both = near.join(shared, ["a", "b"], "left").selectExpr("a", f"coalesce(shared / size_a >= {least} and shared / size_b >= {least}, false) as same")
    own = found.select(F.col("roi").alias("a")).distinct().join(both, "a", "left")
    labelled = own.selectExpr("'found' as source", "a as roi", "case when same then 1 when same is null then 3 else 5 end as class")
    return labelled.unionByName(truth.select("roi").distinct().selectExpr("'true' as source", "roi", "cast(null as int) as class"))
