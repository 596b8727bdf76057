"""Mixing sources to target weights by Poisson replication.

Every source has a target share of the mixture; a document of it is repeated k times, with k from a Poisson distribution whose
mean is target share * size of the mixture / documents of the source. k comes from the inverse of the distribution at a uniform
number hashed from the seed and the doc_id, so that a rerun gives the same mixture. Copies are then put in a global order by a
hash of seed, doc_id and copy. Everything is DataFrame expressions. The table of sources is broadcast if it has no more than
``MAX_BROADCAST`` rows, which is counted; a larger one is joined with every source dealt to ``SALTS`` keys, so that a source with
a third of all documents isn't one task's.

Edge cases: a null source is a source of its own, named ''. A null doc_id hashes as ''. Rows with equal doc_id are repeated
equally often. A source without a target share, where shares are given, has mean 0 and no copies. An empty table stays empty.
Columns of the input named copy_no, n_copies, rate or shuffle_key are replaced by the result's; all others are kept.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.llm import common

SEED = 17
#: Without given shares, a source's share is in proportion to its documents to this power.
POWER = 0.5
MAX_BROADCAST, SALTS = 20_000, 32


def rates(docs: DataFrame, shares: Mapping[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """(src, rate): mean repetitions of a document of each source, for a mixture of epochs * all documents."""
    sizes = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src")).agg(F.count("*").alias("n"))
    if shares is None:
        weighed = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(POWER)))
    else:
        given = F.create_map(*(F.lit(x) for kv in shares.items() for x in kv)) if shares else F.create_map().cast("map<string,double>")
        weighed = sizes.withColumn("w", F.coalesce(F.try_element_at(given, F.col("src")).cast("double"), F.lit(0.0)))
    totals = weighed.agg(F.sum("n").alias("total"), F.sum("w").alias("all_w"))
    return weighed.join(F.broadcast(totals)).select("src", (F.col("w") / F.col("all_w") * epochs * F.col("total") / F.col("n")).alias("rate"))


def distribution(rate: DataFrame) -> DataFrame:
    """(src, rate, cdf): probabilities of at most 0, 1, 2, ... repetitions, until the rest is far below a uniform number's grain."""
    long = rate.where("rate > 0").select("src", "rate", F.explode(F.sequence(F.lit(0), F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int"))).alias("k"))
    so_far = "over (partition by src order by k rows between unbounded preceding and current row)"
    terms = long.selectExpr("src", "rate", "k", f"exp(k * ln(rate) - rate - sum(ln(greatest(k, 1))) {so_far}) as p").selectExpr("src", "rate", "k", f"sum(p) {so_far} as c")
    return terms.groupBy("src", "rate").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("cdf"))


def mix(docs: DataFrame, shares: Mapping[str, float] | None = None, epochs: float = 1.0, seed: int = SEED) -> DataFrame:
    """docs with copy_no (from 1), n_copies, rate and shuffle_key, a row for each copy, in the order of shuffle_key."""
    table = distribution(rates(docs, shares, epochs)).withColumnsRenamed({"src": "__src", "cdf": "__cdf", "rate": "__rate"})
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    uniform = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    table = common.Scratch(docs.sparkSession).put(table, "sources")
    same = F.coalesce(F.col("source").cast("string"), F.lit("")) == F.col("__src")
    if table.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        counted = docs.join(F.broadcast(table), same)
    else:
        salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        counted = docs.withColumn("__part", F.pmod(F.xxhash64(name), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("__part") == F.col("__salt"))).drop("__part", "__salt")
    counted = counted.withColumn("__u", uniform)
    copies = counted.withColumn("n_copies", F.size(F.filter("__cdf", lambda x: x <= F.col("__u"))).cast("long")).where("n_copies > 0")
    copies = copies.withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))))
    key = F.md5(F.concat(F.lit(f"{seed}:"), name, F.lit(":"), F.col("copy_no").cast("string")).cast("binary"))
    return copies.withColumn("rate", F.col("__rate")).withColumn("shuffle_key", key).drop("__src", "__cdf", "__rate", "__u").orderBy("shuffle_key", "doc_id")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixture of all documents with shares by the square root of the source's size."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", "text", "copy_no", "n_copies", F.round("rate", 9).alias("rate"), "shuffle_key")


OP7_SQL = f"""
WITH d AS (SELECT doc_id, source, text, coalesce(source, '') AS src, coalesce(CAST(doc_id AS VARCHAR), '') AS name FROM documents),
sizes AS (SELECT src, count(*) AS n FROM d GROUP BY src),
rates AS (SELECT src, pow(CAST(n AS DOUBLE), {POWER}) / (SELECT sum(pow(CAST(n AS DOUBLE), {POWER})) FROM sizes) * (SELECT sum(n) FROM sizes) / n AS rate FROM sizes),
terms AS (SELECT src, rate, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM rates, unnest(generate_series(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT))) AS g(k)),
cdf AS (SELECT src, rate, k, sum(p) OVER (PARTITION BY src ORDER BY k) AS c FROM terms),
u AS (SELECT d.*, CAST(('0x' || substr(md5('{SEED}:' || name), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS u FROM d),
counted AS (SELECT u.doc_id, u.source, u.text, u.name, rate, q.n_copies FROM (SELECT src, s.name, count(*) FILTER (WHERE c <= s.u) AS n_copies FROM (SELECT DISTINCT src, name, u FROM u) s JOIN cdf USING (src) GROUP BY src, s.name) q JOIN u USING (src, name) JOIN rates USING (src))
SELECT doc_id, source, text, copy_no, n_copies, round(rate, 9) AS rate, md5('{SEED}:' || name || ':' || CAST(copy_no AS VARCHAR)) AS shuffle_key
FROM counted, unnest(generate_series(1, n_copies)) AS g(copy_no)
"""
