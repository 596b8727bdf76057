"""A training corpus in five stages, each over all that the one before kept.

quality     rows that the quality rules reject go
near        one document of each class of near copies stays (five-word shingles, similarity 0.8)
leaks       documents that hold a benchmark item go
secrets     found secrets are masked in the text, and n_chars follows
mix         documents are repeated to target weights of their sources and shuffled

Every stage but the last returns the columns of documents. Repeated rows, nulls and empty tables are handled as the operators
say: a null or empty text fails the quality rules; a kept class of near copies has one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fluxgrid.llm import common, decontaminate, jaccard, mixing, quality, secrets


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"), common.table(spark, sf_dir, "documents"))


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, 5, 0.8)


def _leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [("quality", _quality), ("near", _near), ("leaks", _leaks), ("secrets", _secrets), ("mix", _mix)]
#: The trees of the quality rules, the latent space and the lexer are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read by the next."""
    scratch = common.Scratch(spark)
    docs = common.table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
