"""A session with the settings that the operators expect."""

from pyspark.sql import SparkSession


def session(app: str = "fluxgrid", **more: str) -> SparkSession:
    """Adaptive execution with skew joins, UTC and Arrow; further settings by keyword, with _ for ."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for k, v in more.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()
