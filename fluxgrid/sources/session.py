"""A run's stored results in one folder: configuration, filtered stack, spectra, regions, classes and traces, as Parquet and JSON.

A table is a folder of versions, of which readers take the last whole one, so that a reader never sees half of a table and a writer that
breaks off loses nothing; the version before stays for those who still read it. Traces are
partitioned by kind and spectra by box and time block, so that a look at some reads no others.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.plans.pipeline import Config

#: Columns by which a table is partitioned.
PARTITIONS = {"traces": ["kind"], "spectra": ["box", "step"], "filtered": ["trial"], "stack": ["trial"]}
#: Classes that a new session has: (class, name, red, green, blue, editable), and how many there may be.
FIRST_CLASS, MOST_CLASSES = (0, "Unassigned", 150, 150, 150, False), 8
CLASS_SCHEMA = "class int, name string, red int, green int, blue int, editable boolean"


class Session:
    """Tables by name in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name.replace(' ', '_')}"

    def _files(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def versions(self, name: str) -> list[int]:
        """Numbers of the whole versions of a table; one is whole when its job has left its mark."""
        files, at = self._files(name)
        found = [x.getPath() for x in files.listStatus(at)] if files.exists(at) else []
        numbers = [(int(p.getName()[1:]), p) for p in found if re.fullmatch(r"v\d+", p.getName())]
        return sorted(n for n, p in numbers if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def exists(self, name: str) -> bool:
        return bool(self.versions(name))

    def clear(self, name: str) -> bool:
        """Deletes a table; whether there was one."""
        files, at = self._files(name)
        return files.delete(at, True)

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Stores a table as a further version and returns it as it is read again; the one before the last goes."""
        parts = [c for c in PARTITIONS.get(name, ()) if c in df.columns]
        there = self.versions(name)
        number = there[-1] + 1 if there else 0
        files, _ = self._files(name)
        half = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/v{number}")
        files.delete(half, True)  # left by a job that broke off
        df.write.partitionBy(*parts).parquet(f"{self.path(name)}/v{number}")
        for old in there[:-1]:
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/v{old}"), True)
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        there = self.versions(name)
        if not there:
            raise FileNotFoundError(self.path(name))
        return self.spark.read.parquet(f"{self.path(name)}/v{there[-1]}")

    def put_config(self, config: Config) -> None:
        line = self.spark.createDataFrame([(config.dump(), config.widefield)], "document string, widefield boolean")
        self.put("config", line.coalesce(1))

    def config(self) -> Config:
        from dataclasses import replace

        row = self.get("config").first()
        return replace(Config.load(row.document), widefield=row.widefield)

    def put_stage(self, stage: str, df: DataFrame, config: Config) -> DataFrame:
        """Stores a stage's result with the digest of what it depends on."""
        out = self.put(stage, df)
        self.put(f"{stage}.key", self.spark.createDataFrame([(config.stage_keys()[stage],)], "key string").coalesce(1))
        return out

    def fresh(self, stage: str, config: Config) -> bool:
        """Whether a stage's stored result belongs to this configuration."""
        return self.exists(stage) and self.exists(f"{stage}.key") and self.get(f"{stage}.key").first().key == config.stage_keys()[stage]

    def open(self) -> dict:
        """What an earlier run left: the configuration and every table that is there."""
        out = {"config": self.config() if self.exists("config") else None}
        return out | {name: self.get(name) for name in ("filtered", "spectra", "regions", "classes", "roi_class", "traces") if self.exists(name)}


def new_classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([FIRST_CLASS], CLASS_SCHEMA)


def create_class(classes: DataFrame, name: str, colour: tuple[int, int, int]) -> DataFrame:
    """One more class, numbered one above the largest; there are MOST_CLASSES at most."""
    n, top = classes.agg(F.count("*"), F.max("class")).first()
    if n >= MOST_CLASSES:
        raise ValueError(f"there are {n} classes already")
    return classes.unionByName(classes.sparkSession.createDataFrame([(-1 if top is None else top, name, *colour, True)], CLASS_SCHEMA).withColumn("class", F.col("class") + 1))


def _editable(classes: DataFrame, number: int) -> None:
    row = classes.where(F.col("class") == number).first()
    if row is None or not row.editable:
        raise ValueError(f"class {number} can't be changed")


def edit_class(classes: DataFrame, number: int, name: str, colour: tuple[int, int, int]) -> DataFrame:
    """Another name and colour; a class that isn't editable is refused."""
    _editable(classes, number)
    new = {"name": F.lit(name), **{c: F.lit(v) for c, v in zip(("red", "green", "blue"), colour)}}
    return classes.withColumns({c: F.when(F.col("class") == number, v).otherwise(F.col(c)) for c, v in new.items()})


def delete_class(classes: DataFrame, roi_class: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
    """Without a class and its links."""
    _editable(classes, number)
    return classes.where(F.col("class") != number), roi_class.where(F.col("class") != number)


def assign_class(roi_class: DataFrame, rois: list[int], number: int | None) -> DataFrame:
    """Links of regions to one class each; None takes them out of every class."""
    kept = roi_class.where(~F.col("roi").isin(rois))
    if number is None:
        return kept
    new = roi_class.sparkSession.createDataFrame([(r, number) for r in rois], "roi long, class int")
    return kept.unionByName(new.select("roi", F.col("class").cast(dict(roi_class.dtypes)["class"])))


def without_class(regions: DataFrame, roi_class: DataFrame) -> DataFrame:
    """Regions in no class."""
    return regions.join(roi_class.select("roi"), "roi", "left_anti").select("roi", "pixel", "row", "col")


def background(images: DataFrame, kind: str, fallback: str = "max") -> DataFrame:
    """(pixel, v): one kind of images(kind, pixel, v), the fallback where a pixel has none, 0 for the kind blank."""
    chosen = images.where(F.col("kind") == kind).select("pixel", "v")
    other = images.where(F.col("kind") == fallback).select("pixel", F.col("v").alias("w"))
    if kind == "blank":
        return other.select("pixel", F.lit(0.0).alias("v"))
    return other.join(chosen, "pixel", "full").select("pixel", F.coalesce("v", "w").alias("v"))
