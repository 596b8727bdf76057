"""What the document operators share: input columns, word splitting, label samples, Arrow plumbing, components."""

from __future__ import annotations

import atexit
import contextlib
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space bytes that end a word; bytes.split() without arguments uses the same set.
SPACE = b" \t\n\x0b\x0c\r"

#: Rows a Python worker gets at once; whole texts can be long.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read through Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Session settings that the operators rely on: small Arrow batches, which hold from then on (a plan reads the setting when it
    runs), and the checkpoint folder of spark.checkpoint.dir. Without that setting a temporary folder serves a single machine; a
    cluster is refused, since its executors don't share one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (long) and text, with the further columns named; others are left out, so that clashing names do no harm."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def fold(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo modulus; -1 for a null doc_id, which is in no fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus, F.lit(-1))


def map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with the session prepared."""
    prepare(df.sparkSession)
    return df.mapInArrow(fn, schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def label_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, where: Column | None = None) -> DataFrame:
    """Texts of at most `limit` labelled documents with label 0 or 1, chosen by the smallest hash of their id.

    The bound is on what a model is fitted to, nothing else. The ids chosen (at most `limit`) are broadcast.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    if where is not None:
        chosen = chosen.where(where)
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return texts(docs).join(F.broadcast(chosen), "doc_id")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def pieces(raw: list[bytes], most: int = 2 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of bounded size, each with the index of its first."""
    at, size = 0, 0
    for i, b in enumerate(raw):
        size += len(b)
        if size >= most:
            yield at, raw[at : i + 1]
            at, size = i + 1, 0
    if at < len(raw):
        yield at, raw[at:]


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of some texts, A-Z in lower case, and the number of words of each text; all texts at once."""
    b = np.frombuffer(b"\n".join(raw).lower() + b"\n", np.uint8)
    inside = ~GAPS[b]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(raw), np.int64)
    first = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
    length = np.diff(np.concatenate([first, [len(at)]]))
    place = np.arange(len(at)) - np.repeat(first, length)
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(length.max()), 0x9E3779B97F4A7C15, np.uint64)]), dtype=np.uint64)
    h = np.add.reduceat((b[at].astype(np.uint64) + np.uint64(1)) * powers[place], first)
    ends = np.cumsum([len(x) + 1 for x in raw])
    upto = np.searchsorted(at[first], ends)
    return mix64(h + length.astype(np.uint64)), np.diff(np.concatenate([[0], upto]))


GAPS = np.isin(np.arange(256), list(SPACE))


def connected_components(vertices: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, component) for each v of `vertices`; component is the smallest id reachable over edges (a, b).

    Alternates the large-star and small-star steps, which turn every component into a star around its smallest id in a
    logarithmic number of rounds. Each round is checkpointed, so that lineage stays short and a lost executor costs little.
    """
    prepare(edges.sparkSession)
    cur = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().checkpoint()
    before = None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        cur = small.where("a <> b").distinct().checkpoint()
        sums = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == before:
            break
        before = sums
    else:
        raise RuntimeError("components did not settle")
    roots = cur.groupBy("a").agg(F.min("b").alias("root"))
    return vertices.select("v").distinct().join(roots, F.col("v") == F.col("a"), "left").select("v", F.coalesce("root", "v").alias("component"))


class Scratch:
    """Written tables that cut lineage, in the folder of spark.checkpoint.dir, which driver and executors share."""

    def __init__(self, spark: SparkSession):
        prepare(spark)
        self.spark = spark
        self.root = f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"
        _ROOTS.append(weakref.ref(spark)), _PATHS.append(self.root)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it again; a lost executor costs a reread."""
        df.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        for n in names:
            _delete(self.spark, f"{self.root}/{n}")


_ROOTS: list = []
_PATHS: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in zip(_ROOTS, _PATHS):
        with contextlib.suppress(Exception):  # the session may have ended
            _delete(spark(), path)
