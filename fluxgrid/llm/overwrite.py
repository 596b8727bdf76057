"""Rewriting the days that late arrivals change in a layout of Parquet files.

A layout keeps the latest-arrived row of each key and cuts each day, in order of time and key, into files of equal length. To bring
late rows in, a Bloom filter of their keys is held against the rows of the starting files; what passes meets the late keys in an
exact semi-join, which removes false positives. The days of those rows and the days of the late rows themselves are rewritten; no
other file is touched.

* The filter has ``HASHES`` parts of ``WORDS`` words of 64 bits whatever the input, so what is broadcast doesn't grow. With many
  more keys than bits it lets more rows through to the exact join; results stay the same.
* Places within a day come from a sort by ranges: each range counts its rows of a day, the counts of the ranges (a few rows for
  each partition) are summed up, and a row's place is its range's start and its own place in the range. No task holds a day.
* A file is written by one task, as a stream. Files number no more than rows / file length + days, and only their names reach the
  driver.
* New files are complete in a staging folder before old ones go. A driver that ends between the two leaves a layout to be made anew.

Edge cases: of rows of a key with equal arrival the greatest in its other columns stays. A null arrival counts as late and as after
all others. Rows with a null key share that key. A null time is day -1 and sorts first. A null or NaN total counts as 0 cents.
Further columns of the input are written as they are, whatever their names, as long as they can be ordered. An empty table has no
files and an empty result.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from fluxgrid.llm import common

WORDS, HASHES = 1 << 15, 3
DAY = 86_400_000_000
FILE = re.compile(r"d(-?\d+)-(\d+)\.parquet$")


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a time, read in UTC if it has no zone."""
    if isinstance(df.schema[name].dataType, TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{name}`)")
    return F.unix_micros(name)


def day_of(df: DataFrame, name: str) -> Column:
    """Whole days since 1970, -1 for null."""
    us = micros(df, name)
    return F.coalesce(((us - F.pmod(us, F.lit(DAY))) / DAY).cast("long"), F.lit(-1).cast("long"))


def latest(rows: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """The latest-arrived row of each value of `keys`, by partial maxima."""
    rest = [c for c in rows.columns if c not in keys]
    order = F.struct(F.col(arrival).isNull().alias("unknown"), F.col(arrival).alias("arrival"), F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"))
    return rows.groupBy(*keys).agg(F.max(order).alias("__last")).select(*(F.col(c) if c in keys else F.col(f"__last.row.`{c}`").alias(c) for c in rows.columns))


def unused(columns: list[str]) -> str:
    """A beginning that none of the names has, whatever their case."""
    start = "__"
    while any(c.lower().startswith(start) for c in columns):
        start += "_"
    return start


class Layout:
    """Files of `per_file` rows a day in one folder, named d<day>-<number>.parquet."""

    def __init__(self, scratch: common.Scratch, folder: str, like: DataFrame, key: str, at: str, per_file: int):
        self.scratch, self.spark, self.folder, self.key, self.at, self.per_file = scratch, scratch.spark, folder, key, at, per_file
        self.schema, self.own = like.schema, unused(like.columns)
        self._path = self.spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(folder))

    def files(self) -> dict[str, int]:
        """Paths of the files and their days."""
        names = [str(x.getPath().toString()) for x in self._fs.listStatus(self._path(self.folder)) if x.isFile()]
        return {x: int(m[1]) for x in names if (m := FILE.search(x))}

    def read(self) -> DataFrame:
        """The rows of all files; the staging folder's name hides it."""
        return self.spark.read.schema(self.schema).parquet(self.folder)

    def numbered(self, rows: DataFrame) -> DataFrame:
        """rows with the name of each row's file, from its day and number, in a last column."""
        columns, (day, seq, part, shift, file) = rows.columns, (f"{self.own}{x}" for x in ("day", "seq", "range", "shift", "file"))
        ranged = rows.withColumn(day, day_of(rows, self.at)).repartitionByRange(day, self.at, self.key)
        ranged = ranged.sortWithinPartitions(day, self.at, self.key).withColumn(seq, F.monotonically_increasing_id())
        ranged = self.scratch.put(ranged.withColumn(part, F.shiftright(seq, 33)), f"ranged-{uuid.uuid4().hex}")
        starts = ranged.groupBy(part, day).agg(F.min(seq).alias("first"), F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(day).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = starts.select(part, day, (before - F.col("first")).alias(shift))
        placed = ranged.join(F.broadcast(starts), [part, day])  # a row for each range and each day's first
        name = F.format_string("d%d-%06d", day, F.expr(f"({seq} + {shift}) div {self.per_file}"))
        return placed.select(*(F.col(f"`{c}`") for c in columns), name.alias(file))

    def stage(self, rows: DataFrame) -> str:
        """Writes the files of these rows' days into a new folder inside the layout's; returns it."""
        folder, file = f"{self.folder}/_staged-{uuid.uuid4().hex}", f"{self.own}file"
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))  # a number keeps small files from all being merged into one task
        dealt = self.numbered(rows).repartition(tasks, file).sortWithinPartitions(file, self.at, self.key)
        # files are moved after the whole job only, so that tasks may commit theirs one by one
        dealt.write.option("maxRecordsPerFile", 0).option("mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy(file).parquet(folder)
        return folder

    def settle(self, staged: str, gone: list[str] = ()) -> None:
        """Deletes the files `gone` and moves the staged ones in."""
        for x in gone:
            self._fs.delete(self._path(x), False)
        moves = []
        for x in self._fs.globStatus(self._path(f"{staged}/{self.own}file=*/*.parquet")):
            x = str(x.getPath().toString())
            moves.append((x, f"{self.folder}/{re.search(f'/{self.own}file=([^/]*)/', x)[1]}.parquet"))
        for x, to in moves:
            if not self._fs.rename(self._path(x), self._path(to)):
                raise OSError(f"{x} can't be moved to {to}")
        self._fs.delete(self._path(staged), True)

    def overwrite(self, late: DataFrame) -> list[int]:
        """Brings in late rows, one for each key, each later than what the layout has; returns the days rewritten."""
        start = self.files()
        late = self.scratch.put(late, f"late-{uuid.uuid4().hex}")
        same = F.col(self.key).eqNullSafe(F.col(f"{self.own}key"))
        keys = late.select(F.col(self.key).alias(f"{self.own}key"))
        kept = self.read().select(F.col(self.key), _day_in_path().alias("__day"))
        maybe = passing(kept, self.key, self.scratch.put(bloom(keys, f"{self.own}key"), f"bloom-{uuid.uuid4().hex}"))
        hit = maybe.join(keys, same, "left_semi").select("__day")
        days = hit.union(late.select(day_of(late, self.at).alias("__day"))).distinct()
        changed = [r[0] for r in days.toLocalIterator()]
        gone = [x for x, d in start.items() if d in changed]
        stay = self.read().where(_day_in_path().isin(changed)).join(keys, same, "left_anti")
        self.settle(self.stage(stay.unionByName(late)), gone)
        return sorted(changed)


def _day_in_path() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), FILE.pattern, 1).cast("long")


def _position(column: str, part: int) -> Column:
    return F.pmod(F.xxhash64(F.col(column), F.lit(part)), F.lit(WORDS * 64))


def bloom(ids: DataFrame, column: str) -> DataFrame:
    """(part, word, bits): a filter of HASHES parts of at most WORDS words, by partial bit_or."""
    each = ids.select(F.explode(F.array(*(F.struct(F.lit(i).alias("part"), _position(column, i).alias("at")) for i in range(HASHES)))).alias("x"))
    words = each.selectExpr("x.part", "shiftright(x.at, 6) as word", "shiftleft(1L, cast(x.at & 63 as int)) as bit")
    return words.groupBy("part", "word").agg(F.bit_or("bit").alias("bits"))


def passing(rows: DataFrame, column: str, words: DataFrame) -> DataFrame:
    """Rows whose `column` the filter may hold. HASHES * WORDS rows are broadcast at most."""
    for i in range(HASHES):
        part = words.where(F.col("part") == i).select(F.col("word").alias("__word"), F.col("bits").alias("__bits"))
        at = _position(column, i)
        held = (F.shiftright(at, 6) == F.col("__word")) & (F.getbit("__bits", at.bitwiseAND(63).cast("int")) == 1)
        rows = rows.join(F.broadcast(part), held, "left_semi")
    return rows


def digests(files: DataFrame) -> DataFrame:
    """(path, n_rows, cents, rows_crc, ids_sha256) from rows (path, place, id, cents, crc), streaming each file in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, n, cents, crc, sha = None, 0, 0, 0, hashlib.sha256()

        def row():
            return pa.RecordBatch.from_pydict({"path": [path], "n_rows": [n], "cents": [cents], "rows_crc": [crc], "ids_sha256": [sha.hexdigest()]}, schema=out)

        out = pa.schema([("path", pa.string()), ("n_rows", pa.int64()), ("cents", pa.int64()), ("rows_crc", pa.int64()), ("ids_sha256", pa.string())])
        for b in batches:
            if not b.num_rows:
                continue
            runs = b.column("path").dictionary_encode()
            at, codes = 0, runs.indices.to_numpy()
            while at < len(codes):
                upto = at + int((codes[at:] == codes[at]).sum())  # rows are sorted by path
                name = runs.dictionary[int(codes[at])].as_py()
                if name != path:
                    if path is not None:
                        yield row()
                    path, n, cents, crc, sha = name, 0, 0, 0, hashlib.sha256()
                cut = b.slice(at, upto - at)
                sha.update(("," * (n > 0) + ",".join(cut.column("id").to_pylist())).encode())
                n, cents, crc = n + upto - at, cents + sum(cut.column("cents").to_pylist()), crc + sum(cut.column("crc").to_pylist())
                at = upto
        if path is not None:
            yield row()

    dealt = files.repartition("path").sortWithinPartitions("path", "place")
    return common.map_rows(dealt.select("path", "id", "cents", "crc"), run, "path string, n_rows long, cents long, rows_crc long, ids_sha256 string")


def with_copies(sales: DataFrame) -> DataFrame:
    """sales and the copies that the contract adds to them: later ones of a third of the ids, on days divisible by 7."""
    h = F.crc32(F.col("sale_id").cast("string").cast("binary"))
    plain = F.struct(*(F.col(f"`{c}`") for c in sales.columns))
    new = {"total": F.col("total") + 1, "sold_at": F.col("sold_at") + F.make_dt_interval((h % 2).cast("int")), "arrived_at": F.col("arrived_at") + F.make_dt_interval((1 + h % 97).cast("int"))}
    copy = F.struct(*((new[c].cast(sales.schema[c].dataType) if c in new else F.col(f"`{c}`")).alias(c) for c in sales.columns))
    copied = (h % 3 == 0) & (F.pmod(day_of(sales, "sold_at"), F.lit(7)) == 0)
    return sales.select(F.explode(F.when(copied, F.array(plain, copy)).otherwise(F.array(plain))).alias("__row")).select(*(F.col(f"__row.`{c}`").alias(c) for c in sales.columns))


def overwrite_late(sales: DataFrame, cut_us: int, files: int = 700) -> DataFrame:
    """The final files of `sales` with copies: the layout of rows that arrived before `cut_us`, then brought up to date with the rest."""
    spark = sales.sparkSession
    scratch = common.Scratch(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/layout-{uuid.uuid4().hex}"
    per_file = 1 + sales.count() // files
    rows = with_copies(sales)
    early = F.coalesce(micros(rows, "arrived_at") < cut_us, F.lit(False))
    names, soon = sales.columns, f"{unused(sales.columns)}early"
    last = scratch.put(latest(rows.withColumn(soon, early), [soon, "sale_id"], "arrived_at"), "latest")
    layout = Layout(scratch, folder, sales, "sale_id", "sold_at", per_file)
    layout.settle(layout.stage(last.where(soon).select(*(F.col(f"`{c}`") for c in names))))
    changed = layout.overwrite(last.where(f"not {soon}").select(*(F.col(f"`{c}`") for c in names)))
    final = layout.read()
    if not layout.files():
        return spark.createDataFrame([], RESULT)
    time = lambda c: F.coalesce(micros(final, c).cast("string"), F.lit(""))
    key = F.coalesce(F.col("sale_id").cast("string"), F.lit(""))
    cents = F.when(F.isnan("total"), 0).otherwise(F.coalesce(F.floor(F.col("total") * 100 + 0.5), F.lit(0))).cast("long")
    crc = F.crc32(F.concat_ws(":", key, time("sold_at"), time("arrived_at")).cast("binary"))
    lines = final.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("place"), key.alias("id"), cents.alias("cents"), crc.alias("crc"))
    day, number = (F.regexp_extract("path", FILE.pattern, i).cast("long") for i in (1, 2))
    told = digests(lines).select(day.alias("day"), number.alias("file_no"), "n_rows", "cents", "rows_crc", "path", F.lit(",".join(final.columns)).alias("columns"), "ids_sha256")
    return told.withColumn("rewritten", F.col("day").isin(changed) if changed else F.lit(False))


RESULT = "day long, file_no long, n_rows long, cents long, rows_crc long, path string, columns string, ids_sha256 string, rewritten boolean"
#: 2024-04-10 00:00 UTC
LATE_FROM = 1_712_707_200_000_000


def op12_late_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each file of the layout of sales after late arrivals are in."""
    return overwrite_late(common.table(spark, sf_dir, "sales"), LATE_FROM)
