"""Packing documents into sequences of at most `size` tokens by the sum of squares.

A document is its token ids and an end id. One that is longer than a sequence is cut into pieces of the whole size, of which the first
may be shorter. A piece is placed where the sum over gaps of the squared number of open sequences with that gap becomes smallest: into
one of the open sequences it fits in, or into a new one. Pieces come in order of falling length. Then the pieces of sequences that are
still open are placed anew in the same way, as long as that saves a sequence.

Pieces are dealt by hash to groups of about ``GROUP``, each of which a task packs by itself; only lengths and places move, no texts.
What is left open in the groups is packed again in fewer groups, until one group is enough, so that the waste doesn't grow with
the number of groups. Pieces of the whole size are sequences by themselves and join no group.

Edge cases: a null or empty text is a document of the end id alone. Rows with equal doc_id are documents of their own. A null doc_id
is kept. An empty table gives no pieces. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.llm import common, tokens

SIZE, END = 1024, 2
GROUP = 32_768
#: Rounds over what is left open in a group, at most; a round that saves nothing is the last.
ROUNDS = 12


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the first has what is left over."""
    first = (n - 1) % size + 1
    return [(0, first)] + [(s, size) for s in range(first, n, size)]


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every text, by the tokenizer of a file."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), [x or "" for x in b.column("text").to_pylist()]
            rows: list[tuple] = []
            for i, text in zip(ids, texts):
                raw = encoder.encode(text) + last
                for k, (s, n) in enumerate(cuts(len(raw) // 4, size)):
                    cut = raw[4 * s : 4 * (s + n)]
                    rows.append((i, k, s, n, zlib.crc32(cut), cut)[: len(names)])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names=names)

    return common.map_rows(common.texts(docs), run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def place(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Sequences of indexes into `lengths`, filled one after another in the order given."""
    gaps = np.zeros(size + 1, np.int64)  # open sequences by gap
    at: list[list[int]] = [[] for _ in range(size + 1)]
    out: list[list[int]] = []
    never = np.iinfo(np.int64).max
    for i, n in enumerate(lengths.tolist()):
        left = size - n
        best, cost = size, 2 * int(gaps[left]) + 1 if left else 0  # of a new sequence
        if left:
            here = gaps[n:size]
            change = np.where(here > 0, 2 * (gaps[:left] - here) + 2, never)
            if here[0]:
                change[0] = 1 - 2 * int(here[0])  # it fills up, and counts no more
            k = int(change.argmin())
            if change[k] <= cost:
                best = n + k
        if best == size:
            out.append([i])
            s = len(out) - 1
        else:
            s = at[best].pop()
            gaps[best] -= 1
            out[s].append(i)
        if best > n:
            gaps[best - n] += 1
            at[best - n].append(s)
    return out


def pack(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Sequences of indexes into `lengths`: longest first, then those of open sequences again while that helps."""
    order = np.argsort(-lengths, kind="stable")
    done = [[int(order[i]) for i in s] for s in place(lengths[order], size)]
    for _ in range(ROUNDS):
        left = [s for s in done if lengths[s].sum() < size]
        again = np.array(sorted((i for s in left for i in s), key=lambda i: (-lengths[i], i)), np.int64)
        fresh = place(lengths[again], size)
        if len(fresh) >= len(left):
            break
        done = [s for s in done if lengths[s].sum() == size] + [[int(again[i]) for i in s] for s in fresh]
    return done


def packed(found: DataFrame, size: int = SIZE, group: int = GROUP) -> DataFrame:
    """found (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    scratch = common.Scratch(found.sparkSession)
    rows = scratch.put(found, "pieces")
    whole = rows.where(F.col("length") == size).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    out, rest, level = [whole], rows.where(F.col("length") < size), 0
    schema = rows.schema.simpleString()[7:-1] + ", sequence_id: long, offset: long, open: boolean"
    count = rest.count()

    def run(table: pa.Table) -> pa.Table:
        names = [c for c in table.column_names if c not in ("__row", "__group")]
        table = table.sort_by([("length", "descending"), ("__row", "ascending")])
        lengths = table.column("length").to_numpy()
        seqs = pack(lengths, size)
        number, offset, is_open = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), bool)
        for k, s in enumerate(seqs):
            ends = np.cumsum(lengths[s])
            number[s], offset[s], is_open[s] = k, ends - lengths[s], ends[-1] < size
        base = (table.column("__group")[0].as_py() + (level << 32)) << 20 if len(lengths) else 0
        table = table.select(names)
        return table.append_column("sequence_id", pa.array(base + number)).append_column("offset", pa.array(offset)).append_column("open", pa.array(is_open))

    while count:
        groups = max(1, -(-count // group))
        dealt = rest.withColumn("__row", F.monotonically_increasing_id()).withColumn("__group", F.pmod(F.xxhash64("__row"), F.lit(groups)).cast("long"))
        tasks = max(1, min(groups, int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        done = scratch.put(dealt.repartition(tasks, "__group").groupBy("__group").applyInArrow(run, schema), f"level{level}")
        if groups == 1:
            out.append(done.drop("open"))
            break
        out.append(done.where("not open").drop("open"))
        rest, level = done.where("open").drop("sequence_id", "offset", "open"), level + 1
        count, before = rest.count(), count
        if count > before // 2:  # lengths that don't fit together; another deal wouldn't change that
            out.append(done.where("open").drop("open"))
            break
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


def sequences(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """(sequence_id, ids, doc_ids, starts): the packed sequences themselves; a row has at most `size` tokens."""
    found = common.Scratch(docs.sparkSession).put(pieces(docs, path, size, end, True).withColumn("row", F.monotonically_increasing_id()), "ids")
    where = packed(found.drop("ids"), size).select("row", "sequence_id", "offset")
    rows = found.join(where, "row").groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("x"))
    ids = F.aggregate("x", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return rows.select("sequence_id", ids.alias("ids"), F.col("x.doc_id").alias("doc_ids"), F.col("x.offset").alias("starts"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of documents goes in sequences of 1024 tokens."""
    import public_tokenizers

    return packed(pieces(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
