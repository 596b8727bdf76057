"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes of a text and cuts where five of its bits are 0, so that an insertion moves only the cuts near
it. Where no such place comes for ``MAX_CHUNK`` bytes, the cut is at the smallest hash among them, so that it depends on the
content, too. Chunks are compared by 128-bit digest over all texts. A run of neighbouring chunks that all occur elsewhere and hold
``MIN_RUN`` bytes or more is a repeated passage; of each chunk, the first occurrence (by doc_id, then position) stays and the
others go.

A chunk that a text repeats is one row with all its places, and digest counts are pre-aggregated in every task, so that a chunk which a third of the texts share stays small in the shuffle;
the join that brings counts back to the chunks is one that Spark splits where a key is hot.

Edge cases: null and empty texts have no chunk. Rows with equal doc_id and text are one place: their chunks count as repeated,
and the first occurrence stays in each; so it is where rows of one doc_id have different texts with a chunk at one place. A text with its own chunk twice is repeated too. Ties in position can't occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.llm import common

#: Smallest and largest chunk; cuts come every 32 bytes on average beyond the smallest.
MIN_CHUNK, MAX_CHUNK = 12, 64
#: Bits 11 to 15 of the hash decide, which depend on the last 16 bytes.
LOW_BIT, MASK, REACH = 11, 31, 16
MIN_RUN = 96
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
PIECE = 1 << 20


def cut_points(b: bytes) -> list[int]:
    """Ends of the chunks of a text, in order; the last is its length."""
    found, hashes = [], []
    for at in range(0, len(b), PIECE):
        lead = min(at, REACH - 1)
        h = GEAR[np.frombuffer(b, np.uint8)[at - lead : at + PIECE]]
        for k in (1, 2, 4, 8):
            h[k:] += h[:-k] << np.uint32(k)
        hashes.append(h[lead:])
        found.append(np.flatnonzero(((h[lead:] >> np.uint32(LOW_BIT)) & np.uint32(MASK)) == 0) + at + 1)
    out, last = [], 0
    h = np.concatenate(hashes) if len(hashes) > 1 else hashes[0] if hashes else None
    forced = lambda last: last + MIN_CHUNK + int(np.argmin(h[last + MIN_CHUNK - 1 : last + MAX_CHUNK]))
    for c in np.concatenate(found).tolist() if found else []:
        while c - last > MAX_CHUNK:
            last = forced(last)
            out.append(last)
        if c - last >= MIN_CHUNK:
            out.append(c)
            last = c
    while len(b) - last > MAX_CHUNK:
        last = forced(last)
        out.append(last)
    if len(b) > last:
        out.append(len(b))
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each different chunk of a text, with all its places, packed as start * 512 + length; d1 and d2 are 96 bits of a digest."""
    for batch in batches:
        digests: list[bytes] = []
        places: list[list[int]] = []
        n = []
        for b in common.as_bytes(batch.column("text")):
            own: dict[bytes, list[int]] = {}
            at = 0
            for e in cut_points(b):
                own.setdefault(xxhash.xxh3_128_digest(b[at:e]), []).append(at << 9 | (e - at))
                at = e
            digests += own
            places += own.values()
            n.append(len(own))
        d = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
        owner = pa.array(np.repeat(np.arange(batch.num_rows), n))
        yield pa.RecordBatch.from_arrays([pa.array(d[:, 0]), pa.array((d[:, 1] >> 32).astype(np.int32)), batch.column("doc_id").take(owner), batch.column("rid").take(owner), pa.array(places, pa.list_(pa.int64()))], ["d1", "d2", "doc_id", "rid", "spans"])


def _runs(batches: Iterator[pa.RecordBatch], min_run: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, rid, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "rid", "found"))):
            run: list[tuple] = []
            for c in [*sorted({(p >> 9, p & 511, p != x["keep"], x["n"]) for x in found for p in x["spans"]}), None]:
                if run and (c is None or c[0] != run[-1][0] + run[-1][1]):
                    if run[-1][0] + run[-1][1] - run[0][0] >= min_run:
                        part = [run[0]]
                        for x in [*run[1:], None]:
                            if x is None or x[2] != part[-1][2]:
                                out.append((doc, rid, part[0][0], part[-1][0] + part[-1][1], len(part), max(p[3] for p in part), part[0][2]))
                                part = []
                            part.append(x)
                    run = []
                run.append(c)
        cols = list(zip(*out)) or [[]] * 7
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "rid", "start", "end", "n_chunks", "n_copies", "removed"])


def repeated_passages(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """(doc_id, rid, start, end, n_chunks, n_copies, removed) of each repeated passage of docs(doc_id, text); offsets are bytes, rid is the text's hash."""
    scratch = common.Scratch(docs.sparkSession)
    chunks = scratch.put(common.map_rows(docs.withColumn("rid", F.xxhash64("text")), _chunks, "d1 long, d2 int, doc_id long, rid long, spans array<long>"), "chunks")
    often = chunks.groupBy("d1", "d2").agg(F.sum(F.size("spans")).alias("n"), F.min(F.struct("doc_id", F.col("spans")[0].alias("span"))).alias("first")).where("n >= 2")
    found = chunks.join(often, ["d1", "d2"]).select("doc_id", "rid", "spans", "n", F.when(F.col("doc_id").eqNullSafe(F.col("first.doc_id")), F.col("first.span")).alias("keep"))
    per_doc = found.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("spans", "n", "keep")).alias("found"))
    return common.map_rows(per_doc, lambda batches: _runs(batches, min_run), "doc_id long, rid long, start long, end long, n_chunks long, n_copies long, removed boolean")


def remove_passages(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """docs(doc_id, text) without the bytes of passages that are removed; a code point cut in two goes whole."""
    spans = repeated_passages(docs, min_run).where("removed").groupBy("doc_id", "rid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = docs.withColumn("rid", F.xxhash64("text")).alias("d").join(spans.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.rid") == F.col("s.rid")), "left").select("d.doc_id", "d.text", "s.spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                if spans:
                    b, at, kept = text.encode(), 0, []
                    for s in sorted(spans, key=lambda x: x["start"]):
                        kept.append(b[at : s["start"]].decode("utf-8", "ignore"))
                        at = s["end"]
                    text = "".join(kept) + b[at:].decode("utf-8", "ignore")
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return common.map_rows(joined, cut, "doc_id long, text string")


def op6_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of every whole text of documents, one row each; texts without one have no row."""
    return repeated_passages(common.texts(common.table(spark, sf_dir, "documents"))).drop("rid")
