"""Alignment of the tokens of two tokenizers on the same text.

Space and text are encoded by a byte-level tokenizer (A), the text by a piece tokenizer that adds the space itself (B). Every byte
has a label: a token of neither ends there, one of A, one of B, or one of each. A scan of the label string by a regular expression
gives the spans up to each label of both; the labels in a span count the tokens of its group. The last tokens of a group are linked:
they are the only ones whose bytes end together.

* The tokens of a stretch (white space and what follows it up to the next white space) don't depend on the rest of the text, and
  both tokenizers end a token with it. So the label string of a text is that of its stretches, one after another; a worker keeps
  the spans of at most ``tokens.MAX_KEPT`` stretches. Texts with anything that breaks this rule (other white space, U+2581, bytes
  that don't come back) are encoded and scanned whole.
* Of two linked tokens one's bytes are a suffix of the other's. So the pairs that can be linked at all are known from the two
  vocabularies (``Vocabularies.pairs``, at most the summed lengths of their entries); a pair's number is its place in that table.
  Counts of links are partial sums over it. The table of counts has that bound whatever the documents, and is broadcast.

Edge cases: null and empty texts and texts whose joined bytes differ from space + text have no tokens. Equal rows all count. A null
doc_id is kept. An empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.llm import common, tokens

#: Labels of a byte.
NONE, A_END, B_END, BOTH = b".", b"a", b"b", b"+"
SPAN = re.compile(rb"[^+]*\+")
STRETCH = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Other white space by anyone's definition, NUL and the letter for a blank.
ODD = re.compile("[\0\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u2581]")


class Vocabularies:
    """Both tokenizers, the bytes of their entries and the pairs of entries that can be linked."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.encode_a = tokens.plain(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters, vocab = tokens.letters(), tokens.tokenizer(path_a, False).get_vocab()
        self.bytes_a = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.bytes_b = {}
        for i in range(self.b.get_piece_size()):
            t = self.b.id_to_piece(i)
            self.bytes_b[i] = bytes([int(t[1:-1], 16)]) if self.b.is_byte(i) else t.replace("▁", " ").encode()
        self.blank = self.b.piece_to_id("▁")
        self.length_a, self.length_b = (np.array([len(x.get(i, b"")) for i in range(max(x) + 1)], np.int64) for x in (self.bytes_a, self.bytes_b))

    @functools.cached_property
    def pairs(self) -> np.ndarray:
        """a << 32 | b of all pairs of entries of which one is a suffix of the other, ascending."""
        found = []
        by_bytes: dict[bytes, list[int]] = {}
        for i, t in self.bytes_b.items():
            by_bytes.setdefault(t, []).append(i)
        for i, t in self.bytes_a.items():
            found += [i << 32 | j for k in range(len(t)) for j in by_bytes.get(t[k:], ())]
        by_bytes = {}
        for i, t in self.bytes_a.items():
            by_bytes.setdefault(t, []).append(i)
        for j, t in self.bytes_b.items():
            found += [i << 32 | j for k in range(1, len(t)) for i in by_bytes.get(t[k:], ())]
        return np.unique(np.array(found, np.int64))

    def encode_b(self, parts: list[str]) -> list[list[int]]:
        """Tokens of B that make up each part; B adds a space, so a part that begins with one goes without it."""
        own = self.b.encode([x[1:] if x[0] == " " else x for x in parts], num_threads=1)
        return [[self.blank] if x == " " else ids if x[0] == " " else ids[1:] if ids[:1] == [self.blank] else [] for x, ids in zip(parts, own)]


@functools.cache
def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    return Vocabularies(path_a, path_b)


def labels(ends_a: np.ndarray, ends_b: np.ndarray, length: int) -> bytes:
    """The label string of so many bytes from the offsets where tokens end."""
    out = np.full(length, NONE[0], np.uint8)
    out[ends_a - 1] = A_END[0]
    out[ends_b - 1] = np.where(out[ends_b - 1] == A_END[0], BOTH[0], B_END[0])
    return out.tobytes()


class Aligner:
    """(tokens of A, tokens of B, groups as text, numbers of the linked pairs) of texts."""

    def __init__(self, path_a: str, path_b: str):
        self.v = vocabularies(path_a, path_b)
        self.memo = tokens.Memo(lambda parts: self.spans(parts, [self.v.encode_a(x) for x in parts], self.v.encode_b(parts)) if parts else [])

    def spans(self, parts: list[str], a: list[list[int]], b: list[list[int]]) -> list[tuple[int, int, str, bytes] | None]:
        """The groups of each part, from one label string of all of them; None where the tokens' bytes aren't the part's."""
        raw, v = [x.encode() for x in parts], self.v
        right = [b"".join(map(v.bytes_a.__getitem__, x)) == t and b"".join(map(v.bytes_b.__getitem__, y)) == t for x, y, t in zip(a, b, raw)]
        if not all(right):
            good = iter(self.spans(*([x for x, ok in zip(xs, right) if ok] for xs in (parts, a, b))))
            return [next(good) if ok else None for ok in right]
        if not parts:
            return []
        flat_a, flat_b = (np.fromiter(itertools.chain.from_iterable(x), np.int64) for x in (a, b))
        string = labels(np.cumsum(v.length_a[flat_a]), np.cumsum(v.length_b[flat_b]), sum(map(len, raw)))
        found = SPAN.findall(string)
        in_a, in_b = (np.cumsum([x.count(label) + 1 for x in found]) for label in (A_END, B_END))
        text_a, text_b = flat_a.astype(str).tolist(), flat_b.astype(str).tolist()
        written, i, j = [], 0, 0
        for n, m in zip(in_a.tolist(), in_b.tolist()):
            written.append(f"{text_a[i] if n == i + 1 else ','.join(text_a[i:n])}|{text_b[j] if m == j + 1 else ','.join(text_b[j:m])}")
            i, j = n, m
        linked = np.searchsorted(v.pairs, flat_a[in_a - 1] << 32 | flat_b[in_b - 1]).astype("<i4").tobytes()
        upto = np.searchsorted(np.cumsum(np.fromiter(map(len, found), np.int64)), np.cumsum([len(t) for t in raw]), "right").tolist()
        return [(len(x), len(y), ";".join(written[s:e]), linked[4 * s : 4 * e]) for x, y, s, e in zip(a, b, [0, *upto], upto)]

    def whole(self, text: str) -> tuple[int, int, str, bytes]:
        """One text without the use of stretches."""
        return self.spans([" " + text], [self.v.encode_a(" " + text)], [self.v.b.encode(text)])[0] or NOTHING

    def align(self, texts: list[str]) -> list[tuple[int, int, str, bytes]]:
        parts = [[] if not x or ODD.search(x) else STRETCH.findall(" " + x) for x in texts]
        known = self.memo.known(parts)
        out = []
        for x, p in zip(texts, parts):
            got = [known[u] for u in p]
            if not x:
                out.append(NOTHING)
            elif not p or None in got:
                out.append(self.whole(x))
            else:
                n, m, written, linked = zip(*got)
                out.append((sum(n), sum(m), ";".join(written), b"".join(linked)))
        return out


NOTHING = (0, 0, "", b"")


@functools.cache
def aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of a worker, which keeps its stretches from task to task."""
    return Aligner(path_a, path_b)


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, groups, links): the groups of each text as `a1,a2|b1;a3|b2,b3`, and its links as 32-bit pair numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = aligner(path_a, path_b).align([x or "" for x in b.column("text").to_pylist()])
            n, m, written, linked = zip(*got) if got else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(written, pa.string()), pa.array(linked, pa.binary())], names=["doc_id", "n_a", "n_b", "groups", "links"]
            )

    return common.map_rows(common.texts(docs), run, "doc_id long, n_a long, n_b long, groups string, links binary")


def link_counts(found: DataFrame, n_pairs: int) -> DataFrame:
    """(pair, n): how many links of all documents hold each pair; a task sums up its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_pairs, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column("links").to_pylist()), "<i4"), minlength=n_pairs)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["pair", "n"])

    return common.map_rows(found.select("links"), run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def with_counts(found: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """found with n_links, n_best and count_sum."""
    pairs = vocabularies(path_a, path_b).pairs
    rows = link_counts(found, len(pairs)).collect()  # no more rows than pairs
    counts = np.zeros(len(pairs), np.int64)
    counts[[r[0] for r in rows]] = [r[1] for r in rows]
    of_b = pairs & 0xFFFFFFFF
    highest = np.zeros(int(of_b.max(initial=0)) + 1, np.int64)
    np.maximum.at(highest, of_b, counts)
    shared = found.sparkSession.sparkContext.broadcast((counts, counts == highest[of_b]))
    rest = [c for c in found.columns if c != "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = shared.value
        for b in batches:
            raw = b.column("links").to_pylist()
            n = np.array([len(x) // 4 for x in raw], np.int64)
            at = np.frombuffer(b"".join(raw), "<i4")
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[at])])[np.concatenate([[0], np.cumsum(n)])]) for x in (best, counts)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(n), *(pa.array(s, pa.int64()) for s in sums)], names=[*rest, "n_links", "n_best", "count_sum"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name != "links")
    return common.map_rows(found, run, f"{kinds}, n_links long, n_best long, count_sum long")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of groups and links of every document, and a digest of its groups."""
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    found = aligned(common.table(spark, sf_dir, "documents"), *paths)
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    n_groups = F.when(F.col("n_a") == 0, 0).otherwise(F.length("links") / 4).cast("long")
    kept = common.Scratch(spark).put(found.select("doc_id", "n_a", "n_b", n_groups.alias("n_groups"), digest.alias("groups_sha256"), "links"), "aligned")
    return with_counts(kept, *paths).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
