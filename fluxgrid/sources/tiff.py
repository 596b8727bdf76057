"""TIFF and BigTIFF stacks: pages of strips, plain, LZW, Deflate or PackBits, as a data source with a partition for a range of pages.

The driver reads the page directories alone; a task reads the strips of its own pages. Options choose files and pages before any
sample is read.
"""

from __future__ import annotations

import io
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fluxgrid.sources.files import matching, store

SCHEMA = "trial string, frame long, row long, col long, pixel long, v double"
#: Samples of a partition, about.
SAMPLES = 1 << 23
# Fixed values of the format: kinds of fields with their letter for struct and their bytes; tags; compressions.
KINDS = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4), 16: ("Q", 8)}
COLS, ROWS, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, PER_PIXEL, PER_STRIP, COUNTS, PREDICTOR, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317, 339
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACK_BITS = 1, 5, 8, 32946, 32773


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; 256 clears the table, 257 ends."""
    out, table, width, held, bits, before = [], [], 9, 0, 0, None
    start = [bytes([k]) for k in range(256)] + [b"", b""]
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, before = start.copy(), 9, None
            continue
        if before is None:
            word = table[code]
        else:
            word = table[code] if code < len(table) else before + before[:1]
            table.append(before + word[:1])
        out.append(word)
        before = word
        width = min(12, max(9, (len(table) + 1).bit_length()))  # one code early
    return b"".join(out)


def unpack_bits(data: bytes) -> bytes:
    """Runs of a byte and stretches of plain ones."""
    out, at = [], 0
    while at < len(data):
        n, at = data[at], at + 1
        if n < 128:
            out.append(data[at : at + n + 1])
            at += n + 1
        elif n > 128:
            out.append(data[at : at + 1] * (257 - n))
            at += 1
    return b"".join(out)


UNPACK = {PLAIN: bytes, LZW: unpack_lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACK_BITS: unpack_bits}


@dataclass
class Page:
    """What a page's directory says."""

    rows: int
    cols: int
    dtype: str
    compression: int
    predictor: int
    strips: list[tuple[int, int]]

    def samples(self, f) -> np.ndarray:
        """The page's samples; reads its strips."""
        if self.compression not in UNPACK:
            raise ValueError(f"TIFF compression {self.compression} isn't read")
        raw = []
        for at, n in self.strips:
            f.seek(at)
            raw.append(UNPACK[self.compression](f.read(n)))
        x = np.frombuffer(b"".join(raw), self.dtype)[: self.rows * self.cols].reshape(self.rows, self.cols)
        return np.cumsum(x, axis=1, dtype=x.dtype) if self.predictor == 2 else x


def header(f) -> tuple[str, bool, int]:
    """Byte order, whether it is a BigTIFF, and the place of the first directory."""
    f.seek(0)
    raw = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or len(raw) < 8:
        raise ValueError("not a TIFF file")
    big = struct.unpack_from(order + "H", raw, 2)[0] == 43
    return order, big, struct.unpack_from(order + ("Q" if big else "I"), raw, 8 if big else 4)[0]


def directory(f, order: str, big: bool, at: int) -> tuple[Page, int]:
    """The page whose directory is at a place, and the place of the next one (0 after the last)."""
    size, entry, value, letter = (8, 20, 8, "Q") if big else (2, 12, 4, "I")
    f.seek(at)
    n = struct.unpack(order + ("Q" if big else "H"), f.read(size))[0]
    raw = f.read(n * entry + value)
    tags = {}
    for k in range(n):
        tag, kind = struct.unpack_from(order + "HH", raw, k * entry)
        count = struct.unpack_from(order + letter, raw, k * entry + 4)[0]
        if kind not in KINDS:
            continue
        code, width = KINDS[kind]
        held = raw[k * entry + 4 + value : (k + 1) * entry]
        if width * count > value:
            f.seek(struct.unpack(order + letter, held)[0])
            held = f.read(width * count)
        tags[tag] = struct.unpack_from(f"{order}{count}{code}", held)
    if tags.get(PER_PIXEL, (1,))[0] != 1 or OFFSETS not in tags:
        raise ValueError("only strips of one sample a pixel are read")
    dtype = f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[tags.get(FORMAT, (1,))[0]]}{tags[BITS][0] // 8}"
    page = Page(tags[ROWS][0], tags[COLS][0], dtype, tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0], list(zip(tags[OFFSETS], tags[COUNTS])))
    return page, struct.unpack_from(order + letter, raw, n * entry)[0]


def places(f) -> Iterator[tuple[int, Page]]:
    """Each page's place and directory, without its samples."""
    order, big, at = header(f)
    while at:
        page, after = directory(f, order, big, at)
        yield at, page
        at = after


def write(pages: np.ndarray, compression: int = PLAIN, big: bool = False, rows_per_strip: int | None = None) -> bytes:
    """A stack (frame, row, col) of uint8, uint16 or float32 as a file, plain or Deflate."""
    frames, rows, cols = pages.shape
    per = rows_per_strip or rows
    pages = np.ascontiguousarray(pages.astype(pages.dtype.newbyteorder("<")))
    entry, letter, out = (20, "Q", io.BytesIO()) if big else (12, "I", io.BytesIO())
    out.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) if big else struct.pack("<2sHI", b"II", 42, 8))
    for k in range(frames):
        strips = [pages[k, r : r + per].tobytes() for r in range(0, rows, per)]
        if compression != PLAIN:
            strips = [zlib.compress(s) for s in strips]
        fields = [(COLS, [cols]), (ROWS, [rows]), (BITS, [8 * pages.dtype.itemsize]), (COMPRESSION, [compression]), (PHOTOMETRIC, [1]), (OFFSETS, None), (PER_STRIP, [per]), (COUNTS, [len(s) for s in strips]), (FORMAT, [3 if pages.dtype.kind == "f" else 1])]
        here = out.tell()
        width = 8 if big else 4
        lists = here + (8 if big else 2) + entry * len(fields) + width
        data = lists + 2 * width * len(strips)
        fields = [(t, v if v is not None else (np.cumsum([data, *map(len, strips)])[:-1]).tolist()) for t, v in fields]
        end = data + sum(map(len, strips))
        out.write(struct.pack("<Q" if big else "<H", len(fields)))
        tail = {OFFSETS: lists, COUNTS: lists + width * len(strips)}
        for tag, v in fields:
            held = struct.pack("<" + letter, v[0] if len(v) == 1 else tail[tag])
            out.write(struct.pack("<HH" + letter, tag, 16 if big else 4, len(v)) + held)
        out.write(struct.pack("<" + letter, end if k + 1 < frames else 0))
        for tag in (OFFSETS, COUNTS):
            out.write(struct.pack(f"<{len(strips)}{letter}", *dict(fields)[tag]))
        out.write(b"".join(strips))
    return out.getvalue()


class PageRange(InputPartition):
    def __init__(self, path: str, pages: list[tuple[int, int]]):
        super().__init__(None)
        self.path, self.pages = path, pages


class Reader(DataSourceReader):
    def __init__(self, path: str, samples: int = SAMPLES, trials: list[str] | None = None, first: int = 0, last: int | None = None):
        self.path, self.samples, self.trials, self.first, self.last = path, samples, trials, first, last

    def partitions(self) -> list[PageRange]:
        files, _ = store(self.path)
        out = []
        for x in matching(self.path, ".tif", ".tiff"):
            if self.trials is not None and x.rsplit("/", 1)[-1] not in self.trials:
                continue
            with files.open_input_file(x) as f:
                held, size = [], 0
                for k, (at, page) in enumerate(places(f)):
                    if self.last is not None and k > self.last:
                        break
                    if k >= self.first:
                        held.append((k, at))
                        size += page.rows * page.cols
                    if size >= self.samples:
                        out.append(PageRange(x, held))
                        held, size = [], 0
                if held:
                    out.append(PageRange(x, held))
        return out

    def read(self, partition: PageRange) -> Iterator[pa.RecordBatch]:
        files, _ = store(self.path)
        with files.open_input_file(partition.path) as f:
            order, big, _ = header(f)
            for frame, at in partition.pages:
                x = directory(f, order, big, at)[0].samples(f)
                pixel = np.arange(x.size)
                row, col = np.divmod(pixel, max(1, x.shape[1]))
                columns = [pa.array([partition.path.rsplit("/", 1)[-1]] * x.size, pa.string()), np.full(x.size, frame), row, col, pixel, x.ravel().astype(np.float64)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["trial", "frame", "row", "col", "pixel", "v"])


class TiffSource(DataSource):
    """spark.read.format("tiff_pages").load(path): the frames of a file, or of all .tif and .tiff files of a folder.

    Options: samples, how many a partition has, about; trials, a JSON list of file names; first and last, the frames to read. They stand
    for pushed filters: Spark 4.1 keeps the filters of one query of a Python source for the next query of the same DataFrame.
    """

    @classmethod
    def name(cls) -> str:
        return "tiff_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        o = self.options
        return Reader(o["path"], int(o.get("samples", SAMPLES)), json.loads(o["trials"]) if "trials" in o else None, int(o.get("first", 0)), int(o["last"]) if "last" in o else None)
