"""TIFF, MAT and PNG files, stored tables, and sweeps that are taken up again."""

import io
import json
import os
import struct
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxgrid.operators import graph
from fluxgrid.plans import pipeline, sweep
from fluxgrid.sources import formats, mat, png, session, tiff


def pack_lzw(data):
    """Codes of an encoder that writes plain bytes and clears its table often."""
    bits, width, size = "", 9, 258
    for k, b in enumerate(data):
        if k % 200 == 0:
            bits, width, size = bits + format(256, f"0{width}b"), 9, 258
        bits += format(b, f"0{width}b")
        size += k % 200 > 0
    bits += format(257, f"0{width}b")
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


@pytest.mark.parametrize("dtype", ["uint8", "uint16", "float32"])
@pytest.mark.parametrize("big", [False, True])
def test_tiff_round_trip(dtype, big):
    x = (np.random.default_rng(0).random((5, 7, 9)) * 250).astype(dtype)
    for compression in (tiff.PLAIN, tiff.DEFLATE):
        for per_strip in (None, 3):
            raw = tiff.write(x, compression, big, per_strip)
            assert np.array_equal(np.stack(list(formats.read_pages(raw))), x)


def test_tiff_codecs():
    data = bytes(np.random.default_rng(1).integers(0, 256, 900, dtype=np.uint8))
    assert tiff.unpack_lzw(pack_lzw(data)) == data
    # a table that grows: the codes of -7 -8 -8 ... as in the format's description
    codes = [256, 7, 258, 8, 8, 258, 6, 257]
    bits = "".join(format(c, "09b") for c in codes)
    assert tiff.unpack_lzw(int(bits.ljust(72, "0"), 2).to_bytes(9, "big")) == bytes([7, 7, 7, 8, 8, 7, 7, 6])
    assert tiff.unpack_bits(bytes([254, 0xAA, 2, 0x80, 0x00, 0x2A, 253, 0xAA])) == bytes([0xAA] * 3 + [0x80, 0x00, 0x2A] + [0xAA] * 4)
    with pytest.raises(ValueError):
        list(formats.read_pages(b"no tiff at all, but long enough"))


def test_tiff_predictor():
    x = np.arange(24, dtype=np.uint8).reshape(1, 4, 6) * 7
    steps = np.diff(x, axis=2, prepend=np.uint8(0)).astype(np.uint8)
    raw = bytearray(tiff.write(steps))
    at = raw.index(struct.pack("<HHI", tiff.PHOTOMETRIC, 4, 1))  # the field becomes another one
    raw[at : at + 12] = struct.pack("<HHII", tiff.PREDICTOR, 4, 1, 2)
    assert np.array_equal(next(formats.read_pages(bytes(raw))), x[0])


def test_tiff_pages_are_partitions_and_filters_leave_some_out(spark, tmp_path):
    x = np.random.default_rng(2).integers(0, 999, (20, 6, 5)).astype(np.uint16)
    (tmp_path / "a.tif").write_bytes(tiff.write(x, tiff.DEFLATE, True, 4))
    (tmp_path / "b.tiff").write_bytes(tiff.write(x[:3]))
    (tmp_path / "notes.txt").write_text("no stack")
    reader = tiff.Reader(str(tmp_path), 60)
    parts = reader.partitions()
    assert [(p.path[-6:], [k for k, _ in p.pages]) for p in parts] == [("/a.tif", [2 * k, 2 * k + 1]) for k in range(10)] + [("b.tiff", [0, 1]), ("b.tiff", [2])]
    some = tiff.Reader(str(tmp_path), 60, ["a.tif"], 17)
    assert [[k for k, _ in p.pages] for p in some.partitions()] == [[17, 18], [19]]
    f = formats.tiff_frames(spark, str(tmp_path))
    got = formats.tiff_frames(spark, str(tmp_path), trials=["a.tif"], between=(16, 17)).toPandas()
    assert len(got) == 60 and got[got.frame == 17].sort_values("pixel").v.tolist() == x[17].ravel().tolist()
    assert f.where("trial = 'a.tif' and frame in (3, 17)").count() == 60
    assert f.count() == 23 * 30 and f.agg(F.sum("v")).first()[0] == int(x.sum()) + int(x[:3].sum())


def test_tiff_reads_its_own_pages_only(tmp_path):
    """A file whose other strips were cut out still gives a page: 3 GB of it are a hole."""
    x = np.arange(12, dtype=np.uint8).reshape(1, 3, 4)
    raw = tiff.write(x, big=True)
    far = 3 << 30
    _, big, first = tiff.header(io.BytesIO(raw))
    page, _ = tiff.directory(io.BytesIO(raw), "<", True, first)
    moved = bytearray(raw)
    at = moved.index(struct.pack("<HHQQ", tiff.OFFSETS, 16, 1, page.strips[0][0]))
    moved[at : at + 20] = struct.pack("<HHQQ", tiff.OFFSETS, 16, 1, far)
    with open(tmp_path / "large.tif", "wb") as f:
        f.write(moved)
        f.seek(far)
        f.write(x.tobytes())
    assert os.path.getsize(tmp_path / "large.tif") > 2 << 30
    reader = tiff.Reader(str(tmp_path), 1000)
    (batch,) = reader.read(reader.partitions()[0])
    assert batch.column("v").to_pylist() == x.ravel().tolist()


CELLS = [(1, 2, 3.5), (4, 1, -1.0), (2, 2, 0.0), (4, 3, 2.0)]


@pytest.mark.parametrize("sparse, logical", [(False, False), (True, False), (False, True), (True, True)])
def test_mat_round_trip(spark, tmp_path, sparse, logical):
    cells = spark.createDataFrame(CELLS, "row long, col long, v double")
    mat.write_mat(cells, str(tmp_path / "x.mat"), "thing", 4, 3, sparse, logical)
    got = {(r.row, r.col): r.v for r in mat.read_mat(spark, str(tmp_path)).collect()}
    there = {(r, c): 1.0 if logical else v for r, c, v in CELLS if v}
    assert got == (there if sparse or logical else {(r, c): there.get((r, c), 0.0) for r in range(1, 5) for c in range(1, 4)})
    assert [x for x in os.listdir(tmp_path)] == ["x.mat"]
    assert mat.read_mat(spark, str(tmp_path), "other").count() == 0


def test_mat_files_of_others(tmp_path):
    """Single, integer and big-endian arrays, several in a file, plain and compressed, with small elements and a text in between."""

    def element(kind, raw, order):
        if len(raw) <= 4:
            return struct.pack(order + "I", len(raw) << 16 | kind) + raw.ljust(4, b"\0")
        return struct.pack(order + "II", kind, len(raw)) + raw + b"\0" * (-len(raw) % 8)

    def array(name, kind, numbers, x, order):
        body = element(6, struct.pack(order + "II", kind, 0), order) + element(5, struct.pack(order + "ii", *x.shape), order) + element(1, name.encode(), order) + element(numbers, x.astype(order + mat.NUMBERS[numbers]).tobytes(order="F"), order)
        return struct.pack(order + "II", mat.MATRIX, len(body)) + body

    import zlib

    for order, mark in (("<", b"IM"), (">", b"MI")):
        x, y = np.arange(6.0).reshape(2, 3), np.array([[7.0, 250.0]])
        packed = zlib.compress(array("b", 9, 2, y, order))
        raw = b"text".ljust(124) + struct.pack(order + "H", 0x0100) + mark + array("long_name_of_it", 7, 7, x, order) + array("t", 4, 4, np.array([[65.0]]), order) + struct.pack(order + "II", mat.COMPRESSED, len(packed)) + packed
        f = io.BytesIO(raw)
        found = {v.name: (at, v) for at, _, v in mat.variables(f)}
        assert list(found) == ["long_name_of_it", "t", "b"]
        name, rows, columns, values = mat.cells(f, found["long_name_of_it"][0])
        assert name == "long_name_of_it" and dict(zip(zip(rows.tolist(), columns.tolist()), values.tolist())) == {(r + 1, c + 1): x[r, c] for r in range(2) for c in range(3)}
        assert mat.cells(f, found["long_name_of_it"][0], 1, 2)[3].tolist() == [1.0, 4.0]
        assert mat.cells(f, found["b"][0])[3].tolist() == [7.0, 250.0]
        with pytest.raises(ValueError):
            mat.cells(f, found["t"][0])


def test_mat_regions_and_masks(spark, tmp_path):
    regions = spark.createDataFrame([(0, 5), (0, 6), (2, 6), (2, 11)], "roi long, pixel long")
    mat.write_regions(regions, str(tmp_path / "r.mat"), 12)
    got = formats.sparse_regions(mat.read_mat(spark, str(tmp_path / "r.mat"), "A"), 4)
    assert {tuple(r) for r in got.collect()} == {(0, 5, 1, 1), (0, 6, 1, 2), (2, 6, 1, 2), (2, 11, 2, 3)}
    mask = spark.createDataFrame([(2, 3, 1.0), (1, 1, 1.0)], "row long, col long, v double")
    mat.write_mat(mask, str(tmp_path / "m.mat"), "mask", 3, 4, logical=True)
    frames = spark.range(24).selectExpr("id % 12 as pixel", "id % 12 div 4 as row", "id % 4 as col", "id div 12 as frame", "1.0D as v")
    kept, _ = pipeline.load_stack(frames, pipeline.Config(), pipeline.Shape(3, 4, 2), mat.read_mask(spark, str(tmp_path / "m.mat"), "mask"))
    assert {(r.row, r.col, r.frame) for r in kept.collect()} == {(1, 2, 0), (1, 2, 1), (0, 0, 0), (0, 0, 1)}


def test_png_round_trip(spark, tmp_path):
    rng = np.random.default_rng(3)
    images = {f"k{n}": rng.integers(0, 256, (5, 7, 4), dtype=np.uint8) for n in range(9)} | {"flat": np.full((5, 7, 4), 77, np.uint8)}
    rows = [(k, r, c, *map(int, x[r, c])) for k, x in images.items() for r in range(5) for c in range(7)]
    pixels = spark.createDataFrame(rows, "key string, row int, col int, r int, g int, b int, a int").repartition(6)
    png.write_png(pixels, str(tmp_path / "out"), 5, 7)
    assert sorted(os.listdir(tmp_path / "out")) == sorted(f"{k}.png" for k in images)
    for k, x in images.items():
        assert np.array_equal(png.decode((tmp_path / "out" / f"{k}.png").read_bytes()), x)
    assert {tuple(r) for r in png.read_png(spark, str(tmp_path / "out")).collect()} == set(rows)
    with pytest.raises(Exception, match="file's name"):
        png.write_png(pixels.withColumn("key", F.lit("a/b")), str(tmp_path / "out"), 5, 7)
    assert sorted(os.listdir(tmp_path / "out")) == sorted(f"{k}.png" for k in images)  # nothing of the job that failed


def test_png_of_images_and_regions(spark, tmp_path):
    image = spark.createDataFrame([(0, 0, -3.0), (0, 1, 128.7), (1, 0, 900.0)], "row long, col long, level double")
    png.write_png(png.grey(image, "level"), str(tmp_path), 2, 2)
    assert png.decode((tmp_path / "image.png").read_bytes()).tolist() == [[[0, 0, 0, 255], [128, 128, 128, 255]], [[255, 255, 255, 255], [0, 0, 0, 0]]]
    regions = spark.createDataFrame([(1, 0, 0, 0), (2, 0, 0, 0), (2, 3, 1, 1)], "roi long, pixel long, row long, col long")
    colours = spark.createDataFrame([(1, 9, 9, 9), (2, 1, 2, 3)], "roi long, r int, g int, b int")
    png.write_png(png.painted(regions, colours), str(tmp_path), 2, 2)
    assert png.decode((tmp_path / "regions.png").read_bytes())[[0, 1], [0, 1]].tolist() == [[1, 2, 3, 255]] * 2


def test_stack_files_are_ranges_of_frames(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(formats, "FRAMES", 4)
    frames = spark.range(200).selectExpr("concat('t', id % 2) as trial", "id div 20 as frame", "id % 20 div 5 as row", "id % 5 as col", "id % 20 as pixel", "cast(id as double) as v")
    formats.write_stack(frames, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 200 and len([x for t in ("t0", "t1") for x in os.listdir(tmp_path / "s" / f"trial={t}") if x.endswith(".parquet")]) > 2
    plan = back.where("trial = 't1'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(trial" in plan and {x.rsplit("/", 2)[1] for x in back.where("trial = 't1'").select("*", F.input_file_name().alias("f")).toPandas().f} == {"trial=t1"}


def test_session_keeps_the_last_whole_version(spark, tmp_path):
    s = session.Session(spark, str(tmp_path / "run"))
    assert s.put("regions", spark.range(3)).count() == 3
    first = s.get("regions")
    assert s.put("regions", spark.range(5)).count() == 5 and first.count() == 3  # who still reads the one before can go on
    os.makedirs(tmp_path / "run" / "regions" / "v2")  # a writer that broke off
    assert s.get("regions").count() == 5 and s.versions("regions") == [0, 1]
    assert s.put("regions", spark.range(7)).count() == 7 and s.versions("regions") == [1, 2]


@pytest.fixture(scope="module")
def small_scene(spark):
    rng = np.random.default_rng(3)
    r, c = np.mgrid[:16, :16]
    data = rng.normal(0, 0.05, (16, 16, 60))
    truth = [(r - 4) ** 2 + (c - 4) ** 2 <= 5, (r - 11) ** 2 + (c - 11) ** 2 <= 5]
    for m in truth:
        data += m[..., None] * np.convolve(rng.random(60) < 0.1, np.exp(-np.arange(8) / 3))[:60]
    rows = [(int(a * 16 + b), int(a), int(b), int(t), float(data[a, b, t])) for a in range(16) for b in range(16) for t in range(60)]
    frames = spark.createDataFrame(rows, "pixel long, row long, col long, frame long, v double")
    cells = [(k, int(a * 16 + b), int(a), int(b)) for k, m in enumerate(truth) for a, b in np.argwhere(m)]
    return graph.cut_lineage(frames), spark.createDataFrame(cells, "roi long, pixel long, row long, col long")


BASE = '{"filter": {"localSpatialDenoising": false}, "eigen": {"num_eig": 6, "knn": 20, "normalize_w_k": 12}, "roi_extraction": {"roi_size_min": 4, "max_iter": 30, "num_rois": 6, "merge": false, "roi_eccentricity_limit": 1.0}}'


def test_sweep_is_taken_up_again(spark, small_scene, tmp_path, monkeypatch):
    frames, truth = small_scene
    tasks = pipeline.task_list(pipeline.Config.load(BASE), {("roi_extraction", "roi_size_max"): [60, 2000], ("roi_extraction", "num_rois"): [0, 6]})
    made = []
    plain = sweep.Folder.keep
    monkeypatch.setattr(sweep.Folder, "keep", lambda self, stage, key, make: plain(self, stage, key, lambda: (made.append(stage), make())[1]))
    root = str(tmp_path / "sweep")
    first = sweep.sweep(frames, tasks[:2], 16, 16, 60, root, truth, 3.0, threads=2)  # stopped half way
    assert first.count() == 2 and made.count("filtered") == 1 and made.count("spectra") == 1 and made.count("regions") == 2
    made.clear()
    done = {r.seq: r for r in sweep.sweep(frames, tasks, 16, 16, 60, root, truth, 3.0, threads=2).collect()}
    assert len(done) == 4 and all(r.status == "done" and r.n_true == 2 for r in done.values())
    assert made == ["regions", "regions"]  # the four share filter and spectra, and two were done
    assert done[1].n_found > 0 and 0 <= done[1].recall <= 1
    made.clear()
    assert sweep.sweep(frames, tasks, 16, 16, 60, root, truth, 3.0).count() == 4 and not made
    told = [json.loads((tmp_path / "sweep" / "runs" / x).read_text()) for x in sorted(os.listdir(tmp_path / "sweep" / "runs")) if x.endswith(".json")]
    assert [t["parameters"]["roi_extraction_params"]["roi_size_max"] for t in told] == [60, 60, 2000, 2000]
    lines = (tmp_path / "sweep" / "results.csv").read_text().splitlines()
    assert len(lines) == 5 and lines[0].startswith("seq,status,n_true,n_found,recall,precision,") and "roi_extraction.roi_size_max" in lines[0]


def test_a_run_that_fails_is_noted_and_made_again(spark, small_scene, tmp_path, monkeypatch):
    frames, _ = small_scene
    tasks = [(0, pipeline.Config.load(BASE)), (1, pipeline.Config.load(BASE).with_("box", "total_num_spatial_boxes", 3))]  # no square
    got = {r.seq: r.status for r in sweep.sweep(frames, tasks, 16, 16, 60, str(tmp_path / "s")).collect()}
    assert got == {0: "done", 1: "failed"}
    tasks[1] = (1, tasks[1][1].with_("box", "total_num_spatial_boxes", 1).with_("roi_extraction", "num_rois", 3))
    again = {r.seq: r.status for r in sweep.sweep(frames, tasks, 16, 16, 60, str(tmp_path / "s")).where("status = 'done'").collect()}
    assert again == {0: "done", 1: "done"}


def test_progress_of_a_run(spark, small_scene, tmp_path):
    frames, _ = small_scene
    progress, seen, ended = sweep.Progress(spark, sweep.STAGES), [], threading.Event()

    def watch():
        while not ended.is_set():
            seen.append(progress.share())
            time.sleep(0.05)

    watcher = threading.Thread(target=watch)
    watcher.start()
    sweep.run(frames, pipeline.Config.load(BASE), 16, 16, 60, sweep.Folder(spark, str(tmp_path / "p")), progress=progress)
    ended.set()
    watcher.join()
    assert progress.share() == 1.0 and min(seen) < 0.34 and all(0 <= x <= 1 for x in seen)
    assert any(0.34 < x < 0.99 for x in seen)
