"""Operators beyond SQL, against numpy on small scenes."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fluxgrid.operators import extract, graph, regions, stack
from fluxgrid.plans import pipeline
from fluxgrid.sources import formats


def scene(n=24, t=120, seed=3):
    """Three disks with spike trains of their own over noise."""
    rng = np.random.default_rng(seed)
    r, c = np.mgrid[:n, :n]
    truth = [((r - a) ** 2 + (c - b) ** 2 <= 9) for a, b in ((6, 6), (6, 17), (17, 11))]
    data = rng.normal(0, 0.05, (t, n, n))
    for m in truth:
        data += (np.convolve(rng.random(t) < 0.08, np.exp(-np.arange(12) / 4))[:t])[:, None, None] * m
    return data, truth


def as_frames(spark, data):
    t, rows, cols = data.shape
    f, r, c = np.unravel_index(np.arange(data.size), data.shape)
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"pixel": r * cols + c, "row": r, "col": c, "frame": f, "v": data.ravel()}))


def test_planted_disks_are_found(spark):
    data, truth = scene()
    cfg = pipeline.Config.load('{"filter": {"localSpatialDenoising": false}, "eigen": {"num_eig": 8, "knn": 40, "normalize_w_k": 25}, "roi_extraction": {"roi_size_min": 8, "roi_size_max": 80, "num_rois": 6, "max_iter": 40, "merge_temporal_coef": 0.9}}')
    found = pipeline.find_regions(as_frames(spark, data), cfg, 24, 24, len(data)).toPandas()
    hits = 0
    for m in truth:
        want = set(np.flatnonzero(m.ravel()))
        best = max((len(want & set(g.pixel)) / len(want | set(g.pixel)) for _, g in found.groupby("roi")), default=0)
        hits += best > 0.8
    assert hits == 3


def test_spectrum_of_a_lattice(spark):
    import pandas as pd

    xy = [(i, j) for i in range(6) for j in range(7)]
    v = spark.createDataFrame(pd.DataFrame({"i": range(len(xy)), "x": [list(map(float, p)) for p in xy]}))
    edges = graph.symmetric(graph.affinity(graph.nearest(v, 9), 6))
    out = graph.eigenvectors(edges, 5).toPandas()
    values = np.array(out["values"].iloc[0])
    assert len(out) == len(xy) and values.max() <= 1 + 1e-6 and (np.diff(values) <= 1e-9).all()
    assert len(out.x.iloc[0]) == 4
    k = edges.toPandas().pivot(index="i", columns="j", values="w").fillna(0).to_numpy()
    assert np.allclose(k, k.T)


def test_components_and_holes(spark):
    import pandas as pd

    ring = [(r, c) for r in range(5) for c in range(5) if r in (0, 4) or c in (0, 4)]
    df = spark.createDataFrame(pd.DataFrame({"roi": 1, "row": [p[0] for p in ring], "col": [p[1] for p in ring]}))
    assert regions.fill_holes(df).count() == 25
    assert regions.fill_holes(df.where("not (row = 0 and col = 2)")).count() == 15
    pix = spark.createDataFrame([(0, 0, 0), (16, 1, 1), (40, 2, 10)], "pixel long, row long, col long")
    assert {r.pixel: r.component for r in regions.connected(pix).collect()} == {0: 0, 16: 0, 40: 40}
    from fluxgrid.operators.filters import FOUR

    assert {r.component for r in regions.connected(pix, FOUR).collect()} == {0, 16, 40}


def test_demixing_takes_overlaps_apart():
    rng = np.random.default_rng(0)
    masks = np.zeros((2, 12), bool)
    masks[0, :7], masks[1, 5:] = True, True
    c = rng.random((2, 40))
    got = extract.demix(masks.T.astype(float) @ c, masks, 400)
    assert np.abs(got - c).max() < 0.05
    w, h = extract.rank_one(np.outer([1.0, 2, 3], [4.0, 5]))
    assert np.allclose(np.outer(w, h), np.outer([1, 2, 3], [4, 5]), rtol=1e-6)


@settings(max_examples=25, deadline=None)
@given(st.integers(2, 40), st.integers(2, 40), st.integers(1, 3), st.integers(0, 4))
def test_tiles_cover(nrows, ncols, side, overlap):
    if nrows < side or ncols < side:
        return
    hit = np.zeros((nrows, ncols), int)
    for _, r0, r1, c0, c1 in stack.tiles(nrows, ncols, side, overlap):
        hit[r0:r1, c0:c1] += 1
    assert (hit > 0).all()


@pytest.mark.parametrize("kind", ["uint8", "uint16", "float32"])
def test_tiff_round_trip(spark, tmp_path, kind):
    pages = np.arange(2 * 3 * 4).reshape(2, 3, 4).astype(kind)
    (tmp_path / "a.tif").write_bytes(formats.write_pages(pages))
    got = formats.tiff_frames(spark, str(tmp_path)).orderBy("frame", "pixel").toPandas()
    assert got.v.tolist() == pages.ravel().tolist() and set(got.trial) == {"a.tif"}


def test_region_document_round_trip(spark):
    r = spark.createDataFrame([(1, 16, 1, 1), (1, 17, 1, 2), (2, 40, 2, 10)], "roi long, pixel long, row long, col long")
    back = formats.read_regions(formats.region_document(r, 5, 6), 15, 5, 6)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, r.collect()))


def test_configuration():
    c = pipeline.Config.load('{"eigen": {"knn": 7}}')
    assert c.eigen["knn"] == 7 and c.eigen["num_eig"] == 50
    assert c.key("dataset") == pipeline.Config().key("dataset") and c.key("eigen") != pipeline.Config().key("eigen")
    assert pipeline.Config.load(c.dump()) == c
    with pytest.raises(KeyError):
        pipeline.Config.load('{"eigen": {"merge_threshold": 1}}')


def test_stream_of_frames(spark, sf_dir, tmp_path):
    from fluxgrid.streaming import frames

    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    q = frames.frame_sums(frames.read_events(spark, str(tmp_path / "in"), batch.schema), late="0 seconds").writeStream.format("memory").queryName("sums").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from sums").first()[0] == batch.count()
