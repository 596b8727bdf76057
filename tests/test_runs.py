"""Whole runs, sessions and the numpy kernels behind the tiled operators, on planted scenes."""

import json

import numpy as np
import pandas as pd
import pytest

from fluxgrid.operators import evaluate, extract, filters, graph, regions, stack, traces
from fluxgrid.plans import pipeline
from fluxgrid.sources import formats, session


def frames_of(spark, cube, trial=None):
    """cube is (row, col, frame)."""
    r, c, f = np.unravel_index(np.arange(cube.size), cube.shape)
    df = spark.createDataFrame(pd.DataFrame({"pixel": r * cube.shape[1] + c, "row": r, "col": c, "frame": f, "v": cube.ravel()}))
    from pyspark.sql import functions as F

    return df if trial is None else df.select(F.lit(trial).alias("trial"), "*")


def cube_of(df, column, shape):
    out = np.full(shape, np.nan)
    p = df.toPandas()
    out[p.row, p.col, p.frame] = p[column]
    return out


def planted(n=40, t=200, seed=5):
    """Disks with spike trains of their own over noise, as (row, col, frame)."""
    rng = np.random.default_rng(seed)
    r, c = np.mgrid[:n, :n]
    truth = [((r - a) ** 2 + (c - b) ** 2 <= q * q) for a, b, q in ((8, 8, 4), (8, 26, 5), (24, 15, 4), (30, 31, 5), (33, 6, 4))]
    cube = rng.normal(0, 0.05, (n, n, t))
    for m in truth:
        cube += m[..., None] * np.convolve(rng.random(t) < 0.08, np.exp(-np.arange(12) / 4))[:t]
    return cube, truth


@pytest.mark.parametrize("size", [2, 3, 4])
def test_tiled_median_is_the_median(spark, monkeypatch, size):
    monkeypatch.setattr(filters, "TILE_SAMPLES", 8 * 8 * 6)
    cube = np.random.default_rng(0).normal(size=(19, 21, 6))
    got = cube_of(filters.median3d(frames_of(spark, cube), 19, 21, 6, size), "med", cube.shape)
    wide = np.pad(cube, [(size // 2, size - size // 2 - 1)] * 3, mode="symmetric")
    near = np.lib.stride_tricks.sliding_window_view(wide, (size,) * 3).reshape(*cube.shape, -1)
    assert np.array_equal(got, np.sort(near, axis=-1)[..., size**3 // 2])


def test_tiled_denoising_is_the_weighted_mean(spark, monkeypatch):
    monkeypatch.setattr(filters, "TILE_SAMPLES", 8 * 8 * 7)
    cube = np.random.default_rng(1).random((17, 18, 7))
    got = cube_of(filters.local_denoise(frames_of(spark, cube), 7), "smooth", cube.shape)
    for r, c in ((0, 0), (7, 8), (8, 7), (16, 17), (3, 12)):
        near = [(a, b) for a in range(max(0, r - 1), min(17, r + 2)) for b in range(max(0, c - 1), min(18, c + 2))]
        x = cube[r, c]
        u = [1.0 if p == (r, c) else x @ cube[p] / np.sqrt((x @ x + 1e-7) * (cube[p] @ cube[p] + 1e-7)) for p in near]
        assert np.allclose(got[r, c], sum(w * cube[p] for w, p in zip(u, near)) / (sum(u) + 1e-9))


def test_sparse_spectrum_is_the_dense_one(monkeypatch):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, (150, 3)), rng.normal(9, 1, (150, 3))])  # two components: the value 1 twice
    edges = graph.affinities(x, 12, 6)
    assert np.allclose(edges.dense(), edges.dense().T)
    walk = edges.scaled(1 / np.sqrt(edges.sums() + 1e-9))
    monkeypatch.setattr(graph, "DENSE_VERTICES", 10)
    values, v = graph.leading(walk, 12)
    want = np.linalg.eigvalsh(walk.dense())[::-1][:12]
    assert np.allclose(values, want, atol=1e-6) and np.allclose(walk.dense() @ v, v * values, atol=1e-3)


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_near_rows(metric):
    x = np.round(np.random.default_rng(3).normal(size=(70, 4)), 1)
    at, near = graph.near_rows(x, 9, metric, block=16)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = {"l2": ((x[:, None] - x) ** 2).sum(-1), "ip": 1 - x @ x.T, "cosine": 1 - unit @ unit.T}[metric]
    assert np.allclose(near, np.sort(d, axis=1)[:, :9]) and np.allclose(np.take_along_axis(d, at, 1), near)
    with pytest.raises(ValueError):
        graph.near_rows(x, 3, "manhattan")


def run_config(**more):
    c = pipeline.Config().with_("filter", "localSpatialDenoising", False)
    for k, v in {"num_eig": 6, "knn": 40, "normalize_w_k": 25}.items():
        c = c.with_("eigen", k, v)
    for k, v in {"roi_size_min": 8, "roi_size_max": 120, "num_rois": 6, "max_iter": 200, "merge_temporal_coef": 0.9}.items():
        c = c.with_("roi_extraction", k, v)
    for (section, key), v in more.items():
        c = c.with_(section, key, v)
    return c


@pytest.mark.parametrize(
    "more",
    [
        {},
        {("filter", "median_filter"): True},
        {("box", "total_num_spatial_boxes"): 4, ("box", "spatial_overlap"): 16},
        {("box", "total_num_time_steps"): 2},
        {("dataset", "trial_split"): True, ("dataset", "trial_length"): 60},
        {("filter", "pca"): True},
        {("roi_extraction", "local_max_method"): True},
    ],
    ids=["plain", "median", "boxes", "blocks", "trials", "pca", "peaks"],
)
def test_planted_scene_is_found(spark, more):
    """Every planted disk has a found region of about its cells, under each switch of the run."""
    n, t = 24, 120
    rng = np.random.default_rng(3)
    r, c = np.mgrid[:n, :n]
    truth = [((r - a) ** 2 + (c - b) ** 2 <= 9) for a, b in ((6, 6), (6, 17), (17, 11))]
    data = rng.normal(0, 0.05, (t, n, n))
    for m in truth:
        data += (np.convolve(rng.random(t) < 0.08, np.exp(-np.arange(12) / 4))[:t])[:, None, None] * m
    config = run_config()
    for (section, key), v in more.items():
        config = config.with_(section, key, v)
    found = pipeline.find_regions(frames_of(spark, np.moveaxis(data, 0, 2)), config, n, n, t).toPandas()
    cells = [set(g.pixel) for _, g in found.groupby("roi")]
    best = [max((len(w & g) / len(w | g) for g in cells), default=0) for w in (set(np.flatnonzero(m.ravel()).tolist()) for m in truth)]
    share = 0.3 if ("filter", "median_filter") in more else 0.5  # a cube of three widens disks of seven cells
    assert sum(x > share for x in best) >= (2 if {("box", "total_num_spatial_boxes"), ("filter", "pca")} & set(more) else 3), best


def test_crop_with_all_filters(spark):
    """A cropped stack is a stack of its own: equalised and median filtered without a cell outside it."""
    cube, _ = planted(24, 40)
    c = pipeline.Config().with_("dataset", "crop_stack", True).with_("dataset", "crop_x", [3, 17]).with_("dataset", "crop_y", [5, 24])
    c = c.with_("filter", "hist_eq", True).with_("filter", "median_filter", True)
    out, shape = pipeline.preprocess(frames_of(spark, cube), c, 24, 24, 40)
    p = out.toPandas()
    assert (shape.nrows, shape.ncols, shape.nframes) == (14, 19, 40) and len(p) == 14 * 19 * 40
    assert p.v.between(0, 1).all() and (p.pixel == p.row * 19 + p.col).all() and p.row.max() == 13 and p.col.max() == 18


def test_auto_crop_mask_and_slices(spark):
    cube = np.random.default_rng(4).random((12, 14, 9)) + 1
    cube[:2, :, 3], cube[:, 13, 5] = 0, 0
    c = pipeline.Config().with_("dataset", "auto_crop", True).with_("dataset", "slice_stack", True).with_("dataset", "slice_every", 2).with_("dataset", "slice_start", 1)
    out, shape = pipeline.load_stack(frames_of(spark, cube), c, pipeline.Shape(12, 14, 9))
    assert (shape.nrows, shape.ncols, shape.nframes) == (10, 13, 4)
    assert np.array_equal(cube_of(out, "v", (10, 13, 4)), cube[2:, :13, 1::2])
    mask = spark.createDataFrame([(3, 4), (5, 6)], "row long, col long")
    assert pipeline.load_stack(frames_of(spark, cube), pipeline.Config(), pipeline.Shape(12, 14, 9), mask)[0].count() == 2 * 9
    assert stack.auto_crop_range(frames_of(spark, np.zeros((3, 3, 2))), "row", 3) == (0, 3)


def test_widefield_preset(spark):
    cube, truth = planted(24, 120)
    c = pipeline.Config.for_widefield()
    assert c.roi_extraction["roi_size_max"] == 600 and c.widefield
    c = c.with_("filter", "localSpatialDenoising", False).with_("eigen", "num_eig", 10).with_("eigen", "knn", 30).with_("eigen", "normalize_w_k", 20)
    c = c.with_("roi_extraction", "roi_size_min", 8)
    found = pipeline.find_regions(frames_of(spark, cube), c, 24, 24, 120, spark.range(24 * 24).selectExpr("id div 24 as row", "id % 24 as col").where("row < 22")).toPandas()
    assert len(found) and found.pixel.is_unique and found.row.max() < 22


def test_published_document_is_read():
    """The published document: section names with a suffix, parameters of older versions."""
    text = {
        "global_params": {"load_into_mem": False, "num_threads": 8}, "dataset_params": {"crop_stack": True, "crop_x": [10, 245], "trial_split": True},
        "filter_params": {"pca": True, "pca_threshold": 0.97}, "box_params": {"total_num_time_steps": 13}, "eigen_params": {"eigen_accuracy": 6},
        "roi_extraction_params": {"elbow_threshold_method": False, "eigen_threshold_value": 0.1, "roi_circ_threshold": 20},
        "time_trace_params": {"time_trace_type": "Mean", "denoise": True},
    }
    c = pipeline.Config.load(json.dumps(text))
    assert c.dataset["crop_x"] == [10, 245] and c.box["total_num_time_steps"] == 13 and c.eigen["normalize_w_k"] == 32
    assert pipeline.settings(c).elbow_share is None and pipeline.settings(c).eigen_threshold == 0.1
    assert pipeline.Config.load(c.dump()) == c
    for wrong, error in (({"eigen": {"merge_threshold": 1}}, KeyError), ({"colour": {"a": 1}}, KeyError), ({"filter": {"median_filter_size": 51}}, ValueError)):
        with pytest.raises(error):
            pipeline.Config.load(json.dumps(wrong))
    assert pipeline.Config().stale(c) >= {"box", "eigen", "filter", "dataset", "roi_extraction"} and not c.stale(c)
    assert [pipeline.as_bool(x) for x in ("Yes", "t", "0", "n")] == [True, True, False, False]
    tasks = pipeline.task_list(c, {("filter", "hist_eq"): [False, True], ("eigen", "knn"): [5, 6, 7]})
    assert len(tasks) == 6 and [t.eigen["knn"] for _, t in tasks] == [5, 6, 7] * 2 and tasks[3][1].filter["hist_eq"]


def test_session_round_trip(spark, tmp_path):
    s = session.Session(spark, str(tmp_path / "run one"))
    c = run_config()
    found = spark.createDataFrame([(1, 16, 1, 1), (1, 17, 1, 2), (2, 40, 2, 10)], "roi long, pixel long, row long, col long")
    assert s.open() == {"config": None} and not s.clear("regions") and not s.fresh("regions", c)
    s.put_config(c)
    s.put_stage("regions", found, c)
    t = spark.createDataFrame([(1, "mean", 0, 1.0), (1, "surround", 0, 2.0), (2, "mean", 0, 3.0)], "roi long, kind string, frame long, v double")
    s.put("traces", t)
    s.put("traces", s.get("traces").where("roi = 1"))  # a table can be read while it is written anew
    back = s.open()
    assert back["config"] == c and sorted(map(tuple, back["regions"].collect())) == sorted(map(tuple, found.collect()))
    assert back["traces"].count() == 2 and "kind" in back["traces"].columns
    assert s.fresh("regions", c) and not s.fresh("regions", c.with_("eigen", "knn", 7)) and s.fresh("regions", c.with_("time_trace", "min_neuropil_pixels", 9))
    assert s.clear("regions") and not s.exists("regions")


def test_classes(spark):
    classes = session.new_classes(spark)
    for k in range(7):
        classes = session.create_class(classes, f"c{k}", (k, k, k))
    with pytest.raises(ValueError):
        session.create_class(classes, "one too many", (0, 0, 0))
    with pytest.raises(ValueError):
        session.edit_class(classes, 0, "x", (1, 2, 3))
    assert session.edit_class(classes, 3, "x", (1, 2, 3)).where("class = 3").first()[1:5] == ("x", 1, 2, 3)
    links = session.assign_class(spark.createDataFrame([(1, 2), (2, 3)], "roi long, class int"), [2, 5], 4)
    assert {(r.roi, r["class"]) for r in links.collect()} == {(1, 2), (2, 4), (5, 4)}
    assert session.assign_class(links, [2], None).count() == 2
    kept, linked = session.delete_class(classes, links, 4)
    assert kept.count() == 7 and linked.count() == 1


def test_stack_of_files_and_offset(spark, tmp_path):
    for k, name in enumerate(("b.tif", "a.tif")):
        (tmp_path / name).write_bytes(formats.write_pages(np.full((2, 2, 3), 32768 + 10 * (k + 1), np.uint16)))
    (tmp_path / "notes.txt").write_text("x")
    assert formats.listing(spark, str(tmp_path)) == ["a.tif", "b.tif"] and formats.listing(spark, str(tmp_path / "a.tif")) == ["a.tif"]
    (tmp_path / "notes.txt").unlink()
    got = formats.tiff_frames(spark, str(tmp_path), True, 2.0**15).orderBy("frame", "pixel").toPandas()
    assert "trial" not in got and got.v.tolist() == [20.0] * 12 + [10.0] * 12 and got.frame.max() == 3


def test_principal_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 20)) * 5 + rng.normal(0, 0.01, (60, 20))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pixel long, vec array<double>")
    got = np.array([r.x for r in graph.principal_vectors(df, 10).orderBy("pixel").collect()])
    y = x - x.mean(1, keepdims=True)
    u, s, _ = np.linalg.svd(y, full_matrices=False)
    k = got.shape[1]
    assert k >= 2 and np.allclose(np.abs(got), np.abs(u[:, :k] * s[:k]), atol=1e-6)
    values = graph.principal_values(df, 10).orderBy("k").toPandas()
    assert np.allclose(values.value[:10], s[:10], atol=1e-4) and values.kept.sum() >= k


def test_denoised_traces_take_the_background_off(spark):
    """Two overlapping disks over a background that moves with time: traces correlate with the truth, not with the background."""
    rng = np.random.default_rng(7)
    r, c = np.mgrid[:20, :20]
    masks = [(r - 9) ** 2 + (c - 7) ** 2 <= 16, (r - 9) ** 2 + (c - 12) ** 2 <= 16]
    course = [np.convolve(rng.random(80) < 0.1, np.exp(-np.arange(8) / 3))[:80] for _ in masks]
    drift = 1 + np.sin(np.arange(80) / 9)
    cube = drift[None, None] * 0.5 + sum(m[..., None] * t for m, t in zip(masks, course))
    at = [(k, int(p), int(p // 20), int(p % 20)) for k, m in enumerate(masks) for p in np.flatnonzero(m.ravel())]
    found = spark.createDataFrame(at, "roi long, pixel long, row long, col long")
    got = extract.denoised_traces(found, frames_of(spark, cube)).toPandas().pivot(index="roi", columns="frame", values="v").to_numpy()
    plain = traces.mean_trace(found, frames_of(spark, cube)).toPandas().pivot(index="roi", columns="frame", values="v").to_numpy()
    for k in (0, 1):
        assert np.corrcoef(got[k], course[k])[0, 1] > 0.95 and np.corrcoef(got[k], course[k])[0, 1] > np.corrcoef(plain[k], course[k])[0, 1] + 0.05


def test_poisson_noise(spark):
    cube = np.random.default_rng(8).normal(0, 2, (6, 6, 100))
    got = extract.poisson_noise(frames_of(spark, cube), 0.5, 3).toPandas()
    again = extract.poisson_noise(frames_of(spark, cube).repartition(3), 0.5, 3).toPandas()
    assert len(got) == 3 * cube.size and got.noise.sum() == again.noise.sum()
    assert abs(got.noise.mean() - 0.5 * cube.std(2).mean()) < 0.05 and abs(got.noise.var() - got.noise.mean()) < 0.1
    assert np.allclose(got.noisy, got.v + got.noise) and (got.noise == got.noise.round()).all()


def test_footprint_correlation(spark):
    """A region that is active alone has its footprint's shape in the mean image of those frames."""
    cube = np.zeros((12, 12, 6))
    cube[3:6, 3:6, 2] = 1
    cells = [(1, r * 12 + c, r, c) for r in range(3, 6) for c in range(3, 6)] + [(2, 100, 8, 4), (2, 101, 8, 5)]
    found = spark.createDataFrame(cells, "roi long, pixel long, row long, col long")
    active = spark.createDataFrame([(1, 2), (2, 3)], "roi long, frame long")
    got = {r.roi: (r.n_frames, r.corr) for r in regions.footprint_correlation(found, frames_of(spark, cube), active).collect()}
    assert got[1] == (1, pytest.approx(1.0)) and got[2][1] == 0.0


def test_magic_wand(spark):
    x = np.zeros((8, 8, 3))
    x[2:5, 2:5, 0], x[6:, 6:, 1] = 1.0, 1.0
    x[..., 2] = 0.01
    rows = [(0, r, c, x[r, c].tolist()) for r in range(8) for c in range(8)]
    got = extract.magic_wand(spark.createDataFrame(rows, "box long, row long, col long, x array<double>"), 3, 3).collect()
    assert {(r.row, r.col) for r in got} == {(r, c) for r in range(2, 5) for c in range(2, 5)}


def test_extra_kinds_of_traces(spark):
    from fluxgrid.functions import registry

    cube = np.random.default_rng(9).random((6, 6, 12))
    found = spark.createDataFrame([(1, 14, 2, 2), (1, 15, 2, 3)], "roi long, pixel long, row long, col long")
    around = regions.sized_ring(found, 6, 6, 4)
    registry.register_trace("double", lambda mean, around, denoised: mean.selectExpr("roi", "frame", "2 * v as v"))
    try:
        got = traces.all_kinds(found, around, frames_of(spark, cube)).toPandas().pivot(index="kind", columns="frame", values="v")
        assert len(got) == 10 and np.allclose(got.loc["double"], 2 * got.loc["mean"])
        with pytest.raises(ValueError):
            registry.register_trace("double", lambda *_: None)
    finally:
        del registry.TRACES["double"]
    assert np.allclose(got.loc["mean corrected"], got.loc["mean"] - got.loc["surround"])
