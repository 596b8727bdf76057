"""Findings on larger tables: what failed or grew faster than the input, on small scenes of the same kind."""

import numpy as np
import pytest

from fluxgrid.operators import extract, graph, neighbours, regions, spectrum, traces
from fluxgrid.plans import pipeline, registry
from fluxgrid.sources import tables as src

grid = registry.grid_queries


def tall(spark, nrows, nframes=2):
    """A full stack of 15 columns."""
    at = spark.range(nrows * src.NCOLS * nframes)
    return src.with_coordinates(at.selectExpr(f"id div {nframes} as pixel", f"id % {nframes} as frame", "cast(pmod(xxhash64(id), 1000) as double) as v"))


def test_blocks_beyond_a_thousand_keep_their_numbers(spark):
    """Two blocks far apart under one number had a bounding box as tall as the image."""
    f = tall(spark, 1700)
    found = grid._apart(f).cache()
    assert found.select("roi").distinct().count() == grid._a(f).select("roi").distinct().count() + grid._b(f).select("roi").distinct().count()
    assert regions.shape(found).selectExpr("max(r1 - r0)").first()[0] == 4
    assert sorted(grid._apart(tall(spark, 20)).collect()) == sorted(grid._both(tall(spark, 20)).collect())


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_closest_rows_are_those_of_all_distances(metric):
    rng = np.random.default_rng(4)
    y = rng.normal(50, 1, (3000, 16))
    y[1500:1540] = y[7]  # more copies than places
    ids = rng.permutation(9000)[:3000]
    i, j, d = graph.closest(y[:500], ids[:500], y, ids, 6, metric, cells=1 << 16)
    by = np.argsort(ids)
    full = graph.pair_distances(np.repeat(y[:500], len(y), 0), np.tile(y[by], (500, 1)), metric).reshape(500, -1)
    at = np.argsort(full, axis=1, kind="stable")[:, :6]
    assert (i.reshape(-1, 6) == ids[:500, None]).all() and (j.reshape(-1, 6) == ids[by][at]).all()
    assert (d.reshape(-1, 6) == np.take_along_axis(full, at, 1)).all()


def test_copies_of_a_vector_do_not_grow_with_the_blocks():
    """A vector is sent once to each block; at 600,000 vectors there were 586 blocks."""
    assert graph.block_count(600_000, 64, 1024) <= 12 and graph.block_count(3000, 64, 1024) == 3
    for n, dim in ((10**7, 64), (10**5, 1000)):
        assert n / graph.block_count(n, dim, 1024) * dim <= graph.BLOCK_NUMBERS


def test_neighbours_are_searched_once_for_a_laplacian(spark, sf_dir, monkeypatch):
    """Each reader of the neighbours or of the weights had the whole search in its plan again."""
    for name in ("affinity", "degree", "random_walk", "laplacian"):
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "embeddings" not in plan and "FlatMapGroupsInArrow" not in plan


def ring(spark, n):
    """A symmetric graph: each of n vertices with those one and two places on."""
    e = spark.range(n).selectExpr("id as i", "explode(array(1, 2, -1, -2)) as s").selectExpr("i", f"pmod(i + s, {n}) as j", "1.0D / abs(s) as w")
    return graph.cut_lineage(e)


def test_more_vertices_make_larger_blocks(spark):
    """With blocks of one size the rows that a product sends grew with the vertices times the blocks."""
    assert spectrum.Graph(ring(spark, 400), 4).block == 50


def test_large_tiles_have_exact_neighbours(spark, monkeypatch):
    """A descent sends every vector a hundred times a round."""
    monkeypatch.setattr(neighbours, "descend", None)
    x = np.random.default_rng(1).normal(size=(60, 5))
    tiled = spark.createDataFrame([(0, 0, p, v.tolist()) for p, v in enumerate(x)], "box long, step long, pixel long, x array<double>")
    eigen = {"knn": 8, "metric": "l2", "normalize_w_k": 4, "num_eig": 4, "connections": 5, "accuracy": 8}
    assert pipeline.large_spectra(tiled, eigen).count() == 60


def test_a_chain_of_overlapping_regions_is_dealt_to_tiles(spark):
    """One class of 60 blocks, each overlapping the next ones, with 4 rounds: tiles are 16 rows high, and the traces are those of one task."""
    f = tall(spark, 100, 6)
    found = grid._both(f)
    got = extract.denoised_traces(found, f, rounds=4)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "tr#" in plan  # the whole class was one group
    got = got.toPandas().pivot(index="roi", columns="frame", values="v")
    data = f.toPandas().pivot(index="pixel", columns="frame", values="v").to_numpy()
    cells = found.toPandas()
    a = np.zeros((len(got), len(data)))
    a[np.searchsorted(got.index, cells.roi), cells.pixel] = 1
    want = extract.demix(data, a, 4, data.mean(0))  # no pixel is free of regions
    assert len(got) == cells.roi.nunique() and np.allclose(got.to_numpy(), want, rtol=1e-9)


def test_a_large_single_graph_is_solved_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_VERTICES", 20)
    monkeypatch.setattr(spectrum, "walk_vectors", lambda edges, k, tolerance: "many tasks")
    assert graph.eigenvectors(ring(spark, 30), 5) == "many tasks"


def test_the_large_spectrum_has_exact_neighbours(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(neighbours, "descend", None)
    monkeypatch.setattr(spectrum, "walk_vectors", lambda edges, *_, **__: edges.selectExpr("i", "array(w) as x", "array(1.0D, w) as values"))
    assert registry.QUERIES["large_spectrum"](spark, sf_dir).count() > 0


def test_more_tight_groups_than_the_space_is_wide_settle_soon(spark, monkeypatch):
    """Each group has a value near 1, and those were told apart by products alone; the number of groups grows with the vectors."""
    n, size = 40, 5
    inside = spark.range(n).selectExpr("id as g").selectExpr("g", f"explode(sequence(0, {size - 1})) as p").selectExpr("g", "p", f"explode(sequence(0, {size - 1})) as q")
    inside = inside.where("p <> q").selectExpr(f"g * {size} + p as i", f"g * {size} + q as j", "1.0D as w")
    links = spark.range(n).selectExpr(f"id * {size} as i", f"pmod(id + 1, {n}) * {size} + 1 as j", "(1 + pmod(id * 7, 11)) * 1e-5D as w")
    edges = graph.cut_lineage(inside.union(links).union(links.selectExpr("j", "i", "w")))
    steps, plain = [], spectrum.Graph.step
    monkeypatch.setattr(spectrum.Graph, "step", lambda *a: steps.append(1) or plain(*a))
    got = spectrum.walk_vectors(edges, 4, 1e-9, block=64, width=4).orderBy("i").toPandas()
    cells = edges.toPandas()
    w = np.zeros((n * size, n * size))
    w[cells.i, cells.j] = cells.w
    scale = 1 / np.sqrt(w.sum(1) + 1e-9)
    a = w * scale[:, None] * scale
    assert len(steps) <= 20  # 90 products before
    assert np.abs(np.linalg.eigvalsh(a)[::-1][:4] - got["values"][0]).max() < 1e-9
    x = np.stack(got.x) / scale[:, None]
    assert np.linalg.norm(a @ x - x * np.array(got["values"][0])[1:], axis=0).max() < 2e-9


def test_of_many_groups_the_looser_ones_are_one(spark, monkeypatch):
    """The graph of groups that a task solves is bounded; the start gets poorer by it, the result doesn't."""
    monkeypatch.setattr(spectrum, "GROUPS", 3)
    one = ring(spark, 12).selectExpr("i", "j", "w", "explode(sequence(0, 4)) as g")
    found = spectrum.Graph(one.selectExpr("i + 12 * g as i", "j + 12 * g as j", "w * (g + 1) as w"), 32)
    state = found.coarse(4, 1).toPandas()
    y = np.concatenate([np.frombuffer(state.y[b]).reshape(-1, 4) for b in np.argsort(state.b)])
    assert y.shape == (60, 4) and len({tuple(v) for v in y[:, :3] != 0}) == 3
    assert len(found.groups()[1].collect()) == 5


def test_the_kernel_multiplies_32_bit_numbers_and_is_exact(monkeypatch):
    """Distances that 32 bits can't tell apart, and rows of very different lengths."""
    rng = np.random.default_rng(8)
    kinds, plain = set(), np.partition
    monkeypatch.setattr(np, "partition", lambda z, *a, **b: kinds.add(z.dtype) or plain(z, *a, **b))
    y = np.concatenate([1 + rng.integers(0, 9, (800, 4)) * 1e-9, rng.normal(size=(200, 4)) * 10.0 ** rng.integers(-9, 6, (200, 1))])
    ids = rng.permutation(1000)
    for metric in ("l2", "ip"):
        _, j, d = graph.closest(y, ids, y, ids, 5, metric, cells=1 << 12)
        full = graph.pair_distances(np.repeat(y, 1000, 0), np.tile(y[np.argsort(ids)], (1000, 1)), metric).reshape(1000, -1)
        at = np.argsort(full, axis=1, kind="stable")[:, :5]
        assert (j.reshape(-1, 5) == at).all() and (d.reshape(-1, 5) == np.take_along_axis(full, at, 1)).all()
    assert kinds == {np.dtype(np.float32)}


def test_approximate_neighbours_of_a_bounded_table_are_exact(spark, sf_dir, monkeypatch):
    """Random vectors of 64 numbers have no close ones: at 51,282 vectors the descent found 0.76 of the nine, and sent 160 KB a vector."""
    monkeypatch.setattr(neighbours, "descend", None)
    got = registry.QUERIES["knn_approx"](spark, sf_dir)
    want = graph.nearest(src.vectors(spark, sf_dir), 10).selectExpr("i", "j", "round(d, 5) as d", "cast(rank as long) as rank")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_approximate_neighbours_of_larger_tables_are_found_by_descent(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(pipeline, "EXACT_PIXELS", 400)
    got = registry.QUERIES["knn_approx"](spark, sf_dir)
    assert neighbours.recall(got, graph.nearest(src.vectors(spark, sf_dir), 10)).first()[0] >= 0.9
