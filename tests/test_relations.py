"""Operators that work over relations of any size against numpy: lines and edges, spectra, neighbours, components, demixing."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fluxgrid.operators import demix, edges, extract, graph, neighbours, regions, spectrum, traces
from fluxgrid.plans import pipeline
from fluxgrid.sources import tables as src

G = np.mgrid[:24, :24]
DISK = (G[0] - 11) ** 2 + (G[1] - 11) ** 2 <= 64
BAR = (abs(G[0] - 11) <= 2) & (abs(G[1] - 11) <= 9)
RING = DISK & ~((G[0] - 11) ** 2 + (G[1] - 11) ** 2 <= 16)
DIAGONAL = np.zeros((24, 24), bool)
DIAGONAL[3, 3] = DIAGONAL[4, 4] = True
CORNER = np.zeros((24, 24), bool)
CORNER[:3, :2] = True


def cells_of(spark, masks):
    return spark.createDataFrame([(k, int(r * 24 + c), int(r), int(c), float(m[r, c])) for k, m in enumerate(masks) for r, c in np.argwhere(m)], "roi long, pixel long, row long, col long, v double")


def shifted(x, r, c):
    """x at (row + r, col + c), 0 outside."""
    p = np.pad(x, 1)
    return p[1 + r : 1 + r + x.shape[0], 1 + c : 1 + c + x.shape[1]]


def canny_by_hand(mask, sigma=1.0, low=0.1, high=0.2):
    x = np.pad(mask.astype(float), 8)
    taps = np.exp(-0.5 * (np.arange(-4, 5) / sigma) ** 2)
    taps /= taps.sum()
    for axis in (0, 1):
        x = np.apply_along_axis(lambda v: np.convolve(v, taps, "same"), axis, x)
    gr = sum(w * (shifted(x, 1, c) - shifted(x, -1, c)) for c, w in ((-1, 1), (0, 2), (1, 1)))
    gc = sum(w * (shifted(x, r, 1) - shifted(x, r, -1)) for r, w in ((-1, 1), (0, 2), (1, 1)))
    m = np.hypot(gr, gc)
    thin = np.zeros(m.shape, bool)
    for r, c in np.argwhere(m >= low):
        a, b = abs(gr[r, c]), abs(gc[r, c])
        s = 1 if gr[r, c] * gc[r, c] >= 0 else -1
        part = b / a if a >= b else a / b
        near = [(1, 0), (1, s)] if a >= b else [(0, 1), (s, 1)]
        sides = [(1 - part) * m[r + k * near[0][0], c + k * near[0][1]] + part * m[r + k * near[1][0], c + k * near[1][1]] for k in (1, -1)]
        thin[r, c] = all(m[r, c] >= v - 1e-9 for v in sides)
    kept = thin & (m >= high)
    while True:
        grown = thin & np.any([shifted(kept, r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)], axis=0)
        if (grown == kept).all():
            return {(int(r) - 8, int(c) - 8) for r, c in np.argwhere(kept)}
        kept = grown


def test_canny_is_the_numpy_version(spark):
    masks = [DISK, BAR, RING, DIAGONAL, CORNER]
    got = edges.canny(cells_of(spark, masks)).toPandas()
    for k, m in enumerate(masks):
        assert set(got[got.roi == k][["row", "col"]].itertuples(index=False, name=None)) == canny_by_hand(m), k
    few = edges.canny(cells_of(spark, masks), 1.0, 0.1, 50.0)
    assert few.count() == 0  # nothing is strong enough


def test_circle_fit(spark):
    masks = [DISK, BAR, CORNER]
    got = edges.circle_fit(cells_of(spark, masks)).orderBy("roi").toPandas()
    assert got.circularity[0] == 100 and got.circularity[1] < 80 and got.circularity[2] < 100
    for k, m in enumerate(masks[:2]):  # a brute accumulator
        edge = canny_by_hand(np.kron(m, np.ones((2, 2), bool)))
        r, c = np.nonzero(m)
        radius = min(np.ptp(r), np.ptp(c))
        circle = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if abs(np.hypot(i, j) - radius) < 0.5]
        votes = pd.Series([(a + i, b + j) for a, b in edge for i, j in circle]).value_counts()
        assert got.votes[k] == pytest.approx(votes.max() / len(circle))
    one = cells_of(spark, [np.eye(1, 24, dtype=bool).repeat(1, 0)])
    assert edges.circle_fit(one).first().circularity == 0


def trace_by_hand(mask, level):
    """Closed lines of marching squares, by walking from side to side; values are 0 outside."""
    x = np.pad(mask.astype(float), 1)
    up = x > level
    point = {}
    follow = {}
    for r in range(x.shape[0] - 1):
        for c in range(x.shape[1] - 1):
            sides = {"T": ((r, c), (r, c + 1)), "R": ((r, c + 1), (r + 1, c + 1)), "B": ((r + 1, c + 1), (r + 1, c)), "L": ((r + 1, c), (r, c))}
            names = "TRBL"
            for k, s in enumerate(names):
                a, b = sides[s]
                if up[a] or not up[b]:
                    continue
                t = next(names[(k + n) % 4] for n in (1, 2, 3) if up[sides[names[(k + n) % 4]][0]] and not up[sides[names[(k + n) % 4]][1]])
                key = lambda q: tuple(sorted(q))
                follow[key(sides[s])] = key(sides[t])
                part = (level - x[a]) / (x[b] - x[a])
                point[key(sides[s])] = (a[0] + part * (b[0] - a[0]) - 1, a[1] + part * (b[1] - a[1]) - 1)
    lines = []
    while follow:
        at = next(iter(follow))
        line = []
        while at in follow:
            line.append(point[at])
            at = follow.pop(at)
        lines.append(line)
    return lines


def turned(line):
    k = line.index(min(line))
    return [(round(r, 9), round(c, 9)) for r, c in line[k:] + line[:k]]


def test_contour_lines_are_those_of_a_walk(spark):
    rng = np.random.default_rng(4)
    hills = np.round(np.exp(-((G[0] - 9) ** 2 + (G[1] - 12) ** 2) / 20) + 0.3 * rng.random((24, 24)) * (G[0] > 3), 3)
    masks = [DISK, BAR, RING, DIAGONAL, CORNER, hills]
    got = edges.contour_lines(cells_of(spark, masks), 0.25).orderBy("roi", "line", "k").toPandas()
    for k, m in enumerate(masks):
        own = [list(x[["row", "col"]].itertuples(index=False, name=None)) for _, x in got[got.roi == k].groupby("line")]
        assert all((x.k.to_numpy() == np.arange(len(x))).all() for _, x in got[got.roi == k].groupby("line"))
        assert sorted(turned(x) for x in own) == sorted(turned(x) for x in trace_by_hand(m, 0.25)), k
        assert own == [x for x in own if x[0] == min(x)]
    assert got[got.roi == 2].line.nunique() == 2 and got[got.roi == 3].line.nunique() == 2
    assert edges.contour_lines(cells_of(spark, [DISK]).where("false")).count() == 0


def lattice(side, ids=lambda x: 3 * x + 5):
    n = side * side
    r, c = np.divmod(np.arange(n), side)
    rng = np.random.default_rng(1)
    i, j, w = [], [], []
    for dr, dc in ((0, 1), (1, 0), (1, 1), (2, 0)):
        a = np.flatnonzero((r + dr < side) & (c + dc < side))
        b = a + dr * side + dc
        v = rng.random(len(a)) * np.where((r[a] // 6 != r[b] // 6) | (c[a] // 6 != c[b] // 6), 0.05, 1)
        i, j, w = [*i, a, b], [*j, b, a], [*w, v, v]
    i, j, w = map(np.concatenate, (i, j, w))
    walk = np.zeros((n, n))
    walk[i, j] = w
    return pd.DataFrame({"i": ids(i), "j": ids(j), "w": w}), walk


def test_distributed_spectrum_is_the_dense_one(spark, monkeypatch):
    side, k = 18, 8
    frame, w = lattice(side)
    largest = []
    plain = spectrum.Graph.__init__

    def spied(self, *a, **b):
        plain(self, *a, **b)
        largest.append(self.tiles.agg(F.max(F.length("w") / 8)).first()[0])

    monkeypatch.setattr(spectrum.Graph, "__init__", spied)
    got = spectrum.walk_vectors(spark.createDataFrame(frame), k, 1e-7, block=64, width=12).orderBy("i").toPandas()
    scale = 1 / np.sqrt(w.sum(1) + 1e-9)
    values, v = np.linalg.eigh(w * scale[:, None] * scale)
    values, v = values[::-1][:k], (v * scale[:, None])[:, ::-1][:, 1:k]
    assert np.allclose(got["values"][0], values, atol=1e-9)
    x = np.stack(got.x)
    assert got.i.tolist() == sorted({*frame.i})
    for a, b in zip(x.T, v.T):
        assert min(abs(a - b).max(), abs(a + b).max()) < 1e-4 * abs(b).max()
    assert largest[0] < len(frame) / 4  # no task has the graph


def test_distributed_spectrum_finds_values_that_come_often(spark):
    """Five components have the value 1 five times, more often than the block is wide."""
    one, w = lattice(5, lambda x: x)
    frame = pd.concat([one.assign(i=one.i + 25 * k, j=one.j + 25 * k) for k in range(5)])
    got = spectrum.walk_vectors(spark.createDataFrame(frame), 7, 1e-7, block=40, width=3).first()["values"]
    assert np.allclose(got[:5], 1, atol=1e-7) and got[5] < 1 - 1e-4


def test_spectra_that_do_not_settle_are_refused(spark):
    frame, _ = lattice(12)
    with pytest.raises(RuntimeError, match="didn't settle"):
        spectrum.leading(spectrum.Graph(spark.createDataFrame(frame), 64), 8, 1e-12, max_steps=2, width=4)
    x = np.random.default_rng(2).normal(size=(900, 3))
    with pytest.raises(RuntimeError, match="didn't settle"):
        graph.leading(graph.affinities(x, 12, 6), 12, 1e-13, rounds=1)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_descent_finds_the_neighbours(spark, sf_dir, metric):
    v = src.vectors(spark, "/root/testdata/sf0.01" if sf_dir.endswith("sf0.001") else sf_dir).select("i", "x").coalesce(2)
    exact = graph.nearest(v, 10, metric).where("i <> j").cache()
    good = neighbours.descend(v, 10, metric, connections=20, accuracy=30, rounds=4).cache()
    assert neighbours.recall(good, exact).first()[0] >= 0.9
    own = good.groupBy("i").agg(F.count("*").alias("n"), F.max("rank").alias("top"), F.min(F.struct("rank", "j")).alias("first")).toPandas()
    assert (own.n == 10).all() and (own.top == 10).all() and all(f["j"] == i for i, f in zip(own.i, own["first"]))
    if metric == "l2":  # both parameters act
        poor = neighbours.descend(v, 10, metric, connections=2, accuracy=9, rounds=1)
        assert neighbours.recall(poor, exact).first()[0] < neighbours.recall(good, exact).first()[0]
    with pytest.raises(ValueError):
        graph.distances(np.zeros((2, 2)), np.zeros((2, 2)), "manhattan")


def test_distances_of_copies_are_zero():
    x = np.random.default_rng(5).normal(1e3, 1e-3, (200, 64))
    d = graph.distances(np.concatenate([x, x]), x, "l2")
    assert (np.diag(d[:200]) == 0).all() and (np.diag(d[200:]) == 0).all() and d.min() >= 0
    assert (graph.distances(x, x, "cosine") >= 0).all()


def test_components_of_long_stacks(spark, monkeypatch):
    """More frames than directions: values and vectors are the dense ones, and nothing of frames x frames is made."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 8)) @ rng.normal(size=(8, 90)) * 3 + rng.normal(0, 0.3, (400, 90))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pixel long, vec array<double>").repartition(5)
    widths = []
    plain = graph.centred_product
    monkeypatch.setattr(graph, "centred_product", lambda m, v: (widths.append(v.shape[1]), plain(m, v))[1])
    s, v = graph.principal(df, 10)
    u, want, vt = np.linalg.svd(x - x.mean(1, keepdims=True), full_matrices=False)
    assert np.allclose(s, want[:10], rtol=1e-8) and max(widths) <= 20
    assert np.allclose(np.abs((v * vt[:10].T).sum(0))[:8], 1, atol=1e-6)
    assert graph.principal(df.where("false"), 10)[0].size == 0


def scene(spark, seed=7, frames=30):
    rng = np.random.default_rng(seed)
    masks = [np.zeros((12, 12), bool) for _ in range(3)]
    masks[0][2:7, 2:7], masks[1][4:9, 5:10], masks[2][0:3, 9:12] = True, True, True
    course = rng.random((3, frames)) * 3
    data = sum(m.ravel()[:, None] * c for m, c in zip(masks, course)) + 0.2 * rng.random((144, frames))
    w = spark.createDataFrame([(k, int(p), 1.0) for k, m in enumerate(masks) for p in np.flatnonzero(m.ravel())], "roi long, pixel long, weight double")
    p, f = np.divmod(np.arange(data.size), frames)
    return masks, course, data, w, spark.createDataFrame(pd.DataFrame({"pixel": p, "frame": f, "v": data.ravel()}))


@pytest.mark.parametrize("with_background", [False, True])
def test_demixing_by_relations_is_the_one_by_arrays(spark, with_background):
    masks, _, data, w, rows = scene(spark)
    inside = np.flatnonzero(np.any(masks, axis=0).ravel())
    course = np.abs(np.sin(np.arange(30))) + 0.1
    a = np.array([m.ravel()[inside] for m in masks], float)
    background = None
    if with_background:
        background = spark.createDataFrame([(int(p), int(t), float(v)) for p in inside for t, v in enumerate(course)], "pixel long, frame long, f double")
    got = demix.traces(w, rows, background, rounds=2).toPandas().pivot(index="roi", columns="frame", values="v").to_numpy()
    if not with_background:
        want = extract.demix(data[inside], a, 2)
    else:  # the two classes of overlapping regions have pixels of their own, so that they can be solved side by side
        want = extract.demix(data[inside], a, 2, course)
    assert np.allclose(got, want, rtol=1e-8)


def test_footprints_and_traces_are_both_solved(spark):
    masks, course, data, w, rows = scene(spark)
    weights, found = demix.factors(w, rows, 3)
    c = found.toPandas().pivot(index="roi", columns="frame", values="v").to_numpy()
    a = np.zeros((3, 144))
    p = weights.toPandas()
    a[p.roi, p.pixel] = p.weight
    assert np.allclose(a.max(1), 1) and (a[:, ~np.any(masks, axis=0).ravel()] == 0).all()
    assert all(np.corrcoef(x, y)[0, 1] > 0.95 for x, y in zip(c, course))
    inside = np.any(masks, axis=0).ravel()
    fixed = extract.demix(data[inside], np.array([m.ravel()[inside] for m in masks], float), 3)
    miss = lambda a, c: np.linalg.norm(data[inside] - a.T @ c)
    assert miss(a[:, inside], c) < miss(np.array([m.ravel()[inside] for m in masks], float), fixed)
    x, y = np.array([m.ravel() for m in masks], float), None  # the same updates by arrays
    d = data.copy()
    y = np.maximum(x @ d / x.sum(1, keepdims=True), 1e-11)
    for _ in range(3):
        y = np.maximum(y * (x @ d) / np.maximum(x @ x.T @ y, 1e-11), 1e-11)
        x = np.where(x > 0, np.maximum(x * (d @ y.T).T / np.maximum(y @ y.T @ x, 1e-11), 1e-11), 0)
        top = x.max(1, keepdims=True)
        x, y = x / top, y * top
    assert np.allclose(a, x, rtol=1e-6) and np.allclose(c, y, rtol=1e-6)


def test_ranks_and_elbow_by_ranges(spark):
    rng = np.random.default_rng(8)
    v = np.round(np.sort(rng.exponential(1, 3000)), 2)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(rng.permutation(v))], "i long, norm2 double").repartition(7)
    p = regions.seeds(df).orderBy("seed").toPandas()
    assert p.seed.tolist() == list(range(1, 3001)) and p.sort_values(["norm2", "i"], ascending=[False, True]).i.tolist() == p.i.tolist()
    got = regions.elbow(df, "norm2").first()[0]
    k, h = np.arange(3000), v[-1] - v[0]
    assert got == v[int(np.argmax(np.abs(2999 * (v - v[0]) - k * h)))]


@pytest.mark.parametrize("block", [512, 3])
def test_correlation_by_blocks(spark, block):
    rng = np.random.default_rng(9)
    x = rng.normal(5, 1, (11, 40))
    x[4] = 2.0
    there = rng.random((11, 40)) < 0.8
    there[7] = False
    there[7, :1] = True
    df = spark.createDataFrame([(int(k), int(t), float(x[k, t])) for k, t in np.argwhere(there)], "roi long, frame long, v double")
    got = {(r.a, r.b): r["corr"] for r in traces.correlation(df, block).collect()}
    for a in range(11):
        for b in range(a + 1, 11):
            both = there[a] & there[b]
            if not both.any():
                assert (a, b) not in got
            elif both.sum() == 1 or 4 in (a, b):
                assert got[a, b] is None
            else:
                assert got[a, b] == pytest.approx(np.corrcoef(x[a, both], x[b, both])[0, 1], abs=1e-9)


def test_large_tiles_have_the_spectra_of_small_ones(spark, monkeypatch):
    """The run's spectra by relations are those of one task a tile."""
    rng = np.random.default_rng(3)
    r, c = np.mgrid[:10, :10]
    data = rng.normal(0, 0.05, (10, 10, 30)) + sum(((r - a) ** 2 + (c - b) ** 2 <= 5)[..., None] * rng.random(30) for a, b in ((2, 2), (7, 6)))
    i, t = np.divmod(np.arange(3000), 30)
    frames = spark.createDataFrame(pd.DataFrame({"pixel": i, "row": i // 10, "col": i % 10, "frame": t, "v": data.ravel()}))
    config = pipeline.Config.load('{"eigen": {"num_eig": 4, "knn": 20, "normalize_w_k": 12}}')
    one = pipeline.spectra(frames, config, pipeline.Shape(10, 10, 30)).orderBy("pixel").toPandas()
    monkeypatch.setattr(pipeline, "TILE_PIXELS", 50)
    many = pipeline.spectra(frames, config, pipeline.Shape(10, 10, 30)).orderBy("pixel").toPandas()
    assert one.pixel.tolist() == many.pixel.tolist() and (one.box == many.box).all()
    for x, y in zip(np.stack(one.x).T, np.stack(many.x).T):
        assert min(abs(x - y).max(), abs(x + y).max()) < 1e-2 * abs(x).max()
