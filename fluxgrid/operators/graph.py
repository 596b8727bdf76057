"""Nearest neighbours, self-tuning affinities, normalisations and spectra of vectors(i, x)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Between all rows of x and of y: l2 (squared), ip (1 - dot) or cosine (1 - cosine), none below 0 but those of ip.

    Squares of differences, summed in pieces of bounded size: a vector is at distance 0 from its copy, and equal pairs have equal
    distances whatever the number of rows.
    """
    if metric == "l2":
        out = np.empty((len(x), len(y)))
        step = max(1, 4_000_000 // max(1, y.size))
        for s in range(0, len(x), step):
            diff = x[s : s + step, None, :] - y
            out[s : s + step] = np.einsum("abk,abk->ab", diff, diff)
        return out
    if metric == "ip":
        return 1 - x @ y.T
    if metric == "cosine":
        x, y = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) for v in (x, y))
        return np.maximum(1 - x @ y.T, 0)
    raise ValueError(f"metric {metric} isn't known")


def pair_distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Between each row of x and that of y: what distances() has for l2 and ip; a vector is at cosine distance 0 from its copy."""
    if metric == "l2":
        diff = x - y
        return np.einsum("ak,ak->a", diff, diff)
    dot = np.einsum("ak,ak->a", x, y)
    if metric == "ip":
        return 1 - dot
    return np.maximum(1 - dot / np.maximum(np.sqrt(np.einsum("ak,ak->a", x, x) * np.einsum("ak,ak->a", y, y)), 1e-300), 0)


def closest(x: np.ndarray, xi: np.ndarray, y: np.ndarray, yi: np.ndarray, k: int, metric: str = "l2", cells: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, d): numbers and distances of the k nearest rows of y for each row of x; ties by number.

    A product of 32-bit matrices, tile by tile, tells distances but for rounding. A share of the columns bounds the k-th distance of a
    row, what is within the bound tells the k-th but for the product's error, and what is within that error is measured again by
    pair_distances(), so that the result doesn't depend on the product. Of equal rows of y the first k by number are enough.
    """
    if metric not in ("l2", "ip", "cosine"):
        raise ValueError(f"metric {metric} isn't known")
    order = np.argsort(yi, kind="stable")
    y, yi = np.ascontiguousarray(y[order]), yi[order]
    _, kind = np.unique(y.view(np.dtype((np.void, max(1, y.shape[1]) * 8))).ravel(), return_inverse=True) if y.shape[1] else (None, np.zeros(len(y), int))
    by = np.argsort(kind, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], np.diff(kind[by]) > 0]))
    copy = np.empty(len(y), int)
    copy[by] = np.arange(len(y)) - np.repeat(start, np.diff(np.append(start, len(y))))
    kept = copy < k
    if metric == "cosine":
        kept |= ~y.any(1)  # nothing is at distance 0 from such a vector but itself
    y, yi = y[kept], yi[kept]
    k, n = min(k, len(y)), len(y)
    u, w = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) for v in (x, y)) if metric == "cosine" else (x, y)
    raw = float(np.sqrt(max((u * u).sum(1).max(), (w * w).sum(1).max())))
    centre = w.mean(0)  # what it adds is the same for all rows of y
    u, w = u - centre if metric == "l2" else u, w - centre
    long, square = np.sqrt((u * u).sum(1)), (w * w).sum(1)
    most = float(np.sqrt(square.max()))
    unit = max(float(long.max()), most, 1e-150)
    long, most, raw = long / unit, most / unit, raw / unit
    rounding = (w.shape[1] + 8) * (2 * long * most + most * most)
    error = 4 * np.finfo(np.float32).eps * rounding + 8 * np.finfo(float).eps * (rounding + (w.shape[1] + 8) * (2 * raw * (long + most) + (metric != "l2") / unit / unit))
    error = np.minimum(error, np.finfo(np.float32).max).astype(np.float32)[:, None]
    u, w = (u / unit).astype(np.float32), (w / unit).astype(np.float32)
    if metric == "l2":
        u, w = np.column_stack([-2 * u, np.ones(len(u), np.float32)]), np.column_stack([w, (square / unit / unit).astype(np.float32)])
    else:
        u = -u
    share = np.ascontiguousarray(w[:: max(1, n // max(4096, 8 * k))])
    out, rows = [], max(1, min(256, cells // min(n, 4096)))
    width = max(1, cells // rows)
    for s in range(0, len(x), rows):
        own, more = u[s : s + rows], error[s : s + rows]
        limit = np.partition(own @ share.T, k - 1, axis=1)[:, k - 1 :][:, :1] + more
        found = []
        for t in range(0, n, width):
            rough = own @ w[t : t + width].T
            at = np.flatnonzero(rough <= limit)
            r, c = np.divmod(at, rough.shape[1])
            found.append((r, c + t, rough.ravel()[at]))
        r, c, rough = (np.concatenate(z) for z in zip(*found))
        if len(r):
            order = np.lexsort((rough, r))
            r, c, rough = r[order], c[order], rough[order]
            first = np.searchsorted(r, np.arange(len(own)))
            last = np.minimum(np.append(first[1:], len(r)), first + k) - 1
            near = rough <= rough[np.maximum(last, 0)][r] + more[r, 0]
            r, c = r[near], c[near]
        d = np.empty(len(r))
        for a in range(0, len(r), 1 << 16):
            z = slice(a, a + (1 << 16))
            d[z] = pair_distances(x[s + r[z]], y[c[z]], metric)
        if metric != "ip":
            d[xi[s + r] == yi[c]] = 0
        order = np.lexsort((c, d, r))
        first = np.searchsorted(r, np.arange(len(own)))
        order = order[np.arange(len(r)) - first[r] < k]  # r goes up, so that a row's candidates keep their places
        out.append((xi[s + r[order]], yi[c[order]], d[order]))
    return tuple(np.concatenate(z) for z in zip(*out))


#: Blocks of vectors from which more vectors make larger blocks and not more, and numbers that a block may hold at most.
BLOCKS, BLOCK_NUMBERS = 12, 1 << 22


def block_count(n: int, dim: int, block: int) -> int:
    """Blocks of n vectors: of `block` vectors at first; a vector is sent once to each block, so beyond BLOCKS they grow as far as memory
    goes, to 65,536 vectors or BLOCK_NUMBERS numbers."""
    return max(1, min(-(-n // block), BLOCKS), -(-n // max(1, min(1 << 16, BLOCK_NUMBERS // max(1, dim)))))


def nearest(vectors: DataFrame, k: int, metric: str = "l2", queries: DataFrame | None = None, block: int = 1024) -> DataFrame:
    """(i, j, d, rank): the k nearest of all vectors for each query, itself included; ties by number.

    Blocks of vectors meet blocks of queries in numpy; each keeps its k best, and those are ranked, so that a task holds two
    blocks whatever the number of vectors. Metrics: l2 (squared), ip (1 - dot) and cosine (1 - cosine).
    """
    queries = vectors if queries is None else queries
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dim")).first()
    dim = size.dim or 1
    n_blocks = block_count(size.n, dim, block)
    q_blocks = n_blocks if queries is vectors else block_count(queries.count(), dim, block)
    left = queries.select(F.lit(True).alias("q"), "i", "x", F.pmod(F.xxhash64("i"), F.lit(q_blocks)).alias("a")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    right = vectors.select(F.lit(False).alias("q"), "i", "x", F.pmod(F.xxhash64("i"), F.lit(n_blocks)).alias("b")).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    both = left.select("q", "i", "x", F.col("a").cast("int"), F.col("b").cast("int")).unionByName(right.select("q", "i", "x", F.col("a").cast("int"), F.col("b").cast("int")))

    def best(t: pa.Table) -> pa.Table:
        own = t.column("q").to_numpy()
        x = t.column("x").combine_chunks().flatten().to_numpy().astype(float).reshape(len(own), -1)
        ids = t.column("i").to_numpy()
        found = closest(x[own], ids[own], x[~own], ids[~own], k, metric) if own.any() and not own.all() else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({c: pa.array(v, kind) for c, v, kind in zip("ijd", found, (pa.int64(), pa.int64(), pa.float64()))})

    found = both.groupBy("a", "b").applyInArrow(best, "i long, j long, d double")
    w = Window.partitionBy("i").orderBy("d", "j")
    return found.withColumn("rank", F.row_number().over(w)).where(f"rank <= {k}")


def affinity(neighbours: DataFrame, scale_rank: int) -> DataFrame:
    """(i, j, w): exp(-d / sqrt(s_i s_j)), s_i being the distance to the neighbour of a rank; 0 to itself. The neighbours are read three
    times: their lineage should be cut before."""
    scale = neighbours.where(f"rank = {scale_rank}").select("i", (F.col("d") + 1e-9).alias("s"))
    e = neighbours.join(scale, "i").join(scale.select(F.col("i").alias("j"), F.col("s").alias("sj")), "j")
    return e.select("i", "j", F.expr("case when i = j then 0 else exp(-d / sqrt(s * sj)) end").cast("double").alias("w"))


def symmetric(edges: DataFrame) -> DataFrame:
    """(K + K') / 2."""
    return edges.unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")).groupBy("i", "j").agg((F.sum("w") / 2).alias("w"))


def degree(edges: DataFrame) -> DataFrame:
    d = edges.groupBy("i").agg(F.sum("w").alias("degree"))
    return d.withColumns({"inverse": 1 / (F.col("degree") + 1e-9), "root": F.sqrt("degree"), "inverse_root": 1 / F.sqrt(F.col("degree") + 1e-9)})


def random_walk(edges: DataFrame) -> DataFrame:
    return edges.join(degree(edges).select("i", "inverse"), "i").select("i", "j", (F.col("w") * F.col("inverse")).alias("p"))


def laplacian(edges: DataFrame) -> DataFrame:
    """I - P in long form."""
    p = random_walk(edges).select("i", "j", (-F.col("p")).alias("l"))
    return p.unionByName(edges.select("i").distinct().select("i", F.col("i").alias("j"), F.lit(1.0).alias("l"))).groupBy("i", "j").agg(F.sum("l").alias("l"))


#: Vertices of a single graph up to which one task solves it.
TASK_VERTICES = 1 << 14
#: Vertices of a graph up to which its whole spectrum is solved; larger ones get the leading vectors alone, from sparse rows.
DENSE_VERTICES = 800


class Sparse:
    """A symmetric matrix as rows of (column, weight); products go block by block, so that memory follows the entries."""

    def __init__(self, i: np.ndarray, j: np.ndarray, w: np.ndarray, n: int):
        order = np.lexsort((j, i))
        self.j, self.w, self.n = j[order], w[order], n
        self.at = np.concatenate([[0], np.cumsum(np.bincount(i, minlength=n))])

    def sums(self) -> np.ndarray:
        return np.bincount(np.repeat(np.arange(self.n), np.diff(self.at)), self.w, self.n)

    def scaled(self, r: np.ndarray) -> Sparse:
        out = object.__new__(Sparse)
        out.j, out.at, out.n = self.j, self.at, self.n
        out.w = self.w * np.repeat(r, np.diff(self.at)) * r[self.j]
        return out

    def dot(self, x: np.ndarray, most: int = 1 << 22) -> np.ndarray:
        out = np.zeros((self.n, x.shape[1]))
        a = 0
        while a < self.n:
            z = min(self.n, max(a + 1, int(np.searchsorted(self.at, self.at[a] + most // x.shape[1], "right")) - 1))
            lo, hi = self.at[a], self.at[z]
            if hi > lo:
                full = np.flatnonzero(np.diff(self.at[a : z + 1]))
                out[a + full] = np.add.reduceat(self.w[lo:hi, None] * x[self.j[lo:hi]], self.at[a + full] - lo, axis=0)
            a = z
        return out

    def dense(self) -> np.ndarray:
        out = np.zeros((self.n, self.n))
        np.add.at(out, (np.repeat(np.arange(self.n), np.diff(self.at)), self.j), self.w)
        return out


def leading(a: Sparse, k: int, tolerance: float = 1e-4, rounds: int = 60, depth: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix and their vectors, by a restarted block Krylov space: a block and its products
    with the matrix span a space, whose best vectors begin the next one. Stops when no residual is above the tolerance, and raises
    RuntimeError if that takes more rounds than given. Up to DENSE_VERTICES the whole spectrum is solved, which is exact."""
    if a.n <= max(DENSE_VERTICES, 4 * k):
        values, v = np.linalg.eigh(a.dense())
        order = np.argsort(-values, kind="stable")[:k]
        return values[order], v[:, order]
    width = k + 8
    x = np.linalg.qr(np.random.default_rng(3).normal(size=(a.n, width)))[0]
    for _ in range(rounds):
        blocks = [x]
        for _ in range(depth):
            y = a.dot(blocks[-1])
            for _ in range(2):
                for b in blocks:
                    y -= b @ (b.T @ y)
            blocks.append(np.linalg.qr(y)[0])
        q = np.linalg.qr(np.concatenate(blocks, axis=1))[0]
        aq = a.dot(q)
        values, s = np.linalg.eigh(q.T @ aq)
        order = np.argsort(-values)[:width]
        x, ax = q @ s[:, order], aq @ s[:, order]
        if np.linalg.norm(ax[:, :k] - x[:, :k] * values[order][:k], axis=0).max() < tolerance:
            return values[order][:k], x[:, :k]
    raise RuntimeError(f"the leading {k} vectors didn't settle in {rounds} rounds")


def walk_vectors(edges: Sparse, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading values of the normalised walk, and the k - 1 vectors behind the trivial one."""
    r = 1 / np.sqrt(edges.sums() + 1e-9)
    values, v = leading(edges.scaled(r), min(k, edges.n))
    return values, (v * r[:, None])[:, 1:]


def eigenvectors(edges: DataFrame, k: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, i, x, values): the k - 1 leading non-trivial vectors of the normalised walk of each group's graph; one group a task.

    A group is a tile of a time block, so that its graph has a bounded number of cells. The graph stays sparse. A single graph (no keys)
    of more than TASK_VERTICES vertices is solved by many tasks, to the same tolerance.
    """
    if not keys and edges.select("i").distinct().count() > TASK_VERTICES:
        from fluxgrid.operators import spectrum

        return spectrum.walk_vectors(edges, k, 1e-4)
    rows = edges.withColumn("__g", F.lit(0)) if not keys else edges
    by = list(keys) or ["__g"]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([pdf.i, pdf.j]))
        graph = Sparse(np.searchsorted(ids, pdf.i), np.searchsorted(ids, pdf.j), pdf.w.to_numpy(), len(ids))
        values, x = walk_vectors(graph, k)
        out = pd.DataFrame({"i": ids, "x": list(x), "values": [values.tolist()] * len(ids)})
        for c in by:
            out[c] = pdf[c].iloc[0]
        return out

    kinds = dict(rows.dtypes)
    out = rows.groupBy(*by).applyInPandas(solve, ", ".join(f"{c} {kinds[c]}" for c in by) + ", i long, x array<double>, values array<double>")
    return out if keys else out.drop("__g")


def near_rows(x: np.ndarray, k: int, metric: str = "l2", block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Indices and distances of the k nearest rows for each row, itself included, by blocks of rows; ties by index."""
    if metric not in ("l2", "ip", "cosine"):
        raise ValueError(f"metric {metric} isn't known")
    if metric == "cosine":
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    n, k, sq = len(x), min(k, len(x)), (x * x).sum(1)
    at, near = np.empty((n, k), np.int64), np.empty((n, k))
    for a in range(0, n, block):
        dot = x[a : a + block] @ x.T
        d = np.maximum(sq[a : a + block, None] + sq - 2 * dot, 0) if metric == "l2" else 1 - dot
        own = np.arange(len(d))
        if metric != "ip":
            d[own, a + own] = 0
        limit = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        if k < n:
            d = np.where(d <= limit, d, np.inf)
        best = np.argpartition(d, k - 1, axis=1)[:, :k] if k < n else np.tile(np.arange(n), (len(d), 1))
        order = np.lexsort((best, np.take_along_axis(d, best, 1)), axis=1)
        at[a : a + block] = np.take_along_axis(best, order, 1)
        near[a : a + block] = np.take_along_axis(d, at[a : a + block], 1)
    return at, near


def affinities(x: np.ndarray, knn: int, scale_column: int, metric: str = "l2") -> Sparse:
    """Symmetric self-tuning affinities of rows: the scale of a row is its distance in a column of its sorted neighbours, of which
    column 0 is the row itself."""
    at, near = near_rows(x, knn, metric)
    n, k = at.shape
    scale = near[:, min(scale_column, k - 1)] + 1e-9
    w = np.exp(-near / np.sqrt(scale[:, None] * scale[at])) / 2
    w[at == np.arange(n)[:, None]] = 0
    i, j = np.repeat(np.arange(n), k), at.ravel()
    key = np.concatenate([i * n + j, j * n + i])
    pairs, where = np.unique(key, return_inverse=True)
    return Sparse(pairs // n, pairs % n, np.bincount(where, np.concatenate([w.ravel(), w.ravel()])), n)


def tile_spectra(vectors: DataFrame, keys: tuple[str, ...], k: int, knn: int, scale_column: int, metric: str = "l2") -> DataFrame:
    """(keys, pixel, x): affinities and leading walk vectors of vectors(keys, pixel, x); a group is a task from vectors to spectrum, so
    that no edge is shuffled."""
    kinds = dict(vectors.dtypes)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pixel")
        _, x = walk_vectors(affinities(np.stack(pdf.x.to_numpy()).astype(float), knn, scale_column, metric), k)
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in keys}, "pixel": pdf.pixel.to_numpy(), "x": list(x)})

    return vectors.select(*keys, "pixel", "x").groupBy(*keys).applyInPandas(solve, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", pixel long, x array<double>")


def stack_blocks(spectra: DataFrame, block: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, pixel, x): the vectors of all time blocks of a pixel, one behind the other in order of the block."""
    rows = spectra.groupBy(*keys, "pixel").agg(F.array_sort(F.collect_list(F.struct(block, "x"))).alias("b"))
    return rows.select(*keys, "pixel", F.flatten(F.transform("b", lambda s: s["x"])).alias("x"))


def norms(spectra: DataFrame, key: str = "i", first: int = 0) -> DataFrame:
    """(key, norm): length of each vector from its column `first` on; saved vectors may still have the trivial one in column 0."""
    part = F.slice("x", first + 1, 1 << 30)
    return spectra.select(key, F.sqrt(F.aggregate(part, F.lit(0.0), lambda s, v: s + v * v)).alias("norm"))


def box_scale(image: DataFrame, column: str = "norm", box: str = "box") -> DataFrame:
    """A column times 10 over its mean in each box, so that boxes can be shown side by side."""
    mean = image.groupBy(box).agg(F.avg(column).alias("__m"))
    return image.join(F.broadcast(mean), box).withColumn("scaled", F.col(column) * 10 / F.col("__m")).drop("__m")


def one_vector(spectra: DataFrame, k: int) -> DataFrame:
    """(i or pixel, v): the k-th vector, from 0."""
    return spectra.select(spectra.columns[0], F.element_at("x", k + 1).alias("v"))


def squared_norm(vectors: DataFrame) -> DataFrame:
    return vectors.select("i", F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v).alias("norm2"))


def checkpoint_folder(spark) -> str:
    """The session's checkpoint folder: spark.checkpoint.dir, or a temporary one on a single machine. A cluster without one is refused,
    since its executors don't share a local folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the session's checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, component): smallest reachable node, by alternating large-star and small-star steps with a checkpoint each."""
    cur, before = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), None
    cur = cut_lineage(cur)
    for _ in range(60):  # every round halves the distances to the smallest node, at least
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        down = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        cur = cut_lineage(down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = cur.groupBy("a").agg(F.min("b").alias("root"))
    return nodes.select("v").distinct().join(roots, F.col("v") == F.col("a"), "left").select("v", F.coalesce("root", "v").alias("component"))


def centred_product(matrix: DataFrame, v: np.ndarray) -> np.ndarray:
    """X' X v of the pixel vectors centred over time, X; tasks sum up their own pixels, and a few tasks their sums."""
    n, width = v.shape

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, width))
        for b in batches:
            x = np.array(b.column("vec").to_pylist(), float).reshape(-1, n)
            x = x - x.mean(1, keepdims=True)
            total += x.T @ (x @ v)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, width))
        for b in batches:
            for raw in b.column("s").to_pylist():
                total += np.frombuffer(raw).reshape(n, width)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    sums = matrix.select("vec").mapInArrow(part, "s binary")
    return sum((np.frombuffer(r.s).reshape(n, width) for r in sums.repartition(8).mapInArrow(add, "s binary").collect()), np.zeros((n, width)))


def principal(matrix: DataFrame, most: int = 100, tolerance: float = 1e-9, rounds: int = 100, depth: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The `most` largest singular values of the pixel vectors centred over time, and their directions in time.

    A random block of directions and its products with X' X span a space, whose best directions begin the next one. The driver holds
    frames x (most + 10) numbers a few times, and nothing of frames x frames. Raises RuntimeError without convergence.
    """
    first = matrix.select(F.size("vec").alias("n")).first()
    n = first.n if first else 0
    if not n:
        return np.zeros(0), np.zeros((0, 0))
    width = min(n, most + 10)
    x = np.linalg.qr(np.random.default_rng(5).normal(size=(n, width)))[0]
    ax = centred_product(matrix, x)
    for _ in range(rounds):
        q, aq = x, ax
        for _ in range(depth if width < n else 0):
            y = aq[:, -width:]
            for _ in range(2):
                y = y - q @ (q.T @ y)
            y = np.linalg.qr(y)[0][:, : n - q.shape[1]]
            if not y.shape[1]:
                break
            q, aq = np.concatenate([q, y], axis=1), np.concatenate([aq, centred_product(matrix, y)], axis=1)
            width_now = y.shape[1]
            if width_now < width:
                break
        h = q.T @ aq
        values, s = np.linalg.eigh((h + h.T) / 2)
        s, values = s[:, ::-1][:, :width], values[::-1][:width]
        x, ax = q @ s, aq @ s
        k = min(most, n)
        if np.linalg.norm(ax[:, :k] - x[:, :k] * values[:k], axis=0).max() <= tolerance * max(values[0], 1e-300):
            return np.sqrt(np.maximum(values[:k], 0)), x[:, :k]
    raise RuntimeError(f"{most} principal components didn't settle in {rounds} rounds")


def elbow_value(values: np.ndarray) -> float:
    """The value farthest from the line between the first and the last of a sequence."""
    n = len(values)
    if n < 2:
        return float(values[0]) if n else 0.0
    h = values[-1] - values[0]
    return float(values[int(np.argmax(np.abs((n - 1) * (values - values[0]) - np.arange(n) * h)))])


def principal_values(matrix: DataFrame, most: int = 100) -> DataFrame:
    """(k, value, kept): the `most` largest singular values of the centred pixel x time matrix; those above their elbow are kept."""
    s, _ = principal(matrix, most)
    limit = elbow_value(s)
    return matrix.sparkSession.createDataFrame([(k, float(round(v, 6)), bool(v > limit)) for k, v in enumerate(s)], "k long, value double, kept boolean")


def principal_vectors(matrix: DataFrame, most: int = 100) -> DataFrame:
    """(keys of matrix, x): vec projected on the principal directions whose singular value is above the elbow of the first `most`; at most
    `most` directions of a stack's number of frames go to all workers."""
    s, v = principal(matrix, most)
    kept = np.flatnonzero(s > elbow_value(s))
    v = np.ascontiguousarray(v[:, kept if len(kept) else [0]]) if len(s) else np.zeros((0, 0))
    rest = [c for c in matrix.columns if c != "vec"]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("vec").to_pylist(), float).reshape(-1, len(v))
            x = (x - x.mean(1, keepdims=True)) @ v
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(list(x), pa.list_(pa.float64()))], [*rest, "x"])

    kinds = dict(matrix.dtypes)
    return matrix.select(*rest, "vec").mapInArrow(project, ", ".join([*(f"{c} {kinds[c]}" for c in rest), "x array<double>"]))
