"""Leading eigenvectors of one large graph as a Spark job of many tasks.

The normalised matrix is a relation of tiles (rows of BLOCK vertices by columns of BLOCK vertices). The vectors are a relation too, one
row for each block of vertices. A product sends every tile the vector rows it needs and sums up what its row block gets; a block Krylov
space grows by one product at a time, is kept orthogonal by Gram matrices that tasks sum up, and is cut back to its best vectors when
it gets too wide. The driver holds matrices of the space's width only, and no task holds the graph.

Tight groups of vertices that hardly anything leaves have values near 1, a further one each, and larger graphs have more of them. A space
that is narrower than their number settles slowly, so it starts with the leading vectors of the graph of such groups.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxgrid.operators.graph import checkpoint_folder, components, cut_lineage, degree

#: Vertices of a block, and vectors that are multiplied at once.
BLOCK, WIDTH = 4096, 16
#: Blocks from which more vertices make larger blocks and not more, and vertices of a block at most: a product sends a block each row that
#: it needs once, so few blocks send less.
BLOCKS, MOST = 8, 1 << 16
#: Directions of a new block below this share of its longest are taken for rounding errors.
NOISE = 1e-10
#: Share of a vertex's largest weight from which an entry keeps two vertices in one group, entries of a vertex that are joined at first,
#: and groups that are told apart at most: those that least leaves.
STRONG, FIRST, GROUPS = 0.1, 3, 2048


class Tables:
    """Tables written to the checkpoint folder, so that a lost executor costs a reread."""

    def __init__(self, spark):
        self.spark, self.root = spark, f"{checkpoint_folder(spark)}/spectrum-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def numbered(rows: DataFrame, by: list[str], tables: Tables, name: str) -> DataFrame:
    """rows with `at`, their place from 0 in the order of `by`; sorted by ranges, so that no task holds all."""
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__seq", F.monotonically_increasing_id())
    ranged = tables.put(ranged.withColumn("__range", F.shiftright("__seq", 33)), name)
    starts = ranged.groupBy("__range").agg(F.min("__seq").alias("__first"), F.count("*").alias("__n"))  # a row for each partition
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("__range", (before - F.col("__first")).alias("__shift"))
    return ranged.join(F.broadcast(starts), "__range").withColumn("at", F.col("__seq") + F.col("__shift")).drop("__range", "__seq", "__shift")


def _matrix(raw: bytes, rows: int) -> np.ndarray:
    x = np.frombuffer(raw, np.float64)
    return x.reshape(rows, len(x) // rows if rows else 0)


def _tile(table: pa.Table, block: int) -> pa.Table:
    """The entries of a tile: row, place among the needed columns, weight; sorted by row."""
    a, b, w = (table.column(c).to_numpy() for c in ("a", "b", "w"))
    order = np.lexsort((b, a))
    need, col = np.unique(b[order] % block, return_inverse=True)
    columns = [(a[order] % block).astype(np.int32), col.astype(np.int32), need.astype(np.int32), w[order].astype(np.float64)]
    return pa.table({"dst": table.column("dst")[:1], "src": table.column("src")[:1], **{n: pa.array([c.tobytes()], pa.binary()) for n, c in zip(("row", "col", "need", "w"), columns)}})


def product(row: np.ndarray, col: np.ndarray, w: np.ndarray, x: np.ndarray, out: np.ndarray, most: int = 1 << 22) -> None:
    """Adds a tile's product with vectors to the rows of its block, in pieces of bounded size."""
    step = max(1, most // max(1, x.shape[1]))
    for s in range(0, len(row), step):
        r = row[s : s + step]
        first = np.flatnonzero(np.concatenate([[True], np.diff(r) > 0]))
        out[r[first]] += np.add.reduceat(w[s : s + step, None] * x[col[s : s + step]], first, axis=0)


class Graph:
    """The normalised symmetric matrix of edges(i, j, w): vertices (i, at, scale) and tiles."""

    def __init__(self, edges: DataFrame, block: int = BLOCK):
        self.tables = Tables(edges.sparkSession)
        scale = degree(edges).select("i", F.col("inverse_root").alias("scale"))
        both = edges.select("i").union(edges.select(F.col("j").alias("i"))).distinct().join(scale, "i", "left").fillna(0.0, ["scale"])
        self.vertices = self.tables.put(numbered(both, ["i"], self.tables, "ranged"), "vertices")
        self.n = n = self.vertices.count()
        self.block = block = max(block, min(MOST, -(-n // BLOCKS)))
        self.rows = lambda b: min(block, n - b * block)  # vertices of a block
        v = self.vertices
        e = edges.join(v.select("i", F.col("at").alias("a"), F.col("scale").alias("ra")), "i").join(v.select(F.col("i").alias("j"), F.col("at").alias("b"), F.col("scale").alias("rb")), "j")
        e = e.select("a", "b", (F.col("w") * F.col("ra") * F.col("rb")).alias("w"), F.expr(f"a div {block}").alias("dst"), F.expr(f"b div {block}").alias("src"))
        kind = "dst long, src long, row binary, col binary, need binary, w binary"
        self.tiles = self.tables.put(e.groupBy("dst", "src").applyInArrow(lambda t: _tile(t, block), kind), "tiles")
        self.blocks = edges.sparkSession.range(-(-self.n // block)).withColumnRenamed("id", "b")

    def step(self, state: DataFrame, change: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int) -> DataFrame:
        """state(b, q, y) after the space was changed to change(q, y), whose last `width` columns were multiplied into the new y."""
        rows, send_kind = self.rows, "dst long, src long, x binary"

        def send(key: tuple, tiles: pa.Table, own: pa.Table) -> pa.Table:
            b = key[0].as_py()
            q = change(_matrix(own.column("q")[0].as_py(), rows(b)), _matrix(own.column("y")[0].as_py(), rows(b)))
            last = q[:, q.shape[1] - width :]
            needs = [np.frombuffer(x, np.int32) for x in tiles.column("need").to_pylist()]
            raw = [np.ascontiguousarray(q).tobytes(), *(np.ascontiguousarray(last[x]).tobytes() for x in needs)]
            return pa.table({"dst": pa.array([b, *tiles.column("dst").to_pylist()], pa.int64()), "src": pa.array([-1, *[b] * len(needs)], pa.int64()), "x": pa.array(raw, pa.binary())})

        def gather(key: tuple, tiles: pa.Table, got: pa.Table) -> pa.Table:
            b, parts = key[0].as_py(), dict(zip(got.column("src").to_pylist(), got.column("x").to_pylist()))
            y = np.zeros((rows(b), width))
            for s, *raw in zip(*(tiles.column(c).to_pylist() for c in ("src", "row", "col", "w"))):
                row, col, w = (np.frombuffer(x, t) for x, t in zip(raw, (np.int32, np.int32, np.float64)))
                product(row, col, w, np.frombuffer(parts[s], np.float64).reshape(-1, width), y)
            return pa.table({"b": pa.array([b], pa.int64()), "q": pa.array([parts[-1]], pa.binary()), "y": pa.array([y.tobytes()], pa.binary())})

        sent = self.tiles.select("src", "dst", "need").groupBy("src").cogroup(state.withColumnRenamed("b", "src").groupBy("src")).applyInArrow(send, send_kind)
        return self.tiles.groupBy("dst").cogroup(sent.groupBy("dst")).applyInArrow(gather, "b long, q binary, y binary")

    def meet(self, vectors: DataFrame, found: Callable[..., dict[str, np.ndarray]], kind: str) -> DataFrame:
        """found(x, row, w, y) of each block: its vectors(b, x), and the rows, weights and other ends' vectors of its entries."""
        rows = self.rows

        def send(key: tuple, tiles: pa.Table, own: pa.Table) -> pa.Table:
            b = key[0].as_py()
            x = _matrix(own.column("x")[0].as_py(), rows(b))
            raw = [x.tobytes(), *(x[np.frombuffer(z, np.int32)].tobytes() for z in tiles.column("need").to_pylist())]
            return pa.table({"dst": pa.array([b, *tiles.column("dst").to_pylist()], pa.int64()), "src": pa.array([-1, *[b] * len(tiles)], pa.int64()), "x": pa.array(raw, pa.binary())})

        def gather(key: tuple, tiles: pa.Table, got: pa.Table) -> pa.Table:
            parts = dict(zip(got.column("src").to_pylist(), got.column("x").to_pylist()))
            x = _matrix(parts[-1], rows(key[0].as_py()))
            row, w, y = [np.zeros(0, np.int32)], [np.zeros(0)], [x[:0]]
            for s, *raw in zip(*(tiles.column(c).to_pylist() for c in ("src", "row", "col", "w"))):
                r, c, v = (np.frombuffer(z, t) for z, t in zip(raw, (np.int32, np.int32, np.float64)))
                row.append(r)
                w.append(v)
                y.append(np.frombuffer(parts[s], np.float64).reshape(-1, x.shape[1])[c])
            return pa.table(found(x, *map(np.concatenate, (row, w, y))))

        sent = self.tiles.select("src", "dst", "need").groupBy("src").cogroup(vectors.withColumnRenamed("b", "src").groupBy("src")).applyInArrow(send, "dst long, src long, x binary")
        return self.tiles.groupBy("dst").cogroup(sent.groupBy("dst")).applyInArrow(gather, kind)

    def packed(self, rows: DataFrame) -> DataFrame:
        """vectors(b, x) of rows(at, x), x being an array of the same length for every vertex."""
        block = self.block

        def pack(key: tuple, t: pa.Table) -> pa.Table:
            x = t.column("x").combine_chunks().flatten().to_numpy().reshape(len(t), -1)[np.argsort(t.column("at").to_numpy())]
            return pa.table({"b": pa.array([key[0].as_py()], pa.int64()), "x": pa.array([np.ascontiguousarray(x, float).tobytes()], pa.binary())})

        return rows.select(F.expr(f"at div {block}").alias("b"), "at", "x").groupBy("b").applyInArrow(pack, "b long, x binary")

    def groups(self) -> tuple[DataFrame, DataFrame]:
        """(at, label, root): the group of each vertex, which its strong entries don't leave, and the root of its degree; (a, b, w): sums of
        the weights between two groups and within one."""
        v = self.vertices.select("at", F.when(F.col("scale") > 0, 1 / F.col("scale")).otherwise(0.0).alias("root"))
        first = cut_lineage(self.meet(self.packed(v.select("at", F.array(F.col("at").cast("double")).alias("x"))), _firsts, "a long, b long"))
        part = components(v.select(F.col("at").alias("v")), first).select(F.col("v").alias("at"), F.col("component").alias("part"))
        v = cut_lineage(v.join(part, "at"))
        # a few entries of each vertex join almost all of a group; other strong ones join what is left
        own = F.array(*(F.col(c).cast("double") for c in ("at", "part", "root"))).alias("x")
        between = cut_lineage(self.meet(self.packed(v.select("at", own)), _between, "a long, b long, w double, strong boolean"))
        whole = cut_lineage(components(v.select(F.col("part").alias("v")), between.where("strong and a <> b").select("a", "b")))
        a, b = (whole.select(F.col("v").alias(c), F.col("component").alias(f"{c}_whole")) for c in "ab")
        sums = between.join(a, "a").join(b, "b").groupBy(F.col("a_whole").alias("a"), F.col("b_whole").alias("b")).agg(F.sum("w").alias("w"))
        return v.join(whole.select(F.col("v").alias("part"), F.col("component").alias("label")), "part").select("at", "label", "root"), sums

    def coarse(self, width: int, seed: int) -> DataFrame:
        """state(b, q, y) without a space, y being the leading vectors of the graph of groups and, if those are too few, random ones.

        Of more than GROUPS groups, those of which the least weight leaves are told apart, and the others are one.
        """
        v, between = map(cut_lineage, self.groups())
        total = v.groupBy("label").agg(F.sum(F.col("root") * F.col("root")).alias("total"))
        inner = between.where("a = b").select(F.col("a").alias("label"), F.col("w").alias("inner"))
        kept = total.join(inner, "label", "left").select("label", (F.coalesce("inner", F.lit(0.0)) / F.greatest("total", F.lit(1e-300))).alias("stays")).orderBy(F.desc("stays"), "label").limit(GROUPS - 1).select("label", F.lit(True).alias("kept"))
        kept = cut_lineage(kept)
        for c in "ab":
            between = between.join(F.broadcast(kept.withColumnRenamed("label", c).withColumnRenamed("kept", f"{c}_kept")), c, "left").withColumn(c, F.when(F.col(f"{c}_kept"), F.col(c)).otherwise(-1))
        v = v.join(F.broadcast(kept), "label", "left").withColumn("label", F.when(F.col("kept"), F.col("label")).otherwise(-1)).drop("kept")
        entries = between.groupBy("a", "b").agg(F.sum("w").alias("w"))
        sums = v.groupBy("label").agg(F.sum(F.col("root") * F.col("root")).alias("w"))
        few = entries.unionByName(sums.select(F.lit(-2).cast("long").alias("a"), F.col("label").alias("b"), "w"))

        def solve(t: pa.Table) -> pa.Table:
            a, b, w = (t.column(c).to_numpy() for c in ("a", "b", "w"))
            ids = np.sort(b[a == -2])
            size = np.zeros(len(ids))
            size[np.searchsorted(ids, b[a == -2])] = w[a == -2]
            r = np.where(size > 0, 1 / np.sqrt(np.maximum(size, 1e-300)), 0)
            m, e = np.zeros((len(ids), len(ids))), a != -2
            np.add.at(m, (np.searchsorted(ids, a[e]), np.searchsorted(ids, b[e])), w[e])
            m *= r[:, None] * r
            x = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1][:, :width] * r[:, None]
            return pa.table({"label": ids, "x": pa.array(list(x), pa.list_(pa.float64()))})

        solved = few.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(solve, "label long, x array<double>")
        x = v.join(F.broadcast(cut_lineage(solved)), "label").select("at", F.transform("x", lambda z: z * F.col("root")).alias("x"))
        rows = self.rows

        def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                y = []
                for b, raw in zip(batch.column("b").to_pylist(), batch.column("x").to_pylist()):
                    own = _matrix(raw, rows(b))
                    more = np.random.default_rng((seed, b)).normal(size=(rows(b), width - own.shape[1]))
                    y.append(np.concatenate([own, more], axis=1).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("b"), pa.array([b""] * len(y), pa.binary()), pa.array(y, pa.binary())], names=["b", "q", "y"])

        return self.packed(x).mapInArrow(widen, "b long, q binary, y binary")

    def gram(self, state: DataFrame, change: Callable[[np.ndarray, np.ndarray], np.ndarray] = lambda q, y: y) -> tuple[np.ndarray, np.ndarray]:
        """Products of the space, and of the new block changed to change(q, y), with that block; a task sums up its own blocks."""
        rows = self.rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for b, q, y in zip(*(batch.column(c).to_pylist() for c in ("b", "q", "y"))):
                    q = _matrix(q, rows(b))
                    y = change(q, _matrix(y, rows(b)))
                    part = np.concatenate([q, y], axis=1).T @ y
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([total.shape[0]], pa.int64()), pa.array([total.shape[1]], pa.int64())], names=["g", "height", "width"])

        found = [np.frombuffer(r.g, np.float64).reshape(r.height, r.width) for r in state.mapInArrow(run, "g binary, height long, width long").collect()]
        total = sum(found)
        width = total.shape[1]
        return total[: len(total) - width], total[len(total) - width :]

    def random(self, state: DataFrame, seed: int, width: int) -> DataFrame:
        """state(b[, q]) with a random new block."""
        rows = self.rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column("b").to_pylist()
                q = batch.column("q") if "q" in batch.schema.names else pa.array([b""] * len(own), pa.binary())
                y = [np.random.default_rng((seed, b)).normal(size=(rows(b), width)).tobytes() for b in own]
                yield pa.RecordBatch.from_arrays([batch.column("b"), q, pa.array(y, pa.binary())], names=["b", "q", "y"])

        return state.mapInArrow(run, "b long, q binary, y binary")


def _strong(x: np.ndarray, row: np.ndarray, w: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Entries between two vertices with STRONG of the largest such weight of the row."""
    off = (x[row, 0] != y[:, 0]) & (w > 0)
    most = np.zeros(len(x))
    np.maximum.at(most, row[off], w[off])
    return off & (w >= STRONG * most[row])


def _firsts(x: np.ndarray, row: np.ndarray, w: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """(a, b): the FIRST largest strong entries of each vertex of x(at)."""
    at = np.flatnonzero(_strong(x, row, w, y))
    at = at[np.lexsort((y[at, 0], -w[at], row[at]))]
    at = at[np.arange(len(at)) - np.searchsorted(row[at], row[at]) < FIRST]
    return {"a": x[row[at], 0].astype(np.int64), "b": y[at, 0].astype(np.int64)}


def _between(x: np.ndarray, row: np.ndarray, w: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """(a, b, w, strong): sums over the entries of two groups, and whether one of them is strong; of vertices x(at, label, root)."""
    a, b = x[row, 1].astype(np.int64), y[:, 1].astype(np.int64)
    order = np.lexsort((b, a))
    first = np.flatnonzero(np.concatenate([[True], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)])) if len(order) else order
    weight, strong = (w * x[row, 2] * y[:, 2])[order], _strong(x, row, w, y)[order]
    sums = (np.add.reduceat(weight, first), np.logical_or.reduceat(strong, first)) if len(order) else (weight, strong)
    return {"a": a[order][first], "b": b[order][first], "w": sums[0], "strong": sums[1]}


def _whiten(gram: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(t, r) with y = (y t) r and y t orthonormal, from the Gram matrix of y; directions shorter than NOISE * scale are dropped."""
    s, v = np.linalg.eigh((gram + gram.T) / 2)
    kept = s > max(NOISE * scale, 0) ** 2
    root = np.sqrt(s[kept])
    return v[:, kept] / root, root[:, None] * v[:, kept].T


def leading(graph: Graph, k: int, tolerance: float = 1e-6, max_steps: int = 400, width: int = WIDTH, most: int | None = None, seed: int = 3, start: DataFrame | None = None) -> tuple[np.ndarray, DataFrame, np.ndarray]:
    """(values, state, s): the k largest eigenvalues, and vectors q s from state's spaces q. `start` is a state(b, q, y) to begin with, a
    random block otherwise.

    Stops when no residual is above the tolerance, and once more after a random block was added, which finds further vectors of
    values that are met several times (a graph of several components has 1 that often). Raises RuntimeError after max_steps products.
    """
    k, tables = min(k, graph.n), graph.tables
    most = max(most or k + 10 * width, k + 3 * width)
    width = min(width, graph.n)
    h, m, confirmed, dropped = np.zeros((0, 0)), 0, None, []

    def settle(state: DataFrame, name: str) -> DataFrame:
        out = tables.put(state, name)
        dropped.append(name)
        for old in dropped[:-2]:
            tables.drop(old)
        del dropped[:-2]
        return out

    def orthogonal(state: DataFrame):
        """What makes y orthonormal and orthogonal to q, in two corrections, its width then, and r, the old y in terms of the new."""
        c, s = graph.gram(state)
        t, r = _whiten(s - c.T @ c, float(np.sqrt(max(np.trace(s), 1e-300))))
        c2, s2 = graph.gram(state, lambda q, y: (y - q @ c) @ t)
        t2, r2 = _whiten(s2 - c2.T @ c2, 1e-3) if len(s2) else (s2, s2)
        return c, (lambda q, y: ((y - q @ c) @ t - q @ c2) @ t2), t2.shape[1], r2 @ r

    state = settle(graph.random(graph.blocks, seed, width) if start is None else start, "start")
    _, fix, new, _ = orthogonal(state)
    keep = np.zeros((0, 0))
    for step in range(max_steps):
        if new:
            state = settle(graph.step(state, lambda q, y, keep=keep, fix=fix: np.concatenate([q @ keep, fix(q, y)], axis=1), new), f"product{step}")
            added = new
            c, fix, new, r = orthogonal(state)
            m = len(c)
            grown = np.zeros((m, m))
            grown[: len(h), : len(h)] = h
            grown[:, m - added :], grown[m - added :, :] = c, c.T
            h = (grown + grown.T) / 2
        values, s = np.linalg.eigh(h)
        values, s = values[::-1], s[:, ::-1]
        keep = np.eye(m)
        full = not new or m + width > most  # a random block has to have grown before it can show that nothing is left
        if m >= k and (confirmed is None or full):
            left = np.linalg.norm(r @ s[m - r.shape[1] :, :k], axis=0) if new else np.zeros(k)
            if left.max() < tolerance:
                if m >= graph.n or (confirmed is not None and np.abs(confirmed - values[:k]).max() < 10 * tolerance):
                    return values[:k], state, s[:, :k]
                # the best vectors stay, and a random block takes the place of the next one
                confirmed, h, m = values[:k].copy(), np.diag(values[:k]), k
                state = settle(graph.random(_kept(graph, state, s[:, :k]), seed + step + 1, width), f"again{step}")
                _, fix, new, _ = orthogonal(state)
                keep = np.eye(k)
                continue
        if not new:  # the space is closed but too small: a random block opens it
            state = settle(graph.random(_kept(graph, state, s), seed + step + 1, width), f"more{step}")
            h = np.diag(values)
            _, fix, new, _ = orthogonal(state)
        elif m + width > most:
            best = min(k + width, m)
            keep, h = s[:, :best], np.diag(values[:best])
    raise RuntimeError(f"the leading {k} vectors didn't settle in {max_steps} products")


def _kept(graph: Graph, state: DataFrame, s: np.ndarray) -> DataFrame:
    rows = graph.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = [np.ascontiguousarray(_matrix(q, rows(b)) @ s).tobytes() for b, q in zip(*(batch.column(c).to_pylist() for c in ("b", "q")))]
            yield pa.RecordBatch.from_arrays([batch.column("b"), pa.array(q, pa.binary())], names=["b", "q"])

    return state.mapInArrow(run, "b long, q binary")


def walk_vectors(edges: DataFrame, k: int, tolerance: float = 1e-6, block: int = BLOCK, width: int = WIDTH) -> DataFrame:
    """(i, x, values): the k - 1 leading non-trivial vectors of the normalised walk over one graph edges(i, j, w), which is symmetric."""
    graph = Graph(edges, block)
    width = min(max(width, k), graph.n)  # a start that has all k
    values, state, s = leading(graph, k, tolerance, width=width, start=graph.coarse(width, 3))
    rows, block = graph.rows, graph.block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, q in zip(*(batch.column(c).to_pylist() for c in ("b", "q"))):
                x = _matrix(q, rows(b)) @ s[:, 1:]
                at = pa.array(np.arange(b * block, b * block + len(x)))
                offsets = pa.array(np.arange(0, x.size + 1, max(1, x.shape[1]))[: len(x) + 1] if x.shape[1] else np.zeros(len(x) + 1, int), pa.int32())
                yield pa.RecordBatch.from_arrays([at, pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=["at", "x"])

    x = state.select("b", "q").mapInArrow(run, "at long, x array<double>").join(graph.vertices, "at")
    return x.select("i", F.transform("x", lambda v: v * F.col("scale")).alias("x"), F.array(*map(F.lit, values.tolist())).alias("values"))
