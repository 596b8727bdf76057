"""Edges and lines of regions and images: Canny edges, circle fits, and contour lines at a level.

All are relations over cells: gradients and votes are sums over shifted cells, hysteresis is a component of a graph, and lines are put
in order by following pointers that double their reach in every round.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxgrid.operators.filters import EIGHT, offsets
from fluxgrid.operators.graph import components, cut_lineage

# Weights of the derivative along rows; turned, they are those along columns.
SOBEL = {(-1, -1): -1, (-1, 0): -2, (-1, 1): -1, (1, -1): 1, (1, 0): 2, (1, 1): 1}


def _spread(cells: DataFrame, column: str, axis: str, sigma: float) -> DataFrame:
    """Sums of cells(roi, row, col, column) spread along an axis by a Gaussian cut off at 4 sigma; nothing is outside."""
    radius = int(4 * sigma + 0.5)
    taps = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    kernel = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(t / sum(taps)).alias("t")) for k, t in zip(range(-radius, radius + 1), taps)))
    moved = cells.withColumn("x", F.explode(kernel)).withColumns({axis: (F.col(axis) + F.col("x.k")).cast("long"), column: F.col(column) * F.col("x.t")})
    return moved.groupBy("roi", "row", "col").agg(F.sum(column).alias(column))


def gradients(regions: DataFrame, sigma: float = 1.0) -> DataFrame:
    """(roi, row, col, gr, gc, m): derivatives of each region's smoothed mask and their length, where the mask reaches."""
    mask = regions.select("roi", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).distinct().withColumn("v", F.lit(1.0))
    smooth = _spread(_spread(mask, "v", "row", sigma), "v", "col", sigma) if sigma > 0 else mask
    weights = F.array(*(F.struct(F.lit(-r).alias("dr"), F.lit(-c).alias("dc"), F.lit(float(SOBEL.get((r, c), 0))).alias("a"), F.lit(float(SOBEL.get((c, r), 0))).alias("b")) for r, c in EIGHT))
    # a cell adds to the sums of those that have it as a neighbour
    sent = smooth.withColumn("x", F.explode(weights)).select("roi", (F.col("row") + F.col("x.dr")).alias("row"), (F.col("col") + F.col("x.dc")).alias("col"), (F.col("v") * F.col("x.a")).alias("gr"), (F.col("v") * F.col("x.b")).alias("gc"))
    sums = sent.groupBy("roi", "row", "col").agg(F.sum("gr").alias("gr"), F.sum("gc").alias("gc"))
    return sums.withColumn("m", F.sqrt(F.col("gr") * F.col("gr") + F.col("gc") * F.col("gc")))


def thinned(g: DataFrame) -> DataFrame:
    """Cells of gradients() whose length isn't below that on either side along the gradient, interpolated between two neighbours."""
    near = offsets(g.select("roi", F.col("row"), F.col("col"), F.col("m").alias("w")), EIGHT)
    near = near.select("roi", (F.col("nrow")).alias("r"), (F.col("ncol")).alias("c"), (F.col("row") - F.col("nrow")).alias("dr"), (F.col("col") - F.col("ncol")).alias("dc"), "w")
    at = {(r, c): F.max(F.when((F.col("dr") == r) & (F.col("dc") == c), F.col("w"))).alias(f"m_{r + 1}_{c + 1}") for r, c in EIGHT}
    around = near.groupBy("roi", F.col("r").alias("row"), F.col("c").alias("col")).agg(*at.values())
    m = lambda r, c: F.coalesce(F.col(f"m_{r + 1}_{c + 1}"), F.lit(0.0))
    a, b = F.abs("gr"), F.abs("gc")
    same = F.col("gr") * F.col("gc") >= 0

    def side(s: int) -> Column:
        steep = (1 - b / a) * m(s, 0) + b / a * F.when(same, m(s, s)).otherwise(m(s, -s))
        flat = (1 - a / b) * m(0, s) + a / b * F.when(same, m(s, s)).otherwise(m(-s, s))
        return F.when(a >= b, steep).otherwise(flat)

    kept = g.where("m > 0").join(around, ["roi", "row", "col"])
    even = 1e-9  # equal lengths that are summed in another order
    return kept.where((F.col("m") >= side(1) - even) & (F.col("m") >= side(-1) - even)).select("roi", "row", "col", "m")


def canny(regions: DataFrame, sigma: float = 1.0, low: float = 0.1, high: float = 0.2) -> DataFrame:
    """(roi, row, col): thin edges of each region's mask: of cells from `low` on, those that hang together with one from `high` on."""
    weak = cut_lineage(thinned(gradients(regions, sigma)).where(F.col("m") >= low).withColumn("id", F.xxhash64("roi", "row", "col")))
    near = offsets(weak.select("roi", "row", "col", "id"), EIGHT)
    other = weak.select("roi", F.col("row").alias("nrow"), F.col("col").alias("ncol"), F.col("id").alias("b"))
    pairs = near.join(other, ["roi", "nrow", "ncol"]).select(F.col("id").alias("a"), "b").where("a < b")
    parts = components(weak.select(F.col("id").alias("v")), pairs)
    member = weak.join(parts, F.col("id") == F.col("v"))
    strong = member.where(F.col("m") >= high).select("component").distinct()
    return member.join(strong, "component", "left_semi").select("roi", "row", "col")


def circle_fit(regions: DataFrame) -> DataFrame:
    """(roi, votes, circularity): the best circle through each region's edges, in whole hundredths of the best of all regions.

    Masks are doubled in size and their Canny edges vote for centres at the radius that fits the shorter side of the bounding box.
    votes is the share of the circle's cells that are edges; a region of one row or column has none.
    """
    twice = regions.select("roi", "row", "col").withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(3)))).selectExpr("roi", "2 * row + x div 2 as row", "2 * col + x % 2 as col")
    side = regions.groupBy("roi").agg(F.least(F.max("row") - F.min("row"), F.max("col") - F.min("col")).cast("int").alias("radius"))
    span = F.sequence(-F.col("radius"), F.col("radius"))
    circle = side.where("radius > 0").select("radius").distinct().withColumn("dr", F.explode(span)).withColumn("dc", F.explode(span))
    circle = circle.where("abs(sqrt(dr * dr + dc * dc) - radius) < 0.5")
    size = circle.groupBy("radius").agg(F.count("*").alias("size"))
    votes = canny(twice).join(side, "roi").join(circle, "radius").groupBy("roi", "radius", (F.col("row") + F.col("dr")).alias("cr"), (F.col("col") + F.col("dc")).alias("cc")).agg(F.count("*").alias("n"))
    best = votes.groupBy("roi", "radius").agg(F.max("n").alias("n")).join(size, "radius").select("roi", (F.col("n") / F.col("size")).alias("votes"))
    every = side.select("roi").join(best, "roi", "left").withColumn("votes", F.coalesce("votes", F.lit(0.0)))
    top = every.agg(F.max("votes").alias("top"))
    return every.join(F.broadcast(top)).select("roi", "votes", F.expr("cast(coalesce(votes / nullif(top, 0), 0) * 100 + 1e-9 as long)").alias("circularity"))


def segments(cells: DataFrame, level: float) -> DataFrame:
    """(roi, p, q, row, col): directed pieces of the lines where cells(roi, row, col, v) cross a level, higher values to the left; p and q are
    the sides that a piece comes from and goes to, row and col where it begins. Cells that aren't there are below the level, at 0.

    A square of four cells has one or two pieces; where its diagonals differ, the lower ones are taken as connected.
    """
    corners = F.array(*(F.struct(F.lit(-r).alias("r"), F.lit(-c).alias("c"), F.lit(2 * r + c).alias("k")) for r in (0, 1) for c in (0, 1)))
    each = cells.select("roi", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("v").cast("double").alias("v")).withColumn("x", F.explode(corners))
    each = each.select("roi", (F.col("row") + F.col("x.r")).alias("r"), (F.col("col") + F.col("x.c")).alias("c"), F.col("x.k").alias("k"), "v")
    square = each.groupBy("roi", "r", "c").agg(*(F.coalesce(F.max(F.when(F.col("k") == k, F.col("v"))), F.lit(0.0)).alias(n) for k, n in enumerate(("a", "b", "d", "e"))))  # a b over d e
    up = {n: F.col(n) > level for n in "abde"}
    # sides: top a-b, right b-e, bottom d-e, left a-d; walking with the higher corner to the left
    sides = {"T": ("a", "b"), "R": ("b", "e"), "B": ("e", "d"), "L": ("d", "a")}  # clockwise around the square
    enter = {s: up[y] & ~up[x] for s, (x, y) in sides.items()}  # clockwise from low to high: a line comes in here
    leave = {s: up[x] & ~up[y] for s, (x, y) in sides.items()}
    turn = {s: [("TRBL" * 2)["TRBL".index(s) + k] for k in (1, 2, 3)] for s in sides}
    # the next side clockwise at which the high corners end is where the line leaves: each run of high corners is cut off by itself
    pieces = []
    for s in sides:
        to = F.lit(None).cast("string")
        for other in reversed(turn[s]):
            to = F.when(leave[other], F.lit(other)).otherwise(to)
        pieces.append(F.when(enter[s], F.struct(F.lit(s).alias("s"), to.alias("t"))))
    found = square.withColumn("x", F.explode(F.filter(F.array(*pieces), lambda x: x.isNotNull()))).select("*", "x.s", "x.t").drop("x")

    def side(s: Column) -> Column:
        """Name of a side, the same from the squares on both sides of it."""
        r = F.when(s == "B", F.col("r") + 1).otherwise(F.col("r"))
        c = F.when(s == "R", F.col("c") + 1).otherwise(F.col("c"))
        return F.xxhash64("roi", F.when(s.isin("T", "B"), F.lit("h")).otherwise(F.lit("v")), r, c)

    part = lambda x, y: (F.lit(level) - F.col(x)) / (F.col(y) - F.col(x))
    s = F.col("s")
    row = F.when(s == "T", F.col("r")).when(s == "B", F.col("r") + 1).when(s == "L", F.col("r") + part("a", "d")).otherwise(F.col("r") + part("b", "e"))
    col = F.when(s == "L", F.col("c")).when(s == "R", F.col("c") + 1).when(s == "T", F.col("c") + part("a", "b")).otherwise(F.col("c") + part("d", "e"))
    return found.select("roi", side(s).alias("p"), side(F.col("t")).alias("q"), row.cast("double").alias("row"), col.cast("double").alias("col"))


def chained(pieces: DataFrame, max_rounds: int = 40) -> DataFrame:
    """pieces(p, q, ...), which form closed lines, with `line`, the smallest p of a line, and k, the place of a piece in it from 0.

    In every round each piece learns the smallest p ahead of it twice as far as before; then the line is cut before its smallest p and
    each piece learns in the same way how far the end is. So a line takes as many rounds as its length has binary digits.
    """
    cur = cut_lineage(pieces.select("p", F.col("q").alias("next"), F.col("p").alias("low")))
    before = None
    for _ in range(max_rounds):
        ahead = cur.select(F.col("p").alias("next"), F.col("next").alias("then"), F.col("low").alias("far"))
        cur = cut_lineage(cur.join(ahead, "next").select("p", F.col("then").alias("next"), F.least("low", "far").alias("low")))
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("p", "low").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("lines did not settle")
    lines = cur.select("p", F.col("low").alias("line"))
    known = cut_lineage(pieces.join(lines, "p"))
    # steps to the end of the line, the piece before its smallest p
    cur = known.select("p", F.when(F.col("q") != F.col("line"), F.col("q")).alias("next"), F.when(F.col("q") != F.col("line"), 1).otherwise(0).cast("long").alias("left"))
    while True:
        cur = cut_lineage(cur)
        if cur.where("next is not null").isEmpty():
            break
        ahead = cur.select(F.col("p").alias("next"), F.col("next").alias("then"), F.col("left").alias("more"))
        cur = cur.join(ahead, "next", "left").select("p", F.col("then").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left"))
    length = known.groupBy("line").agg((F.count("*") - 1).alias("last"))
    return known.join(cur.select("p", "left"), "p").join(length, "line").withColumn("k", F.col("last") - F.col("left")).drop("left", "last")


def contour_lines(cells: DataFrame, level: float = 0.5) -> DataFrame:
    """(roi, line, k, row, col): closed lines at a level around the cells(roi, row, col, v) above it, in order and numbered from 1 by their
    first point, which is the upper- and leftmost; the last point joins the first."""
    got = chained(segments(cells, level))
    first = got.groupBy("roi", "line").agg(F.min(F.struct("row", "col", "k")).alias("first"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("roi").orderBy("first.row", "first.col", "line"))  # a row for each line of a region
    numbered = first.select("roi", "line", "n", F.col("first.k").alias("k0"), rank.cast("long").alias("number"))
    return got.join(numbered, ["roi", "line"]).select("roi", F.col("number").alias("line"), F.pmod(F.col("k") - F.col("k0"), F.col("n")).alias("k"), "row", "col")

