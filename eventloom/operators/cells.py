"""Grid cells of segments and polygons: cells walked by a segment, staged ray search, cell covers of polygons.

A segment lies in a number of cells that grows with its length, not with the area of its box.  A polygon's cover has the cells
its ring passes, each with the few edges that touch it, and the cells wholly inside; a point is then tested by an equi join on
its cell, and only points in a ring cell look at edges, those of their own cell.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import geometry as G
from eventloom.operators.joins import salted_join
from eventloom.session import pin

#: Share of a cell by which a walk is widened, so that rounding never hides a shared cell.
SLACK = 1e-6
#: Rows that could be moved in the time a further round of a search takes to start.
ROUND_COST = 500_000
#: Pieces in the cells that a ray looks at in its first round, about.
FEW_PIECES = 64
#: Where in a cell its reference point lies, off the middle so that round coordinates do not fall on it.
REF_X, REF_Y = 0.5 + math.pi / 1000, 0.5 - math.e / 1000


def _heights(cx: Column, x1: Column, y1: Column, x2: Column, y2: Column, size: float, g: float) -> tuple[Column, Column]:
    """First and last row of cells in column ``cx`` within ``g`` of the segment's stretch there."""
    at = lambda v: F.floor(v / F.lit(size)).cast("bigint")
    low, high, dx, dy = F.least(x1, x2), F.greatest(x1, x2), x2 - x1, y2 - y1
    left, right = F.greatest(cx * F.lit(size) - g, low), F.least((cx + 1) * F.lit(size) + g, high)
    # heights at both sides of the column; an upright segment has its whole height in it
    a, b = (F.when(dx == 0, F.lit(upright)).otherwise(F.least(F.greatest(F.try_divide(v - x1, dx), F.lit(0.0)), F.lit(1.0))) for v, upright in ((left, 0.0), (right, 1.0)))
    ya, yb = y1 + a * dy, y1 + b * dy
    return at(F.least(ya, yb) - g), at(F.greatest(ya, yb) + g)


def _columns(x1: Column, x2: Column, size: float, g: float) -> Column:
    at = lambda v: F.floor(v / F.lit(size)).cast("bigint")
    return F.sequence(at(F.least(x1, x2) - g), at(F.greatest(x1, x2) + g))


def walked_cells(x1: Column, y1: Column, x2: Column, y2: Column, size: float) -> Column:
    """Array of ``struct<cx, cy>`` that a segment passes, column by column; at most about ``3 + 3 * length / size`` of them."""
    g = SLACK * size

    def column(cx: Column) -> Column:
        rows = F.sequence(*_heights(cx, x1, y1, x2, y2, size, g))
        return F.transform(rows, lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))

    return F.flatten(F.transform(_columns(x1, x2, size, g), column))


def walk(df: DataFrame, ends: Sequence[Column], size: float, grow: float = 0.0) -> DataFrame:
    """Rows repeated over the cells ``cx, cy`` their segment passes; with ``grow`` all cells that hold a point within that
    distance of it are among them.  Two plain explodes, which Spark compiles."""
    g = SLACK * size + grow
    x1, _, x2, _ = ends
    out = df.withColumn("cx", F.explode(_columns(x1, x2, size, g)))
    first, last = _heights(F.col("cx"), *ends, size, g)
    return out.withColumn("cy", F.explode(F.sequence(first, last)))


def spread(pieces: DataFrame, ends: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2")) -> dict[str, float]:
    """Number of pieces, their mean length, and the area over which their middles are spread (as of a normal distribution)."""
    x1, y1, x2, y2 = (F.col(c) for c in ends)
    n, length, sx, sy = pieces.agg(F.count("*"), F.avg(G.hypot(x2 - x1, y2 - y1)), F.stddev_pop((x1 + x2) / 2), F.stddev_pop((y1 + y2) / 2)).first()
    wide = max(sx or 0.0, sy or 0.0)
    return {"n": n, "length": length or 0.0, "area": 4 * math.pi * max(sx or 0.0, 0.01 * wide) * max(sy or 0.0, 0.01 * wide)}


def fitting_cell(n: int, length: float, right: dict[str, float], largest: float, rounds: int = 1) -> float:
    """Cell size, ``largest`` at most, for which a search of ``n`` pieces among the right ones makes the fewest rows and candidates.

    Small cells repeat long pieces, large ones hold many candidates, and searches that find nothing go on with larger cells."""
    if not n or not right["n"] or not 0 < right["area"] < math.inf or not math.isfinite(right["length"]) or not math.isfinite(length):
        return largest

    def cost(c: float) -> float:
        rows, seen = rounds * right["n"] * (1 + 1.3 * right["length"] / c), n * (4 + 2.6 * length / c)
        return rows + seen * (1 + 0.3 * right["n"] * (c * c + 1.3 * right["length"] * c) / right["area"])

    def total(c: float) -> float:
        found = right["n"] * (0.25 * math.pi * c * c + c * (length + right["length"])) / right["area"]
        return ROUND_COST + cost(c) + (math.exp(-found) * total(4 * c) if 4 * c <= largest else 0.0)

    return min((largest / 2**k for k in range(30)), key=total)


def first_hits(rays: DataFrame, pieces: DataFrame, ray: str, piece: str, reach: float, cell: float) -> DataFrame:
    """First piece hit by each ray ``(ray, x, y, ux, uy)`` within ``reach`` (smallest id on ties) and its distance.

    Cells are searched outwards: the first cell's length, then stretches that end four times as far each, and a ray that has hit
    something takes no part in the next stretch.  A stretch ends earlier where its cells hold more than ``FEW_PIECES`` pieces, four times
    as many each round, so a ray that comes upon a crowd looks at the crowd's edge only; the number of rounds is a logarithm.  ``cell`` is the
    largest size; crowded pieces get smaller cells.  Parallel pieces never count.  A ray without a hit, or with a null or non-finite start or direction, has no row."""
    finite = F.lit(True)
    for name in ("x", "y", "ux", "uy"):
        finite = finite & F.coalesce(F.abs(F.col(name)) < float("inf"), F.lit(False))
    parts = max(rays.sparkSession.sparkContext.defaultParallelism, int(rays.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    todo = pin(rays.where(finite).select(F.col(ray).alias("lid"), "x", "y", "ux", "uy", F.lit(0.0).alias("near")).repartition(parts).withColumn("n", F.monotonically_increasing_id()))
    ends = [F.col(n) for n in ("rx1", "ry1", "rx2", "ry2")]
    whole = pieces.where("x1 + y1 + x2 + y2 IS NOT NULL AND NOT isnan(x1 + y1 + x2 + y2)")
    r = whole.select(F.col(piece).alias("rid"), *[F.col(o).alias(n) for o, n in zip(("x1", "y1", "x2", "y2"), ("rx1", "ry1", "rx2", "ry2"))])
    cell = fitting_cell(todo.count(), 0.0, spread(r, ("rx1", "ry1", "rx2", "ry2")), cell, rounds=4)
    r = pin(walk(r.repartition(parts), ends, cell))
    crowd = pin(r.groupBy("cx", "cy").agg(F.count("*").alias("here")))
    along = lambda d: (F.col("x") + F.col("ux") * d, F.col("y") + F.col("uy") * d)
    slack = F.lit(4 * SLACK * cell)

    def entry(k: str) -> Column:
        """Where the ray comes to its cell's column or row of cells."""
        low, u = F.col(f"c{k}") * F.lit(cell), F.col(f"u{k}")
        return F.coalesce(F.try_divide(F.when(u > 0, low).otherwise(low + cell) - F.col(k), u), F.lit(0.0))

    found, few = None, FEW_PIECES
    while True:
        todo = todo.withColumn("far", F.least(F.lit(float(reach)), F.greatest(F.lit(cell), 4 * F.col("near"))))
        l = walk(todo, (*along(F.col("near")), *along(F.col("far"))), cell).join(crowd, ["cx", "cy"])
        order = Window.partitionBy("n").orderBy("entry", "cx", "cy")
        l = l.withColumn("entry", F.greatest(entry("x"), entry("y"), F.lit(0.0))).withColumn("before", F.sum("here").over(order) - F.col("here"))
        # the first cell that is left for the next round bounds what this one can settle
        left = F.min(F.when(F.col("before") >= few, F.greatest(F.col("entry") - slack, F.col("near")))).over(Window.partitionBy("n"))
        l = pin(l.withColumn("end", F.coalesce(left, F.col("far"))).where(F.col("before") < few).drop("entry", "before", "here").repartition(parts, "cx", "cy"))
        j = salted_join(l, r, ["cx", "cy"])
        # parameters on the whole ray, so that a hit has one distance whatever the stretch
        t, u = G.cut_parameters(F.col("x"), F.col("y"), *along(reach), G.point(ends[0], ends[1]), G.point(ends[2], ends[3]))
        hit = j.withColumns({"t": t, "u": u}).where(F.col("t").between(0, 1) & F.col("u").between(0, 1) & (F.col("t") * reach <= F.col("end")))
        best = pin(hit.groupBy("n", "lid").agg(F.min(F.struct("t", "rid")).alias("b")))
        found = best if found is None else found.unionByName(best)
        ended = l.groupBy("n").agg(F.min("end").alias("end"))
        todo = todo.join(best.select("n"), "n", "left_anti").join(ended, "n", "left").withColumn("near", F.coalesce("end", "far"))
        todo = pin(todo.where(F.col("near") < reach).drop("end", "far").repartition(parts, "n"))
        if todo.isEmpty():
            best = found.groupBy("lid").agg(F.min("b").alias("b"))
            return best.select(F.col("lid").alias(ray), F.col("b.rid").alias(piece), (F.col("b.t") * reach).alias("distance"))
        few *= 4


def polygon_cover(polygons: DataFrame, gid: str, cell: float) -> DataFrame:
    """Cells of polygons ``(gid, ring)``: ``(gid, cx, cy, edges, ref_inside)``; ``edges`` is empty in a cell wholly inside.

    Ring cells come from walking the edges.  Every row of cells is swept along the line of its reference points: sorted crossings, taken two by
    two, bound the inner stretches, which gives the inner cells and the state of every ring cell's reference point.  A sweep holds the
    crossings of one polygon with one line.  Rows that share an id are the rings of one polygon (parts, or holes: even-odd)."""
    e = polygons.where(F.size("ring") >= 3).select(F.col(gid).alias("gid"), F.explode(G.edges_of(G.close_ring(F.col("ring")))).alias("e"))
    a, b = F.col("e.a"), F.col("e.b")
    size = F.lit(cell)
    walked = e.withColumn("c", F.explode(walked_cells(a["x"], a["y"], b["x"], b["y"], cell)))
    ring = walked.groupBy("gid", "c.cx", "c.cy").agg(F.collect_list("e").alias("edges"))  # edges of one cell
    low = F.ceil(F.least(a["y"], b["y"]) / size - REF_Y).cast("bigint")
    high = F.floor(F.greatest(a["y"], b["y"]) / size - REF_Y).cast("bigint")
    rows = e.where(low <= high).withColumn("cy", F.explode(F.sequence(low, high)))
    y = (F.col("cy") + REF_Y) * size
    crosses = (a["y"] > y) != (b["y"] > y)
    x = (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]
    cuts = rows.where(crosses).select("gid", "cy", x.alias("x")).groupBy("gid", "cy").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    pairs = F.transform(F.sequence(F.lit(0), (F.size("xs") / 2).cast("int") - 1), lambda i: F.struct(F.col("xs")[2 * i].alias("a"), F.col("xs")[2 * i + 1].alias("b")))
    spans = cuts.select("gid", "cy", F.explode(pairs).alias("s"))
    # cells whose reference point lies in the stretch: a <= reference < b
    first, last = F.ceil(F.col("s.a") / size - REF_X).cast("bigint"), F.ceil(F.col("s.b") / size - REF_X).cast("bigint") - 1
    inner = spans.where(first <= last).select("gid", F.explode(F.sequence(first, last)).alias("cx"), "cy", F.lit(True).alias("inner"))
    j = ring.join(inner, ["gid", "cx", "cy"], "full")
    return j.select(
        F.col("gid").alias(gid), "cx", "cy", F.coalesce("edges", F.from_json(F.lit("[]"), ring.schema["edges"].dataType)).alias("edges"), F.coalesce("inner", F.lit(False)).alias("ref_inside")
    )


def _inside_cell(x: Column, y: Column, size: float) -> Column:
    """Even-odd state of a point of a ring cell: the reference point's, turned by every edge between them along an upright corner path."""
    mx, my = (F.col("cx") + REF_X) * F.lit(size), (F.col("cy") + REF_Y) * F.lit(size)

    def turns(e: Column) -> Column:
        a, b = e["a"], e["b"]
        xi = (b["x"] - a["x"]) * (my - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]
        yi = (b["y"] - a["y"]) * (x - a["x"]) / F.nullif(b["x"] - a["x"], F.lit(0.0)) + a["y"]
        level = ((a["y"] > my) != (b["y"] > my)) & ((mx < xi) != (x < xi))
        upright = ((a["x"] > x) != (b["x"] > x)) & ((my < yi) != (y < yi))
        return F.coalesce(level, F.lit(False)).cast("int") + F.coalesce(upright, F.lit(False)).cast("int")

    crossed = F.aggregate("edges", F.lit(0), lambda acc, e: acc + turns(e))
    return F.col("ref_inside") != (F.pmod(crossed, F.lit(2)) == 1)


def points_in_cover(points: DataFrame, cover: DataFrame, pid: str, gid: str, cell: float) -> DataFrame:
    """Distinct pairs of points ``(pid, x, y)`` and covered polygons that contain one of them; null places lie nowhere.

    A point on the ring itself falls to one side by the even-odd rule."""
    at = lambda v: F.floor(F.col(v) / F.lit(cell)).cast("bigint")
    p = points.select(F.col(pid).alias("pid"), "x", "y", at("x").alias("cx"), at("y").alias("cy"))
    j = salted_join(p, cover.withColumnRenamed(gid, "gid"), ["cx", "cy"])
    return j.where(_inside_cell(F.col("x"), F.col("y"), cell)).select(F.col("pid").alias(pid), F.col("gid").alias(gid)).distinct()


def pieces_in_cover(pieces: DataFrame, cover: DataFrame, gid: str, cell: float) -> DataFrame:
    """Distinct pairs of pieces ``(id, x1, y1, x2, y2)`` and covered polygons that have a stretch of the piece inside them.

    A piece is cut by the borders and ring edges of each cell it passes; the middle of a stretch is tested in its own cell, against the
    polygon that cut it.  A stretch along the ring counts as outside."""
    ends = [F.col(n) for n in ("x1", "y1", "x2", "y2")]
    x1, y1, x2, y2 = ends
    walked = pieces.withColumn("c", F.explode(walked_cells(*ends, cell))).select("id", "x1", "y1", "x2", "y2", "c.cx", "c.cy")
    j = salted_join(walked, cover.withColumnRenamed(gid, "gid"), ["cx", "cy"])
    borders = F.filter(
        F.array(*[F.try_divide((F.col(k) + i) * F.lit(cell) - o, d) for k, o, d in (("cx", x1, x2 - x1), ("cy", y1, y2 - y1)) for i in (0, 1)]), lambda t: (t > 0) & (t < 1)
    )
    j = j.withColumn("cuts", F.array_sort(F.concat(G.cuts_inside(*ends, F.col("edges")), borders)))
    mid = F.zip_with(F.slice("cuts", 1, F.size("cuts") - 1), F.slice("cuts", 2, F.size("cuts") - 1), lambda a, b: F.when(b - a > 1e-12, (a + b) / 2))
    j = j.withColumn("t", F.explode(mid)).where("t IS NOT NULL")
    j = j.select("id", "gid", "cx", "cy", "edges", "ref_inside", (x1 + (x2 - x1) * F.col("t")).alias("x"), (y1 + (y2 - y1) * F.col("t")).alias("y"))
    at = lambda v: F.floor(F.col(v) / F.lit(cell)).cast("bigint")
    j = j.where((at("x") == F.col("cx")) & (at("y") == F.col("cy"))).where(_inside_cell(F.col("x"), F.col("y"), cell))
    apart = lambda e: G.point_segment_distance(F.col("x"), F.col("y"), e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]) > SLACK * cell
    return j.where(F.forall("edges", apart)).select("id", F.col("gid").alias(gid)).distinct()


def _edges(polygons: DataFrame, gid: str) -> DataFrame:
    e = polygons.select(F.col(gid).alias("id"), F.explode(G.edges_of(G.close_ring(F.col("ring")))).alias("e"))
    return e.select("id", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def inner_points(polygons: DataFrame, gid: str) -> DataFrame:
    """One point ``(gid, x, y)`` inside every ring: the middle of the widest stretch on the level line between its two lowest
    heights.  Rings without an area have no row."""
    height = F.array_sort(F.array_distinct(F.transform("ring", lambda v: v["y"])))
    d = polygons.where(F.size("ring") >= 3).select(gid, G.edges_of(G.close_ring(F.col("ring"))).alias("edges"), height.alias("ys"))
    d = d.select(gid, "edges", ((F.get("ys", 0) + F.get("ys", 1)) / 2).alias("y"))
    cut = lambda e: (e["b"]["x"] - e["a"]["x"]) * (F.col("y") - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]
    d = d.select(gid, "y", F.array_sort(F.transform(F.filter("edges", lambda e: (e["a"]["y"] > F.col("y")) != (e["b"]["y"] > F.col("y"))), cut)).alias("xs"))
    d = d.where(F.size("xs") >= 2)
    stretch = lambda i: F.struct((F.get("xs", 2 * i + 1) - F.get("xs", 2 * i)).alias("w"), F.get("xs", 2 * i).alias("a"))
    d = d.select(gid, "y", F.array_max(F.transform(F.sequence(F.lit(0), (F.size("xs") / 2).cast("int") - 1), stretch)).alias("s"))
    return d.where("s.w > 0").select(gid, (F.col("s.a") + F.col("s.w") / 2).alias("x"), "y")


def boundary_filter(zones: DataFrame, boundary: DataFrame, gid: str, cell: float) -> DataFrame:
    """Distinct ids of the zones ``(gid, ring)`` that share an area with the boundary polygons ``(ring)``.

    A zone shares an area if an inner point of it, or a stretch of its ring, lies inside the boundary, or a stretch of the boundary's
    ring inside the zone.  Zones that only touch it along a line or in a point, and shapes without an area (fewer than three vertices
    or all on a line), are left out, as an intersection that is no polygon would be.  A zone may have several rows, one per part.
    Neither side is ever gathered or broadcast: both are joined by cells."""
    z = pin(zones.select(F.col(gid).alias("gid"), "ring").where((F.size("ring") >= 3) & (G.ring_span(F.col("ring")) > 0)))
    b = pin(boundary.select(F.lit(0).alias("bid"), "ring"))
    cover, zone_cover = pin(polygon_cover(b, "bid", cell)), pin(polygon_cover(z, "gid", cell).withColumnRenamed("gid", "zid"))
    hits = [
        points_in_cover(inner_points(z, "gid"), cover, "gid", "bid", cell).select("gid"),
        pieces_in_cover(_edges(z, "gid"), cover, "bid", cell).select(F.col("id").alias("gid")),
        pieces_in_cover(_edges(b, "bid"), zone_cover, "zid", cell).select(F.col("zid").alias("gid")),
    ]
    return reduce(DataFrame.unionByName, hits).distinct().withColumnRenamed("gid", gid)
