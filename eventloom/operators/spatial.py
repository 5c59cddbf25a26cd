"""Spatial joins as equi joins on grid cells, refined with exact distance or containment.

Shapes are tables of *pieces* ``(id, x1, y1, x2, y2)``; a point is a piece of zero length.  Every join lays
both sides over cells and keeps a pair only in the first cell they share, so no distinct is needed; hot cells
are salted by ``salted_join``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from eventloom.functions import geometry as G
from eventloom.operators import blocks as B
from eventloom.operators.cells import first_hits, fitting_cell, spread, walk
from eventloom.operators.joins import salted_join
from eventloom.operators.sampling import top_n_per_group
from eventloom.session import pin

ENDS = ("x1", "y1", "x2", "y2")
L4, R4 = ("lx1", "ly1", "lx2", "ly2"), ("rx1", "ry1", "rx2", "ry2")


def point_pieces(df: DataFrame, id_: str, x: str, y: str) -> DataFrame:
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(id_, F.col(x).alias("x1"), F.col(y).alias("y1"), F.col(x).alias("x2"), F.col(y).alias("y2"))


def line_pieces(df: DataFrame, id_: str, line: str) -> DataFrame:
    """One row per edge of the line."""
    e = df.select(id_, F.explode(G.edges_of(F.col(line))).alias("e"))
    return e.select(id_, F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def _cells(df: DataFrame, p: Sequence[str], size: float, grow: float, tag: str) -> DataFrame:
    """Rows repeated over the cells of their grown bounding box, with the box's first cell."""
    x1, y1, x2, y2 = (F.col(c) for c in p)
    cell = lambda v: F.floor(v / F.lit(size)).cast("bigint")
    x0, xn = cell(F.least(x1, x2) - grow), cell(F.greatest(x1, x2) + grow)
    y0, yn = cell(F.least(y1, y2) - grow), cell(F.greatest(y1, y2) + grow)
    out = df.withColumns({f"{tag}x0": x0, f"{tag}y0": y0, "cx": F.explode(F.sequence(x0, xn))})
    return out.withColumn("cy", F.explode(F.sequence(F.col(f"{tag}y0"), yn)))


def _rename(df: DataFrame, id_: str, new: str, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return df.select(F.col(id_).alias(new), *by, *[F.col(c).alias(n) for c, n in zip(("x1", "y1", "x2", "y2"), names)])


def piece_distance(points: tuple[bool, bool] = (False, False)) -> Column:
    """Distance of the two pieces of a pair; cheaper forms when a side holds points."""
    lx1, ly1, lx2, ly2 = (F.col(c) for c in L4)
    rx1, ry1, rx2, ry2 = (F.col(c) for c in R4)
    if points == (True, True):
        return G.hypot(lx1 - rx1, ly1 - ry1)
    if points[0]:
        return G.point_segment_distance(lx1, ly1, rx1, ry1, rx2, ry2)
    if points[1]:
        return G.point_segment_distance(rx1, ry1, lx1, ly1, lx2, ly2)
    ends = F.least(
        G.point_segment_distance(lx1, ly1, rx1, ry1, rx2, ry2),
        G.point_segment_distance(lx2, ly2, rx1, ry1, rx2, ry2),
        G.point_segment_distance(rx1, ry1, lx1, ly1, lx2, ly2),
        G.point_segment_distance(rx2, ry2, lx1, ly1, lx2, ly2),
    )
    return F.when(G.segments_cross(lx1, ly1, lx2, ly2, rx1, ry1, rx2, ry2), F.lit(0.0)).otherwise(ends)


def within_pairs(left: DataFrame, right: DataFrame, lid: str, rid: str, d: float, points: tuple[bool, bool] = (False, False), cell: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Piece pairs ``(lid, rid, dist)`` at distance ``<= d``, equal in the columns ``by``; a pair of shapes appears once per piece pair."""
    size = cell or d
    l = _cells(_rename(left, lid, "lid", L4, by), L4, size, 0.0, "l")
    r = _cells(_rename(right, rid, "rid", R4, by), R4, size, d, "r")
    first = (F.col("cx") == F.greatest("lx0", "rx0")) & (F.col("cy") == F.greatest("ly0", "ry0"))
    j = salted_join(l, r, ["cx", "cy", *by]).where(first)
    return j.withColumn("dist", piece_distance(points)).where(F.col("dist") <= d).select("lid", "rid", "dist")


def nearest_join(
    left: DataFrame, right: DataFrame, lid: str, rid: str, radius: float,
    points: tuple[bool, bool] = (False, False), max_distance: float | None = None, out_distance: str = "dist",
) -> DataFrame:
    """One row per left shape: its nearest right shape (smallest id on ties) and the distance.

    Searches within a radius that fits the crowding, ``radius`` at most; shapes that found nothing meet the blocks of right shapes
    that may hold their nearest one, so the answer is exact and the candidates stay local.  Right shapes of one place are folded to their smallest id, left
    points of one place are searched once.  With ``max_distance`` farther shapes are left out.  Without it, shapes with a null or
    NaN vertex, and all shapes when the right side has none to offer, get a null id and distance.
    """
    whole = reduce(lambda a, b: a & b, [F.col(x).isNotNull() & ~F.isnan(F.col(x)) for x in ENDS])
    kind = dict(right.dtypes)[rid]
    blank = lambda ids: ids.select(lid, F.lit(None).cast(kind).alias(rid), F.lit(None).cast("double").alias(out_distance))
    right = pin(right.where(whole).groupBy(*ENDS).agg(F.min(rid).alias("rid")))
    todo = left.where(whole)
    none = right.isEmpty()
    r = radius if max_distance is None else min(radius, max_distance)
    if none:
        ids = left.select(lid).distinct()
        return blank(ids) if max_distance is None else blank(ids.limit(0))
    folded = points[0]
    todo = todo.select(F.struct("x1", "y1").alias("lid"), *ENDS).distinct() if folded else todo.select(F.col(lid).alias("lid"), *ENDS)
    todo, right = pin(_spread_out(todo)), pin(_spread_out(right))
    size = spread(todo)
    r = min(r, fitting_cell(size["n"], size["length"], spread(right), 2 * r) / 2)
    found = pin(_nearest_within(todo, right, r, points))
    if max_distance is None or r < max_distance:
        todo = pin(_spread_out(todo.join(found.select("lid"), "lid", "left_anti")))
        if not todo.isEmpty():
            found = found.unionByName(pin(_nearest_in_blocks(todo, right, points, math.inf if max_distance is None else max_distance)))
    if folded:
        places = found.select("lid.x1", "lid.y1", "b")
        found = salted_join(left.where(whole).select(F.col(lid).alias("lid"), "x1", "y1"), places, ["x1", "y1"]).groupBy("lid").agg(F.min("b").alias("b"))
    found = found.select(F.col("lid").alias(lid), F.col("b.rid").alias(rid), F.col("b.dist").alias(out_distance))
    if max_distance is None and not left.where(~whole).isEmpty():
        found = found.unionByName(blank(left.select(lid).distinct().join(left.where(whole).select(lid).distinct(), lid, "left_anti")))
    return found


def _spread_out(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over all cores: a small table whose rows multiply later must not be left in one partition."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def _nearest_within(left: DataFrame, right: DataFrame, d: float, points: tuple[bool, bool]) -> DataFrame:
    """Nearest right piece ``(lid, b<dist, rid>)`` within ``d``, from cells walked by the right pieces and around the left ones."""
    size = 2 * d
    at = lambda v: F.floor(F.col(v) / F.lit(size)).cast("bigint")
    l = walk(_rename(left, "lid", "lid", L4), [F.col(n) for n in L4], size, d)
    r = _rename(right, "rid", "rid", R4)
    r = r.withColumns({"cx": at("rx1"), "cy": at("ry1")}) if points[1] else walk(r, [F.col(n) for n in R4], size)
    j = salted_join(_spread_out(l, "cx", "cy"), r, ["cx", "cy"]).withColumn("dist", piece_distance(points)).where(F.col("dist") <= d)
    return j.groupBy("lid").agg(F.min(F.struct("dist", "rid")).alias("b"))


#: Blocks of right pieces along the longer axis in the search of shapes far from all others.
BLOCKS = 64


def _nearest_in_blocks(left: DataFrame, right: DataFrame, points: tuple[bool, bool], most: float) -> DataFrame:
    """Nearest right piece ``(lid, b<dist, rid>)`` within ``most``, however far.

    Right pieces lie in the blocks they pass, ``(BLOCKS + 2) ** 2`` at most.  A left piece meets the blocks that are not farther than the
    farthest corner of any block, as each holds a right piece."""
    x0, xn, y0, yn = right.agg(F.min(F.least("x1", "x2")), F.max(F.greatest("x1", "x2")), F.min(F.least("y1", "y2")), F.max(F.greatest("y1", "y2"))).first()
    size = max(xn - x0, yn - y0) / BLOCKS or 1.0
    at = lambda v: F.floor(F.col(v) / F.lit(size)).cast("bigint")
    r = _rename(right, "rid", "rid", R4)
    r = r.withColumns({"cx": at("rx1"), "cy": at("ry1")}) if points[1] else walk(r, [F.col(n) for n in R4], size)
    blocks = np.array([tuple(b) for b in r.select("cx", "cy").distinct().collect()], dtype=np.int64)  # one row per block
    shared = left.sparkSession.sparkContext.broadcast(blocks)

    def meet(batches):
        at_ = shared.value
        slack = 1e-5 * size
        (bx1, by1), (bx2, by2) = (at_ * size - slack).T, ((at_ + 1) * size + slack).T
        for whole in batches:
            for i in range(0, len(whole), 1000):
                b = whole.iloc[i : i + 1000]
                x, y = ((b[f"l{k}1"] + b[f"l{k}2"]).to_numpy(float)[:, None] / 2 for k in "xy")
                half = np.hypot(b["lx2"] - b["lx1"], b["ly2"] - b["ly1"]).to_numpy(float)[:, None] / 2
                best = np.hypot(np.maximum(np.abs(x - bx1), np.abs(x - bx2)), np.maximum(np.abs(y - by1), np.abs(y - by2))).min(1)
                gap = np.hypot(np.maximum(np.maximum(bx1 - x, x - bx2), 0), np.maximum(np.maximum(by1 - y, y - by2), 0)) - half
                row, col = np.nonzero(gap <= (np.minimum(best, most) * (1 + 1e-9) + 1e-9)[:, None])
                yield b.iloc[row][["n", *L4]].assign(cx=at_[col, 0], cy=at_[col, 1])

    # pieces are numbered, as ids of any type may come
    numbered = pin(_rename(left, "lid", "lid", L4).withColumn("n", F.monotonically_increasing_id()))
    pairs = numbered.select("n", *L4).mapInPandas(meet, "n bigint, lx1 double, ly1 double, lx2 double, ly2 double, cx bigint, cy bigint")
    j = salted_join(_spread_out(pairs, "cx", "cy"), r, ["cx", "cy"]).withColumn("dist", piece_distance(points)).where(F.col("dist") <= most)
    best = j.groupBy("n").agg(F.min(F.struct("dist", "rid")).alias("b"))
    return best.join(numbered.select("n", "lid"), "n").groupBy("lid").agg(F.min("b").alias("b"))


#: Cells of a presence search along its radius.
REACH_CELLS = 4


def near_any(left: DataFrame, right: DataFrame, lid: str, d: float) -> DataFrame:
    """Distinct ids of the left shapes that have a right piece within ``d`` of one of their pieces; which one is not searched.

    Cells that right pieces pass mark the cells around them as surely or possibly within ``d``.  A left piece in a sure cell is settled, one
    without a marked cell too; only those between measure distances, to the right pieces around them.  Shapes with a null or non-finite vertex are near nothing."""
    finite = reduce(lambda a, b: a & b, [F.coalesce(F.abs(F.col(n)) < math.inf, F.lit(False)) for n in ENDS])
    size, ends = d / REACH_CELLS, [F.col(n) for n in ENDS]
    left = pin(_spread_out(left.where(finite).select(F.col(lid).alias("lid"), *ENDS)))
    right = pin(_spread_out(right.where(finite).select(*ENDS).distinct()))
    passed = walk(right, ends, size).select("cx", "cy").distinct()
    around, steps = range(-REACH_CELLS - 1, REACH_CELLS + 2), []
    for i, j in ((i, j) for i in around for j in around):
        nearest, farthest = math.hypot(max(abs(i) - 1, 0), max(abs(j) - 1, 0)) * size, math.hypot(abs(i) + 1, abs(j) + 1) * size
        if nearest <= d * (1 + 1e-5):
            steps.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(farthest <= d * (1 - 1e-5)).alias("sure")))
    marks = passed.withColumn("s", F.explode(F.array(*steps))).groupBy((F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy")).agg(F.bool_or("s.sure").alias("sure"))
    met = pin(walk(left, ends, size).join(marks, ["cx", "cy"]).groupBy("lid").agg(F.bool_or("sure").alias("sure")))
    sure = met.where("sure").select("lid")
    todo = _spread_out(left.join(met.where("NOT sure"), "lid", "left_semi"))
    l = walk(_rename(todo, "lid", "lid", L4), [F.col(n) for n in L4], d / 2, d)
    r = walk(_rename(right.withColumn("rid", F.lit(0)), "rid", "rid", R4), [F.col(n) for n in R4], d / 2)
    j = salted_join(_spread_out(l, "cx", "cy"), r, ["cx", "cy"])
    found = j.where(B.segment_distance(*L4, *R4) <= d).select("lid").distinct()
    return sure.unionByName(found).withColumnRenamed("lid", lid)


def count_within(left: DataFrame, points: DataFrame, lid: str, radii: dict[str, float], left_points: bool = False) -> DataFrame:
    """Points strictly closer than each radius of a shape; counted where blocks of shapes and points meet, so no pair travels."""
    at = points.where("abs(x1) < double('inf') AND abs(y1) < double('inf')").select(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")).alias("p"))
    folded = at.groupBy("p").agg(F.count("*").alias("w")).select("p", "p.x", "p.y", "w")
    kind = dict(left.dtypes)[lid]
    schema = f"lid {kind}, " + ", ".join(f"`{n}` bigint" for n in radii)
    counts = B.meet(left.select(F.col(lid).alias("lid"), *ENDS), folded.drop("p").withColumn("rid", F.xxhash64("x", "y")), "lid", "rid", (B.PIECES, B.POINTS), B.counts_kernel("lid", radii), schema)
    counts = counts.groupBy("lid").agg(*[F.sum(n).alias(n) for n in radii])
    ids = left.select(F.col(lid).alias("lid")).distinct()
    return ids.join(counts, "lid", "left").fillna(0, list(radii)).withColumnRenamed("lid", lid)


def points_in_polygons(points: DataFrame, polygons: DataFrame, pid: str, gid: str, cell: float) -> DataFrame:
    """Pairs of points ``(pid, x1, y1)`` and polygons ``(gid, ring)`` that contain them."""
    at = lambda v: F.floor(F.col(v) / F.lit(cell)).cast("bigint")
    p = points.select(F.col(pid).alias("lid"), "x1", "y1", at("x1").alias("cx"), at("y1").alias("cy"))
    g = _ring_cells(polygons, gid, cell)
    j = salted_join(p, g.select("rid", "redges", "cx", "cy"), ["cx", "cy"])
    return j.where(G.inside_edges(F.col("redges"), F.col("x1"), F.col("y1"))).select(F.col("lid").alias(pid), F.col("rid").alias(gid))


def _ring_cells(polygons: DataFrame, gid: str, cell: float) -> DataFrame:
    xs, ys = F.transform("ring", lambda v: v["x"]), F.transform("ring", lambda v: v["y"])
    box = polygons.select(
        F.col(gid).alias("rid"), "ring", G.edges_of(G.close_ring(F.col("ring"))).alias("redges"),
        F.array_min(xs).alias("bx1"), F.array_min(ys).alias("by1"), F.array_max(xs).alias("bx2"), F.array_max(ys).alias("by2"),
    )
    return _cells(box, ("bx1", "by1", "bx2", "by2"), cell, 0.0, "r")


def first_polygon(points: DataFrame, polygons: DataFrame, pid: str, gid: str, cell: float) -> DataFrame:
    """Left join keeping the smallest polygon id per point; points outside every polygon keep null.

    Polygons are tried in order of their ids, four times as many each round, and a point that lies in one takes no part in the next
    round, so a point in very many polygons meets only the first of them."""
    n = polygons.count()
    shares = [FIRST_POLYGONS * 4**k / n for k in range(20) if FIRST_POLYGONS * 4**k < n] if isinstance(polygons.schema[gid].dataType, NumericType) else []
    # the bounds only deal the ids over rounds, so they may be approximate
    bounds = polygons.agg(F.percentile_approx(gid, shares)).first()[0] if shares else []
    todo, found = pin(_spread_out(points)), None
    for low, high in zip([None, *bounds], [*bounds, None]):
        some = polygons
        if low is not None:
            some = some.where(F.col(gid) > low)
        if high is not None:
            some = some.where(F.col(gid) <= high)
        hit = pin(points_in_polygons(todo, _spread_out(some), pid, gid, cell).groupBy(pid).agg(F.min(gid).alias(gid)))
        found = hit if found is None else found.unionByName(hit)
        todo = pin(_spread_out(todo.join(hit.select(pid), pid, "left_anti")))
        if todo.isEmpty():
            break
    return points.select(pid).distinct().join(found, pid, "left")


#: Polygons of the first round of ``first_polygon``.
FIRST_POLYGONS = 500


def within_then_nearest(points: DataFrame, polygons: DataFrame, pid: str, gid: str, cell: float, radius: float) -> DataFrame:
    """Containing polygon, else the nearest one; says which rule matched."""
    inside = pin(first_polygon(points, polygons, pid, gid, cell))
    rest = points.join(inside.where(F.col(gid).isNull()).select(pid), pid, "left_semi")
    done = inside.where(F.col(gid).isNotNull()).select(pid, gid, F.lit("within").alias("method"), F.lit(0.0).alias("dist"))
    if rest.isEmpty():
        return done
    rings = polygons.select(gid, G.close_ring(F.col("ring")).alias("ring"))
    near = nearest_join(rest, line_pieces(rings, gid, "ring"), pid, gid, radius, (True, False))
    return done.unionByName(near.select(pid, gid, F.lit("nearest").alias("method"), "dist"))


def _flat_rings(zones: DataFrame, gid: str, *more: str) -> DataFrame:
    """Zones with the coordinates of their ring's edges as flat arrays and their box; rings without two vertices are left out."""
    ring = F.transform("ring", lambda v: F.struct(v["x"].cast("double").alias("x"), v["y"].cast("double").alias("y")))
    z = zones.where(F.size("ring") >= 2).select(F.col(gid).alias("rid"), *more, G.edges_of(G.close_ring(ring)).alias("e"))
    flat = [F.col(f"e.{end}.{k}").alias(f"{end}{k}") for end in "ab" for k in "xy"]
    z = z.select("rid", *more, *flat)
    box = {"zx1": F.array_min("ax"), "zy1": F.array_min("ay"), "zx2": F.array_max("ax"), "zy2": F.array_max("ay")}
    return z.withColumns(box).where("zx1 IS NOT NULL AND zy1 IS NOT NULL")


def overlay_lengths(lines: DataFrame, zones: DataFrame, lid: str, gid: str) -> DataFrame:
    """Length of every line inside every zone, where positive."""
    kinds = [dict(d.dtypes)[c] for d, c in ((lines, lid), (zones, gid))]
    l = lines.select(F.col(lid).alias("lid"), *ENDS)
    o = B.meet(l, _flat_rings(zones, gid), "lid", "rid", B.OVERLAY, B.overlaps_kernel("lid", "rid"), f"lid {kinds[0]}, rid {kinds[1]}, overlap double", wide=True)
    return o.select(F.col("lid").alias(lid), F.col("rid").alias(gid), "overlap")


def dominant_zone(
    lines: DataFrame, pieces: DataFrame, zones: DataFrame, lid: str, gid: str, length: str, zone: str, subtype: str, outside: str, no_subtype: str
) -> DataFrame:
    """Zone with the longest overlap per line (smallest code, then id, on ties), zone count, flood flag; defaults outside.

    A block of lines and a block of zones leave one row per line, so overlaps never travel."""
    kinds = {**dict(zones.dtypes), "lid": dict(lines.dtypes)[lid]}
    code = F.upper(F.col(zone))
    z = _flat_rings(zones.withColumn("__sfha", code.startswith("A") | code.startswith("V")), gid, zone, subtype, "__sfha")
    kernel = B.best_overlaps_kernel("lid", "rid", [zone, subtype], zone, "__sfha")
    schema = f"lid {kinds['lid']}, rid {kinds[gid]}, overlap double, `{zone}` {kinds[zone]}, `{subtype}` {kinds[subtype]}, zones bigint, flagged boolean"
    part = B.meet(pieces.select(F.col(lid).alias("lid"), *ENDS), z, "lid", "rid", B.DOMINANT, kernel, schema, wide=True)
    best = F.min_by(F.struct(zone, subtype, "overlap"), F.struct(-F.col("overlap"), F.col(zone), F.col("rid")))
    agg = part.groupBy(F.col("lid").alias(lid)).agg(best.alias("b"), F.sum("zones").alias("zone_count"), F.bool_or("flagged").alias("sfha_any"))
    j = lines.select(lid, length).join(agg, lid, "left")
    return j.select(
        lid,
        F.coalesce("b." + zone, F.lit(outside)).alias(zone),
        F.coalesce("b." + subtype, F.lit(no_subtype)).alias(subtype),
        F.coalesce("b.overlap", F.lit(0.0)).alias("overlap"),
        F.coalesce(F.try_divide(F.col("b.overlap"), F.nullif(F.col(length), F.lit(0.0))), F.lit(0.0)).alias("overlap_share"),
        F.coalesce("zone_count", F.lit(0)).alias("zone_count"),
        F.coalesce("sfha_any", F.lit(False)).alias("sfha_any"),
    )


def nearest_by_group(left: DataFrame, right: DataFrame, lid: str, rid: Sequence[str], group: str, d: float, but: DataFrame | None = None) -> DataFrame:
    """Per left piece and group with a right piece within ``d`` of it: the nearest one of the group, ``(group, lid, b<dist, *rid>)``, smallest
    ``rid`` on ties.  Pairs ``but(group, lid)`` are left out.

    Radii fit the crowd and grow up to ``d``; a pair of piece and group that has found something is settled, so the work grows
    with the pairs of the result and not with the pairs of pieces.  A null group is a group."""
    g = F.struct(F.col(group).alias("g"))
    ends = [F.col(n) for n in ENDS]
    finite = reduce(lambda a, b: a & b, [F.abs(e) < math.inf for e in ends])
    left = left.select(F.col(lid).alias("lid"), *ENDS).where(finite)
    right = right.where(finite).select(g.alias("g"), F.struct(*rid).alias("rid"), *ENDS).groupBy("g", *ENDS).agg(F.min("rid").alias("rid"))
    # groups and pairs go by numbers, which join faster
    names = pin(right.select("g").distinct().withColumn("gn", F.monotonically_increasing_id()))
    right = pin(right.join(names, "g").select("gn", "rid", *[F.col(o).alias(n) for o, n in zip(ENDS, R4)]))
    r4, l4 = [F.col(n) for n in R4], [F.col(n) for n in L4]
    met = walk(right, r4, 2 * d).select("gn", "cx", "cy").distinct()
    pairs = salted_join(walk(left, ends, 2 * d, d), met, ["cx", "cy"]).select("gn", "lid", *[F.col(o).alias(n) for o, n in zip(ENDS, L4)]).distinct()
    if but is not None:
        but = but.where(F.col(group).isNotNull()).select(g.alias("g"), F.col(lid).alias("lid")).join(names, "g").select("gn", "lid")
        pairs = pairs.join(but, ["gn", "lid"], "left_anti")
    pairs = pin(_spread_out(pairs).withColumn("n", F.monotonically_increasing_id()))
    size, around = spread(pairs, L4), spread(right, R4)
    r = fitting_cell(size["n"], size["length"], {**around, "n": around["n"] / max(names.count(), 1)}, 2 * d) / 2
    todo, found = pairs.select("n", "gn", *L4), None
    while True:
        j = salted_join(walk(todo, l4, 2 * r, r), walk(right, r4, 2 * r), ["gn", "cx", "cy"])
        # boxes that are farther apart are dropped before the costlier distance
        low, high = (lambda a, b: F.least(a, b) - r), (lambda a, b: F.greatest(a, b) + r)
        meets = [(low(f"l{k}1", f"l{k}2") <= F.greatest(f"r{k}1", f"r{k}2")) & (high(f"l{k}1", f"l{k}2") >= F.least(f"r{k}1", f"r{k}2")) for k in "xy"]
        j = j.where(meets[0] & meets[1]).select("n", "rid", *L4, *R4).withColumn("dist", B.segment_distance(*L4, *R4)).where(F.col("dist") <= r)
        near = pin(j.groupBy("n").agg(F.min(F.struct("dist", "rid")).alias("b")))
        found = near if found is None else found.unionByName(near)
        if r >= d:
            break
        r, todo = min(4 * r, d), pin(_spread_out(todo.join(near.select("n"), "n", "left_anti")))
    best = found.join(pairs.select("n", "gn", "lid"), "n").groupBy("gn", "lid").agg(F.min("b").alias("b")).join(names, "gn")
    return best.select(F.col("g.g").alias(group), F.col("lid").alias(lid), F.struct("b.dist", "b.rid.*").alias("b"))


def storm_exclusions(positives: DataFrame, universe: DataFrame, storm: str, segment: str, d: float) -> DataFrame:
    """Distinct ``(storm, near)`` within ``d`` of the storm's reported segments; no buffer union is ever built."""
    return nearest_by_group(universe.withColumnRenamed(segment, "near"), positives, "near", [segment], storm, d).select(storm, "near")


def unreported_candidates(positives: DataFrame, universe: DataFrame, storm: str, segment: str, event: str, d: float) -> DataFrame:
    """Per storm, unreported segments within ``d`` of a reported one, with the nearest reported event (smallest id on ties)."""
    reported = positives.select(storm, F.col(segment).alias("near")).distinct()
    best = nearest_by_group(universe.withColumnRenamed(segment, "near"), positives, "near", [event, segment], storm, d, reported)
    return best.select(storm, F.col("near").alias("candidate"), F.col("b." + event).alias("nearest_event"), F.col("b." + segment).alias("reported_segment"), F.col("b.dist").alias("dist"))


def raster_samples(lines: DataFrame, cells: DataFrame, lid: str, line: str, length: str, origin: tuple[float, float], step: tuple[float, float]) -> DataFrame:
    """Cell values under the vertices of each line and their summary; cells ``(row, col, value)``, null is no data."""
    v = lines.select(lid, length, F.posexplode(line).alias("i", "v"))
    row = F.floor((F.lit(origin[1]) - F.col("v.y")) / F.lit(step[1])).cast("bigint")
    col = F.floor((F.col("v.x") - F.lit(origin[0])) / F.lit(step[0])).cast("bigint")
    j = salted_join(v.select(lid, length, "i", row.alias("row"), col.alias("col")), cells, ["row", "col"], "left")
    val = F.col("value")
    a = j.groupBy(lid).agg(
        F.min(val).alias("dem_min"), F.max(val).alias("dem_max"), F.avg(val).alias("dem_mean"), F.stddev_pop(val).alias("dem_sd"),
        F.min_by(val, F.when(val.isNotNull(), F.col("i"))).alias("dem_start"), F.max_by(val, F.when(val.isNotNull(), F.col("i"))).alias("dem_end"),
        F.count(val).alias("dem_vertex_n"), F.max(length).alias("__len"),
    )
    slope = F.abs(F.col("dem_end") - F.col("dem_start")) / F.when(F.col("__len") > 0, F.col("__len"))
    return a.withColumn("dem_slope", slope).drop("__len")


def coastward_endpoints(lines: DataFrame, shore: DataFrame, lid: str, line: str, shore_id: str, radius: float) -> DataFrame:
    """End of each line nearer to the shore (the start on ties) with its outward unit direction."""
    l = lines.where(F.size(line) >= 2)
    n = F.size(line)
    ends = l.select(
        lid,
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("k"), F.element_at(line, 1).alias("at"), F.element_at(line, 2).alias("prev")),
                F.struct(F.lit(1).alias("k"), F.element_at(line, -1).alias("at"), F.element_at(F.col(line), n - 1).alias("prev")),
            )
        ).alias("e"),
    ).select(F.struct(F.col(lid).alias("id"), F.col("e.k").alias("k")).alias("eid"), F.col("e.at.x").alias("x"), F.col("e.at.y").alias("y"), "e.prev")
    near = nearest_join(point_pieces(ends, "eid", "x", "y"), shore, "eid", shore_id, radius, (True, False))
    j = ends.join(near, "eid")
    pick = j.groupBy(F.col("eid.id").alias(lid)).agg(F.min(F.struct("dist", F.col("eid.k").alias("k"), "x", "y", "prev", shore_id)).alias("b"))
    dx, dy = F.col("b.x") - F.col("b.prev.x"), F.col("b.y") - F.col("b.prev.y")
    norm = F.nullif(G.hypot(dx, dy), F.lit(0.0))
    return pick.select(
        lid, F.when(F.col("b.k") == 0, "start").otherwise("end").alias("terminal"), F.col("b.dist").alias("shore_distance"), F.col("b.x").alias("ax"), F.col("b.y").alias("ay"),
        (dx / norm).alias("ux"), (dy / norm).alias("uy"), F.col(f"b.{shore_id}").alias("nearest_station"),
    ).where(F.col("ux").isNotNull())


def first_shore_hit(anchors: DataFrame, shore: DataFrame, lid: str, shore_id: str, reach: float, cell: float) -> DataFrame:
    """Nearest shore piece crossed by the ray from each anchor; parallel pieces never count."""
    rays = anchors.select(lid, F.col("ax").alias("x"), F.col("ay").alias("y"), "ux", "uy")
    return first_hits(rays, shore, lid, shore_id, reach, cell).withColumnRenamed("distance", "touch_distance")


def seed_edges(lines: DataFrame, shore: DataFrame, lid: str, line: str, shore_id: str, buffer: float, reach: float, cell: float, keep: int = 3) -> DataFrame:
    """Lines near the shore labelled by the station their ray touches first, else by the nearest one; a few per station."""
    close = pin(lines.join(near_any(line_pieces(lines, lid, line), shore, lid, buffer), lid, "left_semi"))
    anchors = pin(coastward_endpoints(close, shore, lid, line, shore_id, buffer))
    hits = first_shore_hit(anchors, shore, lid, shore_id, reach, cell)
    j = anchors.join(hits, lid, "left")
    s = j.select(
        lid, F.coalesce(shore_id, "nearest_station").alias(shore_id), F.coalesce("touch_distance", "shore_distance").alias("touch_distance"), "terminal", "shore_distance"
    )
    return top_n_per_group(s, [shore_id], [F.col("touch_distance"), F.col(lid)], keep)


def label_lengths(df: DataFrame, label: str, length: str) -> DataFrame:
    """Number of edges and their total length per label; edges without a label are a group of their own."""
    return df.groupBy(label).agg(F.count("*").alias("edges"), F.sum(length).alias("total_length_ft"))


def modal_label(df: DataFrame, key: str, label: str) -> DataFrame:
    """Most frequent label per key, smallest on ties, null labels ignored."""
    counts = df.where(F.col(label).isNotNull()).groupBy(key, label).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias(label), F.sum("n").alias("n"))
