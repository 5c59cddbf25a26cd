"""Cell walks, ray search and polygon covers against literal shapes and brute force."""

import math
import random

from pyspark.sql import functions as F

from eventloom.operators.cells import boundary_filter, first_hits, inner_points, points_in_cover, polygon_cover, walked_cells

# fixed values: a square of side 10 with a notch cut down from its upper edge
NOTCHED = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (6.0, 10.0), (5.0, 2.0), (4.0, 10.0), (0.0, 10.0)]


def ring_frame(spark, rows, schema="gid string, ring array<struct<x: double, y: double>>"):
    return spark.createDataFrame(rows, schema)


def odd(ring, x, y):
    inside = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            inside = not inside
    return inside


def test_cells_of_a_segment_grow_with_its_length(spark):
    rows = [(float(n), 0.3 * n, n * math.cos(a), n * math.sin(a)) for n in (1, 10, 100, 1000) for a in (0.0, 0.7, math.pi / 2, 2.2, 4.0)]
    df = spark.createDataFrame(rows, "x1 double, y1 double, dx double, dy double")
    x1, y1 = F.col("x1"), F.col("y1")
    got = df.select("*", walked_cells(x1, y1, x1 + F.col("dx"), y1 + F.col("dy"), 2.0).alias("c")).collect()
    for r in got:
        cells = {(c.cx, c.cy) for c in r.c}
        length = math.hypot(r.dx, r.dy)
        assert len(r.c) <= 6 + 3 * length / 2.0
        for i in range(401):  # every place on the segment lies in a walked cell
            t = i / 400
            assert (math.floor((r.x1 + t * r.dx) / 2), math.floor((r.y1 + t * r.dy) / 2)) in cells


def test_first_hit_is_the_nearest_along_the_ray(spark):
    rng = random.Random(5)
    pieces = [(i, rng.uniform(-80, 80), rng.uniform(-80, 80)) for i in range(120)]
    pieces = [(i, x, y, x + rng.uniform(-15, 15), y + rng.uniform(-15, 15)) for i, x, y in pieces]
    rays = []
    for i in range(80):
        a = rng.uniform(0, 2 * math.pi)
        rays.append((i, rng.uniform(-60, 60), rng.uniform(-60, 60), math.cos(a), math.sin(a)))
    rays += [(900, None, 0.0, 1.0, 0.0), (901, 0.0, 0.0, float("nan"), 0.0), (902, 500.0, 500.0, 1.0, 0.0)]
    want = {}
    for i, x, y, ux, uy in rays[:80]:
        for p, x1, y1, x2, y2 in pieces:
            den = ux * (y2 - y1) - uy * (x2 - x1)
            if abs(den) < 1e-12:
                continue
            t, u = ((x1 - x) * (y2 - y1) - (y1 - y) * (x2 - x1)) / den, ((x1 - x) * uy - (y1 - y) * ux) / den
            if 0 <= t <= 70 and 0 <= u <= 1:
                want[i] = min(want.get(i, (1e9, 0)), (t, p))
    r = spark.createDataFrame(rays, "ray int, x double, y double, ux double, uy double")
    p = spark.createDataFrame(pieces + [(999, None, 0.0, 1.0, 1.0)], "piece int, x1 double, y1 double, x2 double, y2 double")
    got = {x.ray: (x.distance, x.piece) for x in first_hits(r, p, "ray", "piece", 70.0, 6.0).collect()}
    assert got.keys() == want.keys() and len(want) > 30
    assert all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-6 for k in want)
    assert first_hits(r, p.limit(0), "ray", "piece", 70.0, 6.0).count() == 0


def test_points_in_a_cover_follow_the_even_odd_rule(spark):
    rng = random.Random(9)
    star = [((4 if i % 2 else 11) * math.cos(i * math.pi / 7) + 2, (4 if i % 2 else 11) * math.sin(i * math.pi / 7) - 1) for i in range(14)]
    shapes = ring_frame(spark, [("star", star), ("notched", NOTCHED), ("flat", [(0.0, 0.0), (1.0, 1.0)])])
    pts = [(i, rng.uniform(-13, 15), rng.uniform(-13, 15)) for i in range(1500)]
    want = {(i, n) for i, x, y in pts for n, ring in (("star", star), ("notched", NOTCHED)) if odd(ring, x, y)}
    points = spark.createDataFrame(pts + [(9999, None, 1.0)], "pid int, x double, y double")
    for cell in (0.7, 3.0, 50.0):
        got = {tuple(r) for r in points_in_cover(points, polygon_cover(shapes, "gid", cell), "pid", "gid", cell).collect()}
        assert got == want


def test_holes_and_parts_share_an_id(spark):
    box = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    shape = ring_frame(spark, [("z", box(0.0, 9.0)), ("z", box(3.0, 6.0)), ("z", box(20.0, 22.0))])
    pts = spark.createDataFrame([(1, 1.0, 1.5), (2, 4.5, 4.4), (3, 21.0, 21.2), (4, 12.0, 12.0)], "pid int, x double, y double")
    got = {r.pid for r in points_in_cover(pts, polygon_cover(shape, "gid", 1.3), "pid", "gid", 1.3).collect()}
    assert got == {1, 3}


def test_boundary_keeps_zones_that_share_an_area(spark):
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    zones = [
        ("inside", box(1.0, 1.0, 1.0, 1.0)), ("around", box(-5.0, -5.0, 30.0, 30.0)), ("same", NOTCHED), ("crossing", box(8.0, 8.0, 9.0, 9.0)),
        ("in_notch", box(4.9, 8.0, 0.2, 1.0)), ("spans_notch", box(3.0, 8.0, 4.0, 1.0)), ("beside", box(10.0, 0.0, 3.0, 10.0)), ("corner", box(10.0, 10.0, 2.0, 2.0)),
        ("line", [(1.0, 1.0), (3.0, 3.0), (2.0, 2.0)]), ("two_points", [(1.0, 1.0), (2.0, 2.0)]), ("none", None), ("far", box(70.0, 70.0, 1.0, 1.0)), ("far", box(2.0, 5.0, 1.0, 1.0)),
    ]
    edge = ring_frame(spark, [("b", NOTCHED)])
    for cell in (0.9, 4.0):
        got = {r.gid for r in boundary_filter(ring_frame(spark, zones), edge, "gid", cell).collect()}
        assert got == {"inside", "around", "same", "crossing", "spans_notch", "far"}
    assert boundary_filter(ring_frame(spark, zones), edge.limit(0), "gid", 2.0).count() == 0
    assert boundary_filter(ring_frame(spark, []), edge, "gid", 2.0).count() == 0


def test_inner_points_are_inside(spark):
    rows = [("n", NOTCHED), ("t", [(0.0, 0.0), (4.0, 1.0), (1.0, 5.0)]), ("flat", [(0.0, 1.0), (5.0, 1.0), (2.0, 1.0)]), ("none", None)]
    got = {r.gid: r for r in inner_points(ring_frame(spark, rows), "gid").collect()}
    assert set(got) == {"n", "t"} and all(odd(ring, got[g].x, got[g].y) for g, ring in rows[:2])
