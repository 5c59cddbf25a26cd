import math
import random

import pytest

from eventloom.operators import spatial as S
from eventloom.operators.cells import fitting_cell


def _apart(p, s):
    (x, y), (x1, y1, x2, y2) = p, s
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    t = min(max(((x - x1) * dx + (y - y1) * dy) / n, 0.0), 1.0) if n else 0.0
    return math.hypot(x - x1 - t * dx, y - y1 - t * dy)


@pytest.mark.parametrize("points", [(True, True), (True, False), (False, True)])
def test_crowded_far_and_repeated_places_have_their_nearest_shape(spark, points):
    rng = random.Random(3)
    place = lambda mx, sd: (rng.gauss(mx, sd), rng.gauss(0, sd))

    def pieces(n, mx, point):
        out = []
        for i in range(n):
            x, y = place(mx, 40.0)
            dx, dy = (0.0, 0.0) if point else place(0.0, 30.0)
            out += [(i, x, y, x + dx, y + dy)] * (1 if i % 5 else 2)
        return out

    left, right = pieces(120, 0.0, points[0]), pieces(300, 250.0, points[1])
    right += [(r[0] + 1000, *r[1:]) for r in right]  # copies: the smaller id is the answer
    names = "id int, x1 double, y1 double, x2 double, y2 double"
    near = S.nearest_join(spark.createDataFrame(left, names).withColumnRenamed("id", "a"), spark.createDataFrame(right, names).withColumnRenamed("id", "b"), "a", "b", 20.0, points)
    got = {r.a: (r.b, round(r.dist, 6)) for r in near.collect()}
    want = {}
    for i, *l in left:
        d = min((round(_apart(l[:2], r), 9) if points[0] else round(_apart(r[:2], l), 9), b) for b, *r in right)
        want[i] = (d[1], round(d[0], 6))
    assert got == want


def test_cells_shrink_with_the_crowd_so_that_candidates_grow_as_the_rows():
    seen = {}
    for n in (10_000, 1_000_000):
        c = fitting_cell(n, 0.0, {"n": n, "length": 0.0, "area": 200_000.0}, 40.0)
        seen[n] = n * (c / 2 * 4) ** 2 / 200_000.0
    assert seen[1_000_000] < 3 * seen[10_000] + 50


def test_points_in_many_polygons_meet_the_first_ones_only(spark, monkeypatch):
    rng = random.Random(4)
    rings = [(i, [(x - 9, y - 9), (x + 9, y - 9), (x + 9, y + 9), (x - 9, y + 9)]) for i in range(40) for x, y in [(rng.gauss(0, 8), rng.gauss(0, 8))]]
    pts = [(i, rng.gauss(0, 9), rng.gauss(0, 9)) for i in range(60)] + [(99, 500.0, 500.0)]
    met, plain = [], S.points_in_polygons
    monkeypatch.setattr(S, "FIRST_POLYGONS", 2)
    monkeypatch.setattr(S, "points_in_polygons", lambda p, *rest: met.append(p.count()) or plain(p, *rest))
    polygons = spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in ring]) for i, ring in rings], "gid int, ring array<struct<x: double, y: double>>")
    got = {r.pid: r.gid for r in S.first_polygon(spark.createDataFrame(pts, "pid int, x1 double, y1 double"), polygons, "pid", "gid", 5.0).collect()}
    inside = lambda x, y, ring: ring[0][0] <= x < ring[2][0] and ring[0][1] <= y < ring[2][1]
    assert got == {i: min((g for g, ring in rings if inside(x, y, ring)), default=None) for i, x, y in pts}
    assert len(met) > 1 and met[-1] < met[0]
