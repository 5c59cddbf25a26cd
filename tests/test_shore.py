import math
import random

from eventloom.operators import cells as C
from eventloom.operators import spatial as S

PIECE = "x1 double, y1 double, x2 double, y2 double"


def to_segment(px, py, x1, y1, x2, y2):
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    t = min(max(((px - x1) * dx + (py - y1) * dy) / size, 0.0), 1.0) if size else 0.0
    return math.hypot(px - x1 - t * dx, py - y1 - t * dy)


def apart(p, q):
    den = (p[2] - p[0]) * (q[3] - q[1]) - (p[3] - p[1]) * (q[2] - q[0])
    if abs(den) > 1e-12:
        t = ((q[0] - p[0]) * (q[3] - q[1]) - (q[1] - p[1]) * (q[2] - q[0])) / den
        u = ((q[0] - p[0]) * (p[3] - p[1]) - (q[1] - p[1]) * (p[2] - p[0])) / den
        if 0 <= t <= 1 and 0 <= u <= 1:
            return 0.0
    return min(to_segment(*p[:2], *q), to_segment(*p[2:], *q), to_segment(*q[:2], *p), to_segment(*q[2:], *p))


def test_shapes_near_any_piece_equal_brute_force_and_few_measure_distances(spark, monkeypatch):
    rng = random.Random(4)
    some = lambda n, cx, long: [(x := rng.gauss(cx, 40), y := rng.gauss(0, 40), x + rng.gauss(0, long), y + rng.gauss(0, long)) for _ in range(n)]
    left, right = some(300, -120, 15), some(200, 60, 8)
    rows = [(i % 280, *p) for i, p in enumerate(left)] + [(900, math.nan, 0.0, 1.0, 1.0), (901, None, 0.0, 1.0, 1.0)]
    pairs, plain = [], S.salted_join
    monkeypatch.setattr(S, "salted_join", lambda *a: pairs.append(plain(*a).count()) or plain(*a))
    got = S.near_any(spark.createDataFrame(rows, "lid long, " + PIECE), spark.createDataFrame(right, PIECE), "lid", 30.0).collect()
    want = {i % 280 for i, p in enumerate(left) if any(apart(p, q) <= 30.0 for q in right)}
    assert sorted(r.lid for r in got) == sorted(want) and 30 < len(want) < 270
    inside = sum(apart(p, q) <= 30.0 for p in left for q in right)
    assert sum(pairs) < inside


def test_rays_look_at_the_edge_of_a_crowd_only(spark, monkeypatch):
    rng = random.Random(8)
    walls = [(i, x := 30 + 0.01 * i + rng.random() * 0.001, -20.0, x + 0.002, 20.0) for i in range(2000)]
    loose = [(5000 + i, x := rng.uniform(-80, 20), y := rng.uniform(-60, 60), x + rng.gauss(0, 2), y + rng.gauss(0, 2)) for i in range(60)]
    rays = [(i, rng.uniform(-60, 0), rng.uniform(-15, 15), math.cos(a := rng.gauss(0, 0.7)), math.sin(a)) for i in range(40)] + [(40, -5.0, 0.0, 1.0, 0.0), (41, 0.0, 0.0, 0.0, 1.0)]
    pairs, plain = [], C.salted_join
    monkeypatch.setattr(C, "salted_join", lambda *a: pairs.append(plain(*a).count()) or plain(*a))
    got = C.first_hits(spark.createDataFrame(rays, "ray long, x double, y double, ux double, uy double"), spark.createDataFrame(walls + loose, "piece long, " + PIECE), "ray", "piece", 100.0, 2.0)
    want = {}
    for i, x, y, ux, uy in rays:
        for j, x1, y1, x2, y2 in walls + loose:
            den = 100 * ux * (y2 - y1) - 100 * uy * (x2 - x1)
            if den:
                t = ((x1 - x) * (y2 - y1) - (y1 - y) * (x2 - x1)) / den
                u = ((x1 - x) * 100 * uy - (y1 - y) * 100 * ux) / den
                if 0 <= t <= 1 and 0 <= u <= 1:
                    want[i] = min(want.get(i, (2.0, 0)), (t, j))
    assert {r.ray: (r.piece, round(r.distance, 6)) for r in got.collect()} == {i: (j, round(t * 100, 6)) for i, (t, j) in want.items()} and len(want) > 20
    assert sum(pairs) < 42 * 1000
