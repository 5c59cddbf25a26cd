import random

from eventloom.operators import blocks as B
from eventloom.operators import spatial as S
from tests.test_nearest import _apart

PIECE = "lid int, x1 double, y1 double, x2 double, y2 double"
ZONE = "gid int, zone string, sub string, ring array<struct<x: double, y: double>>"


def _lines(rng, n):
    out = []
    for i in range(n):
        at = [(rng.gauss(0, 60), rng.gauss(0, 60)) for _ in range(3)]
        out += [(i, *a, *b) for a, b in zip(at, at[1:])]
    return out + [(n, 5000.0, 5000.0, 5001.0, 5000.0), (n + 1, None, 0.0, 1.0, 1.0)]


def test_counts_within_leave_no_pairs_between_tasks(spark):
    rng = random.Random(5)
    lines = _lines(rng, 40)
    pts = [(i, rng.gauss(0, 60), rng.gauss(0, 60)) for i in range(400)]
    pts += [(1000 + i, *p[1:]) for i, p in enumerate(pts[:50])] + [(2000, None, 1.0)]
    left, points = spark.createDataFrame(lines, PIECE), spark.createDataFrame(pts, "pid int, x1 double, y1 double")
    df = S.count_within(left, points, "lid", {"near": 10.0, "far": 25.0})
    # a join of pieces with points and a regrouping by pair would be a join by cell and an aggregate of (line, point)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "cx" not in plan
    got = {r.lid: (r.near, r.far) for r in df.collect()}
    want = {}
    for lid in {l[0] for l in lines}:
        mine = [l[1:] for l in lines if l[0] == lid and None not in l]
        dist = [min((_apart(p[1:], m) for m in mine), default=9e9) for p in pts if None not in p]
        want[lid] = (sum(d < 10 for d in dist), sum(d < 25 for d in dist))
    assert got == want


def _zones(rng, n):
    out = []
    for i in range(n):
        x, y = rng.gauss(0, 60), rng.gauss(0, 60)
        ring = [(x - 15, y - 9), (x + 15, y - 9), (x + 15, y + 9), (x - 15, y + 9)]
        if i % 3 == 0:  # a notch: not convex
            ring.insert(1, (x, y + 4))
        out.append((i, ("AE", "X", None)[i % 3], None if i % 4 == 0 else f"Z{i % 4}", [{"x": a, "y": b} for a, b in ring]))
    # a copy of another one under a later id loses the tie
    return out + [(n, out[1][1], "copy", out[1][3]), (n + 1, "X", "empty", None)]


def _length_inside(piece, ring, steps=4000):
    x1, y1, x2, y2 = piece
    n = 0
    for k in range(steps):
        t = (k + 0.5) / steps
        x, y = x1 + (x2 - x1) * t, y1 + (y2 - y1) * t
        odd = False
        for a, b in zip(ring, ring[1:] + ring[:1]):
            if (a["y"] > y) != (b["y"] > y) and x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]:
                odd = not odd
        n += odd
    return n / steps * ((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5


def test_overlaps_and_the_dominant_zone_match_a_sampled_line(spark, monkeypatch):
    monkeypatch.setattr(B, "AT_ONCE", 50)  # many cuts of a strip
    rng = random.Random(6)
    lines, zones = _lines(rng, 12), _zones(rng, 25)
    left, z = spark.createDataFrame(lines, PIECE), spark.createDataFrame(zones, ZONE)
    got = {(r.lid, r.gid): r.overlap for r in S.overlay_lengths(left, z, "lid", "gid").collect()}
    want = {}
    for lid, *piece in lines:
        for gid, _, _, ring in zones:
            if ring and None not in piece:
                want[lid, gid] = want.get((lid, gid), 0.0) + _length_inside(piece, ring)
    want = {k: v for k, v in want.items() if v > 0.2}
    assert set(want) <= set(got) and all(abs(got[k] - want.get(k, 0.0)) < 0.4 for k in got)

    whole = spark.createDataFrame([(i, 100.0) for i in sorted({l[0] for l in lines})], "lid int, len double")
    d = {r.lid: r for r in S.dominant_zone(whole, left, z, "lid", "gid", "len", "zone", "sub", "OUT", "NONE").collect()}
    for lid, r in d.items():
        mine = {g: v for (l, g), v in got.items() if l == lid}
        assert r.zone_count == len(mine)
        if not mine:
            assert (r.zone, r.sub, r.overlap, r.sfha_any) == ("OUT", "NONE", 0.0, False)
            continue
        kind = {g: (code, sub) for g, code, sub, _ in zones}
        best = min(mine, key=lambda g: (-mine[g], kind[g][0] or "", g))
        assert (r.zone, r.sub, r.overlap) == (kind[best][0] or "OUT", kind[best][1] or "NONE", mine[best])
        assert r.sfha_any == any(kind[g][0] == "AE" for g in mine)
