import functools
import math
import random

from eventloom.operators import spatial as S
from tests.test_nearest import _apart


def _gap(p, q):
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    a, b, c, d = p[:2], p[2:], q[:2], q[2:]
    if cross(a, b, c) * cross(a, b, d) < 0 and cross(c, d, a) * cross(c, d, b) < 0:
        return 0.0
    return min(_apart(a, q), _apart(b, q), _apart(c, p), _apart(d, p))


@functools.cache
def _known(p, q):
    return _gap(p, q)


def test_segments_find_the_nearest_of_every_storm_and_leave_the_search(spark, monkeypatch):
    rng = random.Random(8)
    segs = []
    for i in range(400):
        x, y = rng.gauss(0, 6), rng.gauss(0, 6)
        segs.append((i, i % 3 if i % 10 else None, x, y, x + rng.gauss(0, 0.5), y + rng.gauss(0, 0.5)))
    segs.append((600, 1, 500.0, 500.0, 501.0, 500.0))
    pos = [s for s in segs if s[0] % 2 == 0]
    df = lambda rows: spark.createDataFrame(rows, "sid int, storm int, x1 double, y1 double, x2 double, y2 double")
    rounds, plain = [], S.walk
    monkeypatch.setattr(S, "walk", lambda df, *a: (rounds.append(df.count()) if "n" in df.columns else None) or plain(df, *a))
    monkeypatch.setattr("eventloom.operators.cells.ROUND_COST", 0)
    positives = df(pos).selectExpr("*", "sid + 1000 AS event")
    got = {(r.storm, r.candidate): (r.nearest_event, r.reported_segment, r.dist) for r in S.unreported_candidates(positives, df(segs), "storm", "sid", "event", 12.0).collect()}
    want = {}
    for s in segs:
        for storm in (None, 0, 1, 2):
            mine = [p for p in pos if p[1] == storm]
            if storm is not None and any(p[0] == s[0] for p in mine):
                continue
            dist = [(_known(s[2:], p[2:]), p[0]) for p in mine]
            if dist and min(dist)[0] <= 12.0:
                d, rep = min((round(d, 9), i) for d, i in dist)
                want[storm, s[0]] = (rep + 1000, rep, d)
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    assert all(math.isclose(got[k][2], want[k][2], abs_tol=1e-6) for k in want)
    assert len(rounds) > 1 and rounds[-1] < rounds[0] / 2  # what has found its nearest one takes no part in larger radii
    out = {(r.storm, r.near) for r in S.storm_exclusions(positives, df(segs), "storm", "sid", 12.0).collect()}
    assert out == {(storm, s[0]) for s in segs for storm in (None, 0, 1, 2) if any(p[1] == storm and _known(s[2:], p[2:]) <= 12.0 for p in pos)}
