"""Operators against literal fixtures and brute force, with the boundary rules and skewed keys."""

import heapq
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventloom.functions import geometry as G
from eventloom.functions import text as X
from eventloom.operators import controls as K
from eventloom.operators import graph as N
from eventloom.operators import intervals as I
from eventloom.operators import joins as J
from eventloom.operators import sampling as S
from eventloom.operators.ordered import CHUNK, chunked_prefix, global_row_number
from eventloom.operators.quantiles import exact_quantiles
from eventloom.sources import windows as W
from eventloom.sources.requests import clean_requests

T0 = datetime(2024, 1, 1)


def h(x):
    return T0 + timedelta(hours=x)


def merge(spark, rows, **kw):
    df = spark.createDataFrame(rows, "k string, s timestamp_ntz, e timestamp_ntz, status int")
    return [tuple(r) for r in I.interval_merge(df, "k", "s", "e", "status", **kw).select("start", "end", "n_complaints", "status").orderBy("start").collect()]


def test_touching_intervals_merge_and_gaps_split(spark):
    rows = [("a", h(0), h(2), 1), ("a", h(2), h(3), 1), ("a", h(3.01), h(4), 1)]
    assert merge(spark, rows) == [(h(0), h(3), 2, 1), (h(3.01), h(4), 1, 1)]


def test_open_member_swallows_later_history(spark):
    rows = [("a", h(0), h(1), 1), ("a", h(5), None, 0), ("a", h(500), h(501), 1)]
    assert merge(spark, rows) == [(h(0), h(1), 1, 1), (h(5), None, 2, 2)]


def test_gap_of_exactly_24_hours_does_not_split(spark):
    rows = [("a", h(0), None, 0), ("a", h(24), None, 0), ("a", h(48.01), None, 0)]
    assert merge(spark, rows) == [(h(0), h(48), 2, 0), (h(48.01), h(72.01), 1, 0)]
    assert merge(spark, rows, open_end="max_start")[0][1] == h(24)


def test_storms_split_strictly_after_the_gap(spark):
    rows = [(1, h(0), h(1)), (2, h(7), h(8)), (3, h(14.01), h(15))]
    df = spark.createDataFrame(rows, "id long, s timestamp_ntz, e timestamp_ntz")
    ids = {r["id"]: r["storm_event_id"] for r in I.storm_clusters(df, "s", "e").collect()}
    assert ids == {1: "STORM_00001", 2: "STORM_00001", 3: "STORM_00002"}


def test_range_joins_equal_brute_force_with_a_hot_key(spark):
    rng = random.Random(3)
    left = [(i, "hot" if rng.random() < 0.6 else f"k{rng.randrange(4)}", h(rng.uniform(0, 300))) for i in range(300)]
    right = [(i, "hot" if rng.random() < 0.6 else f"k{rng.randrange(4)}", a := h(rng.uniform(0, 300)), a + timedelta(hours=rng.uniform(0, 60))) for i in range(80)]
    p = spark.createDataFrame(left, "pid long, k string, t timestamp_ntz")
    q = spark.createDataFrame(right, "rid long, k string, s timestamp_ntz, e timestamp_ntz")
    got = sorted((r["pid"], r["rid"]) for r in J.point_interval_join(p, q, ["k"], "t", "s", "e", 36000).collect())
    assert got == sorted((i, j) for i, k, t in left for j, k2, s, e in right if k == k2 and s <= t <= e)
    spans = spark.createDataFrame([(i, k, t, t + timedelta(hours=20)) for i, k, t in left], "pid long, k string, a timestamp_ntz, b timestamp_ntz")
    got = sorted((r["pid"], r["rid"]) for r in J.overlap_join(spans, q, ["k"], ("a", "b"), ("s", "e"), 36000).collect())
    assert got == sorted((i, j) for i, k, t in left for j, k2, s, e in right if k == k2 and s <= t + timedelta(hours=20) and e >= t)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.range(500).select(F.col("id"), F.when(F.col("id") < 400, 1).otherwise(F.col("id") % 7).alias("k"))
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (9, "d")], "k long, v string")
    a = sorted(map(str, J.salted_join(left, right, ["k"], how, rows_per_task=20).select(*left.join(right, "k", how).columns).collect()))
    assert a == sorted(map(str, left.join(right, "k", how).collect()))


def test_chunked_prefix_equals_plain_running_values(spark):
    rng = random.Random(1)
    rows = [("a" if rng.random() < 0.7 else "b", i, rng.choice([None, rng.randrange(50)])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, t long, v long").withColumn(CHUNK, F.floor(F.col("t") / 9).cast("bigint"))
    out = chunked_prefix(df, ["k"], ["t"], {"m": ("prev_max", F.col("v")), "l": ("prev_last", F.col("v")), "n": ("next_first", F.col("v")), "s": ("cum_sum", F.coalesce("v", F.lit(0)))})
    for r in out.collect():
        mine = [x for x in rows if x[0] == r["k"]]
        before = [v for _, t, v in mine if t < r["t"] and v is not None]
        after = [v for _, t, v in mine if t > r["t"] and v is not None]
        assert r["m"] == (max(before) if before else None)
        assert r["l"] == (before[-1] if before else None)
        assert r["n"] == (after[0] if after else None)
        assert r["s"] == sum(v or 0 for _, t, v in mine if t <= r["t"])


def test_global_numbers_follow_the_order(spark):
    df = spark.range(0, 1000, 1, 7).select(F.col("id"), (F.col("id") * 7919 % 31).alias("v"))
    got = [(r["v"], r["id"]) for r in global_row_number(df, ["v", "id"]).orderBy("rn").collect()]
    assert got == sorted(got) and len(got) == 1000


@pytest.mark.parametrize("n", [1, 2, 3, 10, 997])
def test_exact_quantiles_match_linear_interpolation(spark, n):
    rng = random.Random(n)
    vals = sorted(float(rng.choice([5, rng.randrange(1000)])) for _ in range(n))
    df = spark.createDataFrame([("g", v) for v in vals] + [("h", None)], "k string, v double")
    probs = {f"p{i}": p for i, p in enumerate([0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0])}
    row = exact_quantiles(df, ["k"], "v", probs, accuracy=200).first()
    for name, p in probs.items():
        pos = p * (n - 1)
        lo, hi = math.floor(pos), math.ceil(pos)
        assert row[name] == pytest.approx(vals[lo] + (vals[hi] - vals[lo]) * (pos - lo)), (n, p)


def test_checked_join_rejects_duplicates(spark):
    a = spark.createDataFrame([(1,)], "k long")
    b = spark.createDataFrame([(1, 1), (1, 2)], "k long, v long")
    with pytest.raises(ValueError):
        J.checked_join(a, b, ["k"])
    with pytest.raises(ValueError):
        J.strict_lookup(a, spark.createDataFrame([(1, None)], "k long, v long"), ["k"], ["v"])


def test_month_windows(spark):
    d = spark.createDataFrame([("2020-01-15", "2020-03-01")], "a string, b string").select(F.col("a").cast("date").alias("a"), F.col("b").cast("date").alias("b"))
    got = [(str(r[0]), str(r[1])) for r in d.select(F.inline(W.anniversary_months(F.col("a"), F.col("b")))).collect()]
    assert got == [("2020-01-15", "2020-02-15"), ("2020-02-15", "2020-03-01")]
    with pytest.raises(Exception):
        d.select(F.inline(W.anniversary_months(F.col("a"), F.col("a")))).collect()


def test_clean_requests_keeps_one_typed_row(spark):
    rows = [("1", "2020-01-01T00:00:00", None, "40.7", "-73.9"), ("1", "2020-01-01T00:00:00", None, "40.7", "-73.9"), ("2", "bad", None, "40.7", "-73.9"), ("3", "2020-01-02", None, None, "-73.9")]
    got = clean_requests(spark.createDataFrame(rows, "unique_key string, created_date string, closed_date string, latitude string, longitude string")).collect()
    assert [r["unique_key"] for r in got] == ["1"]
    assert got[0]["created_date"] == datetime(2020, 1, 1) and got[0]["latitude"] == 40.7


def test_text_rules(spark):
    df = spark.createDataFrame([("123 E. 45th  St & Café Blvd",), ("12-34 Main St",), ("  ",), ("ﬁne Ave",)], "t string")
    got = [r[0] for r in df.select(X.clean_text(F.col("t"))).collect()]
    assert got == ["EAST 45TH STREET AND CAFE BOULEVARD", "34 MAIN STREET", None, "FINE AVENUE"]
    ids = spark.createDataFrame([("0012.0",), ("A-007",), ("000",), ("x",), (None,)], "t string")
    assert [r[0] for r in ids.select(X.normalize_segment_id(F.col("t"))).collect()] == ["12", "7", "0", None, None]
    assert ids.select(X.normalize_segment_id(F.col("t"), decimal_rule=False)).first()[0] == "120"


def test_projection_of_a_known_point_and_round_trip(spark):
    df = spark.createDataFrame([(-73.98566, 40.74844)], "lon double, lat double")
    x, y = G.lonlat_to_feet(F.col("lon"), F.col("lat"))
    lon, lat = G.feet_to_lonlat(x, y)
    r = df.select(x, y, lon, lat).first()
    assert r[0] == pytest.approx(988_218, abs=60) and r[1] == pytest.approx(211_954, abs=120)
    assert r[2] == pytest.approx(-73.98566, abs=1e-9) and r[3] == pytest.approx(40.74844, abs=1e-9)


# ---- graphs ----
def random_graph(seed, n, m):
    rng = random.Random(seed)
    return [(i, rng.randrange(n), rng.randrange(n)) for i in range(m)]


def component_of(nodes, edges):
    lab = {v: v for v in nodes}
    for _ in nodes:
        for _, a, b in edges:
            if a in lab and b in lab:
                lab[a] = lab[b] = min(lab[a], lab[b])
    return lab


@pytest.mark.parametrize("seed", [1, 2])
def test_bridges_and_articulation_match_removal(spark, seed):
    edges = random_graph(seed, 22, 26) + [(100, 3, 4), (101, 3, 4)]
    simple = [e for e in edges if e[1] != e[2]]
    nodes = {v for _, a, b in simple for v in (a, b)}
    count = lambda ns, es: len(set(component_of(ns, es).values()))
    base = count(nodes, simple)
    bridges = {e[0] for e in simple if count(nodes, [x for x in simple if x != e]) > base}
    cuts = {v for v in nodes if count(nodes - {v}, simple) > base - (1 if all(v not in (a, b) or a == b for _, a, b in simple) else 0)}
    got = N.cut_structure(spark.createDataFrame(edges, "edge_id long, src long, dst long"))
    assert {r[0] for r in got["bridges"].collect()} == bridges
    assert {r[0] for r in got["articulation"].collect()} == cuts
    lab = component_of(nodes, simple)
    assert {r["node"]: r["component"] for r in got["components"].collect()} == lab


def test_a_long_path_takes_logarithmic_rounds(spark, monkeypatch):
    rounds = []
    for name in ("pin", "tabled"):
        monkeypatch.setattr(N, name, lambda df, keep=getattr(N, name): rounds.append(1) or keep(df))
    path = spark.range(4999).select(F.col("id").alias("edge_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    loop = path.union(spark.createDataFrame([(9999, 4999, 4000)], path.schema))
    got = N.cut_structure(loop)
    assert got["bridges"].count() == 4000 and got["articulation"].count() == 4000
    assert len(rounds) < 60, len(rounds)


def test_range_extremes_equal_a_scan(spark):
    rng = random.Random(8)
    points = [(k, at, rng.randrange(100), rng.randrange(100)) for k in "ab" for at in rng.sample(range(90), 25)]
    ranges = [("ab"[i % 2], i, lo := rng.randrange(90), lo + rng.randrange(60)) for i in range(80)]
    got = N.range_extremes(spark.createDataFrame(points, "key string, at long, low long, high long"), spark.createDataFrame(ranges, "key string, id long, first long, last long"), "key")
    want = {}
    for k, i, lo, hi in ranges:
        inside = [p for p in points if p[0] == k and lo <= p[1] <= hi]
        if inside:
            want[i] = (min(p[2] for p in inside), max(p[3] for p in inside))
    assert {r["id"]: (r["low"], r["high"]) for r in got.collect()} == want


def test_betweenness_matches_brandes(spark):
    rng = random.Random(5)
    edges = [(i, rng.randrange(9), rng.randrange(9), float(rng.choice([1, 1, 2, 3]))) for i in range(30)]
    edges = [e for e in edges if e[1] != e[2]]
    nodes = sorted({v for _, a, b, _ in edges for v in (a, b)})
    nb, eb = dict.fromkeys(nodes, 0.0), {e[0]: 0.0 for e in edges}
    for s in nodes:
        dist, heap = {s: 0.0}, [(0.0, s)]
        while heap:
            d, v = heapq.heappop(heap)
            for _, a, b, w in edges:
                if a == v and d + w < dist.get(b, math.inf):
                    dist[b] = d + w
                    heapq.heappush(heap, (d + w, b))
        order = sorted(dist, key=dist.get)
        tight = [e for e in edges if e[1] in dist and abs(dist[e[1]] + e[3] - dist[e[2]]) < 1e-12]
        sigma = dict.fromkeys(order, 0.0)
        sigma[s] = 1.0
        for v in order:
            for _, a, b, _ in tight:
                if a == v:
                    sigma[b] += sigma[v]
        delta = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for i, a, b, _ in tight:
                if b == v:
                    part = sigma[a] / sigma[v] * (1 + delta[v])
                    delta[a] += part
                    eb[i] += part
            if v != s:
                nb[v] += delta[v]
    got = N.betweenness(spark.createDataFrame(edges, "edge_id long, src long, dst long, weight double"))
    assert {r["node"]: round(r["betweenness"], 6) for r in got["nodes"].collect()} == {k: round(v, 6) for k, v in nb.items()}
    assert {r["edge_id"]: round(r["edge_betweenness"], 6) for r in got["edges"].collect()} == {k: round(v, 6) for k, v in eb.items()}


def test_snapping_is_transitive_within_a_level(spark):
    rows = [(0, "1", 0.0, 0.0), (1, "1", 10.0, 0.0), (2, "1", 4.0, 0.0), (3, "2", 0.0, 0.0), (4, "1", 8.0, 0.0), (5, "1", 30.0, 0.0)]
    got = {r["idx"]: r["node_id"] for r in N.snap_endpoints(spark.createDataFrame(rows, "idx long, level string, x double, y double"), 5.0).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 4: 0, 3: 1, 5: 2}


# ---- matched controls ----
def test_matched_controls_keep_the_rules_of_every_level(spark):
    rng = random.Random(11)
    seg = [(i, f"r{rng.randrange(2)}", f"e{rng.randrange(2)}", "big" if rng.random() < 0.7 else f"b{rng.randrange(2)}") for i in range(40)]
    keys = {s[0]: (f"{s[3]}|{s[1]}|{s[2]}", f"{s[3]}|{s[2]}", s[3]) for s in seg}
    pos = []
    for i in range(300):
        s, t = rng.choice(seg), h(0 if i < 80 else rng.randrange(12))
        storm = None if i % 50 == 49 else f"S{t.hour // 4}"
        pos.append((i, t, t + timedelta(hours=1), storm, s[0], *(keys[s[0]] if i % 60 else ("none", "none", "none"))))
    flags = {(p[3], p[4]) for p in pos if p[3] and p[0] % 9 == 0} | {(p[3], (p[4] + 1) % 40) for p in pos if p[3] and p[0] % 9 == 0} | {("S1", s) for s in keys if keys[s][2] == "b1"}
    got = K.matched_controls(
        spark.createDataFrame(pos, "event_id long, start timestamp_ntz, end timestamp_ntz, storm string, segment long, k1 string, k2 string, k3 string").repartition(5),
        spark.createDataFrame([(s, *k) for s, k in keys.items()], "segment long, k1 string, k2 string, k3 string"),
        spark.createDataFrame(sorted(flags), "storm string, segment long"),
    )
    picks = {r["event_id"]: r for r in got.collect()}
    shut = lambda p: {s for storm, s in flags if storm == p[3]} | {q[4] for q in pos if (q[3] == p[3] if p[3] else q[1] == p[1] and not q[3])}
    window = lambda p, level: {picks[q[0]]["control"] for q in pos if q[1] == p[1] and q[0] in picks and picks[q[0]]["level"] <= level}
    used = set()
    for p in pos:
        own = picks.get(p[0])
        for level in range(1, (own["level"] if own else 4)):  # nothing was left at the levels before
            assert not {s for s in keys if keys[s][level - 1] == p[4 + level]} - shut(p) - window(p, level)
        if own:
            assert keys[own["control"]][own["level"] - 1] == p[4 + own["level"]] and own["control"] not in shut(p)
            assert (own["control"], p[1]) not in used
            used.add((own["control"], p[1]))
    assert {r["level"] for r in picks.values()} == {1, 2, 3} and len(picks) < len(pos)
    by_time, usage = sorted((p for p in pos if p[0] in picks), key=lambda p: (p[1], p[0])), {}
    for p in by_time:
        s = picks[p[0]]["control"]
        assert picks[p[0]]["score"] == usage.get(s, 0)
        usage[s] = usage.get(s, 0) + 1


def test_controls_go_round_a_pool(spark):
    pos = [(i, h(i), h(i + 1), f"S{i}", 0, "a", "a", "a") for i in range(23)]
    got = K.matched_controls(
        spark.createDataFrame(pos, "event_id long, start timestamp_ntz, end timestamp_ntz, storm string, segment long, k1 string, k2 string, k3 string"),
        spark.createDataFrame([(s, "a", "a", "a") for s in range(6)], "segment long, k1 string, k2 string, k3 string"),
        spark.createDataFrame([], "storm string, segment long"),
    )
    assert {r["event_id"]: r["control"] for r in got.collect()} == {i: 1 + i % 5 for i in range(23)}


def test_stratified_split_shares_hold_inside_a_hot_stratum(spark):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 800, "hot").otherwise("cold").alias("st"))
    out = S.stratified_split(df, "id", "st", {"train": 0.75, "validation": 0.15, "test": 0.10})
    n = {(r["st"], r["split"]): r["n"] for r in out.groupBy("st", "split").agg(F.count("*").alias("n")).collect()}
    assert n[("hot", "train")] == 600 and n[("hot", "validation")] == 120 and n[("hot", "test")] == 80
    assert out.select("id").distinct().count() == 1000
