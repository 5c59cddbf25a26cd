"""Matched controls and the balanced table: rounds that nobody asks, shared tables, tight pools and open windows."""

from datetime import datetime, timedelta

from eventloom.operators import controls as K
from eventloom.operators import intervals as I
from eventloom.plans import controls as P
from eventloom.plans import load
from eventloom.plans import tables as T

POS = "event_id long, start timestamp_ntz, end timestamp_ntz, storm string, segment long, k1 string, k2 string, k3 string"
UNI = "segment long, k1 string, k2 string, k3 string"


def h(i):
    return datetime(2024, 1, 1) + timedelta(hours=i)


def controls(spark, pos, uni):
    got = K.matched_controls(spark.createDataFrame(pos, POS), spark.createDataFrame(uni, UNI), spark.createDataFrame([], "storm string, segment long"))
    return {r["event_id"]: (r["control"], r["level"]) for r in got.collect()}


def counted(monkeypatch, module, name):
    calls, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: calls.append(1) or real(*a, **k))
    return calls


def test_a_round_that_nobody_asks_is_not_run(spark, monkeypatch):
    calls = counted(monkeypatch, K, "_choose")
    got = controls(spark, [(i, h(i), h(i + 1), f"S{i}", 0, "a", "a", "a") for i in range(9)], [(s, "a", "a", "a") for s in range(4)])
    assert got == {i: (1 + i % 3, 1) for i in range(9)} and len(calls) == 1


def test_tight_and_roomy_pools_and_open_windows(spark, monkeypatch):
    calls = counted(monkeypatch, K, "_choose")
    uni = [(s, "big", "b", "x") for s in range(10)] + [(s, "small", "s", "y") for s in range(10, 13)]
    # one window of four in a pool with two free segments, two of them in one with nine; one window has no end
    pos = [(i, h(0), h(1), "S0", 10, "small", "s", "y") for i in range(4)] + [(i, h(0), h(1), "S0", 0, "big", "b", "x") for i in (4, 5)] + [(6, h(2), None, "S0", 0, "big", "b", "x")]
    got = controls(spark, pos, uni)
    assert got == {0: (11, 1), 1: (12, 1), 4: (1, 1), 5: (2, 1)} and len(calls) == 3


def test_windows_of_several_storms_do_not_share_a_control(spark):
    pos = [(i, h(0), h(1), f"S{i}", 0, "a", "a", "a") for i in range(3)]
    got = controls(spark, pos, [(s, "a", "a", "a") for s in range(3)])
    assert len({c for c, _ in got.values()}) == len(got) == 2


def test_storm_starts_sum_up_what_storm_clusters_number(spark):
    rows = [(i, h(i // 3 + 20 * (i // 12)), h(i // 3 + 20 * (i // 12) + i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, s timestamp_ntz, e timestamp_ntz")
    starts = {r["s"]: r for r in I.storm_starts(df, "s", "e").collect()}
    of = {r["id"]: r["storm_event_id"] for r in I.storm_clusters(df, "s", "e").collect()}
    assert len(starts) == len({s for _, s, _ in rows}) and len(set(of.values())) > 1
    for i, s, _ in rows:
        mine = [x for x in rows if of[x[0]] == of[i]]
        r = starts[s]
        assert r["storm_event_id"] == of[i] and r["n_positive_events"] == len(mine)
        assert r["storm_duration_hours"] == (max(e for _, _, e in mine) - min(b for _, b, _ in mine)).total_seconds() / 3600


def test_the_balanced_table_numbers_storms_and_bands_once(spark, monkeypatch):
    bands, spans = counted(monkeypatch, P.B, "rank_bins"), counted(monkeypatch, I, "merge_spans")
    df = load()["balanced_table"].build(spark, "/root/testdata/sf0.001")
    n = {r["dataset_split_role"]: r["n"] for r in df.groupBy("dataset_split_role").agg(T.F.count("*").alias("n")).collect()}
    assert n["positive"] == 1000 and 0 < n["negative"] <= 1000 and (len(bands), len(spans)) == (1, 1)
