from pyspark.sql import functions as F

from eventloom.operators import quantiles as Q
from eventloom.operators.quantiles import exact_quantiles
from eventloom.plans import load


def test_rows_are_counted_and_ranked_between_the_same_bounds(spark):
    """A sketch merged in another order has other bounds, so it must not be evaluated once for counting and once for ranking."""
    rows = spark.range(0, 50_000, 1, 8).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    for keys in ([], ["k"]):
        q = exact_quantiles(rows, keys, "v", {"m": 0.5, "t": 0.75}, accuracy=100)
        assert "percentile_approx" not in q._jdf.queryExecution().optimizedPlan().toString().replace("approx_percentile", "percentile_approx")
    assert [tuple(r) for r in exact_quantiles(rows, [], "v", {"m": 0.5, "t": 0.75}, accuracy=100).collect()] == [(24999.5, 37499.25)]


def test_interpolation_rounds_as_the_sql_does(spark):
    import duckdb

    rows = [(i, round(1000 + i * 7.3137 + j * 3.33, 2)) for i in range(300) for j in range(2)]
    got = {r.k: r.q for r in exact_quantiles(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", {"q": 0.75}).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t(k INTEGER, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    assert got == dict(con.execute("SELECT k, quantile_cont(v, 0.75) FROM t GROUP BY k").fetchall())


def test_rows_of_few_groups_are_not_shuffled_to_their_bounds(spark):
    df = spark.createDataFrame([(i % 3, float(i)) for i in range(3000)], "k int, v double")
    q = exact_quantiles(df, ["k"], "v", {"m": 0.5})
    plan = q._jdf.queryExecution().sparkPlan().toString()
    # the rows are read for the counts outside and inside the bounds, each time beside a broadcast table
    assert plan.count("BroadcastHashJoin") + plan.count("BroadcastNestedLoopJoin") >= 2
    assert {r.k: r.m for r in q.collect()} == {0: 1498.5, 1: 1499.5, 2: 1500.5}


def test_many_small_groups_take_one_shuffle_and_crowded_ones_the_bounds(spark, monkeypatch):
    rows = [(i // 3 if i % 7 else None, "ab"[i % 2], float(i * 37 % 101) if i % 11 else None) for i in range(900)] + [(-1, "a", float(i % 50)) for i in range(120)]
    df = spark.createDataFrame(rows, "k int, s string, v double")
    want = sorted(map(str, Q.exact_quantiles(df, ["k", "s"], "v", {"m": 0.5, "t": 0.8}).collect()))
    bounds, plain = [], Q.exact_quantiles
    monkeypatch.setattr(Q, "exact_quantiles", lambda d, *a, **k: bounds.append(d.count()) or plain(d, *a, **k))
    monkeypatch.setattr(Q, "FEW_GROUPS", 20)
    for limit, through in ((1000, 0), (100, 1)):
        monkeypatch.setattr(Q, "SMALL_GROUP", limit)
        bounds.clear()
        got = plain(df, ["k", "s"], "v", {"m": 0.5, "t": 0.8}, many=True)
        assert sorted(map(str, got.collect())) == want and len(want) > 300
        assert len(bounds) == through and sum(bounds) < 200
    monkeypatch.setattr(Q, "SMALL_GROUP", 1000)
    plan = plain(df, ["k", "s"], "v", {"m": 0.5}, many=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_two_levels_of_medians_share_one_shuffle(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    got = load()["two_level_median"].build(spark, sf)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    monkeypatch.setattr(Q, "SMALL_GROUP", 100)
    assert sorted(got.collect()) == sorted(load()["two_level_median"].build(spark, sf).collect())
