"""Scans, window planners, landing, caching and sinks, driven by the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions.geometry import point
from eventloom.plans.registry import query, table
from eventloom.session import scratch_path
from eventloom.sources import landing as L
from eventloom.sources import windows as W
from eventloom.sources.geo import point_layer
from eventloom.streaming.landing import stream_months

c = F.col


def r(e, n=6):
    return F.round(e, n)


@query(
    "projected_scan",
    "S1 S15",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_returnflag IS NOT NULL AND l_returnflag LIKE 'R%'",
)
def projected_scan(spark, sf):
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    l = table(spark, sf, "lineitem")
    keep = (c("l_shipdate") >= day("1997-01-01")) & (c("l_shipdate") < day("1998-01-01")) & c("l_returnflag").isNotNull() & c("l_returnflag").startswith("R")
    return l.where(keep).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("csv_round_trip", "S2 S19 S20", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, sf):
    cu = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    path = L.write_table(cu, scratch_path(spark, "customer") + ".csv")
    return L.read_table(spark, path, cu.schema)


@query("multi_folder_scan", "S3 S14", "SELECT s_acctbal AS bal, s_suppkey AS supplier, NULL AS customer, 1 AS missing_columns FROM supplier UNION ALL SELECT c_acctbal, NULL, c_custkey, 1 FROM customer")
def multi_folder_scan(spark, sf):
    base = scratch_path(spark, "folders")
    table(spark, sf, "supplier").select(c("s_acctbal").alias("bal"), c("s_suppkey").alias("supplier")).write.parquet(f"{base}/a")
    table(spark, sf, "customer").select(c("c_acctbal").alias("bal"), c("c_custkey").alias("customer")).write.parquet(f"{base}/b")
    out, missing = L.scan_folders(spark, [f"{base}/a", f"{base}/b", f"{base}/none"], ["bal", "supplier", "customer", "phone"])
    return out.withColumn("missing_columns", F.lit(len(missing)))


BOUNDS = "b AS (SELECT CAST(min(o_orderdate) AS DATE) + 14 AS s, CAST(max(o_orderdate) AS DATE) AS e FROM orders)"


def _bounds(spark, sf):
    o = table(spark, sf, "orders")
    return o.agg(F.date_add(F.min("o_orderdate").cast("date"), 14).alias("s"), F.max("o_orderdate").cast("date").alias("e"))


@query("anniversary_windows", "S10", f"WITH {BOUNDS} SELECT CAST(g AS DATE) AS window_start, CAST(least(g + INTERVAL 1 MONTH, e) AS DATE) AS window_end FROM b, generate_series(s, e, INTERVAL 1 MONTH) AS t(g) WHERE g < e".replace("b, generate_series(s, e, INTERVAL 1 MONTH) AS t(g)", "(SELECT unnest(generate_series(CAST(s AS TIMESTAMP), CAST(e AS TIMESTAMP), INTERVAL 1 MONTH)) AS g, e FROM b)"))
def anniversary_windows(spark, sf):
    return _bounds(spark, sf).select(F.inline(W.anniversary_months(c("s"), c("e"))))


@query(
    "calendar_windows",
    "S11 S25",
    f"WITH {BOUNDS} SELECT CAST(greatest(g, s) AS DATE) AS window_start, CAST(least(g + INTERVAL 1 MONTH, e + 1) AS DATE) AS window_end, strftime(g, '%Y_%m') AS tag FROM (SELECT unnest(generate_series(date_trunc('month', s)::TIMESTAMP, date_trunc('month', e)::TIMESTAMP, INTERVAL 1 MONTH)) AS g, s, e FROM b)",
)
def calendar_windows(spark, sf):
    return _bounds(spark, sf).select(F.inline(W.calendar_months(c("s"), c("e"))))


@query(
    "chunk_windows",
    "S12",
    f"""WITH {BOUNDS}, y AS (SELECT 'year' AS plan, CAST(greatest(g, s) AS DATE) AS window_start, CAST(least(g + INTERVAL 1 YEAR - INTERVAL 1 DAY, e) AS DATE) AS window_end FROM (SELECT unnest(generate_series(date_trunc('year', s)::TIMESTAMP, e::TIMESTAMP, INTERVAL 1 YEAR)) AS g, s, e FROM b)),
    f AS (SELECT 'fixed' AS plan, CAST(g AS DATE) AS window_start, CAST(least(g + INTERVAL 31 DAY, e) AS DATE) AS window_end FROM (SELECT unnest(generate_series(s::TIMESTAMP, e::TIMESTAMP, INTERVAL 32 DAY)) AS g, e FROM b)),
    m AS (SELECT s::TIMESTAMP AS s, e::TIMESTAMP AS e, s::TIMESTAMP + (date_diff('day', s, e) * 12)::INTEGER * INTERVAL 1 HOUR AS mid FROM b)
    SELECT * FROM y UNION ALL SELECT * FROM f UNION ALL SELECT 'probe', CAST(a AS DATE), CAST(z AS DATE) FROM (
      SELECT s AS a, least(s + INTERVAL 30 DAY, e) AS z FROM m UNION SELECT date_trunc('day', greatest(mid - INTERVAL 15 DAY, s)), date_trunc('day', least(mid + INTERVAL 15 DAY, e)) FROM m UNION SELECT greatest(e - INTERVAL 30 DAY, s), e FROM m)""",
)
def chunk_windows(spark, sf):
    b = _bounds(spark, sf)
    plans = {"year": W.year_chunks, "fixed": W.fixed_windows, "probe": W.probe_windows}
    parts = [b.select(F.lit(n).alias("plan"), F.inline(f(c("s"), c("e")))) for n, f in plans.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("monthly_landing", "S13 P1", "SELECT strftime(o_orderdate, '%Y_%m') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def monthly_landing(spark, sf):
    o = table(spark, sf, "orders")
    path = scratch_path(spark, "landed")
    early = o.where(c("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    L.land_months(early, "o_orderdate", path, lambda d: d.where("o_totalprice > 1000"))
    L.land_months(o, "o_orderdate", path, lambda d: d.where("o_totalprice > 1000"))  # months already there are skipped
    return spark.read.parquet(path).groupBy(c("month").cast("string").alias("month")).agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "plan_driven_landing",
    "S25 S13",
    """SELECT CASE WHEN o_orderdate < DATE '1995-01-01' THEN 'orders_to_1994' ELSE 'orders_from_1995' END AS folder, strftime(o_orderdate, '%Y_%m') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total
    FROM orders WHERE o_orderdate >= DATE '1992-03-10' AND o_orderdate < DATE '1998-07-01' GROUP BY 1, 2""",
)
def plan_driven_landing(spark, sf):
    o = table(spark, sf, "orders")
    root = scratch_path(spark, "planned")
    archives = {"early": ("1992-03-10", "1994-12-31", "orders_to_1994"), "late": ("1995-01-01", "1998-06-30", "orders_from_1995")}
    plan = spark.createDataFrame([(a, *row) for a, row in archives.items()], "archive string, start string, end string, folder string")
    L.land_plan(plan.where("archive = 'early'"), lambda archive: o, "o_orderdate", root)
    L.land_plan(plan, lambda archive: o, "o_orderdate", root)  # the first archive's months are in the manifest
    return L.landed(spark, root, o.schema).groupBy("folder", "month").agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@query("streamed_landing", "S13", "SELECT strftime(ts, '%Y_%m') AS month, event_type, count(*) AS n FROM events GROUP BY ALL")
def streamed_landing(spark, sf):
    base = scratch_path(spark, "stream")
    schema = table(spark, sf, "events").schema
    out = stream_months(spark, f"{sf}/event[s].parquet", schema, "ts", f"{base}/table", f"{base}/state")
    return out.groupBy(c("month").cast("string").alias("month"), "event_type").agg(F.count("*").alias("n"))


@query(
    "source_fallback",
    "S16 S27",
    """WITH p AS (SELECT *, CASE WHEN l_returnflag = 'R' AND l_tax > 0.07 AND l_quantity > 48 THEN 1 WHEN l_returnflag = 'N' AND l_quantity > 49 THEN 2 WHEN l_returnflag = 'A' THEN 3 END AS pr FROM lineitem)
    SELECT l_suppkey, count(*) AS n, min(pr) AS product FROM (SELECT *, min(pr) OVER (PARTITION BY l_suppkey) AS best FROM p WHERE pr IS NOT NULL) WHERE pr = best GROUP BY 1""",
)
def source_fallback(spark, sf):
    l = table(spark, sf, "lineitem")
    pr = (
        F.when((c("l_returnflag") == "R") & (c("l_tax") > 0.07) & (c("l_quantity") > 48), 1).when((c("l_returnflag") == "N") & (c("l_quantity") > 49), 2).when(c("l_returnflag") == "A", 3)
    )
    return L.best_source(l.withColumn("product", pr), "l_suppkey", c("product")).groupBy("l_suppkey").agg(F.count("*").alias("n"), F.min("product").alias("product"))


@query("tabular_payload", "S17 F22", "SELECT CAST(c_nationkey AS VARCHAR) AS state, CAST(c_custkey AS VARCHAR) AS tract, CAST(c_mktsegment AS VARCHAR) AS name, 'B19013' AS source_table, '2018_2022' AS acs_period FROM customer")
def tabular_payload(spark, sf):
    cells = F.to_json(F.array(c("c_nationkey").cast("string"), c("c_custkey").cast("string"), c("c_mktsegment")))
    p = table(spark, sf, "customer").select(F.from_json(cells, "array<string>").alias("cells"))
    return L.payload_rows(p, "cells", ["state", "tract", "name"], {"source_table": "B19013", "acs_period": "2018_2022"})


@query("cache_contract", "S18 S22", "SELECT s_suppkey, s_acctbal, TRUE AS processed, 'built,kept,empty:missing' AS history FROM supplier")
def cache_contract(spark, sf):
    path = scratch_path(spark, "cache")
    build = lambda: table(spark, sf, "supplier").select("s_suppkey", "s_acctbal", F.lit(True).alias("processed"))
    _, first = L.materialize_if_stale(spark, path, build, ["s_suppkey", "processed"], c("processed"))
    out, second = L.materialize_if_stale(spark, path, build, ["s_suppkey", "processed"], c("processed"))
    empty, note = L.read_lenient(spark, path + "-none", "a int")
    history = ",".join(["built" if first else "kept", "built" if second else "kept", ("empty" if empty.isEmpty() else "rows") + ":" + note])
    return out.withColumn("history", F.lit(history))


@query("stage_results", "S21 M20", "SELECT CASE l_linestatus WHEN 'O' THEN 'temporal_by_era' ELSE 'stratified_75_15_10' END AS split, l_returnflag AS model, count(*) AS n, round(avg(l_discount), 6) AS mean_score FROM lineitem GROUP BY ALL")
def stage_results(spark, sf):
    l = table(spark, sf, "lineitem")
    path = scratch_path(spark, "stages")
    for status, split in (("O", "temporal by era"), ("F", "stratified 75/15/10")):
        for model in ("A", "N", "R"):
            part = l.where((c("l_linestatus") == status) & (c("l_returnflag") == model))
            L.append_stage(part.agg(F.count("*").alias("n"), r(F.avg("l_discount")).alias("mean_score")), path, split, model)
    return spark.read.parquet(path).select(c("split").cast("string").alias("split"), c("model").cast("string").alias("model"), "n", "mean_score")


@query(
    "layer_summary",
    "S23 S9 S8",
    "SELECT 'suppliers' AS layer, count(*) AS rows, 'complete' AS geometry_status FROM supplier UNION ALL SELECT 'customers', count(*), 'complete' FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'parts', count(*), 'no_geometry' FROM part",
)
def layer_summary(spark, sf):
    s = table(spark, sf, "supplier").select(F.struct(c("s_acctbal").alias("latitude"), c("s_nationkey").alias("longitude")).alias("place"))
    cu = table(spark, sf, "customer").select(F.when(c("c_acctbal") > 0, c("c_acctbal").cast("string")).otherwise("n/a").alias("lon"), c("c_nationkey").alias("lat"))
    return L.layer_summary({"suppliers": (point_layer(s), "point"), "customers": (point_layer(cu), "point"), "parts": (table(spark, sf, "part"), None)})


@query("geojson_round_trip", "S28 S4", "SELECT s_suppkey, s_name, s_acctbal AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier")
def geojson_round_trip(spark, sf):
    s = table(spark, sf, "supplier")
    path = scratch_path(spark, "geojson")
    shape = F.struct(F.lit("Point").alias("type"), F.array(c("s_acctbal"), c("s_nationkey").cast("double")).alias("coordinates"))
    L.save_geojson(s, path, shape, ["s_suppkey", "s_name"])
    f = L.read_geojson(spark, path, "type string, properties struct<s_suppkey: bigint, s_name: string>, geometry struct<type: string, coordinates: array<double>>")
    return f.select("properties.s_suppkey", "properties.s_name", c("geometry.coordinates")[0].alias("x"), c("geometry.coordinates")[1].alias("y"))


@query(
    "segment_universe_points",
    "S7 G1 G3",
    "SELECT o_orderkey, round(o_totalprice * 0.304800609601219, 6) AS metres, o_custkey AS segment FROM orders",
)
def segment_universe_points(spark, sf):
    from eventloom.functions.units import US_FT_TO_M

    o = table(spark, sf, "orders").withColumn("p", point(c("o_totalprice"), c("o_custkey")))
    return o.select("o_orderkey", r(c("p.x") * US_FT_TO_M).alias("metres"), c("p.y").cast("bigint").alias("segment"))
