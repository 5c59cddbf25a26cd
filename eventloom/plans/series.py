"""Sensor series: cleaning, sampling interval, gap fill, wet spells and their features."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import intervals as I
from eventloom.operators import series as S
from eventloom.plans.events import ORDER_WINDOWS_SQL, order_windows, r
from eventloom.plans.registry import query, table

# Rain records: a station is a supplier, the depth is wet above a quantity of 40 and missing for late returns.
RAW_SQL = """raw AS (SELECT l_suppkey AS station, l_shipdate AS ts, CASE WHEN l_returnflag = 'R' AND l_tax >= 0.06 THEN NULL WHEN l_quantity > 40 THEN l_quantity / 10 ELSE 0 END AS depth,
  l_linestatus || CAST(l_linenumber AS VARCHAR) AS kind, l_returnflag AS source, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem),
rec AS (SELECT station, ts, max(depth) AS depth, string_agg(DISTINCT kind, '|' ORDER BY kind) AS kind,
  arg_min(source, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS source FROM raw GROUP BY station, ts)"""

FILL_SQL = RAW_SQL + """,
nb AS (SELECT *, last_value(depth IGNORE NULLS) OVER p AS pv, first_value(depth IGNORE NULLS) OVER n AS nv,
  last_value(CASE WHEN depth IS NOT NULL THEN ts END IGNORE NULLS) OVER p AS pt, first_value(CASE WHEN depth IS NOT NULL THEN ts END IGNORE NULLS) OVER n AS nt
  FROM rec WINDOW p AS (PARTITION BY station ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), n AS (PARTITION BY station ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
filled AS (SELECT station, ts, depth AS depth_observed, kind, source,
  CASE WHEN depth IS NULL AND pv IS NOT NULL AND nv IS NOT NULL THEN CASE WHEN pv <= 0 OR nv <= 0 THEN 'zero_guard' ELSE 'linear_positive' END END AS fill_method,
  CASE WHEN depth IS NULL AND pv IS NOT NULL AND nv IS NOT NULL THEN CASE WHEN pv <= 0 OR nv <= 0 THEN 0.0 ELSE pv + (nv - pv) * date_diff('microsecond', pt, ts) / date_diff('microsecond', pt, nt) END ELSE depth END AS depth
  FROM nb)"""

STEP_SQL = """dl AS (SELECT station, CAST(round_even(date_diff('microsecond', lag(ts) OVER (PARTITION BY station ORDER BY ts), ts) / 60000000.0, 0) AS BIGINT) AS m FROM rec),
mc AS (SELECT station, m, count(*) AS n FROM dl WHERE m > 0 GROUP BY station, m),
step AS (SELECT s.station, greatest(coalesce((SELECT m FROM mc WHERE mc.station = s.station ORDER BY n DESC, m LIMIT 1), 60), 1) AS interval_minutes FROM (SELECT DISTINCT station FROM rec) s)"""

WET_SQL = FILL_SQL + ", " + STEP_SQL + """,
wet AS (SELECT f.station, ts, depth, interval_minutes AS st FROM filled f JOIN step USING (station) WHERE depth > 0),
wn AS (SELECT *, CASE WHEN ts - (lag(ts) OVER (PARTITION BY station ORDER BY ts) + st * INTERVAL 1 MINUTE) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM wet),
wg AS (SELECT *, sum(n) OVER (PARTITION BY station ORDER BY ts ROWS UNBOUNDED PRECEDING) AS grp FROM wn),
we AS (SELECT station, min(ts) AS start, max(ts) + max(st) * INTERVAL 1 MINUTE AS "end", sum(depth) AS depth, max(st) AS st FROM wg GROUP BY station, grp HAVING sum(depth) >= 1.1),
rain AS (SELECT station, start, "end", depth, greatest(date_diff('microsecond', start, "end") / 3600000000.0, st / 60.0) AS duration FROM we)"""


def raw_records(spark, sf):
    l = table(spark, sf, "lineitem")
    depth = F.when(
        ~((F.col("l_returnflag") == "R") & (F.col("l_tax") >= 0.06)),
        F.when(F.col("l_quantity") > 40, F.col("l_quantity") / 10).otherwise(F.lit(0.0)),
    )
    return l.select(
        F.col("l_suppkey").alias("station"), F.col("l_shipdate").alias("ts"), depth.alias("depth"),
        F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("kind"), F.col("l_returnflag").alias("source"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
    )


def records(spark, sf):
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return S.collapse_samples(raw_records(spark, sf), "station", "ts", "depth", "kind", "source", order)


def wet_spells(spark, sf):
    rec = records(spark, sf)
    steps = S.sampling_interval(rec, "station", "ts")
    return S.rain_events(S.gap_fill(rec, "station", "ts", "depth"), steps, "station", "ts", "depth")


@query("collapse_samples", "A7", f"WITH {RAW_SQL} SELECT * FROM rec")
def collapse_samples(spark, sf):
    return records(spark, sf)


@query("sampling_interval", "A8", f"WITH {RAW_SQL}, {STEP_SQL} SELECT * FROM step")
def sampling_interval(spark, sf):
    return S.sampling_interval(records(spark, sf), "station", "ts")


@query("series_gap_fill", "W5 P14", f"WITH {FILL_SQL} SELECT station, ts, depth_observed, fill_method, round(depth, 6) AS depth FROM filled WHERE depth >= 0")
def series_gap_fill(spark, sf):
    f = S.gap_fill(records(spark, sf), "station", "ts", "depth").where(F.col("depth") >= 0)
    return f.select("station", "ts", "depth_observed", "fill_method", r(F.col("depth")).alias("depth"))


@query(
    "wet_spell_events",
    "A8 A9",
    f"""WITH {WET_SQL} SELECT printf('P_EVENT_%06d', row_number() OVER (ORDER BY station, start)) AS event_id, station, start, "end",
    round(duration, 6) AS duration, round(depth / duration, 6) AS intensity, round(depth, 6) AS depth FROM rain""",
)
def wet_spell_events(spark, sf):
    e = S.number_rain_events(wet_spells(spark, sf), "station")
    return e.select("event_id", "station", "start", "end", *[r(F.col(c)).alias(c) for c in ("duration", "intensity", "depth")])


@query(
    "wet_spell_windows",
    "A10 S24",
    f"""WITH {RAW_SQL}, {STEP_SQL},
    w AS (SELECT r.station, ts, greatest(6 * 3600, interval_minutes * 60 * 1.5) AS lim, interval_minutes * 60 AS sec, lag(ts) OVER (PARTITION BY r.station ORDER BY ts) AS p FROM rec r JOIN step USING (station) WHERE depth > 0),
    g AS (SELECT *, sum(CASE WHEN date_diff('microsecond', p, ts) <= lim * 1000000 THEN 0 ELSE 1 END) OVER (PARTITION BY station ORDER BY ts ROWS UNBOUNDED PRECEDING) AS event_id FROM w),
    e AS (SELECT station, CAST(event_id AS BIGINT) AS event_id, min(ts) AS start, max(ts) AS "end", count(*) AS wet_records, max(sec) AS sec FROM g GROUP BY station, event_id)
    SELECT e.station, e.event_id, e.start, e."end", e.wet_records, round(sum(r.depth), 6) AS precip_mm, count(*) AS n_records,
      round(greatest(date_diff('microsecond', e.start, e."end") / 1000000.0 + e.sec, e.sec) / 3600.0, 6) AS duration_hours,
      round(sum(r.depth) / (greatest(date_diff('microsecond', e.start, e."end") / 1000000.0 + e.sec, e.sec) / 3600.0), 6) AS mean_intensity,
      e.station || '_' || printf('%04d', e.event_id) AS event_uid
    FROM e JOIN rec r ON r.station = e.station AND r.ts BETWEEN e.start AND e."end" AND r.depth >= 0 GROUP BY e.station, e.event_id, e.start, e."end", e.wet_records, e.sec HAVING sum(r.depth) >= 1.1""",
)
def wet_spell_windows(spark, sf):
    rec = records(spark, sf)
    e = S.rain_event_windows(rec, S.sampling_interval(rec, "station", "ts"), "station", "ts", "depth")
    return e.select(
        "station", "event_id", "start", "end", "wet_records", r(F.col("precip_mm")).alias("precip_mm"), "n_records",
        r(F.col("duration_hours")).alias("duration_hours"), r(F.col("mean_intensity")).alias("mean_intensity"), "event_uid",
    )


@query(
    "event_record_slices",
    "S24",
    f"""WITH {RAW_SQL}, {STEP_SQL},
    w AS (SELECT r.station, ts, greatest(6 * 3600, interval_minutes * 60 * 1.5) AS lim, lag(ts) OVER (PARTITION BY r.station ORDER BY ts) AS p FROM rec r JOIN step USING (station) WHERE depth > 0),
    g AS (SELECT *, sum(CASE WHEN date_diff('microsecond', p, ts) <= lim * 1000000 THEN 0 ELSE 1 END) OVER (PARTITION BY station ORDER BY ts ROWS UNBOUNDED PRECEDING) AS event_id FROM w),
    e AS (SELECT station, CAST(event_id AS BIGINT) AS event_id, min(ts) AS start, max(ts) AS "end" FROM g GROUP BY station, event_id),
    k AS (SELECT e.* FROM e JOIN rec r ON r.station = e.station AND r.ts BETWEEN e.start AND e."end" AND r.depth >= 0 GROUP BY ALL HAVING sum(r.depth) >= 1.1)
    SELECT r.station, r.ts, r.depth, k.station || '_' || printf('%04d', k.event_id) AS event_uid FROM rec r JOIN k ON r.station = k.station AND r.ts BETWEEN k.start AND k."end" """,
)
def event_record_slices(spark, sf):
    rec = records(spark, sf)
    e = S.rain_event_windows(rec, S.sampling_interval(rec, "station", "ts"), "station", "ts", "depth")
    return S.tag_event_records(rec, e, "station", "ts").select("station", "ts", "depth", "event_uid")


@query(
    "interval_overlap_features",
    "J12 A5 F23",
    f"""WITH {ORDER_WINDOWS_SQL}, {WET_SQL}, rx AS (SELECT CAST(station AS INTEGER) AS station, start, "end", duration, depth, CASE WHEN duration < 40 THEN depth / duration END AS intensity FROM rain)
    SELECT w.event_id, 1 AS prec_station_link_count, count(x.station) AS n_prec, round(coalesce(max(intensity), 0), 6) AS prec_intensity_max,
      round(coalesce(sum(coalesce(intensity, 0)) / nullif(count(x.station), 0), 0), 6) AS prec_intensity_mean, round(coalesce(sum(x.depth), 0), 6) AS prec_depth_total,
      round(coalesce(sum(x.duration), 0), 6) AS prec_duration_total, CASE WHEN count(x.station) > 1 THEN 'multiple' WHEN count(x.station) = 1 THEN 'single' ELSE 'none' END AS prec_match_class
    FROM win w LEFT JOIN rx x ON w.station = x.station AND x.start <= w.e AND x."end" >= w.s GROUP BY w.event_id""",
)
def interval_overlap_features(spark, sf):
    from eventloom.functions.labels import match_class

    rain = wet_spells(spark, sf).withColumn("intensity", F.when(F.col("duration") < 40, F.col("intensity")))
    rain = rain.withColumn("station", F.col("station").cast("int"))
    f = I.overlap_features(order_windows(spark, sf), rain, "station", ("s", "e"), "event_id", 7 * 86400)
    rounded = ("prec_intensity_max", "prec_intensity_mean", "prec_depth_total", "prec_duration_total")
    return f.withColumns({c: r(F.col(c)) for c in rounded}).withColumn("prec_match_class", match_class(F.col("n_prec")))


@query(
    "station_resolution",
    "F29",
    """WITH d AS (SELECT user_id, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts) AS us FROM (SELECT DISTINCT user_id, ts FROM events)),
    m AS (SELECT user_id, min(CASE WHEN us > 0 THEN us END) AS lo FROM d GROUP BY user_id)
    SELECT user_id, CASE WHEN lo IS NULL THEN 'unknown' WHEN lo < 3600000000 THEN 'subhourly' WHEN lo < 86400000000 THEN 'hourly' ELSE 'daily' END AS resolution FROM m""",
)
def station_resolution(spark, sf):
    return S.resolution_class(table(spark, sf, "events"), "user_id", "ts", 7 * 86400)


@query(
    "station_event_summary",
    "A25",
    f"""WITH {WET_SQL} SELECT station, count(*) AS events, round(sum(depth), 6) AS depth_total, round(median(duration), 6) AS duration_median,
    round(max(depth / duration), 6) AS intensity_max, min(start) AS first_start, max("end") AS last_end FROM rain GROUP BY station""",
)
def station_event_summary(spark, sf):
    from eventloom.operators.quantiles import exact_quantiles

    e = wet_spells(spark, sf)
    a = e.groupBy("station").agg(
        F.count("*").alias("events"), r(F.sum("depth")).alias("depth_total"), r(F.max("intensity")).alias("intensity_max"),
        F.min("start").alias("first_start"), F.max("end").alias("last_end"),
    )
    q = exact_quantiles(e, ["station"], "duration", {"duration_median": 0.5})
    return a.join(q.withColumn("duration_median", r(F.col("duration_median"))), "station")


@query(
    "interpolation_summary",
    "A25",
    f"""WITH {FILL_SQL} SELECT station, count(*) AS records, count(depth_observed) AS observed, count(*) FILTER (WHERE fill_method = 'zero_guard') AS zero_guard,
    count(*) FILTER (WHERE fill_method = 'linear_positive') AS linear_positive, count(*) FILTER (WHERE depth IS NULL) AS still_missing FROM filled GROUP BY station""",
)
def interpolation_summary(spark, sf):
    f = S.gap_fill(records(spark, sf), "station", "ts", "depth")
    return f.groupBy("station").agg(
        F.count("*").alias("records"), F.count("depth_observed").alias("observed"),
        F.count_if(F.col("fill_method") == "zero_guard").alias("zero_guard"),
        F.count_if(F.col("fill_method") == "linear_positive").alias("linear_positive"),
        F.count_if(F.col("depth").isNull()).alias("still_missing"),
    )


@query(
    "monthly_series",
    "A27",
    """SELECT l_suppkey AS station, date_trunc('month', l_shipdate) AS month, round(avg(l_quantity), 6) AS mean_level, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def monthly_series(spark, sf):
    l = table(spark, sf, "lineitem")
    m = F.date_trunc("month", F.col("l_shipdate")).cast("timestamp_ntz")
    return l.groupBy(F.col("l_suppkey").alias("station"), m.alias("month")).agg(r(F.avg("l_quantity")).alias("mean_level"), F.count("*").alias("n"))


@query(
    "monthly_climatology",
    "A27",
    """WITH m AS (SELECT CAST(extract(month FROM o_orderdate) AS INTEGER) AS month, CAST(extract(year FROM o_orderdate) AS INTEGER) AS y, n_name AS borough, count(*) AS n
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
    SELECT month, borough, CAST(sum(n) AS BIGINT) AS events, round(avg(n), 6) AS mean_per_year FROM m GROUP BY ALL""",
)
def monthly_climatology(spark, sf):
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    m = j.groupBy(F.month("o_orderdate").alias("month"), F.year("o_orderdate").alias("y"), F.col("n_name").alias("borough")).agg(F.count("*").alias("n"))
    return m.groupBy("month", "borough").agg(F.sum("n").alias("events"), r(F.avg("n")).alias("mean_per_year"))
