"""Intervals, events, storms and the interval joins built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import temporal as T
from eventloom.operators import intervals as I
from eventloom.plans.registry import query, table

HOUR = 3600


def r(c, n=6):
    return F.round(c, n)


# Complaints: a segment is (user, type); errors never report an end, values under 1 stay open.
COMPLAINTS_SQL = """complaints AS (
  SELECT event_id, concat_ws('-', user_id, event_type) AS segment_id, user_id, event_type, ts AS start,
         CASE WHEN event_type <> 'error' AND value >= 1 THEN ts + CAST(floor(value * 30) AS BIGINT) * INTERVAL 1 MINUTE END AS "end"
  FROM events)"""

MERGED_SQL = COMPLAINTS_SQL + """,
marked AS (
  SELECT *, CASE WHEN "end" IS NULL THEN 0 ELSE 1 END AS status,
    max(CASE WHEN "end" IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY segment_id) AS known,
    max(coalesce("end", TIMESTAMP '9999-01-01')) OVER (PARTITION BY segment_id ORDER BY start, coalesce("end", TIMESTAMP '9999-01-01'), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_e,
    lag(start) OVER (PARTITION BY segment_id ORDER BY start, coalesce("end", TIMESTAMP '9999-01-01'), event_id) AS prev_s
  FROM complaints),
islands AS (
  SELECT *, sum(CASE WHEN prev_s IS NULL THEN 1 WHEN known = 1 AND start > prev_e THEN 1 WHEN known = 0 AND start - prev_s > INTERVAL 24 HOUR THEN 1 ELSE 0 END)
    OVER (PARTITION BY segment_id ORDER BY start, coalesce("end", TIMESTAMP '9999-01-01'), event_id ROWS UNBOUNDED PRECEDING) AS island
  FROM marked),
merged AS (
  SELECT segment_id, CAST(island - 1 AS BIGINT) AS local_event_id, min(start) AS start,
    CASE WHEN max(known) = 0 THEN max(start) + INTERVAL 24 HOUR WHEN count(*) FILTER (WHERE "end" IS NULL) = 0 THEN max("end") END AS "end",
    count(*) AS n_complaints, count(*) FILTER (WHERE status = 0) AS n_open, count(*) FILTER (WHERE status = 1) AS n_closed
  FROM islands GROUP BY segment_id, island)"""

EVENTS_SQL = MERGED_SQL + """,
flood AS (
  SELECT row_number() OVER (ORDER BY segment_id, start) AS flood_id, segment_id, start, "end", coalesce("end", start + INTERVAL 24 HOUR) AS window_end
  FROM merged)"""


def complaints(spark, sf):
    e = table(spark, sf, "events")
    end = F.when(
        (F.col("event_type") != "error") & (F.col("value") >= 1),
        T.plus_seconds(F.col("ts"), F.floor(F.col("value") * 30) * 60),
    )
    return e.select(
        "event_id",
        F.concat_ws("-", "user_id", "event_type").alias("segment_id"),
        "user_id",
        "event_type",
        F.col("ts").alias("start"),
        end.alias("end"),
    ).withColumn("status", F.when(F.col("end").isNull(), 0).otherwise(1))


def flood_events(spark, sf):
    merged = I.interval_merge(complaints(spark, sf), "segment_id", "start", "end", "status")
    numbered = I.number_events(merged, ["segment_id", "start"], "flood_id")
    return numbered.withColumn("window_end", F.coalesce("end", T.plus_seconds(F.col("start"), 24 * HOUR)))


@query(
    "interval_merge_events",
    "A1 A2 W2 W3 W4",
    f"""WITH {MERGED_SQL}
    SELECT segment_id, local_event_id, start, "end", round(date_diff('microsecond', start, "end") / 3600000000.0, 6) AS duration_hours,
      n_complaints, n_open, n_closed, CAST(CASE WHEN n_closed = 0 THEN 0 WHEN n_open = 0 THEN 1 ELSE 2 END AS TINYINT) AS status
    FROM merged""",
)
def interval_merge_events(spark, sf):
    m = I.interval_merge(complaints(spark, sf), "segment_id", "start", "end", "status")
    return m.withColumn("duration_hours", r(F.col("duration_hours")))


@query(
    "gap_sessions",
    "A2 H5",
    """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 24 HOUR THEN 0 ELSE 1 END AS n, event_id FROM events),
    g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM s)
    SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n_complaints FROM g GROUP BY user_id, grp""",
)
def gap_sessions(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", F.lit(None).cast("timestamp_ntz").alias("end"), F.lit(0).alias("status"))
    return I.interval_merge(e, "user_id", "ts", "end", "status", open_end="max_start").select("user_id", "start", "end", "n_complaints")


@query(
    "numbered_flood_events",
    "A3 F20",
    f"""WITH {EVENTS_SQL}
    SELECT flood_id, segment_id, start, "end", window_end,
      round(date_diff('microsecond', start, window_end) / 3600000000.0, 6) AS window_hours,
      "end" IS NOT NULL AND status = 1 AS resolution_bool, "end" IS NOT NULL AND status <> 1 AS end_inferred,
      round(CASE WHEN status = 1 THEN date_diff('microsecond', start, "end") / 3600000000.0 END, 6) AS resolution_hours
    FROM flood JOIN (SELECT segment_id, start, CASE WHEN n_closed = 0 THEN 0 WHEN n_open = 0 THEN 1 ELSE 2 END AS status FROM merged) USING (segment_id, start)""",
)
def numbered_flood_events(spark, sf):
    ev = flood_events(spark, sf).drop("window_end")
    t = T.event_times(ev, "start", "end", "status")
    return t.select(
        "flood_id", "segment_id", "start", "end", F.col("event_window_end").alias("window_end"),
        r(F.col("event_window_duration_hours")).alias("window_hours"), "resolution_bool",
        F.col("event_end_inferred").alias("end_inferred"), r(F.col("resolution_hours")).alias("resolution_hours"),
    )


STORM_SQL = """w AS (SELECT event_id, ts AS start, ts + CAST(floor(value * 2) AS BIGINT) * INTERVAL 1 SECOND AS "end", user_id, event_type FROM events),
sp AS (SELECT *, max("end") OVER (ORDER BY start, "end", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM w),
st AS (SELECT *, printf('STORM_%05d', CAST(sum(CASE WHEN pe IS NULL OR start > pe + INTERVAL 10 MINUTE THEN 1 ELSE 0 END) OVER (ORDER BY start, "end", event_id ROWS UNBOUNDED PRECEDING) AS BIGINT)) AS storm_event_id FROM sp)"""


def storm_windows(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        "event_id", F.col("ts").alias("start"), T.plus_seconds(F.col("ts"), F.floor(F.col("value") * 2)).alias("end"), "user_id", "event_type"
    )


@query("storm_clusters", "A11 A12", f"WITH {STORM_SQL} SELECT event_id, storm_event_id, count(*) OVER (PARTITION BY storm_event_id) AS storm_event_positive_count FROM st")
def storm_clusters(spark, sf):
    c = I.storm_clusters(storm_windows(spark, sf), "start", "end", 600, 6 * HOUR)
    n = c.groupBy("storm_event_id").agg(F.count("*").alias("storm_event_positive_count"))
    return c.join(n, "storm_event_id").select("event_id", "storm_event_id", "storm_event_positive_count")


@query(
    "storm_summary",
    "A11 A12",
    f"""WITH {STORM_SQL} SELECT storm_event_id, min(start) AS storm_start, max("end") AS storm_end, count(*) AS n_positive_events,
    count(DISTINCT user_id) AS n_positive_segments, count(DISTINCT event_type) AS n_boroughs,
    round(date_diff('microsecond', min(start), max("end")) / 3600000000.0, 6) AS storm_duration_hours FROM st GROUP BY 1""",
)
def storm_summary(spark, sf):
    c = I.storm_clusters(storm_windows(spark, sf), "start", "end", 600, 6 * HOUR)
    s = I.storm_summary(c, "start", "end", "event_id", "user_id", "event_type")
    return s.withColumn("storm_duration_hours", r(F.col("storm_duration_hours")))


@query(
    "point_in_first_interval",
    "J11",
    f"""WITH {EVENTS_SQL},
    m AS (SELECT c.event_id, f.flood_id, row_number() OVER (PARTITION BY c.event_id ORDER BY f.start, f.flood_id) AS rn
          FROM complaints c JOIN flood f ON c.segment_id = f.segment_id AND c.start BETWEEN f.start AND f.window_end)
    SELECT c.event_id, c.segment_id, m.flood_id FROM complaints c LEFT JOIN m ON c.event_id = m.event_id AND m.rn = 1""",
)
def point_in_first_interval(spark, sf):
    ev = flood_events(spark, sf).select("segment_id", F.col("start").alias("ws"), "window_end", "flood_id")
    a = I.assign_first_interval(complaints(spark, sf), ev, "segment_id", "event_id", "start", "ws", "window_end", "flood_id")
    return a.select("event_id", "segment_id", "flood_id")


@query(
    "complaint_summary",
    "A4 A34 J11",
    f"""WITH {EVENTS_SQL},
    m AS (SELECT c.event_id, c.event_type, e.props, f.flood_id, row_number() OVER (PARTITION BY c.event_id ORDER BY f.start, f.flood_id) AS rn
          FROM complaints c JOIN events e USING (event_id) JOIN flood f ON c.user_id = CAST(split_part(f.segment_id, '-', 1) AS BIGINT) AND c.start BETWEEN f.start AND f.window_end),
    a AS (SELECT *, CASE event_type WHEN 'click' THEN 'spatial_nearest' WHEN 'view' THEN 'Textual_unique' END AS method FROM m WHERE rn = 1),
    b AS (SELECT flood_id, event_type, count(*) AS n FROM a GROUP BY ALL),
    k AS (SELECT flood_id, event_type, row_number() OVER (PARTITION BY flood_id ORDER BY n DESC, event_type) AS rn FROM b)
    SELECT a.flood_id, count(*) AS complaint_count_check, count(*) FILTER (WHERE method ILIKE '%spatial%') AS complaint_spatial_match_count,
      count(*) FILTER (WHERE method ILIKE '%text%') AS complaint_textual_match_count, max(k.event_type) AS complaint_borough_mode
    FROM a JOIN k ON a.flood_id = k.flood_id AND k.rn = 1 GROUP BY a.flood_id""",
)
def complaint_summary(spark, sf):
    ev = flood_events(spark, sf).select(
        F.split("segment_id", "-")[0].cast("bigint").alias("user_id"), F.col("start").alias("ws"), "window_end", "flood_id"
    )
    c = complaints(spark, sf).withColumn(
        "method", F.when(F.col("event_type") == "click", "spatial_nearest").when(F.col("event_type") == "view", "Textual_unique")
    )
    a = I.assign_first_interval(c, ev, "user_id", "event_id", "start", "ws", "window_end", "flood_id")
    return I.complaint_summary(a, "flood_id", "method", "event_type")


# Windows of orders and their station: a customer maps to the station numbered by its nation.
ORDER_WINDOWS_SQL = """win AS (
  SELECT o_orderkey AS event_id, c_nationkey AS station, o_orderdate AS s, o_orderdate + CAST(1 + length(o_orderpriority) AS BIGINT) * INTERVAL 1 DAY AS e
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def order_windows(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.select(
        F.col("o_orderkey").alias("event_id"),
        F.col("c_nationkey").alias("station"),
        F.col("o_orderdate").alias("s"),
        T.plus_seconds(F.col("o_orderdate"), (F.length("o_orderpriority") + 1) * 86400).alias("e"),
    )


SAMPLES_SQL = "smp AS (SELECT CAST(s_nationkey AS INTEGER) AS station, l_shipdate AS ts, CASE WHEN l_returnflag = 'R' AND l_discount = 0 THEN NULL ELSE l_quantity END AS level FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"


def samples(spark, sf):
    l, s = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    level = F.when(~((F.col("l_returnflag") == "R") & (F.col("l_discount") == 0)), F.col("l_quantity"))
    return l.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_nationkey").alias("station"), F.col("l_shipdate").alias("ts"), level.alias("level")
    )


@query(
    "series_window_features",
    "J13 A6",
    f"""WITH {ORDER_WINDOWS_SQL}, {SAMPLES_SQL}
    SELECT w.event_id, count(x.station) AS tide_obs_n, round(avg(level), 6) AS tide_level_m_mean, max(level) AS tide_level_m_max,
      min(level) AS tide_level_m_min, max(level) - min(level) AS tide_level_m_range
    FROM win w LEFT JOIN smp x ON w.station = x.station AND x.ts BETWEEN w.s AND w.e GROUP BY w.event_id""",
)
def series_window_features(spark, sf):
    f = I.window_sample_features(order_windows(spark, sf), samples(spark, sf), "station", ("s", "e"), "event_id", "ts", "level", 7 * 86400)
    return f.withColumn("tide_level_m_mean", r(F.col("tide_level_m_mean")))


PERIODS_SQL = """per AS (
  SELECT CAST(extract(year FROM o_orderdate) AS INTEGER) AS end_year, 'acs_' || CAST(extract(year FROM o_orderdate) AS INTEGER) AS period FROM orders WHERE o_orderpriority = '1-URGENT'
  GROUP BY ALL HAVING CAST(extract(year FROM o_orderdate) AS INTEGER) IN (1997, 1999, 2000))"""


@query(
    "as_of_period",
    "J14",
    f"""WITH {PERIODS_SQL}, ev AS (SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS INTEGER) AS yr FROM orders)
    SELECT o_orderkey, yr, coalesce((SELECT arg_max(period, end_year) FROM per WHERE end_year <= yr), (SELECT arg_min(period, end_year) FROM per)) AS period FROM ev""",
)
def as_of_period(spark, sf):
    o = table(spark, sf, "orders")
    years = o.where(F.col("o_orderpriority") == "1-URGENT").select(F.year("o_orderdate").alias("end_year")).distinct()
    per = years.where(F.col("end_year").isin(1997, 1999, 2000)).withColumn("period", F.concat(F.lit("acs_"), F.col("end_year").cast("string")))
    ev = o.select("o_orderkey", F.year("o_orderdate").alias("yr"))
    return I.as_of_period(ev, "yr", per, "period", "end_year", "end_year").select("o_orderkey", "yr", "period")


CONFLICT_SQL = """cand AS (SELECT l_orderkey * 10 + l_linenumber AS cand_id, o_custkey AS k, l_shipdate AS s, l_shipdate + CAST(l_quantity AS BIGINT) * INTERVAL 1 HOUR AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ow AS (SELECT o_custkey AS k, o_orderdate AS s, o_orderdate + INTERVAL 3 DAY AS e FROM orders)"""


@query(
    "temporal_conflict",
    "J15 J7 A22",
    f"""WITH {CONFLICT_SQL}
    SELECT DISTINCT cand_id FROM cand c WHERE EXISTS (SELECT 1 FROM ow WHERE ow.k = c.k AND ow.s <= c.e + INTERVAL 6 HOUR AND ow.e >= c.s - INTERVAL 6 HOUR)""",
)
def temporal_conflict(spark, sf):
    l, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    cand = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cand_id"), F.col("o_custkey").alias("k"),
        F.col("l_shipdate").alias("s"), T.plus_seconds(F.col("l_shipdate"), F.col("l_quantity") * 3600).alias("e"),
    )
    ow = o.select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("s"), T.plus_seconds(F.col("o_orderdate"), 3 * 86400).alias("e"))
    return I.temporal_conflicts(cand, ow, "k", "cand_id", ("s", "e"), 6 * HOUR, 7 * 86400)
