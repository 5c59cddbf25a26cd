"""The composed event tables: master rows with all features, and the balanced table of positives and matched controls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions import labels as L
from eventloom.functions.temporal import micros
from eventloom.operators import contracts as C
from eventloom.operators import controls as K
from eventloom.operators import intervals as I
from eventloom.operators.joins import salted_join
from eventloom.plans.controls import BANDS, exclusions, universe, with_pools
from eventloom.plans.events import STORM_SQL, storm_windows
from eventloom.plans.registry import QUERIES, query, table
from eventloom.session import pin, tabled

c = F.col

STATIC = ("borough", "road", "elevation_band", "shore_band", "zone_class")
STORM = ("storm_event_id", "storm_positive_count", "storm_duration_hours")
COPIED = ("complaint_count", "complaint_value_max", "district", "value_per_complaint")
BASE = {"event_id": "string", "segment": "bigint", "start": "timestamp_ntz", "end": "timestamp_ntz"}


def segment_features(spark, sf, segments) -> DataFrame:
    """One row per segment of the universe or with infrastructure: bands, road class, the broad zone class of its zone code, infrastructure."""
    # sizes stand for zone codes: four kinds of code and none
    size = c("p_size")
    code = F.when(size < 10, "AE").when(size < 15, "VE").when(size < 30, "X").when(size < 40, "OPEN WATER").when(size < 45, "OUTSIDE_NFHL")
    zones = table(spark, sf, "part").select(c("p_partkey").alias("segment"), L.flood_zone_class(code).alias("zone_class"))
    infra = table(spark, sf, "lineitem").groupBy(c("l_partkey").alias("segment")).agg(F.count("*").alias("infra_count"), F.max("l_quantity").alias("infra_quantity_max"))
    return segments.join(zones, "segment").select("segment", *STATIC).join(infra, "segment", "full")


def complaints(spark, sf) -> DataFrame:
    """One row per place of complaints: their count, largest value, district, and value per complaint."""
    o = table(spark, sf, "orders").groupBy(c("o_custkey").alias("place")).agg(F.count("*").alias("complaint_count"), F.max("o_totalprice").alias("complaint_value_max"))
    p = table(spark, sf, "customer").join(table(spark, sf, "nation"), c("c_nationkey") == c("n_nationkey"), "left")
    return p.select(c("c_custkey").alias("place"), c("n_name").alias("district"), "c_acctbal").join(o, "place", "left").select(
        "place", F.coalesce("complaint_count", F.lit(0)).cast("bigint").alias("complaint_count"), "complaint_value_max", "district", F.round(F.try_divide("c_acctbal", "complaint_count"), 6).alias("value_per_complaint")
    )


def master(spark, sf, features) -> DataFrame:
    """One row per event: window, features of its segment, complaints and district, storm; each join keeps the rows.

    A storm is a matter of the event's start and all else of its segment, so events travel once for each."""
    events = storm_windows(spark, sf).select(c("event_id").cast("string").alias("event_id"), c("user_id").cast("bigint").alias("segment"), "start", "end", "event_type")
    rows, n = C.stage(events, "windows", BASE, ["event_id"])
    C.unique(rows, "windows", ["event_id"])
    storms = I.storm_starts(rows, "start", "end", 600, 6 * 3600).select("start", "storm_event_id", c("n_positive_events").alias("storm_positive_count"), F.round("storm_duration_hours", 6).alias("storm_duration_hours"))
    rows = salted_join(rows, storms, ["start"])
    rows = rows.join(features, "segment", "left").join(complaints(spark, sf).withColumnRenamed("place", "segment"), "segment", "left")
    hours = F.round((micros(c("end")) - micros(c("start"))) / F.lit(3_600_000_000.0), 6)
    rows = rows.withColumns({"infra_count": F.coalesce("infra_count", F.lit(0)).cast("bigint"), "duration_hours": hours, "label_definition": F.lit("observed_reported_flood")})
    rows = rows.select("event_id", "segment", "start", "end", "event_type", *STATIC, "infra_count", "infra_quantity_max", *COPIED, *STORM, "duration_hours", "label_definition")
    held = BASE | {"zone_class": "string", "infra_count": "bigint", "complaint_count": "bigint", "storm_event_id": "string", "storm_positive_count": "bigint", "storm_duration_hours": "double"}
    return C.stage(rows, "master", held, ["event_id", "storm_event_id"], n)[0]


MASTER_SQL = f"""SELECT CAST(st.event_id AS VARCHAR) AS event_id, CAST(st.user_id AS BIGINT) AS segment, st.start, st."end", st.event_type, s.borough, s.road, s.elevation_band, s.shore_band, s.zone_class,
  coalesce(f.infra_count, 0) AS infra_count, f.infra_quantity_max, k.complaint_count, k.complaint_value_max, k.district, k.value_per_complaint, st.storm_event_id,
  count(*) OVER (PARTITION BY st.storm_event_id) AS storm_positive_count,
  round(date_diff('microsecond', min(st.start) OVER (PARTITION BY st.storm_event_id), max(st."end") OVER (PARTITION BY st.storm_event_id)) / 3600000000.0, 6) AS storm_duration_hours,
  round(date_diff('microsecond', st.start, st."end") / 3600000000.0, 6) AS duration_hours, 'observed_reported_flood' AS label_definition
FROM st LEFT JOIN stat s ON s.segment = st.user_id LEFT JOIN infra f ON f.segment = st.user_id LEFT JOIN comp k ON k.place = st.user_id"""
PARTS_SQL = f"""{STORM_SQL}, {BANDS},
stat AS (SELECT p_partkey AS segment, p_type AS borough, p_brand AS road, 'elev_' || b AS elevation_band, CASE WHEN p_size > 25 THEN 'far' ELSE 'near' END AS shore_band,
  CASE WHEN p_size < 15 THEN 'SFHA' WHEN p_size < 30 THEN 'MINIMAL' WHEN p_size < 40 THEN 'OTHER' WHEN p_size < 45 THEN 'OUTSIDE_NFHL' ELSE 'UNKNOWN' END AS zone_class FROM part JOIN eb USING (p_partkey)),
infra AS (SELECT l_partkey AS segment, count(*) AS infra_count, max(l_quantity) AS infra_quantity_max FROM lineitem GROUP BY 1),
comp AS (SELECT c_custkey AS place, count(o_orderkey) AS complaint_count, max(o_totalprice) AS complaint_value_max, any_value(n_name) AS district,
  round(any_value(c_acctbal) / nullif(count(o_orderkey), 0), 6) AS value_per_complaint FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
m AS MATERIALIZED ({MASTER_SQL})"""


@query("master_table", "M2 A11 F25", f"WITH {PARTS_SQL} SELECT * FROM m")
def master_table(spark, sf):
    return master(spark, sf, segment_features(spark, sf, universe(spark, sf)))


@query(
    "master_validation",
    "M2 A22",
    f"""WITH {PARTS_SQL} SELECT 'rows' AS metric, count(*) AS value FROM m UNION ALL SELECT 'unique_segments', count(DISTINCT segment) FROM m UNION ALL SELECT 'storm_events', count(DISTINCT storm_event_id) FROM m
    UNION ALL SELECT 'duplicate_event_id', count(*) - count(DISTINCT event_id) FROM m UNION ALL SELECT 'null_borough', count(*) - count(borough) FROM m UNION ALL SELECT 'null_district', count(*) - count(district) FROM m
    UNION ALL SELECT 'negative_duration', count(*) FILTER (WHERE duration_hours < 0) FROM m""",
)
def master_validation(spark, sf):
    m = master_table(spark, sf)
    ids = m.groupBy("event_id").agg(F.count("*").alias("n")).agg(F.sum(c("n") - 1).alias("v"))
    one = m.agg(
        F.count("*").alias("rows"), F.count_distinct("segment").alias("unique_segments"), F.count_distinct("storm_event_id").alias("storm_events"),
        F.count_if(c("borough").isNull()).alias("null_borough"), F.count_if(c("district").isNull()).alias("null_district"), F.count_if(c("duration_hours") < 0).alias("negative_duration"),
    )
    long = one.unpivot([], list(one.columns), "metric", "value")
    return long.unionByName(ids.select(F.lit("duplicate_event_id").alias("metric"), F.coalesce("v", F.lit(0)).cast("bigint").alias("value")))


def balanced(spark, sf) -> DataFrame:
    """Positives and their controls in one table: a control has its own segment's features, its positive's window, storm and complaints."""
    segments = tabled(universe(spark, sf))
    features = tabled(segment_features(spark, sf, segments))
    pos = master(spark, sf, features)
    drawn = pos.withColumns({"event_id": c("event_id").cast("bigint"), "storm": c("storm_event_id")})
    asking = with_pools(drawn.select("event_id", "start", "end", "storm", "segment"), segments)
    picks = pin(K.matched_controls(asking, segments, exclusions(segments, asking)))
    C.unique(picks, "controls", ["event_id"])
    copied = (*STORM, *COPIED)
    neg = K.control_rows(picks, drawn, copied)
    sampling = {"negative_sampling_level": "int", "negative_sampling_relaxed": "boolean", "negative_sampling_notes": "string", "negative_match_score": "double"}
    neg = neg.select("event_id", "matched_positive_event_id", c("segment").cast("bigint").alias("segment"), "start", "end", *[c(k).cast(t).alias(k) for k, t in sampling.items()], *copied)
    neg = neg.join(features, "segment", "left")
    neg = neg.withColumns({"infra_count": F.coalesce("infra_count", F.lit(0)).cast("bigint"), "label_definition": F.lit("matched_no_observed_reported_flood"), "dataset_split_role": F.lit("negative")})
    neg, _ = C.stage(neg, "controls", BASE | sampling | {"storm_event_id": "string"}, ["event_id", "matched_positive_event_id", "storm_event_id"], picks.count())
    pos = pos.withColumns({"matched_positive_event_id": c("event_id"), "dataset_split_role": F.lit("positive"), **{k: F.lit(None).cast(t) for k, t in sampling.items()}})
    return pos.unionByName(neg, allowMissingColumns=True)


@query(
    "balanced_table",
    "M5 M3 J17",
    f"""WITH {PARTS_SQL}, n AS MATERIALIZED ({QUERIES['matched_controls'].sql})
    SELECT m.*, event_id AS matched_positive_event_id, 'positive' AS dataset_split_role, NULL::INTEGER AS negative_sampling_level, NULL::BOOLEAN AS negative_sampling_relaxed, NULL::VARCHAR AS negative_sampling_notes, NULL::DOUBLE AS negative_match_score FROM m
    UNION ALL SELECT n.event_id, n.segment, n.start, n."end", NULL, s.borough, s.road, s.elevation_band, s.shore_band, s.zone_class, coalesce(f.infra_count, 0), f.infra_quantity_max,
      m.complaint_count, m.complaint_value_max, m.district, m.value_per_complaint, m.storm_event_id, m.storm_positive_count, m.storm_duration_hours, NULL, 'matched_no_observed_reported_flood',
      n.matched_positive_event_id, 'negative', n.negative_sampling_level, n.negative_sampling_relaxed, n.negative_sampling_notes, n.negative_match_score
    FROM n JOIN m ON m.event_id = n.matched_positive_event_id LEFT JOIN stat s ON s.segment = n.segment LEFT JOIN infra f ON f.segment = n.segment""",
)
def balanced_table(spark, sf):
    return balanced(spark, sf)
