"""Matched controls, their diagnostics, balanced tables and analysis views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from eventloom.operators import bins as B
from eventloom.operators import controls as K
from eventloom.operators import intervals as I
from eventloom.plans.events import STORM_SQL, storm_windows
from eventloom.plans.registry import query, table
from eventloom.plans.statistics import _RB
from eventloom.session import pin, tabled

c = F.col


def universe(spark, sf):
    """Parts as street segments: borough = type, road = brand, bands from price and size."""
    p = table(spark, sf, "part")
    p = B.rank_bins(p, "p_retailprice", ["p_partkey"], 10, "eb")
    p = p.select(c("p_partkey").alias("segment"), c("p_type").alias("borough"), c("p_brand").alias("road"), B.band_label(c("eb"), "elev").alias("elevation_band"), F.when(c("p_size") > 25, "far").otherwise("near").alias("shore_band"))
    return K.stratum_keys(p, ["borough"], "road", ["elevation_band", "shore_band"])


def positives(spark, sf, segments):
    storms = I.storm_clusters(storm_windows(spark, sf), "start", "end", 600, 6 * 3600)
    return with_pools(storms.select("event_id", "start", "end", c("storm_event_id").alias("storm"), c("user_id").alias("segment")), segments)


def with_pools(pos, segments):
    """Positives on known segments, with the keys of their pools."""
    return pos.join(segments.select("segment", "k1", "k2", "k3"), "segment")


def exclusions(segments, pos):
    # the neighbours of a segment are the ones numbered next to it
    own = pin(pos.select("storm", "segment").distinct())
    near = own.select("storm", F.explode(F.array(c("segment"), c("segment") - 1, c("segment") + 1)).alias("segment")).distinct()
    spatial = near.join(segments.select("segment"), "segment", "left_semi").select("storm", "segment")
    none = spatial.where(F.lit(False))
    return K.exclusion_flags(own, spatial, none)


U_SQL = """ub AS (SELECT p_partkey AS segment, p_type AS k3, p_brand AS road, p_size FROM part), pz AS (SELECT st.event_id, st.storm_event_id AS storm, st.user_id AS segment, ub.k3 FROM st JOIN ub ON ub.segment = st.user_id),
pp AS (SELECT DISTINCT storm, segment FROM pz), sp2 AS (SELECT DISTINCT pp.storm, b.segment FROM pp JOIN ub a ON a.segment = pp.segment JOIN ub b ON b.segment BETWEEN a.segment - 1 AND a.segment + 1),
fl AS (SELECT storm, segment, max(p) AS p, max(s) AS s FROM (SELECT storm, segment, 1 AS p, 0 AS s FROM pp UNION ALL SELECT storm, segment, 0, 1 FROM sp2) GROUP BY 1, 2), fk AS (SELECT fl.*, ub.k3 FROM fl JOIN ub USING (segment))"""


def _level_sql(lv: int) -> str:
    """Round ``lv``: turns within the pool, segments each window of a storm has free, and the one of each turn."""
    before = " UNION ALL ".join(f'SELECT event_id, start, "end", segment FROM l{i}' for i in range(1, lv)) or 'SELECT 0 AS event_id, NULL::TIMESTAMP AS start, NULL::TIMESTAMP AS "end", 0 AS segment WHERE FALSE'
    return f"""t{lv} AS MATERIALIZED ({before}), o{lv} AS MATERIALIZED (SELECT event_id, start, "end", storm, k{lv} AS k, row_number() OVER (PARTITION BY k{lv} ORDER BY start, "end", event_id) - 1 AS turn FROM pos WHERE event_id NOT IN (SELECT event_id FROM t{lv})),
w{lv} AS MATERIALIZED (SELECT storm, k, start, "end", min(turn) AS low FROM o{lv} GROUP BY ALL),
f{lv} AS MATERIALIZED (SELECT w.*, u.segment, row_number() OVER (PARTITION BY w.storm, w.k, w.start, w."end" ORDER BY u.segment) - 1 AS place, count(*) OVER (PARTITION BY w.storm, w.k, w.start, w."end") AS free
  FROM w{lv} w JOIN uni u ON u.k{lv} = w.k ANTI JOIN fl ON fl.storm = w.storm AND fl.segment = u.segment ANTI JOIN t{lv} t ON t.start = w.start AND t."end" = w."end" AND t.segment = u.segment),
l{lv} AS MATERIALIZED (SELECT o.event_id, o.start, o."end", f.segment, {lv} AS level FROM o{lv} o JOIN f{lv} f ON f.storm = o.storm AND f.k = o.k AND f.start = o.start AND f."end" = o."end" AND turn - low < free AND place = turn % free)"""


BANDS = f"""eb AS (SELECT p_partkey, {_RB.format(q='10.0')} AS b FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS rn, count(*) OVER () AS n FROM part)),
uni AS MATERIALIZED (SELECT p_partkey AS segment, p_type || '|' || p_brand || '|' || b || '|' || (p_size > 25) AS k1, p_type || '|' || b || '|' || (p_size > 25) AS k2, p_type AS k3 FROM part JOIN eb USING (p_partkey))"""


@query(
    "matched_controls",
    "M3 M1 F27",
    f"""WITH {STORM_SQL}, {U_SQL}, {BANDS}, pos AS MATERIALIZED (SELECT st.event_id, st.start, st."end", st.storm_event_id AS storm, uni.* FROM st JOIN uni ON uni.segment = st.user_id),
    {', '.join(_level_sql(lv) for lv in (1, 2, 3))}, a AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)
    SELECT 'NEG_' || event_id AS event_id, CAST(event_id AS VARCHAR) AS matched_positive_event_id, a.segment, a.start, a."end", storm, FALSE AS occurrence, 0 AS intensity, level AS negative_sampling_level, level > 1 AS negative_sampling_relaxed,
    ['same_road_same_elev_same_shore', 'same_elev_same_shore', 'same_borough_same_tide_same_precip'][level] AS negative_sampling_notes,
    (row_number() OVER (PARTITION BY a.segment ORDER BY a.start, a."end", event_id) - 1)::DOUBLE AS negative_match_score FROM a JOIN (SELECT event_id, storm FROM pos) USING (event_id)""",
)
def matched_controls(spark, sf):
    segments = tabled(universe(spark, sf))
    pos = pin(positives(spark, sf, segments))
    picks = K.matched_controls(pos, segments, exclusions(segments, pos))
    return K.control_rows(picks, pos)


@query(
    "sampling_diagnostics",
    "M4 A22",
    f"""WITH {STORM_SQL}, {U_SQL}, ag AS (SELECT storm, k3, sum(p) AS np, sum(s) AS ns, sum(p * s) AS nps, count(*) AS nany FROM fk GROUP BY 1, 2), bs AS (SELECT k3, count(*) AS n FROM ub GROUP BY 1)
    SELECT pz.event_id, n AS pool_before, n - nany AS pool_after, 1 AS excluded_by_same_segment, CAST(np - fk.p AS BIGINT) AS excluded_by_temporal_overlap, CAST(ns - fk.s AS BIGINT) AS excluded_by_spatial_buffer,
    CAST(nps - fk.p * fk.s AS BIGINT) AS excluded_by_spatiotemporal_buffer, 0 AS excluded_by_possible_unreported FROM pz JOIN bs USING (k3) JOIN ag ON ag.storm = pz.storm AND ag.k3 = pz.k3 JOIN fk ON fk.storm = pz.storm AND fk.segment = pz.segment AND fk.k3 = pz.k3""",
)
def sampling_diagnostics(spark, sf):
    segments = tabled(universe(spark, sf))
    pos = pin(positives(spark, sf, segments))
    return K.sampling_diagnostics(pos, segments, exclusions(segments, pos))


def _roles(spark, sf):
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    pos = o.select(c("o_orderkey").cast("string").alias("event_id"), F.lit(True).alias("occurrence"), c("o_totalprice").alias("n_prec"), c("o_orderpriority").alias("borough"), F.lit("positive").alias("role"), F.lit("observed_reported_flood").alias("label_definition"))
    first = l.groupBy("l_orderkey").agg(F.min("l_quantity").alias("n_prec"))
    neg = first.select(F.concat(F.lit("NEG_"), c("l_orderkey").cast("string")).alias("event_id"), F.lit(False).alias("occurrence"), "n_prec", F.lit("negative").alias("role"), F.lit("matched_no_observed_reported_flood").alias("label_definition"))
    return pos.unionByName(neg, allowMissingColumns=True)


@query(
    "balanced_union",
    "M5 O4 A19",
    """SELECT CAST(o_orderkey AS VARCHAR) AS event_id, TRUE AS occurrence, o_totalprice AS n_prec, o_orderpriority AS borough, 'positive' AS role, 'observed_reported_flood' AS label_definition FROM orders
    UNION ALL SELECT 'NEG_' || l_orderkey, FALSE, min(l_quantity), NULL, 'negative', 'matched_no_observed_reported_flood' FROM lineitem GROUP BY l_orderkey""",
)
def balanced_union(spark, sf):
    return _roles(spark, sf)


@query(
    "analysis_view_summary",
    "M6 F25",
    """WITH n AS (SELECT (SELECT count(*) FROM orders) AS pos, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS neg, (SELECT count(*) FROM customer) AS cand, (SELECT count(*) FROM customer WHERE c_acctbal > 5000) AS hi)
    SELECT 'strict_main' AS view_name, pos + neg AS rows, pos AS observed_positive, neg AS matched_negative, 0 AS possible_rows FROM n UNION ALL SELECT 'main_plus_high_conf_possible', pos + neg + hi, pos, neg, hi FROM n UNION ALL SELECT 'semi_supervised_pool', pos + neg + cand, pos, neg, cand FROM n""",
)
def analysis_view_summary(spark, sf):
    cand = table(spark, sf, "customer").select(F.concat(F.lit("POSSIBLE_"), c("c_custkey").cast("string")).alias("event_id"), F.when(c("c_acctbal") > 5000, "high").otherwise("low").alias("confidence"))
    views = K.analysis_views(_roles(spark, sf), cand)
    return reduce(lambda a, b: a.union(b), [K.view_summary(v, n) for n, v in views.items()])
