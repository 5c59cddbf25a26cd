"""Column reports, distributions, bins and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import bins as B
from eventloom.operators import stats as S
from eventloom.operators.quantiles import exact_quantiles, groups_are_small, small_group_quantiles
from eventloom.operators.sampling import top_n_per_group
from eventloom.plans.registry import query, table
from eventloom.session import tabled

c = F.col
NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def r(e, n=6):
    return F.round(e, n)


def holes(spark, sf):
    """Lineitem with some values missing."""
    l = table(spark, sf, "lineitem")
    return l.withColumn("l_tax", F.when(c("l_returnflag") != "R", c("l_tax"))).withColumn("l_discount", F.when(c("l_discount") > 0.02, c("l_discount")))


HOLES = "h AS (SELECT * REPLACE (CASE WHEN l_returnflag <> 'R' THEN l_tax END AS l_tax, CASE WHEN l_discount > 0.02 THEN l_discount END AS l_discount) FROM lineitem)"
COLS = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
DT = dict(zip(COLS, "bigint bigint bigint int double double double double string string timestamp_ntz".split()))


@query(
    "missingness",
    "A13",
    f"WITH {HOLES} " + " UNION ALL ".join(f"SELECT '{x}' AS \"column\", count(*) - count({x}) AS missing_count, round((count(*) - count({x})) / count(*), 6) AS missing_share, '{DT[x]}' AS dtype FROM h" for x in COLS),
)
def missingness(spark, sf):
    return S.missingness(holes(spark, sf)).withColumn("missing_share", r(c("missing_share")))


_Q = ", ".join(f"round(quantile_cont({{x}}, {p}), 6) AS {n}" for n, p in S.SUMMARY_PROBS.items())


@query(
    "numeric_summary",
    "A14",
    f"WITH {HOLES} " + " UNION ALL ".join((f"SELECT '{{x}}' AS \"column\", count({{x}}) AS count, round(avg({{x}}), 6) AS mean, round(stddev_samp({{x}}), 6) AS std, min({{x}}) AS min, max({{x}}) AS max, {_Q} FROM h").replace("{x}", x) for x in NUM),
)
def numeric_summary(spark, sf):
    s = S.numeric_summary(holes(spark, sf), NUM)
    return s.select("column", "count", r(c("mean")).alias("mean"), r(c("std")).alias("std"), "min", "max", *[r(c(p)).alias(p) for p in S.SUMMARY_PROBS])


@query(
    "group_numeric_stats",
    "A21 A14",
    " UNION ALL ".join(f"SELECT l_returnflag, '{x}' AS \"column\", count({x}) AS count, round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std, min({x}) AS min, max({x}) AS max, round(median({x}), 6) AS median FROM lineitem GROUP BY 1" for x in NUM),
)
def group_numeric_stats(spark, sf):
    s = S.numeric_summary(table(spark, sf, "lineitem"), NUM, ["l_returnflag"], {"median": 0.5})
    return s.select("l_returnflag", "column", "count", r(c("mean")).alias("mean"), r(c("std")).alias("std"), "min", "max", r(c("median")).alias("median"))


@query(
    "duration_percentiles",
    "A14 A30",
    """SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1""",
)
def duration_percentiles(spark, sf):
    q = exact_quantiles(table(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95})
    return q.select("event_type", *[r(c(p)).alias(p) for p in ("p50", "p75", "p90", "p95")])


PAIRS = [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax"), ("l_quantity", "l_tax"), ("l_discount", "l_extendedprice")]


@query(
    "pair_correlation",
    "A15",
    f"WITH {HOLES} " + " UNION ALL ".join(f"SELECT '{a}' AS feature, '{b}' AS target, count(*) AS n, round(corr({a}, {b}), 6) AS correlation FROM h WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in PAIRS),
)
def pair_correlation(spark, sf):
    return S.pair_correlations(holes(spark, sf), PAIRS).withColumn("correlation", r(c("correlation")))


def _spearman_sql(a, b):
    return f"""SELECT '{a}' AS feature_a, '{b}' AS feature_b, count(*) AS n, round(corr(ra, rb), 6) AS spearman FROM (
      SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb FROM h WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


@query("spearman_matrix", "A16", f"WITH {HOLES} " + " UNION ALL ".join(_spearman_sql(a, b) for a, b in PAIRS[:3]))
def spearman_matrix(spark, sf):
    from functools import reduce

    h = holes(spark, sf)
    parts = [S.spearman(h, a, b) for a, b in PAIRS[:3]]
    return reduce(lambda x, y: x.union(y), parts).withColumn("spearman", r(c("spearman")))


@query(
    "variance_inflation",
    "A17",
    f"""WITH {HOLES}, k AS (SELECT corr(l_quantity, l_extendedprice) AS ab, corr(l_quantity, l_discount) AS ac, corr(l_extendedprice, l_discount) AS bc FROM h WHERE l_discount IS NOT NULL AND l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
    d AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM k)
    SELECT 'l_quantity' AS feature, round((1 - bc * bc) / det, 6) AS vif FROM d UNION ALL SELECT 'l_extendedprice', round((1 - ac * ac) / det, 6) FROM d UNION ALL SELECT 'l_discount', round((1 - ab * ab) / det, 6) FROM d""",
)
def variance_inflation(spark, sf):
    return S.variance_inflation(holes(spark, sf), ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("vif", r(c("vif")))


@query(
    "validation_checks",
    "A18 A22",
    f"""WITH {HOLES} SELECT 'rows' AS metric, count(*) AS value FROM h UNION ALL SELECT 'unique_orders', count(DISTINCT l_orderkey) FROM h UNION ALL SELECT 'null_tax', count(*) - count(l_tax) FROM h
    UNION ALL SELECT 'negative_quantity', count(*) FILTER (WHERE l_quantity < 0) FROM h UNION ALL SELECT 'duplicate_order_rows', count(*) - count(DISTINCT l_orderkey) FROM h
    UNION ALL SELECT 'duplicate_signature_copies', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM h GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""",
)
def validation_checks(spark, sf):
    h = holes(spark, sf)
    return S.checks(
        h,
        {
            "rows": F.count("*"),
            "unique_orders": F.count_distinct("l_orderkey"),
            "null_tax": F.count_if(c("l_tax").isNull()),
            "negative_quantity": F.count_if(c("l_quantity") < 0),
            "duplicate_order_rows": F.max(S.duplicated_rows(h, ["l_orderkey"])),
            "duplicate_signature_copies": F.max(S.duplicated_copies(h, ["l_orderkey", "l_linenumber"])),
        },
    )


@query("value_counts", "A19", "SELECT CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_linestatus END AS value, count(*) AS n FROM lineitem GROUP BY 1")
def value_counts(spark, sf):
    v = F.when(c("l_returnflag") != "R", c("l_linestatus"))
    return table(spark, sf, "lineitem").groupBy(v.alias("value")).agg(F.count("*").alias("n"))


@query(
    "group_distribution",
    "A20 A28",
    " UNION ALL ".join(f"SELECT l_linestatus, '{f}' AS feature, CAST({f} AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY ALL" for f in ("l_returnflag", "l_linenumber", "l_suppkey")),
)
def group_distribution(spark, sf):
    return S.group_distribution(table(spark, sf, "lineitem"), "l_linestatus", ["l_returnflag", "l_linenumber", "l_suppkey"])


@query(
    "monthly_borough_counts",
    "A23",
    """SELECT strftime(ts, '%Y-%m') AS month, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(user_id AS VARCHAR) END AS borough, event_type AS type, count(*) AS n FROM (SELECT DISTINCT ON (event_id) * FROM events) GROUP BY ALL""",
)
def monthly_borough_counts(spark, sf):
    e = table(spark, sf, "events")
    both = e.unionByName(e.where("event_type = 'click'")).dropDuplicates(["event_id"])
    return both.groupBy(
        F.date_format("ts", "yyyy-MM").alias("month"), F.when(c("event_type") != "error", c("user_id").cast("string")).alias("borough"), c("event_type").alias("type")
    ).agg(F.count("*").alias("n"))


@query(
    "station_series_summary",
    "A26 S27",
    """SELECT s_suppkey, s_name, coalesce(n, 0) AS rows, first_ts, last_ts, CASE WHEN n IS NULL THEN 'none' ELSE 'landed' END AS series FROM supplier
    LEFT JOIN (SELECT l_suppkey, count(*) AS n, min(l_shipdate) AS first_ts, max(l_shipdate) AS last_ts FROM lineitem WHERE l_quantity > 49 AND l_tax = 0 GROUP BY 1) ON s_suppkey = l_suppkey""",
)
def station_series_summary(spark, sf):
    l = table(spark, sf, "lineitem").where("l_quantity > 49 AND l_tax = 0")
    a = l.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.min("l_shipdate").alias("first_ts"), F.max("l_shipdate").alias("last_ts"))
    j = table(spark, sf, "supplier").join(a, c("s_suppkey") == c("l_suppkey"), "left")
    return j.select("s_suppkey", "s_name", F.coalesce("n", F.lit(0)).alias("rows"), "first_ts", "last_ts", F.when(c("n").isNull(), "none").otherwise("landed").alias("series"))


@query(
    "two_level_median",
    "A30",
    """SELECT l_suppkey, round(median(m), 6) AS value FROM (SELECT l_suppkey, l_orderkey, median(l_extendedprice) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1""",
)
def two_level_median(spark, sf):
    l = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_extendedprice")
    if groups_are_small(l, ["l_suppkey"]):
        # rows dealt by the outer key serve both levels: one shuffle, and no table between them
        inner = small_group_quantiles(l.repartition("l_suppkey"), ["l_suppkey", "l_orderkey"], "l_extendedprice", {"m": 0.5})
        outer = small_group_quantiles(inner, ["l_suppkey"], "m", {"value": 0.5})
    else:
        inner = tabled(exact_quantiles(l, ["l_suppkey", "l_orderkey"], "l_extendedprice", {"m": 0.5}, many=True).select("l_suppkey", "m"))
        outer = exact_quantiles(inner, ["l_suppkey"], "m", {"value": 0.5}, many=True)
    return outer.withColumn("value", r(c("value")))


@query(
    "period_layer_summary",
    "A32 S26",
    """WITH t AS (SELECT CAST(extract(year FROM o_orderdate) AS INTEGER) AS period, o_orderpriority AS tab FROM orders WHERE o_totalprice > 495000 GROUP BY ALL)
    SELECT p.period, x.tab, t.tab IS NOT NULL AS present FROM (SELECT DISTINCT CAST(extract(year FROM o_orderdate) AS INTEGER) AS period FROM orders) p, (SELECT DISTINCT o_orderpriority AS tab FROM orders) x LEFT JOIN t ON t.period = p.period AND t.tab = x.tab""",
)
def period_layer_summary(spark, sf):
    o = table(spark, sf, "orders").withColumn("period", F.year("o_orderdate"))
    # expected tables of every period: the few table names ride along as one array
    tabs = o.agg(F.sort_array(F.collect_set("o_orderpriority"))).scalar()
    expected = o.select("period").distinct().withColumn("tabs", tabs).select("period", F.explode("tabs").alias("tab"))
    have = o.where("o_totalprice > 495000").select("period", c("o_orderpriority").alias("tab")).distinct().withColumn("present", F.lit(True))
    return expected.join(have, ["period", "tab"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


@query(
    "diagnostic_table",
    "A33 A34 F24",
    """SELECT l_returnflag AS confidence, count(*) AS n, round(avg(l_quantity), 6) AS mean_distance, round(median(l_quantity), 6) AS median_distance, count(*) FILTER (WHERE l_discount > 0.05) AS high, count(*) FILTER (WHERE l_tax IS NULL) AS unmatched FROM lineitem GROUP BY 1""",
)
def diagnostic_table(spark, sf):
    l = table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "confidence")
    a = l.groupBy("confidence").agg(F.count("*").alias("n"), r(F.avg("l_quantity")).alias("mean_distance"), F.count_if(c("l_discount") > 0.05).alias("high"), F.count_if(c("l_tax").isNull()).alias("unmatched"))
    return a.join(exact_quantiles(l, ["confidence"], "l_quantity", {"median_distance": 0.5}).withColumn("median_distance", r(c("median_distance"))), "confidence")


_RB = "greatest(0, CAST(ceil((rn - 1) * {q} / (n - 1)) AS BIGINT) - 1)"


@query(
    "rank_bins",
    "W7 M1",
    f"""WITH t AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS rn, count(*) OVER () AS n FROM part WHERE p_size > 2)
    SELECT p_partkey, CAST({_RB.format(q='10.0')} AS BIGINT) AS bin, 'elev_' || CAST({_RB.format(q='10.0')} AS BIGINT) AS band FROM t UNION ALL SELECT p_partkey, NULL, NULL FROM part WHERE p_size <= 2""",
)
def rank_bins(spark, sf):
    p = table(spark, sf, "part").withColumn("v", F.when(c("p_size") > 2, c("p_retailprice")))
    b = B.rank_bins(p, "v", ["p_partkey"], 10)
    return b.select("p_partkey", "bin", B.band_label(c("bin"), "elev").alias("band"))


@query(
    "value_bins",
    "W8 F26",
    """WITH e AS (SELECT quantile_cont(log10(greatest(l_quantity, 1)), [0, 0.25, 0.5, 0.75, 1]) AS q FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN v <= q[2] THEN 'low' WHEN v <= q[3] THEN 'medium' WHEN v <= q[4] THEN 'high' ELSE 'critical' END AS bin,
    CASE WHEN l_quantity <= 6 THEN 'short' WHEN l_quantity <= 24 THEN 'medium' WHEN l_quantity <= 72 THEN 'long' ELSE 'very_long' END AS duration_bin
    FROM (SELECT *, log10(greatest(l_quantity, 1)) AS v FROM lineitem), e""",
)
def value_bins(spark, sf):
    l = table(spark, sf, "lineitem").withColumn("v", F.log10(F.greatest("l_quantity", F.lit(1.0))))
    b = B.value_bins(l, "v", ["low", "medium", "high", "critical"])
    cut = B.cut(c("l_quantity"), [-0.001, 6, 24, 72, 99999], ["short", "medium", "long", "very_long"])
    return b.select("l_orderkey", "l_linenumber", "l_partkey", "bin", cut.alias("duration_bin"))


@query(
    "percentile_ranks",
    "W9",
    """SELECT l_orderkey, l_linenumber, l_partkey, round((rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0) / count(*) OVER (), 9) AS pct,
    round(rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0, 6) AS avg_rank FROM lineitem""",
)
def percentile_ranks(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return B.average_ranks(l, "l_quantity", "avg_rank", "pct").select("l_orderkey", "l_linenumber", "l_partkey", r(c("pct"), 9).alias("pct"), "avg_rank")


@query(
    "top_n_per_group",
    "W10 M38",
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn <= 3""",
)
def top_n_per_group_q(spark, sf):
    l = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return top_n_per_group(l, ["l_suppkey"], [c("l_extendedprice").desc(), c("l_orderkey"), c("l_linenumber"), c("l_partkey")], 3)


@query(
    "clip_and_scale",
    "W11 W12",
    """WITH q AS (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi, quantile_cont(o_totalprice, 0.95) AS t, min(o_totalprice) AS mn, max(o_totalprice) AS mx FROM orders)
    SELECT o_orderkey, round(least(greatest(o_totalprice, lo), hi), 6) AS clipped, round((o_totalprice - mn) / (mx - mn), 9) AS scaled, o_totalprice >= t AS critical FROM orders, q""",
)
def clip_and_scale(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    o = B.clip_to_quantiles(o, "o_totalprice", 0.01, 0.99, "clipped")
    o = B.at_least_quantile(B.min_max(o, "o_totalprice", "scaled"), "o_totalprice", 0.95, "critical")
    return o.select("o_orderkey", r(c("clipped")).alias("clipped"), r(c("scaled"), 9).alias("scaled"), "critical")


@query(
    "group_mean_zscores",
    "W11 M37",
    """WITH m AS (SELECT label, avg(embedding[1]) AS a, avg(embedding[2]) AS b, count(*) AS n FROM embeddings GROUP BY 1)
    SELECT label, n, round((a - avg(a) OVER ()) / stddev_samp(a) OVER (), 6) AS za, round((b - avg(b) OVER ()) / stddev_samp(b) OVER (), 6) AS zb FROM m""",
)
def group_mean_zscores(spark, sf):
    e = table(spark, sf, "embeddings")
    m = e.groupBy("label").agg(F.avg(c("embedding")[0]).alias("a"), F.avg(c("embedding")[1]).alias("b"), F.count("*").alias("n"))
    s = m.agg(F.struct(F.avg("a").alias("ma"), F.stddev_samp("a").alias("sa"), F.avg("b").alias("mb"), F.stddev_samp("b").alias("sb"))).scalar()
    x = m.withColumn("s", s)
    return x.select("label", "n", r((c("a") - c("s.ma")) / c("s.sa")).alias("za"), r((c("b") - c("s.mb")) / c("s.sb")).alias("zb"))
