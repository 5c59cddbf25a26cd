"""Relational joins, set operators, reshaping and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import text as X
from eventloom.operators import joins as J
from eventloom.operators import matching as M
from eventloom.operators.ordered import global_row_number, keep_first, nulls_last
from eventloom.plans.registry import query, table

c = F.col


def r(e, n=6):
    return F.round(e, n)


def tabs(spark, sf, *names):
    return [table(spark, sf, n) for n in names]


@query(
    "dimension_chain",
    "J1 J3 J21",
    """SELECT l_orderkey, l_linenumber, l_partkey, p_type, s_name, sn.n_name AS supplier_nation, r_name, c_mktsegment, cn.n_name AS customer_nation
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey LEFT JOIN region ON sn.n_regionkey = r_regionkey
    LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation cn ON c_nationkey = cn.n_nationkey""",
)
def dimension_chain(spark, sf):
    l, p, s, n, g, o, cu = tabs(spark, sf, "lineitem", "part", "supplier", "nation", "region", "orders", "customer")
    # sizes decide the strategy: AQE broadcasts what is small at run time and splits skewed shuffles
    sup = s.join(n, c("s_nationkey") == c("n_nationkey"), "left").join(g, c("n_regionkey") == c("r_regionkey"), "left")
    sup = sup.select("s_suppkey", "s_name", c("n_name").alias("supplier_nation"), "r_name")
    cust = cu.join(n, c("c_nationkey") == c("n_nationkey"), "left").select("c_custkey", "c_mktsegment", c("n_name").alias("customer_nation"))
    out = (
        l.join(p, c("l_partkey") == c("p_partkey"), "left").join(sup, c("l_suppkey") == c("s_suppkey"), "left")
        .join(o, c("l_orderkey") == c("o_orderkey"), "left").join(cust, c("o_custkey") == c("c_custkey"), "left")
    )
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "p_type", "s_name", "supplier_nation", "r_name", "c_mktsegment", "customer_nation")


@query(
    "checked_join",
    "J2 J20",
    "SELECT o_orderkey, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
)
def checked_join(spark, sf):
    o, cu, n = tabs(spark, sf, "orders", "customer", "nation")
    j = J.checked_join(o, cu.withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"], "left", "many_to_one")
    j = J.strict_lookup(j, n.withColumnRenamed("n_nationkey", "c_nationkey"), ["c_nationkey"], ["n_name"])
    return j.select("o_orderkey", "c_mktsegment", "n_name")


@query(
    "outer_reduce",
    "J4",
    """WITH a AS (SELECT l_partkey, sum(l_quantity) AS qty_open FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey, max(l_extendedprice) AS max_price FROM lineitem WHERE l_discount > 0.09 GROUP BY 1),
    d AS (SELECT l_partkey, count(*) AS n_returned FROM lineitem WHERE l_returnflag = 'R' AND l_tax > 0.05 GROUP BY 1) SELECT l_partkey, qty_open, max_price, n_returned FROM a FULL JOIN b USING (l_partkey) FULL JOIN d USING (l_partkey)""",
)
def outer_reduce(spark, sf):
    l = table(spark, sf, "lineitem")
    a = l.where((c("l_linestatus") == "O") & (c("l_returnflag") == "A")).groupBy("l_partkey").agg(F.sum("l_quantity").alias("qty_open"))
    b = l.where(c("l_discount") > 0.09).groupBy("l_partkey").agg(F.max("l_extendedprice").alias("max_price"))
    d = l.where((c("l_returnflag") == "R") & (c("l_tax") > 0.05)).groupBy("l_partkey").agg(F.count("*").alias("n_returned"))
    return J.outer_reduce([a, b, d], ["l_partkey"])


@query(
    "outer_counts",
    "J5",
    """WITH a AS (SELECT c_nationkey AS k, count(*) AS customers, sum(c_acctbal) AS bal FROM customer WHERE c_acctbal < 0 GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1)
    SELECT k, coalesce(customers, 0) AS customers, round(coalesce(bal, 0), 2) AS bal, coalesce(suppliers, 0) AS suppliers FROM a FULL JOIN b USING (k)""",
)
def outer_counts(spark, sf):
    cu, s = tabs(spark, sf, "customer", "supplier")
    a = cu.where("c_acctbal < 0").groupBy(c("c_nationkey").alias("k")).agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("bal"))
    b = s.groupBy(c("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "k", "full").fillna(0).withColumn("bal", r(c("bal"), 2))


@query(
    "multi_key_join",
    "J6",
    """WITH e AS (SELECT l_suppkey AS u, l_partkey AS v, count(*) AS edges, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, edges, w FROM lineitem LEFT JOIN e ON l_suppkey = u AND l_partkey = v""",
)
def multi_key_join(spark, sf):
    l = table(spark, sf, "lineitem")
    e = l.groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("edges"), F.sum("l_quantity").alias("w"))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(e, ["l_suppkey", "l_partkey"], "left")


@query(
    "self_role_features",
    "J8",
    """WITH nf AS (SELECT n_nationkey AS node, count(c_custkey) AS degree, avg(c_acctbal) AS betw, bool_or(c_acctbal > 9900) AS art FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE c_mktsegment <> 'BUILDING' AND n_regionkey < 4 GROUP BY 1)
    SELECT o_orderkey, l_linenumber, l_partkey, round(CASE WHEN a.node IS NULL THEN b.degree WHEN b.node IS NULL THEN a.degree ELSE (a.degree + b.degree) / 2.0 END, 6) AS degree_mean, greatest(a.degree, b.degree) AS degree_max,
      round(CASE WHEN a.node IS NULL THEN b.betw WHEN b.node IS NULL THEN a.betw ELSE (a.betw + b.betw) / 2.0 END, 6) AS betw_mean, coalesce(a.art, FALSE) OR coalesce(b.art, FALSE) AS art_any
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nf a ON c_nationkey = a.node LEFT JOIN nf b ON s_nationkey = b.node""",
)
def self_role_features(spark, sf):
    l, o, cu, s, n = tabs(spark, sf, "lineitem", "orders", "customer", "supplier", "nation")
    nf = cu.where("c_mktsegment <> 'BUILDING'").join(n.where("n_regionkey < 4"), c("c_nationkey") == c("n_nationkey"))
    nf = nf.groupBy(c("n_nationkey").alias("node")).agg(F.count("*").alias("degree"), F.avg("c_acctbal").alias("betw"), F.bool_or(c("c_acctbal") > 9900).alias("art"))
    a = nf.withColumnsRenamed({k: f"u_{k}" for k in nf.columns})
    b = nf.withColumnsRenamed({k: f"v_{k}" for k in nf.columns})
    edges = l.join(o, c("l_orderkey") == c("o_orderkey")).join(cu, c("o_custkey") == c("c_custkey")).join(s, c("l_suppkey") == c("s_suppkey"))
    j = edges.join(a, c("c_nationkey") == c("u_node"), "left").join(b, c("s_nationkey") == c("v_node"), "left")
    d = lambda k: (c(f"u_{k}").cast("double"), c(f"v_{k}").cast("double"))
    return j.select(
        "o_orderkey", "l_linenumber", "l_partkey", r(M.pair_mean(*d("degree"))).alias("degree_mean"), F.greatest("u_degree", "v_degree").alias("degree_max"),
        r(M.pair_mean(*d("betw"))).alias("betw_mean"), M.pair_any(c("u_art"), c("v_art")).alias("art_any"),
    )


@query(
    "semi_anti_membership",
    "J7 O6",
    """SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS urgent FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000)""",
)
def semi_anti_membership(spark, sf):
    cu, o = tabs(spark, sf, "customer", "orders")
    big = o.where("o_totalprice > 480000").select(c("o_custkey").alias("c_custkey"))
    urgent = o.where("o_orderpriority = '1-URGENT'").select(c("o_custkey").alias("c_custkey")).distinct().withColumn("urgent", F.lit(True))
    return cu.join(big, "c_custkey", "left_anti").join(urgent, "c_custkey", "left").select("c_custkey", F.coalesce("urgent", F.lit(False)).alias("urgent"))


@query(
    "text_fallback_match",
    "J9 J10 J21",
    f"""WITH seg AS (SELECT p_partkey AS segment_id, {X.clean_text_sql("p_name || ' ' || p_size || ' st'")} AS n1, {X.clean_text_sql("p_type || ' ave ' || p_size")} AS n2, p_brand AS b1, CASE WHEN p_size > 25 THEN 'Brand#1' END AS b2 FROM part),
    cand AS (SELECT DISTINCT segment_id, n AS name, b AS borough FROM (SELECT segment_id, n1 AS n, b1 AS b FROM seg UNION ALL SELECT segment_id, n2, b1 FROM seg UNION ALL SELECT segment_id, n1, b2 FROM seg UNION ALL SELECT segment_id, n2, b2 FROM seg) WHERE b IS NOT NULL),
    ex AS (SELECT name, borough, min(segment_id) AS s FROM cand GROUP BY 1, 2 HAVING count(DISTINCT segment_id) = 1), gl AS (SELECT name, min(segment_id) AS s FROM cand GROUP BY 1 HAVING count(DISTINCT segment_id) = 1),
    q AS (SELECT p_partkey AS id, {X.clean_text_sql("p_name || '-' || p_size || '. ST'")} AS name, CASE WHEN p_type = 'PROMO' THEN 'none' ELSE p_brand END AS borough FROM part)
    SELECT id, q.name, q.borough, coalesce(ex.s, gl.s) AS segment_id, CASE WHEN ex.s IS NOT NULL THEN 'textual_borough_unique' WHEN gl.s IS NOT NULL THEN 'textual_global_unique' END AS match_method
    FROM q LEFT JOIN ex ON q.name = ex.name AND q.borough = ex.borough LEFT JOIN gl ON q.name = gl.name""",
)
def text_fallback_match(spark, sf):
    p = table(spark, sf, "part")
    size = c("p_size").cast("string")
    n1 = X.clean_text(F.concat(c("p_name"), F.lit(" "), size, F.lit(" st")))
    n2 = X.clean_text(F.concat(c("p_type"), F.lit(" ave "), size))
    cand = M.name_candidates(p.withColumnRenamed("p_partkey", "segment_id"), "segment_id", [n1, n2], [c("p_brand"), F.when(c("p_size") > 25, "Brand#1")])
    q = p.select(
        c("p_partkey").alias("id"), X.clean_text(F.concat(c("p_name"), F.lit("-"), size, F.lit(". ST"))).alias("name"),
        F.when(c("p_type") == "PROMO", "none").otherwise(c("p_brand")).alias("borough"),
    )
    return M.cascade_match(q, cand, "name", "borough", "segment_id").select("id", "name", "borough", "segment_id", "match_method")


@query(
    "template_rows",
    "J16 W6 A29 O4",
    """WITH f AS (SELECT o_custkey, arg_min(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS first_open, arg_min(o_orderpriority, o_orderkey) AS first_priority FROM orders GROUP BY 1)
    SELECT 'POSSIBLE_' || o_custkey || '_' || printf('%04d', row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) AS event_id, o_orderkey, first_open, first_priority, c_mktsegment
    FROM orders LEFT JOIN f USING (o_custkey) LEFT JOIN customer ON o_custkey = c_custkey""",
)
def template_rows(spark, sf):
    from eventloom.operators.ordered import CHUNK, chunked_prefix, time_chunk

    o, cu = tabs(spark, sf, "orders", "customer")
    # first non-null per column and key, without sorting a key on one task
    first = o.groupBy("o_custkey").agg(
        F.min_by("o_totalprice", F.when(c("o_orderstatus") == "O", c("o_orderkey"))).alias("first_open"), F.min_by("o_orderpriority", "o_orderkey").alias("first_priority")
    )
    chunked = o.withColumn(CHUNK, time_chunk(c("o_orderdate"), 90 * 86400))
    num = chunked_prefix(chunked, ["o_custkey"], ["o_orderdate", "o_orderkey"], {"seq": ("cum_sum", F.lit(1))})
    j = num.join(first, "o_custkey", "left").join(cu, c("o_custkey") == c("c_custkey"), "left")
    eid = F.format_string("POSSIBLE_%d_%04d", "o_custkey", "seq")
    return j.select(eid.alias("event_id"), "o_orderkey", "first_open", "first_priority", "c_mktsegment")


@query(
    "copied_features",
    "J17 J19",
    """SELECT l_orderkey, l_linenumber, l_partkey, 'NEG_' || l_orderkey AS event_id, o_totalprice AS n_prec, o_orderpriority AS tide_class, p_type AS road FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey""",
)
def copied_features(spark, sf):
    l, o, p = tabs(spark, sf, "lineitem", "orders", "part")
    pos = o.select(c("o_orderkey").alias("matched"), c("o_totalprice").alias("n_prec"), c("o_orderpriority").alias("tide_class"))
    keyed = p.select(F.trim(c("p_partkey").cast("string")).alias("sid"), c("p_type").alias("road"))
    neg = l.select("l_orderkey", "l_linenumber", "l_partkey", c("l_orderkey").alias("matched"), F.trim(F.concat(F.lit(" "), c("l_partkey").cast("string"))).alias("sid"))
    out = neg.join(pos, "matched", "left").join(keyed, "sid", "left")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("NEG_"), c("matched").cast("string")).alias("event_id"), "n_prec", "tide_class", "road")


@query(
    "keep_first_rows",
    "W1 S14 J21",
    """WITH a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_tax > 0.07 THEN NULL ELSE l_discount END NULLS LAST, l_linenumber, l_partkey, l_extendedprice) AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS l FROM lineitem)
    SELECT x.l_orderkey, x.l_partkey AS first_part, x.l_extendedprice AS first_price, y.l_partkey AS last_part, y.l_shipdate AS last_ship FROM a x JOIN a y ON x.l_orderkey = y.l_orderkey AND x.f = 1 AND y.l = 1""",
)
def keep_first_rows(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    d = F.when(~(c("l_tax") > 0.07), c("l_discount"))
    a = keep_first(l, ["l_orderkey"], [*nulls_last(d), c("l_linenumber"), c("l_partkey"), c("l_extendedprice")])
    b = keep_first(l, ["l_orderkey"], [c("l_shipdate"), c("l_linenumber"), c("l_partkey"), c("l_extendedprice")], last=True)
    a = a.select("l_orderkey", c("l_partkey").alias("first_part"), c("l_extendedprice").alias("first_price"))
    return a.join(b.select("l_orderkey", c("l_partkey").alias("last_part"), c("l_shipdate").alias("last_ship")), "l_orderkey")


@query("union_by_name", "O4 S14 S25", "SELECT c_custkey AS id, c_acctbal AS bal, c_mktsegment AS seg, NULL AS nat, 'positive' AS role FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_nationkey, 'negative' FROM supplier")
def union_by_name(spark, sf):
    cu, s = tabs(spark, sf, "customer", "supplier")
    a = cu.select(c("c_custkey").alias("id"), c("c_acctbal").alias("bal"), c("c_mktsegment").alias("seg"), F.lit("positive").alias("role"))
    b = s.select(c("s_suppkey").alias("id"), c("s_acctbal").alias("bal"), c("s_nationkey").alias("nat"), F.lit("negative").alias("role"))
    return a.unionByName(b, allowMissingColumns=True)


@query(
    "set_algebra",
    "O5 O6 M4",
    """WITH a AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R')
    SELECT l_suppkey, l_partkey, 'both' AS kind FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT l_suppkey, l_partkey, 'only_a' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT l_suppkey, l_partkey, 'any' FROM (SELECT * FROM a UNION SELECT * FROM b)""",
)
def set_algebra(spark, sf):
    l = table(spark, sf, "lineitem")
    a = l.where("l_returnflag = 'A'").select("l_suppkey", "l_partkey").distinct()
    b = l.where("l_returnflag = 'R'").select("l_suppkey", "l_partkey").distinct()
    tag = lambda d, k: d.withColumn("kind", F.lit(k))
    return tag(a.intersect(b), "both").union(tag(a.subtract(b), "only_a")).union(tag(a.union(b).distinct(), "any"))


@query(
    "melt_pivot",
    "O7 A28",
    """WITH m AS (SELECT l_returnflag, l_linestatus, m.metric, m.value FROM lineitem, LATERAL (VALUES ('tax', l_tax), ('discount', l_discount)) AS m(metric, value))
    SELECT l_returnflag, metric, round(avg(value) FILTER (WHERE l_linestatus = 'F'), 6) AS mean_f, round(avg(value) FILTER (WHERE l_linestatus = 'O'), 6) AS mean_o FROM m GROUP BY 1, 2""",
)
def melt_pivot(spark, sf):
    l = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", c("l_tax").alias("tax"), c("l_discount").alias("discount"))
    m = l.unpivot(["l_returnflag", "l_linestatus"], ["tax", "discount"], "metric", "value")
    p = m.groupBy("l_returnflag", "metric").pivot("l_linestatus", ["F", "O"]).agg(F.avg("value"))
    return p.select("l_returnflag", "metric", r(c("F")).alias("mean_f"), r(c("O")).alias("mean_o"))


@query("confusion_crosstab", "A28 M25", "SELECT CAST(quality AS VARCHAR) AS y_true, count(*) FILTER (WHERE toxic = 0) AS pred_0, count(*) FILTER (WHERE toxic = 1) AS pred_1 FROM labels GROUP BY 1")
def confusion_crosstab(spark, sf):
    t = table(spark, sf, "labels").groupBy(c("quality").cast("string").alias("y_true")).pivot("toxic", [0, 1]).agg(F.count("doc_id"))
    return t.select("y_true", F.coalesce(c("0"), F.lit(0)).alias("pred_0"), F.coalesce(c("1"), F.lit(0)).alias("pred_1"))


@query(
    "stable_top_k",
    "O1 O2 A24 M38",
    "SELECT l_suppkey, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY qty DESC, l_suppkey LIMIT 20",
)
def stable_top_k(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))
    return g.orderBy(c("qty").desc(), "l_suppkey").limit(20)


@query("global_order_numbers", "O1 A3", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, row_number() OVER (ORDER BY l_shipdate, l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem")
def global_order_numbers(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate").withColumn("neg", -c("l_extendedprice"))
    return global_row_number(l, ["l_shipdate", "neg", "l_orderkey", "l_linenumber", "l_partkey"], "rn").drop("neg", "l_shipdate")


@query("seeded_sample", "O3 M28")
def seeded_sample(spark, sf):
    from eventloom.operators.sampling import seeded_sample as sample

    return sample(table(spark, sf, "orders"), "o_orderkey", 100, seed=42).select("o_orderkey", "o_totalprice")
