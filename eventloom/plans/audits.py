"""Metrics, calibration, bias, feature catalog, leakage and splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from eventloom.operators import bins as B
from eventloom.operators import catalog as C
from eventloom.operators import metrics as X
from eventloom.operators import sampling as S
from eventloom.plans.registry import query, table
from eventloom.session import pin

c = F.col


def r(e, n=6):
    return F.round(e, n)


# Predictions: one row per line item; model = status, set = era of shipping, score = scaled price.
PRED = """pred AS (SELECT l_orderkey * 100000000 + l_partkey * 10 + l_linenumber AS event_id, l_linestatus AS model_name, CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'train' WHEN l_shipdate < TIMESTAMP '2000-01-01' THEN 'validation' ELSE 'test' END AS set_name,
  n_name AS borough, l_returnflag = 'R' OR l_quantity > 45 AS y_true, round(l_extendedprice / 110000, 3) AS y_score, round(l_extendedprice / 110000, 3) >= 0.4 AS y_pred, l_quantity AS y_num, l_extendedprice / 2000 AS p_num,
  l_extendedprice AS price FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def predictions(spark, sf):
    l, s, n = (table(spark, sf, t) for t in ("lineitem", "supplier", "nation"))
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    era = F.when(c("l_shipdate") < day("1998-01-01"), "train").when(c("l_shipdate") < day("2000-01-01"), "validation").otherwise("test")
    score = F.round(c("l_extendedprice") / 110000, 3)
    return l.join(s, c("l_suppkey") == c("s_suppkey")).join(n, c("s_nationkey") == c("n_nationkey")).select(
        (c("l_orderkey") * 100000000 + c("l_partkey") * 10 + c("l_linenumber")).alias("event_id"), c("l_linestatus").alias("model_name"), era.alias("set_name"), c("n_name").alias("borough"),
        ((c("l_returnflag") == "R") | (c("l_quantity") > 45)).alias("y_true"), score.alias("y_score"), (score >= 0.4).alias("y_pred"), c("l_quantity").alias("y_num"),
        (c("l_extendedprice") / 2000).alias("p_num"), c("l_extendedprice").alias("price"),
    )


COUNTS = """cm AS (SELECT model_name, set_name, CAST(count(*) FILTER (WHERE y_true AND y_pred) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE NOT y_true AND y_pred) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE y_true AND NOT y_pred) AS DOUBLE) AS fn,
  CAST(count(*) FILTER (WHERE NOT y_true AND NOT y_pred) AS DOUBLE) AS tn, round(avg((y_score - CAST(y_true AS INTEGER)) ** 2), 6) AS brier_score FROM pred GROUP BY ALL),
st AS (SELECT model_name, set_name, y_score, count(*) FILTER (WHERE y_true) AS pos, count(*) FILTER (WHERE NOT y_true) AS neg FROM pred GROUP BY ALL),
cu AS (SELECT *, sum(pos) OVER w AS ctp, sum(neg) OVER w AS cfp, sum(pos) OVER (PARTITION BY model_name, set_name) AS p, sum(neg) OVER (PARTITION BY model_name, set_name) AS n FROM st WINDOW w AS (PARTITION BY model_name, set_name ORDER BY y_score DESC)),
rk AS (SELECT model_name, set_name, round(sum(neg * (ctp - pos / 2.0)) / max(p) / max(n), 6) AS roc_auc, round(sum(CAST(pos AS DOUBLE) * ctp / (ctp + cfp)) / max(p), 6) AS pr_auc FROM cu GROUP BY ALL)"""
KEYS = ["model_name", "set_name"]


@query(
    "class_metrics",
    "M14 M25",
    f"""WITH {PRED}, {COUNTS} SELECT model_name, set_name, tp, fp, fn, tn, brier_score, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy,
    round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(fp / (fp + tn), 6) AS false_positive_rate, round(fn / (fn + tp), 6) AS false_negative_rate, roc_auc, pr_auc FROM cm JOIN rk USING (model_name, set_name)""",
)
def class_metrics(spark, sf):
    m = X.classification_metrics(predictions(spark, sf), KEYS, "y_true", "y_pred", "y_score")
    return m.select(*KEYS, *[r(c(x)).alias(x) for x in m.columns if x not in KEYS])


@query("roc_curve_points", "M25", f"WITH {PRED}, {COUNTS} SELECT model_name, set_name, y_score AS threshold, round(cfp / n, 9) AS fpr, round(ctp / p, 9) AS tpr FROM cu")
def roc_curve_points(spark, sf):
    p = X.roc_points(predictions(spark, sf), KEYS, "y_true", "y_score")
    return p.select(*KEYS, "threshold", r(c("fpr"), 9).alias("fpr"), r(c("tpr"), 9).alias("tpr"))


@query(
    "regression_metrics",
    "M15",
    f"""WITH {PRED} SELECT model_name, set_name, round(sqrt(avg((y_num - p_num) ** 2)), 6) AS rmse, round(avg(abs(y_num - p_num)), 6) AS mae, round(1 - sum((y_num - p_num) ** 2) / (var_pop(y_num) * count(*)), 6) AS r2, round(corr(y_num, p_num), 6) AS pearson_correlation,
    round(avg(abs(y_num - p_num) / abs(y_num)), 6) AS mape, round(median(abs(y_num - p_num)), 6) AS median_absolute_error, round(corr(ry, rp), 6) AS spearman_correlation FROM (SELECT *, rank() OVER (PARTITION BY model_name, set_name ORDER BY y_num) + (count(*) OVER (PARTITION BY model_name, set_name, y_num) - 1) / 2.0 AS ry,
      rank() OVER (PARTITION BY model_name, set_name ORDER BY p_num) + (count(*) OVER (PARTITION BY model_name, set_name, p_num) - 1) / 2.0 AS rp FROM pred) GROUP BY model_name, set_name""",
)
def regression_metrics(spark, sf):
    m = X.regression_metrics(predictions(spark, sf), KEYS, "y_num", "p_num")
    return m.select(*KEYS, *[r(c(x)).alias(x) for x in m.columns if x not in KEYS])


@query(
    "regression_rank_correlation",
    "M15 A16",
    f"""WITH {PRED} SELECT 'y_num' AS feature_a, 'p_num' AS feature_b, count(*) AS n, round(corr(ra, rb), 6) AS spearman FROM (SELECT rank() OVER (ORDER BY y_num) + (count(*) OVER (PARTITION BY y_num) - 1) / 2.0 AS ra,
    rank() OVER (ORDER BY p_num) + (count(*) OVER (PARTITION BY p_num) - 1) / 2.0 AS rb FROM pred)""",
)
def regression_rank_correlation(spark, sf):
    from eventloom.operators.stats import spearman

    return spearman(predictions(spark, sf), "y_num", "p_num").withColumn("spearman", r(c("spearman")))


@query(
    "overfitting_flags",
    "M16 M20 M40",
    f"""WITH {PRED}, {COUNTS}, w AS (SELECT model_name, max(pr_auc) FILTER (WHERE set_name = 'train') AS train_pr_auc, max(pr_auc) FILTER (WHERE set_name = 'validation') AS v, max(pr_auc) FILTER (WHERE set_name = 'test') AS test_pr_auc FROM rk GROUP BY 1)
    SELECT model_name, train_pr_auc, test_pr_auc, v AS cv_validation_primary_score, round(train_pr_auc - v, 5) AS train_vs_validation_gap, round(v - test_pr_auc, 5) AS validation_vs_test_gap, train_pr_auc - v > 0.1 AS possible_overfitting, v - test_pr_auc > 0.1 AS possible_test_degradation FROM w""",
)
def overfitting_flags(spark, sf):
    m = X.ranking_metrics(predictions(spark, sf), KEYS, "y_true", "y_score").withColumn("pr_auc", r(c("pr_auc")))
    w = m.groupBy("model_name").pivot("set_name", ["train", "validation", "test"]).agg(F.max("pr_auc"))
    w = w.select("model_name", c("train").alias("train_pr_auc"), c("test").alias("test_pr_auc"), c("validation").alias("cv_validation_primary_score"))
    f = X.overfitting_flags(w, "classification")
    return f.withColumns({g: r(c(g), 5) for g in ("train_vs_validation_gap", "validation_vs_test_gap")})


BINS = """rk AS (SELECT *, row_number() OVER (ORDER BY y_score, event_id) AS rn, count(*) OVER () AS n FROM pred)"""


@query(
    "calibration",
    "M24 W7",
    f"""WITH {PRED}, {BINS} SELECT model_name, set_name, greatest(0, CAST(ceil((rn - 1) * 10.0 / (n - 1)) AS BIGINT) - 1) AS score_bin, count(*) AS n, round(avg(y_score), 6) AS mean_predicted_probability, round(avg(CAST(y_true AS INTEGER)), 6) AS observed_rate FROM rk GROUP BY ALL""".replace("count(*) AS n, round(avg(y_score)", "count(*) AS n_rows, round(avg(y_score)"),
)
def calibration(spark, sf):
    t = X.calibration(predictions(spark, sf), KEYS, "event_id", "y_true", "y_score")
    return t.select(*KEYS, "score_bin", c("n").alias("n_rows"), r(c("mean_predicted_probability")).alias("mean_predicted_probability"), r(c("observed_rate")).alias("observed_rate"))


BIAS_LONG = """band AS (SELECT *, greatest(0, CAST(ceil((row_number() OVER (ORDER BY price, event_id) - 1) * 4.0 / (count(*) OVER () - 1)) AS BIGINT) - 1) AS b FROM pred),
lg AS (SELECT *, 'borough' AS bias_dimension, borough AS group_value FROM band UNION ALL SELECT *, 'event_intensity_band', CAST(b AS VARCHAR) FROM band UNION ALL SELECT *, 'model_name', model_name FROM band)"""


def _bands(spark, sf):
    b = B.rank_bins(predictions(spark, sf), "price", ["event_id"], 4, "b")
    return b, {"borough": c("borough"), "event_intensity_band": c("b"), "model_name": c("model_name")}


@query(
    "bias_by_group",
    "M22",
    f"""WITH {PRED}, {BIAS_LONG} SELECT set_name, bias_dimension, group_value, count(*) AS n, round(avg(CAST(y_true <> y_pred AS INTEGER)), 6) AS error_rate, round(count(*) FILTER (WHERE y_true AND NOT y_pred) / greatest(count(*) FILTER (WHERE y_true), 1), 6) AS false_negative_rate,
    round(count(*) FILTER (WHERE NOT y_true AND y_pred) / greatest(count(*) FILTER (WHERE NOT y_true), 1), 6) AS false_positive_rate, round(avg(y_score), 6) AS mean_score FROM lg GROUP BY ALL""",
)
def bias_by_group(spark, sf):
    b, dims = _bands(spark, sf)
    t = X.classification_bias(b, "set_name", dims, "y_true", "y_pred", "y_score")
    return t.withColumns({x: r(c(x)) for x in ("error_rate", "false_negative_rate", "false_positive_rate", "mean_score")})


@query(
    "residual_bias_by_group",
    "M22 M39",
    f"""WITH {PRED}, {BIAS_LONG} SELECT set_name, bias_dimension, group_value, count(*) AS n, round(avg(y_num - p_num), 4) AS mean_residual, round(avg(abs(y_num - p_num)), 4) AS mae, round(avg(CAST(y_num - p_num > 0 AS INTEGER)), 6) AS underprediction_rate, round(median(y_num - p_num), 6) AS median_residual FROM lg GROUP BY ALL""",
)
def residual_bias_by_group(spark, sf):
    b, dims = _bands(spark, sf)
    t = X.regression_bias(b, "set_name", dims, "y_num", "p_num")
    return t.withColumns({"mean_residual": r(c("mean_residual"), 4), "mae": r(c("mae"), 4), "underprediction_rate": r(c("underprediction_rate")), "median_residual": r(c("median_residual"))})


@query(
    "fairness_terciles",
    "M23 W8 A28",
    f"""WITH {PRED}, e AS (SELECT quantile_cont(price, [1/3, 2/3]) AS q FROM pred), t AS (SELECT *, CASE WHEN price <= q[1] THEN 'low' WHEN price <= q[2] THEN 'mid' ELSE 'high' END AS tercile FROM pred, e)
    SELECT model_name, round(avg(CAST(NOT y_pred AS INTEGER)) FILTER (WHERE y_true AND tercile = 'low'), 6) AS fnr_low, round(avg(CAST(NOT y_pred AS INTEGER)) FILTER (WHERE y_true AND tercile = 'mid'), 6) AS fnr_mid, round(avg(CAST(NOT y_pred AS INTEGER)) FILTER (WHERE y_true AND tercile = 'high'), 6) AS fnr_high FROM t GROUP BY 1""",
)
def fairness_terciles(spark, sf):
    t = B.value_bins(predictions(spark, sf), "price", ["low", "mid", "high"], "tercile").where("y_true")
    p = t.groupBy("model_name").pivot("tercile", ["low", "mid", "high"]).agg(F.avg((~c("y_pred")).cast("double")))
    return p.select("model_name", *[r(c(x)).alias(f"fnr_{x}") for x in ("low", "mid", "high")])


@query(
    "residual_summary_by_borough",
    "M39 M38",
    f"WITH {PRED} SELECT borough, count(*) AS n, round(avg(abs(y_num - p_num)), 4) AS mae, round(avg(y_num), 4) AS mean_observed, round(avg(p_num), 4) AS mean_predicted FROM pred WHERE set_name = 'test' GROUP BY 1",
)
def residual_summary_by_borough(spark, sf):
    p = predictions(spark, sf).where("set_name = 'test'")
    return p.groupBy("borough").agg(F.count("*").alias("n"), r(F.avg(F.abs(c("y_num") - c("p_num"))), 4).alias("mae"), r(F.avg("y_num"), 4).alias("mean_observed"), r(F.avg("p_num"), 4).alias("mean_predicted"))


@query(
    "metric_table_long_to_wide",
    "M40 A28",
    f"""WITH {PRED}, m AS (SELECT model_name, set_name, avg(abs(y_num - p_num)) AS mae, avg(CAST(y_true <> y_pred AS INTEGER)) AS error FROM pred GROUP BY ALL)
    SELECT model_name, round(max(mae) FILTER (WHERE set_name = 'test'), 6) AS test_mae, round(max(error) FILTER (WHERE set_name = 'test'), 6) AS test_error, round(max(mae) FILTER (WHERE set_name = 'train'), 6) AS train_mae, round(max(error) FILTER (WHERE set_name = 'train'), 6) AS train_error FROM m GROUP BY 1""",
)
def metric_table_long_to_wide(spark, sf):
    m = predictions(spark, sf).groupBy(*KEYS).agg(F.avg(F.abs(c("y_num") - c("p_num"))).alias("mae"), F.avg((c("y_true") != c("y_pred")).cast("double")).alias("error"))
    long = m.unpivot(KEYS, ["mae", "error"], "metric", "value").withColumn("cell", F.concat_ws("_", "set_name", "metric"))
    cells = ["test_mae", "test_error", "train_mae", "train_error"]
    w = long.groupBy("model_name").pivot("cell", cells).agg(F.max("value"))
    return w.select("model_name", *[r(c(x)).alias(x) for x in cells])


# A modelling frame with the canonical names the catalog and the leakage rules know.
FRAME = """fr AS (SELECT CAST(o_orderkey AS VARCHAR) AS event_id, o_orderstatus = 'F' AS occurrence, CAST(length(o_orderpriority) AS BIGINT) AS intensity, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS resolution, o_orderdate AS start, c_acctbal AS elevation, c_mktsegment AS road_class,
  n_name AS borough, 'x' AS gov_city, CAST(NULL AS DOUBLE) AS pump_nearest_ft, c_nationkey AS custom_code, o_totalprice > 0 AS present_price, o_totalprice AS dem_mean FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
FTYPES = {"event_id": "string", "occurrence": "boolean", "intensity": "bigint", "resolution": "double", "start": "timestamp_ntz", "elevation": "double", "road_class": "string", "borough": "string", "gov_city": "string", "pump_nearest_ft": "double", "custom_code": "int", "present_price": "boolean", "dem_mean": "double"}


def modelling_frame(spark, sf):
    o, cu, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    j = o.join(cu, c("o_custkey") == c("c_custkey")).join(n, c("c_nationkey") == c("n_nationkey"))
    return j.select(
        c("o_orderkey").cast("string").alias("event_id"), (c("o_orderstatus") == "F").alias("occurrence"), F.length("o_orderpriority").cast("bigint").alias("intensity"), F.when(c("o_orderstatus") == "F", c("o_totalprice")).alias("resolution"),
        c("o_orderdate").alias("start"), c("c_acctbal").alias("elevation"), c("c_mktsegment").alias("road_class"), c("n_name").alias("borough"), F.lit("x").alias("gov_city"), F.lit(None).cast("double").alias("pump_nearest_ft"),
        c("c_nationkey").alias("custom_code"), (c("o_totalprice") > 0).alias("present_price"), c("o_totalprice").alias("dem_mean"),
    )


FACTS = "facts AS (" + " UNION ALL ".join(f"SELECT '{x}' AS feature, '{t}' AS dtype, round(count({x}) / count(*), 6) AS non_null_rate, count(DISTINCT {x}) AS n_unique FROM fr" for x, t in FTYPES.items()) + ")"
EXPECTED = "ex AS (SELECT * FROM (VALUES " + ", ".join(f"('{g}', '{f}')" for g, fs in C.FEATURE_GROUPS.items() for f in fs) + ") AS v(feature_group, feature))"
HIDDEN = "(" + ", ".join(f"'{x}'" for x in C.IDENTIFIERS) + ")"
CATALOG = f"""{FRAME}, {FACTS}, {EXPECTED}, cat AS (SELECT coalesce(feature_group, 'extra') AS feature_group, feature, dtype IS NOT NULL AS available, dtype, non_null_rate, coalesce(n_unique, 0) AS n_unique FROM facts FULL JOIN ex USING (feature)
  WHERE NOT (feature_group IS NULL AND (feature LIKE 'present_%' OR feature IN {HIDDEN})))"""


@query("feature_catalog", "M7", f"WITH {CATALOG} SELECT * FROM cat")
def feature_catalog(spark, sf):
    return C.feature_catalog(modelling_frame(spark, sf)).withColumn("non_null_rate", r(c("non_null_rate")))


@query("unavailable_features", "M7", f"WITH {CATALOG} SELECT * FROM cat WHERE NOT available")
def unavailable_features(spark, sf):
    return C.unavailable_features(C.feature_catalog(modelling_frame(spark, sf))).withColumn("non_null_rate", r(c("non_null_rate")))


@query("feature_group_summary", "M7", f"WITH {CATALOG} SELECT feature_group, count(*) AS expected_features, count(*) FILTER (WHERE available) AS available_features, round(avg(non_null_rate), 5) AS mean_non_null_rate, count(*) FILTER (WHERE NOT available) AS missing_features FROM cat GROUP BY 1")
def feature_group_summary(spark, sf):
    s = C.feature_group_summary(C.feature_catalog(modelling_frame(spark, sf)))
    return s.withColumn("mean_non_null_rate", r(c("mean_non_null_rate"), 5))


def _rules_sql(task):
    return f"r_{task} AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in C.leakage_rules(task).items()) + ") AS v(feature, reason))"


def _audit_sql(task):
    return f"SELECT '{task}' AS task, feature, feature LIKE 'present_%' OR reason IS NOT NULL AS excluded_from_predictors, CASE WHEN feature LIKE 'present_%' THEN '{C.PRESENCE_REASON}' ELSE reason END AS reason, dtype, non_null_rate, n_unique FROM facts LEFT JOIN r_{task} USING (feature)"


@query("leakage_audit", "M8", f"WITH {FRAME}, {FACTS}, {', '.join(_rules_sql(t) for t in C.TASK_REASONS)} " + " UNION ALL ".join(_audit_sql(t) for t in C.TASK_REASONS))
def leakage_audit(spark, sf):
    f = modelling_frame(spark, sf)
    facts = pin(C.column_facts(f))  # one row per column, shared by the tasks
    parts = [C.leakage_audit(f, t, facts).withColumn("task", F.lit(t)) for t in C.TASK_REASONS]
    return reduce(lambda a, b: a.unionByName(b), parts).withColumn("non_null_rate", r(c("non_null_rate")))


@query(
    "predictor_columns",
    "M9",
    f"""WITH {FRAME}, {FACTS}, {_rules_sql('occurrence')}, a AS ({_audit_sql('occurrence')}) SELECT feature, dtype, CASE WHEN dtype IN ('string', 'boolean') THEN 'categorical' ELSE 'numeric' END AS kind FROM a
    WHERE NOT excluded_from_predictors AND non_null_rate > 0 AND dtype NOT LIKE 'timestamp%' AND NOT (dtype = 'string' AND n_unique <= 1)""",
)
def predictor_columns(spark, sf):
    return C.predictor_columns(C.leakage_audit(modelling_frame(spark, sf), "occurrence"))


@query(
    "temporal_split",
    "M12",
    """SELECT CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'validation' ELSE 'test' END AS split, count(*) AS n, count(DISTINCT o_orderstatus) AS classes, TRUE AS usable FROM orders GROUP BY 1""",
)
def temporal_split(spark, sf):
    o = table(spark, sf, "orders")
    cuts = [("1998-01-01", "train"), ("2000-01-01", "validation"), (None, "test")]
    d = o.withColumn("split", S.temporal_split(c("o_orderdate"), cuts))
    ok = S.split_is_usable(d, "split", "o_orderstatus", ["train", "validation", "test"])
    return d.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("o_orderstatus").alias("classes"), F.lit(ok).alias("usable"))


@query("stratified_split", "M13 M11")
def stratified_split(spark, sf):
    p = table(spark, sf, "part")
    ladder = [(F.concat_ws("|", "p_type", "p_brand", c("p_size").cast("string")), 20), (F.concat_ws("|", "p_type", "p_brand"), 12), (c("p_type"), 4)]
    label = S.stratum_ladder(p, ladder)
    return S.stratified_split(p.withColumn("stratum", label), "p_partkey", "stratum", {"train": 0.75, "validation": 0.15, "test": 0.10}).select("p_partkey", "stratum", "split")


@query(
    "target_strata",
    "M11 W7",
    """WITH t AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn, count(*) OVER () AS n FROM orders WHERE o_orderstatus <> 'P')
    SELECT o_orderkey, 'resolution_' || greatest(0, CAST(ceil((rn - 1) * 5.0 / (n - 1)) AS BIGINT) - 1) AS stratum FROM t UNION ALL SELECT o_orderkey, 'MISSING' FROM orders WHERE o_orderstatus = 'P'""",
)
def target_strata(spark, sf):
    o = table(spark, sf, "orders").withColumn("v", F.when(c("o_orderstatus") != "P", c("o_totalprice")))
    b = B.rank_bins(o, "v", ["o_orderkey"], 5)
    return b.select("o_orderkey", B.stratum_label(c("v"), c("bin"), "resolution").alias("stratum"))


@query(
    "cluster_anomaly_diagnostics",
    "J18 M37",
    f"""WITH {PRED}, cl AS (SELECT p_partkey, p_size > 25 AS anomalous, p_type AS cluster_label FROM part)
    SELECT cluster_label, anomalous, set_name, count(*) AS n, round(avg(CAST(y_true <> y_pred AS INTEGER)), 6) AS error_rate, round(avg(y_score), 6) AS mean_score FROM pred LEFT JOIN cl ON CAST(floor(event_id / 10) AS BIGINT) - CAST(floor(event_id / 100000000) AS BIGINT) * 10000000 = p_partkey GROUP BY ALL""",
)
def cluster_anomaly_diagnostics(spark, sf):
    cl = table(spark, sf, "part").select("p_partkey", (c("p_size") > 25).alias("anomalous"), c("p_type").alias("cluster_label"))
    part = F.floor(c("event_id") / 10) - F.floor(c("event_id") / 100000000) * 10000000
    j = predictions(spark, sf).withColumn("p_partkey", part.cast("bigint")).join(cl, "p_partkey", "left")
    return j.groupBy("cluster_label", "anomalous", "set_name").agg(F.count("*").alias("n"), r(F.avg((c("y_true") != c("y_pred")).cast("double"))).alias("error_rate"), r(F.avg("y_score")).alias("mean_score"))
