"""Exact model metrics, curves, calibration and bias audits as aggregates and ordered scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators.bins import rank_bins
from eventloom.operators.ordered import CHUNK, chunk_by_range, chunked_prefix, value_ranks
from eventloom.operators.quantiles import exact_quantiles


def score_steps(df: DataFrame, keys: Sequence[str], truth: str, score: str) -> DataFrame:
    """Per distinct score, descending: positives and negatives at the score and at or above it."""
    steps = (
        df.where(F.col(score).isNotNull() & F.col(truth).isNotNull())
        .groupBy(*keys, score)
        .agg(F.count_if(F.col(truth)).alias("pos"), F.count_if(~F.col(truth)).alias("neg"))
        .withColumn("__desc", -F.col(score))
    )
    chunked = chunk_by_range(steps, [*keys, "__desc"])
    run = chunked_prefix(chunked, keys, ["__desc"], {"tp": ("cum_sum", F.col("pos")), "fp": ("cum_sum", F.col("neg"))})
    return run.drop("__desc", CHUNK)


def ranking_metrics(df: DataFrame, keys: Sequence[str], truth: str, score: str) -> DataFrame:
    """ROC-AUC by rank sum with ties and average precision by steps; null with a single class."""
    s = score_steps(df, keys, truth, score)
    a = s.groupBy(*keys).agg(
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / F.lit(2.0))).alias("wins"),
        F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("prec"),
    )
    two = (F.col("p") > 0) & (F.col("n") > 0)
    return a.select(
        *keys,
        F.when(two, F.col("wins") / F.col("p") / F.col("n")).alias("roc_auc"),
        F.when(two, F.col("prec") / F.col("p")).alias("pr_auc"),
    )


def classification_metrics(df: DataFrame, keys: Sequence[str], truth: str, pred: str, score: str) -> DataFrame:
    t, p = F.col(truth), F.col(pred)
    a = df.groupBy(*keys).agg(
        F.count_if(t & p).cast("double").alias("tp"),
        F.count_if(~t & p).cast("double").alias("fp"),
        F.count_if(t & ~p).cast("double").alias("fn"),
        F.count_if(~t & ~p).cast("double").alias("tn"),
        F.avg((F.col(score) - t.cast("double")) ** 2).alias("brier_score"),
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    zero, one = F.lit(0.0), F.lit(1.0)
    recall, spec = F.coalesce(F.try_divide(tp, tp + fn), zero), F.coalesce(F.try_divide(tn, tn + fp), zero)
    sides = F.when(tp + fn > 0, one).otherwise(zero) + F.when(tn + fp > 0, one).otherwise(zero)
    a = a.withColumns(
        {
            "accuracy": (tp + tn) / (tp + tn + fp + fn),
            "balanced_accuracy": (recall + spec) / sides,
            "precision": F.coalesce(F.try_divide(tp, tp + fp), zero),
            "recall": recall,
            "f1": F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), zero),
            "false_positive_rate": fp / F.greatest(fp + tn, one),
            "false_negative_rate": fn / F.greatest(fn + tp, one),
        }
    )
    rank = ranking_metrics(df, keys, truth, score)
    if keys:
        out = _per_key(a, rank, keys)  # a group without scores keeps its counts
    else:
        out = a.withColumn("__r", rank.select(F.struct("roc_auc", "pr_auc")).scalar()).select(*a.columns, "__r.*")
    return out.withColumn("brier_score", F.when(F.col("roc_auc").isNotNull(), F.col("brier_score")))


def _corr(x: Column, y: Column) -> Column:
    """Pearson's correlation of the pairs without nulls; null where a side is constant (``corr`` divides by zero there)."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(a) * F.stddev_pop(b))


def regression_metrics(df: DataFrame, keys: Sequence[str], truth: str, pred: str, ordered: bool = True) -> DataFrame:
    """RMSE, MAE, R2, Pearson, MAPE (only without a zero truth), exact median absolute error and Spearman's rank correlation.

    ``ordered=False`` leaves out the last two, which order the rows; the others are one aggregate."""
    y, p = F.col(truth).cast("double"), F.col(pred).cast("double")
    d = df.withColumn("__ae", F.abs(y - p))
    a = d.groupBy(*keys).agg(
        F.sqrt(F.avg((y - p) ** 2)).alias("rmse"),
        F.avg("__ae").alias("mae"),
        (F.lit(1.0) - F.try_divide(F.sum((y - p) ** 2), F.var_pop(y) * F.count(y))).alias("r2"),
        _corr(y, p).alias("pearson_correlation"),
        F.when(F.count_if(y == 0) == 0, F.avg(F.col("__ae") / F.nullif(F.abs(y), F.lit(0.0)))).alias("mape"),
    )
    if not ordered:
        return a
    med = exact_quantiles(d, keys, "__ae", {"median_absolute_error": 0.5})
    both = df.where(y.isNotNull() & p.isNotNull()).select(*keys, y.alias("__y"), p.alias("__p"))
    for v in ("__y", "__p"):  # mean rank of equal values, per key
        ranks = value_ranks(both.select(*keys, v), v, keys).select(*keys, v, (F.col("n_below") + (F.col("n_eq") + 1) / 2).alias(f"{v}r"))
        both = both.join(ranks, [*keys, v])
    rank = both.groupBy(*keys).agg(_corr(F.col("__yr"), F.col("__pr")).alias("spearman_correlation"))
    if keys:
        return _per_key(_per_key(a, med, keys), rank, keys)
    return a.withColumn("median_absolute_error", med.scalar()).withColumn("spearman_correlation", rank.scalar())


def _per_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys that may be null."""
    r = right.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    return left.join(r, [left[k].eqNullSafe(r[f"__k_{k}"]) for k in keys], "left").drop(*[f"__k_{k}" for k in keys])


def roc_points(df: DataFrame, keys: Sequence[str], truth: str, score: str) -> DataFrame:
    """False and true positive rate at every distinct threshold."""
    s = score_steps(df, keys, truth, score)
    t = s.groupBy(*keys).agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    s = s.join(t, list(keys)) if keys else s.withColumn("__t", t.select(F.struct("__p", "__n")).scalar()).select(*s.columns, "__t.*")
    return s.select(*keys, F.col(score).alias("threshold"), (F.col("fp") / F.col("__n")).alias("fpr"), (F.col("tp") / F.col("__p")).alias("tpr"))


def calibration(df: DataFrame, keys: Sequence[str], key: str, truth: str, score: str, bins: int = 10) -> DataFrame:
    """Predicted and observed rate per rank bin of the score over all predictions."""
    b = rank_bins(df.where(F.col(score).isNotNull()), score, [key], bins, "score_bin")
    return b.groupBy(*keys, "score_bin").agg(
        F.count("*").alias("n"), F.avg(score).alias("mean_predicted_probability"), F.avg(F.col(truth).cast("double")).alias("observed_rate")
    )


def _by_dimension(df: DataFrame, set_name: str, dims: dict[str, Column], aggs: Sequence[Column]) -> DataFrame:
    """One row per (set, dimension, value): the dimensions are laid out as rows once, then aggregated together."""
    pairs = F.array(*[F.struct(F.lit(n).alias("bias_dimension"), e.cast("string").alias("group_value")) for n, e in dims.items()])
    long = df.withColumn("__d", F.explode(pairs)).select(*df.columns, "__d.*")
    return long.groupBy(set_name, "bias_dimension", "group_value").agg(F.count("*").alias("n"), *aggs)


def classification_bias(df: DataFrame, set_name: str, dims: dict[str, Column], truth: str, pred: str, score: str) -> DataFrame:
    t, p = F.col(truth), F.col(pred)
    one = F.lit(1)
    return _by_dimension(
        df, set_name, dims,
        [
            F.avg((t != p).cast("double")).alias("error_rate"),
            (F.count_if(t & ~p) / F.greatest(F.count_if(t), one)).alias("false_negative_rate"),
            (F.count_if(~t & p) / F.greatest(F.count_if(~t), one)).alias("false_positive_rate"),
            F.avg(score).alias("mean_score"),
        ],
    )


def regression_bias(df: DataFrame, set_name: str, dims: dict[str, Column], truth: str, pred: str) -> DataFrame:
    d = df.withColumn("__res", F.col(truth) - F.col(pred))
    base = _by_dimension(
        d, set_name, dims,
        [F.avg("__res").alias("mean_residual"), F.avg(F.abs("__res")).alias("mae"), F.avg((F.col("__res") > 0).cast("double")).alias("underprediction_rate")],
    )
    pairs = F.array(*[F.struct(F.lit(n).alias("bias_dimension"), e.cast("string").alias("group_value")) for n, e in dims.items()])
    long = d.withColumn("__d", F.explode(pairs)).select(set_name, "__res", "__d.*")
    by = [set_name, "bias_dimension", "group_value"]
    med = exact_quantiles(long, by, "__res", {"median_residual": 0.5}).withColumnsRenamed({k: f"__{k}" for k in by})
    cond = base[by[0]].eqNullSafe(med[f"__{by[0]}"])
    for k in by[1:]:
        cond = cond & base[k].eqNullSafe(med[f"__{k}"])
    return base.join(med, cond, "left").drop(*[f"__{k}" for k in by])


# ---- fixed values: gaps above which a model counts as over-fitted ----
GAP_LIMITS = {"classification": 0.10, "regression": 0.15}
PRIMARY = {"classification": ("pr_auc", 1.0), "regression": ("mae", -1.0)}
# ---- end of fixed values ----


def overfitting_flags(results: DataFrame, task: str, validation: str = "cv_validation_primary_score") -> DataFrame:
    """Train-validation and validation-test gaps of the primary metric, with flags."""
    metric, sign = PRIMARY[task]
    train, test, val = F.col(f"train_{metric}") * sign, F.col(f"test_{metric}") * sign, F.col(validation)
    a, b = train - val, val - test
    limit = GAP_LIMITS[task]
    return results.withColumns(
        {
            "train_vs_validation_gap": a,
            "validation_vs_test_gap": b,
            "possible_overfitting": F.coalesce(a > limit, F.lit(False)),
            "possible_test_degradation": F.coalesce(b > limit, F.lit(False)),
        }
    )


def prefix_metrics(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}_{c}" for c in df.columns if c not in keys})
