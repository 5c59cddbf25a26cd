"""Column reports: missingness, summaries, correlations, variance inflation, validation, distributions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators.ordered import chunk_by_range, chunked_prefix
from eventloom.operators.quantiles import exact_quantiles


def _stack(row: DataFrame, names: Sequence[str], fields: dict[str, str]) -> DataFrame:
    """Turn one row holding ``<field>__<i>`` columns into one row per name."""
    parts = [F.struct(F.lit(n).alias("column"), *[F.col(f"{f}__{i}").cast(t).alias(f) for f, t in fields.items()]) for i, n in enumerate(names)]
    return row.select(F.inline(F.array(*parts)))


def missingness(df: DataFrame) -> DataFrame:
    """Nulls per column, their share and the type, from one pass."""
    names = df.columns
    one = df.agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_count__{i}") for i, c in enumerate(names)],
    )
    one = one.withColumns({f"missing_share__{i}": F.col(f"missing_count__{i}") / F.col("n") for i in range(len(names))})
    one = one.withColumns({f"dtype__{i}": F.lit(t) for i, (_, t) in enumerate(df.dtypes)})
    return _stack(one, names, {"missing_count": "bigint", "missing_share": "double", "dtype": "string"})


def long_form(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows ``(keys, column, value)`` of numeric columns as doubles."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(keys), list(columns), "column", "value")


SUMMARY_PROBS = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def numeric_summary(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), probs: dict[str, float] | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quantiles per column (and key)."""
    long = long_form(df, columns, keys)
    by = [*keys, "column"]
    base = long.groupBy(*by).agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    return base.join(exact_quantiles(long, by, "value", probs or SUMMARY_PROBS), by, "left")


def pair_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson on complete cases per pair; null under three rows or with a constant side."""
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
        usable = (F.count(x) >= 3) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
        aggs += [F.count(x).alias(f"n__{i}"), F.when(usable, F.corr(x, y)).alias(f"correlation__{i}")]
    one = df.agg(*aggs)
    one = one.withColumns({f"{k}__{i}": F.lit(v) for i, p in enumerate(pairs) for k, v in (("feature", p[0]), ("target", p[1]))})
    names = [f"{a}~{b}" for a, b in pairs]
    return _stack(one, names, {"feature": "string", "target": "string", "n": "bigint", "correlation": "double"}).drop("column")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation of two columns on complete rows, ties averaged.

    Works on the counts of distinct value pairs, so repeated values cost nothing.
    """
    joint = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")).agg(F.count("*").alias("w"))
    mean_rank = F.col("n_below") + (F.col("n_eq") + 1) / F.lit(2.0)

    def ranks(v: str, out: str) -> DataFrame:
        per = joint.groupBy(v).agg(F.sum("w").alias("w"))
        return weighted_ranks(per, v, "w").select(v, mean_rank.alias(out))

    r = joint.join(ranks("x", "rx"), "x").join(ranks("y", "ry"), "y")
    w, x, y = F.col("w"), F.col("rx"), F.col("ry")
    s = r.agg(
        F.sum(w).alias("n"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"),
        F.sum(w * x * x).alias("sxx"), F.sum(w * y * y).alias("syy"), F.sum(w * x * y).alias("sxy"),
    )
    num = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    den = F.sqrt(F.col("n") * F.col("sxx") - F.col("sx") ** 2) * F.sqrt(F.col("n") * F.col("syy") - F.col("sy") ** 2)
    return s.select(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col("n"), F.try_divide(num, den).alias("spearman"))


def weighted_ranks(counts: DataFrame, value: str, weight: str) -> DataFrame:
    """Rows below and equal per distinct value from pre-counted values."""
    run = chunked_prefix(chunk_by_range(counts, [value]), [], [F.col(value)], {"cum": ("cum_sum", F.col(weight))})
    return run.select(value, (F.col("cum") - F.col(weight)).alias("n_below"), F.col(weight).alias("n_eq"))


def variance_inflation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """VIF per column on complete rows: the diagonal of the inverse correlation matrix.

    One distributed pass yields the p x p correlations; only that small matrix reaches the driver.
    """
    complete = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    p = len(columns)
    cells = [(i, j) for i in range(p) for j in range(i + 1, p)]
    row = complete.agg(F.count("*").alias("n"), *[F.corr(columns[i], columns[j]).alias(f"r{i}_{j}") for i, j in cells]).first()
    m = np.eye(p)
    for i, j in cells:
        m[i, j] = m[j, i] = row[f"r{i}_{j}"]
    vif = np.diag(np.linalg.inv(m))
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, vif)], "feature string, vif double")


def checks(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """Validation table ``(metric, value)`` from one aggregate."""
    one = df.agg(*[e.cast("bigint").alias(f"value__{i}") for i, e in enumerate(metrics.values())])
    return _stack(one, list(metrics), {"value": "bigint"}).withColumnRenamed("column", "metric")


def duplicated_rows(df: DataFrame, keys: Sequence[str]) -> Column:
    """Rows beyond the first of each key, as a scalar."""
    return df.groupBy(*keys).agg((F.count("*") - 1).alias("d")).agg(F.sum("d")).scalar()


def duplicated_copies(df: DataFrame, keys: Sequence[str]) -> Column:
    """All rows of keys that occur more than once, as a scalar."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()


def group_distribution(df: DataFrame, role: str, features: Sequence[str]) -> DataFrame:
    """Counts of every value of several categorical columns per role, null kept."""
    long = df.select(role, *[F.col(c).cast("string").alias(c) for c in features]).unpivot([role], list(features), "feature", "value")
    return long.groupBy(role, "feature", "value").agg(F.count("*").alias("n"))

