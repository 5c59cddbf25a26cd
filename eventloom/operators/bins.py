"""Rank and value bins, percentile ranks, clipping and scaling over whole columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators.joins import salted_join
from eventloom.operators.ordered import global_row_number, value_ranks
from eventloom.operators.quantiles import exact_quantiles


def rank_bin(rank: Column, n: Column, q: Column) -> Column:
    """0-based bin of a first-method rank when ``n`` ranks are cut into ``q`` equal-frequency bins."""
    return F.greatest(F.lit(0), F.ceil((rank - 1) * q / (n - 1)) - 1).cast("bigint")


def rank_bins(df: DataFrame, value: str, tie: Sequence[str], q: int, out: str = "bin") -> DataFrame:
    """Equal-frequency bins by order of value, ties broken by ``tie`` (which must make rows unique).

    Only values are ranked; rows are ordered where equal values lie on both sides of an edge.  Null values get a null bin; fewer than two distinct values give no bin at all.
    """
    v = F.col(value)
    ranks = value_ranks(df.select(value).where(v.isNotNull()), value)  # distinct values with the rows below and equal
    n, d = ranks.agg(F.max("n_all"), F.count("*")).first()
    if not n or d < 2:
        return df.withColumn(out, F.lit(None).cast("bigint"))
    bin_of = lambda rank: rank_bin(rank, F.lit(n), F.lit(min(q, d)))
    spans = ranks.select(v, "n_below", "n_eq", bin_of(F.col("n_below") + 1).alias("lo"), bin_of(F.col("n_below") + F.col("n_eq")).alias("hi"))
    # at most q of each: the first value of every bin, and values whose equal rows lie in several bins
    edges = spans.where("lo > 0").groupBy("lo").agg(F.min(value).alias("e")).collect()
    cut = sorted((tuple(r) for r in spans.where("lo < hi").select(value, "n_below", "n_eq").collect()), key=lambda r: r[1])
    steps = sorted((r["lo"], r["e"]) for r in edges)
    levels = [0, *[lo for lo, _ in steps]]
    by_value = F.lit(0).cast("bigint")
    for before, (lo, e) in zip(levels, steps):
        by_value = by_value + F.when(v >= F.lit(e), lo - before).otherwise(0)
    whole = df.where(v.isNull() | ~v.isin([c[0] for c in cut])) if cut else df
    binned = whole.withColumn(out, F.when(v.isNotNull(), by_value))
    if not cut:
        return binned
    # rows of a cut value need their place among equals
    placed = global_row_number(df.where(v.isin([c[0] for c in cut])), [value, *tie], "__rn")
    shift, at = F.lit(0), 0
    for x, below, equal in cut:
        shift = F.when(v == F.lit(x), F.lit(below - at)).otherwise(shift)
        at += equal
    return binned.unionByName(placed.withColumn(out, bin_of(F.col("__rn") + shift)).drop("__rn"))


def band_label(bin_: Column, prefix: str) -> Column:
    """``<prefix>_<bin>``; null without a bin."""
    return F.concat(F.lit(f"{prefix}_"), bin_.cast("string"))


def stratum_label(value: Column, bin_: Column, prefix: str) -> Column:
    """Label for strata: ``MISSING`` for a null value, ``<prefix>_constant`` when there was nothing to cut."""
    return F.when(value.isNull(), F.lit("MISSING")).otherwise(F.coalesce(band_label(bin_, prefix), F.lit(f"{prefix}_constant")))


def value_bins(df: DataFrame, value: str, labels: Sequence[str], out: str = "bin") -> DataFrame:
    """Equal-frequency bins by quantile edges; duplicate edges merge and the first labels are used."""
    n = len(labels)
    probs = {f"e{i}": i / n for i in range(n + 1)}
    edges = exact_quantiles(df, [], value, probs)
    span = [F.col("e0") - F.lit(1e-9), *[F.col(f"e{i}") for i in range(1, n)], F.col(f"e{n}") + F.lit(1e-9)]
    cuts = edges.select(F.array_sort(F.array_distinct(F.array(*span))).alias("cuts")).scalar()
    v = F.col(value)
    with_cuts = df.withColumn("__cuts", cuts)
    # right-closed intervals: the bin is the number of inner edges strictly below the value
    below = F.aggregate(
        F.slice("__cuts", 2, F.greatest(F.size("__cuts") - 2, F.lit(0))), F.lit(0), lambda a, e: a + F.when(v > e, 1).otherwise(0)
    )
    label = F.element_at(F.array(*[F.lit(x) for x in labels]), below + 1)
    return with_cuts.withColumn(out, F.when(v.isNotNull(), label)).drop("__cuts")


def cut(v: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins with fixed edges; outside is null."""
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(edges[:-1], edges[1:], labels))):
        out = F.when((v > lo) & (v <= hi), F.lit(label)).otherwise(out)
    return out


def average_ranks(df: DataFrame, value: str, rank: str = "avg_rank", pct: str | None = None) -> DataFrame:
    """Rank with ties sharing their mean; optionally the rank as a share of the non-null rows."""
    ranks = value_ranks(df, value)
    mean = F.col("n_below") + (F.col("n_eq") + 1) / F.lit(2.0)
    cols = [mean.alias(rank)] + ([(mean / F.col("n_all")).alias(pct)] if pct else [])
    return salted_join(df, ranks.select(value, *cols), [value], "left")


def clip_to_quantiles(df: DataFrame, value: str, lo: float, hi: float, out: str) -> DataFrame:
    """Winsorize to two quantiles of the column."""
    e = exact_quantiles(df, [], value, {"lo": lo, "hi": hi}).select(F.struct("lo", "hi")).scalar()
    x = df.withColumn("__e", e)
    clipped = F.greatest(F.least(F.col(value), F.col("__e.hi")), F.col("__e.lo"))
    return x.withColumn(out, F.when(F.col(value).isNotNull(), clipped)).drop("__e")


def min_max(df: DataFrame, value: str, out: str) -> DataFrame:
    e = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    x = df.withColumn("__e", e)
    return x.withColumn(out, F.try_divide(F.col(value) - F.col("__e.lo"), F.col("__e.hi") - F.col("__e.lo"))).drop("__e")


def at_least_quantile(df: DataFrame, value: str, p: float, out: str) -> DataFrame:
    """Flag values at or above a quantile of the column; null values are not flagged."""
    t = exact_quantiles(df, [], value, {"t": p}).scalar()
    return df.withColumn(out, F.coalesce(F.col(value) >= t, F.lit(False)))
