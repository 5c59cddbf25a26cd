"""Text fallback matching and self-role enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_lookup(candidates: DataFrame, keys: Sequence[str], member: str) -> DataFrame:
    """Keys that resolve to exactly one member."""
    # min = max replaces a distinct count: one map-side combined pass
    lo, hi = F.min(member), F.max(member)
    return candidates.groupBy(*keys).agg(lo.alias(member), hi.alias("__hi")).where(F.col(member) == F.col("__hi")).drop("__hi")


def name_candidates(segments: DataFrame, segment: str, names: Sequence[Column], boroughs: Sequence[Column]) -> DataFrame:
    """Distinct ``(segment, name, borough)`` over several name columns and both street sides."""
    name = F.explode(F.array_compact(F.array_distinct(F.array(*names))))
    return segments.select(segment, F.array(*boroughs).alias("__b"), name.alias("name")).select(
        segment, "name", F.explode(F.array_compact(F.array_distinct("__b"))).alias("borough")
    ).distinct()


def cascade_match(rows: DataFrame, candidates: DataFrame, name: str, borough: str, segment: str) -> DataFrame:
    """Match by (name, borough) when unique, else by name alone when unique; records the method."""
    exact = unique_lookup(candidates, ["name", "borough"], segment).select(F.col("name").alias(name), F.col("borough").alias(borough), F.col(segment).alias("__exact"))
    loose = unique_lookup(candidates, ["name"], segment).select(F.col("name").alias(name), F.col(segment).alias("__loose"))
    out = rows.join(exact, [name, borough], "left").join(loose, [name], "left")
    method = F.when(F.col("__exact").isNotNull(), "textual_borough_unique").when(F.col("__loose").isNotNull(), "textual_global_unique")
    return out.withColumn(segment, F.coalesce("__exact", "__loose")).withColumn("match_method", method).drop("__exact", "__loose")


def pair_mean(a: Column, b: Column) -> Column:
    """Mean of two values that skips nulls."""
    n = F.when(a.isNotNull(), 1).otherwise(0) + F.when(b.isNotNull(), 1).otherwise(0)
    return F.try_divide(F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)), n.cast("double"))


def pair_any(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))
