"""Joins Spark has no physical operator for, rewritten into equi joins, plus checked relational joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators.ordered import micros

SALT = "__salt"
ROWS_PER_TASK = 2_000_000
MAX_HOT_KEYS = 10_000


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Equi join whose hot left keys are spread over several tasks (``how``: inner, left, left_semi, left_anti).

    A key is hot when it has more rows than ``rows_per_task`` and more than a ten-thousandth of the left
    side, so there are fewer than ``MAX_HOT_KEYS`` hot keys whatever the data: that table is safe to broadcast.
    Without a hot key this is a plain join, whose milder skew is left to AQE.  Left rows of a hot key draw a salt by row hash; right rows of it are repeated once per salt.
    """
    keys = list(keys)
    counts = left.groupBy(*keys).agg(F.count("*").alias("__n"))
    total, most = counts.agg(F.sum("__n"), F.max("__n")).first()
    if not most or most <= rows_per_task:
        return left.join(right, keys, how)
    limit = max(float(rows_per_task), total / MAX_HOT_KEYS)
    hot = counts.where(F.col("__n") > limit).select(
        *keys, F.least(F.ceil(F.col("__n") / rows_per_task), F.lit(100_000)).cast("int").alias("__salts")
    )
    hot = F.broadcast(hot)
    row_hash = F.xxhash64(*[c for c in left.columns])
    l = left.join(hot, keys, "left").withColumn(
        SALT, F.when(F.col("__salts").isNull(), F.lit(0)).otherwise(F.pmod(row_hash, F.col("__salts"))).cast("int")
    )
    r = (
        right.join(hot, keys, "left")
        .withColumn(SALT, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1)))
        .drop("__salts")
    )
    return l.drop("__salts").join(r, [*keys, SALT], how).drop(SALT)


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "right side") -> None:
    """Raise when a key occurs twice."""
    dup = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    if not dup.isEmpty():
        raise ValueError(f"{what} has duplicate keys on {list(keys)}")


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", validate: str = "many_to_one") -> DataFrame:
    """Equi join with a cardinality contract: ``one_to_one`` or ``many_to_one``."""
    if validate not in ("one_to_one", "many_to_one"):
        raise ValueError(f"unknown contract {validate!r}")
    if validate == "one_to_one":
        assert_unique(left, on, "left side")
    assert_unique(right, on)
    return left.join(right, list(on), how)


def strict_lookup(left: DataFrame, dim: DataFrame, on: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Dimension lookup that raises when a member or one of its required attributes is missing."""
    out = checked_join(left, dim, on)
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required])
    if not out.where(missing).isEmpty():
        raise ValueError(f"dimension members without {list(required)}")
    return out


def outer_reduce(frames: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Full outer join of N tables on one key."""
    return reduce(lambda a, b: a.join(b, list(on), "full"), frames)


def _buckets(start: Column, end: Column, seconds: int) -> Column:
    width = F.lit(seconds * 1_000_000)
    return F.sequence(F.floor(micros(start) / width).cast("bigint"), F.floor(micros(end) / width).cast("bigint"))


def point_interval_join(
    points: DataFrame,
    intervals: DataFrame,
    on: Sequence[str],
    ts: str,
    start: str,
    end: str,
    seconds: int,
    how: str = "inner",
) -> DataFrame:
    """Pairs with ``start <= ts <= end`` (closed both sides) per key, as an equi join on time buckets.

    The bucket splits a hot key along time; what is still hot is salted.  Intervals with ``end < start``
    match nothing.
    """
    b = "__bucket"
    p = points.withColumn(b, F.floor(micros(F.col(ts)) / F.lit(seconds * 1_000_000)).cast("bigint"))
    i = intervals.where(F.col(end) >= F.col(start)).withColumn(b, F.explode(_buckets(F.col(start), F.col(end), seconds)))
    joined = salted_join(p, i, [*on, b], "inner")
    out = joined.where(F.col(ts).between(F.col(start), F.col(end))).drop(b)
    if how == "inner":
        return out
    raise ValueError(f"unsupported join type {how!r}")


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    seconds: int,
) -> DataFrame:
    """Pairs of closed intervals that overlap, per key.

    Both sides are laid out over time buckets; a pair that shares several buckets is kept only in the first
    shared one, so no distinct is needed.  A row lies in a bucket once, so when no key has more rows than a task takes, no bucket has,
    and the laid out rows need not be counted.
    """
    b = "__bucket"
    (ls, le), (rs, re_) = left_span, right_span
    width = F.lit(seconds * 1_000_000)
    l = left.where(F.col(le) >= F.col(ls)).withColumn(b, F.explode(_buckets(F.col(ls), F.col(le), seconds)))
    r = right.where(F.col(re_) >= F.col(rs)).withColumn(b, F.explode(_buckets(F.col(rs), F.col(re_), seconds)))
    first = F.floor(F.greatest(micros(F.col(ls)), micros(F.col(rs))) / width).cast("bigint")
    overlap = (F.col(rs) <= F.col(le)) & (F.col(re_) >= F.col(ls))
    most = left.groupBy(*on).agg(F.count("*").alias("__n")).agg(F.max("__n")).first()[0] or 0
    joined = l.join(r, [*on, b]) if most <= ROWS_PER_TASK else salted_join(l, r, [*on, b], "inner")
    return joined.where(overlap & (F.col(b) == first)).drop(b)
