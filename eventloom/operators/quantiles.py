"""Exact interpolated quantiles without gathering a group: sketch a bracket, then rank only inside it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.session import pin


#: Groups whose bounds are broadcast: one row each, two numbers per quantile.
FEW_GROUPS = 10_000
#: Slots in which the rows of many groups are counted, and the most rows of one whose groups are ranked whole.
SLOTS, SMALL_GROUP = 1 << 18, 200_000


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    accuracy: int = 100_000,
    many: bool = False,
) -> DataFrame:
    """Linear-interpolated quantiles of ``value`` per key, one output column per entry of ``probs``.

    Pass 1 sketches two bounds around every target rank (mergeable, combined map-side).  Pass 2 counts the
    rows below the bounds and ranks only the distinct values between them: about ``4 / accuracy`` of the
    group.  The neighbours just outside the bracket are kept too, since interpolation may need one of them.
    With ``many`` groups the small ones take one shuffle instead (``small_group_quantiles``), and only keys that share a crowded slot
    go through the bounds.  The bounds are pinned: a sketch depends on the order its parts arrive in, so two evaluations may differ.
    """
    if not keys:
        whole = exact_quantiles(df.withColumn("__one", F.lit(0)), ["__one"], value, probs, accuracy)
        return whole.drop("__one")
    keys = list(keys)
    if many:
        slot, crowded, used = _crowded_slots(df, keys)
        if not crowded and used > FEW_GROUPS:
            return small_group_quantiles(df, keys, value, probs)
        if crowded and used > FEW_GROUPS:
            hot = F.broadcast(df.sparkSession.createDataFrame([(x,) for x in crowded], "__slot int"))
            few, rest = (df.withColumn("__slot", slot).join(hot, "__slot", how).drop("__slot") for how in ("left_semi", "left_anti"))
            return exact_quantiles(few, keys, value, probs, accuracy).unionByName(small_group_quantiles(rest, keys, value, probs))
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    names, ps = list(probs), list(probs.values())
    delta = 2.0 / accuracy
    ends = [max(0.0, p - delta) for p in ps] + [min(1.0, p + delta) for p in ps]
    k = len(ps)
    sketch = rows.groupBy(*keys).agg(
        F.count("*").alias("__n"),
        F.percentile_approx("__v", ends, accuracy).alias("__q"),
    )
    sketch = pin(sketch)
    # bounds of few groups go to the rows: a join by few keys would sort all rows of a group in one task
    few = sketch.count() <= FEW_GROUPS
    joined = _null_safe_join(rows, F.broadcast(sketch) if few else sketch, keys)
    lo = [F.col("__q")[i] for i in range(k)]
    hi = [F.col("__q")[k + i] for i in range(k)]
    v = F.col("__v")
    outside = joined.groupBy(*keys).agg(
        F.max("__n").alias("__n"),
        *[F.count_if(v < lo[i]).alias(f"__b{i}") for i in range(k)],
        *[F.max(F.when(v < lo[i], v)).alias(f"__p{i}") for i in range(k)],
        *[F.min(F.when(v > hi[i], v)).alias(f"__x{i}") for i in range(k)],
    )
    hits = F.filter(
        F.array(*[F.when(v.between(lo[i], hi[i]), F.lit(i)) for i in range(k)]), lambda x: x.isNotNull()
    )
    near = reduce(lambda a, b: a | b, [v.between(lo[i], hi[i]) for i in range(k)])
    inside = (
        joined.where(near).select(*keys, "__v", F.explode(hits).alias("__i"))
        .groupBy(*keys, "__i", "__v")
        .agg(F.count("*").alias("__c"))
    )
    run = Window.partitionBy(*keys, "__i").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("__cum", F.sum("__c").over(run))
    ranked = _null_safe_join(inside, outside, keys)
    below = F.element_at(F.array(*[F.col(f"__b{i}") for i in range(k)]), F.col("__i") + 1)
    prob = F.element_at(F.array(*[F.lit(p) for p in ps]), F.col("__i") + 1)
    pos = prob * (F.col("__n") - 1)
    first, last = below + F.col("__cum") - F.col("__c"), below + F.col("__cum")
    at_lo = (first <= F.floor(pos)) & (F.floor(pos) < last)
    at_hi = (first <= F.ceil(pos)) & (F.ceil(pos) < last)
    pair = ranked.groupBy(*keys).agg(
        *[F.max(F.when((F.col("__i") == i) & at_lo, F.col("__v"))).alias(f"__l{i}") for i in range(k)],
        *[F.max(F.when((F.col("__i") == i) & at_hi, F.col("__v"))).alias(f"__h{i}") for i in range(k)],
    )
    full = _null_safe_join(outside, pair, keys)
    cols = []
    for i, (name, p) in enumerate(zip(names, ps)):
        at = F.lit(p) * (F.col("__n") - 1)
        left = F.coalesce(F.col(f"__l{i}"), F.when(F.floor(at) < F.col(f"__b{i}"), F.col(f"__p{i}")), F.col(f"__x{i}"))
        right = F.coalesce(F.col(f"__h{i}"), F.when(F.ceil(at) < F.col(f"__b{i}"), F.col(f"__p{i}")), F.col(f"__x{i}"))
        cols.append(_between(left, right, at).alias(name))
    return full.select(*keys, *cols)


def _crowded_slots(df: DataFrame, keys: Sequence[str]) -> tuple[Column, list[int], int]:
    """Rows counted by a hash of their key: the hash, the slots whose groups may be too large for a task, and the number of slots in use."""
    slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int")
    slots = pin(df.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")))
    return slot, [r["slot"] for r in slots.where(F.col("n") > SMALL_GROUP).collect()], slots.count()


def groups_are_small(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether no group of the keys has more than ``SMALL_GROUP`` rows."""
    return not _crowded_slots(df, keys)[1]


def small_group_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """As ``exact_quantiles``, for groups that each fit a task: the rows of a key come together once, are ranked and leave one row.

    Rows that are already dealt by some of the keys stay where they are."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    group, i, n = Window.partitionBy(*keys), F.col("__i"), F.col("__n")
    ranked = rows.withColumns({"__i": F.row_number().over(group.orderBy("__v")) - 1, "__n": F.count("*").over(group)})
    at = {name: F.lit(p) * (n - 1) for name, p in probs.items()}
    near = reduce(lambda a, b: a | b, [(i == F.floor(e)) | (i == F.ceil(e)) for e in at.values()])
    ends = [F.max(F.when(i == f(e), F.col("__v"))).alias(f"__{tag}{k}") for k, e in enumerate(at.values()) for f, tag in ((F.floor, "l"), (F.ceil, "h"))]
    found = ranked.where(near).groupBy(*keys).agg(F.max("__n").alias("__n"), *ends)
    return found.select(*keys, *[_between(F.col(f"__l{k}"), F.col(f"__h{k}"), e).alias(name) for k, (name, e) in enumerate(at.items())])


def _between(left: Column, right: Column, at: Column) -> Column:
    """Linear interpolation at the rank ``at`` between the values of the ranks around it."""
    share = at - F.floor(at)
    return F.when(left == right, left).otherwise(left * (F.lit(1.0) - share) + right * share)


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys where null equals null."""
    renamed = right.withColumnsRenamed({c: f"__r_{c}" for c in keys})
    cond = reduce(lambda a, b: a & b, [left[c].eqNullSafe(renamed[f"__r_{c}"]) for c in keys])
    return left.join(renamed, cond).drop(*[f"__r_{c}" for c in keys])
