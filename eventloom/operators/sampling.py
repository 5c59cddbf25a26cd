"""Seeded samples, stratified and temporal splits, analysis views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.ordered import chunk_by_range, chunked_prefix


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement, the same ones on every run: smallest seeded hashes of the key."""
    return df.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed))).orderBy("__h", key).limit(n).drop("__h")


def stratified_split(df: DataFrame, key: str, stratum: str, shares: dict[str, float], seed: int = 42, out: str = "split") -> DataFrame:
    """Cut every stratum by position in seeded hash order, so shares hold within each one.

    Positions come from a range-partitioned scan: one stratum may hold most of the rows.
    """
    hashed = df.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed)))
    placed = chunk_by_range(hashed, [stratum, "__h", key])
    numbered = chunked_prefix(
        placed, [stratum], ["__h", key], {"__pos": ("cum_sum", F.lit(1))}
    )
    sizes = df.groupBy(stratum).agg(F.count("*").alias("__n"))
    frac = (F.col("__pos") - F.lit(0.5)) / F.col("__n")
    label: Column = F.lit(None)
    bound, branches = 0.0, []
    for name, share in shares.items():
        bound += share
        branches.append((bound, name))
    for edge, name in reversed(branches):
        label = F.lit(name) if name == branches[-1][1] else F.when(frac < edge, F.lit(name)).otherwise(label)
    return numbered.join(sizes, stratum).withColumn(out, label).drop("__h", "__pos", "__n", "__chunk")


def temporal_split(ts: Column, cuts: Sequence[tuple[str | None, str]]) -> Column:
    """Label by date cuts in ascending order; the last has no cut. A null time has no split."""
    out = F.when(ts.isNull(), F.lit(None).cast("string"))
    for cut, name in cuts:
        out = out.otherwise(F.lit(name)) if cut is None else out.when(ts < F.lit(cut).cast("timestamp_ntz"), F.lit(name))
    return out


def split_is_usable(df: DataFrame, split: str, target: str, names: Sequence[str], min_rows: int = 30, classes: bool = True) -> bool:
    """Every split has enough rows and, for classes, both of them (numeric targets: enough values)."""
    g = df.groupBy(split).agg(F.count("*").alias("n"), F.min(F.col(target).cast("string")).alias("lo"), F.max(F.col(target).cast("string")).alias("hi"), F.count(target).alias("v"))
    ok = (F.col("n") >= min_rows) & ((F.col("lo") < F.col("hi")) if classes else (F.col("v") >= min_rows))
    good = {row[split] for row in g.where(ok).select(split).collect()}  # one row per split name
    return set(names) <= good


def valid_strata(df: DataFrame, label: Column, min_count: int) -> bool:
    """More than one stratum and none too small."""
    row = df.groupBy(label.alias("s")).agg(F.count("*").alias("n")).agg(F.count("*").alias("k"), F.min("n").alias("lo")).first()
    return bool(row["k"] > 1 and row["lo"] >= min_count)


def stratum_ladder(df: DataFrame, ladder: Sequence[tuple[Column, int]]) -> Column | None:
    """First label of the ladder whose strata are all large enough."""
    for label, min_count in ladder:
        if valid_strata(df, label, min_count):
            return label
    return None


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per key; Spark limits each map task to ``n`` rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")
