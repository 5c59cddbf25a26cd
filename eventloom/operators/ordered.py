"""Ordered computations that never put one key (or the whole table) on one task.

Spark's own window functions run each partition key on a single task.  A key that owns a third of the
rows, or a window without a key, would therefore run on one core.  The operators here cut the ordered
rows of a key into *chunks*, run the window inside ``(key, chunk)``, and carry the state of earlier
chunks through a summary holding one row per ``(key, chunk)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.session import pin

CHUNK = "__chunk"


def time_chunk(ts: Column, seconds: int) -> Column:
    """Deterministic chunk number of a timestamp: whole periods since the epoch."""
    return F.floor(epoch_seconds(ts) / F.lit(seconds)).cast("bigint")


def epoch_seconds(ts: Column) -> Column:
    """Seconds since the epoch as a double, for zoned and zone-less timestamps alike."""
    return micros(ts) / F.lit(1_000_000.0)


def micros(ts: Column) -> Column:
    """Microseconds since the epoch as a bigint (session zone is UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def chunk_by_range(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Give rows a chunk number that follows ``order``; ties must be broken by the last columns.

    Range partitioning samples the full ordering tuple, so a hot leading key is spread over many
    partitions.  The result is pinned because sampled bounds may differ between two evaluations.
    """
    ordering = [F.col(c).asc_nulls_last() for c in order]
    ranged = df.repartitionByRange(*ordering)
    return pin(ranged.withColumn(CHUNK, F.spark_partition_id().cast("bigint")))


def chunked_prefix(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    specs: dict[str, tuple[str, Column]],
    chunk: str = CHUNK,
) -> DataFrame:
    """Append prefix results per key in ``order``; ``chunk`` must be non-decreasing along it.

    ``specs`` maps output name to ``(kind, expression)``:

    * ``prev_max``  maximum over earlier rows
    * ``prev_last`` last non-null value over earlier rows
    * ``next_first`` first non-null value over later rows
    * ``cum_sum``   sum over earlier rows and this one
    * ``key_max``   maximum over all rows of the key

    Every window is keyed by ``(keys, chunk)``.  The only window keyed by ``keys`` alone reads the summary,
    whose size is the number of chunks, not the number of rows.
    """
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    tie = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order_cols)])
    part = [*keys, chunk]
    inner = Window.partitionBy(*part).orderBy(*order_cols)
    before, after = (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)
    carry = Window.partitionBy(*keys).orderBy(chunk)

    local, summary, carried = {}, [], []
    for name, (kind, expr) in specs.items():
        s, c = f"__s_{name}", f"__c_{name}"
        if kind == "prev_max":
            local[name] = F.max(expr).over(inner.rowsBetween(*before))
            summary.append(F.max(expr).alias(s))
            carried.append(F.max(s).over(carry.rowsBetween(*before)).alias(c))
        elif kind == "prev_last":
            local[name] = F.last(expr, ignorenulls=True).over(inner.rowsBetween(*before))
            summary.append(F.max_by(expr, F.when(expr.isNotNull(), tie)).alias(s))
            carried.append(F.last(s, ignorenulls=True).over(carry.rowsBetween(*before)).alias(c))
        elif kind == "next_first":
            local[name] = F.first(expr, ignorenulls=True).over(inner.rowsBetween(*after))
            summary.append(F.min_by(expr, F.when(expr.isNotNull(), tie)).alias(s))
            carried.append(F.first(s, ignorenulls=True).over(carry.rowsBetween(*after)).alias(c))
        elif kind == "cum_sum":
            local[name] = F.sum(expr).over(inner.rowsBetween(Window.unboundedPreceding, 0))
            summary.append(F.sum(expr).alias(s))
            carried.append(F.sum(s).over(carry.rowsBetween(*before)).alias(c))
        elif kind == "key_max":
            summary.append(F.max(expr).alias(s))
            whole = carry.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            carried.append(F.max(s).over(whole).alias(c))
        else:
            raise ValueError(f"unknown prefix kind {kind!r}")

    states = df.groupBy(*part).agg(*summary).select(*part, *carried)
    out = df.withColumns(local).join(states, part, "left")
    for name, (kind, _) in specs.items():
        c = F.col(f"__c_{name}")
        if kind == "key_max":
            merged = c
        elif kind == "prev_max":
            merged = F.greatest(F.col(name), c)
        elif kind == "cum_sum":
            merged = F.col(name) + F.coalesce(c, F.lit(0))
        else:
            merged = F.coalesce(F.col(name), c)
        out = out.withColumn(name, merged).drop(f"__c_{name}")
    return out


def global_row_number(df: DataFrame, order: Sequence[str], out: str = "rn") -> DataFrame:
    """1-based dense numbering of the whole table in ``order`` (null last), without a single-task sort.

    Rows are range partitioned and sorted per partition; the position inside the partition comes from
    ``monotonically_increasing_id`` (partition number in the high bits, position in the low 33) and the
    offset of each partition from the running total of the partition sizes.
    """
    ordering = [F.col(c).asc_nulls_last() for c in order]
    placed = pin(
        df.repartitionByRange(*ordering)
        .sortWithinPartitions(*ordering)
        .withColumn("__mid", F.monotonically_increasing_id())
    )
    pid = F.shiftright("__mid", 33)
    sizes = placed.groupBy(pid.alias("__pid")).agg(F.count("*").alias("__n"))
    # one row per partition: bounded by the partition count
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    low = F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("__pid", pid)
        .join(F.broadcast(offsets), "__pid")
        .withColumn(out, (F.col("__off") + low + 1).cast("bigint"))
        .drop("__pid", "__off", "__mid")
    )


def value_ranks(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per distinct ``value`` (null excluded): rows below, rows equal, rows in all, per key.

    Ties are folded before anything is ordered, so one value that owns a third of the rows is one row here.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n_eq"))
    chunked = chunk_by_range(counts, [*keys, value])
    run = chunked_prefix(chunked, keys, [F.col(value)], {"cum": ("cum_sum", F.col("n_eq"))})
    if keys:
        totals = counts.groupBy(*keys).agg(F.sum("n_eq").alias("n_all"))
        run = run.join(totals, list(keys))
    else:
        run = run.withColumn("n_all", counts.agg(F.sum("n_eq")).scalar())
    return run.select(*keys, value, (F.col("cum") - F.col("n_eq")).alias("n_below"), "n_eq", "n_all")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], last: bool = False) -> DataFrame:
    """One whole row per key: the first (or last) in ``order``, which must be total.

    An aggregate with map-side combine replaces ``row_number() = 1``, so no key is ever sorted on one task.
    """
    row = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    rank = F.struct(*order)
    pick = F.max_by(row, rank) if last else F.min_by(row, rank)
    return df.groupBy(*keys).agg(pick.alias("__row")).select(*keys, "__row.*").select(*df.columns)


def nulls_last(c: Column) -> list[Column]:
    """Two ordering terms that put nulls after every value inside a struct comparison."""
    return [c.isNull(), c]
