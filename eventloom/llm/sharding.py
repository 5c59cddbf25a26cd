"""Shards of near-equal bytes by sampled splitters.

Rows are ordered by ``(hash of the text, hash of the id)``, so equal texts are neighbours and the order is random otherwise.
A sample drawn in proportion to size gives the quantiles of that order; they cut it into ranges, a key that owns several
quantiles is cut by its second hash, and a range that still holds more than twice its share is cut into equal steps.  Exact
byte and row totals per range, and running totals within a range, place every row at its exact byte position.

A shard is one ``shards``-th of the bytes.  Groups of equal texts above a quarter of a range (at most four for each range, so
their hashes and sizes may go to the driver) are placed first, largest first, whole, in the fullest shard that has room.  All
other rows flow in order into the room that is left, a group of equal texts whole at the place of its middle.  Only a
group that no shard has room for flows in row by row and is split.

Only (id, size, checksum, hashes) travel, never texts.  The driver holds the splitters and range totals: at most
``max_ranges`` ranges, 16 sampled keys and four large groups for each.

Defined cases: a null text is empty (size 1, checksum 0).  Null ids come first among equals.  Rows repeated whole are separate
rows.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import arrow_map
from eventloom.session import pin

SHARDS = 16
PER_RANGE = 16
LARGE = 4  # a group of equal texts is large above this part of a range


def splitters(sample: list[tuple[int, int, float]], ranges: int, divisible: set[int] | dict[int, int] | None = None) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Range bounds from weighted ``(k1, k2, weight)``: first hashes that start a range, and for a first hash that owns more than
    one quantile, the second hashes that cut it.  Only ``divisible`` first hashes (by default all) are cut."""
    s = sorted(sample)
    if not s:
        return np.zeros(0, np.int64), {}
    cum = np.cumsum([w for *_, w in s])
    at = np.searchsorted(cum, cum[-1] * np.arange(1, ranges) / ranges)
    picks = [s[i][:2] for i in np.minimum(at, len(s) - 1)]
    first: dict[int, list[int]] = {}
    for a, b in picks:
        first.setdefault(a, []).append(b)
    hot = {a: np.unique(np.array(b, dtype=np.int64)) for a, b in first.items() if len(b) > 1 and (divisible is None or a in divisible)}
    starts = set(first) | {a + 1 for a in hot if a < 2**63 - 1}  # a hot key has its ranges to itself
    return np.array(sorted(starts), dtype=np.int64), hot


def placements(groups: dict[int, int], total: int, shards: int) -> tuple[dict[int, int], list[float]]:
    """``(shard of each group that fits, room left in each shard)``: largest first, into the shard with the least room that will do."""
    room = [total / shards] * shards
    placed = {}
    for key, size in sorted(groups.items(), key=lambda g: (-g[1], g[0])):
        fits = [(left, i) for i, left in enumerate(room) if left >= size]
        if fits:
            _, i = min(fits)
            placed[key] = i
            room[i] -= size
    return placed, room


def _ranger(starts: np.ndarray, hot: dict[int, np.ndarray]):
    """Number of the range of each row; a hot key takes one number for each of its cuts."""
    extra = np.zeros(len(starts) + 1, dtype=np.int64)
    for a, cuts in hot.items():
        extra[np.searchsorted(starts, a, side="right")] = len(cuts)
    base = np.arange(len(starts) + 1) + np.cumsum(extra) - extra

    def run(batches):
        import pyarrow as pa

        for b in batches:
            k1, k2 = (np.asarray(b.column(c).to_numpy(zero_copy_only=False), dtype=np.int64) for c in ("k1", "k2"))
            slot = np.searchsorted(starts, k1, side="right")
            out = base[slot]
            for a in np.intersect1d(k1, np.array(list(hot), dtype=np.int64)) if hot else ():
                m = k1 == a
                out[m] += np.searchsorted(hot[int(a)], k2[m], side="right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[*b.schema.names, "range"])

    return run


def shard(docs: DataFrame, shards: int = SHARDS, min_ranges: int = 1024, max_ranges: int = 65_536, rows_per_range: int = 1_000_000) -> DataFrame:
    """Per row of ``docs``: ``doc_id, size, text_crc32, shard, slot`` with slots from 0 without gaps in each shard."""
    b = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.length(b) + 1).cast("bigint").alias("size"), F.crc32(b).alias("text_crc32"), F.xxhash64(b).alias("k1"), F.xxhash64("doc_id").alias("k2"))
    rows = pin(rows)
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    if not n:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    ranges = int(min(max_ranges, max(min_ranges, n // rows_per_range)))
    large = {r.k1: r["size"] for r in rows.groupBy("k1").agg(F.sum("size").alias("size")).where(F.col("size") > total / (LARGE * ranges)).collect()}  # fewer than LARGE * ranges
    fitted, room = placements(large, total, shards)
    kinds = rows.sparkSession.createDataFrame([(k, fitted.get(k)) for k in large], "k1 bigint, at int")
    # `at`: the shard of a large group that fits; `flow`: the bytes a row takes of the room left
    rows = rows.join(F.broadcast(kinds.withColumn("large", F.lit(True))), "k1", "left").withColumn("flow", F.when(F.col("at").isNull(), F.col("size")).otherwise(0))
    chance = F.least(F.lit(1.0), F.col("size") * (PER_RANGE * ranges / total))
    draw = F.pmod(F.xxhash64("k2", "k1", F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < chance).select("k1", "k2", (F.col("size") / chance).alias("w")).collect()
    starts, hot = splitters([tuple(r) for r in sample], ranges, large)
    types = dict(rows.dtypes)
    placed = arrow_map(rows, _ranger(starts, hot), ", ".join(f"`{c}` {t}" for c, t in types.items()) + ", range bigint")

    # overfull ranges are cut into equal steps of their span of the hash that varies in them
    share = total / ranges
    spans = placed.groupBy("range").agg(F.sum("size").alias("bytes"), *[f(c).cast("double").alias(x) for c, f, x in (("k1", F.min, "lo"), ("k1", F.max, "hi"), ("k2", F.min, "lo2"), ("k2", F.max, "hi2"))])
    over = spans.where(F.col("bytes") > 2 * share).select(F.col("range").alias("r"), F.ceil(F.col("bytes") / share).alias("steps"), "lo", "hi", "lo2", "hi2")  # fewer rows than half the ranges
    one = F.col("lo") == F.col("hi")
    part = F.when(one, F.try_divide(F.col("k2") - F.col("lo2"), F.col("hi2") - F.col("lo2"))).otherwise(F.try_divide(F.col("k1") - F.col("lo"), F.col("hi") - F.col("lo")))
    step = F.coalesce(F.least(F.floor(part * F.col("steps")), F.col("steps") - 1), F.lit(0)).cast("bigint")
    placed = placed.join(F.broadcast(over), F.col("range") == F.col("r"), "left").select(*types, "range", step.alias("step"))
    placed = pin(placed)

    flows = F.col("at").isNull()
    # at most 3 * max_ranges rows
    counts = sorted(tuple(r) for r in placed.groupBy("range", "step").agg(F.sum("flow"), F.count_if(flows), F.count("*")).collect())
    bases, at_bytes, at_flow, at_row = [], 0, 0, 0
    for r, s, size, k, k_all in counts:
        bases.append((r, s, at_bytes, at_flow, at_row))
        at_bytes, at_flow, at_row = at_bytes + size, at_flow + k, at_row + k_all
    base = rows.sparkSession.createDataFrame(bases, "range bigint, step bigint, base_bytes bigint, base_flow bigint, base_row bigint")
    order = Window.partitionBy("range", "step").orderBy("k1", "k2", F.col("doc_id").asc_nulls_first(), "size")
    group = Window.partitionBy("range", "step", "k1")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    run = placed.withColumns({"before": F.sum("flow").over(upto) - F.col("flow"), "nth_flow": F.count_if(flows).over(upto) - 1, "nth_row": F.row_number().over(order) - 1})
    run = run.withColumns({"first": F.min("before").over(group), "own": F.sum("flow").over(group)}).join(F.broadcast(base), ["range", "step"])
    middle = F.col("base_bytes") + F.when(F.col("large"), F.col("before") + F.col("flow") / 2).otherwise(F.col("first") + F.col("own") / 2)
    bounds = F.array(*[F.lit(float(x)) for x in np.cumsum(room)[:-1]]).cast("array<double>")
    last = max((i for i, left in enumerate(room) if left > 0), default=0)
    number = F.coalesce("at", F.least(F.size(F.filter(bounds, lambda b: b <= middle)), F.lit(last)))
    # rows of a shard: those that flowed into it, then its large groups one by one
    unit = F.when(~flows, F.col("k1"))
    nth = F.when(flows, F.col("base_flow") + F.col("nth_flow")).otherwise(F.col("base_row") + F.col("nth_row"))
    done = pin(run.select("doc_id", "size", "text_crc32", number.cast("int").alias("shard"), unit.alias("unit"), nth.alias("nth")))
    units = done.groupBy("shard", "unit").agg(F.min("nth").alias("first"), F.count("*").alias("n"))  # a row per shard and large group
    earlier = Window.partitionBy("shard").orderBy(F.col("unit").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    units = units.select(F.col("shard").alias("s"), F.col("unit").alias("u"), (F.sum("n").over(earlier) - F.col("n") - F.col("first")).alias("shift"))
    out = done.join(F.broadcast(units), (F.col("shard") == F.col("s")) & F.col("unit").eqNullSafe(F.col("u")))
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("nth") + F.col("shift")).cast("bigint").alias("slot"))
