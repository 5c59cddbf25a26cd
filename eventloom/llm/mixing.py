"""Mixing sources to target weights by entropy balancing.

Every document gets an expected number of copies ``q``.  Among all rates that give each source its target number of words
and at most ``limit`` copies, the one closest to "one copy each" in relative entropy is ``q = min(limit, exp(t * size / mean))``
with one multiplier ``t`` per source.  The multipliers solve a convex dual; safeguarded Newton steps run as one aggregation
per step over a (source, size) histogram, so a hot source costs no more than any other.  Rates become whole copies by
carrying the rounding error along, largest documents first.

Defined cases: a null or blank text has size 0 and is taken once (0 words).  A null source is a source of its own, after
all others.  Rows that repeat an id are separate documents.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import SPACE, arrow_map, spare
from eventloom.operators.joins import salted_join
from eventloom.operators.ordered import global_row_number
from eventloom.session import pin

WEIGHTS = (1.0, 2.0, 3.0)
LIMIT = 3.0
ROWS_PER_CHUNK = 2_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """``sizes (source, source_size)`` to ``target``: the whole shared by repeating weights in code-point order of the sources.

    A target stops at ``limit`` times its source; the excess is shared again by weight until none is above.  The level of
    words per weight is found by repeating one small aggregation; the driver holds sums only.
    """
    order = sizes.withColumn("__n", F.col("source").isNull().cast("int")).withColumn("__b", F.col("source").cast("binary"))
    ranked = global_row_number(order, ["__n", "__b"], "__rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("__rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = pin(ranked.select("source", "source_size", weight.alias("w"), (F.col("source_size") * limit).cast("double").alias("most")))
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = F.col("most") <= F.col("w") * level
        capped, w = s.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))).first()
        if not w:
            break
        higher = (total - capped) / w
        if higher <= level:
            break
        level = higher
    target = F.when(F.col("most") <= F.col("w") * level, F.col("most")).otherwise(F.col("w") * level)
    return s.select("source", "source_size", target.cast("double").alias("target"))


def multipliers(hist: DataFrame, targets: DataFrame, limit: float = LIMIT, steps: int = 80, tolerance: float = 1e-9) -> DataFrame:
    """``hist (source, size, n)`` to ``(source, source_size, target, mean, t)``: Newton steps on the dual, all sources at once.

    ``t`` is null where the target is ``limit`` times the source or the source has no words: all rates are ``limit`` or 1.
    """
    hist = pin(hist.where("size > 0"))
    mean = hist.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    base = targets.join(mean.withColumnRenamed("source", "__s"), targets["source"].eqNullSafe(F.col("__s")), "left").drop("__s")
    trivial = (F.col("source_size") == 0) | (F.col("target") >= F.col("source_size") * limit * (1 - 1e-12))
    state = pin(base.withColumns({
        "t": F.when(~trivial, F.lit(0.0)), "lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double"), "open": ~trivial,
    }))
    for _ in range(steps):
        if state.where("open").isEmpty():
            break
        live = state.where("open").select(F.col("source").alias("__s"), "t", "mean")
        x = F.col("size") / F.col("mean")
        rate = F.least(F.lit(limit), F.exp(F.least(F.col("t") * x, F.lit(50.0))))
        got = hist.join(live, hist["source"].eqNullSafe(F.col("__s"))).groupBy("__s").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("g"),
            F.sum(F.when(rate < limit, F.col("n") * F.col("size") * x * rate).otherwise(0.0)).alias("slope"),
        )
        j = state.join(got, state["source"].eqNullSafe(got["__s"]), "left").drop("__s")
        gap = F.col("g") - F.col("target")
        lo = F.when(gap <= 0, F.col("t")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("t")).otherwise(F.col("hi"))
        newton = F.when(F.col("slope") > 0, F.col("t") - gap / F.col("slope"))
        j = j.withColumns({"lo": F.when(F.col("open"), lo), "hi": F.when(F.col("open"), hi), "gap": gap, "newton": newton})
        inside = F.col("newton").isNotNull() & (F.col("lo").isNull() | (F.col("newton") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("newton") < F.col("hi")))
        half = F.when(F.col("hi").isNull(), F.col("lo") * 2 + 1).when(F.col("lo").isNull(), F.col("hi") * 2 - 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        near = F.abs("gap") <= F.greatest(F.col("target") * tolerance, F.lit(1e-9))
        t = F.when(~F.col("open") | near, F.col("t")).when(inside, F.col("newton")).otherwise(half)
        state = pin(j.withColumns({"t": t, "open": F.col("open") & ~near}).select(*state.columns))
    if not state.where("open").isEmpty():
        raise RuntimeError(f"a source has not met its target after {steps} steps")
    # sums of doubles depend on their order in the last digits: rounded, a rerun gives the same rates
    return state.select("source", "source_size", "target", "mean", F.round("t", 9).alias("t"))


def _round(batches):
    """Rows sorted by (source, chunk), size descending and id: copies that keep the running total near the expected one."""
    import math

    import pyarrow as pa

    key, due = None, 0.0
    for b in batches:
        copies = []
        for source, chunk, size, rate in zip(*(b.column(c).to_pylist() for c in ("source", "chunk", "size", "rate"))):
            if (source, chunk) != key:
                key, due = (source, chunk), 0.0
            due += rate * size
            low = math.floor(rate + 1e-9)
            k = low + (rate - low > 1e-9 and due - low * size > 0.5 * size)
            due -= k * size
            copies.append(k)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names), pa.array(copies, pa.int64())], names=[*b.schema.names, "copies"])


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: float = LIMIT, rows_per_chunk: int = ROWS_PER_CHUNK, keys: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """Per row of ``docs``: ``*keys, size, source_size, target, rate, copies, taken``; texts are read once and never shuffled.

    Rounding runs in chunks of a source that a hash of the id and the text deals out; rows repeated whole more often than a chunk has
    rows are dealt out by their place in the table as well."""
    rows = pin(docs.select(*keys, words(F.col("text")).alias("size"), F.xxhash64("text").alias("hash")).withColumn("place", F.monotonically_increasing_id()))
    hist = pin(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    sizes = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("__rows"))
    solved = multipliers(hist, source_targets(sizes.drop("__rows"), weights, limit), limit)
    counts = sizes.select(F.col("source").alias("__c"), F.ceil(F.col("__rows") / rows_per_chunk).alias("chunks"))
    solved = pin(solved.join(counts, solved["source"].eqNullSafe(F.col("__c"))).withColumnRenamed("source", "__s").drop("__c"))
    often = pin(rows.groupBy("doc_id", "hash").agg(F.count("*").alias("n")).where(F.col("n") > rows_per_chunk).select(F.col("doc_id").alias("__i"), F.col("hash").alias("__h")))
    if not often.isEmpty():
        same = rows["doc_id"].eqNullSafe(F.col("__i")) & (rows["hash"] == F.col("__h"))
        # fewer rows than one in rows_per_chunk
        rows = rows.join(often, same, "left").withColumn("place", F.when(F.col("__h").isNotNull(), F.floor(F.col("place") / rows_per_chunk)).otherwise(0)).drop("__i", "__h")
    else:
        rows = rows.withColumn("place", F.lit(0).cast("bigint"))
    chunk = F.pmod(F.xxhash64("doc_id", "hash", "place"), F.col("chunks")).cast("bigint")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("t").isNull(), F.lit(limit)).otherwise(F.least(F.lit(limit), F.exp(F.least(F.col("t") * F.col("size") / F.col("mean"), F.lit(50.0)))))
    placed = rows.join(solved, rows["source"].eqNullSafe(F.col("__s"))).select(*keys, "size", "source_size", "target", chunk.alias("chunk"), rate.alias("rate"), "hash")
    placed = placed.repartition("source", "chunk").sortWithinPartitions("source", "chunk", F.desc("size"), "hash", *[k for k in keys if k != "source"])
    out = arrow_map(placed, _round, ", ".join(f"{n} {t}" for n, t in placed.dtypes) + ", copies bigint")
    return out.drop("chunk", "hash").withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it (never, up to ``limit`` times), all columns as they are.

    Rows that share id, source and text share the copies of their key evenly."""
    who, what, n, copies, part, nth, before, again = spare(docs, "who", "what", "rows", "copies", "part", "nth", "before", "again")
    tagged = docs.withColumns({who: F.to_json(F.struct("doc_id", "source")), what: F.xxhash64("text")})
    plan = mix(tagged.select("doc_id", "source", "text", who, what), weights, limit, keys=("doc_id", "source", who, what))
    plan = pin(plan.groupBy(who, what).agg(F.count("*").alias(n), F.sum("copies").alias(copies)).where(F.col(copies) > 0))
    joined = tagged.join(plan, [who, what]) if plan.where(F.col(n) > 1).isEmpty() else salted_join(tagged, plan, [who, what], rows_per_task=100_000)
    out = joined.where(F.col(n) == 1)
    many = pin(joined.where(F.col(n) > 1))
    if not many.isEmpty():
        # numbered by partition, so that a row repeated very often is nowhere one group
        many = many.withColumn(part, F.spark_partition_id())
        local = many.withColumn(nth, F.row_number().over(Window.partitionBy(part, who, what).orderBy(who)) - 1)
        run = Window.partitionBy(who, what).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        offsets = many.groupBy(who, what, part).agg(F.count("*").alias(before)).select(who, what, part, F.coalesce(F.sum(before).over(run), F.lit(0)).alias(before))
        share = F.floor(F.col(copies) / F.col(n)) + (F.col(nth) + F.col(before) < F.pmod(copies, n)).cast("bigint")
        out = out.unionByName(local.join(offsets, [who, what, part]).withColumn(copies, share).where(F.col(copies) > 0).select(*out.columns))
    return out.withColumn(again, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copies)))).select(*docs.columns)
