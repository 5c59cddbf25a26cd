"""Irregular sensor series: collapse, sampling interval, gap fill, wet-spell events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.temporal import plus_seconds
from eventloom.operators.joins import point_interval_join
from eventloom.operators.ordered import CHUNK, chunked_prefix, global_row_number, micros, time_chunk
from eventloom.session import pin

YEAR = 365 * 86_400
HOUR_US = 3_600_000_000
# ---- fixed values ----
DRY_GAP_HOURS = 6
MIN_EVENT_DEPTH_MM = 1.1
DEFAULT_INTERVAL_MINUTES = 60
# ---- end of fixed values ----


def collapse_samples(df: DataFrame, station: str, ts: str, value: str, kind: str, source: str, order: Column) -> DataFrame:
    """One row per (station, time): largest value, sorted distinct kinds, first source in ``order``."""
    return df.where(F.col(ts).isNotNull()).groupBy(station, ts).agg(
        F.max(value).alias(value),
        F.array_join(F.array_sort(F.collect_set(F.nullif(F.col(kind), F.lit("")))), "|").alias(kind),
        F.min_by(source, F.when(F.col(source).isNotNull(), order)).alias(source),
    )


def step_deltas(df: DataFrame, station: str, ts: str, chunk_seconds: int = YEAR) -> DataFrame:
    """Distinct times per station with the microseconds since the previous one."""
    times = df.where(F.col(ts).isNotNull()).select(station, ts).distinct().withColumn(CHUNK, time_chunk(F.col(ts), chunk_seconds))
    prev = chunked_prefix(times, [station], [ts], {"__prev": ("prev_last", F.col(ts))})
    return prev.select(station, ts, (micros(F.col(ts)) - micros(F.col("__prev"))).alias("delta_us"))


def sampling_interval(df: DataFrame, station: str, ts: str) -> DataFrame:
    """Most frequent positive step in rounded minutes (smallest on ties), default 60, at least 1."""
    d = step_deltas(df, station, ts)
    minutes = F.when(F.col("delta_us") > 0, F.bround(F.col("delta_us") / F.lit(60_000_000.0)).cast("bigint"))
    counts = d.groupBy(station, minutes.alias("m")).agg(F.count("*").alias("n"))
    mode = F.min_by("m", F.when(F.col("m").isNotNull(), F.struct(-F.col("n"), F.col("m"))))
    return counts.groupBy(station).agg(
        F.greatest(F.coalesce(mode, F.lit(DEFAULT_INTERVAL_MINUTES)), F.lit(1)).cast("bigint").alias("interval_minutes")
    )


def resolution_class(df: DataFrame, station: str, ts: str, chunk_seconds: int = YEAR) -> DataFrame:
    """Subhourly, hourly, daily or unknown by the smallest positive step."""
    low = F.min(F.when(F.col("delta_us") > 0, F.col("delta_us")))
    return step_deltas(df, station, ts, chunk_seconds).groupBy(station).agg(
        F.when(low.isNull(), "unknown").when(low < HOUR_US, "subhourly").when(low < 24 * HOUR_US, "hourly").otherwise("daily").alias("resolution")
    )


def gap_fill(df: DataFrame, station: str, ts: str, value: str, chunk_seconds: int = YEAR) -> DataFrame:
    """Fill nulls between two observations: 0 next to a dry reading, else linear in time; edges stay null."""
    rows = df.withColumn(CHUNK, time_chunk(F.col(ts), chunk_seconds))
    seen = F.when(F.col(value).isNotNull(), F.struct(micros(F.col(ts)).alias("t"), F.col(value).alias("v")))
    near = chunked_prefix(rows, [station], [ts], {"__a": ("prev_last", seen), "__b": ("next_first", seen)})
    a, b, here = F.col("__a"), F.col("__b"), micros(F.col(ts))
    gap = F.col(value).isNull() & a.isNotNull() & b.isNotNull()
    dry = (a["v"] <= 0) | (b["v"] <= 0)
    linear = a["v"] + (b["v"] - a["v"]) * (here - a["t"]) / (b["t"] - a["t"])
    return (
        near.withColumn("depth_observed", F.col(value))
        .withColumn("fill_method", F.when(gap & dry, "zero_guard").when(gap, "linear_positive"))
        .withColumn(value, F.when(gap & dry, F.lit(0.0)).when(gap, linear).otherwise(F.col(value)))
        .withColumn("was_interpolated", F.col("fill_method").isNotNull())
        .drop("__a", "__b", CHUNK)
    )


def _wet_groups(wet: DataFrame, station: str, ts: str, is_new: Column, chunk_seconds: int) -> DataFrame:
    # each scan reads its input twice, so the inputs are pinned instead of recomputed
    rows = pin(wet.withColumn(CHUNK, time_chunk(F.col(ts), chunk_seconds)))
    prev = chunked_prefix(rows, [station], [ts], {"__prev": ("prev_last", F.col(ts))})
    flagged = pin(prev.withColumn("__new", F.coalesce(is_new, F.lit(True)).cast("bigint")))
    return chunked_prefix(flagged, [station], [ts], {"grp": ("cum_sum", F.col("__new"))})


def rain_events(
    records: DataFrame, intervals: DataFrame, station: str, ts: str, value: str,
    dry_gap_hours: float = DRY_GAP_HOURS, min_depth: float = MIN_EVENT_DEPTH_MM, chunk_seconds: int = YEAR,
) -> DataFrame:
    """Wet spells: a dry pause of at least the gap, measured from the end of the previous sample, splits.

    ``records`` hold one row per (station, time); ``intervals`` one row per station.
    """
    wet = records.where(F.col(value) > 0).join(intervals, station, "left")
    step = F.coalesce("interval_minutes", F.lit(DEFAULT_INTERVAL_MINUTES))
    wet = wet.select(station, ts, value, step.alias("__step"))
    pause = micros(F.col(ts)) - micros(F.col("__prev")) - F.col("__step") * 60_000_000
    grouped = _wet_groups(wet, station, ts, pause >= int(dry_gap_hours * HOUR_US), chunk_seconds)
    ev = grouped.groupBy(station, "grp").agg(
        F.min(ts).alias("start"), F.max(ts).alias("__last"), F.sum(value).alias("depth"), F.max("__step").alias("__step")
    )
    ev = ev.withColumn("end", plus_seconds(F.col("__last"), F.col("__step") * 60))
    hours = (micros(F.col("end")) - micros(F.col("start"))) / F.lit(float(HOUR_US))
    return (
        ev.withColumn("duration", F.greatest(hours, F.col("__step") / F.lit(60.0)))
        .withColumn("intensity", F.col("depth") / F.col("duration"))
        .where(F.col("depth") >= min_depth)
        .select(station, "start", "end", "duration", "intensity", "depth")
    )


def number_rain_events(events: DataFrame, station: str) -> DataFrame:
    """Ids ``P_EVENT_000001`` in station and start order."""
    return global_row_number(events, [station, "start"], "__rn").withColumn("event_id", F.format_string("P_EVENT_%06d", "__rn")).drop("__rn")


def rain_event_windows(
    records: DataFrame, steps: DataFrame, station: str, ts: str, value: str,
    gap_hours: float = DRY_GAP_HOURS, min_total: float = MIN_EVENT_DEPTH_MM, chunk_seconds: int = YEAR, bucket_seconds: int = 30 * 86_400,
) -> DataFrame:
    """The variant that splits on a pause strictly above ``max(gap, 1.5 steps)`` and sums every record in the window."""
    rows = records.where(F.col(value) >= 0)
    wet = rows.where(F.col(value) > 0).select(station, ts, value).join(steps.select(station, (F.col("interval_minutes") * 60).alias("__sec")), station)
    limit = F.greatest(F.lit(gap_hours * 3600.0), F.col("__sec") * F.lit(1.5)) * 1_000_000
    pause = micros(F.col(ts)) - micros(F.col("__prev"))
    ev = _wet_groups(wet, station, ts, pause > limit, chunk_seconds).groupBy(station, F.col("grp").alias("event_id")).agg(
        F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("wet_records"), F.max("__sec").alias("__sec")
    )
    inside = point_interval_join(rows.select(station, ts, value), ev.select(station, "event_id", "start", "end"), [station], ts, "start", "end", bucket_seconds)
    totals = inside.groupBy(station, "event_id").agg(F.sum(value).alias("precip_mm"), F.count("*").alias("n_records"))
    hours = F.greatest((micros(F.col("end")) - micros(F.col("start"))) / F.lit(1e6) + F.col("__sec"), F.col("__sec")) / F.lit(3600.0)
    return (
        ev.join(totals, [station, "event_id"])
        .where(F.col("precip_mm") >= min_total)
        .withColumn("duration_hours", hours)
        .withColumn("mean_intensity", F.col("precip_mm") / F.col("duration_hours"))
        .withColumn("event_uid", F.concat(F.replace(F.col(station).cast("string"), F.lit(":"), F.lit("_")), F.lit("_"), F.format_string("%04d", "event_id")))
        .drop("__sec")
    )


def tag_event_records(records: DataFrame, events: DataFrame, station: str, ts: str, bucket_seconds: int = 30 * 86_400) -> DataFrame:
    """Records that fall inside an event window, tagged with the event's uid."""
    return point_interval_join(records, events.select(station, "event_uid", "start", "end"), [station], ts, "start", "end", bucket_seconds)
