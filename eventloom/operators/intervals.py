"""Interval merging, sessions, storm clusters and interval joins with their features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.temporal import plus_seconds
from eventloom.operators.joins import overlap_join, point_interval_join, salted_join
from eventloom.operators.ordered import CHUNK, chunked_prefix, global_row_number, micros
from eventloom.session import pin

FOREVER = (1 << 63) - 1
DAY = 86_400


def _islands(df: DataFrame, keys: list[str], is_new: Column, chunk: str = CHUNK) -> DataFrame:
    """Number the runs that start where ``is_new`` holds, per key in order of ``__s``."""
    # pinned because the second scan reads its input twice
    flagged = pin(df.withColumn("__new", is_new.cast("bigint")))
    return chunked_prefix(flagged, keys, ["__s"], {"__island": ("cum_sum", F.col("__new"))}, chunk)


def interval_merge(
    df: DataFrame,
    key: str,
    start: str,
    end: str,
    status: str,
    gap_hours: float = 24,
    open_end: str = "max_start_plus_gap",
    chunk_seconds: int = 7 * DAY,
) -> DataFrame:
    """Merge complaint intervals of a key into disjoint events.

    A key with any known end merges by overlap (touching intervals merge, an open interval reaches forever).
    A key without known ends starts a new event after a pause longer than ``gap_hours`` and closes it at the
    last start plus the gap (``open_end='max_start_plus_gap'``) or at the last start (``'max_start'``).
    Rows with a null key or start are dropped; ``end >= start`` is expected where the end is known.
    """
    gap = int(gap_hours * 3_600_000_000)
    e = micros(F.col(end))
    # fold equal starts first: what is ordered afterwards is one row per distinct start
    folded = (
        df.where(F.col(key).isNotNull() & F.col(start).isNotNull())
        .groupBy(F.col(key), F.col(start).alias("__start"))
        .agg(
            F.max(F.col(end)).alias("__end"),
            F.count_if(F.col(end).isNull()).alias("__open"),
            F.max(F.coalesce(e, F.lit(FOREVER))).alias("__e"),
            F.count("*").alias("__n"),
            F.count_if(F.col(status) == 0).alias("__n0"),
            F.count_if(F.col(status) == 1).alias("__n1"),
        )
        .withColumn("__s", micros(F.col("__start")))
        .withColumn(CHUNK, F.floor(F.col("__s") / (chunk_seconds * 1_000_000)).cast("bigint"))
    )
    seen = chunked_prefix(
        folded,
        [key],
        ["__s"],
        {
            "__prev_e": ("prev_max", F.col("__e")),
            "__prev_s": ("prev_last", F.col("__s")),
            "__known": ("key_max", F.col("__end").isNotNull().cast("int")),
        },
    )
    by_end = F.col("__s") > F.col("__prev_e")
    by_gap = F.col("__s") - F.col("__prev_s") > gap
    is_new = F.col("__prev_s").isNull() | F.when(F.col("__known") == 1, by_end).otherwise(by_gap)
    merged = (
        _islands(seen, [key], is_new)
        .groupBy(key, "__island")
        .agg(
            F.min("__start").alias("start"),
            F.max("__start").alias("__last"),
            F.max("__end").alias("__max_end"),
            F.sum("__open").alias("__open"),
            F.max("__known").alias("__known"),
            F.sum("__n").alias("n_complaints"),
            F.sum("__n0").alias("n_open"),
            F.sum("__n1").alias("n_closed"),
        )
    )
    inferred = F.col("__last") if open_end == "max_start" else plus_seconds(F.col("__last"), gap_hours * 3600)
    closed = F.when(F.col("__open") == 0, F.col("__max_end"))
    out_end = F.when(F.col("__known") == 1, closed).otherwise(inferred)
    state = F.when(F.col("n_closed") == 0, 0).when(F.col("n_open") == 0, 1).otherwise(2)
    return merged.select(
        key,
        (F.col("__island") - 1).alias("local_event_id"),
        "start",
        out_end.alias("end"),
        ((micros(out_end) - micros(F.col("start"))) / F.lit(3_600_000_000.0)).alias("duration_hours"),
        "n_complaints",
        "n_open",
        "n_closed",
        state.cast("tinyint").alias("status"),
    )


def number_events(events: DataFrame, order: Sequence[str], out: str = "event_id") -> DataFrame:
    """Global event numbers in key and start order."""
    return global_row_number(events, list(order), out)


def merge_spans(df: DataFrame, keys: Sequence[str], start: str, end: str, gap_seconds: int = 0, chunk_seconds: int = DAY) -> DataFrame:
    """Disjoint cover of the closed spans per key (no key: the whole table), with a running span number.

    A new span opens when the start lies more than ``gap_seconds`` after everything seen before.
    """
    keys = list(keys)
    folded = (
        df.where(F.col(start).isNotNull())
        .groupBy(*keys, F.col(start).alias("__start"))
        .agg(F.max(F.coalesce(F.col(end), F.col(start))).alias("__end"), F.count("*").alias("__n"))
        .withColumn("__s", micros(F.col("__start")))
        .withColumn(CHUNK, F.floor(F.col("__s") / (chunk_seconds * 1_000_000)).cast("bigint"))
    )
    seen = chunked_prefix(folded, keys, ["__s"], {"__prev": ("prev_max", micros(F.col("__end")))})
    is_new = F.coalesce(F.col("__s") > F.col("__prev") + gap_seconds * 1_000_000, F.lit(True))
    return _islands(seen, keys, is_new).select(*keys, "__start", "__end", "__n", F.col("__island").alias("span_no"))


def storm_starts(events: DataFrame, start: str, end: str, gap_seconds: int = 6 * 3600, chunk_seconds: int = 6 * 3600) -> DataFrame:
    """One row per distinct start: its storm's id, the storm's number of events, and its hours from first start to latest end.

    Storms are summed over starts, so events are read once, however many a storm has."""
    spans = merge_spans(events, [], start, end, gap_seconds, chunk_seconds)
    hours = (micros(F.max("__end")) - micros(F.min("__start"))) / F.lit(3_600_000_000.0)
    storms = spans.groupBy("span_no").agg(F.sum("__n").alias("n_positive_events"), hours.alias("storm_duration_hours"))
    return spans.join(storms, "span_no").select(F.col("__start").alias(start), _storm_name(), "n_positive_events", "storm_duration_hours")


def _storm_name() -> Column:
    return F.format_string("STORM_%05d", F.col("span_no")).alias("storm_event_id")


def storm_clusters(events: DataFrame, start: str, end: str, gap_seconds: int = 6 * 3600, chunk_seconds: int = 6 * 3600) -> DataFrame:
    """Events with a global storm id: a storm ends when nothing starts within the gap of its latest end.

    The ordering has no key, so the scan is cut into time chunks and carried over a one-row-per-chunk summary.
    """
    spans = merge_spans(events, [], start, end, gap_seconds, chunk_seconds)
    return salted_join(events, spans.select(F.col("__start").alias(start), _storm_name()), [start])


def storm_summary(clustered: DataFrame, start: str, end: str, event: str, segment: str, borough: str) -> DataFrame:
    return (
        clustered.groupBy("storm_event_id")
        .agg(
            F.min(start).alias("storm_start"),
            F.max(end).alias("storm_end"),
            F.count(event).alias("n_positive_events"),
            F.count_distinct(segment).alias("n_positive_segments"),
            F.count_distinct(borough).alias("n_boroughs"),
        )
        .withColumn(
            "storm_duration_hours", (micros(F.col("storm_end")) - micros(F.col("storm_start"))) / F.lit(3_600_000_000.0)
        )
    )


def assign_first_interval(
    points: DataFrame, intervals: DataFrame, key: str, point_id: str, ts: str, start: str, end: str, event_id: str, seconds: int = DAY
) -> DataFrame:
    """First event (by start, then id) whose closed window holds the point; unmatched points keep null."""
    pairs = point_interval_join(
        points.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, point_id, ts),
        intervals.select(key, start, end, event_id),
        [key],
        ts,
        start,
        end,
        seconds,
    )
    first = pairs.groupBy(point_id).agg(F.min_by(event_id, F.struct(start, event_id)).alias(event_id))
    return points.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).join(first, point_id, "left")


def complaint_summary(assigned: DataFrame, event_id: str, method: str, borough: str) -> DataFrame:
    """Per event: complaints, complaints by match method, most frequent borough (smallest on ties)."""
    rows = assigned.where(F.col(event_id).isNotNull())
    m = F.lower(F.coalesce(F.col(method), F.lit("unknown")))
    # counts per (event, borough) first, so the mode needs no gathered list
    per = rows.groupBy(event_id, borough).agg(
        F.count("*").alias("n"), F.count_if(m.contains("spatial")).alias("sp"), F.count_if(m.contains("text")).alias("tx")
    )
    b = F.col(borough)
    return per.groupBy(event_id).agg(
        F.sum("n").alias("complaint_count_check"),
        F.sum("sp").alias("complaint_spatial_match_count"),
        F.sum("tx").alias("complaint_textual_match_count"),
        F.min_by(b, F.when(b.isNotNull(), F.struct(-F.col("n"), b))).alias("complaint_borough_mode"),
    )


def overlap_features(
    events: DataFrame, rain: DataFrame, station: str, window: tuple[str, str], event_id: str, seconds: int = DAY
) -> DataFrame:
    """Rain features of each event window: count, max and mean intensity, depth and duration totals.

    Computed once per distinct (station, window) and joined back.  The mean divides by every overlap,
    including those without an intensity; no overlap gives zeros.
    """
    s, e = window
    spans = events.where(F.col(station).isNotNull()).select(station, s, e).distinct()
    pairs = overlap_join(spans, rain.select(station, "start", "end", "intensity", "depth", "duration"), [station], window, ("start", "end"), seconds)
    feats = pairs.groupBy(station, s, e).agg(
        F.count("*").alias("n"),
        F.max("intensity").alias("imax"),
        F.sum("intensity").alias("isum"),
        F.sum("depth").alias("depth"),
        F.sum("duration").alias("dur"),
    )
    zero = F.lit(0.0)
    return events.join(feats, [station, s, e], "left").select(
        event_id,
        F.when(F.col(station).isNotNull(), 1).otherwise(0).alias("prec_station_link_count"),
        F.coalesce("n", F.lit(0)).alias("n_prec"),
        F.coalesce("imax", zero).alias("prec_intensity_max"),
        F.coalesce(F.col("isum") / F.col("n"), zero).alias("prec_intensity_mean"),
        F.coalesce("depth", zero).alias("prec_depth_total"),
        F.coalesce("dur", zero).alias("prec_duration_total"),
    )


def window_sample_features(
    events: DataFrame, samples: DataFrame, station: str, window: tuple[str, str], event_id: str, ts: str, level: str, seconds: int = DAY
) -> DataFrame:
    """Level statistics of the samples inside each closed window; null where there are none.

    Samples are folded per (station, time) and windows per distinct span before they meet, so the pairs
    grow with distinct times, not with rows.
    """
    s, e = window
    spans = events.where(F.col(station).isNotNull()).select(station, s, e).distinct()
    folded = samples.groupBy(station, ts).agg(
        F.count("*").alias("n"),
        F.count(level).alias("nv"),
        F.sum(level).alias("sum"),
        F.max(level).alias("max"),
        F.min(level).alias("min"),
    )
    pairs = point_interval_join(folded, spans, [station], ts, s, e, seconds)
    feats = pairs.groupBy(station, s, e).agg(
        F.sum("n").alias("n"),
        (F.sum("sum") / F.sum("nv")).alias("avg"),
        F.max("max").alias("max"),
        F.min("min").alias("min"),
    )
    return events.join(feats, [station, s, e], "left").select(
        event_id,
        F.coalesce("n", F.lit(0)).alias("tide_obs_n"),
        F.col("avg").alias("tide_level_m_mean"),
        F.col("max").alias("tide_level_m_max"),
        F.col("min").alias("tide_level_m_min"),
        (F.col("max") - F.col("min")).alias("tide_level_m_range"),
    )


def as_of_period(df: DataFrame, year: str, periods: DataFrame, period: str, end_year: str, tie: str) -> DataFrame:
    """Add the latest period whose end year is not after ``year``, else the earliest one.

    The periods are laid out as one row per calendar year (at most 10,000 rows whatever the input), so the
    as-of join is an equi join with a small table.
    """
    last = periods.groupBy(F.col(end_year).alias("__from")).agg(F.max_by(period, F.struct(tie, period)).alias(period))
    first = periods.groupBy(F.lit(1)).agg(F.min_by(period, F.struct(end_year, tie, period)).alias("p"), F.min(end_year).alias("y"))
    before = first.where("y > 0").select(F.lit(0).alias("__from"), F.col("p").alias(period))
    w = Window.orderBy("__from")  # one row per distinct end year
    spans = before.unionByName(last).withColumn("__to", F.coalesce(F.lead("__from").over(w) - 1, F.lit(9999)))
    years = spans.select(F.explode(F.sequence("__from", "__to")).alias(year), period)
    return df.join(F.broadcast(years), year, "left")


def temporal_conflicts(
    candidates: DataFrame, events: DataFrame, key: str, cand_id: str, window: tuple[str, str], buffer_seconds: int, seconds: int = DAY
) -> DataFrame:
    """Ids of candidates whose window, widened by the buffer, meets an event of the same key (closed bounds).

    Event windows are first merged into disjoint spans, so a candidate meets few of them however many
    events the key has.
    """
    s, e = window
    cover = merge_spans(events, [key], s, e).groupBy(key, "span_no").agg(F.min("__start").alias("__cs"), F.max("__end").alias("__ce"))
    wide = candidates.select(
        key,
        cand_id,
        plus_seconds(F.col(s), -float(buffer_seconds)).alias("__ws"),
        plus_seconds(F.col(e), float(buffer_seconds)).alias("__we"),
    )
    return overlap_join(wide, cover, [key], ("__ws", "__we"), ("__cs", "__ce"), seconds).select(cand_id).distinct()
