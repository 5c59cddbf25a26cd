"""Calendar and event-time expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.text import lookup_map
from eventloom.operators.ordered import micros

# ---- fixed values ----
LOCAL_ZONE = "America/New_York"
EXPLICIT_ZONE = r"(Z|[+-][0-9]{2}:[0-9]{2})$"
SEASONS = {1: "winter", 2: "winter", 3: "spring", 4: "spring", 5: "spring", 6: "summer",
           7: "summer", 8: "summer", 9: "fall", 10: "fall", 11: "fall", 12: "winter"}
SEASON_CODES = {1: "DJF", 2: "DJF", 3: "MAM", 4: "MAM", 5: "MAM", 6: "JJA",
                7: "JJA", 8: "JJA", 9: "SON", 10: "SON", 11: "SON", 12: "DJF"}
ADMINISTRATIONS = [
    ("2014-01-01", "michael_bloomberg_2002_2013"),
    ("2022-01-01", "bill_de_blasio_2014_2021"),
    ("2026-01-01", "eric_adams_2022_2025"),
    (None, "zohran_mamdani_2026_present"),
]
UNKNOWN_ADMINISTRATION = "unknown_mayoral_administration"
DEFAULT_WINDOW_HOURS = 24
# ---- end of fixed values ----


def parse_timestamp(c: Column) -> Column:
    """Timestamp or null, never an error under ANSI mode."""
    return F.try_to_timestamp(c)


def instant_to_local(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    """Wall clock in ``zone`` of an instant, as a zone-less timestamp."""
    return F.convert_timezone(F.current_timezone(), F.lit(zone), ts.cast("timestamp_ntz"))


def to_local_naive(df: DataFrame, column: str, out: str, assume_utc: bool = False) -> DataFrame:
    """Parse text to local wall-clock time.

    One explicit zone anywhere in the column (or ``assume_utc``) means every value is read as an instant.
    """
    text = F.col(column)
    naive = F.try_to_timestamp(text).cast("timestamp_ntz")
    local = instant_to_local(F.try_to_timestamp(text))
    if assume_utc:
        return df.withColumn(out, local)
    zoned = df.agg(F.coalesce(F.bool_or(text.rlike(EXPLICIT_ZONE)), F.lit(False))).scalar()
    return df.withColumn(out, F.when(zoned, local).otherwise(naive))


def hours_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(3_600_000_000.0)


def plus_seconds(ts: Column, seconds: Column | float) -> Column:
    s = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return ts + F.make_dt_interval(secs=s.cast("decimal(18,6)"))


def season(month: Column, codes: bool = False) -> Column:
    return F.element_at(lookup_map(SEASON_CODES if codes else SEASONS), month.cast("int"))


def administration(ts: Column) -> Column:
    """Label of the administration in office at ``ts``."""
    out = F.when(ts.isNull(), F.lit(UNKNOWN_ADMINISTRATION))
    for cut, label in ADMINISTRATIONS:
        out = out.otherwise(F.lit(label)) if cut is None else out.when(ts < F.lit(cut).cast("timestamp_ntz"), F.lit(label))
    return out


def calendar_parts(ts: Column) -> dict[str, Column]:
    """Year, month, hour, day of week (Monday is 0) and ISO date text."""
    return {
        "event_year": F.year(ts),
        "event_month": F.month(ts),
        "event_hour": F.hour(ts),
        "event_dow": F.weekday(ts),
        "event_date": F.date_format(ts, "yyyy-MM-dd"),
    }


def event_times(df: DataFrame, start: str, end: str, status: str, hours: int = DEFAULT_WINDOW_HOURS) -> DataFrame:
    """Window end, durations, observed end and resolution of events.

    An end is *observed* only when every member closed (status 1); other ends are inferred.
    """
    s, e = F.col(start), F.col(end)
    df = df.withColumn("event_window_end", F.coalesce(e, plus_seconds(s, hours * 3600)))
    df = df.withColumn("event_end_observed", F.when(F.col(status) == 1, e))
    return df.withColumns(
        {
            "event_window_duration_hours": hours_between(s, F.col("event_window_end")),
            "resolution_hours": hours_between(s, F.col("event_end_observed")),
            "resolution_bool": F.col("event_end_observed").isNotNull(),
            "event_end_inferred": e.isNotNull() & F.col("event_end_observed").isNull(),
        }
    )
