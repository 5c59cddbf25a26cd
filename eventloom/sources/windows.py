"""Time-window planners as array expressions: explode one to get a plan table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _span(a: Column, b: Column) -> Column:
    return F.struct(a.alias("window_start"), b.alias("window_end"))


def anniversary_months(start: Column, end: Column) -> Column:
    """``[cur, cur + 1 month)`` from ``start``, cut at ``end``; an empty interval is an error.

    Steps add up one by one, so a day lost to a short month stays lost.
    """
    n = F.greatest(F.ceil(F.months_between(end, start)), F.lit(0)).cast("int")
    day = lambda k: F.array_min(F.transform(F.sequence(F.lit(0), k), lambda j: F.dayofmonth(F.add_months(start, j))))
    at = lambda k: F.date_add(F.trunc(F.add_months(start, k), "MM"), day(k) - 1)
    spans = F.transform(F.sequence(F.lit(0), n), lambda k: _span(at(k), F.least(at(k + 1), end)))
    spans = F.filter(spans, lambda s: s["window_start"] < end)
    return F.when(start < end, spans).otherwise(F.raise_error(F.lit("start must be before end")))


def calendar_months(start: Column, end: Column) -> Column:
    """Calendar months covering ``start`` to ``end`` inclusive, with a ``YYYY_MM`` tag."""
    stop = F.date_add(end, 1)
    months = F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.make_ym_interval(F.lit(0), F.lit(1)))
    return F.transform(
        months,
        lambda m: F.struct(
            F.greatest(m, start).alias("window_start"), F.least(F.add_months(m, 1), stop).alias("window_end"), F.date_format(m, "yyyy_MM").alias("tag")
        ),
    )


def year_chunks(start: Column, end: Column) -> Column:
    years = F.sequence(F.trunc(start, "YYYY"), F.trunc(end, "YYYY"), F.make_ym_interval(F.lit(1), F.lit(0)))
    return F.transform(years, lambda y: _span(F.greatest(y, start), F.least(F.date_sub(F.add_months(y, 12), 1), end)))


def fixed_windows(start: Column, end: Column, days: int = 31) -> Column:
    """Consecutive windows that end ``days`` days after they start, both days included; the next starts the day after."""
    starts = F.sequence(start, end, F.make_dt_interval(F.lit(days + 1)))
    return F.transform(starts, lambda s: _span(s.cast("date"), F.least(F.date_add(s.cast("date"), days), end)))


def probe_windows(start: Column, end: Column, days: int = 31) -> Column:
    """``days`` days from the start, around the midpoint and up to the end, within the period and without repeats.

    Half days are floored, at both ends of the middle window."""
    span, whole = days - 1, F.datediff(end, start)
    low, high = (F.floor(F.greatest(whole, F.lit(0)) / 2 + k * span / 2).cast("int") for k in (-1, 1))
    first = _span(start, F.least(F.date_add(start, span), end))
    middle = _span(F.greatest(F.date_add(start, low), start), F.least(F.date_add(start, high), end))
    last = _span(F.greatest(F.date_sub(end, span), start), end)
    return F.filter(F.array_distinct(F.array(first, middle, last)), lambda w: w["window_end"] >= w["window_start"])
