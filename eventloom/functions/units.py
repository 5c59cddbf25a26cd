"""Number parsing, unit conversion and safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ----
FT_TO_M = 0.3048
US_FT_TO_M = 0.304800609601219
MPH_TO_MS = 0.44704
INCH_TO_MM = 25.4
# ---- end of fixed values ----


def safe_numeric(c: Column) -> Column:
    """Double or null."""
    return F.trim(c.cast("string")).try_cast("double")


def safe_ratio(num: Column, den: Column) -> Column:
    """Quotient; a zero denominator gives null."""
    return F.try_divide(num, F.nullif(den, F.lit(0.0)))


def safe_boolean(c: Column) -> Column:
    t = c.cast("string")
    return F.when(t.isin("True", "true", "1"), F.lit(True)).when(t.isin("False", "false", "0"), F.lit(False))


def rain_text_to_mm(c: Column, unit: str) -> Column:
    """Gauge text to millimetres: trace is 0, quality flags are stripped."""
    factors = {"in": INCH_TO_MM, "inch": INCH_TO_MM, "inches": INCH_TO_MM, "mm": 1.0}
    if unit.lower() not in factors:
        raise ValueError(f"unknown rain unit {unit!r}")
    t = F.upper(F.trim(c.cast("string")))
    number = F.regexp_replace(t, r"[^0-9eE+\-.]", "").try_cast("double")
    return F.when(t.isin("T", "TRACE"), F.lit(0.0)).otherwise(number * F.lit(factors[unit.lower()]))


def speed_ms(posted_mph: Column, lanes: Column) -> Column:
    """Posted speed, else a speed by lane count, in metres per second."""
    by_lanes = F.when(lanes >= 6, F.lit(15.0)).when(lanes >= 3, F.lit(10.0)).otherwise(F.lit(6.0))
    return F.coalesce(posted_mph * F.lit(MPH_TO_MS), by_lanes)


def tide_level_m(value: Column, product: Column, clearance_m: Column) -> Column:
    """Water level from a reading; an air gap counts down from the bridge clearance."""
    return F.when(product == "air_gap", clearance_m - value).otherwise(value)


def tide_labels(product: Column, clearance_m: Column) -> tuple[Column, Column]:
    """Kind of measurement and of series of a product; an air gap becomes a tide only with a known clearance."""
    measured = F.when(product == "hourly_height", "water_level_m").when(product == "high_low", "high_low_m").when(product == "air_gap", "air_gap_m").otherwise("level_m")
    gap = F.when(clearance_m.isNotNull(), "air_gap_to_tide").otherwise("air_gap_raw")
    return measured, F.when(product == "air_gap", gap).when(product == "high_low", "observed_high_low").otherwise("observed_hourly")


def sigmoid(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
