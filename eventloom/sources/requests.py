"""Service-request cleaning and incremental monthly landing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.temporal import parse_timestamp
from eventloom.functions.units import safe_numeric
from eventloom.operators.ordered import keep_first
from eventloom.sources.columns import fill_columns


def clean_requests(frame: DataFrame, order: Sequence[Column] | None = None, key: str = "unique_key") -> DataFrame:
    """Typed requests with a creation time and coordinates, one row per key (first in ``order``)."""
    text = F.lit(None).cast("string")
    frame = fill_columns(frame, {n: text for n in ("created_date", "closed_date", "latitude", "longitude")})
    typed = frame.withColumns(
        {
            "created_date": parse_timestamp(F.col("created_date").cast("string")).cast("timestamp_ntz"),
            "closed_date": parse_timestamp(F.col("closed_date").cast("string")).cast("timestamp_ntz"),
            "latitude": safe_numeric(F.col("latitude")),
            "longitude": safe_numeric(F.col("longitude")),
        }
    ).dropna(subset=["created_date", "latitude", "longitude"])
    if key not in typed.columns:
        return typed.dropDuplicates()
    rest = [F.col(c) for c in typed.columns if c != key]
    return keep_first(typed, [key], [*(order or []), *rest])
