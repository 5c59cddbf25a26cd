"""Geometry columns of tabular sources, nested locations and point layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions.geometry import looks_like_geometry, parse_parts, point
from eventloom.functions.units import safe_numeric

# ---- fixed values: names tried in this order ----
GEOMETRY_NAMES = ["the_geom", "shape", "geometry"]
POINT_NAMES = [
    ("longitude", "latitude"),
    ("lon", "lat"),
    ("x", "y"),
    ("location_1_longitude", "location_1_latitude"),
    ("the_geom_longitude", "the_geom_latitude"),
]
# ---- end of fixed values ----


def detect_geometry_column(df: DataFrame) -> str | None:
    """A known name, else the first column whose first non-null value looks like a geometry."""
    for name in GEOMETRY_NAMES:
        if name in df.columns:
            return name
    for f in df.schema:
        if not isinstance(f.dataType, (T.StructType, T.StringType)):
            continue
        some = df.where(F.col(f.name).isNotNull())  # the first row that has a value ends the scan
        if isinstance(f.dataType, T.StructType):
            if "coordinates" in f.dataType.names and not some.isEmpty():
                return f.name
            continue
        first = some.select(looks_like_geometry(F.col(f.name))).first()
        if first and first[0]:
            return f.name
    return None


def parse_geometry(df: DataFrame, column: str) -> Column:
    """Parts of a shape, each a list of points, from text or from a ``struct<type, coordinates>``."""
    if isinstance(df.schema[column].dataType, T.StructType):
        return parse_parts(F.to_json(F.col(column)))
    return parse_parts(F.col(column))


def build_geo_table(df: DataFrame, column: str, project=None, drop_unparsed: bool = True) -> DataFrame:
    """Add ``parts`` and ``line``, the first part; ``project(x, y)`` maps coordinates to the working plane."""
    parts = parse_geometry(df, column)
    if project is not None:
        parts = F.transform(parts, lambda line: F.transform(line, lambda p: point(*project(p["x"], p["y"]))))
    out = df.withColumn("parts", parts).withColumn("line", F.get("parts", F.lit(0)))
    return out.where(F.col("line").isNotNull()) if drop_unparsed else out


def expand_locations(df: DataFrame) -> DataFrame:
    """Nested ``struct<latitude, longitude>`` columns become ``<c>_latitude`` and ``<c>_longitude``."""
    new = {}
    for f in df.schema:
        if isinstance(f.dataType, T.StructType) and {"latitude", "longitude"} <= set(f.dataType.names):
            new |= {f"{f.name}_{k}": F.col(f"{f.name}.{k}") for k in ("latitude", "longitude")}
    return df.withColumns(new)


def detect_point_columns(df: DataFrame) -> tuple[str, str] | None:
    for pair in POINT_NAMES:
        if set(pair) <= set(df.columns):
            return pair
    for c in df.columns:
        lat = c.replace("_longitude", "_latitude")
        if c.endswith("_longitude") and lat in df.columns:
            return c, lat
    return None


def point_layer(df: DataFrame) -> DataFrame | None:
    """Rows with usable coordinates and their point, or nothing when there are none."""
    wide = expand_locations(df)
    pair = detect_point_columns(wide)
    if pair is None:
        return None
    x, y = (safe_numeric(F.col(c)) for c in pair)
    out = wide.withColumns({pair[0]: x, pair[1]: y}).dropna(subset=list(pair)).withColumn("point", point(F.col(pair[0]), F.col(pair[1])))
    return None if out.isEmpty() else out
