"""Landing, caching and lenient reading of tables; payloads, fallback ladders and sinks."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.session import path_exists
from eventloom.sources.columns import is_complete
from eventloom.sources.windows import calendar_months


ROWS_PER_FILE = 4_000_000


def scan_folders(spark: SparkSession, paths: Sequence[str], wanted: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Union of several Parquet folders, the wanted columns that exist, and the names of those that do not."""
    present = [p for p in paths if path_exists(spark, p)]
    if not present:
        raise FileNotFoundError(f"none of {list(paths)}")
    frames = [spark.read.option("mergeSchema", True).parquet(p) for p in present]
    have = set().union(*[f.columns for f in frames])
    missing = [c for c in wanted if c not in have]
    kept = [f.select(*[c for c in wanted if c in f.columns]) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kept), missing


def land_months(batch: DataFrame, ts: str, path: str, clean: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Write only the months that are not landed yet, one partition per month; returns how many were new.

    Rows without a time are the month ``undated``.
    """
    spark = batch.sparkSession
    rows = (clean(batch) if clean else batch).withColumn("month", F.coalesce(F.date_format(ts, "yyyy_MM"), F.lit("undated")))
    if path_exists(spark, path):
        landed = spark.read.parquet(path).select(F.col("month").cast("string").alias("month")).distinct()
        rows = rows.join(F.broadcast(landed), "month", "left_anti")  # one row per landed month
    months = rows.groupBy("month").agg(F.ceil(F.count("*") / ROWS_PER_FILE).alias("__files"))
    new = months.count()
    if new:
        # a month is as many tasks and files as its rows ask for; the table has one row per month
        spread = rows.join(F.broadcast(months), "month").withColumn("__file", F.pmod(F.xxhash64(*batch.columns), F.col("__files")))
        spread.repartition("month", "__file").drop("__files", "__file").write.mode("append").partitionBy("month").parquet(path)
    return new


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    schema = "archive string, folder string, month string, batch string, rows bigint"
    path = f"{root}/manifest"
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def land_plan(plan: DataFrame, read: Callable[[str], DataFrame], ts: str, root: str, before_commit: Callable[[str], None] | None = None) -> int:
    """Land the months that ``plan (archive, start, end, folder)`` asks for and the manifest lacks; returns how many were new.

    ``read(archive)`` gives an archive's rows; those with ``start <= day of ts <= end`` are written to a fresh batch folder,
    a partition per month, and only then is one file appended to the manifest, with a row for every month of the batch (months
    without rows too, so that they are not asked for again).  ``landed`` reads what the manifest names, so a batch whose writer
    died before that file is never seen, and the next run lands its months once more: no month is missed or repeated.
    One writer at a time per root.  Rows without a time belong to no month of a plan.  The driver holds plan rows and months only."""
    spark = plan.sparkSession
    windows = plan.select("archive", "folder", F.inline(calendar_months(F.col("start").cast("date"), F.col("end").cast("date")))).withColumnRenamed("tag", "month")
    pending = windows.join(_manifest(spark, root), ["archive", "folder", "month"], "left_anti").collect()  # one row per month of a plan
    day = F.to_date(ts)
    for archive, folder in sorted({(p.archive, p.folder) for p in pending}):
        asked = [p for p in pending if (p.archive, p.folder) == (archive, folder)]
        window = spark.createDataFrame([(p.month, p.window_start, p.window_end) for p in asked], "month string, __start date, __end date")
        rows = read(archive).where((F.col(ts) >= F.lit(min(p.window_start for p in asked))) & (F.col(ts) < F.lit(max(p.window_end for p in asked))))
        rows = rows.withColumn("month", F.date_format(ts, "yyyy_MM")).join(F.broadcast(window), "month").where((day >= F.col("__start")) & (day < F.col("__end"))).drop("__start", "__end")
        batch = f"{root}/data/{folder}/{uuid.uuid4().hex}"
        rows.write.partitionBy("month").parquet(batch)
        if before_commit:
            before_commit(archive)
        written = spark.read.schema(rows.schema).parquet(batch).groupBy(F.col("month").cast("string")).count()  # one row per month
        counts = dict(tuple(r) for r in written.collect())
        entries = [(archive, folder, p.month, batch, counts.get(p.month, 0)) for p in asked]
        spark.createDataFrame(entries, "archive string, folder string, month string, batch string, rows bigint").coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return len(pending)


def landed(spark: SparkSession, root: str, schema: T.StructType | str, folder: str | None = None) -> DataFrame:
    """Rows of the batches that the manifest names, of one folder or all, with their ``folder`` and ``month``."""
    named = _manifest(spark, root).where("rows > 0")
    named = (named.where(F.col("folder") == folder) if folder else named).select("folder", "batch").distinct().collect()  # one row per batch
    parts = [spark.read.parquet(b.batch).withColumns({"month": F.col("month").cast("string"), "folder": F.lit(b.folder)}) for b in sorted(named)]
    if not parts:
        return spark.createDataFrame([], schema).withColumns({"month": F.lit(None).cast("string"), "folder": F.lit(None).cast("string")})
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def materialize_if_stale(spark: SparkSession, path: str, build: Callable[[], DataFrame], required: Sequence[str], flag: Column | None = None) -> tuple[DataFrame, bool]:
    """Read the cached table when it meets its contract, else build and write it; says whether it was built."""
    if path_exists(spark, path):
        cached = spark.read.parquet(path)
        if is_complete(cached, required, flag):
            return cached, False
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), True


def read_lenient(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, str]:
    """The table and a note; a missing or unreadable file gives an empty table."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema), "missing"
    try:
        return spark.read.parquet(path), "ok"
    except Exception as ex:
        return spark.createDataFrame([], schema), f"unreadable: {type(ex).__name__}"


def write_table(df: DataFrame, path: str) -> str:
    """Parquet, or CSV when a type does not fit Parquet or the name asks for it; returns the path written."""
    if path.endswith(".csv"):
        df.write.mode("overwrite").csv(path, header=True)
        return path
    try:
        df.write.mode("overwrite").parquet(path)
        return path
    except Exception:
        fallback = re.sub(r"(\.parquet)?$", ".csv", path, count=1)
        df.select(*[F.col(c).cast("string") for c in df.columns]).write.mode("overwrite").csv(fallback, header=True)
        return fallback


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Reader by suffix; CSV takes a schema instead of guessing one."""
    if path.endswith(".csv"):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema is not None else reader).csv(path)
    return spark.read.parquet(path)


def safe_name(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9_.-]+", "_", text)


def append_stage(results: DataFrame, path: str, split: str, model: str) -> None:
    """Add one stage's rows to the cumulative results, partitioned by split and model."""
    out = results.withColumns({"split": F.lit(safe_name(split)), "model": F.lit(safe_name(model))})
    out.write.mode("append").partitionBy("split", "model").parquet(path)


def payload_rows(df: DataFrame, cells: str, header: Sequence[str], lineage: dict[str, str]) -> DataFrame:
    """Header plus arrays of cells to columns, with lineage columns."""
    return df.select(*[F.get(F.col(cells), i).alias(h) for i, h in enumerate(header)], *[F.lit(v).alias(k) for k, v in lineage.items()])


def best_source(df: DataFrame, station: str, priority: Column) -> DataFrame:
    """Rows of the first source in priority order that has any, per station."""
    ranked = df.withColumn("__p", priority)
    best = ranked.where(F.col("__p").isNotNull()).groupBy(station).agg(F.min("__p").alias("__b"))
    return ranked.join(best, station).where(F.col("__p") == F.col("__b")).drop("__p", "__b")


def layer_summary(layers: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """Rows and geometry status per layer."""
    parts = []
    for name, (df, geometry) in layers.items():
        status = F.lit("no_geometry") if geometry is None else F.when(F.count(geometry) == F.count("*"), "complete").otherwise("partial")
        parts.append(df.agg(F.lit(name).alias("layer"), F.count("*").alias("rows"), status.alias("geometry_status")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def save_geojson(df: DataFrame, path: str, geometry: Column, properties: Sequence[str]) -> None:
    """One GeoJSON feature per line, written by all tasks; no rows leave one empty collection."""
    if df.isEmpty():
        df.sparkSession.createDataFrame([('{"type": "FeatureCollection", "features": []}',)], "value string").write.mode("overwrite").text(path)
        return
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))
    df.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)


def read_geojson(spark: SparkSession, path: str, schema: str, whole_file: bool = False) -> DataFrame:
    """Features of line-delimited GeoJSON, or of whole-file collections."""
    if whole_file:
        doc = spark.read.schema(f"type string, features array<struct<{schema}>>").option("multiLine", True).json(path)
        return doc.select(F.explode("features").alias("f")).select("f.*")
    return spark.read.schema(schema).json(path)
