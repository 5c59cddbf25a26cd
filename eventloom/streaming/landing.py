"""Incremental landing as a file stream: every run takes what is new, then stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream_months(spark: SparkSession, source: str, schema: T.StructType, ts: str, target: str, state: str, key: str | None = None) -> DataFrame:
    """Append the files not seen yet to ``target``, one partition per month; progress is kept in ``state``."""
    rows = spark.readStream.schema(schema).parquet(source)
    if key is not None:
        rows = rows.withWatermark(ts, "1 day").dropDuplicatesWithinWatermark([key])
    rows = rows.withColumn("month", F.date_format(ts, "yyyy_MM"))
    q = rows.writeStream.format("parquet").partitionBy("month").option("checkpointLocation", state).trigger(availableNow=True).start(target)
    q.awaitTermination()
    return spark.read.parquet(target)
