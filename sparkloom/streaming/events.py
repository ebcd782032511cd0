"""Streaming ingestion of agent events: redacted on the way in, appended as Parquet, and counted in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkloom.functions.secrets import redact, redaction_count
from sparkloom.schema import ACTIVITY


def source(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(ACTIVITY).json(path)


def redacted(events: DataFrame) -> DataFrame:
    """Events with data and project redacted, and how many places that were."""
    count = F.coalesce(redaction_count(F.col("data")), F.lit(0)) + F.coalesce(redaction_count(F.col("project")), F.lit(0))
    return events.withColumn("redaction_count", count.cast("int")).withColumn("data", redact(F.col("data"))).withColumn("project", redact(F.col("project")))


def ingest(events: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = redacted(events).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events by window, model and kind; state ends with the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "model_version", "event").agg(F.count(F.lit(1)).alias("n"))
