"""Trace events as a stream: files that arrive are appended once, and latencies are windowed with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import TRACE


def steps_stream(spark: SparkSession, path: str) -> DataFrame:
    """Retrieval steps that arrive as JSON lines under ``path``."""
    return spark.readStream.schema(TRACE["retrieval_step"]).json(path)


def ingest(spark: SparkSession, source: str, table: str, checkpoint: str) -> StreamingQuery:
    """Takes what is there and stops; steps seen before are dropped within the watermark, and the file sink's log makes every batch count once."""
    stream = steps_stream(spark, source).withWatermark("created_at", "1 hour").dropDuplicatesWithinWatermark(["step_id"])
    return stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latency_windows(steps: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Count, mean and greatest latency per stage and window; later rows than the watermark are dropped."""
    w = steps.withWatermark("created_at", late).groupBy(F.window("created_at", width).alias("w"), "stage")
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg("latency_ms").alias("mean_ms"), F.max("latency_ms").alias("max_ms")).select(F.col("w.start").alias("window_start"), "stage", "n", "mean_ms", "max_ms")
