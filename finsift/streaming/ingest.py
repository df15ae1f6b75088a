"""Streams: documents through the batch transforms, micro-batch by micro-batch; and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsift.operators import formatting


def score_stream(spark: SparkSession, source: str, out: str, checkpoint: str, schema: str = "doc_id bigint, content string"):
    """Scores Parquet documents that arrive in source and adds them to out, each batch under its number.

    A batch that is retried replaces its own rows, so that every document is there once.
    """

    def scored(batch: DataFrame, number: int) -> None:
        formatting.assessed(batch).select("doc_id", "overall", "risk_level").write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(scored).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_stream(spark: SparkSession, source: str, out: str, checkpoint: str, schema: str, time_col: str, key_col: str, value_col: str, width: str = "1 day", delay: str = "1 day"):
    """Counts and sums of events by time window and key, written once a window has closed.

    Events that come later than `delay` after the latest one seen are left out; no more state than open windows is held.
    """
    events = spark.readStream.schema(schema).parquet(source).select(F.col(time_col).cast("timestamp").alias("at"), F.col(key_col).alias("key"), F.col(value_col).alias("value"))
    counts = events.withWatermark("at", delay).groupBy(F.window("at", width), "key").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    flat = counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "key", "n", "total")
    return flat.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
