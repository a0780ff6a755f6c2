"""Streaming forms: resumable ingest, event windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records as R
from ..sources.sinks import append_new


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, schema) -> None:
    """All files of source not seen yet, as unified records appended once each; a restart resumes from the
    checkpoint, and a repeated batch adds nothing."""
    docs = spark.readStream.schema(schema).parquet(source)
    # a batch's name is the checkpoint's and its own number: a batch that runs again after a crash is known
    writer = docs.writeStream.foreachBatch(lambda df, n: append_new(R.unified(df), target, batch=f"{checkpoint}#{n}") and None)
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windows(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums of event types in tumbling windows; events later than the watermark are left out."""
    w, events = F.window("ts", size), events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w, events = F.session_window("ts", gap), events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).groupBy("user_id", w).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("session_start"), "n")
