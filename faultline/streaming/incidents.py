"""Extension: incident counts over a stream, by tumbling windows of event time with a watermark, and sessions of a service."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def incidents(events: DataFrame) -> DataFrame:
    """Errors among events with their severity; needs event_id, ts, user_id, event_type and value."""
    severity = F.when(F.col("value") >= 300, "critical").when(F.col("value") >= 100, "high").otherwise("other")
    return events.filter(F.col("event_type") == "error").select(F.col("event_id").alias("id"), F.col("user_id").alias("service_id"), F.col("ts").cast("timestamp").alias("ts"), "value", severity.alias("severity"))


def windowed_history(rows: DataFrame, window: str = "1 day", watermark: str = "2 days") -> DataFrame:
    """Incidents by window and severity. On a stream, windows are final once the watermark passes them; later rows are dropped."""
    if rows.isStreaming:
        rows = rows.withWatermark("ts", watermark)
    out = rows.groupBy(F.window("ts", window).alias("w"), "severity").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("max_value"))
    return out.select(F.col("w.start").alias("window_start"), "severity", "n", "max_value")


def sessions(rows: DataFrame, gap: str = "6 hours", watermark: str = "2 days") -> DataFrame:
    """Runs of a service's incidents with no gap longer than ``gap``."""
    if rows.isStreaming:
        rows = rows.withWatermark("ts", watermark)
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "service_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("service_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def run_to_completion(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """A streaming result over what the source has now, as files beside the checkpoint.

    Appended rows go to files as they are final; in the other modes each batch's whole result takes the place of the
    one before.
    """
    out, spark = f"{checkpoint.rstrip('/')}-{name}", df.sparkSession
    writer = df.writeStream.outputMode(mode).queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)
