"""Structured Streaming: windowed counts, incremental ingest, progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) per window of ``ts``; events later than the watermark are left out."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (
        events.withWatermark("ts", late)
        .groupBy(w, "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n): sessions of a user, parted by a gap."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap), "user_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
    )


def new_only(papers: DataFrame, time: str = "updated_at", late: str = "7 days") -> DataFrame:
    """Papers not seen before within the watermark."""
    return papers.withWatermark(time, late).dropDuplicatesWithinWatermark(["key"])


def ingest(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run ``write(batch, batch_id)`` over all that is there; the checkpoint remembers what was done."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(query: StreamingQuery) -> dict:
    """State, rows so far, and the error of a dead query."""
    done = query.recentProgress
    state = "running" if query.isActive else "failed" if query.exception() else "done"
    return {"id": str(query.id), "state": state, "rows": sum(p["numInputRows"] for p in done), "error": str(query.exception() or "") or None}
