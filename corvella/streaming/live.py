"""Streams: adding documents as they come, and counting operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvella.sources.store import Store


def add_stream(store: Store, stream: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Adds each micro-batch of ``(doc_id, text, ...)`` to the store; ids that are there are skipped, so a batch run again adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(["doc_id"]).join(store.documents.select("doc_id"), "doc_id", "left_anti")
        if not new.isEmpty():
            store.add_all(new)

    w = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def operation_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``(window_start, operation, events)``: each ``audit_id`` once, later than ``late`` dropped by a stream; also for a finished table."""
    unique = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["audit_id"]) if events.isStreaming else events.dropDuplicates(["audit_id"])
    return unique.groupBy(F.window("ts", window), F.lower("operation").alias("operation")).agg(F.count(F.lit(1)).alias("events")).select(F.col("window.start").alias("window_start"), "operation", "events")
