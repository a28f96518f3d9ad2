"""Streams of events: counts in windows, and reports merged into the notices batch by batch.

An event may be late by ``delay``; a window is final when the watermark has passed its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import notices, store


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes", slide: str | None = None, time: str = "ts") -> DataFrame:
    """(start, end, event_type, n, total) of tumbling or sliding windows."""
    w = F.window("at", width, slide) if slide else F.window("at", width)
    rows = events.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", delay)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes", time: str = "ts") -> DataFrame:
    rows = events.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", delay)
    return rows.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "user_id", "n")


def merge_reports(events: DataFrame, table: store.Table, checkpoint: str):
    """Add each report event (id) to its notice; all that has come is handled, then the stream stops.

    A batch that is handled again, after a failure between its commit and the stream's, is skipped: the table knows the
    last batch of each stream, by its checkpoint.
    """

    def merge(batch: DataFrame, number: int) -> None:
        if not table.holds(checkpoint, number):
            more, _unknown = notices.count_reports(table.read(), batch)
            table.commit(more, checkpoint, number)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
