"""Incremental normalising and routing (an extension: the batch pipeline has no streams).

Routing is stateless, so it runs unchanged on a stream; repeats are dropped within a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def without_repeats(stream: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """Rows whose key was not seen within the delay; rows with a null key are kept apart by their time."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def route_stream(stream: DataFrame, reason: F.Column, included: str, excluded: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Each micro-batch goes to exactly one of two folders by its rows' reasons."""
    rows = (prepare(stream) if prepare else stream).withColumn("reason", reason)

    def write(batch: DataFrame, number: int) -> None:
        # a batch that runs again after a failure replaces its own folders
        batch.where("reason is null").drop("reason").write.mode("overwrite").parquet(f"{included}/batch={number}")
        batch.where("reason is not null").write.mode("overwrite").parquet(f"{excluded}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(stream: DataFrame, time: str, kind: str, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(window, kind, n): late rows within the delay still count."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, size), kind).agg(F.count("*").alias("n"))
