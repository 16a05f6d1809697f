"""Streams: progress by latest event with expiry, windowed counts with late data, and files chunked as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from granary.config import ChunkConfig
from granary.operators import blocks, chunking


def progress(events: DataFrame, key: str = "task_id", time: str = "ts", expiry: str = "30 seconds") -> DataFrame:
    """The latest state of each task while it is fresh: state older than the watermark is dropped."""
    return events.withWatermark(time, expiry).groupBy(F.session_window(time, expiry), key).agg(F.max_by("state", time).alias("state"), F.max(time).alias("last_seen"), F.count("*").alias("updates"))


def latest_progress(events: DataFrame, now: Column, key: str = "task_id", time: str = "ts", expiry: str = "30 seconds") -> DataFrame:
    """What a reader sees at a time: the latest state of each task that is not older than the expiry. One row for each task, however long it was silent before."""
    held = events.where(F.col(time) <= now).groupBy(key).agg(F.max_by("state", time).alias("state"), F.max(time).alias("last_seen"), F.count("*").alias("updates"))
    return held.where(F.col("last_seen") >= now - F.expr(f"interval {expiry}"))


def windowed_counts(events: DataFrame, time: str, group: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, window), group).agg(F.count("*").alias("n"))


def chunk_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, strategy: str | None = None, config: ChunkConfig = ChunkConfig()) -> StreamingQuery:
    """Chunk JSON documents (doc_id, text) as their files come; what is there already is done, then the query ends. Batches are idempotent: one folder each."""
    docs = spark.readStream.schema("doc_id long, text string").json(source)

    def write(batch: DataFrame, number: int) -> None:
        chunking.chunk_documents(blocks.from_markdown(batch), strategy, config).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(query: StreamingQuery, then: Callable[[], None] | None = None) -> None:
    query.awaitTermination()
    if then:
        then()
