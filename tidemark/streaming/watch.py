"""File events: filtering, debouncing and coalescing, as batch plans and as Structured Streaming.

Events are ``(src_path, event_type, ts)`` with types created, modified, deleted and moved.  Debouncing is per path: a burst
ends when nothing happens to that path for the gap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def relevant(events: DataFrame, ignored: Column) -> DataFrame:
    """Deletions always; of ignored paths and of changed directories nothing else."""
    keep = (F.col("event_type") == "deleted") | ~ignored
    if "is_directory" in events.columns:
        keep &= ~(F.col("is_directory") & (F.col("event_type") == "modified"))
    return events.where(keep)


def across_boundary(events: DataFrame, from_ignored: Column, to_ignored: Column) -> DataFrame:
    """A move out of what is ignored creates its target, a move into it deletes its source."""
    moved = F.col("event_type") == "moved"
    kind = F.when(moved & from_ignored & ~to_ignored, "created").when(moved & ~from_ignored & to_ignored, "deleted").otherwise(F.col("event_type"))
    path = F.when(moved & from_ignored & ~to_ignored, F.col("dest_path")).otherwise(F.col("src_path"))
    return events.where(~(moved & from_ignored & to_ignored)).select(*[{"event_type": kind, "src_path": path}.get(c, F.col(c)).alias(c) for c in events.columns])


def sessions(events: DataFrame, key: str, gap: str) -> DataFrame:
    """key, first_ts, last_ts, n for each burst (works on streams with a watermark as well)."""
    burst = events.groupBy(key, F.session_window("ts", gap)).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))
    return burst.select(key, "first_ts", "last_ts", "n")


def fold(ordered: Column) -> Column:
    """What an ordered array of event types amounts to: created stays created when modified, deleted then created is a
    modification, else the latest counts."""

    def step(state, event):
        return F.when((state == "created") & (event == "modified"), state).when((state == "deleted") & (event == "created"), F.lit("modified")).otherwise(event)

    return F.aggregate(F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))), F.get(ordered, F.lit(0)), step)


def coalesce(events: DataFrame, gap: str) -> DataFrame:
    """src_path, event_type, last_ts, n: one event for each path and burst. A burst's events are one path's, so few."""
    burst = events.groupBy("src_path", F.session_window("ts", gap).alias("w")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_type"))).alias("e"), F.count(F.lit(1)).alias("n"))
    return burst.select("src_path", fold(F.transform("e", lambda x: x["event_type"])).alias("event_type"), F.element_at("e", -1)["ts"].alias("last_ts"), "n")


def start(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, *, gap: str = "1 second", lateness: str = "10 seconds", name: str = "file-events", available_now: bool = False) -> StreamingQuery:
    """Coalesce a stream of events and hand each batch of finished bursts to ``apply(batch, batch_id)``.

    Batches come one after the other and none is dropped; the checkpoint makes a restart go on where it stopped.
    """
    ready = coalesce(events.withWatermark("ts", lateness), gap)
    writer = ready.writeStream.queryName(name).outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(apply)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=gap)).start()


def queue_worker(chunks: DataFrame, embed: Callable[[Column], Column], out: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Embed a stream of ``chunks(chunk_id, content)`` into a Parquet table, batch by batch, each chunk once."""

    def run(batch: DataFrame, batch_id: int) -> None:
        vectors = batch.dropDuplicates(["chunk_id"]).select("chunk_id", embed(F.col("content")).alias("embedding"))
        vectors.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").partitionBy("batch").option("partitionOverwriteMode", "dynamic").parquet(out)

    writer = chunks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def snapshot_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """src_path, event_type from two listings ``(path, modified_at)``: what a file source never reports, deletions, too."""
    both = before.select("path", F.col("modified_at").alias("a")).join(now.select("path", F.col("modified_at").alias("b")), "path", "full")
    kind = F.when(F.col("a").isNull(), "created").when(F.col("b").isNull(), "deleted").when(F.col("b") > F.col("a"), "modified")
    return both.select(F.col("path").alias("src_path"), kind.alias("event_type")).where(F.col("event_type").isNotNull())
