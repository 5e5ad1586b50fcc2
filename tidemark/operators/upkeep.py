"""Keeping a collection healthy: coverage, missing and orphaned rows, verdicts, the work queue, change detection.

Counters are always derived from the tables.  ``chunks(chunk_id, project_id, vector_id, ...)``, ``vectors(vector_id, project_id)``,
``queue(chunk_id, status, retry_count, ...)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import percentage

STATUSES = ("pending", "processing", "done", "failed")
MAX_RETRY = 3


def with_zeros(counts: DataFrame, column: str = "status", values: tuple[str, ...] = STATUSES) -> DataFrame:
    """``counts(column, count)`` with a 0 for each known value that doesn't occur."""
    every = counts.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return every.join(counts, column, "left").select(column, F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def status_counts(queue: DataFrame) -> DataFrame:
    return with_zeros(queue.groupBy("status").count())


def coverage(chunks: DataFrame, *by: str) -> DataFrame:
    """total, with_vector, without_vector, coverage (per cent; 0 when empty), overall or by columns."""
    have = F.count_if(F.col("vector_id").isNotNull())
    return chunks.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), have.alias("with_vector")).select(*by, "total", "with_vector", (F.col("total") - F.col("with_vector")).alias("without_vector"), percentage(F.col("with_vector"), F.col("total")).alias("coverage"))


def missing(chunks: DataFrame, vectors: DataFrame, key: str = "vector_id") -> DataFrame:
    """Chunks that name a vector which isn't there."""
    return chunks.where(F.col(key).isNotNull()).join(vectors.select(key), key, "left_anti")


def orphans(vectors: DataFrame, chunks: DataFrame, key: str = "vector_id") -> DataFrame:
    """Vectors that no chunk names."""
    return vectors.join(chunks.where(F.col(key).isNotNull()).select(key), key, "left_anti")


def valid(vectors: DataFrame, chunks: DataFrame, key: str = "vector_id") -> DataFrame:
    return vectors.join(chunks.select(key), key, "left_semi")


def verdict(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per project: db_count, vector_count, missing, orphan, action, drift (counts differ by over 5 per cent of the larger).

    It compares counts, so a missing and an orphaned row cancel out; ``missing`` and ``orphans`` compare sets.
    """
    db = chunks.groupBy("project_id").agg(F.count(F.lit(1)).alias("db_count"))
    vec = vectors.groupBy("project_id").agg(F.count(F.lit(1)).alias("vector_count"))
    both = db.join(vec, "project_id", "full").select("project_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("db_count", "vector_count")])
    gap = F.col("db_count") - F.col("vector_count")
    both = both.withColumns({"missing": F.greatest(gap, F.lit(0)), "orphan": F.greatest(-gap, F.lit(0))})
    action = F.when(F.col("missing") > 0, "sync_missing").when(F.col("orphan") > 0, "clean_orphans").otherwise("none")
    return both.withColumns({"action": action, "drift": F.abs(gap) > 0.05 * F.greatest("db_count", "vector_count")})


def verdict_rollup(verdicts: DataFrame) -> DataFrame:
    """Each project and, with a null project_id, all of them: projects, with_issues, missing, orphan."""
    issue = F.sum(F.when(F.col("action") != "none", 1).otherwise(0))
    return verdicts.rollup("project_id").agg(F.count(F.lit(1)).alias("projects"), issue.alias("with_issues"), F.sum("missing").alias("missing"), F.sum("orphan").alias("orphan"))


def enqueue(queue: DataFrame, chunks: DataFrame, most: int = 4000) -> tuple[DataFrame, DataFrame]:
    """(rows to add, one row queued/skipped/total): chunks not queued yet, content cut to ``most`` characters."""
    fresh = chunks.join(queue.select("chunk_id"), "chunk_id", "left_anti").dropDuplicates(["chunk_id"])
    rows = fresh.select("chunk_id", F.left("content", F.lit(most)).alias("content"), F.lit("pending").alias("status"), F.lit(0).alias("retry_count"))
    total = chunks.agg(F.count(F.lit(1)).alias("total"))
    counts = rows.agg(F.count(F.lit(1)).alias("queued")).crossJoin(total).select("queued", (F.col("total") - F.col("queued")).alias("skipped"), "total")
    return rows, counts


def populate(chunks: DataFrame, queue: DataFrame) -> DataFrame:
    """Chunks without a vector whose id isn't queued with a status other than failed (NOT IN, as ids are never null)."""
    busy = queue.where("status <> 'failed'").select("chunk_id")
    return chunks.where(F.col("vector_id").isNull()).join(busy, "chunk_id", "left_anti")


def next_state(queue: DataFrame) -> DataFrame:
    """A failed item with retries left goes back to pending, one without stays; processing ones whose lease ended do too."""
    again = (F.col("status") == "failed") & (F.col("retry_count") < MAX_RETRY)
    return queue.withColumn("next_status", F.when(again, "pending").otherwise(F.col("status")))


def record_outcome(queue: DataFrame, outcome: DataFrame) -> DataFrame:
    """``outcome(chunk_id, ok, error)``: done, or failed with one more retry and the error's first 200 characters."""
    joined = queue.join(outcome, "chunk_id", "left")
    status = F.when(F.col("ok").isNull(), F.col("status")).when(F.col("ok"), "done").otherwise("failed")
    retries = F.col("retry_count") + F.when(~F.col("ok"), 1).otherwise(0)
    error = F.when(~F.col("ok"), F.left("error", F.lit(200)))
    return joined.select(*[{"status": status, "retry_count": F.coalesce(retries, F.col("retry_count")).cast("int")}.get(c, F.col(c)).alias(c) for c in queue.columns], error.alias("error_msg"))


def release_stale(queue: DataFrame, now, lease_seconds: int = 600) -> DataFrame:
    """Items left in processing by a worker that ended: pending again once their lease is over."""
    stale = (F.col("status") == "processing") & (F.col("created_at") < F.lit(now) - F.make_dt_interval(secs=F.lit(lease_seconds)))
    return queue.withColumn("status", F.when(stale, "pending").otherwise(F.col("status")))


def classify(files: DataFrame, documents: DataFrame) -> DataFrame:
    """path, change: created, deleted, updated (file newer than the row) or unchanged, by one full outer join.

    ``files(path, modified_at)``, ``documents(path, updated_at)``.
    """
    both = files.join(documents, "path", "full")
    change = F.when(F.col("updated_at").isNull(), "created").when(F.col("modified_at").isNull(), "deleted").when(F.col("modified_at") > F.col("updated_at"), "updated").otherwise("unchanged")
    return both.select("path", change.alias("change"))


def counters(changes: DataFrame) -> DataFrame:
    """Per project and (null project_id) overall: how many of each change."""
    kinds = ("created", "updated", "deleted", "renamed", "skipped", "errors")
    return changes.rollup("project_id").agg(*[F.count_if(F.col("change") == k).alias(k) for k in kinds])


def delete_documents(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the listed document_ids: chunks, vectors, summaries, queue and documents alike."""
    gone = ids.select("document_id").distinct()
    return {name: t.join(gone, "document_id", "left_anti").select(*t.columns) for name, t in tables.items()}


def overlong(chunks: DataFrame, most: int) -> DataFrame:
    """One row: total, overlong, longest, passed."""
    n = F.length("content")
    out = chunks.agg(F.count(F.lit(1)).alias("total"), F.count_if(n > most).alias("overlong"), F.max(n).cast("long").alias("longest"))
    return out.withColumn("passed", F.col("overlong") == 0)


def unindexed(points: DataFrame, least: int = 100) -> DataFrame:
    """The rows of ``points(project_id, points, indexed)`` with over ``least`` points of which none is indexed, and the message for each."""
    quiet = (F.col("points") > least) & (F.col("indexed") == 0)
    return points.where(quiet).withColumn("message", F.format_string("%s: %d points, none indexed", "project_id", "points"))
