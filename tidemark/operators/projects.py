"""Projects as rows of a store: create, rename, delete, resolve, reindex, and repairs that can be tried without effect.

Tables of the store: ``projects(project_id, name, description, watcher_enabled)``, ``documents``, ``chunks``, ``queue`` and
``vectors(vector_id, project_id, ...)``. A project's collection is its rows of ``vectors``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ingest import QUEUED, content_hash, take_in
from ..sources.store import Store, Transaction
from . import upkeep

PROJECT = "project_id string, name string, description string, watcher_enabled boolean"
#: Tables that bear a project_id.
OWNED = ("projects", "documents", "chunks", "vectors")


def _projects(t: Store | Transaction) -> DataFrame:
    return t.read("projects") if t.exists("projects") else t.spark.createDataFrame([], PROJECT)


def _free(t: Transaction, name: str) -> None:
    if _projects(t).where(F.col("name") == name).count():
        raise ValueError(f"there is a project {name!r} already")


def create(store: Store, name: str, description: str | None = None) -> str:
    """A new project's id. Names are unique (of two creators at once one gets ``Conflict``); its folder isn't watched until ``watch`` says so."""
    t = store.begin()
    _free(t, name)
    project_id = str(uuid.uuid4())
    t.insert_new("projects", store.spark.createDataFrame([(project_id, name, description, False)], PROJECT), ["project_id"])
    t.commit()
    return project_id


def _change(t: Transaction, which: str, **columns) -> int:
    have = _projects(t)
    hit = F.col("name") == which
    n = have.where(hit).count()
    if n:
        t.write("projects", have.select(*[F.when(hit, F.lit(columns[c])).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in have.columns]))
        t.commit()
    return n


def rename(store: Store, name: str, new: str) -> int:
    """How many projects were renamed; their ids stay."""
    t = store.begin()
    if new != name:
        _free(t, new)
    return _change(t, name, name=new)


def watch(store: Store, name: str, on: bool = True) -> int:
    return _change(store.begin(), name, watcher_enabled=on)


def watched(projects: DataFrame) -> DataFrame:
    return projects.where("watcher_enabled")


def delete(store: Store, project_id: str, dry_run: bool = False) -> DataFrame:
    """table, rows: what a project has in each table, and what goes unless ``dry_run``, all in one commit; source files are never touched."""
    mine = F.col("project_id") == project_id
    t = store.begin()
    tables = {name: t.read(name) for name in OWNED if t.exists(name)}
    counts = []
    if "chunks" in tables and t.exists("queue"):
        chunks, queue = tables["chunks"].where(mine).select("chunk_id"), t.read("queue")
        counts.append(("queue", queue.join(chunks, "chunk_id", "left_semi").count()))
        if counts[0][1] and not dry_run:
            t.write("queue", queue.join(chunks, "chunk_id", "left_anti").select(*queue.columns))
    for name, table in tables.items():
        n = table.where(mine).count()
        counts.append((name, n))
        if n and not dry_run:
            t.write(name, table.where(~F.coalesce(mine, F.lit(False))))
    t.commit()
    return store.spark.createDataFrame(counts, "table string, rows long")


def resolve(projects: DataFrame, text: str) -> str:
    """The id that a user's text means: itself if it has a UUID's shape, else the first project by name and id whose name
    it is or is part of (ignoring case), else the text as it stands."""
    if len(text) == 36 and text.count("-") == 4:
        return text
    found = projects.where((F.col("name") == text) | F.contains(F.lower("name"), F.lit(text.lower()))).orderBy("name", "project_id").select("project_id").limit(1).collect()
    return found[0].project_id if found else text


def reindex(store: Store, files: DataFrame, project_id: str, chunker) -> dict[str, DataFrame]:
    """Take all files of a project in again; documents, chunks, vectors and queue rows of files that are no longer there go. One commit."""
    t = store.begin()
    take_in(t, files, project_id, chunker)
    kept = t.read("files").select("document_id")
    for name in ("documents", "chunks", "vectors"):
        if t.exists(name):
            have = t.read(name)
            mine = F.coalesce(F.col("project_id") == project_id, F.lit(False))
            t.write(name, have.where(~mine).unionByName(have.where(mine).join(kept, "document_id", "left_semi").select(*have.columns)))
    queue = t.read("queue")
    t.write("queue", queue.join(t.read("chunks").select("chunk_id"), "chunk_id", "left_semi").select(*queue.columns))
    t.commit()
    return {name: t.read(name) for name in ("documents", "chunks", "queue")}


def repair(store: Store, dry_run: bool = False) -> DataFrame:
    """action, rows: chunks without a document go, then vectors without a chunk (they are noted in ``orphan_log`` once), and
    chunks whose vector isn't there lose its name and are queued again, all in one commit. ``dry_run`` only counts."""
    t = store.begin()
    documents, have, vectors = (t.read(name) for name in ("documents", "chunks", "vectors"))
    astray = have.join(documents.select("document_id"), "document_id", "left_anti")
    kept = have.join(documents.select("document_id"), "document_id", "left_semi").select(*have.columns)
    orphans = upkeep.orphans(vectors, kept)
    missing = upkeep.missing(kept, vectors)
    counts = [("drop_orphan_chunks", astray.count()), ("drop_orphan_vectors", orphans.count()), ("queue_missing_vectors", missing.count())]
    if not dry_run:
        if counts[1][1]:
            t.insert_new("orphan_log", orphans.select("vector_id", "project_id"), ["vector_id"])
            t.write("vectors", upkeep.valid(vectors, kept).select(*vectors.columns))
        if counts[2][1]:
            rows = missing.select("chunk_id", F.left("content", F.lit(QUEUED)).alias("content"), content_hash(F.col("content")).alias("content_hash"), F.lit("pending").alias("status"), F.lit(0).alias("retry_count"))
            if t.exists("queue"):
                queue = t.read("queue")
                t.write("queue", queue.join(rows, "chunk_id", "left_anti").select(*queue.columns).unionByName(rows, allowMissingColumns=True))
            else:
                t.write("queue", rows)
        if counts[0][1] or counts[2][1]:
            there = vectors.select("vector_id", F.lit(True).alias("_there")).distinct()
            named = kept.join(there, "vector_id", "left").withColumn("vector_id", F.when(F.col("_there"), F.col("vector_id")))
            t.write("chunks", named.select(*have.columns))
        t.commit()
    return store.spark.createDataFrame(counts, "action string, rows long")


def collection_size(store: Store, project_id: str) -> int:
    """Vectors of a project's collection; 0 where there is none."""
    return store.read("vectors").where(F.col("project_id") == project_id).count() if store.exists("vectors") else 0


def totals(documents: DataFrame) -> DataFrame:
    """One row: projects, documents, bytes."""
    return documents.agg(F.count_distinct("project_id").alias("projects"), F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))


def hit_fields(hits: DataFrame, payload: DataFrame) -> DataFrame:
    """chunk_id, score and the payload's fields of each hit: texts that are missing are empty, lists without members."""
    fields = {"content": F.coalesce("content", F.lit("")), "document_id": F.coalesce(F.col("document_id").cast("string"), F.lit("")), "symbols": F.coalesce("symbols", F.array().cast("array<string>"))}
    joined = hits.join(payload, "chunk_id", "left")
    return joined.select("chunk_id", "score", *[fields.get(c, F.col(c)).alias(c) for c in ("content", "document_id", "filename", "source_path", "start_line", "end_line", "symbols")])


def next_batch(queue: DataFrame, size: int) -> DataFrame:
    """The pending items that come next, by chunk_id."""
    return queue.where("status = 'pending'").orderBy("chunk_id").limit(size)


def last_errors(errors: DataFrame, n: int = 5) -> DataFrame:
    """project_id and its last ``n`` messages, oldest first. ``errors(project_id, at, message)``."""
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("at"), F.desc("message")))
    latest = errors.withColumn("_place", place).where(F.col("_place") <= n)
    return latest.groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "message"))), lambda e: e.message).alias("messages"))
