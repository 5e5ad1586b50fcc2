"""Files to documents, chunks, vectors and queue rows, kept true to each chunk's content.

Tables of a ``Store``: ``documents(document_id, project_id, filename, ...)``, ``chunks(chunk_id, document_id, project_id, content,
content_hash, ..., vector_id)``, ``queue(chunk_id, content, content_hash, status, retry_count)`` and ``vectors(vector_id, project_id,
document_id, content_hash, embedding)``.  A vector belongs to a chunk's content: it counts only as long as both have the same hash.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import embedding
from ..session import prepare
from .store import Store, Transaction, latest

VECTOR = "vector_id string, project_id string, document_id string, content_hash string, embedding array<float>"
#: Longest text of a queue row, in characters.
QUEUED = 4000


def content_hash(content) -> F.Column:
    return F.sha2(F.coalesce(content, F.lit("")), 256)


def _hashed(df: DataFrame) -> DataFrame:
    """Tables of stores that had no hashes yet: such rows match no content, so they are embedded anew."""
    return df if "content_hash" in df.columns else df.withColumn("content_hash", F.lit(None).cast("string"))


def with_state(chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks with ``vector_id`` set where a vector has their content, vectors to be added).

    A chunk keeps the vector of its own id if the content is the same.  Otherwise another vector of its project with this content is
    copied under the chunk's id: text that only moved isn't embedded again.
    """
    have = _hashed(vectors)
    own = have.select(F.col("vector_id").alias("chunk_id"), "content_hash", F.lit(True).alias("own")).distinct()
    known = chunks.drop("vector_id").join(own, ["chunk_id", "content_hash"], "left")
    lacking = known.where(F.col("own").isNull()).select("chunk_id", "project_id", "document_id", "content_hash")
    # one vector of each content that is asked for, before it meets the chunks that hold it
    given = have.join(lacking.select("project_id", "content_hash").distinct(), ["project_id", "content_hash"], "left_semi")
    given = given.groupBy("project_id", "content_hash").agg(F.min_by("embedding", "vector_id").alias("embedding"))
    copied = lacking.join(given, ["project_id", "content_hash"]).select(F.col("chunk_id").alias("vector_id"), "project_id", "document_id", "content_hash", "embedding")
    named = known.join(copied.select(F.col("vector_id").alias("chunk_id"), F.lit(True).alias("copy")), "chunk_id", "left")
    vector_id = F.when(F.col("own") | F.col("copy"), F.col("chunk_id"))
    return named.withColumn("vector_id", vector_id).select(*chunks.columns), copied


def queue_state(queue: DataFrame | None, chunks: DataFrame) -> DataFrame:
    """The queue that ``chunks`` need: a row whose content is still the chunk's keeps its status and count, unless it says done
    and the vector is missing; rows of other content are pending anew; rows of chunks with a vector are done, or absent if they never were
    queued; rows of chunks that are gone go."""
    rows = chunks.select("chunk_id", F.left("content", F.lit(QUEUED)).alias("content"), "content_hash", F.col("vector_id").isNotNull().alias("embedded"))
    if queue is None:
        old = rows.select("chunk_id", "content_hash", F.lit("pending").alias("status"), F.lit(0).alias("retry_count")).limit(0)
    else:
        old = latest(_hashed(queue).select("chunk_id", "content_hash", "status", "retry_count"), ["chunk_id"])
    old = old.select("chunk_id", F.col("content_hash").alias("old_hash"), F.col("status").alias("old"), "retry_count")
    both = rows.join(old, "chunk_id", "left").where(~F.col("embedded") | F.col("old").isNotNull())
    same = F.col("old_hash") == F.col("content_hash")
    goes_on = same & (F.col("old") != "done")
    status = F.when(F.col("embedded"), "done").when(goes_on, F.col("old")).otherwise("pending")
    count = F.when(goes_on & ~F.col("embedded"), F.col("retry_count")).otherwise(0).cast("int")
    return both.select("chunk_id", "content", "content_hash", status.alias("status"), count.alias("retry_count"))


def take_in(t: Transaction, files: DataFrame, project_id: str, chunker) -> None:
    """The writes of ``ingest``, inside a transaction that may do more."""
    from ..functions import chunking

    # files are read and parsed once; what follows reads this table
    own = files.withColumn("document_id", F.sha2(F.concat_ws("\u0001", F.lit(project_id), "path"), 256))
    if t.exists("documents"):  # a renamed document has kept the id it was given first
        known = t.read("documents").where(F.col("project_id") == project_id).select(F.col("filename").alias("path"), F.col("document_id").alias("_known"))
        new = own.join(known, "path", "left").withColumn("_new", F.col("_known").isNull())
        # a new file where a renamed one was must not get that one's id
        taken = known.select(F.col("_known").alias("document_id"), F.lit(True).alias("_taken"))
        new = new.join(taken, "document_id", "left").withColumn("document_id", F.when(~F.col("_new"), F.col("_known")).when(F.col("_taken"), F.sha2(F.concat_ws("\u0001", "document_id", F.lit("again")), 256)).otherwise(F.col("document_id")))
        own = new.select(*own.columns)
    ids = t.write("files", latest(own, ["document_id"], [F.desc_nulls_last("modified_at")]))
    fine = ids.where(F.col("error").isNull())
    pieces = chunking.chunk(fine, "document_id", "text", chunker)
    chunks = pieces.select(F.concat_ws("-", "document_id", "chunk_index").alias("chunk_id"), "document_id", F.lit(project_id).alias("project_id"), "content", content_hash(F.col("content")).alias("content_hash"), "chunk_index", "start_line", "end_line", F.lit(None).cast("string").alias("vector_id"))
    chunks = t.write("staged_chunks", chunks)
    status = F.when(F.col("error").isNull(), "completed").otherwise("failed")
    documents = ids.select("document_id", F.lit(project_id).alias("project_id"), F.col("path").alias("filename"), "doc_type", F.col("size").alias("file_size"), status.alias("status"), F.col("error").alias("error_message"), F.col("modified_at").alias("updated_at"), F.when(F.col("error").isNull(), content_hash(F.col("text"))).alias("content_hash"))
    if t.exists("documents") and "content_hash" not in t.read("documents").columns:
        t.write("documents", _hashed(t.read("documents")))
    t.upsert("documents", documents, ["document_id"])
    _settle(t, chunks, ids.select("document_id").distinct())


def _settle(t: Transaction, chunks: DataFrame, taken: DataFrame) -> None:
    """Put ``chunks`` in place of those of the documents in ``taken``, and bring vectors and queue in line with them."""
    vectors = t.read("vectors") if t.exists("vectors") else t.spark.createDataFrame([], VECTOR)
    stated, copied = with_state(chunks, vectors)
    mine = t.write("staged_chunks", stated)
    if t.exists("chunks"):
        have = _hashed(t.read("chunks"))
        new = t.write("chunks", have.join(taken, "document_id", "left_anti").select(*mine.columns).unionByName(mine))
    else:
        new = t.write("chunks", mine)
    if t.exists("vectors"):
        # of the documents taken in, what no chunk has any more goes; a chunk's vector of other content too
        keys = mine.where("vector_id IS NOT NULL").select("vector_id", "content_hash")
        own = _hashed(vectors)
        kept = own.join(taken, "document_id", "left_anti").select(*own.columns).unionByName(own.join(taken, "document_id", "left_semi").join(keys, ["vector_id", "content_hash"], "left_semi").select(*own.columns))
        t.write("vectors", kept.unionByName(copied.select(*[c for c in own.columns if c in copied.columns]), allowMissingColumns=True))
    t.write("queue", queue_state(t.read("queue") if t.exists("queue") else None, new))
    t.drop("staged_chunks")


def ingest(store: Store, files: DataFrame, project_id: str, chunker) -> dict[str, DataFrame]:
    """Documents, chunks and queue rows of extracted files (see ``files.read``), in one commit.

    A document's id comes from project and first path, so taking a file in again replaces it and its chunks.  Chunks whose content
    didn't change keep their vectors; the others lose them and are queued.  Of several rows of one path the last modified counts.
    """
    prepare(store.spark)
    t = store.begin()
    take_in(t, files, project_id, chunker)
    t.commit()
    return {name: t.read(name) for name in ("documents", "chunks", "queue")}


def embed_pending(store: Store, port: Callable[[list[str]], Sequence], dim: int, project_id: str | None = None, **options) -> DataFrame:
    """Embed what is pending now: vectors, the chunks' vector_id and the queue's status change in one commit. status, count of what
    was asked for.

    The port is asked once for each content.  If chunks or queue change while it runs, the commit raises ``Conflict`` and
    nothing is kept, so no vector of an older content can come in.
    """
    prepare(store.spark)
    t = store.begin()
    chunks, queue = t.read("chunks"), t.read("queue")
    mine = chunks if project_id is None else chunks.where(F.col("project_id") == project_id)
    waiting = queue.where("status = 'pending'").join(mine.select("chunk_id", "content_hash", "project_id", "document_id"), ["chunk_id", "content_hash"])
    texts = waiting.groupBy("content_hash").agg(F.min("content").alias("content"))
    done = t.write("embedded", embedding.embed(texts, "content", port, dim, **options).select("content_hash", "embedding", "embed_status", "embed_error"))
    rows = t.write("answered", waiting.select("chunk_id", "content_hash", "project_id", "document_id").join(done, "content_hash"))
    fresh = rows.where("embed_status = 'ok'").select(F.col("chunk_id").alias("vector_id"), "project_id", "document_id", "content_hash", "embedding")
    t.upsert("vectors", fresh, ["vector_id"])
    named = chunks.join(fresh.select(F.col("vector_id").alias("chunk_id"), F.lit(True).alias("_new")), "chunk_id", "left")
    t.write("chunks", named.withColumn("vector_id", F.when(F.col("_new"), F.col("chunk_id")).otherwise(F.col("vector_id"))).select(*chunks.columns))
    told = queue.join(rows.select("chunk_id", "embed_status"), "chunk_id", "left")
    status = F.when(F.col("embed_status") == "failed", "failed").when(F.col("embed_status").isNotNull(), "done").otherwise(F.col("status"))
    count = (F.col("retry_count") + F.when(F.col("embed_status") == "failed", 1).otherwise(0)).cast("int")
    t.write("queue", told.withColumn("status", status).withColumn("retry_count", count).select(*queue.columns))
    counts = rows.groupBy(F.col("embed_status").alias("status")).count()
    counts = store.spark.createDataFrame(counts.collect(), counts.schema)
    for staged in ("embedded", "answered"):
        t.drop(staged)
    t.commit()
    return counts
