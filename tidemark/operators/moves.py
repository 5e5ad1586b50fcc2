"""What became of a project's files between its documents and a listing, with renames that keep the document's id.

``documents(document_id, path, size, content_hash)`` as stored, ``files(path, size, content_hash, modified_at)`` as found.  A path that went
and one that came are one file if size and content are equal.  Of equal files each is matched once: first those of the same
name (moved), then those of the same folder (renamed), then the rest, in the order of a hash of the path where several fit.  Two paths that
exchanged their contents exchange their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import Store

#: Equal files are paired within so many parts first, so that of a content in most files only what is left over meets in one task.
_PARTS = 64


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder_of(path: Column) -> Column:
    return F.left(path, F.length(path) - F.length(name_of(path)))


def _paired(rows: DataFrame, levels: list[list[str]]) -> DataFrame:
    """old_path, path: ``rows(side, path, ...)`` of side 0 and 1 paired one-to-one, by the columns of the first level, what is left by those of the
    second, and so on; within a level the k-th of one side goes with the k-th of the other, in order of the path's hash.

    A pass reads each row once a level: what finds a partner follows from its place and from the other side's number.
    """
    rows = rows.withColumn("_h", F.xxhash64("path")).withColumn("_part", F.pmod("_h", F.lit(_PARTS))).withColumn("_pair", F.lit(None).cast("string"))
    for n, keys in enumerate(levels):
        open_ = F.col("_pair").isNull()
        here = Window.partitionBy(*keys, "_open")
        rows = rows.withColumn("_open", open_).withColumns({"_n0": F.count_if(F.col("side") == 0).over(here), "_n1": F.count_if(F.col("side") == 1).over(here)})
        rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_open", "side").orderBy("_h", "path")))
        name = F.to_json(F.struct(F.lit(n).alias("n"), *[F.col(k) for k in keys], "_k"))
        rows = rows.withColumn("_pair", F.when(F.col("_open") & (F.col("_k") <= F.least("_n0", "_n1")), name).otherwise(F.col("_pair"))).drop("_open", "_n0", "_n1", "_k")
    sides = [F.max(F.when(F.col("side") == k, F.col("path"))).alias(name) for k, name in enumerate(("old_path", "path"))]
    return rows.where("_pair IS NOT NULL").groupBy("_pair").agg(*sides).select("old_path", "path")


def match(gone: DataFrame, came: DataFrame) -> DataFrame:
    """old_path, path: one-to-one, of paths(path, size, content_hash) that went and that came; as many as sizes and contents allow.
    Rows without a content hash match nothing.  Of equal files that only went, or only came, all meet in one task's sort."""
    shape = ["size", "content_hash"]
    sides = [side.where(F.col("content_hash").isNotNull()).select(F.lit(k).alias("side"), "path", *shape) for k, side in enumerate((gone, came))]
    rows = sides[0].unionByName(sides[1]).withColumn("name", name_of(F.col("path"))).withColumn("folder", folder_of(F.col("path")))
    return _paired(rows, [shape + more for more in (["name", "_part"], ["name"], ["folder"], ["_part"], [])])


def exchanged(documents: DataFrame, files: DataFrame) -> DataFrame:
    """old_path, path of pairs of paths that hold each other's content now."""
    both = documents.select("path", F.col("content_hash").alias("old")).join(files.select("path", F.col("content_hash").alias("new")), "path").where("old <> new")
    rows = both.select((F.col("old") < F.col("new")).cast("int").alias("side"), "path", F.least("old", "new").alias("low"), F.greatest("old", "new").alias("high"))
    pairs = _paired(rows, [["low", "high", "_part"], ["low", "high"]])
    return pairs.select(F.explode(F.array(F.struct("old_path", "path"), F.struct(F.col("path").alias("old_path"), F.col("old_path").alias("path")))).alias("x")).select("x.*")


def classify(documents: DataFrame, files: DataFrame) -> DataFrame:
    """change, document_id, old_path, path: created (no id yet), deleted (no path any more), renamed, updated (other content) or unchanged."""
    gone = documents.join(files.select("path"), "path", "left_anti")
    came = files.join(documents.select("path"), "path", "left_anti")
    moves = match(gone, came).unionByName(exchanged(documents, files)).withColumnRenamed("path", "_to")
    ids = documents.select("document_id", F.col("path").alias("old_path"), F.col("content_hash").alias("_old")).join(moves, "old_path", "left")
    # no path is the target of a move and of a document that stays: targets are new, or exchanged
    both = ids.withColumn("_to", F.coalesce("_to", "old_path")).join(files.select("path", F.col("content_hash").alias("_new")), F.col("_to") == F.col("path"), "full")
    change = F.when(F.col("old_path").isNull(), "created").when(F.col("path").isNull(), "deleted").when(F.col("path") != F.col("old_path"), "renamed").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("updated")
    return both.select(change.alias("change"), "document_id", "old_path", "path")


def sync(store: Store, project_id: str, files: DataFrame) -> DataFrame:
    """Bring a project's documents in line with ``files(path, size, content_hash, modified_at)``: renamed rows get their new name and keep id, chunks
    and vectors; deleted ones go with all that is theirs. One commit. What is left to take in comes back: change, document_id, path
    of created and updated files (``ingest`` finds a renamed document by its name and keeps the id)."""
    t = store.begin()
    documents = t.read("documents")
    mine = F.coalesce(F.col("project_id") == project_id, F.lit(False))
    stored = documents.where(mine).select("document_id", F.col("filename").alias("path"), F.col("file_size").alias("size"), "content_hash")
    plan = t.write("sync_plan", classify(stored, files))
    moved = plan.where("change = 'renamed'").select("document_id", F.col("path").alias("_new")).join(files.select(F.col("path").alias("_new"), F.col("modified_at").alias("_at")), "_new")
    gone = plan.where("change = 'deleted'").select("document_id")
    if not moved.isEmpty():
        named = documents.join(moved, "document_id", "left")
        t.write("documents", named.withColumn("filename", F.coalesce("_new", "filename")).withColumn("updated_at", F.coalesce("_at", "updated_at")).select(*documents.columns))
    if not gone.isEmpty():
        if t.exists("queue") and t.exists("chunks"):
            lost = t.read("chunks").join(gone, "document_id", "left_semi").select("chunk_id")
            t.write("queue", t.read("queue").join(lost, "chunk_id", "left_anti").select(*t.read("queue").columns))
        for name in ("documents", "chunks", "vectors"):
            if t.exists(name):
                t.write(name, t.read(name).join(gone, "document_id", "left_anti").select(*t.read(name).columns))
    t.commit()
    return t.read("sync_plan").where("change IN ('created', 'updated')").select("change", "document_id", "path")
