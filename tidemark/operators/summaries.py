"""Document summaries as a stored table: written anew only where a document's text has changed, deleted with it.

``summaries(document_id, project_id, summary, source_hash, summary_status, embedding)``: one row a document.  ``source_hash`` is that of the
prompt, which holds all a summariser sees, so later chunks of a long document may change without a new summary.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import prepare
from ..sources.store import Store, Transaction
from . import embedding, hierarchical

#: A summariser takes prompts and gives a summary for each.
Summariser = Callable[[list[str]], list[str]]
#: Longest summary, in characters.
LONGEST = 500
SUMMARY = "document_id string, project_id string, summary string, source_hash string, summary_status string, embedding array<float>"


def sources(chunks: DataFrame, first_chunks: int = 10, most: int = 4000) -> DataFrame:
    """document_id, prompt, fallback, source_hash of every document that has a chunk; without early chunks the prompt is empty."""
    prompts = hierarchical.summary_prompt(chunks, first_chunks, most)
    both = hierarchical.fallback_summary(chunks).select("document_id", F.col("summary").alias("fallback")).join(prompts, "document_id", "left")
    both = both.withColumn("prompt", F.coalesce("prompt", F.lit("")))
    return both.select("document_id", "prompt", "fallback", F.sha2("prompt", 256).alias("source_hash"))


def changes(sources: DataFrame, summaries: DataFrame) -> DataFrame:
    """document_id, change: new, changed (another source_hash, or a fallback that stands in for a failed summary), kept or gone."""
    have = summaries.select("document_id", F.col("source_hash").alias("old_hash"), F.coalesce(F.col("summary_status") == "failed", F.lit(False)).alias("stand_in"))
    both = sources.select("document_id", "source_hash").join(have, "document_id", "full")
    change = F.when(F.col("source_hash").isNull(), "gone").when(F.col("stand_in").isNull(), "new").when(~F.col("source_hash").eqNullSafe(F.col("old_hash")) | F.col("stand_in"), "changed").otherwise("kept")
    return both.select("document_id", change.alias("change"))


def summarise(df: DataFrame, port: Summariser | None, group: int = 10) -> DataFrame:
    """``df(prompt, fallback, ...)`` with ``summary`` and ``summary_status``: ok, failed (the port raised or gave nothing; the fallback stands in) or
    fallback (there is no port, or no text to summarise).  A group that fails is asked one by one."""
    if port is None:
        return df.withColumns({"summary": F.left("fallback", F.lit(LONGEST)), "summary_status": F.lit("fallback")})
    schema = T.StructType([*df.schema.fields, T.StructField("summary", T.StringType()), T.StructField("summary_status", T.StringType())])

    def ask(prompts: list[str]) -> list[str | None]:
        try:
            got = list(port(prompts))
            if len(got) != len(prompts):
                raise ValueError(f"{len(prompts)} prompts, {len(got)} summaries")
        except Exception:  # noqa: BLE001: a port may raise anything; the status says so
            return [None] if len(prompts) == 1 else [x for p in prompts for x in ask([p])]
        return [g.strip()[:LONGEST] if isinstance(g, str) and g.strip() else None for g in got]

    def run(batches):
        for batch in batches:
            prompts, fallbacks = batch.column("prompt").to_pylist(), batch.column("fallback").to_pylist()
            due = [i for i, p in enumerate(prompts) if p and p.strip()]
            found: dict[int, str | None] = {}
            for at in range(0, len(due), group):
                some = due[at : at + group]
                found |= dict(zip(some, ask([prompts[i] for i in some])))
            made = [found[i] if found.get(i) else (fallbacks[i] or "")[:LONGEST] for i in range(len(prompts))]
            status = ["fallback" if i not in found else "ok" if found[i] else "failed" for i in range(len(prompts))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string()), pa.array(status, pa.string())], schema.names)

    prepare(df.sparkSession)
    return df.mapInArrow(run, schema)


def refresh(store: Store, port: Summariser | None = None, embed: embedding.Port | None = None, dim: int = 0, project_id: str | None = None, **options) -> DataFrame:
    """Bring the table in line with the chunks, in one commit: change, count.

    Only new and changed documents are summarised (and embedded by ``embed``; without it a document's vector is the mean of its
    chunks').  Kept summaries stay as they are; those of documents without chunks go, also where ``project_id`` is given, if they are of that project.
    """
    prepare(store.spark)
    t = store.begin()
    chunks = t.read("chunks")
    have = t.read("summaries") if t.exists("summaries") else t.spark.createDataFrame([], SUMMARY)
    if project_id is not None:
        chunks = chunks.where(F.col("project_id") == project_id)
    mine = have if project_id is None else have.where(F.col("project_id") == project_id)
    wanted = sources(chunks)
    told = t.write("summary_changes", changes(wanted, mine))
    due = told.where("change IN ('new', 'changed')").select("document_id")
    projects = chunks.groupBy("document_id").agg(F.min("project_id").alias("project_id"))
    # the port is asked once: what follows reads this table
    made = t.write("summaries_made", summarise(wanted.join(due, "document_id", "left_semi").join(projects, "document_id"), port))
    rows = made.select("document_id", "project_id", "summary", "source_hash", "summary_status")
    if embed is not None:
        vectors = embedding.embed(rows, "summary", embed, dim, **options)
        rows = t.write("summaries_embedded", vectors.withColumn("embedding", F.when(F.col("embed_status") == "ok", F.col("embedding"))).drop("embed_status", "embed_error"))
    elif t.exists("vectors"):
        means = hierarchical.centroids(t.read("vectors").join(due, "document_id", "left_semi"))
        rows = rows.join(means.select("document_id", F.col("embedding").cast("array<float>")), "document_id", "left")
    else:
        rows = rows.withColumn("embedding", F.lit(None).cast("array<float>"))
    stale = told.where("change <> 'kept'").select("document_id")
    names = [f.name for f in T._parse_datatype_string(SUMMARY).fields]
    t.write("summaries", have.join(stale, "document_id", "left_anti").select(*names).unionByName(rows.select(*names)))
    counts = told.groupBy("change").count()
    counts = store.spark.createDataFrame(counts.collect(), counts.schema)  # four rows at most
    for staged in ("summary_changes", "summaries_made", "summaries_embedded"):
        t.drop(staged)
    t.commit()
    return counts


#: Tables whose rows go with a document, and the key that they have in common with it.
OWNED = ("chunks", "vectors", "summaries", "documents", "files")


def delete_documents(t: Transaction, ids: DataFrame) -> dict[str, int]:
    """Rows that went from each table: chunks with their queue rows, vectors, summaries, documents. The caller commits.

    ``vectors_without_chunk`` counts vectors of these documents that no chunk named, which go too.
    """
    gone = ids.select("document_id").distinct()
    out: dict[str, int] = {}
    if t.exists("chunks") and t.exists("queue"):
        theirs = t.read("chunks").join(gone, "document_id", "left_semi").select("chunk_id")
        queue = t.read("queue")
        out["queue"] = queue.join(theirs, "chunk_id", "left_semi").count()
        t.write("queue", queue.join(theirs, "chunk_id", "left_anti").select(*queue.columns))
    if t.exists("chunks") and t.exists("vectors"):
        named = t.read("chunks").select(F.col("vector_id")).where("vector_id IS NOT NULL")
        out["vectors_without_chunk"] = t.read("vectors").join(gone, "document_id", "left_semi").join(named, "vector_id", "left_anti").count()
    for name in OWNED:
        if t.exists(name):
            table = t.read(name)
            out[name] = table.join(gone, "document_id", "left_semi").count()
            if out[name]:
                t.write(name, table.join(gone, "document_id", "left_anti").select(*table.columns))
    return out
