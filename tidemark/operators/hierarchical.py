"""Two-stage search: document summaries first, then the best chunks of the documents found."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import snippet
from ..sources.store import latest
from . import vectors as V


def fallback_summary(chunks: DataFrame) -> DataFrame:
    """document_id, summary, chunk_count: the first chunk's opening 200 characters and dots (the default of the summary port)."""
    first = F.min_by("content", "chunk_index")
    return chunks.groupBy("document_id").agg(F.concat(F.left(first, F.lit(200)), F.lit("...")).alias("summary"), F.count(F.lit(1)).alias("chunk_count"))


def summary_prompt(chunks: DataFrame, first_chunks: int = 10, most: int = 4000) -> DataFrame:
    """document_id, prompt: what a language-model summariser is given."""
    head = chunks.where(F.col("chunk_index") < first_chunks).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("c"))
    return head.select("document_id", snippet(F.array_join(F.transform("c", lambda x: x["content"]), "\n\n"), most).alias("prompt"))


def centroids(vectors: DataFrame, key: str = "document_id") -> DataFrame:
    """A document's mean vector, component by component: the default summary embedding."""
    parts = vectors.select(key, F.posexplode("embedding").alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: F.round(p["x"], 9)).alias("embedding"))


def search(summaries: DataFrame, vectors: DataFrame, query: list[float], top_k: int = 20, summary_top_k: int | None = None, chunks_per_doc: int = 3) -> tuple[DataFrame, DataFrame]:
    """(summaries found, chunks found).  One summary per document counts (see ``latest``), so no document's chunks come twice."""
    one = latest(summaries, ["document_id"]).withColumnRenamed("document_id", "vector_id")
    found = V.search(one, query, summary_top_k or min(5, top_k)).withColumnRenamed("vector_id", "document_id")
    ask = F.array(*[F.lit(float(x)) for x in query])
    # at most five documents: their ids are a broadcast of known size
    inside = vectors.join(F.broadcast(found.select("document_id")), "document_id", "left_semi")
    scored = inside.withColumn("score", F.round(V.cosine(F.col("embedding"), ask), 6)).where(F.col("score").isNotNull()).drop("embedding")
    best = scored.withColumn("_n", F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("score"), "vector_id"))).where(F.col("_n") <= chunks_per_doc).drop("_n")
    return found, best.orderBy(F.desc("score"), "vector_id").limit(top_k)


def with_summaries(hits: DataFrame, summaries: DataFrame) -> DataFrame:
    """Each hit with its document's summary text, or null."""
    return hits.join(latest(summaries.select("document_id", "summary"), ["document_id"]), "document_id", "left")
