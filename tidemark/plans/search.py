"""Search requests to plans: retrievers by mode, fusion, reranking, threshold, limit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import fusion, hierarchical, keyword
from ..operators import vectors as V
from ..operators.keyword_index import KeywordIndex

MODES = ("semantic", "keyword", "hybrid", "hierarchical")


@dataclass(frozen=True)
class SearchRequest:
    query: str
    top_k: int = 20
    mode: str = "hybrid"
    score_threshold: float | None = None
    filters: dict = field(default_factory=dict)
    rerank: bool = True

    def __post_init__(self):
        if not 1 <= len(self.query) <= 1000:
            raise ValueError("query: 1 to 1000 characters")
        if not 1 <= self.top_k <= 100:
            raise ValueError("top_k: 1 to 100")
        if self.mode not in MODES:
            raise ValueError(f"mode: one of {', '.join(MODES)}")
        if self.score_threshold is not None and not 0 <= self.score_threshold <= 1:
            raise ValueError("score_threshold: 0 to 1")


@dataclass
class Collection:
    """The tables of a collection.

    chunks(chunk_id, document_id, content, ...), vectors(vector_id = chunk_id, document_id, embedding, ...),
    summaries(document_id, summary, embedding), documents(document_id, filename, ...); the last two may be None.  With ``index`` (a
    ``KeywordIndex`` of the chunks) keyword search reads stored segments; a request with filters counts anew, over what is left.
    """

    chunks: DataFrame
    vectors: DataFrame
    summaries: DataFrame | None = None
    documents: DataFrame | None = None
    index: KeywordIndex | None = None

    def semantic(self, vector: list[float], top_k: int, filters: dict | None = None) -> DataFrame:
        hits = V.search(self.vectors, vector, top_k, None, filters).select(F.col("vector_id").alias("chunk_id"), "score")
        return hits.join(self.chunks.select("chunk_id", "content"), "chunk_id", "left").select("chunk_id", "score", F.coalesce("content", F.lit("")).alias("content"), F.lit("semantic").alias("search_type"))

    def keyword(self, query: str, top_k: int, filters: dict | None = None) -> DataFrame:
        if self.index is not None and not filters:
            return self.index.search(query, top_k).withColumn("search_type", F.lit("keyword"))
        chunks = self.chunks.where(V.payload_filter(filters))
        return keyword.search(chunks, query, top_k).withColumn("search_type", F.lit("keyword"))

    def hierarchical(self, vector: list[float], top_k: int) -> DataFrame:
        summaries = self.summaries if self.summaries is not None else hierarchical.centroids(self.vectors).join(hierarchical.fallback_summary(self.chunks), "document_id", "left")
        _, best = hierarchical.search(summaries, self.vectors, vector, top_k)
        hits = best.select(F.col("vector_id").alias("chunk_id"), "document_id", "score").join(self.chunks.select("chunk_id", "content"), "chunk_id", "left")
        return hierarchical.with_summaries(hits, summaries).select("chunk_id", "score", "content", F.lit("hierarchical").alias("search_type"))


def search(collection: Collection, request: SearchRequest, vector: list[float] | None = None, scorer: Callable[[Column], Column] | None = None) -> DataFrame:
    """chunk_id, score, content, search_type, document columns if known: one lazy plan.

    Each retriever gives twice top_k candidates.  The threshold comes last, on whatever scale the scores then have: fused scores
    stay below 2/61, so a threshold meant for similarities removes every hybrid row when reranking is off.  0 is no threshold.
    """
    k = request.top_k
    if request.mode != "keyword" and vector is None:
        raise ValueError(f"mode {request.mode} needs the query's vector")
    if request.mode == "semantic":
        hits = collection.semantic(vector, 2 * k, request.filters)
    elif request.mode == "keyword":
        hits = collection.keyword(request.query, 2 * k, request.filters)
    elif request.mode == "hierarchical":
        hits = collection.hierarchical(vector, k)
    else:
        hits = fusion.rrf(collection.semantic(vector, 2 * k, request.filters).unionByName(collection.keyword(request.query, 2 * k, request.filters)))
    seen = [F.col("seen")] if "seen" in hits.columns else []
    if request.rerank and scorer is not None:
        hits = fusion.rerank(hits, scorer, 2 * k)
        seen = []
    if request.score_threshold:
        hits = hits.where(F.col("score") >= request.score_threshold)
    hits = hits.orderBy(F.desc("score"), *seen, "chunk_id").limit(k).drop("seen")
    if collection.documents is not None and "document_id" in collection.chunks.columns:
        of = collection.chunks.select("chunk_id", "document_id").join(collection.documents, "document_id", "left")
        hits = hits.join(of, "chunk_id", "left")
    return hits
