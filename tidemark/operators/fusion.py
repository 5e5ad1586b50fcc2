"""Reciprocal rank fusion, reranking and the steps after it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize, tokenize_literal

RRF_K = 60
HIT = ["chunk_id", "score", "content", "search_type"]


def rrf(hits: DataFrame, k: int = RRF_K, order: tuple[str, ...] = ("semantic", "keyword")) -> DataFrame:
    """chunk_id, score, content, search_type: sum of 1 / (k + rank) over the retrievers' lists.

    ``hits`` has HIT's columns; ranks are by score within a search_type, ties by chunk_id.  Content is that of the first
    list (in ``order``) that holds the chunk; ties of the fused score keep that first-seen order.
    """
    list_no = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("search_type"))
    ranked = hits.withColumn("r", F.row_number().over(Window.partitionBy("search_type").orderBy(F.desc("score"), "chunk_id")))
    fused = ranked.groupBy("chunk_id").agg(F.sum(1.0 / (k + F.col("r"))).alias("s"), F.min_by("content", F.struct(list_no, "r")).alias("content"), F.min(F.struct(list_no.alias("l"), F.col("r").alias("r"))).alias("seen"))
    return fused.select("chunk_id", F.round("s", 6).alias("score"), "content", F.lit("hybrid").alias("search_type"), "seen")


def lexical_scorer(query: str) -> Callable[[Column], Column]:
    """The default scorer port: the share of the query's distinct tokens that a text holds."""
    wanted = sorted(set(tokenize_literal(query)))
    if not wanted:
        return lambda content: F.lit(0.0)
    return lambda content: F.size(F.array_intersect(tokenize(content), F.array(*[F.lit(w) for w in wanted]))).cast("double") / len(wanted)


def rerank(hits: DataFrame, scorer: Callable[[Column], Column] | None, top_k: int | None = None) -> DataFrame:
    """Scores replaced by the scorer's, search_type "reranked"; equal scores keep the order they came in (old score, then
    chunk_id).  Without a scorer: the hits as they came."""
    if scorer is None:
        out, keys = hits, [F.desc("score"), F.col("chunk_id")]
    else:
        out = hits.withColumn("_old", F.col("score")).withColumn("score", F.round(scorer(F.col("content")), 6)).withColumn("search_type", F.lit("reranked"))
        keys = [F.desc("score"), F.desc("_old"), F.col("chunk_id")]
    out = out.orderBy(*keys)
    return (out.limit(top_k) if top_k else out).select(*[c for c in hits.columns if c != "seen"])


def rerank_with_threshold(hits: DataFrame, scorer, top_k: int, threshold: float = 0.0) -> DataFrame:
    out = rerank(hits, scorer, 2 * top_k)
    return (out.where(F.col("score") >= threshold) if threshold > 0 else out).orderBy(F.desc("score"), "chunk_id").limit(top_k)
