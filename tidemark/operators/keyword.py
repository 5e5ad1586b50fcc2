"""Keyword search: Okapi BM25 over ``chunks(chunk_id, content)``, as one plan.

idf(t) = ln(N - df + 0.5) - ln(df + 0.5); a negative one is replaced by a quarter of the mean over all terms.
Chunks that hold no query term score 0 and are returned after the others (in order of chunk_id) while there is room.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize_cjk, tokenize_cjk_literal

K1, B, EPSILON = 1.5, 0.75, 0.25


def lengths(chunks: DataFrame, tokens=tokenize_cjk) -> DataFrame:
    """chunk_id, tokens, dl"""
    return chunks.select("chunk_id", tokens(F.col("content")).alias("tokens")).withColumn("dl", F.coalesce(F.size("tokens"), F.lit(0)))


def postings(chunks: DataFrame, tokens=tokenize_cjk) -> DataFrame:
    """chunk_id, term, tf, dl"""
    return lengths(chunks, tokens).select("chunk_id", "dl", F.explode("tokens").alias("term")).groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def corpus_stats(chunks: DataFrame, tokens=tokenize_cjk) -> DataFrame:
    """One row: n, total, avgdl"""
    return lengths(chunks, tokens).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).withColumn("avgdl", F.when(F.col("n") > 0, F.col("total").cast("double") / F.col("n")))


def term_idf(chunks: DataFrame, tokens=tokenize_cjk) -> DataFrame:
    """term, df, idf with the floor for negative values"""
    seen = lengths(chunks, tokens).select(F.explode(F.array_distinct("tokens")).alias("term"))
    df = seen.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = chunks.agg(F.count(F.lit(1)).alias("n"))  # one row: its broadcast has a known size
    raw = df.crossJoin(F.broadcast(n)).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf0"))
    mean = raw.agg(F.avg("idf0").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("idf0") >= 0, F.col("idf0")).otherwise(EPSILON * F.col("mean")).alias("idf"))


def search(chunks: DataFrame, query: str, top_k: int = 20, threshold: float = 0.0, *, pad: bool = True, tokens=tokenize_cjk, literal=tokenize_cjk_literal) -> DataFrame:
    """chunk_id, score, content: the best ``top_k`` by rounded score, ties by chunk_id; a query without tokens finds nothing.

    ``pad=False`` leaves out chunks without any query term.  ``tokens`` and ``literal`` are one tokenizer, for columns and for the query.
    """
    wanted = Counter(literal(query))
    spark = chunks.sparkSession
    if not wanted:
        return chunks.select("chunk_id", F.lit(0.0).alias("score"), "content").limit(0)
    terms = spark.createDataFrame(list(wanted.items()), "term string, times long")
    stats = corpus_stats(chunks, tokens).select("avgdl")
    hits = postings(chunks, tokens).where(F.col("term").isin(list(wanted)))
    weighted = hits.join(F.broadcast(term_idf(chunks, tokens).where(F.col("term").isin(list(wanted)))), "term").join(F.broadcast(terms), "term").crossJoin(F.broadcast(stats))
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scores = weighted.groupBy("chunk_id").agg(F.sum(part).alias("s"))
    joined = chunks.select("chunk_id", "content").join(scores, "chunk_id", "left" if pad else "inner")
    scored = joined.select("chunk_id", F.round(F.coalesce("s", F.lit(0.0)), 6).alias("score"), "content")
    return scored.where(F.col("score") >= threshold).orderBy(F.desc("score"), "chunk_id").limit(top_k)


def upsert(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks with those of ``fresh`` added, or replaced where the chunk_id is known. Statistics are derived, so never stale."""
    return chunks.join(fresh.select("chunk_id"), "chunk_id", "left_anti").select(*chunks.columns).unionByName(fresh.select(*chunks.columns))


def remove(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks without the listed ids; unknown and repeated ids are harmless."""
    return chunks.join(ids.select("chunk_id"), "chunk_id", "left_anti").select(*chunks.columns)
