"""Answers to search requests: each retriever and the reranker on its own, so that one that fails leaves the others' hits.

A plan is one unit for Spark: if a retriever's function raises, all of it ends.  Here each retriever's hits (at most twice top_k, which a
request bounds by 100) are fetched apart, and what happened is a row of ``status``.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import fusion
from ..session import prepare
from .search import Collection, SearchRequest

#: A scorer takes the query and some texts and gives a number for each, higher for better.
Scorer = Callable[[str, list[str]], list[float]]
SCORERS: dict[str, Callable[[], Scorer]] = {}
_LOADED: dict[str, Scorer] = {}
HITS = "chunk_id string, score double, content string, search_type string"
STATUS = "part string, ok boolean, rows long, ms long, error string"


def register(name: str, load: Callable[[], Scorer]) -> None:
    """Make a scorer known. ``load`` is called once in each worker, when it is first needed."""
    SCORERS[name] = load


def scored(hits: DataFrame, query: str, name: str, group: int = 16) -> DataFrame:
    """``hits`` with ``rerank_score`` and ``rerank_error``. Texts are sent in groups; a group that fails has no scores and says why."""
    if name not in SCORERS:
        raise ValueError(f"no scorer {name!r}; known: {', '.join(sorted(SCORERS)) or 'none'}")
    load = SCORERS[name]
    schema = T.StructType([*hits.schema.fields, T.StructField("rerank_score", T.DoubleType()), T.StructField("rerank_error", T.StringType())])

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("content").to_pylist()]
            scores: list[float | None] = []
            errors: list[str | None] = []
            for at in range(0, len(texts), group):
                some = texts[at : at + group]
                try:
                    if name not in _LOADED:
                        _LOADED[name] = load()
                    got = [float(x) for x in _LOADED[name](query, some)]
                    if len(got) != len(some) or not all(map(math.isfinite, got)):
                        raise ValueError(f"{len(some)} texts, {sum(map(math.isfinite, got))} finite scores")
                    scores += got
                    errors += [None] * len(some)
                except Exception as e:  # noqa: BLE001: a port may raise anything; the row says what
                    scores += [None] * len(some)
                    errors += [f"{type(e).__name__}: {e}"[:200]] * len(some)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(errors, pa.string())], schema.names)

    prepare(hits.sparkSession)
    return hits.mapInArrow(run, schema)


@dataclass
class Response:
    """hits: chunk_id, score, content, search_type and the document's columns, best first. status: a row for each part that was asked."""

    hits: DataFrame
    status: DataFrame
    query_time_ms: int


class _Parts:
    def __init__(self, spark):
        self.spark, self.rows = spark, []

    def run(self, part: str, plan: Callable[[], DataFrame]) -> list:
        """The rows of a part, counted while it runs; none if it fails."""
        began = time.perf_counter()
        try:
            seen = Observation()
            got = plan().observe(seen, F.count(F.lit(1)).alias("n")).collect()
            ok, n, error = True, seen.get["n"], None
        except Exception as e:  # noqa: BLE001: whatever a retriever raises, the others go on
            got, ok, n, error = [], False, 0, f"{type(e).__name__}: {e}"[:500]
        self.rows.append((part, ok, n, int(1000 * (time.perf_counter() - began)), error))
        return got


def respond(collection: Collection, request: SearchRequest, embed: Callable[[str], list[float]] | None = None, scorer: str | None = None) -> Response:
    """Answer a request. ``embed`` turns the query into a vector; without it, or if it fails, only keywords are searched where the mode allows.

    The reranker sees what fusion left; if it fails for any text, the order before it stands.  ``status`` has parts embed, semantic,
    keyword, hierarchical and rerank, as far as they were asked.
    """
    began, k = time.perf_counter(), request.top_k
    spark = collection.chunks.sparkSession
    parts, vector = _Parts(spark), None
    columns = ["chunk_id", "score", "content", "search_type"]
    key = collection.chunks.schema["chunk_id"].dataType
    schema = T.StructType([T.StructField("chunk_id", key), *T._parse_datatype_string(HITS).fields[1:]])
    if request.mode != "keyword":
        t0 = time.perf_counter()
        try:
            if embed is None:
                raise ValueError("no embedder")
            vector = [float(x) for x in embed(request.query)]
            parts.rows.append(("embed", True, 1, int(1000 * (time.perf_counter() - t0)), None))
        except Exception as e:  # noqa: BLE001
            parts.rows.append(("embed", False, 0, int(1000 * (time.perf_counter() - t0)), f"{type(e).__name__}: {e}"[:500]))
    found = {}
    if vector is not None and request.mode in ("semantic", "hybrid"):
        found["semantic"] = parts.run("semantic", lambda: collection.semantic(vector, 2 * k, request.filters).select(*columns))
    if request.mode in ("keyword", "hybrid"):
        found["keyword"] = parts.run("keyword", lambda: collection.keyword(request.query, 2 * k, request.filters).select(*columns))
    if vector is not None and request.mode == "hierarchical":
        found["hierarchical"] = parts.run("hierarchical", lambda: collection.hierarchical(vector, k).select(*columns))
    frames = [spark.createDataFrame(rows, schema) for rows in found.values()] or [spark.createDataFrame([], schema)]
    hits = frames[0]
    if request.mode == "hybrid":
        for f in frames[1:]:
            hits = hits.unionByName(f)
        hits = fusion.rrf(hits)
    seen = [F.col("seen")] if "seen" in hits.columns else []
    hits = hits.orderBy(F.desc("score"), *seen, "chunk_id").limit(2 * k).select(*columns)
    if request.rerank and scorer is not None:
        rows = parts.run("rerank", lambda: scored(hits, request.query, scorer))
        errors = [r.rerank_error for r in rows if r.rerank_error]
        if errors:
            name, _, n, ms, _ = parts.rows.pop()
            parts.rows.append((name, False, n, ms, errors[0]))
        elif rows:
            hits = spark.createDataFrame([(r.chunk_id, r.rerank_score, r.content, "reranked") for r in rows], schema)
    if request.score_threshold:
        hits = hits.where(F.col("score") >= request.score_threshold)
    hits = hits.orderBy(F.desc("score"), "chunk_id").limit(k)
    if collection.documents is not None and "document_id" in collection.chunks.columns:
        hits = hits.join(collection.chunks.select("chunk_id", "document_id"), "chunk_id", "left").join(collection.documents, "document_id", "left").orderBy(F.desc("score"), "chunk_id")
    answer = spark.createDataFrame(hits.collect(), hits.schema)  # at most top_k rows
    return Response(answer, spark.createDataFrame(parts.rows, STATUS), int(1000 * (time.perf_counter() - began)))
