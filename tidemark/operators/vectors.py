"""Vector search: exact cosine top-k with payload filters, and upkeep of vector tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import prepare


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is null, empty or zero."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths)


def is_zero(v: Column) -> Column:
    return F.forall(v, lambda x: x == 0)


def payload_filter(filters: dict | None) -> Column:
    """AND over keys: a list means any of its values, anything else equality."""
    tests = [F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == F.lit(v) for k, v in (filters or {}).items()]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def search(vectors: DataFrame, query: list[float], top_k: int, threshold: float | None = None, filters: dict | None = None) -> DataFrame:
    """All columns but the vector, and score: rounded first, then filtered, ordered (ties by vector_id) and cut."""
    ask = F.array(*[F.lit(float(x)) for x in query])
    kept = vectors.where(payload_filter(filters))
    scored = kept.withColumn("score", F.round(cosine(F.col("embedding"), ask), 6)).where(F.col("score").isNotNull())
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return scored.drop("embedding").orderBy(F.desc("score"), "vector_id").limit(top_k)


def batch_search(vectors: DataFrame, queries: DataFrame, top_k: int, most_bytes: int = 32 << 20) -> DataFrame:
    """query_id, rank, vector_id, score for a stated set of queries against all vectors but the query's own.

    Queries of at most ``most_bytes`` (counted first, as doubles) are broadcast: each task multiplies them with its vectors block by block and
    sends on its own ``top_k`` of each query, so what is shuffled doesn't grow with a task's vectors.  More queries than that meet the
    vectors in a distributed product.  Vectors and queries that are null, empty, zero or hold null or non-finite components find nothing and
    aren't found; so do those of unlike lengths with each other.  Ties go to the smaller vector_id, also among many copies.
    """
    named = queries.where("vector_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vector_id").alias("query_id"), "embedding")
    size = named.agg(F.coalesce(F.sum(8 * F.size("embedding").cast("long")), F.lit(0)).alias("n")).first().n
    sent = vectors.where("vector_id IS NOT NULL").select("vector_id", "embedding")
    scored = _by_blocks(sent, named, top_k) if size <= most_bytes else _by_pairs(sent, named)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vector_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("query_id", "rank", "vector_id", "score")


def _by_pairs(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")), F.lit(False)))
    asked = queries.where(finite).select("query_id", F.col("embedding").alias("ask"))
    # neither side is broadcast here: the one that fits has gone the other way
    pairs = asked.hint("shuffle_replicate_nl").join(vectors.where(finite), F.col("query_id") != F.col("vector_id"))
    return pairs.select("query_id", "vector_id", F.round(cosine(F.col("ask"), F.col("embedding")), 6).alias("score")).where(F.col("score").isNotNull())


def _units(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, vectors of length one as doubles) of the lists that have ``dim`` finite components and aren't zero."""
    at = np.flatnonzero(np.asarray(pc.fill_null(pc.list_value_length(lists), -1)) == dim)
    if not dim or not len(at):
        return at[:0], np.empty((0, dim))
    m = pc.cast(lists.take(pa.array(at)).flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    length = np.sqrt((m * m).sum(axis=1))
    fine = np.isfinite(length) & (length > 0)
    return at[fine], m[fine] / length[fine, None]


def _by_blocks(vectors: DataFrame, queries: DataFrame, top_k: int, cells: int = 4_000_000) -> DataFrame:
    spark = prepare(vectors.sparkSession)
    table = queries.toArrow().combine_chunks()  # its size has been checked
    ids, lists = table["query_id"].combine_chunks(), table["embedding"].combine_chunks()
    asked = {}
    for dim in pc.unique(pc.list_value_length(lists)).to_pylist():
        at, units = _units(lists, dim)
        if len(at):
            asked[dim] = (np.asarray(ids.take(pa.array(at))), units)
    shared = spark.sparkContext.broadcast(asked)
    kind = vectors.schema["vector_id"].dataType
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("vector_id", kind), T.StructField("score", T.DoubleType())])

    def run(batches):
        best: dict[int, tuple] = {}
        for batch in batches:
            names = np.asarray(batch.column("vector_id"))
            for dim, (query_ids, q) in shared.value.items():
                at, units = _units(batch.column("embedding"), dim)
                order = np.argsort(names[at], kind="stable")
                at, units = at[order], units[order]
                step = max(1, cells // len(q))
                for a in range(0, len(at), step):
                    ours = names[at[a : a + step]]
                    score = np.round(q @ units[a : a + step].T, 6) + 0.0
                    score[query_ids[:, None] == ours[None, :]] = -np.inf
                    if score.shape[1] > top_k:
                        # all above the k-th score, and of those equal to it the first by vector_id
                        least = np.partition(score, score.shape[1] - top_k, axis=1)[:, -top_k][:, None]
                        above = score > least
                        level = score == least
                        take = above | (level & (np.cumsum(level, axis=1) <= top_k - above.sum(axis=1, keepdims=True)))
                    else:
                        take = np.ones(score.shape, bool)
                    row, column = np.nonzero(take & (score > -np.inf))
                    new = (row, ours[column], score[row, column])
                    if dim in best:
                        new = tuple(np.concatenate([x, y]) for x, y in zip(best[dim], new))
                    by = np.lexsort((new[1], -new[2], new[0]))
                    row, found, told = (x[by] for x in new)
                    first = np.searchsorted(row, row)
                    keep = np.arange(len(row)) - first < top_k
                    best[dim] = (row[keep], found[keep], told[keep])
        for dim, (row, found, told) in best.items():
            for a in range(0, len(row), 100_000):
                some = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(shared.value[dim][0][row[some]]), pa.array(found[some]), pa.array(told[some])], schema.names)

    return vectors.mapInArrow(run, schema)


def upsert(vectors: DataFrame, fresh: DataFrame) -> DataFrame:
    return vectors.join(fresh.select("vector_id"), "vector_id", "left_anti").select(*vectors.columns).unionByName(fresh.select(*vectors.columns))


def delete(vectors: DataFrame, condition: Column) -> DataFrame:
    return vectors.where(~F.coalesce(condition, F.lit(False)))
