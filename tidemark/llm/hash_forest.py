"""Approximate nearest neighbours by a hash-prefix forest.

Each tree hashes a vector to a string of ``bits`` signs of random projections; its strings lie in a sorted array, so the
vectors that share a prefix with a query are a contiguous run found by two binary searches.  A query first descends in
every tree to its longest matching prefix, then all trees ascend together, one bit at a time, until the runs hold enough
candidates; the distinct candidates are scored exactly.

Vectors lie in shards of bounded size, each with its own forest; queries visit every shard in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEED = 20260101


class Forest:
    def __init__(self, vectors: np.ndarray, trees: int, bits: int, seed: int = SEED):
        self.trees, self.bits = trees, bits
        self.planes = np.random.default_rng(seed).standard_normal((trees * bits, vectors.shape[1])).astype(np.float32)
        self.keys, self.order = [], []
        codes = self.codes(vectors)
        for t in range(trees):
            order = np.argsort(codes[:, t], kind="stable")
            self.order.append(order.astype(np.int32))
            self.keys.append(codes[order, t])

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """The strings, as unsigned integers whose high bits come first: (vector, tree)."""
        out = np.empty((len(vectors), self.trees), np.uint32)
        weights = (np.uint32(1) << np.arange(self.bits - 1, -1, -1, dtype=np.uint32)).astype(np.uint32)
        for a in range(0, len(vectors), 4096):
            signs = (vectors[a : a + 4096].astype(np.float32) @ self.planes.T > 0).reshape(-1, self.trees, self.bits)
            out[a : a + 4096] = (signs * weights).sum(axis=2, dtype=np.uint32)
        return out

    def candidates(self, queries: np.ndarray, enough: int):
        """For each query the places of its candidates: at the deepest level at which all trees together hold enough."""
        codes = self.codes(queries)
        level = np.full(len(queries), -1)
        lows = np.zeros((len(queries), self.trees), np.int64)
        highs = np.zeros((len(queries), self.trees), np.int64)
        for depth in range(self.bits, -1, -1):  # ascending synchronously, from whole strings to the empty prefix
            open_ = np.flatnonzero(level < 0)
            if not len(open_):
                break
            shift = np.uint32(self.bits - depth)
            for t in range(self.trees):
                low = (codes[open_, t] >> shift) << shift
                lows[open_, t] = np.searchsorted(self.keys[t], low, "left")
                highs[open_, t] = np.searchsorted(self.keys[t], low | ((np.uint32(1) << shift) - np.uint32(1)), "right")
            held = (highs[open_] - lows[open_]).sum(axis=1)
            level[open_[(held >= enough) | (depth == 0)]] = depth
        mark = np.zeros(len(self.order[0]), bool)
        for q in range(len(queries)):
            mark[:] = False
            for t in range(self.trees):
                mark[self.order[t][lows[q, t] : highs[q, t]]] = True
            yield np.flatnonzero(mark)


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows whose vector takes part: not null, not empty, no null or non-finite component, not all zero."""
    v = F.col(vec_col)
    fine = v.isNotNull() & F.col(id_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return df.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def _matrix(column) -> np.ndarray:
    flat = np.asarray(column.flatten() if isinstance(column, pa.ListArray) else column.combine_chunks().flatten(), np.float64)
    return flat.reshape(len(column), -1)


def search(
    spark: SparkSession,
    vectors: DataFrame,
    is_query,
    k: int = 20,
    *,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    trees: int = 96,
    bits: int = 16,
    share: float = 0.55,
    shard_rows: int = 8192,
    block_rows: int = 4096,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every query row, by inner product in double precision.

    ``is_query`` is a condition on vec_id.  Ascent stops once the trees' runs together hold ``share`` times as many entries as
    the shard has distinct vectors (an entry counts in each tree that holds it), and 24 for each neighbour wanted.  Vectors are brought to one length first by an added component
    (sqrt(M^2 - |x|^2), M the largest length), which turns the largest inner product into the smallest angle.  A query is
    never its own neighbour; ties go to the smaller vec_id; fewer candidates give fewer rows.  Repeated ids are
    repeated candidates.  Vectors of another length than the most common one take no part.
    """
    good = usable(vectors, id_col, vec_col)
    shapes = good.select(F.size("v").alias("d"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x).alias("n")).groupBy("d").agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("n")).orderBy(F.desc("rows"), "d").limit(1).collect()
    if not shapes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, rows, longest = shapes[0].d, shapes[0].rows, shapes[0].n
    good = good.where(F.size("v") == width)
    shards = max(1, -(-rows // shard_rows))
    queries = good.where(is_query(F.col("vec_id")))
    n_queries = queries.count()
    blocks = max(1, -(-n_queries // block_rows))

    # every shard's vectors, and a copy of every block of queries beside them: (shard, block) is a task's group
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    left = good.select(spread.alias("shard"), F.lit(False).alias("asks"), "vec_id", "v").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.select(block.alias("block"), F.lit(True).alias("asks"), "vec_id", "v").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def nearest(key, table):
        asks = np.asarray(table.column("asks").combine_chunks().to_numpy(zero_copy_only=False))
        ids, m = np.asarray(table.column("vec_id")), _matrix(table.column("v"))
        base, base_ids, ask, ask_ids = m[~asks], ids[~asks], m[asks], ids[asks]
        out: list[np.ndarray] = []
        if len(base) and len(ask):
            # copies of a vector count once, so that a run of copies is not taken for many candidates
            order = np.lexsort((base_ids, *base.T[::-1]))
            base, base_ids = base[order] + 0.0, base_ids[order]
            first = np.flatnonzero(np.concatenate([[True], (base[1:] != base[:-1]).any(axis=1)]))
            copies = np.minimum(np.diff(np.concatenate([first, [len(base)]])), k + 1)  # of each, the smallest ids
            distinct = base[first]
            lift = lambda x: np.hstack([x, np.sqrt(np.maximum(0, longest - (x * x).sum(axis=1)))[:, None]])
            forest = Forest(lift(distinct), trees, bits)
            enough = max(24 * k, int(np.ceil(share * len(distinct)))) + trees  # a query that is a row finds itself in each tree
            for q, found in enumerate(forest.candidates(np.hstack([ask, np.zeros((len(ask), 1))]), enough)):
                score = np.einsum("ij,j->i", distinct[found], ask[q])
                if len(found) > k + 1:
                    near = score >= np.partition(score, -k - 1)[-k - 1]
                    found, score = found[near], score[near]
                rows = np.repeat(first[found] - np.cumsum(copies[found]) + copies[found], copies[found]) + np.arange(copies[found].sum())
                score = np.repeat(score, copies[found])
                own = base_ids[rows] != ask_ids[q]
                rows, score = rows[own], score[own]
                top = np.lexsort((base_ids[rows], -score))[:k]
                out.append(np.rec.fromarrays([np.full(len(top), ask_ids[q]), base_ids[rows][top], score[top]], names="q,v,s"))
        got = np.concatenate(out) if out else np.rec.fromarrays([np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)], names="q,v,s")
        return pa.table({"query_id": pa.array(got["q"], pa.int64()), "vec_id": pa.array(got["v"], pa.int64()), "score": pa.array(got["s"], pa.float64())})

    parts = left.select("shard", "block", "asks", "vec_id", "v").unionByName(right.select("shard", "block", "asks", "vec_id", "v"))
    found = parts.groupBy("shard", "block").applyInArrow(nearest, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
