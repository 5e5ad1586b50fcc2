"""Ranked lexical search over a tiered index.

Documents lie in shards of some megabytes of text; a shard keeps the postings of each of its terms by falling impact, cut into tiers,
and for each term and tier the greatest impact that lies further down (the residual bound).  A search reads the first tier
of all shards.  What a document has scored so far is a lower bound of its score; adding the residual bounds of its other
terms gives an upper one.  An item is proven when its ten best so far are known in full and no other document's upper bound
comes up to the tenth; items that aren't fall through to the next tier.  The last tier holds all that is left.

A term's weight in the collection is w = floor(1000 ln((2N + 2) / (2 df + 1))); an occurrence count tf in a document of n terms has the impact
1000000000 tf div (1000 tf + 8 m) with m = 25 + 75 n N div L.  Scores are 64-bit integers.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, slices
from .decontaminate import words

#: Bytes of text in a shard, and postings of a term in each tier but the last (the last has the rest).
SHARD, TIERS = 4_000_000, (8, 64)
#: Shards in a file: what a task reads of them, or holds to be written, at once.
SHARDS_IN_FILE = 4
#: Bytes of query text that are broadcast at once; more are searched for in several rounds.
MOST_ITEM_BYTES = 4 << 20
_RAW = "doc_ids binary, sizes binary, terms array<binary>, df array<int>, docs binary, tf binary"
_LAST = len(TIERS)
_KEPT = ["doc_ids", "m", "terms", *[f"{c}_{k}" for k in range(_LAST + 1) for c in ("n", "rest", "docs", "impact")]]
_INDEX = ", ".join(f"{c} {'array<binary>' if c == 'terms' else 'binary'}" for c in _KEPT)


@dataclass
class TieredIndex:
    """Tables in the shared folder: one row a shard, and term, df of the collection; n, its documents with terms, and length, their terms."""

    shards: DataFrame
    vocabulary: DataFrame
    n: int
    length: int


def build(spark: SparkSession, docs: DataFrame, scratch: Scratch | None = None) -> TieredIndex:
    """The index of ``docs(doc_id, text)``: every term of every whole text.

    Rows without a doc_id or without terms (null and empty texts) take no part; each of several rows of a doc_id is a document.
    """
    scratch = scratch or Scratch(spark, "tiered-index")
    raw = scratch.table(docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_inverted, _RAW), "raw", SHARDS_IN_FILE)
    pairs = raw.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select("x.terms", "x.df")
    vocabulary = scratch.table(pairs.groupBy(F.col("terms").alias("term")).agg(F.sum("df").alias("df")), "vocabulary")
    n, length = _totals(raw)
    shards = scratch.table(raw.mapInArrow(_tiered(n, length), _INDEX), "shards", SHARDS_IN_FILE)
    scratch.drop(raw)
    return TieredIndex(shards, vocabulary, n, length)


def _inverted(batches):
    """Shards: documents with their numbers of terms, and for each term its documents (by place in the shard) and counts."""
    ids: list[int] = []
    sizes: list[int] = []
    tokens: list[bytes] = []
    held = 0

    def shard():
        number: dict[bytes, int] = {}
        term = np.fromiter((number.setdefault(w, len(number)) for w in tokens), np.int64, len(tokens))
        doc = np.repeat(np.arange(len(ids)), sizes)
        key, tf = np.unique(term * len(ids) + doc, return_counts=True)
        df = np.bincount(key // len(ids), minlength=len(number))
        terms = pa.ListArray.from_arrays(pa.array([0, len(number)], pa.int32()), pa.array(list(number), pa.binary()))
        dfs = pa.ListArray.from_arrays(pa.array([0, len(number)], pa.int32()), pa.array(df, pa.int32()))
        blobs = [np.asarray(ids, "<i8"), np.asarray(sizes, "<u4"), (key % len(ids)).astype("<u4"), tf.astype("<u4")]
        a, b, c, d = (pa.array([x.tobytes()], pa.binary()) for x in blobs)
        return pa.RecordBatch.from_arrays([a, b, terms, dfs, c, d], ["doc_ids", "sizes", "terms", "df", "docs", "tf"])

    for batch in batches:
        doc_ids = batch.column("doc_id").to_pylist()
        for at, to in slices(batch.column("text"), SHARD):
            for i, t in zip(doc_ids[at:to], batch.column("text").slice(at, to - at).to_pylist()):
                if w := words(t):
                    ids.append(i)
                    sizes.append(len(w))
                    tokens += w
                    held += len(t)
                    if held >= SHARD:
                        yield shard()
                        ids, sizes, tokens, held = [], [], [], 0
    if ids:
        yield shard()


def _totals(raw: DataFrame) -> tuple[int, int]:
    def run(batches):
        for batch in batches:
            n = [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column("sizes")]
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, n))], pa.int64()), pa.array([sum(int(x.sum(dtype=np.int64)) for x in n)], pa.int64())], ["n", "length"])

    row = raw.select("sizes").mapInArrow(run, "n long, length long").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).first()
    return row.n or 0, row.length or 0


def _tiered(n: int, length: int):
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                blob = lambda c, kind: np.frombuffer(batch.column(c)[row].as_buffer(), kind)
                m = 25 + 75 * blob("sizes", "<u4").astype(np.int64) * n // length
                docs, tf = blob("docs", "<u4").astype(np.int64), blob("tf", "<u4").astype(np.int64)
                df = batch.column("df").slice(row, 1).flatten().to_numpy()
                impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[docs])
                term = np.repeat(np.arange(len(df)), df)
                order = np.lexsort([-impact, term])  # postings lie by term already
                docs, impact = docs[order], impact[order]
                first = np.cumsum(df) - df
                place = np.arange(len(docs)) - np.repeat(first, df)
                cols, low = [], 0
                for k in range(_LAST + 1):
                    high = TIERS[k] if k < _LAST else np.iinfo(np.int64).max
                    mine = (place >= low) & (place < high)
                    more = df > high
                    rest = np.zeros(len(df), np.int64)
                    rest[more] = impact[(first + min(high, len(docs)))[more]]
                    cols += [np.clip(df - low, 0, high - low).astype("<u4"), rest.astype("<u4"), docs[mine].astype("<u4"), impact[mine].astype("<u4")]
                    low = high
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids").slice(row, 1), pa.array([m.tobytes()], pa.binary()), batch.column("terms").slice(row, 1), *[pa.array([c.tobytes()], pa.binary()) for c in cols]], _KEPT)

    return run


@dataclass
class _Items:
    """A block of items: distinct terms, and for each item the places of its terms among them, with weight x repeats."""

    terms: list[bytes]
    at: list[np.ndarray]
    worth: list[np.ndarray]


def _blocks(items: DataFrame) -> int:
    total = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0] or 0
    return int(total // MOST_ITEM_BYTES) + 1


def search(spark: SparkSession, index: TieredIndex, items: DataFrame, top: int = 10, report: list | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of ``items(item_id, text)`` its ``top`` documents with a score above 0, equal scores
    by doc_id.  Items without terms, or whose terms no document has, have no rows; of several rows of an item_id each is ranked
    by itself.  ``report`` gets, for each block of items, how many each tier settled.
    """
    scratch, out = Scratch(spark, "tiered-search"), None
    rows = items.select("item_id", "text")
    blocks = _blocks(rows)
    for b in range(blocks):
        mine = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        found = _search_block(spark, index, mine, rows.schema["item_id"].dataType, top, scratch, report)
        out = found if out is None else out.unionByName(found)
    return out


def _search_block(spark, index: TieredIndex, rows: DataFrame, id_type, top: int, scratch: Scratch, report) -> DataFrame:
    given = [(r.item_id, Counter(words(r.text))) for r in rows.collect()]  # at most some MOST_ITEM_BYTES of text
    every = sorted({t for _, c in given for t in c})
    asked = spark.createDataFrame([(t,) for t in every], "term binary")
    df = {bytes(r.term): r.df for r in index.vocabulary.join(F.broadcast(asked), "term", "left_semi").collect()}
    weight = {t: math.floor(1000 * math.log((2 * index.n + 2) / (2 * n + 1))) for t, n in df.items()}
    terms = [t for t in every if weight.get(t, 0) > 0]
    place = {t: k for k, t in enumerate(terms)}
    at = [np.asarray([place[t] for t in c if t in place], np.int64) for _, c in given]
    worth = [np.asarray([weight[t] * k for t, k in c.items() if t in place], np.int64) for _, c in given]
    named = spark.createDataFrame(list(enumerate(g[0] for g in given)), f"item int, item_id {id_type.simpleString()}")
    asking = [k for k in range(len(given)) if len(at[k])]
    floor, settled, tables = np.zeros(len(given), np.int64), [], []
    for tier in range(_LAST + 1):
        if not asking:
            break
        value = spark.sparkContext.broadcast((_Items(terms, at, worth), asking, floor))
        found = index.shards.select(*_KEPT[: 3 + 4 * (tier + 1)]).mapInArrow(_scorer(value, tier, top), "item int, doc_id long, low long, high long, rest long")
        best = scratch.table(_best(scratch.table(found, f"found-{tier}"), top), f"tier-{tier}")
        if tier == _LAST:
            proven = set(asking)
        else:
            state = best.groupBy("item").agg(F.count("doc_id").alias("n"), F.min("low").alias("least"), F.max(F.col("high") - F.col("low")).alias("open"), F.max("rest").alias("rest")).collect()
            proven = set()
            for r in state:  # one row an item of the block
                if r.n == top:
                    floor[r.item] = max(floor[r.item], r.least)
                if not r.open and (not r.rest or (r.n == top and r.rest < r.least)):
                    proven.add(r.item)
        settled.append(len(proven))
        keep = spark.createDataFrame([(k,) for k in sorted(proven)], "item int")
        tables.append(best.where("low > 0").join(F.broadcast(keep), "item", "left_semi").select("item", F.col("place").alias("rank"), "doc_id", F.col("low").alias("score")))
        asking = [k for k in asking if k not in proven]
    if report is not None:
        report.append(settled)
    empty = spark.createDataFrame([], "item int, rank int, doc_id long, score long")
    for t in tables:
        empty = empty.unionByName(t)
    return empty.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")


def _best(found: DataFrame, top: int) -> DataFrame:
    """item, place, doc_id, low, high: the first ``top`` documents of each item by lower bound and doc_id; rest: the upper bound of all
    others.  Ranked first in 64 parts of each item, so that no task sees what all shards found for one."""
    order = [F.desc("low"), F.asc("doc_id")]
    parts = found.where(F.col("doc_id").isNotNull()).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    parts = parts.withColumn("at", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order)))
    whole = parts.where(F.col("at") <= top).withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    beyond = parts.where(F.col("at") > top).select("item", F.col("high").alias("rest"))
    beyond = beyond.unionByName(whole.where(F.col("place") > top).select("item", F.col("high").alias("rest"))).unionByName(found.select("item", "rest"))
    return whole.where(F.col("place") <= top).select("item", "place", "doc_id", "low", "high").join(beyond.groupBy("item").agg(F.max("rest").alias("rest")), "item", "right")


def _scorer(value, tier: int, top: int):
    """For each shard and item: the ``top`` best documents by what tiers up to ``tier`` tell, with lower and upper bound, and the greatest
    upper bound of the shard's other documents (``rest``)."""

    def run(batches):
        items, asking, floor = value.value
        asked = pa.array(items.terms, pa.binary())
        for batch in batches:
            for row in range(batch.num_rows):
                blob = lambda c, kind: np.frombuffer(batch.column(c)[row].as_buffer(), kind)
                doc_ids = blob("doc_ids", "<i8")
                known = pc.index_in(batch.column("terms").slice(row, 1).flatten(), asked)
                here = np.full(len(items.terms), -1, np.int64)
                where = np.flatnonzero(pc.is_valid(known).to_numpy(zero_copy_only=False))
                here[known.drop_null().to_numpy()] = where
                lists = []
                for k in range(tier + 1):
                    n = blob(f"n_{k}", "<u4").astype(np.int64)
                    lists.append((np.cumsum(n) - n, n, blob(f"docs_{k}", "<u4"), blob(f"impact_{k}", "<u4")))
                residual = blob(f"rest_{tier}", "<u4").astype(np.int64)
                yield _shard(doc_ids, here, lists, residual, items, asking, floor, top)

    return run


def _shard(doc_ids, here, lists, residual, items: _Items, asking, floor, top: int) -> pa.RecordBatch:
    out: list[list] = [[], [], [], [], []]
    for item in asking:
        place = here[items.at[item]]
        there = place >= 0
        place, worth = place[there], items.worth[item][there]
        if not len(place):
            continue
        bound = int((worth * residual[place]).sum())
        docs, gain, less = [], [], []
        for start, n, doc, impact in lists:
            size = n[place]
            ends = np.cumsum(size)
            at = np.repeat(start[place] - ends + size, size) + np.arange(int(ends[-1]))
            each, left = np.repeat(worth, size), np.repeat(residual[place], size)
            docs.append(doc[at])
            gain.append(each * impact[at].astype(np.int64))
            less.append(each * left)
        docs, gain, less = map(np.concatenate, (docs, gain, less))
        seen, back = np.unique(docs, return_inverse=True)
        low, down = _added(back, gain, len(seen)), _added(back, less, len(seen))
        high = low + bound - down
        order = np.lexsort([doc_ids[seen], -low])
        best = order[:top]
        best = best[high[best] >= floor[item]]
        others = int(high[order[top:]].max()) if len(order) > top else 0
        if len(seen) < len(doc_ids):
            others = max(others, bound)
        if not len(best):
            out[0].append(np.asarray([item]))
            for k, x in enumerate((None, 0, 0, others), 1):
                out[k].append([x])
            continue
        out[0].append(np.full(len(best), item))
        for k, x in enumerate((doc_ids[seen[best]].tolist(), low[best].tolist(), high[best].tolist(), [others] * len(best)), 1):
            out[k].append(x)
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([int(v) if v is not None else None for x in col for v in x], kind) for col, kind in zip(out, kinds)], ["item", "doc_id", "low", "high", "rest"])


def _added(where: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of 64-bit integers by place."""
    if len(x) and int(x.max()) * len(x) < 2**53:
        return np.bincount(where, weights=x, minlength=n).astype(np.int64)
    out = np.zeros(n, np.int64)
    np.add.at(out, where, x)
    return out


def ranked_search(spark: SparkSession, docs: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """``build`` and ``search`` in one."""
    return search(spark, build(spark, docs), items, top)
