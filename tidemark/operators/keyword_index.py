"""A stored keyword index of immutable segments.

``add`` and ``remove`` write one small segment in one commit; what they replace is only marked dead.  Segments of like size are merged,
and the dead left out, when there are several.  Scores are those of ``keyword.search`` over the live chunks, whatever the
order of changes.

Tables of a ``Store``, for segment n: ``<name>.<n>.postings`` (key, term, class, chunk_id, tf, dl; dealt by term and class, each file in
order of key, a hash of the term, which takes no comparison of strings), ``.blocks`` (term, class, n, max_tf, min_dl), ``.chunks`` (chunk_id, dl, content, counts: its terms and how often each occurs),
``.dead`` (chunk_id, dl, counts: dead in segments before n); and ``<name>.stats`` (one row).

A text is cut into terms once, when its chunk is written; whatever follows reads the chunk's counts.

A block is the postings of a term whose tf and dl are of one class; its greatest tf and least dl bound what any of its chunks
can gain.  A search scores the most promising blocks first; a block is read only if its bound and the best blocks of the
other terms together could reach what the k-th chunk has by then.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import tokenize_cjk_literal
from ..session import prepare
from ..sources.store import Store, Transaction, latest
from . import keyword

PARTS = ("chunks", "postings", "blocks", "dead")
#: So many of the newest segments at least are merged at once, if the oldest of them is no larger than the others together.
FAN = 4
#: Scores are compared after rounding to six digits.
_SLACK = 1e-5
#: A first look at each term's best blocks ends when they hold so many times top_k postings.
_FIRST = 4
#: A task that sorts postings gets about so many words of text, a batch of counted chunks about so many characters.
_TASK_WORDS, _BATCH_CHARS = 4_000_000, 4_000_000
_COUNTED = "dl int, content string, counts array<struct<term: string, tf: bigint>>"


def block_class(tf: Column, dl: Column) -> Column:
    """A number for like tf and dl: each occurrence count up to 8, then powers of two; lengths by half powers of two."""
    often = F.when(tf <= 8, tf).otherwise(F.floor(F.log2(tf)) + 6)
    return (often * 256 + F.floor(2 * F.log2(dl + 1))).cast("int")


def _key(term: Column) -> Column:
    return F.xxhash64(term)


def counted(chunks: DataFrame, tokens: Callable[[str], list[str]]) -> DataFrame:
    """chunk_id, dl, content, counts. Each row by itself; a task holds some texts at a time."""
    prepare(chunks.sparkSession)
    schema = StructType([*chunks.select("chunk_id").schema, *StructType.fromDDL(_COUNTED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())]))

        def told(batch: pa.RecordBatch, lengths: list[int], counts: list[Counter]) -> pa.RecordBatch:
            offsets = [0]
            for c in counts:
                offsets.append(offsets[-1] + len(c))
            terms, tfs = pa.array([t for c in counts for t in c], pa.string()), pa.array([n for c in counts for n in c.values()], pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([terms, tfs], ["term", "tf"])).cast(kind)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int32()), batch.column(1), lists], schema.names)

        for batch in batches:
            first, chars, lengths, counts = 0, 0, [], []
            for at, content in enumerate(batch.column(1)):
                text = content.as_py() or ""
                words = tokens(text)
                lengths.append(len(words))
                counts.append(Counter(words))
                chars += len(text)
                if chars >= _BATCH_CHARS:
                    yield told(batch.slice(first, at + 1 - first), lengths, counts)
                    first, chars, lengths, counts = at + 1, 0, [], []
            if counts:
                yield told(batch.slice(first), lengths, counts)

    return chunks.select("chunk_id", F.col("content").cast("string").alias("content")).mapInArrow(run, schema)


class KeywordIndex:
    def __init__(self, store: Store, name: str = "keyword", literal: Callable[[str], list[str]] = tokenize_cjk_literal):
        self.store, self.name, self.literal = store, name, literal

    # tables

    def _segments(self, t: Transaction) -> list[int]:
        head = f"{self.name}."
        return sorted({int(n[len(head) :].split(".")[0]) for n in t.tables if n.startswith(head) and n[len(head)].isdigit()})

    def _all(self, t: Transaction, part: str, segments: list[int] | None = None) -> DataFrame | None:
        """A table of all segments, with the column ``segment``."""
        names = [n for n in (self._segments(t) if segments is None else segments) if f"{self.name}.{n}.{part}" in t.tables]
        frames = [t.read(f"{self.name}.{n}.{part}").withColumn("segment", F.lit(n)) for n in names]
        return reduce(DataFrame.unionByName, frames) if frames else None

    def _live(self, t: Transaction, rows: DataFrame, segments: list[int] | None = None) -> DataFrame:
        """Rows(chunk_id, segment) that no later segment (of ``segments``) has marked dead."""
        dead = self._all(t, "dead", segments)
        if dead is None:
            return rows
        last = dead.groupBy(F.col("chunk_id").alias("_dead")).agg(F.max("segment").alias("_until"))
        return rows.join(last, (F.col("chunk_id") == F.col("_dead")) & (F.col("segment") < F.col("_until")), "left_anti")

    @staticmethod
    def _posted(chunks: DataFrame) -> DataFrame:
        rows = chunks.select("chunk_id", "dl", F.inline("counts"))
        return rows.select("term", block_class(F.col("tf"), F.col("dl")).alias("class"), "chunk_id", "tf", "dl")

    def _dealt(self, postings: DataFrame, chunks: DataFrame) -> DataFrame:
        """Postings by term and class, in order within each of so many tasks as the words of ``chunks`` need; no other pass over them."""
        spark = postings.sparkSession
        words = chunks.agg(F.sum("dl")).first()[0] or 0
        tasks = -(-words // _TASK_WORDS)
        number = [tasks] if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else []  # else Spark may join small ones
        dealt = postings.select("term", "class", "chunk_id", "tf", "dl").repartition(*number, "term", "class")
        return dealt.select(_key(F.col("term")).alias("key"), "*").sortWithinPartitions("key")

    @staticmethod
    def _blocks(postings: DataFrame) -> DataFrame:
        return postings.groupBy("term", "class").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))

    # changes

    def _change(self, chunks: DataFrame | None, gone: DataFrame | None, *, anew: bool = False) -> None:
        t = self.store.begin()
        t.exists(f"{self.name}.stats")
        if anew:
            self._cleared(t)
        segments = self._segments(t)
        n = 1 + max(segments, default=0)
        if gone is not None and segments:
            known = self._live(t, self._all(t, "chunks")).join(gone.select("chunk_id").distinct(), "chunk_id", "left_semi")
            dead = t.write(f"{self.name}.{n}.dead", known.select("chunk_id", "dl", "counts"))
            lost = self._lost(dead)
        if chunks is not None:
            rows = chunks.select("chunk_id", "content")
            if not rows.groupBy("chunk_id").count().where("count > 1").isEmpty():
                rows = latest(rows, ["chunk_id"])
            rows = t.write(f"{self.name}.{n}.chunks", counted(rows, self.literal))
            postings = t.write(f"{self.name}.{n}.postings", self._dealt(self._posted(rows), rows))
            blocks = self._blocks(postings)
            if gone is not None and segments:
                blocks = blocks.unionByName(lost)
            t.write(f"{self.name}.{n}.blocks", blocks.sortWithinPartitions("term"))
        elif gone is not None and segments:
            t.write(f"{self.name}.{n}.blocks", lost.sortWithinPartitions("term"))
        self._counted(t)
        self._merge(t)
        t.commit()

    def _counted(self, t: Transaction) -> None:
        """One row: n, total, avgdl, mean_idf of the live chunks."""
        have, dead = self._all(t, "chunks"), self._all(t, "dead")
        rows = have.select(F.lit(1).alias("n"), "dl")
        if dead is not None:
            rows = rows.unionByName(dead.select(F.lit(-1).alias("n"), (-F.col("dl")).alias("dl")))
        size = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"))
        df = self._all(t, "blocks").groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")
        mean = df.crossJoin(F.broadcast(size)).agg(F.avg(F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("mean_idf"))
        t.write(f"{self.name}.stats", size.crossJoin(mean).withColumn("avgdl", F.when(F.col("n") > 0, F.col("total").cast("double") / F.col("n"))))

    def _merge(self, t: Transaction) -> None:
        """Merge the newest segments, as many as are together no smaller than the oldest of them, if these are FAN or more."""
        segments = self._segments(t)
        if len(segments) < FAN:
            return
        rows = self._all(t, "blocks").groupBy("segment").agg(F.sum(F.abs("n")).alias("n")).collect()  # one a segment
        sizes = [dict(map(tuple, rows)).get(s, 0) for s in segments]
        first = next((k for k in range(len(segments) - FAN + 1) if sizes[k] <= sum(sizes[k + 1 :])), None)
        if first is not None:
            self._merged(t, segments[first:])

    def _merged(self, t: Transaction, run: list[int]) -> None:
        """One segment in place of ``run``, under the last one's number. Rows that a mark of the run killed go together with the mark, so that
        sums over blocks stay those of the live chunks; marks of rows in older segments stay."""
        last, staged = run[-1], {}
        chunks, postings, dead = (self._all(t, part, run) for part in ("chunks", "postings", "dead"))
        if chunks is not None:
            staged["chunks"] = self._live(t, chunks, run).select("chunk_id", "dl", "content", "counts")
            staged["postings"] = self._dealt(self._live(t, postings, run), chunks)
        if dead is not None and run[0] != self._segments(t)[0]:
            marks = dead
            if chunks is not None:  # a mark that follows a row of its chunk in this run has met that row
                met = dead.join(chunks.select("chunk_id", F.col("segment").alias("_of")), "chunk_id").where("_of < segment").select("chunk_id", "segment").distinct()
                marks = dead.join(met, ["chunk_id", "segment"], "left_anti")
            staged["dead"] = marks.select("chunk_id", "dl", "counts")
        tables = {part: t.write(f"{self.name}.merged.{part}", df) for part, df in staged.items()}
        blocks = [self._blocks(tables["postings"])] if "postings" in tables else []
        if "dead" in tables:
            blocks.append(self._lost(tables["dead"]))
        if blocks:
            tables["blocks"] = t.write(f"{self.name}.merged.blocks", reduce(DataFrame.unionByName, blocks).sortWithinPartitions("term"))
        for n in run:
            for part in PARTS:
                t.drop(f"{self.name}.{n}.{part}")
        for part in tables:
            t.rename(f"{self.name}.merged.{part}", f"{self.name}.{last}.{part}")

    def _lost(self, dead: DataFrame) -> DataFrame:
        """What goes, counted with a minus, so that sums over all blocks are those of the live chunks; it bounds nothing."""
        return self._blocks(self._posted(dead)).select("term", "class", (-F.col("n")).alias("n"), F.lit(None).cast("long").alias("max_tf"), F.lit(None).cast("int").alias("min_dl"))

    def _cleared(self, t: Transaction) -> None:
        for n in self._segments(t):
            for part in PARTS:
                t.drop(f"{self.name}.{n}.{part}")

    @property
    def exists(self) -> bool:
        return self.store.exists(f"{self.name}.stats")

    @property
    def segments(self) -> list[int]:
        return self._segments(self.store.begin())

    def build(self, chunks: DataFrame) -> None:
        """The index of ``chunks(chunk_id, content)``, in place of what was there. Of repeated chunk_ids one stays (``latest``); null contents have no terms."""
        self._change(chunks, None, anew=True)

    def add(self, chunks: DataFrame) -> None:
        """Add chunks, or replace those whose chunk_id is known."""
        self._change(chunks, chunks)

    def remove(self, ids: DataFrame) -> None:
        """Remove the listed chunk_ids; unknown and repeated ones are harmless."""
        if self.exists:
            self._change(None, ids)

    def clear(self) -> None:
        t = self.store.begin()
        self._cleared(t)
        t.drop(f"{self.name}.stats")
        t.commit()

    @property
    def size(self) -> int:
        return self.store.read(f"{self.name}.stats").first().n if self.exists else 0

    def search(self, query: str, top_k: int = 20, threshold: float = 0.0, *, pad: bool = True) -> DataFrame:
        """chunk_id, score, content: as ``keyword.search`` over the indexed chunks.

        The blocks of the query's terms come to the driver first (a query's terms times some hundred classes times the segments, whose number
        grows with the logarithm of the chunks), then one job scores the best of them; the rest is a lazy plan.
        """
        t = self.store.begin()
        chunks = self._all(t, "chunks")
        wanted = Counter(self.literal(query))
        if not wanted:
            return chunks.select("chunk_id", F.lit(0.0).alias("score"), "content").limit(0)
        chunks = self._live(t, chunks)
        stats = t.read(f"{self.name}.stats").first()
        blocks = self._all(t, "blocks").where(F.col("term").isin(list(wanted))).collect()
        df: Counter = Counter()
        for b in blocks:
            df[b.term] += b.n
        raw = {term: math.log(stats.n - n + 0.5) - math.log(n + 0.5) for term, n in df.items() if n > 0}
        weight = {term: wanted[term] * (idf if idf >= 0 else keyword.EPSILON * stats.mean_idf) for term, idf in raw.items()}
        bounded = [(b, _gain(weight[b.term], b.max_tf, b.min_dl, stats.avgdl)) for b in blocks if b.max_tf is not None and b.term in weight]
        reached = self._reached(t, bounded, weight, stats.avgdl, top_k)
        if reached is not None:
            top: dict[str, float] = {}
            for b, bound in bounded:
                top[b.term] = max(top.get(b.term, 0.0), bound)
            bounded = [(b, bound) for b, bound in bounded if bound + sum(top.values()) - top[b.term] >= reached - _SLACK]
        found = self._scored(t, [b for b, _ in bounded], weight, stats.avgdl).select("chunk_id", F.round("score", 6).alias("score"))
        if pad and threshold <= 0 and reached is None:
            # chunks without a term score 0: they count only if the others leave room, in order of chunk_id
            rest = chunks.select("chunk_id").join(found, "chunk_id", "left_anti").orderBy("chunk_id").limit(top_k)
            found = found.unionByName(rest.withColumn("score", F.lit(0.0)))
        best = found.where(F.col("score") >= threshold).orderBy(F.desc("score"), "chunk_id").limit(top_k)
        return chunks.select("chunk_id", "content").join(F.broadcast(best), "chunk_id").select("chunk_id", "score", "content").orderBy(F.desc("score"), "chunk_id")

    def _reached(self, t: Transaction, bounded: list, weight: dict[str, float], avgdl: float, top_k: int) -> float | None:
        """What ``top_k`` chunks have at least, by the best blocks of each term; None if nothing may be left out: all blocks are among the best,
        too few chunks have been found, or a weight is negative."""
        if min(weight.values(), default=0.0) < 0:
            return None
        first, held = [], Counter()
        for b, _ in sorted(bounded, key=lambda x: (-x[1], x[0].segment, x[0]["class"])):
            if held[b.term] < _FIRST * top_k:
                first.append(b)
                held[b.term] += b.n
        if len(first) == len(bounded):
            return None
        seen = self._scored(t, first, weight, avgdl).orderBy(F.desc("score")).limit(top_k).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
        return seen.least if seen.n == top_k and seen.least > 0 else None

    def _scored(self, t: Transaction, blocks: list, weight: dict[str, float], avgdl: float) -> DataFrame:
        """chunk_id, score from the postings of these blocks."""
        postings = self._all(t, "postings")
        asked = t.spark.createDataFrame([(b.segment, b.term, b["class"], weight[b.term]) for b in blocks], "segment int, term string, class int, weight double")
        terms = sorted({b.term for b in blocks})
        read = postings.where(F.col("key").isin([_key(F.lit(x)) for x in terms]) & F.col("term").isin(terms)).join(F.broadcast(asked), ["segment", "term", "class"])
        return self._live(t, read).groupBy("chunk_id").agg(F.sum(_gain(F.col("weight"), F.col("tf"), F.col("dl"), avgdl)).alias("score"))


def _gain(weight, tf, dl, avgdl: float):
    k1, b = keyword.K1, keyword.B
    return weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
