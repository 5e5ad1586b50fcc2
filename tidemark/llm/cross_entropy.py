"""Cross-entropy difference: how much more a text is like the target corpus than like the whole.

Two matched models, of the target documents and of all documents, share one vocabulary: every word of the whole corpus.
Each mixes, in the logarithm, a unigram and a bigram model with additive smoothing:

    loss(w | v) = (1 - MIX) * -ln((c(w) + ALPHA) / (N + ALPHA * V)) + MIX * -ln((c(v w) + MU / (V + 1)) / (c(v) + MU))

(V words; the end of a text is one more thing that may follow a word).  A document's score is the mean over its tokens of
target loss minus background loss: the lower, the more target-like.

Counts are exact and grow with the corpus; words and pairs are told apart by 64-bit hashes.  As the loss is a sum of terms
that each need one count, a document's terms can be looked up apart.  Fewer than ``heavy`` words, and as few pairs, occur
in more than a ``heavy``-th of all places: those words are broadcast, and those of the pairs that would also take up over
a fiftieth of a shard.  All others are sent, packed by slice of texts and shard of hash space, to where their shard is
counted, and the counts come back to the slice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Filter, Scratch, mix64, slices

#: Share of the bigram model; strength of its smoothing; what is added to each unigram count.
MIX, MU, ALPHA = 0.5, 16.0, 0.5
#: Broadcast words and pairs, at most (16 bytes each); places counted in one shard; bytes of text in one slice.
HEAVY, SHARD, SLICE = 1 << 20, 1_500_000, 3_000_000
#: What stands before a text's first word.
START = np.uint64(0)
ASKED = np.dtype([("event", "<u8"), ("row", "<u4"), ("n", "<u4"), ("m", "<i4"), ("mine", "<u4")])
TOLD = np.dtype([("row", "<u4"), ("n", "<u4"), ("m", "<i4"), ("all", "<u4"), ("target", "<u4")])


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class Hashes(dict):
    """word -> 64-bit hash, never that of START; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) or 1
        return h


def sequences(texts: list[str | None], hashes: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words in a row, the hash before each (START at a text's start), words of each text."""
    counts = np.zeros(len(texts), np.int64)
    parts = []
    for i, t in enumerate(texts):
        w = words(t)
        counts[i] = len(w)
        parts.append(np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w)))
    ids = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[(np.cumsum(counts) - counts)[counts > 0]] = START
    return ids, before, counts


def pairs(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return mix64(mix64(before) * np.uint64(3) + ids)


def pack(a: np.ndarray) -> bytes:
    """Byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes())


def unpack(data: bytes, kind: np.dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def grouped(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys, and the sum of each weight per key."""
    found, inverse = np.unique(keys, return_inverse=True)
    return found, *(np.bincount(inverse, w, len(found)).astype(np.int64) for w in weights)


class Known:
    """Exact counts of the broadcast words or pairs."""

    def __init__(self, rows: pa.Table):
        key = rows.column("key").to_numpy().view(np.uint64)
        order = np.argsort(key)
        self.key = key[order]
        self.all, self.target = (rows.column(c).to_numpy()[order].astype(np.uint32) for c in ("n", "tn"))

    def place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key is, and whether it is there at all."""
        if not len(self.key):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        return at, self.key[at] == keys


class Model:
    """The terms of a loss, each from one count."""

    def __init__(self, places: int, vocabulary: int):
        self.places, self.vocabulary = places, vocabulary

    def terms(self, n, m, c, pair) -> np.ndarray:
        """n occurrences of a pair; or n of a word, and m of it before another word."""
        c = np.asarray(c, np.float64)
        unigram = np.log(self.places + ALPHA * self.vocabulary) - np.log(c + ALPHA)
        return np.where(pair, -MIX * n * np.log(c + MU / (self.vocabulary + 1)), (1 - MIX) * n * unigram + MIX * np.maximum(m, 0) * np.log(c + MU))


def count(texts: DataFrame, choose) -> DataFrame:
    """key, n, tn: exact counts in all texts and in targets of the keys that ``choose(ids, before, counts)`` names."""

    def run(batches):
        hashes, held, size = Hashes(), [], 0

        def merged():
            return grouped(*(np.concatenate(x) for x in zip(*held)))

        def send(keys, n, tn):
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n), pa.array(tn)], ["key", "n", "tn"])

        for batch in batches:
            column = batch.column("text")
            mine = np.asarray(batch.column("target"))
            for a, b in slices(column, SLICE):
                ids, before, counts = sequences(column.slice(a, b - a).to_pylist(), hashes)
                flags = np.repeat(mine[a:b], counts).astype(np.int64)
                keys, picked = choose(ids, before)
                flags = flags[picked] if picked is not None else flags
                held.append(grouped(keys, np.ones(len(keys)), flags))
                size += len(held[-1][0])
                if size > 1_000_000:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 500_000:
                        yield send(*held.pop())
                        size = 0
        if held:
            yield send(*merged())

    return texts.mapInArrow(run, "key long, n long, tn long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("tn").alias("tn"))


def marked(docs: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, text and whether ``ids(doc_id)`` lists the row: only texts that a small filter can't tell apart are sent."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    maybe = Filter(ids, "doc_id").mark(source, "_maybe", "doc_id")
    listed = maybe.where("_maybe").select("doc_id", "text").join(ids.withColumn("target", F.lit(1)), "doc_id", "left")
    listed = scratch.table(listed.select("doc_id", "text", F.coalesce("target", F.lit(0)).alias("target")), "listed")
    return maybe.where("not _maybe").select("doc_id", "text", F.lit(0).alias("target")).unionByName(listed)


_ASK = "shard long, slice long, ids array<long>, counts array<long>, target array<double>, background array<double>, events binary"
_TELL = _ASK.partition(", ")[2]


def _ask(shared, shards: int):
    """Per slice of texts: its rows with the terms of broadcast counts, and what it asks each shard for."""

    def run(batches):
        heavy_words, heavy_pairs, models = shared.value
        hashes = Hashes()
        number = TaskContext.get().partitionId() << 32
        empty = {"ids": [], "counts": [], "target": [], "background": []}
        schema = pa.schema([(k, pa.int64()) for k in ("shard", "slice")] + [(k, pa.list_(pa.int64())) for k in ("ids", "counts")] + [(k, pa.list_(pa.float64())) for k in ("target", "background")] + [("events", pa.binary())])
        for batch in batches:
            column, mine = batch.column("text"), np.asarray(batch.column("target"))
            for a, b in slices(column, SLICE):
                number += 1
                ids, before, counts = sequences(column.slice(a, b - a).to_pylist(), hashes)
                row = np.repeat(np.arange(b - a), counts)
                last = np.zeros(len(ids), bool)
                last[np.cumsum(counts)[counts > 0] - 1] = True
                first = before == START
                both = pairs(before, ids)
                sums = np.zeros((2, b - a))
                asked = []
                for known, keys, n, m, pair in ((heavy_words, ids, 1, (~last).astype(np.int64), False), (heavy_pairs, both, 1, -1, True), (heavy_words, before[first], 0, 1, False)):
                    rows = row if n else row[first]
                    at, have = known.place(keys)
                    m = np.broadcast_to(m, len(keys))
                    for k, (model, c) in enumerate(zip(models, (known.target, known.all))):
                        sums[k] += np.bincount(rows[have], model.terms(n, m[have], c[at[have]], pair), b - a)
                    rest = ~have
                    new = np.zeros(int(rest.sum()), ASKED)
                    new["event"], new["row"], new["n"], new["m"] = keys[rest], rows[rest], n, m[rest]
                    asked.append(new)
                events = np.concatenate(asked)
                order = np.argsort(events["event"], kind="stable")
                events = events[order]
                if len(events):
                    starts = np.flatnonzero(np.concatenate([[True], (events["event"][1:] != events["event"][:-1]) | (events["row"][1:] != events["row"][:-1])]))
                    total = {c: np.add.reduceat(events[c].astype(np.int64), starts) for c in ("n", "m")}
                    events = events[starts]
                    pair = events["m"] < 0
                    events["n"], events["m"] = total["n"], np.where(pair, -1, total["m"])
                events["mine"] = mine[a:b][events["row"]]
                shard = (events["event"] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
                edges = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(events)]])
                out = [{"shard": int(shard[x]), "slice": number, "events": pack(events[x:y]), **empty} for x, y in zip(edges[:-1], edges[1:]) if y > x]
                out.append({"shard": number % shards, "slice": number, "ids": batch.column("doc_id").slice(a, b - a).to_pylist(), "counts": counts.tolist(), "target": sums[0].tolist(), "background": sums[1].tolist(), "events": None})
                yield from pa.Table.from_pylist(out, schema).to_batches()

    return run


def _tell(table: pa.Table) -> pa.Table:
    """One shard: counts all that was asked for, and answers each slice."""
    head = table.filter(pc.is_null(table.column("events"))).drop_columns(["shard"])
    asked = table.filter(pc.is_valid(table.column("events")))
    numbers = asked.column("slice").to_pylist()
    if not numbers:
        return head
    parts = [unpack(e.as_py(), ASKED) for e in asked.column("events")]
    sizes = [len(p) for p in parts]
    events = np.concatenate(parts)
    del parts
    _, inverse = np.unique(events["event"], return_inverse=True)
    total = [np.bincount(inverse, events["n"] * w)[inverse] for w in (np.ones(1), events["mine"])]
    told = np.zeros(len(events), TOLD)
    for c in ("row", "n", "m"):
        told[c] = events[c]
    told["all"], told["target"] = total
    ends = np.cumsum(sizes).tolist()
    rows = [{"slice": number, "ids": [], "counts": [], "target": [], "background": [], "events": pack(told[end - size : end])} for number, size, end in zip(numbers, sizes, ends)]
    return pa.concat_tables([head, pa.Table.from_pylist(rows, head.schema)])


def cross_entropy_difference(spark: SparkSession, docs: DataFrame, target_ids: DataFrame, heavy: int = HEAVY, per_shard: int = SHARD) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, target_loss, background_loss, score (means per token; null without tokens).

    ``target_ids(doc_id)`` lists the target documents (rows that share a listed doc_id are all targets).  Repeated rows count
    each time; null texts have no tokens; without targets the target model is uniform.  Other columns are not read.
    The result does not depend on ``heavy`` (words and pairs broadcast, at most) or ``per_shard`` (places in a task).
    ``docs`` must be a table (a scan), so that a task that is run again sees its rows in the same order.
    """
    scratch = Scratch(spark, "cross-entropy")
    wanted = target_ids.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    texts = marked(docs, wanted, scratch)

    def one(ids, before):
        """Each word, and each text's start."""
        first = before == START
        return np.concatenate([ids, before[first]]), np.concatenate([np.arange(len(ids)), np.flatnonzero(first)])

    counted = scratch.table(count(texts, one), "words")
    scratch.release(2)
    word = F.col("key") != int(START)
    size = counted.where(word).agg(F.count("*").alias("v"), F.sum("n").alias("n"), F.sum("tn").alias("tn")).first()
    places = size.n or 0
    models = Model(size.tn or 0, size.v), Model(places, size.v)
    # fewer than ``heavy`` keys can have more than places / heavy occurrences
    many = F.col("n") > places // heavy
    heavy_words = Known(counted.where(many | ~word).toArrow())
    # a shard has room for pairs of up to a fiftieth of it, so that few need to be counted twice
    many = F.col("n") > max(places // heavy, per_shard // 50)
    paired = spark.sparkContext.broadcast(Known(counted.where(many | ~word).toArrow()))

    def two(ids, before):
        """Each pair of two frequent words: no other pair can be as frequent."""
        picked = np.flatnonzero(paired.value.place(ids)[1] & paired.value.place(before)[1])
        return pairs(before[picked], ids[picked]), picked

    heavy_pairs = Known(count(texts, two).where(many).toArrow())
    scratch.release(2)
    shared = spark.sparkContext.broadcast((heavy_words, heavy_pairs, models))
    shards = places * 2 // per_shard + 1

    def tell(table):
        return _tell(table)

    def finish(table):
        sums = counts = ids = None
        add = []
        for r in table.select(["ids", "counts", "target", "background", "events"]).to_pylist():
            if r["events"] is None:
                ids, counts, sums = r["ids"], np.asarray(r["counts"]), np.asarray([r["target"], r["background"]])
            else:
                add.append(r["events"])
        for data in add:
            e = unpack(data, TOLD)
            for k, (model, c) in enumerate(zip(models, (e["target"], e["all"]))):
                sums[k] += np.bincount(e["row"], model.terms(e["n"].astype(np.float64), e["m"], c, e["m"] < 0), len(counts))
        means = sums / np.maximum(counts, 1)
        rounded = [np.round(x, 6) for x in (*means, means[0] - means[1])]
        return pa.table([pa.array(ids, pa.int64()), pa.array(counts), *(pa.array(x, pa.float64(), mask=counts == 0) for x in rounded)], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    told = texts.mapInArrow(_ask(shared, shards), _ASK).groupBy("shard").applyInArrow(tell, _TELL)
    return told.groupBy("slice").applyInArrow(finish, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
