"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned for in training texts.

Normalisation lower-cases A-Z and takes as words the runs of digits, ASCII letters and all characters from U+0080 on.
A window is ``n`` consecutive words of an item; an item of fewer words (but some) is one window of its own length.

What is broadcast is the text of items, a bounded part at a time; each worker makes the hash set of it.  The hits of several parts, which are
all found in the texts as they came in, are written down part by part and united.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Filter, Scratch, fresh, held, slices, window_hashes

#: Bytes of benchmark text that one broadcast may hold (its hash set takes some 20 bytes a window and what Python needs for its vocabulary).
#: A larger benchmark is scanned for in several parts, one pass each.
MOST_ITEM_BYTES = 8 << 20
#: A longer item is dealt to the parts in pieces of about so many bytes, which share all but one word of a window with the next.
PIECE_BYTES = 64 << 10

#: Fixed by the definition of a word: bytes that separate words become spaces, A-Z become a-z.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


class WindowSet:
    """The windows of some items: word numbers and, per window length, sorted hashes of the different windows, where the words of each stand
    (to verify hits), and the items that have it."""

    def __init__(self, items: list[tuple[object, str | None]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = [item for item, _ in items]
        ids = [np.asarray([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], np.int64) for _, text in items]
        self.words = np.concatenate([np.empty(0, np.int64), *ids])
        counts = np.asarray([len(x) for x in ids], np.int64)
        begins = np.cumsum(counts) - counts
        self.lengths: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for size in np.unique(np.minimum(counts[counts > 0], n)).tolist():
            mine = np.flatnonzero(np.minimum(counts, n) == size)
            starts = np.concatenate([np.arange(begins[k], begins[k] + counts[k] - size + 1) for k in mine])
            owner = np.repeat(mine, counts[mine] - size + 1)
            hashes = window_hashes(self.words, size)[starts]
            order = np.lexsort((owner, hashes))
            hashes, starts, owner = hashes[order], starts[order], owner[order]
            same = hashes[1:] == hashes[:-1]
            for j in range(size):
                same &= self.words[starts[1:] + j] == self.words[starts[:-1] + j]
            first = np.flatnonzero(np.concatenate([[True], ~same]))
            self.lengths.append((size, hashes[first], starts[first], np.append(first, len(starts)), owner))

    def ids(self, tokens: list[bytes]) -> np.ndarray:
        """Word numbers; 0 for words that no item has."""
        get = self.vocabulary.get
        return np.fromiter([get(w, 0) for w in tokens], np.int64, len(tokens))


def find(ids: np.ndarray, doc_of: np.ndarray, found: WindowSet) -> tuple[np.ndarray, dict[int, set]]:
    """Which words any occurrence of a window covers, and the items found in each document (by its number)."""
    edges = np.zeros(len(ids) + 1, np.int64)
    items: dict[int, set] = defaultdict(set)
    known = np.concatenate([[0], np.cumsum(ids > 0)])
    for size, hashes, places, offsets, owner in found.lengths:
        if len(ids) < size:
            continue
        starts = np.flatnonzero((known[size:] - known[:-size] == size) & (doc_of[: len(ids) - size + 1] == doc_of[size - 1 :]))
        if not len(starts):
            continue
        span = ids[starts[:, None] + np.arange(size)]
        got = window_hashes(span.reshape(-1), size)[::size]
        low, high = np.searchsorted(hashes, got), np.searchsorted(hashes, got, "right")
        told: set[tuple[int, int]] = set()
        for k in np.flatnonzero(high > low).tolist():
            doc, hit = int(doc_of[starts[k]]), False
            for p in range(int(low[k]), int(high[k])):
                if np.array_equal(found.words[places[p] : places[p] + size], span[k]):  # a hash may collide: the words decide
                    hit = True
                    if (doc, p) not in told:
                        told.add((doc, p))
                        items[doc].update(found.names[x] for x in owner[offsets[p] : offsets[p + 1]].tolist())
            if hit:
                edges[starts[k]] += 1
                edges[starts[k] + size] -= 1
    return np.cumsum(edges[:-1]) > 0, items


@dataclass
class Part:
    """Some items on every executor; ``name`` is what a worker keeps their window set under."""

    name: str
    items: object
    n: int


def _scan(docs: DataFrame, part: Part, handle, schema) -> DataFrame:
    def run(batches):
        windows = held(part.name, lambda: WindowSet(part.items.value, part.n))
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts, 4_000_000):
                tokens: list[bytes] = []
                counts = np.zeros(b - a, np.int64)
                for i, t in enumerate(texts.slice(a, b - a).to_pylist()):
                    w = words(t)
                    counts[i] = len(w)
                    tokens += w
                doc_of = np.repeat(np.arange(b - a), counts)
                hit, items = find(windows.ids(tokens), doc_of, windows)
                yield handle(batch.slice(a, b - a), counts, doc_of, hit, items)

    return docs.mapInArrow(run, schema)


def pieces(text: str, n: int, most: int) -> list[str]:
    """Runs of words of about ``most`` bytes, at least ``n`` words each, that have every window of the text between them."""
    found, out, at = words(text), [], 0
    if len(text) * 4 <= most or len(found) <= n:
        return [text]
    ends = np.cumsum([len(w) + 1 for w in found])
    while True:
        stop = max(at + n, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        if stop >= len(found):
            return [*out, b" ".join(found[at:]).decode("utf-8", "surrogatepass")]
        out.append(b" ".join(found[at:stop]).decode("utf-8", "surrogatepass"))
        at = stop - n + 1


def _parts(spark: SparkSession, items: DataFrame, n: int, scratch: Scratch) -> list[DataFrame]:
    """The items in parts of at most about MOST_ITEM_BYTES, half of it on average; sizes are measured before anything is fetched."""
    sized = items.select("item_id", "text")
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total <= MOST_ITEM_BYTES:
        return [sized]
    count, most = int(total // max(MOST_ITEM_BYTES // 2, 1)) + 1, min(PIECE_BYTES, MOST_ITEM_BYTES)

    def cut_up(batches):
        for batch in batches:
            for at, text in enumerate(batch.column("text").to_pylist()):
                got = pieces(text, n, most) if text is not None else []
                for some in range(0, len(got), 64):
                    run = got[some : some + 64]
                    yield pa.RecordBatch.from_arrays([pa.array(batch.column("item_id").slice(at, 1).to_pylist() * len(run), batch.schema.field("item_id").type), pa.array(run, pa.string())], ["item_id", "text"])

    dealt = sized.mapInArrow(cut_up, sized.schema).withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)).cast("int"))
    stored = scratch.table(dealt, "items")
    return [stored.where(F.col("part") == k) for k in range(count)]


def _sent(spark: SparkSession, part: DataFrame, n: int) -> Part:
    rows = [(r.item_id, r.text) for r in part.select("item_id", "text").collect()]
    return Part(f"windows-{uuid.uuid4().hex}", spark.sparkContext.broadcast(rows), n)


def _tagged(docs: DataFrame, doc: str, tag: str) -> DataFrame:
    """``docs`` with a key that equal rows share: their results are the same."""
    return docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).withColumn(tag, F.coalesce(F.md5("text"), F.lit("")))


def _united(spark: SparkSession, docs: DataFrame, parts: list[DataFrame], n: int, scratch: Scratch) -> DataFrame:
    """doc, tag, hit (a bit for each word), items of all texts with a hit: a pass for each part, after which its broadcast is let go."""
    keyed = _tagged(docs.select("doc_id", "text"), "doc", "tag").select("doc", "tag", "text")

    def told(batch, counts, doc_of, hit, items):
        per = np.split(hit, np.cumsum(counts)[:-1])
        some = [i for i in range(len(counts)) if per[i].any()]
        return pa.RecordBatch.from_arrays(
            [*(pa.array([batch.column(c)[i].as_py() for i in some], pa.string()) for c in ("doc", "tag")), pa.array([np.packbits(per[i]).tobytes() for i in some], pa.binary()), pa.array([sorted({str(x) for x in items[i]}) for i in some], pa.list_(pa.string()))],
            ["doc", "tag", "hit", "items"],
        )

    tables = []
    for k, part in enumerate(parts):
        sent = _sent(spark, part, n)
        one = _scan(keyed, sent, told, "doc string, tag string, hit binary, items array<string>")
        tables.append(scratch.table(one.dropDuplicates(["doc", "tag"]), f"hits-{k}"))
        sent.items.destroy()
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)

    def unite(table):
        bits, names = None, set()
        for hit, found in zip(table.column("hit").to_pylist(), table.column("items").to_pylist()):
            now = np.frombuffer(hit, np.uint8)
            bits = now if bits is None else bits | now
            names.update(found)
        return pa.table({"doc": table.column("doc").slice(0, 1), "tag": table.column("tag").slice(0, 1), "hit": pa.array([bits.tobytes()], pa.binary()), "items": pa.array([sorted(names)], pa.list_(pa.string()))})

    # a text's rows here are as many as the parts that hit it
    return scratch.table(every.groupBy("doc", "tag").applyInArrow(unite, "doc string, tag string, hit binary, items array<string>"), "hits")


def _with_hits(docs: DataFrame, united: DataFrame, hit: str, items: str) -> DataFrame:
    """``docs`` with the hits of each row, null where there are none; rows that surely have none are not sent anywhere."""
    doc, tag, touched = (fresh(docs, c) for c in ("doc", "tag", "touched"))
    marked = Filter(united, "doc", "tag").mark(_tagged(docs, doc, tag), touched, doc, tag)
    other = united.select(F.col("doc").alias(doc), F.col("tag").alias(tag), F.col("hit").alias(hit), F.col("items").alias(items))
    clean = marked.where(~F.col(touched)).withColumn(hit, F.lit(None).cast("binary")).withColumn(items, F.lit(None).cast("array<string>"))
    return marked.where(F.col(touched)).join(other, [doc, tag], "left").unionByName(clean).drop(doc, tag, touched)


def _judged(n_words: list, hit: list, lists: list) -> list[pa.Array]:
    """The columns n_words, n_hit, n_items, items_sha256, contaminated."""
    lists = [sorted({str(x) for x in found}) for found in lists]
    joined = [",".join(x) for x in lists]
    return [
        pa.array(n_words, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in lists], pa.int64()),
        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in joined], pa.string()), pa.array([h > 0 for h in hit], pa.bool_()),
    ]


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null text has no words; a document shorter than ``n`` can only hold windows of short items.  Repeated rows are judged
    each for itself; without items nothing is hit.  Extra columns are not read.
    """
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]

    def handle(batch, counts, doc_of, hit, items):
        hits = np.bincount(doc_of[hit], minlength=len(counts))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *_judged(counts.tolist(), hits.tolist(), [items.get(i, ()) for i in range(len(counts))])], names)

    scratch = Scratch(spark, "decontamination")
    parts = _parts(spark, items, n, scratch)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if len(parts) == 1:
        return _scan(source, _sent(spark, parts[0], n), handle, schema)

    def count(batches):
        for batch in batches:
            lists = [x or () for x in batch.column("items").to_pylist()]
            hits = [0 if x is None else int(np.unpackbits(np.frombuffer(x, np.uint8)).sum()) for x in batch.column("hit").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_judged([len(words(t)) for t in batch.column("text").to_pylist()], hits, lists)], names)

    return _with_hits(source, _united(spark, source, parts, n, scratch), "hit", "items").mapInArrow(count, schema)


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, n: int = 10, mode: str = "document") -> DataFrame:
    """``docs`` without what is contaminated, in its own columns.

    mode "document" drops each document with a hit; "span" cuts the hit words with what stands between them out of the
    text (a document of which nothing is left keeps an empty text).  Null texts are kept.
    """
    if mode not in ("document", "span"):
        raise ValueError("mode: document or span")
    scratch = Scratch(spark, "decontamination")
    parts = _parts(spark, items, n, scratch)
    names = docs.columns
    columns = [F.col(f"`{c}`") for c in names]

    if len(parts) == 1:

        def handle(batch, counts, doc_of, hit, items):
            hits = np.bincount(doc_of[hit], minlength=len(counts))
            if mode == "document":
                return batch.filter(pa.array(hits == 0))
            texts = batch.column("text").to_pylist()
            ends = np.cumsum(counts)
            for i in np.flatnonzero(hits).tolist():
                texts[i] = cut(texts[i], hit[ends[i] - counts[i] : ends[i]])
            at = batch.schema.get_field_index("text")
            return batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

        return _scan(docs, _sent(spark, parts[0], n), handle, docs.schema).select(*columns)

    bits, found = fresh(docs, "hit"), fresh(docs, "items")
    told = _with_hits(docs, _united(spark, docs, parts, n, scratch), bits, found)
    if mode == "document":
        return told.where(F.col(bits).isNull()).select(*columns)

    def apply(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, hit in enumerate(batch.column(bits).to_pylist()):
                if hit is not None:
                    texts[i] = cut(texts[i], np.unpackbits(np.frombuffer(hit, np.uint8), count=len(words(texts[i]))).astype(bool))
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type)).select(names)

    return told.mapInArrow(apply, docs.schema).select(*columns)


def cut(text: str, hit: np.ndarray) -> str:
    """The text without its hit words and without what stands between two neighbouring ones."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    word = np.frombuffer(_TABLE, np.uint8)[raw] != 32
    edge = np.diff(np.concatenate([[0], word.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = np.ones(len(raw), bool)
    run = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    for a, b in zip(np.flatnonzero(run == 1), np.flatnonzero(run == -1)):
        keep[starts[a] : ends[b - 1]] = False
    return raw[keep].tobytes().decode("utf-8", "surrogatepass")
