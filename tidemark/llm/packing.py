"""Lexical retrieval packing: related documents share a training window.

Documents are tokenized once; document frequencies of all token ids are counted over the whole corpus (the vocabulary
bounds them).  Documents are laid out in the order of their likeness, two min-hashes of their rarest token ids (a merge
vocabulary lists frequent tokens first), so that documents with most rare tokens in common are neighbours whatever the
corpus's size; runs of about ``shard_docs`` of that order are the shards, and a common likeness may fill many.  Each shard holds a
BM25 inverted index over token ids with the corpus statistics.  A window starts with a seed (what is left of the document cut last, else
the next unused one); all the seed's terms are looked up, and its unused neighbours fill the window, best first, the last of them
cut to fit.  So every window but a shard's last is full; the last is cut into sequences whose lengths are powers of two, which
need no padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, mix64, slices
from .encoding import encoder

WINDOW = 2048
K1, B = 1.2, 0.75
#: Rarest distinct ids whose min-hashes are a document's likeness; tokens of a shard at most (one document at least).
RAREST, SHARD_TOKENS = 24, 2_000_000


def likeness(ids: np.ndarray, seeds: tuple[int, ...] = (1, 2)) -> list[int]:
    """Min-hashes of the RAREST largest distinct ids: two documents agree in one as often as these sets overlap."""
    top = np.unique(ids)[-RAREST:].astype(np.uint64)
    return [int(mix64(top + np.uint64(seed << 32)).min() >> np.uint64(1)) for seed in seeds]


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id, ids (little-endian, 2 bytes each if the vocabulary allows, else 4), n, width, l1, l2 (likeness): with the end id, null text as empty."""

    def run(batches):
        enc = encoder(tokenizer_path)
        kind = "<u2" if enc.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts, 2_000_000):
                ids, lens = enc.encode([t or "" for t in texts.slice(a, b - a).to_pylist()])
                lens = lens + 1
                ends = np.cumsum(lens)
                full = np.empty(int(ends[-1]), kind)
                last = np.zeros(len(full), bool)
                last[ends - 1] = True
                full[last], full[~last] = end_id, ids
                width = full.itemsize
                data = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(np.concatenate([[0], ends * width]).astype("<i4").tobytes()), pa.py_buffer(full.tobytes())])
                like = np.asarray([likeness(full[e - n : e]) for e, n in zip(ends.tolist(), lens.tolist())], np.int64).reshape(-1, 2)
                columns = [batch.column("doc_id").slice(a, b - a), data, pa.array(lens, pa.int64()), pa.array(np.full(b - a, width, np.int32)), pa.array(like[:, 0]), pa.array(like[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "n", "width", "l1", "l2"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, n long, width int, l1 long, l2 long")


def frequencies(tokens: DataFrame) -> DataFrame:
    """id, df: in how many documents each token id occurs. One row per id and task is sent, at most the vocabulary."""

    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for raw, width in zip(batch.column("ids"), batch.column("width").to_pylist()):
                ids = np.frombuffer(raw.as_buffer(), f"<u{width}")
                if width > 2 and int(ids.max()) >= len(total):
                    total = np.concatenate([total, np.zeros(max(len(total), int(ids.max()) + 1 - len(total)), np.int64)])
                total[ids] += 1  # an id that comes several times is raised once
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "df"])

    return tokens.select("ids", "width").mapInArrow(run, "id long, df long").groupBy("id").agg(F.sum("df").alias("df"))


class Index:
    """BM25 postings of one shard."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        terms, tfs, sizes = [], [], []
        for d in docs:
            s = np.sort(d)
            edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            terms.append(s[edge])
            tfs.append(np.diff(np.concatenate([edge, [len(s)]])))
            sizes.append(len(edge))
        term = np.concatenate(terms).astype(np.int64)
        tf = np.concatenate(tfs).astype(np.float64)
        owner = np.repeat(np.arange(len(docs)), sizes)
        length = np.repeat([len(d) for d in docs], sizes)
        self.weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))
        self.term, self.ends = term, np.cumsum(sizes)
        order = np.argsort(term, kind="stable")
        self.p_doc, self.p_weight = owner[order], self.weight[order]
        heads = np.searchsorted(term[order], np.arange(int(term.max()) + 2 if len(term) else 1))
        self.first, self.last = heads[:-1], heads[1:]
        self.n = len(docs)

    def neighbours(self, doc: int, used: np.ndarray) -> np.ndarray:
        """Unused documents by falling score for the document's terms (ties: smaller number)."""
        end = self.ends[doc]
        start = self.ends[doc - 1] if doc else 0
        term = self.term[start:end]
        at = [slice(a, b) for a, b in zip(self.first[term].tolist(), self.last[term].tolist())]
        score = np.bincount(np.concatenate([self.p_doc[s] for s in at]), np.concatenate([self.p_weight[s] for s in at]), self.n)
        score[used] = 0
        score[doc] = 0
        found = np.flatnonzero(score > 0)
        return found[np.argsort(-score[found], kind="stable")]


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean_length: float, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard."""
    index = Index(docs, idf, mean_length)
    used = np.zeros(len(docs), bool)
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence, fill, nxt = 0, 0, 0
    held: list[tuple[int, int, int]] = []  # the open window's pieces

    def put(doc: int, start: int) -> int:
        """Place as much as fits; what is placed."""
        nonlocal sequence, fill
        n = min(len(docs[doc]) - start, window - fill)
        held.append((doc, start, n))
        fill += n
        if fill == window:
            at = 0
            for d, s, m in held:
                pieces.append((d, s, m, sequence, at))
                at += m
            held.clear()
            sequence, fill = sequence + 1, 0
        return n

    rest: tuple[int, int] | None = None
    while True:
        if rest is None:
            while nxt < len(docs) and used[nxt]:
                nxt += 1
            if nxt == len(docs):
                break
            seed, start = nxt, 0
            used[seed] = True
        else:
            seed, start = rest
            rest = None
        while start < len(docs[seed]):
            start += put(seed, start)
        if not fill:
            continue
        ranked = iter(index.neighbours(seed, used).tolist())
        while fill:
            doc = next((d for d in ranked if not used[d]), None)
            if doc is None:
                while nxt < len(docs) and used[nxt]:
                    nxt += 1
                if nxt == len(docs):
                    break
                doc = nxt
            used[doc] = True
            n = put(doc, 0)
            if n < len(docs[doc]):
                rest = (doc, n)
        if rest is None and fill and nxt == len(docs):
            break
    # the last, short window: sequences of falling powers of two
    while held:
        size = 1 << (sum(m for _, _, m in held).bit_length() - 1)
        at = 0
        while at < size:
            d, s, m = held.pop(0)
            take = min(m, size - at)
            pieces.append((d, s, take, sequence, at))
            at += take
            if take < m:
                held.insert(0, (d, s + take, m - take))
        sequence += 1
    return pieces


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int, *, shard_docs: int = 2000, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, on demand).

    Null and empty texts are the end id alone.  Each row of ``docs`` is a document of its own, repeated ones too; other
    columns are not read; an empty table gives no pieces.
    """
    scratch = Scratch(spark, "packing")
    tokens = scratch.table(tokenized(docs, tokenizer_path, end_id), "tokens")
    count, total = tokens.agg(F.count(F.lit(1)), F.sum("n")).first()
    rows = frequencies(tokens).collect()  # at most one for each id of the vocabulary
    df = np.zeros(max([0, *(r.id for r in rows)]) + 1)
    for r in rows:
        df[r.id] = r.df
    mean_length = total / count if count else 1.0
    statistics = spark.sparkContext.broadcast((np.log1p((count - df + 0.5) / (df + 0.5)), mean_length))
    shards = max(1, -(-count // shard_docs))

    def made(rows: list[tuple], sequence: int) -> pa.RecordBatch:
        """The pieces of one shard, whose sequences are numbered from ``sequence`` on."""
        # by likeness and doc_id, nulls first; rows of one doc_id by their ids, so that any order of the input gives the same pieces
        texts = [np.frombuffer(x, f"<u{w}") for _, x, w in rows]
        pieces = np.asarray(pack_shard(texts, *statistics.value), np.int64).reshape(-1, 5)
        cuts = [texts[d][s : s + m].astype("<u4") for d, s, m in pieces[:, :3].tolist()]
        columns = [
            pa.array([rows[d][0] for d in pieces[:, 0].tolist()], pa.int64()), pa.array(pieces[:, 1]), pa.array(pieces[:, 2]), pa.array([zlib.crc32(c) for c in cuts], pa.int64()),
            pa.array([len(texts[d]) for d in pieces[:, 0].tolist()], pa.int64()), pa.array(pieces[:, 3] + sequence), pa.array(pieces[:, 4]),
        ]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            columns.append(pa.array([c.tolist() for c in cuts], pa.list_(pa.int64())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        sequence = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        tokens_held = 0
        for batch in batches:
            for row in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), batch.column("width").to_pylist()):
                row = (row[0], row[1].as_py(), row[2])
                n = len(row[1]) // row[2]
                if rows and (len(rows) >= 2 * shard_docs or tokens_held + n > SHARD_TOKENS):
                    out = made(rows, sequence)
                    sequence = int(out.column("sequence_id")[-1].as_py()) + 1
                    yield out
                    rows, tokens_held = [], 0
                rows.append(row)
                tokens_held += n
        if rows:
            yield made(rows, sequence)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<long>" if with_ids else "")
    order = ["l1", "l2", "doc_id", "n"]
    dealt = tokens.withColumn("crc", F.crc32("ids")).repartitionByRange(shards, *order, "crc").sortWithinPartitions(*order, "crc")
    return dealt.select("doc_id", "ids", "width").mapInArrow(run, schema)
