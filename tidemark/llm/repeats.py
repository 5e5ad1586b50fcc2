"""Suffix-array deduplication: bytes covered by a string of 50 bytes that also starts in an earlier document.

Every window of 50 bytes belongs to the hashed 16-gram of smallest order in it (its anchor; the leftmost one if equal), so
equal windows have equal anchors wherever they stand.  Neighbouring windows with one anchor form a stretch of at most
84 bytes.  A window reaches 17 bytes or more beyond its anchor on one side at least, so equal windows also share the 33 bytes
that the anchor makes with that side.  A text that equals one of a smaller doc_id goes whole.  The others are dealt to chunks of some megabytes, which are written once.  Each chunk sends its
distinct hashed 33-grams, in sorted and compressed runs, one to each range of hash space; the ranges answer which of
them occur in several documents, and a chunk keeps the stretches, or halves of them, that can hold a repeat.  These
are dealt out by anchor, each distinct one once from each chunk, however often it occurs; each shard sorts their suffixes by
induced sorting, groups them by permuted common prefixes of 50 bytes or more, and finds for every window the smallest
document that has it.  Occurrences join these results, and each chunk removes the covered bytes of its rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Filter, Scratch, mix64
from .suffix_array import permuted_lcp, suffix_array

#: Bytes of text looked at together; a longer text is looked at in overlapping parts. Positions take 20 bits.
PART = 1 << 20
GRAM = 16
#: Bytes of text in a chunk (one text at least), of text whose 33-grams one range of hash space holds, of stretches in one suffix array.
CHUNK, RANGE, SHARD = 8 << 20, 18 << 20, 4_000_000
#: Rows that are looked at for the end of a key at once.
STEP = 4096


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of 16 bytes, by doubling."""
    h = raw.astype(np.uint64) + np.uint64(1)
    for width, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9), (8, 0xD6E8FEB86659FD93)):
        h = h[:-width] * np.uint64(factor) + (h[width:] ^ (h[width:] >> np.uint64(29)))
    return mix64(h)


def anchors(raw: np.ndarray, doc_of: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Of each stretch: first window, last window, the anchor's hash, the hashes of the anchor with its left and with its right
    side, and the anchor's place.

    Windows that cross documents don't count.  A side that no window of the stretch reaches far into has the hash 0.
    """
    n = len(raw) - window + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none, none, *[np.empty(0, np.uint64)] * 3, none
    hashes = gram_hashes(raw)
    span = window - GRAM + 1
    place = np.arange(len(hashes), dtype=np.uint64)
    low = (hashes >> np.uint64(20) << np.uint64(20)) | place  # order first, then the place: the leftmost of equals
    done = 1
    while done * 2 <= span:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    if done < span:
        low = np.minimum(low[:n], low[span - done :][:n])
    at = (low[:n] & np.uint64((1 << 20) - 1)).astype(np.int64)
    whole = doc_of[:n] == doc_of[window - 1 :]
    at[~whole] = -1
    edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    ends = np.concatenate([edge[1:], [n]]) - 1
    real = at[edge] >= 0
    first, last = edge[real], ends[real]
    p = at[first]
    reach = (window - GRAM) // 2  # a window has so many bytes beyond its anchor on one side at least
    sides = []
    for sign, fine in ((1, first <= p - reach), (-1, last > p - reach)):
        here, key = p[fine], np.zeros(len(p), np.uint64)
        # grams that overlap, so that together they are the side and the anchor
        for g in [*[here - sign * (reach - GRAM * k) for k in range(-(-reach // GRAM))], here]:
            key[fine] = mix64(key[fine] * np.uint64(0x9E3779B97F4A7C15) + hashes[g] + np.uint64(1))
        sides.append(key)
    return first, last, hashes[p], *sides, p


def parts(texts: list[bytes], window: int):
    """(bytes, row of each byte, place of each row's bytes in the part, offset of them in its text, by row number in the part)."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def flush():
        raw = np.frombuffer(b"".join(x for _, _, x in held), np.uint8)
        lens = np.asarray([len(x) for _, _, x in held])
        return raw, np.repeat(np.arange(len(held)), lens), np.cumsum(lens) - lens, np.asarray([o for _, o, _ in held]), np.asarray([r for r, _, _ in held])

    for row, data in enumerate(texts):
        if len(data) < window:
            continue
        at = 0
        while True:
            piece = data[at : at + PART]
            if size + len(piece) > PART and held:
                yield flush()
                held, size = [], 0
            held.append((row, at, piece))
            size += len(piece)
            if at + PART >= len(data):
                break
            at += PART - window + 1
    if held:
        yield flush()


class Keys:
    """The distinct side hashes of a chunk, cut to ``bits`` bits: sorted, with a mark for those of several documents."""

    def __init__(self, ids: list, copies: list, texts: list[bytes], window: int, bits: int):
        self.shift = np.uint64(64 - bits)
        docs = np.asarray([0 if i is None else i for i in ids], np.int64)
        # rows without an id take no part; copies need none: their first one has all they have
        named = [b"" if i is None or c else t for i, c, t in zip(ids, copies, texts)]
        self.found, keys, owners = [], [], []
        for raw, doc_of, heads, offsets, rows in parts(named, window):
            first, last, anchor, left, right, p = anchors(raw, doc_of, window)
            row = rows[doc_of[first]]
            self.found.append((raw, first, last, anchor, left, right, p, row, offsets[doc_of[first]] - heads[doc_of[first]]))
            for side in (left, right):
                keys.append(side[side > 0] >> self.shift)
                owners.append(docs[row[side > 0]])
        key = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        owner = np.concatenate(owners) if owners else np.empty(0, np.int64)
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        self.keys = key[edge]
        self.several = np.minimum.reduceat(owner, edge) != np.maximum.reduceat(owner, edge) if len(edge) else np.empty(0, bool)

    def runs(self, ranges: int, bits: int):
        """(range, packed run) of each range that has keys."""
        of = ((self.keys * np.uint64(ranges)) >> np.uint64(bits)).astype(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.empty(0, np.int64)
        packer = zstandard.ZstdCompressor(level=1)
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(of)]):
            steps = np.diff(self.keys[a:b], prepend=np.uint64(0)).astype("<u8")
            planes = steps.view(np.uint8).reshape(-1, 8).T.tobytes()  # steps are small: high planes are zeros
            yield int(of[a]), (b - a).to_bytes(8, "little") + np.packbits(self.several[a:b]).tobytes() + packer.compress(planes)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    wide = -(-n // 8)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8 + wide :]), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64), np.unpackbits(np.frombuffer(data[8 : 8 + wide], np.uint8), count=n).astype(bool)


_BODY = pa.schema([("doc_id", pa.int64()), ("copy", pa.bool_()), ("data", pa.large_binary())])


def _packed(ids: list, copies: list, texts: list[bytes]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _BODY, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=1))) as out:
        out.write_batch(pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(copies, pa.bool_()), pa.array(texts, pa.large_binary())], schema=_BODY))
    return sink.getvalue().to_pybytes()


def _body(data: bytes) -> tuple[list, list, list[bytes]]:
    t = pa.ipc.open_stream(data).read_all()
    return t.column("doc_id").to_pylist(), t.column("copy").to_pylist(), t.column("data").to_pylist()


def _chunks(docs: DataFrame, window: int, ranges: int, bits: int) -> DataFrame:
    """chunk, slot, data: a chunk's rows (slot -1), and its run of keys for each range (slot)."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        copies: list = []
        texts: list[bytes] = []

        def flush():
            made = [(-1, _packed(ids, copies, texts)), *Keys(ids, copies, texts, window, bits).runs(ranges, bits)]
            return pa.RecordBatch.from_arrays([pa.array([number] * len(made), pa.int64()), pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.binary())], ["chunk", "slot", "data"])

        size = 0
        for batch in batches:
            for i, c, t in zip(batch.column("doc_id").to_pylist(), batch.column("copy").to_pylist(), batch.column("text")):
                t = t.as_py()
                data = t.encode("utf-8", "surrogatepass") if t else b""
                if ids and size + len(data) > CHUNK:
                    yield flush()
                    number += 1
                    ids, copies, texts, size = [], [], [], 0
                ids.append(i)
                copies.append(c)
                texts.append(data)
                size += len(data) + 64
        if ids:
            yield flush()

    return docs.mapInArrow(run, "chunk long, slot int, data binary")


def _answers(runs: DataFrame) -> DataFrame:
    """chunk, slot, data: which keys of a chunk's run occur in several documents."""

    def answer(key, table):
        got = [_unpack(x.as_py()) for x in table.column("data")]
        every = np.concatenate([k for k, _ in got])
        order = np.argsort(every, kind="stable")
        ordered = every[order]
        same = ordered[1:] == ordered[:-1]
        again = np.zeros(len(every), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        out, at = [], 0
        for keys, several in got:
            out.append(len(keys).to_bytes(8, "little") + np.packbits(again[at : at + len(keys)]).tobytes())
            at += len(keys)
        # a key that one chunk alone marks is answered by the chunk itself
        return pa.table({"chunk": table.column("chunk"), "slot": table.column("slot"), "data": pa.array(out, pa.binary())})

    return runs.groupBy("slot").applyInArrow(answer, "chunk long, slot int, data binary")


def _stretches(rows: DataFrame, window: int, bits: int) -> DataFrame:
    """key, c1, c2 (128 bits of the bytes), chunk, row, doc_id, start, tells and bytes for every stretch that can hold a repeat.

    ``tells``: the row is its content's smallest document in the chunk (then with the bytes) or its largest one.
    """
    reach = (window - GRAM) // 2

    def keep(key, table):
        slots = np.asarray(table.column("slot"))
        order = np.argsort(slots)
        data = [table.column("data")[int(k)].as_py() for k in order]
        ids, copies, texts = _body(data[0])
        found = Keys(ids, copies, texts, window, bits)
        shared = found.several.copy()
        at = 0
        for x in data[1:]:
            n = int.from_bytes(x[:8], "little")
            shared[at : at + n] |= np.unpackbits(np.frombuffer(x[8:], np.uint8), count=n).astype(bool)
            at += n
        columns: list[list] = [[], [], []]
        spans: list[bytes] = []

        def is_shared(side):
            where = np.minimum(np.searchsorted(found.keys, side >> found.shift), max(len(shared) - 1, 0))
            return (side > 0) & shared[where] if len(shared) else side > 0

        for raw, first, last, anchor, left, right, p, row, offset in found.found:
            a, b = is_shared(left), is_shared(right)
            # without its left (right) half, a stretch begins after (ends with) the windows that reach far left
            first, last = np.where(a, first, np.maximum(first, p - reach + 1)), np.where(b, last, np.minimum(last, p - reach))
            fine = np.flatnonzero((a | b) & (first <= last))
            text = raw.tobytes()
            for x, y in zip(first[fine].tolist(), (last[fine] + window).tolist()):
                spans.append(text[x:y])
            columns[0].append(anchor[fine])
            columns[1].append(row[fine])
            columns[2].append(first[fine] + offset[fine])
        content = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, spans)), np.int64).reshape(-1, 2)
        anchor, row, start = (np.concatenate(c) if c else np.empty(0, np.int64) for c in columns)
        doc = np.asarray([0 if i is None else i for i in ids], np.int64)[row.astype(np.int64)]
        order = np.lexsort((doc, content[:, 1], content[:, 0]))
        ordered = content[order]
        edge = np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(axis=1)]) if len(order) else np.empty(0, bool)
        heads = np.flatnonzero(edge)
        ends = np.concatenate([heads[1:], [len(order)]]).astype(np.int64) - 1 if len(heads) else heads
        tells, told = np.zeros(len(order), bool), np.ones(len(order), bool)
        tells[order[heads]] = True
        tells[order[ends]] |= doc[order[ends]] != doc[order[heads]]
        told[order[heads]] = False
        return pa.table(
            {
                "key": pa.array(anchor.astype(np.uint64).view(np.int64)), "c1": pa.array(content[:, 0]), "c2": pa.array(content[:, 1]), "chunk": pa.array(np.full(len(row), key[0].as_py(), np.int64)),
                "row": pa.array(row.astype(np.int32)), "doc_id": pa.array(doc), "start": pa.array(start.astype(np.int64)), "tells": pa.array(tells), "bytes": pa.array([None if t else x for t, x in zip(told.tolist(), spans)], pa.binary()),
            }
        )

    return rows.groupBy("chunk").applyInArrow(keep, "key long, c1 long, c2 long, chunk long, row int, doc_id long, start long, tells boolean, bytes binary")


def shard_windows(lo: np.ndarray, spans: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """(stretch, from, to, smallest document) for runs of windows, found by one suffix array over the stretches."""
    sizes = np.asarray([len(x) for x in spans])
    text = np.frombuffer(b"\0".join(spans) + b"\0", np.uint8).astype(np.int16)
    ends = np.cumsum(sizes + 1) - 1
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] += 1  # so that a byte of zero is no separator
    order = suffix_array(text, 257, separator=0)
    common = permuted_lcp(text, order, 0)
    owner = np.repeat(np.arange(len(spans), dtype=np.int32), sizes + 1)
    edge = np.flatnonzero(common[order] < window)
    edge = edge if len(edge) and edge[0] == 0 else np.concatenate([[0], edge])
    least = np.minimum.reduceat(lo[owner[order]], edge)
    smallest = np.empty(len(text), np.int64)
    smallest[order] = np.repeat(least, np.diff(np.concatenate([edge, [len(order)]])))
    valid = np.flatnonzero(np.arange(window, len(text) + window) <= ends[owner])
    of, low = owner[valid], smallest[valid]
    run = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (low[1:] != low[:-1])])) if len(valid) else np.empty(0, np.int64)
    stop = np.concatenate([run[1:], [len(valid)]]).astype(np.int64) - 1 if len(valid) else run
    base = (ends - sizes)[of[run]]
    return of[run], valid[run] - base, valid[stop] - base, low[run]


def _windows(told: DataFrame, window: int) -> DataFrame:
    """c1, c2, a, b, least: the windows that start at a to b in a stretch occur first in document ``least``."""

    def told_batch(c1, c2, a, b, least):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (c1, c2, a, b, least)], ["c1", "c2", "a", "b", "least"])

    def contents(t: pa.Table):
        """Of keys that several documents have: the batch for those of one content, in which there is nothing to sort (equal windows
        have equal keys, so all of its windows occur first in its smallest document), and the contents of the others."""
        key, c1, c2, doc = (np.asarray(t.column(c)) for c in ("key", "c1", "c2", "doc_id"))
        has = t.column("bytes").is_valid().to_numpy()
        order = np.lexsort((~has, c2, c1, key))
        key, c1, c2, doc = key[order], c1[order], c2[order], doc[order]
        head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])]))
        lo, hi = np.minimum.reduceat(doc, head), np.maximum.reduceat(doc, head)  # hi > lo if and only if there are two documents
        source, key, c1, c2 = order[head], key[head], c1[head], c2[head]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.concatenate([edge, [len(key)]]))
        several = np.minimum.reduceat(lo, edge) < np.maximum.reduceat(hi, edge)
        alone, others = edge[several & (n == 1)], np.flatnonzero(np.repeat(several & (n > 1), n))
        length = np.asarray(pc.binary_length(t.column("bytes").take(pa.array(source[alone]))), np.int64)
        whole = told_batch(c1[alone], c2[alone], np.zeros(len(alone), np.int64), length - window, lo[alone]) if len(alone) else None
        return whole, (lo[others], hi[others], c1[others], c2[others]), t.column("bytes").take(pa.array(source[others])).to_pylist()

    def sort(columns: list, spans: list[bytes]):
        lo, hi, c1, c2 = (np.concatenate(x) for x in zip(*columns))
        of, a, b, least = shard_windows(lo, spans, window)
        useful = least < hi[of]
        of = of[useful]
        return told_batch(c1[of], c2[of], a[useful], b[useful], least[useful])

    def run(batches):
        held: list = []
        columns: list = []
        spans: list[bytes] = []
        size = waiting = 0

        def look(pieces: list):
            nonlocal columns, spans, waiting
            whole, more, texts = contents(pa.Table.from_batches(pieces))
            if whole is not None:
                yield whole
            new = sum(map(len, texts))
            if spans and waiting + new > SHARD:  # no more is sorted at once than what was looked at
                yield sort(columns, spans)
                columns, spans, waiting = [], [], 0
            columns.append(more)
            spans += texts
            waiting += new

        for batch in batches:
            for k in range(0, batch.num_rows, STEP):
                piece = batch.slice(k, STEP)
                if size > SHARD:  # what is looked at ends where its last key does; only the new rows are compared for that
                    before = held[-1].column("key")[-1].as_py()
                    other = np.flatnonzero(np.asarray(piece.column("key")) != before)
                    if len(other):
                        cut = int(other[0])
                        yield from look([*held, piece.slice(0, cut)])
                        held, size, piece = [], 0, piece.slice(cut)
                held.append(piece)
                size += piece.column("bytes").nbytes
        if held:
            yield from look(held)
        if spans:
            yield sort(columns, spans)

    return told.repartition("key").sortWithinPartitions("key").mapInArrow(run, "c1 long, c2 long, a long, b long, least long")


def _marked(scratch: Scratch, source: DataFrame, window: int) -> DataFrame:
    """With ``copy``: the row's whole text (by 128 bits) is that of a smaller doc_id, and long enough to go."""
    hashed = source.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(7), "text")})
    large = hashed.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= window))
    classes = scratch.table(large.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h1", "h2", "first"), "copies")
    likely = Filter(classes, "h1", "h2").mark(hashed, "likely", "h1", "h2")
    # only what is likely a copy, or has one, is sent anywhere
    joined = likely.where("likely").join(classes, ["h1", "h2"], "left").withColumn("copy", F.coalesce((F.col("doc_id") > F.col("first")) & (F.octet_length("text") >= window), F.lit(False)))
    return joined.select("doc_id", "copy", "text").unionByName(likely.where("NOT likely").select("doc_id", F.lit(False).alias("copy"), "text"))


def _cut(rows: DataFrame, keep_text: bool) -> DataFrame:
    """From a chunk's texts (``data``) and the places to cut (row, a, b): the result's rows."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")

    def cut(key, table):
        has = table.column("data").is_valid().to_numpy()
        ids, copies, texts = _body(table.column("data")[int(np.flatnonzero(has)[0])].as_py())
        row, a, b = (np.asarray(table.column(c).filter(pa.array(~has))) for c in ("row", "a", "b"))
        order = np.argsort(row, kind="stable")
        row, a, b = row[order], a[order], b[order]
        bounds = np.searchsorted(row, np.arange(len(ids) + 1))
        out: list[tuple] = []
        for k, data in enumerate(texts):
            x, y = bounds[k], bounds[k + 1]
            spans, kept = 0, data
            if copies[k]:
                spans, kept = 1, b""
            elif y > x:
                edges = np.zeros(len(data) + 1, np.int64)
                np.add.at(edges, a[x:y], 1)
                np.add.at(edges, b[x:y], -1)
                gone = np.cumsum(edges[:-1]) > 0
                spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            out.append((len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
        names = ["n_bytes", "n_removed", "n_spans"]
        made = {"doc_id": pa.array(ids, pa.int64())} | {c: pa.array([o[k] for o in out], pa.int64()) for k, c in enumerate(names)} | {"kept_sha256": pa.array([o[3] for o in out], pa.string())}
        if keep_text:
            made["kept"] = pa.array([o[4] for o in out], pa.binary())
        return pa.table(made)

    return rows.groupBy("chunk").applyInArrow(cut, schema)


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = 50, keep_text: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes, on demand).

    A byte goes if a string of ``window`` bytes over it also starts in a document with a smaller doc_id, judged on the
    input.  Null texts are empty; texts shorter than the window stay whole.  A row without doc_id takes no part and stays
    whole.  Rows that share a doc_id are one document, so they don't repeat each other; each is cut by itself.
    Other columns are not read; an empty table gives no rows.
    """
    if not 2 * GRAM < window <= 1000:
        raise ValueError(f"window: more than {2 * GRAM} bytes, up to 1000")
    scratch = Scratch(spark, "repeats")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(1 << 14, -(-total // RANGE) or 1)
    bits = min(50, int(total).bit_length() + 11)  # so few false meetings that they cost nothing; they don't change results
    chunks = _chunks(_marked(scratch, source, window), window, ranges, bits)
    place = scratch.path("chunks")
    chunks.withColumn("keys", F.col("slot") >= 0).write.partitionBy("keys").option("compression", "zstd").parquet(place)
    bodies, runs = (spark.read.schema(chunks.schema).parquet(f"{place}/keys={kind}") if total else spark.createDataFrame([], chunks.schema) for kind in ("false", "true"))
    answers = scratch.table(_answers(runs), "answers")
    scratch.drop(f"{place}/keys=true")
    scratch.release()
    found = scratch.table(_stretches(bodies.unionByName(answers), window, bits), "stretches")
    scratch.drop(answers)
    scratch.release()
    windows = scratch.table(_windows(found.where("tells").select("key", "c1", "c2", "doc_id", "bytes"), window), "windows")
    scratch.release(wait=1.0)
    covered = found.select("c1", "c2", "chunk", "row", "doc_id", "start").join(windows, ["c1", "c2"]).where(F.col("doc_id") > F.col("least"))
    none = F.lit(None)
    spots = scratch.table(covered.select("chunk", "row", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b") + window).alias("b")), "places")
    # what the places came from goes before the texts are sent to them
    scratch.drop(found, windows)
    scratch.release(wait=1.0)
    places = spots.select("chunk", none.cast("binary").alias("data"), "row", "a", "b")
    whole = bodies.select("chunk", "data", none.cast("int").alias("row"), none.cast("long").alias("a"), none.cast("long").alias("b"))
    return _cut(whole.unionByName(places), keep_text)
