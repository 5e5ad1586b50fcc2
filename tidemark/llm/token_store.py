"""Token-id output: bit-plane shuffled blocks with a chunk index.

File format (one file per ordered range of documents, little-endian)::

    "TMPLANE1"  | chunk* | chunk index | document index | tail
    chunk       : for each plane, its zstandard frame (no bytes: a plane of zeros)
    chunk index : zstandard of int64 rows [offset, n_ids, len(plane 0), len(plane 1), ...]
    document idx: zstandard of uint8 is_null[n] + int64 doc_id[n] + int64 n_tokens[n]
    tail        : int64 x 5 (planes, ids of a full chunk, chunks, bytes of chunk index, bytes of document index) + "TMPLANE1"

A chunk holds a fixed number of ids (the last of a file may hold fewer).  Ids are transposed into 4 byte planes or 32 bit
planes: plane k of a chunk holds byte (bit) k of every id, so planes of high bits are nearly constant and compress away.
The index lets a reader fetch any chunk, or any id range, without reading what stands before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices
from .encoding import encoder

MAGIC = b"TMPLANE1"
CHUNK_IDS = 1 << 16


def to_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids: 4 byte planes or 32 bit planes."""
    octets = np.ascontiguousarray(ids.astype("<u4", copy=False)).view(np.uint8).reshape(-1, 4)
    if planes == 4:
        return [octets[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, k]).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    if len(planes) == 4:
        for k, p in enumerate(planes):
            if p:
                out[:, k] = np.frombuffer(p, np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for k, p in enumerate(planes):
            if p:
                bits[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n)
        out = np.packbits(bits, axis=1, bitorder="little")
    return out.view("<u4").reshape(-1)


class PlaneWriter:
    """Streams documents of ids into one file object."""

    def __init__(self, sink, planes: int = 4, chunk_ids: int = CHUNK_IDS, level: int = 1):
        if planes not in (4, 32):
            raise ValueError("planes: 4 (bytes) or 32 (bits)")
        self.sink, self.planes, self.chunk_ids = sink, planes, chunk_ids
        self.packer = zstandard.ZstdCompressor(level=level)
        self.at, self.rest, self.rest_n = len(MAGIC), [], 0
        self.chunks: list[list[int]] = []
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        sink.write(MAGIC)

    def add(self, doc_ids: np.ndarray, is_null: np.ndarray, n_tokens: np.ndarray, ids: np.ndarray) -> None:
        """Documents in order; ``ids`` has the ids of all of them in a row."""
        self.docs.append((is_null.astype(np.uint8), doc_ids.astype("<i8"), n_tokens.astype("<i8")))
        self.rest.append(ids)
        self.rest_n += len(ids)
        if self.rest_n >= self.chunk_ids:
            every = np.concatenate(self.rest)
            full = len(every) // self.chunk_ids * self.chunk_ids
            for k in range(0, full, self.chunk_ids):
                self._chunk(every[k : k + self.chunk_ids])
            self.rest, self.rest_n = [every[full:].copy()], len(every) - full

    def _chunk(self, ids: np.ndarray) -> None:
        packed = [self.packer.compress(p) if any(p[:64]) or np.frombuffer(p, np.uint8).any() else b"" for p in to_planes(ids, self.planes)]
        self.chunks.append([self.at, len(ids), *map(len, packed)])
        for p in packed:
            self.sink.write(p)
            self.at += len(p)

    def close(self) -> tuple[int, int]:
        """Write the indexes; the numbers of documents and of ids."""
        if self.rest_n:
            self._chunk(np.concatenate(self.rest))
        chunks = np.asarray(self.chunks, "<i8").reshape(len(self.chunks), 2 + self.planes)
        columns = [np.concatenate([d[k] for d in self.docs]) if self.docs else np.empty(0) for k in range(3)]
        first, second = self.packer.compress(chunks.tobytes()), self.packer.compress(b"".join(c.tobytes() for c in columns))
        self.sink.write(first + second + np.asarray([self.planes, self.chunk_ids, len(chunks), len(first), len(second)], "<i8").tobytes() + MAGIC)
        return len(columns[0]), int(columns[2].sum())


class PlaneReader:
    """Random access to a file of planes."""

    def __init__(self, source):
        size = source.size()
        tail = source.read_at(48, size - 48)
        if tail[40:] != MAGIC:
            raise ValueError("not a complete file of token planes")
        self.source = source
        self.unpacker = zstandard.ZstdDecompressor()
        self.planes, self.chunk_ids, n, a, b = map(int, np.frombuffer(tail[:40], "<i8"))
        packed = source.read_at(a + b, size - 48 - a - b)
        self.chunks = np.frombuffer(self.unpacker.decompress(packed[:a]), "<i8").reshape(n, 2 + self.planes)
        docs = self.unpacker.decompress(packed[a:])
        m = len(docs) // 17
        self.is_null = np.frombuffer(docs, np.uint8, m).astype(bool)
        self.doc_ids = np.frombuffer(docs, "<i8", m, m)
        self.n_tokens = np.frombuffer(docs, "<i8", m, 9 * m)

    def chunk(self, k: int) -> np.ndarray:
        at, n, *lens = map(int, self.chunks[k])
        packed, planes, p = self.source.read_at(sum(lens), at), [], 0
        for size in lens:
            planes.append(self.unpacker.decompress(packed[p : p + size]) if size else b"")
            p += size
        return from_planes(planes, n)

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` up to ``start + n`` of the file, from the chunks that hold them only."""
        if not n:
            return np.empty(0, np.uint32)
        first, last = start // self.chunk_ids, (start + n - 1) // self.chunk_ids
        got = np.concatenate([self.chunk(k) for k in range(first, last + 1)])
        return got[start - first * self.chunk_ids :][:n]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        rest, k = np.empty(0, np.uint32), 0
        for null, doc, n in zip(self.is_null.tolist(), self.doc_ids.tolist(), self.n_tokens.tolist()):
            parts, have = [rest], len(rest)
            while have < n:
                parts.append(self.chunk(k))
                have += len(parts[-1])
                k += 1
            every = np.concatenate(parts) if len(parts) > 1 else rest
            yield None if null else doc, every[:n]
            rest = every[n:]


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, *, planes: int = 4, chunk_ids: int = CHUNK_IDS) -> list[tuple[int, str, int, int]]:
    """Tokenize ``docs(doc_id, text, ...)`` and write one file per range of doc_id, ascending over files and in each.

    Null text counts as empty; each document ends with ``end_id``.  Rows that share a doc_id are ordered by text, null
    doc_ids come first, other columns are not read.  A file is written under another name and renamed once complete,
    so a task may run again.  Returns the manifest (part, uri, documents, ids): a row per file, not per document.
    """
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches):
        task = TaskContext.get()
        part = task.partitionId()
        filesystem, base = _open(folder)
        filesystem.create_dir(base, recursive=True)
        hidden, name = f"{base}/.part-{part:06d}-{task.taskAttemptId()}", f"part-{part:06d}.planes"
        enc = encoder(tokenizer_path)
        with filesystem.open_output_stream(hidden) as sink:
            out = PlaneWriter(sink, planes, chunk_ids)
            for batch in batches:
                texts = batch.column("text")
                for a, b in slices(texts, 2_000_000):
                    keys = batch.column("doc_id").slice(a, b - a)
                    ids, lens = enc.encode(texts.slice(a, b - a).to_pylist())
                    ends = np.cumsum(lens + 1)
                    full = np.empty(int(ends[-1]), np.uint32)
                    last = np.zeros(len(full), bool)
                    last[ends - 1] = True
                    full[last], full[~last] = end_id, ids
                    out.add(np.asarray(keys.fill_null(0)), np.asarray(keys.is_null().to_numpy(zero_copy_only=False)), lens + 1, full)
            n_docs, n_ids = out.close()
        filesystem.move(hidden, f"{base}/{name}")
        yield pa.RecordBatch.from_pydict({"part": [part], "uri": [f"{folder}/{name}"], "docs": [n_docs], "ids": [n_ids]}, pa.schema([("part", pa.int64()), ("uri", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    rows = ordered.mapInArrow(write, "part long, uri string, docs long, ids long").collect()
    return sorted((r.part, r.uri, r.docs, r.ids) for r in rows)


def read_token_files(spark: SparkSession, manifest: list[tuple[int, str, int, int]]) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    starts, rows = 0, []
    for part, uri, n_docs, n_ids in manifest:
        rows.append((part, uri, starts))
        starts += n_ids
    files = spark.createDataFrame(rows, "part long, uri string, first long").repartition(max(1, len(rows)), "part")

    def read(batches):
        for batch in batches:
            for uri, first in zip(batch.column("uri").to_pylist(), batch.column("first").to_pylist()):
                filesystem, path = _open(uri)
                with filesystem.open_input_file(path) as source:
                    reader = PlaneReader(source)
                    crc = np.fromiter((zlib.crc32(np.ascontiguousarray(ids, "<u4")) for _, ids in reader.documents()), np.int64, len(reader.doc_ids))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(reader.doc_ids, pa.int64(), mask=reader.is_null), pa.array(first + np.cumsum(reader.n_tokens) - reader.n_tokens), pa.array(reader.n_tokens), pa.array(crc)],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, **options) -> tuple[DataFrame, list]:
    """Write the token files of ``docs`` to ``folder`` (a new one in the shared folder) and read them back.

    Empty input gives no ids and an empty result; a null or empty text gives a document of the end id alone; repeated
    rows are repeated documents.  Returns (digest rows, manifest).
    """
    folder = folder or Scratch(spark, "token-planes").path("files")
    manifest = write_token_files(docs, folder, tokenizer_path, end_id, **options)
    return read_token_files(spark, manifest), manifest
