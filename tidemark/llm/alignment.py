"""Alignment of two tokenizations of one text, by byte-owner arrays, and how often the ids of both meet in a corpus.

Each tokenizer's tokens own the bytes of the text: ``np.repeat`` of token numbers over token lengths.  Where either owner
changes, a pair of overlapping tokens starts; where both change at once, both tokenizations have a cut, and a group ends.

Texts reach both tokenizers in units (white space and what follows it up to the next white space), each distinct unit once
per worker: neither vocabulary has a token that goes on from other characters to the white space a unit may start with.
Units that don't come back byte by byte send their text through the libraries as a whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, held, slices

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Fixed by Unicode: the characters of White_Space.
_SPACES = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Pairs that one broadcast holds (17 bytes each); more take several passes over the stored pairs.
MOST_PAIRS = 4_000_000
#: Characters of text that are aligned at once; longer texts are cut where both tokenizations have a cut.
SEGMENT = 1_000_000
_CUT = re.compile(r"(?<=[\x21-\x7e]) (?=[\x21-\x7e])")


def _byte_of() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: visible ones for themselves, the others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Pair:
    """Both tokenizers, with what each has made of the units seen so far (``most`` units, then it starts anew)."""

    def __init__(self, byte_level: str, pieces: str, most: int = 400_000):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_level), sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.most = most
        byte_of, vocabulary = _byte_of(), self.a.get_vocab()
        self.n_a, self.n_b = max(vocabulary.values()) + 1, self.b.get_piece_size()
        self.a_bytes, self.b_bytes = [b""] * self.n_a, [b""] * self.n_b
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        joins = set()
        for i in range(self.n_b):
            piece = self.b.id_to_piece(i)
            self.b_bytes[i] = bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            if not self.b.is_byte(i):
                piece = piece.replace("▁", " ")
                joins.update(y for x, y in zip(piece, piece[1:]) if y in _SPACES and x not in _SPACES)
        self.a_size, self.b_size = (np.fromiter(map(len, t), np.int64) for t in (self.a_bytes, self.b_bytes))
        # a unit is asked for behind a line feed, which must stand alone: else texts go whole
        self.by_units = not any("\n" in self.b.id_to_piece(i) for i in range(self.n_b)) and len(self.b.encode("\n")) == 2
        self.by_spaces = self.by_units and " " not in joins
        inner = f"(?:[{''.join(sorted(joins))}][{_SPACES}]*[^{_SPACES}]*)*" if joins else ""
        self.unit = re.compile(f"[{_SPACES}]*[^{_SPACES}]+{inner}|[{_SPACES}]+")
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = [np.empty(1 << 16, np.uint32), np.empty(1 << 16, np.uint32)]
        self.used = [0, 0]
        self.start, self.length = np.empty((2, 1 << 14), np.int64), np.empty((2, 1 << 14), np.int64)
        self.odd = np.zeros(1 << 14, bool)

    def _learn(self, units: list[str]) -> None:
        at, n = len(self.index), len(units)
        got = [[e.ids for e in self.a.encode_batch(units, add_special_tokens=False)], [ids[2:] for ids in self.b.encode(["\n" + u for u in units], num_threads=1)]]
        while at + n > len(self.odd):
            self.start, self.length = (np.concatenate([x, np.empty_like(x)], axis=1) for x in (self.start, self.length))
            self.odd = np.concatenate([self.odd, np.zeros_like(self.odd)])
        for k, lists in enumerate(got):
            lens = np.fromiter(map(len, lists), np.int64, n)
            ids = np.asarray([i for x in lists for i in x], np.uint32)
            while self.used[k] + len(ids) > len(self.flat[k]):
                self.flat[k] = np.concatenate([self.flat[k], np.empty_like(self.flat[k])])
            self.flat[k][self.used[k] : self.used[k] + len(ids)] = ids
            self.start[k, at : at + n] = self.used[k] + np.cumsum(lens) - lens
            self.length[k, at : at + n] = lens
            self.used[k] += len(ids)
        tables = self.a_bytes, self.b_bytes
        self.odd[at : at + n] = [any(b"".join(map(t.__getitem__, ids)) != u.encode() for t, ids in zip(tables, both)) for u, *both in zip(units, *got)]
        self.index.update(zip(units, range(at, at + n)))

    def _whole(self, text: str) -> list[np.ndarray] | None:
        """Both ids of a text (without the space before it) from the libraries, or None if either doesn't give it back."""
        both = [self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)]
        want = (" " + text).encode()
        if any(b"".join(map(t.__getitem__, ids)) != want for t, ids in zip((self.a_bytes, self.b_bytes), both)):
            return None
        return [np.asarray(ids, np.uint32) for ids in both]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """([ids by A, ids by B], [A's number of ids of each text, B's]) of `` `` + text; texts that don't come back have none."""
        if len(self.index) > self.most or max(self.used) > 8 * self.most:
            self._reset()
        flat: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if self.by_units:
                units = self.unit.findall(" " + t)
                counts[i] = len(units)
                flat += units
        get = self.index.get
        idx = np.fromiter(map(get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(idx < 0)
        if len(missing):
            self._learn(list(dict.fromkeys([flat[i] for i in missing.tolist()])))
            idx[missing] = np.fromiter((self.index[flat[i]] for i in missing.tolist()), np.int64, len(missing))
        text_of = np.repeat(np.arange(len(texts)), counts)
        alone = np.unique(text_of[self.odd[idx]]).tolist() if self.by_units else list(range(len(texts)))
        ids, lens = [], []
        for k in range(2):
            size = self.length[k, idx]
            ends = np.cumsum(size)
            where = np.repeat(self.start[k, idx] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)
            ids.append(self.flat[k][where])
            lens.append(np.bincount(text_of, weights=size, minlength=len(texts)).astype(np.int64))
        if alone:
            whole = {i: self._whole(texts[i]) or [np.empty(0, np.uint32)] * 2 for i in alone}
            for k in range(2):
                parts = np.split(ids[k], np.cumsum(lens[k])[:-1])
                for i in alone:
                    parts[i] = whole[i][k]
                    lens[k][i] = len(parts[i])
                ids[k] = np.concatenate(parts)
        return ids, lens


def align(ids: list[np.ndarray], sizes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(numbers of A's token and B's token of each link, [group of each token of A, of B]) of tokens with equal bytes in all.

    ``sizes`` are the tokens' lengths in bytes. Tokens without bytes have no links and don't occur in these vocabularies."""
    owners = [np.repeat(np.arange(len(i), dtype=np.int32), s) for i, s in zip(ids, sizes)]
    turns = [np.concatenate([[True], o[1:] != o[:-1]]) if len(o) else np.empty(0, bool) for o in owners]
    at = np.flatnonzero(turns[0] | turns[1])
    group_at = np.cumsum(turns[0] & turns[1]) - 1  # of each byte
    return owners[0][at], owners[1][at], [group_at[t] for t in turns]


def _separated(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal of each number below ``n`` as a row of bytes with room for a mark, and its length."""
    width = len(str(max(n - 1, 1))) + 1
    text = np.char.encode(np.arange(n).astype(str), "ascii").astype(f"S{width}")
    return text.view(np.uint8).reshape(n, width), np.char.str_len(text)


class Writer:
    """Groups as text: ``a1,a2|b1;a3|b2``."""

    def __init__(self, n: int):
        self.digits, self.length = _separated(n)

    def write(self, ids: list[np.ndarray], groups: list[np.ndarray], text_of_group: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The text of all groups in a row, a ``;`` after each, and the length of each group's part."""
        n = [len(x) for x in ids]
        n_groups = len(text_of_group)
        per = [np.bincount(g, minlength=n_groups) for g in groups]
        before = [np.cumsum(p) - p for p in per]
        order = np.empty(n[0] + n[1], np.int64)
        slot_a = np.arange(n[0]) + before[1][groups[0]]
        slot_b = np.arange(n[1]) + (before[0] + per[0])[groups[1]]
        order[slot_a], order[slot_b] = ids[0], ids[1]
        mark = np.full(len(order), ord(","), np.uint8)
        mark[slot_a[np.cumsum(per[0]) - 1]] = ord("|")  # every group has a token of each side
        mark[slot_b[np.cumsum(per[1]) - 1]] = ord(";")
        rows, size = self.digits[order], self.length[order]
        rows[np.arange(len(order)), size] = mark
        keep = np.arange(rows.shape[1]) <= size[:, None]
        total = np.concatenate([[0], np.cumsum(size + 1)])
        ends = np.cumsum(per[0] + per[1])
        return rows[keep].tobytes(), total[ends] - total[ends - per[0] - per[1]]


def segments(text: str) -> list[str]:
    """A text in pieces that one space parts, each of some SEGMENT characters; a stretch without such a space stays whole."""
    out, at = [], 0
    while len(text) - at > SEGMENT and (m := _CUT.search(text, at + SEGMENT)):
        out.append(text[at : m.start()])
        at = m.end()
    return [*out, text[at:]]


def _aligned(texts: list[str | None], pair: Pair, writer: Writer, width: str) -> list[list]:
    """Of each text: n_a, n_b, n_groups, n_links, groups_sha256, its distinct pairs, and how often each links."""
    if len(texts) == 1 and len(texts[0] or "") > SEGMENT and pair.by_spaces:
        return [_long(texts[0], pair, writer, width)]
    given = [i for i, t in enumerate(texts) if t]
    ids, lens = pair.encode([texts[i] for i in given])
    a, b, groups = align(ids, [pair.a_size[ids[0]], pair.b_size[ids[1]]])
    text_of = [np.repeat(np.arange(len(given)), n) for n in lens]
    n_groups = int(groups[0][-1]) + 1 if len(groups[0]) else 0
    first = np.searchsorted(groups[0], np.arange(n_groups))
    text_of_group = text_of[0][first]
    link_text = text_of[0][a]
    code = ids[0][a].astype(np.int64) * pair.n_b + ids[1][b]
    distinct, times = _distinct(link_text, code, pair.n_a * pair.n_b)
    content, sizes = writer.write(ids, groups, text_of_group) if n_groups else (b"", np.empty(0, np.int64))
    byte_ends = np.cumsum(np.bincount(text_of_group, weights=sizes, minlength=len(given)).astype(np.int64))
    group_counts, link_counts = np.bincount(text_of_group, minlength=len(given)), np.bincount(link_text, minlength=len(given))
    pair_ends = np.cumsum(np.bincount(distinct[0], minlength=len(given)))
    view, byte_at, pair_at = memoryview(content), 0, 0
    out = [[0, 0, 0, 0, "", b"", b""]] * len(texts)
    for k, i in enumerate(given):
        byte_to, pair_to = int(byte_ends[k]), int(pair_ends[k])
        if lens[0][k]:
            digest = hashlib.sha256(view[byte_at : byte_to - 1]).hexdigest()
            out[i] = [int(lens[0][k]), int(lens[1][k]), int(group_counts[k]), int(link_counts[k]), digest, distinct[1][pair_at:pair_to].astype(width).tobytes(), times[pair_at:pair_to].astype("<u4").tobytes()]
        byte_at, pair_at = byte_to, pair_to
    return out


def _distinct(text: np.ndarray, code: np.ndarray, space: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """The distinct (text, code) in order, and how often each occurs."""
    if (int(text[-1]) + 1 if len(text) else 1) * space < 2**63:
        both, times = np.unique(text * space + code, return_counts=True)
        return (both // space, both % space), times
    order = np.lexsort([code, text])
    text, code = text[order], code[order]
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (code[1:] != code[:-1])])
    at = np.flatnonzero(new)
    return (text[at], code[at]), np.diff(np.concatenate([at, [len(text)]]))


def _long(text: str, pair: Pair, writer: Writer, width: str) -> list:
    """As ``_aligned`` of one very long text, piece by piece."""
    counts, digest, codes, times, first = np.zeros(4, np.int64), hashlib.sha256(), [], [], True
    for part in segments(text):
        ids, lens = pair.encode([part])
        if not lens[0][0]:
            return [0, 0, 0, 0, "", b"", b""]
        a, b, groups = align(ids, [pair.a_size[ids[0]], pair.b_size[ids[1]]])
        n_groups = int(groups[0][-1]) + 1
        content, _ = writer.write(ids, groups, np.zeros(n_groups, np.int64))
        digest.update((b"" if first else b";") + content[:-1])
        first = False
        code, n = np.unique(ids[0][a].astype(np.int64) * pair.n_b + ids[1][b], return_counts=True)
        codes.append(code)
        times.append(n)
        counts += [len(ids[0]), len(ids[1]), n_groups, len(a)]
    code, back = np.unique(np.concatenate(codes), return_inverse=True)
    n = np.bincount(back, weights=np.concatenate(times)).astype("<u4")
    return [*counts.tolist(), digest.hexdigest(), code.astype(width).tobytes(), n.tobytes()]


_STORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary"


def cross_alignment(spark: SparkSession, docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A: ``byte_level`` (tokenizers) over a space and the text; B: ``pieces`` (sentencepiece) over the text. Texts that are null or
    empty, or that either doesn't give back byte by byte, have no tokens: zeros and an empty string.  A pair of ids counts the
    rows that hold it linked; repeated rows count each.  Texts of any length are aligned whole, in pieces of some million
    characters; extra columns are not read.
    """
    scratch = Scratch(spark, "alignment")
    stored = scratch.table(_stored(docs, byte_level, pieces), "pairs")
    n_b, width = _space(byte_level, pieces)
    counts = scratch.table(_ranked(_counted(stored, width), n_b), "counts")
    parts = max(1, -(-counts.count() // MOST_PAIRS))
    mine = lambda k: counts if parts == 1 else counts.where(F.expr(f"pmod(xxhash64(code div {n_b}L), {parts}L) = {k}"))
    fixed = ["n_a", "n_b", "n_groups", "n_links"]
    columns = ["doc_id", *fixed, "n_best", "count_sum", "groups_sha256"]
    if parts == 1:
        kept = ", ".join(f"{c} long" for c in ["doc_id", *fixed]) + ", groups_sha256 string"
        return _summed(stored, spark.sparkContext.broadcast(_packed(mine(0))), width, kept).select(*columns)
    # a pass for each part of the pairs; a row's sums are added up by its number
    numbered = scratch.table(stored.withColumn("row", F.monotonically_increasing_id()), "rows")
    sums = None
    for k in range(parts):
        value = spark.sparkContext.broadcast(_packed(mine(k)))
        one = scratch.table(_summed(numbered.select("row", "codes", "times"), value, width, "row long"), f"part-{k}")
        value.destroy()
        sums = one if sums is None else sums.unionByName(one)
    total = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return numbered.join(total, "row").select(*columns)


def _space(byte_level: str, pieces: str) -> tuple[int, str]:
    """The size of B's vocabulary, and the type that holds a pair of ids."""
    import sentencepiece
    from tokenizers import Tokenizer

    n_a = max(Tokenizer.from_file(byte_level).get_vocab().values()) + 1
    n_b = sentencepiece.SentencePieceProcessor(model_file=pieces).get_piece_size()
    return n_b, "<u4" if n_a * n_b < 2**32 else "<u8"


def _stored(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    def run(batches):
        pair, writer = held(f"alignment {byte_level} {pieces}", lambda: (p := Pair(byte_level, pieces), Writer(max(p.n_a, p.n_b))))
        width = "<u4" if pair.n_a * pair.n_b < 2**32 else "<u8"
        for batch in batches:
            for at, to in slices(batch.column("text"), 1_000_000):
                rows = _aligned(batch.column("text").slice(at, to - at).to_pylist(), pair, writer, width)
                cols = list(zip(*rows))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), *[pa.array(c, k) for c, k in zip(cols, kinds)]], [f.split()[0] for f in _STORED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _STORED)


def _counted(stored: DataFrame, width: str) -> DataFrame:
    """code, n: how many rows hold each pair. Tasks add up what they read before anything is sent."""

    def run(batches):
        codes, n, waiting, held_back = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def merged():
            every = np.concatenate([codes, *waiting])
            one, back = np.unique(every, return_inverse=True)
            return one, np.bincount(back, weights=np.concatenate([n, np.ones(len(every) - len(codes), np.int64)])).astype(np.int64)

        for batch in batches:
            for blob in batch.column("codes"):
                more = np.frombuffer(blob.as_buffer(), width).astype(np.int64)
                waiting.append(more)
                held_back += len(more)
                if held_back > 2_000_000:
                    codes, n = merged()
                    waiting, held_back = [], 0
                    if len(codes) > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], ["code", "n"])
                        codes, n = codes[:0], n[:0]
        codes, n = merged()
        for at in range(0, len(codes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(codes[at : at + 100_000]), pa.array(n[at : at + 100_000])], ["code", "n"])

    return stored.select("codes").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _ranked(counts: DataFrame, n_b: int) -> DataFrame:
    """code, n, best: whether no pair of the same id of A counts more. An id has at most as many pairs as B has ids."""
    own = counts.withColumn("a", F.expr(f"code div {n_b}L"))
    return own.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a"))).select("code", "n", "best")


def _packed(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = counts.toArrow()  # at most MOST_PAIRS rows, counted before
    code = table.column("code").to_numpy()
    order = np.argsort(code)
    return code[order], table.column("n").to_numpy()[order], table.column("best").to_numpy(zero_copy_only=False)[order]


def _summed(stored: DataFrame, value, width: str, kept: str) -> DataFrame:
    """The columns ``kept`` with n_best and count_sum over the pairs that ``value`` has."""
    names = [f.split()[0] for f in kept.split(", ")]

    def run(batches):
        codes, n, best = value.value
        for batch in batches:
            blobs = batch.column("codes").to_pylist()
            sizes = np.fromiter((len(x) for x in blobs), np.int64, len(blobs)) // np.dtype(width).itemsize
            mine, times = np.frombuffer(b"".join(blobs), width).astype(np.int64), np.frombuffer(b"".join(batch.column("times").to_pylist()), "<u4").astype(np.int64)
            at = np.minimum(np.searchsorted(codes, mine), max(len(codes) - 1, 0))
            there = codes[at] == mine if len(codes) else np.zeros(len(mine), bool)
            worth, top = np.zeros(len(mine), np.int64), np.zeros(len(mine), np.int64)
            worth[there] = times[there] * n[at[there]]
            top[there] = times[there] * best[at[there]]
            ends = np.cumsum(sizes)
            cols = []
            for x in (top, worth):
                total = np.concatenate([[0], np.cumsum(x)])
                cols.append(pa.array(total[ends] - total[ends - sizes], pa.int64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *cols], [*names, "n_best", "count_sum"])

    return stored.mapInArrow(run, f"{kept}, n_best long, count_sum long")
