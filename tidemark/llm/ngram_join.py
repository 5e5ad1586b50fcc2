"""N-gram Jaccard join by signature trees.

A document's set is its distinct word n-gram hashes.  Two sets with similarity >= t differ in at most D hashes, D known
from the smaller one's size; cut hash space into more than D groups and the two sets agree on a whole group.  So each
set is entered, for each size level it may meet a partner in, under one key per group (the hash of the group's
members): sets that share no key need no look.  The sets under one key form a signature tree: leaves in order of
component, size and bitmap, inner nodes with the OR of their bitmaps and their size range.  The dual traversal of a tree
with itself drops a node pair when the sizes can't fit, or when the overlap that its bitmaps allow at most is too small, or
when both nodes lie in one component already.  Pairs that reach the leaves are checked on the sets themselves.

Keys of hot groups (thousands of near copies) never make pairs of all their members: a first round links each document
to one partner of its keys and unites what passes; the trees look only at keys that several components still share, cut
into bounded blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, held, mix64, slices, window_hashes
from .components import components

#: Ratio of neighbouring size levels; room for empty groups; members of a block; fan-out of the trees.
LEVEL_RATIO, ROOM, BLOCK, FAN = 1.35, 1.15, 1024, 8


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bounded number."""

    MOST = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's n-grams of words (A-Z lower-cased, split at ASCII white space).

    A text of fewer words than ``n`` has its whole sequence as its one n-gram; no words, or null: the empty set.
    """
    tokens: list[bytes] = []
    counts = []
    for t in texts:
        w = t.encode("utf-8", "surrogatepass").lower().split() if t else []
        counts.append(len(w))
        tokens += w
    get = held("word hashes", WordHashes).__getitem__
    hashes = np.fromiter(map(get, tokens), np.uint64, len(tokens))
    grams = mix64(window_hashes(hashes, n)) if len(hashes) >= n else np.empty(0, np.uint64)
    out, at = [], 0
    for c in counts:
        if c >= n:
            g = np.sort(grams[at : at + c - n + 1])
            out.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
        elif c:
            out.append(mix64(window_hashes(hashes[at : at + c], c) + np.uint64(c)))
        else:
            out.append(np.empty(0, np.uint64))
        at += c
    return out


class Levels:
    """Size levels for similarity num/den: level k holds pairs whose smaller set has low[k] <= size < low[k + 1]."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        low = [1]
        while low[-1] < 1 << 40:
            low.append(max(low[-1] + 1, int(low[-1] * LEVEL_RATIO)))
        self.low = np.asarray(low, np.int64)

    def of(self, size: int) -> range:
        last = int(np.searchsorted(self.low, size, side="right")) - 1
        first = last
        while first > 0 and size * self.num <= (int(self.low[first]) - 1) * self.den:
            first -= 1
        return range(first, last + 1)

    def groups(self, level: int) -> tuple[int, int]:
        """(differences at most, groups)"""
        d = (self.den - self.num) * (int(self.low[level + 1]) - 1) // self.num
        return d, 1 if not d else int(np.ceil(ROOM * (d + 1)))


def keys_of(hashes: np.ndarray, levels: Levels) -> np.ndarray:
    """The keys that a set is entered under.

    Two sets of a pair agree on at least groups - D groups.  If one of them has no more than groups - D - 1 empty groups,
    they agree on one that isn't empty; else the set is entered under its empty groups too.
    """
    out = []
    totals = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(hashes), dtype=np.uint64)])
    for level in levels.of(len(hashes)):
        d, m = levels.groups(level)
        group = ((hashes >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        sizes = np.bincount(group.astype(np.int64), minlength=m)
        ends = np.cumsum(sizes)
        key = mix64(totals[ends] - totals[ends - sizes] + np.arange(m, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF) + sizes.astype(np.uint64))
        filled = sizes > 0
        out.append(key[filled] if m - filled.sum() <= m - d - 1 else key)
    return np.concatenate(out).view(np.int64)


def bitmap(hashes: np.ndarray) -> bytes:
    """At least two bits for each hash, a power of two and 64 at least; a hash's low bits name its bit."""
    width = max(64, 1 << int(2 * len(hashes) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(hashes & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _fold(raw: bytes, width: int) -> np.ndarray:
    words = np.frombuffer(raw, np.uint64)
    while len(words) * 64 > width:
        words = words[: len(words) // 2] | words[len(words) // 2 :]
    return words


def tree_pairs(block: np.ndarray, node: np.ndarray, part: np.ndarray, size: np.ndarray, bits: list[bytes], num: int, den: int) -> np.ndarray:
    """Pairs (smaller node, larger node) of one block and different parts that no bound rules out.

    All blocks' trees are built and traversed together, level by level.
    """
    found: list[np.ndarray] = []
    narrow = np.asarray([len(b) * 8 for b in bits])
    order = np.lexsort((size, part, block))
    block, node, part, size, narrow = (x[order] for x in (block, node, part, size, narrow))
    bits = [bits[i] for i in order]
    edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    width_of = np.repeat(np.minimum.reduceat(narrow, edge), np.diff(np.concatenate([edge, [len(block)]])))
    for width in np.unique(width_of):
        at = np.flatnonzero(width_of == width)
        words = np.stack([_fold(bits[i], int(width)) for i in at])
        b, n = block[at], size[at]
        extra = n - np.bitwise_count(words).sum(axis=1).astype(np.int64)
        p = part[at]
        levels = [dict(b=b, w=words, lo=n, hi=n, e=extra, p0=p, p1=p, child=None)]
        while True:
            t = levels[-1]
            starts = np.flatnonzero(np.concatenate([[True], t["b"][1:] != t["b"][:-1]]))
            if len(starts) == len(t["b"]):
                break
            sizes = np.diff(np.concatenate([starts, [len(t["b"])]]))
            inside = np.arange(len(t["b"])) - np.repeat(starts, sizes)
            heads = np.flatnonzero(inside % FAN == 0)
            levels.append(
                dict(
                    b=t["b"][heads], w=np.bitwise_or.reduceat(t["w"], heads, axis=0), lo=np.minimum.reduceat(t["lo"], heads), hi=np.maximum.reduceat(t["hi"], heads), e=np.maximum.reduceat(t["e"], heads),
                    p0=np.minimum.reduceat(t["p0"], heads), p1=np.maximum.reduceat(t["p1"], heads), child=np.concatenate([heads, [len(t["b"])]]),
                )
            )
        roots = np.arange(len(levels[-1]["b"]))
        front_a, front_b = roots, roots
        for t in range(len(levels) - 1, -1, -1):
            level = levels[t]
            keep: list[tuple[np.ndarray, np.ndarray]] = []
            for k in range(0, len(front_a), 1 << 17):
                a, c = front_a[k : k + (1 << 17)], front_b[k : k + (1 << 17)]
                fine = ~((level["p0"][a] == level["p1"][a]) & (level["p0"][c] == level["p1"][c]) & (level["p0"][a] == level["p0"][c]))
                if not t:
                    fine &= a < c
                fine &= (level["hi"][a] * den >= level["lo"][c] * num) & (level["hi"][c] * den >= level["lo"][a] * num)
                a, c = a[fine], c[fine]
                most = np.bitwise_count(level["w"][a] & level["w"][c]).sum(axis=1).astype(np.int64) + np.minimum(level["e"][a], level["e"][c])
                most = np.minimum(most, np.minimum(level["hi"][a], level["hi"][c]))
                fine = most * (num + den) >= num * (level["lo"][a] + level["lo"][c])
                keep.append((a[fine], c[fine]))
            front_a, front_b = (np.concatenate([x[i] for x in keep]) if keep else np.empty(0, np.int64) for i in (0, 1))
            if t and len(front_a):
                child = level["child"]
                na, nb = child[front_a + 1] - child[front_a], child[front_b + 1] - child[front_b]
                many = na * nb
                owner = np.repeat(np.arange(len(many)), many)
                inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                left = child[front_a][owner] + inner // nb[owner]
                right = child[front_b][owner] + inner % nb[owner]
                upper = left <= right
                front_a, front_b = left[upper], right[upper]
        x, y = node[at][front_a], node[at][front_b]
        found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
    every = np.concatenate(found) if found else np.empty((0, 2), np.int64)
    return np.unique(every, axis=0)


_SCAN = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("keys", pa.list_(pa.int64())), ("bits", pa.binary())])


def _scan(docs: DataFrame, n: int, levels: Levels) -> DataFrame:
    """Per row its set's size and 128-bit hash; keys and bitmap for the first row of a set with a doc_id in each task."""

    def run(batches):
        seen: set = set()
        for batch in batches:
            texts, named = batch.column("text"), batch.column("doc_id").is_valid().to_pylist()
            for a, b in slices(texts, 3_000_000):
                sets = shingle_sets(texts.slice(a, b - a).to_pylist(), n)
                digests = [xxhash.xxh3_128_digest(s) for s in sets]
                fresh = []
                for s, d, has_id in zip(sets, digests, named[a:b]):
                    fresh.append(has_id and len(s) > 0 and d not in seen)
                    if has_id and len(seen) < 1_000_000:
                        seen.add(d)
                both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]),
                        pa.array([keys_of(s, levels) if f else None for s, f in zip(sets, fresh)], pa.list_(pa.int64())), pa.array([bitmap(s) if f else None for s, f in zip(sets, fresh)], pa.binary()),
                    ],
                    schema=_SCAN,
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, h1 long, h2 long, keys array<long>, bits binary")


#: Bits of the filter that tells the second scan which texts it needs: a fixed 4 MB, however many documents there are.
FILTER_BITS = 25


def _filter(ids: DataFrame) -> bytes:
    """A bitmap of hashed ids, built in 64 parts by executors; it may say yes too often, never no to a listed id."""
    place = F.expr(f"shiftrightunsigned(xxhash64(doc_id), {64 - FILTER_BITS})")
    part_bits = FILTER_BITS - 6

    def run(batches):
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            p = np.asarray(batch.column("p"))
            for k in np.unique(p >> part_bits):
                bits = parts.setdefault(int(k), np.zeros(1 << part_bits, bool))
                bits[p[p >> part_bits == k] & ((1 << part_bits) - 1)] = True
        for k, bits in parts.items():
            yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros((64, 1 << (part_bits - 3)), np.uint8)
    placed = ids.select(place.alias("p")).distinct().withColumn("k", F.shiftright("p", part_bits)).repartition(64, "k").select("p")
    for row in placed.mapInArrow(run, "k long, bits binary").toLocalIterator():
        out[row.k] |= np.frombuffer(row.bits, np.uint8)
    return out.tobytes()


def _sets(docs: DataFrame, need: DataFrame, n: int) -> DataFrame:
    """doc_id and set of the needed documents (and of a few others): the texts are read again, none is shuffled."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter(need))

    def run(batches):
        have = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            p = np.asarray(batch.column("p"))
            batch = batch.filter(pa.array((have[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1))
            texts = batch.column("text")
            for a, b in slices(texts, 3_000_000):
                sets = shingle_sets(texts.slice(a, b - a).to_pylist(), n)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "hashes"])

    source = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    source = source.withColumn("p", F.expr(f"shiftrightunsigned(xxhash64(doc_id), {64 - FILTER_BITS})"))
    return source.mapInArrow(run, "doc_id long, hashes binary")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (x, y) whose sets, compared in full, are similar enough."""

    def run(batches):
        for batch in batches:
            x, y = batch.column("hx").to_pylist(), batch.column("hy").to_pylist()
            fine = []
            for s, t in zip(x, y):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                if len(s) > len(t):
                    s, t = t, s
                both = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum()) if len(t) else 0
                fine.append(both > 0 and both * den >= num * (len(s) + len(t) - both))
            yield batch.select(["x", "y"]).filter(pa.array(fine, pa.bool_()))

    with_x = pairs.join(sets.select(F.col("doc_id").alias("x"), F.col("hashes").alias("hx")), "x")
    with_y = with_x.join(sets.select(F.col("doc_id").alias("y"), F.col("hashes").alias("hy")), "y")
    return with_y.select("x", "y", "hx", "hy").mapInArrow(run, "x long, y long")


def _blocks(members: DataFrame, scratch: Scratch, num: int, den: int) -> DataFrame:
    """Candidate pairs of ``members(key, node, part, n, bits)``: a tree for each key, or for each two cuts of a hot key."""
    # rows of a key -> number of cuts; a member of cut c meets every other cut in a block of the two
    cuts = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("cuts"))
    own = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    spread = members.join(cuts, "key").withColumn("c", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    spread = spread.select("key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "node", "part", "n", "bits")
    dealt = spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches):
        rest = None

        def pairs(t: pa.Table):
            cols = [np.asarray(t.column(c)) for c in ("key", "i", "j")]
            block = np.cumsum(np.concatenate([[False], np.any([c[1:] != c[:-1] for c in cols], axis=0)]))
            got = tree_pairs(block, np.asarray(t.column("node")), np.asarray(t.column("part")), np.asarray(t.column("n")), t.column("bits").to_pylist(), num, den)
            return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["x", "y"])

        for batch in batches:
            for a in range(0, batch.num_rows, 8192):
                t = pa.Table.from_batches([batch.slice(a, 8192)])
                rest = t if rest is None else pa.concat_tables([rest, t])
                key, i, j = (np.asarray(rest.column(c)) for c in ("key", "i", "j"))
                whole = np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1]))
                if len(whole):
                    yield pairs(rest.slice(0, int(whole[-1]) + 1))
                    rest = rest.slice(int(whole[-1]) + 1)
        if rest is not None:
            yield pairs(rest)

    return dealt.mapInArrow(run, "x long, y long").distinct()


def ngram_join(spark: SparkSession, docs: DataFrame, n: int = 5, similarity: tuple[int, int] = (8, 10), scratch: Scratch | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles (size of its set), component_id (smallest doc_id reachable by links).

    Documents link when their sets' Jaccard similarity is at least ``similarity`` (a fraction num/den).  Empty sets (null
    text, no words) link with nothing.  Rows that share a doc_id are one document.  A null doc_id has a null component
    and links with nothing.  Other columns are not read; an empty table gives no rows.
    """
    num, den = similarity
    levels = Levels(num, den)
    scratch = scratch or Scratch(spark, "ngram-join")
    rows = scratch.table(_scan(docs, n, levels), "sets")
    full = rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull())

    # copies of one set: the smallest id stands for them
    classes = full.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    same = scratch.table(full.select("doc_id", "n", "h1", "h2").join(classes, ["h1", "h2"]).where("copies > 1").select("doc_id", "node"), "copies")

    # sets go by their class's node from here on, whichever copy a task saw first
    first_seen = full.where(F.col("keys").isNotNull()).join(classes.where("copies > 1").select("h1", "h2", "node"), ["h1", "h2"], "left")
    first_seen = first_seen.withColumn("node", F.coalesce("node", "doc_id"))

    # the keys that several nodes share, and their members
    entered = first_seen.select(F.explode("keys").alias("key"), "node").repartition("key")
    shared = entered.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key", "low")
    members = scratch.table(entered.join(shared, "key").select("key", "node", "low"), "members")

    # round one: each node and the first node of the key group it shares most of
    votes = members.where("node <> low").groupBy("node", "low").count()
    best = votes.groupBy("node").agg(F.max_by("low", F.struct("count", -F.col("low"))).alias("low"))
    first = best.select(F.greatest("node", "low").alias("x"), F.least("node", "low").alias("y")).distinct()
    need = scratch.table(members.select(F.col("node").alias("doc_id")).distinct(), "needed")
    sets = scratch.table(_sets(docs, need, n).join(need, "doc_id", "left_semi"), "hashes")
    links = scratch.table(_verified(first, sets, num, den), "links")
    parts = scratch.table(components(links, scratch), "parts")

    # round two: trees over the keys that several components still share
    placed = members.select("key", "node").distinct()
    placed = placed.join(parts.withColumnRenamed("component", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    open_ = placed.groupBy("key").agg(F.min("part").alias("p0"), F.max("part").alias("p1")).where("p0 < p1").select("key")
    shapes = first_seen.select("node", "h1", "h2", "n", "bits").dropDuplicates(["node", "h1", "h2"])
    pairs = _blocks(placed.join(open_, "key", "left_semi").join(shapes, "node").select("key", "node", "part", "n", "bits"), scratch, num, den)
    more = scratch.table(_verified(scratch.table(pairs, "pairs"), sets, num, den), "links")

    every = links.select("x", "y").unionByName(more.select("x", "y")).unionByName(same.where("doc_id <> node").select(F.col("doc_id").alias("x"), F.col("node").alias("y")))
    final = scratch.table(components(every, scratch), "components")
    scratch.drop(sets, members, need)
    return rows.select("doc_id", F.col("n").alias("n_shingles")).join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, n: int = 5, similarity: tuple[int, int] = (8, 10)) -> DataFrame:
    """``docs`` with one row of each component: the one of the smallest doc_id.

    Each row counts by its own text, also if several share a doc_id: unlike texts of one doc_id all stay, and of equal ones one.
    Rows without words (null, empty) and rows without a doc_id are in no component and stay, each of them.  An empty table gives an
    empty one; extra columns are kept.
    """
    scratch = Scratch(spark, "near-duplicates")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.where(F.col("doc_id").isNotNull())
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        judged = scratch.table(ngram_join(spark, docs, n, similarity), "components")
        kept = docs.join(judged.where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi")
        return kept.unionByName(docs.where(F.col("doc_id").isNull())).select(*columns)
    # rows go by numbers of their own; they are written once, so that the numbers hold
    row = fresh(docs, "row")
    rows = scratch.table(named.withColumn(row, F.monotonically_increasing_id()), "rows")
    judged = scratch.table(ngram_join(spark, rows.select(F.col(row).alias("doc_id"), "text"), n, similarity), "components")
    ids = rows.select(F.col(row).alias("row"), "doc_id")
    placed = judged.select(F.col("doc_id").alias("row"), "component_id").join(ids, "row")
    first = placed.groupBy("component_id").agg(F.min_by("row", F.struct("doc_id", "row")).alias(row))
    return rows.join(first.select(row), row, "left_semi").select(*columns).unionByName(docs.where(F.col("doc_id").isNull()).select(*columns))
