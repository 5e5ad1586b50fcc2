"""Fuzzy line deduplication by MinHash, in DataFrame operations only.

Lines (lower-cased, white space collapsed) are cut into stretches of a fixed number of shingle starts, one row each, whose
shingles are hashed by generated code.  The hash circle is cut into ``bands * rows`` buckets; a line's min-hash of a bucket is the
smallest of its hashes there (of the next bucket that has one, if there is none), so the stretches of a line, and all copies
of a line, meet in one map-side combined aggregation of fixed-size minima: no text is shuffled for signatures.  A band packs
16 bits of each of its min-hashes; lines that agree in a whole band are candidates.  Candidates that agree in too few of all
min-hashes are dropped (four standard deviations below what the least similarity gives), and so are those that must differ
in too many shingles: a line's parity map has for each bit whether an odd number of its shingles falls on it, so two lines
differ in as many shingles at least as their maps do in bits.  The others are compared by the
Jaccard similarity of *all* their character shingles; links are joined to components by distributed union-find, and of each
component the first line (by doc_id, then text, then place) stays.

Rounds whose work is linear in the rows of a band unite most of a crowded band: each line first meets the first line of each of its
bands; then, while a crowded band's lines are not one component yet, the others meet a member chosen by hash.  In bands that
hold several components even then, all members of different components meet, in bounded blocks: no candidate is left out.
There the maps tell most pairs apart within the join, which gives a row for hardly more than the pairs that are similar.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Filter, Scratch, fresh
from .components import components

#: A row without doc_id comes last.
_LAST = (1 << 63) - 1
#: Shingle starts of a stretch; members of a band that meet others of it in one block.
_STRETCH, _BLOCK = 64, 1024
#: The columns of a line's parity map, of 64 bits each.
_MAP = [f"p{w}" for w in range(16)]


def _once(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normal(line: Column) -> Column:
    """Lower-cased, runs of white space as one space, none at the ends."""

    def tidy(low: Column) -> Column:
        odd = reduce(lambda a, b: a | b, [F.contains(low, F.lit(s)) for s in ("  ", "\t", "\r", "\f", "\x0b")])
        return F.trim(F.when(odd, F.regexp_replace(low, r"\s+", " ")).otherwise(low))

    return _once(F.lower(line), tidy)


def _rows(docs: DataFrame) -> list[Column]:
    """What names a row: its doc_id, and a hash of its text for rows that share one."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tag")]


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    split = F.transform(F.split("text", "\n"), normal)
    return docs.select(*_rows(docs), F.posexplode(split).alias("place", "line")).where(F.length("line") >= min_chars)


def _keyed(lines: DataFrame) -> DataFrame:
    """With 128 bits that stand for the line's text."""
    return lines.withColumns({"k1": F.xxhash64("line"), "k2": F.xxhash64(F.lit(7), "line")})


def _apart(value: Column | str) -> Column:
    """``value`` by way of a lambda, which keeps a projection of many expressions out of whole-stage code: there they would make
    one method, too long for the compiler; by itself a projection is split into short ones."""
    return _once(F.col(value) if isinstance(value, str) else value, lambda x: x)


def _signatures(lines: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """k1, k2, n (occurrences) and sketch (a packed long for each band) of every distinct line."""
    buckets = bands * rows
    points = [i * (1 << 32) // buckets - (1 << 31) for i in range(buckets)]
    width = 4 * k
    starts = lambda u: F.sequence(F.lit(1), F.greatest(F.octet_length(u) - width + 1, F.lit(1)), F.lit(4 * _STRETCH))
    cut = _once(F.encode("line", "UTF-32"), lambda u: F.transform(starts(u), lambda i: F.substring(u, i, F.lit(4 * _STRETCH + width - 4))))
    stretches = _keyed(lines).select("k1", "k2", F.posexplode(cut).alias("turn", "part"))
    hashes = F.array(*[F.hash(F.substring("part", 4 * j + 1, width)) for j in range(_STRETCH)])
    hashed = stretches.select("k1", "k2", "turn", F.slice(hashes, 1, F.greatest((F.octet_length("part") / 4).cast("int") - k + 1, F.lit(1))).alias("h"))
    ends = F.array(*[F.lit(p) for p in points])
    # (a stretch always has hashes; that ``h`` is read twice keeps Spark from moving it into the next, uncompiled projection)
    counted = ((F.col("turn") == 0) & (F.size("h") > 0)).cast("long")
    marked = hashed.select("k1", "k2", counted.alias("n"), F.sort_array(F.concat("h", ends)).alias("m"))
    # what follows a bucket's first point in order is its smallest hash, or the next bucket's point, larger than any, if it has none
    least = [F.get("m", F.array_position("m", F.lit(p)).cast("int")) for p in points]
    met = marked.select("k1", "k2", _apart("n").alias("n"), *[x.alias(f"m{i}") for i, x in enumerate(least)])
    met = met.groupBy("k1", "k2").agg(F.sum("n").alias("n"), *[F.min(f"m{i}").alias(f"m{i}") for i in range(buckets)])
    # an empty bucket takes what the next one on the circle has
    some = met.select("k1", "k2", _apart("n").alias("n"), F.array_except(F.array_compact(F.array(*[F.col(f"m{i}") for i in range(buckets)])), ends).alias("h"))
    some = some.select("k1", "k2", _apart("n").alias("n"), F.concat("h", F.slice("h", 1, 1)).alias("h"), F.sort_array(F.concat("h", ends)).alias("m"))
    low = [F.element_at("h", (F.array_position("m", F.lit(p)) - i).cast("int")).cast("long").bitwiseAND(F.lit(0xFFFF)) for i, p in enumerate(points)]

    def packed(b: int) -> Column:
        return reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(low[b + bands * r], 16 * r) for r in range(rows)])

    return some.select("k1", "k2", _apart("n").alias("n"), F.array(*[packed(b) for b in range(bands)]).alias("sketch"))


def _agreement(a: str, b: str, bands: int, rows: int) -> Column:
    """In how many min-hashes two sketches agree."""

    def differing(i: int) -> Column:
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        for shift in (8, 4, 2, 1):  # any set bit of a field ends in its lowest bit
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(int(f"{(1 << 16 - shift) - 1:04x}" * rows, 16))))
        return F.bit_count(x.bitwiseAND(F.lit(int("0001" * rows, 16))))

    return F.lit(bands * rows) - reduce(lambda x, y: x + y, [differing(i) for i in range(bands)])


def _shingles(line: str, k: int) -> Column:
    """The set of a line's k-character shingles, as 64-bit hashes.  A line of up to k characters is one shingle."""
    width = 4 * k
    starts = lambda u: F.sequence(F.lit(1), F.greatest(F.octet_length(u) - width + 1, F.lit(1)), F.lit(4))
    return F.array_distinct(_once(F.encode(F.col(line), "UTF-32"), lambda u: F.transform(starts(u), lambda i: F.xxhash64(F.substring(u, i, F.lit(width))))))


def _maps(texts: DataFrame, k: int) -> DataFrame:
    """id, size (distinct shingles) and the parity map of every line of ``texts`` (id, line)."""
    each = texts.select("id", F.explode(_shingles("line", k)).alias("h"))
    word, bit = F.shiftrightunsigned("h", 60), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("h", 54).bitwiseAND(F.lit(63)).cast("int"))
    marked = each.select("id", word.alias("word"), bit.alias("bit"))
    return marked.groupBy("id").agg(F.count(F.lit(1)).alias("size"), *[F.bit_xor(F.when(F.col("word") == w, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(p) for w, p in enumerate(_MAP)])


def _near(u: str, v: str, similarity: float) -> Column:
    """False only for lines whose sets are surely not similar enough (columns size and map with the endings ``u`` and ``v``).

    |a ^ b| <= (|a| + |b|) * (1 - t) / (1 + t) holds if |both| >= t * |either|; what is added is less than a shingle and more than rounding.
    """
    differing = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{p}{u}").bitwiseXOR(F.col(f"{p}{v}"))) for p in _MAP])
    return differing <= (F.col(f"size{u}") + F.col(f"size{v}")) * ((1 - similarity) / (1 + similarity)) + 1e-3


def _similar(pairs: DataFrame, a: str, b: str, k: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` whose lines ``a`` and ``b`` have similar enough sets of shingles.

    Each set is a column that is read twice, so Spark makes it once.
    """
    sets = pairs.select("u", "v", _shingles(a, k).alias("a"), _shingles(b, k).alias("b"))
    counts = sets.select("u", "v", F.size(F.array_intersect("a", "b")).alias("both"), (F.size("a") + F.size("b")).alias("sizes"))
    # |both| >= t * |either|, with |either| = sizes - |both|; what is added is less than a shingle and more than rounding
    return counts.where(F.col("both") * (1 + similarity) + 1e-6 >= F.col("sizes") * similarity).select("u", "v")


def _across(open_: DataFrame, fit) -> DataFrame:
    """All fitting pairs (u > v) of one band and different components; a hot band's members meet in blocks of two cuts of it."""
    cuts = open_.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / _BLOCK).cast("int").alias("cuts"))
    dealt = open_.join(cuts, "band").withColumn("own", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    names = ["id", "part", "sketch", "size", *_MAP]
    a = dealt.select("band", F.col("own").alias("i"), F.col("other").alias("j"), *[F.col(c).alias(f"{c}_u") for c in names])
    b = dealt.select("band", F.col("other").alias("i"), F.col("own").alias("j"), *[F.col(c).alias(f"{c}_v") for c in names])
    met = a.join(b, ["band", "i", "j"]).where((F.col("id_u") > F.col("id_v")) & (F.col("part_u") != F.col("part_v"))).where(fit("_u", "_v"))
    return met.select(F.col("id_u").alias("u"), F.col("id_v").alias("v")).distinct()


def line_components(scratch: Scratch, lines: DataFrame, k: int, similarity: float, bands: int, rows: int, rounds: int) -> DataFrame:
    """k1, k2, part of every line that occurs twice or is linked: ``part`` is one for all lines of a component."""
    signatures = scratch.table(_signatures(lines, k, bands, rows).withColumn("id", F.monotonically_increasing_id()), "signatures")
    scratch.release()

    # a band's lines meet in one exchange, which both the count and the join use
    members = signatures.select("id", F.explode(F.array_distinct("sketch")).alias("band")).repartition("band")
    crowded = members.groupBy("band").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("band", "lo")
    held = scratch.table(members.join(crowded, "band").select("band", "id", "lo"), "members")
    scratch.release()

    # sketches and texts of candidates, these by the first of a line's copies that comes
    candidates = scratch.table(signatures.select("k1", "k2", "id", "sketch").join(held.select("id").distinct(), "id"), "candidates")
    wanted = candidates.select("k1", "k2", "id")
    likely = Filter(wanted, "k1").mark(_keyed(lines.select("line")), "likely", "k1").where("likely").drop("likely")
    texts = scratch.table(likely.groupBy("k1", "k2").agg(F.first("line").alias("line")).join(wanted, ["k1", "k2"]).select("id", "line"), "texts")
    told = scratch.table(_maps(texts, k).join(candidates.select("id", "sketch"), "id"), "maps")
    scratch.drop(candidates)

    total = bands * rows
    least = int(total * similarity - 4 * (total * similarity * (1 - similarity)) ** 0.5)
    # (the last term, always true, keeps this long condition out of whole-stage code, see _apart; it names both sides, so that a join holds it too)
    fit = lambda u, v: _near(u, v, similarity) & (_agreement(f"sketch{u}", f"sketch{v}", bands, rows) >= least) & F.exists(F.array(f"sketch{u}", f"sketch{v}"), lambda x: x.isNotNull())

    def fitting(pairs: DataFrame) -> DataFrame:
        named = lambda x: told.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("sketch", "size", *_MAP)])
        return pairs.join(named("u"), "u").join(named("v"), "v").where(fit("_u", "_v")).select("u", "v")

    tried: list[DataFrame] = []

    def similar(pairs: DataFrame) -> DataFrame:
        """Of fitting pairs that were not compared before those that are similar, all shingles compared."""
        for old in tried:
            pairs = pairs.join(old, ["u", "v"], "left_anti")
        tried.append(scratch.table(pairs, "tried"))
        with_u = tried[-1].join(texts.select(F.col("id").alias("u"), F.col("line").alias("lu")), "u")
        with_v = with_u.join(texts.select(F.col("id").alias("v"), F.col("line").alias("lv")), "v")
        return scratch.table(_similar(with_v, "lu", "lv", k, similarity), "links")

    def opened(parts: DataFrame) -> DataFrame:
        """band, id, part of the bands that hold several components."""
        placed = held.select("band", "id").join(parts.select(F.col("node").alias("id"), F.col("component").alias("part")), "id", "left").withColumn("part", F.coalesce("part", "id"))
        several = placed.groupBy("band").agg(F.min("part").alias("p0"), F.max("part").alias("p1")).where("p0 < p1").select("band")
        return scratch.table(placed.join(several, "band"), "open")

    # first each line meets the first line of each of its bands
    links = similar(fitting(held.where("id <> lo").select(F.greatest("id", "lo").alias("u"), F.least("id", "lo").alias("v")).distinct()))
    parts = scratch.table(components(links, scratch), "parts")
    # then, while a band of several components is crowded, its lines meet some members of other components, chosen by hash
    open_ = opened(parts)
    for turn in range(rounds):
        if open_.groupBy("band").count().where(F.col("count") > _BLOCK).isEmpty():
            break
        centres = open_.groupBy("band").agg(F.min_by(F.struct("id", "part"), F.xxhash64("id", F.lit(turn))).alias("c"))
        met = open_.join(centres, "band").where(F.col("part") != F.col("c.part"))
        links = links.unionByName(similar(fitting(met.select(F.greatest("id", "c.id").alias("u"), F.least("id", "c.id").alias("v")).distinct())))
        parts = scratch.table(components(links, scratch), "parts")
        open_ = opened(parts)
    # at last, in bands that hold several components even now, all members of different ones that can fit
    links = links.unionByName(similar(_across(open_.join(told, "id"), fit)))
    parts = scratch.table(components(links, scratch), "parts")
    scratch.drop(held, texts, told)
    scratch.release()
    grouped = signatures.select("k1", "k2", "id", "n").join(parts.select(F.col("node").alias("id"), "component"), "id", "left")
    return grouped.where("n > 1 OR component IS NOT NULL").select("k1", "k2", F.coalesce("component", "id").alias("part"))


def without(lines: Column, places: Column) -> Column:
    """An array without its elements at the given places (from 0, each once): the runs between them, so that the work grows with the array's length."""

    def rest(s: Column) -> Column:
        begin = lambda j: F.when(j == 0, 1).otherwise(F.get(s["at"], j - 1) + 2)
        end = lambda j: F.coalesce(F.get(s["at"], j), F.size(s["all"]))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(s["at"])), lambda j: F.slice(s["all"], begin(j), end(j) - begin(j) + 1)))

    # bound as one element, both arrays are made once and not for each run
    return F.get(F.transform(F.array(F.struct(lines.alias("all"), F.array_sort(places).alias("at"))), rest), F.lit(0))


def line_dedup(
    spark: SparkSession,
    docs: DataFrame,
    *,
    k: int = 8,
    similarity: float = 0.8,
    bands: int = 10,
    rows: int = 4,
    rounds: int = 2,
    min_chars: int = 8,
    drop_emptied: bool = False,
) -> DataFrame:
    """``docs`` with its own columns and new texts, plus n_lines and n_removed (replaced if there).

    Of each component of similar lines the first (by doc_id, then text, then place in the text) stays, every other line goes
    with its line end.  Lines of fewer than ``min_chars`` characters (blank ones too) are left alone.  Null texts stay null
    and have 0 lines; empty texts have one blank line.  Rows that share doc_id and text share their decisions; rows that share
    only the doc_id are told apart; null doc_ids come last.  An empty table gives no rows; other columns pass through,
    whatever their names.  A line of any length is compared whole (in memory of some ten times its size).
    ``drop_emptied``: leave out documents that lost lines and keep none but blank ones.  ``rows``: 4 at most.
    """
    if not 1 <= rows <= 4:
        raise ValueError("rows: 1 to 4 min-hashes in a band")
    scratch = Scratch(spark, "line-dedup")
    lines = scratch.table(_lines(docs, min_chars), "lines")
    grouped = scratch.table(line_components(scratch, lines, k, similarity, bands, rows, rounds), "groups")
    # the occurrences of lines that are in a group of several
    likely = Filter(grouped, "k1").mark(_keyed(lines).select("doc", "tag", "place", "k1", "k2"), "likely", "k1").where("likely").drop("likely")
    found = scratch.table(likely.join(grouped, ["k1", "k2"]).select("doc", "tag", "place", "part"), "occurrences")
    first = found.groupBy("part").agg(F.min(F.struct("doc", "tag", "place")).alias("first"))
    gone = found.join(first, "part").where(F.struct("doc", "tag", "place") != F.col("first"))
    cuts = scratch.table(gone.groupBy("doc", "tag").agg(F.collect_set("place").alias("cut")), "cuts")
    scratch.drop(lines, grouped, found)
    scratch.release()

    # texts that lose nothing are not sent anywhere
    doc, tag, cut, touched = (fresh(docs, c) for c in ("doc", "tag", "cut", "touched"))
    name_doc, name_tag = _rows(docs)
    named = docs.withColumn(doc, name_doc).withColumn(tag, name_tag)
    marked = Filter(cuts, "doc", "tag").mark(named, touched, doc, tag)
    other = cuts.select(F.col("doc").alias(doc), F.col("tag").alias(tag), F.col("cut").alias(cut))
    out = marked.where(F.col(touched)).join(other, [doc, tag], "left").unionByName(marked.where(~F.col(touched)).withColumn(cut, F.lit(None).cast("array<int>")))
    old = F.split("text", "\n")
    new = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(without(old, F.col(cut)), "\n"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    columns = [(new if c == "text" else F.col(f"`{c}`")).alias(c) for c in names]
    out = out.select(*columns, F.when(F.col("text").isNull(), 0).otherwise(F.size(old)).cast("long").alias("n_lines"), F.coalesce(F.size(cut), F.lit(0)).cast("long").alias("n_removed"))
    if drop_emptied:
        out = out.where((F.col("n_removed") == 0) | (F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) > 0))
    return out


def shingle_jaccard(a: str, b: str, k: int = 8) -> float:
    """The measure, for tests: of two normalised lines."""
    sets = [{x[i : i + k] for i in range(len(x) - k + 1)} if len(x) > k else {x} for x in (a, b)]
    return len(sets[0] & sets[1]) / len(reduce(set.union, sets))
