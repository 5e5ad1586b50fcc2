"""Secret scans: known forms by pattern, and random strings by token efficiency.

Words and names were seen by whoever made a vocabulary and take few tokens; a random string takes a token for every one or two
characters.  So a run of key characters is a secret if it has at most ``ratio`` characters per token, and isn't a digest, a UUID,
a number, a date or a name by its form, nor one of the strings that the caller knows.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, held, slices

#: Fixed by the definition: kinds with their patterns, the group whose length counts, and its least length.
BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
]
KINDS = [kind for kind, *_ in BASE] + ["random"]

#: Runs that the test looks at. Longer ones are encoded in pieces of this length, so that time stays linear.
CANDIDATE, PIECE = re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 512
RATIO = 2.0
#: Digests by their length in hexadecimal, with or without a label; UUIDs; integrity labels.
_DIGEST = re.compile(r"(?:(?:md5|sha-?\d+)[-=_/+]+)?(?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{56}|[0-9A-Fa-f]{64}|[0-9A-Fa-f]{96}|[0-9A-Fa-f]{128})", re.IGNORECASE)
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_INTEGRITY = re.compile(r"(?:sha256|sha384|sha512)-[A-Za-z0-9+/]+={0,2}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the matches of each kind, leftmost and non-overlapping, too short ones dropped."""
    return [(m.start(), k, m.end()) for k, (_, pattern, group, least) in enumerate(BASE) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]


def known_form(s: str) -> bool:
    """Digests, UUIDs and integrity values; numbers, dates and times; names, which hold no digit and seldom switch case."""
    if _DIGEST.fullmatch(s) or _UUID.fullmatch(s) or _INTEGRITY.fullmatch(s):
        return True
    digits = sum(map(s.count, "0123456789"))
    if digits:
        return 5 * sum(map(str.isalpha, s)) <= len(s)
    return 4 * sum(a.islower() != b.islower() for a, b in zip(s, s[1:])) < len(s)


class Efficiency:
    """Characters per token under a tiktoken vocabulary."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ratio(self, s: str) -> float:
        return len(s) / sum(len(self.encode(s[k : k + PIECE])) for k in range(0, len(s), PIECE))


def random_spans(text: str, efficiency: Efficiency, ratio: float) -> list[tuple[int, int, int]]:
    kind = len(BASE)
    return [(m.start(), kind, m.end()) for m in CANDIDATE.finditer(text) if not known_form(m.group()) and efficiency.ratio(m.group()) <= ratio]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def all_spans(base: list, more: list) -> list:
    """Base spans and those of ``more`` that no single base span covers, in order."""
    return sorted(base + [x for x in more if not any(a <= x[0] and x[2] <= b for a, _, b in base)])


def find_secrets(spark: SparkSession, docs: DataFrame, vocabulary: str, ratio: float = RATIO, known: DataFrame | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    A span is ``kind:start:end`` of a whole match, in code points, end exclusive, in order of start and kind.  ``vocabulary`` is
    a tiktoken file; ``known(value)`` lists strings that are no secrets for the test (public digests, keys of examples): spans
    of kind random with one of these values go, base ones stay.  Null and empty texts have no spans; repeated rows are judged
    each for itself; texts are read as a whole; extra columns are not read.
    """
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if known is not None:
        return _less_known(spark, source, vocabulary, ratio, known, schema)

    def run(batches):
        test = held(f"efficiency {vocabulary}", lambda: Efficiency(vocabulary))
        for batch in batches:
            for at, to in slices(batch.column("text"), 8_000_000):
                some = batch.slice(at, to - at)
                base, spans = [], []
                for text in some.column("text").to_pylist():
                    base.append(sorted(base_spans(text or "")))
                    spans.append(all_spans(base[-1], random_spans(text or "", test, ratio)))
                yield _result(some.column("doc_id"), base, spans, names)

    return source.mapInArrow(run, schema)


def _result(doc_ids, base: list, spans: list, names: list[str]) -> pa.RecordBatch:
    counts = np.asarray([np.bincount([k for _, k, _ in found], minlength=len(BASE)) if found else np.zeros(len(BASE), np.int64) for found in base], np.int64).reshape(-1, len(BASE))
    digests = [hashlib.sha256(joined(found).encode()).hexdigest() for found in base]
    return pa.RecordBatch.from_arrays([doc_ids, *[pa.array(counts[:, k]) for k in range(len(BASE))], pa.array(digests, pa.string()), pa.array([joined(x) for x in spans], pa.string())], names)


def _less_known(spark, source: DataFrame, vocabulary: str, ratio: float, known: DataFrame, schema: str) -> DataFrame:
    """The random strings meet the known ones in a join, each by its value; rows are written once, so their numbers hold."""
    scratch = Scratch(spark, "secrets")

    def run(batches):
        test = held(f"efficiency {vocabulary}", lambda: Efficiency(vocabulary))
        for batch in batches:
            for at, to in slices(batch.column("text"), 8_000_000):
                some = batch.slice(at, to - at)
                texts = [t or "" for t in some.column("text").to_pylist()]
                base = [sorted(base_spans(t)) for t in texts]
                more = [[x for x in random_spans(t, test, ratio) if x in all_spans(b, [x])] for t, b in zip(texts, base)]
                cols = [[[{"start": a, "kind": k, "end": e, "value": t[a:e] if k == len(BASE) else None} for a, k, e in found] for t, found in zip(texts, which)] for which in (base, more)]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), *[pa.array(c, _SPANS) for c in cols]], ["doc_id", "base", "more"])

    span = "array<struct<start:int,kind:int,end:int,value:string>>"
    found = source.mapInArrow(run, f"doc_id long, base {span}, more {span}").withColumn("row", F.monotonically_increasing_id())
    found = scratch.table(found, "spans")
    values = found.select("row", F.explode("more").alias("x")).select("row", "x", F.col("x.value").alias("value"))
    kept = values.join(known.select(F.col("value").cast("string").alias("value")).distinct(), "value", "left_anti").groupBy("row").agg(F.collect_list("x").alias("kept"))  # one row's spans
    both = found.join(kept, "row", "left").select("doc_id", "base", F.coalesce("kept", F.array().cast(span)).alias("kept"))

    def finish(batches):
        for batch in batches:
            lists = [[sorted((x["start"], x["kind"], x["end"]) for x in row) for row in batch.column(c).to_pylist()] for c in ("base", "kept")]
            yield _result(batch.column("doc_id"), lists[0], [sorted(a + b) for a, b in zip(*lists)], [f.split()[0] for f in schema.split(", ")])

    return both.mapInArrow(finish, schema)


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
