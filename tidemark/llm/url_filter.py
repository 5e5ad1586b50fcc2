"""URL filter rules in a sorted array of 64-bit digests, memory-mapped and probed by binary search.

A rule is (host, path): it fits its host and every subdomain, where the URL's path starts with the rule's.  Rules lie in
a file as a sorted array of xxhash64 digests of ``host path`` keys plus the full strings; a batch of URLs is turned into the keys that could match
(each host suffix at a label x each path prefix of a length that some rule has), all digests are searched at once, and a
found digest counts only if the stored string is the key's, so colliding digests can't match.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Rules may be broadcast up to this many bytes of strings; a longer list is split over several passes of this size.
MOST_RULE_BYTES = 64 << 20


class DigestArray:
    """A sorted digest array in one file: uint64 digests, int64 string offsets, uint8 verdicts, string bytes."""

    def __init__(self, path: str):
        self.raw = np.memmap(path, np.uint8, "r")
        n, size = np.frombuffer(self.raw[:16], np.int64)
        self.digests = self.raw[16 : 16 + 8 * n].view(np.uint64)
        self.offsets = self.raw[16 + 8 * n : 24 + 16 * n].view(np.int64)
        self.allow = self.raw[24 + 16 * n : 24 + 17 * n]
        self.text = self.raw[24 + 17 * n : 24 + 17 * n + size]

    @staticmethod
    def build(rules: list[tuple[bytes, bool]]) -> bytes:
        """rules: (key, allow). A key given twice keeps ``block``, the stricter verdict."""
        kept: dict[bytes, bool] = {}
        for key, allow in rules:
            kept[key] = kept.get(key, True) and allow
        order = sorted((xxhash.xxh64_intdigest(k), k) for k in kept)
        ends = np.cumsum([0, *(len(k) for _, k in order)], dtype=np.int64)
        return b"".join([np.asarray([len(order), ends[-1]], np.int64).tobytes(), np.asarray([d for d, _ in order], np.uint64).tobytes(), ends.tobytes(), bytes(int(kept[k]) for _, k in order), b"".join(k for _, k in order)])

    def probe(self, keys: list[bytes]) -> np.ndarray:
        """The place of each key, or -1: one vectorised binary search, then the strings are compared."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.digests) or not keys:
            return out
        digests = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, digests)
        for i in np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == digests).tolist():
            p = int(at[i])
            while p < len(self.digests) and self.digests[p] == digests[i]:
                if self.text[self.offsets[p] : self.offsets[p + 1]].tobytes() == keys[i]:
                    out[i] = p
                    break
                p += 1
        return out


def parse_rule(rule: str) -> tuple[str, str]:
    """``example.net/en/`` -> (example.net, /en/)."""
    host, slash, path = rule.partition("/")
    return host, slash + path


def split_url(column):
    """(host, path) of a URL column, by built-in functions; both empty for null or no ``://``."""
    after = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(column, after, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(column, after, 2), F.lit(""))


def rule_parts(rules: list[tuple[str, bool]], most: int) -> list[list[tuple[str, bool]]]:
    """The rules in runs of up to ``most`` bytes of strings, one rule at least; no rules: one empty run."""
    parts: list[list[tuple[str, bool]]] = [[]]
    size = 0
    for rule in rules:
        n = len(rule[0].encode())
        if parts[-1] and size + n > most:
            parts.append([])
            size = 0
        parts[-1].append(rule)
        size += n
    return parts


def url_filter(pages: DataFrame, rules: list[tuple[str, bool]], url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict columns (columns of those names are replaced).

    rules: (``host/path``, allow).  The longest rule that fits decides; a URL that no rule fits is in no block list, so
    it is allowed.  Null URLs and URLs without ``://`` have an empty host and path: no rule fits, they are allowed.
    """
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = split_url(F.col(f"`{url}`"))
    fields = pages.select(*[F.col(f"`{c}`") for c in keep], host.alias("host"), path.alias("path"))
    out = fields
    for part in rule_parts(rules, MOST_RULE_BYTES):
        out = _judged(out, part, first=out is fields)
    return out.select(*[F.col(f"`{c}`") for c in fields.columns], "rule", "verdict")


def _judged(fields: DataFrame, rules: list[tuple[str, bool]], first: bool) -> DataFrame:
    """One pass: ``fields`` with the longest rule of these and of the passes before, its verdict and rank (_bytes, _host)."""
    keyed = [("\n".join(parse_rule(r)).encode(), allow) for r, allow in rules]
    image = DigestArray.build(keyed)
    lengths = sorted({len(parse_rule(r)[1]) for r, _ in rules})
    columns = fields.columns if first else fields.columns[:-4]

    def judge(batches):
        with tempfile.NamedTemporaryFile(prefix="digests-", delete=False) as f:  # each task maps its own copy
            f.write(image)
        try:
            table = DigestArray(f.name)
        finally:
            os.unlink(f.name)
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            keys, owner = [], []
            for i, (h, p) in enumerate(zip(hosts, paths)):
                labels = h.split(".")
                ends = [p[:n] for n in lengths if n <= len(p)]
                for k in range(len(labels)):
                    suffix = ".".join(labels[k:])
                    for q in ends:
                        keys.append(f"{suffix}\n{q}".encode())
                        owner.append(i)
            found = table.probe(keys)
            best: dict[int, tuple[int, int, int]] = {}
            for j in np.flatnonzero(found >= 0).tolist():
                key = keys[j]
                rank = (len(key), key.index(b"\n"), int(found[j]))
                if rank > best.get(owner[j], (0, 0, 0)):
                    best[owner[j]] = rank
            if first:
                rule, verdict = [None] * len(hosts), ["allow"] * len(hosts)
                sizes, cuts = [0] * len(hosts), [0] * len(hosts)
            else:
                rule, verdict, sizes, cuts = (batch.column(c).to_pylist() for c in ("rule", "verdict", "_bytes", "_host"))
            for i, (n, cut, p) in best.items():
                if (n, cut) < (sizes[i], cuts[i]):
                    continue
                stricter = (n, cut) == (sizes[i], cuts[i]) and verdict[i] == "block"  # the same rule in two parts
                rule[i] = table.text[table.offsets[p] : table.offsets[p + 1]].tobytes().decode().replace("\n", "")
                verdict[i] = "allow" if table.allow[p] and not stricter else "block"
                sizes[i], cuts[i] = n, cut
            judged = [pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(sizes, pa.int64()), pa.array(cuts, pa.int64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *judged], [*columns, "rule", "verdict", "_bytes", "_host"])

    added = [StructField("rule", StringType()), StructField("verdict", StringType()), StructField("_bytes", LongType()), StructField("_host", LongType())]
    return fields.mapInArrow(judge, StructType([*[fields.schema[c] for c in columns], *added]))
