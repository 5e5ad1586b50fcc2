"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades 0 < 1 < ... < K share one weight vector over hashed text features and have ordered thresholds:
``P(grade <= j) = sigmoid(threshold_j - w.x)``.  A document's expected grade is the sum of its tail probabilities
``P(grade > j)``, and a document is selected if its tail probability of the top grade is high enough.

Features of a text: the distinct words without marks at their ends, their first four and their last three characters, each hashed to a bucket, plus
buckets for the share of distinct words and for length.  Weights are fitted on a bounded sample of labelled rows;
every document is scored on its whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, slices

BITS = 18
BUCKETS = 1 << BITS
#: The last 64 buckets are for the features of the whole text.
_WORD_BUCKETS = BUCKETS - 64


_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class WordBuckets(dict):
    """word -> its three buckets in one integer."""

    MOST = 300_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        bare = word.strip(_MARKS) or word
        a, b, c = (xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass"), seed) % _WORD_BUCKETS for seed, x in ((1, bare), (2, bare[:4]), (3, word[-3:])))
        v = self[word] = a | b << BITS | c << 2 * BITS
        return v


def features(text: str | None) -> np.ndarray:
    """The distinct buckets of a text."""
    words = text.lower().split() if text else []
    n = len(words)
    get = held("word buckets", WordBuckets).__getitem__
    packed = np.unique(np.fromiter(map(get, words), np.int64, n))
    mask = BUCKETS - 1
    share = int(10 * len(packed) / n) if n else 11
    whole = [_WORD_BUCKETS + share, _WORD_BUCKETS + 16 + min(int(n).bit_length(), 20)]
    return np.unique(np.concatenate([packed & mask, packed >> BITS & mask, packed >> 2 * BITS, whole]))


def scale(n: int) -> float:
    """The value of each of ``n`` present features: a long text's sum grows, but slower than its length."""
    return 1.0 / max(n, 1) ** 0.5


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade > j) for each score and threshold."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - x[:, None], -30, 30)))


#: Features that a step of a round looks at together: the driver holds 4 bytes for each feature of the sample, and more only for these.
_TOGETHER = 1 << 18


def fit(rows: list[np.ndarray], grades: np.ndarray, top: int, *, rounds: int = 100, rate: float = 0.3, decay: float = 1e-5) -> Model:
    """Full-batch Adam on the likelihood; thresholds stay ordered as a first one plus positive steps."""
    share = np.asarray([(grades > j).mean() if len(rows) else 0.5 for j in range(top)]).clip(0.01, 0.99)
    first = -np.log(share / (1 - share))
    steps = np.log(np.maximum(np.diff(first), 1e-2))
    if not rows:
        return Model(np.zeros(BUCKETS), np.sort(first))
    sizes = np.asarray([len(r) for r in rows], np.int64)
    ends = np.cumsum(sizes)
    scales = np.asarray([scale(n) for n in sizes], np.float64)
    present = np.zeros(BUCKETS, bool)
    for r in rows:
        present[r] = True
    used = np.flatnonzero(present)
    place = np.cumsum(present, dtype=np.int32) - np.int32(1)
    local = np.empty(int(ends[-1]), np.int32)
    for r, end in zip(rows, ends.tolist()):
        local[end - len(r) : end] = place[r]
    # runs of whole rows
    cuts, n = [0], len(rows)
    while cuts[-1] < n:
        before = ends[cuts[-1]] - sizes[cuts[-1]]
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, before + _TOGETHER, side="right"))))
    runs = [(a, b, local[ends[a] - sizes[a] : ends[b - 1]]) for a, b in zip(cuts, cuts[1:])]
    params = [np.zeros(len(used)), first[:1].copy(), steps]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for t in range(1, rounds + 1):
        thresholds = params[1][0] + np.concatenate([[0.0], np.cumsum(np.exp(params[2]))])
        x = np.concatenate([np.add.reduceat(params[0][at] * np.repeat(scales[a:b], sizes[a:b]), ends[a:b] - sizes[a:b] - (ends[a] - sizes[a])) for a, b, at in runs])
        below = 1 / (1 + np.exp(-np.clip(np.concatenate([np.full((1, n), -40.0), thresholds[:, None] - x[None, :], np.full((1, n), 40.0)]), -40, 40)))
        high, low = below[grades + 1, np.arange(n)], below[grades, np.arange(n)]
        p = np.maximum(high - low, 1e-9)
        dh, dl = high * (1 - high) / p, low * (1 - low) / p  # of log p by its upper and lower threshold
        gx = -(dh - dl) / n  # of log p by x
        g_threshold = np.asarray([(dh[grades == j].sum() - dl[grades == j + 1].sum()) / n for j in range(top)])
        g_weights = -decay * params[0]
        for a, b, at in runs:
            g_weights += np.bincount(at, np.repeat(gx[a:b] * scales[a:b], sizes[a:b]), len(used))
        g = [g_weights, np.asarray([g_threshold.sum()]), np.asarray([g_threshold[j + 1 :].sum() for j in range(top - 1)]) * np.exp(params[2])]
        for k in range(3):
            m, v = moments[k]
            m += 0.1 * (g[k] - m)
            v += 0.01 * (g[k] ** 2 - v)
            params[k] = params[k] + (rate if not k else 0.05) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    weights = np.zeros(BUCKETS)
    weights[used] = params[0]
    return Model(weights, params[1][0] + np.concatenate([[0.0], np.cumsum(np.exp(params[2]))]))


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade: toxic 0, else low quality 1, else 2. Rows without a doc_id or a rating don't count."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).where(F.col("grade").isNotNull()).groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(spark: SparkSession, docs: DataFrame, ratings: DataFrame, top: int = 2, sample: int = 10_000) -> Model:
    """Fit on at most ``sample`` rated documents, those of the smallest hash of doc_id (the same ones in every run).

    ``ratings``: doc_id, grade (0 to ``top``).  Without any rated document the model is neutral: it selects everything.
    """
    chosen = ratings.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = {r.doc_id: r.grade for r in chosen.collect()}
    known = spark.sparkContext.broadcast(np.sort(np.fromiter(picked, np.int64, len(picked))))

    def run(batches):
        ids = known.value
        for batch in batches:
            keys = np.asarray(batch.column("doc_id"))
            at = np.minimum(np.searchsorted(ids, keys), len(ids) - 1)
            batch = batch.filter(pa.array(ids[at] == keys))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([features(t).astype("<i4").tobytes() for t in batch.column("text").to_pylist()], pa.binary())], ["doc_id", "f"])

    rows, grades = [], []
    if picked:
        got = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, f binary")
        seen: dict[int, bytes] = {}
        for r in got.toLocalIterator():
            seen[r.doc_id] = max(bytes(r.f), seen.get(r.doc_id, b""))  # repeated rows: one of them, whatever their order
        for doc in sorted(seen):
            rows.append(np.frombuffer(seen[doc], "<i4"))
            grades.append(picked[doc])
    model = fit(rows, np.asarray(grades, np.int64), top)
    if not rows:
        model = Model(model.weights, np.full(top, -30.0))
    return model


def score(spark: SparkSession, docs: DataFrame, model: Model, least: float, keep_only: bool = False) -> DataFrame:
    """Every row with expected_grade, p_top (probability of the top grade) and selected (p_top >= least).

    ``keep_only``: the selected rows alone, in ``docs``' own columns.  Null and empty texts have only the features of an
    empty text.  Columns that bear the new names are replaced.
    """
    shared = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))
    names = [c for c in docs.columns if c not in ("expected_grade", "p_top", "selected")]
    source = docs if keep_only else docs.select(*[F.col(f"`{c}`") for c in names])

    def run(batches):
        weights, thresholds = shared.value
        own = Model(weights, thresholds)
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts, 4_000_000):
                x = np.empty(b - a)
                for i, t in enumerate(texts.slice(a, b - a).to_pylist()):
                    f = features(t)
                    x[i] = weights[f].sum(dtype=np.float64) * scale(len(f))
                tails = own.tails(x)
                part = batch.slice(a, b - a)
                if keep_only:
                    yield part.filter(pa.array(tails[:, -1] >= least))
                else:
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= least)], [*part.schema.names, "expected_grade", "p_top", "selected"])

    from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

    schema = source.schema if keep_only else StructType([*source.schema, StructField("expected_grade", DoubleType()), StructField("p_top", DoubleType()), StructField("selected", BooleanType())])
    return source.mapInArrow(run, schema)
