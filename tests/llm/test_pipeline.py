"""The pipeline's stages against plain versions, on rows that are awkward."""

import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm.test_operators import brute_components, brute_hits, sets_of
from tidemark.llm.line_dedup import shingle_jaccard
from tidemark.llm.quality import features, graded, scale, train
from tidemark.llm.queries import LEAST_TOP

#: Columns that bear names which the operators use for their own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines long, n_removed long, hit string, row long, selected boolean"
STAGES = dict(P.STAGES)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(n))


def row(doc_id, text, n_chars=None):
    return (doc_id, text, "en", None, len(text or "") if n_chars is None else n_chars, 7, 8, "mine", doc_id, True)


@pytest.fixture(scope="module")
def passage(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text


@pytest.fixture(scope="module")
def rows(passage):
    rng = random.Random(11)
    line, other = words(rng, 12), words(rng, 60)
    base = words(rng, 80)
    near = base.split()
    near[40] = "changed"
    return [
        row(1, base), row(2, " ".join(near)), row(3, base), row(3, words(rng, 30)), row(3, None), row(None, base), row(None, None, -1),
        row(4, ""), row(5, "  \n "), row(6, f"{words(rng, 9)}\n{line}\n{words(rng, 9)}"), row(7, f"{line}\n{words(rng, 9)}"), row(8, line), row(8, line),
        row(9, words(rng, 9) + " " + passage + " " + words(rng, 9)), row(10, "\n".join(words(rng, 8) for _ in range(3000))), row(11, other), row(11, other),
        row(12, "Ünïcode 日本語 " + words(rng, 40)), (13, "x", None, None, None, None, None, None, None, None),
    ]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def ran(docs, out):
    """The rows of a stage that keeps the columns of its input."""
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    return Counter(tuple(r) for r in out.collect())


def test_quality_classifier(spark, sf_dir, rows, docs):
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = real.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10**6), allowMissingColumns=True)
    got = ran(both, P.quality_classifier(spark, both, sf_dir))
    model = train(spark, both, graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    weights = model.weights.astype("float32")

    def top(text):
        f = features(text)
        return float(model.tails(weights[f].sum(dtype="float64").reshape(1) * scale(len(f)))[0, -1])

    want = Counter(tuple(r) for r in both.collect() if top(r.text) >= LEAST_TOP)
    assert got == want and 0 < sum(got.values()) < both.count()


def test_line_dedup(spark, sf_dir, rows, docs):
    got = ran(docs, P.line_deduplication(spark, docs, sf_dir))
    seen, want = [], Counter()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    first: dict[tuple, list] = {}
    for r in order:
        key = (r[0], r[1])
        if key not in first and r[1] is not None:
            kept = []
            for text in r[1].split("\n"):
                plain = " ".join(text.split())
                if len(plain) < 8:
                    kept.append(text)
                elif all(shingle_jaccard(plain, s) < 0.8 for s in seen if abs(len(s) - len(plain)) <= 0.25 * max(len(s), len(plain))):
                    kept.append(text)
                if len(plain) >= 8:
                    seen.append(plain)
            first[key] = kept
        if r[1] is None:
            want[r] += 1
            continue
        kept = first[key]
        if len(kept) == len(r[1].split("\n")):
            want[r] += 1
        elif "".join(kept).strip():
            text = "\n".join(kept)
            want[(r[0], text, *r[2:4], len(text), *r[5:])] += 1
    assert got == want
    assert (4, "", "en", None, 0, 7, 8, "mine", 4, True) in got and not any(r[0] == 8 for r in got)


def test_near_duplicate_removal(spark, sf_dir, rows, docs):
    got = ran(docs, P.near_duplicate_removal(spark, docs, sf_dir))
    sets = [sets_of(r[1] or "", 5) if r[0] is not None else set() for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    part = brute_components(links, range(len(rows)))
    best: dict[int, int] = {}
    for i, r in enumerate(rows):
        p = part[i]
        if p not in best or (r[0] is not None and r[0] < rows[best[p]][0]):
            best[p] = i
    assert got == Counter(rows[i] for i in best.values())
    assert sum(n for r, n in got.items() if r[0] == 3) == 2 and sum(n for r, n in got.items() if r[0] is None) == 2


def test_benchmark_decontamination(spark, sf_dir, rows, docs):
    got = ran(docs, P.benchmark_decontamination(spark, docs, sf_dir))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = Counter(r for r in rows if not brute_hits(r[1], items, 10)[1])
    assert got == want and not any(r[0] == 9 for r in got) and sum(got.values()) == len(rows) - 1


def test_packing(spark, sf_dir, rows, docs):
    got = P.packing(spark, docs, sf_dir).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = Counter((r[0], len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in rows)
    placed = Counter()
    for p in got:
        placed[p.doc_id, p.doc_tokens] += p.length
    assert placed == Counter({k: k[1] * n for k, n in lengths.items()})
    fill = Counter()
    for p in sorted(got, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == fill[p.sequence_id]
        fill[p.sequence_id] += p.length
    assert all(n <= 2048 and n & (n - 1) == 0 for n in fill.values())


@pytest.mark.parametrize("name", STAGES)
def test_empty_tables(spark, sf_dir, docs, name):
    none = spark.createDataFrame([], SCHEMA)
    out = STAGES[name](spark, none, sf_dir)
    assert out.count() == 0 and (name == "packing" or out.dtypes == docs.dtypes)
