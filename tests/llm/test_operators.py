"""Each operator on small tables with awkward rows, against brute force."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import xxhash
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import cross_entropy, quality
from tidemark.llm.common import Scratch
from tidemark.llm.components import components
from tidemark.llm.decontaminate import contamination, decontaminate, words
from tidemark.llm.hash_forest import search
from tidemark.llm.line_dedup import line_dedup, shingle_jaccard
from tidemark.llm.ngram_join import near_duplicates_out, ngram_join
from tidemark.llm.packing import pack
from tidemark.llm.repeats import remove_repeats
from tidemark.llm.token_store import token_store
from tidemark.llm.url_filter import url_filter

DOCS = "doc_id long, text string, n long, key string, hashes string"


def sentence(rng, n):
    return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empties, ties, repeats, near and exact copies, shared passages, one long text."""
    rng = np.random.default_rng(5)
    base = [sentence(rng, int(rng.integers(5, 120))) for _ in range(30)]
    passage = sentence(rng, 40)
    out = [(i, t) for i, t in enumerate(base)]
    out += [(30 + i, base[i]) for i in range(6)]
    out += [(40 + i, " ".join(w if k % 40 else "Changed" for k, w in enumerate(base[i].split()))) for i in range(12)]
    out += [(60 + i, f"{sentence(rng, 10)}\n{passage}\n{sentence(rng, 8)}") for i in range(8)]
    out += [(80, None), (81, ""), (82, "   "), (83, "one"), (84, "one"), (85, "two words"), (86, "Two  Words"), (87, sentence(rng, 6000)), (88, "é ñ\n" * 40), (3, base[3]), (None, base[1]), (None, None), (89, "a" * 700), (90, "a" * 900)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame([(i, t, 7, "k", "h") for i, t in rows], DOCS).repartition(3)
    return Scratch(spark, "fixture").table(df, "docs")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def sets_of(text, n):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()]
    return {tuple(w[k : k + n]) for k in range(max(len(w) - n + 1, 1))} if w else set()


def brute_components(links, nodes):
    label = {n: n for n in nodes} | {n: n for e in links for n in e}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 8, 10)])
def test_ngram_join(spark, docs, rows, empty, n, num, den):
    got = ngram_join(spark, docs, n, (num, den)).collect()
    named = [(i, sets_of(t, n)) for i, t in rows if i is not None]
    links = [(a, b) for k, (a, s) in enumerate(named) for b, t in named[k + 1 :] if s and t and den * len(s & t) >= num * len(s | t)]
    want = brute_components(links, {i for i, _ in named})
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == sorted((i, len(s), want[i]) for i, s in named)
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]
    assert len(set(want.values())) < len(want) and ngram_join(spark, empty, n).count() == 0
    kept = near_duplicates_out(spark, docs, n, (num, den))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(set(want.values()))


def test_near_duplicates_with_repeated_ids_lose_no_text(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    near = " ".join(a.split()[:-1])
    rows = [(1, a), (1, b), (2, c), (3, None), (3, d), (1, a), (4, near), (5, near), (5, ""), (0, c), (None, a), (None, None)]
    got = near_duplicates_out(spark, spark.createDataFrame([(i, t, 1, "k", "h") for i, t in rows], DOCS).repartition(3), 5, (8, 10))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, a), (1, b), (0, c), (3, None), (3, d), (5, ""), (None, a), (None, None)], key=str)
    assert near_duplicates_out(spark, got.limit(0)).count() == 0


def test_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(8)
    base = sentence(rng, 60).split()
    texts = [(i, " ".join(w if k != i % 60 else f"x{i}" for k, w in enumerate(base))) for i in range(400)]
    got = ngram_join(spark, spark.createDataFrame(texts, "doc_id long, text string"), 3, (8, 10)).collect()
    assert {r.component_id for r in got} == {0}


@pytest.mark.parametrize("leading_null", [False, True])
def test_copies_in_any_order(spark, leading_null):
    """A class's smallest id, or a row without id, need not be the first copy that a task sees."""
    rng = np.random.default_rng(21)
    rows = []
    for f in range(40):
        # a, b and c are near each other or not: several families share keys, so round one can't link all
        base = sentence(rng, 60).split()
        for v in range(6):
            text = " ".join(w if k not in (7 * v + 3, 7 * v + 4) else f"q{v}" for k, w in enumerate(base))
            rows += [(1000 * f + 10 * v + c, text) for c in range(3)]
            rows += [(None, text)] * leading_null
    rows.sort(key=lambda r: (r[0] is not None, -(r[0] or 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in ngram_join(spark, df, 3, (7, 10)).collect()}
    named = [(i, sets_of(t, 3)) for i, t in rows if i is not None]
    links = [(a, b) for k, (a, s) in enumerate(named) for b, t in named[k + 1 :] if 10 * len(s & t) >= 7 * len(s | t)]
    want = brute_components(links, {i for i, _ in named})
    assert len(set(want.values())) < len(want) / 3 and {i: got[i] for i in want} == want


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(500, 560)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7)]
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "cc")).collect()
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert {r.node: r.component for r in got} == brute_components(edges, nodes) and len(got) == len(nodes)
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "cc")).count() == 0


def test_token_store(spark, docs, rows, empty, tmp_path):
    got, manifest = token_store(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), 2, f"file://{tmp_path}/t", chunk_ids=256, planes=32)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for (i, _), e in zip(order, t.encode_batch([x or "" for _, x in order], add_special_tokens=False)):
        ids = np.asarray([*e.ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids)))
        at += len(ids)
    assert [tuple(r) for r in got.orderBy("start").collect()] == want and sum(m[3] for m in manifest) == at
    assert token_store(spark, empty, public_tokenizers.path("byte_bpe_50k.json"), 2)[0].count() == 0


def test_line_dedup(spark, docs, rows, empty):
    out = line_dedup(spark, docs, k=5, min_chars=4)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    # rows that share a doc_id (or have none) are told apart by their texts, in the order of the texts' hashes
    name = lambda i, t: (2**63 - 1 if i is None else i, (xxhash.xxh64_intdigest(t.encode(), 42) ^ 1 << 63) - (1 << 63))
    lines = sorted((*name(i, t), p, " ".join(x.lower().split())) for i, t in rows if t is not None for p, x in enumerate(t.split("\n")) if len(" ".join(x.split())) >= 4)
    distinct = sorted({x for *_, x in lines})
    links = [(a, b) for k, a in enumerate(distinct) for b in distinct[k + 1 :] if 0.8 * len(b) <= 1.3 * len(a) and 0.8 * len(a) <= 1.3 * len(b) and shingle_jaccard(a, b, 5) >= 0.8]
    part = brute_components(links, distinct)
    first: dict = {}
    for i, tag, p, x in lines:
        first.setdefault(part[x], (i, tag, p))
    gone: dict = {}
    for i, tag, p, x in lines:
        if first[part[x]] != (i, tag, p):
            gone.setdefault((i, tag), set()).add(p)
    want = []
    for i, t in rows:
        cut = set() if t is None else gone.get(name(i, t), set())
        kept = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in cut)
        want.append((i, kept, 0 if t is None else t.count("\n") + 1, len(cut)))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    assert len(links) > 5
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=key) == sorted(want, key=key)
    assert line_dedup(spark, empty).count() == 0


def test_line_dedup_tells_rows_of_one_id_apart(spark):
    rows = [(1, "a line that both rows hold here", 1), (2, "a line that both rows hold here\nand another one after it", 2), (2, "totally other content of this row\nthat nothing else repeats", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _doc long").withColumn("_cut", F.lit(5)).withColumn("bucket", F.lit(6))
    out = line_dedup(spark, docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    assert sorted((r.doc_id, r.text, r._doc) for r in out.collect()) == [(1, rows[0][1], 1), (2, "and another one after it", 2), (2, rows[2][1], 3)]


def test_line_dedup_of_a_template(spark):
    """Many lines of one template: copies with a small change go, lines of the template that are less similar stay."""
    rng = np.random.default_rng(31)
    words = [sentence(rng, 1) for _ in range(4000)]
    fixed = " ".join(rng.choice(words, 24))
    lines, near = [], []
    for f in range(120):
        own = f"{fixed} {' '.join(rng.choice(words, 9))}"
        lines.append(own)
        at = int(rng.integers(0, len(own) - 4))
        near.append(own[:at] + "#" + own[at + 1 :])
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines + near)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in line_dedup(spark, docs).collect()}
    distinct = [x.lower() for x in lines]
    links = [(a, b) for a in range(120) for b in range(a) if shingle_jaccard(distinct[a], distinct[b]) >= 0.8]
    part = brute_components(links, set(range(120)))
    assert sum(got[i] for i in range(120)) == 120 - len(set(part.values()))
    assert sum(got[120 + i] for i in range(120)) >= 0.95 * 120


def test_line_dedup_compares_few_lines_of_a_template(spark, monkeypatch):
    """Lines of one template that are less similar are told apart before their texts meet; similar ones never are."""
    from tidemark.llm import line_dedup as module

    rng = np.random.default_rng(37)
    words = [sentence(rng, 1) for _ in range(4000)]
    fixed = " ".join(rng.choice(words, 24))
    lines = [f"{fixed} {' '.join(rng.choice(words, 9))}" for _ in range(150)]
    compared = []

    class Counted(module.Scratch):
        def table(self, df, name):
            out = super().table(df, name)
            if name == "tried":
                compared.append(out.count())
            return out

    monkeypatch.setattr(module, "Scratch", Counted)
    line_dedup(spark, spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    assert sum(compared) < 150  # of 11,175 pairs

    near = [x[:60] + "#" * int(rng.integers(1, 9)) + x[60:] for x in lines]
    texts = spark.createDataFrame(list(enumerate(x.lower() for x in lines + near)), "id long, line string")
    told = module._maps(texts, 8)
    sides = [told.select(*[F.col(c).alias(c + e) for c in told.columns]) for e in ("_u", "_v")]
    kept = {(r.id_u, r.id_v) for r in sides[0].where("id_u < 150").join(sides[1], F.col("id_u") + 150 == F.col("id_v")).where(module._near("_u", "_v", 0.8)).collect()}
    alike = {(n, n + 150) for n in range(150) if shingle_jaccard(lines[n].lower(), near[n].lower()) >= 0.8}
    assert len(alike) > 100 and alike <= kept


def test_line_dedup_recall(spark):
    rng = np.random.default_rng(11)
    lines = [sentence(rng, int(rng.integers(6, 40))) for _ in range(150)]
    near = []
    for x in lines:
        w = x.split()
        w[int(rng.integers(len(w)))] = "zz"
        near.append(" ".join(w))
    pairs = [(a, b) for a, b in zip(lines, near) if shingle_jaccard(a, b) >= 0.8]
    texts = [(n, a) for n, (a, _) in enumerate(pairs)] + [(1000 + n, b) for n, (_, b) in enumerate(pairs)]
    out = line_dedup(spark, spark.createDataFrame(texts, "doc_id long, text string"))
    assert out.where("doc_id >= 1000 AND n_removed = 1").count() >= 0.97 * len(pairs) and out.where("doc_id < 1000 AND n_removed > 0").count() <= 2


def test_line_dedup_several_families_in_one_band(spark):
    """Families that share bands but not the least key or a centre: every member still meets its own."""
    rng = np.random.default_rng(31)
    head = sentence(rng, 40)
    families = [f"{head} {sentence(rng, 18)}" for _ in range(60)]
    texts = [(n + 1000 * v, f"{x}{' ' + 'xyz'[v] * 3 if v else ''}") for n, x in enumerate(families) for v in range(3)]
    assert max(shingle_jaccard(a, b) for n, a in enumerate(families) for b in families[:n]) < 0.8
    out = line_dedup(spark, spark.createDataFrame(texts, "doc_id long, text string"), bands=2, rows=1, rounds=2)
    assert {r.doc_id for r in out.where("n_removed = 0").collect()} == set(range(60))


def test_line_dedup_without_spaces(spark):
    """Lines of one long word, and of few long words, that differ at the start."""
    rng = np.random.default_rng(32)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnop"), n))
    lines = [word(int(rng.integers(60, 300))) for _ in range(60)] + [" ".join(word(40) for _ in range(3)) for _ in range(40)]
    texts = [(n + 1000 * v, f"{v}{x}") for n, x in enumerate(lines) for v in range(2)]
    out = line_dedup(spark, spark.createDataFrame(texts, "doc_id long, text string"))
    assert out.where("doc_id >= 1000 AND n_removed = 1").count() >= 98 and out.where("doc_id < 1000 AND n_removed > 0").count() == 0


def test_url_filter(spark):
    urls = ["http://a.net/x", "https://EXAMPLE.net/en/a?q#f", "http://example.net/de", "http://x.example.com/de/", "http://example.com/den", "nourl", None, "", "http://", "http://net/", "http://notnet/", "http://a.net", "http://é.org/fr/x", "x://y://a.net/b", "http://a.net:80/x"]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rules = [("net/", False), ("example.net/en/", True), ("example.com/de/", False), ("org/fr/", True)]
    got = {r.page_id: r for r in url_filter(df, rules).collect()}
    for i, u in enumerate(urls):
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:].split("?")[0].split("#")[0]
        fit = [(len(r), r, a) for r, a in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        rule, allow = (max(fit)[1], max(fit)[2]) if fit else (None, True)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, "allow" if allow else "block")
    assert url_filter(df.limit(0), rules).count() == 0 and url_filter(df, []).where("verdict = 'block'").count() == 0


def test_url_filter_in_several_passes(spark, monkeypatch):
    from tidemark.llm import url_filter as U

    urls = ["http://a.net/x", "http://example.net/en/a", "http://example.net/de", "http://x.example.com/de/", "http://a.org/fr/x", "nourl", None]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [("example.net/en/", True), ("net/", False), ("org/fr/", True), ("org/", True), ("example.com/de/", False), ("example.net/", True), ("org/fr/", False), ("example.com/de/", True)]
    want = sorted(map(str, url_filter(df, rules).collect()))
    monkeypatch.setattr(U, "MOST_RULE_BYTES", 20)
    got = url_filter(df, rules)
    assert len(U.rule_parts(rules, 20)) > 3 and sorted(map(str, got.collect())) == want
    assert [r.verdict for r in got.orderBy("page_id").collect()] == ["block", "allow", "allow", "block", "block", "allow", "allow"]


def test_hash_forest(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((700, 16)) * rng.uniform(0.5, 2, (700, 1))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(700 + i, v[0].tolist()) for i in range(30)] + [(800, None), (801, [0.0] * 16), (802, [float("nan")] * 16), (803, [1.0]), (804, [None] * 16), (805, []), (806, [float("inf")] * 16), (None, v[1].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = search(spark, df, lambda i: i % 10 == 0, 10, shard_rows=300).collect()
    ids, m = np.asarray([i for i, _ in rows[:730]]), np.asarray([x for _, x in rows[:730]])
    hits = total = 0
    for q in range(0, 730, 10):
        s = m @ m[q]
        s[q] = -np.inf
        want = ids[np.lexsort((ids, -s))[:10]]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == list(range(1, 11)) and all(abs(float(m[list(ids).index(v)] @ m[q]) - sc) < 1e-9 for _, v, sc in mine)
        assert [(-sc, v) for _, v, sc in mine] == sorted((-sc, v) for _, v, sc in mine)
        hits += len(set(want) & {v for _, v, _ in mine})
        total += 10
    assert hits / total >= 0.9 and {r.query_id for r in got} == set(range(0, 730, 10))
    assert search(spark, df.limit(0), lambda i: i % 10 == 0).count() == 0


def brute_hits(text, items, n):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        size = min(n, len(x))
        grams = {tuple(x[k : k + size]) for k in range(len(x) - size + 1)} if size else set()
        for k in range(len(w) - size + 1 if size else 0):
            if tuple(w[k : k + size]) in grams:
                hit.update(range(k, k + size))
                found.add(str(item))
    return len(w), len(hit), ",".join(sorted(found)), len(found)


@pytest.mark.parametrize("most", [None, 200])
def test_decontamination(spark, docs, rows, empty, monkeypatch, most):
    from tidemark.llm import decontaminate as D

    if most:
        monkeypatch.setattr(D, "MOST_ITEM_BYTES", most)  # a benchmark over the broadcast's bound: several parts
    items = [(1, rows[0][1]), (2, " ".join((rows[5][1] or "").split()[3:30])), (10, "two words"), (11, None), (12, ""), (13, rows[60][1]), (13, "é, Ñ")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = contamination(spark, docs, bench, 10).collect()
    want = []
    for i, t in rows:
        n, hit, names, k = brute_hits(t, items, 10)
        want.append((i, n, hit, k, hashlib.sha256(names.encode()).hexdigest(), hit > 0))
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key) and sum(w[5] for w in want) > 4
    clean = decontaminate(spark, docs, bench, 10)
    assert clean.columns == docs.columns and clean.count() == sum(not w[5] for w in want)
    cut = decontaminate(spark, docs, bench, 10, "span")
    assert cut.count() == len(rows) and contamination(spark, cut.where("doc_id = 0"), bench, 10).first().n_words == 0
    texts = {(r.doc_id, r.text) for r in cut.collect()}
    for i, t in rows:  # all hits are found in the text as it came, then cut
        n, hit, _, _ = brute_hits(t, items, 10)
        assert any(a == i and len(words(b)) == n - hit and (t is None) == (b is None) for a, b in texts)
    assert contamination(spark, empty, bench).count() == 0 and contamination(spark, docs, bench.limit(0)).where("contaminated").count() == 0


def test_quality(spark, sf_dir, docs, empty):
    real, labels = spark.read.parquet(f"{sf_dir}/../sf0.1/documents.parquet"), spark.read.parquet(f"{sf_dir}/../sf0.1/labels.parquet")
    ratings = quality.graded(labels)
    model = quality.train(spark, real, ratings.where("doc_id % 2 = 0"), sample=2000)
    out = quality.score(spark, real, model, 0.65).join(ratings.where("doc_id % 2 = 1"), "doc_id").groupBy("grade").agg(F.avg((~F.col("selected")).cast("double")).alias("rejected"), F.avg("expected_grade").alias("expected")).orderBy("grade").collect()
    # about 2,000 rated documents, a tenth of them toxic: far fewer than production's sample
    assert out[0].rejected > 0.7 and out[1].rejected > 0.8 and out[2].rejected < 0.06
    assert out[0].expected < out[1].expected < out[2].expected
    odd = quality.score(spark, docs.withColumn("p_top", F.lit("x")), model, 0.65)
    assert odd.count() == docs.count() and odd.where("p_top IS NULL").count() == 0 and set(quality.score(spark, docs, model, 0.5, keep_only=True).columns) == set(docs.columns)
    none = quality.train(spark, docs, ratings.limit(0))
    assert quality.score(spark, docs, none, 0.65, keep_only=True).count() == docs.count() and quality.score(spark, empty, model, 0.5).count() == 0


@pytest.mark.parametrize("heavy, per_shard", [(cross_entropy.HEAVY, cross_entropy.SHARD), (16, 500)])
def test_cross_entropy(spark, docs, rows, empty, heavy, per_shard):
    targets = spark.createDataFrame([(i,) for i in [*range(0, 30, 2), 3, None, 999]], "doc_id long")
    run = lambda d: cross_entropy.cross_entropy_difference(spark, d, targets, heavy, per_shard)
    got = run(docs).collect()
    texts = [(i, cross_entropy.words(t)) for i, t in rows]
    v = len({w for _, ws in texts for w in ws})
    mix, mu, alpha = cross_entropy.MIX, cross_entropy.MU, cross_entropy.ALPHA

    def model(some):
        pair, one = Counter(), Counter()
        for ws in some:
            pair.update(zip([None, *ws], ws))
            one.update(ws)
            one[None] += bool(ws)
        n = sum(one.values()) - one[None]
        return lambda a, b: -(1 - mix) * np.log((one[b] + alpha) / (n + alpha * v)) - mix * np.log((pair[a, b] + mu / (v + 1)) / (one[a] + mu))

    wanted = set([*range(0, 30, 2), 3])
    t, b = model([ws for i, ws in texts if i in wanted]), model([ws for _, ws in texts])
    want = []
    for i, ws in texts:
        if ws:
            lt, lb = (float(np.mean([m(x, y) for x, y in zip([None, *ws], ws)])) for m in (t, b))
            want.append((i, len(ws), lt, lb, lt - lb))
        else:
            want.append((i, 0, None, None, None))
    key = lambda r: tuple((x is not None, x or 0) for x in r[:3])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:2] == w[:2] and all((x is None) == (y is None) and (x is None or abs(x - y) < 2e-6) for x, y in zip(g[2:], w[2:]))
    assert run(empty).count() == 0


def test_packing(spark, docs, rows, empty):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"), 1, shard_docs=20, with_ids=True).collect()
    want = sorted((i is not None, i or 0, [*e.ids, 1]) for (i, _), e in zip(rows, t.encode_batch([x or "" for _, x in rows], add_special_tokens=False)))
    whole: dict = {}
    for r in got:
        assert zlib.crc32(np.asarray(r.ids, "<u4")) == r.ids_crc32 and len(r.ids) == r.length
        whole.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
    assert sum(r.length for r in got) == sum(len(x) for _, _, x in want)
    for named, i, ids in want:
        if named and i != 3:
            at = 0
            for s, part in sorted(whole[i, len(ids)]):
                assert s == at and ids[s : s + len(part)] == part
                at += len(part)
            assert at == len(ids)
    sizes: dict = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert sizes.get(r.sequence_id, 0) == r.offset
        sizes[r.sequence_id] = r.offset + r.length
    assert all(n == 2048 or n & (n - 1) == 0 for n in sizes.values())
    assert pack(spark, empty, public_tokenizers.path("word_bpe_49k.json"), 1).count() == 0


def brute_repeats(rows):
    seen: dict = {}
    for i, t in rows:
        if i is not None:
            data = (t or "").encode()
            for k in range(len(data) - 49):
                w = data[k : k + 50]
                seen[w] = min(seen.get(w, i), i)
    want = []
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - 49 if i is not None else 0):
            if seen[data[k : k + 50]] < i:
                gone[k : k + 50] = True
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        want.append((i, len(data), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    return sorted(want, key=repeat_key)


def repeat_key(r):
    return tuple((x is not None, x or 0) for x in (r[0], r[1], r[4]))


def test_repeats(spark, docs, rows, empty):
    got = remove_repeats(spark, docs, 50, keep_text=True).collect()
    assert sorted(((r[0], r[1], r[2], r[3], r[4], bytes(r[5])) for r in got), key=repeat_key) == brute_repeats(rows)
    assert remove_repeats(spark, empty).count() == 0


def test_repeats_of_rows_with_one_id_and_of_a_hot_passage(spark, monkeypatch):
    """Rows that share a doc_id are cut each by itself; a passage of many rows, in other surroundings each, goes from all but one."""
    monkeypatch.setattr("tidemark.llm.repeats.CHUNK", 2000)
    rng = np.random.default_rng(11)
    passage, common = sentence(rng, 20), sentence(rng, 4)[:24]
    rows = [(1, passage), (2, passage + " with a tail of its own"), (2, sentence(rng, 40)), (2, sentence(rng, 5) + passage)]
    rows += [(i, f"{sentence(rng, 6)} {passage if i % 3 else common} {sentence(rng, 6)}") for i in range(300, 3, -1)]
    got = remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 50, keep_text=True).collect()
    assert sorted(((r[0], r[1], r[2], r[3], r[4], bytes(r[5])) for r in got), key=repeat_key) == brute_repeats(rows)


def test_every_query_is_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)} and "pipeline" in names


def test_repeats_let_go_of_stretches_before_texts_are_sent(spark, monkeypatch):
    import glob

    from tidemark.llm import repeats as module

    made = []

    class Seen(module.Scratch):
        def __init__(self, *a):
            super().__init__(*a)
            made.append(self.root.removeprefix("file://"))

    monkeypatch.setattr(module, "Scratch", Seen)
    out = remove_repeats(spark, spark.createDataFrame([(1, "ab cd " * 30), (2, "x" + "ab cd " * 30)], "doc_id long, text string"), 50)
    left = {p.rpartition("-")[2] for p in glob.glob(f"{made[0]}/*")}
    assert "places" in left and not left & {"stretches", "windows"}
    assert out.where("n_removed > 0").count() == 1
