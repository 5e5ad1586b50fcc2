"""The operators' inner parts against plain versions."""

import random
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm import decontaminate as D
from tidemark.llm import hash_forest, line_dedup, packing, quality, repeats, token_store, url_filter
from tidemark.llm.encoding import UnitEncoder
from tidemark.llm.ngram_join import Levels, bitmap, keys_of, shingle_sets, tree_pairs
from tidemark.llm.suffix_array import permuted_lcp, suffix_array

ODD = ["", " ", "  ", "a", "a  b", " a", "a ", "\n", "a\n b", "a \nb", "a\n\nb", "it's don't 's", "İ a", "é ́a", "日 本", "<|endoftext|> a", "b<|endoftext|>", "x <|startoftext|>y <|endoftext|> <|endoftext|>", "<|ENDOFTEXT|> a", "<|endoftext |>", "a" * 3000 + " b", "😀 a", "x\r\ny\tz"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choice(["a", "B", "'s", " ", " ", "  ", "\n", "é", "1", "!", "..", "́", "日", "the", "%%%", "\t"]) for _ in range(rnd.randint(1, 25))) for _ in range(600)]
    t = Tokenizer.from_file(public_tokenizers.path(name))
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    for step, most in ((1, 50), (40, 300), (len(texts), 10**6)):
        enc = UnitEncoder(public_tokenizers.path(name), most)
        for a in range(0, len(texts), step):
            ids, lens = enc.encode(texts[a : a + step])
            ends = np.cumsum(lens)
            assert [ids[e - n : e].tolist() for e, n in zip(ends, lens)] == want[a : a + step]


@pytest.mark.parametrize("planes", [4, 32])
def test_planes_round_trip(tmp_path, planes):
    from pyarrow import fs

    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 2**32 if n % 5 == 0 else 50_000, n, dtype=np.uint32) for n in (0, 1, 7, 0, 100, 1000, 3)]
    local = fs.LocalFileSystem()
    with local.open_output_stream(str(tmp_path / "x")) as sink:
        w = token_store.PlaneWriter(sink, planes, 64)
        for i, d in enumerate(docs):
            w.add(np.asarray([i]), np.asarray([i == 3]), np.asarray([len(d)]), d)
        assert w.close() == (7, sum(map(len, docs)))
    with local.open_input_file(str(tmp_path / "x")) as f:
        r = token_store.PlaneReader(f)
        got = list(r.documents())
        assert [k for k, _ in got] == [0, 1, 2, None, 4, 5, 6] and all(np.array_equal(a, b) for (_, a), b in zip(got, docs))
        every = np.concatenate(docs)
        assert np.array_equal(r.ids(60, 70), every[60:130]) and len(r.ids(5, 0)) == 0
    (tmp_path / "y").write_bytes((tmp_path / "x").read_bytes()[:-3])
    with local.open_input_file(str(tmp_path / "y")) as f, pytest.raises(ValueError):
        token_store.PlaneReader(f)


def test_suffix_arrays():
    rnd = random.Random(3)
    for _ in range(400):
        k = rnd.choice([1, 2, 3, 30])
        t = np.asarray([rnd.randrange(k) for _ in range(rnd.randint(1, 50))] * rnd.choice([1, 1, 3]), np.int64)
        order = suffix_array(t, k)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        for separator in (None, 0):
            common = permuted_lcp(t, order, separator)
            for a, b in zip(order, order[1:]):
                c = 0
                while max(a, b) + c < len(t) and t[a + c] == t[b + c] != separator:
                    c += 1
                assert common[b] == c


def test_suffix_arrays_end_comparisons_at_separators():
    """Separators count as characters of their own, in the order of their places; long and short strings."""
    rnd = random.Random(8)
    for n in [1, 2, 3, 5] * 20 + [40, 900, 1500]:
        words = [bytes(rnd.choices(b"abc ", k=rnd.randint(1, 25))) for _ in range(40)]
        raw = b"\0".join(b"".join(rnd.choices(words, k=rnd.randint(1, 5))) for _ in range(n)) + b"\0"
        text = np.frombuffer(raw, np.uint8).astype(np.int16)
        ends = np.flatnonzero(text == 0)
        end = ends[np.searchsorted(ends, np.arange(len(text)))].tolist()
        order = suffix_array(text, 257, separator=0).tolist()
        assert order == sorted(range(len(text)), key=lambda i: (raw[i : end[i]] + b"\0", end[i] if end[i] < len(raw) - 1 else -1))
        common = permuted_lcp(text, np.asarray(order), 0)
        for a, b in zip(order, order[1:]):
            x, y = raw[a : end[a]], raw[b : end[b]]
            assert common[b] == next((k for k, (i, j) in enumerate(zip(x, y)) if i != j), min(len(x), len(y)))


def test_only_contents_that_meet_others_are_sorted(monkeypatch):
    """A content alone under its key is told without sorting; the others of several runs are sorted together."""
    rnd = random.Random(9)
    text = lambda: bytes(rnd.choices(b"abcdef ", k=70))
    alone, twice, one_doc = [text() for _ in range(30)], [text() for _ in range(30)], [text() for _ in range(30)]
    rows = []
    for k in range(30):
        rows += [(3 * k, k, 1, 10, alone[k]), (3 * k, k, 1, 4, None), (3 * k + 1, k, 2, 9, twice[k]), (3 * k + 1, k, 3, 7, b"x" + twice[k][:60]), (3 * k + 2, k, 4, 5, one_doc[k]), (3 * k + 2, k, 5, 5, one_doc[k][1:])]
    table = pa.table(dict(zip(("key", "c1", "c2", "doc_id", "bytes"), map(list, zip(*rows)))))
    calls, plain = [], repeats.shard_windows
    monkeypatch.setattr(repeats, "SHARD", 1000)
    monkeypatch.setattr(repeats, "shard_windows", lambda lo, spans, window: calls.append(spans) or plain(lo, spans, window))
    ran = SimpleNamespace(mapInArrow=lambda f, schema: [r for b in f(table.to_batches(7)) for r in b.to_pylist()])
    frame = SimpleNamespace(repartition=lambda key: SimpleNamespace(sortWithinPartitions=lambda key: ran))
    monkeypatch.setattr(repeats, "STEP", 7)
    got = {(r["c1"], r["c2"], r["a"], r["b"], r["least"]) for r in repeats._windows(frame, 50)}
    assert got == {(k, 1, 0, 20, 4) for k in range(30)} | {(k, 2, 0, 10, 7) for k in range(30)}
    assert sorted(x for c in calls for x in c) == sorted(y for x in twice for y in (x, b"x" + x[:60])) and 1 < len(calls) < 6
    assert max(sum(map(len, c)) for c in calls) <= 1000


def test_anchors_belong_to_windows():
    raw = np.frombuffer(bytes(random.Random(5).choices(b"ab ", k=3000)), np.uint8)
    doc_of = np.repeat([0, 1, 2], [1000, 40, 1960])
    first, last, key, *_ = repeats.anchors(raw, doc_of, 50)
    seen: dict = {}
    for a, b, h in zip(first, last, key):
        for w in range(a, b + 1):
            assert doc_of[w] == doc_of[w + 49] and seen.setdefault(raw[w : w + 50].tobytes(), h) == h
    assert sum(last - first + 1) == sum(doc_of[w] == doc_of[w + 49] for w in range(2951))


def test_pairs_that_are_similar_share_a_key():
    rnd = random.Random(7)
    levels = {t: Levels(*t) for t in ((90, 100), (8, 10))}
    for _ in range(600):
        n = rnd.choice([1, 2, 5, 9, 12, 20, 60, 300])
        x = {rnd.getrandbits(64) for _ in range(n)}
        y = set(x)
        for _ in range(rnd.randint(0, max(1, n // 5))):
            if rnd.random() < 0.5 and len(y) > 1:
                y.remove(rnd.choice(sorted(y)))
            else:
                y.add(rnd.getrandbits(64))
        for (num, den), lv in levels.items():
            if len(x & y) * den >= num * len(x | y):
                a, b = (set(keys_of(np.asarray(sorted(s), np.uint64), lv).tolist()) for s in (x, y))
                assert a & b


def test_trees_lose_no_pair():
    rnd = random.Random(9)
    base = [[rnd.getrandbits(64) for _ in range(rnd.choice([3, 30, 100, 130]))] for _ in range(12)]
    sets = []
    for i in range(150):
        s = set(base[i % 12])
        for _ in range(rnd.randint(0, 6)):
            s.discard(rnd.choice(sorted(s)))
            s.add(rnd.getrandbits(64))
        sets.append(np.asarray(sorted(s), np.uint64))
    block, part = np.asarray([i % 2 for i in range(150)]), np.asarray([i // 10 for i in range(150)])
    got = {tuple(p) for p in tree_pairs(block, np.arange(150), part, np.asarray([len(s) for s in sets]), [bitmap(s) for s in sets], 8, 10).tolist()}
    for i in range(150):
        for j in range(i + 1, 150):
            both = len(np.intersect1d(sets[i], sets[j]))
            if block[i] == block[j] and part[i] != part[j] and both * 10 >= 8 * (len(sets[i]) + len(sets[j]) - both):
                assert (i, j) in got
            elif block[i] != block[j] or part[i] == part[j]:
                assert (i, j) not in got
    assert len(got) < 150 * 149 / 8


def test_shingles():
    a, b, c, d, e = shingle_sets(["A b\tc d", "a B c d", "x y", None, " \n"], 3)
    assert np.array_equal(a, b) and len(a) == 2 and len(c) == 1 and len(d) == len(e) == 0
    assert len(shingle_sets(["a a a a a"], 3)[0]) == 1


def test_windows_of_items_and_cutting():
    assert D.words("Don't ÄÉ-x_9") == [b"don", b"t", "ÄÉ".encode(), b"x", b"9"]
    found = D.WindowSet([(1, "a b c d"), (2, "x"), (3, None), (4, "...")], 3)
    ids = found.ids(D.words("q a b c d x"))
    hit, items = D.find(ids, np.zeros(len(ids), np.int64), found)
    assert hit.tolist() == [False, True, True, True, True, True] and items[0] == {1, 2}
    assert D.cut("q, a - b; c d. z", np.asarray([False, True, True, False, False, False])) == "q, ; c d. z"


def test_windows_with_colliding_hashes(monkeypatch):
    monkeypatch.setattr(D, "window_hashes", lambda ids, size: np.full(max(0, len(ids) - size + 1), 7, np.uint64))
    found = D.WindowSet([(1, "a b c a b"), (2, "b c a"), (3, "c b"), (1, "a b c")], 3)
    ids = found.ids(D.words("a b c b b c a"))
    hit, items = D.find(ids, np.zeros(len(ids), np.int64), found)
    assert hit.tolist() == [True] * 7 and items[0] == {1, 2, 3}  # c b stands in the middle


def test_pieces_have_all_windows():
    rng = np.random.default_rng(1)
    for size in (1, 5, 300):
        text = " ".join(str(x) for x in rng.integers(0, 50, size))
        every = {tuple(D.words(text)[k : k + 4]) for k in range(max(1, size - 3))}
        cut = D.pieces(text, 4, 40)
        assert {tuple(w[k : k + 4]) for p in cut for w in [D.words(p)] for k in range(max(1, len(w) - 3))} == every
        assert size < 300 or (len(cut) > 20 and max(map(len, cut)) < 80)


def test_digest_array_confirms_strings(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda k: len(k))  # every key of a length collides
    (tmp_path / "d").write_bytes(url_filter.DigestArray.build([(b"aa", True), (b"bb", False), (b"bb", True), (b"c", False)]))
    table = url_filter.DigestArray(str(tmp_path / "d"))
    at = table.probe([b"aa", b"bb", b"cc", b"c", b"ddd"])
    assert (at >= 0).tolist() == [True, True, False, True, False] and table.allow[at[1]] == 0
    (tmp_path / "e").write_bytes(url_filter.DigestArray.build([]))
    assert url_filter.DigestArray(str(tmp_path / "e")).probe([b"a"]).tolist() == [-1]


def test_forest_ascends_to_enough():
    rng = np.random.default_rng(2)
    v = rng.standard_normal((300, 8))
    forest = hash_forest.Forest(v, 6, 10)
    for q, found in enumerate(forest.candidates(v[:20], 60)):
        assert q in found and len(found) >= 10
    assert all(len(f) == 300 for f in forest.candidates(v[:3], 10**6))


def test_ordinal_model_learns_an_order():
    rng = np.random.default_rng(1)
    grades = rng.integers(0, 3, 2400)
    rows = [np.unique(np.concatenate([rng.integers(100, 200, 10), np.full(1, g)])) for g in grades]
    m = quality.fit(rows[:1800], grades[:1800], 2)
    assert m.thresholds[0] < m.thresholds[1]
    x = np.asarray([m.weights[r].sum() * quality.scale(len(r)) for r in rows[1800:]])
    expected = m.tails(x).sum(axis=1)
    assert np.corrcoef(expected, grades[1800:])[0, 1] > 0.85
    assert quality.fit([], np.empty(0, np.int64), 2).thresholds.shape == (2,)


def test_fitting_holds_little_beside_its_sample():
    import tracemalloc

    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, quality.BUCKETS, 700)).astype("<i4") for _ in range(3000)]
    grades = rng.integers(0, 3, 3000)
    tracemalloc.start()
    quality.fit(rows, grades, 2, rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 4 bytes a feature, what a round's step looks at (some 20 bytes a feature) and the buckets; not five arrays of 8 bytes a feature
    assert peak < 4 * sum(map(len, rows)) + 96 * quality.BUCKETS


def test_packing_keeps_every_id():
    rnd = random.Random(2)
    docs = [np.asarray([rnd.randrange(50) for _ in range(rnd.choice([1, 3, 40, 200, 700]))], np.uint16) for _ in range(60)]
    pieces = packing.pack_shard(docs, np.ones(50), 100.0, 256)
    cover: dict = {}
    for d, s, n, _, _ in pieces:
        cover.setdefault(d, []).append((s, n))
    for d, doc in enumerate(docs):
        at = 0
        for s, n in sorted(cover[d]):
            assert s == at and n > 0
            at += n
        assert at == len(doc)
    sizes: dict = {}
    for _, _, n, q, o in pieces:
        assert sizes.get(q, 0) == o
        sizes[q] = o + n
    assert all(n == 256 or n & (n - 1) == 0 for n in sizes.values())


def test_a_window_holds_its_neighbours():
    words = lambda base: np.asarray([base + k for k in range(40)], np.uint16)
    docs = [words(0), words(100), words(200), words(0), words(100), words(200)]
    pieces = packing.pack_shard(docs, np.ones(300), 40.0, 80)
    together = {}
    for d, _, _, q, _ in pieces:
        together.setdefault(q, set()).add(d % 3)
    assert all(len(v) == 1 for v in together.values())


def test_line_measure():
    assert line_dedup.shingle_jaccard("abcdefghij", "abcdefghij") == 1 and line_dedup.shingle_jaccard("ab", "cd") == 0


def test_neighbours_by_bm25():
    """Scores and order against a plain loop over all documents and terms."""
    rng = np.random.default_rng(4)
    docs = [rng.zipf(1.4, int(rng.integers(1, 60))).clip(0, 199).astype(np.uint16) for _ in range(80)]
    df = np.asarray([sum(t in d for d in docs) for t in range(200)])
    idf, mean = np.log1p((80 - df + 0.5) / (df + 0.5)), float(np.mean([len(d) for d in docs]))
    index, used = packing.Index(docs, idf, mean), np.zeros(80, bool)
    used[::7] = True

    def score(q, d):
        return sum(idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in set(q.tolist()) if (tf := int((d == t).sum())))

    for seed in range(80):
        scores = {k: score(docs[seed], docs[k]) for k in range(80) if k != seed and not used[k]}
        want = sorted((k for k in scores if scores[k] > 0), key=lambda k: (-round(scores[k], 9), k))
        got = index.neighbours(seed, used).tolist()
        assert sorted(got) == sorted(want) and [round(scores[k], 9) for k in got] == [round(scores[k], 9) for k in want]


def test_likeness_brings_related_documents_together():
    rng = np.random.default_rng(9)
    base = [rng.choice(40_000, 120, replace=False) for _ in range(300)]
    near = [np.concatenate([b[:110], rng.choice(40_000, 10)]) for b in base]
    agree = [any(x == y for x, y in zip(packing.likeness(a), packing.likeness(b))) for a, b in zip(base, near)]
    apart = [any(x == y for x, y in zip(packing.likeness(a), packing.likeness(b))) for a, b in zip(base, base[1:])]
    assert np.mean(agree) > 0.9 and np.mean(apart) < 0.05


def test_lines_without_places(spark):
    from pyspark.sql import functions as F

    from tidemark.llm.line_dedup import without

    rng = np.random.default_rng(3)
    rows = [(0, "a", [0]), (1, "a\nb\nc", [1]), (2, "a\nb\nc", [2, 0]), (3, "a\nb", []), (4, "\n\n", [1])]
    for k in range(30):
        lines = [str(x) for x in rng.integers(0, 9, int(rng.integers(1, 40)))]
        rows.append((10 + k, "\n".join(lines), [int(x) for x in rng.permutation(len(lines))[: rng.integers(0, len(lines) + 1)]]))
    rows.append((99, "\n".join(map(str, range(200_000))), list(range(0, 200_000, 2))))  # half of very many
    df = spark.createDataFrame(rows, "id int, text string, cut array<int>")
    got = {r.id: r.kept for r in df.select("id", without(F.split("text", "\n"), F.col("cut")).alias("kept")).collect()}
    for i, text, cut in rows:
        gone = set(cut)
        assert got[i] == [x for k, x in enumerate(text.split("\n")) if k not in gone]
