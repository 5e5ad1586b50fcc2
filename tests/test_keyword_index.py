"""The stored keyword index against the search that counts anew, and the store's versions."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import keyword
from tidemark.operators.keyword_index import KeywordIndex
from tidemark.sources.store import Conflict, Store

ROWS = [
    (1, "人工智能有很多分支,例如机器学习。"), (2, "The weather is fine today"), (3, "机器学习是人工智能的一个分支"), (4, "fine wine and fine food"), (5, None), (6, ""), (7, "日本語のテキスト and some english words"),
    (8, "some english words about the weather"), (9, "短"),
]


@pytest.fixture()
def chunks(spark):
    return spark.createDataFrame(ROWS, "chunk_id long, content string")


def counted(chunks, query, **options):
    return [(r.chunk_id, r.score) for r in keyword.search(chunks, query, tokens=text.tokenize_cjk, literal=text.tokenize_cjk_literal, **options).collect()]


def test_tokens_of_unspaced_scripts(spark, chunks):
    got = {r.chunk_id: sorted(r.t or []) for r in chunks.select("chunk_id", text.tokenize_cjk(F.col("content")).alias("t")).collect()}
    assert got == {i: sorted(text.tokenize_cjk_literal(c)) if c is not None else [] for i, c in ROWS}
    assert text.tokenize_cjk_literal("人工智能 ok x 短") == ["ok", "人工", "工智", "智能", "短"]


def test_stored_index(spark, chunks, tmp_path):
    index = KeywordIndex(Store(spark, f"file://{tmp_path}/s"))
    assert not index.exists and index.size == 0
    index.build(chunks.where("chunk_id <> 3"))
    for fresh in (chunks.where("chunk_id IN (3, 4)"), chunks.where("chunk_id = 4").withColumn("content", F.lit("fine weather again"))):
        index.add(fresh)
    now = chunks.where("chunk_id <> 4").unionByName(fresh)
    index.remove(spark.createDataFrame([(2,), (2,), (77,)], "chunk_id long"))
    now = now.where("chunk_id <> 2")
    again = KeywordIndex(Store(spark, f"file://{tmp_path}/s"))  # as another session finds it
    assert again.size == now.count()
    for query in ("人工智能有哪些分支", "fine weather", "english english words", "nothing here"):
        for pad in (True, False):
            assert [(r.chunk_id, r.score) for r in again.search(query, 5, pad=pad).collect()] == counted(now, query, top_k=5, pad=pad)
    assert {r.chunk_id for r in again.search("人工智能有哪些分支", 3, 0.01).collect()} == {1, 3}
    assert again.search("!", 5).count() == 0
    index.clear()
    assert not again.exists


def test_a_write_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s")
    with pytest.raises(FileNotFoundError):
        store.read("t")
    store.write("t", spark.range(3))
    before = store.read("t")
    monkeypatch.setattr(store, "_point", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
    with pytest.raises(RuntimeError):
        store.write("t", spark.range(9))
    monkeypatch.undo()
    assert store.read("t").count() == 3
    store.write("t", store.read("t").where("id > 0"))
    assert store.read("t").count() == 2 and before.count() == 3  # a reader of the version before goes on


def test_segments_after_any_changes(spark, tmp_path, monkeypatch):
    """Adds, replacements and removals in turn, with merges between them: scores stay those of a rebuild."""
    import random

    from tidemark.operators import keyword_index

    monkeypatch.setattr(keyword_index, "FAN", 3)
    rng, index, now, written = random.Random(3), KeywordIndex(Store(spark, f"file://{tmp_path}/s")), {}, []
    vocabulary = [f"word{k}" for k in range(12)] + ["人工智能", "机器学习"]
    for step in range(7):
        text_of = lambda: " ".join(rng.choices(vocabulary, [2**-k for k in range(12)] + [0.1, 0.1], k=rng.randrange(0, 30)))
        if step in (2, 5):
            gone = rng.sample(sorted(now), 6)
            index.remove(spark.createDataFrame([(i,) for i in [*gone, 999]], "chunk_id long"))
            now = {i: c for i, c in now.items() if i not in gone}
        else:
            fresh = {rng.randrange(60): text_of() for _ in range(40 if step == 0 else 12)}
            index.add(spark.createDataFrame(list(fresh.items()), "chunk_id long, content string"))
            now |= fresh
        written.append(index.segments)
    assert index.size == len(now) and written[0] == [1] and any(len(b) < len(a) for a, b in zip(written, written[1:]))
    chunks = spark.createDataFrame(list(now.items()), "chunk_id long, content string")
    for query, k in (("word0 word5 word11", 3), ("人工智能 word3 word3", 10), ("word9", 50)):
        assert [(r.chunk_id, r.score, r.content) for r in index.search(query, k).collect()] == [(i, s, now[i]) for i, s in counted(chunks, query, top_k=k)]


def test_a_change_writes_only_its_segment(spark, tmp_path):
    index = KeywordIndex(Store(spark, f"file://{tmp_path}/s"))
    many = spark.range(200).selectExpr("id AS chunk_id", "concat('common word', id % 7, ' and number', id) AS content")
    index.build(many)
    t = index.store.begin()
    first = {n: f for n, f in t.tables.items() if ".1." in n}
    index.add(many.where("id < 3").withColumn("content", F.lit("fresh text")))
    index.remove(many.where("id = 9"))
    t = index.store.begin()
    assert first.items() <= t.tables.items() and index.segments == [1, 2, 3] and index.size == 199
    assert t.read("keyword.2.postings").count() == 6 and "keyword.3.postings" not in t.tables
    one, two = KeywordIndex(Store(spark, index.store.root)), KeywordIndex(Store(spark, index.store.root))
    begun = two.store.begin()
    two.store.begin = lambda: begun
    one.remove(many.where("id = 10"))
    with pytest.raises(Conflict):  # two writers of one index
        two.remove(many.where("id = 11"))
    assert index.size == 198


def test_requests_use_the_index(spark, chunks, tmp_path):
    from tidemark.plans.search import Collection, SearchRequest, search

    index = KeywordIndex(Store(spark, f"file://{tmp_path}/s"))
    index.build(chunks)
    vectors = spark.createDataFrame([(1, 1, [1.0, 0.0])], "vector_id long, document_id long, embedding array<double>")
    request = SearchRequest("人工智能有哪些分支", 3, mode="keyword", rerank=False)
    stored, anew = (search(Collection(chunks, vectors, index=i), request).collect() for i in (index, None))
    assert stored == anew and {r.chunk_id for r in stored[:2]} == {1, 3}


def test_each_text_is_cut_once_and_tasks_grow_with_the_words(spark, chunks, tmp_path, monkeypatch):
    from tidemark.operators import keyword_index

    monkeypatch.setattr(keyword_index, "_TASK_WORDS", 1)
    monkeypatch.setattr(keyword_index, "_BATCH_CHARS", 20)  # several batches for a task
    index = KeywordIndex(Store(spark, f"file://{tmp_path}/s"))
    index.build(chunks)
    held = {r.chunk_id: (r.dl, {c.term: c.tf for c in r.counts}) for r in index.store.read("keyword.1.chunks").collect()}
    plain = {i: text.tokenize_cjk_literal(c or "") for i, c in ROWS}
    assert held == {i: (len(t), {x: t.count(x) for x in t}) for i, t in plain.items()}
    assert index.store.read("keyword.1.postings").select(F.input_file_name()).distinct().count() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    index.remove(chunks.where("chunk_id IN (3, 8)"))
    assert "content" not in index.store.read("keyword.2.dead").columns  # what is removed is known by its counts
    assert [(r.chunk_id, r.score) for r in index.search("english weather", 5).collect()] == counted(chunks.where("chunk_id NOT IN (3, 8)"), "english weather", top_k=5)
