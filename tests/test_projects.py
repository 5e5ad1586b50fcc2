"""Projects in a store, repairs, the embedding port."""

import pytest

from tidemark.functions.chunking import SemanticChunker
from tidemark.operators import embedding, projects
from tidemark.sources.store import Store

FILES = "path string, text string, doc_type string, size long, modified_at timestamp, error string"
CHUNKS = "chunk_id string, document_id string, project_id string, content string, chunk_index int, start_line int, end_line int, vector_id string"


def taken(df):
    return dict(map(tuple, df.collect()))


def test_project_rows(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    one = projects.create(store, "Alpha docs", "first")
    two = projects.create(store, "beta")
    with pytest.raises(ValueError):
        projects.create(store, "beta")
    have = store.read("projects")
    assert projects.watched(have).count() == 0
    assert projects.resolve(have, "beta") == two and projects.resolve(have, "ALPHA") == one
    assert projects.resolve(have, one) == one and projects.resolve(have, "nothing") == "nothing"
    assert projects.rename(store, "beta", "gamma") == 1 and projects.rename(store, "beta", "delta") == 0
    with pytest.raises(ValueError):
        projects.rename(store, "gamma", "Alpha docs")
    assert projects.watch(store, "gamma") == 1
    assert [tuple(r) for r in projects.watched(store.read("projects")).select("project_id", "name").collect()] == [(two, "gamma")]


def test_reindex_and_delete(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    mine = projects.create(store, "mine")
    files = spark.createDataFrame([(f"{n}.txt", f"text of file {n}", "txt", 10, None, None) for n in "abc"], FILES)
    projects.reindex(store, files, mine, SemanticChunker())
    projects.reindex(store, files.where("path = 'a.txt'"), "other", SemanticChunker())
    assert store.read("documents").count() == 4
    projects.reindex(store, files.where("path <> 'c.txt'"), mine, SemanticChunker())
    assert {(r.project_id, r.filename) for r in store.read("documents").collect()} == {(mine, "a.txt"), (mine, "b.txt"), ("other", "a.txt")}
    assert store.read("queue").count() == store.read("chunks").count() == 3
    want = {"queue": 2, "projects": 1, "documents": 2, "chunks": 2}
    assert taken(projects.delete(store, mine, dry_run=True)) == want
    assert store.read("chunks").count() == 3
    assert taken(projects.delete(store, mine)) == want
    assert [store.read(t).count() for t in ("projects", "documents", "chunks", "queue")] == [0, 1, 1, 1]


def test_repair(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.write("documents", spark.createDataFrame([("d1", "p"), ("d2", "p")], "document_id string, project_id string"))
    store.write("chunks", spark.createDataFrame([(c, d, "p", f"text {c}", 0, 1, 1, v) for c, d, v in [("c1", "d1", "v1"), ("c2", "d1", "v2"), ("c3", "d2", None), ("c4", "gone", "v4")]], CHUNKS))
    store.write("vectors", spark.createDataFrame([("v1", "p"), ("v4", "p"), ("v9", "p")], "vector_id string, project_id string"))
    want = {"drop_orphan_chunks": 1, "drop_orphan_vectors": 2, "queue_missing_vectors": 1}
    assert taken(projects.repair(store, dry_run=True)) == want
    assert store.read("chunks").count() == 4 and projects.collection_size(store, "p") == 3 and not store.exists("queue")
    assert taken(projects.repair(store)) == want
    assert {(r.chunk_id, r.vector_id) for r in store.read("chunks").collect()} == {("c1", "v1"), ("c2", None), ("c3", None)}
    assert [r.vector_id for r in store.read("vectors").collect()] == ["v1"]
    assert [r.chunk_id for r in projects.next_batch(store.read("queue"), 5).collect()] == ["c2"]
    assert {r.vector_id for r in store.read("orphan_log").collect()} == {"v4", "v9"}
    assert set(taken(projects.repair(store)).values()) == {0}


def test_last_errors(spark):
    rows = spark.createDataFrame([("p", i, f"e{i}") for i in range(8)] + [("q", 1, "only")], "project_id string, at int, message string")
    assert taken(projects.last_errors(rows)) == {"p": ["e3", "e4", "e5", "e6", "e7"], "q": ["only"]}


def test_embed(spark):
    def port(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        if any("net" in t for t in texts):
            raise OSError("down")
        return [None if t == "none" else [0.0, 0.0] if t == "null" else [1.0] if t == "short" else [float(len(t)), 1.0] for t in texts]

    texts = ["abc", "  ", None, "bad", "net", "none", "null", "short", "x" * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    out = embedding.embed(df, "text", port, 2, group=3, attempts=2, wait=0.01)
    got = {r.id: (r.embed_status, list(r.embedding)) for r in out.collect()}
    zero = [0.0, 0.0]
    assert got == {0: ("ok", [3.0, 1.0]), 1: ("zero", zero), 2: ("zero", zero), 3: ("failed", zero), 4: ("failed", zero), 5: ("zero", zero), 6: ("zero", zero), 7: ("failed", zero), 8: ("ok", [4000.0, 1.0])}
    assert tuple(embedding.statistics(out).first()) == (9, 2, 3, 4)


def test_a_dead_service_is_asked_a_few_times_only(spark, tmp_path):
    log = tmp_path / "calls"

    def dead(texts):
        with open(log, "a") as out:
            out.write("x")
        raise OSError("down")

    df = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "id int, text string").coalesce(1)
    out = embedding.embed(df, "text", dead, 2, group=5, attempts=2, wait=0.01)
    rows = out.collect()
    assert {r.embed_status for r in rows} == {"failed"} and len(log.read_text()) == 2 * embedding.MOST_DOWN
    assert rows[-1].embed_error.startswith("not asked") and rows[0].embed_error.endswith("down")
