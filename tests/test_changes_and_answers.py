"""Renames that keep ids, ignore files, answers that survive a failing part, statistics of the run itself."""

import random
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import ignore
from tidemark.functions.chunking import SemanticChunker
from tidemark.operators import fusion, moves, upkeep
from tidemark.plans import respond as R
from tidemark.plans.search import Collection, SearchRequest
from tidemark.sources import files
from tidemark.sources.ingest import embed_pending, ingest
from tidemark.sources.store import Store

FILE = "path string, size long, content_hash string"


def cost(a, b):
    return 0 if a.rsplit("/", 1)[-1] == b.rsplit("/", 1)[-1] else 1 if a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0] else 2


def test_matching_against_all_assignments(spark):
    rng = random.Random(5)
    gone, came = [], []
    for g in range(25):  # small groups of equal files
        for side in (gone, came):
            side += {(f"{g}/{rng.choice('xyz')}/{rng.choice('mnop')}", 7, f"h{g}") for _ in range(rng.randrange(0, 5))}
    gone += [("null", 1, None)]
    came += [("null2", 1, None), ("other", 9, "h0")]
    got = [tuple(r) for r in moves.match(spark.createDataFrame(gone, FILE), spark.createDataFrame([c for c in came], FILE)).collect()]
    assert len({a for a, _ in got}) == len(got) == len({b for _, b in got})
    for g in range(25):
        a, b = (sorted(p for p, _, h in side if h == f"h{g}" and p.startswith(f"{g}/")) for side in (gone, came))
        mine = [x for x in got if x[0] in a]
        assert len(mine) == min(len(a), len(b)) and all(y in b for _, y in mine)
        if mine:
            short, long = sorted((a, b), key=len)
            best = max((sum(cost(x, y) == 0 for x, y in zip(short, p)) for p in permutations(long, len(short))), default=0)
            assert sum(cost(x, y) == 0 for x, y in mine) == best
    one = moves.match(spark.createDataFrame([(f"old/{k}", 0, "e") for k in range(300)], FILE), spark.createDataFrame([(f"new/x{k}", 0, "e") for k in range(200)], FILE)).collect()
    assert len({r.path for r in one}) == 200 == len({r.old_path for r in one})


def test_what_became_of_files(spark):
    before = spark.createDataFrame([("d1", "a", 1, "h1"), ("d2", "b", 1, "h2"), ("d3", "c", 1, "h3"), ("d4", "x/d", 2, "h4"), ("d5", "e", 2, "h5"), ("d6", "f", 2, "h6"), ("d7", "g", 1, "h7")], f"document_id string, {FILE}")
    now = spark.createDataFrame([("a", 1, "h2"), ("b", 1, "h1"), ("c", 1, "h9"), ("y/d", 2, "h4"), ("e", 2, "h5"), ("copy", 2, "h5"), ("g2", 1, "h7"), ("g3", 1, "h7")], FILE)
    got = {(r.change, r.document_id, r.old_path, r.path) for r in moves.classify(before, now).collect()}
    seventh = next(x for x in got if x[1] == "d7")
    assert seventh[0] == "renamed" and seventh[3] in ("g2", "g3")
    left = ({"g2", "g3"} - {seventh[3]}).pop()
    assert got == {seventh, ("created", None, None, left), ("renamed", "d1", "a", "b"), ("renamed", "d2", "b", "a"), ("updated", "d3", "c", "c"), ("renamed", "d4", "x/d", "y/d"), ("unchanged", "d5", "e", "e"), ("created", None, None, "copy"), ("deleted", "d6", "f", None)}


def test_a_rename_keeps_id_chunks_and_vectors(spark, tmp_path):
    store, chunker = Store(spark, f"file://{tmp_path}/s"), SemanticChunker()
    taken = lambda texts: spark.createDataFrame([(p, t, "txt", len(t), None, None) for p, t in texts.items()], "path string, text string, doc_type string, size long, modified_at timestamp, error string")
    listed = lambda texts: taken(texts).select("path", "size", F.sha2("text", 256).alias("content_hash"), "modified_at")
    ingest(store, taken({"a.txt": "first", "b.txt": "second", "c.txt": "third"}), "p", chunker)
    embed_pending(store, lambda texts: [[1.0, float(len(t))] for t in texts], 2)
    ids = {r.filename: r.document_id for r in store.read("documents").collect()}
    chunks = store.read("chunks").collect()
    todo = moves.sync(store, "p", listed({"dir/a.txt": "first", "b.txt": "second now", "new.txt": "n"}))
    assert {(r.change, r.path) for r in todo.collect()} == {("updated", "b.txt"), ("created", "new.txt")}
    assert {r.filename: r.document_id for r in store.read("documents").collect()} == {"dir/a.txt": ids["a.txt"], "b.txt": ids["b.txt"]}
    ingest(store, taken({"dir/a.txt": "first", "a.txt": "another", "b.txt": "second now"}), "p", chunker)
    now = {r.filename: r.document_id for r in store.read("documents").collect()}
    assert now["dir/a.txt"] == ids["a.txt"] and now["b.txt"] == ids["b.txt"] and now["a.txt"] not in ids.values()
    kept = [c for c in store.read("chunks").collect() if c.document_id == ids["a.txt"]]
    assert kept == [c for c in chunks if c.document_id == ids["a.txt"]] and kept[0].vector_id is not None
    assert {r.document_id for r in store.read("vectors").collect()} == {ids["a.txt"]}


TREE = {
    "": "# comment\n\n*.log\n/build\ndocs/*.tmp\nsecret/\n!keep.log\nfoo/**/bar\n**/deep\nend/**\n\\#odd\nspace\\ \nname[0-9].txt\nq?.md\n",
    "sub": "!*.log\n/only\nx.dat  \n",
    "sub/inner": "*.log\n",
}
CASES = {
    "a.log": True, "x/y/b.log": True, "keep.log": False, "x/keep.log": False, "build": True, "build/a": True, "x/build": False, "docs/a.tmp": True, "docs/x/a.tmp": False, "x/docs/a.tmp": False,
    "secret/a": True, "x/secret/b/c": True, "secret": False, "foo/bar": True, "foo/a/b/bar": True, "foo/bars": False, "deep": True, "a/deep/b": True, "end/x/y": True, "end": False, "#odd": True, "space ": True,
    "name1.txt": True, "namex.txt": False, "qa.md": True, "q/.md": False, "sub/a.log": False, "sub/inner/a.log": True, "sub/only": True, "sub/x/only": False, "sub/z/x.dat": True, "x.dat": False,
}


@pytest.mark.parametrize("most", [8 << 20, 10])
def test_ignore_files(spark, monkeypatch, most):
    monkeypatch.setattr(ignore, "MOST_BYTES", most)
    monkeypatch.setattr(ignore.paths, "IGNORED", ("node_modules/",))  # the global patterns have their own tests
    rows = spark.createDataFrame([(p, i) for i, p in enumerate(CASES)] + [(None, 99), ("a.log", 100), ("node_modules/x", 101)], "path string, n int")
    got = {r.n: r.ignored for r in ignore.with_ignored(rows, "path", TREE).collect()}
    assert got == {i: v for i, v in enumerate(CASES.values())} | {99: False, 100: True, 101: True}


def test_ignore_files_are_read_again(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("a")
    (tmp_path / "sub" / "b.txt").write_text("b")
    (tmp_path / "sub" / "c.md").write_text("c")
    names = lambda: {r.path.rsplit("/", 1)[-1] for r in files.read(spark, str(tmp_path)).select("path").collect()}
    assert names() == {"a.txt", "b.txt", "c.md"}
    own = ignore.IgnoreFiles(f"file://{tmp_path}")
    assert own.files == {} and not own.reload()
    (tmp_path / "sub" / ".gitignore").write_text("*.txt\n")
    assert own.reload() and own.files == {"sub": "*.txt\n"} and not own.reload()
    assert names() == {"a.txt", "c.md"}
    (tmp_path / "sub" / ".gitignore").unlink()
    assert own.reload() and own.files == {}


@pytest.fixture()
def collection(spark):
    chunks = spark.createDataFrame([(1, 1, "aa bb aa"), (2, 1, "bb cc"), (3, 2, "dd aa")], "chunk_id long, document_id long, content string").withColumn("chunk_index", F.lit(0))
    vectors = spark.createDataFrame([(1, 1, [1.0, 0.0]), (3, 2, [0.5, 1.0])], "vector_id long, document_id long, embedding array<double>")
    return Collection(chunks, vectors, documents=spark.createDataFrame([(1, "one.txt"), (2, "two.txt")], "document_id long, filename string"))


def broken(query, texts):
    raise RuntimeError("scorer down")


def test_answers_survive_a_failing_part(spark, collection):
    R.register("length", lambda: lambda query, texts: [float(len(t)) for t in texts])
    R.register("broken", lambda: broken)
    R.register("short", lambda: lambda query, texts: [1.0])
    state = lambda a: {r.part: r.ok for r in a.status.collect()}
    request = SearchRequest("aa", 2)
    fine = R.respond(collection, request, lambda q: [1.0, 0.0], "length")
    assert state(fine) == {"embed": True, "semantic": True, "keyword": True, "rerank": True} and fine.query_time_ms > 0
    assert [(r.chunk_id, r.score, r.search_type, r.filename) for r in fine.hits.collect()] == [(1, 8.0, "reranked", "one.txt"), (2, 5.0, "reranked", "one.txt")]
    assert {r.part: r.rows for r in fine.status.collect()}["keyword"] == 3
    for name in ("broken", "short"):  # the order of fusion stands
        bad = R.respond(collection, request, lambda q: [1.0, 0.0], name)
        assert state(bad)["rerank"] is False and bad.hits.first().chunk_id == 1 and bad.hits.first().search_type != "reranked"
    fails = Collection(collection.chunks, collection.vectors.withColumn("embedding", F.raise_error(F.lit("store down")).cast("array<double>")), documents=collection.documents)
    left = R.respond(fails, request, lambda q: [1.0, 0.0])
    assert state(left) == {"embed": True, "semantic": False, "keyword": True} and left.hits.first().chunk_id == 1
    assert "store down" in left.status.where("NOT ok").first().error
    alone = R.respond(collection, request)
    assert state(alone) == {"embed": False, "keyword": True} and alone.hits.count() == 2
    assert R.respond(collection, SearchRequest("aa", 2, mode="semantic")).hits.count() == 0
    with pytest.raises(ValueError):
        R.scored(collection.chunks, "aa", "unknown")
    both = collection.semantic([1.0, 0.0], 4).unionByName(collection.keyword("aa", 4))
    assert [r.chunk_id for r in fusion.rrf(both).orderBy(F.desc("score"), "seen", "chunk_id").limit(2).collect()] == [r.chunk_id for r in R.respond(collection, request, lambda q: [1.0, 0.0]).hits.collect()]


def test_statistics_and_alarms(spark, tmp_path):
    (tmp_path / "a.txt").write_text("four")
    (tmp_path / "b.docx").write_bytes(b"broken")
    rows, seen = files.with_statistics(files.read(spark, str(tmp_path)))
    assert len(rows.collect()) == 2 and seen.get == {"total": 2, "parsed": 1, "failed": 1, "characters": 4}
    points = spark.createDataFrame([("a", 101, 0), ("b", 100, 0), ("c", 500, 1)], "project_id string, points long, indexed long")
    assert [tuple(r) for r in upkeep.unindexed(points).collect()] == [("a", 101, 0, "a: 101 points, none indexed")]
    assert Counter(r.change for r in moves.classify(spark.createDataFrame([], f"document_id string, {FILE}"), spark.createDataFrame([], FILE)).collect()) == {}
