"""Stored summaries, uploads, parser ports, folder sizes, exports to files."""

import json
import os
import sys

import pytest
from pyspark.sql import functions as F

from tidemark.functions.chunking import LineChunker
from tidemark.operators import export, folders, summaries
from tidemark.sources import files, uploads
from tidemark.sources.store import Store

CHUNKS = "chunk_id string, document_id string, project_id string, content string, chunk_index int, vector_id string"


def chunk(doc, index, content, project="p"):
    return (f"{doc}-{index}", doc, project, content, index, f"{doc}-{index}")


def shout(prompts):
    if any("bad" in p for p in prompts):
        raise OSError("down")
    return [("S:" + p).upper() + "x" * 600 for p in prompts]


def never(prompts):
    raise AssertionError("a summary that is kept was asked for again")


def state(store):
    return {r.document_id: (r.summary, r.summary_status, r.embedding) for r in store.read("summaries").collect()}


def test_summaries_follow_their_documents(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = [chunk("a", 0, "one"), chunk("a", 1, "two"), chunk("b", 0, "bad"), chunk("c", 0, None), chunk("d", 12, "late only"), chunk("e", 0, "other", "q")]
    store.write("chunks", spark.createDataFrame(rows, CHUNKS))
    store.write("vectors", spark.createDataFrame([("a-0", "a", [1.0, 0.0]), ("a-1", "a", [0.0, 1.0])], "vector_id string, document_id string, embedding array<float>"))
    counts = {r["change"]: r["count"] for r in summaries.refresh(store, shout).collect()}
    got = state(store)
    assert counts == {"new": 5} and set(got) == set("abcde")
    assert got["a"] == (("S:ONE\n\nTWO" + "x" * 600)[:500], "ok", [0.5, 0.5])
    assert got["b"][:2] == ("bad...", "failed") and got["c"][1] == "fallback" and got["d"][:2] == ("late only...", "fallback")
    # a changed, b failed before, c gone, d kept; e is of another project and isn't looked at
    rows = [chunk("a", 0, "new"), chunk("b", 0, "bad"), chunk("d", 12, "late only"), chunk("f", 0, "six"), chunk("e", 0, "changed", "q")]
    store.write("chunks", spark.createDataFrame(rows, CHUNKS))
    counts = {r["change"]: r["count"] for r in summaries.refresh(store, shout, lambda texts: [[float(len(x)), 1.0] for x in texts], 2, "p").collect()}
    now = state(store)
    assert counts == {"changed": 2, "gone": 1, "kept": 1, "new": 1} and set(now) == set("abdef")
    assert now["a"][0].startswith("S:NEW") and now["a"][2] == [500.0, 1.0] and now["d"] == got["d"] and now["e"] == got["e"] and now["b"][1] == "failed"
    store.write("chunks", spark.createDataFrame([r for r in rows if r[1] != "b"], CHUNKS))
    summaries.refresh(store, never, project_id="p")
    assert set(state(store)) == set("adef") and "summaries_made" not in store.names()


def test_a_deleted_document_takes_its_rows_along(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.write("chunks", spark.createDataFrame([chunk("a", 0, "x"), chunk("b", 0, "y")], CHUNKS))
    store.write("queue", spark.createDataFrame([("a-0", "x"), ("b-0", "y")], "chunk_id string, content string"))
    summaries.refresh(store)
    store.write("vectors", spark.createDataFrame([("a-0", "a"), ("a-9", "a"), ("b-0", "b")], "vector_id string, document_id string"))
    t = store.begin()
    assert summaries.delete_documents(t, spark.createDataFrame([("a",), ("a",), ("z",)], "document_id string")) == {"queue": 1, "vectors_without_chunk": 1, "chunks": 1, "vectors": 2, "summaries": 1}
    assert store.read("chunks").count() == 2  # nothing is seen before the commit
    t.commit()
    assert {n: store.read(n).count() for n in store.names()} == {"chunks": 1, "queue": 1, "vectors": 1, "summaries": 1}
    for n in ("chunks", "vectors", "summaries"):
        assert [r.document_id for r in store.read(n).collect()] == ["b"]


def test_uploads(spark, tmp_path):
    store, folder = Store(spark, str(tmp_path / "s")), str(tmp_path / "up")
    source = tmp_path / "a file [1].md"
    source.write_text("# Title\n\nSome text.\n" * 30)
    first = uploads.upload_path(store, folder, str(source), "p", LineChunker(), {"author": "me", "n": 3})
    assert first.status == "completed" and first.chunks > 0 and first.metadata == {"author": "me", "n": "3"}
    again = uploads.upload(store, folder, "x/y\\a file [1].md", b"short", "p", LineChunker(), "{broken")
    assert again.document_id == first.document_id and again.metadata == {} and again.chunks == 1
    assert sorted(os.listdir(tmp_path / "up" / "p"))[-1] == "a file [1].md" and store.read("documents").count() == 1
    broken = uploads.upload(store, folder, "b.docx", b"no archive", "p", LineChunker(), "[1]")
    assert broken.status == "failed" and "BadZipFile" in broken.error and broken.chunks == 0 and broken.metadata == {}
    every = {r.document_id: r.metadata for r in uploads.with_metadata(store.read("documents"), store.read("metadata").where("document_id <> 'x'")).collect()}
    assert every == {first.document_id: {}, broken.document_id: {}}
    for bad, error in (("", ValueError), (str(tmp_path), ValueError), (str(tmp_path / "none"), FileNotFoundError)):
        with pytest.raises(error):
            uploads.upload_path(store, folder, bad, "p", LineChunker())
    for bad in ("..", "", ".hidden", "a/"):
        with pytest.raises(ValueError):
            uploads.upload(store, folder, bad, b"", "p", LineChunker())


def test_metadata(spark):
    texts = [None, "", "{", "[]", "1", "null", '"a"', "{}", ' {"a": 1, "b": {"c": [2]}, "d": null} ', '{"a": 1} {"b": 2}x']
    got = [dict(r.m) for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(1).sortWithinPartitions("i").select(uploads.metadata(F.col("t")).alias("m")).collect()]
    assert got[:8] == [{}] * 8 and got[8] == {"a": "1", "b": '{"c":[2]}', "d": None} and got[9] == {}


def test_ports():
    page = files.paged(lambda data: [" one ", None, "", "  ", "two\n"])
    assert page(b"", "x.pdf") == "one\n\ntwo"
    with pytest.raises(ValueError):
        files.paged(lambda data: [None, " "])(b"", "x.pdf")

    def port(code, timeout=60.0):
        return files.command([sys.executable, "-c", code], timeout)

    read = "import sys, json; d = open(sys.argv[1]).read(); print('loading'); print(json.dumps({'text': 'early'})); print(json.dumps({'text': d + '!'})); print('[1]'); print('done')"
    assert port(read)(b"hello", "x.pdf") == "hello!"
    for code, told in (("print('{\"error\": \"no pages\"}')", "no pages"), ("print('{\"text\": \" \"}')", "no text"), ("raise SystemExit(3)", "exit 3"), ("import time; time.sleep(60)", "over 1 seconds")):
        with pytest.raises(ValueError, match=told):
            port(code, 1.0 if "sleep" in code else 60.0)(b"", "x.pdf")
    both = files.first_of(port("raise SystemExit(1)"), page)
    assert files.extract(b"", "pdf", "x.pdf", {"pdf": both}) == "one\n\ntwo"


def test_folder_sizes(spark):
    rows = [("/a/b/x.md", 5, 1), ("a//b/y.md", None, 3), ("a/z.md", 2, 2), ("top.md", 1, 9), (None, 7, 7), ("a/b c/ü.md", 4, None)]
    df = spark.createDataFrame(rows, "path string, size long, modified_at int")
    got = {r.folder: tuple(r)[1:] for r in folders.sizes(df).collect()}
    assert got == {"": (5, 12, 5, 9), "a": (4, 11, 5, 3), "a/b": (2, 5, 5, 3), "a/b c": (1, 4, 4, None)}
    assert {r.folder for r in folders.sizes(df, 1).collect()} == {"", "a"} and folders.sizes(df.limit(0)).count() == 0


@pytest.mark.parametrize("form", ["txt", "json"])
def test_export_to_files(spark, tmp_path, form):
    docs = [(f"d{k:02}", "p" if k % 2 else "q/r", f"n{99 - k}\"", "completed" if k % 5 else "failed") for k in range(20)]
    documents = spark.createDataFrame(docs, "document_id string, project_id string, filename string, status string")
    chunks = spark.createDataFrame([(d, i, f"text {d} {i}" if i else None) for d, *_ in docs for i in (1, 0)], "document_id string, chunk_index int, content string")
    n = export.save_project(chunks, documents, str(tmp_path / "out"), form, 4)
    done = sorted((f, d) for d, p, f, s in docs if s == "completed" and p == "p")
    assert n == sum(s == "completed" for *_, s in docs)
    where = tmp_path / "out" / "project_id=p"
    text = "".join((where / f).read_text() for f in sorted(os.listdir(where)) if f.startswith("part-"))
    if form == "txt":
        assert text == "".join(f"# {f}\n\n[片段 2]\ntext {d} 1\n\n" for f, d in done)
    else:
        assert [json.loads(x) for x in text.splitlines()] == [{"filename": f, "document_id": d, "chunks": [{"chunk_index": 0, "content": ""}, {"chunk_index": 1, "content": f"text {d} 1"}]} for f, d in done]
    with pytest.raises(ValueError):
        export.save_project(chunks, documents, "x", "pdf")
