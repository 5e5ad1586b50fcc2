"""Files to text, tables on disk, ingestion."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions.chunking import SemanticChunker
from tidemark.sources import files
from tidemark.sources.ingest import ingest
from tidemark.sources.store import Store

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


DOCX = zipped({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"})
XLSX = zipped(
    {
        "xl/workbook.xml": f'<workbook {S} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {S}><si><t>x</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c t="s"><v>0</v></c><c><v>2</v></c></row><row/></sheetData></worksheet>',
    }
)
PPTX = zipped({"ppt/slides/slide1.xml": '<p:sld xmlns:p="p" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><p:txBody><a:p><a:r><a:t>Hi</a:t></a:r></a:p></p:txBody></p:sld>'})


def test_office_files():
    assert files.extract(DOCX, "docx") == "One\n\n\n[表格 1]\n\na | b"
    assert files.extract(XLSX, "xlsx") == "# 工作表: One\n\nx | 2\n"
    assert files.extract(PPTX, "pptx") == "# 幻灯片 1\n\nHi\n"


def test_ports_and_encodings():
    assert files.decode("中文".encode("gbk")) == "中文" and files.decode(b"\xff\xfe\xfd") and files.decode("é".encode()) == "é"
    assert files.extract(b"x", "pdf", "a.pdf", {"pdf": lambda data, name: name}) == "a.pdf"
    assert files.extract(DOCX, "docx", "a", {"docx": lambda data, name: 1 / 0}).startswith("One")
    with pytest.raises(ValueError):
        files.extract(b"x", "image", "a.png", {"image": lambda data, name: " "})
    for kind in ("pdf", "code", "image"):
        with pytest.raises(ValueError):
            files.extract(b"x", kind)


def test_ingest_twice_and_after_a_change(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "node_modules").mkdir(parents=True)
    (folder / "a.md").write_text("# Title\n" + "句子。" * 800)
    (folder / "b.txt").write_bytes("中文".encode("gbk"))
    (folder / "c.docx").write_bytes(b"broken")
    (folder / "d.docx").write_bytes(DOCX)
    (folder / "node_modules" / "e.md").write_text("no")
    got = files.read(spark, str(folder)).orderBy("path").collect()
    assert [(r.path[-6:], r.doc_type, r.error is None) for r in got] == [("n/a.md", "md", True), ("/b.txt", "txt", True), ("c.docx", "docx", False), ("d.docx", "docx", True)]
    assert got[1].text == "中文" and files.listing(spark, str(folder)).count() == 5
    store = Store(spark, str(tmp_path / "store"))
    first = ingest(store, files.read(spark, str(folder)), "p", SemanticChunker())
    n = first["chunks"].count()
    assert n == first["queue"].count() and first["documents"].where("status = 'failed'").count() == 1
    again = ingest(store, files.read(spark, str(folder)), "p", SemanticChunker())
    assert again["chunks"].count() == n == again["queue"].count()
    (folder / "a.md").write_text("short")
    assert ingest(store, files.read(spark, str(folder)), "p", SemanticChunker())["chunks"].count() < n
    left = store.delete("documents", spark.createDataFrame([(store.read("documents").first().document_id,)], "document_id string"), "document_id")
    assert left.count() == 3


def test_comments_of_files(spark, tmp_path):
    (tmp_path / "a.py").write_text('"""Doc of it."""\n')
    (tmp_path / "b.go").write_text("// says something\nx\n")
    (tmp_path / "c.txt").write_text("# no")
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.code_comments(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.py", "b.go"} and "1. Doc of it." in got["a.py"].markdown and got["b.go"].error is None


def test_search_and_upkeep_by_hand(spark):
    from tidemark.operators import export, fusion, keyword, upkeep
    from tidemark.operators import vectors as V
    from tidemark.plans.search import Collection, SearchRequest, search

    chunks = spark.createDataFrame([(1, 1, "aa bb aa"), (2, 1, "bb cc"), (3, 2, "dd")], "chunk_id long, document_id long, content string")
    hits = keyword.search(chunks, "aa zz", 10).collect()
    assert [h.chunk_id for h in hits] == [1, 2, 3] and hits[0].score > 0 == hits[1].score
    assert keyword.search(chunks, "!", 10).count() == 0 and keyword.search(chunks, "aa", 10, pad=False).count() == 1
    changed = keyword.remove(keyword.upsert(chunks, spark.createDataFrame([(3, 2, "aa")], chunks.schema)), spark.createDataFrame([(1,), (1,), (9,)], "chunk_id long"))
    assert sorted(map(tuple, changed.collect())) == [(2, 1, "bb cc"), (3, 2, "aa")]
    vectors = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [0.0, 0.0]), (3, 2, [1.0, 1.0]), (4, 2, None), (5, 2, [])], "vector_id long, document_id long, embedding array<double>")
    got = V.search(vectors, [1.0, 0.0], 5).collect()
    assert [(r.vector_id, r.score) for r in got] == [(1, 1.0), (3, 0.707107)]
    assert V.search(vectors, [1.0, 0.0], 5, filters={"document_id": [2]}).count() == 1
    c = Collection(chunks.withColumn("chunk_index", F.lit(0)), vectors)
    fused = search(c, SearchRequest("aa", 2, rerank=False), [1.0, 0.0]).collect()
    assert fused[0].chunk_id == 1 and abs(fused[0].score - 2 / 61) < 1e-6
    assert search(c, SearchRequest("aa", 2), [1.0, 0.0], fusion.lexical_scorer("aa")).first().search_type == "reranked"
    assert search(c, SearchRequest("aa", 5, mode="hierarchical"), [1.0, 0.0]).count() == 2
    for bad in (dict(query=""), dict(query="x", top_k=0), dict(query="x", mode="y"), dict(query="x", score_threshold=2.0)):
        with pytest.raises(ValueError):
            SearchRequest(**bad)
    queue = spark.createDataFrame([(1, "failed", 1), (2, "processing", 0)], "chunk_id long, status string, retry_count int")
    rows, counts = upkeep.enqueue(queue, chunks.select("chunk_id", "content"))
    assert tuple(counts.first()) == (1, 2, 3) and rows.first().chunk_id == 3
    done = upkeep.record_outcome(queue, spark.createDataFrame([(1, False, "x" * 300), (2, True, None)], "chunk_id long, ok boolean, error string")).orderBy("chunk_id").collect()
    assert [(r.status, r.retry_count, r.error_msg and len(r.error_msg)) for r in done] == [("failed", 2, 200), ("done", 0, None)]
    left = upkeep.delete_documents({"chunks": chunks, "vectors": vectors}, spark.createDataFrame([(1,)], "document_id long"))
    assert left["chunks"].count() == 1 and left["vectors"].count() == 3
    assert "⚠️" in export.sync_report([{"name": "a", "db_count": 4921, "vector_count": 4411, "missing": 510, "orphan": 0}])
    assert spark.range(1).select(export.error_summary(F.array(*[F.lit(str(i)) for i in range(6)]))).first()[0] == "0; 1; 2 ... 共 6 个错误"
