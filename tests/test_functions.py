"""Chunkers, markup, comments, ignore rules, file events: goldens, plain loops and properties."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import chunking, comments, markup, paths
from tidemark.functions import text as T
from tidemark.streaming import watch

CJK = "第一段内容。这里有一句话！还有一个问题？"
CASES = [
    CJK + "\n\n" + "第二段。" * 30, "A1\tB1\tC1\t" * 2000, "# 标题\n正文。\n## 小节\n内容。" * 100, "测试内容。" * 5000, "1234567890" * 5000, "a" * 9000, " ".join(["word"] * 4000),
    "# h\n1. one\n2. two\n| a | b |\n结论。" * 200, "测" * 4000, "测" * 4100, "测" * 20000, "x. " * 3000, "line\n" * 3000,
]


@pytest.mark.parametrize("text", CASES)
@pytest.mark.parametrize("chunker", [chunking.SemanticChunker(), chunking.FlatChunker()])
def test_no_chunk_is_too_long(text, chunker):
    pieces = chunker.pieces(text)
    assert pieces and max(len(p.content) for p in pieces) <= chunking.MAX_CHUNK


@pytest.mark.parametrize("text", ["", "  \n ", "\t"])
def test_blank_text_has_no_chunks(text):
    assert chunking.SemanticChunker().split(text) == [] == chunking.FlatChunker().split(text) == chunking.LineChunker().pieces(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab 。.!?\n\t#|1;；-é", max_size=600), st.integers(20, 60))
def test_semantic_chunks_hold_everything(text, target):
    c = chunking.SemanticChunker(target=target, largest=2 * target, smallest=target // 3, overlap=0)
    pieces = c.split(text)
    assert bool(pieces) == bool(chunking.preprocess(text)) or not chunking.preprocess(text)
    assert all(len(p) <= 2 * target + 2 for p in pieces)
    if c.boundaries(chunking.preprocess(text))[0]:
        squeezed = lambda s: "".join(s.split())
        assert squeezed("".join(pieces)) == squeezed(chunking.preprocess(text))


def brute_boundaries(text, least):
    import re

    found = []
    for pattern, strength in chunking.BOUNDARIES:
        if strength < least:
            continue
        for m in re.finditer(pattern, text):
            near = [b for b in found if abs(b[0] - m.start()) < 3]
            if not near:
                found.append((m.start(), m.end(), strength))
            elif strength > near[0][2]:
                found.remove(near[0])
                found.append((m.start(), m.end(), strength))
    return sorted(found)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab 。.!\n#1;；-|\t", max_size=120), st.sampled_from([0.1, 0.5, 0.7]))
def test_boundaries_equal_the_plain_rule(text, least):
    assert list(zip(*chunking.SemanticChunker(least_strength=least).boundaries(text))) == brute_boundaries(text, least)


def test_overlap_repeats_the_end_of_the_piece_before():
    c = chunking.SemanticChunker(target=50, largest=200, smallest=10, overlap=20)
    pieces = c.split("".join(f"这是第{n}个句子的内容部分。" for n in range(30)))
    assert len(pieces) > 3 and all(p.startswith(c.tail(q)) for q, p in zip(chunking.SemanticChunker(50, 200, 10, 0).split("".join(f"这是第{n}个句子的内容部分。" for n in range(30))), pieces[1:]))


def test_code_chunks_begin_at_symbols():
    source = "\n".join(f"def f{n}(x):\n" + "    y = x + 1\n" * 30 for n in range(5))
    pieces = chunking.CodeChunker("python").pieces(source)
    assert [s["name"] for p in pieces for s in p.symbols] == [f"f{n}" for n in range(5)]
    assert all(p.content.startswith("def") for p in pieces if p.symbols)
    assert chunking.CodeChunker().symbol("x = 1", 1) is None and chunking.CodeChunker("typescript").symbol("export interface Foo {", 3)["type"] == "interface"


def test_line_chunks_number_their_lines():
    pieces = chunking.LineChunker(size=50, overlap=12).pieces("\n".join(f"line {n:03d} x" for n in range(20)))
    assert pieces[0].start_line == 1 and pieces[-1].end_line == 20
    assert all(b.start_line <= a.end_line + 1 for a, b in zip(pieces, pieces[1:]))


def test_chunks_of_a_table(spark):
    df = spark.createDataFrame([(1, "short text"), (2, None), (3, ""), (4, "句子。" * 1000)], "id long, text string")
    got = chunking.chunk(df, "id", "text", chunking.SemanticChunker()).groupBy("id").count().collect()
    assert {r.id: r["count"] for r in got}.keys() == {1, 4}
    md = spark.createDataFrame([(1, "intro\n# A\nbody\n## B\n" + "句子。" * 1000), (2, "plain")], "id long, text string")
    s = chunking.markdown_sections(md, "id", "text").orderBy("id", "section").collect()
    assert [r.header for r in s][:3] == ["A", "B", "B (part 2)"] and s[-1].level == 0
    long = spark.createDataFrame([(1, 0, "a"), (1, 1, "句子。" * 3000), (1, 2, "z")], "document_id long, chunk_index long, content string")
    again = chunking.rechunk_overlong(long).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in again] == list(range(len(again))) and again[-1].content == "z" and max(len(r.content) for r in again) <= 4000


def test_tables_to_markdown():
    html = "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td></tr><tr><td>2</td><td> 3 </td></tr></table>"
    assert markup.table_of(html) == (["a", "b"], [["1"], ["2", "3"]])
    assert markup.table_markdown(*markup.table_of(html)) == "| a | b |\n| --- | --- |\n| 1 |  |\n| 2 | 3 |"
    assert markup.table_of("") == ([], []) and markup.table_markdown([], []) == ""
    assert markup.text_of("<p>a<script>x</script> b</p><p>c</p>") == "a b\nc" and markup.text_of(None) is None


def test_comments():
    assert comments.python_comments('"""Mod."""\n# TODO\n# real one\ndef f():\n    """Doc\n    line."""\n') == ["Mod.", "Doc line.", "real one"]
    assert comments.python_comments("def (") == []
    assert comments.pattern_comments("// hello\nx /* a\n * bb cc\n */ // ---", "go") == ["hello", "bb cc"]
    assert comments.pattern_comments("# hi there", "python") == [] and comments.pattern_comments("#x\n# shell it", "shell") == ["shell it"]
    assert comments.as_markdown("a.py", ["one", "two\nlines"]).startswith("# File: a.py\n\n## Comments\n\n1. one\n### Comment 2")


def test_ignore_rules():
    for path in ("node_modules/x.js", "a/dist/b.md", "x.log", "a/b.pyc", ".env/x", "src/.git/config", "a/~/b~"):
        assert any(paths.matches(path, p) for p in paths.IGNORED), path
    for path in ("src/main.md", "distribution/a.md", "docs/builder.txt"):
        assert not any(paths.matches(path, p) for p in paths.IGNORED), path


def test_text_expressions(spark):
    df = spark.createDataFrame([("a\r\n b \n\n\n\nc\x01",), (None,)], "t string")
    assert [r[0] for r in df.select(T.preprocess(F.col("t"))).collect()] == ["a\n b\n\nc", None]
    assert spark.range(1).select(T.shorten(F.lit("abcdefgh"), 6)).first()[0] == "abc..."
    assert spark.range(1).select(T.json_map(F.lit("nope"))).first()[0] == {}
    assert spark.range(1).select(T.size_label(F.lit(1536))).first()[0] == "1.5 KB"
    assert spark.range(1).select(paths.suffix(F.lit("a/.env"))).first()[0] == "" and spark.range(1).select(paths.suffix(F.lit("a/B.TAR.GZ"))).first()[0] == ".gz"


def fold(kinds):
    state = None
    for k in kinds:
        if state == "created" and k == "modified":
            continue
        state = "modified" if state == "deleted" and k == "created" else k
    return state


def test_coalescing_equals_the_plain_loop(spark):
    import random

    rnd, t0 = random.Random(4), dt.datetime(2024, 1, 1)
    rows = [(f"p{n % 7}", rnd.choice(["created", "modified", "deleted", "moved"]), t0 + dt.timedelta(milliseconds=300 * n + (2000 if n % 37 == 0 else 0))) for n in range(300)]
    rows = sorted({(p, t): (p, k, t) for p, k, t in rows}.values(), key=lambda r: r[2])
    want = {}
    for p in {r[0] for r in rows}:
        burst: list = []
        for _, k, t in [r for r in rows if r[0] == p]:
            if burst and t - burst[-1][1] >= dt.timedelta(seconds=2):
                want[p, burst[-1][1]] = (fold([b[0] for b in burst]), len(burst))
                burst = []
            burst.append((k, t))
        want[p, burst[-1][1]] = (fold([b[0] for b in burst]), len(burst))
    got = watch.coalesce(spark.createDataFrame(rows, "src_path string, event_type string, ts timestamp"), "2 seconds").collect()
    assert {(r.src_path, r.last_ts): (r.event_type, r.n) for r in got} == want


def test_streamed_events_are_coalesced(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", "created", t0), ("a", "modified", t0 + dt.timedelta(seconds=0.5)), ("b", "deleted", t0), ("z", "modified", t0 + dt.timedelta(hours=1))]
    schema = "src_path string, event_type string, ts timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    seen = []
    q = watch.start(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lambda df, n: seen.extend(map(tuple, df.select("src_path", "event_type").collect())), str(tmp_path / "ck"), available_now=True)
    q.awaitTermination(120)
    assert set(seen) >= {("a", "created"), ("b", "deleted")}
    listing = lambda rows: spark.createDataFrame(rows, "path string, modified_at long")
    got = watch.snapshot_changes(listing([("a", 1), ("b", 1), ("c", 1)]), listing([("a", 1), ("b", 2), ("d", 1)])).collect()
    assert {tuple(r) for r in got} == {("b", "modified"), ("c", "deleted"), ("d", "created")}


def test_elements_fold_into_a_document(spark):
    from tidemark.functions import structure

    row = lambda kind, text=None, page=None, depth=None, html=None: (kind, text, page, depth, html)
    elements = [row("Text", "intro"), row("Header", "skip"), row("Title", "SHORT", 1), row("ListItem", "a"), row("Table", "", html="<table><tr><td>x</td></tr><tr><td>1</td></tr></table>"), row("PageBreak", "-", 2), row("Image", ""), row("Formula", "e=mc"), row("Title", "a longer title in lower case", None, 2), row("Text", " ")]
    schema = "id int, e array<struct<kind: string, text: string, page: int, depth: int, html: string>>"
    df = spark.createDataFrame([(1, elements), (2, None)], schema).select("id", structure.structured(F.col("e")).alias("d")).orderBy("id")
    full, none = (r.d for r in df.collect())
    assert [(s.title, s.level, s.content) for s in full.sections] == [("正文", 0, ["intro"]), ("SHORT", 1, ["a", "e=mc"]), ("a longer title in lower case", 3, [])]
    assert full.page_count == 2 and full.tables[0].headers == ["x"] and full.images[0].page == 2 and "• a" in full.text and "$$ e=mc $$" in full.markdown
    assert none.text == "" and none.sections == []
