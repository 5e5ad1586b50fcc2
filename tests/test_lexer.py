"""The lexer of comments: literals that hold comment marks, and sources put together at random whose comments are known."""

import random
import time

from tidemark.functions import comments, lexer

# Pieces without a comment, each with marks inside a literal where the language has such literals.
PIECES = {
    "javascript": ['var a = "// no";', "b = '/* no */' + 'it\\'s // no';", "c = `// no ${d + `/* no */ ${ {x: '}'}.x } // no`} no`;", "e = /[/*]\\/\\/ '\"`/.test(f);", "g = h / i / j;", "k = (l) / m; n++ / 2;", "if (o) /['\"]/.exec(p);", "function q() {} /[`]/.test(r);", "s = { t: 1 } / 2;", "return /\"/;", "u = v.return / 2 / w;", "x = a[1] / b / c", "y = 1e+3 / .5 / 0x1F;", "z = s.replace(/>/g, '&gt;');", "m = <A {...p} />;", "n = <b>t</b>;", "o = a\n/ b / c;"],
    "java": ['String a = "// no \\" /* no */";', "char b = '\"'; char c = '\\'';", 'String t = """\n  // no "" \\""" /* no\n  """;', "int d = e / f;"],
    "c": ['char *a = "/* no */ // no \\\\";', "char b = '\"', c = '\\'';", "int d = e / *f;", '#include <sys/types.h>', 'x = "a\\\n// no";'],
    "cpp": ['auto a = R"x(no // )" /* " )x";', "int n = 1'000'000 / 2;", 'auto b = u8R"(/* no " */)";', 'auto c = L"// no";'],
    "go": ['a := "// no \\""', "b := `// no\n\\ /* no */`", "c := '\"'", "d := '\\''", "e := f / g"],
}
PIECES["typescript"] = [*PIECES["javascript"], "let a: Map<string, number[]> = f<T>(x) / 2;", "type U = `a/*${string}`;"]


def test_comments_between_literals():
    rng = random.Random(5)
    for language, pieces in PIECES.items():
        for _ in range(150):
            source, want = "", []
            for _ in range(rng.randrange(1, 12)):
                kind = rng.randrange(3)
                if kind == 0:
                    raw = f"// c{rng.randrange(100)} it's \"/* `x"
                    want.append(("line", raw, len(source)))
                elif kind == 1:
                    raw = f"/* b{rng.randrange(100)}\n * '// \" ` **/"
                    want.append(("block", raw, len(source)))
                else:
                    raw = rng.choice(pieces)
                source += raw + "\n"
            assert lexer.lex(source, language) == want, (language, source)


def test_every_piece_alone_then_a_comment():
    for language, pieces in PIECES.items():
        for piece in pieces:
            assert comments.of(f"{piece} // yes\n", language) == ["yes"] or language == "c" and piece.startswith("#"), (language, piece)


def test_order_and_limits_by_language():
    source = "/* first one */ x = '//'; // second\n/* " + "y" * 600 + " */"
    cut = "y" * 500 + "..."
    assert comments.of(source, "javascript") == ["first one", "second", cut] == comments.of(source, "typescript")
    assert comments.of(source.replace("'//'", '"//"'), "java") == ["second", "first one", "y" * 600]
    assert comments.of("// one \\\n goes on\nint a;", "c") == ["one \\\n goes on"]
    assert comments.of("#!/usr/bin/env node // no\n// yes", "javascript") == ["yes"]


def test_go_package_and_repeats():
    source = "// licence\n\n// Package p does it.\n// licence\n\npackage p\n"
    assert comments.of(source, "go") == ["licence", "Package p does it."]  # a blank line: not the package's
    source = "// licence\n\n// Package p does it.\n// licence\npackage p\n\nvar u = `// no` // note\n/* note */\n// todo\n// TODO:\n// é\n// ée\n"
    assert comments.of(source, "go") == ["[Package] Package p does it.", "[Package] licence", "note", "todo", "ée"]
    assert comments.of("/* doc\n * more */\npackage p", "go") == ["[Package] doc\nmore"]
    assert comments.of("/* doc */ package p", "go") == ["doc"]
    assert comments.of("import x\n// doc\npackage p", "go") == ["doc"]
    assert comments.of("// " + "é" * 251 + "\n", "go") == ["é" * 250 + "..."]


def test_errors_fall_back_to_patterns():
    for language in lexer.LANGUAGES - {"go"}:
        assert comments.of('x = "open // a note\n// yes /* bbb */', language) == ["a note", "yes /* bbb */", "bbb"]
    assert comments.of("x := `open // note\n// note", "go") == ["note"]
    assert lexer.lex("/* open", "c") is None and comments.of("/* open", "c") == []
    assert comments.of("", "java") == [] and comments.of("x", "unknown") == []


def test_time_grows_with_length():
    began = time.perf_counter()
    for unit in ("/*", "'", "`${", "(", "a / b ", "{", "/* c */", "\\", '"\\', "//", "/[", "R\"(", "é² "):
        for language in lexer.LANGUAGES:
            comments.of(unit * 20_000, language)
    assert time.perf_counter() - began < 20


def test_a_batch_is_told_in_parts(spark, monkeypatch):
    import pyarrow as pa

    sources, sizes, plain = [f"// note {k}\nx = 1;" if k % 4 else None for k in range(40)], [], comments.of
    monkeypatch.setattr(comments, "_PART_CHARS", 60)
    array = pa.array
    monkeypatch.setattr(comments.pa, "array", lambda values, *kind: sizes.append(len(values)) or array(values, *kind))
    found = comments._found(array(sources), array(["javascript"] * 40))
    assert found.to_pylist() == [None if s is None else plain(s, "javascript") for s in sources]
    assert len(sizes) > 5 and max(sizes) < 10  # no more than a part's comments are held as objects
    assert comments._found(array([], pa.string()), array([], pa.string())).to_pylist() == []
