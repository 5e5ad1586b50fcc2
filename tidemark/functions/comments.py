"""Comments of source code: Python by its own tokenizer and syntax tree, languages with curly brackets by a lexer, others (and what the
lexer finds to be in error) by patterns."""

from __future__ import annotations

import ast
import io
import re
import tokenize

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexer

# Suffix to language; how comments look.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".c": "c", ".h": "c",
    ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".go": "go", ".rs": "rust", ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".rb": "ruby", ".php": "php",
}
_SLASHES = {"javascript", "typescript", "java", "c", "cpp", "go", "rust", "php"}
_HASHES = {"shell", "ruby"}
#: Comments of so many characters of source, about, are held as Python objects.
_PART_CHARS = 1_000_000


def is_meaningless(comment: str) -> bool:
    """Blank, a ruler, a bare reminder, or under three characters."""
    return len(comment.strip()) < 3 or bool(re.fullmatch(r"[-=_\s*]+|(?i:todo|fixme)[:\s]*", comment))


def _line(raw: str) -> str:
    body = raw[1:] if raw.startswith("#") else raw[2:] if raw.startswith("//") else raw
    return "" if is_meaningless(body.strip()) else body.strip()


def _block(raw: str) -> str:
    lines = (re.sub(r"^\*", "", line.strip()).strip() for line in raw.strip().removeprefix("/*").removesuffix("*/").strip().split("\n"))
    return "\n".join(line for line in lines if line and not is_meaningless(line))


def _docstring(raw: str) -> str:
    """The first paragraph on one line, up to 500 characters."""
    paragraph = re.split(r"\n\s*\n", raw.strip("\n \t"))[0]
    out = " ".join(filter(None, map(str.strip, paragraph.split("\n"))))
    return out[:500] + "..." if len(out) > 500 else out


def python_comments(source: str) -> list[str]:
    """Docstrings, the module's first, then comments; source that doesn't parse has none."""
    try:
        tree = ast.parse(source)
        nodes = [n for n in ast.walk(tree) if isinstance(n, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef))]
        docs = [_docstring(d) for n in nodes if (d := ast.get_docstring(n, clean=False))]
        lines = [_line(t.string) for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type == tokenize.COMMENT]
    except (SyntaxError, ValueError, tokenize.TokenError):
        return []
    return [c for c in docs + lines if c]


def _blocks(source: str) -> list[str]:
    out, at = [], source.find("/*")
    while at >= 0 and (stop := source.find("*/", at + 2)) >= 0:
        out.append(source[at : stop + 2])
        at = source.find("/*", stop + 2)
    return out


def pattern_comments(source: str, language: str) -> list[str]:
    """Line comments, then block comments; those inside strings aren't told apart."""
    if language in _HASHES:
        found = map(_line, re.findall(r"#[^\n]*", source))
    elif language in _SLASHES:
        found = [*map(_line, re.findall(r"//[^\n]*", source)), *map(_block, _blocks(source))]
    else:
        found = []
    return [c for c in found if c.strip()]


def _short(comment: str) -> str:
    return comment[:500] + "..." if len(comment) > 500 else comment


def _go(raw: str) -> str:
    """Go's rules: lengths are bytes of UTF-8 (a character that the cut would split goes), bare reminders in capitals only."""
    body = (raw[2:] if raw.startswith("//") else raw[2:-2]).strip()
    lines = (line.strip().removeprefix("*").strip() for line in body.split("\n"))
    kept = [x for x in lines if len(x.encode()) >= 3 and not re.fullmatch(r"[-=_\s*]+|(?:TODO|FIXME)[:\s]*", x)]
    out = "\n".join(kept).encode()
    return out[:500].decode(errors="ignore") + "..." if len(out) > 500 else out.decode()


def lexed_comments(source: str, language: str) -> list[str]:
    """Scripts: in the order of the source, blocks of at most 500 characters. Java, C and C++: line comments, then blocks. Go: the package's
    comments first and marked so, each text once. Source with an error in a literal is left to the patterns."""
    found = lexer.lex(source, language)
    if language == "go":
        if found is None:
            lines, blocks = re.findall(r"//[^\n]*", source), _blocks(source)
            return list(dict.fromkeys(filter(None, map(_go, lines + blocks))))
        package = list(dict.fromkeys(filter(None, (_go(raw) for _, raw, _ in lexer.package_comments(source, found)))))
        rest = dict.fromkeys(filter(None, (_go(raw) for _, raw, _ in found)))
        return [f"[Package] {c}" for c in package] + [c for c in rest if c not in set(package)]
    if found is None:
        return pattern_comments(source, language)
    clean = {"line": _line, "block": _block}
    if language in ("java", "c", "cpp"):
        return [c for kind in clean for k, raw, _ in found if k == kind and (c := clean[kind](raw))]
    return [c for k, raw, _ in found if (c := _short(_block(raw)) if k == "block" else _line(raw))]


def of(source: str, language: str) -> list[str]:
    if language == "python":
        return python_comments(source)
    return lexed_comments(source, language) if language in lexer.LANGUAGES else pattern_comments(source, language)


def as_markdown(name: str, comments: list[str]) -> str:
    """A numbered list; comments of several lines as blocks."""
    body = [f"### Comment {n}\n\n{c}\n" if "\n" in c else f"{n}. {c}" for n, c in enumerate(comments, 1)]
    return "\n".join([f"# File: {name}", "", "## Comments", "", *body])


def _found(sources: pa.Array, languages: pa.Array) -> pa.Array:
    """A list of comments for each source. Only one part's comments are Python's at a time, so a batch of any length costs little more than its texts."""
    parts, part, chars = [], [], 0
    for source, language in zip(sources, languages):
        text = source.as_py()
        part.append(None if text is None else of(text, language.as_py()))
        chars += len(text or "")
        if chars >= _PART_CHARS:
            parts.append(pa.array(part, pa.list_(pa.string())))
            part, chars = [], 0
    return pa.concat_arrays([*parts, pa.array(part, pa.list_(pa.string()))])


def extract(source: Column, language: Column) -> Column:
    """array<string>; null source gives null."""

    @F.arrow_udf("array<string>")
    def run(sources: pa.Array, languages: pa.Array) -> pa.Array:
        return _found(sources, languages)

    return run(source, language)
