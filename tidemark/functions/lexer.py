"""Where the comments of curly-brace languages are: a lexer that knows strings, templates, regular expressions and nesting.

``lex`` gives each comment as (kind, text with its marks, start), kind ``line`` or ``block``, in the order of the source, or None
where a literal or a block comment has no end, which is a syntax error in all these languages.  It looks at each character a bounded number of
times, so its time grows with the length of the source.  Text between the tags of markup inside scripts is read as if it were code.
"""

from __future__ import annotations

import re

# The languages this lexer knows, and words after which a slash starts a regular expression.
LANGUAGES = {"javascript", "typescript", "java", "c", "cpp", "go"}
_BEFORE_REGEX = set("return typeof case in of delete void throw new instanceof do else yield await default extends".split())
_BEFORE_OBJECT = set("return typeof case in of new void throw yield await default extends".split())
_SIGNS_BEFORE_OBJECT = set("=(,:?[&|!+-*%~^<")
_BEFORE_PAREN = {"if", "while", "for", "with"}

_LINE = {lang: re.compile(r"//(?:\\\r?\n|[^\n])*" if lang in ("c", "cpp") else r"//[^\n\r  ]*" if lang in ("javascript", "typescript") else r"//[^\n]*") for lang in LANGUAGES}
_SHORT = {q: re.compile(rf"{q}(?:\\(?:\r\n|[\s\S])|[^\\\n{q}])*+{q}") for q in "\"'"}
_REGEX = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*+\]|[^/\\\[\n])++/\w*")
_TEMPLATE = re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^\\`$])*+(`|\$\{)")
_TEXT_BLOCK = re.compile(r'"""(?:\\[\s\S]|[^\\"]|"(?!""))*+"""')
_RAW = re.compile(r'(?:u8|[uUL])?R"([^()\\\s]{0,16})\(')
_NUMBER = re.compile(r"\.?[0-9](?:[eEpP][+-]|'(?=[0-9A-Fa-f])|[\w.])*")
_GO_RAW = re.compile(r"`[^`]*+`")
_SIGN = re.compile(r"[\s\S]")
_TWICE = re.compile(r"\+\+|--")
_CLAUSE = re.compile(r"(\s*)package\s")
_WORD = re.compile(r"[^\W\d][\w$]*|\$[\w$]*")
_PLAIN = re.compile(r"[^\w$/\"'`(){}\[\].+\-]+")


def lex(source: str, language: str) -> list[tuple[str, str, int]] | None:
    script, comments = language in ("javascript", "typescript"), []
    at, end = 0, len(source)
    if script and source.startswith("#!"):
        at = (source + "\n").index("\n")
    value = False  # does what came last end a value, so that a slash divides?
    last = ""  # the last word or sign
    opened: list[tuple[str, bool]] = []  # brackets, each with whether its end ends a value
    while at < end:
        c = source[at]
        if source.startswith("//", at):
            m = _LINE[language].match(source, at)
            comments.append(("line", m.group(), at))
            at = m.end()
            continue
        if source.startswith("/*", at):
            stop = source.find("*/", at + 2) + 2
            if stop < 2:
                return None
            comments.append(("block", source[at:stop], at))
            at = stop
            continue
        resumed = False
        if c in ")]}":
            kind, value = opened.pop() if opened else ("", c != "}")
            resumed, last = kind == "${" and c == "}", c
            if not resumed:
                at += 1
                continue
        if resumed or (c == "`" and script):
            m = _TEMPLATE.match(source, at + 1)
            if not m:
                return None
            value, last = m.group(1) == "`", m.group(1)
            if not value:
                opened.append(("${", True))
        elif c == "/":
            tag = last[-1:] == "<" or (last == "}" and source.startswith("/>", at))  # of markup inside a script
            m = _REGEX.match(source, at) if script and not value and not tag else _SIGN.match(source, at)
            if not m:
                return None
            value, last = m.re is _REGEX, c
        elif c == "`" and language == "go":
            m = _GO_RAW.match(source, at)
            if not m:
                return None
            value, last = True, c
        elif c in "\"'":
            m = _TEXT_BLOCK.match(source, at) if language == "java" and source.startswith('"""', at) else _SHORT[c].match(source, at)
            if not m:
                return None
            value, last = True, c
        elif c in "([{":
            m = _SIGN.match(source, at)
            if c == "{":  # an object where a value is looked for, else a block
                after = not value and last != "=>" and (last in _BEFORE_OBJECT or last == "${" or last[-1:] in _SIGNS_BEFORE_OBJECT)
            else:
                after = c == "[" or last not in _BEFORE_PAREN
            opened.append((c, after))
            value, last = False, c
        elif m := _NUMBER.match(source, at):
            value, last = True, "0"
        elif language == "cpp" and (m := _RAW.match(source, at)):
            stop = source.find(f'){m.group(1)}"', m.end())
            if stop < 0:
                return None
            at, value, last = stop + len(m.group(1)) + 2, True, '"'
            continue
        elif m := _WORD.match(source, at):
            member = last == "."
            value = member or m.group() not in _BEFORE_REGEX
            last = "a" if member else m.group()
        elif m := _TWICE.match(source, at):
            last = m.group()  # after x++ a slash divides
        elif m := _PLAIN.match(source, at):
            if not m.group().isspace():
                value, last = False, m.group().rstrip()[-2:]
        else:
            m = _SIGN.match(source, at)
            value, last = False, c
        at = m.end()
    return comments


def package_comments(source: str, found: list[tuple[str, str, int]]) -> list[tuple[str, str, int]]:
    """Of a Go file's comments those of the package: the group that ends on the line before the package clause."""
    first = stop = 0
    for k, (_, raw, at) in enumerate(found):
        between = source[stop:at]
        if between.strip():
            break  # code came first
        first = k if between.count("\n") > 1 else first
        stop = at + len(raw)
        m = _CLAUSE.match(source, stop)
        if m:
            return found[first : k + 1] if m.group(1).count("\n") == 1 else []
    return []
