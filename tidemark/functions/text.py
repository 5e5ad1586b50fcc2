"""Scalar text functions as Column expressions: JVM-side, no UDFs."""

from __future__ import annotations

import re

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def tokenize(text: Column) -> Column:
    """Lower-cased runs of letters and digits of two characters or more (the default for the tokenizer port)."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda t: F.length(t) > 1)


def tokenize_literal(text: str) -> list[str]:
    """``tokenize`` of a string that the plan is built from."""
    return [t for t in regex.findall(WORD, text.lower()) if len(t) > 1]


#: Scripts written without spaces between words.
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
#: The first of their characters is U+1100: a comparison that most texts need no script lookup after.
_FAR = "[\u1100-\U0010ffff]"
_WORDS, _IS_FAR = re.compile(r"[^\W_]{2,}"), re.compile(_FAR)  # the letters and digits of ``re`` are those of L and N


def tokenize_cjk(text: Column) -> Column:
    """As ``tokenize``, but a run of Chinese, Japanese or Korean characters gives its pairs of neighbours (or its one character).

    Texts without such characters are cut by one pattern only."""
    low = F.lower(text)
    words = F.filter(F.regexp_extract_all(low, F.lit(rf"[[\p{{L}}\p{{N}}]&&[^{_UNSPACED}]]+"), F.lit(0)), lambda t: F.length(t) > 1)
    pairs = F.regexp_extract_all(low, F.lit(rf"(?=([{_UNSPACED}]{{2}}))"), F.lit(1))
    single = F.regexp_extract_all(low, F.lit(rf"(?<![{_UNSPACED}])[{_UNSPACED}](?![{_UNSPACED}])"), F.lit(0))
    return F.when(text.rlike(_FAR) & text.rlike(f"[{_UNSPACED}]"), F.concat(words, pairs, single)).otherwise(tokenize(text))


def tokenize_cjk_literal(text: str) -> list[str]:
    """``tokenize_cjk`` of a string that the plan is built from."""
    low, unspaced = text.lower(), _UNSPACED.replace("Is", "Script=")
    if not _IS_FAR.search(low):
        return _WORDS.findall(low)
    words = [t for t in regex.findall(rf"(?V1)[[\p{{L}}\p{{N}}]--[{unspaced}]]+", low) if len(t) > 1]
    return words + regex.findall(rf"[{unspaced}]{{2}}", low, overlapped=True) + regex.findall(rf"(?<![{unspaced}])[{unspaced}](?![{unspaced}])", low)


def preprocess(text: Column) -> Column:
    """Line ends to LF; control characters but tab and LF out; blanks before a line end out; at most one empty line; trimmed."""
    out = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    out = F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    out = F.regexp_replace(out, r"[ \t]+\n", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def flatten_space(text: Column) -> Column:
    """The legacy cleaning: all white space to single blanks, so its rule for line ends never applies."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def shorten(text: Column, n: int) -> Column:
    """Up to ``n`` characters as they are, else ``n`` with dots as the last three."""
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.left(text, F.lit(n - 3)), F.lit("...")))


def snippet(text: Column, n: int) -> Column:
    """Longer than ``n``: the first ``n`` characters and three dots."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def size_label(size: Column) -> Column:
    """1536 -> 1.5 KB; exact halves go to the even digit."""
    units = ["B", "KB", "MB", "GB", "TB"]
    value = size.cast("double")
    out = F.format_string("%.1f TB", F.bround(value / 1024.0**4, 1))
    for k in range(3, -1, -1):
        out = F.when(value < 1024.0 ** (k + 1), F.format_string(f"%.1f {units[k]}", F.bround(value / 1024.0**k, 1))).otherwise(out)
    return out


def percentage(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.when(whole > 0, F.round(part.cast("double") * 100 / whole, digits)).otherwise(F.lit(0.0))


def score_band(score: Column) -> Column:
    return F.when(score >= 0.8, "green").when(score >= 0.6, "yellow").otherwise("red")


def json_map(text: Column) -> Column:
    """A JSON object as map<string, string>; what isn't one gives an empty map."""
    return F.coalesce(F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"}), F.from_json(F.lit("{}"), "map<string,string>"))


def line_of(text: Column, position: Column) -> Column:
    """1 + the number of LF before the 0-based position."""
    head = F.left(text, position.cast("int"))
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def heading_level(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^(#{1,6})\s+", 1))


def meaningless(comment: Column) -> Column:
    """Blank, ruler-like, a bare reminder, or under three characters."""
    c = F.trim(comment)
    return (c == "") | c.rlike(r"^[-=_\s*]+$") | c.rlike(r"(?i)^(TODO|FIXME)\s*:?\s*$") | (F.length(c) < 3)


def like_literal(fragment: str) -> str:
    """A LIKE pattern that finds ``fragment`` as it stands (escape character: backslash)."""
    return "%" + fragment.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
