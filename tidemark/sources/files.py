"""Files as DataFrames: listings, texts by document type, and ports for parsers that need other software.

``read`` gives one row per file with an ``error`` column; a file that can't be read never stops the others.
"""

from __future__ import annotations

import io
import json
import os
import re
import subprocess
import tempfile
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import comments, paths
from ..functions.ignore import IgnoreFiles, with_ignored
from ..session import prepare

#: Encodings in the order in which they are tried; the last accepts any bytes.
ENCODINGS = ("utf-8", "gbk", "gb2312", "latin-1")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

#: Parsers of types that the standard library can't read: pdf and image get one here (bytes, name) -> text.
PORTS: dict[str, Callable[[bytes, str], str]] = {}


def decode(data: bytes) -> str:
    for encoding in ENCODINGS:
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            pass
    raise AssertionError("latin-1 decodes anything")


def _in_order(names: list[str]) -> list[str]:
    return sorted(names, key=lambda n: [int(d) for d in re.findall(r"\d+", n)])


def docx_text(data: bytes) -> str:
    """Paragraphs that aren't blank, then each table with its number, cells between bars."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    told = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    parts = [t for p in body.findall(f"{_W}p") if (t := told(p)).strip()]
    for n, table in enumerate(body.findall(f"{_W}tbl"), 1):
        parts.append(f"\n[表格 {n}]")
        parts += [" | ".join(told(c).strip() for c in row.findall(f"{_W}tc")) for row in table.findall(f"{_W}tr")]
    return "\n\n".join(parts)


def xlsx_text(data: bytes) -> str:
    """Each sheet's name, then its rows: cells that have a value between bars, blank rows left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        book = ET.fromstring(z.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in book.iter(f"{_S}sheet"):
            out += [f"# 工作表: {sheet.get('name')}", ""]
            target = targets[sheet.get(f"{_R}id")].lstrip("/")
            for row in ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_S}row"):
                cells = []
                for c in row.findall(f"{_S}c"):
                    v = c.find(f"{_S}v")
                    if c.get("t") == "inlineStr":
                        cells.append("".join(t.text or "" for t in c.iter(f"{_S}t")))
                    elif v is not None and v.text is not None:
                        cells.append(shared[int(v.text)] if c.get("t") == "s" else v.text)
                if any(x.strip() for x in cells):
                    out.append(" | ".join(cells))
            out.append("")
    return "\n".join(out)


def pptx_text(data: bytes) -> str:
    """Each slide's number, then the texts of its shapes that aren't blank."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        out = []
        for n, name in enumerate(_in_order([x for x in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", x)]), 1):
            out += [f"# 幻灯片 {n}", ""]
            for shape in ET.fromstring(z.read(name)).iter():
                if shape.tag.endswith("}txBody"):
                    lines = ["".join(t.text or "" for t in p.iter(f"{_A}t")) for p in shape.findall(f"{_A}p")]
                    if any(line.strip() for line in lines):
                        out.append("\n".join(lines).strip())
            out.append("")
    return "\n".join(out)


def extract(data: bytes, doc_type: str, name: str = "", ports: dict[str, Callable[[bytes, str], str]] | None = None) -> str:
    """A file's text by its type; a port that is given for a type comes first, an Office port that fails gives way."""
    ports = PORTS if ports is None else ports
    native = {"docx": docx_text, "xlsx": xlsx_text, "pptx": pptx_text}.get(doc_type)
    if doc_type in ports:
        try:
            text = ports[doc_type](data, name)
        except Exception:
            if native is None:
                raise
            return native(data)
        if doc_type == "image":
            if not text.strip():
                raise ValueError("no text found in the image")
            return f"[图片: {name}]\n{text}"
        return text
    if native:
        return native(data)
    if doc_type in ("pdf", "image"):
        raise ValueError(f"no parser is registered for {doc_type}")
    if doc_type == "code":
        raise ValueError("code is not indexed as text")
    return decode(data)


def paged(pages_of: Callable[[bytes], list[str | None]]) -> Callable[[bytes, str], str]:
    """A port from a function that gives a file's pages: those with text, an empty line between; a file without any text is an error."""

    def port(data: bytes, name: str) -> str:
        text = "\n\n".join(t for t in (p.strip() for p in pages_of(data) if p) if t)
        if not text:
            raise ValueError(f"no text found in {name}")
        return text

    return port


def command(argv: list[str], timeout: float = 120.0, suffix: str = ".pdf") -> Callable[[bytes, str], str]:
    """A port that runs a program on a file: ``argv`` and the path of a copy in the task's own folder, which goes afterwards.

    The last line of the output that is a JSON object counts: its ``text``, or its ``error`` as an error.  Other lines are the
    program's talk.  A program that takes longer than ``timeout`` seconds is stopped, which is an error as well.
    """

    def port(data: bytes, name: str) -> str:
        with tempfile.TemporaryDirectory() as folder:
            path = os.path.join(folder, f"input{suffix}")
            with open(path, "wb") as f:
                f.write(data)
            try:
                done = subprocess.run([*argv, path], capture_output=True, timeout=timeout, check=False)
            except subprocess.TimeoutExpired:
                raise ValueError(f"{name}: the parser took over {timeout:g} seconds") from None
        for line in reversed(done.stdout.decode("utf-8", "replace").splitlines()):
            try:
                answer = json.loads(line)
            except ValueError:
                continue
            if isinstance(answer, dict):
                if answer.get("error"):
                    raise ValueError(f"{name}: {answer['error']}")
                if not str(answer.get("text") or "").strip():
                    raise ValueError(f"no text found in {name}")
                return str(answer["text"])
        raise ValueError(f"{name}: exit {done.returncode} without a result: {done.stderr.decode('utf-8', 'replace').strip()[-100:]}")

    return port


def first_of(*ports: Callable[[bytes, str], str]) -> Callable[[bytes, str], str]:
    """A port that asks others in turn until one gives a text; the last one's error is told."""

    def port(data: bytes, name: str) -> str:
        for p in ports[:-1]:
            try:
                return p(data, name)
            except Exception:  # noqa: BLE001, S112: a parser may raise anything; the next is asked
                continue
        return ports[-1](data, name)

    return port


def listing(spark: SparkSession, folder: str, pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """path, size, modified_at of the files of a folder; contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    return reader.load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))


def read(spark: SparkSession, folder: str, *, type_of: Callable[[Column], Column] = paths.watch_type, ignore: list[str] | None = None, pattern: str | None = None, ports: dict | None = None) -> DataFrame:
    """path, doc_type, size, modified_at, text, error for every file that neither the global patterns and ``ignore`` nor the folder's own
    ignore files (at any depth) exclude."""
    prepare(spark)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    files = reader.load(folder)
    base = "/" + re.sub(r"^[a-z]+:/+", "", folder).strip("/")
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), "^" + re.escape(base) + "/", "")
    files = files.withColumn("doc_type", type_of(paths.suffix(F.col("path")))).where(~paths.ignored(relative, ignore))
    try:
        own = IgnoreFiles(folder if re.match(r"^[a-z0-9]+:/", folder) else f"file://{os.path.abspath(folder)}").files
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):  # a store that pyarrow can't list has no ignore files of its own
        own = {}
    if own:
        files = with_ignored(files.withColumn("_relative", relative), "_relative", own, "_ignored").where(~F.col("_ignored")).drop("_relative", "_ignored")

    @F.pandas_udf("text string, error string")
    def run(content: pd.Series, kind: pd.Series, path: pd.Series) -> pd.DataFrame:
        out = []
        for data, k, p in zip(content, kind, path):
            try:
                out.append((extract(bytes(data), k, p.rsplit("/", 1)[-1], ports), None))
            except Exception as e:
                out.append((None, f"{type(e).__name__}: {e}"[:200]))
        return pd.DataFrame(out, columns=["text", "error"])

    done = files.withColumn("r", run("content", "doc_type", "path"))
    return done.select("path", "doc_type", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), "r.text", "r.error")


def code_comments(spark: SparkSession, folder: str) -> DataFrame:
    """path, language, markdown (null without comments), error for source files; those over 10 MB are an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    ext = paths.suffix(F.col("path"))
    language = F.coalesce(*[F.when(ext == e, lang) for e, lang in comments.LANGUAGES.items()])
    files = files.withColumn("language", language).where(F.col("language").isNotNull())

    @F.pandas_udf("string")
    def run(content: pd.Series, languages: pd.Series, path: pd.Series) -> pd.Series:
        found = [comments.of(decode(bytes(c)), lang) if c is not None else [] for c, lang in zip(content, languages)]
        return pd.Series([comments.as_markdown(p.rsplit("/", 1)[-1], f) if f else None for f, p in zip(found, path)])

    small = F.col("length") <= paths.LARGEST_SOURCE_FILE
    out = files.withColumn("markdown", run(F.when(small, F.col("content")), "language", "path"))
    return out.select("path", "language", "markdown", F.when(~small, F.lit("file is larger than 10 MB")).alias("error"))


def with_statistics(files: DataFrame) -> tuple[DataFrame, Observation]:
    """(the same rows, what will be known once they have been computed): total, parsed, failed, characters, of the run itself and not of
    another pass over the files. Write the rows as they come: a sort after this may run its input twice and count double."""
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("total"), F.count_if(F.col("error").isNull()).alias("parsed"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters")]
    return files.observe(seen, *counts), seen
