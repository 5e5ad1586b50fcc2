"""Exports and listings: ordered texts of documents and projects, pages, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def ordered(value: Column, position: str = "chunk_index") -> Column:
    """The values of a group in order of a position."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), value.alias("v")))), lambda x: x["v"])


def documents_text(chunks: DataFrame) -> DataFrame:
    """document_id, text: chunks by chunk_index, an empty line between."""
    return chunks.groupBy("document_id").agg(F.array_join(ordered(F.col("content")), "\n\n").alias("text"))


def documents_json(chunks: DataFrame) -> DataFrame:
    """document_id, json: an array of {chunk_index, content} in order."""
    return chunks.groupBy("document_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("chunk_index", "content")))).alias("json"))


def project_text(chunks: DataFrame, documents: DataFrame, label: str = "片段") -> DataFrame:
    """project_id, text: completed documents by name, each a header and its numbered chunks."""
    done = documents.where("status = 'completed'").select("document_id", "project_id", "filename")
    numbered = F.concat(F.lit(f"[{label} "), (F.col("chunk_index") + 1).cast("string"), F.lit("]\n"), F.col("content"))
    each = chunks.join(done, "document_id").groupBy("project_id", "document_id", "filename").agg(F.array_join(ordered(numbered), "\n\n").alias("body"))
    whole = each.withColumn("block", F.concat(F.lit("# "), F.col("filename"), F.lit("\n\n"), F.col("body")))
    return whole.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("filename", "document_id", "block"))), lambda x: x["block"]), "\n\n").alias("text"))


def project_rows(chunks: DataFrame, documents: DataFrame, label: str = "片段") -> DataFrame:
    """project_id, filename, document_id, text: the blocks of ``project_text``, a row for each completed document, so that no project has to fit into a cell."""
    done = documents.where("status = 'completed'").select("document_id", "project_id", "filename")
    numbered = F.concat(F.lit(f"[{label} "), (F.col("chunk_index") + 1).cast("string"), F.lit("]\n"), F.col("content"))
    bodies = chunks.groupBy("document_id").agg(F.array_join(ordered(numbered), "\n\n").alias("body"))
    return done.join(bodies, "document_id").select("project_id", "filename", "document_id", F.concat(F.lit("# "), "filename", F.lit("\n\n"), "body").alias("text"))


def project_json(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """project_id, filename, document_id, chunks, json: of each completed document an array of {chunk_index, content} in order."""
    named = _pieces(chunks, documents)
    return named.select("project_id", "filename", "document_id", F.size("chunks").cast("long").alias("chunks"), F.to_json("chunks").alias("json"))


def _pieces(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    done = documents.where("status = 'completed'").select("document_id", "project_id", "filename")
    pieces = F.array_sort(F.collect_list(F.struct("chunk_index", F.coalesce("content", F.lit("")).alias("content"))))
    return done.join(chunks.groupBy("document_id").agg(pieces.alias("chunks")), "document_id")


#: Forms of an exported project, and what stands between two documents.
FORMATS = {"txt": "\n\n", "markdown": "\n\n", "json": "\n"}


def save_project(chunks: DataFrame, documents: DataFrame, folder: str, form: str = "txt", parts: int | None = None) -> int:
    """Write completed documents as text below ``folder``, one folder a project; the number of documents.

    Part files follow one another in the order of file names, so reading them by name gives the export; no project passes through one
    task or the driver.  ``txt`` and ``markdown`` are the same; ``json`` has a line for each document: filename, document_id, chunks.
    A project's name that can't be a folder's is encoded as Spark encodes partition values.
    """
    if form not in FORMATS:
        raise ValueError(f"form: one of {', '.join(FORMATS)}")
    if form == "json":
        rows = _pieces(chunks, documents).withColumn("text", F.to_json(F.struct("filename", "document_id", "chunks")))
    else:
        rows = project_rows(chunks, documents)
    seen = Observation()
    keys = ["project_id", "filename", "document_id"]
    dealt = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).observe(seen, F.count(F.lit(1)).alias("n")).select("project_id", "text").write.mode("overwrite").option("lineSep", FORMATS[form]).partitionBy("project_id").text(folder)
    return seen.get["n"]


def page(df: DataFrame, order: list, skip: int = 0, limit: int = 100) -> DataFrame:
    """A page in a stated order: a negative skip is 0, a limit under 1 is 100, one over 500 is 500."""
    return df.orderBy(*order).offset(max(skip, 0)).limit(100 if limit < 1 else min(limit, 500))


def pages(total: int, size: int) -> int:
    return -(-total // size)


def find_project(projects: DataFrame, wanted: str) -> DataFrame:
    """The project of that id, else the first (by id) of that name."""
    hit = projects.where((F.col("project_id") == wanted) | (F.col("name") == wanted))
    return hit.orderBy(F.when(F.col("project_id") == wanted, 0).otherwise(1), "project_id").limit(1)


def error_summary(errors: Column, listed: int = 5, shown: int = 3) -> Column:
    """Up to ``listed`` errors in full, else the first ``shown`` and their number."""
    return F.when(F.size(errors) <= listed, F.array_join(errors, "; ")).otherwise(F.concat(F.array_join(F.slice(errors, 1, shown), "; "), F.lit(" ... 共 "), F.size(errors).cast("string"), F.lit(" 个错误")))


def sync_report(rows: list[dict]) -> str:
    """A Markdown report of per-project verdicts (name, db_count, vector_count, missing, orphan): bounded by the projects."""
    lines = ["| project | chunks | vectors | missing | orphan | status |", "|---|---|---|---|---|---|"]
    for r in sorted(rows, key=lambda r: r["name"]):
        fine = not r["missing"] and not r["orphan"]
        lines.append(f"| {r['name']} | {r['db_count']} | {r['vector_count']} | {r['missing']} | {r['orphan']} | {'✅' if fine else '⚠️'} |")
    todo = [f"- {r['name']}: {r['missing']} missing, {r['orphan']} orphaned" for r in sorted(rows, key=lambda r: r["name"]) if r["missing"] or r["orphan"]]
    return "\n".join(lines + ([""] + todo if todo else []))
