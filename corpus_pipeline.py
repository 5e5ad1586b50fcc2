"""A corpus pipeline of training-data operators: documents in, packed training windows out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's ``docs``.
All but the last return the columns of ``documents``.

Every stage takes any rows: repeated doc_ids, null in any column, empty and very long texts, an empty table (which gives an empty one) and
extra columns, whose names and values it keeps.  What each does with them is in its docstring; ``tests/llm/test_pipeline.py`` holds each
against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, fresh
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.ngram_join import near_duplicates_out
from tidemark.llm.packing import pack
from tidemark.llm.quality import graded, score, train
from tidemark.llm.queries import LEAST_TOP
from tidemark.session import prepare


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: those whose chance of the top grade is under LEAST_TOP.

    Each row is judged by its whole text alone, so equal texts share their fate; null is judged as an empty text.  A row without a
    doc_id is judged, but no rating is looked up for it.  Without ratings (or documents) nothing is rejected.
    """
    prepare(spark)
    model = train(spark, docs, graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score(spark, docs, model, LEAST_TOP, keep_only=True)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of similar lines stays; documents that lost lines and keep none but blank ones go.

    The first line by doc_id, then text, then place stays; null doc_ids come last.  ``n_chars`` is counted anew where a text lost
    lines.  Null and empty texts stay as they are; rows of one doc_id and text are treated alike, other rows of one doc_id each by itself.
    """
    prepare(spark)
    names = docs.columns
    # the operator's own counts must not take the place of columns that came with the documents
    aside = {c: fresh(docs, c) for c in ("n_lines", "n_removed") if c in names}
    back = {v: k for k, v in aside.items()}
    docs = docs.withColumnsRenamed(aside)
    out = line_dedup(spark, docs, drop_emptied=True)
    columns = [F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns).withColumnsRenamed(back)


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest doc_id: sets of 5-word shingles, Jaccard 0.8 or more.

    Links count through others.  Texts without words (null, empty, blank) and rows without a doc_id are in no group and stay.  Of rows of
    one doc_id each counts by its own text.
    """
    prepare(spark)
    return near_duplicates_out(spark, docs, 5, (8, 10))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 10 consecutive words of a benchmark item go (all words of a shorter item).

    Null, empty and wordless texts hold none and stay; items without words hit nothing.  Rows are judged each by itself.
    """
    prepare(spark)
    return decontaminate(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10, "document")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 tokens, filled with related documents: a row for each piece of a document, not the columns of ``documents``.

    Null and empty texts are the end id alone; longer ones than a window go on in the next.  Each row is a document of its own,
    repeated ones too; other columns are not read.
    """
    prepare(spark)
    import public_tokenizers

    return pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"), 1)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", near_duplicate_removal),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: A classifier, a tokenizer and a greedy packer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(docs, f"stage-{k}")
    return docs
