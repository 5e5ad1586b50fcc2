"""Sizes of folders from a listing of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parents(path: Column) -> Column:
    """The folders above a path, the root ("") first; neither a leading nor a doubled slash makes one."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def sizes(files: DataFrame, depth: int | None = None) -> DataFrame:
    """folder, files, bytes, largest, newest of every folder with what is below it: ``files(path, size, modified_at)``.

    Files of one folder are added up before they meet those of others, so the shuffle carries folders and not files.  ``depth``: folders of
    so many elements at most.  Null paths don't count; null sizes are 0.
    """
    named = files.where(F.col("path").isNotNull()).withColumn("above", parents(F.col("path")))
    own = named.groupBy(F.element_at("above", -1).alias("own")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"), F.max("size").alias("largest"), F.max("modified_at").alias("newest"))
    up = F.concat(parents(F.col("own")), F.when(F.col("own") != "", F.array("own")).otherwise(F.array().cast("array<string>")))
    each = own.select(F.explode(F.array_distinct(up)).alias("folder"), "files", "bytes", "largest", "newest")
    if depth is not None:
        each = each.where(F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/"))) <= depth)
    return each.groupBy("folder").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.max("largest").alias("largest"), F.max("newest").alias("newest"))
