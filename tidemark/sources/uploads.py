"""Uploads: single files with metadata, and local paths after checks."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from . import files
from .ingest import take_in
from .store import Store


def metadata(text: Column) -> Column:
    """A JSON object's members as map<string, string>; anything else (null, broken, another kind of value) is an empty map."""
    whole = F.regexp_replace(text, r"^\s+|\s+$", "")
    sound = F.coalesce(whole.startswith("{") & whole.endswith("}"), F.lit(False)) & F.from_json(whole, "map<string,string>", {"mode": "PERMISSIVE"}).isNotNull()
    return F.when(sound, F.from_json(whole, "map<string,string>", {"mode": "PERMISSIVE"})).otherwise(F.from_json(F.lit("{}"), "map<string,string>"))


def checked(path: str) -> str:
    """A local file's full path, or a FileNotFoundError or ValueError that says what is wrong with it."""
    if not path or not path.strip():
        raise ValueError("no path was given")
    full = os.path.realpath(os.path.expanduser(path))
    if not os.path.exists(full):
        raise FileNotFoundError(f"file does not exist: {path}")
    if not os.path.isfile(full):
        raise ValueError(f"not a file: {path}")
    return full


@dataclass
class Uploaded:
    document_id: str
    status: str
    chunks: int
    error: str | None = None
    metadata: dict[str, str] = field(default_factory=dict)


def upload(store: Store, folder: str, name: str, data: bytes, project_id: str, chunker, about: str | None = None, ports: dict | None = None) -> Uploaded:
    """Keep a file's bytes below ``folder``/project and take it in, with its metadata, in one commit.

    ``folder`` is in a store that all workers see.  The name's last element counts, so it can't lead out of the folder; a file of that name
    is replaced, and its document keeps its id.  ``about`` is a JSON object; what isn't one counts as none.
    """
    base = re.split(r"[\\/]", name)[-1]
    if base in ("", ".", "..") or base.startswith("."):
        raise ValueError(f"not a file name: {name!r}")
    spark = store.spark
    fs, target = store._fs(f"{folder}/{project_id}/{base}")
    # under a hidden name first: a reader never meets half a file
    _, hidden = store._fs(f"{folder}/{project_id}/.{base}.part")
    out = fs.create(hidden, True)
    out.write(bytearray(data))
    out.close()
    fs.delete(target, False)
    if not fs.rename(hidden, target):
        raise OSError(f"cannot write {target.toString()}")
    rows = files.read(spark, f"{folder}/{project_id}", type_of=paths.upload_type, pattern=re.sub(r"([*?\[\]{}\\])", r"\\\1", base), ports=ports)
    t = store.begin()
    take_in(t, rows, project_id, chunker)
    mine = t.read("documents").where((F.col("project_id") == project_id) & (F.element_at(F.split("filename", "/"), -1) == base))
    row = mine.select("document_id", "status", "error_message").first()
    if row is None:
        raise ValueError(f"{base} is excluded by the ignore rules")
    told = spark.createDataFrame([(row.document_id, about)], "document_id string, about string").select("document_id", metadata(F.col("about")).alias("metadata"))
    t.upsert("metadata", told, ["document_id"])
    known = t.read("metadata").where(F.col("document_id") == row.document_id).first().metadata
    chunks = t.read("chunks").where(F.col("document_id") == row.document_id).count()
    t.commit()
    return Uploaded(row.document_id, row.status, chunks, row.error_message, dict(known))


def upload_path(store: Store, folder: str, path: str, project_id: str, chunker, about: dict | str | None = None, ports: dict | None = None) -> Uploaded:
    """``upload`` of a file of the driver's machine, after its path was checked."""
    full = checked(path)
    with open(full, "rb") as f:
        data = f.read()
    return upload(store, folder, os.path.basename(full), data, project_id, chunker, json.dumps(about) if isinstance(about, dict) else about, ports)


def with_metadata(documents: DataFrame, told: DataFrame) -> DataFrame:
    """Documents with their ``metadata``, an empty map where nothing was told."""
    return documents.join(told.select("document_id", "metadata"), "document_id", "left").withColumn("metadata", F.coalesce("metadata", F.from_json(F.lit("{}"), "map<string,string>")))
