"""Ignore files of projects: rules of nested ``.gitignore`` files as a tree of folders.

The last rule that fits decides, and rules of deeper files come after those above.  A rule that fits a folder fits all that is
in it; a later rule with ``!`` takes single files back in.  Patterns follow git's documented form.
"""

from __future__ import annotations

import pickle
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import paths

NAME = ".gitignore"
#: A tree up to this size goes with the tasks; a larger one is met in a join by folder.
MOST_BYTES = 8 << 20


@lru_cache(4096)
def compiled(pattern: str) -> re.Pattern:
    """A pattern (without ``!``) for paths relative to its file's folder: what it fits, and all below."""
    only_folders = pattern.endswith("/")
    body = pattern.rstrip("/")
    anchored = "/" in body
    body = body.removeprefix("/")
    out, i = "" if anchored else "(?:.*/)?", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out += "(?:.*/)?"
            i += 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out += "/.+"
            i += 3
        elif c == "*":
            while i < len(body) and body[i] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
            i += 1
        elif c == "[" and (end := body.find("]", i + (3 if body[i + 1 : i + 2] in ("!", "^") else 2))) > 0:
            inside = body[i + 1 : end]
            negated = inside[:1] in ("!", "^")
            inside = inside[1:] if negated else inside
            out += "(?!/)[" + ("^" if negated else "") + inside.replace("\\", "\\\\").replace("[", "\\[") + "]"
            i = end + 1
        elif c == "\\" and i + 1 < len(body):
            out += re.escape(body[i + 1])
            i += 2
        else:
            out += re.escape(c)
            i += 1
    return re.compile(out + ("/.*" if only_folders else "(?:/.*)?"), re.DOTALL)


def parse(text: str) -> list[tuple[bool, str]]:
    """(ignores, pattern) of each rule of a file, in order."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line.removeprefix("﻿"))
        if not line.strip() or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line
        if line.strip("/"):
            out.append((not negated, line))
    return out


class Tree:
    """Folders with rules; children by name."""

    def __init__(self, files: dict[str, str] | None = None):
        self.rules: list[tuple[bool, str]] = []
        self.children: dict[str, Tree] = {}
        for folder, text in (files or {}).items():
            node = self
            for part in filter(None, folder.split("/")):
                node = node.children.setdefault(part, Tree())
            node.rules = parse(text)

    def ignores(self, path: str) -> bool:
        """Whether a path relative to the tree's root is ignored."""
        parts, node, levels = path.strip("/").split("/"), self, []
        for k in range(len(parts)):
            levels.append(("/".join(parts[k:]), node.rules))
            node = node.children.get(parts[k])
            if node is None:
                break
        return decided(reversed(levels))


def decided(levels) -> bool:
    """(path relative to the folder, its rules), deepest folder first: what the last fitting rule says."""
    for path, rules in levels:
        for ignores, pattern in reversed(rules):
            if compiled(pattern).fullmatch(path):
                return ignores
    return False


class IgnoreFiles:
    """The ignore files of a project's folder; ``reload`` reads again what has another time, is new or is gone."""

    def __init__(self, root: str):
        self.root, self.files, self.times = root, {}, {}
        self.reload()

    def reload(self) -> bool:
        from pyarrow.fs import FileSelector, FileSystem

        fs, root = FileSystem.from_uri(self.root)
        found = {f.path.removeprefix(root).strip("/").removesuffix(NAME).strip("/"): f for f in fs.get_file_info(FileSelector(root, allow_not_found=True, recursive=True)) if f.base_name == NAME and f.is_file}
        times = {folder: f.mtime_ns for folder, f in found.items()}
        if times == self.times:
            return False
        for folder, f in found.items():
            if times[folder] != self.times.get(folder):
                with fs.open_input_stream(f.path) as data:
                    self.files[folder] = data.read().decode("utf-8", "replace")
        self.files = {folder: text for folder, text in self.files.items() if folder in found}
        self.times = times
        return True


def with_ignored(rows: DataFrame, path: str, files: dict[str, str], column: str = "ignored") -> DataFrame:
    """``rows`` with a column that says whether the global patterns or the ignore files (folder -> text) exclude ``path``, a path relative to
    the project's root. Null paths aren't ignored."""
    everywhere = paths.ignored(F.col(path))
    tree = Tree(files)
    if not files:
        return rows.withColumn(column, everywhere)
    if len(pickle.dumps(tree)) <= MOST_BYTES:

        @F.pandas_udf("boolean")
        def run(values: pd.Series) -> pd.Series:
            return values.map(lambda p: p is not None and tree.ignores(p.replace("\\", "/")))

        return rows.withColumn(column, everywhere | run(F.col(path)))
    # each path meets the rules of the folders above it
    rules = rows.sparkSession.createDataFrame([(folder, text) for folder, text in files.items()], "_folder string, _text string")
    distinct = rows.select(F.col(path).alias("_path")).where("_path IS NOT NULL").distinct()
    parts = F.split(F.translate("_path", "\\", "/"), "/")
    above = distinct.withColumn("_depth", F.explode(F.sequence(F.lit(0), F.size(parts) - 1))).withColumn("_folder", F.array_join(F.slice(parts, 1, F.col("_depth")), "/")).withColumn("_rest", F.array_join(F.slice(parts, F.col("_depth") + 1, F.size(parts)), "/"))
    levels = above.join(rules, "_folder").groupBy("_path").agg(F.sort_array(F.collect_list(F.struct("_depth", "_rest", "_text")), False).alias("_levels"))  # the folders above one path

    @F.pandas_udf("boolean")
    def judge(lists: pd.Series) -> pd.Series:
        return lists.map(lambda found: decided((x["_rest"], parse(x["_text"])) for x in found))

    judged = levels.select(F.col("_path").alias(path), judge("_levels").alias("_own"))
    return rows.join(judged, path, "left").withColumn(column, everywhere | F.coalesce("_own", F.lit(False))).drop("_own")


def ignored(path: Column, files: dict[str, str]) -> Column:
    """``with_ignored`` as an expression, for trees that go with the tasks."""
    tree = Tree(files)
    if len(pickle.dumps(tree)) > MOST_BYTES:
        raise ValueError("too many rules for an expression: use with_ignored")

    @F.pandas_udf("boolean")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda p: p is not None and tree.ignores(p.replace("\\", "/")))

    return paths.ignored(path) | run(path)
