"""A streaming source of file events: ``spark.readStream.format("tidemark_files")`` after ``register``.

Each batch is the difference of two listings of a folder.  An offset names a listing that is kept as a small file in the folder
``state``, so a restarted query finds the listing it had seen and reports what changed in between, deletions and moves too,
and a batch that is run again gives the same events.  Folders are listed through pyarrow's file systems (local paths, hdfs, s3, ...)
by the driver, as a file stream does; events are read in partitions by the executors, which reach ``state`` too.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..session import prepare

SCHEMA = "src_path string, dest_path string, event_type string, is_directory boolean, size long, ts timestamp"
#: Listings that are kept; a query that starts again needs the last two.
KEPT = 10
#: Events of one partition.
PART = 10_000


def register(spark: SparkSession) -> None:
    prepare(spark)
    spark.dataSource.register(FileEvents)


def changes(before: dict[str, list], now: dict[str, list]) -> list[tuple]:
    """(event_type, src_path, dest_path, size, time) of two listings path -> [size, time in microseconds], in order of time and path.

    A file that went and one that came with the same size and time are one that moved, if no other file has the two; of several the
    ones of the same name go together, the rest count as deleted and created.
    """
    gone = sorted(p for p in before if p not in now)
    came = sorted(p for p in now if p not in before)
    by_shape: dict[tuple, tuple[list, list]] = defaultdict(lambda: ([], []))
    for k, paths in enumerate((gone, came)):
        table = (before, now)[k]
        for p in paths:
            by_shape[tuple(table[p])][k].append(p)
    moved: dict[str, str] = {}
    for olds, news in by_shape.values():
        if len(olds) == len(news) == 1:
            moved[olds[0]] = news[0]
        elif olds and news:
            named: dict[str, tuple[list, list]] = defaultdict(lambda: ([], []))
            for k, paths in enumerate((olds, news)):
                for p in paths:
                    named[p.rsplit("/", 1)[-1]][k].append(p)
            moved |= {a[0]: b[0] for a, b in named.values() if len(a) == len(b) == 1}
    targets = set(moved.values())
    out = [("moved", p, q, *now[q]) for p, q in moved.items()]
    out += [("deleted", p, None, *before[p]) for p in gone if p not in moved]
    out += [("created", p, None, *now[p]) for p in came if p not in targets]
    out += [("modified", p, None, *now[p]) for p in now if p in before and now[p] != before[p]]
    return sorted(out, key=lambda e: (e[4], e[1]))


class FileEvents(DataSource):
    """Options: ``path``, the folder to watch; ``state``, a folder that the driver and the executors share for listings; ``initial``:
    "true" reports the files that are there at the start as created, else only later changes count."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ListingReader(self.options["path"], self.options["state"], self.options.get("initial", "true").lower() == "true")


class Part(InputPartition):
    def __init__(self, start: str, end: str, at: int, to: int, stamp: int):
        self.start, self.end, self.at, self.to, self.stamp = start, end, at, to, stamp


class Listings:
    """Listings as files named by their content."""

    def __init__(self, folder: str):
        from pyarrow.fs import FileSystem

        self.fs, self.root = FileSystem.from_uri(folder)

    def put(self, listing: dict, number: int) -> str:
        data = zlib.compress(json.dumps(sorted(listing.items())).encode())
        name = f"{number:012d}-{hashlib.sha256(data).hexdigest()[:24]}"
        self.fs.create_dir(self.root, recursive=True)
        with self.fs.open_output_stream(f"{self.root}/.{name}") as out:
            out.write(data)
        self.fs.move(f"{self.root}/.{name}", f"{self.root}/{name}")
        return name

    def get(self, name: str) -> dict:
        if not name:
            return {}
        with self.fs.open_input_stream(f"{self.root}/{name}", compression=None) as data:
            return dict(json.loads(zlib.decompress(data.read())))

    def forget(self, upto: str) -> None:
        from pyarrow.fs import FileSelector

        names = sorted(f.base_name for f in self.fs.get_file_info(FileSelector(self.root)) if not f.base_name.startswith("."))
        for name in [n for n in names if n <= upto][:-KEPT]:
            self.fs.delete_file(f"{self.root}/{name}")


class ListingReader(DataSourceStreamReader):
    def __init__(self, path: str, state: str, initial: bool):
        self.path, self.state, self.initial = path, state, initial
        self.last: tuple[str, dict] | None = None

    def _list(self) -> dict[str, list]:
        from pyarrow.fs import FileSelector, FileSystem, FileType

        fs, root = FileSystem.from_uri(self.path)
        found = fs.get_file_info(FileSelector(root, allow_not_found=True, recursive=True))
        return {f.path: [f.size, f.mtime_ns // 1000 if f.mtime_ns else 0] for f in found if f.type == FileType.File}

    def initialOffset(self) -> dict:
        return {"listing": "" if self.initial else Listings(self.state).put(self._list(), 0)}

    def latestOffset(self) -> dict:
        kept, now = Listings(self.state), self._list()
        if self.last is None:
            self.last = self._newest(kept)
        if self.last is None or self.last[1] != now:
            number = int(self.last[0].split("-")[0]) + 1 if self.last and self.last[0] else 1
            self.last = (kept.put(now, number), now)
        return {"listing": self.last[0]}

    @staticmethod
    def _newest(kept: Listings) -> tuple[str, dict] | None:
        """What a query before this one saw last: an unchanged folder keeps its offset over a restart."""
        from pyarrow.fs import FileSelector

        names = sorted(f.base_name for f in kept.fs.get_file_info(FileSelector(kept.root, allow_not_found=True)) if not f.base_name.startswith("."))
        return (names[-1], kept.get(names[-1])) if names else None

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        kept = Listings(self.state)
        n = len(changes(kept.get(start["listing"]), kept.get(end["listing"])))
        stamp = int(end["listing"].split("-")[0] or 0)
        return [Part(start["listing"], end["listing"], at, min(at + PART, n), stamp) for at in range(0, n, PART)] or [Part("", "", 0, 0, 0)]

    def read(self, partition: Part) -> Iterator[tuple]:
        kept = Listings(self.state)
        events = changes(kept.get(partition.start), kept.get(partition.end))[partition.at : partition.to]
        for kind, src, dest, size, at in events:
            yield (src, dest, kind, False, size, datetime.fromtimestamp(at / 1e6, timezone.utc))

    def commit(self, end: dict) -> None:
        if end["listing"]:
            Listings(self.state).forget(end["listing"])
