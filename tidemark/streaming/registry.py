"""The registry of watched projects and its periodic checks, as a batch plan and as a stateful stream.

Rows are ``(project_id, kind, at, chunks, points, indexed)``.  Kinds: ``add``, ``remove``, ``pause`` and ``resume`` are commands;
``measure`` says how many chunks a project has and how many vectors (points), indexed or not; of other kinds (``tick``) only the time counts.

While a project is watched and not paused, a health check is due every five minutes from its start (add or resume) and a consistency check, which
asks for a new scan, every hour.  The clock is that of the rows: of rows of one moment commands and measures come before checks, in the order of
kind, and a measure counts from when its project was added until it is removed.

Results are ``(project_id, kind, at, ok, message)``: each command with whether it changed anything, each check with its findings.  Rows without a project or a
time are left out.  Stopping the stream stops the checks; the registry is in its checkpoint, and commands sent meanwhile wait in its source.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import prepare
from .debounce import _ROCKS

RESULT = "project_id string, kind string, at timestamp, ok boolean, message string"
HEALTH, CONSISTENCY = 300.0, 3600.0
#: A project with more points than this of which none is indexed is an alarm, and so is a difference of over a twentieth between chunks and points.
LEAST_POINTS, TOLERANCE = 100, 0.05
#: So many rows, about, are put in order by one task.
_TASK_ROWS = 250_000
_VALUES = ["chunks", "points", "indexed"]
_REFUSED = {"add": "is already watched", "remove": "is not watched", "pause": "is not watched, or paused", "resume": "is not paused"}


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def findings(project: Column, chunks: Column, points: Column, indexed: Column) -> Column:
    """What a health check says: alarms, one after the other, or the empty string. Unknown numbers give no alarm."""
    unindexed = F.when((points > LEAST_POINTS) & (indexed == 0), F.format_string("%s: %d points, none indexed", project, points))
    apart = F.when(F.abs(chunks - points) > F.greatest(chunks, points) * TOLERANCE, F.format_string("%s: %d chunks, %d points", project, chunks, points))
    return F.concat_ws("; ", unindexed, apart)


def _found(project: str, chunks, points, indexed) -> str:
    alarms = []
    if points is not None and indexed is not None and points > LEAST_POINTS and indexed == 0:
        alarms.append(f"{project}: {points} points, none indexed")
    if chunks is not None and points is not None and abs(chunks - points) > max(chunks, points) * TOLERANCE:
        alarms.append(f"{project}: {chunks} chunks, {points} points")
    return "; ".join(alarms)


def _judged(rows: DataFrame) -> DataFrame:
    """The rows in order, with ``spell`` (how often the project was removed before), ``watched`` (before the row) and, of commands, ``ok``.

    Many rows are dealt to as many tasks as they need."""
    tasks = -(-rows.count() // _TASK_ROWS)
    if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        rows = rows.repartition(tasks, "project_id")
    order = ["at", "kind", *_VALUES]
    before = lambda *keys: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    kind = F.col("kind")
    out = rows.withColumn("spell", F.coalesce(F.sum((kind == "remove").cast("long")).over(before("project_id")), F.lit(0)))
    spell = before("project_id", "spell")
    out = out.withColumn("watched", F.coalesce(F.max(kind == "add").over(spell), F.lit(False)))
    turned = F.when(F.col("watched") & kind.isin("pause", "resume"), kind)
    out = out.withColumn("paused", F.coalesce(F.last(turned, True).over(spell) == "pause", F.lit(False)))
    ok = F.when(kind == "add", ~F.col("watched")).when(kind == "remove", F.col("watched")).when(kind == "pause", F.col("watched") & ~F.col("paused"))
    return out.withColumn("ok", ok.when(kind == "resume", F.col("watched") & F.col("paused")))


def history(rows: DataFrame, until: Column, health_seconds: float = HEALTH, consistency_seconds: float = CONSISTENCY) -> DataFrame:
    """All results up to ``until`` (included). A project's rows are ordered within one task, on its disk where they are many; no task holds them.

    From one row of a project to the next nothing changes, so each row tells which checks are due until the next one and what they find: the
    checks, far more than the rows, are made last and never sorted or sent.
    """
    known = rows.select("project_id", "kind", F.col("at").cast("timestamp").alias("at"), *[F.col(c).cast("long").alias(c) for c in _VALUES])
    known = known.where(F.col("project_id").isNotNull() & (F.col("at") <= until) & F.col("kind").isin(*_REFUSED, "measure"))
    kind, at = F.col("kind"), _micros(F.col("at"))
    judged = _judged(known).where((kind != "measure") | F.col("watched"))
    # an add belongs to the spell that it opens, as all rows do up to and with the remove that ends it
    spell = Window.partitionBy("project_id", "spell").orderBy("at", "kind", *_VALUES)
    so_far = spell.rowsBetween(Window.unboundedPreceding, 0)
    turned = F.last(F.when(F.col("ok"), F.struct(kind.isin("add", "resume").alias("active"), at.alias("since"))), True).over(so_far)
    measured = F.last(F.when(kind == "measure", F.struct(*_VALUES)), True).over(so_far)
    stood = judged.select("project_id", "kind", "at", "ok", turned.alias("turned"), measured.alias("m"), F.coalesce(F.lead(at).over(spell) - 1, _micros(until)).alias("to"))
    since = F.when(F.col("turned.active"), F.col("turned.since"))

    def due(name: str, seconds: float) -> Column:
        """The numbers of the checks from this row's moment to the one before the next row."""
        step = F.lit(int(seconds * 1_000_000))
        first = F.greatest(F.lit(1).cast("long"), F.ceil((at - since) / step).cast("long"))
        return F.struct(F.lit(name).alias("check"), step.cast("long").alias("step"), first.alias("first"), F.floor((F.col("to") - since) / step).cast("long").alias("last"))

    command = F.when(kind != "measure", F.struct(F.lit(None).cast("string").alias("check"), *[F.lit(0).cast("long").alias(c) for c in ("step", "first", "last")]))
    told = stood.select("*", since.alias("since"), F.inline(F.filter(F.array(command, due("consistency", consistency_seconds), due("health", health_seconds)), lambda x: x["first"] <= x["last"])))
    told = told.select("*", F.explode(F.sequence("first", "last")).alias("k"))
    check, m = F.col("check"), F.col("m")
    refused = F.concat(F.col("project_id"), F.lit(" "), F.coalesce(*[F.when(kind == k, F.lit(text)) for k, text in _REFUSED.items()]))
    alarms = findings(F.col("project_id"), *[m[c] for c in _VALUES])
    ok = F.when(check.isNull(), F.col("ok")).when(check == "consistency", True).when(m.isNotNull(), alarms == "")
    message = F.when(check.isNull(), F.when(~F.col("ok"), refused)).when(check == "consistency", F.concat(F.lit("scan "), "project_id")).when(m.isNull(), F.lit("not measured")).when(alarms != "", alarms)
    moment = F.when(check.isNull(), F.col("at")).otherwise(F.timestamp_micros(F.col("since") + F.col("k") * F.col("step")))
    return told.select("project_id", F.coalesce(check, kind).alias("kind"), moment.alias("at"), ok.alias("ok"), message.alias("message"))


class Registry(StatefulProcessor):
    """Keyed by project: its phase, since when, the next checks, the last measure; and the rows whose time the watermark hasn't passed yet."""

    def __init__(self, health: float, consistency: float):
        self.steps = {"consistency": int(consistency * 1_000_000), "health": int(health * 1_000_000)}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "phase string, since long, consistency long, health long, measured boolean, chunks long, points long, indexed long")
        self.waiting = handle.getListState("waiting", "at long, kind string, chunks long, points long, indexed long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            stamps = frame["at"].astype("datetime64[us]").astype("int64")
            values = [[None if pd.isna(x) else int(x) for x in frame[c]] for c in _VALUES]
            new = [r for r in zip(map(int, stamps), frame["kind"], *values) if r[1] in _REFUSED or r[1] == "measure"]
            if new:
                self.waiting.appendList(new)
        self._wake()
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = 1000 * max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[1], *[(x is not None, x or 0) for x in r[2:]])) if self.waiting.exists() else []
        ready, rest = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        state = list(self.entry.get()) if self.entry.exists() else [None, 0, 0, 0, False, None, None, None]
        out: list[tuple] = []
        for row in [*ready, None]:
            for result in self._due(key[0], state, now if row is None else row[0] - 1):
                out.append(result)
                if len(out) >= 10_000:
                    yield self._frame(out)
                    out = []
            if row is not None and (result := self._apply(key[0], state, row)):
                out.append(result)
        if out:
            yield self._frame(out)
        if state[0] is None:
            self.entry.clear()
        else:
            self.entry.update(tuple(state))
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        self._wake()

    def _due(self, project: str, state: list, to: int) -> Iterator[tuple]:
        """The checks that are due up to a moment, in order of time."""
        while state[0] == "active":
            at, kind = min((state[1] + n * self.steps[k], k) for k, n in (("consistency", state[2]), ("health", state[3])))
            if at > to:
                return
            state[2 if kind == "consistency" else 3] += 1
            if kind == "consistency":
                yield project, kind, at, True, f"scan {project}"
            elif not state[4]:
                yield project, kind, at, None, "not measured"
            else:
                alarms = _found(project, *state[5:])
                yield project, kind, at, not alarms, alarms or None

    def _apply(self, project: str, state: list, row: tuple) -> tuple | None:
        at, kind = row[:2]
        if kind == "measure":
            if state[0] is not None:
                state[4:] = [True, *row[2:]]
            return None
        ok = {"add": state[0] is None, "remove": state[0] is not None, "pause": state[0] == "active", "resume": state[0] == "paused"}[kind]
        if ok and kind == "remove":
            state[:] = [None, 0, 0, 0, False, None, None, None]
        elif ok:
            state[:4] = ["paused" if kind == "pause" else "active", at, 1, 1]
        return project, kind, at, ok, None if ok else f"{project} {_REFUSED[kind]}"

    def _wake(self) -> None:
        """One timer: for the next check or the earliest row that waits."""
        moments = [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
        if self.entry.exists():
            phase, since, consistency, health, *_ = self.entry.get()
            if phase == "active":
                moments.append(since + min(consistency * self.steps["consistency"], health * self.steps["health"]))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if moments:
            self.handle.registerTimer(-(-min(moments) // 1000))

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["project_id", "kind", "at", "ok", "message"])
        frame["at"] = [datetime.fromtimestamp(us // 1_000_000, timezone.utc).replace(tzinfo=None, microsecond=us % 1_000_000) for us in frame["at"]]
        return frame.astype({"ok": "object"})

    def close(self) -> None:
        pass


def checks(rows: DataFrame, health_seconds: float = HEALTH, consistency_seconds: float = CONSISTENCY, lateness: str = "10 seconds") -> DataFrame:
    """The results of a stream of rows, each as the watermark passes its time; rows may come in any order within the lateness.

    A project that isn't watched has no state.  The session must use the RocksDB state store, which timers need; it is set if no query has been started.
    """
    spark = prepare(rows.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    known = rows.select("project_id", "kind", "at", *_VALUES).where("project_id IS NOT NULL AND at IS NOT NULL AND kind IS NOT NULL").withWatermark("at", lateness)
    return known.groupBy("project_id").transformWithStateInPandas(Registry(health_seconds, consistency_seconds), outputStructType=RESULT, outputMode="Append", timeMode="EventTime")


def standing(rows: DataFrame) -> DataFrame:
    """The registry as it stands: project_id, state (active or paused), since, of each project that is watched."""
    judged = _judged(rows.where(F.col("project_id").isNotNull() & F.col("at").isNotNull() & F.col("kind").isin(*_REFUSED)))
    last = judged.where("ok").groupBy("project_id").agg(F.max_by(F.struct("kind", "at"), F.struct("at", "kind", *_VALUES)).alias("c"))
    phase = F.when(F.col("c.kind") == "pause", "paused").otherwise("active")
    return last.where("c.kind <> 'remove'").select("project_id", phase.alias("state"), F.col("c.at").alias("since"))
