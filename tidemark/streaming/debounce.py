"""The trailing debounce of a watched root: one timer for all its paths, set again by every event.

When a root has been quiet for the gap, all its pending paths are handed over as one batch, each with what its events amount
to (see ``watch.fold``).  ``bursts`` is the batch form, ``start_global`` the stateful stream; both give what a plain simulation of the timer gives.
Here no batch is lost while another runs; ``busy`` marks those that a handler which takes so long would have dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import prepare
from .watch import fold

BATCH = "root string, flushed_at timestamp, src_path string, event_type string, last_ts timestamp, n long, dropped boolean"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def bursts(events: DataFrame, gap_seconds: float = 1.0, bucket_seconds: int = 3600) -> DataFrame:
    """root, burst (1, 2, ... in order of time), flushed_at, src_path, event_type, last_ts, n from ``events(root, src_path, event_type, ts)``.

    A root's events are cut at the hours first and the cuts mended on one row an hour, so a root with most of the events is
    no single task's work.
    """
    if bucket_seconds < gap_seconds:
        raise ValueError("a bucket holds one gap at least")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    at, gap = micros("ts"), int(gap_seconds * 1_000_000)
    rows = events.select("root", "src_path", "event_type", "ts").withColumn("bucket", F.floor(at / (bucket_seconds * 1_000_000)))
    here = Window.partitionBy("root", "bucket").orderBy("ts")
    fresh = F.coalesce((at - F.lag(at).over(here) >= gap).cast("long"), F.lit(1))
    rows = rows.withColumn("fresh", fresh).withColumn("local", F.sum("fresh").over(here.rangeBetween(Window.unboundedPreceding, 0)))
    edges = rows.groupBy("root", "bucket").agg(F.min("ts").alias("low"), F.max("ts").alias("high"), F.max("local").alias("bursts"))
    order = Window.partitionBy("root").orderBy("bucket")
    goes_on = F.coalesce((micros("low") - F.lag(micros("high")).over(order) < gap).cast("long"), F.lit(0))
    edges = edges.withColumn("goes_on", goes_on).withColumn("before", F.coalesce(F.sum(F.col("bursts") - F.col("goes_on")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    told = rows.join(edges.select("root", "bucket", "before", "goes_on"), ["root", "bucket"]).withColumn("burst", F.col("before") + F.col("local") - F.col("goes_on"))
    ends = told.groupBy("root", "burst").agg((F.max("ts") + F.make_dt_interval(secs=F.lit(gap_seconds))).alias("flushed_at"))
    one = told.groupBy("root", "burst", "src_path").agg(F.array_sort(F.collect_list(F.struct("ts", "event_type"))).alias("e"), F.count(F.lit(1)).alias("n"))
    out = one.select("root", "burst", "src_path", fold(F.transform("e", lambda x: x["event_type"])).alias("event_type"), F.element_at("e", -1)["ts"].alias("last_ts"), "n")
    return out.join(ends, ["root", "burst"]).select("root", "burst", "flushed_at", "src_path", "event_type", "last_ts", "n")


def folded(state: str | None, event: str) -> str:
    """``watch.fold``, one event at a time."""
    if state == "created" and event == "modified":
        return state
    return "modified" if state == "deleted" and event == "created" else event


class Debouncer(StatefulProcessor):
    """Keyed by root: pending paths, the last event's time, and until when the handler of the last batch is busy."""

    def __init__(self, gap: float, busy: float):
        self.gap, self.busy = timedelta(seconds=gap), timedelta(seconds=busy)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "src_path string", "event_type string, last_ts long, n long")
        self.clock = handle.getValueState("clock", "last_ts long, busy_until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, busy = self.clock.get() if self.clock.exists() else (None, 0)
        gap = self.gap // timedelta(microseconds=1)
        every = pd.concat(list(rows))
        stamps = every["ts"].astype("datetime64[us]").astype("int64")
        for ts, path, kind in sorted(zip(stamps, every["src_path"], every["event_type"])):
            if last is not None and ts - last >= gap:
                batch, busy = self._flushed(key[0], last + gap, busy)
                yield from batch
            last = ts if last is None else max(ts, last)
            old, _, n = self.pending.getValue((path,)) if self.pending.containsKey((path,)) else (None, 0, 0)
            self.pending.updateValue((path,), (folded(old, kind), int(ts), n + 1))
        self.clock.update((int(last), int(busy)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(-(-(int(last) + gap) // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, busy = self.clock.get()
        batch, busy = self._flushed(key[0], last + self.gap // timedelta(microseconds=1), busy)
        yield from batch
        self.clock.update((last, int(busy)))

    def _flushed(self, root: str, at: int, busy: int) -> tuple[list[pd.DataFrame], int]:
        rows = sorted((path[0], *value) for path, value in self.pending.iterator())
        if not rows:
            return [], busy
        self.pending.clear()
        dropped = at < busy
        moment = lambda us: datetime.fromtimestamp(us / 1e6, timezone.utc).replace(tzinfo=None)
        frame = pd.DataFrame([(root, moment(at), path, kind, moment(ts), n, dropped) for path, kind, ts, n in rows], columns=[f.split()[0] for f in BATCH.split(", ")])
        return [frame], busy if dropped else at + self.busy // timedelta(microseconds=1)

    def close(self) -> None:
        pass


def global_stream(events: DataFrame, gap_seconds: float = 1.0, lateness: str = "10 seconds", busy_seconds: float = 0.0) -> DataFrame:
    """The batches of a stream ``events(root, src_path, event_type, ts)``, one row a path, as the watermark passes the end of each burst.

    State is a root's pending paths. The session must use the RocksDB state store, which timers need; it is set if no query has been started.
    """
    spark = prepare(events.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    keyed = events.select("root", "src_path", "event_type", "ts").withWatermark("ts", lateness).groupBy("root")
    return keyed.transformWithStateInPandas(Debouncer(gap_seconds, busy_seconds), outputStructType=BATCH, outputMode="Append", timeMode="EventTime")
