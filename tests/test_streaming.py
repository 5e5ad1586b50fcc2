"""The live file source, and the debounce of a whole root, batch and streaming, against plain simulations."""

import os
import random
import shutil
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.streaming import debounce, source

EVENTS = "root string, src_path string, event_type string, ts timestamp"
START = datetime(2026, 1, 1, 10, 59, 50)


def simulated(rows, gap, busy=0.0):
    """The timer, event by event: (root, burst, flushed_at, path, type, last_ts, n, dropped)."""
    out = []
    for root in sorted({r[0] for r in rows}):
        pending, deadline, free, burst = {}, None, None, 0

        def flush():
            nonlocal pending, free, burst
            burst += 1
            dropped = free is not None and deadline < free
            out.extend((root, burst, deadline, path, kind, ts, n, dropped) for path, (kind, ts, n) in pending.items())
            if not dropped:
                free = deadline + timedelta(seconds=busy)
            pending = {}

        for _, path, kind, ts in sorted((r for r in rows if r[0] == root), key=lambda r: (r[3], r[1], r[2])):
            if deadline is not None and ts >= deadline:
                flush()
            old = pending.get(path, (None, None, 0))
            pending[path] = (debounce.folded(old[0], kind), ts, old[2] + 1)
            deadline = ts + timedelta(seconds=gap)
        flush()
    return sorted(out)


def some_events(n, seed):
    rng = random.Random(seed)
    rows, at = [], START
    for _ in range(n):
        at += timedelta(milliseconds=rng.choice([10, 200, 700, 999, 1000, 1001, 3000, 2_000_000]))
        rows.append((rng.choice("ab"), f"f{rng.randrange(4)}", rng.choice(["created", "modified", "deleted", "moved"]), at))
    return rows


def test_bursts_of_a_root(spark):
    rows = some_events(300, 1)
    for bucket in (2, 3600):
        got = debounce.bursts(spark.createDataFrame(rows, EVENTS), 1.0, bucket).select("root", "burst", "flushed_at", "src_path", "event_type", "last_ts", "n").collect()
        assert sorted(map(tuple, got)) == [r[:-1] for r in simulated(rows, 1.0)]
    assert debounce.bursts(spark.createDataFrame([], EVENTS)).count() == 0


def test_global_debounce_as_a_stream(spark, tmp_path):
    rows = some_events(40, 2)
    end = rows[-1][3] + timedelta(hours=2)
    batches = [rows[:15], rows[15:30], rows[30:], [("z", "end", "created", end)]]
    folder, got = tmp_path / "in", []
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for k, batch in enumerate(batches):
            spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(str(folder))
            stream = debounce.global_stream(spark.readStream.schema(EVENTS).parquet(str(folder)), 1.0, "0 seconds", busy_seconds=2.5)
            writer = stream.writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).foreachBatch(lambda df, _: got.extend(map(tuple, df.collect())))
            writer.trigger(availableNow=True).start().awaitTermination()  # each round is a restart
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = [(r[0], *r[2:]) for r in simulated(rows, 1.0, busy=2.5)]
    assert sorted(got) == sorted(want) and any(r[-1] for r in want)


def test_changes_of_listings():
    before = {"a": [1, 10], "b": [2, 20], "x/c": [3, 30], "y/c": [3, 30], "d": [4, 40], "e": [5, 50], "f": [5, 50]}
    now = {"a": [1, 11], "new": [2, 20], "p/c": [3, 30], "d": [4, 40], "q/e": [5, 50], "q/f": [5, 50], "g": [9, 60]}
    got = [e[:3] for e in source.changes(before, now)]
    assert sorted(got, key=str) == sorted([("modified", "a", None), ("moved", "b", "new"), ("deleted", "x/c", None), ("deleted", "y/c", None), ("created", "p/c", None), ("moved", "e", "q/e"), ("moved", "f", "q/f"), ("created", "g", None)], key=str)
    assert source.changes(now, now) == []


def test_live_file_source(spark, tmp_path):
    source.register(spark)
    watched, got = tmp_path / "watched", []
    (watched / "sub").mkdir(parents=True)

    def run():
        stream = spark.readStream.format("tidemark_files").option("path", f"file://{watched}").option("state", f"file://{tmp_path}/state").load()
        writer = stream.writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).foreachBatch(lambda df, _: got.extend(map(tuple, df.select("event_type", F.regexp_extract("src_path", "watched/(.*)", 1), F.regexp_extract("dest_path", "watched/(.*)", 1)).collect())))
        writer.trigger(availableNow=True).start().awaitTermination()
        out = sorted(got, key=str)
        got.clear()
        return out

    (watched / "a.txt").write_text("a")
    (watched / "sub" / "b.txt").write_text("bb")
    assert run() == [("created", "a.txt", None), ("created", "sub/b.txt", None)]
    assert run() == []  # a restart reports nothing twice
    (watched / "a.txt").write_text("changed")
    (watched / "c.txt").write_text("ccc")
    shutil.move(watched / "sub" / "b.txt", watched / "b2.txt")
    assert run() == [("created", "c.txt", None), ("modified", "a.txt", None), ("moved", "sub/b.txt", "b2.txt")]
    os.remove(watched / "a.txt")
    assert run() == [("deleted", "a.txt", None)]
