"""The watch registry: batch and stream against a plain simulation with a manual clock."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.streaming import registry

ROWS = "project_id string, kind string, at timestamp, chunks long, points long, indexed long"
START = datetime(2026, 1, 1)


def simulated(rows, until, health, consistency):
    """Second by second for each project: commands and measures of the moment, then the checks that are due."""
    out = []
    for project in sorted({r[0] for r in rows}):
        mine = sorted((r for r in rows if r[0] == project), key=lambda r: (r[2], r[1], *[(x is not None, x or 0) for x in r[3:]]))
        state, since, measure, now = "none", None, None, START
        while now <= until:
            while mine and mine[0][2] <= now:
                _, kind, at, *values = mine.pop(0)
                if kind == "measure":
                    measure = values if state != "none" else None
                    continue
                if kind not in ("add", "remove", "pause", "resume"):
                    continue
                after = {("none", "add"): "active", ("active", "pause"): "paused", ("paused", "resume"): "active", ("active", "remove"): "none", ("paused", "remove"): "none"}.get((state, kind))
                out.append((project, kind, at, after is not None, None if after else f"{project} {registry._REFUSED[kind]}"))
                if after:
                    state, since = after, at
                    measure = None if after == "none" else measure
            gone = (now - since).total_seconds() if since else 0
            if state == "active" and gone > 0 and gone % consistency == 0:
                out.append((project, "consistency", now, True, f"scan {project}"))
            if state == "active" and gone > 0 and gone % health == 0:
                if measure is None:
                    out.append((project, "health", now, None, "not measured"))
                else:
                    chunks, points, indexed = measure
                    text = []
                    if points is not None and points > 100 and indexed == 0:
                        text.append(f"{project}: {points} points, none indexed")
                    if None not in (chunks, points) and abs(chunks - points) > 0.05 * max(chunks, points):
                        text.append(f"{project}: {chunks} chunks, {points} points")
                    out.append((project, "health", now, not text, "; ".join(text) or None))
            now += timedelta(seconds=1)
    return sorted(out, key=str)


def some_rows(n, seed):
    rng = random.Random(seed)
    rows, at = [], 0
    for _ in range(n):
        at += rng.choice([0, 1, 3, 5, 10, 17])
        kind = rng.choice(["add", "add", "remove", "pause", "resume", "resume", "measure", "measure", "measure", "tick"])
        numbers = (rng.choice([None, 0, 95, 100, 106]), rng.choice([None, 0, 100, 101, 111]), rng.choice([None, 0, 7])) if kind == "measure" else (None,) * 3
        rows.append((rng.choice("abc"), kind, START + timedelta(seconds=at), *numbers))
    return rows, START + timedelta(seconds=at)


def test_history_in_batch(spark):
    for seed in range(3):
        rows, end = some_rows(150, seed)
        got = registry.history(spark.createDataFrame([*rows, (None, "add", START, None, None, None), ("a", "add", None, None, None, None)], ROWS), F.lit(end), 5, 20)
        want = simulated(rows, end, 5, 20)
        assert sorted(map(tuple, got.collect()), key=str) == want
        assert {(r[1], r[3]) for r in want} >= {("health", True), ("health", False), ("health", None), ("pause", True), ("pause", False), ("add", False), ("remove", False)}
    empty = spark.createDataFrame([], ROWS)
    assert registry.history(empty, F.lit(end)).count() == 0 == registry.standing(empty).count()


def test_standing(spark):
    rows, _ = some_rows(150, 9)
    last = {}
    for project, kind, at, ok, _ in sorted(simulated(rows, rows[-1][2], 10**6, 10**6), key=lambda r: (r[2], r[1])):
        if ok and kind in registry._REFUSED:
            last[project] = (kind, at)
    want = {p: ("paused" if k == "pause" else "active", at) for p, (k, at) in last.items() if k != "remove"}
    assert {r.project_id: (r.state, r.since) for r in registry.standing(spark.createDataFrame(rows, ROWS)).collect()} == want


def test_checks_as_a_stream(spark, tmp_path):
    rows, end = some_rows(60, 4)
    rng = random.Random(1)
    shuffled = sorted(rows, key=lambda r: r[2] + timedelta(seconds=rng.uniform(0, 20)))  # out of order, within the lateness
    far = end + timedelta(seconds=60)
    batches = [shuffled[:20], shuffled[20:40], shuffled[40:], [("clock", "tick", far, None, None, None)], [("clock", "tick", far, None, None, None)]]
    folder, got = tmp_path / "in", []
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for batch in batches:
            spark.createDataFrame(batch, ROWS).coalesce(1).write.mode("append").parquet(str(folder))
            stream = registry.checks(spark.readStream.schema(ROWS).parquet(str(folder)), 5, 20, "30 seconds")
            writer = stream.writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).foreachBatch(lambda df, _: got.extend(map(tuple, df.collect())))
            writer.trigger(availableNow=True).start().awaitTermination()  # each round is a restart
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(got, key=str) == simulated(rows, far - timedelta(seconds=30), 5, 20)


def test_tasks_grow_with_the_rows_and_checks_are_not_sorted(spark, monkeypatch):
    rows, until = some_rows(200, 5)
    frame = spark.createDataFrame(rows, ROWS)
    alike = sorted([tuple(r) for r in registry.history(frame, F.lit(until), 20, 60).collect()], key=str)
    monkeypatch.setattr(registry, "_TASK_ROWS", 4)
    out = registry.history(frame, F.lit(until), 20, 60)
    assert sorted([tuple(r) for r in out.collect()], key=str) == alike == simulated(rows, until, 20, 60)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and plan.index("Window") > plan.rindex("Generate")  # the outermost step is named first
    assert plan.count("RepartitionByExpression") == 1 and "Union" not in plan
    assert {r.project_id for r in registry.standing(frame).collect()} <= set("abc")
