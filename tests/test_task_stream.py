"""Keyed task state: a replay against a fold in plain Python, restarts, late rows and stale tasks."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from kelpline.streaming.tasks import EVENTS, decisions, drain

SCHEMA = "dedupe_key string, task_id long, event string, at timestamp, extra int"
T0 = dt.datetime(2024, 5, 1)


def at(minutes: float) -> dt.datetime:
    return T0 + dt.timedelta(minutes=minutes)


def fold(events: list[tuple]) -> list[tuple]:
    """(key, task, action, minutes, active) in order; no stale tasks."""
    out, active = [], {}
    for key, task, event, when in sorted(events, key=lambda e: (e[3], EVENTS.index(e[2]), e[1])):
        now = active.get(key)
        if event == "submit":
            active.setdefault(key, [task, "queued"])
            out.append((key, task, "reused" if now else "queued", when, active[key][0]))
        elif now and now[0] == task and event == "start" and now[1] == "queued":
            now[1] = "running"
            out.append((key, task, "running", when, task))
        elif now and now[0] == task and event == "finish":
            del active[key]
            out.append((key, task, "done", when, task))
    return sorted(out, key=repr)


def source(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(path)


def put(spark, path, events):
    spark.createDataFrame([(k, t, e, at(m), 0) for k, t, e, m in events], SCHEMA).coalesce(1).write.mode("append").json(path)


def got(df):
    rows = df.select("dedupe_key", "task_id", "action", (F.col("at_ms") / 60000).alias("m"), "active_id").collect()
    base = T0.replace(tzinfo=dt.UTC).timestamp() / 60
    return sorted(((r[0], r[1], r[2], round(r[3] - base, 3), r[4]) for r in rows), key=repr)


def test_replay_restart_and_late_rows(spark, tmp_path):
    r = random.Random(1)
    events = []
    for task in range(60):
        begin = task * 2 + r.randint(0, 1)
        key = f"p{task % 4}:full"
        events += [(key, task, "submit", begin)]
        if r.random() < 0.9:
            events += [(key, task, "start", begin + 1), (key, task, "finish", begin + r.randint(2, 9))]
    events.sort(key=lambda e: e[3])
    where, out = str(tmp_path / "in"), f"file://{tmp_path}/run"
    parts = [[e for e in events if lo <= e[3] < lo + 30] for lo in range(0, 150, 30)]
    for part in parts[:2]:
        put(spark, where, part)
        drain(spark, decisions(source(spark, where), stale=10**6), out)  # each run starts anew from the checkpoint
    put(spark, where, [("p0:full", 999, "submit", 1), ("p9:full", 998, "submit", 2)])  # half an hour late: no rows
    for part in parts[2:]:
        put(spark, where, part)
    put(spark, where, [(None, 1, "submit", 149), ("p1:full", None, "submit", 149), ("p1:full", 7, "other", 149)])
    df = drain(spark, decisions(source(spark, where), stale=10**6), out)
    assert got(df) == fold(events)


def test_stale_tasks_are_queued_again(spark, tmp_path):
    where, out = str(tmp_path / "in"), f"file://{tmp_path}/run"
    put(spark, where, [("a", 1, "submit", 0), ("a", 1, "start", 1), ("b", 2, "submit", 0), ("b", 2, "start", 1), ("b", 2, "finish", 5)])
    drain(spark, decisions(source(spark, where)), out)
    put(spark, where, [("c", 3, "submit", 60)])
    drain(spark, decisions(source(spark, where)), out)
    put(spark, where, [("a", 4, "submit", 61), ("a", 1, "start", 62), ("a", 1, "finish", 63), ("a", 5, "submit", 64)])
    df = drain(spark, decisions(source(spark, where)), out)
    assert [x for x in got(df) if x[0] == "a"] == sorted(
        [("a", 1, "queued", 0, 1), ("a", 1, "running", 1, 1), ("a", 1, "requeued", 31, 1), ("a", 4, "reused", 61, 1), ("a", 1, "running", 62, 1), ("a", 1, "done", 63, 1), ("a", 5, "queued", 64, 5)], key=repr
    )
    assert not [x for x in got(df) if x[2] == "requeued" and x[0] != "a"]


def test_keys_of_one_bucket_keep_their_own_tasks_and_deadlines(spark, tmp_path):
    where, out = str(tmp_path / "in"), f"file://{tmp_path}/run"
    starts = {"a": 1, "b": 5, "c": 19, "d": 20, "e": 45}
    put(spark, where, [(k, ord(k), e, m) for k, s in starts.items() for e, m in (("submit", 0), ("start", s))] + [("f", 9, "submit", 0)])
    drain(spark, decisions(source(spark, where), buckets=1), out)
    put(spark, where, [("x", 3, "submit", 60)])  # the watermark passes ten minutes before it
    df = drain(spark, decisions(source(spark, where), buckets=1), out)
    assert [(k, m) for k, _, action, m, _ in got(df) if action == "requeued"] == [("a", 31), ("b", 35), ("c", 49)]
    put(spark, where, [("e", ord("e"), "finish", 61), ("d", 7, "submit", 61), ("y", 4, "submit", 90)])
    df = drain(spark, decisions(source(spark, where), buckets=1), out)
    late = [x for x in got(df) if x[3] >= 50 and x[0] in "de"]
    assert late == sorted([("d", 7, "reused", 61, ord("d")), ("d", ord("d"), "requeued", 50, ord("d")), ("e", ord("e"), "done", 61, ord("e"))], key=repr)
