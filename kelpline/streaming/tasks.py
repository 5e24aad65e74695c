"""Index tasks as keyed state: one active task for each key, and running tasks that went stale back in the queue.

The state of a key is its active task alone, so it doesn't grow with the stream, and goes when the task is done. Keys fall
into a fixed number of buckets, each a list of its active tasks that is read and written once a micro-batch: a call to the
state store for every key would take longer than all the rest. A timer in event time stands for a bucket's next deadline.
State lives in the state store of the query's checkpoint, from which a restart goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kelpline.sources.store import shared_path

#: Events of a task, in the order in which those of one instant count.
EVENTS = ("submit", "start", "finish")
DECIDED = "dedupe_key string, task_id long, action string, at_ms long, active_id long"
STATE = "dedupe_key string, task_id long, status string, started_ms long"
#: Fixed, as a checkpoint's state is laid out by it.
BUCKETS = 512
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class ActiveTasks(StatefulProcessor):
    """Decides each event of a bucket's keys by the active task of its key.

    A submitted task is queued where the key has no active one, else it reuses that; a queued task that starts is running,
    an active one that finishes frees the key; other events of tasks that aren't active change nothing and are no rows.
    A running task is queued again when the watermark passes its start by stale_ms.
    """

    def __init__(self, stale_ms: int):
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.active = handle.getListState("active", STATE)

    def _read(self) -> dict[str, tuple[int, str, int]]:
        """(task, status, start or -1) by key."""
        return {key: (int(task), status, int(started)) for key, task, status, started in self.active.get()}

    def _write(self, active: dict[str, tuple[int, str, int]]) -> None:
        if active:
            self.active.put([(key, *x) for key, x in active.items()])
        else:
            self.active.clear()
        due = min((started + self.stale_ms for _, status, started in active.values() if status == "running"), default=None)
        timers = list(self.handle.listTimers())
        for at in timers:
            if at != due:
                self.handle.deleteTimer(at)
        if due is not None and due not in timers:
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        late = timerValues.getCurrentWatermarkInMs()
        batch = pd.concat(list(rows))
        batch = batch[batch.at_ms > late] if late > 0 else batch
        batch = batch.assign(order=batch.event.map(EVENTS.index)).sort_values(["at_ms", "order", "task_id"])
        active = self._read()
        out = []
        for k, task, event, at in zip(batch.dedupe_key.tolist(), batch.task_id.tolist(), batch.event.tolist(), batch.at_ms.tolist(), strict=True):
            now = active.get(k)
            if event == "submit":
                if now is None:
                    active[k] = (task, "queued", -1)
                    out.append((k, task, "queued", at, task))
                else:
                    out.append((k, task, "reused", at, now[0]))
            elif now and now[0] == task and event == "start" and now[1] == "queued":
                active[k] = (task, "running", at)
                out.append((k, task, "running", at, task))
            elif now and now[0] == task and event == "finish":
                del active[k]
                out.append((k, task, "done", at, task))
        if out:
            self._write(active)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DECIDED.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # One timer fires for all deadlines of the bucket that the watermark has passed.
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        active, out = self._read(), []
        for k, (task, status, started) in active.items():
            if status == "running" and started + self.stale_ms <= passed:
                active[k] = (task, "queued", -1)
                out.append((k, task, "requeued", started + self.stale_ms, task))
        self._write(active)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DECIDED.split(", ")])

    def close(self) -> None:
        pass


def decisions(events: DataFrame, stale: int = 30 * 60, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """A stream of events(dedupe_key, task_id, event, at) -> the stream of decisions (DECIDED); stale in seconds.

    Rows that come later than `late` behind the newest, and rows with a null key, task, time or another event, are left out.
    Events of one instant count in the order submit, start, finish, then by task. The rows of a bucket in one micro-batch
    are held together, so a source's limit for a trigger bounds them; a checkpoint goes on with the buckets it began with.
    """
    rows = events.filter(F.col("event").isin(*EVENTS) & F.col("dedupe_key").isNotNull() & F.col("task_id").isNotNull() & F.col("at").isNotNull())
    rows = rows.select("dedupe_key", F.col("task_id").cast("long").alias("task_id"), "event", F.col("at").cast("timestamp").alias("at"))
    rows = rows.withWatermark("at", late).withColumn("at_ms", F.unix_millis("at"))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("dedupe_key"), F.lit(buckets))).groupBy("bucket").transformWithStateInPandas(ActiveTasks(1000 * stale), DECIDED, "Append", "EventTime")


def drain(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """What a stream has so far, appended to the Parquet table at `path`/out with its checkpoint beside it; the whole table."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def decided(spark: SparkSession, events: DataFrame, name: str, stale: int = 30 * 60, late: str = "10 minutes") -> DataFrame:
    """All decisions on the events that a stream has now."""
    return drain(spark, decisions(events, stale, late), shared_path(spark, name))
