"""State with timers: tasks that stay in work for too long go back to the queue, as soon as event time says so.

``recovered`` keeps tasks in the streaming state store with timers in event time, which the watermark moves; a stream that was stopped goes on from its
checkpoint with the timers it had. What it gives is what ``recovered_table`` gives over the whole log.

Defined cases: changes are taken by (ts, id, status), in whatever order they arrive; a change that comes again alters nothing; a change below the
watermark is dropped, as Spark does with late rows; changes without task, time or id are left out. The session's state store must be RocksDB.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WORKING = "processing"
RESULT = "task long, stale_since timestamp, recovered_at timestamp"


class Recover(StatefulProcessor):
    """Changes wait until the watermark has passed them and are then taken in order, so what is given doesn't depend on their arrival. Kept of a task: the
    changes of the time that may still be late, and its last one while it is in work."""

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts long, id long, status string")
        self.waiting = handle.getListState("waiting", "ts long, id long, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for b in rows:
            at = b["ts"].astype("datetime64[us]").astype("int64")
            self.waiting.appendList([(int(t), int(i), str(s)) for t, i, s in zip(at, b["id"], b["status"])])
            for t in {-(-int(t) // 1000) for t in at}:  # rounded up: a timer counts milliseconds
                self.handle.registerTimer(t)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        last = tuple(self.last.get()) if self.last.exists() else None
        waiting = sorted({tuple(x) for x in self.waiting.get()})

        def due() -> int:
            return -(-last[0] // 1000) + self.patience

        for c in [x for x in waiting if x[0] <= now * 1000]:
            if last and due() * 1000 < c[0]:
                out.append((last[0], due()))
            last = c if c[2] == WORKING else None
        if last and due() <= now:
            out.append((last[0], due()))
            last = None
        if last:
            self.last.update(last)
            self.handle.registerTimer(due())
        else:
            self.last.clear()
        later = [x for x in waiting if x[0] > now * 1000]
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        if out:
            yield pd.DataFrame({"task": [key[0]] * len(out), "stale_since": pd.to_datetime([x[0] for x in out], unit="us"), "recovered_at": pd.to_datetime([x[1] for x in out], unit="ms")})

    def close(self) -> None:
        pass


def recovered(changes: DataFrame, patience_s: int = 300, late: str = "10 minutes") -> DataFrame:
    """changes(task, id, status, ts), a stream -> (task, stale_since, recovered_at): tasks in work without a change for ``patience_s``."""
    d = changes.dropna(subset=["task", "id", "ts"]).withColumn("status", F.coalesce("status", F.lit(""))).withWatermark("ts", late).select("task", "id", "status", "ts")
    return d.groupBy("task").transformWithStateInPandas(Recover(patience_s * 1000), RESULT, "append", "eventTime")


def recovered_table(changes: DataFrame, until: Column, patience_s: int = 300) -> DataFrame:
    """The same over a table of all changes, where the watermark has come to ``until``: a change to "processing" that nothing follows for ``patience_s``."""
    d = changes.dropna(subset=["task", "id", "ts"]).where(F.col("ts") <= until).select("task", "id", F.coalesce("status", F.lit("")).alias("status"), "ts").distinct()
    due = F.timestamp_micros((F.ceil(F.unix_micros("ts") / 1000) + patience_s * 1000) * 1000)
    d = d.withColumns({"_next": F.lead("ts").over(Window.partitionBy("task").orderBy("ts", "id", "status")), "recovered_at": due}).where(F.col("status") == WORKING)
    kept = F.when(F.col("_next").isNull(), F.col("recovered_at") <= until).otherwise(F.col("recovered_at") < F.col("_next"))
    return d.where(kept).select("task", F.col("ts").alias("stale_since"), "recovered_at")
