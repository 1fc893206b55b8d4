"""Events out of a stream of polls, with the last counts of each file as state.

The batch plan compares a row with the valid row before it in its file. A stream keeps what that comparison needs: per
(machine, file) the counts of the last valid row, some 300 bytes. Rows are taken in the order of `at` within a micro-batch;
a row that comes in a later batch than its successor is compared with what came before it, as nothing can tell it was
late. A row whose time lies LATE before the latest time seen is left out. A file's state is freed by a timer, when the
watermark has passed the file's latest time by KEEP; so the state holds the files of some days, however long the stream
runs. A file that goes on after that begins anew: its next row only sets the counts.

Duplicates of (machine, head, ts) that a re-sent file brings are dropped within the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cyclemill.schema import KEY
from cyclemill.sources.extract import INT_MAX
from cyclemill.workers import ship

LATE, KEEP = "2 days", "1 day"
_OUT = "machine_id string, head_id int, ts timestamp_ntz, cap_seq long, app_torque float, status float, delta int, is_fault boolean, aggregated boolean, is_reset boolean, seen_at timestamp"
#: State with timers needs this store of state.
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Counts(StatefulProcessor):
    """Of each file: the counts of its last row, until its timer ends."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "counts array<bigint>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values("at", kind="stable")  # one source's rows of one micro-batch
        before = np.array(self.last.get()[0], np.int64) if self.last.exists() else None
        found, counts = changes_of(key[0], own, before)
        self.last.update((counts.tolist(),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(own["seen_at"].max().timestamp() * 1000) + self.keep_ms)
        yield found

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def changes_of(machine_id: str, rows: pd.DataFrame, last: np.ndarray | None) -> tuple[pd.DataFrame, np.ndarray]:
    """The events of a file's rows in their order, and the counts of the last; nothing is before a file's first row."""
    counts, torques, statuses = (np.array(rows[c].tolist(), float) for c in ("counts", "torques", "statuses"))
    counts = (np.sign(counts) * np.floor(np.abs(counts) + 0.5)).astype(np.int64)
    step = np.diff(counts, axis=0, prepend=(counts[0] if last is None else last)[None, :])
    row, head = np.nonzero(step)
    step, status = step[row, head], statuses[row, head]
    whole = np.where(np.isfinite(status) & (np.abs(status) <= 2**53), status, 1).astype(np.int64)
    out = {
        "machine_id": machine_id,
        "head_id": (head + 1).astype(np.int32),
        "ts": rows["ts"].to_numpy()[row],
        "cap_seq": counts[row, head],
        "app_torque": torques[row, head].astype(np.float32),
        "status": status.astype(np.float32),
        "delta": np.clip(step, 0, INT_MAX).astype(np.int32),
        "is_fault": whole % 2 != 0,
        "aggregated": step > 1,
        "is_reset": step < 0,
        "seen_at": rows["seen_at"].to_numpy()[row],
    }
    return pd.DataFrame(out), counts[-1]


def live_events(polls: DataFrame, late: str = LATE, keep: str = KEEP) -> DataFrame:
    """Events of a stream (machine_id, file, at long, ts timestamp_ntz, counts, torques, statuses) of valid polls, and seen_at, their
    event time, under a watermark."""
    spark = polls.sparkSession
    ship(spark)
    spark.conf.set(*_PROVIDER)
    stamped = polls.withColumn("seen_at", F.col("ts").cast("timestamp")).withWatermark("seen_at", late)
    rows = stamped.select("machine_id", "file", "at", "ts", "counts", "torques", "statuses", "seen_at")
    counts = Counts(int(pd.Timedelta(keep).total_seconds() * 1000))
    return rows.groupBy("machine_id", "file").transformWithStateInPandas(counts, _OUT, "append", "eventTime", eventTimeColumnName="seen_at")


def deduplicated(events: DataFrame, within: str = "1 day") -> DataFrame:
    """within: the watermark of events that have none yet."""
    stamped = events if "seen_at" in events.columns else events.withColumn("seen_at", F.col("ts").cast("timestamp")).withWatermark("seen_at", within)
    return stamped.dropDuplicatesWithinWatermark(KEY).drop("seen_at")


def into_store(events: DataFrame, store_path: str, checkpoint: str, name: str = "live"):
    """Append each micro-batch to a store as a source file of its own; a batch that is run again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        from cyclemill.sources.store import COLUMNS, EventStore, first_of_each

        EventStore(batch.sparkSession, store_path).write(first_of_each(batch, ["cap_seq"]).select(*COLUMNS, F.lit(f"{name}-{number:08d}").alias("source_file")))

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("append")
