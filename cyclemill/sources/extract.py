"""Events out of polls: a row for each head whose counter changed since the file's valid row before.

The raw rows are read once and are not shuffled. A task sweeps its splits of the files in the rows' own order and gives the
changes within each split, and one row for the split itself: counts of valid, skipped and late rows, its first valid row and
what its last one has. What changed from one split to the next of a file is found between these, a row a split. So a
file of any size is worked on by as many tasks as it has splits. The sweep is stored; counts and events both come of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclemill.schema import EVENTS, HEADS
from cyclemill.sources.scratch import scratch_dir
from cyclemill.workers import ship

INT_MAX = 2147483647
#: Of a change (kind 0): where, the head's number from 0, time, counter now and before, torque, status. Of a split (kind 1): the rest.
_CHANGE = pa.schema([("i", pa.int32()), ("ts", pa.string()), ("now", pa.int64()), ("before", pa.int64()), ("torque", pa.float64()), ("status", pa.float64())])
_POLL = pa.struct([("row", pa.int64()), ("ts", pa.string()), ("counts", pa.list_(pa.int64())), ("torques", pa.list_(pa.float64())), ("statuses", pa.list_(pa.float64()))])
_SPLIT = pa.schema([("valid", pa.int64()), ("skipped", pa.int64()), ("late", pa.int64()), ("first", _POLL), ("last", pa.struct([("ts", pa.string()), ("counts", pa.list_(pa.int64()))]))])
_ROW = pa.schema([("kind", pa.int32()), ("file", pa.string()), ("block", pa.int64()), ("row", pa.int64()), *_CHANGE, *_SPLIT])
_DDL = (
    "kind int, file string, block long, row long, i int, ts string, now long, before long, torque double, status double, valid long, skipped long, late long, "
    "first struct<row: long, ts: string, counts: array<long>, torques: array<double>, statuses: array<double>>, last struct<ts: string, counts: array<long>>"
)


class _Split:
    """What has been seen of a split."""

    def __init__(self, file: str, block: int):
        self.file, self.block = file, block
        self.valid = self.skipped = self.late = 0
        self.first: dict | None = None
        self.ts = ""
        self.counts: np.ndarray | None = None

    def take(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        """Go on with rows of the split; the changes between them."""
        good = rows.filter(rows.column("good"))
        self.valid, self.skipped = self.valid + len(good), self.skipped + len(rows) - len(good)
        if not len(good):
            return good_changes(self, good, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, HEADS), np.int64), np.zeros((0, HEADS), np.int64))
        now, times = matrix(good, "counts"), good.column("ts").to_pylist()
        if self.first is None:
            self.first = {c: good.column(c)[0].as_py() for c in ("row", "ts", "counts", "torques", "statuses")}
        before = np.vstack([now[:1] if self.counts is None else self.counts[None, :], now[:-1]])
        self.late += sum(bool(a) and b <= a for a, b in zip([self.ts, *times], times, strict=False))
        self.ts, self.counts = times[-1], now[-1]
        at, head = np.nonzero(now != before)
        return good_changes(self, good, at, head, now, before)

    def summary(self) -> pa.RecordBatch:
        last = None if self.counts is None else {"ts": self.ts, "counts": self.counts.tolist()}
        row = {"kind": 1, "file": self.file, "block": self.block, "valid": self.valid, "skipped": self.skipped, "late": self.late, "first": self.first, "last": last}
        return pa.RecordBatch.from_pylist([row], _ROW)


def matrix(rows: pa.RecordBatch, name: str) -> np.ndarray:
    """A row of HEADS numbers for each row."""
    return np.asarray(rows.column(name).flatten()).reshape(-1, HEADS)


def good_changes(split: _Split, good: pa.RecordBatch, at: np.ndarray, head: np.ndarray, now: np.ndarray, before: np.ndarray) -> pa.RecordBatch:
    n, own = len(at), pa.array(at)
    columns = [pa.array(np.zeros(n, np.int32)), pa.array([split.file] * n, pa.string()), pa.array(np.full(n, split.block)), good.column("row").take(own), pa.array(head.astype(np.int32)), good.column("ts").take(own)]
    columns += [pa.array(x[at, head]) for x in (now, before)]
    columns += [pa.array(matrix(good, c)[at, head] if n else np.zeros(0)) for c in ("torques", "statuses")]
    return pa.RecordBatch.from_arrays([*columns, *(pa.nulls(n, f.type) for f in _SPLIT)], schema=_ROW)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split: _Split | None = None
    for batch in batches:
        files, blocks = batch.column("file").dictionary_encode(), np.asarray(batch.column("block"))
        code = np.asarray(files.indices)
        cuts = np.flatnonzero((np.diff(code) != 0) | (np.diff(blocks) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
            if a == b:
                continue
            file, block = files.dictionary[int(code[a])].as_py(), int(blocks[a])
            if split is None or (file, block) != (split.file, split.block):
                if split is not None:
                    yield split.summary()
                split = _Split(file, block)
                if block == 0 and batch.column("head")[a].as_py():
                    a += 1  # the file's first line
            yield split.take(batch.slice(a, b - a))
    if split is not None:
        yield split.summary()


def sweep(polls: DataFrame) -> DataFrame:
    """Changes and splits of polls, from one pass over the raw files, stored."""
    spark = polls.sparkSession
    ship(spark)
    good = F.col("reason").isNull()
    whole = F.when(good, F.transform("counts", lambda x: F.round(F.when(good, x)).cast("long")))
    rows = polls.select("file", F.col("at.block").alias("block"), F.col("at.row").alias("row"), good.alias("good"), "head", "ts", whole.alias("counts"), "torques", "statuses")
    into = scratch_dir(spark)
    rows.mapInArrow(_sweep, _DDL).write.parquet(into)
    return spark.read.schema(_DDL).parquet(into)


def _swept(df: DataFrame) -> DataFrame:
    return df if "kind" in df.columns else sweep(df)


def _after(swept: DataFrame) -> DataFrame:
    """Splits with a valid row, and what the one before in the file ends with."""
    return swept.where("kind = 1 and valid > 0").withColumn("prev_", F.lag("last").over(Window.partitionBy("file").orderBy("block")))


def changes(polls: DataFrame) -> DataFrame:
    """(file, at, head_id, ts text, cap_seq, app_torque, status as doubles, delta, is_fault, aggregated, is_reset) of polls or of a sweep.

    Invalid rows go before rows are compared. Order is the file's, never the time's.
    """
    swept = _swept(polls)
    names = ["file", "block", "row", "i", "ts", "now", "before", "torque", "status"]
    head = F.explode(F.filter(F.sequence(F.lit(0), F.lit(HEADS - 1)), lambda i: F.get("first.counts", i) != F.get("prev_.counts", i)))
    between = _after(swept).where("prev_ is not null").withColumn("i", head)

    def of(name: str) -> Column:
        return F.get(name, F.col("i"))

    between = between.select("file", "block", F.col("first.row").alias("row"), "i", F.col("first.ts").alias("ts"), of("first.counts").alias("now"), of("prev_.counts").alias("before"), of("first.torques").alias("torque"), of("first.statuses").alias("status"))
    step = F.col("now") - F.col("before")
    return swept.where("kind = 0").select(names).unionByName(between).select(
        "file",
        F.struct("block", "row").alias("at"),
        (F.col("i") + 1).cast("int").alias("head_id"),
        "ts",
        F.col("now").alias("cap_seq"),
        F.col("torque").alias("app_torque"),
        "status",
        F.greatest(F.least(step, F.lit(INT_MAX)), F.lit(0)).cast("int").alias("delta"),
        F.coalesce(F.try_mod(F.col("status").try_cast("bigint"), F.lit(2)) != 0, F.lit(True)).alias("is_fault"),
        (step > 1).alias("aggregated"),
        (step < 0).alias("is_reset"),
    )


def policy_counts(polls: DataFrame) -> DataFrame:
    """(file, valid, skipped, out_of_order) of polls or of a sweep: rows whose time, as text, is not after that of the valid row before
    count as out of order; they are kept, in their place."""
    swept = _swept(polls)
    each = swept.where("kind = 1").select("file", "valid", "skipped", "late")
    between = _after(swept).where("prev_.ts <> '' and first.ts <= prev_.ts").select("file", F.lit(0).alias("valid"), F.lit(0).alias("skipped"), F.lit(1).alias("late"))
    return each.unionByName(between).groupBy("file").agg(F.sum("valid").alias("valid"), F.sum("skipped").alias("skipped"), F.sum("late").alias("out_of_order"))


def events(changed: DataFrame, machine_id: str) -> DataFrame:
    """The event table's columns, and file and at. A time that isn't one fails the job."""
    typed = {f.name: F.col(f.name).cast(f.dataType) for f in EVENTS.fields if f.name != "machine_id"}
    return changed.select(F.lit(machine_id).alias("machine_id"), *(c.alias(n) for n, c in typed.items()), "file", "at")


def csv_rows(changed: DataFrame) -> DataFrame:
    """For a CSV sink: times as they were read, numbers as doubles, flags 0 and 1."""
    flags = {n: F.col(c).cast("int").alias(n) for n, c in (("is_fault", "is_fault"), ("aggregated", "aggregated"), ("reset", "is_reset"))}
    return changed.orderBy("file", "at", "head_id").select("head_id", "ts", "cap_seq", "app_torque", "status", "delta", *flags.values())
