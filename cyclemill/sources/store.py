"""The event store: immutable segments of Parquet, and a log of snapshots that name them.

A write makes a segment, a folder that nobody knows of, and then a log entry with the next number, a file that is made only if
it is not there. So a killed write is never seen, a reader that has taken a snapshot keeps it whatever is written, and of
two writers one gets the number; the other looks at what was committed meanwhile and tries the next one. An entry says
which segments make up the store, and for each segment which source files in it have been read again since and count no
more.

Segments are bucketed by the events' key. So a merge, which adds the rows whose keys are not here, shuffles the new rows
alone, and compares them bucket by bucket with the stored ones where these lie. Within a bucket rows are in the order
of time, so that a reader of a period passes over most of a file; segments outside the period are not opened.

Reading a file again replaces its own rows and nothing else. Duplicates of other files are settled once, when the store is
compacted or merged, by the first file; so no reader pays for them. A tag beside the data says what makes two rows one
event, and a store with another tag is refused.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cyclemill.operators.readings import COLUMNS as READINGS
from cyclemill.operators.readings import readings
from cyclemill.schema import EVENTS, KEY
from cyclemill.sources.extract import changes, csv_rows, events, policy_counts, sweep
from cyclemill.sources.files import created, deleted, exists, fs_of, moved, names_in, text_of
from cyclemill.sources.raw import every_row

TAG = {"identity": ",".join(KEY)}
COLUMNS = [f.name for f in EVENTS.fields]
ROWS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EVENTS.fields) + ", source_file string"
SOURCE = ["machine_id", "source_file"]
#: Buckets of a new store's segments; a store keeps the number it was made with. A bucket of the whole store should suit one task.
BUCKETS = 16


class StoreError(ValueError):
    pass


def publish(spark: SparkSession, into: str, make) -> None:
    """Give make() a folder beside `into`, and rename that once it is whole: nobody sees a half of it. An existing place is
    refused, also one that another writer made meanwhile, and what a failed attempt left aside is not in the way."""
    if exists(spark, into):
        raise StoreError(f"{into} exists")
    half = f"{into.rstrip('/')}.part-{uuid.uuid4().hex[:8]}"
    try:
        make(half)
    except BaseException:
        deleted(spark, half)
        raise
    if not moved(spark, half, into):
        deleted(spark, half)
        raise StoreError(f"{into} exists")


def _total(counts: DataFrame) -> dict:
    found = counts.agg(*(F.sum(c).alias(c) for c in ("valid", "skipped", "out_of_order"))).first()
    return {k: v or 0 for k, v in found.asDict().items()}


def clean_to_csv(spark: SparkSession, path: str, into: str, kind: str | None = None) -> dict:
    """Events of a raw file or folder as a folder of CSV with a header, in the order of files, rows and heads; how many rows were
    skipped or out of order. Times stay as they were read. No duplicates are dropped: that is the store's work."""
    swept = sweep(every_row(spark, path, kind))
    publish(spark, into, lambda half: csv_rows(changes(swept)).write.option("header", True).csv(half))
    return _total(policy_counts(swept))


def first_of_each(df: DataFrame, order: list[str]) -> DataFrame:
    """One row per key, the first in the given order."""
    w = Window.partitionBy(*KEY).orderBy(*order)
    return df.withColumn("k_", F.row_number().over(w)).where("k_ = 1").drop("k_")


@dataclass(frozen=True)
class Segment:
    """least, most: its first and last time as text. without: (machine, source file) of rows that count no more."""

    name: str
    rows: int
    least: str | None
    most: str | None
    without: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Snapshot:
    version: int = 0
    buckets: int = BUCKETS
    segments: tuple[Segment, ...] = field(default=())

    def text(self, what: str) -> str:
        return json.dumps({"version": self.version, "what": what, "buckets": self.buckets, "segments": [vars(s) for s in self.segments]})

    @staticmethod
    def of(text: str) -> Snapshot:
        d = json.loads(text)
        own = tuple(Segment(**s | {"without": tuple(map(tuple, s["without"]))}) for s in d["segments"])
        return Snapshot(d["version"], d["buckets"], own)


class EventStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        if exists(spark, f"{self.path}/_meta"):
            tag = json.loads(spark.read.text(f"{self.path}/_meta").first()[0])
            if tag != TAG:
                raise StoreError(f"{path}: rows are identified by {tag}, not by {TAG}")
        elif exists(spark, f"{self.path}/log"):
            raise StoreError(f"{path}: a store without a tag")

    # ------------------------------------------------------------ snapshots

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in names_in(self.spark, f"{self.path}/log") if re.fullmatch(r"\d+\.json", n)]

    def _entry(self, version: int) -> str:
        return f"{self.path}/log/{version:020d}.json"

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The last one, or that of a number; of an empty store one without segments."""
        known = self.versions()
        if version is not None and version not in known:
            raise StoreError(f"{self.path}: there is no version {version}")
        return Snapshot.of(text_of(self.spark, self._entry(version or known[-1]))) if known else Snapshot(0, self.buckets)

    def _commit(self, what: str, make: Callable[[Snapshot], tuple[Segment, ...]]) -> Snapshot:
        """Append an entry with the segments that make() gives for the last snapshot; again, if another writer was first."""
        if not exists(self.spark, f"{self.path}/_meta"):
            created(self.spark, f"{self.path}/_meta/tag", json.dumps(TAG))
        while True:
            now = self.snapshot()
            after = Snapshot(now.version + 1, now.buckets, make(now))
            if created(self.spark, self._entry(after.version), after.text(what)):
                return after

    # ------------------------------------------------------------ segments

    def _place(self, name: str) -> str:
        return f"{self.path}/data/{name}"

    def _segment(self, rows: DataFrame, buckets: int) -> Segment:
        """Write a segment. rows: COLUMNS and source_file, dealt by key already or not. Nobody sees it before it is committed."""
        name = uuid.uuid4().hex
        place, table = self._place(name), f"cyclemill_{name}"
        dealt = rows.select(*COLUMNS, "source_file").repartition(buckets, *KEY)
        try:
            dealt.write.format("parquet").bucketBy(buckets, *KEY).sortBy("ts", "machine_id", "head_id").option("path", place).saveAsTable(table)
            written = self.spark.read.schema(ROWS).parquet(place)
            written.select(*SOURCE).distinct().coalesce(1).write.parquet(f"{place}/_sources")
            readings(written).write.parquet(f"{place}/_readings")
            r = written.agg(F.count(F.lit(1)).alias("n"), F.min("ts").cast("string").alias("least"), F.max("ts").cast("string").alias("most")).first()
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        return Segment(name, r["n"], r["least"], r["most"])

    def _without(self, rows: DataFrame, segment: Segment) -> DataFrame:
        if not segment.without:
            return rows
        gone = F.broadcast(self.spark.createDataFrame(list(segment.without), "machine_id string, source_file string"))  # as many as files read again
        return rows.join(gone, SOURCE, "left_anti")

    def _bucketed(self, segment: Segment, buckets: int) -> DataFrame:
        """The rows of a segment, with its buckets made use of. The name it is read by is dropped at once; the files stay."""
        table = f"cyclemill_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {table} ({ROWS}) USING parquet CLUSTERED BY ({', '.join(KEY)}) INTO {buckets} BUCKETS LOCATION '{self._place(segment.name)}'")
        try:
            return self._without(self.spark.table(table), segment)
        finally:
            self.spark.sql(f"DROP TABLE {table}")

    def _sources_again(self, segments: tuple[Segment, ...], own: Segment) -> tuple[Segment, ...]:
        """segments, without the source files that own has read again."""
        if not segments:
            return segments
        ours = self.spark.read.parquet(f"{self._place(own.name)}/_sources")
        known = self.spark.read.parquet(*(f"{self._place(s.name)}/_sources" for s in segments))
        name = F.regexp_extract(F.col("_metadata.file_path"), "/data/([0-9a-f]{32})/_sources/", 1).alias("name")
        twice = [(r["name"], (r["machine_id"], r["source_file"])) for r in known.select(*SOURCE, name).join(ours, SOURCE, "left_semi").collect()]
        return tuple(Segment(s.name, s.rows, s.least, s.most, tuple(sorted({*s.without, *(w for n, w in twice if n == s.name)}))) for s in segments)

    # ------------------------------------------------------------ reading

    def _rows(self, snapshot: Snapshot, since: str | None = None, until: str | None = None) -> DataFrame:
        """COLUMNS and source_file. since, until: times as text, which only leave out segments that lie outside."""
        inside = [s for s in snapshot.segments if s.rows and (since is None or s.most >= since) and (until is None or s.least <= until)]
        plain = [self._place(s.name) for s in inside if not s.without]
        frames = [self._without(self.spark.read.schema(ROWS).parquet(self._place(s.name)), s) for s in inside if s.without]
        if plain:
            frames.append(self.spark.read.schema(ROWS).parquet(*plain))
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], ROWS)

    def read(self, dedup: bool = False, version: int | None = None) -> DataFrame:
        """The events of the last snapshot, or of a version; what is written later is not seen."""
        found = self.snapshot(version)
        if not found.version:
            raise StoreError(f"{self.path}: no events are stored here")
        rows = self._rows(found)
        return (first_of_each(rows, ["source_file", "cap_seq"]) if dedup else rows).select(COLUMNS)

    def readings(self, version: int | None = None) -> DataFrame:
        """The same events counted by reading (operators.readings): the tables of all segments, none of which is made anew when
        another is added."""
        inside = [s for s in self.snapshot(version).segments if s.rows]
        frames = [self._without(self.spark.read.schema(READINGS).parquet(f"{self._place(s.name)}/_readings"), s) for s in inside]
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], READINGS)

    def count(self) -> int:
        return self.read().count() if self.versions() else 0

    # ------------------------------------------------------------ writing

    def write(self, rows: DataFrame) -> Snapshot:
        """rows: event columns and source_file. Each source file's rows are replaced whole, in one commit."""
        own: list[Segment] = []

        def make(now: Snapshot) -> tuple[Segment, ...]:
            if not own:
                own.append(self._segment(rows, now.buckets))
            return (*self._sources_again(now.segments, own[0]), *own)

        return self._commit("write", make)

    def ingest(self, path: str, machine_id: str, kind: str | None = None, refused: dict[str, str] | None = None) -> dict:
        """Events of a raw file or folder; how many rows were skipped or out of order. The raw files are read once. Files with other
        columns fail the call, or are named in refused and left out."""
        swept = sweep(every_row(self.spark, path, kind, refused.update if refused is not None else None))
        found = events(changes(swept), machine_id)
        found = found.withColumn("source_file", F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", ""))
        self.write(first_of_each(found.withColumn("from_", F.col("file")), ["from_", "at"]).select(*COLUMNS, "source_file"))
        return _total(policy_counts(swept))

    def new_rows(self, rows: DataFrame, segments: tuple[Segment, ...], buckets: int) -> DataFrame:
        """The rows whose keys no segment has. They are dealt by key once; stored rows stay where they lie."""
        out = rows.repartition(buckets, *KEY)
        for s in segments:
            out = out.join(self._bucketed(s, buckets).select(*KEY), KEY, "left_anti")
        return out

    def merge(self, sources: list[str]) -> list[str]:
        """Add the rows of other stores whose keys are not here; rows here, and earlier sources, win. Returns the sources
        that could not be read; StoreError if none could. Rows that other writers commit meanwhile win too: what was found new is
        compared with their segments before the next try."""
        frames, failed = [], []
        for i, path in enumerate(sources):
            try:
                frames.append(EventStore(self.spark, path).read().withColumn("n_", F.lit(i)))
            except Exception as e:  # any unreadable source is named, the others are merged
                failed.append(f"{path}: {type(e).__name__}")
        if not frames:
            raise StoreError(f"none of the sources can be read: {failed}")
        name = F.lit(f"merged-{int(time.time() * 1000):013d}-{uuid.uuid4().hex[:8]}").alias("source_file")  # its own, so that it replaces nothing
        tried: list[Segment] = []
        known: set[tuple] = set()

        def make(now: Snapshot) -> tuple[Segment, ...]:
            if tried:
                rows = self.spark.read.schema(ROWS).parquet(self._place(tried[-1].name))
            else:
                all_of = reduce(DataFrame.unionByName, frames).repartition(now.buckets, *KEY)
                rows = first_of_each(all_of, ["n_", "cap_seq"]).select(*COLUMNS, name)
            tried.append(self._segment(self.new_rows(rows, tuple(s for s in now.segments if (s.name, s.without) not in known), now.buckets), now.buckets))
            known.update((s.name, s.without) for s in now.segments)
            return (*now.segments, tried[-1])

        self._commit("merge", make)
        for s in tried[:-1]:
            deleted(self.spark, self._place(s.name))
        return failed

    # ------------------------------------------------------------ upkeep

    def _settled(self, snapshot: Snapshot, buckets: int) -> DataFrame:
        """All rows, of equal keys the first source file's. One segment is worked on bucket by bucket, where it lies."""
        if len(snapshot.segments) == 1 and snapshot.buckets == buckets:
            rows = self._bucketed(snapshot.segments[0], buckets)
        else:
            rows = self._rows(snapshot).repartition(buckets, *KEY)
        return first_of_each(rows, ["source_file", "cap_seq"])

    def compact(self, into: str, buckets: int | None = None) -> EventStore:
        """A store without duplicates at a new place; of equal keys the first source file's row stays."""
        now = self.snapshot()
        many = buckets or now.buckets
        publish(self.spark, into, lambda half: EventStore(self.spark, half, many).write(self._settled(now, many)))
        return EventStore(self.spark, into)

    def tidy(self) -> Snapshot:
        """Put the segments of now together as one, without duplicates. Segments that are committed meanwhile stay; if source files of
        the old ones are read again meanwhile, it is done once more."""
        made: dict[tuple[Segment, ...], Segment] = {}

        def make(now: Snapshot) -> tuple[Segment, ...]:
            for old, own in made.items():
                if set(old) <= set(now.segments):
                    return (own, *(s for s in now.segments if s not in old))
            made[now.segments] = self._segment(self._settled(now, now.buckets), now.buckets)
            return (made[now.segments],)

        after = self._commit("tidy", make)
        for own in made.values():
            if own not in after.segments:
                deleted(self.spark, self._place(own.name))
        return after

    def vacuum(self, keep: int = 10, hours: float = 24.0) -> list[str]:
        """Drop log entries before the last `keep`, and segments that none of the others names and that are older than `hours`, as a
        writer may be about to commit a younger one. The names of what was dropped."""
        known = self.versions()
        for version in known[:-keep]:
            deleted(self.spark, self._entry(version))
        named = {s.name for v in known[-keep:] for s in self.snapshot(v).segments}
        gone = []
        for name in names_in(self.spark, f"{self.path}/data"):
            fs, p = fs_of(self.spark, self._place(name))
            if name not in named and fs.getFileStatus(p).getModificationTime() / 1000 < time.time() - hours * 3600:
                deleted(self.spark, self._place(name))
                gone.append(name)
        return gone

    def export(self, into: str, since: str | None = None, until: str | None = None) -> int:
        """A Parquet folder ordered by machine, head and time; bounds are inclusive, a bare date as the upper one means
        its whole day. An existing destination is refused."""
        rows = self.read()
        if since:
            rows = rows.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
        if until:
            until = f"{until} 23:59:59.999999" if re.fullmatch(r"\d{4}-\d{2}-\d{2}", until.strip()) else until
            rows = rows.where(F.col("ts") <= F.lit(until).cast("timestamp_ntz"))
        wanted = rows.count()

        def make(half: str) -> None:
            rows.orderBy("machine_id", "head_id", "ts").write.parquet(half)
            got = self.spark.read.schema(EVENTS).parquet(half).count()
            if got != wanted:
                raise StoreError(f"{into}: {got} rows were written, {wanted} expected")

        publish(self.spark, into, make)
        return wanted
