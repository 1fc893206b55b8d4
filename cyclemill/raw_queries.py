"""Queries of reading, extraction and the store, with the SQL that gives the same rows.

The tables hold no polls, so day-files are derived from `events`: a row for each hour that has events, users dealt out to
36 heads, a head's counter the number of its events so far, modulo WRAP, its torque the hour's largest value, its status the
hour's worst. Of 50 hours one lacks its last cell, one has a word for a number, one a time that was before. They are
written as CSV, JSON lines or Parquet, a file a day, and read as any raw files are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cyclemill import queries as Q
from cyclemill.schema import EVENTS, HEADS, RAW_COLUMNS
from cyclemill.sources.extract import changes, events, policy_counts
from cyclemill.sources.raw import every_row
from cyclemill.sources.scratch import scratch_dir
from cyclemill.sources.store import EventStore

WRAP = 50
SHORT, WORD, LATE = 17, 23, 31


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n, hour, head, seen, torque, status): a row for each hour that has events and each head."""
    kind, hour = F.col("event_type"), F.date_trunc("hour", F.col("ts").cast("timestamp_ntz").cast("timestamp"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(hour.alias("hour"), (F.col("user_id") % HEADS).cast("int").alias("head"), F.col("value").cast("double").alias("value"), F.when(kind == "error", 65).when(kind == "view", 2).when(kind == "signup", 4).otherwise(0).alias("status"))
    each = rows.groupBy("hour", "head").agg(F.count(F.lit(1)).alias("c"), F.max("value").alias("torque"), F.max("status").alias("status"))
    hours = rows.select("hour").distinct().withColumn("n", F.row_number().over(Window.orderBy("hour")) - 1)  # as many as hours
    grid = hours.withColumn("head", F.explode(F.sequence(F.lit(0), F.lit(HEADS - 1)))).join(each, ["hour", "head"], "left")
    seen = F.sum(F.coalesce("c", F.lit(0))).over(Window.partitionBy("head").orderBy("n"))
    return grid.select("n", "hour", "head", (seen % WRAP).alias("seen"), F.coalesce("torque", F.lit(0.0)).alias("torque"), F.coalesce("status", F.lit(0)).alias("status"))


def day_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, n, the columns of a day-file as text)."""
    cells = F.map_from_entries(F.collect_list(F.struct("head", F.struct("seen", "torque", "status").alias("v"))))
    rows = hourly(spark, sf_dir).groupBy("n", "hour").agg(cells.alias("v"))
    case = F.col("n") % 50
    time = F.when(case == LATE, F.col("hour") - F.expr("INTERVAL 2 HOURS")).otherwise(F.col("hour"))
    out = [F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("timestamp")]
    for part in ("seen", "torque", "status"):
        out += [F.col("v")[h][part].cast("string") for h in range(HEADS)]
    out[1] = F.when(case == WORD, "abc").otherwise(out[1])
    out[-1] = F.when(case != SHORT, out[-1])
    return rows.select(F.to_date("hour").alias("day"), "n", *(c.alias(name) for c, name in zip(out, RAW_COLUMNS, strict=True)))


def written(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """A folder with a file a day, rows in order."""
    rows, into = day_rows(spark, sf_dir), scratch_dir(spark)
    if kind == "csv":
        rows = rows.select("day", "n", F.concat_ws(",", *(F.col(f"`{c}`") for c in RAW_COLUMNS)).alias("value"))
        head = rows.select("day").distinct().select("day", F.lit(-1).alias("n"), F.lit(",".join(RAW_COLUMNS)).alias("value"))
        rows = rows.unionByName(head)
    out = rows.repartition("day").sortWithinPartitions("day", "n").drop("n").write.partitionBy("day")
    {"csv": out.text, "json": out.json, "parquet": out.parquet}[kind](into)
    return into


def _day() -> Column:
    return F.regexp_extract("file", r"day=(\d{4}-\d{2}-\d{2})", 1)


def read_polls(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return every_row(spark, written(spark, sf_dir, kind) + "/day=*", kind)


def extracted(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    found = events(changes(read_polls(spark, sf_dir, kind)), "MCC").withColumn("day", _day())
    return found.select("day", "head_id", "ts", "cap_seq", "app_torque", "status", "delta", *(F.col(c).cast("int") for c in ("is_fault", "aggregated", "is_reset")))


def policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy_counts(read_polls(spark, sf_dir, "csv")).select(_day().alias("day"), "valid", "skipped", "out_of_order")


def _stored(spark: SparkSession, rows: DataFrame, source: str) -> EventStore:
    """A new store with these rows (of Q.events) as one source file."""
    zero = {"delta": 1, "is_fault": False, "aggregated": False}
    full = rows.select(*(F.lit(zero[f.name]).alias(f.name) if f.name in zero else F.col(f.name).cast(f.dataType) for f in EVENTS.fields), F.lit(source).alias("source_file"))
    store = EventStore(spark, scratch_dir(spark))
    store.write(full)
    return store


FIRST, SECOND = "ts < TIMESTAMP_NTZ '2024-01-15'", "ts >= TIMESTAMP_NTZ '2024-01-10'"
SHIFT = 1_000_000
_SEEN = ["head_id", "ts", "cap_seq", "app_torque", "status"]


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stores that share days, the second with other counters there: the first one's rows stay."""
    rows = Q.events(spark, sf_dir)
    first = _stored(spark, rows.where(FIRST), "a")
    first.merge([_stored(spark, rows.where(SECOND).withColumn("cap_seq", F.col("cap_seq") + SHIFT), "b").path])
    return first.read().select(_SEEN)


def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One store with two source files that share days, compacted: the first file's rows stay."""
    rows = Q.events(spark, sf_dir)
    store = _stored(spark, rows.where(SECOND), "b")
    other = _stored(spark, rows.where(FIRST).withColumn("cap_seq", F.col("cap_seq") + SHIFT), "a")
    store.write(other.read().withColumn("source_file", F.lit("a")))
    return store.compact(scratch_dir(spark)).read().select(_SEEN)


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusive bounds; a bare date as the upper one means the whole day."""
    into = scratch_dir(spark)
    _stored(spark, Q.events(spark, sf_dir), "a").export(into, "2024-01-05 12:00:00", "2024-01-10")
    return spark.read.schema(EVENTS).parquet(into).select(_SEEN)


_POLLS = f"""
WITH hours AS (SELECT h, row_number() OVER (ORDER BY h) - 1 AS n FROM (SELECT DISTINCT date_trunc('hour', ts)::TIMESTAMP AS h FROM events)),
each AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS h, user_id % {HEADS} AS k, count(*) AS c, max(CAST(value AS DOUBLE)) AS torque,
  max(CASE event_type WHEN 'error' THEN 65 WHEN 'view' THEN 2 WHEN 'signup' THEN 4 ELSE 0 END) AS status FROM events GROUP BY 1, 2),
grid AS (SELECT n, h, k, sum(coalesce(c, 0)) OVER (PARTITION BY k ORDER BY n) % {WRAP} AS seen, coalesce(torque, 0) AS torque, coalesce(status, 0) AS status
  FROM hours CROSS JOIN (SELECT unnest(range({HEADS})) AS k) LEFT JOIN each USING (h, k)),
polls AS (SELECT *, strftime(CAST(h AS DATE), '%Y-%m-%d') AS day, n % 50 IN ({SHORT}, {WORD}) AS bad, CASE WHEN n % 50 = {LATE} THEN h - INTERVAL 2 HOUR ELSE h END AS ts FROM grid)
"""
_EXTRACT = f"""{_POLLS}, steps AS (SELECT *, seen - lag(seen) OVER (PARTITION BY day, k ORDER BY n) AS step FROM polls WHERE NOT bad)
SELECT day, CAST(k + 1 AS BIGINT) AS head_id, ts, CAST(seen AS BIGINT) AS cap_seq, round(CAST(CAST(torque AS REAL) AS DOUBLE), 6) AS app_torque, round(CAST(status AS DOUBLE), 6) AS status,
  CAST(greatest(step, 0) AS BIGINT) AS delta, CAST(status % 2 AS BIGINT) AS is_fault, CAST(step > 1 AS BIGINT) AS aggregated, CAST(step < 0 AS BIGINT) AS is_reset
FROM steps WHERE step <> 0
"""
_POLICY = f"""{_POLLS}, rows AS (SELECT DISTINCT day, n, bad, ts FROM polls),
late AS (SELECT day, n, ts <= lag(ts) OVER (PARTITION BY day ORDER BY n) AS late FROM rows WHERE NOT bad)
SELECT day, count(*) FILTER (NOT bad) AS valid, count(*) FILTER (bad) AS skipped, count(*) FILTER (coalesce(late, FALSE)) AS out_of_order
FROM rows LEFT JOIN late USING (day, n) GROUP BY day
"""
_A, _B = "ts < TIMESTAMP '2024-01-15'", "ts >= TIMESTAMP '2024-01-10'"
_SEEN_SQL = "CAST(head_id AS BIGINT) AS head_id, ts, CAST(cap_seq AS BIGINT) AS cap_seq, round(CAST(app_torque AS DOUBLE), 6) AS app_torque, round(CAST(status AS DOUBLE), 6) AS status"


def _first_wins(first: str, second: str) -> str:
    """Of equal (head, ts) the first table's row, in it the one with the least counter."""
    rows = f"SELECT 0 AS o, head_id, ts, cap_seq, app_torque, status FROM ev WHERE {first} UNION ALL SELECT 1, head_id, ts, cap_seq{{}}, app_torque, status FROM ev WHERE {second}"
    return f"{Q._EVENTS}, joined_ AS ({rows}) SELECT {_SEEN_SQL} FROM joined_ QUALIFY row_number() OVER (PARTITION BY head_id, ts ORDER BY o, cap_seq) = 1"


_TABLE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    **{f"extract_events_{kind}": (lambda spark, sf_dir, kind=kind: extracted(spark, sf_dir, kind), _EXTRACT) for kind in ("csv", "json", "parquet")},
    "row_policy_counts": (policy, _POLICY),
    "merge_stores": (merged, _first_wins(_A, _B).format(f" + {SHIFT}")),
    "dedup_store": (deduplicated, _first_wins(_A, _B).format("").replace("SELECT 0 AS o, head_id, ts, cap_seq,", f"SELECT 0 AS o, head_id, ts, cap_seq + {SHIFT} AS cap_seq,")),
    "export_range": (exported, f"{Q._EVENTS} SELECT {_SEEN_SQL} FROM ev WHERE ts >= TIMESTAMP '2024-01-05 12:00:00' AND ts < TIMESTAMP '2024-01-11'"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, make=make: Q._plain(make(spark, sf_dir))) for name, (make, _) in _TABLE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _TABLE.items()}
