"""Queries over the supplied tables and the SQL that gives the same rows.

The tables hold no machine telemetry, so `events` is read as such: users are heads, a purchase or click a success, an
error a reject, a view a cycle without load, a signup a closure without a verdict. Both sides use this reading.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cyclemill.config import Config
from cyclemill.functions import exprs as X
from cyclemill.operators import frames as A

CONFIG = Config(torque_min=5.0, torque_max=100.0, idle_max_gap_seconds=86400)
PERIOD = "2024-01"
IDLE_SECONDS, GAP_SECONDS = 300, 60
#: Heads of head_correlation and correlation_outliers, in their SQL too; the queries named ..._all take every head.
CORRELATED = list(range(41))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = rows.select(
        F.lit("MCC").alias("machine_id"),
        F.col("user_id").cast("int").alias("head_id"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("event_id").cast("long").alias("cap_seq"),
        F.when(kind == "view", 0.0).otherwise(F.col("value")).cast("float").alias("app_torque"),
        F.when(kind == "error", 65.0).when(kind == "view", 2.0).when(kind == "signup", 4.0).otherwise(0.0).cast("float").alias("status"),
        F.lit(False).alias("is_reset"),
    )
    return X.scope(rows, CONFIG, PERIOD)


_EVENTS = """
WITH ev AS (
  SELECT CAST(user_id AS INTEGER) AS head_id, ts, event_id AS cap_seq,
    CAST(CASE WHEN event_type = 'view' THEN 0 ELSE value END AS REAL) AS app_torque,
    CAST(CASE event_type WHEN 'error' THEN 65 WHEN 'view' THEN 2 WHEN 'signup' THEN 4 ELSE 0 END AS REAL) AS status
  FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'),
f AS (SELECT *, CAST(app_torque AS DOUBLE) AS x, app_torque > 0 AS loaded, CAST(status AS BIGINT) % 2 <> 0 AS rej, status = 0 AS good FROM ev),
caps AS (SELECT * FROM f WHERE loaded)
"""


def _plain(df: DataFrame) -> DataFrame:
    """Whole numbers as long, other numbers as doubles of 6 places."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ShortType, T.IntegerType, T.LongType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = X.rounded(c.cast("double"), 6)
        out.append(c.alias(f.name))
    return df.select(out)


def _sql(columns: str, body: str, more: str = "") -> str:
    """columns: name[:i|d] and so on; :i is a long, :d a double of 6 places."""
    out = []
    for c in columns.split():
        name, _, kind = c.partition(":")
        out.append({"i": f"CAST({name} AS BIGINT) AS {name}", "d": f"round(CAST({name} AS DOUBLE), 6) AS {name}", "": name}[kind])
    return f"{_EVENTS}{more}\nSELECT {', '.join(out)} FROM ({body}) AS result_"


_RATE = "count(*) FILTER (good) * 1.0 / nullif(count(*) FILTER (good OR rej), 0)"
_SUCCESS = f"count(*) AS total, count(*) FILTER (good) AS successful, count(*) FILTER (rej) AS failed, {_RATE} AS success_rate"
_STATS = "count(*) AS n, avg(x) AS mean, min(x) AS min, max(x) AS max, stddev_samp(x) AS stddev, median(x) AS median"
_RUNS = f""", marked AS (SELECT *, coalesce(status = 2 AND app_torque = 0, FALSE) AS idle FROM f),
islands AS (SELECT *, row_number() OVER (PARTITION BY head_id ORDER BY ts, cap_seq) - row_number() OVER (PARTITION BY head_id, idle ORDER BY ts, cap_seq) AS island FROM marked),
broken AS (SELECT *, CASE WHEN date_diff('second', lag(ts) OVER w, ts) > {CONFIG.idle_max_gap_seconds} THEN 1 ELSE 0 END AS brk FROM islands WHERE idle WINDOW w AS (PARTITION BY head_id, island ORDER BY ts, cap_seq)),
parts AS (SELECT *, sum(brk) OVER (PARTITION BY head_id, island ORDER BY ts, cap_seq) AS part FROM broken),
runs AS (SELECT head_id, min(ts) AS start, max(ts) AS "end", count(*) AS cycles, date_diff('second', min(ts), max(ts)) AS duration_seconds
  FROM parts GROUP BY head_id, island, part HAVING date_diff('second', min(ts), max(ts)) >= {IDLE_SECONDS})"""
_SCALE = """, med AS (SELECT head_id, median(x) AS m, (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 2 AS half_iqr FROM caps GROUP BY head_id),
away AS (SELECT head_id, median(abs(x - m)) AS mad FROM caps JOIN med USING (head_id) GROUP BY head_id),
scale AS (SELECT head_id, m, mad, half_iqr, greatest(1.4826::DOUBLE * CASE WHEN mad > 0 THEN mad ELSE half_iqr END, 0.01::DOUBLE) AS s,
  CASE WHEN mad > 0 THEN 'mad' WHEN half_iqr > 0 THEN 'iqr' ELSE 'exact' END AS basis FROM med JOIN away USING (head_id)),
hits AS (SELECT head_id, ts, cap_seq, app_torque, m, basis FROM caps JOIN scale USING (head_id) WHERE abs(x - m) > 3.0::DOUBLE * s)"""
_OUT = "(x < 5.0::DOUBLE OR x > 100.0::DOUBLE)"
_BUCKETS = ", b AS (SELECT head_id, date_trunc('day', ts)::TIMESTAMP AS bucket, {value} AS value FROM caps GROUP BY 1, 2)"
_PAIRS = f""", m AS (SELECT head_id, date_trunc('day', ts)::TIMESTAMP AS bucket, avg(x) AS v FROM caps WHERE head_id <= {CORRELATED[-1]} GROUP BY 1, 2),
p AS (SELECT a.head_id AS head_a, b.head_id AS head_b, count(*) AS shared, CASE WHEN count(*) >= 3 THEN corr(a.v, b.v) END AS r0
  FROM m a JOIN m b ON a.bucket = b.bucket AND a.head_id < b.head_id GROUP BY 1, 2),
pairs AS (SELECT head_a, head_b, shared, CASE WHEN isnan(r0) THEN NULL ELSE r0 END AS r FROM p)"""
_DRIFT = """, k AS (SELECT a.head_id, sum(sign(b.value - a.value)) AS s FROM b a JOIN b ON a.head_id = b.head_id AND a.bucket < b.bucket GROUP BY 1),
t AS (SELECT head_id, sum(c) AS n, sum(c * (c - 1) / 2.0) AS tied FROM (SELECT head_id, value, count(*) AS c FROM b WHERE value IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
d AS (SELECT head_id, coalesce(s, 0) AS kendall_s, n AS n_buckets,
  CASE WHEN n < 2 OR n * (n - 1) / 2.0 - tied <= 0 THEN 0 ELSE coalesce(s, 0) / sqrt((n * (n - 1) / 2.0)::DOUBLE * (n * (n - 1) / 2.0 - tied)::DOUBLE) END AS tau FROM t LEFT JOIN k USING (head_id))"""
_HOURS = ", hours AS (SELECT hour(ts) AS hour, count(*) AS closures, count(*) FILTER (rej) AS rejected FROM caps WHERE good OR rej GROUP BY 1)"
_COMPARE = """SELECT *, caps * 1.0 / nullif(calendar_days, 0) AS caps_per_day, caps * 1.0 / nullif(active_days, 0) AS caps_per_active_day,
  rejected * 1.0 / nullif(successful + rejected, 0) AS reject_rate, no_load_cycles * 1.0 / nullif(caps + no_load_cycles, 0) AS no_load_share
FROM (SELECT bucket_start, count(*) AS events, count(*) FILTER (loaded) AS caps, count(*) FILTER (loaded AND good) AS successful, count(*) FILTER (loaded AND rej) AS rejected,
  count(*) FILTER (status = 2 AND app_torque = 0) AS no_load_cycles, count(DISTINCT CAST(ts AS DATE)) FILTER (loaded) AS active_days,
  avg(x) FILTER (loaded) AS torque_mean, median(x) FILTER (loaded) AS torque_median, stddev_samp(x) FILTER (loaded) AS torque_stddev,
  greatest(date_diff('day', greatest(CAST(bucket_start AS DATE), DATE '2024-01-01'), least(CAST(bucket_start + INTERVAL 1 {by} AS DATE), DATE '2024-02-01')), 0) AS calendar_days
  FROM (SELECT *, date_trunc('{by}', ts)::TIMESTAMP AS bucket_start FROM f) GROUP BY bucket_start)"""
_COMPARED = "bucket_start events:i caps:i successful:i rejected:i no_load_cycles:i calendar_days:i active_days:i torque_mean:d torque_median:d torque_stddev:d caps_per_day:d caps_per_active_day:d reject_rate:d no_load_share:d"
_MATCH = "loaded AND app_torque > 40::REAL AND app_torque < 90::REAL"
_CONDITION = "CASE WHEN status = 65 THEN 'Bad Closure' ELSE 'unspecified' END"

_TABLE: dict[str, tuple[Callable[[DataFrame], DataFrame], str | None]] = {
    "overview": (
        lambda e: A.overview(e, CONFIG),
        _sql("rows:i capping_operations:i successful:i failed:i no_load_cycles:i ts_min ts_max null_torque:i invalid_torque:i counter_resets:i", f"SELECT count(*) AS rows, count(*) FILTER (loaded) AS capping_operations, count(*) FILTER (loaded AND good) AS successful, count(*) FILTER (loaded AND rej) AS failed, count(*) FILTER (status = 2 AND app_torque = 0) AS no_load_cycles, min(ts) AS ts_min, max(ts) AS ts_max, count(*) FILTER (app_torque IS NULL) AS null_torque, count(*) FILTER (loaded AND {_OUT}) AS invalid_torque, 0 AS counter_resets FROM f"),
    ),
    "overview_heads": (A.heads, _sql("head_id:i", "SELECT DISTINCT head_id FROM f")),
    "fingerprint": (A.fingerprint, _sql("rows:i ts_min ts_max heads:i", "SELECT count(*) AS rows, min(ts) AS ts_min, max(ts) AS ts_max, count(DISTINCT head_id) AS heads FROM f")),
    "success_by_head": (lambda e: A.success(e, CONFIG, "head"), _sql("head_id:i total:i successful:i failed:i success_rate:d", f"SELECT head_id, {_SUCCESS} FROM caps GROUP BY 1")),
    "success_by_day": (lambda e: A.success(e, CONFIG, "day"), _sql("day total:i successful:i failed:i success_rate:d", f"SELECT CAST(ts AS DATE) AS day, {_SUCCESS} FROM caps GROUP BY 1")),
    "success_overall": (lambda e: A.success(e, CONFIG, "overall"), _sql("total:i successful:i failed:i success_rate:d", f"SELECT {_SUCCESS} FROM caps")),
    "lowest_head": (lambda e: A.lowest_head(e, CONFIG), _sql("lowest_head:i", f"SELECT head_id AS lowest_head FROM (SELECT head_id, {_RATE} AS r FROM caps GROUP BY 1) WHERE r IS NOT NULL ORDER BY r, head_id LIMIT 1")),
    "torque_overall_successful": (lambda e: A.torque(e, CONFIG, "successful", False), _sql("n:i mean:d min:d max:d stddev:d median:d", f"SELECT {_STATS} FROM caps WHERE good")),
    "torque_overall_failed": (lambda e: A.torque(e, CONFIG, "failed", False), _sql("n:i mean:d min:d max:d stddev:d median:d", f"SELECT {_STATS} FROM caps WHERE rej")),
    "torque_overall_all": (lambda e: A.torque(e, CONFIG, "all", False), _sql("n:i mean:d min:d max:d stddev:d median:d", f"SELECT {_STATS} FROM caps")),
    "torque_by_head": (lambda e: A.torque(e, CONFIG, "all", True), _sql("head_id:i n:i mean:d min:d max:d stddev:d median:d", f"SELECT head_id, {_STATS} FROM caps GROUP BY 1")),
    "torque_histogram": (lambda e: A.histogram(e, CONFIG, "all"), _sql("bin_start:d count:i", "SELECT round(floor(x / 0.01::DOUBLE + 0.001::DOUBLE) * 0.01::DOUBLE, 4) AS bin_start, count(*) AS count FROM caps GROUP BY 1")),
    **{
        f"speed_{by}": (
            lambda e, by=by: A.speed(e, by),
            _sql("bucket_start caps:i active_hours:i pieces_per_hour:d pieces_per_second:d", f"SELECT *, caps * 1.0::DOUBLE / active_hours AS pieces_per_hour, caps * 1.0::DOUBLE / active_hours / 3600 AS pieces_per_second FROM (SELECT date_trunc('{by}', ts)::TIMESTAMP AS bucket_start, count(*) AS caps, count(DISTINCT date_trunc('hour', ts)) AS active_hours FROM caps GROUP BY 1)"),
        )
        for by in ("hour", "day")
    },
    "idle_runs": (lambda e: A.idle_runs(e, CONFIG, IDLE_SECONDS), _sql('head_id:i start "end" cycles:i duration_seconds:i', "SELECT * FROM runs", _RUNS)),
    "idle_by_head": (lambda e: A.idle_by_head(A.idle_runs(e, CONFIG, IDLE_SECONDS)), _sql("head_id:i periods:i total_seconds:i", "SELECT head_id, count(*) AS periods, sum(duration_seconds) AS total_seconds FROM runs GROUP BY 1", _RUNS)),
    "event_gaps": (lambda e: A.gaps(e, GAP_SECONDS), _sql('start "end" duration_seconds:i', f"SELECT lag(ts) OVER (ORDER BY ts) AS start, ts AS \"end\", date_diff('second', lag(ts) OVER (ORDER BY ts), ts) AS duration_seconds FROM (SELECT DISTINCT ts FROM f) QUALIFY duration_seconds > {GAP_SECONDS}")),
    "anomaly_faults": (lambda e: A.faults(e).withColumn("conditions", F.array_join("conditions", ", ")), _sql("head_id:i ts cap_seq:i app_torque:d status:d conditions", f"SELECT *, {_CONDITION} AS conditions FROM f WHERE rej")),
    "fault_conditions": (A.fault_conditions, _sql("condition count:i", f"SELECT {_CONDITION} AS condition, count(*) AS count FROM f WHERE rej GROUP BY 1")),
    "threshold_hits": (lambda e: A.threshold_hits(e, CONFIG), _sql("head_id:i ts cap_seq:i app_torque:d", f"SELECT * FROM caps WHERE {_OUT}")),
    "threshold_by_head": (lambda e: A.threshold_by_head(e, CONFIG), _sql("head_id:i count:i", f"SELECT head_id, count(*) AS count FROM caps WHERE {_OUT} GROUP BY 1")),
    "deviation_scale": (lambda e: A.deviation_scale(e, CONFIG), _sql("head_id:i m:d mad:d half_iqr:d s:d basis", "SELECT * FROM scale", _SCALE)),
    "deviation_hits": (lambda e: A.deviation_hits(e, CONFIG, A.deviation_scale(e, CONFIG)), _sql("head_id:i ts cap_seq:i app_torque:d m:d basis", "SELECT * FROM hits", _SCALE)),
    "hit_sample": (
        lambda e: (lambda h: A.spread_sample(h, h.count(), 100))(A.threshold_hits(e, CONFIG)),
        _sql("head_id:i ts cap_seq:i app_torque:d", f"SELECT head_id, ts, cap_seq, app_torque FROM (SELECT *, row_number() OVER (ORDER BY ts, head_id, cap_seq, app_torque) - 1 AS k, count(*) OVER () AS n FROM caps WHERE {_OUT}) WHERE k % greatest(CAST(ceil(n / 100.0) AS BIGINT), 1) = 0 ORDER BY k LIMIT 100"),
    ),
    **{
        f"trend_{signal}_day": (
            lambda e, signal=signal: A.series(e, CONFIG, signal, "day", 7),
            _sql("head_id:i bucket value:d rolling_mean:d rolling_std:d", "SELECT head_id, bucket, value, avg(value) OVER w AS rolling_mean, stddev_samp(value) OVER w AS rolling_std FROM b WINDOW w AS (PARTITION BY head_id ORDER BY bucket ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)", _BUCKETS.format(value=value)),
        )
        for signal, value in (("torque", "avg(x)"), ("success_rate", _RATE))
    },
    "kendall_s": (lambda e: A.drift(A.bucketed(e, CONFIG, "torque", "day")).select("head_id", "kendall_s", "n_buckets"), _sql("head_id:i kendall_s:i n_buckets:i", "SELECT * FROM d", _BUCKETS.format(value="round(avg(x), 9)") + _DRIFT)),
    "kendall_tau": (lambda e: A.drift(A.bucketed(e, CONFIG, "success_rate", "day")).select("head_id", "tau", "n_buckets"), _sql("head_id:i tau:d n_buckets:i", "SELECT * FROM d", _BUCKETS.format(value=_RATE) + _DRIFT)),
    "drift_trend": (
        lambda e: A.drift(A.bucketed(e, CONFIG, "torque", "day")).select("head_id", "kendall_s", "tau", "n_buckets", "direction", F.col("insufficient").cast("int").alias("insufficient")),
        _sql("head_id:i kendall_s:i tau:d n_buckets:i direction insufficient:i", "SELECT *, CASE WHEN tau > 0 THEN 'rising' WHEN tau < 0 THEN 'falling' ELSE 'flat' END AS direction, n_buckets < 8 AS insufficient FROM d", _BUCKETS.format(value="round(avg(x), 9)") + _DRIFT),
    ),
    "drift_verdicts": (lambda e: A.drift(A.bucketed(e, CONFIG, "torque", "day")), None),
    "head_correlation": (lambda e: A.correlation(e, "day", CORRELATED), _sql("head_a:i head_b:i shared:i r:d", "SELECT * FROM pairs", _PAIRS)),
    "correlation_outliers": (lambda e: A.correlation_outliers(A.correlation(e, "day", CORRELATED)), _sql("head_id:i mean_correlation:d", "SELECT head_id, avg(r) AS mean_correlation FROM (SELECT head_a AS head_id, r FROM pairs UNION ALL SELECT head_b, r FROM pairs) WHERE r IS NOT NULL GROUP BY 1", _PAIRS)),
    "head_correlation_all": (lambda e: A.correlation(e, "day"), None),
    "correlation_outliers_all": (lambda e: A.correlation_outliers_all(e, "day"), None),
    **{
        f"compare_{by}": (lambda e, by=by: A.compared(e, CONFIG, by, (date(2024, 1, 1), date(2024, 2, 1))), _sql(_COMPARED, _COMPARE.format(by=by)))
        for by in ("month", "week")
    },
    "closure_filter_count": (lambda e: A.filtered(e, CONFIG, 40, 90, "all", None).agg(F.count(F.lit(1)).alias("count")), _sql("count:i", f"SELECT count(*) AS count FROM f WHERE {_MATCH}")),
    "closure_filter_by_head": (lambda e: A.filtered(e, CONFIG, 40, 90, "all", None).groupBy("head_id").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "head_id"), _sql("head_id:i count:i", f"SELECT head_id, count(*) AS count FROM f WHERE {_MATCH} GROUP BY 1")),
    "closure_filter_events": (
        lambda e: A.first_events(A.filtered(e, CONFIG, 40, 90, "failed", None), CONFIG),
        _sql("head_id:i ts cap_seq:i app_torque:d status:d outcome", f"SELECT *, 'rejected: ' || {_CONDITION} AS outcome FROM f WHERE {_MATCH} AND rej ORDER BY ts, cap_seq, head_id LIMIT 20"),
    ),
    "failure_by_hour": (lambda e: A.by_hour(e, CONFIG), _sql("hour:i closures:i rejected:i reject_rate:d", "SELECT *, rejected * 1.0 / closures AS reject_rate FROM hours", _HOURS)),
    "chi_square": (lambda e: A.chi_square(A.by_hour(e, CONFIG)), _sql("chi_square:d degrees_of_freedom:i", "SELECT sum((rejected - closures * p) ** 2 / nullif(closures * p * (1 - p), 0)) AS chi_square, count(*) - 1 AS degrees_of_freedom FROM hours, (SELECT sum(rejected)::DOUBLE / sum(closures) AS p FROM hours)", _HOURS)),
    "failure_torque_zones": (lambda e: A.zones(e, CONFIG), _sql("zone closures:i rejected:i reject_rate:d", "SELECT zone, count(*) AS closures, count(*) FILTER (rej) AS rejected, count(*) FILTER (rej) * 1.0 / count(*) AS reject_rate FROM (SELECT *, CASE WHEN app_torque < 5::REAL THEN 'below' WHEN app_torque > 100::REAL THEN 'above' ELSE 'inside' END AS zone FROM caps WHERE good OR rej) GROUP BY 1")),
    "torque_outcome_corr": (lambda e: A.torque_outcome(e, CONFIG), _sql("closures:i correlation:d mean_torque_successful:d mean_torque_rejected:d", "SELECT count(*) AS closures, corr(x, CASE WHEN good THEN 1.0 ELSE 0.0 END) AS correlation, avg(x) FILTER (good) AS mean_torque_successful, avg(x) FILTER (rej) AS mean_torque_rejected FROM caps WHERE good OR rej")),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, frame=frame: _plain(frame(events(spark, sf_dir)))) for name, (frame, _) in _TABLE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _TABLE.items() if sql}
