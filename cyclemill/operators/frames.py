"""DataFrames of the analyses. Each takes the events in scope (functions.exprs.scope). Those that ask for days at most may be given
readings (operators.readings) in their place: overview, success, torque, histogram, deviation_scale, threshold_by_head,
fault_conditions, compared."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclemill.config import Config
from cyclemill.functions import exprs as X
from cyclemill.functions.stats import DRIFT_SCHEMA, drifts
from cyclemill.operators.gram import correlations, mean_correlations
from cyclemill.workers import ship

BIN = 0.01


def _n(condition: Column) -> Column:
    return F.count_if(condition)


def _tally(df: DataFrame, condition: Column | None = None) -> Column:
    """How many events a group has, or of these meet a condition: rows, or what the rows of readings stand for."""
    if "n" not in df.columns:
        return F.count(F.lit(1)) if condition is None else F.count_if(condition)
    return F.coalesce(F.sum("n" if condition is None else F.when(condition, F.col("n"))), F.lit(0))


# ---------------------------------------------------------------- counts and rates


def overview(events: DataFrame, cfg: Config) -> DataFrame:
    first, last = ("first", "last") if "n" in events.columns else ("ts", "ts")
    return events.agg(
        _tally(events).alias("rows"),
        _tally(events, X.loaded()).alias("capping_operations"),
        _tally(events, X.successful(cfg)).alias("successful"),
        _tally(events, X.failed()).alias("failed"),
        _tally(events, X.no_load(cfg)).alias("no_load_cycles"),
        F.min(first).alias("ts_min"),
        F.max(last).alias("ts_max"),
        _tally(events, F.col("app_torque").isNull()).alias("null_torque"),
        _tally(events, X.outside(cfg)).alias("invalid_torque"),
        _tally(events, F.col("is_reset")).alias("counter_resets"),
    )


def heads(events: DataFrame) -> DataFrame:
    return events.select("head_id").distinct().orderBy("head_id")


def fingerprint(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("ts_min"), F.max("ts").alias("ts_max"), F.count_distinct("head_id").alias("heads"))


def success(events: DataFrame, cfg: Config, by: str) -> DataFrame:
    """by head, day or overall: groups without a capping operation are absent, rates without a verdict null."""
    keys = {"head": [F.col("head_id")], "day": [F.to_date("ts").alias("day")], "overall": []}[by]
    good, bad = _tally(events, X.successful(cfg)), _tally(events, X.failed())
    out = events.where(X.loaded()).groupBy(*keys).agg(_tally(events).alias("total"), good.alias("successful"), bad.alias("failed"), X.ratio(good, good + bad).alias("success_rate"))
    return out.orderBy({"head": "head_id", "day": "day", "overall": "total"}[by])


def lowest_head(events: DataFrame, cfg: Config) -> DataFrame:
    rated = success(events, cfg, "head").where("success_rate is not null")
    return rated.agg(F.min_by("head_id", F.struct("success_rate", "head_id")).alias("lowest_head"))


# ---------------------------------------------------------------- exact quantiles


def counted(df: DataFrame, by: list[str], x: Column) -> DataFrame:
    """(by, x, n): how often each value occurs; null values go. As short as the sensor has readings, however many rows."""
    return df.groupBy(*by, x.alias("x")).agg(_tally(df).alias("n")).where("x is not null")


def quantiles(counts: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """(by, a column for each share): exact quantiles of counted values, between two values in proportion.

    They are read off running sums of the counts, so no task holds the values of a group in memory.
    """
    w = Window.partitionBy(*by)
    up = counts.withColumn("upto_", F.sum("n").over(w.orderBy("x"))).withColumn("last_", F.sum("n").over(w) - 1)

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("upto_") - F.col("n") <= place) & (place < F.col("upto_")), F.col("x")))

    def quantile(share: float) -> Column:
        place = F.col("last_") * share
        low, high = at(F.floor(place)), at(F.ceil(place))
        return low + (high - low) * F.max(place - F.floor(place))

    return up.groupBy(*by).agg(*(quantile(s).alias(name) for name, s in shares.items()))


# ---------------------------------------------------------------- torque


def of_outcome(events: DataFrame, cfg: Config, outcome: str) -> DataFrame:
    return events.where({"successful": X.successful(cfg), "failed": X.failed(), "all": X.loaded()}[outcome])


def torque(events: DataFrame, cfg: Config, outcome: str, by_head: bool) -> DataFrame:
    """All of it off the counts of readings, which are much fewer than the events."""
    by = ["head_id"] if by_head else []
    counts = counted(of_outcome(events, cfg, outcome), by, F.col("app_torque").cast("double"))
    w = Window.partitionBy(*by)
    up = counts.withColumn("all_", F.sum("n").over(w)).withColumn("mean_", F.sum(F.col("x") * F.col("n")).over(w) / F.col("all_")).withColumn("upto_", F.sum("n").over(w.orderBy("x")))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("upto_") - F.col("n") <= place) & (place < F.col("upto_")), F.col("x")))

    middle = (at(F.floor((F.col("all_") - 1) / 2)) + at(F.ceil((F.col("all_") - 1) / 2))) / 2
    n = F.coalesce(F.sum("n"), F.lit(0))
    squares = F.sum(F.col("n") * F.pow(F.col("x") - F.col("mean_"), 2))
    out = up.groupBy(*by).agg(n.alias("n"), F.max("mean_").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"), F.sqrt(F.try_divide(squares, (n - 1).cast("double"))).alias("stddev"), middle.alias("median"))
    return out.orderBy(F.desc_nulls_last("stddev"), "head_id") if by_head else out


def histogram(events: DataFrame, cfg: Config, outcome: str) -> DataFrame:
    """Classes of 0.01 Nm that hold a row. The small shift keeps a class's lower edge in it, whatever its 32-bit value."""
    place = F.floor(F.col("app_torque").cast("double") / F.lit(BIN) + F.lit(1e-3))
    out = of_outcome(events, cfg, outcome).groupBy(place.alias("class")).agg(_tally(events).alias("count"))
    return out.select(F.round(F.col("class") * F.lit(BIN), 4).alias("bin_start"), "count").orderBy("bin_start")


# ---------------------------------------------------------------- speed, stops


def speed(events: DataFrame, bucket: str) -> DataFrame:
    hours = F.count_distinct(X.truncated("hour"))
    out = events.where(X.loaded()).groupBy(X.truncated(bucket).alias("bucket_start")).agg(F.count(F.lit(1)).alias("caps"), hours.alias("active_hours"))
    rate = X.ratio(F.col("caps"), F.col("active_hours"))
    return out.withColumn("pieces_per_hour", rate).withColumn("pieces_per_second", rate / 3600).orderBy("bucket_start")


def idle_runs(events: DataFrame, cfg: Config, min_seconds: int) -> DataFrame:
    """Runs of a head's no-load rows, ended by any other row or by a gap, that last long enough.

    Rows are shuffled once, by head and day, and become a day's runs there, beside one row for the others. What a day ends
    with and the next one begins with is then joined among these few.
    """
    order = ["ts", "cap_seq"]
    rows = events.select("head_id", "ts", "cap_seq", F.coalesce(X.no_load(cfg), F.lit(False)).alias("idle"), F.to_date("ts").alias("day_"))
    day = Window.partitionBy("head_id", "day_").orderBy(*order)
    rows = rows.withColumn("prev_", F.lag(F.struct("ts", "idle")).over(day)).withColumn("last_", F.lead(F.lit(1)).over(day).isNull())
    gap = X.seconds(F.col("ts"), F.col("prev_.ts")) > cfg.idle_max_gap_seconds
    starts = F.col("idle") & F.coalesce(~F.col("prev_.idle") | gap, F.lit(True))
    rows = rows.withColumn("run_", F.when(F.col("idle"), F.sum(starts.cast("int")).over(day.rowsBetween(Window.unboundedPreceding, 0))))
    runs = rows.groupBy("head_id", "day_", "run_").agg(
        F.min(F.struct(*order)).alias("from_"),
        F.max("ts").alias("end"),
        F.count(F.lit(1)).alias("cycles"),
        F.bool_or(F.col("prev_").isNull()).alias("opens_"),
        F.bool_or("last_").alias("closes_"),
    )
    head = Window.partitionBy("head_id").orderBy("from_")
    runs = runs.withColumn("prev_", F.lag(F.struct("run_", "end", "closes_")).over(head))
    goes_on = F.col("opens_") & F.col("prev_.closes_") & F.col("prev_.run_").isNotNull() & (X.seconds(F.col("from_.ts"), F.col("prev_.end")) <= cfg.idle_max_gap_seconds)
    runs = runs.withColumn("whole_", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(head)).where("run_ is not null")
    whole = runs.groupBy("head_id", "whole_").agg(F.min("from_.ts").alias("start"), F.max("end").alias("end"), F.sum("cycles").alias("cycles")).drop("whole_")
    whole = whole.withColumn("duration_seconds", X.seconds(F.col("end"), F.col("start")))
    return whole.where(F.col("duration_seconds") >= min_seconds).orderBy("head_id", "start")


def idle_by_head(runs: DataFrame) -> DataFrame:
    out = runs.groupBy("head_id").agg(F.count(F.lit(1)).alias("periods"), F.sum("duration_seconds").alias("total_seconds"))
    return out.orderBy(F.desc("total_seconds"), "head_id")


def gaps(events: DataFrame, min_seconds: int) -> DataFrame:
    """Stretches between one of the machine's times and the next that are longer than min_seconds.

    Times are shuffled once, by day. The gap before a day's first time is found among the days' ends, a row for each.
    """
    day = Window.partitionBy("day_").orderBy("ts")
    times = events.select("ts").distinct().withColumn("day_", F.to_date("ts"))
    times = times.repartition("day_").withColumn("start", F.lag("ts").over(day)).withColumn("last_", F.max("ts").over(Window.partitionBy("day_")))
    few = times.where(F.col("start").isNull() | (X.seconds(F.col("ts"), F.col("start")) > min_seconds))
    first = few.where("start is null").withColumn("start", F.lag("last_").over(Window.orderBy("day_")))
    out = few.where("start is not null").unionByName(first).select("start", F.col("ts").alias("end"), X.seconds(F.col("ts"), F.col("start")).alias("duration_seconds"))
    return out.where(F.col("duration_seconds") > min_seconds).orderBy("start")


# ---------------------------------------------------------------- anomalies


def faults(events: DataFrame) -> DataFrame:
    """Rejected rows, loaded or not."""
    return events.where(X.rejected()).select("head_id", "ts", "cap_seq", "app_torque", "status", X.conditions().alias("conditions"))


def fault_conditions(events: DataFrame) -> DataFrame:
    """Rejects per condition; a row counts for each one that its status sets."""
    by_status = events.where(X.rejected()).groupBy("status").agg(_tally(events).alias("n"))
    return by_status.select(F.explode(X.conditions()).alias("condition"), "n").groupBy("condition").agg(F.sum("n").alias("count")).orderBy("condition")


def threshold_hits(events: DataFrame, cfg: Config) -> DataFrame:
    return events.where(X.outside(cfg)).select("head_id", "ts", "cap_seq", "app_torque")


def threshold_by_head(events: DataFrame, cfg: Config) -> DataFrame:
    return events.where(X.outside(cfg)).groupBy("head_id").agg(_tally(events).alias("count")).orderBy(F.desc("count"), "head_id")


def deviation_scale(events: DataFrame, cfg: Config) -> DataFrame:
    """(head_id, m, mad, half_iqr, s, basis): median and the robust spread that a head's torque is measured by."""
    counts = counted(events.where(X.loaded()), ["head_id"], F.col("app_torque").cast("double"))
    middle = quantiles(counts, ["head_id"], {"m": 0.5, "q1": 0.25, "q3": 0.75}).withColumn("half_iqr", (F.col("q3") - F.col("q1")) / 2)
    away = counts.join(middle.select("head_id", "m"), "head_id").select("head_id", F.abs(F.col("x") - F.col("m")).alias("x"), "n")
    away = away.groupBy("head_id", "x").agg(F.sum("n").alias("n"))
    both = middle.join(quantiles(away, ["head_id"], {"mad": 0.5}), "head_id")
    spread = F.when(F.col("mad") > 0, F.col("mad")).otherwise(F.col("half_iqr"))
    basis = F.when(F.col("mad") > 0, "mad").when(F.col("half_iqr") > 0, "iqr").otherwise("exact")
    return both.select("head_id", "m", "mad", "half_iqr", F.greatest(F.lit(1.4826) * spread, F.lit(float(cfg.mad_floor))).alias("s"), basis.alias("basis"))


def deviation_hits(events: DataFrame, cfg: Config, scale: DataFrame) -> DataFrame:
    """scale has a row per head, which Spark broadcasts while it is small."""
    caps = events.where(X.loaded()).select("head_id", "ts", "cap_seq", "app_torque")
    far = F.abs(F.col("app_torque").cast("double") - F.col("m")) > F.lit(float(cfg.mad_k)) * F.col("s")
    return caps.join(scale, "head_id").where(far).select("head_id", "ts", "cap_seq", "app_torque", "m", "basis")


def spread_sample(hits: DataFrame, total: int, limit: int) -> DataFrame:
    """At most `limit` of `total` hits, by a fixed stride in time order, so that they span the period.

    Positions come from a count per day and a rank within the day.
    """
    order = ["ts", *(c for c in hits.columns if c not in ("ts", "conditions"))]
    stride = max(1, -(-total // limit))
    day = hits.withColumn("day_", F.to_date("ts"))
    counts = day.groupBy("day_").agg(F.count(F.lit(1)).alias("n_"))
    before = counts.select("day_", F.coalesce(F.sum("n_").over(Window.orderBy("day_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    placed = day.withColumn("at_", F.row_number().over(Window.partitionBy("day_").orderBy(*order)) - 1).join(before, "day_")
    return placed.where((F.col("at_") + F.col("before_")) % stride == 0).orderBy(*order).select(hits.columns).limit(limit)


# ---------------------------------------------------------------- trend, correlation


def bucketed(events: DataFrame, cfg: Config, signal: str, by: str) -> DataFrame:
    """(head_id, bucket, value), in no order."""
    good, bad = _n(F.col("status") == F.lit(cfg.success_status)), _n(X.rejected())
    both = _n((F.col("status") == F.lit(cfg.success_status)) | X.rejected())
    value = F.avg(F.col("app_torque").cast("double")) if signal == "torque" else X.ratio(good, both)
    return events.where(X.loaded()).groupBy(F.col("head_id").cast("int").alias("head_id"), X.truncated(by).alias("bucket")).agg(value.alias("value"))


def series(events: DataFrame, cfg: Config, signal: str, by: str, window: int) -> DataFrame:
    """(head_id, bucket, value, rolling_mean, rolling_std); windows count the buckets that a head has."""
    out = bucketed(events, cfg, signal, by)
    w = Window.partitionBy("head_id").orderBy("bucket").rowsBetween(1 - window, 0)
    return out.withColumn("rolling_mean", F.avg("value").over(w)).withColumn("rolling_std", F.stddev_samp("value").over(w)).orderBy("head_id", "bucket")


def drift(buckets: DataFrame) -> DataFrame:
    """Mann-Kendall per head. A head's buckets, a few thousand hours or days, are one row, and many heads one batch."""
    ship(buckets.sparkSession)
    listed = buckets.groupBy("head_id").agg(F.sort_array(F.collect_list(F.struct("bucket", "value"))).alias("v"))
    found = listed.select("head_id", F.col("v.value").alias("values")).mapInArrow(drifts, DRIFT_SCHEMA)
    return found.orderBy(F.desc(F.abs("tau")), "head_id")


def _bucket_means(events: DataFrame, by: str) -> DataFrame:
    return events.where(X.loaded()).groupBy("head_id", X.truncated(by).alias("bucket")).agg(F.avg(F.col("app_torque").cast("double")).alias("x"))


def correlation(events: DataFrame, by: str, only: list[int] | None = None, least: int = 3) -> DataFrame:
    """(head_a, head_b, shared, r) for each two heads: Pearson of bucket means over the buckets that both have. The pairs of a given
    list of heads, a few, are joined bucket by bucket; those of all heads come of matrix products."""
    means = _bucket_means(events if only is None else events.where(F.col("head_id").isin(only)), by)
    if only is None:
        found = correlations(means.select(F.col("head_id").alias("series"), "bucket", "x"))
        kind = events.schema["head_id"].dataType
        pairs = found.select(F.col("first").cast(kind).alias("head_a"), F.col("second").cast(kind).alias("head_b"), "shared", "r")
    else:
        a = means.select("bucket", F.col("head_id").alias("head_a"), F.col("x").alias("a"))
        b = means.select("bucket", F.col("head_id").alias("head_b"), F.col("x").alias("b"))
        pairs = a.join(b, "bucket").where("head_a < head_b").groupBy("head_a", "head_b").agg(F.count(F.lit(1)).alias("shared"), X.correlation(F.col("a"), F.col("b")).alias("r"))
    return pairs.withColumn("r", F.when(F.col("shared") >= least, F.col("r")))


def correlation_outliers(pairs: DataFrame) -> DataFrame:
    """Heads by their mean correlation with the others, lowest first."""
    both = pairs.select(F.col("head_a").alias("head_id"), "r").unionByName(pairs.select(F.col("head_b").alias("head_id"), "r"))
    return both.where("r is not null").groupBy("head_id").agg(F.avg("r").alias("mean_correlation")).orderBy("mean_correlation", "head_id")


def correlation_outliers_all(events: DataFrame, by: str, least: int = 3) -> DataFrame:
    """correlation_outliers of the pairs of all heads, none of which is made a row."""
    found = mean_correlations(_bucket_means(events, by).select(F.col("head_id").alias("series"), "bucket", "x"), least)
    kind = events.schema["head_id"].dataType
    return found.select(F.col("series").cast(kind).alias("head_id"), F.col("mean").alias("mean_correlation")).orderBy("mean_correlation", "head_id")


# ---------------------------------------------------------------- comparison, filter, factors


def compared(events: DataFrame, cfg: Config, by: str, bounds: tuple[date, date]) -> DataFrame:
    """One row per month or week; calendar days are the bucket's within bounds [first day, day after the last)."""
    x = F.when(X.loaded(), F.col("app_torque").cast("double"))
    if "n" in events.columns:
        many, total = F.sum(F.when(x.isNotNull(), F.col("n"))), F.sum(x * F.col("n"))
        mean = total / many
        spread = F.sqrt(F.greatest(F.try_divide(F.sum(x * x * F.col("n")) - total * mean, (many - 1).cast("double")), F.lit(0.0)))
        spread = F.when(many > 1, spread)
    else:
        mean, spread = F.avg(x), F.stddev_samp(x)
    out = events.groupBy(X.truncated(by).alias("bucket_start")).agg(
        _tally(events).alias("events"),
        _tally(events, X.loaded()).alias("caps"),
        _tally(events, X.successful(cfg)).alias("successful"),
        _tally(events, X.failed()).alias("rejected"),
        _tally(events, X.no_load(cfg)).alias("no_load_cycles"),
        F.count_distinct(F.when(X.loaded(), F.to_date("ts"))).alias("active_days"),
        mean.alias("torque_mean"),
        spread.alias("torque_stddev"),
    )
    bucket = events.withColumn("bucket_start", X.truncated(by))
    out = out.join(quantiles(counted(bucket, ["bucket_start"], x), ["bucket_start"], {"torque_median": 0.5}), "bucket_start", "left")
    start = F.to_date("bucket_start")
    end = F.date_add(start, 7) if by == "week" else F.to_date(F.add_months(start, 1))
    days = F.greatest(F.date_diff(F.least(end, F.lit(bounds[1])), F.greatest(start, F.lit(bounds[0]))), F.lit(0))
    out = out.withColumn("calendar_days", days)
    return (
        out.withColumn("caps_per_day", X.ratio(F.col("caps"), F.col("calendar_days")))
        .withColumn("caps_per_active_day", X.ratio(F.col("caps"), F.col("active_days")))
        .withColumn("reject_rate", X.ratio(F.col("rejected"), F.col("successful") + F.col("rejected")))
        .withColumn("no_load_share", X.ratio(F.col("no_load_cycles"), F.col("caps") + F.col("no_load_cycles")))
        .orderBy("bucket_start")
    )


def filtered(events: DataFrame, cfg: Config, above: float | None, below: float | None, outcome: str, head: int | None) -> DataFrame:
    out = of_outcome(events, cfg, outcome)
    if above is not None:
        out = out.where(F.col("app_torque") > X.real(above))
    if below is not None:
        out = out.where(F.col("app_torque") < X.real(below))
    return out if head is None else out.where(F.col("head_id") == head)


def outcome_of(cfg: Config) -> Column:
    named = F.concat(F.lit("rejected: "), F.array_join(X.conditions(), ", "))
    return F.when(X.rejected(), named).when(F.col("status") == F.lit(cfg.success_status), "ok").otherwise("no verdict")


def first_events(matching: DataFrame, cfg: Config, n: int = 20) -> DataFrame:
    rows = matching.select("head_id", "ts", "cap_seq", "app_torque", "status", outcome_of(cfg).alias("outcome"))
    return rows.orderBy("ts", "cap_seq", "head_id").limit(n)


def by_hour(events: DataFrame, cfg: Config) -> DataFrame:
    out = events.where(X.verdict(cfg)).groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("closures"), _n(X.rejected()).alias("rejected"))
    return out.withColumn("reject_rate", X.ratio(F.col("rejected"), F.col("closures"))).orderBy("hour")


def chi_square(hours: DataFrame) -> DataFrame:
    """One row: does the reject rate vary with the hour?"""
    every = hours.agg(F.sum("rejected").alias("k"), F.sum("closures").alias("n"), F.count(F.lit(1)).alias("hours"))
    joined = hours.crossJoin(F.broadcast(every.select(X.ratio(F.col("k"), F.col("n")).alias("p"), "hours")))  # 24 rows and one
    part = F.pow(F.col("rejected") - F.col("closures") * F.col("p"), 2)
    return joined.agg(F.sum(F.try_divide(part, F.col("closures") * F.col("p") * (1 - F.col("p")))).alias("chi_square"), (F.max("hours") - 1).alias("degrees_of_freedom"))


def zones(events: DataFrame, cfg: Config) -> DataFrame:
    zone = F.when(F.col("app_torque") < X.real(cfg.torque_min), "below").when(F.col("app_torque") > X.real(cfg.torque_max), "above").otherwise("inside")
    out = events.where(X.verdict(cfg)).groupBy(zone.alias("zone")).agg(F.count(F.lit(1)).alias("closures"), _n(X.rejected()).alias("rejected"))
    return out.withColumn("reject_rate", X.ratio(F.col("rejected"), F.col("closures"))).orderBy("zone")


def torque_outcome(events: DataFrame, cfg: Config) -> DataFrame:
    x = F.col("app_torque").cast("double")
    good = F.col("status") == F.lit(cfg.success_status)
    return events.where(X.verdict(cfg)).agg(
        F.count(F.lit(1)).alias("closures"),
        X.correlation(x, F.when(good, 1.0).otherwise(0.0)).alias("correlation"),
        F.avg(F.when(good, x)).alias("mean_torque_successful"),
        F.avg(F.when(X.rejected(), x)).alias("mean_torque_rejected"),
    )
