"""Column expressions that several analyses share."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclemill.config import Config
from cyclemill.schema import CONDITIONS

def loaded() -> Column:
    return F.col("app_torque") > 0


def rejected(status: str = "status") -> Column:
    """Bit 0 of a status. A status beyond the whole numbers counts as a reject."""
    return F.coalesce(F.expr(f"try_cast({status} as bigint) % 2 <> 0"), F.col(status).isNotNull())


def successful(cfg: Config) -> Column:
    return (F.col("status") == F.lit(cfg.success_status)) & loaded()


def failed() -> Column:
    return rejected() & loaded()


def no_load(cfg: Config) -> Column:
    return (F.col("status") == F.lit(cfg.no_load_status)) & (F.col("app_torque") == 0)


def verdict(cfg: Config) -> Column:
    return loaded() & ((F.col("status") == F.lit(cfg.success_status)) | rejected())


def outside(cfg: Config) -> Column:
    """Torque outside the band; limits are doubles, as the band's always were."""
    x = F.col("app_torque").cast("double")
    return loaded() & ((x < F.lit(float(cfg.torque_min))) | (x > F.lit(float(cfg.torque_max))))


def real(x: float) -> Column:
    """A limit in the sensor's 32 bits."""
    return F.lit(float(x)).cast("float")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def rounded(x: Column, places: int) -> Column:
    """F.round, value by value the same. That rounds the number as it is written, halves up, by way of decimals, which takes a
    microsecond a row; here only large numbers and those near a half go that way."""
    scaled = x * F.lit(10.0**places)
    whole = F.rint(scaled)
    plain = (F.abs(x) < 1000) & (F.abs(scaled - whole) < 0.499)
    return F.when(plain, whole / F.lit(10.0**places) + F.lit(0.0)).otherwise(F.round(x, places))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r; null where either doesn't vary."""
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def seconds(later: Column, earlier: Column) -> Column:
    """Second boundaries between two times."""
    return F.unix_seconds(later.cast("timestamp")) - F.unix_seconds(earlier.cast("timestamp"))


def truncated(unit: str, ts: str = "ts") -> Column:
    return F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz")


def conditions(status: str = "status") -> Column:
    """Names of the bits that a status sets; 'unspecified' where it sets none of them."""
    bits = F.expr(f"coalesce(try_cast({status} as bigint), 0)")
    found = F.filter(F.array(*(F.when(bits.bitwiseAND(F.lit(b)) != 0, F.lit(n)) for b, n in CONDITIONS.items())), lambda c: c.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unspecified")))


_MONTH = re.compile(r"(\d{4})-(\d{1,2})\Z")


def period_bounds(period: str | None) -> tuple[date, date] | None:
    """First day and the day after the last of 'YYYY-MM' or 'YYYY-MM..YYYY-MM'."""
    if period is None:
        return None
    ends = []
    for part in (period.split("..") if ".." in period else [period] * 2):
        m = _MONTH.match(part.strip())
        if not m or not 1 <= int(m[2]) <= 12:
            raise ValueError(f"a period is YYYY-MM or YYYY-MM..YYYY-MM, not {period!r}")
        ends.append(date(int(m[1]), int(m[2]), 1))
    if len(ends) != 2 or ends[0] > ends[1]:
        raise ValueError(f"the period {period!r} runs backwards or has not two ends")
    return ends[0], (ends[1] + timedelta(days=32)).replace(day=1)


def scope(events: DataFrame, cfg: Config, period: str | None) -> DataFrame:
    """The machine's events in the period. Plain comparisons, so they reach the scan."""
    out = events.where(F.col("machine_id") == cfg.machine_id)
    if bounds := period_bounds(period):
        lo, hi = (F.lit(d.isoformat()).cast("timestamp_ntz") for d in bounds)
        out = out.where((F.col("ts") >= lo) & (F.col("ts") < hi))
    return out
