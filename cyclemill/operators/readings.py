"""Events counted by reading: a table that adds up, so that it is kept beside the events and never made anew.

A row stands for n events of a machine, head and day with equal torque, status and reset flag. `ts` is the begin of the day,
first and last are the events' times. Analyses that ask for no more than the day (overview, rates, torque, spreads, months
and weeks) read it in place of the events: frames that are given it weigh each row with n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = "machine_id string, source_file string, head_id int, ts timestamp_ntz, app_torque float, status float, is_reset boolean, n bigint, first timestamp_ntz, last timestamp_ntz"
_KEY = ["machine_id", "source_file", "head_id", "day_", "app_torque", "status", "is_reset"]


def readings(events: DataFrame) -> DataFrame:
    """Of events with source_file."""
    rows = events.withColumn("day_", F.to_date("ts"))
    out = rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return out.select("machine_id", "source_file", "head_id", F.col("day_").cast("timestamp_ntz").alias("ts"), "app_torque", "status", "is_reset", "n", "first", "last")
