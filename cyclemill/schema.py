"""Columns of the raw day-files and of the event table."""

from __future__ import annotations

from pyspark.sql import types as T

HEADS = 36
RAW_COLUMNS = ["timestamp"] + [f"H{h:02d} {kind}" for kind in ("Count", "AppTorque", "Status") for h in range(1, HEADS + 1)]

EVENTS = T.StructType(
    [
        T.StructField("machine_id", T.StringType()),
        T.StructField("head_id", T.IntegerType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("cap_seq", T.LongType()),
        T.StructField("app_torque", T.FloatType()),
        T.StructField("status", T.FloatType()),
        T.StructField("delta", T.IntegerType()),
        T.StructField("is_fault", T.BooleanType()),
        T.StructField("aggregated", T.BooleanType()),
        T.StructField("is_reset", T.BooleanType()),
    ]
)
#: Two rows with these three equal are one event. The counter resets, so it is no part of it.
KEY = ["machine_id", "head_id", "ts"]

#: Status bits and what the controller means by them.
CONDITIONS = {2: "No Load", 4: "No Closure", 8: "No InTorque", 16: "No CapTurns", 32: "Following Error", 64: "Bad Closure"}
