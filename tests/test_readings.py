"""Analyses off readings give what they give off the events, also of a store with segments, hidden files and later days."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cyclemill.config import Config
from cyclemill.operators import analyses as T
from cyclemill.operators.readings import readings
from cyclemill.schema import EVENTS
from cyclemill.sources.store import EventStore

START = datetime(2026, 1, 20)


def some(spark, source, days, seed):
    rng = random.Random(seed)
    rows = []
    for d in days:
        for i in range(60):
            status = rng.choice([0.0, 0.0, 0.0, 2.0, 65.0, 9.0, 4.0])
            torque = None if rng.random() < 0.03 else 0.0 if status == 2.0 else round(rng.gauss(2.0, 0.05), 2) if rng.random() < 0.95 else 9.0
            rows.append(("MCC", rng.randint(1, 5), START + timedelta(days=d, seconds=1000 * i + rng.randint(0, 99)), i, torque, status, 1, int(status) % 2 == 1, False, rng.random() < 0.02))
    return spark.createDataFrame(rows, EVENTS).withColumn("source_file", F.lit(source))


def alike(a, b, at=""):
    if isinstance(a, dict):
        assert a.keys() == b.keys(), at
        for k in a:
            alike(a[k], b[k], f"{at}.{k}")
    elif isinstance(a, list):
        assert len(a) == len(b), at
        for i, (x, y) in enumerate(zip(a, b)):
            alike(x, y, f"{at}[{i}]")
    elif isinstance(a, float):
        assert b == pytest.approx(a, rel=1e-9, abs=1e-9), at
    else:
        assert a == b, at


STEPS = [
    (T.overview, {}),
    (T.success_rates, {"by": "head"}),
    (T.success_rates, {"by": "day"}),
    (T.success_rates, {"by": "overall"}),
    *((T.torque_stats, {"outcome": o, "by": b}) for o in ("successful", "failed", "all") for b in (None, "head")),
    (T.compare_periods, {"by": "month"}),
    (T.compare_periods, {"by": "week"}),
    (T.anomalies, {"method": "both"}),
]


def test_readings_and_events_agree(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"), 2)
    store.write(some(spark, "a", range(10), 1))
    store.write(some(spark, "b", range(10, 20), 2))
    before = store.readings().count()
    store.write(some(spark, "a", range(5), 3))  # a is read again, with fewer days
    assert store.readings(2).count() == before
    events, kept = store.read().persist(), store.readings().persist()
    assert kept.agg(F.sum("n")).first()[0] == events.count() and kept.count() < events.count()
    cfg = Config(torque_min=1.5, torque_max=2.5)
    plain, counted = T.Session(cfg, events), T.Session(cfg, events, kept)
    for period in ("2026-01", "2026-01..2026-02", "2025-05"):
        for tool, args in STEPS if period != "2025-05" else STEPS[:2]:
            a, b = tool(plain, period, **args), tool(counted, period, **args)
            assert (a.status, a.provenance.rows_scanned) == (b.status, b.provenance.rows_scanned)
            alike(a.values, b.values, f"{tool.__name__} {args} {period}")


def test_days_beside_readings_open_no_event(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"), 2)
    store.write(some(spark, "a", range(3), 1))
    store.write(some(spark, "b", range(3, 4), 2))
    assert all("/_readings/" in f for f in store.readings().inputFiles()) and len({f.split("/_readings/")[0] for f in store.readings().inputFiles()}) == 2


def test_no_readings(spark, tmp_path):
    assert EventStore(spark, str(tmp_path / "none")).readings().count() == 0
    assert readings(some(spark, "a", [], 1)).count() == 0
