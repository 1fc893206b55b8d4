import os
import sys
from datetime import datetime, timedelta

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

from pyspark.sql import SparkSession  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


START = datetime(2026, 2, 1)


@pytest.fixture
def event_table(spark):
    """A table of events from (head, seconds after the start or a time, torque, status)."""
    from cyclemill.schema import EVENTS

    def make(rows, machine="MCC"):
        out = []
        for i, (head, at, torque, status, *more) in enumerate(rows):
            ts = at if isinstance(at, datetime) else START + timedelta(seconds=at)
            out.append((machine, head, ts, i + 1, torque, float(status), 1, int(status) % 2 == 1, False, bool(more and more[0])))
        return spark.createDataFrame(out, EVENTS)

    return make


TINY = [(1, 0, 2.0, 0), (1, 10, 2.1, 0), (1, 20, 1.9, 0), (2, 0, 2.0, 0), (2, 30, 1.99, 65), (2, 40, 1.95, 9), (3, 0, 0.0, 2), (3, 1, 0.0, 2)]
