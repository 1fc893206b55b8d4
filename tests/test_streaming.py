from pyspark.sql import functions as F
from test_sources import EXPECTED, example

from cyclemill.sources.raw import polls
from cyclemill.sources.store import EventStore
from cyclemill.streaming.live import deduplicated, into_store, live_events


def test_stream_gives_the_batch_events(spark, tmp_path):
    rows = polls(spark, example(tmp_path / "a.csv")).select(F.lit("MCC").alias("machine_id"), "file", F.col("at.row").alias("at"), F.col("ts").cast("timestamp_ntz").alias("ts"), "counts", "torques", "statuses").collect()
    schema = "machine_id string, file string, at long, ts timestamp_ntz, counts array<double>, torques array<double>, statuses array<double>"
    inbox = str(tmp_path / "in")
    store = str(tmp_path / "store")
    for part in (rows[:2], rows[2:4], rows[4:]):  # the state crosses micro-batches
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(inbox)
        feed = spark.readStream.schema(schema).parquet(inbox)
        q = into_store(deduplicated(live_events(feed)), store, str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = EventStore(spark, store).read().orderBy("ts", "head_id").collect()
    assert [(r["head_id"], r["cap_seq"], r["delta"], r["is_fault"], r["aggregated"], r["is_reset"]) for r in got] == [(h, c, d, f, a, x) for h, _, c, _, _, d, f, a, x in EXPECTED]


def poll(file, at, count):
    from datetime import datetime, timedelta

    from cyclemill.schema import HEADS

    return ("MCC", file, at, datetime(2026, 2, 1) + timedelta(seconds=at), [float(count)] * HEADS, [2.0] * HEADS, [0.0] * HEADS)


def test_state_is_freed_and_survives_restarts(spark, tmp_path):
    """Each feed is a query of its own, which goes on from the checkpoint. Two files take turns; once a third is days later, their state
    is gone, and what goes on later begins anew."""
    schema = "machine_id string, file string, at long, ts timestamp_ntz, counts array<double>, torques array<double>, statuses array<double>"
    inbox, store, held = str(tmp_path / "in"), str(tmp_path / "store"), []
    hour = 3600
    feeds = [
        [poll("a", 0, 1), poll("b", 5, 10)],
        [poll("a", 10, 2), poll("a", 20, 4), poll("b", 15, 11)],
        [poll("b", 25, 11), poll("a", 30, 0)],
        [poll("c", 100 * hour, 7)],
        [poll("c", 101 * hour, 8), poll("a", 100 * hour + 1, 50)],
        [poll("a", 102 * hour, 51)],
    ]
    for rows in feeds:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        feed = spark.readStream.schema(schema).parquet(inbox)
        q = into_store(deduplicated(live_events(feed, "2 hours", "1 hour")), store, str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        held.append([s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"] if s["operatorName"].startswith("transformWithState")][-1])
    got = {(r["ts"].hour + 24 * (r["ts"].day - 1), r["ts"].second, r["cap_seq"], r["delta"], r["is_reset"]) for r in EventStore(spark, store).read().where("head_id = 1").collect()}
    assert got == {(0, 10, 2, 1, False), (0, 20, 4, 2, False), (0, 15, 11, 1, False), (0, 30, 0, 0, True), (101, 0, 8, 1, False), (102, 0, 51, 1, False)}
    assert held[2] > held[3] and held[3] < held[0] + 1


def test_stream_equals_batch_over_many_batches(spark, tmp_path):
    import random

    rng = random.Random(4)
    schema = "machine_id string, file string, at long, ts timestamp_ntz, counts array<double>, torques array<double>, statuses array<double>"
    rows, want = [], set()
    for f in ("x", "y"):
        count = last = 5
        for i in range(40):
            count = max(0, count + rng.choice([0, 1, 1, 3, -5]))
            rows.append(poll(f, 100 * i + (f == "y"), count))
            if i and count != last:
                want.add((rows[-1][3], count, max(0, count - last)))
            last = count
    rows.sort(key=lambda r: r[2])
    for k in range(0, len(rows), 16):
        spark.createDataFrame(rows[k : k + 16], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = into_store(deduplicated(live_events(feed)), str(tmp_path / "store"), str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["ts"], r["cap_seq"], r["delta"]) for r in EventStore(spark, str(tmp_path / "store")).read().where("head_id = 3").collect()}
    assert got == want
