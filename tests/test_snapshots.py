"""The store's log: killed and competing writers, old snapshots, upkeep; plans of merge; sweeps over many splits; wrong files."""

import json
import random
import re
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from test_sources import csv, line

from cyclemill.schema import HEADS, RAW_COLUMNS
from cyclemill.sources import extract, raw
from cyclemill.sources.store import EventStore, StoreError

START = datetime(2026, 2, 1)


def rows(spark, source, seconds, head=1, cap=0, machine="MCC"):
    """An event of a head at each of some seconds."""
    from cyclemill.schema import EVENTS

    own = [(machine, head, START + timedelta(seconds=s), cap + s, 1.5, 0.0, 1, False, False, False) for s in seconds]
    return spark.createDataFrame(own, EVENTS).withColumn("source_file", F.lit(source))


def caps(store, **more):
    return sorted(r["cap_seq"] for r in store.read(**more).collect())


def store_at(spark, path, buckets=3):
    return EventStore(spark, str(path), buckets)


def test_old_snapshots_are_read(spark, tmp_path):
    store = store_at(spark, tmp_path / "s")
    store.write(rows(spark, "a", range(5)))
    first = store.read()
    store.write(rows(spark, "b", range(5, 8)))
    store.write(rows(spark, "a", range(2)))  # a is read again
    assert store.versions() == [1, 2, 3]
    assert caps(store) == [0, 1, 5, 6, 7] and caps(store, version=2) == list(range(8)) and caps(store, version=1) == list(range(5))
    assert first.count() == 5  # a reader keeps what it has begun with
    with pytest.raises(StoreError):
        store.read(version=9)
    entry = json.loads((tmp_path / "s/log" / f"{3:020d}.json").read_text())
    assert entry["what"] == "write" and [s["without"] for s in entry["segments"]] == [[["MCC", "a"]], [], []]


def test_a_killed_write_is_not_seen(spark, tmp_path, monkeypatch):
    store = store_at(spark, tmp_path / "s")
    store.write(rows(spark, "a", range(5)))
    failing = rows(spark, "a", range(100, 200)).withColumn("cap_seq", F.when(F.col("cap_seq") < 190, F.col("cap_seq")).otherwise(F.raise_error(F.lit("killed")).cast("long")))
    with pytest.raises(Exception, match="killed"):
        store.write(failing)
    assert caps(store) == list(range(5))

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr("cyclemill.sources.store.created", killed)  # all is written but the entry
    with pytest.raises(KeyboardInterrupt):
        store.write(rows(spark, "b", range(50, 60)))
    monkeypatch.undo()
    assert caps(store) == list(range(5)) and store.versions() == [1]
    assert len(list((tmp_path / "s/data").iterdir())) >= 2
    assert store.vacuum() == []  # a young segment may be another writer's
    assert store.vacuum(hours=0) and caps(store) == list(range(5))
    assert len(list((tmp_path / "s/data").iterdir())) == 1
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("cyclemill_")]


def test_writers_at_once_lose_nothing(spark, tmp_path):
    """Merges that share keys, writes and a tidy at once: no row is lost, none comes twice."""
    store_at(spark, tmp_path / "s").write(rows(spark, "a", range(10)))
    for i in range(3):
        store_at(spark, tmp_path / f"m{i}").write(rows(spark, "x", range(5, 30 + 10 * i), cap=1000 * (i + 1)))

    def do(i):
        own = store_at(spark, tmp_path / "s")
        if i < 3:
            return own.merge([str(tmp_path / f"m{i}")])
        return own.write(rows(spark, f"w{i}", range(100 * i, 100 * i + 3), head=i)) if i < 5 else own.tidy()

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(do, range(6)))
    store = store_at(spark, tmp_path / "s")
    got = store.read().collect()
    assert len(store.versions()) == 7
    assert sorted(r["ts"] for r in got if r["head_id"] == 1) == [START + timedelta(seconds=s) for s in range(50)]
    assert sorted(r["cap_seq"] for r in got if r["cap_seq"] < 10) == list(range(10))  # rows that were here win
    assert sorted(r["cap_seq"] for r in got if r["head_id"] > 1) == [300, 301, 302, 400, 401, 402]
    assert store.tidy().segments[0].rows == len(got) and len(store.snapshot().segments) == 1


def test_merge_moves_no_stored_row(spark, tmp_path):
    store = store_at(spark, tmp_path / "s")
    store.write(rows(spark, "a", range(50)))
    store.write(rows(spark, "b", range(50, 90)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        now = store.snapshot()
        new = store.new_rows(rows(spark, "c", range(80, 120)), now.segments, now.buckets)
        plan = new._jdf.queryExecution().executedPlan().toString()
        assert new.count() == 30
        assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and plan.count("Bucketed: true") == 2
        settled = store_at(spark, tmp_path / "t")
        settled.write(rows(spark, "a", range(50)))
        plan = settled._settled(settled.snapshot(), 3)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_segments_outside_a_period_are_not_opened(spark, tmp_path):
    store = store_at(spark, tmp_path / "s")
    for day in range(3):
        store.write(rows(spark, f"d{day}", range(86400 * day, 86400 * day + 5)))
    now = store.snapshot()
    assert [s.least[:10] for s in now.segments] == ["2026-02-01", "2026-02-02", "2026-02-03"]
    found = store._rows(now, "2026-02-02", "2026-02-02 23:59:59")
    assert len({re.search(r"/data/(\w+)/", f)[1] for f in found.inputFiles()}) == 1 and found.count() == 5
    assert store.export(str(tmp_path / "x"), "2026-02-02", "2026-02-02") == 5


def test_one_file_of_many_splits(spark, tmp_path):
    """A file in many splits gives the changes and counts that a plain pass over its lines gives."""
    rng = random.Random(1)
    lines, count = [], [100] * HEADS
    for i in range(700):
        count = [c + (rng.random() < 0.05) * rng.choice([1, 1, 3, -c]) for c in count]
        ts = f"2026-02-01T{i // 60:02d}:{i % 60:02d}:00.000"
        lines.append(rng.choice(["", " ", "x,1", ",".join(RAW_COLUMNS), line(ts, ["y"])]) if rng.random() < 0.05 else line(rng.choice([ts, ts, ts, "2026-02-01T00:00:00.000"]), count, [round(rng.random(), 3) for _ in range(HEADS)], [rng.choice([0, 65])] * HEADS))
    path = csv(tmp_path / "big.csv", lines)
    want, before, late, valid, skipped, last = [], None, 0, 0, 0, ""
    for text in lines:
        cells = text.split(",")
        if text == "":
            continue
        if len(cells) != len(RAW_COLUMNS) or cells == RAW_COLUMNS or "y" in cells:
            skipped += 1
            continue
        valid, late, last = valid + 1, late + bool(last and cells[0] <= last), cells[0]
        now = [int(c) for c in cells[1 : 1 + HEADS]]
        want += [(h + 1, cells[0], now[h], max(0, now[h] - before[h]), float(cells[1 + HEADS + h])) for h in range(HEADS) if before and now[h] != before[h]]
        before = now
    sizes = {"spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "0"}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        swept = extract.sweep(raw.every_row(spark, path))
    finally:
        for k in sizes:
            spark.conf.unset(k)
    assert swept.where("kind = 1").select("block").distinct().count() > 10
    got = extract.changes(swept).orderBy("at", "head_id").collect()
    assert [(r["head_id"], r["ts"], r["cap_seq"], r["delta"], r["app_torque"]) for r in got] == want
    r = extract.policy_counts(swept).first()
    assert (r["valid"], r["skipped"], r["out_of_order"]) == (valid, skipped, late)


def test_wrong_files_in_a_folder(spark, tmp_path):
    """Each file is checked by itself; a header later in a file, and a line of blanks, is a skipped row."""
    folder = tmp_path / "in"
    folder.mkdir()
    csv(folder / "a.csv", [line("2026-02-01T00:00:00.000", (1,)), ",".join(RAW_COLUMNS), "  ", "", line("2026-02-01T00:00:01.000", (2,))])
    (folder / "b.csv").write_text("timestamp,other\n1,2\n")
    (folder / "c.csv").write_text("")
    with pytest.raises(raw.RawError, match="b.csv"):
        raw.every_row(spark, str(folder), "csv")
    store, refused = store_at(spark, tmp_path / "s"), {}
    assert store.ingest(str(folder), "MCC", "csv", refused) == {"valid": 2, "skipped": 2, "out_of_order": 0}
    assert sorted(f.rsplit("/", 1)[1] for f in refused) in (["b.csv"], ["b.csv", "c.csv"]) and caps(store) == [2]
    with pytest.raises(raw.RawError):
        raw.every_row(spark, str(tmp_path / "nothing"), "csv")


def test_json_files_of_both_kinds_and_wrong_ones(spark, tmp_path):
    def poll(i, **more):
        return dict(zip(RAW_COLUMNS, [f"2026-02-01T00:00:0{i}.000", i, *[0] * 107], strict=True)) | more

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps([poll(1), poll(2)], indent=2))
    (folder / "b.json").write_text("\n" + "\n".join(json.dumps(poll(i)) for i in (3, 4, 5)) + "\n{broken\n")
    r = {x["file"][-6:]: (x["valid"], x["skipped"]) for x in extract.policy_counts(raw.every_row(spark, str(folder), "json")).collect()}
    assert r == {"a.json": (2, 0), "b.json": (3, 1)}
    (folder / "c.json").write_text(json.dumps({k: v for k, v in poll(1).items() if k != "H07 Status"}))
    (folder / "d.json").write_text(json.dumps(poll(1, other=1)))
    (folder / "e.json").write_text("")
    with pytest.raises(raw.RawError, match="H07 Status"):
        raw.every_row(spark, str(folder), "json")
    wrong = {}
    assert extract.changes(raw.every_row(spark, str(folder), "json", wrong.update)).count() == 3
    assert {f[-6:] for f in wrong} >= {"c.json", "d.json"}


def test_parquet_files_of_other_types_and_wrong_ones(spark, tmp_path):
    def table(kind, drop=()):
        cells = [F.lit("2026-02-01T00:00:00.000").alias("timestamp"), *((F.col("id") + 1 if c == "H01 Count" else F.lit(0)).cast(kind).alias(c) for c in RAW_COLUMNS[1:])]
        return spark.range(3).coalesce(1).select(*cells).drop(*drop)

    for name, df in {"a": table("int"), "b": table("double"), "c": table("int", ["H36 Status"]), "d": table("int").withColumn("more", F.lit(1))}.items():
        df.write.parquet(str(tmp_path / f"in/{name}.parquet"))
    with pytest.raises(raw.RawError, match="H36 Status"):
        raw.every_row(spark, str(tmp_path / "in/*"), "parquet")
    wrong = {}
    counts = extract.policy_counts(raw.every_row(spark, str(tmp_path / "in/*"), "parquet", wrong.update)).collect()
    assert len(wrong) == 2 and sorted((r["valid"], r["out_of_order"]) for r in counts) == [(3, 2), (3, 2)]


def test_heads_beyond_32767(spark, tmp_path):
    """A head's number of more than 15 bits goes through write, merge, compaction, readings and export."""
    heads = [1, 32_767, 32_768, 540_000]
    of = lambda source, cap: reduce(DataFrame.unionByName, (rows(spark, source, range(3), head=h, cap=cap) for h in heads))
    one, two = store_at(spark, tmp_path / "one"), store_at(spark, tmp_path / "two")
    one.write(of("a", 0))
    two.write(of("b", 1000).unionByName(rows(spark, "b", [7], head=90_000)))
    one.merge([two.path])
    assert sorted((r["head_id"], r["cap_seq"]) for r in one.read().collect()) == sorted([*((h, s) for h in heads for s in range(3)), (90_000, 7)])
    assert {r["head_id"] for r in one.readings().collect()} == {*heads, 90_000}
    assert one.compact(str(tmp_path / "whole")).count() == 13
    assert one.export(str(tmp_path / "out")) == 13
