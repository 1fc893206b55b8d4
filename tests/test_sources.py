import json

import pytest
from pyspark.sql import functions as F

from cyclemill.schema import HEADS, RAW_COLUMNS
from cyclemill.sources.extract import changes, csv_rows
from cyclemill.sources.raw import RawError, policy_counts, polls, raw_format
from cyclemill.sources.store import EventStore, StoreError


def line(ts, counts, torques=(), statuses=()):
    def pad(x):
        return [str(v) for v in x] + ["0"] * (HEADS - len(x))

    return ",".join([ts, *pad(counts), *pad(torques), *pad(statuses)])


def csv(path, lines, end="\n", header=None):
    path.write_bytes((end.join([header or ",".join(RAW_COLUMNS), *lines]) + end).encode())
    return str(path)


EXAMPLE = [("100", "50", 0, 0), ("100", "50", 0, 0), ("101", "50", 0, 0), ("101", "53", 0, 65), ("0", "53", 0, 65)]


def example(path, end="\n"):
    return csv(path, [line(f"2026-02-01T00:00:0{i}.000", (a, b), (2.5, 2.25), (s1, s2)) for i, (a, b, s1, s2) in enumerate(EXAMPLE)] + [""], end)


def found(spark, path):
    rows = changes(polls(spark, path)).orderBy("at", "head_id").collect()
    return [(r["head_id"], r["ts"][-6:], r["cap_seq"], r["app_torque"], r["status"], r["delta"], r["is_fault"], r["aggregated"], r["is_reset"]) for r in rows]


EXPECTED = [(1, "02.000", 101, 2.5, 0.0, 1, False, False, False), (2, "03.000", 53, 2.25, 65.0, 3, True, True, False), (1, "04.000", 0, 2.5, 0.0, 0, False, False, True)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_documented_example(spark, tmp_path, end):
    path = example(tmp_path / "a.csv", end)
    assert found(spark, path) == EXPECTED
    assert policy_counts(polls(spark, path)).first()["skipped"] == 0


def test_three_formats_agree(spark, tmp_path):
    rows = list(zip((100, 101, 103, 104), (1.5, 1.75, 2.5, 0.5), (0, 0, 0, 1), strict=True))
    csv(tmp_path / "t.csv", [line(f"2026-02-27T16:00:0{i}.000", (c,), (t,), (s,)) for i, (c, t, s) in enumerate(rows)])
    table = [dict(zip(RAW_COLUMNS, [f"2026-02-27 16:00:0{i}", c, *[0] * 35, t, *[0.0] * 35, s, *[0] * 35], strict=True)) for i, (c, t, s) in enumerate(rows)]
    (tmp_path / "t.jsonl").write_text("\n".join(json.dumps(r) for r in table))
    (tmp_path / "t.json").write_text(json.dumps(table, indent=1))
    typed = spark.read.csv(str(tmp_path / "t.csv"), header=True, inferSchema=True)
    typed.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    want = found(spark, str(tmp_path / "t.csv"))
    assert [(r[2], r[5], r[6]) for r in want] == [(101, 1, False), (103, 2, False), (104, 1, True)]
    for name in ("t.jsonl", "t.json", "t.parquet"):
        assert found(spark, str(tmp_path / name)) == want, name


@pytest.mark.parametrize(
    "lines, valid, skipped",
    [
        (["short,1", line("b", ("abc",)), line("c", (1,))], 1, 2),
        ([line("a", (c,)) for c in ("100", "1e18", "inf", "nan", "101")], 2, 3),
        ([line("a", (1,), (t,)) for t in ("1e300", "inf", "nan", "2")], 1, 3),
        ([line("a", (1,)) + ",7", line("b", (1,))], 1, 1),
        ([line("a", ("1d",)), line("b", ("0x1",)), line("c", (" 1 ",))], 1, 2),
    ],
)
def test_row_policy(spark, tmp_path, lines, valid, skipped):
    r = policy_counts(polls(spark, csv(tmp_path / "b.csv", lines))).first()
    assert (r["valid"], r["skipped"]) == (valid, skipped)


def test_order_is_the_files(spark, tmp_path):
    path = csv(tmp_path / "o.csv", [line(f"10:00:0{s}", (i,)) for i, s in enumerate((1, 0, 0, 2))])
    r = policy_counts(polls(spark, path)).first()
    assert (r["valid"], r["out_of_order"], r["skipped"]) == (4, 2, 0)
    assert [x[2] for x in found(spark, path)] == [1, 2, 3]


def test_invalid_rows_make_no_event(spark, tmp_path):
    path = csv(tmp_path / "i.csv", [line("a", (5,)), line("b", ("x",)), line("c", (6,)), line("d", (3e9,))])
    assert [(x[2], x[5], x[7]) for x in found(spark, path)] == [(6, 1, False), (3000000000, 2147483647, True)]


def test_columns_are_checked(spark, tmp_path):
    with pytest.raises(RawError):
        polls(spark, csv(tmp_path / "h.csv", [line("a", (1,))], header="timestamp,x"))
    swapped = [RAW_COLUMNS[0], RAW_COLUMNS[2], RAW_COLUMNS[1], *RAW_COLUMNS[3:]]
    with pytest.raises(RawError):
        polls(spark, csv(tmp_path / "s.csv", [line("a", (1,))], header=",".join(swapped)))
    (tmp_path / "x.json").write_text('{"timestamp": "a", "other": 1}')
    with pytest.raises(RawError):
        polls(spark, str(tmp_path / "x.json"))
    assert [raw_format(p) for p in ("a.PARQUET", "a.ndjson", "a.txt")] == ["parquet", "json", "csv"]


def test_csv_sink(spark, tmp_path):
    rows = csv_rows(changes(polls(spark, example(tmp_path / "c.csv"))))
    assert rows.columns[-3:] == ["is_fault", "aggregated", "reset"] and dict(rows.dtypes)["app_torque"] == "double"
    assert [r["reset"] for r in rows.collect()] == [0, 0, 1]


def test_store(spark, tmp_path):
    raw, store = example(tmp_path / "d1.csv"), EventStore(spark, str(tmp_path / "store"))
    assert store.ingest(raw, "MCC") == {"valid": 5, "skipped": 0, "out_of_order": 0}
    assert store.count() == 3
    store.ingest(raw, "MCC")
    assert store.count() == 3  # the file's partition is replaced
    store.ingest(example(tmp_path / "copy.csv"), "MCC")
    assert store.count() == 6 and store.read(dedup=True).count() == 3
    assert store.compact(str(tmp_path / "small")).count() == 3
    merged = EventStore(spark, str(tmp_path / "merged"))
    assert merged.merge([str(tmp_path / "store"), str(tmp_path / "nothing")]) and merged.count() == 3
    merged.merge([str(tmp_path / "small")])
    assert merged.count() == 3
    with pytest.raises(StoreError):
        EventStore(spark, str(tmp_path / "empty")).read()


def test_export(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"))
    store.ingest(example(tmp_path / "e.csv"), "MCC")
    assert store.export(str(tmp_path / "x"), "2026-02-01 00:00:03", "2026-02-01") == 2
    assert store.export(str(tmp_path / "none"), "2027-01-01") == 0 and spark.read.parquet(str(tmp_path / "none")).count() == 0
    with pytest.raises(StoreError):
        store.export(str(tmp_path / "x"))


def test_other_identity_is_refused(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"))
    store.ingest(example(tmp_path / "f.csv"), "MCC")
    spark.range(1).select(F.lit('{"identity": "machine_id,head_id,cap_seq"}').alias("value")).write.mode("overwrite").text(str(tmp_path / "store/_meta"))
    with pytest.raises(StoreError):
        EventStore(spark, str(tmp_path / "store"))


def test_clean_to_csv(spark, tmp_path, capsys):
    from cyclemill.__main__ import main

    into = str(tmp_path / "out")
    assert main(["clean", example(tmp_path / "a.csv"), into], spark) == 0
    assert json.loads(capsys.readouterr().out)["valid"] == 5
    got = spark.read.option("header", True).csv(into)
    assert got.columns == ["head_id", "ts", "cap_seq", "app_torque", "status", "delta", "is_fault", "aggregated", "reset"]
    rows = [(int(r["head_id"]), r["ts"][-6:], int(r["cap_seq"]), float(r["app_torque"]), float(r["status"]), int(r["delta"]), *(r[c] == "1" for c in ("is_fault", "aggregated", "reset"))) for r in got.collect()]
    assert sorted(rows) == sorted(EXPECTED)
    assert main(["clean", example(tmp_path / "a.csv"), into], spark) == 1
    assert not [p for p in tmp_path.iterdir() if ".part" in p.name]


def test_publishing_a_failure_leaves_nothing(spark, tmp_path):
    from cyclemill.sources.store import publish

    def fail(half):
        spark.range(3).write.parquet(half)
        raise ValueError("half way")

    with pytest.raises(ValueError):
        publish(spark, str(tmp_path / "x"), fail)
    assert list(tmp_path.iterdir()) == []
