"""Keys of rows whatever df they come of, hot keys of urls, chains that many GIF heads share, batches committed at once."""

import struct
import time
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from cyclemill.llm import media, mixing, near_dedup, shared, token_rollups, url_rules

SF = "/root/testdata/sf0.001"


def frames(spark):
    """The same rows, twice each: stored, and as they come out of an explode, a union, a join and Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0).union(spark.read.parquet(f"{SF}/documents.parquet")).where("doc_id < 40")
    plain = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    twice = plain.withColumn("again", F.explode(F.array(F.lit(1), F.lit(2)))).drop("again")
    yield "stored", shared.stored(twice)
    yield "explode", twice
    yield "union", plain.union(docs)
    yield "join", plain.join(F.broadcast(spark.range(2).withColumnRenamed("id", "k_")), F.col("k_") >= 0).drop("k_")
    yield "python", twice.mapInArrow(lambda batches: batches, twice.schema)


def test_keys_of_rows_that_are_no_plain_scan(spark):
    shared.ship(spark)
    mixes, firsts = {}, {}
    for name, df in frames(spark):
        assert Counter(r.row_key_ for r in shared.keyed(df).select("row_key_").collect()).most_common(1)[0][1] == 1, name
        assert df.count() == 80, name
        if name not in ("stored", "explode"):
            continue
        mixes[name] = Counter(r.source for r in mixing.repeated(df).select("source").collect())
        firsts[name] = Counter(r.doc_id for r in near_dedup.deduplicated(df).select("doc_id").collect())
    assert all(m == mixes["stored"] for m in mixes.values())
    assert all(f == firsts["stored"] for f in firsts.values())
    assert firsts["stored"].most_common(1)[0][1] == 1
    plain = spark.read.parquet(f"{SF}/documents.parquet")
    assert shared._is_scan(plain.where("doc_id > 3").select("doc_id")) and not shared._is_scan(plain.withColumn("x", F.rand()))


def test_many_rows_go_by_a_shuffle(spark, monkeypatch):
    """The rows to leave out or to repeat are joined by a shuffle, and are the same."""
    for module in (shared, mixing, near_dedup):
        monkeypatch.setattr(module, "MAX_IDS", 0)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    again = Counter(r.doc_id for r in mixing.repeated(docs).select("doc_id").collect())
    want = {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}
    assert again == want
    kept = {r.doc_id for r in near_dedup.link(docs).where("kept").collect()}
    assert {r.doc_id for r in near_dedup.deduplicated(docs).select("doc_id").collect()} == kept


def test_hot_key_of_urls(spark):
    """4000 hosts under com, all with the path /: their common key is dealt to several ranges, and each url keeps its rule."""
    pages = spark.createDataFrame([(i, f"https://h{i}.com/") for i in range(4000)] + [(9000 + i, f"http://x.org/p{i}") for i in range(50)], "page_id long, url string")
    rules = spark.createDataFrame([("com", "/", "block"), ("h7.com", "/", "allow"), ("com", "", "allow"), ("net", "/", "block")], "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judged(pages, rules).collect()}
    assert got[7] == ("h7.com/", "allow") and got[9001] == (None, "allow")
    assert {got[i] for i in range(4000) if i != 7} == {("com/", "block")}
    sample = ["com\0/"] * 350 + [f"com.h{i}\0/" for i in range(50)]
    bounds, heavy = url_rules._bounds(sample, 8)
    first, many = heavy["com\0/"]
    assert many >= 6 and first == len(bounds) + 1
    import pyarrow as pa

    rows = pa.RecordBatch.from_pydict({"range": pa.array([0] * 4000, pa.int32()), "key": ["com\0/"] * 4000, "kind": [1] * 4000, "host": [f"h{i}.com" for i in range(4000)], "path": ["/"] * 4000})
    ranges = Counter(next(url_rules._ranged(bounds, heavy)([rows])).column("range").to_pylist())
    assert len(ranges) == many and max(ranges.values()) < 1.3 * 4000 / many


def gif(comment=b""):
    """A picture of one point, with a comment before it."""
    blocks = b"".join(bytes([len(comment[i : i + 255])]) + comment[i : i + 255] for i in range(0, len(comment), 255))
    more = b"!\xfe" + blocks + b"\0" if comment else b""
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + more + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\0;"


def test_gif_chains(spark):
    small = gif()
    assert media.carve(small) == [(0, len(small), "image/gif")] or media.carve(small)[0][:2] == (0, len(small))
    with_comment = gif(b"hello " * 100)
    spans = media.carve(b"xx" + with_comment + b"yy" + small + small)
    assert [(s[0], s[1]) for s in spans] == [(2, len(with_comment)), (4 + len(with_comment), len(small)), (4 + len(with_comment) + len(small), len(small))]
    inner = gif(gif(b"inside") * 3)  # files in a comment lie in one found before
    assert len(media.carve(inner)) == 1
    assert [s[1] for s in media.carve(inner[:-1] + b"?" + small)][-1] == len(small)


def test_gif_heads_take_time_in_proportion():
    """Heads without an end whose comments swallow the heads after them."""
    head = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"!\xfe\x0d"
    took = []
    for n in (20_000, 80_000):
        start = time.process_time()
        assert media.carve(head * n) == []
        took.append(time.process_time() - start)
    assert took[1] < 12 * max(took[0], 0.1)


def test_a_batch_committed_at_once_has_one_winner(spark, tmp_path):
    schema = "seq int, op string, doc_id long, source string, lang string, version string, tokens long"
    stores = [token_rollups.Rollups(spark, str(tmp_path / "r")) for _ in range(3)]
    changes = [spark.createDataFrame([(1, "insert", 1, "s", "en", "v", 10 + i)], schema) for i in range(3)]
    with ThreadPoolExecutor(3) as pool:
        won = list(pool.map(lambda i: stores[i].commit(1, changes[i]), range(3)))
    assert won.count(True) == 1
    assert [r.tokens for r in stores[0].totals().collect()] == [10 + won.index(True)]
    assert sorted(p.name for p in (tmp_path / "r").iterdir()) == ["batches", "buckets"]
    assert sorted(p.name for p in (tmp_path / "r/batches/batch=1").iterdir()) == ["kind=delta", "kind=ledger"]


def test_batches_put_together(spark, tmp_path):
    """Totals and later batches are as before; a merged batch stays committed, also when its folder is gone; new ids read few rows."""
    schema = "seq int, op string, doc_id long, source string, lang string, version string, tokens long"

    def changes(*rows):
        return spark.createDataFrame([(1, op, i, "s", "en", "v", n) for op, i, n in rows], schema)

    store = token_rollups.Rollups(spark, str(tmp_path / "r"), buckets=4)
    plain = {}
    batches = [[("insert", i, i) for i in range(60)], [("revise", i, 100) for i in range(0, 60, 3)] + [("delete", i, 0) for i in range(1, 60, 3)], [("insert", i, 7) for i in range(55, 90)], [("delete", 0, 0), ("insert", 1, 5)]]
    for k, batch in enumerate(batches):
        assert store.commit(k + 1, changes(*batch))
        for op, i, n in batch:
            plain.pop(i, None)
            if op != "delete":
                plain[i] = n
        if k in (1, 2):
            store.compact()
            assert token_rollups.Rollups(spark, str(tmp_path / "r"), buckets=9).buckets == 4
        if k == 2:
            store.drop_merged()
            assert [p.name for p in (tmp_path / "r/batches").iterdir()] == ["merged=000000000003"]
        assert [(r.docs, r.tokens) for r in store.totals().collect()] == [(len(plain), sum(plain.values()))]
        assert store.committed() == list(range(1, k + 2)) and not store.commit(1, changes(("insert", 5000, 1)))
    ledger = store._read("ledger", "doc_id long, source string, lang string, version string, docs long, tokens long, bucket int")
    assert {r.doc_id: r.t for r in ledger.groupBy("doc_id").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t")).where("d > 0").collect()} == plain
