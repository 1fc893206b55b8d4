"""Places that one of several writers gets, on a local file system and by a path that only Spark's file systems open."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from cyclemill.sources import files


@pytest.fixture(params=["", "viewfs"])
def root(request, spark, tmp_path):
    if request.param:
        spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.files.link./in", f"file://{tmp_path}")
        return "viewfs://files/in"
    return str(tmp_path)


def test_created_once(spark, root):
    assert not files.names_in(spark, f"{root}/log")
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda i: files.created(spark, f"{root}/log/1.json", f"text {i} é" * 1000), range(16)))
    assert got.count(True) == 1
    assert files.text_of(spark, f"{root}/log/1.json") == f"text {got.index(True)} é" * 1000
    assert files.names_in(spark, f"{root}/log") == ["1.json"]
    assert files.first_bytes(spark, f"{root}/log/1.json", 4) == b"text"


def test_moved_once(spark, root):
    for i in range(4):
        spark.range(i).coalesce(1).write.parquet(f"{root}/aside-{i}")
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda i: files.moved(spark, f"{root}/aside-{i}", f"{root}/place"), range(4)))
    assert got.count(True) == 1 and spark.read.parquet(f"{root}/place").count() == got.index(True)
    assert not [n for n in files.names_in(spark, f"{root}/place") if n.startswith("aside")]
    assert [files.exists(spark, f"{root}/aside-{i}") for i in range(4)] == [not x for x in got]
