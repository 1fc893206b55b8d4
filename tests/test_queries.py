import os
import statistics

import duckdb
import pytest
from conftest import SF
from pyspark.sql import functions as F

from cyclemill import queries as Q
from cyclemill import raw_queries as R
from cyclemill.operators import frames as A


def plain(v):
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def same(df, con, sql):
    q = con.execute(sql)
    names = [d[0] for d in q.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(repr([plain(r[names.index(c)]) for c in sorted(names)]) for r in q.fetchall())
    assert sorted(repr([plain(r[c]) for c in sorted(names)]) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, duck, name):
    df = Q.queries()[name](spark, SF)
    if name in Q.oracle_sql():
        same(df, duck, Q.oracle_sql()[name])
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", sorted(R.queries()))
def test_raw_query(spark, duck, name):
    df = R.queries()[name](spark, SF)
    assert df.count() > 0
    same(df, duck, R.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_quantiles_against_lists(spark):
    """Quantiles off counts are those of the rows; groups of one row, ties, and a null value, which counts nowhere."""
    import numpy as np

    rows = [(g, x) for g, xs in {"a": [1.5], "b": [2.0, 2.0, 2.0, 9.0], "c": [0.1 * i for i in range(37)] * 3, None: [4.0, 1.0]}.items() for x in xs] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r for r in A.quantiles(A.counted(df, ["g"], F.col("x")), ["g"], {"low": 0.25, "mid": 0.5, "high": 0.75}).collect()}
    for g in {g for g, _ in rows}:
        xs = [x for h, x in rows if h == g and x is not None]
        assert [got[g]["low"], got[g]["mid"], got[g]["high"]] == pytest.approx(np.quantile(xs, [0.25, 0.5, 0.75]).tolist(), abs=1e-12)
    assert A.quantiles(A.counted(df, [], F.col("x")), [], {"mid": 0.5}).first()["mid"] == pytest.approx(statistics.median(x for _, x in rows if x is not None))


def test_filters_reach_the_scan(spark):
    plan = Q.queries()["success_by_head"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan and "props" not in plan


def test_correlation_of_all_heads(spark, duck):
    path = SF.replace("sf0.001", "sf0.01")
    own = {}
    day_means = """SELECT user_id, ts::DATE, avg(value::REAL::DOUBLE) FROM '{}/events.parquet' WHERE event_type <> 'view' AND value > 0 GROUP BY 1, 2"""
    for head, day, x in duck.execute(day_means.format(path)).fetchall():
        own.setdefault(head, {})[day] = x
    want, means = {}, {}
    for a in own:
        for b in own:
            both = sorted(own[a].keys() & own[b].keys())
            if a < b and both:
                x, y = [own[a][d] for d in both], [own[b][d] for d in both]
                r = statistics.correlation(x, y) if len(both) > 2 else None
                want[a, b] = (len(both), r)
                for h in (a, b):
                    means.setdefault(h, []).append(r)
    got = {(r.head_a, r.head_b): (r.shared, r.r) for r in Q.queries()["head_correlation_all"](spark, path).collect()}
    assert got.keys() == want.keys() and max(b for _, b in got) > 41
    assert all(got[k][0] == n and got[k][1] == (None if r is None else pytest.approx(r, abs=2e-6)) for k, (n, r) in want.items())
    outliers = {r.head_id: r.mean_correlation for r in Q.queries()["correlation_outliers_all"](spark, path).collect()}
    for h, rs in means.items():
        if rs := [r for r in rs if r is not None]:
            assert outliers.pop(h) == pytest.approx(sum(rs) / len(rs), abs=2e-6)
    assert not outliers


def test_rounding_is_sparks(spark):
    """Value by value, zeros' signs, halves and numbers that aren't any with them; and few rows go by way of decimals."""
    from cyclemill.functions import exprs as X

    odd = [0.0, -0.0, -1e-7, 5e-7, -5e-7, 1.5e-6, 2.5e-6, 0.1234565, -0.1234575, 999.9999995, 1000.0, 1234567.1234565, 1e300, float("nan"), float("inf"), -float("inf"), None]
    near = spark.range(20_000).select((F.col("id") / 10_000 - 1 + 5e-7 * (F.col("id") % 2) + 1e-15 * (F.col("id") % 3)).alias("x"))
    wide = spark.range(20_000).select((F.randn(7) * F.pow(F.lit(10.0), F.col("id") % 12 - 6)).alias("x"))
    for df in (spark.createDataFrame([(x,) for x in odd], "x double"), near, wide):
        got = df.select("x", X.rounded(F.col("x"), 6).cast("string").alias("a"), F.round("x", 6).cast("string").alias("b"))
        assert got.where(~F.col("a").eqNullSafe(F.col("b"))).collect() == []
