"""Hard negatives against a plain search over all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cyclemill.llm import hard_negatives, shared

SCHEMA = "vec_id long, embedding array<float>, label int, size int, cell int, n string"


def plain(rows):
    """rows of (vec_id, embedding, label), by loops."""
    good = []
    for i, v, y in rows:
        if y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(256 * float(np.float32(x))) for x in v]
        if sum(x * x for x in w) < 2**62:
            good.append((i, tuple(w), (y + 1) % 10 if i is not None and i % 7 == 0 else y))
    last = float("inf")
    out = []
    for a, v, y in sorted({r for r in good if r[0] is not None and r[0] % 100 == 0}):
        others = sorted((-sum(p * q for p, q in zip(v, w)), last if i is None else i, z) for i, w, z in good if i != a)
        for s, p, _ in [r for r in others if r[2] == y][:5]:
            fit = [r for r in others if r[2] != y and -30 * s <= -100 * r[0] <= -90 * s][:10]
            out += [(a, None if p == last else p, k + 1, None if i == last else i, -s, -t) for k, (t, i, _) in enumerate(fit)]
    return sorted(out, key=str)


def mined(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(parts)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    df = hard_negatives.whole(df).select("vec_id", moved.alias("label"), F.col("embedding").alias("v"), "size", "cell", "n")
    got = hard_negatives.mine(df, F.col("vec_id") % 100 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.fixture(scope="module")
def some(spark):
    shared.ship(spark)
    rng = np.random.default_rng(3)
    near = rng.normal(size=(6, 8))
    return [(i, [float(x) for x in near[i % 6] + rng.normal(size=8) * 0.7], int(rng.integers(0, 4))) for i in range(700)]


def test_odd_rows(spark, some):
    hot = [(1000 + i, [1.0, 0.5], i % 3) for i in range(300)]  # anchors among them, ties everywhere
    odd = [(2000, None, 1), (2001, [1.0, None], 1), (2002, [float("nan"), 1.0], 1), (2003, [float("inf")], 1), (2100, [1.0] * 8, None), (2004, [3e38] * 8, 1), (2200, [], 1), (2005, [], 2), (None, [2.0] * 8, 1), (None, [2.0] * 8, 2), (2300, [-1.0] * 12, 3), (2300, [-1.0] * 12, 3), (2006, [-1.0] * 12, 3), (2006, [-1.0] * 12, 3), (2007, [0.3] * 12, 2), (2301, [-0.2] * 3, 2), (-100, [0.5] * 8, 1)]
    rows = some + hot + odd
    want = plain(rows)
    assert len(want) > 500
    assert mined(spark, rows) == want


def test_many_groups_parts_and_large_numbers(spark, some, monkeypatch):
    """Small groups, parts, cells and samples, so that every bound takes effect; and scores beyond what doubles hold exactly."""
    for name, value in {"GROUP": 2, "PART": 50, "PIVOTS": 9, "SAMPLE": 40}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    assert mined(spark, some) == plain(some)
    large = [(i, [x * 2.0**20 for x in v], y) for i, v, y in some[:250]]
    assert mined(spark, large) == plain(large)


def test_bounds_leave_out_rows_that_cannot_serve(spark):
    """With vectors in far heaps an anchor's blocks are few, and hold all its best rows."""
    rng = np.random.default_rng(5)
    heaps = rng.normal(size=(12, 6)) * 8
    x = np.floor(256 * (heaps[np.arange(1200) % 12] + rng.normal(size=(1200, 6)) * 0.05))
    df = shared.stored(spark.createDataFrame([(i, 0, [int(v) for v in r]) for i, r in enumerate(x)], "vec_id long, label long, v array<int>"))
    where = hard_negatives.space(df)
    rows = hard_negatives.placed(df, where).collect()
    where.low, where.high = np.full((len(where.pivots), hard_negatives.RINGS), np.inf), np.full((len(where.pivots), hard_negatives.RINGS), -np.inf)
    for r in rows:
        where.low[r.cell, r.ring] = min(where.low[r.cell, r.ring], r.distance)
        where.high[r.cell, r.ring] = max(where.high[r.cell, r.ring], r.distance)
    sent = kept = 0
    for a in range(0, 1200, 100):
        scores = x @ x[a]
        least = np.sort(scores)[-6]
        serves = where.blocks(x[a : a + 1], np.array([least]), np.array([np.inf]))[0]
        assert all(serves[r.cell, r.ring] for r in rows if scores[r.vec_id] >= least)
        sent, kept = sent + sum(bool(serves[r.cell, r.ring]) for r in rows), kept + 1200
    assert sent < 0.5 * kept


def test_no_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0], 1)]) == []
    assert mined(spark, [(100, [1.0], 1), (1, [1.0], 1)]) == []
