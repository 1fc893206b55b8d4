"""Repaired conversations against a plain search for the cheapest audit, and long ones that lie in several tasks."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from cyclemill.llm import conversation_repair as repair
from cyclemill.llm import shared

SCHEMA = "conv_id long, turn long, role string, text string, kind int, place int, audit string"
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")
WHITE = " \t\n\x0b\x0c\r"


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, turns): the ASCII-least of the cheapest audits, by trying them in the order of cost and audit."""
    faults = faults_of(rows)
    heap, done = [(0, "", 0, ())], {}
    while heap:
        cost, audit, i, turns = heapq.heappop(heap)
        initials = "".join(r[:1] for r, _ in turns)
        if i == len(rows) and GRAMMAR.match(initials):
            return cost, audit, turns
        key = (i, initials[-1:], "s" in initials and len(initials) == 1)
        if done.setdefault(key, (cost, audit)) < (cost, audit) and done[key][0] < cost:
            continue
        ways = [("I", i, 2, (r, "")) for r in ("user", "assistant")]
        if i < len(rows):
            role, text = rows[i]
            late = faults[i] == "truncated"
            ways.append(("D", i + 1, 3, None))
            if faults[i] not in ("blank", "duplicate"):
                ways += [("K", i + 1, late, (role, text))] + [("R", i + 1, 2 + late, (r, text)) for r in ("user", "assistant")]
        for edit, j, more, turn in ways:
            after = turns + (turn,) if turn else turns
            if re.match(r"(s?(ua)*u?)\Z", "".join(r[:1] or "-" for r, _ in after)):
                heapq.heappush(heap, (cost + more, audit + edit, j, after))


def plain(rows):
    """One conversation's results, of (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    said = [(r, t) for _, r, t in rows]
    faults, turns = faults_of(said), [t for t, _, _ in rows if t is not None]
    illegal = sum((a[:1] + b[:1]) not in ("su", "ua", "au") for (a, _), (b, _) in zip(said, said[1:]))
    cost, audit, kept = cheapest(said)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest), kept


def by_conversation(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return out


@pytest.fixture(scope="module")
def some():
    rng = random.Random(7)
    roles = ["system", "user", "user", "assistant", "assistant", "tool", None, "", "ustad"]
    texts = ["Hello.", "Why?", "no end", "", " \n", None, "Yes! ", "aé日.", "same same."]
    rows = [(c, rng.choice([None, *range(n + 2)]), rng.choice(roles), rng.choice(texts)) for c in range(120) for n in [rng.randint(1, 7)] for _ in range(n)]
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (500, None, None, None), (501, -(2**62), "user", "x."), (501, 2**62, "assistant", "y."), (502, 3, "user", "z" * 300_000), (502, 3, "user", "z" * 300_000)]
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(parts)


def test_repair(spark, some):
    shared.ship(spark)
    want = {c: plain(rows) for c, rows in by_conversation(some).items()}
    rows = repair.turns(frame(spark, some))
    found = shared.stored(repair.audits(rows))
    got = {r[0]: tuple(r[1:]) for r in repair.digests(rows, found).collect()}
    assert got == {c: w for c, (w, _) in want.items()}
    turns = {}
    for r in sorted(repair.rebuilt(rows, found).collect(), key=lambda r: r.place):
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    assert {c: tuple(t) for c, t in turns.items()} == {c: t for c, (_, t) in want.items() if t}


def test_long_conversation_in_many_tasks(spark):
    """One conversation holds most rows; its parts meet at any state. Compared with one pass over all of it."""
    rng = random.Random(11)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "system", "tool"]), rng.choice(["Same.", f"t{t}.", f"cut {t}", ""])) for t in range(3000) for _ in range(rng.choice([1, 1, 1, 2]))]
    rows += [(c, t, "user", "Hi.") for c in (0, 2) for t in range(2)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = repair.turns(frame(spark, rows))
        order = ["conv_id", "turn", "role", "digest"]
        spread = repair.cells(turns).repartitionByRange(*order).where("conv_id = 1").select(F.spark_partition_id()).distinct().count()
        assert spread >= 3
        got = {r[0]: tuple(r[1:]) for r in repair.digests(turns, shared.stored(repair.audits(turns))).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    said = sorted([(t, r, x) for c, t, r, x in rows if c == 1], key=lambda r: (r[0], r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    said = [(r, t) for _, r, t in said]
    faults = faults_of(said)
    kinds = "".join("d" if f in ("blank", "duplicate") else (k.upper() if f else k) for f, (r, _) in zip(faults, said) for k in [r[0] if r[0] in "sua" else "x"])
    after = repair.END
    for k in reversed(kinds):
        after, _ = repair.step(after, k)
    assert got[1][5] == after[0]
    assert got[1][6] == repair.walk(kinds, repair.END, True)[1][0]
    assert got[0] == plain([(t, "user", "Hi.") for t in range(2)])[0]
    assert got[1][1:4] == tuple(faults.count(f) for f in ("blank", "duplicate", "truncated"))


def test_damage_and_sql_on_odd_rows(spark, some):
    rows = some + [(c, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for c in range(600, 640) for t in range(6)]
    df = frame(spark, rows)
    hits = {(c, t): zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 for c, t, _, _ in rows}
    assert {hits[k] for k in hits} >= {0, 1, 2, 3, 4}
    turns = repair.damaged(df)
    got = {r[0]: tuple(r[1:]) for r in repair.digests(turns, shared.stored(repair.audits(turns))).collect()}
    after = {c: [] for c, *_ in rows}
    for c, t, r, x in rows:
        h, r, x = hits[(c, t)], " " if r is None else r, " " if x is None else x
        if h:
            after[c] += [(t, "user" if h == 4 else r, "" if h == 1 else re.sub("[.!?]", "", x) if h == 2 else x)] * (2 if h == 3 else 1)
    empty = (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())
    assert got == {c: plain(a)[0] if a else empty for c, a in after.items()}
    con = duckdb.connect()
    conversations = df.select("conv_id", "turn", "role", "text").toArrow()  # noqa: F841
    sql = con.execute(repair.ORACLE).fetchall()
    names = [d[0] for d in con.description]
    assert {r[0]: tuple(r[1:]) for r in sql} == got and names[1:] == [*repair.TOTALS, "audit", "repaired_sha256"]


def test_no_rows(spark):
    assert repair.audits(repair.turns(frame(spark, []))).collect() == []
