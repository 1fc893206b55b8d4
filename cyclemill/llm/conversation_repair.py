"""Repair of the structure of conversations by the cheapest edits.

A repaired conversation is empty, or an optional system turn and then pairs of user and assistant. Edits of a row: K keeps it, R
makes it one of user or assistant, D deletes it (blank rows and those seen before must go); I inserts an empty turn. The cost
to go, for each state of the grammar, is found backwards over the rows; forwards the edit that comes first in ASCII is taken
among those on a cheapest way, so that of equally cheap audits the ASCII-least is found. The turns are then rebuilt.

No conversation is gathered to be repaired. Rows are sorted in ranges, so a long conversation lies in several tasks. A task gives its
part as a string with a letter for each row and as a (min, +) matrix of costs from state to state; a conversation's matrices,
as many as tasks at most, give the cost to go at the end of each part; each part is walked from each state it may be entered
in, and the walks are joined up. Texts move once, when the turns are rebuilt, a stream in which only a batch is held. Two
things follow the length of one conversation, as the results ask for them: its audit is one string, and SHA-256 goes over its
text from the start to the end, in one task.

Rows are taken by turn, nulls first, those of one turn by role and then by the SHA-256 of the text; equal rows are rows each, of
which the later ones are duplicates. A null role or text is one space. A null conv_id is a conversation. An empty role has no
initial and is never kept. A conversation whose rows were all taken away, and one of which all are deleted, is empty. Gaps
end at 2**63 - 1. Other columns are left alone. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclemill.llm.shared import stored, table

SEEN = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
LEGAL = ("su", "ua", "au")
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States: nothing yet, after system, after user, after assistant. A conversation may end in the first and the last.
KEEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEW = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
NEVER = 1 << 60
Costs = tuple[int, int, int, int]


def _settled(base: list[int]) -> Costs:
    """Costs to go with turns inserted first; two in a row are the most that pay."""
    user = min(base[2], INSERT + base[3])
    return tuple(min(x, NEVER) for x in (min(base[0], INSERT + user), min(base[1], INSERT + user), user, min(base[3], INSERT + base[2])))


@functools.cache
def _edits(after: Costs, kind: str) -> tuple[Costs, str]:
    """Costs to go before a row, and for each state the first edit of a cheapest way."""
    ways: list[dict[str, int]] = []
    for state in range(4):
        way = {"D": DELETE + after[state]}
        if kind != "d":
            late = TRUNCATED * kind.isupper()
            if kind.lower() in KEEPS[state]:
                way["K"] = late + after[KEEPS[state][kind.lower()]]
            way["R"] = REROLE + late + after[NEW[state][0]]
        ways.append(way)
    costs = _settled([min(w.values()) for w in ways])
    for state, way in enumerate(ways):
        way["I"] = INSERT + costs[NEW[state][0]]
    return costs, "".join(min((e for e in w if w[e] <= costs[state]), default="D") for state, w in enumerate(ways))


def step(after: Costs, kind: str) -> tuple[Costs, str]:
    """kind: d for a row that must go, else s, u, a or x by its role's initial, upper case if it is truncated. Costs differ from their
    least by one of a few patterns, so a row is a lookup."""
    least = min(after)
    costs, edits = _edits(tuple(x - least if x < NEVER else NEVER for x in after), kind)
    return tuple(x + least if x < NEVER else NEVER for x in costs), edits


END = _settled([0, NEVER, NEVER, 0])


def crossing(kinds: str) -> list[int]:
    """Costs over some rows: for each state at their end, from each state at their start."""
    out: list[int] = []
    for end in range(4):
        costs: Costs = tuple(0 if i == end else NEVER for i in range(4))
        for kind in reversed(kinds):
            costs, _ = step(costs, kind)
        out += costs
    return out


def before(matrix: list[int], after: Costs) -> Costs:
    return tuple(min(NEVER, *(matrix[4 * end + state] + after[end] for end in range(4))) for state in range(4))


def walk(kinds: str, after: Costs, last: bool) -> tuple[list[int], list[str]]:
    """For each state at the start of some rows, the state at their end and the edits on the way."""
    edits: list[str] = []
    costs = after
    for kind in reversed(kinds):
        costs, found = step(costs, kind)
        edits.append(found)
    edits.reverse()
    ends, audits = [], []
    for state in range(4):
        audit = []
        for kind, choice in zip(kinds, edits, strict=True):
            while choice[state] == "I":
                audit.append("I")
                state = NEW[state][0]
            audit.append(choice[state])
            state = {"D": lambda s, _: s, "K": lambda s, k: KEEPS[s][k.lower()], "R": lambda s, _: NEW[s][0]}[choice[state]](state, kind)
        while last and state in (1, 2):
            audit.append("I")
            state = NEW[state][0]
        ends.append(state)
        audits.append("".join(audit))
    return ends, audits


def turns(df: DataFrame, times: Column | None = None) -> DataFrame:
    """(conv_id, turn, role, text, digest, times) of rows (conv_id, turn, role, text). times: how often a row stands there; 0 only names
    its conversation."""
    out = df.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.lit(1) if times is None else times).cast("long").alias("times"))
    return out.withColumn("digest", F.sha2("text", 256))


def cells(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn as one, with n, what is wrong with them, and whether an earlier turn had them."""
    some = rows.select("conv_id", "turn", "role", "digest", "times", (~F.col("text").rlike(SEEN)).alias("blank"), (~F.col("text").rlike(ENDED)).alias("truncated"))
    each = stored(some.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("times").alias("n"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated")))
    at = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    again = each.where("n > 0").groupBy("conv_id", "role", "digest").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1")
    again = again.select(F.col("conv_id").alias("conv_"), F.col("role").alias("role_"), F.col("digest").alias("digest_"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("conv_")) & (F.col("role") == F.col("role_")) & (F.col("digest") == F.col("digest_"))
    return each.join(again, same, "left").select("conv_id", "turn", "role", "digest", "n", "blank", "truncated", F.coalesce(at > F.col("first"), F.lit(False)).alias("seen"))


PART = "part int, kinds string, matrix array<long>, blank long, duplicate long, truncated long, illegal long, first string, last string, turns long, first_turn long, last_turn long"


def _parts(batches):
    """A row for each conversation that a task has rows of, as far as it has them."""
    now, held = object(), {}

    def done():
        kinds = "".join(held.pop("kinds"))
        return {"part": TaskContext.get().partitionId(), "kinds": kinds, "matrix": crossing(kinds)} | held

    fields: list[pa.Field] = []
    for batch in batches:
        if not fields:
            fields = [batch.schema.field("conv_id"), *(pa.field(n, {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}.get(t, pa.list_(pa.int64()))) for n, t in (x.split(" ") for x in PART.split(", ")))]
        out = []
        for conv, turn, role, n, blank, truncated, seen in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "n", "blank", "truncated", "seen")), strict=True):
            if conv != now or not held:
                if held:
                    out.append({"conv_id": now} | done())
                now, held = conv, {"kinds": [], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "first": None, "last": None, "turns": 0, "first_turn": None, "last_turn": None}
            if not n:
                continue
            initial = role[:1]
            if held["first"] is None:
                held["first"] = initial
            else:
                held["illegal"] += held["last"] + initial not in LEGAL
            held["illegal"] += (n - 1) * (2 * initial not in LEGAL)
            held["last"] = initial
            if turn is not None and turn != held["last_turn"]:
                held["turns"] += 1
                held["first_turn"] = turn if held["first_turn"] is None else held["first_turn"]
                held["last_turn"] = turn
            alone = not blank and not seen
            held["blank"] += n * blank
            held["duplicate"] += 0 if blank else n - alone
            held["truncated"] += alone and truncated
            kind = initial if initial in ("s", "u", "a") else "x"
            held["kinds"].append(((kind.upper() if truncated else kind) if alone else "d") + "d" * (n - 1))
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema(fields))
    if held:
        yield pa.RecordBatch.from_pylist([{"conv_id": now} | done()], pa.schema(fields))


TOTALS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _totals(batches):
    """Totals of each conversation, and the cost to go at the end of each of its parts."""
    for batch in batches:
        out: dict[str, list] = {n: [] for n in [*TOTALS, "ends"]}
        for parts in batch.column("parts").to_pylist():
            after, ends = END, []
            for p in reversed(parts):
                ends.append({"part": p["part"], "after": list(after), "final": not ends})
                after = before(p["matrix"], after)
            full = [p for p in parts if p["first"] is not None]
            dated = [p for p in parts if p["turns"]]
            turns = sum(p["turns"] for p in dated) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(dated, dated[1:], strict=False))
            out["gaps"].append(min(2**63 - 1, dated[-1]["last_turn"] - dated[0]["first_turn"] + 1 - turns) if dated else 0)
            for n in ("blank", "duplicate", "truncated"):
                out[n].append(sum(p[n] for p in parts))
            out["illegal"].append(sum(p["illegal"] for p in parts) + sum(a["last"] + b["first"] not in LEGAL for a, b in zip(full, full[1:], strict=False)))
            out["cost"].append(after[0])
            out["ends"].append(ends)
        kinds = [pa.int64()] * len(TOTALS) + [pa.list_(pa.struct({"part": pa.int32(), "after": pa.list_(pa.int64()), "final": pa.bool_()}))]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], ["conv_id", *out])


def _walks(batches):
    for batch in batches:
        found = [walk(k, tuple(a), last) for k, a, last in zip(*(batch.column(c).to_pylist() for c in ("kinds", "after", "final")), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.string()))], ["conv_id", "part", "ends", "edits"])


def _joined(batches):
    for batch in batches:
        audits = []
        for parts in batch.column("parts").to_pylist():
            state, audit = 0, []
            for p in parts:
                audit.append(p["edits"][state])
                state = p["ends"][state]
            audits.append("".join(audit))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(audits, pa.string())], ["conv_id", "audit"])


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation of turns()."""
    conv = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}"
    order = ["conv_id", "turn", "role", "digest"]
    parts = stored(cells(rows).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_parts, f"{conv}, {PART}"))
    few = F.struct(*(n for n in (x.split(" ")[0] for x in PART.split(", ")) if n != "kinds"))
    gathered = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(few)).alias("parts"))  # a part for each task at most
    schema = f"{conv}, {', '.join(f'{n} long' for n in TOTALS)}, ends array<struct<part int, after array<long>, final boolean>>"
    totals = stored(gathered.mapInArrow(_totals, schema))
    ends = totals.select(F.col("conv_id").alias("conv_"), F.explode("ends").alias("e")).select("conv_", F.col("e.part").alias("part_"), "e.after", "e.final")
    known = parts.join(ends, F.col("conv_id").eqNullSafe(F.col("conv_")) & (F.col("part") == F.col("part_"))).select("conv_id", "part", "kinds", "after", "final")
    walked = known.mapInArrow(_walks, f"{conv}, part int, ends array<int>, edits array<string>")
    audit = walked.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "ends", "edits"))).alias("parts")).mapInArrow(_joined, f"{conv}, audit string")
    return totals.join(audit.withColumnRenamed("conv_id", "conv_"), F.col("conv_id").eqNullSafe(F.col("conv_"))).select("conv_id", *TOTALS, "audit")


def _streamed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """A conversation's audit, then its rows in their order. A task holds whole conversations."""
    none = {"turn": "long", "role": "string", "text": "string", "digest": "string", "times": "long"}
    heads = found.select("conv_id", F.lit(0).alias("kind"), *(F.lit(None).cast(t).alias(n) for n, t in none.items()), *TOTALS, "audit")
    body = rows.where("times > 0").select("conv_id", F.lit(1).alias("kind"), *none, *(F.lit(None).cast("long").alias(n) for n in TOTALS), F.lit(None).cast("string").alias("audit"))
    return heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest").drop("turn", "digest")


def _edited(batches):
    """(edit, role, text) of each repaired turn, after (None, totals, None) of its conversation."""
    audit, at, state = "", 0, 0

    def inserted():
        nonlocal at, state
        while audit[at : at + 1] == "I":
            at, (state, role) = at + 1, NEW[state]
            yield "I", role, ""

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("kind", "role", "text", "times", "audit", "conv_id", *TOTALS)), strict=True):
            kind, role, text, times, own = row[:5]
            if not kind:
                yield from inserted()
                audit, at, state = own, 0, 0
                yield None, row[4:], None
                continue
            for _ in range(times):
                yield from inserted()
                edit, at = audit[at], at + 1
                if edit == "R":
                    state, new = NEW[state]
                    yield edit, new, text
                elif edit == "K":
                    state = KEEPS[state][role[0]]
                    yield edit, role, text
    yield from inserted()


def rebuilt(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit) of the repaired turns; found is audits(rows)."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        out, size, conv, place, schema = [], 0, None, 0, None
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([first.schema.field("conv_id"), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
        for edit, role, text in _edited(x for part in ([first], batches) for x in part):
            if edit is None:
                conv, place = role[1], 0
                continue
            out.append({"conv_id": conv, "place": place, "role": role, "text": text, "edit": edit})
            place, size = place + 1, size + len(text)
            if size > 1 << 22 or len(out) > 10_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return _streamed(rows, found).mapInArrow(run, f"conv_id {kind}, place long, role string, text string, edit string")


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """found with repaired_sha256, of the repaired turns as role:text, a line feed between two."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["audit", "conv_id", *TOTALS]

    def run(batches):
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([*(first.schema.field(n) for n in names), ("repaired_sha256", pa.string())])
        out, digest, lines = [], None, 0
        for edit, role, text in _edited(x for part in ([first], batches) for x in part):
            if edit is None:
                if out:
                    out[-1]["repaired_sha256"] = digest.hexdigest()
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
                out.append(dict(zip(names, role, strict=True)))
                digest, lines = hashlib.sha256(), 0
            else:
                digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                lines += 1
        if out:
            out[-1]["repaired_sha256"] = digest.hexdigest()
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = f"audit string, conv_id {kind}, {', '.join(f'{n} long' for n in TOTALS)}, repaired_sha256 string"
    return _streamed(rows, found).mapInArrow(run, schema).select("conv_id", *TOTALS, "audit", "repaired_sha256")


def damaged(df: DataFrame) -> DataFrame:
    """turns() of conversations with a fifth of the rows damaged, by crc32 of `conv_id:turn`."""
    space = F.lit(" ")
    hit = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    text = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return turns(df.select("conv_id", "turn", F.when(hit == 4, "user").otherwise(role).alias("role"), text.alias("text"), hit.alias("hit")), F.when(F.col("hit") == 0, 0).when(F.col("hit") == 3, 2).otherwise(1))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations"))
    return digests(rows, stored(audits(rows)))


def _oracle() -> str:
    def best(*ways: str) -> str:
        return f"list_sort(list_filter([{', '.join(ways)}], lambda x: x.c is not null))[1]"

    def way(cost: str, edit: str, line: str, rest: str) -> str:
        lines = f"list_prepend({line}, {rest}.t)" if line else f"{rest}.t"
        return f"{{'c': {cost} + {rest}.c, 'e': '{edit}' || {rest}.e, 't': {lines}}}"

    after = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    new = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
    base = []
    for s in range(4):
        late = "case when must then null else late end"
        keeps = [way(f"case when not must and initial = '{i}' then late end", "K", "role || ':' || text", f"f{to}") for i, to in after[s].items()]
        base.append(best(way("3", "D", "", f"f{s}"), *keeps, way(f"2 + ({late})", "R", f"'{new[s][1]}:' || text", f"f{new[s][0]}")) + f" as b{s}")
    return f"""
with recursive polynomials as (
  select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n)) as p
), hit as materialized (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, xor(list_reduce(list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: ascii(c)::bigint), lambda c, b: xor(c >> 8, p[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 as hit
  from conversations, polynomials
), damaged as (
  select conv_id, turn, case when hit = 4 then 'user' else role end as role, case when hit = 1 then '' when hit = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case hit when 0 then 0 when 3 then 2 else 1 end)) as copy
  from hit
), placed as (
  select conv_id, turn, role, text, left(role, 1) as initial, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as i, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as again
  from damaged
), faults as materialized (
  select *, not regexp_matches(text, '[^\\x20\\x09-\\x0D]') as blank, not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') as cut, lag(initial) over (partition by conv_id order by i) || initial as pair from placed
), rows as materialized (
  select conv_id, i, role, text, initial, blank or again > 1 as must, (cut and not blank and again = 1)::bigint as late from faults
), counts as (
  select conv_id, least(coalesce(max(turn)::hugeint - min(turn) + 1 - count(distinct turn), 0), 9223372036854775807) as gaps, count(*) filter (blank) as blank, count(*) filter (not blank and again > 1) as duplicate, count(*) filter (not blank and again = 1 and cut) as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, count(*) as n
  from faults group by conv_id
), ways as (
  select conv_id, n as i, {{'c': 0::bigint, 'e': '', 't': []::varchar[]}} as f0, {{'c': 4::bigint, 'e': 'II', 't': ['user:', 'assistant:']}} as f1, {{'c': 2::bigint, 'e': 'I', 't': ['assistant:']}} as f2, {{'c': 0::bigint, 'e': '', 't': []::varchar[]}} as f3
  from counts
  union all
  select conv_id, i, {best('b0', way('2', 'I', "'user:'", 'f2'))}, {best('b1', way('2', 'I', "'user:'", 'f2'))}, f2, {best('b3', way('2', 'I', "'user:'", 'b2'))}
  from (
    select *, {best('b2', way('2', 'I', "'assistant:'", 'b3'))} as f2
    from (select w.conv_id, w.i - 1 as i, {', '.join(base)} from ways w join rows r on r.conv_id is not distinct from w.conv_id and r.i = w.i)
  )
)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(f0.c, 0)::bigint as cost, coalesce(f0.e, '') as audit, sha256(coalesce(array_to_string(f0.t, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counts c on c.conv_id is not distinct from o.conv_id left join ways w on w.conv_id is not distinct from o.conv_id and w.i = 0
"""


ORACLE = _oracle()
