"""Preference formatting of chat pairs, with DataFrame operations only.

A pair is a chosen and a rejected conversation. The longest common prefix of their turns (equal role and text) is rendered
once, as the prompt; what follows on each side is its completion. In a completion the spans of assistant turns carry
loss; roles' headers, other turns and the prompt are masked.

A pair without one of its sides is not a pair and gives no row. Pairs with nothing in common have an empty prompt; equal
sides have empty completions and no spans. Null roles and texts are rendered as empty and equal only each other. Turns with
equal numbers are taken in order of role, then text; repeated rows are turns of their own. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclemill.llm.shared import table

HEAD, BODY, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def _head(t: Column) -> Column:
    return F.concat(F.lit(HEAD), F.coalesce(t["role"], F.lit("")), F.lit(BODY))


def _body(t: Column) -> Column:
    return F.concat(F.coalesce(t["text"], F.lit("")), F.lit(END))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def spans(turns: Column) -> Column:
    """array<struct<start, length>>: characters of the rendered turns that carry loss."""
    nothing = F.from_json(F.lit("[]"), "array<struct<start: bigint, length: bigint>>")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), nothing.alias("out"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(_head(t))
        span = F.struct(begin.alias("start"), F.length(_body(t)).cast("bigint").alias("length"))
        return F.struct((begin + F.length(_body(t))).alias("at"), F.when(t["role"] == TRAINED, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(turns, start, step, lambda acc: acc["out"])


def formatted(turns: DataFrame) -> DataFrame:
    """(pair_id, n_common, prompt, chosen, rejected, chosen_spans, rejected_spans) of (pair_id, side, turn, role, text).

    One shuffle by pair: a row of the result holds its two conversations anyway.
    """
    turn = F.struct("turn", "role", "text")
    sides = turns.groupBy("pair_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("side") == s, turn))).alias(s) for s in ("chosen", "rejected")))
    sides = sides.where("size(chosen) > 0 and size(rejected) > 0")
    least = F.least(F.size("chosen"), F.size("rejected"))

    def differ(i: Column) -> Column:
        a, b = F.get("chosen", i), F.get("rejected", i)
        return ~(a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))

    n = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(0), least - 1), differ)), least)
    cut = sides.withColumn("n_common", n)
    after = {s: F.slice(s, F.col("n_common") + 1, F.size(s)) for s in ("chosen", "rejected")}
    cut = cut.select("pair_id", F.col("n_common").cast("long").alias("n_common"), F.slice("chosen", F.lit(1), F.col("n_common")).alias("common"), *(x.alias(s) for s, x in after.items()))
    return cut.select("pair_id", "n_common", rendered(F.col("common")).alias("prompt"), *(rendered(F.col(s)).alias(s) for s in after), *(spans(F.col(s)).alias(f"{s}_spans") for s in after))


def against_next(conversations: DataFrame) -> DataFrame:
    """Pairs out of a table of conversations: each one as chosen; as rejected the same with its last assistant turn's text
    replaced by that of the conversation with the next conv_id (null where there is none)."""
    told = conversations.where(F.col("role") == TRAINED).groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    last = told.select("conv_id", F.col("last.turn").alias("last_turn"))
    other = told.select((F.col("conv_id") - 1).alias("conv_id"), F.col("last.text").alias("other"))
    swap = conversations.join(last, "conv_id", "left").join(other, "conv_id", "left")
    swapped = F.when((F.col("turn") == F.col("last_turn")) & (F.col("role") == TRAINED), F.col("other")).otherwise(F.col("text"))
    both = F.explode(F.array(F.struct(F.lit("chosen").alias("side"), F.col("text").alias("text")), F.struct(F.lit("rejected").alias("side"), swapped.alias("text"))))
    return swap.select(F.col("conv_id").alias("pair_id"), "turn", "role", both.alias("s")).select("pair_id", "turn", "role", "s.side", "s.text")


def op3_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = formatted(against_next(table(spark, sf_dir, "conversations")))
    show = {f"{s}_spans": F.array_join(F.transform(f"{s}_spans", lambda x: F.concat(x["start"].cast("string"), F.lit("+"), x["length"].cast("string"))), ",") for s in ("chosen", "rejected")}
    return found.select(F.col("pair_id").alias("conv_id"), "n_common", "prompt", "chosen", "rejected", *(c.alias(n) for n, c in show.items()))


ORACLE = r"""
WITH told AS (SELECT conv_id, max(turn) AS last_turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
lasts AS (SELECT c.conv_id, c.turn, max(c.text) AS text FROM conversations c JOIN told t ON c.conv_id = t.conv_id AND c.turn = t.last_turn AND c.role = 'assistant' GROUP BY ALL),
turns AS (SELECT c.conv_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn, c.role, c.text) AS k, c.role, c.text,
  CASE WHEN c.turn = l.turn AND c.role = 'assistant' THEN o.text ELSE c.text END AS other
  FROM conversations c LEFT JOIN lasts l ON c.conv_id = l.conv_id LEFT JOIN lasts o ON o.conv_id = c.conv_id + 1),
common AS (SELECT conv_id, coalesce(min(k) FILTER (WHERE text IS DISTINCT FROM other) - 1, count(*)) AS n FROM turns GROUP BY conv_id),
parts AS (SELECT t.conv_id, n, k, role, '<|' || coalesce(role, '') || '|>' || chr(10) AS head,
  coalesce(text, '') || '<|end|>' || chr(10) AS a, coalesce(other, '') || '<|end|>' || chr(10) AS b FROM turns t JOIN common USING (conv_id)),
placed AS (SELECT *, coalesce(sum(length(head) + length(a)) FILTER (WHERE k > n) OVER w, 0) - length(a) AS at_a,
  coalesce(sum(length(head) + length(b)) FILTER (WHERE k > n) OVER w, 0) - length(b) AS at_b
  FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY k))
SELECT conv_id, CAST(n AS BIGINT) AS n_common,
  coalesce(string_agg(head || a, '' ORDER BY k) FILTER (WHERE k <= n), '') AS prompt,
  coalesce(string_agg(head || a, '' ORDER BY k) FILTER (WHERE k > n), '') AS chosen,
  coalesce(string_agg(head || b, '' ORDER BY k) FILTER (WHERE k > n), '') AS rejected,
  coalesce(string_agg(CAST(at_a AS BIGINT) || '+' || length(a), ',' ORDER BY k) FILTER (WHERE k > n AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(CAST(at_b AS BIGINT) || '+' || length(b), ',' ORDER BY k) FILTER (WHERE k > n AND role = 'assistant'), '') AS rejected_spans
FROM placed GROUP BY conv_id, n
"""
