"""URL filter rules by a sort-merge range join.

A key is a host with its labels reversed, a zero character, and a path. All keys that a rule fits lie in the interval of
keys that begin with the rule's own; as a rule also fits subdomains, a url has a key for each suffix of its host. Urls
(distinct hosts and paths) and rules are dealt out by key range and sorted; one sweep over a range keeps the stack of the
rules whose interval is open, the last one being the longest that fits. A range starts with the rules that are open at
its lower bound, so neither a host nor a rule that covers many ranges is gathered in one task. Only suffixes that some rule's
host equals get a key. A key that many urls share, as `com` and `/`, has several ranges of its own, to which its urls
are dealt by hash; each starts with the rules that are open at that key.

The range bounds come from a sample of keys; they settle where rows go, not what comes out.

Nulls and texts without '://' have host '' and path ''. Of fitting rules the one with the longest host and path together
wins, between equals the one with the longer host; of rules with equal host and path one that blocks. Without a rule the
verdict is DEFAULT. Repeated rows give a row each. No rule: every verdict is DEFAULT.
"""

from __future__ import annotations

import bisect
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclemill.llm.shared import stored, table

DEFAULT = "allow"
#: (host, path, verdict)
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
KEYS_A_RANGE = 50
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROW = "range int, key string, kind int, host string, path string, rule_host string, rule string, verdict string"


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host and path; columns of these names are replaced."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    out = pages.withColumn("rest_", rest).withColumn("host_", host)
    path = F.regexp_extract(F.expr("substring(rest_, length(host_) + 1)"), "^[^?#]*", 0)
    return out.drop("host", "path").withColumn("path", path).withColumn("host", F.translate("host_", _UPPER, _LOWER)).drop("rest_", "host_")


def _keys(df: DataFrame, depths) -> DataFrame:
    """df with key and suffix_, for each depth (number of labels) of its host."""
    labels = F.split("host", "[.]")
    own = df.withColumn("labels_", F.reverse(labels))
    own = own.withColumn("depth_", depths(F.size("labels_"))).withColumn("labels_", F.expr("slice(labels_, 1, depth_)"))
    key = F.concat(F.array_join("labels_", "."), F.lit("\0"), F.col("path"))
    return own.withColumn("key", key).withColumn("suffix_", F.array_join(F.reverse("labels_"), ".")).drop("labels_", "depth_")


def _ranged(bounds: list[str], heavy: dict[str, tuple[int, int]]):
    """heavy: a key's first own range, and how many it has."""

    def run(batches):
        cuts = [b.encode() for b in bounds]
        for batch in batches:
            at = []
            for key, kind, host, path in zip(*(batch.column(c).to_pylist() for c in ("key", "kind", "host", "path")), strict=True):
                first, many = heavy.get(key, (0, 0)) if kind else (0, 0)
                at.append(first + zlib.crc32(f"{host}\0{path}".encode()) % many if many else bisect.bisect_right(cuts, key.encode()))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns[1:]], batch.schema.names)

    return run


def _bounds(found: list[str], parts: int) -> tuple[list[str], dict[str, tuple[int, int]]]:
    """Bounds of ranges out of sampled keys, and the own ranges of keys that take up several of them."""
    cuts = sorted(found, key=lambda x: x.encode())[:: max(1, len(found) // parts)][1:]
    bounds, heavy = list(dict.fromkeys(cuts)), {}
    at = len(bounds) + 1
    for b in bounds:
        if (many := cuts.count(b)) > 1:
            heavy[b] = (at, many)
            at += many
    return bounds, heavy


def _sweep(batches):
    """(host, path, rule_host, rule, verdict) for each key of a url that some rule fits."""
    stack: list[tuple] = []
    last = None
    for batch in batches:
        out = []
        c = batch.to_pydict()
        for here, key, kind, host, path, rule_host, rule, verdict in zip(*c.values(), strict=True):
            if here != last:
                stack, last = [], here
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((key, rule_host, rule, verdict))
            elif stack:
                out.append((host, path, *stack[-1][1:]))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (zip(*out, strict=True) if out else [[]] * 5)], ["host", "path", "rule_host", "rule", "verdict"])


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of the distinct (host, path) in urls that a rule of (host, path, verdict) fits."""
    spark = urls.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    no = F.lit(None).cast("string")
    starts = stored(_keys(rules, lambda n: n).select(F.lit(0).alias("range"), "key", F.lit(0).alias("kind"), no.alias("host"), no.alias("path"), F.col("host").alias("rule_host"), F.concat("host", "path").alias("rule"), "verdict"))
    points = _keys(urls.select("host", "path").distinct(), lambda n: F.explode(F.sequence(F.lit(1), n)))
    points = points.join(starts.select(F.col("rule_host").alias("suffix_")).distinct(), "suffix_", "left_semi")
    points = stored(points.select(F.lit(0).alias("range"), "key", F.lit(1).alias("kind"), "host", "path", no.alias("rule_host"), no.alias("rule"), no.alias("verdict")))
    count = points.count()
    fraction = min(1.0, KEYS_A_RANGE * parts / max(1, count))
    bounds, heavy = _bounds([r["key"] for r in points.select("key").sample(fraction, 11).collect()], parts)
    rows = points.unionByName(starts).mapInArrow(_ranged(bounds, heavy), _ROW)
    if bounds:  # the rules that are open where a range begins
        own = [(first + k, b, len(b)) for b, (first, many) in heavy.items() for k in range(many)]
        heads = spark.createDataFrame([*((i + 1, b, len(b) - 1) for i, b in enumerate(bounds)), *own], "range int, bound string, most int")
        parts_of = "explode(transform(sequence(1, most), n -> substring(bound, 1, n))) as key"
        carried = heads.where("most > 0").selectExpr("range", parts_of).join(starts.drop("range"), "key").select(*rows.columns)
        rows = rows.unionByName(carried)
    swept = rows.repartition(parts, "range").sortWithinPartitions("range", "key", "kind").mapInArrow(_sweep, "host string, path string, rule_host string, rule string, verdict string")
    best = swept.groupBy("host", "path").agg(F.max(F.struct(F.length("rule"), F.length("rule_host"), "rule", "verdict")).alias("b"))
    return best.select("host", "path", "b.rule", "b.verdict")


def judged(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """pages with host, path, rule (null where none fits) and verdict."""
    own = parsed(pages.drop("rule", "verdict"), url)
    return own.join(matched(own, rules), ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judged(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT page_id, regexp_extract(r, '^[^/?#]*') AS h, r FROM rest),
urls AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path FROM cut),
fits AS (SELECT u.*, rule_host || rule_path AS rule, verdict,
  row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC) AS k
  FROM urls u LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1
"""
