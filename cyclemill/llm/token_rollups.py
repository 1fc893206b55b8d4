"""Token counts kept up by deltas: totals by source, language and tokenizer version.

A batch of changes (inserts, deletes, revised counts) becomes signed ledger rows, found by a join with what the ledger
holds of the same documents, and their sums, the batch's delta. Totals are the sum of the deltas of all committed batches.
The ledger lies in parts by the documents' hash, and in each in the order of ids: a batch reads the parts that its documents
fall in, of these the stretch from its least id to its greatest, and keeps the rows of its documents alone before it adds
anything up. Ledger and delta are written aside and committed together by one rename that
replaces nothing; a batch that is sent again after that changes nothing. Of several that commit the same batch at once, one
wins and the others are told; different batches must be committed one after another, as each builds on what was before.
Many batches are put together as one from time to time (compact), which says whose rows it holds; a batch that is in it is
still known as committed.

Documents are told apart by doc_id. An insert of a document that is there, or a revision of one that is not, sets its count; a
delete of one that is not there does nothing. Of several changes of a document and version in a batch, repeated rows too, the
one with the highest seq holds; between equal ones the largest tokens, then the least op, source and language, null last. Null
source and language are groups of their own; null tokens count 0; rows with a null doc_id or version are left out. Null
and empty texts have no tokens but are documents. An empty batch is committed and changes nothing. Other columns are passed
over.
"""

from __future__ import annotations

import functools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cyclemill.llm.packing import classes, document_ids, word_ids
from cyclemill.llm.shared import WORD, shared_dir, slices, stored, table, utf8
from cyclemill.sources.files import created, deleted, exists, moved, names_in, text_of

GROUP = ["source", "lang", "version"]
#: Tokenizer versions that Spark counts by itself: a token is a match.
VERSIONS = {"words-1": WORD, "pieces-2": r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"}

#: Parts of a new ledger, which keeps their number; one should suit a task.
BUCKETS = 64
_LEDGER = "doc_id long, source string, lang string, version string, docs long, tokens long"


def counts(docs: DataFrame, versions: dict[str, str] = VERSIONS) -> DataFrame:
    """(doc_id, source, lang, version, tokens) of each document by each version."""
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("version"), F.coalesce(F.regexp_count("text", F.lit(p)), F.lit(0)).cast("long").alias("tokens")) for v, p in versions.items())))
    return docs.select("doc_id", "source", "lang", each.alias("t")).select("doc_id", "source", "lang", "t.version", "t.tokens")


def tokenizer_counts(docs: DataFrame, version: str, path: str) -> DataFrame:
    """(doc_id, source, lang, version, tokens): ids by a tokenizer file that packing.WordIds can read, special ones left out."""
    kinds = classes(path)

    def run(batches):
        for batch in batches:
            ids = word_ids(path, kinds)
            for a, b in slices(batch.column("text")):
                _, ends = document_ids(utf8(batch.column("text").slice(a, b - a)), ids)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), part.column("lang"), pa.array([version] * (b - a)), pa.array(np.diff(ends, prepend=0) - 1)], ["doc_id", "source", "lang", "version", "tokens"])

    return docs.select("doc_id", "source", "lang", "text").mapInArrow(run, "doc_id long, source string, lang string, version string, tokens long")


class Rollups:
    """Totals in a folder that driver and executors share. buckets: parts of the ledger, if it is new."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self._buckets = spark, path.rstrip("/"), buckets

    @property
    def buckets(self) -> int:
        if not exists(self.spark, place := f"{self.path}/buckets"):
            created(self.spark, place, str(self._buckets))
        return int(text_of(self.spark, place))

    def _folders(self) -> tuple[list[str], set[int]]:
        """The folders that together hold all rows, and the batches in them."""
        names = names_in(self.spark, f"{self.path}/batches")
        merged = max((n for n in names if n.startswith("merged=")), default=None)  # numbers of equal length
        within = set(map(int, text_of(self.spark, f"{self.path}/batches/{merged}/batches").split())) if merged else set()
        single = {int(n.partition("=")[2]) for n in names if n.startswith("batch=")}
        return [merged] * bool(merged) + [f"batch={b}" for b in sorted(single - within)], within | single

    def committed(self) -> list[int]:
        return sorted(self._folders()[1])

    def _read(self, kind: str, schema: str) -> DataFrame:
        folders, _ = self._folders()
        if not folders:
            return self.spark.createDataFrame([], schema)
        root, names = f"{self.path}/batches", [f.name for f in T.StructType.fromDDL(schema)]
        # folders of a batch each are read together; another column of folders, merged, is read apart
        lists = [x for x in ([f for f in folders if f.startswith(k)] for k in ("merged", "batch")) if x]
        frames = [self.spark.read.schema(schema).option("basePath", root).parquet(*(f"{root}/{f}/kind={kind}" for f in x)).select(names) for x in lists]
        return functools.reduce(DataFrame.unionByName, frames)

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply changes (seq, op, doc_id, source, lang, version, tokens; op insert, delete or revise) once. False: it was."""
        if batch in self.committed():
            return False
        order = [F.desc("seq"), F.desc_nulls_last("tokens"), F.asc_nulls_last("op"), F.asc_nulls_last("source"), F.asc_nulls_last("lang")]
        new = changes.where("doc_id is not null and version is not null").withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "version").orderBy(*order))).where("k = 1")
        bucket = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(self.buckets)).cast("int").alias("bucket")
        new = stored(new.select(bucket, "doc_id", "source", "lang", "version", "op", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")))
        touched = new.groupBy("bucket").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).collect()  # a row for each bucket
        if touched:
            ends = F.col("doc_id").between(min(r["least"] for r in touched), max(r["most"] for r in touched))
            before = self._read("ledger", f"{_LEDGER}, bucket int").where(F.col("bucket").isin([r["bucket"] for r in touched]) & ends)
        else:
            before = self.spark.createDataFrame([], f"{_LEDGER}, bucket int")
        own = before.join(new.select("bucket", "doc_id", "version"), ["bucket", "doc_id", "version"], "left_semi")
        held = own.groupBy("bucket", "doc_id", *GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0")
        out = held.select("doc_id", *GROUP, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"), "bucket")
        into = new.where("op <> 'delete'").select("doc_id", *GROUP, F.lit(1).cast("long").alias("docs"), "tokens", "bucket")
        aside = f"{self.path}/aside-{uuid.uuid4().hex}"
        self._write(aside, out.unionByName(into))
        if moved(self.spark, aside, f"{self.path}/batches/batch={batch}"):
            return True
        deleted(self.spark, aside)
        return False

    def _write(self, aside: str, ledger: DataFrame) -> None:
        """Ledger rows, and the sums of them."""
        ledger.repartition("bucket").sortWithinPartitions("bucket", "doc_id").write.partitionBy("bucket").parquet(f"{aside}/kind=ledger")
        rows = self.spark.read.schema(f"{_LEDGER}, bucket int").parquet(f"{aside}/kind=ledger")
        rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{aside}/kind=delta")

    def compact(self) -> None:
        """Put all batches together, a row for each document and version that is there. Folders that are in it may be read on until
        drop_merged; it must not run beside a commit."""
        folders, within = self._folders()
        if len(folders) < 2:
            return
        rows = self._read("ledger", f"{_LEDGER}, bucket int").groupBy("bucket", "doc_id", *GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")
        aside = f"{self.path}/aside-{uuid.uuid4().hex}"
        self._write(aside, rows.select("doc_id", *GROUP, "docs", "tokens", "bucket"))
        created(self.spark, f"{aside}/batches", " ".join(map(str, sorted(within))))
        if not moved(self.spark, aside, f"{self.path}/batches/merged={len(within):012d}"):
            deleted(self.spark, aside)

    def drop_merged(self) -> None:
        """Delete the folders whose rows another one holds."""
        folders, _ = self._folders()
        for name in names_in(self.spark, f"{self.path}/batches"):
            if name not in folders:
                deleted(self.spark, f"{self.path}/batches/{name}")

    def totals(self) -> DataFrame:
        rows = self._read("delta", "source string, lang string, version string, docs long, tokens long")
        return rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")


def op4_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches, the last two sent twice: all documents; new counts of those with markup characters, once these are
    taken out; deletes of the documents that are labelled toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()

    def change(op: str, rows: DataFrame, tokens: Column | str = "tokens") -> DataFrame:
        return rows.select(F.lit(1).alias("seq"), F.lit(op).alias("op"), "doc_id", *GROUP, F.col(tokens).alias("tokens"))

    first = change("insert", counts(docs))
    marked = docs.where(F.col("text").rlike("[#*$%&|<>]")).withColumn("text", F.regexp_replace("text", "[#*$%&|<>]", ""))
    second = change("revise", counts(marked))
    versions = F.explode(F.array(*map(F.lit, VERSIONS))).alias("version")
    none = F.lit(None).cast("string")
    third = change("delete", toxic.select("doc_id", none.alias("source"), none.alias("lang"), versions, F.lit(0).cast("long").alias("tokens")))
    kept = Rollups(spark, shared_dir(spark))
    for batch, changes in ((1, first), (2, second), (2, second), (3, third), (3, third)):
        kept.commit(batch, changes)
    return kept.totals()


ORACLE = r"""
WITH live AS (SELECT doc_id, source, lang, CASE WHEN regexp_matches(text, '[#*$%&|<>]') THEN regexp_replace(text, '[#*$%&|<>]', '', 'g') ELSE text END AS text
  FROM documents WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)),
each AS (
  SELECT doc_id, source, lang, 'words-1' AS version, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n FROM live
  UNION ALL
  SELECT doc_id, source, lang, 'pieces-2' AS version, coalesce(len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]')), 0) AS n FROM live),
one AS (SELECT * FROM each QUALIFY row_number() OVER (PARTITION BY doc_id, version ORDER BY n DESC, source NULLS LAST, lang NULLS LAST) = 1)
SELECT source, lang, version, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM one GROUP BY ALL
"""
