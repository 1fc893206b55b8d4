"""Raw day-files (CSV, JSON, Parquet) as one kind of DataFrame.

polls: (file, at, ts, counts array<double>, torques array<double>, statuses array<double>, head, reason). `at` is the row's place
in its file (block of the file, row in it), `reason` is null for a valid row and else says why it isn't. Rows are valid with
all cells, only numbers, counts within 2**53, and torques and statuses in the range of 32-bit floats. `head` is true where a
line of a CSV file reads as the header; polls leaves such lines out, every_row has them, for a sweep, which sees the
places of rows, to leave out the first of a file and count others as skipped.

Every file's columns are checked by what it begins with (a header line, a first object) or ends with (a footer), a few
kilobytes that the driver reads of many files at a time; no job runs before the rows are read.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclemill.schema import HEADS, RAW_COLUMNS
from cyclemill.sources.extract import policy_counts  # noqa: F401  (the row policy's counts are asked for here)
from cyclemill.sources.files import first_bytes, fs_of

#: Decimal numbers as Python and C read them, without type suffixes and hexadecimal.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_ODD = r"^\s*[+-]?(inf|infinity|nan)\s*$"
FLOAT_MAX, COUNT_MAX = 3.4028234663852886e38, float(2**53)
#: Bytes of a file's begin that are looked at, of JSON, where an object may lack a column, some hundred objects; and files at a time.
BEGIN, JSON_BEGIN, AT_ONCE = 1 << 16, 1 << 20, 16


class RawError(ValueError):
    """Files whose columns are not those of a day-file."""


def raw_format(path: str) -> str:
    low = path.lower()
    if low.endswith(".parquet"):
        return "parquet"
    return "json" if low.endswith((".json", ".jsonl", ".ndjson")) else "csv"


def _file_place(df: DataFrame) -> DataFrame:
    """file, and at: rows in the order of their splits and of the rows within."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return df.withColumn("file", F.col("_metadata.file_path")).withColumn("at", place)


# ---------------------------------------------------------------- columns, file by file


def _wrong(found: list[str], ordered: bool = False) -> str | None:
    """What is wrong with a file's columns."""
    twice = sorted({c for c in found if found.count(c) > 1})
    missing, extra = [c for c in RAW_COLUMNS if c not in found], [c for c in found if c not in RAW_COLUMNS]
    if twice or missing or extra:
        return f"{len(found)} columns for {len(RAW_COLUMNS)}, missing {missing[:3]}, unexpected {extra[:3]}, double {twice[:3]}"
    return "the columns are not in order" if ordered and found != RAW_COLUMNS else None


def _csv_kind(spark: SparkSession, file: str) -> tuple[str | None, str]:
    line = first_bytes(spark, file, BEGIN).split(b"\n")[0].decode("utf-8", "replace")
    return (_wrong([c.removesuffix("\r") for c in line.split(",")], ordered=True) if line else "the file is empty"), "csv"


def _objects(text: str, array: bool) -> list[list[tuple[str, object]]]:
    """The whole objects that a JSON file begins with, as pairs; broken lines are passed over."""
    decoder, out = json.JSONDecoder(object_pairs_hook=list), []
    at = 1 if array else 0
    while array:
        at += len(text[at:]) - len(text[at:].lstrip(" \t\r\n,"))
        try:
            pairs, at = decoder.raw_decode(text, at)
        except ValueError:
            return out
        out.append(pairs)
    for line in text.split("\n"):
        try:
            out.append(decoder.decode(line))
        except ValueError:
            continue
    return out


def _json_kind(spark: SparkSession, file: str) -> tuple[str | None, str]:
    """Whether the file is an array or has an object a line, by its first character that isn't blank. An object may lack a column;
    one that none of those in the file's begin has is missing."""
    text = first_bytes(spark, file, JSON_BEGIN).decode("utf-8", "replace").lstrip("\ufeff \t\r\n")
    array = text.startswith("[")
    found = _objects(text, array)
    try:
        names = dict.fromkeys(k for pairs in found for k, _ in pairs)
        twice = [k for pairs in found if len({k for k, _ in pairs}) < len(pairs) for k, _ in pairs]
    except (ValueError, TypeError):  # numbers, texts, lists
        found = []
    return (_wrong(twice or list(names)) if found else "it doesn't begin with an object"), "array" if array else "lines"


def _parquet_kind(spark: SparkSession, file: str) -> tuple[str | None, str]:
    """Files of one schema are read together."""
    hadoop = spark._jvm.org.apache.parquet.hadoop
    _, p = fs_of(spark, file)
    try:
        reader = hadoop.ParquetFileReader.open(hadoop.util.HadoopInputFile.fromPath(p, spark._jsc.hadoopConfiguration()))
    except Exception as e:  # a file of another format
        return f"no Parquet file: {type(e).__name__}", ""
    try:
        fields = reader.getFooter().getFileMetaData().getSchema().getFields()
        return _wrong([f.getName() for f in fields]), "; ".join(sorted(str(f) for f in fields))
    finally:
        reader.close()


def checked(spark: SparkSession, path: str, kind: str) -> tuple[dict[str, list[str]], dict[str, str]]:
    """The files at a path by what tells them apart (see the three functions above), and what is wrong with the others."""
    files = sorted(spark.read.text(path).inputFiles())
    look = {"csv": _csv_kind, "json": _json_kind, "parquet": _parquet_kind}[kind]
    with ThreadPoolExecutor(AT_ONCE) as pool:
        found = list(pool.map(lambda f: look(spark, f), files))
    good: dict[str, list[str]] = defaultdict(list)
    for f, (wrong, what) in zip(files, found, strict=True):
        if wrong is None:
            good[what].append(f)
    return dict(good), {f: wrong for f, (wrong, _) in zip(files, found, strict=True) if wrong is not None}


# ---------------------------------------------------------------- rows


def _cells(cells: Column) -> list[Column]:
    def number(x: Column) -> Column:
        return F.when(x.rlike(NUMBER) | F.lower(x).rlike(_ODD), F.expr("0D") + F.coalesce(x.try_cast("double"), F.lit(float("nan"))))

    return [F.transform(F.slice(cells, 2 + k * HEADS, HEADS), number).alias(n) for k, n in enumerate(("counts", "torques", "statuses"))]


def _judged(rows: DataFrame, head: Column | None = None) -> DataFrame:
    """rows (file, at, cells array<string>) as polls."""
    head = F.lit(False) if head is None else head
    out = rows.select("file", "at", F.when(~head, F.get("cells", F.lit(0))).alias("ts"), F.size("cells").alias("n"), *_cells(F.col("cells")), head.alias("head"))

    def every(name: str, most: float) -> Column:
        return F.forall(name, lambda x: ~F.isnan(x) & (F.abs(x) <= most))

    numeric = F.forall(F.concat("counts", "torques", "statuses"), lambda x: x.isNotNull())
    reason = (
        F.when(F.col("n") < len(RAW_COLUMNS), "short")
        .when(F.col("n") > len(RAW_COLUMNS), "extra")
        .when(~numeric, "not a number")
        .when(~every("counts", COUNT_MAX), "count out of range")
        .when(~(every("torques", FLOAT_MAX) & every("statuses", FLOAT_MAX)), "real out of range")
    )
    return out.withColumn("reason", reason).drop("n")


def read_csv(spark: SparkSession, files: list[str], what: str) -> DataFrame:
    """Lines are split by hand: a CSV reader would fill short rows up and cut long ones, and lose their order. Empty lines are passed
    over; the first line of a file is told by its place when rows are swept."""
    lines = _file_place(spark.read.option("lineSep", "\n").text(files).select("value", "_metadata"))
    lines = lines.withColumn("value", F.regexp_replace("value", "\r$", "")).where("value <> ''")
    cells = F.transform(F.split("value", ",", -1), lambda x: F.regexp_replace(x, "\r$", ""))
    body = lines.withColumn("cells", cells)
    last = F.element_at("cells", -1) == ""  # a comma at the end opens no cell
    body = body.withColumn("cells", F.when(last, F.slice("cells", 1, F.size("cells") - 1)).otherwise(F.col("cells")))
    return _judged(body, F.col("cells") == F.array(*map(F.lit, RAW_COLUMNS)))


def _cell_array(df: DataFrame, ts: Column) -> Column:
    cells = F.array(ts, *(F.col(f"`{c}`").cast("string") for c in RAW_COLUMNS[1:]))
    return F.filter(cells, lambda x: x.isNotNull())  # an empty cell makes a row short


def _spelled(stamp: Column) -> Column:
    """A time as a CSV file has it; what isn't one stays as it is."""
    return F.coalesce(F.date_format(stamp.cast("string").try_cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), stamp.cast("string"))


def read_parquet(spark: SparkSession, files: list[str], what: str) -> DataFrame:
    df = spark.read.parquet(*files)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.row_index").alias("row"))
    return _judged(df.select(F.col("_metadata.file_path").alias("file"), place.alias("at"), _cell_array(df, _spelled(F.col("timestamp"))).alias("cells")))


def read_json(spark: SparkSession, files: list[str], what: str) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in RAW_COLUMNS)
    df = spark.read.schema(schema).option("multiLine", what == "array").json(files)
    df = _file_place(df.select("*", "_metadata"))
    return _judged(df.select("file", "at", _cell_array(df, _spelled(F.col("timestamp"))).alias("cells")))


def every_row(spark: SparkSession, path: str, kind: str | None = None, refuse: Callable[[dict[str, str]], None] | None = None) -> DataFrame:
    """The rows of all files at a path. Files with other columns raise RawError, or are given to refuse and left out."""
    kind = kind or raw_format(path)
    try:
        good, wrong = checked(spark, path, kind)
    except AnalysisException as e:
        raise RawError(f"{path}: {e.getCondition()}") from e
    if wrong and (refuse is None or not good):
        raise RawError("; ".join(f"{f}: {why}" for f, why in sorted(wrong.items())[:5]))
    if not good:
        raise RawError(f"{path}: no files")
    if wrong:
        refuse(wrong)
    read = {"csv": read_csv, "parquet": read_parquet, "json": read_json}[kind]
    out = None
    for what, files in sorted(good.items()):
        rows = read(spark, files, what)
        out = rows if out is None else out.unionByName(rows)
    return out


def polls(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    return every_row(spark, path, kind).where("not head")
