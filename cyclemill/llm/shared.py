"""Helpers that several operators use: shared tables, table reading, words of a batch of texts."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import unicodedata
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word, as a Java and DuckDB regular expression.
WORD = r"[^\x20\x09-\x0D]+"

#: Texts of one batch are worked on in slices of at most so many bytes (a longer text is a slice of its own).
SLICE_BYTES = 3 << 20

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Bytes of a batch of rows for Python, and rows that a reader of Parquet decodes at once: by the default, 4096 whole texts are
#: an array of 16 to 32 MB for each task, a large object on the JVM's heap.
BATCH_BYTES, READ_ROWS = 2 << 20, 512
#: Spark's settings, and what they are set to where the session leaves them open.
_SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES, "spark.sql.parquet.columnarReaderBatchSize": READ_ROWS}


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package (on a cluster it is installed or sent with --py-files), and keep their memory
    small: batches of a few megabytes, and what is freed goes back to the system. So with the JVM's arrays of texts."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    known = spark.conf.getAll
    for name, value in _SETTINGS.items():
        if name not in known:
            spark.conf.set(name, str(value))


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="cyclemill-")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, under a temp folder (local mode) or the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        base = _local_dir() if local else spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/cyclemill-{uuid.uuid4().hex}"


def stored(df: DataFrame, into: str | None = None) -> DataFrame:
    """df, written once as Parquet to the shared folder: lineage is cut, and a lost executor costs nothing."""
    path = into or shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@functools.cache
def _trim():
    """glibc's malloc_trim; None with another C library."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def released(result=None):
    """result. What this worker has freed goes back to the system: workers outlive their tasks, and the C library keeps freed
    blocks of up to 32 MB in each of them."""
    trim = _trim()
    if trim is not None:
        trim(0)
    return result


def lean(run):
    """run, a task's function of batches, with what it has freed released at its end."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            released()

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def widened(df: DataFrame, more: str) -> T.StructType:
    """df's schema and more columns after it."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(more).fields])


def apart(df: DataFrame, *used: str) -> DataFrame:
    """df with other names for all columns but those used, so that no name that an operator adds clashes with one of them."""
    return df.toDF(*(c if c in used else f"column_{i}_" for i, c in enumerate(df.columns)))


#: So many ids or files are broadcast at most, some 8 or 100 bytes each; more go another way.
MAX_IDS, MAX_FILES = 2_000_000, 100_000


def _is_scan(df: DataFrame) -> bool:
    """Whether df is columns and conditions over one relation, so that a row of that is a row of df at most once."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.deterministic() and plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def keyed(df: DataFrame) -> DataFrame:
    """df with row_key_, a whole number for each row that every later job finds the same, whatever is lost in between.

    Rows of a plain scan of Parquet files are told by file and place, so that their texts need not be written again; others,
    as those of an explode, a join or a union, and those of very many files, get a number and are stored with it.
    """
    files: list[str] = []
    if _is_scan(df):
        try:
            placed = df.select("*", F.col("_metadata.file_path").alias("keyed_file_"), F.col("_metadata.row_index").alias("keyed_row_"))
            files = sorted(df.inputFiles())
        except AnalysisException:  # files of another format
            pass
    if not files or len(files) > MAX_FILES:
        return stored(df.withColumn("row_key_", F.monotonically_increasing_id()))
    found = placed.select("keyed_file_").distinct()  # the spelling of paths in rows; at most as many as files
    number = stored(found.withColumn("keyed_number_", F.row_number().over(Window.orderBy("keyed_file_")) - 1))
    key = F.shiftleft(F.col("keyed_number_").cast("long"), 40).bitwiseOR(F.col("keyed_row_")).alias("row_key_")
    return placed.join(F.broadcast(number), "keyed_file_").select(*df.columns, key)


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows (row_key_ and others) but those whose row_key_ is in gone. Texts are shuffled only if more than MAX_IDS go."""
    gone = stored(gone.select("row_key_"))
    return rows.join(F.broadcast(gone) if gone.count() <= MAX_IDS else gone, "row_key_", "left_anti")


def ranked(df: DataFrame, by: list[str], key: list[str], largest: int, chunk: int = 20_000) -> DataFrame:
    """df with rank_: from 0 within the columns `by` (nulls are a group), in an order that key settles.

    largest: rows of the largest group. Groups are split into hashed chunks of about `chunk` rows, so none is gathered
    in one task: a chunk's ranks start after the counts of the chunks before it.
    """
    chunks = max(1, -(-largest // chunk))
    cut = df.withColumn("chunk_", F.pmod(F.xxhash64(*key), F.lit(chunks)).cast("int"))
    sizes = cut.groupBy(*by, "chunk_").agg(F.count(F.lit(1)).alias("n_"))
    earlier = Window.partitionBy(*by).orderBy("chunk_").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*(F.col(c).alias(f"{c}_by") for c in by), F.col("chunk_").alias("chunk_by"), F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("before_"))
    own = cut.withColumn("rank_", F.row_number().over(Window.partitionBy(*by, "chunk_").orderBy(*key)) - 1)
    same = F.col("chunk_") == F.col("chunk_by")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"{c}_by"))
    return own.join(before, same).select(*df.columns, (F.col("rank_") + F.col("before_")).alias("rank_"))


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """(start, stop) row ranges of about limit bytes."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0))
    start = held = 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def utf8(texts: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null gives b''."""
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    return [x or b"" for x in texts.cast(kind).to_pylist()]


class Words:
    """Words of some texts: distinct words, the word number at each place, the text number of each place.

    ASCII white space is exactly the six bytes that WORD leaves out.
    """

    def __init__(self, texts: list[bytes]):
        parts = pa.compute.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
        flat = parts.flatten()
        real = np.asarray(pa.compute.binary_length(flat)) > 0  # white space at an end leaves an empty part there
        before = np.concatenate([[0], np.cumsum(real)])
        self.counts = np.diff(before[np.asarray(parts.offsets)])
        coded = (flat if real.all() else flat.filter(pa.array(real))).dictionary_encode()
        self.codes = np.asarray(coded.indices)
        self.text = np.repeat(np.arange(len(texts)), self.counts)
        self._words = coded.dictionary

    @functools.cached_property
    def distinct(self) -> list[bytes]:
        _, ends, data = self._words.buffers()
        cut, data = np.frombuffer(ends, np.int32)[: len(self._words) + 1].tolist(), (data or b"")
        data = bytes(memoryview(data)[: cut[-1]]) if cut else b""
        return [data[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def chars(self) -> np.ndarray:
        """Code points of each distinct word; a byte that is no part of UTF-8 counts as it is decoded with replacement."""
        data = b"".join(self.distinct)
        sizes = np.array([len(w) for w in self.distinct], np.int64)
        try:
            data.decode()
        except UnicodeDecodeError:
            return np.array([len(w.decode("utf-8", "replace")) for w in self.distinct], np.int64)
        begins = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
        ends = np.cumsum(sizes)
        return begins[ends] - begins[ends - sizes]

    def sums(self, per_word: np.ndarray) -> np.ndarray:
        """Per text the sum of a number that each distinct word has."""
        return np.bincount(self.text, weights=per_word[self.codes], minlength=len(self.counts)) if len(self.codes) else np.zeros(len(self.counts))


def numbered(key: np.ndarray) -> tuple[np.ndarray, int]:
    """Equal values as equal numbers from 0 on, and how many there are."""
    coded = pa.array(key).dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), len(coded.dictionary)


@functools.cache
def letter_table() -> np.ndarray:
    """For each code point: its lower case if it is a letter or a mark, else a space."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if unicodedata.category(x)[0] in "LM":
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def code_points(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of '\\n' w0 '\\n' w1 ... '\\n', and for each place the word number (of a '\\n': of the word after it)."""
    text = (b"\n" + b"\n".join(words) + b"\n").decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return points, np.cumsum(points == 10) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def chained(parts: list[np.ndarray], seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each row of equally long columns."""
    with np.errstate(over="ignore"):
        start = mixed(np.array([(seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1)], np.uint64))
        h = np.full(len(parts[0]), start[0])  # mixed, so that a seed is not made up for by the first part
        for p in parts:
            h = mixed(h + p.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return h
