"""Language identification by bit-sliced Bloom filters of character n-grams.

One slot of the filter holds a bit for each language (64-bit words). The masks at an n-gram's k slots, and-ed together,
give all languages that contain it at once. Per language the hits are counted, corrected for the filter's false
positives, and the highest count decides.

Nulls, empty texts and texts without a letter give lang_pred 'und' and score 0. Rows with a null lang or text teach
nothing. Ties go to the smallest language value. Repeated rows each give a row; other columns are left alone.
An empty training set gives 'und' for every row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclemill.llm.shared import Words, chained, code_points, lean, letter_table, mixed, numbered, slices, stored, table, utf8, widened

SIZES = (3, 4)
HASHES = 3
#: The filter has 2**LEAST_BITS slots at least, and at least SLOTS for each n-gram of the language with the most.
LEAST_BITS, SLOTS = 16, 12
#: A language contains an n-gram if the n-gram's share of its n-grams is MIN_SHARE at least,
#: and RATIO at least of that share in the language where it is highest.
MIN_SHARE = 1e-6
RATIO = 0.2
UNKNOWN = "und"
#: Rows that a task holds before it adds up equal n-grams.
HELD = 400_000
#: Texts are worked on in slices of so many bytes; with 3 MB a worker took 75 to 90 MB more and was no faster.
SLICE = 1 << 20


@dataclass
class Filter:
    """masks: 2**bits slots by one word per 64 languages. A language has 1 / MIN_SHARE n-grams at most, as their shares add up
    to one, so bits is 24 at most, whatever the corpus."""

    languages: list[str]
    bits: int
    masks: np.ndarray  # (slots, words)
    false_rate: np.ndarray  # by language


def grams(words: list[bytes], sizes: tuple[int, ...] = SIZES) -> tuple[np.ndarray, np.ndarray]:
    """Hash and word number of every n-gram of the words' letters. Edges of runs of letters count as a character."""
    points, number = code_points(words)
    points = letter_table()[points]
    inside = points != 32
    hashes, owners = [], []
    for n in sizes:
        if len(points) < n:
            continue
        ok = np.ones(len(points) - n + 1, bool)
        for k in range(1, n - 1):
            ok &= inside[k : len(points) - n + 1 + k]
        at = np.flatnonzero(ok)
        hashes.append(chained([points[at + k] for k in range(n)], n))
        owners.append(number[at + 1])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def letters(words: list[bytes]) -> np.ndarray:
    """How many letters each word has (a mark alone is none)."""
    points, number = code_points(words)
    low = letter_table()[points]
    found = np.flatnonzero(low != 32)
    seen = np.unique(points[found])
    alpha = np.array([chr(c).isalpha() for c in seen.tolist()], bool)
    found = found[alpha[np.searchsorted(seen, points[found])]]
    return np.bincount(number[found], minlength=len(words))[: len(words)]


def slots(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    return (mixed(h + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1))) >> np.uint64(64 - bits)).astype(np.int64)


def _count(batches):
    """(lang, gram, n) of a task's texts, added up now and then."""
    names: dict[str, int] = {}
    held: list[tuple[np.ndarray, ...]] = []
    rows = 0

    def summed() -> tuple[np.ndarray, ...]:
        lang, gram, n = (np.concatenate(x) for x in zip(*held, strict=True))
        of, size = numbered(numbered(gram)[0] * len(names) + lang)
        first = np.empty(size, np.int64)
        first[of] = np.arange(len(of))
        return lang[first], gram[first], np.bincount(of, weights=n, minlength=size).astype(np.int64)

    def batch_of(lang, gram, n):
        return pa.RecordBatch.from_arrays([pa.array(list(names), pa.string()).take(pa.array(lang)), pa.array(gram), pa.array(n)], ["lang", "gram", "n"])

    for batch in batches:
        for a, b in slices(batch.column("text"), SLICE):
            words = Words(utf8(batch.column("text").slice(a, b - a)))
            if not len(words.codes):
                continue
            gram, owner = grams(words.distinct)
            of = np.array([names.setdefault(x, len(names)) for x in batch.column("lang").slice(a, b - a).to_pylist()])[words.text]
            gram, n_grams = gram.view(np.int64), len(gram)
            code, size = numbered(gram) if n_grams else (gram, 0)
            first = np.empty(size, np.int64)
            first[code] = gram
            for i in np.unique(of).tolist():
                weight = np.bincount(words.codes[of == i], minlength=len(words.distinct))
                n = np.bincount(code, weights=weight[owner], minlength=size).astype(np.int64)
                own = np.flatnonzero(n)
                held.append((np.full(len(own), i, np.int32), first[own], n[own]))
                rows += len(own)
            if rows > HELD:
                held = [summed()]
                rows = len(held[0][0])
                if rows > HELD // 2:
                    yield batch_of(*held[0])
                    held, rows = [], 0
    if held:
        yield batch_of(*summed())


def _set_bits(batches, bits: int):
    """(slot, word, mask) of each n-gram and its languages."""
    for batch in batches:
        h = np.asarray(batch.column("gram")).view(np.uint64)
        lang = np.asarray(batch.column("number")).astype(np.int64)
        bit = (np.uint64(1) << (lang % 64).astype(np.uint64)).view(np.int64)
        for k in range(HASHES):
            yield pa.RecordBatch.from_arrays([pa.array(slots(h, k, bits)), pa.array(lang // 64), pa.array(bit)], ["slot", "word", "mask"])


def fit(training: DataFrame) -> Filter:
    """Learn from text and lang. Only the filter, of a bounded size, and one row per language reach the driver."""
    spark = training.sparkSession
    rows = training.where("text is not null and lang is not null").select("lang", "text")
    counts = stored(rows.mapInArrow(lean(_count), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = {r["lang"]: r["total"] for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    languages = sorted(totals, key=lambda x: x.encode())
    bits, words = LEAST_BITS, max(1, -(-len(languages) // 64))
    masks = np.zeros((1 << bits, words), np.uint64)
    if languages:
        numbers = spark.createDataFrame([(x, i, totals[x]) for i, x in enumerate(languages)], "lang string, number int, total long")
        share = counts.join(F.broadcast(numbers), "lang").select("gram", F.struct((F.col("n") / F.col("total")).alias("share"), "number").alias("s"))
        each = share.where(F.col("s.share") >= MIN_SHARE).groupBy("gram").agg(F.collect_list("s").alias("s"))  # of as many as languages
        top = F.array_max("s")["share"]
        kept = stored(each.select("gram", F.explode(F.filter("s", lambda x: x["share"] >= RATIO * top)).alias("s")).select("gram", "s.number"))
        most = kept.groupBy("number").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        bits = max(bits, int(SLOTS * most).bit_length())
        found = kept.mapInArrow(lean(lambda batches: _set_bits(batches, bits)), "slot bigint, word bigint, mask bigint").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
        masks = np.zeros((1 << bits, words), np.uint64)
        masks[np.asarray(found["slot"]), np.asarray(found["word"])] = np.asarray(found["mask"]).view(np.uint64)
    full = np.array([((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
    return Filter(languages, bits, masks, full**HASHES)


def hits(model: Filter, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Per word the n-grams, and those that each language contains."""
    h, owner = grams(words)
    found = model.masks[slots(h, 0, model.bits)]
    for k in range(1, HASHES):
        found &= model.masks[slots(h, k, model.bits)]
    n = np.bincount(owner, minlength=len(words))[: len(words)]
    per = np.empty((len(words), len(model.languages)))
    for i in range(len(model.languages)):
        per[:, i] = np.bincount(owner, weights=((found[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(float), minlength=len(words))[: len(words)]
    return n, per


def _decide(model: Filter, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
    words = Words(texts)
    if not len(words.codes) or not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    n, per = hits(model, words.distinct)
    total = words.sums(n)
    f = model.false_rate
    found = np.stack([words.sums(per[:, i]) for i in range(len(f))], 1)
    real = np.clip((found - total[:, None] * f) / np.maximum(1 - f, 1e-9), 0, None)
    best = real.argmax(1)
    known = (words.sums(letters(words.distinct)) > 0) & (total > 0)
    score = np.where(known, np.clip(real[np.arange(len(texts)), best] / np.maximum(total, 1), 0, 1), 0.0)
    return [model.languages[i] if k else UNKNOWN for i, k in zip(best.tolist(), known.tolist(), strict=True)], score


def predict(docs: DataFrame, model: Filter) -> DataFrame:
    """docs with lang_pred and score; columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded, see Filter

    def run(batches):
        for batch in batches:
            text = batch.column("text")
            for a, b in slices(text, SLICE):
                lang, score = _decide(sent.value, utf8(text.slice(a, b - a)))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    return docs.mapInArrow(lean(run), widened(docs, "lang_pred string, score double"))


HELD_OUT = "crc32(cast(doc_id as string)) % 4 = 2"


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn on the rows that are not held out; predict all."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(f"not coalesce({HELD_OUT}, false)"))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.expr(f"coalesce({HELD_OUT}, false)").alias("held_out"), "lang_pred", "score")
