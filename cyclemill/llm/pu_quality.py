"""A quality classifier learnt from trusted positives and unlabelled text.

There are no trusted negatives. With a class prior, the share of good rows among unlabelled ones, the risk on bad rows is the
risk of calling unlabelled rows bad less the positives' part in it. With the logistic loss and a linear score f the sum of
both classes' risks is convex, mean_U log(1 + e^f) - prior * mean_P f and an L2 term, so a few Newton steps minimise it; each is
one aggregate over the stored features of all rows, of which the sums alone reach the driver. The risk on bad rows cannot
be negative: a step at whose end its estimate is, is halved until it isn't, so that the score never fits that away.

The prior is estimated from the scores of a first fit: over every end of the scores, the share of unlabelled rows above it is at
least prior times the share of positives above it, and the two are equal where no bad row scores as high; the end is taken
where that ratio and its sampling error are least together.

Features are shares of kinds of characters and counts of words, repeats and lines, standardised over the unlabelled rows. Null and
empty texts have all counts 0 and a score like others. A row with labels that contradict each other is not trusted. Rows with
a null doc_id have no label and are unlabelled, not held out. Repeated rows are rows each. Without positives or without
unlabelled rows every score is 0.5. An empty table gives no rows. Other columns are left alone.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclemill.llm.quality import repeat_words
from cyclemill.llm.shared import Words, apart, numbered, slices, stored, table, utf8, widened

#: Kinds of characters; others are of the last.
KINDS = ["lower", "upper", "letter", "mark", "digit", "space", "feed", "stop", "end", "quote", "symbol", "punctuation", "other"]
COUNTS = ["words", "word_length", "distinct", "repeated", "doubled", "commonest", "long_words", "short_words", "odd_words", "lines", "line_length", "same_lines"]
WIDTH = len(KINDS) + len(COUNTS)
#: Standardised features end there, so that a very odd text counts as much as an odd one.
CLIP = 4.0
L2 = 1e-2
STEPS, HALVINGS, TOLERANCE = 15, 6, 1e-6
FIRST_PRIOR = 0.5
BINS = 2000
LONG, SHORT = 25, 2
SLICE = 3 << 19


@functools.cache
def kind_table() -> np.ndarray:
    """For each code point the number of its kind."""
    named = {" ": "space", "\t": "space", "\n": "feed", ".": "stop", ",": "stop", "!": "end", "?": "end"} | dict.fromkeys("'\"-()", "quote") | dict.fromkeys("#*$%&|<>", "symbol")
    general = {"Ll": "lower", "Lu": "upper", "L": "letter", "M": "mark", "N": "digit", "Z": "space", "P": "punctuation", "S": "punctuation"}
    out = np.full(0x110000, len(KINDS) - 1, np.uint8)
    for c in range(0x110000):
        category = unicodedata.category(chr(c))
        kind = named.get(chr(c)) or general.get(category) or general.get(category[0])
        if kind:
            out[c] = KINDS.index(kind)
    return out


def features(texts: list[bytes]) -> np.ndarray:
    """A row of WIDTH numbers for each text."""
    n = len(texts)
    out = np.zeros((n, WIDTH))
    decoded = [t.decode("utf-8", "replace") for t in texts]
    points, chars = np.frombuffer("".join(decoded).encode("utf-32-le"), np.uint32), np.array([len(t) for t in decoded], np.int64)
    kinds = np.bincount(np.repeat(np.arange(n) * len(KINDS), chars) + kind_table()[points], minlength=n * len(KINDS)).reshape(n, len(KINDS))
    out[:, : len(KINDS)] = np.sqrt(kinds / np.maximum(chars, 1)[:, None])

    words = Words(texts)
    count = np.maximum(words.counts, 1)
    length = words.chars() if len(words.distinct) else np.zeros(0, np.int64)
    odd = np.array([not w[:-1].isalnum() and not w[:-1].decode("utf-8", "replace").isalnum() and len(w) > 1 for w in words.distinct], float)
    pair, size = numbered(words.text.astype(np.int64) * max(len(words.distinct), 1) + words.codes)
    each = np.bincount(pair, minlength=size)
    owner = np.zeros(size, np.int64)
    owner[pair] = words.text
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner, each)
    twice = (words.codes[1:] == words.codes[:-1]) & (words.text[1:] == words.text[:-1])
    lines, same = np.zeros(n), np.zeros(n)
    for i, t in enumerate(texts):
        own = [x for x in t.split(b"\n") if x.strip()]
        lines[i], same[i] = len(own), len(own) - len(set(own))
    share = lambda x: np.sqrt(x / count)
    counts = {
        "words": np.log1p(words.counts),
        "word_length": np.log1p(words.sums(length) / count),
        "distinct": share(np.bincount(owner, minlength=n)),
        "repeated": share(repeat_words(words)),
        "doubled": share(np.bincount(words.text[1:][twice], minlength=n)),
        "commonest": share(most),
        "long_words": share(words.sums((length > LONG).astype(float))),
        "short_words": share(words.sums((length <= SHORT).astype(float))),
        "odd_words": share(words.sums(odd)),
        "lines": np.log1p(lines),
        "line_length": np.log1p(words.counts / np.maximum(lines, 1)),
        "same_lines": np.sqrt(same / np.maximum(lines, 1)),
    }
    for k, name in enumerate(COUNTS):
        out[:, len(KINDS) + k] = counts[name]
    return out


def featured(docs: DataFrame) -> DataFrame:
    """docs without text and with features."""
    names = [c for c in docs.columns if c != "text"]

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column("text"), SLICE):
                part = batch.slice(a, b - a)
                found = features(utf8(part.column("text"))).astype(np.float32)
                arrays = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, WIDTH, dtype=np.int32)), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*part.select(names).columns, arrays], [*names, "features"])

    return docs.mapInArrow(run, widened(docs.select(*names), "features array<float>"))


@dataclass
class Model:
    """mean, spread: of the features; weights: one a feature, and the constant."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    prior: float

    def inputs(self, batch: pa.RecordBatch) -> np.ndarray:
        x = np.asarray(batch.column("features").flatten()).reshape(-1, WIDTH).astype(float)
        return np.hstack([np.clip((x - self.mean) / self.spread, -CLIP, CLIP), np.ones((len(x), 1))])


def _summed(rows: DataFrame, of) -> np.ndarray:
    """The sum over all batches of of(batch), an array of a fixed size. Numbers are added up as decimals, so that their order has no
    effect."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                found = of(batch)
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "x"])

    # a row for each number from each task
    found = rows.mapInArrow(run, "k long, x double").groupBy("k").agg(F.sum(F.col("x").cast("decimal(38,12)")).cast("double").alias("x")).collect()
    return np.array([r["x"] for r in sorted(found, key=lambda r: r["k"])])


def _flags(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(batch.column("positive")), np.asarray(batch.column("unlabelled"))


def _risk(rows: DataFrame, model: Model, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Risk with the L2 term, the estimate of the risk on bad rows, gradient and Hessian; one pass."""

    def of(batch):
        x = model.inputs(batch)
        p, u = _flags(batch)
        f = x @ model.weights
        good = 1 / (1 + np.exp(-np.clip(f[u], -500, 500)))
        called = np.logaddexp(0, f)
        return np.concatenate([[p.sum(), u.sum(), f[p].sum(), called[p].sum(), called[u].sum()], x[p].sum(0), good @ x[u], ((x[u] * (good * (1 - good))[:, None]).T @ x[u]).ravel()])

    s, d = _summed(rows, of), WIDTH + 1
    n_p, n_u, f_p, called_p, called_u = s[:5]
    slope_p, slope_u, curve = s[5 : 5 + d], s[5 + d : 5 + 2 * d], s[5 + 2 * d :].reshape(d, d)
    l2 = np.full(d, L2)
    l2[-1] = 0
    bad = called_u / n_u - prior * called_p / n_p
    w = model.weights
    return called_u / n_u - prior * f_p / n_p + l2 @ (w * w) / 2, bad, slope_u / n_u - prior * slope_p / n_p + l2 * w, curve / n_u + np.diag(l2 + 1e-9)


def minimise(rows: DataFrame, model: Model, prior: float) -> Model:
    """The weights of the least risk that has no negative part."""
    risk, _, slope, curve = _risk(rows, model, prior)
    for _ in range(STEPS):
        step = np.linalg.solve(curve, slope)
        for _ in range(HALVINGS):
            tried = Model(model.mean, model.spread, model.weights - step, prior)
            found = _risk(rows, tried, prior)
            if found[0] < risk and found[1] >= 0:
                break
            step /= 2
        else:
            break
        gain, model, (risk, _, slope, curve) = risk - found[0], tried, found
        if gain < TOLERANCE:
            break
    return Model(model.mean, model.spread, model.weights, prior)


def class_prior(rows: DataFrame, model: Model) -> float:
    """The share of good rows among the unlabelled, from BINS ends of the scores."""

    def of(batch):
        f = model.inputs(batch) @ model.weights
        score = np.minimum((BINS / (1 + np.exp(-np.clip(f, -500, 500)))).astype(np.int64), BINS - 1)
        return np.concatenate([np.bincount(score[own], minlength=BINS) for own in _flags(batch)]).astype(float)

    counts = _summed(rows, of)
    above = np.cumsum(counts.reshape(2, BINS)[:, ::-1], axis=1)
    n_p, n_u = above[:, -1]
    some = above[0] > 0
    p, u = above[0][some] / n_p, above[1][some] / n_u
    error = np.sqrt(np.log(40) / 2) * (n_u**-0.5 + n_p**-0.5) / p
    return float(np.clip((u / p)[np.argmin(u / p + error)], 0.01, 0.99))


def fit(rows: DataFrame) -> Model | None:
    """Learn from rows with features, positive and unlabelled (not null). Positives may be among the unlabelled. None without both."""

    def moments(batch):
        x = np.asarray(batch.column("features").flatten()).reshape(-1, WIDTH).astype(float)
        p, u = _flags(batch)
        return np.concatenate([[p.sum(), u.sum()], x[u].sum(0), (x[u] ** 2).sum(0)])

    s = _summed(rows, moments)
    if not len(s) or not s[0] or not s[1]:
        return None
    mean = s[2 : 2 + WIDTH] / s[1]
    spread = np.sqrt(np.maximum(s[2 + WIDTH :] / s[1] - mean**2, 0)) + 1e-6
    first = minimise(rows, Model(mean, spread, np.zeros(WIDTH + 1), FIRST_PRIOR), FIRST_PRIOR)
    return minimise(rows, Model(mean, spread, np.zeros(WIDTH + 1), 0.0), class_prior(rows, first))


def scored(rows: DataFrame, model: Model | None) -> DataFrame:
    """rows with score, the probability of being good."""
    names = rows.columns

    def run(batches):
        for batch in batches:
            score = np.full(batch.num_rows, 0.5) if model is None else 1 / (1 + np.exp(-np.clip(model.inputs(batch) @ model.weights, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*names, "score"])

    return rows.mapInArrow(run, widened(rows, "score double"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (doc_id, ...) with trusted, whether all labels of the doc_id are 1."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("label_id_")).agg((F.min("quality") == 1).alias("trusted"))
    return rows.join(known, F.col("doc_id") == F.col("label_id_"), "left").drop("label_id_").withColumn("trusted", F.coalesce("trusted", F.lit(False)))


HELD_OUT = "crc32(cast(doc_id as string)) % 5 = 0"
GOOD = 0.3


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn on the rows that are not held out; score all."""
    docs = apart(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "text")
    rows = stored(featured(docs.withColumn("held_out", F.expr(f"coalesce({HELD_OUT}, false)"))))
    learn = with_labels(rows.where("not held_out"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    learn = stored(learn.select("features", F.expr("trusted and not held_out").alias("positive"), F.lit(True).alias("unlabelled")))
    found = scored(rows, fit(learn))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
