"""Quality rules: base counts of a text, and bands of perplexity under a modified Kneser-Ney n-gram model per language.

The model's units are characters of the running text, ORDER at a time: words with one space between two, so that contexts
reach over word boundaries and the order of words counts, and letters in their case. Spark counts the n-grams of all
documents that pass the base rules, in two halves that the text's hash picks; a document is scored by the half it is not
in, so neither its own counts nor those of its exact copies help it.

judge() keeps every n-gram, of any share, and broadcasts none. Rows are cut into chunks of CHUNK bytes of text or so. A chunk
sends each of its distinct n-grams once, with its count, to the bucket of its third and fourth character; these rows travel
packed, at some 2 bytes each. A bucket has all that orders 3 to 5 need: an n-gram, its suffixes, their contexts and all that
stands to their left. Orders 1 and 2, which it does not have, are DataFrame aggregates of the distinct trigrams and are joined
to the buckets. The bucket then answers each chunk with the log-probabilities of its n-grams, and there they meet the texts.
A bucket holds its distinct n-grams, and packed rows beside them; an n-gram that is in all texts has a row for each chunk.

kneser_ney(), fit() and score() are the same model as tables and as sorted arrays of hashed n-grams, for a corpus whose model
fits a task. There, if `entries` is given, an n-gram is kept if its share of its model's characters is (number of models) /
entries at least, and the mass of others goes to the shorter context; probabilities still add up to one.

A document is rejected if its mean negative log-probability per character ("nats") lies outside its language's band, taken
from histograms in steps of 1/STEPS nats of all documents that pass the base rules. Below, the band ends LOW scaled median
absolute deviations (FLOOR nats at least) under the median. Above, it ends HIGH of them over the median, or, if that is
higher, where 4 of 5 planted texts still lie above: one text in PLANTED is scored with its words in another order too.

Null and empty texts have no words: n_words 0, base_failed true, kept false, nats null. A null lang is a language of its own,
another than the empty string. A document that no model can score, as its language has no text in the other half, has null
nats and isn't rejected by them. Ties at a band's ends are kept. Repeated rows each give a row. An empty table gives an empty
result. Other columns are left alone, whatever their names; columns of the names given here are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cyclemill.llm.shared import Words, apart, chained, keyed, lean, mixed, numbered, released, slices, stored, table, utf8, widened

ORDER = 5
#: N-grams of an order that fit() keeps at most; None: all of them.
ENTRIES: int | None = None
HALVES = 2
#: Ends of the band in scaled median absolute deviations, which count as FLOOR nats at least.
LOW, HIGH, FLOOR = 6.0, 4.0, 0.02
STEPS = 1000
#: One text in so many is scored in another order of its words too; this share of these may lie under the band's upper end.
PLANTED, MISSED = 8, 0.2
SYMBOLS = b"#*$%&|<>"
#: Before each text, so that its first characters have contexts.
PAD = "\n" * (ORDER - 1)
#: Rows that a task holds before it adds up equal n-grams.
HELD = 800_000
#: Texts are worked on in slices of so many bytes; each character takes some 70 bytes then.
SLICE = 1 << 19
#: Bytes of texts in a packed row, small enough to be no large object on the JVM's heap once compressed.
BUNDLE = 3 << 18
#: Bytes of text of a chunk and of what is dealt to a bucket, on average.
CHUNK, BUCKET = 28 << 20, 16 << 20

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
BASE_NAMES = [x.split()[0] for x in BASE.split(", ")]


# ---------------------------------------------------------------- base rules


def repeat_words(words: Words) -> np.ndarray:
    """Per text the words that lie in a 3-word window found twice or more in it."""
    n, v = len(words.counts), max(len(words.distinct), 1)
    start = np.flatnonzero(words.text[:-2] == words.text[2:])
    key, size = words.text[start].astype(np.int64), n
    for k in range(3):
        if size * v >= 1 << 62:
            key, size = numbered(key)
        key, size = key * v + words.codes[start + k], size * v
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(start), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    covered = np.zeros(len(words.codes), bool)
    for k in range(3):
        covered[start[again] + k] = True
    return np.bincount(words.text[covered], minlength=n)


def base_counts(texts: list[bytes]) -> np.ndarray:
    """A row of the BASE columns for each text."""
    words = Words(texts)
    out = np.zeros((len(texts), len(BASE_NAMES)), np.int64)
    out[:, 0] = words.counts
    out[:, 1] = words.sums(words.chars())
    out[:, 4] = repeat_words(words)
    for i, text in enumerate(texts):
        out[i, 2] = len(text) - len(text.translate(None, SYMBOLS))
        lines = text.split(b"\n")
        if len(lines) > 1:
            lines = [x for x in lines if x.split(None, 1)]
            out[i, 3] = len(lines) - len(set(lines))
    return out


def _passes(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] >= 50) & (100 * base[:, 4] <= 50 * base[:, 0])


# ---------------------------------------------------------------- n-grams of running text


def half_of(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) % HALVES


class Grams:
    """The n-grams of ORDER characters of some texts, each of which ends at a character with all its context.

    kinds: a number for each text; n-grams of texts of different kinds are told apart. points: all code points; every: where
    characters stand; text: each one's text; key: its n-gram and kind as one number, `exact` if that can be read back.
    """

    def __init__(self, texts: list[bytes], kinds: np.ndarray):
        own = [b" ".join(t.split()).decode("utf-8", "replace") for t in texts]
        self.points = np.frombuffer(PAD.join(["", *own]).encode("utf-32-le"), np.uint32)
        self.text = np.repeat(np.arange(len(texts)), [len(t) for t in own])
        present = np.zeros(0x110000, bool)
        present[self.points] = True
        self.alphabet = np.flatnonzero(present)
        ids = (np.cumsum(present) - 1)[self.points]
        letters, n = len(self.alphabet), max(len(ids) - ORDER + 1, 0)
        self.most = int(kinds.max(initial=0)) + 1
        self.exact = letters**ORDER * self.most < 1 << 62
        key, size = ids[:n], letters
        for k in range(1, ORDER):
            if size * letters >= 1 << 62:
                key, size = numbered(key)
            key, size = key * letters + ids[k : k + n], size * letters
        self.every = np.flatnonzero(self.points[ORDER - 1 :] != ord("\n")) + ORDER - 1  # words have no line feed
        if size * self.most >= 1 << 62:
            key, size = numbered(key)
        self.key = key[self.every - (ORDER - 1)] * self.most + kinds[self.text]

    def distinct(self, kinds: np.ndarray) -> None:
        """Sets codes, each character's number of its n-gram and kind, and of these at, where a last character stands, and kind."""
        self.codes, found = numbered(self.key)
        self.at = np.empty(found, np.int64)
        self.at[self.codes] = self.every
        self.kind = np.empty(found, np.int64)
        self.kind[self.codes] = kinds[self.text]

    def packed(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the n-grams that distinct() has found: the first two code points as one number, the last three as one."""
        p = [self.points[self.at + k].astype(np.int64) for k in range(1 - ORDER, 1)]
        return p[0] << 21 | p[1], p[2] << 42 | p[3] << 21 | p[4]

    def nats(self, value: np.ndarray, texts: int) -> np.ndarray:
        """Per text the mean negative of its n-grams' values, log-probabilities; nan without characters."""
        sums, n = np.bincount(self.text, weights=value[self.codes], minlength=texts), np.bincount(self.text, minlength=texts)
        return np.where(n > 0, -sums / np.maximum(n, 1), np.nan)

    def counted(self, kinds: np.ndarray) -> tuple[np.ndarray, ...]:
        """(kind, first two code points as one number, last three as one, n) of the distinct n-grams."""
        if self.exact:
            key, n = np.unique(self.key, return_counts=True)
            key, kind = np.divmod(key, self.most)
            p = []
            for _ in range(ORDER):
                key, last = np.divmod(key, max(len(self.alphabet), 1))
                p.append(self.alphabet[last])
            p.reverse()
        else:
            self.distinct(kinds)
            return self.kind, *self.packed(), np.bincount(self.codes, minlength=len(self.at))
        return kind, p[0] << 21 | p[1], p[2] << 42 | p[3] << 21 | p[4], n


def _strings(high: np.ndarray, low: np.ndarray) -> pa.Array:
    """The strings of n-grams that are packed as two and three code points of 21 bits."""
    points = np.stack([high >> 21, high & 0x1FFFFF, low >> 42, low >> 21 & 0x1FFFFF, low & 0x1FFFFF], 1).astype("<u4")
    text = points.tobytes().decode("utf-32-le")
    return pa.array([text[i : i + ORDER] for i in range(0, len(text), ORDER)], pa.string())


def _count(batches):
    """(lang, half, gram, n) of a task's texts that pass the base rules; held rows are added up now and then."""
    kinds: dict[tuple[str | None, int], int] = {}
    held: list[tuple[np.ndarray, ...]] = []
    rows = 0

    def summed() -> tuple[np.ndarray, ...]:
        kind, high, low, n = (np.concatenate(x) for x in zip(*held, strict=True))
        (a, _), (b, size) = numbered(low), numbered(high * len(kinds) + kind)
        of, found = numbered(a * size + b)
        first = np.empty(found, np.int64)
        first[of] = np.arange(len(of))
        return kind[first], high[first], low[first], np.bincount(of, weights=n, minlength=found).astype(np.int64)

    def batch_of(kind, high, low, n) -> pa.RecordBatch:
        lang, half = pa.array([x for x, _ in kinds], pa.string()), np.array([x for _, x in kinds], np.int32)
        return pa.RecordBatch.from_arrays([lang.take(pa.array(kind)), pa.array(half[kind]), _strings(high, low), pa.array(n)], ["lang", "half", "gram", "n"])

    for batch in batches:
        for a, b in slices(batch.column("text"), SLICE):
            texts, langs = utf8(batch.column("text").slice(a, b - a)), batch.column("lang").slice(a, b - a).to_pylist()
            use = np.flatnonzero(_passes(base_counts(texts)))
            if not len(use):
                continue
            kind = np.array([kinds.setdefault((langs[i], half_of(texts[i])), len(kinds)) for i in use])
            held.append(Grams([texts[i] for i in use], kind).counted(kind))
            rows += len(held[-1][0])
            if rows > HELD:
                held = [summed()]
                rows = len(held[0][0])
                if rows > HELD * 3 // 4:
                    yield batch_of(*held[0])
                    held, rows = [], 0
    if held:
        yield batch_of(*summed())


# ---------------------------------------------------------------- the model


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _few(n: str) -> list[Column]:
    """n1 to n4: how many n-grams have a count of 1 to 4."""
    return [F.sum((F.col(n) == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)]


def _discounts() -> list[Column]:
    """d1 to d3, for counts of 1, of 2, and of 3 and more, of n1 to n4."""
    y = _ratio(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    return [F.least(F.greatest(i - (i + 1) * y * _ratio(F.col(f"n{i + 1}"), F.col(f"n{i}")), F.lit(0.1 * i)), F.lit(0.95 * i)).alias(f"d{i}") for i in (1, 2, 3)]


def kneser_ney(docs: DataFrame, entries: int | None = ENTRIES) -> tuple[DataFrame, DataFrame]:
    """Tables (lang, half, gram, own) and (lang, half, gram, rest) of the interpolated model with three discounts per order.

    own: an n-gram's discounted probability after its context; rest: the mass that a context leaves to the shorter one.
    Counts below the highest order are numbers of distinct left neighbours, but raw counts where a text begins.
    """
    model = ["lang", "half"]
    top = docs.select(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("lang"), "text").where("text is not null")
    top = top.mapInArrow(_count, "lang string, half int, gram string, n bigint").groupBy(*model, "gram").agg(F.sum("n").alias("n"))
    levels = {ORDER: stored(top.withColumn("raw", F.col("n")))}
    for k in range(ORDER - 1, 0, -1):
        level = levels[k + 1].groupBy(*model, F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("left"), F.sum("raw").alias("raw"))
        levels[k] = stored(level.select(*model, "gram", F.when(F.startswith("gram", F.lit("\n")), F.col("raw")).otherwise(F.col("left")).alias("n"), "raw"))
    counts = None
    for k, level in levels.items():
        level = level.withColumn("k", F.lit(k))
        counts = level if counts is None else counts.unionByName(level)

    sizes = counts.groupBy(*model, "k").agg(*_few("n"), F.sum("raw").alias("chars"))
    sizes = stored(sizes.select(*model, "k", "chars", *_discounts()))
    models = sizes.select(*model).distinct().count()
    context = F.expr("substring(gram, 1, k - 1)")
    total = F.sum("n").over(Window.partitionBy(*model, "k", "context_"))
    less = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    parts = counts.withColumn("context_", context).withColumn("total_", total).join(F.broadcast(sizes) if models * ORDER < 100_000 else sizes, [*model, "k"])
    kept = parts if entries is None else parts.where(F.col("raw") * (entries / max(models, 1)) >= F.col("chars"))
    kept = stored(kept.select(*model, "gram", "context_", ((F.col("n") - less) / F.col("total_")).alias("own")))
    rest = kept.groupBy(*model, F.col("context_").alias("gram")).agg((1 - F.sum("own")).alias("rest"))
    return kept.select(*model, "gram", "own"), stored(rest)


def _hash(points: np.ndarray, at: np.ndarray, n: int, model: int) -> np.ndarray:
    """Hashes of the n code points from each place on, for one model."""
    return chained([points[at + k] for k in range(n)] or [np.zeros(len(at))], model * 16 + n)


class Arrays:
    """The models as sorted arrays of hashes, with the values beside them."""

    def __init__(self, models: list[tuple[str, int]], own: pa.Table, rest: pa.Table):
        self.number = {x: i for i, x in enumerate(models)}
        self.own, self.rest = self._sorted(own), self._sorted(rest)

    @staticmethod
    def _sorted(t: pa.Table) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """By model and length of the n-gram, so that each array is small."""
        keys, values, model, length = (t[c].to_numpy() for c in ("key", "value", "model", "length"))
        keys, out = keys.view(np.uint64), {}
        for m, n in sorted(set(zip(model.tolist(), length.tolist(), strict=True))):
            own = np.flatnonzero((model == m) & (length == n))
            own = own[np.argsort(keys[own])]
            out[m, n] = keys[own], values[own]
        return out

    @staticmethod
    def find(arrays: tuple[np.ndarray, np.ndarray] | None, wanted: np.ndarray, default: float) -> np.ndarray:
        if arrays is None:
            return np.full(len(wanted), default)
        keys, values = arrays
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], default)

    def log_probability(self, model: int, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the characters at these places, by the contexts before them. All unseen characters are one character."""
        p = 1.0 / (len(self.own.get((model, 1), ((),))[0]) + 1)
        for n in range(1, ORDER + 1):
            start = at - n + 1
            p = self.find(self.own.get((model, n)), _hash(points, start, n, model), 0.0) + self.find(self.rest.get((model, n - 1)), _hash(points, start, n - 1, model), 1.0) * p
        return np.log(p)

    def nats(self, texts: list[bytes], models: list[int | None]) -> np.ndarray:
        """Per text the mean negative log-probability of a character; nan without characters or a model."""
        number = np.array([-1 if m is None else m for m in models], np.int64)
        grams = Grams(texts, number + 1)
        grams.distinct(number + 1)
        value = np.full(len(grams.at), np.nan)
        for m in np.unique(number[number >= 0]).tolist():
            own = np.flatnonzero(grams.kind == m + 1)
            value[own] = self.log_probability(m, grams.points, grams.at[own])
        return grams.nats(value, len(texts))


def _keyed(df: DataFrame, value: str, models: list[tuple[str, int]]) -> pa.Table:
    """(key, value, model, length): the hash of each gram and what it stands for."""

    def run(batches):
        number = {x: i for i, x in enumerate(models)}
        for batch in batches:
            grams = batch.column("gram").to_pylist()
            model = np.array([number[x] for x in zip(batch.column("lang").to_pylist(), batch.column("half").to_pylist(), strict=True)], np.int32)
            lengths = np.array([len(g) for g in grams], np.int32)
            keys = np.zeros(len(grams), np.uint64)
            for m, n in sorted(set(zip(model.tolist(), lengths.tolist(), strict=True))):
                own = np.flatnonzero((model == m) & (lengths == n))
                points = np.frombuffer("".join(grams[i] for i in own).encode("utf-32-le"), np.uint32)
                keys[own] = _hash(points, np.arange(len(own)) * n, n, m)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(value).cast(pa.float32()), pa.array(model), pa.array(lengths)], ["key", "value", "model", "length"])

    return df.select("lang", "half", "gram", value).mapInArrow(run, "key bigint, value float, model int, length int").toArrow()


def fit(docs: DataFrame, entries: int | None = ENTRIES) -> Arrays:
    """The models of all languages and halves. What reaches the driver is about `entries` rows an order; judge() needs none of it."""
    own, rest = kneser_ney(docs, entries)
    models = sorted((r["lang"], r["half"]) for r in rest.where("gram = ''").select("lang", "half").collect())
    return Arrays(models, _keyed(own, "own", models), _keyed(rest, "rest", models))


# ---------------------------------------------------------------- scores and bands


def shuffled(text: bytes) -> bytes:
    """The words in another order, always the same for a text."""
    words = text.split()
    order = np.argsort(mixed(np.arange(len(words), dtype=np.uint64) ^ np.uint64(xxhash.xxh3_64_intdigest(text))))
    return b" ".join([words[i] for i in order.tolist()])


def _planted(texts: list[bytes], passed: np.ndarray) -> list[int]:
    """Which texts are scored in another order of their words too."""
    return [i for i in np.flatnonzero(passed).tolist() if xxhash.xxh3_64_intdigest(texts[i]) // HALVES % PLANTED == 0]


def _named(lang: str | None) -> str:
    return "" if lang is None else f"={lang}"


SCORED = f"{BASE}, base_failed boolean, nats double, planted_nats double"


def _score(part: pa.RecordBatch, columns: list[str], nats_of) -> pa.RecordBatch:
    """The columns of a slice of rows, and those of SCORED. nats_of: the nats of texts, given their langs and their halves."""
    texts, langs = utf8(part.column("text")), part.column("lang").to_pylist()
    base = base_counts(texts)
    passed = _passes(base)
    plant = _planted(texts, passed)
    halves = [half_of(t) for t in texts]
    rows = [*range(len(texts)), *plant]
    both = nats_of([*texts, *(shuffled(texts[i]) for i in plant)], [_named(langs[i]) for i in rows], [halves[i] for i in rows])
    planted = np.full(len(texts), np.nan)
    planted[plant] = both[len(texts) :]
    more = [*(pa.array(base[:, i].copy()) for i in range(len(BASE_NAMES))), pa.array(~passed), pa.array(both[: len(texts)], from_pandas=True), pa.array(planted, from_pandas=True)]
    return pa.RecordBatch.from_arrays([*part.select(columns).columns, *more], [*columns, *BASE_NAMES, "base_failed", "nats", "planted_nats"])


def score(docs: DataFrame, model: Arrays | Broadcast, carry: bool = True) -> DataFrame:
    """docs with the BASE columns, base_failed, nats, and planted_nats: those of one text in PLANTED in another order.

    All in one pass over the texts; without carry the text itself is left out.
    """
    docs = docs.drop(*BASE_NAMES, "base_failed", "nats", "planted_nats")
    sent = model if isinstance(model, Broadcast) else docs.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in docs.columns if carry or c != "text"]

    def run(batches):
        arrays = sent.value
        for batch in batches:
            for a, b in slices(batch.column("text"), SLICE):
                yield _score(batch.slice(a, b - a), columns, lambda texts, langs, halves: arrays.nats(texts, [arrays.number.get((x, HALVES - 1 - h)) for x, h in zip(langs, halves, strict=True)]))

    return docs.mapInArrow(lean(run), widened(docs.select(columns), SCORED))


# ---------------------------------------------------------------- every n-gram, by buckets


MASK = (1 << 21) - 1


def model_key(lang: str, half: int) -> int:
    """The key of a model; that of the language's other half differs in the last bit."""
    return (xxhash.xxh3_64_intdigest(lang.encode()) >> 2 << 1) | half


def _planes(columns: np.ndarray) -> bytes:
    """Columns of 4 bytes a value as their bytes by place: most are as in the row before."""
    return np.ascontiguousarray(columns.view(np.uint8).reshape(len(columns), -1, 4).transpose(0, 2, 1)).tobytes()


def _columns(data: bytes, n: int, kind: str, offset: int = 0) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=offset).reshape(n, 4, -1).transpose(0, 2, 1)
    return np.ascontiguousarray(planes).view(kind)[:, :, 0]


def _pack(model: np.ndarray, high: np.ndarray, low: np.ndarray) -> bytes:
    """N-grams, sorted by model and low, compressed."""
    first = np.flatnonzero(np.diff(model, prepend=-1))
    head = np.concatenate([[len(first)], model[first], np.diff(first, append=len(model))]).astype("<i8")
    planes = _planes(np.stack([high >> 21, high & MASK, low >> 42, low >> 21 & MASK, low & MASK]).astype("<u4"))
    return zstandard.compress(head.tobytes() + planes, 6)


def _unpack(data: bytes) -> tuple[np.ndarray, ...]:
    """(model, high, low)."""
    data = zstandard.decompress(data)
    k = int(np.frombuffer(data, "<i8", 1)[0])
    head = np.frombuffer(data, "<i8", 2 * k, 8)
    p = _columns(data, 5, "<u4", 8 * (1 + 2 * k)).astype(np.int64)
    return np.repeat(head[:k], head[k:]), p[0] << 21 | p[1], p[2] << 42 | p[3] << 21 | p[4]


def _pack_numbers(x: np.ndarray, kind: str) -> bytes:
    return zstandard.compress(_planes(x.astype(kind)[None]), 1)


def _unpack_numbers(data: bytes, kind: str) -> np.ndarray:
    return _columns(zstandard.decompress(data), 1, kind)[0]


def _rows(blobs: pa.Table):
    """(model, high, low, n) of each packed row."""
    for data, n in zip(blobs.column("data").to_pylist(), blobs.column("n").to_pylist(), strict=True):
        yield *_unpack(data), _unpack_numbers(n, "<u4").astype(np.int64)


def _gram_keys(model: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return chained([model, high, low], ORDER)


def _total(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(key, model, high, low, n) of some rows, in the order of keys, those of equal keys added up. held is emptied: a column
    after another is put together, and sorted, as a table of hashes takes several times the memory."""
    columns = [list(x) for x in zip(*held, strict=True)]
    held.clear()
    key = np.concatenate(columns.pop(0))
    order = np.argsort(key)
    key = key[order]
    begins = np.flatnonzero(np.diff(key, prepend=key[:1] - np.uint64(1)))
    first, key = order[begins], key[begins]
    model, high, low = (np.concatenate(columns.pop(0))[first] for _ in range(3))
    n = np.concatenate(columns.pop())[order]
    return key, model, high, low, np.add.reduceat(n, begins) if len(n) else n


def _drained(held: list):
    """Its items, each let go of."""
    while held:
        yield held.pop(0)


def _totals(rows) -> tuple[np.ndarray, ...]:
    """The same of all rows (model, high, low, n); added up now and then, so that distinct n-grams are held."""
    held: list[tuple[np.ndarray, ...]] = []
    size, most = 0, HELD
    for model, high, low, n in rows:
        held.append((_gram_keys(model, high, low), model, high, low, n))
        size += len(model)
        if size > most:
            held = [_total(held)]
            size = len(held[0][0])
            most = max(HELD, 2 * size)
    return _total(held)


def _deal(batches, rows_in_chunk: int, buckets: int):
    """(chunk, bucket, data, n): the distinct n-grams of a chunk's rows, with their counts in texts that pass the base rules. Those of
    other texts, and of planted ones, have a count of 0: they are asked for only."""
    held: list[tuple[np.ndarray, ...]] = []

    def dealt(chunk: int):
        model, high, low, n = _totals(_drained(held))[1:]
        bucket = (chained([model >> 1, low >> 21], ORDER) % np.uint64(buckets)).astype(np.int32 if buckets > 1 << 15 else np.int16)
        order = np.lexsort((high, low, model))
        order = order[np.argsort(bucket[order], kind="stable")]
        bucket = bucket[order]
        found = np.unique(bucket)
        cuts = [*np.searchsorted(bucket, found).tolist(), len(bucket)]
        parts = [order[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
        data, times = [_pack(model[x], high[x], low[x]) for x in parts], [_pack_numbers(n[x], "<u4") for x in parts]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), chunk)), pa.array(found.astype(np.int32)), pa.array(data, pa.binary()), pa.array(times, pa.binary())], ["chunk", "bucket", "data", "n"])

    def summed() -> None:
        held[:] = [_totals(_drained(held))[1:]]

    last = size = 0
    for batch in batches:
        chunk = batch.column("row_key_").to_numpy() // rows_in_chunk
        cuts = np.flatnonzero(np.diff(chunk, prepend=-1)).tolist()
        for i, j in zip(cuts, [*cuts[1:], len(chunk)], strict=False):
            if held and chunk[i] != last:
                yield dealt(last)
                held.clear()
                size = 0
            last = chunk[i]
            for a, b in slices(batch.column("text").slice(i, j - i), SLICE):
                texts, langs = utf8(batch.column("text").slice(i + a, b - a)), batch.column("lang").slice(i + a, b - a).to_pylist()
                passed = _passes(base_counts(texts))
                names: dict[int, int] = {}
                kind = np.array([names.setdefault(model_key(_named(x), half_of(t)), len(names)) for x, t in zip(langs, texts, strict=True)], np.int64)
                keys = np.array(list(names), np.int64)
                plant, failed = _planted(texts, passed), np.flatnonzero(~passed)
                counts = ([texts[x] for x in np.flatnonzero(passed)], kind[passed], 1), ([*(texts[x] for x in failed), *(shuffled(texts[x]) for x in plant)], np.concatenate([kind[failed], kind[plant]]), 0)
                for some, kinds, times in counts:
                    k, high, low, n = Grams(some, kinds).counted(kinds)
                    if len(k):
                        held.append((keys[k], high, low, n * times))
                        size += len(k)
                if size > HELD:
                    summed()
                    size = len(held[0][0])
                    if size > HELD * 3 // 4:
                        yield dealt(last)
                        held.clear()
                        size = 0
    if held:
        yield dealt(last)


class Level:
    """The seen n-grams of an order in a bucket: their keys, those of their contexts, models, counts and where each one's
    first row is among the next longer ones."""

    def __init__(self, k: int, key: np.ndarray, context: np.ndarray, model: np.ndarray, begins: np.ndarray, weight: np.ndarray):
        """Of the rows of longer n-grams. begins: which have no other left neighbour than a text's begin; weight: raw counts."""
        of, found = numbered(key)
        self.k, self.first = k, np.empty(found, np.int64)
        self.first[of] = np.arange(len(of))
        self.key, self.context, self.model = key[self.first], context[self.first], model[self.first]
        self.raw = np.bincount(of, weights=weight, minlength=found).astype(np.int64)
        self.n = self.raw if k == ORDER else np.where(begins[self.first], self.raw, np.bincount(of, minlength=found))


def levels(model: np.ndarray, high: np.ndarray, low: np.ndarray, n: np.ndarray) -> list[Level]:
    """Orders 5, 4 and 3 of distinct n-grams that all of a third and a fourth character are among."""
    out = [Level(5, _gram_keys(model, high, low), chained([model, high, low >> 21], 4), model, np.zeros(len(model), bool), n)]
    high, low = high[out[0].first], low[out[0].first]
    begins = high & MASK
    out.append(Level(4, chained([out[0].model, begins, low], 14), chained([out[0].model, begins, low >> 21], 13), out[0].model, begins == ord("\n"), out[0].raw))
    low = low[out[1].first]
    out.append(Level(3, chained([out[1].model, low], 23), chained([out[1].model, low >> 21], 22), out[1].model, low >> 42 == ord("\n"), out[1].raw))
    return out


def _asked_keys(model: np.ndarray, high: np.ndarray, low: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The keys of n-grams and of contexts, for orders 3, 4 and 5."""
    second = high & MASK
    return [
        (chained([model, low], 23), chained([model, low >> 21], 22)),
        (chained([model, second, low], 14), chained([model, second, low >> 21], 13)),
        (_gram_keys(model, high, low), chained([model, high, low >> 21], 4)),
    ]


#: Of a bucket. k > 0: how many n-grams of an order have counts of 1 to 4. k = 0: a trigram of a model that is seen, n1 times, or
#: asked for, n1 = 0.
_STATED = "bucket int, model long, k int, gram long, n1 long, n2 long, n3 long, n4 long"


def _stated(group: pa.Table) -> pa.Table:
    model, high, low, n = _totals(_rows(group))[1:]
    seen = n > 0
    rows = []
    every = levels(model[seen], high[seen], low[seen], n[seen])
    for level in every:
        keys, of = np.unique(level.model, return_inverse=True)
        few = [np.bincount(of[level.n == i], minlength=len(keys)) for i in (1, 2, 3, 4)]
        rows.append((keys, np.full(len(keys), level.k), 0 * keys, *few))
    where = np.flatnonzero(seen)[every[0].first[every[1].first[every[2].first]]]
    rows.append((model[where], 0 * where, low[where], every[2].raw, 0 * where, 0 * where, 0 * where))
    of, found = numbered(chained([model, low]))
    first = np.empty(found, np.int64)
    first[of] = np.arange(len(of))
    none = np.zeros(found, np.int64)
    rows.append((model[first] ^ 1, none, low[first], none, none, none, none))
    columns = [np.concatenate(x) for x in zip(*rows, strict=True)]
    bucket = np.full(len(columns[0]), group.column("bucket")[0].as_py(), np.int32)
    return pa.Table.from_arrays([pa.array(bucket), pa.array(columns[0]), pa.array(columns[1].astype(np.int32)), *(pa.array(x) for x in columns[2:])], names=[x.split()[0] for x in _STATED.split(", ")])


def _short(stated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From the buckets' rows: (bucket, model, gram, p) of the last two characters of all trigrams of a bucket, and the discounts
    (model, k, d1, d2, d3) of orders 3 to 5."""
    trigrams = stated.where("k = 0").select("bucket", "model", F.col("gram").bitwiseAND((1 << 42) - 1).alias("gram"), F.col("n1").alias("raw"))
    left, raw = F.count(F.lit(1)).alias("left"), F.sum("raw").alias("raw")
    begins = F.shiftright("gram", 21) == ord("\n")
    two = stored(trigrams.where("raw > 0").groupBy("model", "gram").agg(left, raw).select("model", "gram", "raw", F.when(begins, F.col("raw")).otherwise(F.col("left")).alias("n")))
    one = stored(two.groupBy("model", F.col("gram").bitwiseAND(MASK).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    sizes = one.select("model", F.lit(1).alias("k"), "n").unionByName(two.select("model", F.lit(2).alias("k"), "n")).groupBy("model", "k").agg(*_few("n"))
    sizes = sizes.unionByName(stated.where("k > 0").groupBy("model", "k").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in (1, 2, 3, 4))))
    discounts = stored(sizes.select("model", "k", *_discounts()))
    less = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    of = lambda k: discounts.where(F.col("k") == k).drop("k")
    total = one.groupBy("model").agg(F.sum("n").alias("total"), *_up(), F.count(F.lit(1)).alias("kinds")).join(of(1), "model")
    total = stored(total.select("model", "total", "d1", "d2", "d3", (_left_over() / F.col("total") / (F.col("kinds") + 1)).alias("unseen")))
    p1 = one.join(total, "model").select("model", F.col("gram").alias("last"), ((F.col("n") - less) / F.col("total") + F.col("unseen")).alias("p1"))
    contexts = two.groupBy("model", F.shiftright("gram", 21).alias("context")).agg(F.sum("n").alias("total"), *_up()).join(of(2), "model")
    contexts = stored(contexts.select("model", "context", "total", "d1", "d2", "d3", (_left_over() / F.col("total")).alias("rest")))
    own = two.withColumn("context", F.shiftright("gram", 21)).join(contexts, ["model", "context"]).select("model", "gram", ((F.col("n") - less) / F.col("total")).alias("own"))
    asked = trigrams.select("model", "gram").distinct().withColumns({"context": F.shiftright("gram", 21), "last": F.col("gram").bitwiseAND(MASK)})
    asked = asked.join(total.select("model", "unseen"), "model").join(p1, ["model", "last"], "left").join(contexts.select("model", "context", "rest"), ["model", "context"], "left").join(own, ["model", "gram"], "left")
    p = F.coalesce("own", F.lit(0.0)) + F.coalesce("rest", F.lit(1.0)) * F.coalesce("p1", "unseen")
    p2 = stored(asked.select("model", "gram", p.alias("p")))
    return trigrams.select("bucket", "model", "gram").distinct().join(p2, ["model", "gram"]), discounts.where("k > 2")


def _up() -> list[Column]:
    """u1 to u3: how many counts are 1, 2, and 3 or more."""
    return [F.sum((F.col("n") == i if i < 3 else F.col("n") >= 3).cast("long")).alias(f"u{i}") for i in (1, 2, 3)]


def _left_over() -> Column:
    return F.col("d1") * F.col("u1") + F.col("d2") * F.col("u2") + F.col("d3") * F.col("u3")


def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    order = np.argsort(keys)
    return (keys[order], values[order]) if len(keys) else None


def _answers(blobs: pa.Table, short: pa.Table, discounts: dict[tuple[int, int], list[float]]):
    """(chunk, data, values): each packed row set again, and the log-probabilities of its n-grams by the other half's model."""
    key, model, high, low, n = _totals(_rows(blobs))
    seen = n > 0
    other = model ^ 1
    p = Arrays.find(_sorted(chained([short.column("model").to_numpy(), short.column("gram").to_numpy()]), short.column("p").to_numpy()), chained([other, low & ((1 << 42) - 1)]), np.nan)
    for level, (grams, contexts) in zip(reversed(levels(model[seen], high[seen], low[seen], n[seen])), _asked_keys(other, high, low), strict=True):
        models, which = np.unique(level.model, return_inverse=True)
        d = np.array([[0.0, *discounts[m, level.k]] for m in models.tolist()]).reshape(-1, 4)
        of, found = numbered(level.context)
        total = np.bincount(of, weights=level.n, minlength=found)
        less = d[which, np.minimum(level.n, 3)] if len(which) else np.zeros(0)
        up = [np.bincount(of[np.minimum(level.n, 3) == i], minlength=found) for i in (1, 2, 3)]
        first = np.empty(found, np.int64)
        first[of] = np.arange(len(of))
        rest = sum(d[which[first], i] * u for i, u in zip((1, 2, 3), up, strict=True)) / total if found else np.zeros(0)
        p = Arrays.find(_sorted(level.key, (level.n - less) / total[of]), grams, 0.0) + Arrays.find(_sorted(level.context[first], rest), contexts, 1.0) * p
    table_ = _sorted(key, np.log(p).astype(np.float32))
    for chunk, x in zip(blobs.column("chunk").to_pylist(), blobs.column("data").to_pylist(), strict=True):
        yield chunk, x, _pack_numbers(Arrays.find(table_, _gram_keys(*_unpack(x)), np.nan), "<f4")


def _answered(blobs: pa.Table, short: pa.Table, discounts: dict[tuple[int, int], list[float]]) -> pa.Table:
    chunk, data, values = zip(*_answers(blobs, short, discounts), strict=True) if len(blobs) else ((), (), ())
    return pa.table([pa.array(chunk, pa.int64()), pa.array(data, pa.binary()), pa.array(values, pa.binary())], names=["chunk", "data", "values"])


def _bundled(batches, columns: list[str], rows_in_chunk: int):
    """(chunk, rows): rows of a chunk as compressed Arrow batches, each small enough to be no large object on the JVM's heap."""
    for batch in batches:
        chunk = batch.column("row_key_").to_numpy() // rows_in_chunk
        cuts = np.flatnonzero(np.diff(chunk, prepend=-1)).tolist()
        for i, j in zip(cuts, [*cuts[1:], len(chunk)], strict=False):
            for a, b in slices(batch.column("text").slice(i, j - i), BUNDLE):
                part, sink = batch.slice(i + a, b - a).select(columns), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_batch(part)
                data = zstandard.compress(sink.getvalue().to_pybytes(), 6)
                yield pa.RecordBatch.from_arrays([pa.array([int(chunk[i])], pa.int64()), pa.array([data], pa.binary())], ["chunk", "rows"])


def scored_whole(docs: DataFrame, carry: bool = True, key: str | None = None) -> DataFrame:
    """As score() with fit(docs) of all n-grams, whatever their number. Other columns of docs have names of apart(), but for
    key, a column that keyed() has made; without it, rows are given one."""
    spark = docs.sparkSession
    columns = [c for c in docs.columns if carry or c != "text"]
    docs_columns, schema = docs.columns, widened(docs.select(columns), SCORED)
    rows = keyed(docs) if key is None else docs
    files = rows.groupBy(F.shiftright("row_key_", 33)).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size"), F.count(F.lit(1)).alias("n"))
    size, largest = files.agg(F.coalesce(F.sum("size"), F.lit(0)), F.max_by(F.struct("size", "n"), "size")).first()
    buckets = -(-size // BUCKET) + 7
    rows_in_chunk = max(1, -(-largest["n"] // (-(-largest["size"] // CHUNK) or 1))) if largest else 1  # so that the end of a file leaves no small chunk
    tasks = 3 * (-(-size // CHUNK) + 1)  # more than chunks, so that few have several of them
    asked = rows.select("row_key_", "lang", "text").mapInArrow(lean(lambda batches: _deal(batches, rows_in_chunk, buckets)), "chunk long, bucket int, data binary, n binary")
    by_bucket = stored(asked).repartition(buckets, "bucket")
    stated = stored(by_bucket.groupBy("bucket").applyInArrow(lambda group: released(_stated(group)), _STATED))
    short, discounts = _short(stated)
    d = {(r["model"], r["k"]): [r["d1"], r["d2"], r["d3"]] for r in discounts.collect()}  # three rows for each language and half
    sent = spark.sparkContext.broadcast(d)
    answers = by_bucket.groupBy("bucket").cogroup(short.repartition(buckets, "bucket").groupBy("bucket")).applyInArrow(lambda a, b: released(_answered(a, b, sent.value)), "chunk long, data binary, values binary")
    bundles = rows.mapInArrow(lean(lambda batches: _bundled(batches, docs_columns, rows_in_chunk)), "chunk long, rows binary")

    def run(batches: pa.Table, answers: pa.Table):
        out, keys, values = [], [], []
        for data, x in zip(answers.column("data").to_pylist(), answers.column("values").to_pylist(), strict=True):
            keys.append(_gram_keys(*_unpack(data)))
            values.append(_unpack_numbers(x, "<f4"))
        known = _sorted(np.concatenate(keys), np.concatenate(values)) if keys else None

        def nats_of(texts, langs, halves):
            names: dict[int, int] = {}
            kind = np.array([names.setdefault(model_key(x, h), len(names)) for x, h in zip(langs, halves, strict=True)], np.int64)
            grams = Grams(texts, kind)
            grams.distinct(kind)
            return grams.nats(Arrays.find(known, _gram_keys(np.array(list(names), np.int64)[grams.kind], *grams.packed()), np.nan), len(texts))

        for data in batches.column("rows").to_pylist():
            for batch in pa.ipc.open_stream(zstandard.decompress(data)):
                out.append(_score(batch, columns, nats_of))
        return pa.Table.from_batches(out)  # a chunk has a row at least

    both = bundles.repartition(tasks, "chunk").groupBy("chunk").cogroup(answers.repartition(tasks, "chunk").groupBy("chunk"))
    return both.applyInArrow(lambda a, b: released(run(a, b)), schema)


def bands(scored: DataFrame) -> DataFrame:
    """(band_lang_, low_, high_), a row for each language, from histograms of as many rows as steps."""
    rows = scored.where("not base_failed").select(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("band_lang_"), "nats", "planted_nats")
    step = lambda c: F.round(F.col(c) * STEPS).cast("long").alias("x")

    def bars(of: str) -> DataFrame:
        return rows.where(f"{of} is not null").groupBy("band_lang_", step(of)).agg(F.count(F.lit(1)).alias("n"))

    def quantile(bars: DataFrame, share: float, name: str) -> DataFrame:
        w = Window.partitionBy("band_lang_")
        up = bars.withColumn("upto", F.sum("n").over(w.orderBy("x"))).withColumn("all", F.sum("n").over(w))
        return up.where(F.col("upto") >= F.col("all") * share).groupBy("band_lang_").agg(F.min("x").alias(name))

    own = stored(bars("nats"))
    center = quantile(own, 0.5, "mid")
    away = own.join(center, "band_lang_").groupBy("band_lang_", F.abs(F.col("x") - F.col("mid")).alias("x")).agg(F.sum("n").alias("n"))
    wide = F.greatest(1.4826 * F.col("mad"), F.lit(FLOOR * STEPS))
    both = center.join(quantile(away, 0.5, "mad"), "band_lang_").join(quantile(bars("planted_nats"), MISSED, "junk"), "band_lang_", "left")
    high = F.greatest(F.col("mid") + HIGH * wide, F.col("junk").cast("double"))  # greatest() passes over nulls
    return both.select("band_lang_", ((F.col("mid") - LOW * wide) / STEPS).alias("low_"), (high / STEPS).alias("high_"))


#: Bands of so many languages are broadcast at most, some 50 bytes each; more are joined by a shuffle.
MAX_LANGUAGES = 100_000


def judge(docs: DataFrame, carry: bool = True, key: str | None = None) -> DataFrame:
    """docs (with text and lang) with the BASE columns, base_failed, nats and kept; without carry the text is left out. key: as
    of scored_whole()."""
    docs = docs.drop(*BASE_NAMES, "base_failed", "nats", "kept")
    scored = stored(scored_whole(apart(docs, "text", "lang", key), carry, key))
    limits = stored(bands(scored))
    limits = F.broadcast(limits) if limits.count() <= MAX_LANGUAGES else limits
    lang = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    outside = F.coalesce((F.col("nats") < F.col("low_")) | (F.col("nats") > F.col("high_")), F.lit(False))
    out = scored.join(limits, lang == F.col("band_lang_"), "left").withColumn("kept", ~F.col("base_failed") & ~outside)
    return out.drop("band_lang_", "low_", "high_", "planted_nats").toDF(*(c for c in docs.columns if carry or c != "text"), *BASE_NAMES, "base_failed", "nats", "kept")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return judge(docs, carry=False).select("doc_id", *BASE_NAMES, "base_failed", "kept", F.round("nats", 6).alias("nats"))
