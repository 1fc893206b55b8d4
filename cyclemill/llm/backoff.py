"""Stupid-backoff scores of documents: n-gram tables partitioned by hash, joined to the exploded n-grams, summed per document.

S(w2 | w1) = c(w1 w2) / c(w1) if the bigram was seen, else ALPHA * c(w2) / N, each count taken without the document's own,
so that a document is scored by the rest of the corpus. A word's key is the 64-bit hash of its bytes: at ten million words
two of them share a key with probability 3e-6.

Each document's distinct bigrams are exploded and dealt once into buckets by hash, of about BUCKET rows each. There the rows
of a bigram meet: their sum is the bigram's count, which is joined back to each row and gives its part of the document's
score. Of the two words only the counts of frequent ones are known beforehand: those with a share of SHARE of all words at
least, so 1/SHARE at most whatever the corpus; they are broadcast. A bigram with a rarer word is dealt by that word, whose
rows then meet too: their sum is its count (the last word of a text, or the first, has a row without a bigram, so that it is
counted too). A bigram of two rare words has two rows, one dealt by each of them: the first word's row counts if the bigram
was seen, the second's if not.

No bucket gets large: a rare word's rows are few by definition, and bigrams of more than SPLIT documents (or HOT of all
words, if that is more; 1/HOT at most) are counted in a pass of their own and broadcast, so they have no rows. That pass is
run only if words are in so many documents. Rows travel packed, a row of the shuffle for each bucket of a slice of texts: as
rows of their own they took 19 bytes each instead of about 8. A document's parts from all buckets are packed alike, by
buckets of documents, and added up there.

Null and empty texts and texts of one word have no events: n_events 0, score null. Repeated rows are documents each, give a
row each and count for each other; null doc_ids too. A word's unigram count without the document's own is taken as ADD at
least, N as 1 at least. An empty table gives an empty result. Other columns are passed over. doc_id is a whole number.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclemill.llm.shared import Words, chained, mixed, numbered, slices, stored, table, utf8

ALPHA = 0.4
ADD = 0.5
SHARE = 1e-6
SPLIT, HOT = 1_000_000, 1e-6
BUCKET = 500_000
#: Documents whose parts are added up together.
DOCUMENTS = 50_000
#: Rows that a task holds before it adds up equal words, or a document's parts.
HELD = 1_000_000

#: Kinds of exploded rows. BOTH: two frequent words. FIRST, SECOND: dealt by a rare first or second word, with a frequent
#: other. FIRST_OF, SECOND_OF: the same of two rare words. ALONE: a word without a bigram. TEXT: a document.
BOTH, FIRST, SECOND, FIRST_OF, SECOND_OF, ALONE, TEXT = range(7)


def word_keys(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64).view(np.int64)


def _summed(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Rows of a key and numbers with equal keys added up."""
    keys, *values = (np.concatenate(x) for x in zip(*held, strict=True))
    of, size = numbered(keys)
    first = np.empty(size, np.int64)
    first[of] = keys
    sums = [np.zeros(size, x.dtype) for x in values]
    for into, x in zip(sums, values, strict=True):
        np.add.at(into, of, x)
    return first, *sums


def _added(parts, whole: bool = False):
    """The summed rows of parts (key, numbers...). Held rows are added up now and then; many different ones are given out
    before the end, but not if whole."""
    held: list[tuple[np.ndarray, ...]] = []
    rows, most = 0, HELD
    for part in parts:
        held.append(part)
        rows += len(part[0])
        if rows > most:
            held = [_summed(held)]
            rows = len(held[0][0])
            most = max(HELD, 2 * rows)
            if rows > HELD * 3 // 4 and not whole:
                yield held[0]
                held, rows, most = [], 0, HELD
    if held:
        yield _summed(held)


def _sums(parts, names: list[str]):
    for part in _added(parts):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in part], names)


class Bigrams:
    """The distinct bigrams of each of some texts: text, the words' numbers x and y, counts n, and the text's own counts of x and y."""

    def __init__(self, words: Words):
        size = max(len(words.distinct), 1)
        place, kinds = numbered(words.text.astype(np.int64) * size + words.codes)
        own = np.bincount(place, minlength=kinds)[place] if len(place) else place
        at = np.flatnonzero(words.text[:-1] == words.text[1:])
        of, found = numbered(place[at] * size + words.codes[at + 1])  # a place stands for its text and word
        first = np.empty(found, np.int64)
        first[of] = at
        self.text, self.x, self.y = words.text[first], words.codes[first].astype(np.int64), words.codes[first + 1].astype(np.int64)
        self.n, self.own_x, self.own_y = np.bincount(of, minlength=found), own[first], own[first + 1]


def _words(batches):
    """(key, n, docs) of the words of each slice of texts."""
    for batch in batches:
        for a, b in slices(batch.column("text")):
            words = Words(utf8(batch.column("text").slice(a, b - a)))
            size = len(words.distinct)
            pair, kinds = numbered(words.text.astype(np.int64) * max(size, 1) + words.codes)
            code = np.empty(kinds, np.int64)
            code[pair] = words.codes
            yield word_keys(words.distinct), np.bincount(words.codes, minlength=size), np.bincount(code, minlength=size)


@dataclass
class Frequent:
    """The frequent words: sorted keys and the rank of each, and by rank counts and documents; the number of all words; bigrams of
    very many documents, as sorted pairs of ranks, and their counts."""

    keys: np.ndarray
    rank: np.ndarray
    counts: np.ndarray
    docs: np.ndarray
    total: int
    pairs: np.ndarray
    pair_counts: np.ndarray

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        """-1 for words that are not frequent."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], -1)

    def hot(self, pairs: np.ndarray) -> np.ndarray:
        """The counts of bigrams of very many documents; 0 for others."""
        if not len(self.pairs):
            return np.zeros(len(pairs), np.int64)
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pairs, self.pair_counts[at], 0)


def frequent(docs: DataFrame, share: float = SHARE) -> Frequent:
    texts = docs.select("text").where("text is not null")
    schema = "key long, n long, docs long"
    counts = texts.mapInArrow(lambda batches: _sums(_words(batches), ["key", "n", "docs"]), schema)
    counts = stored(counts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    total = int(counts.agg(F.sum("n")).first()[0] or 0)
    often = counts.where(F.col("n") >= share * total).toArrow()  # 1 / share rows at most
    key, n, in_docs = (often[c].to_numpy() for c in ("key", "n", "docs"))
    by_count, by_key = np.lexsort((key, -n)), np.argsort(key)
    rank = np.empty(len(key), np.int64)
    rank[by_count] = np.arange(len(key))
    none = np.zeros(0, np.int64)
    found = Frequent(key[by_key], rank[by_key], n[by_count], in_docs[by_count], total, none, none)
    most = max(SPLIT, HOT * total)
    if (found.docs > most).any():
        sent = docs.sparkSession.sparkContext.broadcast((found, most))
        pairs = texts.mapInArrow(lambda batches: _sums(_common(batches, *sent.value), ["key", "n", "docs"]), schema)
        pairs = pairs.groupBy("key").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") > most).toArrow()  # 1 / HOT rows at most
        order = np.argsort(pairs["key"].to_numpy())
        found.pairs, found.pair_counts = pairs["key"].to_numpy()[order], pairs["n"].to_numpy()[order]
    return found


def _common(batches, known: Frequent, most: float):
    """(pair of ranks, n, docs) of the bigrams of each slice whose words are both in more than `most` documents."""
    for batch in batches:
        for a, b in slices(batch.column("text")):
            words = Words(utf8(batch.column("text").slice(a, b - a)))
            rank = known.ranks(word_keys(words.distinct))
            rank[rank >= 0] = np.where(known.docs[rank[rank >= 0]] > most, rank[rank >= 0], -1)
            g = Bigrams(words)
            use = np.flatnonzero((rank[g.x] >= 0) & (rank[g.y] >= 0)) if len(g.n) else g.n
            yield (rank[g.x[use]] << 32) | rank[g.y[use]], g.n[use], np.ones(len(use), np.int64)


def _packed(columns: np.ndarray, steps: int) -> bytes:
    """Columns of whole numbers, that of number `steps` by its steps, their bytes by place, compressed: most places hold zeros."""
    out = columns.copy()
    out[steps, 1:] -= columns[steps, :-1]
    return zstandard.compress(np.ascontiguousarray(out.view(np.uint8).reshape(len(out), -1, 8).transpose(0, 2, 1)).tobytes(), 1)


def _unpacked(data: bytes, columns: int, steps: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(columns, 8, -1)
    out = planes.transpose(0, 2, 1).copy().view(np.int64).reshape(columns, -1)  # a single row's planes lie in order already, and data can't be written to
    out[steps] = np.cumsum(out[steps])
    return out


def _value(seen, rest, word, n):
    """A bigram's part of a score, but for N."""
    log = np.log(np.maximum(word, ADD))
    return n * np.where(seen, np.log(np.maximum(rest, 1)) - log, math.log(ALPHA) + log)


def exploded(words: Words, doc: np.ndarray, ids: pa.Array, known: Frequent) -> np.ndarray:
    """Columns (kind, key, other, document, n, own_x, own_y) of some texts' rows. doc: a number for each text."""
    keys = word_keys(words.distinct)
    rank = known.ranks(keys)
    by_first, by_second = (chained([keys.view(np.uint64)], seed).view(np.int64) for seed in (1, 2))
    g = Bigrams(words)
    rx, ry = (rank[g.x], rank[g.y]) if len(g.n) else (g.n, g.n)
    parts: list[list[np.ndarray]] = []

    def bigrams(kind, which, key, other):
        parts.append([np.full(len(which), kind), key, other, doc[g.text[which]], g.n[which], g.own_x[which], g.own_y[which]])

    both = np.flatnonzero((rx >= 0) & (ry >= 0))
    pair = (rx[both] << 32) | ry[both]
    times = known.hot(pair)
    cold, hot = np.flatnonzero(times == 0), np.flatnonzero(times)
    bigrams(BOTH, both[cold], pair[cold], 0 * pair[cold])
    hot, rest = both[hot], times[hot] - g.n[both[hot]]
    seen = rest > 0
    value = _value(seen, rest, np.where(seen, known.counts[rx[hot]] - g.own_x[hot], known.counts[ry[hot]] - g.own_y[hot]), g.n[hot])
    values = np.bincount(g.text[hot], weights=value, minlength=len(doc)) if len(hot) else np.zeros(len(doc))
    seen_n = np.bincount(g.text[hot], weights=g.n[hot] * seen, minlength=len(doc)) if len(hot) else np.zeros(len(doc))
    own = np.flatnonzero((rx < 0) & (ry >= 0))
    bigrams(FIRST, own, by_first[g.x[own]], ry[own])
    own = np.flatnonzero((rx >= 0) & (ry < 0))
    bigrams(SECOND, own, by_second[g.y[own]], rx[own])
    own = np.flatnonzero((rx < 0) & (ry < 0))
    bigrams(FIRST_OF, own, by_first[g.x[own]], keys[g.y[own]])
    bigrams(SECOND_OF, own, by_second[g.y[own]], keys[g.x[own]])
    # texts' last words have no bigram that they begin, their first words none that they end
    has = np.flatnonzero(words.counts)
    ends = np.cumsum(words.counts)[has]
    for place, key in ((ends - 1, by_first), (ends - words.counts[has], by_second)):
        code = words.codes[place]
        rare = rank[code] < 0
        none = np.zeros(int(rare.sum()), np.int64)
        parts.append([none + ALONE, key[code[rare]], none, doc[has[rare]], none + 1, none, none])
    text = np.asarray(ids.fill_null(0)).astype(np.int64)
    parts.append([np.full(len(doc), TEXT), mixed(doc.view(np.uint64)).view(np.int64), text, doc, words.counts, np.asarray(ids.is_valid()) + 2 * seen_n.astype(np.int64), values.view(np.int64)])
    return np.stack([np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True)])


def _dealt(batches, known: Frequent, buckets: int):
    """(bucket, base, data): a slice's rows for each bucket, sorted by key."""
    for batch in batches:
        for a, b in slices(batch.column("text")):
            words = Words(utf8(batch.column("text").slice(a, b - a)))
            doc = batch.column("row_key_").slice(a, b - a).to_numpy()
            rows = exploded(words, doc, batch.column("doc_id").slice(a, b - a), known)
            rows = rows[:, np.argsort(rows[1])]
            bucket = (mixed(rows[1].view(np.uint64)) % np.uint64(buckets)).astype(np.int32 if buckets > 1 << 15 else np.int16)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[:, order], bucket[order]
            rows[3] -= doc[0]
            found = np.unique(bucket)
            cuts = [*np.searchsorted(bucket, found).tolist(), len(bucket)]
            data = [_packed(rows[:, i:j], 1) for i, j in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(np.full(len(found), doc[0])), pa.array(data, pa.binary())], ["bucket", "base", "data"])


def _bucket_scores(held: list[tuple[int, bytes]], counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, value, seen, words, id, known id) of a bucket: the sums of its rows, and the rows that stand for documents."""
    parts = []
    for base, data in held:
        part = _unpacked(data, 7, 1)
        part[3] += base
        parts.append(part)
    kind, key, other, doc, n, own_x, own_y = np.concatenate(parts, axis=1)
    times = np.where(kind == TEXT, 0, n)
    word_of, size = numbered(key)
    word = np.bincount(word_of, weights=times, minlength=size)[word_of]  # the rare word's count
    pair_of, size = numbered(word_of * np.int64(len(key)) + numbered(other)[0])
    rest = np.bincount(pair_of, weights=times, minlength=size)[pair_of] - n
    seen = rest > 0
    rank = np.where(kind == BOTH, np.where(seen, key >> 32, key & 0xFFFFFFFF), np.where(((kind == FIRST) & ~seen) | ((kind == SECOND) & seen), other, -1))
    if len(counts):
        word = np.where(rank >= 0, counts[np.maximum(rank, 0)], word)
    use = np.flatnonzero((kind < ALONE) & ~((kind == FIRST_OF) & ~seen) & ~((kind == SECOND_OF) & seen))
    value = _value(seen[use], rest[use], word[use] - np.where(seen, own_x, own_y)[use], n[use])
    text = np.flatnonzero(kind == TEXT)
    none = np.zeros(len(use), np.int64)
    both = ((doc[use], doc[text]), (value, own_y[text].view(np.float64)), (n[use] * seen[use], own_x[text] >> 1), (none, n[text]), (none, other[text]), (none, 1 + (own_x[text] & 1)))
    return tuple(np.concatenate(x) for x in both)


#: A document's parts; marked is 0 for a part of bigrams alone, 1 for that of a document without an id, 2 with one.
_PARTS = ["doc", "value", "seen", "words", "doc_id", "marked"]


def _scores(batches, counts: np.ndarray):
    """The parts of documents in each bucket. Buckets come sorted, each whole; one is held at a time."""
    held: list[tuple[int, bytes]] = []
    last = None
    for batch in batches:
        for bucket, base, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "base", "data")), strict=True):
            if held and bucket != last:
                yield _bucket_scores(held, counts)
                held = []
            held.append((base, data))
            last = bucket
    if held:
        yield _bucket_scores(held, counts)


def _dealt_parts(batches, counts: np.ndarray, buckets: int):
    """(bucket, data): a task's parts for each bucket of documents, sorted by document."""
    for doc, value, *rest in _added(_scores(batches, counts)):
        rows = np.stack([doc, value.view(np.int64), *rest])
        bucket = mixed(doc.view(np.uint64)) % np.uint64(buckets)
        order = np.lexsort((doc, bucket))
        rows, bucket = rows[:, order], bucket[order]
        found = np.unique(bucket)
        cuts = [*np.searchsorted(bucket, found).tolist(), len(bucket)]
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array([_packed(rows[:, i:j], 0) for i, j in zip(cuts, cuts[1:], strict=False)], pa.binary())], ["bucket", "data"])


def _documents(batches):
    """The parts of each document added up. Buckets come sorted, each whole; the sums of one are held at a time."""

    def parts(own):
        for data in own:
            doc, value, *rest = _unpacked(data, len(_PARTS), 0)
            yield doc, value.view(np.float64), *rest

    rows = (r for batch in batches for r in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist(), strict=True))
    for _, own in itertools.groupby(rows, lambda r: r[0]):
        for part in _added(parts(data for _, data in own), whole=True):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in part], _PARTS)


def scored(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, n_events, score) of docs with doc_id and text; score is the mean natural logarithm of S."""
    docs = docs.select("doc_id", "text").withColumn("row_key_", F.monotonically_increasing_id())
    known, n = frequent(docs, share), docs.count()
    sent = docs.sparkSession.sparkContext.broadcast(known)
    buckets, groups = max(1, -(-(known.total + n) // BUCKET)), max(1, -(-known.total // (4 * BUCKET)), -(-n // DOCUMENTS))
    dealt = docs.mapInArrow(lambda batches: _dealt(batches, sent.value, buckets), "bucket int, base long, data binary")
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket")
    parts = dealt.mapInArrow(lambda batches: _dealt_parts(batches, sent.value.counts, groups), "bucket int, data binary")
    parts = parts.repartition("bucket").sortWithinPartitions("bucket")
    sums = parts.mapInArrow(_documents, "doc long, value double, seen long, words long, doc_id long, marked long")
    events = F.greatest(F.col("words") - 1, F.lit(0)).cast("long")
    others = F.log(F.greatest(F.lit(known.total) - F.col("words"), F.lit(1)).cast("double"))
    score = F.try_divide(F.col("value") - (events - F.col("seen")) * others, events)
    return sums.select(F.when(F.col("marked") == 2, F.col("doc_id")).alias("doc_id"), events.alias("n_events"), F.round(score, 6).alias("score"))


def op8_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
word AS (SELECT r, unnest(w) AS x FROM texts),
own AS (SELECT r, x, count(*) AS n FROM word GROUP BY ALL),
uni AS (SELECT x, sum(n) AS n FROM own GROUP BY ALL),
every AS (SELECT sum(n) AS n FROM own),
pair AS (SELECT r, unnest(w[:-2]) AS x, unnest(w[2:]) AS y FROM texts WHERE len(w) > 1),
pairs AS (SELECT r, x, y, count(*) AS n FROM pair GROUP BY ALL),
bi AS (SELECT x, y, sum(n) AS n FROM pairs GROUP BY ALL),
part AS (SELECT p.r, p.n, bi.n - p.n AS rest, greatest(ux.n - ox.n, 0.5) AS first, greatest(uy.n - oy.n, 0.5) AS second
  FROM pairs p JOIN bi USING (x, y) JOIN uni ux ON ux.x = p.x JOIN uni uy ON uy.x = p.y
  JOIN own ox ON ox.r = p.r AND ox.x = p.x JOIN own oy ON oy.r = p.r AND oy.x = p.y),
total AS (SELECT t.r, t.doc_id, CAST(greatest(len(t.w) - 1, 0) AS BIGINT) AS n_events, CAST(greatest(every.n - len(t.w), 1) AS DOUBLE) AS others FROM texts t, every)
SELECT any_value(t.doc_id) AS doc_id, any_value(t.n_events) AS n_events,
  round(sum(p.n * CASE WHEN p.rest > 0 THEN ln(CAST(p.rest AS DOUBLE)) - ln(CAST(p.first AS DOUBLE)) ELSE ln(0.4) + ln(CAST(p.second AS DOUBLE)) - ln(t.others) END) / nullif(any_value(t.n_events), 0), 6) AS score
FROM total t LEFT JOIN part p USING (r) GROUP BY t.r
"""
