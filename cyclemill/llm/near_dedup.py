"""Near-duplicate documents by min-max hashing of 5-word shingles, confirmed on full shingle sets.

Under each of PERMUTATIONS hash functions a document's smallest and its largest shingle are kept: two values of a
signature for one evaluation. The values are cut into BANDS bands of ROWS; documents that share a band are candidates.
At a similarity of 0.75 a pair shares none with probability (1 - 0.75**5)**40 = 2e-5, at 0.8 with 1e-7.

Documents with equal sets are one class before anything else, and only its smallest doc_id goes on. In each band's group
the smallest doc_id is the hub. Each document's hub with which it shares the most bands is confirmed first, and once more
among the hubs of other components; that leaves few components in a group of copies, however large. Then every group that still holds several components is compared throughout: small ones
by a join, the others in blocks of about BLOCK documents a side, inside tasks: there pairs that pass the signatures'
estimate are confirmed on full sets, and only links that join components leave the task. So nothing is capped: each
candidate pair is either in one component already, or confirmed or refuted.

Null and empty texts have an empty set: n_shingles 0, linked with nothing, a component of their own. Texts of one to four
words are one shingle. Rows with an equal doc_id are one document with the first of their texts in no given order, so
doc_id should be unique; a null doc_id links with nothing and is its own (null) component, kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclemill.llm.components import components
from cyclemill.llm.shared import MAX_IDS, Words, apart, keyed, lean, mixed, slices, stored, table, utf8, without

SHINGLE = 5
PERMUTATIONS = 100
ROWS = 5
BANDS = 2 * PERMUTATIONS // ROWS
PERCENT = 75
#: Signature values compared by an estimate, a byte each, and how many must agree: six standard deviations under 75%.
BYTES = 128
AGREE = 66
#: How often each document's best hub is confirmed before groups are compared throughout.
HUB_ROUNDS = 2
#: Groups up to so many documents are compared by a join; larger ones in blocks.
SMALL = 16
BLOCK = 512

_RNG = np.random.default_rng(20240531)
_A = _RNG.integers(0, 2**63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, PERMUTATIONS, np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    words = Words([t.lower() for t in texts])  # of bytes: A-Z only
    own = np.array([xxhash.xxh3_64_intdigest(w) for w in words.distinct], np.uint64)
    own = own[words.codes] if len(words.codes) else own
    ends = np.cumsum(words.counts)
    with np.errstate(over="ignore"):
        h = own.copy()
        for k in range(1, SHINGLE):
            h = h[:-1] * _P + own[k:] if len(h) > 1 else h[:0]
        h = mixed(h)
    out = []
    for end, n in zip(ends.tolist(), words.counts.tolist(), strict=True):
        if n >= SHINGLE:
            out.append(np.unique(h[end - n : end - SHINGLE + 1]))
        elif n:
            with np.errstate(over="ignore"):
                x = np.uint64(n)
                for w in own[end - n : end]:
                    x = x * _P + w
            out.append(mixed(np.array([x], np.uint64)))
        else:
            out.append(own[:0])
    return out


def min_max(shingles: np.ndarray) -> np.ndarray:
    """The signature: the minimum under each permutation, then the maximum under each."""
    low, high = np.full(PERMUTATIONS, 2**64 - 1, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(shingles), 4096):
        x = _A[:, None] * shingles[None, i : i + 4096] + _B[:, None]
        np.minimum(low, x.min(1), out=low)
        np.maximum(high, x.max(1), out=high)
    return np.concatenate([low, high])


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature. Neighbouring bands mix minima of different permutations."""
    with np.errstate(over="ignore"):
        parts = signatures.reshape(len(signatures), BANDS, ROWS)
        h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), parts.shape[:2]).copy()
        for k in range(ROWS):
            h = mixed(h * _P + parts[:, :, k])
    return h


def _signatures(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])
    for batch in batches:
        for a, b in slices(batch.column("text"), 2 << 20):
            ids = batch.column("doc_id").slice(a, b - a)
            sets = shingle_sets(utf8(batch.column("text").slice(a, b - a)))
            n = np.array([len(x) for x in sets], np.int64)
            both = np.array([xxhash.xxh3_128_intdigest(x.tobytes()) for x in sets], object)
            s1 = np.array([x >> 64 for x in both], np.uint64).view(np.int64)
            s2 = np.array([x & (2**64 - 1) for x in both], np.uint64).view(np.int64)
            signatures = np.stack([min_max(x) for x in sets])
            keys = band_keys(signatures).view(np.int64)
            short = (mixed(signatures[:, :: 2 * PERMUTATIONS // BYTES][:, :BYTES]) & np.uint64(255)).astype(np.uint8)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(n), pa.array(s1), pa.array(s2), lists, pa.array([x.tobytes() for x in short], pa.binary())], schema=schema)


def _sets(batches):
    for batch in batches:
        for a, b in slices(batch.column("text")):
            sets = shingle_sets(utf8(batch.column("text").slice(a, b - a)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).cast(pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["doc_id", "shingles"])


def _bytes_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _estimated(batches):
    """(a, b, agree) of the pairs whose signatures agree often enough."""
    for batch in batches:
        if batch.num_rows:
            agree = (_bytes_matrix(batch.column("sig_a")) == _bytes_matrix(batch.column("sig_b"))).sum(1).astype(np.int64)
            keep = np.flatnonzero(agree >= AGREE)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep)), batch.column("b").take(pa.array(keep)), pa.array(agree[keep])], ["a", "b", "agree"])


def _confirmed(batches):
    for batch in batches:
        left, right = batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()
        keep = []
        for i, (x, y) in enumerate(zip(left, right, strict=True)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= PERCENT * (len(x) + len(y) - both):
                keep.append(i)
        take = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take)], ["a", "b"])


def set_table(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, shingles) of the docs whose doc_id is in ids."""
    ids = stored(ids.distinct())
    texts = docs.join(F.broadcast(ids) if ids.count() <= MAX_IDS else ids, "doc_id", "left_semi")
    return stored(texts.mapInArrow(lean(_sets), "doc_id long, shingles binary"))


def confirm(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of doc_ids whose full sets are alike enough."""
    sets = set_table(docs, pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))))
    a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    return stored(pairs.select("a", "b").join(a, "a").join(b, "b").mapInArrow(lean(_confirmed), "a long, b long"))


def overlaps(x: np.ndarray, others: list[np.ndarray], limit: int = 1 << 19) -> np.ndarray:
    """How many of x's shingles each other set has; all sorted, none empty. About `limit` are looked up at a time."""
    out = np.empty(len(others), np.int64)
    start = 0
    while start < len(others):
        stop, held = start, 0
        while stop < len(others) and (not held or held + len(others[stop]) <= limit):
            held += len(others[stop])
            stop += 1
        sizes = np.array([len(y) for y in others[start:stop]])
        y = np.concatenate(others[start:stop])
        hit = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
        out[start:stop] = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
        start = stop
    return out


def _links_of(t: pa.Table) -> pa.RecordBatch:
    """(a, b) of one block: links confirmed on full sets that join all that its pairs join.

    A pair is looked at in the first band that it shares, and only while its two are not joined yet.
    """
    first, comp, n, doc = (t[x].to_numpy() for x in ("first", "comp", "n", "doc_id"))
    comp = comp.copy()
    sig = _bytes_matrix(t["sig"].combine_chunks())
    bands = t["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    sets = [np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()]
    band = int(np.flatnonzero(bands[0] == t["key"][0].as_py())[0])
    same = t["lo"][0].as_py() == t["hi"][0].as_py()
    left = np.arange(len(doc)) if same else np.flatnonzero(first)
    right = np.arange(len(doc)) if same else np.flatnonzero(~first)
    a, b = [], []
    for i in left.tolist():
        other = right[(comp[right] != comp[i]) & (100 * np.minimum(n[right], n[i]) >= PERCENT * np.maximum(n[right], n[i]))]
        other = other[other > i] if same else other
        other = other[(sig[other] == sig[i]).sum(1) >= AGREE]
        other = other[~(bands[other, :band] == bands[i, :band]).any(1)]
        if not len(other):
            continue
        both = overlaps(sets[i], [sets[k] for k in other])
        for k in other[100 * both >= PERCENT * (n[i] + n[other] - both)].tolist():
            if comp[k] != comp[i]:
                comp[comp == comp[k]] = comp[i]
                a.append(min(doc[i], doc[k]))
                b.append(max(doc[i], doc[k]))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _block_links(batches):
    """Links of each block. Blocks come sorted, each whole; one is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(x).to_numpy() for x in ("key", "lo", "hi")], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            now = tuple(key[x])
            if held and now != last:
                yield _links_of(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(x, y - x))
            last = now
    if held:
        yield _links_of(pa.Table.from_batches(held))


def link(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of docs with doc_id and text."""
    docs = docs.select("doc_id", "text")
    sig = stored(docs.mapInArrow(lean(_signatures), "doc_id long, n long, s1 long, s2 long, bands array<long>, sig binary"))
    reps = sig.where("n > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "n", "bands", "sig")).alias("r"))
    reps = stored(reps.select("s1", "s2", "r.*"))
    rows = reps.select("doc_id", F.explode("bands").alias("key"))
    hubs = rows.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1")
    members = stored(rows.join(hubs, "key").select("key", "m", "hub", "doc_id"))
    short = reps.select("doc_id", "n", "sig")

    def estimate(pairs: DataFrame) -> DataFrame:
        a = short.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
        b = short.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
        near = f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)"
        return pairs.join(a, "a").join(b, "b").where(near).select("a", "b", "sig_a", "sig_b").mapInArrow(lean(_estimated), "a long, b long, agree long")

    shared = stored(members.where("doc_id <> hub").groupBy(F.col("hub").alias("a"), F.col("doc_id").alias("b")).agg(F.count(F.lit(1)).alias("bands")))
    links = tested = comps = None
    for _ in range(HUB_ROUNDS):
        left = shared
        if comps is not None:
            left = shared.join(tested, ["a", "b"], "left_anti")
            for x in ("a", "b"):
                left = left.join(comps.select(F.col("id").alias(x), F.col("comp").alias(f"comp_{x}")), x, "left")
            left = left.where("coalesce(comp_a, a) <> coalesce(comp_b, b)")
        best = stored(left.groupBy("b").agg(F.max(F.struct("bands", (-F.col("a")).alias("minus"))).alias("x")).select((-F.col("x.minus")).alias("a"), "b"))
        found = confirm(docs, best)
        links = found if links is None else links.unionByName(found)
        tested = best if tested is None else tested.unionByName(best)
        comps = components(links)

    placed = members.join(comps.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
    mixed_keys = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    open_ = stored(placed.join(mixed_keys, "key", "left_semi").select("key", "m", "doc_id", "comp"))
    few = open_.where(F.col("m") <= SMALL)
    a = few.select("key", F.col("doc_id").alias("a"), F.col("comp").alias("comp_a"))
    b = few.select("key", F.col("doc_id").alias("b"), F.col("comp").alias("comp_b"))
    small = estimate(a.join(b, "key").where("a < b and comp_a <> comp_b").select("a", "b").distinct())
    many = open_.where(F.col("m") > SMALL)
    sets = set_table(docs, many.select("doc_id"))
    many = many.join(reps.select("doc_id", "n", "bands", "sig"), "doc_id").join(sets, "doc_id").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    many = many.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).withColumn("first", F.col("own") == F.col("lo"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = many.select("key", "lo", "hi", "first", "doc_id", "comp", "n", "sig", "bands", "shingles").repartition(parts, "key", "lo", "hi")
    across = stored(many.sortWithinPartitions("key", "lo", "hi").mapInArrow(lean(_block_links), "a long, b long"))
    rest = stored(small.select("a", "b").join(tested, ["a", "b"], "left_anti"))
    final = components(links.unionByName(across).unionByName(confirm(docs, rest)))

    whole = reps.join(final.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("s1", "s2", F.coalesce("comp", "doc_id").alias("component_id"))
    found = sig.where("n > 0 and doc_id is not null").select("doc_id", "n", "s1", "s2").join(whole, ["s1", "s2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = sig.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each component of docs, that with the smallest doc_id (a null one is the last). Rows are told apart by a
    key of their own, not by doc_id. The texts are shuffled only if more than MAX_IDS rows go."""
    columns, docs = docs.columns, apart(docs, "doc_id", "text")
    own = docs.columns
    rows = keyed(docs)
    linked = link(rows.select(F.col("row_key_").alias("doc_id"), "text")).select(F.col("doc_id").alias("row_key_"), "component_id")
    linked = stored(linked.join(rows.select("row_key_", "doc_id"), "row_key_"))
    first = linked.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key_")).alias("x"))
    gone = linked.join(first.select(F.col("x.row_key_").alias("row_key_")), "row_key_", "left_anti")
    return without(rows, gone).select(*own).toDF(*columns)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
