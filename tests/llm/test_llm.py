"""The corpus operators against plain versions, on supplied rows and on odd ones."""

import hashlib
import math
import os
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cyclemill.llm import backoff, catalog, language_id, media, mixing, near_dedup, packing, preferences, quality, shared, token_rollups, url_rules

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["size", "kept", "score", "lang_pred", "comp", "key", "n", "length", "offset", "target", "rank_", "id", "low", "high", "band_lang", "doc", "total", "events", "gram", "word", "x", "m", "hub"]


@pytest.fixture(scope="module")
def base(spark):
    shared.ship(spark)
    return shared.stored(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long")))


@pytest.fixture(scope="module")
def odd(spark, base):
    """Supplied rows and odd ones: nulls in every column, empty, blank and very long texts, copies, ties."""
    some = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in base.orderBy("doc_id").limit(60).collect()]
    text, long_text = some[0][1], " ".join(r[1] or "" for r in some[:40]) * 6
    rows = [(9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, " \t\n\r", None, "s", 3), (9004, text, None, None, None), (9005, text, "en", "s", 9), (9006, long_text, "en", "s", 9), (9007, "one two", "en", "t", 7), (9008, "ONE two", "en", "t", 7), (9009, "#*$ %& 123", "en", "t", 7), (9010, "a\u00a0b \u65e5\u672c", "en", "t", 5)]
    return shared.stored(spark.createDataFrame(some + rows, SCHEMA).repartition(3))


def clashing(df):
    return df.select("*", *(F.lit("x").alias(c) for c in CLASHES))


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def utf8(text):
    return (text or "").encode()


def test_registered():
    assert list(catalog.queries()) == ["pipeline", *(k for n in range(1, 14) for k in catalog.queries() if k.startswith(f"op{n}_"))]


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = catalog.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(repr([r[c] for c in names]) for r in got.collect()) == sorted(repr(list(r)) for r in want.fetchall())


# ---------------------------------------------------------------- 1


def test_carving_takes_time_in_proportion():
    """Begins of files without an end: each search of the rest of the blob is made once."""
    for begin in (b"%PDF-1 ", b"\xff\xd8\xff\xc0\x00\x04cd\xff\xda\x00\x03x\x01"):
        blob = begin * 200_000
        start = time.process_time()
        assert media.carve(blob) == [] and time.process_time() - start < 20


def test_media_round_trip(spark, odd):
    odd.select("doc_id", "text").write.mode("overwrite").parquet(path := shared.shared_dir(spark) + "/documents.parquet")
    texts = {r.doc_id: utf8(r.text) for r in odd.collect()}
    found = rows_of(media.op1_media_columns(spark, os.path.dirname(path)))
    assert len(found) == len(texts)
    for r in found:
        payload = media.padded(texts[r["doc_id"]])
        assert len(payload) % 192 == 0 and payload.startswith(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"]) == (len(texts[r["doc_id"]]), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
    assert all(r["payload_sha256"] in {v["payload_sha256"] for v in found} and len({(v["media_sha256"], v["feature"], v["media_type"], v["type_changed"]) for v in found if v["payload_sha256"] == r["payload_sha256"]}) == 1 for r in found)
    assert {r["type_changed"] for r in found} == {True, False} and "application/octet-stream" in {r["media_type"] for r in found}


def test_media_carving(spark):
    payload = bytes(range(192)) * 3
    files = [media.to_png(payload), media.to_bmp(payload), media.to_wav(payload)]
    kinds = ["image/png", "image/bmp", "audio/wav"]
    gif = b"GIF89a" + b"\x01\x00\x01\x00\x80\x00\x00" + bytes(6) + b"\x2c" + bytes(4) + b"\x01\x00\x01\x00\x00" + b"\x02\x02\x44\x01\x00" + b"\x3b"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x04cd\xff\xda\x00\x03x" + b"\x01\xff\x00\x02" + b"\xff\xd9"
    pdf = b"%PDF-1.4\nabc\nstartxref\n9\n%%EOF"
    updated = b"%PDF-1.7\nabc\nstartxref\n0\n%%EOF\nabc\nstartxref\n5\n%%EOF\nmore\nstartxref\n40\n%%EOF"
    filled = jpeg[:2] + b"\xff\xff" + jpeg[2:-2] + b"\xff\xff\xff\xd9"
    fields = struct.pack("<2sIIIIiiHHIIiiII", b"BM", 66 + 8, 0, 66, 40, 2, 1, 1, 32, 3, 8, 0, 0, 0, 0) + bytes(20)
    files += [gif, jpeg, pdf, updated, filled, fields]
    kinds += ["image/gif", "image/jpeg", "application/pdf", "application/pdf", "image/jpeg", "image/bmp"]
    rng = random.Random(4)
    for f, k in zip(files, kinds, strict=True):
        assert media.carve(f) == [(0, len(f), k)]
        for cut in (1, 7, len(f) // 2):
            assert not any(s == 0 and n > len(f) - cut for s, n, _ in media.carve(f[:-cut])) and (f is updated or not any(s == 0 for s, _, _ in media.carve(f[:-cut])))
    noise = bytes(rng.randrange(1, 60) for _ in range(50))
    blob, want = noise, []
    for f, k in zip(files, kinds, strict=True):
        want.append({"start": len(blob), "length": len(f), "type": k})
        blob += f + noise + b"BM" + noise + b"\x89PNG\r\n\x1a\n" + noise
    rows = [(1, blob, "text/plain"), (2, files[0], "image/gif"), (3, files[0], "image/png"), (4, None, "a/b"), (5, b"", None), (6, noise, None), (7, b"BM", "image/bmp")]
    df = spark.createDataFrame(rows, "id long, content binary, declared string").withColumn("media_type", F.lit(1))
    got = {r["id"]: (r["media_type"], r["type_changed"], r["media_spans"]) for r in rows_of(media.sniffed(df, "content", "declared"))}
    assert got[1] == ("text/plain", False, want)
    whole = [{"start": 0, "length": len(files[0]), "type": "image/png"}]
    assert got[2] == ("image/png", True, whole) and got[3] == ("image/png", False, whole)
    assert got[4] == (None, False, []) and got[5] == (None, False, []) and got[6] == (None, False, []) and got[7] == ("image/bmp", False, [])


# ---------------------------------------------------------------- 2


def plain_base(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)]


def test_quality(spark, odd):
    got = {r["doc_id"]: r for r in rows_of(quality.judge(clashing(odd)))}
    for r in odd.collect():
        g = got[r.doc_id]
        want = plain_base(r.text)
        assert [g[c] for c in quality.BASE_NAMES] == want and g["text"] == r.text and g["size"] == "x"
        assert g["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (g["kept"] and g["base_failed"]) and g["kept"] is not None
    assert quality.judge(odd.limit(0)).count() == 0


def test_quality_of_repeated_rows_and_clashing_names(spark, odd):
    """Equal rows give equal rows each, null ids too, and columns with the names used inside come out as they went in."""
    twice = odd.unionByName(odd).unionByName(odd.withColumn("doc_id", F.lit(None).cast("long")))
    names = ["low_", "high_", "band_lang_", "column_0_", "half", "gram", "own", "rest", "planted_nats_", "doc"]
    got = quality.judge(twice.select("*", *(F.lit(c).alias(c) for c in names)))
    assert got.count() == twice.count() and set(names) <= set(got.columns)
    verdicts = defaultdict(set)
    for r in got.collect():
        verdicts[r.text, r.lang].add((r.n_words, r.kept, r.nats))
        assert all(r[c] == c for c in names)
    assert all(len(v) == 1 for v in verdicts.values())


def test_repeat_words_in_parts():
    """Windows are told apart by all three words, whatever the size of the vocabulary."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(6)}" for _ in range(rng.randrange(40))) for _ in range(60)] + ["", "a", "a b a b a b"]
    got = quality.base_counts([utf8(t) for t in texts])
    assert got.tolist() == [plain_base(t) for t in texts]


def running(text):
    return quality.PAD + " ".join(WORD.findall(text))


@pytest.mark.parametrize("entries", [quality.ENTRIES, 3000])
def test_kneser_ney_is_a_distribution(spark, odd, entries):
    """Sums over all characters after a context are one, with n-grams left out too; scores are those of a plain walk."""
    docs = odd.where("doc_id < 9000")
    own, rest = quality.kneser_ney(docs, entries)
    p = {(r.lang, r.half, r.gram): r.own for r in own.collect()}
    b = {(r.lang, r.half, r.gram): r.rest for r in rest.collect()}
    models = sorted({k[:2] for k in p})
    assert entries == quality.ENTRIES or max(Counter((k[0], k[1], len(k[2])) for k in p).values()) <= entries / len(models)
    letters = {m: [g for lang, half, g in p if (lang, half) == m and len(g) == 1] for m in models}

    def prob(m, ctx, c):
        low = prob(m, ctx[1:], c) if ctx else 1 / (len(letters[m]) + 1)
        return p.get((*m, ctx + c), 0.0) + b.get((*m, ctx), 1.0) * low

    for *m, ctx in random.Random(1).sample(sorted(b), 60):
        assert sum(prob(tuple(m), ctx, c) for c in [*letters[tuple(m)], "\U0010ffff"]) == pytest.approx(1, abs=1e-9)
    got = {r.doc_id: r.nats for r in quality.score(odd, quality.fit(docs, entries)).collect()}
    for r in odd.collect():
        m, text = ("" if r.lang is None else f"={r.lang}", 1 - quality.half_of(utf8(r.text))), running(r.text or "")
        if m not in letters or text == quality.PAD:
            assert got[r.doc_id] is None
        elif len(text) < 3000:
            total = sum(-math.log(prob(m, text[i - 4 : i], text[i])) for i in range(4, len(text)))
            assert got[r.doc_id] == pytest.approx(total / (len(text) - 4), abs=1e-5)


def test_grams_of_many_letters():
    """Where n-grams don't fit one number, counts are the same."""
    rng = random.Random(5)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(9000)) * 2, "abc abc abc", "", "abc  abc\tabc"]
    kinds = np.array([0, 1, 1, 1])
    for some in (slice(0, 4), slice(1, 4)):
        grams = quality.Grams([t.encode() for t in texts[some]], kinds[some])
        assert grams.exact == (some.start == 1)
        kind, high, low, n = grams.counted(kinds[some])
        got = Counter()
        for k, g, c in zip(kind.tolist(), quality._strings(high, low).to_pylist(), n.tolist(), strict=True):
            got[k, g] += c
        want = Counter((k, running(t)[i - 4 : i + 1]) for t, k in zip(texts[some], kinds[some].tolist(), strict=True) for i in range(4, len(running(t))))
        assert got == want


def test_counts_of_the_model(spark, odd):
    """Every 5-gram of every text that passes the base rules, by language and half."""
    want = Counter()
    for r in odd.collect():
        n, *_, again = plain_base(r.text)
        if n >= 50 and 100 * again <= 50 * n:
            t = running(r.text)
            want.update((r.lang, quality.half_of(utf8(r.text)), t[i - 4 : i + 1]) for i in range(4, len(t)))
    got = Counter()
    for r in odd.select("lang", "text").mapInArrow(quality._count, "lang string, half int, gram string, n bigint").collect():
        got[r.lang, r.half, r.gram] += r.n
    assert got == want


def test_junk_at_both_ends(spark):
    """Supplied documents against planted junk that passes the base rules: words out of order and random letters lie over
    the band, most runs of a language's most frequent words under it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").where("lang = 'en'")
    rng = random.Random(8)
    texts = [r.text for r in docs.orderBy("doc_id").collect() if r.text]
    often = [w for w, _ in Counter(w for t in texts for w in t.split() if w.isalpha() and w.islower()).most_common(10)]
    some = [t for t in texts if 80 < len(t.split()) < 400][:60]
    junk = {}
    for i, t in enumerate(some):
        words = t.split()
        junk[10_000 + i] = " ".join(rng.sample(words, len(words)))
        junk[20_000 + i] = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in w) for w in words)
        junk[30_000 + i] = " ".join(rng.choice(often) for _ in range(150))
    every = shared.stored(docs.unionByName(spark.createDataFrame([(k, t, "en") for k, t in junk.items()], "doc_id long, text string, lang string")))
    model = quality.fit(docs)
    scored = shared.stored(quality.score(every, model))
    limit = quality.bands(scored.where("doc_id < 10000")).first()
    nats = {r.doc_id: r.nats for r in scored.where("not base_failed").collect()}
    kept = {k for k, v in nats.items() if limit.low_ <= v <= limit.high_}
    share = lambda a, b: np.mean([k in kept for k in nats if a <= k < b])
    assert share(0, 10_000) >= 0.96 and share(10_000, 20_000) <= 0.35 and share(20_000, 30_000) == 0
    assert share(30_000, 40_000) <= 0.5
    own = model.nats([utf8(t) for t in some], [model.number["=en", 1 - quality.half_of(utf8(t))] for t in some])
    worse = model.nats([quality.shuffled(utf8(t)) for t in some], [model.number["=en", 1 - quality.half_of(utf8(t))] for t in some])
    assert (worse > own).mean() >= 0.95


# ---------------------------------------------------------------- 3


def test_preferences(spark):
    schema = "pair_id long, side string, turn int, role string, text string"
    rows = [(1, s, *t) for s, more in (("chosen", [(3, "assistant", "yes"), (4, "user", "ok")]), ("rejected", [(3, "assistant", "no")])) for t in [(1, "user", "q"), (2, None, None), *more]]
    rows += [(2, s, 1, "user", "same") for s in ("chosen", "rejected")] + [(3, "chosen", 1, "user", "alone")] + [(4, s, 1, "assistant", s * 5000) for s in ("chosen", "rejected")]
    got = {r["pair_id"]: r for r in rows_of(preferences.formatted(spark.createDataFrame(rows, schema)))}
    assert set(got) == {1, 2, 4}
    assert got[1]["prompt"] == "<|user|>\nq<|end|>\n<||>\n<|end|>\n" and got[1]["n_common"] == 2
    assert got[1]["chosen"] == "<|assistant|>\nyes<|end|>\n<|user|>\nok<|end|>\n"
    span = got[1]["chosen_spans"][0]
    assert got[1]["chosen"][span["start"] :][: span["length"]] == "yes<|end|>\n" and len(got[1]["chosen_spans"]) == 1
    assert (got[2]["n_common"], got[2]["chosen"], got[2]["chosen_spans"]) == (1, "", [])
    assert got[4]["prompt"] == "" and got[4]["rejected_spans"][0]["length"] == 5000 * 8 + len("<|end|>\n")
    assert preferences.formatted(spark.createDataFrame([], schema)).count() == 0


# ---------------------------------------------------------------- 4


def test_rollups(spark):
    schema = "seq int, op string, doc_id long, source string, lang string, version string, tokens long"
    kept = token_rollups.Rollups(spark, shared.shared_dir(spark))
    assert kept.totals().count() == 0
    one = [(1, "insert", 1, "a", "en", "v", 5), (1, "insert", 2, "a", None, "v", 7), (1, "insert", 3, None, "en", "v", None), (1, "insert", None, "a", "en", "v", 9), (1, "insert", 1, "a", "en", None, 9)]
    two = [(1, "revise", 1, "a", "en", "v", 50), (2, "revise", 1, "b", "en", "v", 6), (1, "delete", 2, None, None, "v", 0), (1, "delete", 77, None, None, "v", 0), (1, "revise", 8, "a", "en", "v", 4)]
    assert kept.commit(1, spark.createDataFrame(one, schema)) and not kept.commit(1, spark.createDataFrame(two, schema))
    totals = lambda: {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in kept.totals().collect()}
    assert totals() == {("a", "en", "v"): (1, 5), ("a", None, "v"): (1, 7), (None, "en", "v"): (1, 0)}
    assert kept.commit(2, spark.createDataFrame(two, schema)) and not kept.commit(2, spark.createDataFrame(two, schema))
    assert totals() == {("a", "en", "v"): (1, 4), ("b", "en", "v"): (1, 6), (None, "en", "v"): (1, 0)}
    assert kept.commit(3, spark.createDataFrame([], schema)) and len(totals()) == 3
    ties = [(1, "insert", 5, "b", "en", "v", 2), (1, "insert", 5, "a", "en", "v", 2), (1, "insert", 5, "a", "en", "v", 2), (1, "revise", 5, "a", None, "v", 2), (1, "delete", 6, "a", "en", "v", 2), (1, "insert", 6, "a", "en", "v", 2)]
    clash = [F.lit("x").alias(c) for c in ("k", "bucket", "docs", "doc")]
    assert kept.commit(4, spark.createDataFrame(ties, schema).select("*", *clash)) and kept.committed() == [1, 2, 3, 4]
    assert totals() == {("a", "en", "v"): (2, 6), ("b", "en", "v"): (1, 6), (None, "en", "v"): (1, 0)}


def test_rollups_by_a_tokenizer(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = {r.doc_id: (r.version, r.tokens) for r in token_rollups.tokenizer_counts(odd, "word-bpe", path).collect()}
    assert got == {r.doc_id: ("word-bpe", len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect()}


def test_rollups_against_a_plain_ledger(spark):
    """Random batches, some sent twice, against a dictionary."""
    rng, schema = random.Random(7), "seq int, op string, doc_id long, source string, lang string, version string, tokens long"
    kept, plain = token_rollups.Rollups(spark, shared.shared_dir(spark)), {}
    for batch in range(4):
        rows = [(i, rng.choice(["insert", "delete", "revise"]), rng.randrange(12), rng.choice(["a", "b", None]), "en", rng.choice("vw"), rng.randrange(50)) for i in range(25)]
        changes = spark.createDataFrame(rows, schema)
        assert kept.commit(batch, changes) and not kept.commit(batch, changes)
        for _, op, doc, source, lang, version, tokens in rows:
            plain.pop((doc, version), None)
            if op != "delete":
                plain[doc, version] = (source, lang, tokens)
    want = Counter()
    for (_, version), (source, lang, tokens) in plain.items():
        want[source, lang, version, "docs"] += 1
        want[source, lang, version, "tokens"] += tokens
    got = Counter()
    for r in kept.totals().collect():
        got[r.source, r.lang, r.version, "docs"], got[r.source, r.lang, r.version, "tokens"] = r.docs, r.tokens
    assert +got == +want


# ---------------------------------------------------------------- 5


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(w)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_components(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    where = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            where[x].append(k)
    label = {k: k for k in texts}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, s in sets.items():
        for other, both in Counter(o for x in s for o in where[x]).items():
            if other > k and 100 * both >= 75 * (len(s) + len(sets[other]) - both):
                a, b = find(k), find(other)
                label[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), find(k)) for k in texts}


def near_copies(n, seed=3):
    """A group larger than SMALL and than a block's floor: copies at many distances of one text, some linked by chains."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(900)}" for _ in range(120)]
    out = []
    for _ in range(n):
        own = list(words)
        for _ in range(rng.randrange(9)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block", [512, 16])
def test_near_dedup(spark, odd, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    extra = spark.createDataFrame([(20_000 + i, t) for i, t in enumerate(near_copies(150))], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(extra)
    got = {r.doc_id: r for r in near_dedup.link(clashing(docs)).collect()}
    want = plain_components({r.doc_id: r.text for r in docs.collect()})
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_dedup_null_ids_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (4, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    got = sorted(repr(tuple(r)) for r in near_dedup.link(docs).collect())
    assert got == sorted(map(repr, [(None, 2, None, True), (3, 2, 3, True), (3, 2, 3, True), (4, 2, 3, False)]))
    assert near_dedup.link(docs.limit(0)).count() == 0
    assert near_dedup.deduplicated(docs.where("doc_id is not null").withColumn("comp", F.lit(1))).columns == ["doc_id", "text", "comp"]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**63, 4000, np.uint64)
    a, b = near_dedup.min_max(x[:3000]), near_dedup.min_max(x[1000:])
    assert abs((a == b).mean() - 0.5) < 0.12


# ---------------------------------------------------------------- 6


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    left, full = dict(sizes), {}
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = sum(sizes.values())
    while left:
        level = (total - sum(full.values())) / sum(weight[s] for s in left)
        over = [s for s in left if level * weight[s] > most * sizes[s] + 1e-9]
        if not over:
            return full | {s: level * weight[s] for s in left}
        for s in over:
            full[s] = most * sizes[s]
            del left[s]
    return full


def test_mixing(spark, odd, base):
    hot = spark.createDataFrame([(30_000 + i, "word " * (1 + i % 3), "en", "tiny", 0) for i in range(300)], SCHEMA)
    docs = clashing(base.unionByName(odd).dropDuplicates(["doc_id"]).unionByName(hot).drop("size"))
    got = rows_of(mixing.mix(docs))
    again = {r["doc_id"]: r["copies"] for r in rows_of(mixing.mix(docs.repartition(5)))}
    texts = {r.doc_id: r for r in docs.collect()}
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in got:
        d = texts[r["doc_id"]]
        assert r["size"] == len(WORD.findall(d.text or "")) and 0 <= r["copies"] <= 3 and again[r["doc_id"]] == r["copies"]
        sizes[d.source] += r["size"]
        taken[d.source] += r["copies"] * r["size"]
        largest[d.source] = max(largest[d.source], r["size"])
    want = plain_targets(sizes)
    for r in got:
        s = texts[r["doc_id"]].source
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s], rel=1e-9)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(1, largest[s])
    assert len(got) == len(texts) and mixing.mix(docs.limit(0)).count() == 0
    assert mixing.repeated(docs).count() == sum(r["copies"] for r in got)


def test_rates_solve_the_dual(spark, odd, base):
    """Rates against a bisection of each source's equation."""
    docs = base.unionByName(odd).dropDuplicates(["doc_id"])
    cells = defaultdict(Counter)
    for r in docs.collect():
        cells[r.source][len(WORD.findall(r.text or ""))] += 1
    want = plain_targets({s: sum(x * n for x, n in c.items()) for s, c in cells.items()})
    got = {}
    for r in mixing.mix(docs).collect():
        got[None if r.source_key == "1" else r.source_key[1:], r.size] = r.rate
    for s, c in cells.items():
        mean = sum(x * n for x, n in c.items()) / sum(c.values())
        if want[s] >= 3 * mean * sum(c.values()) * (1 - 1e-9):
            assert all(got[s, x] == 3 for x in c)
            continue
        low, high = -200.0, 200.0
        for _ in range(200):
            mid = (low + high) / 2
            took = sum(n * x * min(3.0, math.exp(min(mid * x / mean, 700))) for x, n in c.items())
            low, high = (mid, high) if took < want[s] else (low, mid)
        for x in c:
            assert got[s, x] == pytest.approx(min(3.0, math.exp(min(low * x / mean, 700))) if want[s] > 0 else 0.0, abs=1e-6)


def test_mixing_of_repeated_rows(spark):
    rows = [(None, "a b c", "en", None, 0), (1, "a b c", "en", "s", 0), (1, "a b c", "en", "s", 0), (1, None, "en", "s", 0), (2, "a", "en", "t", 0), (None, "a", "en", "t", 0)] * 7
    docs = shared.stored(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got, texts = mixing.mix(clashing(docs.drop("n_chars"))), Counter((r[0], r[1], r[3]) for r in rows)
    assert got.count() == len(rows)
    again = mixing.repeated(docs)
    assert again.columns == docs.columns
    for k, n in Counter((r.doc_id, r.text, r.source) for r in again.collect()).items():
        assert n <= 3 * texts[k]
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len((text or "").split())
    want, taken = plain_targets(sizes), Counter()
    for r in again.collect():
        taken[r.source] += len((r.text or "").split())
    assert all(abs(taken[s] - t) <= 3 for s, t in want.items())


# ---------------------------------------------------------------- 7


def plain_verdict(host, path, rules):
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, "allow")


@pytest.mark.parametrize("keys", [50, 1])
def test_urls(spark, monkeypatch, keys):
    monkeypatch.setattr(url_rules, "KEYS_A_RANGE", keys)
    rng = random.Random(2)
    hosts = ["a.com", "b.a.com", "com", "x.b.a.com", "ba.com", "a.org", "", "ex-a.com", "A.COM"]
    paths = ["/", "/p", "/p/q", "/p/q/r?x=/s", "", "/pq#z", "?only", "/\u00e9/\U0001f600"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)] + [None, "", "no scheme/p", "x://", "http://b.a.com/p/q", "a://b://c/d"]
    rules = sorted({(h, p): (h, p, v) for h, p, v in [(rng.choice(hosts[:6]), rng.choice(["/", "/p", "/p/q", "", "/\u00e9"]), rng.choice(["allow", "block"])) for _ in range(25)]}.values())
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("host", F.lit(2))
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r["page_id"]: r for r in rows_of(url_rules.judged(pages, table))}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        assert (got[i]["rule"], got[i]["verdict"]) == plain_verdict(host, path, rules)
    assert len(got) == len(urls)
    assert {r["verdict"] for r in rows_of(url_rules.judged(pages, table.limit(0)))} == {"allow"}
    assert url_rules.judged(pages.limit(0), table).count() == 0


# ---------------------------------------------------------------- 8


def plain_scores(texts):
    """(n_events, score) of each text, from counts of the words themselves."""
    words = [WORD.findall(t or "") for t in texts]
    uni, bi = Counter(x for w in words for x in w), Counter(p for w in words for p in zip(w, w[1:], strict=False))
    total, out = sum(uni.values()), []
    for w in words:
        own, value = Counter(w), 0.0
        for (x, y), n in Counter(zip(w, w[1:], strict=False)).items():
            first, second, c = max(uni[x] - own[x], backoff.ADD), max(uni[y] - own[y], backoff.ADD), bi[x, y] - n
            value += n * (math.log(c / first) if c > 0 else math.log(backoff.ALPHA * second / max(total - len(w), 1)))
        out.append((max(len(w) - 1, 0), round(value / (len(w) - 1), 4) if len(w) > 1 else None))
    return out


@pytest.mark.parametrize(("share", "split"), [(backoff.SHARE, backoff.SPLIT), (2e-3, backoff.SPLIT), (2e-3, 5), (2.0, 5)])
def test_backoff(spark, odd, base, monkeypatch, share, split):
    """All words frequent, some, some with bigrams dealt in parts, and none; repeated rows and null ids; words whose hashes begin alike."""
    monkeypatch.setattr(backoff, "SPLIT", split)
    monkeypatch.setattr(backoff, "HOT", 0)
    monkeypatch.setattr(backoff, "BUCKET", 3000)
    monkeypatch.setattr(backoff, "DOCUMENTS", 20)
    slot, alike = {}, []
    for i in range(20_000):
        w = f"w{i}"
        other = slot.setdefault(backoff.xxhash.xxh3_64_intdigest(w.encode()) >> 43, w)
        if other != w:
            alike.append((other, w))
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(r.doc_id, r.text) for r in base.orderBy("doc_id").limit(30).collect()]
    rows += [(None, rows[3][1]), (None, "a b"), (None, "a b a"), (None, None), (-1, "a"), (7, "b a"), (7, "b a")]
    for i, (a, b) in enumerate(alike[:10]):
        rows += [(50_000 + i, f"{a} common end"), (60_000 + i, f"{b} common end"), (70_000 + i, f"common {a} {b} {b}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_events, None if r.score is None else round(r.score, 4)) for r in backoff.scored(clashing(docs), share).collect())
    assert got == Counter((i, *v) for (i, _), v in zip(rows, plain_scores([t for _, t in rows]), strict=True))
    assert backoff.scored(odd.limit(0), share).count() == 0


def test_frequent_words_are_few(spark, base, monkeypatch):
    found = backoff.frequent(base, 1e-3)
    texts = [WORD.findall(r.text or "") for r in base.collect()]
    want = Counter(w for t in texts for w in t)
    assert found.total == sum(want.values()) and 0 < len(found.keys) <= 1000 and not len(found.pairs)
    assert found.counts.tolist() == sorted((n for n in want.values() if n >= 1e-3 * found.total), reverse=True) and (found.docs <= found.counts).all()
    monkeypatch.setattr(backoff, "SPLIT", 20)
    monkeypatch.setattr(backoff, "HOT", 0)
    found = backoff.frequent(base, 1e-3)
    pairs, in_docs = Counter(p for t in texts for p in zip(t, t[1:], strict=False)), Counter(p for t in texts for p in set(zip(t, t[1:], strict=False)))
    often = {w for w, n in want.items() if n >= 1e-3 * found.total}
    assert sorted(found.pair_counts.tolist()) == sorted(pairs[p] for p, n in in_docs.items() if n > 20 and set(p) <= often) != []


def test_packed_rows():
    rows = np.random.default_rng(3).integers(-(2**63), 2**63, (7, 1000))
    for steps in (0, 1):
        assert (backoff._unpacked(backoff._packed(rows, steps), 7, steps) == rows).all()


def test_packed_row_alone():
    """A bucket with one row of a slice: its bytes lie in order as they come out of the decompressor, which can't be written to."""
    for n in (0, 1, 2):
        rows = np.arange(7 * n, dtype=np.int64).reshape(7, n) - 3
        for steps in (0, 1):
            got = backoff._unpacked(backoff._packed(rows, steps), 7, steps)
            assert (got == rows).all() and got.flags.writeable


# ---------------------------------------------------------------- 9


def test_language(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    train = docs.where(f"not {language_id.HELD_OUT}")
    model = language_id.fit(train)
    held = rows_of(language_id.predict(docs.where(language_id.HELD_OUT), model))
    right = [r["lang"] == r["lang_pred"] for r in held if r["lang"] and re.search(r"[^\W\d_]", r["text"] or "")]
    assert len(right) > 200 and np.mean(right) >= 0.97
    got = {r["doc_id"]: r for r in rows_of(language_id.predict(clashing(odd), model))}
    for k in (9001, 9002, 9003):
        assert (got[k]["lang_pred"], got[k]["score"]) == ("und", 0.0)
    assert got[9009]["lang_pred"] == "und" and got[9005]["lang_pred"] == got[9004]["lang_pred"]
    assert all(0 <= r["score"] <= 1 and r["key"] == "x" for r in got.values())
    none = language_id.fit(train.limit(0))
    assert {r["lang_pred"] for r in rows_of(language_id.predict(odd, none))} == {"und"}
    assert language_id.predict(odd.limit(0), model).count() == 0


def test_filter_against_exact_sets(spark, base):
    """Hits of the filter against sets of n-grams: none is missed, and few are extra."""
    model = language_id.fit(base)
    texts = [r.text for r in base.where("text is not null and lang is not null").limit(30).collect()]
    words = shared.Words([utf8(t) for t in texts]).distinct
    n, per = language_id.hits(model, words)
    counts = defaultdict(Counter)
    for r in base.where("text is not null and lang is not null").collect():
        w = shared.Words([utf8(r.text)])
        h, owner = language_id.grams(w.distinct)
        times = np.bincount(w.codes, minlength=len(w.distinct))
        for x, k in zip(h.tolist(), times[owner].tolist(), strict=True):
            counts[r.lang][x] += k
    share = {lang: {g: c / sum(cs.values()) for g, c in cs.items()} for lang, cs in counts.items()}
    top = Counter()
    for s in share.values():
        for g, v in s.items():
            top[g] = max(top[g], v)
    h, owner = language_id.grams(words)
    for i, lang in enumerate(model.languages):
        s = share[lang]
        exact = np.bincount(owner, weights=[float(s.get(g, 0) >= language_id.MIN_SHARE and s.get(g, 0) >= language_id.RATIO * top[g]) for g in h.tolist()], minlength=len(words))
        assert (per[:, i] >= exact).all() and per[:, i].sum() - exact.sum() <= 0.02 * n.sum()


def test_predictions_against_exact_sets(spark, base, odd):
    """Language and score by sets of n-grams: with a filter of few false positives they are nearly the same."""
    model = language_id.fit(base)
    counts = defaultdict(Counter)

    def grams_of(text):
        w = shared.Words([utf8(text)])
        h, owner = language_id.grams(w.distinct)
        return Counter(dict(zip(*(x.tolist() for x in np.unique(np.repeat(h, np.bincount(w.codes, minlength=len(w.distinct))[owner]), return_counts=True)), strict=True)))

    for r in base.where("text is not null and lang is not null").collect():
        counts[r.lang].update(grams_of(r.text))
    total = {k: sum(c.values()) for k, c in counts.items()}
    top = Counter()
    for k, c in counts.items():
        for g, n in c.items():
            top[g] = max(top[g], n / total[k])
    sets = {k: {g for g, n in c.items() if n / total[k] >= language_id.MIN_SHARE and n / total[k] >= language_id.RATIO * top[g]} for k, c in counts.items()}
    rows, same = rows_of(language_id.predict(clashing(odd.unionByName(odd)), model)), []
    for r in rows:
        own = grams_of(r["text"])
        if not re.search(r"[^\W\d_]", r["text"] or "") or not own:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        hits = {k: sum(n for g, n in own.items() if g in x) / sum(own.values()) for k, x in sets.items()}
        best = max(hits.values())
        same.append(hits[r["lang_pred"]] == best)
        assert hits[r["lang_pred"]] >= best - 0.02 and r["score"] == pytest.approx(best, abs=0.02)
    assert len(rows) == 2 * odd.count() and np.mean(same) >= 0.99


def test_the_filter_grows_with_its_grams(spark):
    rows = [("x", " ".join("".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=8)) for i in range(j, j + 400))) for j in range(0, 8000, 400)]
    model = language_id.fit(spark.createDataFrame([*rows, ("y", "la le li lo")], "lang string, text string"))
    assert model.bits > language_id.LEAST_BITS and model.false_rate.max() < 0.05


# ---------------------------------------------------------------- 10


def test_packing(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    special = ["a <|endoftext|> b", "<|startoftext|>x", "x<|endoftext|>y <|endoftext|>", "<| endoftext |>", "<|ENDOFTEXT|> it's 'super' '' --'s"]
    odd = odd.unionByName(spark.createDataFrame([(40_000 + i, t, "en", "s", 0) for i, t in enumerate(special)], SCHEMA))
    got = defaultdict(list)
    bins = defaultdict(list)
    for r in rows_of(packing.pack_documents(clashing(odd), path)):
        got[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for r in odd.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, packing.END_ID]
        own = sorted(got[r.doc_id], key=lambda x: x["piece"])
        assert [x["start"] for x in own] == list(range(0, len(ids), packing.CAPACITY))
        for i, x in enumerate(own):
            part = np.array(ids[x["start"] : x["start"] + packing.CAPACITY], "<u4")
            assert (x["piece"], x["length"], x["ids_crc32"]) == (i, len(part), zlib.crc32(part.tobytes()))
    total = 0
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
        total += at
    assert len(bins) <= total / packing.CAPACITY * 1.05 + 1
    assert packing.pack_documents(odd.limit(0), path).count() == 0


def test_ids_of_any_unicode():
    """10,000 strings of all code points, unassigned and newest ones too, and of special tokens, against the tokenizer as it is."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, rng = Tokenizer.from_file(path), random.Random(6)
    odd = packing.odd_points(path)
    ids = packing.WordIds(path, packing.classes(path))
    assert not odd[:0x250].any() and odd[0xE0FFF]
    pools = [range(32, 127), range(9, 0x250), range(0x250, 0x3000), range(0x3000, 0xD800), range(0xE000, 0x10000), range(0x10000, 0x20000), range(0x20000, 0x110000), [ord(c) for c in "ab 's 1."]]
    pieces = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "'s", "'re", " ", "\u00c5", "A\u030a", "\u03a3", "\u0130", "\u212a"]
    texts = []
    for _ in range(10_000):
        pool = [rng.choice(pools) for _ in range(rng.randrange(1, 4))]
        texts.append("".join(rng.choice(pieces) if rng.random() < 0.1 else chr(rng.choice(rng.choice(pool))) for _ in range(rng.randrange(1, 30))))
    for i in range(0, len(texts), 500):
        some = texts[i : i + 500]
        got, ends = packing.document_ids([t.encode() for t in some], ids)
        want = [[*e.ids, packing.END_ID] for e in tok.encode_batch(some, add_special_tokens=False)]
        for t, g, w in zip(some, np.split(got, ends[:-1]), want, strict=True):
            assert g.tolist() == w, ascii(t)


def test_packing_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, None), (None, ""), (2, "x " * 5000), (2, "x " * 5000)], "doc_id long, text string")
    got = rows_of(packing.pack_documents(docs.withColumn("piece", F.lit("p")).withColumn("length", F.lit(0))))
    assert Counter((r["doc_id"], r["piece"], r["length"]) for r in got) == Counter([(1, 0, 3), (1, 0, 3), (None, 0, 3), (None, 0, 1), (None, 0, 1), *[(2, k, n) for k, n in ((0, 2048), (1, 2048), (2, 905)) for _ in range(2)]])
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)


def test_plan():
    rng = random.Random(8)
    for _ in range(40):
        cap = rng.choice([10, 60, 2048])
        counts = Counter(min(cap, max(1, int(rng.expovariate(4 / cap)))) for _ in range(rng.randrange(1, 400)))
        placed = Counter()
        for k, items in packing.plan(counts, cap):
            assert sum(items) <= cap
            for x in items:
                placed[x] += k
        assert placed == counts
        best_fit = []
        for x in sorted(counts.elements(), reverse=True):
            at = min((i for i, g in enumerate(best_fit) if g >= x), key=lambda i: best_fit[i], default=None)
            if at is None:
                best_fit.append(cap - x)
            else:
                best_fit[at] -= x
        assert sum(k for k, _ in packing.plan(counts, cap)) <= len(best_fit) + 1
    assert packing.plan({}) == []


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, odd):
    docs = odd
    for c in ["extra", "kept", "lang_pred", *(c for c in CLASHES if c not in ("kept", "lang_pred")), "column_1_", "row_key_", "copies_", "size", "nats"]:
        docs = docs.withColumn(c, F.lit("x"))
    seen = [{r.doc_id for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.stored(stage(spark, docs, SF))
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert seen[-1] <= seen[-2], name
    assert not seen[1] & {9001, 9002, 9003} and 9007 not in seen[2]
    assert seen[3] == {c for c in (v[1] for k, v in plain_components({r.doc_id: r.text for r in odd.collect() if r.doc_id in seen[2]}).items())}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.agg(F.sum((F.col("piece") == 0).cast("int"))).first()[0] == docs.count()
    empty = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_keys_of_rows(spark, tmp_path):
    """The same in every job, for files whose names need escapes too, and for rows that are no plain scan."""
    path = str(tmp_path / "a b%20c")
    spark.range(1000).withColumn("text", F.lit("x")).repartition(5).write.parquet(path)
    for df in (spark.read.parquet(path), spark.read.parquet(path).select(F.col("id").alias("row_"), "text").where("row_ > 10"), spark.read.parquet(path).groupBy("id").count()):
        rows = shared.keyed(df)
        name = df.columns[0]
        once = {r[name]: r.row_key_ for r in rows.select(name, "row_key_").collect()}
        again = {r[name]: r.row_key_ for r in rows.where(F.col(name) % 7 == 0).coalesce(1).collect()}
        assert len(set(once.values())) == len(once) == df.count() and all(once[k] == v for k, v in again.items())
        assert rows.columns == [*df.columns, "row_key_"]
        assert shared.without(rows, rows.where(F.col(name) % 2 == 0)).count() == df.where(F.col(name) % 2 == 1).count()


def test_stages_with_repeated_and_null_ids(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    rows = [(None, a), (None, a), (7, a), (7, a), (7, b), (8, b), (None, "only one of this kind"), (5, "one more text of five"), (5, "and another under its id"), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.distinct(spark, docs, SF).collect())
    assert got == Counter([(7, a), (7, b), (None, "only one of this kind"), (5, "one more text of five"), (5, "and another under its id"), (None, None), (None, None)])
    many = [(None if i % 3 else i % 2, f"word{i} " * (1 + i % 4), "en", "xyz"[i % 3], 0) for i in range(90)]
    docs = shared.stored(spark.createDataFrame(many, SCHEMA).repartition(3))
    again = Counter(r.text for r in corpus_pipeline.mixed(spark, docs, SF).collect())
    assert max(again.values()) <= mixing.MOST and sum(again.values()) == mixing.mix(docs.withColumn("doc_id", F.monotonically_increasing_id())).agg(F.sum("copies")).first()[0]
