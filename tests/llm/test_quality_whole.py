"""The quality rules' model has every n-gram, however rare and whatever the size of the corpus."""

import math
import random
from collections import Counter, defaultdict

import pytest

from cyclemill.llm import quality

ORDER = quality.ORDER


def running(text):
    return quality.PAD + " ".join(text.split())


def plain_model(texts):
    """Probabilities of a modified Kneser-Ney model of these texts, with nothing left out."""
    n = {ORDER: Counter(running(t)[i - 4 : i + 1] for t in texts for i in range(4, len(running(t))))}
    raw = dict(n)
    for k in range(ORDER - 1, 0, -1):
        left, raw[k] = Counter(g[1:] for g in n[k + 1]), Counter()
        for g, c in raw[k + 1].items():
            raw[k][g[1:]] += c
        n[k] = Counter({g: raw[k][g] if g[0] == "\n" else c for g, c in left.items()})
    less, total, rest = {}, {}, {}
    for k, counts in n.items():
        few = [sum(c == i for c in counts.values()) for i in range(5)]
        y = few[1] / (few[1] + 2 * few[2]) if few[1] + few[2] else 0
        d = [0] + [min(max(i - (i + 1) * y * (few[i + 1] / few[i] if few[i] else 0), 0.1 * i), 0.95 * i) for i in (1, 2, 3)]
        less[k], total[k], rest[k] = d, Counter(), defaultdict(float)
        for g, c in counts.items():
            total[k][g[:-1]] += c
            rest[k][g[:-1]] += d[min(c, 3)]

    def p(gram):
        if not gram:
            return 1 / (len(n[1]) + 1)
        k, context = len(gram), gram[:-1]
        lower = p(gram[1:])
        if not total[k][context]:
            return lower
        c = n[k][gram]
        return (c - less[k][min(c, 3)]) / total[k][context] + rest[k][context] / total[k][context] * lower

    return p


def plain_nats(texts):
    models = {}
    for lang, text in set(texts):
        models.setdefault((lang, quality.half_of(text.encode())), [])
    for lang, text in texts:
        if not quality._passes(quality.base_counts([text.encode()]))[0]:
            continue
        models[lang, quality.half_of(text.encode())].append(text)
    models = {m: plain_model(t) for m, t in models.items() if t}
    out = {}
    for lang, text in set(texts):
        p, t = models.get((lang, 1 - quality.half_of(text.encode()))), running(text)
        own = range(4, len(t))
        out[lang, text] = -sum(math.log(p(t[i - 4 : i + 1])) for i in own) / len(own) if p and own else None
    return out


@pytest.fixture
def corpus():
    """A language of some size, and so many small ones that a share of all n-grams of a fixed number would leave its rare ones out."""
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyzé\U0001f600字"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(700)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [("en", text(rng.randrange(40, 300))) for _ in range(90)]
    out += [(f"l{i % 150}" if i else None, text(55)) for i in range(600)]
    return [*out, *out[:5], ("en", ""), ("en", "a"), ("en", " \n"), ("l1", "a b " * 80), ("alone", text(60))]


@pytest.mark.parametrize("chunk, bucket, held", [(quality.CHUNK, quality.BUCKET, quality.HELD), (20_000, 15_000, 3000)])
def test_every_ngram_counts(spark, corpus, monkeypatch, chunk, bucket, held):
    for name, x in (("CHUNK", chunk), ("BUCKET", bucket), ("HELD", held)):
        monkeypatch.setattr(quality, name, x, raising=False)
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(corpus)], "doc_id long, text string, lang string").repartition(3)
    got, want = quality.judge(docs).collect(), plain_nats(corpus)
    assert len(got) == len(corpus) and {r.doc_id for r in got} == set(range(len(corpus)))
    for r in got:
        w = want[r.lang, r.text]
        assert (r.nats is None) == (w is None), (r, w)
        assert w is None or r.nats == pytest.approx(w, abs=1e-6)
    assert sum(w is not None for w in want.values()) > 500


def test_whole_model_as_arrays(spark, corpus):
    """score() by fit() keeps all n-grams too, if it is not told otherwise."""
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(corpus)], "doc_id long, text string, lang string")
    want = plain_nats(corpus)
    for r in quality.score(docs, quality.fit(docs)).where("lang = 'en'").collect():
        assert r.nats is None and want[r.lang, r.text] is None or r.nats == pytest.approx(want[r.lang, r.text], abs=1e-5)
