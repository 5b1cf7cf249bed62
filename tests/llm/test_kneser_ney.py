"""The Kneser-Ney model, its perplexities and its verdicts against brute force with counters."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import kneser_ney as kn

END = "\0end"


def tokens(text):
    return [*("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()), END]


def discounts(counts):
    n = [sum(1 for c in counts.values() if c == k) for k in (1, 2, 3, 4)]
    if not n[0] or not n[1]:
        return [0.0, 0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 * k for k in (1, 2, 3)]
    return [0.0, *(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), raw, strict=True))]


class Brute:
    def __init__(self, texts):
        t = [tokens(x) for x in texts]
        tri = Counter(tuple(x[i : i + 3]) for x in t for i in range(len(x) - 2))
        bi = Counter(g[1:] for g in tri)
        bi.update(tuple(x[:2]) for x in t if len(x) > 1)
        uni = Counter(g[1:] for g in bi)
        uni.update((x[0],) for x in t)
        self.counts = [None, uni, bi, tri]
        self.d = [None, *map(discounts, (uni, bi, tri))]
        self.total, self.given = Counter(), Counter()
        for k in (1, 2, 3):
            for g, c in self.counts[k].items():
                self.total[g[:-1]] += c
                self.given[g[:-1]] += self.d[k][min(c, 3)]

    def p(self, h, w):
        if h and h not in self.total:
            return self.p(h[1:], w)
        below = self.p(h[1:], w) if h else 1 / (len(self.counts[1]) + 1)
        c = self.counts[len(h) + 1][(*h, w)]
        return (c - self.d[len(h) + 1][min(c, 3)]) / self.total[h] + self.given[h] / self.total[h] * below

    def perplexity(self, text):
        t = tokens(text)
        return math.exp(-sum(math.log(self.p(tuple(t[max(0, i - 2) : i]), w)) for i, w in enumerate(t)) / len(t))


def rows(seed, n):
    rng = np.random.default_rng(seed)
    return [" ".join(f"W{x}" for x in np.minimum(rng.geometric(0.12, rng.integers(0, 40)), 40)) for _ in range(n)]


@pytest.mark.parametrize("entries", [4_000_000, 50])
def test_perplexities(spark, monkeypatch, entries):
    monkeypatch.setattr(kn, "SHARD_ENTRIES", entries)
    monkeypatch.setattr(kn, "STEP_BYTES", 500)
    texts = rows(3, 60)
    model = kn._count_model(spark.createDataFrame([(x,) for x in texts], "text string").repartition(3))
    assert len(model.shards) > 1 or entries > 50
    want = Brute(texts)
    asked = [*texts, *rows(9, 40), None, "", "w1 w2", "never seen", "w1 never w2 w3"]
    df = spark.createDataFrame([(i, t, "en", 1.0) for i, t in enumerate(asked)], "doc_id long, text string, lang string, perplexity double").repartition(4)
    for r in kn.perplexities(df, model).collect():
        assert r.perplexity == pytest.approx(want.perplexity(asked[r.doc_id]), rel=1e-9)
        assert r.n_tokens == len(tokens(asked[r.doc_id]))
    small = kn.Model.train([np.array(kn.token_hashes(kn.pa.array([x], kn.pa.large_string()))[0]) for x in texts])
    for r in kn.perplexities(df, small).collect():
        assert r.perplexity == pytest.approx(want.perplexity(asked[r.doc_id]), rel=1e-9)


def test_verdicts(spark):
    """Repeated rows, null and rare languages, ties at the threshold; every verdict from thresholds made by hand."""
    texts = rows(5, 300)
    docs = [(i, t, ("en", "de", None)[i % 3] if i % 50 else "rare") for i, t in enumerate(texts)] + [(3, texts[3], "en"), (400, None, "en"), (401, " ", None), (None, "w1", "de")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in range(0, 300, 2)] + [(4,), (None,)], "doc_id long")
    out = kn.classify(df, trusted).collect()
    assert len(out) == len(docs)
    half = {r.trusted_id for r in trusted.withColumnRenamed("doc_id", "trusted_id").where(kn._in_training()).collect()}
    want = Brute([t for i, t, _ in docs if i in half and t is not None and i % 2 == 0 and i < 300])
    rest = [r for r in out if r.doc_id is not None and r.doc_id % 2 == 0 and r.doc_id < 300 and r.doc_id not in half and r.n_tokens > 1]
    for r in out:
        text = next(t for i, t, _ in docs if i == r.doc_id)
        assert r.perplexity == pytest.approx(want.perplexity(text), rel=1e-9)
        own = sorted(x.perplexity for x in rest if x.lang == r.lang) if r.lang else []
        pool = own if len(own) >= kn.LEAST_TRUSTED else sorted(x.perplexity for x in rest)
        assert r.threshold == pytest.approx(kn.MARGIN * pool[math.ceil(kn.QUANTILE * len(pool)) - 1], rel=1e-9)
        assert r.kept == (r.n_tokens > 1 and r.perplexity <= r.threshold)


def test_languages_train_alike(spark, monkeypatch):
    monkeypatch.setattr(kn, "TRAIN_ROWS", 200)
    seen = []
    monkeypatch.setattr(kn, "_count_model", lambda d: seen.append(d.groupBy("lang").count().collect()))
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") % 20 == 0, "de").otherwise("en").alias("lang"))
    kn.train(df, df.select("doc_id"))
    got = {r.lang: r["count"] for r in seen[0]}
    assert 70 <= got["de"] <= 130 and 70 <= got["en"] <= 130


def test_very_long_text(spark):
    model = kn._count_model(spark.createDataFrame([("a b c a b d",)], "text string"))
    df = spark.createDataFrame([(1, "a b c " * 1_000_000, "en")], "doc_id long, text string, lang string")
    r = kn.perplexities(df, model).first()
    assert r.n_tokens == 3_000_001 and 1 < r.perplexity < 10
