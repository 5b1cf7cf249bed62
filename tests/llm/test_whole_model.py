"""The n-gram model against brute force over every n-gram, those that occur once included."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import ngram_trie as nt


def brute(docs, trained):
    tok = {d: [*t.split(), "\0end"] for d, t in docs}
    c = [None] + [Counter(tuple(tok[i][j : j + k]) for i in trained for j in range(len(tok[i]) - k + 1)) for k in (1, 2, 3)]
    n, v = sum(c[1].values()), len(c[1])
    taken = Counter()
    for k in (2, 3):
        for g, x in c[k].items():
            taken[g[:-1]] += x - 0.75

    def p(h, w):
        if not h:
            return (c[1][(w,)] + 0.5) / (n + 0.5 * (v + 1))
        held, below = c[len(h)][h], p(h[1:], w)
        return max(c[len(h) + 1][(*h, w)] - 0.75, 0) / held + (1 - taken[h] / held) * below if held else below

    return {i: sum(math.log10(p(tuple(t[max(0, j - 2) : j]), w)) for j, w in enumerate(t)) for i, t in tok.items()}


@pytest.mark.parametrize("shard,key_bits,flush", [(3_000_000, 63, 12_000_000), (7, 63, 50), (7, 8, 12_000_000)])
def test_every_ngram_counts(spark, monkeypatch, shard, key_bits, flush):
    monkeypatch.setattr(nt, "SHARD_NGRAMS", shard)
    monkeypatch.setattr(nt, "KEY_BITS", key_bits)  # 8: two bits of a context's number, the rest is its page
    monkeypatch.setattr(nt, "FLUSH_AT", flush)
    monkeypatch.setattr(nt, "STEP_BYTES", 400)
    rng = np.random.default_rng(5)
    docs = [(i, " ".join(f"w{x}" for x in np.minimum(rng.geometric(0.1, rng.integers(1, 40)), 40))) for i in range(50)] + [(50, "seen only once here")]
    trained = [d for d, _ in docs if zlib.crc32(str(d).encode()) % 5 != 1]
    want = brute(docs, trained)
    for r in nt.lm_scores(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect():
        assert abs(r.score - want[r.doc_id]) <= 3e-4 * r.n_tokens, r.doc_id


def test_wide_pairs():
    """Pairs that no key of 64 bits holds."""
    rng = np.random.default_rng(1)
    context, child = rng.integers(0, 2**50, 300), rng.integers(-1, 2**40, 300)
    context[::3], child[::3] = context[0], child[0]
    (c, d), back = nt._unique_pairs(context, child)
    asked = np.where(child < 0, child.max() + 1, child)
    assert (c[back] == context).all() and (d[back] == asked).all()
    assert sorted(set(zip(context.tolist(), asked.tolist(), strict=True))) == list(zip(c.tolist(), d.tolist(), strict=True))


def test_odd_rows(spark):
    """Nulls, repeated rows, a very long text and clashing columns; no training documents; no rows."""
    rows = [(1, None, 0), (2, "", 0), (3, "a b", 0), (3, "a b", 1), (4, "a b " * 800_000, 0), (None, "b", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    out = nt.lm_scores(df).collect()
    assert sorted(r.n_tokens for r in out) == [1, 1, 2, 3, 3, 1_600_001]
    assert len({(r.score, r.base_score) for r in out if r.doc_id == 3}) == 1 and all(r.score <= 0 for r in out)
    held = spark.createDataFrame([(d, "x y") for d in range(60) if zlib.crc32(str(d).encode()) % 5 == 1], "doc_id long, text string")
    assert {(r.train_tokens, r.n_known) for r in nt.lm_scores(held).collect()} == {(0, 0)}
    assert nt.lm_scores(df.limit(0)).count() == 0
