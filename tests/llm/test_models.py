"""The language models, the language identifier and the quality operators."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import kneser_ney as kn
from tessera.llm import language_id as li
from tessera.llm import ngram_trie as nt
from tessera.llm import quality_rules as qr
from tessera.llm.elias_fano import EliasFano, load, pack_bits, read_bits, save
from tessera.llm.textvec import NOT_WORD, WHITE, words

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile("[^ \t-\r]+")


def low(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**63), max_size=200), st.lists(st.integers(0, 2**63), max_size=20))
def test_elias_fano(values, asked):
    v = np.sort(np.array(values, dtype=np.uint64))
    e = EliasFano.of(v)
    assert e.get(np.arange(len(v))).tolist() == v.tolist()
    q = np.array(asked + values, dtype=np.uint64)
    place, same = e.successor(q)
    assert place.tolist() == np.searchsorted(v, q).tolist()
    assert same.tolist() == np.isin(q, v).tolist()


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 63), st.lists(st.integers(0, 2**63), max_size=100))
def test_bit_fields(bits, values):
    v = np.array(values, dtype=np.uint64) & np.uint64((1 << bits) - 1)
    assert read_bits(pack_bits(v, bits), bits, np.arange(len(v))).tolist() == v.tolist()


def test_saved_arrays(tmp_path):
    a = {"x": np.arange(5), "y": np.array([], dtype=np.uint16), "z": np.array([1.5])}
    (tmp_path / "f").write_bytes(save(a))
    b = load(f"file://{tmp_path}/f")
    assert {k: v.tolist() for k, v in b.items()} == {k: v.tolist() for k, v in a.items()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \t\nAbé日.-9\x85", max_size=12), max_size=6))
def test_words_equal_the_patterns(texts):
    array = pa.array(texts, pa.large_string())
    for separators, pattern in ((WHITE, WORD), (NOT_WORD, re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"))):
        w = words(array, separators, lower=True)
        got = [[w.bytes_of(i).decode() for i in range(w.first[k], w.first[k + 1])] for k in range(len(texts))]
        assert got == [pattern.findall(low(t)) for t in texts]
        names = [x for g in got for x in g]
        assert len(set(names)) == len(set(w.hash.tolist()))


def brute_lm(docs, trained):
    tok = {d: [*WORD.findall(low(t or "")), "\0end"] for d, t in docs}
    c = [None] + [Counter(tuple(tok[i][j : j + k]) for i in trained for j in range(len(tok[i]) - k + 1)) for k in (1, 2, 3)]
    n, v, mass = sum(c[1].values()), len(c[1]), Counter()
    for k in (2, 3):
        for g, x in c[k].items():
            mass[g[:-1]] += x - 0.75

    def p(h, w):
        if not h:
            return (c[1][(w,)] + 0.5) / (n + 0.5 * (v + 1))
        below, k = p(h[1:], w), len(h) + 1
        if c[k - 1][h] == 0:
            return below
        return max(c[k][(*h, w)] - 0.75, 0) / c[k - 1][h] + (1 - mass[h] / c[k - 1][h]) * below

    return {i: (len(t), sum(c[1][(w,)] > 0 for w in t), n, sum(math.log10(p((), w)) for w in t), sum(math.log10(p(tuple(t[max(0, j - 2) : j]), w)) for j, w in enumerate(t))) for i, t in tok.items()}


@pytest.mark.parametrize("shard", [3_000_000, 7])
def test_trie_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(nt, "SHARD_NGRAMS", shard)  # 7: contexts span shards
    monkeypatch.setattr(nt, "STEP_BYTES", 300)
    monkeypatch.setattr(nt, "MERGE_AT", 40)
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(f"W{x}" for x in np.minimum(rng.geometric(0.15, rng.integers(0, 40)), 30))) for i in range(60)] + [(100, None), (101, ""), (102, "never seen Words é")]
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in docs], "doc_id long, text string, n_tokens int, score string").repartition(3)
    trained = [d for d, _ in docs if zlib.crc32(str(d).encode()) % 5 != 1]
    want = brute_lm(docs, trained)
    for r in nt.lm_scores(df).collect():
        w = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3] and r.held_out == (r.doc_id not in trained)
        assert r.base_score == pytest.approx(w[3], abs=1e-9)
        assert abs(r.score - w[4]) <= 3e-4 * r.n_tokens
    assert nt.lm_scores(df.limit(0)).count() == 0


def test_pressed_blocks():
    keys = np.sort(np.random.default_rng(0).integers(0, 2**63, 1000, dtype=np.uint64))
    counts = np.arange(1000)
    k, c = nt.unpress(nt.press(keys, counts))
    assert k.tolist() == keys.tolist() and c.tolist() == counts.tolist()


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 2**63, 40, dtype=np.uint64)
    m = kn.Model.train([v[np.minimum(rng.geometric(0.1, rng.integers(1, 50)), 39)] for _ in range(60)] + [np.zeros(0, np.uint64)])
    seen = np.unique(np.concatenate([k for k, _ in m.shards]))
    assert len(seen)
    for h in ([], [v[3]], [v[1], v[2]], [np.uint64(5), v[1]], [v[1], np.uint64(9)]):
        total = 0.0
        for w in [*v.tolist(), 12345]:
            x = np.array([*h, w], dtype=np.uint64)
            p = m.probabilities(x, np.array([0, len(x)]))[-1]
            total += p
            assert p > 0
        never = sum(1 for w in v.tolist() if m.join(kn._keys(np.array([w], dtype=np.uint64))[0], -1.0)[0] < 0)
        assert total - never * m.probabilities(np.array([*h, 12345], dtype=np.uint64), np.array([0, len(h) + 1]))[-1] == pytest.approx(1.0)
    assert kn.Model.train([]).probabilities(np.array([1], dtype=np.uint64), np.array([0, 1]))[0] == 1.0


def test_classifier_keeps_clean_text(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    odd = spark.createDataFrame([(10**6, None, None, "x"), (10**6 + 1, "", "en", "x"), (10**6 + 2, " ".join(f"zq{i}%%%" for i in range(300)), "en", "x")], "doc_id long, text string, lang string, source string")
    both = docs.select("doc_id", "text", "lang", "source").unionByName(odd).withColumn("perplexity", F.lit("clash"))
    rows = {r.doc_id: r for r in kn.classify(both, qr.trusted_ids(labels)).collect()}
    assert len(rows) == both.count()
    assert not any(rows[10**6 + k].kept for k in range(3))
    good = [r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()]
    assert np.mean([rows[d].kept for d in good]) > 0.97
    assert kn.classify(both.limit(0), qr.trusted_ids(labels)).count() == 0
    assert {r.kept for r in kn.classify(odd.limit(3), qr.trusted_ids(labels.limit(0))).where("n_tokens > 1").collect()} == {True}


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = li.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_language_of_odd_rows(spark):
    train = [(i, t, c, "s") for i, (t, c) in enumerate([("der hund und die katze", "de"), ("the dog and the cat", "en"), ("le chien et le chat", "fr"), (None, "fr"), ("x", None)] * 8)]
    odd = [(1000, None, None, "s"), (1001, "123 !", "en", "s"), (1002, "日本", None, "s"), (None, "the cat", "en", "s"), (1003, "und die katze " * 5000, None, "s")]
    df = spark.createDataFrame(train + odd, "doc_id long, text string, lang string, lang_pred string")
    rows = {r.doc_id: r for r in li.language_id(df).collect()}
    assert [rows[k].lang_pred for k in (1000, 1001)] == ["und", "und"] and rows[1000].score == 0
    assert rows[1002].lang_pred in {"de", "en", "fr"} and rows[1003].lang_pred == "de" and rows[None].held_out is False
    assert {r.lang_pred for r in li.language_id(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert li.language_id(df.limit(0)).count() == 0


def rules(text):
    w = WORD.findall(text or "")
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_rules_against_brute_force(spark):
    odd = [None, "", "a b", "a b c a b c", "a a a a a a", "x\n x\nx\n\n\n", "#é|日本 <b>", "a\tb\x0bc\x0cd\re", "w " * 30_000, " ".join(f"v{i}" for i in range(60))]
    df = spark.createDataFrame([(i, t, "m", 1.0, "h") for i, t in enumerate(odd)] + [(1, "", "m", 1.0, "h")], "doc_id long, text string, m string, llr double, kept string")
    trusted = spark.createDataFrame([(9,), (None,)], "doc_id long")
    for r in qr.quality_rules(df, trusted).collect():
        want = rules(odd[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    kept = qr.keep_quality(df, trusted)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [9]
    assert qr.quality_rules(df.limit(0), trusted).count() == 0
    assert {r.llr for r in qr.quality_rules(df, trusted.limit(0)).collect()} == {0.0}


def test_ratio_against_counts(spark, monkeypatch):
    """The score is the mean log ratio of the smoothed counts, with buckets so many that n-grams do not meet."""
    texts = {1: "good words here", 2: "good words there", 3: "bad ### here"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    trusted = {1, 2}
    grams = {d: [*w, *zip(w, w[1:], strict=False)] for d, t in texts.items() for w in [t.split()]}
    c, t = Counter(g for x in grams.values() for g in x), Counter(g for d in trusted for g in grams[d])
    part = sum(t.values()) / sum(c.values())
    want = {d: sum(math.log((t[g] + qr.PRIOR) / (c[g] * part + qr.PRIOR)) for g in x) / len(x) for d, x in grams.items()}
    got = {r.doc_id: r.llr for r in qr.quality_rules(df, spark.createDataFrame([(d,) for d in trusted], "doc_id long")).collect()}
    assert got == pytest.approx(want)


def test_junk_and_clean_part_ways(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    rows = qr.quality_rules(docs, qr.trusted_ids(labels)).collect()
    clean = [r for r in rows if not r.base_failed and r.n_symbols <= 0.1 * r.n_words]
    junk = [r for r in rows if not r.base_failed and r.n_symbols > r.n_words]
    assert np.mean([r.kept for r in clean]) > 0.98 and np.mean([r.kept for r in junk]) < 0.1
