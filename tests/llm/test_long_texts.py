"""Very long texts in spans give what they give whole."""

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import kneser_ney as kn
from tessera.llm import ngram_trie as nt
from tessera.llm import textvec


def test_words_of_spans(monkeypatch):
    texts = pa.array(["one two  three", "", "x" * 40, " a b", "four\nfive six " * 5, "é ü"], pa.large_string())
    whole = textvec.words(texts, textvec.WHITE, lower=True)
    for most in (1, 3, 10):
        monkeypatch.setattr(textvec, "SPAN_BYTES", most)
        part = textvec.words(texts, textvec.WHITE, lower=True)
        for name in ("start", "end", "hash", "first"):
            assert (getattr(part, name) == getattr(whole, name)).all(), (most, name)


def test_models_of_spans(spark, monkeypatch):
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(f"w{x}" for x in rng.integers(0, 12, n))) for i, n in enumerate([60, 5, 0, 200, 33])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("lang", nt.F.lit("en"))
    scored = lambda: {r.doc_id: (r.n_tokens, r.n_known, pytest.approx(r.base_score, abs=1e-9), pytest.approx(r.score, abs=1e-9)) for r in nt.score(df, nt.train(df)).collect()}
    odd = lambda: {r.doc_id: pytest.approx(r.perplexity, rel=1e-9) for r in kn.perplexities(df, kn._count_model(df)).collect()}
    whole, perplexity = scored(), odd()
    for module in (nt, kn):
        monkeypatch.setattr(module, "STEP_BYTES", 1)  # a step a text
    monkeypatch.setattr(nt, "SPAN_TOKENS", 7)
    assert scored() == whole and odd() == perplexity


def test_long_pieces_are_not_kept():
    from tessera.llm import token_files as tf
    from tessera.llm.queries import tokenizer_path

    e = tf.Encoder(tokenizer_path())
    text = "a short one and " + "x" * 5000 + " end"
    for _ in range(2):
        assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
    assert max(map(len, e.kept)) <= tf.LONG_PIECE
