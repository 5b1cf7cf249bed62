"""The Kneser-Ney model counts every training document, on both ways to them."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import kneser_ney as kn
from tests.llm.test_kneser_ney import Brute


@pytest.mark.parametrize("ids", [3_000_000, 10])
def test_every_training_document_counts(spark, monkeypatch, ids):
    """Each document has a word of its own: a model of a sample misses some."""
    monkeypatch.setattr(kn, "BROADCAST_IDS", ids, raising=False)
    df = spark.range(8000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" x y")).alias("text"), F.lit("en").alias("lang"))
    half = [r.trusted_id for r in df.select(F.col("doc_id").alias("trusted_id")).where(kn._in_training()).collect()]
    assert len(half) > 3500
    want = Brute([f"w{i} x y" for i in half])
    known, unknown = want.perplexity(f"w{half[0]} x y"), want.perplexity("new x y")
    assert known < unknown
    got = {r.doc_id: r.perplexity for r in kn.perplexities(df, kn.train(df, df.select("doc_id"))).collect()}
    seen = set(half)
    for i in range(8000):
        assert got[i] == pytest.approx(known if i in seen else unknown, rel=1e-9)
