"""The ratios of the quality rules are not spelled out in plans, which the driver keeps descriptions of."""

from tessera.llm import quality_rules as qr


def test_plans_are_short(spark):
    docs = spark.createDataFrame([(k, f"a{k} b c " * 30, "x") for k in range(20)], "doc_id long, text string, ratios string")
    trusted = docs.where("doc_id < 10").select("doc_id")
    for made in (qr.quality_rules(docs, trusted), qr.keep_quality(docs, trusted)):
        assert len(made._jdf.queryExecution().toString()) < 200_000
    own = {r.doc_id: r for r in qr.quality_rules(docs, trusted).collect()}
    assert len(own) == 20 and len({r.llr for r in own.values()}) > 1
    kept = qr.keep_quality(docs, trusted)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in own.items() if r.kept}
