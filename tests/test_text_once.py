"""Normalised texts are worked out once, and terms are counted without postings."""

import unicodedata

from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.operators import diagnostics as d
from tessera.operators import retrieval as r
from tessera.plans import adapters as a


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_filters_do_not_repeat_normalisation(spark, tmp_path):
    spark.createDataFrame([(1, "a", "A b")], "doc_id long, source string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = a.documents(spark, str(tmp_path)).where("eligible").select("terms")
    assert plan(docs).count("_nfc(") == 1
    assert plan(d.exact_duplicates(spark.read.parquet(f"{tmp_path}/documents.parquet"), F.col("text"), "doc_id")).count("_nfc(") == 1


def test_only_characters_that_may_change_go_to_python(spark):
    rows = [(chr(i),) for i in range(1, 0x30000) if not 0xD800 <= i < 0xE000]
    out = spark.createDataFrame(rows, "x string").select("x", F.col("x").rlike(t.MAY_CHANGE).alias("may")).collect()
    assert all(x.may for x in out if unicodedata.normalize("NFC", x.x) != x.x)
    assert not any(x.may for x in out if x.x < "̀")


def test_term_totals(spark):
    rows = [(1, ["a", "b", "a"], True), (2, ["b"], True), (3, [], False)]
    got = {(x.term, x.df, x.cf) for x in r.term_totals(spark.createDataFrame(rows, "doc_id long, terms array<string>, eligible boolean")).collect()}
    assert got == {("a", 1, 2), ("b", 2, 2), (None, 2, 4)}
