import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import queries, token_files
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_jaccard import brute as classes

FOLDER = "/root/testdata/sf0.001"


def test_every_stage(spark):
    docs = queries.table(spark, FOLDER, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    kept, before = {}, docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept[name] = stage(spark, before, FOLDER).checkpoint()
        assert kept[name].columns == docs.columns
        before = kept[name]
    texts = lambda d: [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    quality, copies, clean, mixed = (texts(kept[n]) for n, _ in corpus_pipeline.STAGES[:4])
    verdict = {r.doc_id for r in queries.op10_quality_rules(spark, FOLDER).where("kept").collect()}
    assert {d for d, _ in quality} == verdict
    assert sorted(d for d, _ in copies) == sorted({c for _, c, _ in classes(quality)})
    items = [(r.item_id, r.text) for r in queries.table(spark, FOLDER, "benchmark").collect()]
    assert sorted(d for d, _ in clean) == sorted(r[0] for r in leaks(copies, items) if r[3] == 0)
    assert {d for d, _ in mixed} == {d for d, _ in clean} and len(mixed) >= len(clean)
    last = {}
    for r in corpus_pipeline.token_files(spark, before, FOLDER).collect():
        last.setdefault(r.doc_id, []).append(r)
    e = token_files.encoder(queries.tokenizer_path())
    for d, text in mixed:
        ids = np.array([*e.tokenizer.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        assert {(r.n_tokens, r.ids_crc32) for r in last[d]} == {(len(ids), zlib.crc32(ids.tobytes()))}
    assert sum(map(len, last.values())) == len(mixed)


def test_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0
    assert out.agg(F.min("start")).first()[0] == 0


def test_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)


def test_store_that_only_spark_reads(spark, tmp_path):
    """Tables behind a file system that plain file functions do not know."""
    import os

    (tmp_path / "in").mkdir()
    os.symlink(FOLDER, tmp_path / "in" / "tables")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.held.link./in", f"file://{tmp_path}/in")
    for name in ("op3_secrets", "op9_decontaminate"):
        assert queries.queries()[name](spark, "viewfs://held/in/tables").count() > 0
