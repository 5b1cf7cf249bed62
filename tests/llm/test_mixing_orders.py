"""The mixture with everything that ties: repeated doc_ids, equal rows, parts of blocks; permutations; many sources."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing as mx
from tessera.llm import oracles
from tests.compare import same
from tests.llm.test_mixing_html import SCHEMA, skewed


def tied():
    rows = skewed()
    rows += [(7, f"other text {k} " * 9, "s0", k) for k in range(12)]  # one doc_id, several texts
    rows += [(9, "word " * 69, "hot", 1)] * 3  # equal rows
    return rows + [(None, None, None, 0), (None, "x " * 40, None, 0), (None, "y " * 40, None, 0)]


def duck(rows):
    import duckdb

    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar, source varchar, epoch bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?)", rows)
    return con


@pytest.mark.parametrize("part,listed", [(1 << 22, 10_000), (40, 10_000), (40, 0)])
def test_equals_sql(spark, monkeypatch, part, listed):
    monkeypatch.setattr(mx, "PART_TOKENS", part)
    monkeypatch.setattr(mx, "BLOCKS", 4 if part < 1000 else 1024)
    monkeypatch.setattr(mx, "LISTED_SOURCES", listed)
    sql = oracles.OP4 if part > 1000 else oracles.OP4.replace("/ 4194304", "/ 40").replace("% 1024 AS block", "% 4 AS block")
    rows = tied()
    same(mx.mix_sources(spark.createDataFrame(rows, SCHEMA).repartition(5)), sql, duck(rows))


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(mx, "BROADCAST_SOURCES", 0)
    rows = tied()
    same(mx.mix_sources(spark.createDataFrame(rows, SCHEMA)), oracles.OP4, duck(rows))


def test_epochs_are_permutations(spark, monkeypatch):
    monkeypatch.setattr(mx, "BLOCKS", 8)
    df = spark.createDataFrame([(i, "a b c", "s", 0) for i in range(200)], SCHEMA)
    out = mx.mix_sources(df, budget=200 * 3 * 3 + 150).orderBy("epoch", "block_rank", "place").collect()
    by_epoch = {}
    for r in out:
        by_epoch.setdefault(r.epoch, []).append(r)
    assert sorted(by_epoch) == [0, 1, 2, 3]
    for e in (0, 1, 2):
        assert sorted(r.doc_id for r in by_epoch[e]) == list(range(200))
        assert sorted({r.block_rank for r in by_epoch[e]}) == list(range(1, len({r.block for r in by_epoch[e]}) + 1))
    assert [r.doc_id for r in by_epoch[0]] != [r.doc_id for r in by_epoch[1]]
    assert len({tuple(dict.fromkeys(r.block for r in by_epoch[e])) for e in (0, 1, 2)}) > 1
    assert len(by_epoch[3]) == 50  # what is left of the budget


def test_rows_are_the_mixture(spark, monkeypatch):
    monkeypatch.setattr(mx, "PART_TOKENS", 60)
    df = spark.createDataFrame(tied(), SCHEMA)
    key = lambda rows: sorted(map(repr, rows))
    got = mx.mix_rows(df).select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(mx.WORD)).cast("long").alias("n")).collect()
    want = mx.mix_sources(df).select("doc_id", "source", F.col("n_tokens").alias("n")).collect()
    assert key(got) == key(want) and mx.mix_rows(df).columns == df.columns
    assert key(mx.mix_rows(df).collect()) == key(mx.mix_rows(df.repartition(7)).collect())


def test_sections_equal_one_row(spark):
    rng = random.Random(3)
    for n, h, e in ((1, 0.98, 1.5), (30, 0.98, 50.0), (300, 0.9, 1e9)):
        tokens = [int(rng.paretovariate(0.8) * 100) for _ in range(n)]
        df = spark.createDataFrame([(t,) for t in tokens], "source_tokens long")
        one = df.agg(F.collect_list("source_tokens").alias("t")).select(mx.exponent_of(F.col("t"), h, e).alias("a")).first().a
        assert mx.exponent_by_sections(df, h, e) == pytest.approx(one, abs=1.1e-6)


def test_long_and_empty(spark):
    df = spark.createDataFrame([(1, "w " * 3_000_000, "a", 0), (2, "", "a", 0), (3, None, "b", 0)], SCHEMA)
    got = {r.doc_id: r.n_tokens for r in mx.mix_sources(df).collect()}
    assert got == {1: 3_000_000, 2: 0, 3: 0}
    assert mx.mix_sources(df.limit(0)).count() == 0
