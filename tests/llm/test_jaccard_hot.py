"""Hot keys and large groups of the chosen-path join: nothing is lost, and what is shuffled grows with the group."""

import random

import pytest

from tessera.llm import jaccard_join as jj
from tests.llm.test_jaccard import brute, corpus


@pytest.mark.parametrize("keys", [500_000, 0])
def test_hot_keys_by_broadcast_and_by_salt(spark, monkeypatch, keys):
    monkeypatch.setattr(jj, "SMALL", 4)
    monkeypatch.setattr(jj, "BLOCK", 5)
    monkeypatch.setattr(jj, "BROADCAST_KEYS", keys)
    rows = corpus(8, 70) + [(100 + k, "the very same text of a few more words than five") for k in range(40)]
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jj.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == brute(rows)


def test_group_of_unequal_copies(spark):
    """Every pair is linked or not as brute force says, and rows that move grow in proportion to the group."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(60)]

    def group(n):
        out = []
        for i in range(n):
            w = list(base)
            w[rng.randrange(60)] = f"own{i}"
            out.append((i, " ".join(w)))
        return out

    rows = group(700)
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jj.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == brute(rows)


def test_large_groups_move_once(spark, monkeypatch):
    dealt = []
    write = jj.compared

    def counted(rows, key, most, compare, schema, large):
        dealt.append((large, rows.count()))
        return write(rows, key, most, compare, schema, large)

    monkeypatch.setattr(jj, "compared", counted)
    monkeypatch.setattr(jj, "BLOCK", 16)
    rows = [(i, " ".join(["a"] * 3 + [f"x{k}" for k in range(60)] + [f"own{i}"])) for i in range(300)]
    out = jj.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.class_id, r.n_links) for r in out} == {(0, 299)}
    assert dealt[-1] == (True, 300) and dealt[-2] == (False, 0)  # whole sets: one row a node, whatever the number of blocks


def test_recall_at_the_similarity(spark):
    """Pairs at the very threshold, by brute force."""
    rng = random.Random(11)
    rows = []
    for i in range(400):
        w = [f"v{rng.randrange(10**6)}" for _ in range(94)]
        rows.append((2 * i, " ".join(w)))
        rows.append((2 * i + 1, " ".join([*w[:-10], *(f"u{rng.randrange(10**6)}" for _ in range(10))])))  # 80 of 100 shingles
    got = {r.doc_id: r.class_id for r in jj.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {d: c for d, c, _ in brute(rows[:80])}
    assert all(want[d] == got[d] for d in want)
    assert sum(got[2 * i + 1] == 2 * i for i in range(400)) >= 399


def test_survivor_of_repeated_ids(spark):
    a, b = "a text that has more than five words in it", "another text with quite a few other words"
    rows = [(5, a), (6, a), (5, b), (3, b), (9, None), (9, "alone it stands here with six words")]
    df = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, sig int")
    kept = jj.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted([(5, a), (3, b), (9, ""), (9, rows[-1][1])])
