import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import components
from tessera.llm import jaccard_join as jj
from tessera.llm.components import connected_components

WORD = re.compile("[^ \t-\r]+")


def sets(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, least=0.8):
    s = [sets(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and len(s[i] & s[j]) >= least * len(s[i] | s[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                up[max(find(i), find(j))] = min(find(i), find(j))
    names = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[find(i)] = min(names.get(find(i), d), d)
    return sorted(((d, names.get(find(i)), links[i]) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    shared = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows, base = [], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.45 and base:
            w = rng.choice(base).split()
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((i, " ".join(w)))
        else:
            text = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 40, 120])))
            base.append(text)
            rows.append((i, f"{text} {shared}" if kind > 0.85 else text))
    return rows


@pytest.mark.parametrize("small,few", [(256, 100_000), (4, 0)])
def test_against_all_pairs(spark, monkeypatch, small, few):
    monkeypatch.setattr(components, "ONE_TASK_EDGES", few)
    monkeypatch.setattr(jj, "SMALL", small)  # 4: paths are split level by level, and large buckets go in blocks
    monkeypatch.setattr(jj, "BLOCK", 8)
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jj.jaccard_join(df).collect()), key=repr)
    assert got == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"x{i % 977}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A b"), (4, "a B"), (5, long), (6, long + " end"), (None, "a b"), (7, "same text of more than five words"), (7, "same text of more than five words")]
    df = spark.createDataFrame([(d, t, "s", 1, "c") for d, t in rows], "doc_id long, text string, sig string, n_links int, class_id string")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jj.jaccard_join(df).collect()), key=repr)
    assert got == brute(rows)
    kept = jj.keep_one(df)
    assert kept.columns == df.columns
    # the row without an id stays, and rows that repeat an id stay once for each text
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.select("doc_id", "text").collect() if r.doc_id != 5) == sorted([(1, ""), (2, ""), (3, " \n"), (4, "A b"), (4, "a B"), (0, "a b"), (7, rows[-1][1])])
    assert jj.jaccard_join(df.limit(0)).count() == 0


def test_runs_reach_the_recall():
    assert 5 < jj.runs_for(0.999) < jj.runs_for(0.99999)


@pytest.mark.parametrize("few", [0, 100_000])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "ONE_TASK_EDGES", few)  # 0: by contraction
    rng = random.Random(1)
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(120) if i % 40 != 39] + [("z", "z")] + [(f"m{rng.randrange(50)}", f"m{rng.randrange(50)}") for _ in range(60)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        if a != b:
            up[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in up}
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_planted_copies_in_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jj.jaccard_join(docs).collect())
    assert got == sorted(brute(rows))
    assert jj.keep_one(docs).count() == len({c for _, c, _ in got})
    assert docs.agg(F.count("*")).first()[0] == len(got)
