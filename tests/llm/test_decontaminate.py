import hashlib
import re

import pytest

from tessera.llm import decontaminate as dc
from tests.compare import duck, same

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(docs, items):
    windows = {}
    for i, text in items:
        w = words(text)
        n = min(8, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k : k + n]))
                if own:
                    found |= own
                    hit |= set(range(k, k + n))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return out


ITEMS = [(1, "One two three four five six seven eight nine TEN"), (2, "one two three four five six seven eight"), (10, "short item"), (3, ""), (4, None), (5, "the the the the the the the the the"), (6, "é-word naïve 日本 x y z a b c")]
DOCS = [
    (1, "zero one two three four five six seven eight nine"), (2, "one, TWO; three four-five six seven eight!"), (3, None), (4, ""), (5, "a short item here and a short item there"),
    (6, "the " * 20), (7, "one two three four five six seven"), (8, "é word naïve 日本 x y z a b c d"), (9, "clean text without anything of note"), (1, "short item"), (None, "short item"),
]


@pytest.fixture
def tables(spark):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in DOCS], "doc_id long, text string, n_words string, items long")
    items = spark.createDataFrame([(i, t, 0) for i, t in ITEMS + [(2, ITEMS[1][1])]], "item_id long, text string, doc_id int")
    return docs, items


def plain(rows):
    return sorted(tuple(r)[:6] for r in rows) if all(r.doc_id is not None for r in rows) else sorted((tuple(r)[:6] for r in rows), key=repr)


def test_against_brute_force(tables):
    docs, items = tables
    assert plain(dc.decontaminate(docs, items).collect()) == sorted(brute(DOCS, ITEMS), key=repr)


def test_many_blocks_from_the_shared_folder(tables, monkeypatch):
    docs, items = tables
    want = plain(dc.decontaminate(docs, items).collect())
    monkeypatch.setattr(dc, "BLOCK_BYTES", 40)
    monkeypatch.setattr(dc, "CHUNK", 3)
    assert plain(dc.decontaminate(docs, items).collect()) == want


def test_rows_are_dropped_whole(tables):
    docs, items = tables
    kept = dc.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    want = [d for d, r in zip(DOCS, brute(DOCS, ITEMS), strict=True) if r[3] == 0]
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted((d, t or "") for d, t in want)


def test_empty_tables(spark, tables):
    docs, items = tables
    assert dc.decontaminate(docs.limit(0), items).count() == 0
    assert {r.n_items for r in dc.decontaminate(docs, items.limit(0)).collect()} == {0}


def test_equals_sql(spark):
    from tessera.llm import oracles, queries

    folder = "/root/testdata/sf0.001"
    for name, sql in oracles.oracle_sql().items() if hasattr(oracles, "oracle_sql") else oracles.SQL.items():
        same(queries.queries()[name](spark, folder), sql, duck(folder))
