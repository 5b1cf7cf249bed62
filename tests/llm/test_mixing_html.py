import html
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import html_extract as hx
from tessera.llm import mixing as mx
from tessera.llm import oracles
from tessera.llm.html_pages import CLOSE, OPEN, pages
from tessera.llm.html_tree import parse
from tests.compare import same


def skewed(n=400):
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else (None if i % 50 == 1 else f"s{i % 7}")
        rows.append((i, None if i % 90 == 5 else "word " * (i % 40 + (60 if source == "hot" else 0)), source, i))
    return [*rows, (7, "word " * 7, "s0", 0), (n, "", "empty", 0), (None, "a b", "s1", 0)]


SCHEMA = "doc_id long, text string, source string, epoch long"


def test_mixture_equals_sql(spark):
    import duckdb

    rows = [r for r in skewed() if r[0] != 7]
    df = spark.createDataFrame(rows, SCHEMA)
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar, source varchar, epoch bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?)", rows)
    same(mx.mix_sources(df), oracles.OP4, con)


def test_nothing_is_dropped_and_limits_hold(spark):
    df = spark.createDataFrame(skewed(), SCHEMA)
    out = mx.mix_sources(df)
    shown = out.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("epoch").alias("e"))
    assert shown.count() == df.select("doc_id").distinct().count()
    per = {r.source: r for r in out.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.first("exponent").alias("a"), F.max("epoch").alias("e")).collect()}
    base = {r.source: r.t for r in df.groupBy("source").agg(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(mx.WORD))).alias("t")).collect()}
    a, top = per["hot"].a, base["hot"]
    assert 0 < a < 1
    for s, r in per.items():
        if base[s]:
            quota = int(top * (base[s] / top) ** a)
            assert quota - 110 <= r.t <= quota and r.e <= 1
    rows = mx.mix_rows(df)
    assert rows.columns == df.columns and rows.count() == out.count()


def test_budget(spark):
    df = spark.createDataFrame(skewed(), SCHEMA)
    out = mx.mix_sources(df, budget=3000)
    assert 2500 <= out.agg(F.sum("n_tokens")).first()[0] <= 3000
    assert mx.mix_sources(df, budget=60_000).agg(F.max("epoch")).first()[0] >= 2


def test_exponents(spark):
    of = lambda t, h, e: spark.createDataFrame([(t,)], "t array<long>").select(mx.exponent_of(F.col("t"), h, e)).first()[0]
    assert of([5, 5, 5], 0.98, 1.5) == 1.0
    assert of([1, 100], 0.9, 1e9) < 1
    a = of([10, 100], 1.0, 2.0)
    assert (100 / 10) ** (1 - a) == pytest.approx(2.0, abs=1e-4)
    assert of([7], 0.98, 1.5) == 1.0


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mx.mix_sources(df).count() == 0 and mx.mix_rows(df).count() == 0


@pytest.mark.parametrize(
    "page,text",
    [
        ("<article><p>One<p>Two <b>bo</b>ld<br>next</article>", ["One", "Two bold next"]),
        ("a &lt;b&gt; &eacute;&#x41;&copy <!-- no <p> --> c<script>x</script><style>y</style>", ["a <b> éA© c"]),
        ("<p title='a>b'>x</p><title>t</title><textarea>z</textarea>", ["x"]),
        ("<ul><li>1<li>2</ul><table><tr><td>3<td>4</table>", ["1", "2", "3", "4"]),
        ("<p>cut <b>off &am", ["cut off &am"]),
        ("x <p cla", ["x"]),
        ("", []),
        ("<SCRIPT>a</SCRIPT ><P>b</P>", ["b"]),
        ("1 < 2 <p>3", ["1 < 2", "3"]),
    ],
)
def test_reader(page, text):
    assert [t for n in sorted((r for x in parse(page) for r in x.texts)) for t in [n[1]]] == text


def test_made_pages_that_were_not_trained_on():
    model, wrong = hx.default_model(), 0
    made = pages(200, seed=77)
    for p in made:
        truth = " ".join(t for _, t in sorted(r for n in parse(p) for r in n.texts if OPEN in r[1])).replace(OPEN, "").replace(CLOSE, "")
        wrong += model.text(p.replace(OPEN, "").replace(CLOSE, "")) != truth
    assert wrong <= 0.03 * len(made)


def test_marginals_are_exact():
    """Sum-product against the sum over all states of a small tree."""
    import itertools

    model = hx.default_model()
    nodes = parse("<div><nav><p>a</p></nav><article><p>some text here.</p></article></div>")
    got = model.marginals(nodes)
    own = []
    for at, value in hx.features(nodes):
        z = sum(model.weights[i] * v for i, v in zip(at, value, strict=True))
        p = 1 / (1 + 2.718281828459045**-z)
        own.append((1 - p, p))
    own[0] = (0.0, 1.0)
    total, each = 0.0, [0.0] * len(nodes)
    for state in itertools.product((0, 1), repeat=len(nodes)):
        w = 1.0
        for k, s in enumerate(state):
            w *= own[k][s]
            if k:
                w *= model.pair[hx.parent_kind(nodes[nodes[k].parent])][state[nodes[k].parent]][s]
        total += w
        for k, s in enumerate(state):
            each[k] += w * s
    assert got == pytest.approx([x / total for x in each], abs=1e-6)


def test_pages_of_the_tables(spark):
    web = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in web.join(hx.extract_text(web).drop("url"), "page_id").collect():
        inner = r.html[r.html.find("<article>") + 9 :].split("</article>")[0]
        plain = re.sub(r"<[^>]*(>|$)", "", re.sub(r"<(/?(p|h1)|br)[^>]*>", " ", inner))
        assert r.text == " ".join(html.unescape(plain).split()) and r.n_chars == len(r.text)


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "<p>Deep text that is long enough to be found. It has two sentences.</p>"
    rows = [(1, "u", None, "x"), (1, "u", "", "x"), (None, None, deep, "x"), (2, "u", "<" * 2000, "x"), (3, "u", "plain words only", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = hx.extract_text(df)
    assert out.count() == 5 and out.where("page_id = 1 and text = '' and n_chars = 0").count() == 2
    assert hx.extract_text(df.limit(0)).count() == 0
