import unicodedata
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as t


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("value,matching,folded", [(None, "", ""), ("  A\tb\n", "a b", "a b"), ("Hãy ĐĂNG ký!", "hãy đăng ký", "hay dang ky"), ("x y", "x y", "x y"), ("日本 a", "a", "a")])
def test_normal_forms(spark, value, matching, folded):
    assert one(spark, value, t.for_matching) == matching
    assert one(spark, value, t.accent_fold) == folded
    assert t.fold_plain(value or "") == folded


def test_nfc_and_nfkc(spark):
    apart = unicodedata.normalize("NFD", "é")
    assert one(spark, apart, lambda c: t.unicode_form(c, composed=False)) == "é"
    assert one(spark, "ﬁne ①", t.for_metric) == "fine 1"


def test_units(spark):
    assert one(spark, "5 ký và 3 ki lô gam, 2 ki lo", t.unit_aliases) == "5 kg và 3 kg 2 kg"


def test_char_grams(spark):
    got = one(spark, ["ab", "abcdef"], t.char_grams, "array<string>")
    want = []
    for w in ["ab", "abcdef"]:
        p = f" {w} "
        for n in range(3, min(5, len(p)) + 1):
            want += [p[i : i + n] for i in range(len(p) - n + 1)]
    assert Counter(got) == Counter(want)
    assert one(spark, ["a"], t.char_grams, "array<string>") == [" a "]


@pytest.mark.parametrize("value,longest,runs", [([], 0, 0), (["a"], 1, 0), (["a", "a", "b", "c", "c", "c"], 3, 2), (["a", "b", "a"], 1, 0)])
def test_runs(spark, value, longest, runs):
    r = one(spark, value, t.repeated_runs, "array<string>")
    assert (r.longest, r.runs) == (longest, runs)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=20))
def test_gram_repetition(spark, words):
    r = one(spark, words, lambda c: t.gram_repetition(c, 3), "array<string>")
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    total = sum(grams.values())
    assert (r.total, r.distinct, r.repeated) == (total, len(grams), total - len(grams))
    if grams:
        g, n = max(grams.items(), key=lambda x: (x[1], x[0]))
        assert r.times == n and r.most == (" ".join(g) if n > 1 else None)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_bag_and_edits(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    r = df.select(t.bag_overlap(F.col("a"), F.col("b")).alias("o"), t.token_distance("a", "b").alias("d")).first()
    common = sum((Counter(a) & Counter(b)).values())
    p, q = (1, 1) if not a and not b else (common / len(b) if b else 0, common / len(a) if a else 0)
    f = 1 if not a and not b else (2 * p * q / (p + q) if common else 0)
    assert (r.o.precision, r.o.recall, r.o.f1) == pytest.approx((p, q, f))
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    assert r.d == row[-1]


def test_error_rates(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "c"], "ab é", "ab e"), ([], ["x"], "", "x")], "r array<string>, c array<string>, rt string, ct string")
    rows = df.select(t.word_error_rate(F.col("r"), F.col("c")).alias("w"), t.char_error_rate(F.col("rt"), F.col("ct")).alias("c")).collect()
    assert (rows[0].w, rows[0].c) == (0.5, pytest.approx(1 / 3))
    assert rows[1].w is None and rows[1].c is None


def test_boilerplate(spark):
    phrase = t.BOILERPLATE[3]
    r = one(spark, f"xin chào {phrase} rồi", t.boilerplate)
    assert len(r.matches) == 1 and r.matches[0].start == 9
    solid = len(t.fold_plain(phrase).replace(" ", ""))
    assert r.coverage == pytest.approx(solid / (solid + len("xinchaoroi")))
    whole = one(spark, t.BOILERPLATE[0], t.boilerplate)
    assert whole.coverage == 1.0 and len(whole.spans) == 1
    assert one(spark, None, t.boilerplate).coverage == 0.0


def test_spans(spark):
    kind = "array<struct<start:int,end:int>>"
    assert [tuple(x) for x in one(spark, [(5, 7), (0, 2), (2, 4), (6, 9)], t.merge_spans, kind)] == [(0, 4), (5, 9)]
    df = spark.createDataFrame([("abcdef", [(0, 2), (4, 5)])], f"x string, s {kind}")
    assert df.select(t.remove_spans(F.col("x"), F.col("s")).alias("y")).first().y == "cd f"


def test_segments(spark):
    kind = "array<struct<text:string>>"
    r = one(spark, [("Xin chào",), ("xin chao!",), ("",), ("bạn",)], t.distinct_segments, kind)
    assert (r.text, r.repeated) == ("Xin chào bạn", True)
    assert one(spark, None, t.distinct_segments, kind).text == ""


@pytest.mark.parametrize("value,want", [("30000/1001", 30000 / 1001), ("0/0", None), ("1/0", None), ("25", 25.0), (None, None), ("x", None)])
def test_fraction(spark, value, want):
    got = one(spark, value, t.parse_fraction)
    assert got is None if want is None else got == pytest.approx(want)


def test_answers_and_classes(spark):
    df = spark.createDataFrame([('L01_V001, 120, "Hà Nội, Huế"', "QA")], "a string, k string")
    r = df.select(t.parse_answer(F.col("a"), F.col("k")).alias("p")).first().p
    assert tuple(r) == ("L01_V001", 120, "Hà Nội, Huế")
    assert one(spark, "cao 5 km", t.classify_query) == "number_or_measurement"
    assert one(spark, "một nghệ sĩ", t.classify_query) == "person_organization_location"
    assert one(spark, None, t.classify_query) == "other"


def test_times(spark):
    kind = "array<struct<start_s:double,end_s:double>>"
    for rows, diagnostics, ingest in (([(0.0, 5.0)], False, False), ([(None, 5.0)], False, True), ([(-0.1, 5.0)], True, False), ([(1.0, 0.5)], True, True), (None, False, False)):
        df = spark.createDataFrame([(rows,)], f"s {kind}")
        got = df.select(t.invalid_times(F.col("s"), F.lit(60.0)).alias("a"), t.invalid_times_at_ingest(F.col("s"), F.lit(60.0)).alias("b")).first()
        assert (got.a, got.b) == (diagnostics, ingest)


def test_forms_that_may_change():
    """Every character that a normal form changes, alone or behind a letter, is asked for."""
    import re

    import regex

    pattern = regex.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), t.MAY_CHANGE))
    for code in range(0x80, 0x110000):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or pattern.search(c):
            continue
        assert unicodedata.normalize("NFC", c) == c and unicodedata.normalize("NFC", "e" + c) == "e" + c, hex(code)


def test_decomposed_text_is_the_same(spark):
    words = "Hãy đăng ký kênh Ổ Ộ ệ Ångström ﬁ 2 kí lô"
    rows = [(unicodedata.normalize(f, words),) for f in ("NFC", "NFD")] + [(None,)]
    df = spark.createDataFrame(rows, "text string")
    c = F.col("text")
    for f in (t.for_matching, t.accent_fold, t.for_agreement, t.unit_aliases, t.unicode_form):
        got = [r[0] for r in df.select(f(c)).collect()]
        assert got[0] == got[1] != "" and got[2] == "", f
