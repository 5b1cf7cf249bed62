"""Text functions of the engine as Columns: built-in expressions wherever they can say it.

Only Unicode normal forms, token edit distance and sequence matching have no built-in form; they are Arrow UDFs.
"""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Stock phrases of speech models, in the order in which they are looked for.
BOILERPLATE = (
    "hãy subscribe cho kênh ghiền mì gõ để không bỏ lỡ những video hấp dẫn",
    "các bạn hãy đăng ký kênh để ủng hộ kênh của chúng mình nhé",
    "đừng quên đăng ký kênh để không bỏ lỡ những video hấp dẫn",
    "hãy đăng ký kênh để không bỏ lỡ những video hấp dẫn",
    "hãy subscribe cho kênh ghiền mì gõ",
    "các bạn hãy đăng ký kênh để ủng hộ kênh của chúng mình",
)
DOMINANT_COVERAGE = 0.80
POSTPROCESS_VERSION = "1.1"

# Spoken units and what they become, in order.
UNIT_ALIASES = (
    (r"\bki\s*l[oô]\s*gam\b", "kg"),
    (r"\bkilogram\b", "kg"),
    (r"\bkilograms\b", "kg"),
    (r"\bki\s*l[oô]\b", "kg"),
    (r"(?<=\d)\s*k[ýy]\b", " kg"),
)

# Classes of queries.
MEASURE = r"\b\d+(?:[.,]\d+)?\s*(?:kg|km|g|%|ml|giờ|phút|con|người)?\b"
NAMED = ("địa điểm", "tỉnh", "xã ", "thành phố", "nghệ sĩ", "tổng thống", "người phụ nữ", "người đàn ông", "câu lạc bộ")

# Ids of videos.
VIDEO_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"
CORPUS_VIDEO_ID = r"^[KL]\d{2}_V\d{3}$"


def _fold_tables() -> tuple[str, str]:
    """Letters with marks and the letters below them, then the marks themselves, which are dropped."""
    letters, bases, marks = [], [], []
    for code in range(0xC0, 0x1EFA):
        c = chr(code)
        if unicodedata.category(c) == "Mn":
            marks.append(c)
            continue
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if len(base) == 1 and base != c:
            letters.append(c)
            bases.append(base)
    return "đ" + "Đ" + "".join(letters) + "".join(marks), "d" + "D" + "".join(bases)


_FOLD_FROM, _FOLD_TO = _fold_tables()


def squeeze(text: Column) -> Column:
    """White space as single spaces, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


#: Characters that a Unicode normal form may change (none below U+0300, which is asked first), and some more: marks, letters that compose with what stands before
#: them, and the ranges that hold characters with a canonical form of their own.
MAY_CHANGE = (
    r"[\u0300-\x{10FFFF}&&[\p{M}\u0340-\u0387\u0958-\u0FFF\u1100-\u11FF\u1F00-\u1FFF\u2000\u2001\u2126\u212A\u212B\u2329\u232A\u2ADC\uF900-\uFAFF\uFB1D-\uFB4F"
    r"\x{11000}-\x{12FFF}\x{1D100}-\x{1D1FF}\x{2F800}-\x{2FA1F}]]"
)


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfc_all(s: pd.Series) -> pd.Series:
    return s.map(lambda xs: xs if xs is None else [x if x is None else unicodedata.normalize("NFC", x) for x in xs])


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def nfc(text: Column) -> Column:
    """The text in NFC. Python gets the texts that may change; of all others it sees a null."""
    return F.coalesce(_nfc(F.when(text.rlike(MAY_CHANGE), text)), text)


def unicode_form(text: Column, composed: bool = False) -> Column:
    """Squeezed text in NFC. composed: the text is known to be NFC already, so no Python is needed."""
    return squeeze(text if composed else nfc(text))


def for_matching(text: Column, composed: bool = False) -> Column:
    """Lower-case letters and digits of the text in NFC; everything else is space, squeezed."""
    lower = F.lower(F.coalesce(text if composed else nfc(text), F.lit("")))
    return squeeze(F.regexp_replace(lower, r"(?U)[^0-9a-zA-ZÀ-ỹđĐ\s]", " "))


def accent_fold(text: Column, composed: bool = False) -> Column:
    """for_matching without marks on letters, and as long."""
    return let(for_matching(text, composed), fold_marks)


def fold_marks(plain: Column) -> Column:
    """accent_fold of a text that for_matching made."""
    return F.when(plain.rlike("[À-ỹ]"), F.trim(F.regexp_replace(F.translate(plain, _FOLD_FROM, _FOLD_TO), " +", " "))).otherwise(plain)


def unit_aliases(text: Column, composed: bool = False) -> Column:
    out = for_matching(text, composed)
    for pattern, unit in UNIT_ALIASES:
        out = F.regexp_replace(out, "(?iU)" + pattern, unit)
    return squeeze(out)


def for_agreement(text: Column, composed: bool = False) -> Column:
    """Lower case of the text in NFC; any run of punctuation, underscores and white space is one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text if composed else nfc(text), F.lit(""))), r"(?U)[\W_]+", " "))


def for_metric(text: Column) -> Column:
    """NFKC, lower case, no punctuation."""
    return squeeze(F.regexp_replace(F.lower(_nfkc(F.coalesce(text, F.lit("")))), r"(?U)[^\w\s]", " "))


def tokens(normal: Column) -> Column:
    """Tokens of a squeezed text."""
    return F.filter(F.split(normal, " "), lambda x: x != "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(rows: DataFrame, made: str) -> DataFrame:
    """Rows whose column `made` is worked out once: without this, a filter on it goes below the column and works it out
    a second time."""
    return rows.withColumn(made, F.when(F.spark_partition_id() >= 0, F.col(made)))  # always so, but not for the optimiser


def unique_terms(terms: Column) -> Column:
    return F.array_distinct(terms)


def char_grams(terms: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside words, each word with a space on both sides; a word shorter than n is one gram."""

    def grams(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        size = F.length(padded)
        each = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(padded, i, n))
        return F.flatten(F.transform(F.sequence(F.lit(low), F.greatest(F.least(F.lit(high), size), F.lit(low))), each))

    return F.flatten(F.transform(terms, grams))


def token_grams(terms: Column, n: Column | int) -> Column:
    """Runs of n tokens, joined by spaces."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(F.size(terms) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(terms) - n + 1, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(terms, i, n)))).otherwise(F.array().cast("array<string>"))


def repeated_runs(terms: Column) -> Column:
    """struct(longest, runs): the longest run of one token, and how many runs have two tokens or more."""
    begin = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("longest"), F.lit(0).alias("runs"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(s["last"] == x, s["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(s["longest"], run).alias("longest"), (s["runs"] + F.when(run == 2, 1).otherwise(0)).alias("runs"))

    return F.aggregate(terms, begin, step, lambda s: F.struct(s["longest"].alias("longest"), s["runs"].alias("runs")))


def gram_repetition(terms: Column, n: int) -> Column:
    """struct(total, distinct, repeated, ratio, most, times): repetition of n-grams within one text. `most` is the
    n-gram found most often, the larger one among equals, or null if none repeats. Sorted, not paired: n log n."""
    begin = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("distinct"), F.lit(None).cast("string").alias("most"), F.lit(0).alias("times"))

    def step(s: Column, x: Column) -> Column:
        same = F.coalesce(s["last"] == x, F.lit(False))
        run = F.when(same, s["run"] + 1).otherwise(1)
        more = run >= s["times"]
        return F.struct(x.alias("last"), run.alias("run"), (s["distinct"] + F.when(same, 0).otherwise(1)).alias("distinct"), F.when(more, x).otherwise(s["most"]).alias("most"), F.greatest(run, s["times"]).alias("times"))

    def measured(g: Column) -> Column:
        total = F.size(g)
        return let(
            F.aggregate(F.array_sort(g), begin, step),
            lambda s: F.struct(
                total.alias("total"),
                s["distinct"].alias("distinct"),
                (total - s["distinct"]).alias("repeated"),
                F.when(total > 0, (total - s["distinct"]) / total).otherwise(0.0).alias("ratio"),
                F.when(s["times"] > 1, s["most"]).alias("most"),
                s["times"].alias("times"),
            ),
        )

    return let(token_grams(terms, n), measured)


def bag_overlap(left: Column, right: Column) -> Column:
    """struct(precision, recall, f1) of two bags of tokens. Both are sorted once and numbered by occurrence, so the
    overlap of bags is that of sets."""

    def numbered(terms: Column) -> Column:
        begin = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.array().cast("array<string>").alias("out"))

        def step(s: Column, x: Column) -> Column:
            run = F.when(F.coalesce(s["last"] == x, F.lit(False)), s["run"] + 1).otherwise(1)
            return F.struct(x.alias("last"), run.alias("run"), F.concat(s["out"], F.array(F.concat_ws(" ", x, run.cast("string")))).alias("out"))

        return F.aggregate(F.array_sort(terms), begin, step, lambda s: s["out"])

    both_empty = (F.size(left) == 0) & (F.size(right) == 0)

    def measured(common: Column) -> Column:
        p, r = common / F.greatest(F.size(right), F.lit(1)), common / F.greatest(F.size(left), F.lit(1))
        one = lambda x: F.when(both_empty, 1.0).otherwise(x)
        return F.struct(one(p).alias("precision"), one(r).alias("recall"), one(F.when(common > 0, 2 * p * r / (p + r)).otherwise(0.0)).alias("f1"))

    return let(F.size(F.array_intersect(numbered(left), numbered(right))), measured)


def _edits(left: list, right: list) -> int:
    """Edit distance by bit-parallel columns: one pass over the longer side with integers as wide as the shorter."""
    if len(left) < len(right):
        left, right = right, left
    if not right:
        return len(left)
    places: dict = {}
    for i, x in enumerate(right):
        places[x] = places.get(x, 0) | 1 << i
    m = len(right)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, distance = mask, 0, m
    for x in left:
        eq = places.get(x, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        hp = minus | ~(xh | plus) & mask
        hm = plus & xh
        if hp & top:
            distance += 1
        elif hm & top:
            distance -= 1
        hp = (hp << 1 | 1) & mask
        hm = (hm << 1) & mask
        plus = hm | ~(xv | hp) & mask
        minus = hp & xv
    return distance


@F.pandas_udf(T.LongType())
def token_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    """Edit distance of two arrays of tokens; null arrays are empty."""
    of = lambda x: [] if x is None else list(x)
    return pd.Series([_edits(of(a), of(b)) for a, b in zip(left, right, strict=True)], dtype="int64")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two strings."""
    return pd.Series([difflib.SequenceMatcher(None, a or "", b or "").ratio() for a, b in zip(left, right, strict=True)], dtype="float64")


def word_error_rate(reference: Column, candidate: Column) -> Column:
    """Token edits per reference token; null without reference tokens."""
    return F.when(F.size(reference) > 0, token_distance(reference, candidate) / F.size(reference))


def char_error_rate(reference: Column, candidate: Column) -> Column:
    """Character edits, spaces left out, per reference character; null without them."""
    a, b = F.translate(reference, " ", ""), F.translate(candidate, " ", "")
    return F.when(F.length(a) > 0, F.levenshtein(a, b) / F.length(a))


def boilerplate(text: Column, phrases: tuple[str, ...] = BOILERPLATE) -> Column:
    """struct(matches array<struct<phrase,start,end>>, spans, coverage) of stock phrases in the folded text.
    Places are code points from 0, ends exclusive; spans are the merged matches; coverage counts characters other
    than spaces."""
    span_type = "array<struct<start:int,end:int>>"

    def of(folded: Column) -> Column:
        def places(phrase: str) -> Column:
            plain = fold_plain(phrase)
            cut = F.split(folded, plain)
            ends = F.aggregate(
                F.slice(cut, 1, F.greatest(F.size(cut) - 1, F.lit(0))),
                F.struct(F.lit(0).alias("at"), F.array().cast(span_type).alias("out")),
                lambda s, x: F.struct((s["at"] + F.length(x) + len(plain)).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + F.length(x)).alias("start"), (s["at"] + F.length(x) + len(plain)).alias("end")))).alias("out")),
                lambda s: s["out"],
            )
            return F.transform(ends, lambda x: F.struct(F.lit(phrase).alias("phrase"), x["start"].alias("start"), x["end"].alias("end")))

        matches = F.concat(*(places(p) for p in dict.fromkeys(phrases)))
        return let(matches, lambda m: let(merge_spans(F.transform(m, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))), lambda spans: measured(folded, m, spans)))

    def measured(folded: Column, m: Column, spans: Column) -> Column:
        solid = lambda x: F.length(F.translate(x, " ", ""))
        held = F.aggregate(spans, F.lit(0), lambda n, x: n + solid(F.substring(folded, x["start"] + 1, x["end"] - x["start"])))
        return F.struct(m.alias("matches"), spans.alias("spans"), F.when(solid(folded) > 0, held / solid(folded)).otherwise(0.0).alias("coverage"))

    return let(accent_fold(text), of)


def fold_plain(text: str) -> str:
    """accent_fold of a Python string."""
    low = " ".join(unicodedata.normalize("NFC", text).lower().split())
    kept = "".join(c if c.isascii() and c.isalnum() or "À" <= c <= "ỹ" or c == " " else " " for c in low)
    return " ".join("".join(c for c in unicodedata.normalize("NFD", kept.replace("đ", "d")) if unicodedata.category(c) != "Mn").split())


def merge_spans(spans: Column) -> Column:
    """Sorted spans of struct(start, end), joined where one begins at or before the end of another."""
    kind = "array<struct<start:int,end:int>>"

    def step(out: Column, x: Column) -> Column:
        joins = (F.size(out) > 0) & (x["start"] <= F.try_element_at(out, F.lit(-1))["end"])
        grown = F.struct(F.try_element_at(out, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(out, F.lit(-1))["end"], x["end"]).alias("end"))
        return F.when(joins, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(F.array_sort(spans.cast(kind)), F.array().cast(kind), step)


def remove_spans(text: Column, spans: Column) -> Column:
    """The text without its spans, squeezed."""
    return squeeze(F.aggregate(spans, text, lambda t, x: F.overlay(t, F.repeat(F.lit(" "), x["end"] - x["start"]), x["start"] + 1, x["end"] - x["start"])))


def distinct_segments(segments: Column) -> Column:
    """struct(text, repeated): texts of the segments joined, without segments that repeat the match form of the last
    one that had text; repeated says whether any was left out."""
    begin = F.struct(F.lit(None).cast("string").alias("last"), F.array().cast("array<string>").alias("kept"), F.lit(False).alias("repeated"))

    def step(s: Column, x: Column) -> Column:
        text, match = unicode_form(x, True), accent_fold(x, True)
        again = (match != "") & F.coalesce(match == s["last"], F.lit(False))
        take = ~again & (text != "")
        return F.struct(F.when(take, match).otherwise(s["last"]).alias("last"), F.when(take, F.concat(s["kept"], F.array(text))).otherwise(s["kept"]).alias("kept"), (s["repeated"] | again).alias("repeated"))

    texts = F.coalesce(F.transform(segments, lambda x: x["text"].cast("string")), F.array().cast("array<string>"))
    composed = F.coalesce(_nfc_all(F.when(F.exists(texts, lambda x: F.coalesce(x.rlike(MAY_CHANGE), F.lit(False))), texts)), texts)
    return F.aggregate(composed, begin, step, lambda s: F.struct(squeeze(F.concat_ws(" ", s["kept"])).alias("text"), s["repeated"].alias("repeated")))


def reasons(*named: tuple[str, Column], old: Column | None = None) -> Column:
    """Names whose condition holds, with old ones, sorted and distinct."""
    new = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in named)), lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(old, F.array().cast("array<string>")), new) if old is not None else new))


def classify_query(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    named = F.lit(False)
    for x in NAMED:
        named = named | low.contains(x)
    return F.when(low.rlike("(?U)" + MEASURE), "number_or_measurement").when(named, "person_organization_location").otherwise("other")


def parse_answer(answer: Column, task: Column) -> Column:
    """struct(video_id, frame_id, answer_text) of 'video, frame[, text]'; the text only for question answering."""
    parts = F.transform(F.split(answer, ",", 3), lambda x: F.trim(x))
    frame = F.regexp_extract(F.get(parts, F.lit(1)), r"-?\d+", 0)
    said = F.trim(F.regexp_replace(F.get(parts, F.lit(2)), '^"+|"+$', ""))
    return F.struct(F.get(parts, F.lit(0)).alias("video_id"), F.when(frame != "", frame.cast("long")).alias("frame_id"), F.when((task == "QA") & (said != ""), said).alias("answer_text"))


def parse_fraction(text: Column) -> Column:
    """The value of 'a/b' or a number; null for 0/0, a zero denominator or anything else."""
    t = F.trim(F.coalesce(text, F.lit("")))
    a, b = F.regexp_extract(t, r"^([+-]?\d+)/(\d+)$", 1), F.regexp_extract(t, r"^([+-]?\d+)/(\d+)$", 2)
    return F.when(b != "", F.when(b.cast("double") != 0, a.cast("double") / b.cast("double"))).when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.cast("double"))


def valid_video_id(text: Column, pattern: str = VIDEO_ID) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def window_id(video: Column, index: Column) -> Column:
    return F.format_string("%s_%04d", video, index)


def identity(*columns: Column) -> Column:
    """SHA-256 of the columns as canonical JSON: keys in order, no spaces."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def invalid_times(segments: Column, duration: Column) -> Column:
    """Diagnostics' rule: a segment with both times is invalid below 0, backwards, or over a second past the end."""
    return F.coalesce(F.exists(segments, lambda s: F.coalesce(s["start_s"].isNotNull() & s["end_s"].isNotNull() & (F.isnan(s["start_s"]) | F.isnan(s["end_s"]) | (s["start_s"] < 0) | (s["end_s"] < s["start_s"]) | (s["end_s"] > duration + 1.0)), F.lit(False))), F.lit(False))


def invalid_times_at_ingest(segments: Column, duration: Column, slack: float = 0.25) -> Column:
    """Ingest's rule: one time without the other is invalid too, and both may be off by a little."""
    return F.coalesce(F.exists(segments, lambda s: (s["start_s"].isNull() != s["end_s"].isNull()) | F.coalesce((s["start_s"] < -slack) | (s["end_s"] < s["start_s"]) | (s["end_s"] > duration + slack), F.lit(False))), F.lit(False))
