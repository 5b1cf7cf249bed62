"""Quality rules: fixed rules on each text, then a hashed n-gram log-likelihood ratio.

Unigrams and bigrams of words fall into hash buckets. Two multinomials over the buckets are counted: of the whole
corpus and of trusted documents. The trusted one is smoothed towards the corpus, so a bucket without evidence says
nothing. A document's score is the sum of log(trusted / corpus) over its n-grams divided by their number, and a
fixed threshold decides on every document.

Everything is DataFrame functions. The corpus is scanned twice (counts, scores) and its rows are never shuffled:
counting shuffles one partial row per bucket and task, and the table of BUCKETS ratios, of fixed size, reaches the
scoring scan as a scalar subquery: a literal would stand in every description of the plan that the driver keeps. Only trusted document ids, at most about TRUSTED_ROWS, are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import checkpoint_root

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words

#: Buckets of the hashed n-grams.
BUCKETS = 1 << 16
#: Strength of the pull of the trusted multinomial towards the corpus, in n-grams of each bucket.
PRIOR = 8.0
#: About as many trusted documents as the target multinomial is counted from, at most.
TRUSTED_ROWS = 20_000
#: Least mean log-likelihood ratio of a document that is kept.
THRESHOLD = -0.11


def _let(value: Column, body) -> Column:
    """body(value), with value computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _repeated_words(w: Column) -> Column:
    """Words that lie in 3-word windows found twice or more. Windows are compared by 64-bit hash."""
    n = F.size(w)

    def marked(s: Column) -> Column:
        twice = lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, twice), lambda x: x["i"]))

    windows = F.transform(F.slice(w, 1, n - 2), lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
    covered = F.aggregate(
        _let(F.array_sort(windows), marked),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + i + 3 - F.greatest(a["end"], i)).alias("n")),
        lambda a: a["n"],
    )
    return F.when(n < 4, F.lit(0).cast("long")).otherwise(covered)


def _buckets(w: Column) -> Column:
    """Buckets of the unigrams and bigrams."""
    return F.concat(
        F.transform(w, lambda x: F.xxhash64(x).bitwiseAND(BUCKETS - 1).cast("int")),
        F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.xxhash64(F.get(w, i), x).bitwiseAND(BUCKETS - 1).cast("int")),
    )


def ratio_table(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row: the array of log(trusted / corpus) by bucket.

    trusted: doc_id of trusted documents; of more than TRUSTED_ROWS, those whose hash falls in that share are used.
    """
    ids = trusted.select(F.col("doc_id").alias("trusted_id")).where("trusted_id is not null").distinct()
    n = ids.count()
    if n > TRUSTED_ROWS:
        ids = ids.where(F.pmod(F.xxhash64("trusted_id"), F.lit(1_000_000)) < int(1_000_000 * TRUSTED_ROWS / n))
    flagged = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("trusted_id"), "left")
    grams = flagged.select(F.col("trusted_id").isNotNull().cast("long").alias("t"), _words(F.col("text")).alias("w"))
    counted = grams.select("t", F.explode(_buckets(F.col("w"))).alias("b")).groupBy("b").agg(F.count("*").alias("c"), F.sum("t").alias("t"))
    # a dense array: buckets that never occur count 0
    pairs = counted.select(F.col("b"), "c", "t").unionByName(docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"), F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("t")))
    dense = pairs.groupBy("b").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    rows = dense.agg(F.array_sort(F.collect_list(F.struct("b", "c", "t"))).alias("rows"), F.sum("c").alias("c"), F.sum("t").alias("t"))
    expected = lambda x: x["c"] * F.col("t") / F.greatest(F.col("c"), F.lit(1))
    ratio = lambda x: F.log((x["t"] + PRIOR) / (expected(x) + PRIOR))
    return rows.select(F.transform("rows", ratio).alias("ratios"))


def quality_columns(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> dict[str, Column]:
    """The rules' columns over text and ratios, by name, and that column of ratios; see quality_rules."""
    checkpoint_root(docs.sparkSession)
    table = F.col("ratios")
    text = F.coalesce(F.col("text"), F.lit(""))

    def measured(w: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        b = _buckets(w)
        total = F.aggregate(b, F.lit(0.0), lambda a, x: a + F.get(table, x))
        grams = F.greatest(2 * F.size(w) - 1, F.lit(1))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            _repeated_words(w).alias("n_repeat_words"),
            (total / grams).alias("llr"),
        )

    m = _let(_words(text), measured)
    return {"measured": m, "threshold": F.lit(float(threshold)), "ratios": ratio_table(docs, trusted).checkpoint().scalar().alias("ratios")}


def verdict(m: Column, threshold: Column) -> tuple[Column, Column]:
    failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])
    return failed, ~failed & (m["llr"] >= threshold)


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rules and verdict of every document, one row per input row.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr. A null or
    empty text has no words and fails; very long texts are read whole; a ratio equal to the threshold is kept; repeated
    rows are judged alike; without trusted documents every ratio is 0 and only the rules decide; a table without rows
    gives none; other columns, whatever their names, are not read.
    """
    c = quality_columns(docs, trusted, threshold)
    base = docs.select("doc_id", "text", c["ratios"]).select("doc_id", c["measured"].alias("m"))
    failed, kept = verdict(F.col("m"), c["threshold"])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return base.select("doc_id", *(F.col("m")[n].alias(n) for n in names), failed.alias("base_failed"), kept.alias("kept"), F.col("m")["llr"].alias("llr"))


def keep_quality(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that quality_rules keeps, with their own columns only."""
    c = quality_columns(docs, trusted, threshold)
    packed = docs.select(F.struct("*").alias("row"), "text", c["ratios"])
    # one use of what is measured: a filter is pushed below its column and would measure for each use
    return packed.where(_let(c["measured"], lambda m: verdict(m, c["threshold"])[1])).select("row.*")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the documents that labels call good."""
    return labels.where(F.col("quality") == 1).select("doc_id")
