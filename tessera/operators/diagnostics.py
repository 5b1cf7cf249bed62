"""Quality of transcripts: repetition, duplicates, phrases, agreement of two transcripts, run times."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.operators.retrieval import grams_of, term_counts

# Statuses that count as success.
SUCCESS = ("ok", "success")
NEAR = 0.90
#: Vectors of one block.
BLOCK = 1024


def zero_reason(status: Column, text: Column, rejections: Column, apply_rejections: bool = True) -> Column:
    """Why a window is not searched, or null: the first of a bad status, an empty text and a rejection."""
    out = F.when(~F.coalesce(status, F.lit("")).isin(*SUCCESS), F.concat(F.lit("status_"), F.coalesce(status, F.lit("missing")))).when(t.squeeze(text) == "", "empty_text")
    return out.when(F.coalesce(F.size(rejections) > 0, F.lit(False)), "processed_rejection") if apply_rejections else out


def searchable(status: Column, text: Column, rejections: Column) -> Column:
    """Production's rule: status ok in any case, some text, no rejection."""
    return (F.lower(F.coalesce(status, F.lit(""))) == "ok") & (t.squeeze(text) != "") & (F.coalesce(F.size(rejections), F.lit(0)) <= 0)


def window_diagnostics(windows: DataFrame, sizes: tuple[int, ...] = (3, 4, 5), flag_at: float | None = None) -> DataFrame:
    """Lengths, runs, n-gram repetition, run-time factor and flags of each window, all within the row.
    Columns read: window_id, raw_text, retrieval_text, status, duration_s, runtime_s, rejections."""
    w = windows.withColumn("tokens", t.tokens(t.for_matching(F.col("raw_text")))).withColumn("run", t.repeated_runs(F.col("tokens")))
    for n in sizes:
        w = w.withColumn(f"g{n}", t.gram_repetition(F.col("tokens"), n))
    score = F.greatest(*(F.col(f"g{n}.ratio") for n in sizes)) if len(sizes) > 1 else F.col(f"g{sizes[0]}.ratio")
    flags = F.filter(
        F.array(
            F.when(~F.coalesce(F.col("status"), F.lit("")).isin(*SUCCESS), F.concat(F.lit("status_"), F.coalesce("status", F.lit("missing")))),
            F.when(t.squeeze(F.col("raw_text")) == "", "empty_raw_output"),
            F.when(t.squeeze(F.col("retrieval_text")) == "", "empty_processed_output"),
            F.when(F.size("rejections") > 0, "processed_rejected"),
            *([F.when(score >= flag_at, "high_internal_repetition")] if flag_at is not None else []),
        ),
        lambda x: x.isNotNull(),
    )
    grams = [F.col(f"g{n}.{a}").alias(f"ngram_{n}_{b}") for n in sizes for a, b in (("total", "total"), ("distinct", "unique"), ("repeated", "repeated"), ("ratio", "repetition_ratio"), ("most", "most_repeated"), ("times", "maximum_occurrence"))]
    return w.select(
        "window_id", F.length(F.coalesce("raw_text", F.lit(""))).alias("raw_characters"), F.size("tokens").alias("raw_tokens"),
        F.when(F.col("duration_s") > 0, F.col("runtime_s") / F.col("duration_s")).alias("real_time_factor"),
        F.col("run.longest").alias("longest_run"), F.col("run.runs").alias("repeated_runs"), score.alias("repetition_score"), *grams, flags.alias("flags"),
    )


def exact_duplicates(windows: DataFrame, text: Column, key: str = "window_id") -> DataFrame:
    """Groups of windows of one normalised text: its digest, members, and the first window."""
    norm = t.for_matching(text)
    return t.once(windows.select(key, norm.alias("norm")), "norm").where("norm <> ''").groupBy(F.sha2("norm", 256).alias("digest")).agg(F.count("*").alias("members"), F.min(key).alias("first_id")).where("members > 1")


def near_pairs(windows: DataFrame, least: float = NEAR, block: int = BLOCK) -> DataFrame:
    """Pairs of windows with a character n-gram cosine of `least` or more: (left_id, right_id, similarity).

    windows: window_id and text. Windows of one text are one class, named by its first window, so copies form no
    pairs. Classes are compared in pairs of blocks: a task holds two blocks of vectors and only pairs above the threshold
    become rows. Inside, a vector's n-grams stand by rarity; two vectors can only be similar if they share one of the
    first, before what is left of the vector is shorter than the threshold, so only the lists of these are read, and what
    they give is verified exactly. What is moved grows with the classes times their blocks; for whole corpora use a
    shingle join."""
    norm = t.once(windows.select("window_id", t.for_matching(F.col("text")).alias("norm")), "norm").where("norm <> ''")
    classes = norm.groupBy("norm").agg(F.min("window_id").alias("class_id"), F.count("*").alias("members"))
    size = classes.agg(F.sum("members").alias("n"), F.count("*").alias("k")).first()
    if not size.k:
        return windows.sparkSession.createDataFrame([], "left_id string, right_id string, similarity double")
    terms = term_counts(classes.withColumn("terms", t.tokens(F.col("norm"))), "class_id", "members")
    grams = terms.join(grams_of(terms), "term").groupBy("class_id", "members", "gram").agg(F.sum(F.col("tf") * F.col("times")).alias("tf"))
    idf = grams.groupBy("gram").agg(F.sum("members").alias("df")).select("gram", (F.log((F.lit(1.0) + size.n) / (1 + F.col("df"))) + 1).alias("idf"))
    weighted = grams.join(idf, "gram").select("class_id", F.xxhash64("gram").alias("g"), (F.col("tf") * F.col("idf")).alias("w"))
    vectors = weighted.groupBy("class_id").agg(F.collect_list(F.struct("g", "w")).alias("v")).select("class_id", F.col("v.g").alias("g"), F.col("v.w").alias("w"))
    blocks = -(-size.k // block)
    own = F.pmod(F.xxhash64("class_id"), F.lit(blocks)).cast("int")
    dealt = vectors.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    return dealt.select("i", "j", "own", "class_id", "g", "w").groupBy("i", "j").applyInPandas(_compare_blocks(least), "left_id string, right_id string, similarity double")


def _compare_blocks(least: float):
    def f(key, rows: pd.DataFrame) -> pd.DataFrame:
        i, j = key
        ids, own = rows["class_id"].to_numpy(), rows["own"].to_numpy()
        sizes = np.array([len(x) for x in rows["g"]])
        grams, weights = np.concatenate(rows["g"].to_numpy()), np.concatenate(rows["w"].to_numpy())
        holder = np.repeat(np.arange(len(ids)), sizes)
        weights = weights / np.sqrt(np.bincount(holder, weights=weights * weights))[holder]
        value, place, df = np.unique(grams, return_inverse=True, return_counts=True)
        rarity = np.lexsort((value, df))  # rare n-grams first
        rank = np.empty(len(value), dtype=np.int64)
        rank[rarity] = np.arange(len(value))
        order = np.lexsort((rank[place], holder))  # each vector by rarity
        place, weights = rank[place[order]], weights[order]
        where = np.concatenate([[0], np.cumsum(sizes)])
        # what is left of a vector from each n-gram on; once that is shorter than `least`, the pair must share one before
        left = np.cumsum(weights[::-1] ** 2)[::-1]
        left = left - np.repeat(np.append(left, 0.0)[where[1:]], sizes)
        prefix = left >= least * least - 1e-9
        in_prefix = np.flatnonzero(prefix)
        listed = in_prefix[np.argsort(place[in_prefix], kind="stable")]  # prefix entries by n-gram
        first = np.searchsorted(place[listed], np.arange(len(value) + 1))
        dense = np.zeros(len(value))
        out = []
        for x in range(len(ids)):
            mine = slice(where[x], where[x + 1])
            ahead = np.flatnonzero(prefix[mine]) + where[x]
            many = first[place[ahead] + 1] - first[place[ahead]]
            at = np.repeat(first[place[ahead]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            meets = listed[at]
            # at the first n-gram that two vectors share, what is left of both bounds their product
            near = np.unique(holder[meets[np.repeat(left[ahead], many) * left[meets] >= least**4 - 1e-9]])
            near = near[[ids[x] < ids[y] and (i == j or own[x] != own[y]) for y in near.tolist()]] if len(near) else near
            if not len(near):
                continue
            dense[place[mine]] = weights[mine]
            sizes_of = sizes[near]
            entries = np.repeat(where[near], sizes_of) + np.arange(sizes_of.sum()) - np.repeat(np.cumsum(sizes_of) - sizes_of, sizes_of)
            like = np.add.reduceat(weights[entries] * dense[place[entries]], np.cumsum(sizes_of) - sizes_of)
            dense[place[mine]] = 0.0
            out += [(ids[x], ids[y], float(v)) for y, v in zip(near.tolist(), like.tolist(), strict=True) if v >= least]
        return pd.DataFrame(out, columns=["left_id", "right_id", "similarity"])

    return f


def relationship(left_video: Column, right_video: Column, left_index: Column, right_index: Column) -> Column:
    """adjacent_same_video, non_adjacent_same_video or cross_video."""
    return F.when((left_video == right_video) & (F.abs(left_index - right_index) == 1), "adjacent_same_video").when(left_video == right_video, "non_adjacent_same_video").otherwise("cross_video")


def strong_duplicates(pairs: DataFrame) -> DataFrame:
    """Ids of windows whose exact copy stands elsewhere than next to them."""
    strong = pairs.where(F.col("exact") & F.col("relationship").isin("non_adjacent_same_video", "cross_video"))
    return strong.select(F.col("left_id").alias("window_id")).union(strong.select("right_id")).distinct()


def strong_duplicate_windows(windows: DataFrame) -> DataFrame:
    """strong_duplicates among all copies of a text, without forming their pairs: a window counts if its text has more
    copies than the window itself and those next to it in its video. windows: window_id, video_id, window_index, text."""
    w = windows.select("window_id", "video_id", "window_index", t.for_matching(F.col("text")).alias("norm"))
    w = t.once(w, "norm").where("norm <> ''").select("window_id", "video_id", "window_index", F.sha2("norm", 256).alias("digest")).distinct()
    members = w.groupBy("digest").agg(F.count("*").alias("members")).where("members > 1")
    line = W.partitionBy("digest", "video_id").orderBy("window_index").rangeBetween
    beside = F.count("*").over(line(-1, -1)) + F.count("*").over(line(1, 1))
    return w.join(members, "digest").withColumn("beside", beside).where(F.col("members") - 1 > F.col("beside")).select("window_id").distinct()


def mine_phrases(windows: DataFrame, low: int = 4, high: int = 8, least_videos: int = 2, most: int | None = 500) -> DataFrame:
    """Token n-grams found in several videos: occurrences, windows, videos, largest share of a window, and their
    product with the videos. windows: window_id, video_id, text. Counts are summed per window before they meet."""
    toks = windows.select("window_id", "video_id", t.tokens(t.for_matching(F.col("text"))).alias("w"))
    grams = F.flatten(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda n: F.transform(t.token_grams(F.col("w"), n), lambda g: F.struct(g.alias("phrase"), n.alias("n")))))
    each = toks.select("window_id", "video_id", F.size("w").alias("size"), F.explode(grams).alias("g")).groupBy("window_id", "video_id", "size", "g.phrase", "g.n").agg(F.count("*").alias("c"))
    share = F.least(F.lit(1.0), F.col("c") * F.col("n") / F.col("size"))
    out = each.groupBy("phrase", "n").agg(F.sum("c").alias("occurrences"), F.count_distinct("window_id").alias("windows"), F.count_distinct("video_id").alias("videos"), F.max(share).alias("coverage"))
    out = out.where(F.col("videos") >= least_videos).withColumn("suspicion", F.col("videos") * F.col("coverage"))
    return out if most is None else out.orderBy(F.col("suspicion").desc(), F.col("videos").desc(), F.col("occurrences").desc(), "phrase").limit(most)


def agreement(reference: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """Two transcripts of the same windows: error rates, bag overlap, similarity. Both have keys and text."""
    norm = lambda d, p: d.select(*keys, t.for_agreement(F.col("text")).alias(f"{p}_text"))
    j = norm(reference, "r").join(norm(candidate, "c"), keys).withColumn("r", t.tokens(F.col("r_text"))).withColumn("c", t.tokens(F.col("c_text")))
    j = j.withColumn("bag", t.bag_overlap(F.col("r"), F.col("c"))).withColumn("edits", t.token_distance("r", "c"))
    return j.select(
        *keys, F.size("r").alias("reference_tokens"), F.size("c").alias("candidate_tokens"),
        F.when(F.size("r") > 0, F.col("edits") / F.size("r")).alias("wer"), t.char_error_rate(F.col("r_text"), F.col("c_text")).alias("cer"),
        F.col("bag.precision").alias("token_precision"), F.col("bag.recall").alias("token_recall"), F.col("bag.f1").alias("token_f1"),
        (F.col("edits") / F.greatest(F.size("r"), F.size("c"), F.lit(1))).alias("symmetric_distance"),
        F.when(F.size("r") > 0, F.size("c") / F.size("r")).alias("length_ratio"),
    )


def agreement_summary(rows: DataFrame, trusted: str) -> DataFrame:
    """All windows and the trusted ones: means and medians."""
    tagged = rows.withColumn("subset", F.explode(F.when(F.col(trusted), F.array(F.lit("all_reference_windows"), F.lit("trusted_reference_windows"))).otherwise(F.array(F.lit("all_reference_windows")))))
    return tagged.groupBy("subset").agg(
        F.count("*").alias("window_count"), F.avg("wer").alias("wer_mean"), F.percentile("wer", 0.5).alias("wer_median"), F.avg("cer").alias("cer_mean"), F.percentile("cer", 0.5).alias("cer_median"),
        F.avg("token_f1").alias("token_f1_mean"), F.avg("length_ratio").alias("length_ratio_mean"),
    )


def operational_summary(runs: DataFrame, by: list[str]) -> DataFrame:
    """Counts, run times and real-time factors of a group: status, runtime_s, duration_s, raw_text."""
    tried = F.col("runtime_s").isNotNull()
    good = F.col("status").isin(*SUCCESS)
    rtf = F.when(tried & (F.col("duration_s") != 0), F.col("runtime_s") / F.col("duration_s"))
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    total, audio = F.sum(F.coalesce("runtime_s", F.lit(0.0))), F.sum(F.when(tried, F.coalesce("duration_s", F.lit(0.0))).otherwise(0.0))
    return runs.groupBy(*by).agg(
        F.count("*").alias("expected"), count(F.col("status") != "missing").alias("present"), count(good).alias("successful"), count(~good & (F.col("status") != "missing")).alias("failed"),
        count(good & (t.squeeze(F.col("raw_text")) == "")).alias("empty"), total.alias("total_runtime_s"), audio.alias("total_audio_s"),
        F.when(audio > 0, total / audio).alias("aggregate_rtf"), F.avg(rtf).alias("mean_rtf"), F.percentile(rtf, 0.5).alias("median_rtf"), F.percentile(rtf, 0.9).alias("p90_rtf"), F.percentile(rtf, 0.95).alias("p95_rtf"),
        F.when(total > 0, count(tried) / (total / 3600.0)).alias("windows_per_hour"),
    )


def latency_summary(rows: DataFrame, by: list[str], value: str, percentiles: tuple[int, ...] = (50, 90, 95)) -> DataFrame:
    """Mean, percentiles (linear between ranks), maximum, and runs per second of a latency in milliseconds."""
    return rows.groupBy(*by).agg(F.count("*").alias("runs"), F.avg(value).alias("mean_ms"), *(F.percentile(value, p / 100).alias(f"p{p}_ms") for p in percentiles), F.max(value).alias("max_ms"), (F.count("*") / (F.sum(value) / 1000)).alias("per_second"))


def counters(rows: DataFrame, by: list[str], values: Column) -> DataFrame:
    """How often each value of an array column occurs, in groups."""
    return rows.select(*by, F.explode(values).alias("value")).groupBy(*by, "value").agg(F.count("*").alias("n"))
