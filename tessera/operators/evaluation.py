"""Relevance, retrieval metrics and paired comparison of methods."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.ranking import display_order, on_every_query, video_max, video_order, worst_tied
from tessera.operators.retrieval import small

# Depths at which recall is reported.
STORY_DEPTHS = (1, 3, 5, 10)
VIDEO_DEPTHS = (1, 3, 5, 10, 20)


def overlap_seconds(start: Column, end: Column, answer: Column, radius: float = 60.0) -> Column:
    """Seconds that a window shares with the answer's zone."""
    return F.greatest(F.lit(0.0), F.least(end, answer + radius) - F.greatest(start, answer - radius))


def relevance(scores: DataFrame, queries: DataFrame, radius: float = 60.0, least: float = 30.0) -> DataFrame:
    """Score rows with overlap_s and relevant: the right video, and enough of the window in the answer's zone.
    queries: query_id, correct_video, answer_time_s."""
    both = scores.join(small(queries.select("query_id", "correct_video", "answer_time_s")), "query_id")
    over = overlap_seconds(F.col("start_s"), F.col("end_s"), F.col("answer_time_s"), radius)
    return both.withColumn("overlap_s", over).withColumn("relevant", (F.col("video_id") == F.col("correct_video")) & (F.col("overlap_s") >= least))


def query_metrics(judged: DataFrame, keys: tuple[str, ...] = (), videos: DataFrame | None = None) -> DataFrame:
    """One row per query (and keys): first relevant rank inside the right video, the video's rank among videos, best
    windows and videos with their scores, margins, counts of windows with evidence, recall flags and reciprocal ranks.
    Ranks are worst-tied; null without relevance. judged may have `eligible`; other facts of a query are joined to the
    result by query_id. videos: see video_metrics, where judged holds the rows of the right video only."""
    by = [*keys, "query_id"]
    eligible = F.col("eligible") if "eligible" in judged.columns else F.lit(True)
    positive = (F.col("score") > 0) & eligible
    story = judged.where("video_id = correct_video")
    story = worst_tied(story, by, "story_rank").withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*display_order())))
    one = story.groupBy(*by).agg(
        F.min(F.when(F.col("relevant"), F.col("story_rank"))).alias("first_relevant_rank"),
        F.max(F.when(F.col("relevant"), F.col("score"))).alias("best_relevant_score"), F.max(F.when(~F.col("relevant"), F.col("score"))).alias("best_irrelevant_score"),
        *(F.max(F.when(F.col("place") == 1, F.col(c))).alias(n) for c, n in (("window_id", "top_story_window_id"), ("start_s", "top_story_start_s"), ("end_s", "top_story_end_s"), ("score", "top_story_score"))),
        F.sum(positive.cast("long")).alias("correct_video_positive_windows"),
    ).withColumn("story_score_margin", F.col("best_relevant_score") - F.col("best_irrelevant_score"))
    if videos is None:
        videos = judged.groupBy(*by, "video_id", "correct_video").agg(F.max("score").alias("score"), F.max(positive.cast("int")).alias("positive"), F.count("*").alias("windows"), F.sum(eligible.cast("long")).alias("eligible_windows"), F.sum(positive.cast("long")).alias("positive_windows"))
    out = video_metrics(videos, by).join(one, by, "left")
    at = lambda rank, k: F.coalesce(F.col(rank) <= k, F.lit(False)).cast("double")
    return out.select(
        "*",
        *(at("first_relevant_rank", k).alias(f"story_recall_at_{k}") for k in STORY_DEPTHS),
        *(at("video_rank", k).alias(f"video_recall_at_{k}") for k in VIDEO_DEPTHS),
        F.coalesce(1.0 / F.col("first_relevant_rank"), F.lit(0.0)).alias("story_rr"),
        F.coalesce(1.0 / F.col("video_rank"), F.lit(0.0)).alias("video_rr"),
    )


def video_metrics(videos: DataFrame, by: list[str]) -> DataFrame:
    """What query_metrics says about a query's videos: query_id, video_id, correct_video, score, positive, windows,
    eligible_windows and positive_windows."""
    videos = worst_tied(videos, by, "video_rank").withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*video_order())))
    right = F.col("video_id") == F.col("correct_video")
    return videos.groupBy(*by).agg(
        F.max(F.when(right, F.col("video_rank"))).alias("video_rank"),
        F.max(F.when(right, F.col("score"))).alias("correct_video_score"),
        F.max(F.when(~right, F.col("score"))).alias("best_wrong_video_score"),
        F.max(F.when(F.col("place") == 1, F.col("video_id"))).alias("top_video_id"),
        F.max("score").alias("top_video_score"),
        F.sum("windows").alias("physical_window_count"),
        F.sum("eligible_windows").alias("eligible_window_count"),
        F.sum("positive_windows").alias("positive_window_count"),
        (F.sum("positive_windows") / F.sum("windows")).alias("positive_window_fraction"),
        F.sum("positive").alias("positive_video_count"),
        (F.max("positive") == 0).alias("zero_evidence"),
    ).withColumn("video_score_margin", F.col("correct_video_score") - F.col("best_wrong_video_score"))


def _summaries() -> list[Column]:
    return [
        F.count("*").alias("query_count"),
        *(F.avg(f"story_recall_at_{k}").alias(f"story_recall_at_{k}") for k in STORY_DEPTHS),
        F.avg("story_rr").alias("story_mrr"),
        F.avg("first_relevant_rank").alias("story_first_rank_mean"),
        F.percentile("first_relevant_rank", 0.5).alias("story_first_rank_median"),
        *(F.avg(f"video_recall_at_{k}").alias(f"video_recall_at_{k}") for k in VIDEO_DEPTHS),
        F.avg("video_rr").alias("video_mrr"),
        F.avg("video_rank").alias("video_rank_mean"),
        F.percentile("video_rank", 0.5).alias("video_rank_median"),
        F.avg("story_score_margin").alias("story_score_margin_mean"),
        F.avg("video_score_margin").alias("video_score_margin_mean"),
        F.sum(F.col("zero_evidence").cast("long")).alias("zero_evidence_query_count"),
    ]


def metric_summary(metrics: DataFrame, by: list[str]) -> DataFrame:
    return metrics.groupBy(*by).agg(*_summaries())


def metric_breakdowns(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """Metrics over all queries and by each column alone, in one pass of grouping sets: breakdown_type, breakdown_value."""
    keys = [F.col(c).cast("string").alias(c) for c in columns]
    cast = metrics.select(*[c for c in metrics.columns if c not in columns], *keys)
    sets = [[], *([F.col(c)] for c in columns)]
    grouped = cast.groupingSets(sets, *columns).agg(F.grouping_id(*columns).alias("gid"), *_summaries())
    whole = (1 << len(columns)) - 1
    kind, value = F.when(F.col("gid") == whole, "overall"), F.when(F.col("gid") == whole, F.lit("all"))
    for k, c in enumerate(columns):
        mine = whole & ~(1 << (len(columns) - 1 - k))
        kind, value = kind.when(F.col("gid") == mine, c), value.when(F.col("gid") == mine, F.col(c))
    return grouped.withColumn("breakdown_type", kind).withColumn("breakdown_value", value).drop("gid", *columns)


def rank_relation(candidate: Column, reference: Column) -> Column:
    """better, worse or tie; a missing rank is worse than any."""
    a, b = F.coalesce(candidate.cast("double"), F.lit(float("inf"))), F.coalesce(reference.cast("double"), F.lit(float("inf")))
    return F.when(a < b, "better").when(a > b, "worse").otherwise("tie")


def rank_effect(candidate: Column, reference: Column) -> Column:
    return F.when(rank_relation(candidate, reference) == "better", "improved").when(rank_relation(candidate, reference) == "worse", "worsened").otherwise("unchanged")


def compare_methods(metrics: DataFrame, reference: str, keys: tuple[str, ...] = ("query_id",), hard_rank: int = 20) -> DataFrame:
    """Each method's queries against the reference method's: relations, deltas, changes at the top, regressions."""
    fields = ["first_relevant_rank", "video_rank", "story_rr", "video_rr", "top_story_window_id", "top_video_id"]
    ref = metrics.where(F.col("method_id") == reference).select(*keys, *(F.col(c).alias(f"{c}_reference") for c in fields))
    both = metrics.where(F.col("method_id") != reference).join(ref, list(keys))
    delta = F.col("video_rank") - F.col("video_rank_reference")
    return both.select(
        *keys, F.lit(reference).alias("reference_method"), F.col("method_id").alias("candidate_method"),
        rank_relation(F.col("first_relevant_rank"), F.col("first_relevant_rank_reference")).alias("story_relation"),
        rank_relation(F.col("video_rank"), F.col("video_rank_reference")).alias("video_relation"),
        (F.col("story_rr") - F.col("story_rr_reference")).alias("story_rr_delta"),
        (F.col("video_rr") - F.col("video_rr_reference")).alias("video_rr_delta"),
        (~F.col("top_story_window_id").eqNullSafe(F.col("top_story_window_id_reference"))).alias("top_story_changed"),
        (~F.col("top_video_id").eqNullSafe(F.col("top_video_id_reference"))).alias("top_video_changed"),
        F.coalesce((delta >= 10) & (F.col("video_rank") > 10), F.lit(False)).alias("catastrophic_regression"),
        F.coalesce((F.col("video_rank_reference") == 1) & (F.col("video_rank") > hard_rank), F.lit(False)).alias("hard_regression"),
        F.coalesce((F.col("video_rank_reference") != 1) & (F.col("video_rank") == 1), F.lit(False)).alias("rank1_recovery"),
        F.coalesce((F.col("video_rank_reference") == 1) & (F.col("video_rank") != 1), F.lit(False)).alias("rank1_loss"),
    )


def relation_counts(compared: DataFrame, by: list[str], relation: str) -> DataFrame:
    """Better, tie and worse as columns, 0 where there are none."""
    return compared.groupBy(*by).pivot(relation, ["better", "tie", "worse"]).count().na.fill(0)


def composite(metrics: DataFrame, reference: str) -> DataFrame:
    """Methods by their means over channels: per query first, then deltas against the reference."""
    per = metrics.groupBy("method_id", "query_id").agg(F.avg("video_rr").alias("video_rr"), F.avg("story_rr").alias("story_rr"))
    ref = per.where(F.col("method_id") == reference).select("query_id", F.col("video_rr").alias("rv"), F.col("story_rr").alias("rs"))
    d = F.col("video_rr") - F.col("rv")
    count = lambda c: F.sum(c.cast("long"))
    return per.join(ref, "query_id").groupBy("method_id").agg(
        F.count("*").alias("query_count"), F.avg("video_rr").alias("composite_video_rr"), F.avg("story_rr").alias("composite_story_rr"),
        F.avg(d).alias("video_delta_mean"), F.percentile(d, 0.5).alias("video_delta_median"), F.avg(F.col("story_rr") - F.col("rs")).alias("story_delta_mean"),
        count(d > 0).alias("better"), count(d == 0).alias("tie"), count(d < 0).alias("worse"),
    )


def bootstrap_interval(rows: DataFrame, key: str, value: str, confidence: float = 0.9, samples: int = 2000, seed: int = 20260810) -> DataFrame:
    """Interval of the mean of each group's values by resampling with a seeded generator. A group is a method's
    per-query values (as many as there are queries), sorted, so the interval does not depend on row order."""

    def f(group: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(group[value].dropna().to_numpy(dtype=float))
        if not len(v):
            return pd.DataFrame({key: [group[key].iloc[0]], "n": [0], "low": [None], "high": [None]})
        rng = np.random.default_rng(seed)
        step = max(1, (1 << 22) // len(v))  # samples drawn at a time
        means = np.concatenate([rng.choice(v, size=(min(step, samples - k), len(v))).mean(axis=1) for k in range(0, samples, step)])
        low, high = np.quantile(means, [(1 - confidence) / 2, (1 + confidence) / 2])
        return pd.DataFrame({key: [group[key].iloc[0]], "n": [len(v)], "low": [low], "high": [high]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, value).groupBy(key).applyInPandas(f, f"{key} {kind}, n long, low double, high double")


def fusion_diagnostics(metrics: DataFrame, hybrid: str, sparse: str, dense: str) -> DataFrame:
    """Per query: does the hybrid beat both of its sources, lose to both, and agree with them at the top?"""
    of = lambda m, p: metrics.where(F.col("method_id") == m).select("query_id", F.col("video_rank").alias(f"{p}_rank"), F.col("top_video_id").alias(f"{p}_top"))
    j = of(hybrid, "hybrid").join(of(sparse, "sparse"), "query_id").join(of(dense, "dense"), "query_id")
    rel = lambda p: rank_relation(F.col("hybrid_rank"), F.col(f"{p}_rank"))
    return j.select(
        "query_id", "hybrid_rank", "sparse_rank", "dense_rank",
        ((rel("sparse") == "better") & (rel("dense") == "better")).alias("beats_both"), ((rel("sparse") == "worse") & (rel("dense") == "worse")).alias("worse_than_both"),
        F.col("hybrid_top").eqNullSafe(F.col("sparse_top")).alias("agrees_with_sparse"), F.col("hybrid_top").eqNullSafe(F.col("dense_top")).alias("agrees_with_dense"),
    )


def pool_results(pool: DataFrame, queries: DataFrame) -> DataFrame:
    """Per policy and query: was the right video kept, and a relevant window of it? pool: rows of pool_grid with
    correct_video and relevant."""
    of = pool.groupBy("policy_id", "video_k", "windows_m", "query_id").agg(
        F.count("*").alias("pair_count"), F.max((F.col("video_id") == F.col("correct_video")).cast("int")).alias("v"), F.max(F.col("relevant").cast("int")).alias("r")
    )
    kept, relevant = F.coalesce(F.col("v"), F.lit(0)) == 1, F.coalesce(F.col("r"), F.lit(0)) == 1
    every = on_every_query(of.select("policy_id", "video_k", "windows_m").distinct(), queries)
    return every.join(of, ["policy_id", "video_k", "windows_m", "query_id"], "left").select(
        "policy_id", "video_k", "windows_m", "query_id", F.coalesce("pair_count", F.lit(0)).alias("pair_count"),
        kept.alias("video_kept"), relevant.alias("window_kept"), (kept & relevant).alias("joint_success"),
        F.when(~kept, "CANDIDATE_VIDEO_MISS").when(~relevant, "CANDIDATE_WINDOW_MISS").alias("failure_type"),
    )


def pool_summary(results: DataFrame) -> DataFrame:
    rate = lambda c: F.avg(F.col(c).cast("double"))
    misses = lambda c: F.sum((~F.col(c)).cast("long"))
    return results.groupBy("policy_id", "video_k", "windows_m").agg(
        F.count("*").alias("query_count"), F.avg("pair_count").alias("pairs_mean"), F.max("pair_count").alias("pairs_max"),
        rate("video_kept").alias("video_recall"), rate("window_kept").alias("temporal_recall"), rate("joint_success").alias("joint_recall"),
        F.coalesce(F.avg(F.when(F.col("video_kept"), F.col("window_kept").cast("double"))), F.lit(0.0)).alias("conditional_temporal_recall"),
        misses("video_kept").alias("video_misses"), misses("joint_success").alias("joint_misses"),
    )


def failures(results: DataFrame) -> DataFrame:
    return results.where(F.col("failure_type").isNotNull()).orderBy("policy_id", "failure_type", "query_id")


def gate(rows: DataFrame, model: str, value: str, slow: str, fast: str, least: float = 10.0) -> DataFrame:
    """How many times faster `fast` is than `slow`, and whether that reaches the gate."""
    of = lambda m: F.max(F.when(F.col(model) == m, F.col(value)))
    return rows.agg(of(slow).alias("slow_value"), of(fast).alias("fast_value")).withColumn("speedup", F.col("slow_value") / F.col("fast_value")).withColumn("passes", F.col("speedup") >= least)


def regression(actual: DataFrame, expected: DataFrame, keys: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Rows that differ from the expected ones, or are on one side only."""
    a, e = actual.select(*keys, F.col(value).alias("actual")), expected.select(*keys, F.col(value).alias("expected"))
    both = a.join(e, keys, "full")
    status = F.when(F.col("expected").isNull(), "unexpected").when(F.col("actual").isNull(), "missing").when(F.abs(F.col("actual") - F.col("expected")) > tolerance, "different").otherwise("same")
    return both.withColumn("status", status)


def video_scores(scores: DataFrame) -> DataFrame:
    """Videos of each query by best window, ranked for metrics (worst-tied) and for display."""
    v = video_max(scores)
    return worst_tied(v, ["query_id"], "metric_rank").withColumn("display_rank", F.row_number().over(W.partitionBy("query_id").orderBy(*video_order())))
