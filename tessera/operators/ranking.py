"""Ranks, orders, limits and pools over long score tables.

A score table has one row per (query, window): query_id, window_id, video_id, start_s, score. Partitions of every
window function are a query's rows or finer, never the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIE = 1e-12


def worst_tied(rows: DataFrame, by: list[str], name: str = "rank", score: str = "score", tolerance: float = TIE) -> DataFrame:
    """rows with their rank, best first: a group of ties is a score and all below it by `tolerance` at most, the next
    group starts with the first score beyond; rows of a group share its worst position.

    Chains of different scores closer than the tolerance are rare, so only these are gathered, to find the scores that
    start a group; all others start their own."""
    line = W.partitionBy(*by).orderBy(F.col(score).desc())
    s = F.col(score)
    up, down = F.lag(score).over(line) - s, s - F.lead(score).over(line)
    close = lambda gap: F.coalesce((gap > 0) & (gap <= tolerance), F.lit(False))
    starts = lambda xs: F.aggregate(
        F.reverse(F.array_sort(xs)), F.array().cast("array<double>"), lambda a, x: F.when((F.size(a) == 0) | (F.get(a, F.size(a) - 1) - x > tolerance), F.concat(a, F.array(x))).otherwise(a)
    )
    chained = rows.withColumn("_close", close(up) | close(down))
    chained = chained.withColumn("_chain", F.collect_set(F.when(F.col("_close"), s.cast("double"))).over(W.partitionBy(*by)))
    # equal scores are all marked as soon as one of them has a close neighbour, as they are in the set
    own = F.when(F.size("_chain") == 0, s.cast("double")).otherwise(F.when(F.array_contains("_chain", s.cast("double")), F.element_at(F.filter(starts(F.col("_chain")), lambda a: a >= s), -1)).otherwise(s))
    anchored = chained.withColumn("_start", own)
    return anchored.withColumn(name, F.count("*").over(W.partitionBy(*by).orderBy(F.col("_start").desc()))).drop("_close", "_chain", "_start")


def worst_tied_rank(by: list[str], score: str = "score", tolerance: float = TIE) -> Column:
    """worst_tied as a Column, for scores without chains (each close to the next, the ends further apart): there it
    would tie along the chain."""
    keys = ", ".join(f"`{c}`" for c in by)
    return F.expr(f"count(*) over (partition by {keys} order by -`{score}` range between unbounded preceding and {tolerance}D following)")


def display_order(score: str = "score") -> list[Column]:
    """Windows: higher score, earlier, smaller id."""
    return [F.col(score).desc(), F.col("start_s").asc(), F.col("window_id").asc()]


def video_order(score: str = "score") -> list[Column]:
    return [F.col(score).desc(), F.col("video_id").asc()]


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def top(rows: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group, with their place."""
    return numbered(rows, by, order, name).where(F.col(name) <= k)


def top_evidence(scores: DataFrame, videos: DataFrame, windows_k: int = 20, videos_k: int = 10) -> DataFrame:
    """Best windows and best videos of each query as one table of evidence."""
    order = [F.col("score").desc(), F.col("video_id").asc(), F.col("start_s").asc(), F.col("window_id").asc()]
    w = top(scores, ["query_id"], order, windows_k).select("query_id", F.lit("window").alias("kind"), "rank", "video_id", "window_id", "score")
    v = top(videos, ["query_id"], video_order(), videos_k).select("query_id", F.lit("video").alias("kind"), "rank", "video_id", F.lit(None).cast(scores.schema["window_id"].dataType).alias("window_id"), "score")
    return w.unionByName(v)


def video_max(scores: DataFrame) -> DataFrame:
    """Best window of each video; every video that has a window is there."""
    return scores.groupBy("query_id", "video_id").agg(F.max("score").alias("score"))


def video_max_floor(scores: DataFrame, videos: DataFrame, queries: DataFrame) -> DataFrame:
    """Every video for every query, with its best score but not below 0; the queries are the small, stated side."""
    axis = on_every_query(videos.select("video_id"), queries)
    return axis.join(video_max(scores), ["query_id", "video_id"], "left").select("query_id", "video_id", F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)).alias("score"))


#: A stated query set up to this size is dealt to rows as an array; a larger one goes in parts.
QUERY_SET = 10_000


def on_every_query(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Each row once for every query of a stated set, whose ids travel as arrays of at most QUERY_SET, one a part."""
    ids = queries.select("query_id").distinct()
    parts = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-ids.count() // QUERY_SET))))
    sets = [r.ids for r in ids.groupBy(parts.alias("p")).agg(F.sort_array(F.collect_list("query_id")).alias("ids")).toLocalIterator()]
    kind = queries.schema["query_id"].dataType
    if not sets:
        return rows.limit(0).withColumn("query_id", F.lit(None).cast(kind))
    each = [rows.withColumn("query_id", F.explode(F.array(*map(F.lit, s)).cast(T.ArrayType(kind)))) for s in sets]
    return reduce(DataFrame.unionByName, each)


def video_top_mean(scores: DataFrame, k: int) -> DataFrame:
    """Mean of the best min(k, n) windows of each video."""
    return top(scores, ["query_id", "video_id"], display_order(), k).groupBy("query_id", "video_id").agg(F.avg("score").alias("score"))


def video_best_span(scores: DataFrame, span: int) -> DataFrame:
    """Best mean of `span` neighbouring windows (of all, where a video has fewer)."""
    by = W.partitionBy("query_id", "video_id")
    line = by.orderBy("start_s", "window_id")
    full = (
        scores.withColumn("n", F.count("*").over(by))
        .withColumn("at", F.row_number().over(line))
        .withColumn("mean", F.avg("score").over(line.rowsBetween(0, span - 1)))
        .where(F.col("at") <= F.greatest(F.col("n") - span + 1, F.lit(1)))
    )
    return full.groupBy("query_id", "video_id").agg(F.max("mean").alias("score"))


def aggregate_videos(scores: DataFrame, kind: str, k: int = 1) -> DataFrame:
    """Video scores by name: max, topk_mean or contiguous_mean."""
    if kind == "max":
        return video_max(scores)
    if kind == "topk_mean":
        return video_top_mean(scores, k)
    if kind == "contiguous_mean":
        return video_best_span(scores, k)
    raise ValueError(f"no video aggregation {kind!r}")


def peaks(scores: DataFrame) -> DataFrame:
    """Each video's best three windows, the best one's neighbours in time, and its gap to the stronger neighbour."""
    by = W.partitionBy("query_id", "video_id")
    line = by.orderBy("start_s", "window_id")
    full = scores.withColumn("place", F.row_number().over(by.orderBy(*display_order()))).withColumn("left", F.lag("score").over(line)).withColumn("right", F.lead("score").over(line))
    nth = lambda n, c="score": F.max(F.when(F.col("place") == n, F.col(c)))
    near = F.greatest(nth(1, "left"), nth(1, "right"))
    return full.groupBy("query_id", "video_id").agg(
        F.count("*").alias("window_count"), nth(1).alias("peak_score"), nth(2).alias("second_score"), nth(3).alias("third_score"),
        nth(1, "window_id").alias("peak_window_id"), nth(1, "left").alias("left_score"), nth(1, "right").alias("right_score"),
        near.alias("strongest_neighbour"), (nth(1) - near).alias("isolation_gap"),
    )


def candidate_pool(scores: DataFrame, video_k: int, windows_m: int) -> DataFrame:
    """Windows of the best video_k videos of each query, windows_m of each video at most."""
    videos = top(video_max(scores), ["query_id"], video_order(), video_k, "video_rank").select("query_id", "video_id", "video_rank", F.col("score").alias("video_score"))
    windows = top(scores, ["query_id", "video_id"], display_order(), windows_m, "window_rank")
    return windows.join(videos, ["query_id", "video_id"])


def capped_pool(scores: DataFrame, video_k: int = 50, windows_m: int = 3, pairs: int = 150) -> DataFrame:
    """The pool, breadth first (every video's first window before any second), and at most `pairs` of a query."""
    return top(candidate_pool(scores, video_k, windows_m), ["query_id"], [F.col("window_rank").asc(), F.col("video_rank").asc()], pairs, "pair_rank")


def pool_grid(scores: DataFrame, policies: list[tuple[str, int, int]]) -> DataFrame:
    """The pools of several (policy, K, M), from one ranking: K and M only cut it."""
    ranked = candidate_pool(scores, max(k for _, k, _ in policies), max(m for _, _, m in policies))
    every = F.array(*(F.struct(F.lit(p).alias("policy_id"), F.lit(k).alias("video_k"), F.lit(m).alias("windows_m")) for p, k, m in policies))
    return ranked.withColumn("policy", F.explode(every)).select("*", "policy.*").drop("policy").where((F.col("video_rank") <= F.col("video_k")) & (F.col("window_rank") <= F.col("windows_m")))


def final_order(first: DataFrame, reranked: DataFrame) -> DataFrame:
    """Reranked videos by final score, then the others as the first stage had them."""
    both = first.select("query_id", "video_id", "first_rank").join(reranked.select("query_id", "video_id", F.col("score").alias("final_score")), ["query_id", "video_id"], "left")
    return numbered(both, ["query_id"], [F.col("final_score").isNull().asc(), F.col("final_score").desc(), F.when(F.col("final_score").isNull(), F.col("first_rank")).asc(), F.col("video_id").asc()], "final_rank")


def supporting_windows(scores: DataFrame, final: DataFrame, n: int = 3) -> DataFrame:
    """n windows of each video: reranked ones by final score, then the rest by first-stage score."""
    both = scores.join(final.select("query_id", "window_id", F.col("score").alias("final_score")), ["query_id", "window_id"], "left")
    order = [F.col("final_score").isNull().asc(), F.col("final_score").desc(), F.when(F.col("final_score").isNull(), F.col("score")).desc(), F.col("start_s").asc(), F.col("window_id").asc()]
    return top(both, ["query_id", "video_id"], order, n, "support_rank")


def pareto_frontier(rows: DataFrame, name: str, up: str, down: str, parts: int = 64) -> DataFrame:
    """Rows that no other beats: at least as good in both and better in one. A sweep by `up` with the least `down` of the
    strictly better ones, so no pair is formed: ranges of `up` are swept side by side, each from the least `down` of the
    ranges above it."""
    of = rows.select(name, up, down)
    best = of.groupBy(up).agg(F.min(down).alias("least"))
    ends = [x for x in best.select(F.percentile_approx(up, F.array(*(F.lit(k / parts) for k in range(1, parts))), F.lit(1000)).alias("e")).first().e or []]
    part = F.size(F.filter(F.array(*map(F.lit, sorted(set(ends)))), lambda e: e < F.col(up))) if ends else F.lit(0)
    ranged = best.withColumn("part", part)
    lows = ranged.groupBy("part").agg(F.min("least").alias("low"))
    over = lows.withColumn("above_part", F.min("low").over(W.orderBy(F.col("part").desc()).rowsBetween(W.unboundedPreceding, -1)))  # one row a range
    inside = F.min("least").over(W.partitionBy("part").orderBy(F.col(up).desc()).rowsBetween(W.unboundedPreceding, -1))
    sweep = ranged.withColumn("inside", inside).join(F.broadcast(over.select("part", "above_part")), "part")
    above = F.least(F.col("inside"), F.col("above_part"))  # nulls are skipped
    kept = sweep.where(above.isNull() | (above > F.col("least")))
    return of.join(kept.select(up, F.col("least").alias(down)), [up, down])


def recommended_policy(summary: DataFrame, target: float = 1.0, tolerance: float = TIE) -> DataFrame:
    """The summary with `recommended`: the cheapest policy that reaches the target recall, or the best recall there is."""
    best = summary.agg(F.max("joint_recall").alias("best")).first().best  # one number
    goal = target if best is not None and best >= target - tolerance else best
    with_goal = summary.withColumn("reaches", F.col("joint_recall") >= F.lit(goal) - tolerance)
    order = W.orderBy(F.col("reaches").desc(), "pairs_max", "video_k", "windows_m", "policy_id")  # a row a policy
    return with_goal.withColumn("recommended", F.row_number().over(order) == 1).drop("reaches")


def extremes(rows: DataFrame, by: list[str], score: str, key: str, n: int, flagged: Column) -> DataFrame:
    """The n highest and the n lowest of each group, and every flagged row."""
    high = F.row_number().over(W.partitionBy(*by).orderBy(F.col(score).desc(), key))
    low = F.row_number().over(W.partitionBy(*by).orderBy(F.col(score).asc(), key))
    return rows.withColumn("from_top", high).withColumn("from_bottom", low).where((F.col("from_top") <= n) | (F.col("from_bottom") <= n) | flagged)


def evenly_spaced(rows: DataFrame, key: str, n: int) -> DataFrame:
    """n rows at even distances in key order, the first and the last included, with their `place` from 0.

    Rows are dealt by ranges of the key and numbered in them; a range's first number is the sum of the ones before."""
    ends = rows.select(F.percentile_approx(key, F.array(*(F.lit(k / 64) for k in range(1, 64))), F.lit(1000)).alias("e")).first().e or []
    part = F.size(F.filter(F.array(*map(F.lit, sorted(set(ends)))), lambda e: e < F.col(key))) if ends else F.lit(0)
    ranged = rows.withColumn("part", part)
    sizes = {r.part: r.n for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}  # 64 at most
    total, before, first = sum(sizes.values()), 0, []
    for k in sorted(sizes):
        first += [F.lit(k), F.lit(before)]
        before += sizes[k]
    if not total:
        return rows.withColumn("place", F.lit(0))
    wanted = sorted({int(i * (total - 1) / max(n - 1, 1) + 0.5) for i in range(n)})
    placed = ranged.withColumn("place", F.row_number().over(W.partitionBy("part").orderBy(key)) - 1 + F.element_at(F.create_map(*first), F.col("part")))
    return placed.where(F.col("place").isin(wanted)).drop("part")
