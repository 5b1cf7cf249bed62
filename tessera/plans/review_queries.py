"""Registered queries of summaries, reviews, checks and lookups; each over its whole tables. See queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import plugins
from tessera.functions import text as t
from tessera.operators import diagnostics as d
from tessera.operators import evaluation as e
from tessera.operators import governance as g
from tessera.operators import ranking as k
from tessera.operators import reports as p
from tessera.operators import retrieval as r
from tessera.operators import summaries as m
from tessera.operators import windowing as w
from tessera.plans import adapters as a
from tessera.plans.queries import _as_views, _folder, _metrics, _pool_results, _reranked, _sparse_for_vectors, _videos, _views, query, six
from tessera.plans.search import structural_problems
from tessera.sources import tables

DELTAS = ("delta_mean", "delta_median", "better", "tie", "worse")


def long(c: str):
    return F.col(c).cast("long").alias(c)


def _split(q: DataFrame) -> DataFrame:
    return q.withColumn("split", F.when(F.col("query_id") % 3 == 0, "holdout").otherwise("development")).withColumn("task", F.concat(F.lit("t"), (F.col("query_id") % 5).cast("string")))


def _failures(s, x) -> DataFrame:
    """Failures of one pool policy, as if it were the method `coarse`."""
    found = _pool_results(s, x).where("policy_id = 'K3_M1'").select(F.lit("coarse").alias("method_id"), "query_id", "failure_type")
    return found.where("failure_type is not null")


@query
def query_metric_rows(s, x):
    out = _metrics(s, x)
    return out.select(
        "method_id", "query_id", "first_relevant_rank", "video_rank", *map(six, ("best_relevant_score", "best_irrelevant_score", "correct_video_score", "best_wrong_video_score", "top_story_score", "top_video_score", "positive_window_fraction")),
        "top_story_start_s", "top_story_end_s", *map(long, ("physical_window_count", "eligible_window_count", "positive_window_count", "correct_video_positive_windows")), "zero_evidence",
        *(f"video_recall_at_{n}" for n in e.VIDEO_DEPTHS), *(f"story_recall_at_{n}" for n in e.STORY_DEPTHS),
    )


@query
def candidate_slice_summary(s, x):
    out = m.candidate_slices(_split(_pool_results(s, x)), {"split": "split", "task": "task"})
    return out.select("policy_id", "slice", "query_count", six("video_recall"), six("temporal_recall"), six("joint_recall"), six("pairs_mean"), long("pairs_max"))


@query
def method_slice_summary(s, x):
    return m.method_slices(_split(_metrics(s, x)), {"split": "split", "task": "task"}).select("method_id", "slice", "query_count", six("video_mrr"), six("story_mrr"), six("video_recall_at_1"))


@query
def method_summary_vs_control(s, x):
    out = m.method_summary(_metrics(s, x), "exact", _failures(s, x))
    return out.select(
        "method_id", "query_count", *map(six, ("video_rr_mean", "story_rr_mean", "video_rr_delta_mean", "video_rr_delta_median", "story_rr_delta_mean")), "video_rr_better", "video_rr_tie", "video_rr_worse",
        "rank1_recoveries", "rank1_losses", "large_regressions", "hard_regressions", "candidate_video_miss", "candidate_window_miss", "reranker_failure",
    )


@query
def method_summary_intervals(s, x):
    """The same with bootstrap intervals of the deltas."""
    mx = _metrics(s, x)
    deltas = e.compare_methods(mx, "exact").select(F.col("candidate_method").alias("method_id"), "video_rr_delta")
    return m.with_intervals(m.method_summary(mx, "exact"), deltas, "method_id", "video_rr_delta").select("method_id", six("video_rr_mean"), "bootstrap_90_low", "bootstrap_90_high")


@query
def compare_two_references(s, x):
    out = m.compare_references(_metrics(s, x), ["exact", "coarse"])
    return out.select("reference_method", "candidate_method", "query_id", "story_relation", "video_relation", six("video_rr_delta"), "catastrophic_regression", "hard_regression", "rank1_recovery")


@query
def dual_reference_summary(s, x):
    out = m.dual_summary(_metrics(s, x), {"sparse": "coarse", "dense": "exact"})
    names = [f"composite_{c}" for c in ("video_rr", "story_rr", "video_recall_at_1", "video_recall_at_5", "video_recall_at_10", "story_recall_at_1")]
    both = [f"{c}_vs_{v}" for v in ("sparse", "dense") for c in ("video_delta_mean", "video_delta_median", "story_delta_mean")]
    return out.select("method_id", "query_count", *map(six, names + both), *(f"video_{c}_vs_{v}" for v in ("sparse", "dense") for c in ("better", "tie", "worse")))


SPECS = {"P0_max": ("max", 1), "P1_top3": ("topk_mean", 3), "P2_span2": ("contiguous_mean", 2)}


def _aggregations(s, x) -> DataFrame:
    v, q = a.vectors(s, x), a.vector_queries(s, x)
    sc = a.scores(s, x, max(n for kind, n in SPECS.values() if kind != "contiguous_mean"))
    spans = lambda *digits: {name: r.dense_best_spans(v, q, n, digits) for name, (kind, n) in SPECS.items() if kind == "contiguous_mean"}
    exact = m.aggregation_results(sc, q, SPECS, spans(9)).withColumn("source_id", F.lit("exact"))
    return exact.unionByName(m.aggregation_results(sc.withColumn("score", F.round("score", 1)), q, SPECS, spans(9, 1)).withColumn("source_id", F.lit("coarse")))


@query
def aggregation_source_summary(s, x):
    out = m.aggregation_summary(_aggregations(s, x), {"exact": "fine", "coarse": "rough"}, "P0_max")
    return out.select("aggregation_id", *(six(f"{v}_{c}") for v in ("fine", "rough", "cross_source") for c in ("video_rr_mean", "delta_mean", "delta_median")), *(long(f"{v}_{c}") for v in ("fine", "rough", "cross_source") for c in ("better", "tie", "worse")))


@query
def compare_aggregations(s, x):
    """Aggregations against P0 of the same source."""
    rows = _aggregations(s, x).select(F.col("aggregation_id").alias("method_id"), "source_id", "query_id", F.lit(None).cast("long").alias("first_relevant_rank"), "video_rank", F.lit(0.0).alias("story_rr"), "video_rr", F.lit(None).cast("long").alias("top_story_window_id"), F.lit(None).cast("long").alias("top_video_id"))
    return e.compare_methods(rows, "P0_max", ("source_id", "query_id")).select("source_id", "query_id", "candidate_method", "video_relation", six("video_rr_delta"))


@query
def peak_right_and_wrong(s, x):
    out = m.peak_comparison(a.scores(s, x), a.vector_queries(s, x))
    return out.select("query_id", "correct_window_count", six("correct_peak_score"), six("correct_second_score"), six("correct_isolation_gap"), "wrong_video_id", six("wrong_peak_score"), six("wrong_isolation_gap"), six("peak_gap"))


def _targets(s, x) -> DataFrame:
    """Videos by best window as returned hits, with whether their best three windows are relevant."""
    q, sc = a.vector_queries(s, x), a.scores(s, x)
    judged = e.relevance(sc, q, radius=20_000.0, least=30.0)
    best = k.top(judged, ["query_id", "video_id"], k.display_order(), 3, "place").groupBy("query_id", "video_id").agg(F.array_sort(F.collect_list(F.struct("place", "relevant"))).alias("b"))
    hits = k.numbered(k.video_max(sc), ["query_id"], k.video_order(), "rank").where("rank <= 8").join(best, ["query_id", "video_id"]).select("query_id", "video_id", "rank", F.col("b.relevant").alias("moments"))
    return m.target_results(hits, q.select("query_id", F.col("correct_video").alias("target_video_id"), (F.col("query_id") % 3 != 0).alias("timed")))


@query
def target_rank_summary(s, x):
    out = m.target_summary(_targets(s, x))
    return out.select("query_count", "temporal_queries", long("worst_rank"), *map(six, ("mrr", "mean_rank", "median_rank", "moment_hit_at_1", "moment_hit_at_3")), *(six(f"recall_at_{n}") for n in (1, 3, 5, 10, 20, 30, 50, 75, 100)), *(six(f"video_plus_moment_at_{n}") for n in m.MOMENT_DEPTHS))


@query
def failure_review(s, x):
    return m.failure_review(_targets(s, x), 5).select("query_id", long("target_rank"), "moment_hit_at_3", "failure_type")


@query
def hardest_queries(s, x):
    return m.hardest(_targets(s, x)).select("query_id", long("target_rank"), "top_1_video_id")


@query
def dense_query_diagnostics(s, x):
    out = m.dense_diagnostics(a.scores(s, x), a.vector_queries(s, x), best=a.scores(s, x, 20))
    return out.select("query_id", "eligible_window_count", *map(six, ("score_mean", "score_std", "top_score", "bottom_score", "top5_score_mean", "top20_score_mean")), "correct_video_windows_in_top5", "correct_video_windows_in_top20")


@query
def dense_diagnostics_with_ranks(s, x):
    found = m.dense_diagnostics(a.scores(s, x), a.vector_queries(s, x), best=a.scores(s, x, 20)).withColumn("method_id", F.lit("exact"))
    out = m.enriched(found, _metrics(s, x), ["method_id", "query_id"], ["video_rank", "video_score_margin"])
    return out.select("query_id", six("score_mean"), "video_rank", six("video_score_margin"))


@query
def fusion_with_normalisation(s, x):
    """Per query: is the right video's rank by fusion better than by both sources, with the bounds of its scores."""
    q = a.vector_queries(s, x)
    place = a.vectors(s, x).select("doc_id", "video_id").withColumn("start_s", F.col("doc_id") * 45.0)
    dense = r.dense_scores(a.vectors(s, x), q).withColumn("score", F.round("score", 9))
    sparse = _sparse_for_vectors(s, x)
    fused = r.weighted_fusion(dense, sparse, a.vectors(s, x).count())
    every = dense.select("query_id", "doc_id").join(sparse, ["query_id", "doc_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    judged = None
    for name, rows in (("hybrid", fused.select("query_id", "doc_id", F.round("score", 9).alias("score"))), ("dense", dense), ("sparse", every)):
        one = e.relevance(rows.join(place, "doc_id").withColumnRenamed("doc_id", "window_id").withColumn("end_s", F.col("start_s") + 60.0), q).withColumn("method_id", F.lit(name))
        judged = one if judged is None else judged.unionByName(one, allowMissingColumns=True)
    found = e.fusion_diagnostics(e.query_metrics(judged, ("method_id",)), "hybrid", "sparse", "dense")
    out = m.enriched(found, m.normalisation_stats(dense), ["query_id"], ["minimum", "maximum", "constant"])
    return out.select("query_id", "hybrid_rank", "sparse_rank", "dense_rank", "beats_both", "worse_than_both", "agrees_with_sparse", "agrees_with_dense", six("minimum"), six("maximum"), "constant")


@query
def normalisation_bounds(s, x):
    return m.normalisation_stats(a.scores(s, x)).select("query_id", six("minimum"), six("maximum"), "constant")


@query
def suspicious_windows(s, x):
    rows = a.windows(s, x).select("window_id", F.col("text").alias("raw_text"), F.when(F.col("role") != "system", F.col("text")).otherwise("").alias("retrieval_text"), F.when(F.col("window_index") % 5 == 4, "failed").otherwise("ok").alias("status"), F.lit(60.0).alias("duration_s"), (F.length("text") / 10.0).alias("runtime_s"), F.array().cast("array<string>").alias("rejections"))
    found = d.window_diagnostics(rows).join(rows.select("window_id", "runtime_s"), "window_id")
    return m.suspicious_windows(found, 10).select("window_id", long("flag_count"), six("repetition_score"), six("runtime_s"))


@query
def metrics_against_history(s, x):
    now = e.metric_summary(_metrics(s, x), ["method_id"])
    history = now.where("method_id = 'exact'").withColumn("method_id", F.explode(F.array(F.lit("exact"), F.lit("coarse"))))
    out = m.against_history(now, history, ["method_id"], ["video_recall_at_1", "video_mrr", "story_mrr"])
    return out.select("method_id", *(six(c) for v in ("video_recall_at_1", "video_mrr", "story_mrr") for c in (v, f"baseline_{v}", f"{v}_delta")))


@query
def metrics_with_latency(s, x):
    """Each model's run times beside its counts, models without any kept."""
    runs = a.runs(s, x)
    latency = d.latency_summary(runs.where("runtime_s is not null and model_id <> 'view'"), ["model_id"], "runtime_s")
    return p.model_summary(d.operational_summary(runs, ["model_id"]).select("model_id", "expected"), latency.select("model_id", "runs", "mean_ms")).select("model_id", "expected", "runs", six("mean_ms"))


@query
def postprocess_consistency(s, x):
    runs = a.runs(s, x).select("model_id", "stage_id", "status", (F.col("runtime_s") > 20).alias("matches"), F.when(F.col("runtime_s") > 60, "1.1").otherwise("1.0").alias("version"))
    return m.postprocess_consistency(runs, ["model_id", "stage_id"]).select("model_id", "stage_id", "present", "matched", "mismatched", six("match_rate"), F.concat_ws(",", "versions").alias("versions"))


@query
def smoke_models(s, x):
    runs = a.runs(s, x).select("model_id", "status", (F.col("runtime_s") / 60).alias("real_time_factor"), (F.col("runtime_s") / 100).alias("wer"), (F.col("runtime_s") / 200).alias("cer"), F.length("raw_text").cast("double").alias("length_ratio"), F.col("stage_id").alias("peak_memory"), (F.col("stage_id") == 1).alias("known_boilerplate"))
    return m.smoke_summary(runs, "click").select("model_id", "successful_windows", *map(six, ("mean_rtf", "mean_wer", "mean_cer", "mean_length_ratio")), "maximum_peak_memory", "boilerplate_windows")


@query
def size_description(s, x):
    return m.describe(a.table(s, x, "documents"), "n_chars").select(long("count"), *map(six, ("mean", "std", "q25", "q50", "q75")), long("min"), long("max"))


@query
def prefix_counts(s, x):
    return m.by_prefix(a.windows(s, x), "window_id").select("prefix", "n")


@query
def effect_counts(s, x):
    """How often each method improves, worsens or leaves the right video's rank. Every vector is a query."""
    ranks = e.video_metrics(_videos(s, x, a.vector_queries(s, x, every=1), positive=False), ["method_id", "query_id"])
    v = p.view_comparison(_as_views(ranks.withColumn("video_rr", 1.0 / F.col("video_rank"))), "exact", "coarse", ["query_id"])
    return v.select(e.rank_effect(F.col("processed_rank"), F.col("raw_rank")).alias("effect")).groupBy("effect").agg(F.count("*").alias("n"))


@query
def legacy_scores(s, x):
    """The oldest scorer over vectors: half lexical, half clipped semantic evidence; toxic labels are not scored."""
    toxic = a.table(s, x, "labels").where("toxic = 1").select(F.col("doc_id").alias("window_id")).distinct().withColumn("zero_reason", F.lit("processed_rejection"))
    start = F.col("window_id") * 45.0
    wins = a.vectors(s, x).select(F.col("doc_id").alias("window_id"), "video_id").join(toxic, "window_id", "left").withColumn("start_s", start).withColumn("end_s", start + 60.0)
    out = r.legacy_scores(wins, a.vector_queries(s, x), _sparse_for_vectors(s, x), r.dense_scores(a.vectors(s, x), a.vector_queries(s, x)))
    return out.select("query_id", "window_id", "is_scored", "zero_reason", six("lexical_score"), six("semantic_score"), six("final_score"))


@query
def clipped_scores(s, x):
    return r.clipped(a.scores(s, x)).select("query_id", "window_id", six("score"))


@query
def identity_scores(s, x):
    return r.identity_control(a.scores(s, x), "control").select("method_id", "query_id", "window_id", six("score"))


@query
def scores_on_every_window(s, x):
    best = k.top(a.scores(s, x), ["query_id"], k.display_order(), 5).select("query_id", "window_id", "score")
    return r.on_every_window(best, a.scores(s, x).select("window_id").distinct(), a.vector_queries(s, x)).select("query_id", "window_id", six("score"))


@query
def rerank_query_metrics(s, x):
    blend = r.candidate_blend(_reranked(s, x)).groupBy("query_id", "video_id").agg(F.round(F.max("blend"), 9).alias("score"))
    first = e.video_scores(a.scores(s, x, 1)).select("query_id", "video_id", F.col("display_rank").alias("first_rank"))
    return m.rerank_metrics(first, blend, a.vector_queries(s, x)).select("query_id", long("first_rank"), "candidate_rank", "video_rank", six("video_rr"))


@query
def rerank_story_ranks(s, x):
    final = r.candidate_blend(_reranked(s, x)).select("query_id", "window_id", F.round("blend", 9).alias("score"))
    return m.rerank_story_ranks(a.scores(s, x), final, a.vector_queries(s, x)).select("query_id", "window_id", "story_rank", "reranked")


@query
def holdout_evaluation(s, x):
    """Fusion of both kinds of evidence, evaluated on the holdout queries alone."""
    q = g.split_rows(_split(a.vector_queries(s, x)), "holdout").drop("split", "task")
    place = a.vectors(s, x).select("doc_id", "video_id").withColumn("start_s", F.col("doc_id") * 45.0)
    dense = r.dense_scores(a.vectors(s, x), q).withColumn("score", F.round("score", 9))
    fused = r.weighted_fusion(dense, _sparse_for_vectors(s, x).join(r.small(q.select("query_id")), "query_id"), a.vectors(s, x).count()).withColumn("score", F.round("score", 9))
    judged = e.relevance(fused.join(place, "doc_id").withColumnRenamed("doc_id", "window_id").withColumn("end_s", F.col("start_s") + 60.0), q)
    return e.query_metrics(judged).select("query_id", "video_rank", "first_relevant_rank", six("video_rr"), six("story_rr"))


@query
def speed_gate(s, x):
    per = d.operational_summary(a.runs(s, x), ["model_id"]).select("model_id", "aggregate_rtf")
    return e.gate(per, "model_id", "aggregate_rtf", "purchase", "click", 1.0).select(six("slow_value"), six("fast_value"), six("speedup"), "passes")


@query
def transcript_statuses(s, x):
    runs = a.runs(s, x)
    per = runs.groupBy("model_id", "stage_id").agg(F.sum((F.col("status") != "missing").cast("long")).alias("seen"), F.count("*").alias("expected"), F.sum((F.col("status") == "failed").cast("long")).alias("failed"), F.sum((F.trim("raw_text") == "").cast("long")).alias("empty"))
    return per.select("model_id", "stage_id", g.transcript_status(F.col("seen"), F.when(F.col("stage_id") == 0, F.col("expected")).otherwise(F.col("seen")), F.when(F.col("stage_id") < 2, F.col("failed")), F.col("empty"), F.lit(0)).alias("status"))


@query
def pool_contract_problems(s, x):
    pool = k.candidate_pool(a.scores(s, x, 3), 5, 3).join(a.table(s, x, "documents").select(F.col("doc_id").alias("window_id"), "text"), "window_id", "left")
    return g.pool_contract(pool, a.vector_queries(s, x), 5, 3)


@query
def repeat_determinism(s, x):
    """Repeats that disagree: windows of equal index of a conversation's role."""
    return g.determinism(a.windows(s, x), "role", "video_id").select("role", "different")


@query
def benchmark_problems(s, x):
    q = _split(a.vector_queries(s, x))
    wins = a.scores(s, x).select("window_id", "video_id", "start_s", "end_s").distinct()
    return g.benchmark_problems(q, wins, {"query_count": 10, "window_count": 10, "video_count": 10}).select("problem", long("n"))


@query
def corpus_contract_checks(s, x):
    q = _split(a.vector_queries(s, x))
    return g.corpus_contract(q.where("split = 'development'"), q.where("split = 'holdout'"), q.where("split = 'development'").count(), None, ["query_id", "correct_video"])


@query
def inventory_differences(s, x):
    docs = a.table(s, x, "documents").select("doc_id", "lang", "n_chars")
    now = docs.where("doc_id % 10 <> 3").withColumn("n_chars", F.when(F.col("doc_id") % 10 == 5, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return g.verify_inventory(now, docs.where("doc_id % 10 <> 7"), "doc_id", ["lang", "n_chars"])


@query
def frozen_prerequisites(s, x):
    """The stage's tables as they are frozen, one that changed, and one that lacks a column."""
    labels, docs = a.table(s, x, "labels"), a.table(s, x, "documents").select("doc_id", "lang")
    contracts = {"labels": g.frozen(labels, ["doc_id", "quality"]), "documents": g.frozen(docs, ["doc_id", "lang"]), "pages": {"columns": ["nowhere"], "n": 0, "digest": ""}}
    problems = g.prerequisite_problems({"labels": labels, "documents": docs.where("doc_id > 0"), "pages": a.table(s, x, "pages")}, contracts)
    return s.createDataFrame([(y,) for y in problems], "problem string")


@query
def search_structure_problems(s, x):
    """Ranked videos whose ranks have gaps or are too many: the ranking without its second places."""
    ranked = k.numbered(k.video_max(a.scores(s, x, 1)), ["query_id"], k.video_order(), "rank").where("not (rank = 2 and query_id % 40 = 0)")
    return structural_problems(ranked, 100).select("query_id", "n", long("low"), long("high"), "videos")


@query
def strong_duplicate_ids(s, x):
    return d.strong_duplicate_windows(a.windows(s, x))


@query
def reused_vectors(s, x):
    """Vectors that a new release takes over: same id and same label."""
    v = a.vectors(s, x).select("doc_id", F.col("video_id").cast("string").alias("identity"))
    old = v.where("doc_id % 4 <> 0").withColumn("value", F.col("doc_id") * 2).withColumn("identity", F.when(F.col("doc_id") % 4 == 1, F.lit("changed")).otherwise(F.col("identity")))
    return g.reusable(old, v, ["doc_id"]).select("doc_id", "reused", "value")


@query
def run_differences(s, x):
    m_ = _metrics(s, x).select("method_id", "query_id", "video_rank")
    return g.same_rows(m_.where("method_id = 'exact'").drop("method_id"), m_.where("method_id = 'coarse'").drop("method_id"))


@query
def acceptance_gates(s, x):
    rows = e.metric_summary(_metrics(s, x), ["method_id"])
    found = g.acceptance(rows, {"enough_queries": F.min("query_count") >= 1, "mrr": F.min("video_mrr") > 2.0, "recall": F.max("video_recall_at_20") >= 0.0})
    return found.select("accepted", F.concat_ws(",", "blockers").alias("blockers"))


@query
def pivot_of_views(s, x):
    return p.pivot_by_view(_views(s, x), ["video_rank", "video_rr"], ["exact", "coarse"]).select("query_id", "exact_video_rank", six("exact_video_rr"), "coarse_video_rank", six("coarse_video_rr"))


@query
def scope_rows(s, x):
    splits = a.windows(s, x).select("video_id").distinct().withColumn("split", F.when(F.col("video_id") % 4 == 0, "core").when(F.col("video_id") % 4 == 1, "holdout").otherwise("rest"))
    each = [p.scope(a.windows(s, x), splits, n).groupBy().agg(F.count("*").alias("windows"), F.count_distinct("video_id").alias("videos")).withColumn("scope", F.lit(n)) for n in ("all", "core", "holdout", "non_holdout")]
    return g.unioned(each)


@query
def rows_in_any(s, x):
    return g.in_any(a.table(s, x, "documents"), lang=["de", "fr"], source=None).groupBy("lang").agg(F.count("*").alias("n"))


@query
def repeated_keys(s, x):
    return g.duplicate_keys(a.table(s, x, "documents").select(F.md5("text").alias("digest")), ["digest"])


@query
def evenly_spaced_documents(s, x):
    return k.evenly_spaced(a.table(s, x, "documents").select("doc_id"), "doc_id", 7).select("doc_id", long("place"))


@query
def tfidf_dual_cosine(s, x):
    out = r.dual_tfidf_of_rows(a.both_terms(s, x), a.queries(s, x), a.queries(s, x, True))
    return out.select("query_id", "doc_id", six("score"))


@query
def token_audit(s, x):
    return plugins.token_audit(a.table(s, x, "documents"), "text", 512).select(six("p50"), six("p90"), six("p95"), six("cut_share"))


@query
def base_reason_counts(s, x):
    rows = a.windows(s, x).select("window_id", F.array(F.col("role"), F.lit("known_boilerplate"), F.lit("empty_output")).alias("reasons"))
    return rows.select(F.explode(w.base_reasons(F.col("reasons"))).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query
def folded_metric_texts(s, x):
    return a.table(s, x, "documents").select("doc_id", F.md5(t.for_metric(F.col("text"))).alias("metric"))


@query
def report_round_trip(s, x):
    """Reports as CSV, read back."""
    folder, rows = _folder(s, "reports"), a.table(s, x, "labels")
    tables.write_reports({"labels": rows}, folder, {"n": 1})
    return tables.read_csv(s, f"{folder}/labels", rows.schema)


@query
def diagnostics_of_windows(s, x):
    """All diagnostics of the conversations' windows: how many rows each report has."""
    w_ = a.windows(s, x)
    rows = w_.select("window_id", "video_id", "window_index", F.col("text").alias("raw_text"), F.col("text").alias("retrieval_text"), F.lit("ok").alias("status"), F.lit(60.0).alias("duration_s"), F.lit(6.0).alias("runtime_s"), F.array().cast("array<string>").alias("rejections"))
    found = p.diagnose(rows, a.runs(s, x), w_.select("window_id", "text"))
    return s.createDataFrame([(name, r_.count()) for name, r_ in found.items()], "report string, n long")  # a job a report, not one plan of all
