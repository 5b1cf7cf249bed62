"""DuckDB SQL for the queries of review_queries, over the same tables."""

from __future__ import annotations

from tessera.plans.oracles import _VIEWS, AGREE, BLEND, CHARS, GRID, JUDGED, METRICS, OPS, POOL, RUNS, SC, SPARSE, TFIDF, VEC, WIN, _six, folded, norm, rel, toks, worst

_AT = ", ".join(f"coalesce({r} <= {k}, false)::INT::DOUBLE AS {v}_recall_at_{k}" for r, v, ks in (("video_rank", "video", (1, 3, 5, 10, 20)), ("first_relevant_rank", "story", (1, 3, 5, 10))) for k in ks)
_ALL = METRICS + f", ma AS (SELECT * EXCLUDE (video_recall_at_3, story_recall_at_3), {_AT} FROM m)"
_SPLIT = "CASE WHEN query_id % 3 = 0 THEN 'holdout' ELSE 'development' END AS split, 't' || (query_id % 5) AS task"
_SLICE = "CASE WHEN grouping(split) = 0 THEN 'split:' || split WHEN grouping(task) = 0 THEN 'task:' || task ELSE 'all' END AS slice"
_REF = _ALL + ", rf AS (SELECT a.*, b.video_rr AS rv, b.story_rr AS rs, b.video_rank AS rr FROM ma a JOIN ma b USING (query_id) WHERE b.method_id = '{}')"


def _delta(v: str, r: str, pre: str = "", suf: str = "") -> str:
    d = f"{v} - {r}"
    return f"round(avg({d}), 6) AS {pre}delta_mean{suf}, round(median({d}), 6) AS {pre}delta_median{suf}, count(*) FILTER ({d} > 0) AS {pre}better{suf}, count(*) FILTER ({d} = 0) AS {pre}tie{suf}, count(*) FILTER ({d} < 0) AS {pre}worse{suf}"


def _compare(ref: str) -> str:
    return f"""SELECT '{ref}' AS reference_method, a.method_id AS candidate_method, a.query_id, {rel('a.first_relevant_rank', 'b.first_relevant_rank')} AS story_relation, {rel('a.video_rank', 'b.video_rank')} AS video_relation,
round(a.video_rr - b.video_rr, 6) AS video_rr_delta, coalesce(a.video_rank - b.video_rank >= 10 AND a.video_rank > 10, false) AS catastrophic_regression, coalesce(b.video_rank = 1 AND a.video_rank > 20, false) AS hard_regression,
coalesce(b.video_rank <> 1 AND a.video_rank = 1, false) AS rank1_recovery FROM m a JOIN m b USING (query_id) WHERE a.method_id <> '{ref}' AND b.method_id = '{ref}'"""


_PER = """, per AS (SELECT method_id, query_id, avg(video_rr) AS video_rr, avg(story_rr) AS story_rr, avg(video_recall_at_1) AS video_recall_at_1, avg(video_recall_at_5) AS video_recall_at_5, avg(video_recall_at_10) AS video_recall_at_10, avg(story_recall_at_1) AS story_recall_at_1 FROM ma GROUP BY ALL)"""


def _vs(name: str, ref: str) -> str:
    return f", v{name} AS (SELECT a.method_id, {_delta('a.video_rr', 'b.video_rr', 'video_', f'_vs_{name}')}, round(avg(a.story_rr - b.story_rr), 6) AS story_delta_mean_vs_{name} FROM per a JOIN per b USING (query_id) WHERE b.method_id = '{ref}' GROUP BY a.method_id)"


def _agg(source: str, score: str) -> str:
    by = "PARTITION BY query_id, video_id"
    return f""", s{source} AS (SELECT query_id, window_id, video_id, start_s, {score} AS score FROM sc), p{source} AS (SELECT *, row_number() OVER ({by} ORDER BY score DESC, start_s, window_id) AS n, count(*) OVER ({by}) AS c, row_number() OVER ({by} ORDER BY start_s, window_id) AS i, avg(score) OVER ({by} ORDER BY start_s, window_id ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS w FROM s{source}),
a{source} AS (SELECT 'P0_max' AS aggregation_id, query_id, video_id, max(score) AS score FROM p{source} GROUP BY ALL UNION ALL SELECT 'P1_top3', query_id, video_id, avg(score) FROM p{source} WHERE n <= 3 GROUP BY ALL UNION ALL SELECT 'P2_span2', query_id, video_id, max(w) FROM p{source} WHERE i <= greatest(c - 1, 1) GROUP BY ALL),
r{source} AS (SELECT aggregation_id, query_id, video_id, {worst('aggregation_id, query_id')} AS video_rank FROM a{source}),
g{source} AS (SELECT '{source}' AS source_id, aggregation_id, r.query_id, video_rank, 1.0 / video_rank AS video_rr FROM r{source} r JOIN vq ON r.query_id = vq.query_id AND r.video_id = vq.correct_video)"""


_AGGS = SC + _agg("exact", "score") + _agg("coarse", "round(score, 1)") + ", ag AS (SELECT * FROM gexact UNION ALL SELECT * FROM gcoarse)"
_WIDE = _AGGS + """, pq AS (SELECT source_id, aggregation_id, query_id, avg(video_rr) AS rr FROM ag GROUP BY ALL), pc AS (SELECT * FROM pq UNION ALL SELECT 'cross', aggregation_id, query_id, avg(rr) FROM pq GROUP BY ALL),
pd AS (SELECT a.*, b.rr AS r0 FROM pc a JOIN pc b ON a.source_id = b.source_id AND a.query_id = b.query_id AND b.aggregation_id = 'P0_max')"""


def _wide(source: str, name: str) -> str:
    f = f"FILTER (source_id = '{source}')"
    return f"round(avg(rr) {f}, 6) AS {name}_video_rr_mean, round(avg(rr - r0) {f}, 6) AS {name}_delta_mean, round(median(rr - r0) {f}, 6) AS {name}_delta_median, count(*) FILTER (source_id = '{source}' AND rr > r0) AS {name}_better, count(*) FILTER (source_id = '{source}' AND rr = r0) AS {name}_tie, count(*) FILTER (source_id = '{source}' AND rr < r0) AS {name}_worse"


_PEAK = SC + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY score DESC, start_s, window_id) AS n, lag(score) OVER l AS l, lead(score) OVER l AS r FROM sc WINDOW l AS (PARTITION BY query_id, video_id ORDER BY start_s, window_id)),
pk AS (SELECT query_id, video_id, count(*) AS window_count, max(score) FILTER (n = 1) AS peak, max(score) FILTER (n = 2) AS second, max(score) FILTER (n = 1) - greatest(max(l) FILTER (n = 1), max(r) FILTER (n = 1)) AS gap FROM r GROUP BY ALL),
pb AS (SELECT pk.*, video_id = correct_video AS ok FROM pk JOIN vq USING (query_id) QUALIFY row_number() OVER (PARTITION BY query_id, video_id = correct_video ORDER BY peak DESC, video_id) = 1)"""
_TARGET = SC + """, j AS (SELECT sc.*, video_id = correct_video AND greatest(0.0, least(end_s, answer + 20000) - greatest(start_s, answer - 20000)) >= 30 AS relevant FROM sc JOIN vq USING (query_id)),
b AS (SELECT query_id, video_id, list(relevant ORDER BY score DESC, start_s, window_id)[1:3] AS moments FROM j GROUP BY ALL),
h AS (SELECT query_id, video_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, video_id) AS rank FROM (SELECT query_id, video_id, max(score) AS s FROM sc GROUP BY ALL) QUALIFY rank <= 8),
t AS (SELECT vq.query_id, correct_video, query_id % 3 <> 0 AS timed FROM vq),
res AS (SELECT t.query_id, h.rank AS target_rank, coalesce(1.0 / h.rank, 0) AS rr, CASE WHEN timed THEN coalesce(moments[1], false) END AS m1, CASE WHEN timed THEN coalesce(list_bool_or(moments), false) END AS m3, (SELECT video_id FROM h z WHERE z.query_id = t.query_id AND z.rank = 1) AS top_1_video_id
        FROM t LEFT JOIN h ON h.query_id = t.query_id AND h.video_id = t.correct_video LEFT JOIN b ON b.query_id = h.query_id AND b.video_id = h.video_id)"""
_DIAG = SC + """, dp AS (SELECT sc.*, correct_video, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, window_id) AS n FROM sc JOIN vq USING (query_id)),
dd AS (SELECT query_id, count(*) AS eligible_window_count, avg(score) AS score_mean, stddev_pop(score) AS score_std, max(score) AS top_score, min(score) AS bottom_score, avg(score) FILTER (n <= 5) AS top5_score_mean, avg(score) FILTER (n <= 20) AS top20_score_mean, count(*) FILTER (n <= 5 AND video_id = correct_video) AS correct_video_windows_in_top5, count(*) FILTER (n <= 20 AND video_id = correct_video) AS correct_video_windows_in_top20 FROM dp GROUP BY query_id)"""
_FUSED = VEC + f""", {SPARSE}, f0 AS (SELECT query_id, doc_id, video_id, dense.score AS d, coalesce(sp.score, 0) AS s FROM dense LEFT JOIN sp USING (query_id, doc_id)),
f1 AS (SELECT *, CASE WHEN max(s) OVER q - min(s) OVER q > 1e-12 THEN (s - min(s) OVER q) / (max(s) OVER q - min(s) OVER q) ELSE 0 END AS ns, CASE WHEN max(d) OVER q - min(d) OVER q > 1e-12 THEN (d - min(d) OVER q) / (max(d) OVER q - min(d) OVER q) ELSE 0 END AS nd FROM f0 WINDOW q AS (PARTITION BY query_id)),
f2 AS (SELECT query_id, doc_id, video_id, d, s, round(0.25 * ns + 0.75 * nd, 9) AS h FROM f1)"""


def _rank_of(name: str, c: str) -> str:
    return f""", x{name} AS (SELECT query_id, video_id, max({c}) AS score FROM f2 GROUP BY ALL), y{name} AS (SELECT *, {worst('query_id')} AS r, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, video_id) AS n FROM x{name}),
z{name} AS (SELECT y.query_id, max(r) FILTER (y.video_id = correct_video) AS {name}_rank, max(y.video_id) FILTER (n = 1) AS {name}_top FROM y{name} y JOIN vq USING (query_id) GROUP BY ALL)"""


_REPEAT = f"""wt AS (SELECT window_id, window_index, role, text, {toks(norm("text"))} AS w FROM win),
gg AS (SELECT window_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT window_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM wt, (VALUES (3), (4), (5)) v(k))),
gr AS (SELECT window_id, max(q) AS ratio FROM (SELECT window_id, k, (count(*) - count(DISTINCT g)) / count(*) AS q FROM gg GROUP BY ALL) GROUP BY ALL)"""

REVIEWS: dict[str, str] = {
    "query_metric_rows": f"WITH {_ALL} SELECT method_id, query_id, first_relevant_rank, video_rank, {_six('best_relevant_score', 'best_irrelevant_score', 'correct_video_score', 'best_wrong_video_score', 'top_story_score', 'top_video_score', 'positive_window_fraction')}, top_story_start_s, top_story_end_s, physical_window_count, physical_window_count AS eligible_window_count, positive_window_count, correct_video_positive_windows, zero_evidence, " + ", ".join(f"video_recall_at_{k}" for k in (1, 3, 5, 10, 20)) + ", " + ", ".join(f"story_recall_at_{k}" for k in (1, 3, 5, 10)) + " FROM ma",
    "candidate_slice_summary": f"WITH {GRID}, x AS (SELECT *, {_SPLIT} FROM res) SELECT policy_id, {_SLICE}, count(*) AS query_count, round(avg(video_kept::INT), 6) AS video_recall, round(avg(window_kept::INT), 6) AS temporal_recall, round(avg((video_kept AND window_kept)::INT), 6) AS joint_recall, round(avg(pair_count), 6) AS pairs_mean, max(pair_count) AS pairs_max FROM x GROUP BY GROUPING SETS ((policy_id), (policy_id, split), (policy_id, task))",
    "method_slice_summary": f"WITH {_ALL}, x AS (SELECT *, {_SPLIT} FROM ma) SELECT method_id, {_SLICE}, count(*) AS query_count, round(avg(video_rr), 6) AS video_mrr, round(avg(story_rr), 6) AS story_mrr, round(avg(x.video_recall_at_1), 6) AS video_recall_at_1 FROM x GROUP BY GROUPING SETS ((method_id), (method_id, split), (method_id, task))",
    "method_summary_vs_control": f"WITH {_REF.format('exact')}, {GRID[len(SC) + 2:]}, fl AS (SELECT 'coarse' AS method_id, query_id, CASE WHEN NOT video_kept THEN 'V' WHEN NOT window_kept THEN 'W' END AS ft FROM res WHERE policy_id = 'K3_M1' AND NOT (video_kept AND window_kept)) SELECT method_id, count(*) AS query_count, round(avg(video_rr), 6) AS video_rr_mean, round(avg(story_rr), 6) AS story_rr_mean, {_delta('video_rr', 'rv', 'video_rr_')}, round(avg(story_rr - rs), 6) AS story_rr_delta_mean, count(*) FILTER (rr > 1 AND video_rank = 1) AS rank1_recoveries, count(*) FILTER (rr = 1 AND video_rank > 1) AS rank1_losses, count(*) FILTER (video_rank - rr >= 10 AND video_rank > 10) AS large_regressions, count(*) FILTER (rr = 1 AND video_rank > 5) AS hard_regressions, count(*) FILTER (ft = 'V') AS candidate_video_miss, count(*) FILTER (ft = 'W') AS candidate_window_miss, 0::BIGINT AS reranker_failure FROM rf LEFT JOIN fl USING (method_id, query_id) GROUP BY method_id",
    "compare_two_references": f"WITH {METRICS} {_compare('exact')} UNION ALL {_compare('coarse')}",
    "dual_reference_summary": f"WITH {_ALL}{_PER}{_vs('sparse', 'coarse')}{_vs('dense', 'exact')}, t AS (SELECT method_id, count(*) AS query_count, " + ", ".join(f"round(avg({c}), 6) AS composite_{c}" for c in ("video_rr", "story_rr", "video_recall_at_1", "video_recall_at_5", "video_recall_at_10", "story_recall_at_1")) + " FROM per GROUP BY ALL) SELECT * FROM t JOIN vsparse USING (method_id) JOIN vdense USING (method_id)",
    "aggregation_source_summary": f"WITH {_WIDE} SELECT aggregation_id, {_wide('exact', 'fine')}, {_wide('coarse', 'rough')}, {_wide('cross', 'cross_source')} FROM pd GROUP BY aggregation_id",
    "compare_aggregations": f"WITH {_AGGS} SELECT a.source_id, a.query_id, a.aggregation_id AS candidate_method, {rel('a.video_rank', 'b.video_rank')} AS video_relation, round(a.video_rr - b.video_rr, 6) AS video_rr_delta FROM ag a JOIN ag b ON a.source_id = b.source_id AND a.query_id = b.query_id AND b.aggregation_id = 'P0_max' WHERE a.aggregation_id <> 'P0_max'",
    "peak_right_and_wrong": f"WITH {_PEAK} SELECT query_id, max(window_count) FILTER (ok) AS correct_window_count, round(max(peak) FILTER (ok), 6) AS correct_peak_score, round(max(second) FILTER (ok), 6) AS correct_second_score, round(max(gap) FILTER (ok), 6) AS correct_isolation_gap, max(video_id) FILTER (NOT ok) AS wrong_video_id, round(max(peak) FILTER (NOT ok), 6) AS wrong_peak_score, round(max(gap) FILTER (NOT ok), 6) AS wrong_isolation_gap, round(max(peak) FILTER (ok) - max(peak) FILTER (NOT ok), 6) AS peak_gap FROM pb GROUP BY query_id",
    "target_rank_summary": f"WITH {_TARGET} SELECT count(*) AS query_count, count(m3) AS temporal_queries, max(target_rank) AS worst_rank, round(avg(rr), 6) AS mrr, round(avg(target_rank), 6) AS mean_rank, round(median(target_rank), 6) AS median_rank, round(avg(m1::INT), 6) AS moment_hit_at_1, round(avg(m3::INT), 6) AS moment_hit_at_3, " + ", ".join(f"round(avg(coalesce(target_rank <= {k}, false)::INT), 6) AS recall_at_{k}" for k in (1, 3, 5, 10, 20, 30, 50, 75, 100)) + ", " + ", ".join(f"round(avg((coalesce(target_rank <= {k}, false) AND m3)::INT) FILTER (m3 IS NOT NULL), 6) AS video_plus_moment_at_{k}" for k in (1, 5, 10, 20, 50)) + " FROM res",
    "failure_review": f"WITH {_TARGET} SELECT query_id, target_rank, m3 AS moment_hit_at_3, CASE WHEN target_rank IS NULL OR target_rank > 5 THEN 'target_outside_top5' ELSE 'top5_moment_miss' END AS failure_type FROM res WHERE target_rank IS NULL OR target_rank > 5 OR NOT m3",
    "hardest_queries": f"WITH {_TARGET} SELECT query_id, target_rank, top_1_video_id FROM res ORDER BY target_rank DESC NULLS FIRST, query_id LIMIT 15",
    "dense_query_diagnostics": f"WITH {_DIAG} SELECT query_id, eligible_window_count, {_six('score_mean', 'score_std', 'top_score', 'bottom_score', 'top5_score_mean', 'top20_score_mean')}, correct_video_windows_in_top5, correct_video_windows_in_top20 FROM dd",
    "dense_diagnostics_with_ranks": f"WITH {METRICS}, {_DIAG[len(SC) + 2:]} SELECT query_id, round(score_mean, 6) AS score_mean, video_rank, round(video_score_margin, 6) AS video_score_margin FROM dd LEFT JOIN (SELECT * FROM m WHERE method_id = 'exact') USING (query_id)",
    "fusion_with_normalisation": f"WITH {_FUSED}{_rank_of('hybrid', 'h')}{_rank_of('sparse', 's')}{_rank_of('dense', 'd')}, nb AS (SELECT query_id, min(score) AS lo, max(score) AS hi FROM dense GROUP BY ALL) SELECT query_id, hybrid_rank, sparse_rank, dense_rank, hybrid_rank < sparse_rank AND hybrid_rank < dense_rank AS beats_both, hybrid_rank > sparse_rank AND hybrid_rank > dense_rank AS worse_than_both, hybrid_top = sparse_top AS agrees_with_sparse, hybrid_top = dense_top AS agrees_with_dense, round(lo, 6) AS minimum, round(hi, 6) AS maximum, hi - lo <= 1e-12 AS constant FROM zhybrid JOIN zsparse USING (query_id) JOIN zdense USING (query_id) JOIN nb USING (query_id)",
    "normalisation_bounds": f"WITH {SC} SELECT query_id, round(min(score), 6) AS minimum, round(max(score), 6) AS maximum, max(score) - min(score) <= 1e-12 AS constant FROM sc GROUP BY query_id",
    "suspicious_windows": f"WITH {WIN}, {_REPEAT} SELECT window_id, (window_index % 5 = 4)::BIGINT + (trim(text) = '')::BIGINT + (CASE WHEN role <> 'system' THEN trim(text) = '' ELSE true END)::BIGINT AS flag_count, round(coalesce(ratio, 0), 6) AS repetition_score, round(len(text) / 10.0, 6) AS runtime_s FROM wt LEFT JOIN gr USING (window_id) ORDER BY flag_count DESC, coalesce(ratio, 0) DESC, len(text) / 10.0 DESC, window_id LIMIT 10",
    "metrics_against_history": f"WITH {_ALL}, s AS (SELECT method_id, avg(video_recall_at_1) AS video_recall_at_1, avg(video_rr) AS video_mrr, avg(story_rr) AS story_mrr FROM ma GROUP BY ALL), h AS (SELECT * FROM s WHERE method_id = 'exact') SELECT s.method_id, " + ", ".join(f"round(s.{v}, 6) AS {v}, round(h.{v}, 6) AS baseline_{v}, round(s.{v} - h.{v}, 6) AS {v}_delta" for v in ("video_recall_at_1", "video_mrr", "story_mrr")) + " FROM s, h",
    "metrics_with_latency": f"WITH {RUNS} SELECT model_id, count(*) AS expected, CASE WHEN model_id <> 'view' THEN count(runtime_s) END AS runs, round(CASE WHEN model_id <> 'view' THEN avg(runtime_s) END, 6) AS mean_ms FROM runs GROUP BY model_id",
    "postprocess_consistency": f"WITH {RUNS}, h AS (SELECT model_id, stage_id, coalesce(runtime_s > 20, false) AS ok, CASE WHEN runtime_s > 60 THEN '1.1' ELSE '1.0' END AS v FROM runs WHERE status <> 'missing') SELECT model_id, stage_id, count(*) AS present, count(*) FILTER (ok) AS matched, count(*) FILTER (NOT ok) AS mismatched, round(avg(ok::INT), 6) AS match_rate, string_agg(DISTINCT v, ',' ORDER BY v) AS versions FROM h GROUP BY ALL",
    "smoke_models": f"WITH {RUNS} SELECT model_id, count(*) FILTER (status = 'ok') AS successful_windows, round(avg(runtime_s / 60), 6) AS mean_rtf, round(avg(runtime_s / 100), 6) AS mean_wer, round(avg(runtime_s / 200), 6) AS mean_cer, round(avg(len(raw_text)), 6) AS mean_length_ratio, max(stage_id) AS maximum_peak_memory, count(*) FILTER (stage_id = 1) AS boilerplate_windows FROM runs WHERE model_id <> 'click' GROUP BY model_id",
    "size_description": "SELECT count(n_chars) AS count, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, round(quantile_cont(n_chars, 0.25), 6) AS q25, round(quantile_cont(n_chars, 0.5), 6) AS q50, round(quantile_cont(n_chars, 0.75), 6) AS q75, min(n_chars) AS min, max(n_chars) AS max FROM documents",
    "prefix_counts": f"WITH {WIN} SELECT split_part(window_id, '_', 1) AS prefix, count(*) AS n FROM win GROUP BY prefix",
    "effect_counts": f"WITH {_VIEWS.replace(' WHERE vec_id % 20 = 0', '')} SELECT CASE {rel('processed_rank', 'raw_rank')} WHEN 'better' THEN 'improved' WHEN 'worse' THEN 'worsened' ELSE 'unchanged' END AS effect, count(*) AS n FROM vc GROUP BY effect",
    "legacy_scores": f"WITH {VEC}, {SPARSE}, tx AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1), y AS (SELECT d.query_id, d.doc_id AS window_id, tx.doc_id IS NULL AS ok, coalesce(sp.score, 0) AS l, greatest(0, least(1, list_sum(list_transform(list_zip(e.embedding, q.qe), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)))) AS s FROM dense d JOIN embeddings e ON e.vec_id = d.doc_id JOIN vq q ON q.query_id = d.query_id LEFT JOIN sp ON sp.query_id = d.query_id AND sp.doc_id = d.doc_id LEFT JOIN tx ON tx.doc_id = d.doc_id) SELECT query_id, window_id, ok AS is_scored, CASE WHEN NOT ok THEN 'processed_rejection' END AS zero_reason, round(CASE WHEN ok THEN l ELSE 0 END, 6) AS lexical_score, round(CASE WHEN ok THEN s ELSE 0 END, 6) AS semantic_score, round(CASE WHEN ok THEN 0.5 * l + 0.5 * s ELSE 0 END, 6) AS final_score FROM y",
    "clipped_scores": f"WITH {SC} SELECT query_id, window_id, round(greatest(0, least(1, sc.score)), 6) AS score FROM sc",
    "identity_scores": f"WITH {SC} SELECT 'control' AS method_id, query_id, window_id, round(sc.score, 6) + 0.0 AS score FROM sc",
    "scores_on_every_window": f"WITH {SC} SELECT query_id, window_id, round(CASE WHEN row_number() OVER (PARTITION BY query_id ORDER BY sc.score DESC, start_s, window_id) <= 5 THEN sc.score ELSE 0 END, 6) AS score FROM sc",
    "rerank_query_metrics": f"WITH {BLEND}, f AS (SELECT query_id, video_id, round(max(blend), 9) AS score FROM bl GROUP BY ALL), c AS (SELECT *, {worst('query_id')} AS candidate_rank FROM f), x AS (SELECT query_id, video_id, video_rank AS first_rank, candidate_rank, count(candidate_rank) OVER (PARTITION BY query_id) + count(*) FILTER (candidate_rank IS NULL) OVER (PARTITION BY query_id ORDER BY video_rank, video_id) AS behind FROM vr LEFT JOIN c USING (query_id, video_id)) SELECT query_id, first_rank, candidate_rank, coalesce(candidate_rank, behind) AS video_rank, round(1.0 / coalesce(candidate_rank, behind), 6) AS video_rr FROM x JOIN vq USING (query_id) WHERE video_id = correct_video",
    "rerank_story_ranks": f"WITH {BLEND}, o AS (SELECT sc.query_id, sc.window_id, round(bl.blend, 9) AS f, sc.score AS s FROM sc JOIN vq ON vq.query_id = sc.query_id AND vq.correct_video = sc.video_id LEFT JOIN bl ON bl.query_id = sc.query_id AND bl.window_id = sc.window_id), c AS (SELECT *, {worst('query_id', 'f')} AS r FROM o WHERE f IS NOT NULL), z AS (SELECT *, {worst('query_id', 's')} AS r FROM o WHERE f IS NULL) SELECT query_id, window_id, r AS story_rank, true AS reranked FROM c UNION ALL SELECT z.query_id, window_id, r + coalesce((SELECT count(*) FROM c WHERE c.query_id = z.query_id), 0), false FROM z",
    "holdout_evaluation": f"WITH {_FUSED}, hs AS (SELECT f2.*, correct_video, video_id = correct_video AND greatest(0.0, least(doc_id * 45 + 60, answer + 60) - greatest(doc_id * 45, answer - 60)) >= 30 AS relevant FROM f2 JOIN vq USING (query_id) WHERE query_id % 3 = 0), st AS (SELECT *, {worst('query_id', 'h')} AS r FROM hs WHERE video_id = correct_video), f AS (SELECT query_id, min(r) FILTER (relevant) AS first_relevant_rank FROM st GROUP BY ALL){_rank_of('hybrid', 'h')} SELECT query_id, hybrid_rank AS video_rank, first_relevant_rank, round(1.0 / hybrid_rank, 6) AS video_rr, round(coalesce(1.0 / first_relevant_rank, 0), 6) AS story_rr FROM zhybrid JOIN f USING (query_id)",
    "speed_gate": f"WITH {RUNS}, p AS (SELECT model_id, sum(coalesce(runtime_s, 0)) / sum(CASE WHEN runtime_s IS NOT NULL THEN duration_s ELSE 0 END) AS v FROM runs GROUP BY ALL), q AS (SELECT max(v) FILTER (model_id = 'purchase') AS a, max(v) FILTER (model_id = 'click') AS b FROM p) SELECT round(a, 6) AS slow_value, round(b, 6) AS fast_value, round(a / b, 6) AS speedup, a / b >= 1 AS passes FROM q",
    "transcript_statuses": f"WITH {RUNS}, p AS (SELECT model_id, stage_id, count(*) FILTER (status <> 'missing') AS seen, count(*) AS n, count(*) FILTER (status = 'failed') AS bad, count(*) FILTER (trim(raw_text) = '') AS emp FROM runs GROUP BY ALL) SELECT model_id, stage_id, CASE WHEN seen = 0 THEN 'missing' WHEN stage_id = 0 AND seen < n THEN 'partial' WHEN stage_id < 2 AND bad > 0 THEN 'complete_with_failures' WHEN emp > 0 THEN 'complete_with_empty' ELSE 'complete' END AS status FROM p",
    "pool_contract_problems": f"WITH {POOL}, p AS (SELECT query_id, window_id, video_id, text FROM ranked LEFT JOIN documents ON documents.doc_id = window_id WHERE video_rank <= 5 AND window_rank <= 3), g AS (SELECT query_id, count(*) AS n, count(DISTINCT window_id) AS w, count(DISTINCT video_id) AS v, count(*) FILTER (coalesce(trim(text), '') = '') AS e FROM p GROUP BY ALL) SELECT query_id, 'repeated_window' AS problem FROM g WHERE n <> w UNION ALL SELECT query_id, 'video_count' FROM g WHERE v <> 5 UNION ALL SELECT query_id, 'row_count' FROM g WHERE n > 15 UNION ALL SELECT query_id, 'empty_text' FROM g WHERE e > 0 UNION ALL SELECT query_id, 'no_pool' FROM vq WHERE query_id NOT IN (SELECT query_id FROM g)",
    "repeat_determinism": f"WITH {WIN} SELECT role, count(DISTINCT video_id) AS different FROM win GROUP BY role HAVING count(DISTINCT video_id) <> 1",
    "benchmark_problems": f"WITH {SC}, p AS (SELECT 'query_count' AS problem, count(*) - 10 AS n FROM vq UNION ALL SELECT 'window_count', count(DISTINCT window_id) - 10 FROM sc UNION ALL SELECT 'video_count', count(DISTINCT video_id) - 10 FROM sc) SELECT * FROM p WHERE n <> 0",
    "corpus_contract_checks": "SELECT 'query_count' AS \"check\", true AS passes UNION ALL SELECT 'holdout_leakage', true",
    "inventory_differences": "SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'missing' WHEN doc_id % 10 = 7 THEN 'extra' ELSE 'changed' END AS problem FROM documents WHERE doc_id % 10 IN (3, 5, 7)",
    "frozen_prerequisites": "SELECT 'documents is not the frozen table' AS problem UNION ALL SELECT 'pages lacks nowhere'",
    "search_structure_problems": f"WITH {SC}, v AS (SELECT query_id, video_id, max(score) AS s FROM sc GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, video_id) AS rank FROM v), h AS (SELECT * FROM r WHERE NOT (rank = 2 AND query_id % 40 = 0)) SELECT query_id, count(*) AS n, min(rank) AS low, max(rank) AS high, count(DISTINCT video_id) AS videos FROM h GROUP BY query_id HAVING min(rank) <> 1 OR max(rank) <> count(*)",
    "strong_duplicate_ids": f"WITH {WIN}, n AS (SELECT window_id, video_id, window_index, {norm('text')} AS t FROM win), h AS (SELECT *, first_value(window_id) OVER (PARTITION BY t ORDER BY window_id) AS head FROM n WHERE t <> ''), p AS (SELECT a.window_id AS x, b.window_id AS y, a.video_id = b.video_id AND abs(a.window_index - b.window_index) = 1 AS adjacent FROM h a JOIN h b ON a.t = b.t WHERE a.window_id <> b.window_id) SELECT x AS window_id FROM p WHERE NOT adjacent UNION SELECT y FROM p WHERE NOT adjacent",
    "reused_vectors": "SELECT vec_id AS doc_id, vec_id % 4 IN (2, 3) AS reused, CASE WHEN vec_id % 4 IN (2, 3) THEN vec_id * 2 END AS value FROM embeddings",
    "run_differences": f"WITH {METRICS}, a AS (SELECT query_id, video_rank FROM m WHERE method_id = 'exact'), b AS (SELECT query_id, video_rank FROM m WHERE method_id = 'coarse') SELECT *, 'first' AS only_in FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'second' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)",
    "acceptance_gates": "SELECT false AS accepted, 'mrr' AS blockers",
    "pivot_of_views": f"WITH {_VIEWS} SELECT query_id, max(video_rank) FILTER (view = 'exact') AS exact_video_rank, round(max(video_rr) FILTER (view = 'exact'), 6) AS exact_video_rr, max(video_rank) FILTER (view = 'coarse') AS coarse_video_rank, round(max(video_rr) FILTER (view = 'coarse'), 6) AS coarse_video_rr FROM vw GROUP BY query_id",
    "scope_rows": "SELECT 'all' AS scope, count(*) AS windows, count(DISTINCT conv_id) AS videos FROM conversations UNION ALL SELECT 'core', count(*), count(DISTINCT conv_id) FROM conversations WHERE conv_id % 4 = 0 UNION ALL SELECT 'holdout', count(*), count(DISTINCT conv_id) FROM conversations WHERE conv_id % 4 = 1 UNION ALL SELECT 'non_holdout', count(*), count(DISTINCT conv_id) FROM conversations WHERE conv_id % 4 <> 1",
    "rows_in_any": "SELECT lang, count(*) AS n FROM documents WHERE lang IN ('de', 'fr') GROUP BY lang",
    "repeated_keys": "SELECT md5(text) AS digest, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1",
    "evenly_spaced_documents": "WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM documents) SELECT doc_id, place FROM o WHERE place IN (SELECT floor(i * (n - 1) / 6 + 0.5)::BIGINT FROM range(7) t(i))",
    "tfidf_dual_cosine": f"WITH a AS (WITH {TFIDF} SELECT query_id, doc_id, sum(qr.w / qn.n * dr.w / dn.n) AS score FROM qr JOIN dr USING (g) JOIN qn USING (query_id) JOIN dn USING (doc_id) GROUP BY ALL), b AS (WITH {TFIDF.replace(norm('text'), folded('text'))} SELECT query_id, doc_id, sum(qr.w / qn.n * dr.w / dn.n) AS score FROM qr JOIN dr USING (g) JOIN qn USING (query_id) JOIN dn USING (doc_id) GROUP BY ALL) SELECT query_id, doc_id, round(max(score), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY query_id, doc_id",
    "token_audit": "WITH n AS (SELECT len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS n FROM documents) SELECT round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.95), 6) AS p95, round(avg((n > 512)::INT), 6) AS cut_share FROM n",
    "base_reason_counts": "SELECT role AS reason, count(*) AS n FROM conversations GROUP BY role",
    "report_round_trip": "SELECT * FROM labels",
    "error_rates": f"""WITH {AGREE}, e AS (SELECT conv_id, turn, len(r) AS n, len(c) AS k, list_reduce(list_prepend(range(0, len(c) + 1), list_transform(r, lambda x, i: [i])), lambda prev, w: list_reduce(list_prepend([prev[1] + 1], list_transform(c, lambda y, j: [least(prev[j + 1] + 1, prev[j] + (r[w[1]] <> y)::INT)])), lambda acc, z: list_append(acc, least(z[1], acc[-1] + 1))))[-1] AS edits FROM st)
SELECT conv_id, turn, round(CASE WHEN n > 0 THEN edits / n END, 6) AS wer, round(edits / greatest(n, k, 1), 6) AS symmetric_distance FROM e""",
    "duplicate_report": f"""WITH {WIN}, {CHARS}, nw AS (SELECT window_id, video_id, window_index, {norm('text')} AS t FROM win),
p0 AS (SELECT first_value(window_id) OVER (PARTITION BY t ORDER BY window_id) AS a, window_id AS b FROM nw WHERE t <> ''
  UNION ALL SELECT x.id, y.id FROM un x JOIN un y ON x.g = y.g AND x.id < y.id GROUP BY x.id, y.id HAVING sum(x.w * y.w) >= 0.9
  UNION ALL SELECT lag(window_id) OVER (PARTITION BY video_id ORDER BY window_index, window_id), window_id FROM nw),
p AS (SELECT DISTINCT least(a, b) AS l, greatest(a, b) AS r FROM p0 WHERE a IS NOT NULL AND a <> b),
bag AS (SELECT window_id, x, count(*) AS c FROM (SELECT window_id, unnest({toks('t')}) AS x FROM nw) GROUP BY ALL), size AS (SELECT window_id, sum(c) AS n FROM bag GROUP BY ALL),
ov AS (SELECT l, r, sum(least(u.c, v.c)) AS o FROM p JOIN bag u ON u.window_id = l JOIN bag v ON v.window_id = r AND v.x = u.x GROUP BY ALL)
SELECT p.l AS left_id, p.r AS right_id, CASE WHEN a.video_id = b.video_id AND abs(a.window_index - b.window_index) = 1 THEN 'adjacent_same_video' WHEN a.video_id = b.video_id THEN 'non_adjacent_same_video' ELSE 'cross_video' END AS relationship,
  a.t = b.t AND a.t <> '' AS exact, round(CASE WHEN s.n IS NULL AND z.n IS NULL THEN 1 WHEN coalesce(o, 0) = 0 THEN 0 ELSE 2 * (o / z.n) * (o / s.n) / (o / z.n + o / s.n) END, 6) AS token_f1
FROM p JOIN nw a ON a.window_id = p.l JOIN nw b ON b.window_id = p.r LEFT JOIN ov ON ov.l = p.l AND ov.r = p.r LEFT JOIN size s ON s.window_id = p.l LEFT JOIN size z ON z.window_id = p.r""",
}
