"""DuckDB SQL for the registered queries of tessera.plans, over the same tables."""

from __future__ import annotations

from tessera.functions.text import NAMED


def norm(x: str) -> str:
    """Normalisation for matching."""
    return rf"trim(regexp_replace(regexp_replace(lower(nfc_normalize({x})), '[^0-9a-zA-ZÀ-ỹđĐ\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def folded(x: str) -> str:
    return f"strip_accents(translate({norm(x)}, 'đĐ', 'dD'))"


def agree(x: str) -> str:
    return rf"trim(regexp_replace(translate(regexp_replace(lower(nfc_normalize({x})), '[^\p{{L}}\p{{N}}\p{{M}}_\s]', ' ', 'g'), '_', ' '), '\s+', ' ', 'g'))"


def toks(n: str) -> str:
    return f"list_filter(string_split({n}, ' '), lambda x: x <> '')"


def worst(by: str, score: str = "score") -> str:
    return f"count(*) OVER (PARTITION BY {by} ORDER BY -{score} RANGE BETWEEN UNBOUNDED PRECEDING AND 1e-12 FOLLOWING)"


def bm25(fold: bool) -> str:
    f = folded if fold else norm
    return f"""
docs AS (SELECT doc_id, source AS video_id, {toks(f("text"))} AS terms FROM documents),
ok AS (SELECT * FROM docs WHERE len(terms) > 0),
stats AS (SELECT count(*) AS n, avg(len(terms)) AS m FROM ok),
post AS (SELECT doc_id, term, count(*) AS tf, any_value(len) AS length FROM (SELECT doc_id, len(terms) AS len, unnest(terms) AS term FROM ok) GROUP BY doc_id, term),
q AS (SELECT item_id AS query_id, {toks(f("text"))} AS terms FROM benchmark),
qt AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(terms) AS term FROM q)),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (
  SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / m))) AS score
  FROM post JOIN df USING (term) JOIN qt USING (term), stats GROUP BY query_id, doc_id
)"""


WIN = """win AS (SELECT printf('%d_%04d', conv_id, turn) AS window_id, conv_id AS video_id, turn AS window_index, turn * 45.0::DOUBLE AS start_s, turn * 45.0::DOUBLE + 60 AS end_s, role, text FROM conversations)"""
VEC = """vq AS (SELECT vec_id AS query_id, embedding AS qe, label AS correct_video, vec_id * 45.0::DOUBLE + 30 AS answer FROM embeddings WHERE vec_id % 20 = 0),
dense AS (SELECT query_id, vec_id AS doc_id, label AS video_id, round(list_sum(list_transform(list_zip(embedding, qe), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 9) AS score FROM embeddings, vq)"""
SC = VEC + """,
sc AS (SELECT query_id, doc_id AS window_id, video_id, doc_id * 45.0::DOUBLE AS start_s, doc_id * 45.0::DOUBLE + 60 AS end_s, score FROM dense)"""
SPARSE = """sp AS (SELECT query_id, vec_id AS doc_id, (vec_id % 7 + 1) / 7.0 AS score FROM embeddings JOIN vq ON vec_id % 10 = (query_id // 20) % 10)"""
JUDGED = SC + """,
judged1 AS (SELECT sc.*, correct_video, greatest(0.0, least(end_s, answer + 60) - greatest(start_s, answer - 60)) AS overlap_s FROM sc JOIN vq USING (query_id)),
judged0 AS (SELECT *, video_id = correct_video AND overlap_s >= 30 AS relevant FROM judged1),
judged AS (SELECT *, 'exact' AS method_id FROM judged0 UNION ALL SELECT * REPLACE (round(score, 1) AS score), 'coarse' AS method_id FROM judged0)"""
METRICS = JUDGED + f""",
story AS (SELECT *, {worst("method_id, query_id")} AS story_rank, row_number() OVER (PARTITION BY method_id, query_id ORDER BY score DESC, start_s, window_id) AS place FROM judged WHERE video_id = correct_video),
one AS (SELECT method_id, query_id, min(story_rank) FILTER (relevant) AS first_relevant_rank, max(score) FILTER (relevant) AS best_relevant_score, max(score) FILTER (NOT relevant) AS best_irrelevant_score, best_relevant_score - best_irrelevant_score AS story_score_margin, max(window_id) FILTER (place = 1) AS top_story_window_id,
        max(start_s) FILTER (place = 1) AS top_story_start_s, max(end_s) FILTER (place = 1) AS top_story_end_s, max(score) FILTER (place = 1) AS top_story_score, count(*) FILTER (score > 0) AS correct_video_positive_windows FROM story GROUP BY method_id, query_id),
vid0 AS (SELECT method_id, query_id, video_id, correct_video, max(score) AS score, max((score > 0)::INT) AS positive, count(*) AS windows, count(*) FILTER (score > 0) AS positive_windows FROM judged GROUP BY ALL),
vid AS (SELECT *, {worst("method_id, query_id")} AS video_rank0, row_number() OVER (PARTITION BY method_id, query_id ORDER BY score DESC, video_id) AS place FROM vid0),
two AS (SELECT method_id, query_id, max(video_rank0) FILTER (video_id = correct_video) AS video_rank, max(score) FILTER (video_id = correct_video) AS correct_video_score, max(score) FILTER (video_id <> correct_video) AS best_wrong_video_score, correct_video_score - best_wrong_video_score AS video_score_margin, max(score) AS top_video_score,
        sum(windows)::BIGINT AS physical_window_count, sum(positive_windows)::BIGINT AS positive_window_count, sum(positive_windows) / sum(windows) AS positive_window_fraction, max(video_id) FILTER (place = 1) AS top_video_id, sum(positive)::BIGINT AS positive_video_count, max(positive) = 0 AS zero_evidence FROM vid GROUP BY method_id, query_id),
m AS (SELECT *, coalesce(1.0 / first_relevant_rank, 0) AS story_rr, coalesce(1.0 / video_rank, 0) AS video_rr, (coalesce(video_rank <= 3, false))::INT::DOUBLE AS video_recall_at_3, (coalesce(first_relevant_rank <= 3, false))::INT::DOUBLE AS story_recall_at_3
      FROM two LEFT JOIN one USING (method_id, query_id)),
c AS (SELECT a.query_id, a.method_id AS candidate_method, a.first_relevant_rank AS s1, b.first_relevant_rank AS s0, a.video_rank AS v1, b.video_rank AS v0, a.story_rr - b.story_rr AS story_rr_delta, a.video_rr - b.video_rr AS video_rr_delta,
        a.top_story_window_id IS DISTINCT FROM b.top_story_window_id AS top_story_changed, a.top_video_id IS DISTINCT FROM b.top_video_id AS top_video_changed
      FROM m a JOIN m b USING (query_id) WHERE a.method_id <> 'exact' AND b.method_id = 'exact')"""


def rel(a: str, b: str) -> str:
    return f"CASE WHEN coalesce({a}, 'inf'::DOUBLE) < coalesce({b}, 'inf'::DOUBLE) THEN 'better' WHEN coalesce({a}, 'inf'::DOUBLE) > coalesce({b}, 'inf'::DOUBLE) THEN 'worse' ELSE 'tie' END"


POOL = SC + """,
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY video_score DESC, video_id) AS video_rank FROM (SELECT query_id, video_id, max(score) AS video_score FROM sc GROUP BY ALL)),
wr AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY score DESC, start_s, window_id) AS window_rank FROM sc),
ranked AS (SELECT wr.*, video_rank, video_score FROM wr JOIN vr USING (query_id, video_id))"""
GRID = POOL + """,
pol(policy_id, video_k, windows_m) AS (VALUES ('K3_M1', 3, 1), ('K3_M3', 3, 3), ('K5_M1', 5, 1), ('K5_M3', 5, 3), ('K5_M5', 5, 5)),
jr AS (SELECT ranked.*, correct_video, video_id = correct_video AND greatest(0.0, least(end_s, answer + 60) - greatest(start_s, answer - 60)) >= 30 AS relevant FROM ranked JOIN vq USING (query_id)),
of AS (SELECT policy_id, query_id, count(*) AS pair_count, bool_or(video_id = correct_video) AS v, bool_or(relevant) AS r FROM jr, pol WHERE video_rank <= video_k AND window_rank <= windows_m GROUP BY ALL),
res AS (SELECT p.policy_id, p.video_k, p.windows_m, vq.query_id, coalesce(pair_count, 0) AS pair_count, coalesce(v, false) AS video_kept, coalesce(r, false) AS window_kept FROM pol p CROSS JOIN vq LEFT JOIN of ON of.policy_id = p.policy_id AND of.query_id = vq.query_id),
psum AS (SELECT policy_id, video_k, windows_m, count(*) AS query_count, avg(pair_count) AS pairs_mean, max(pair_count) AS pairs_max, avg(video_kept::INT) AS video_recall, avg(window_kept::INT) AS temporal_recall,
         avg((video_kept AND window_kept)::INT) AS joint_recall, coalesce(avg(window_kept::INT) FILTER (video_kept), 0) AS conditional_temporal_recall, count(*) FILTER (NOT video_kept) AS video_misses, count(*) FILTER (NOT (video_kept AND window_kept)) AS joint_misses FROM res GROUP BY ALL)"""
BLEND = POOL + """,
re AS (SELECT *, ((window_id * 31 + query_id * 17) % 101) / 10.0 AS rr FROM ranked WHERE video_rank <= 5 AND window_rank <= 3),
nb AS (SELECT *, CASE WHEN max(score) OVER q - min(score) OVER q > 1e-12 THEN (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q) ELSE 0 END AS a,
         CASE WHEN max(rr) OVER q - min(rr) OVER q > 1e-12 THEN (rr - min(rr) OVER q) / (max(rr) OVER q - min(rr) OVER q) ELSE 0 END AS b FROM re WINDOW q AS (PARTITION BY query_id)),
bl AS (SELECT *, 0.5 * a + 0.5 * b AS blend FROM nb)"""
RUNS = """runs AS (SELECT event_type AS model_id, user_id % 4 AS stage_id, CASE WHEN event_id % 50 = 0 THEN 'failed' WHEN event_id % 77 = 0 THEN 'missing' ELSE 'ok' END AS status,
  CASE WHEN event_id % 50 = 0 OR event_id % 77 <> 0 THEN value END AS runtime_s, 60.0::DOUBLE AS duration_s, coalesce(props, '') AS raw_text FROM events)"""
OPS = RUNS + """,
ops AS (SELECT model_id, stage_id, count(*) AS expected, count(*) FILTER (status <> 'missing') AS present, count(*) FILTER (status = 'ok') AS successful, count(*) FILTER (status = 'failed') AS failed,
  count(*) FILTER (status = 'ok' AND trim(raw_text) = '') AS empty, sum(coalesce(runtime_s, 0)) AS total, sum(CASE WHEN runtime_s IS NOT NULL THEN duration_s ELSE 0 END) AS audio, avg(runtime_s / duration_s) AS mean_rtf,
  quantile_cont(runtime_s / duration_s, 0.5) AS median_rtf, quantile_cont(runtime_s / duration_s, 0.9) AS p90_rtf, quantile_cont(runtime_s / duration_s, 0.95) AS p95_rtf, count(runtime_s) AS tried FROM runs GROUP BY ALL)"""
AGREE = f"""sides AS (SELECT u.conv_id, u.turn, {agree("u.text")} AS r_text, {agree("v.text")} AS c_text FROM conversations u JOIN conversations v ON u.conv_id = v.conv_id AND v.turn = u.turn + 1 WHERE u.role = 'user' AND v.role = 'assistant'),
st AS (SELECT *, {toks("r_text")} AS r, {toks("c_text")} AS c FROM sides),
rc AS (SELECT conv_id, turn, term, count(*) AS n FROM (SELECT conv_id, turn, unnest(r) AS term FROM st) GROUP BY ALL),
cc AS (SELECT conv_id, turn, term, count(*) AS n FROM (SELECT conv_id, turn, unnest(c) AS term FROM st) GROUP BY ALL),
ov AS (SELECT conv_id, turn, sum(least(rc.n, cc.n)) AS common FROM rc JOIN cc USING (conv_id, turn, term) GROUP BY ALL),
ag AS (SELECT conv_id, turn, len(r) AS rn, len(c) AS cn, coalesce(common, 0) AS o FROM st LEFT JOIN ov USING (conv_id, turn)),
agr AS (SELECT *, CASE WHEN rn = 0 AND cn = 0 THEN 1 WHEN rn = 0 OR cn = 0 THEN 0 ELSE o / cn END AS p, CASE WHEN rn = 0 AND cn = 0 THEN 1 WHEN rn = 0 OR cn = 0 THEN 0 ELSE o / rn END AS rcl FROM ag),
agf AS (SELECT *, CASE WHEN p + rcl > 0 THEN 2 * p * rcl / (p + rcl) ELSE 0 END AS f1 FROM agr)"""
GRAMS = f"""wt AS (SELECT window_id, video_id, {toks(norm("text"))} AS w FROM win),"""
CHARS = f"""base AS (SELECT window_id, {norm("text")} AS n FROM win WHERE {norm("text")} <> ''),
cls AS (SELECT n, min(window_id) AS id, count(*) AS members FROM base GROUP BY n),
wd AS (SELECT id, members, ' ' || unnest({toks("n")}) || ' ' AS w FROM cls),
gr AS (SELECT id, members, unnest(flatten([[w[i : i + k - 1] FOR i IN range(1, greatest(len(w) - k + 1, 1) + 1)] FOR k IN range(3, greatest(least(5, len(w)), 3) + 1)])) AS g FROM wd),
tf AS (SELECT id, members, g, count(*) AS tf FROM gr GROUP BY ALL),
idf AS (SELECT g, ln((1 + (SELECT count(*) FROM base)) / (1 + sum(members))) + 1 AS idf FROM tf GROUP BY g),
rw AS (SELECT id, g, tf * idf AS w FROM tf JOIN idf USING (g)), nm AS (SELECT id, sqrt(sum(w * w)) AS nm FROM rw GROUP BY id),
un AS (SELECT id, g, w / nm AS w FROM rw JOIN nm USING (id))"""
# a number that ends at a word boundary; the unit after it is optional
_NUMBER = r"(^|[^\p{L}\p{N}_])\d+([.,]\d+)?(\s*(kg|km|g|ml|giờ|phút|con|người))?($|[^\p{L}\p{N}_])"


def _six(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n.split('.')[-1]}" for n in names)


TFIDF = f"""d AS (SELECT doc_id, {toks(norm("text"))} AS t FROM documents), q AS (SELECT item_id AS query_id, {toks(norm("text"))} AS t FROM benchmark),
dw AS (SELECT doc_id, ' ' || unnest(t) || ' ' AS w FROM d), qw AS (SELECT query_id, ' ' || unnest(t) || ' ' AS w FROM q),
qg AS (SELECT query_id, unnest(flatten([[w[i : i + k - 1] FOR i IN range(1, greatest(len(w) - k + 1, 1) + 1)] FOR k IN range(3, greatest(least(5, len(w)), 3) + 1)])) AS g FROM qw),
idf AS (SELECT g, ln((1.0 + (SELECT count(*) FROM q)) / (1 + count(DISTINCT query_id))) + 1 AS idf FROM qg GROUP BY g),
dg AS (SELECT doc_id, g FROM (SELECT doc_id, unnest(flatten([[w[i : i + k - 1] FOR i IN range(1, greatest(len(w) - k + 1, 1) + 1)] FOR k IN range(3, greatest(least(5, len(w)), 3) + 1)])) AS g FROM dw) SEMI JOIN idf USING (g)),
qr AS (SELECT query_id, g, count(*) * any_value(idf) AS w FROM qg JOIN idf USING (g) GROUP BY ALL), dr AS (SELECT doc_id, g, count(*) * any_value(idf) AS w FROM dg JOIN idf USING (g) GROUP BY ALL),
qn AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM qr GROUP BY ALL), dn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM dr GROUP BY ALL)"""

SQL: dict[str, str] = {
    "search": f"WITH {bm25(False)}, v AS (SELECT query_id, video_id, max(round(score, 6)) AS score FROM raw JOIN docs USING (doc_id) GROUP BY ALL) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, video_id) AS rank, video_id, score FROM v QUALIFY rank <= 10",
    "bm25_scores": f"WITH {bm25(False)} SELECT query_id, doc_id, round(score, 6) AS score FROM raw",
    "bm25_topk": f"WITH {bm25(False)} SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(raw.score, 6) DESC, doc_id) AS rank FROM raw QUALIFY rank <= 20",
    "bm25_folded_topk": f"WITH {bm25(True)} SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(raw.score, 6) DESC, doc_id) AS rank FROM raw QUALIFY rank <= 20",
    "term_document_stats": f"WITH {bm25(False)} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY term",
    "idf_table": f"WITH {bm25(False)} SELECT term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, stats",
    "tfidf_query_fitted": f"WITH {TFIDF} SELECT query_id, doc_id, round(sum(qr.w / qn.n * dr.w / dn.n), 6) AS score FROM qr JOIN dr USING (g) JOIN qn USING (query_id) JOIN dn USING (doc_id) GROUP BY query_id, doc_id",
    "query_coverage": f"WITH {bm25(False)} SELECT query_id, round(avg((term IN (SELECT term FROM df))::INT), 6) AS coverage FROM qt GROUP BY query_id",
    "dense_topk_exact": f"WITH {VEC} SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY dense.score DESC, doc_id) AS rank FROM dense QUALIFY rank <= 20",
    "dense_l2_norm_check": "SELECT vec_id, abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) <= 1e-5 AS unit FROM embeddings",
    "minmax_fusion_25_75": f"WITH {VEC}, {SPARSE}, f AS (SELECT query_id, doc_id, dense.score AS d, coalesce(sp.score, 0) AS s FROM dense LEFT JOIN sp USING (query_id, doc_id)), g AS (SELECT query_id, doc_id, CASE WHEN max(s) OVER q - min(s) OVER q > 1e-12 THEN (s - min(s) OVER q) / (max(s) OVER q - min(s) OVER q) ELSE 0 END AS sparse_score, CASE WHEN max(d) OVER q - min(d) OVER q > 1e-12 THEN (d - min(d) OVER q) / (max(d) OVER q - min(d) OVER q) ELSE 0 END AS dense_score FROM f WINDOW q AS (PARTITION BY query_id)) SELECT query_id, doc_id, round(sparse_score, 6) AS sparse_score, round(dense_score, 6) AS dense_score, round(0.25 * g.sparse_score + 0.75 * g.dense_score, 6) AS score FROM g",
    "rrf_k60_positive": f"WITH {VEC}, {SPARSE}, a AS (SELECT query_id, doc_id, {worst('query_id')} AS r FROM (SELECT query_id, doc_id, round(score, 2) AS score FROM dense) WHERE score > 0 UNION ALL SELECT query_id, doc_id, {worst('query_id')} AS r FROM sp WHERE score > 0) SELECT query_id, doc_id, round(sum(1.0 / (60 + r)), 6) AS score FROM a GROUP BY ALL",
    "weighted_raw_sum": f"WITH {VEC}, {SPARSE} SELECT query_id, doc_id, round(0.75 * dense.score + 0.25 * coalesce(sp.score, 0), 6) AS score FROM dense LEFT JOIN sp USING (query_id, doc_id)",
    "video_max_rank": f"WITH {SC}, v AS (SELECT query_id, video_id, max(round(score, 2)) AS score FROM sc GROUP BY ALL) SELECT query_id, video_id, score, {worst('query_id')} AS metric_rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, video_id) AS display_rank FROM v",
    "video_max_zero_floor": f"WITH {SC}, ax AS (SELECT query_id, video_id FROM vq CROSS JOIN (SELECT DISTINCT label AS video_id FROM embeddings)) SELECT ax.query_id, ax.video_id, round(greatest(coalesce(max(score), 0), 0), 6) AS score FROM ax LEFT JOIN (SELECT * FROM sc WHERE score > 0.2) s USING (query_id, video_id) GROUP BY ALL",
    "video_topk_mean": f"WITH {SC}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY score DESC, start_s, window_id) AS n FROM sc) SELECT query_id, video_id, round(avg(score), 6) AS score FROM r WHERE n <= 3 GROUP BY ALL",
    "video_contiguous_mean": f"WITH {SC}, r AS (SELECT *, count(*) OVER (PARTITION BY query_id, video_id) AS n, row_number() OVER l AS i, avg(score) OVER (PARTITION BY query_id, video_id ORDER BY start_s, window_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS m FROM sc WINDOW l AS (PARTITION BY query_id, video_id ORDER BY start_s, window_id)) SELECT query_id, video_id, round(max(m), 6) AS score FROM r WHERE i <= greatest(n - 2, 1) GROUP BY ALL",
    "peak_isolation_gap": f"WITH {SC}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY score DESC, start_s, window_id) AS n, lag(score) OVER l AS l, lead(score) OVER l AS r FROM sc WINDOW l AS (PARTITION BY query_id, video_id ORDER BY start_s, window_id)) SELECT query_id, video_id, count(*) AS window_count, round(max(score) FILTER (n = 1), 6) AS peak_score, round(max(score) FILTER (n = 2), 6) AS second_score, round(max(score) FILTER (n = 3), 6) AS third_score, max(window_id) FILTER (n = 1) AS peak_window_id, round(max(l) FILTER (n = 1), 6) AS left_score, round(max(r) FILTER (n = 1), 6) AS right_score, round(max(score) FILTER (n = 1) - greatest(max(l) FILTER (n = 1), max(r) FILTER (n = 1)), 6) AS isolation_gap FROM r GROUP BY query_id, video_id",
    "worst_tied_ranks": f"WITH {SC}, s AS (SELECT query_id, window_id, round(score, 1) + 0.0 AS score FROM sc) SELECT *, {worst('query_id')} AS rank FROM s",
    "top_evidence": f"WITH {SC}, w AS (SELECT query_id, 'window' AS kind, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, video_id, start_s, window_id) AS rank, video_id, window_id, round(score, 6) AS score FROM sc QUALIFY rank <= 20), v AS (SELECT query_id, 'video' AS kind, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, video_id) AS rank, video_id, NULL::BIGINT AS window_id, round(s, 6) AS score FROM (SELECT query_id, video_id, max(score) AS s FROM sc GROUP BY ALL) QUALIFY rank <= 10) SELECT * FROM w UNION ALL SELECT * FROM v",
    "candidate_k_m_pool": f"WITH {POOL} SELECT query_id, video_id, window_id, video_rank, window_rank, round(score, 6) AS score FROM ranked WHERE video_rank <= 5 AND window_rank <= 3",
    "candidate_breadth_first_cap": f"WITH {POOL} SELECT query_id, window_id, row_number() OVER (PARTITION BY query_id ORDER BY window_rank, video_rank) AS pair_rank FROM ranked WHERE video_rank <= 6 AND window_rank <= 3 QUALIFY pair_rank <= 10",
    "candidate_policy_grid_summary": f"WITH {GRID} SELECT policy_id, video_k, windows_m, query_count, {_six('pairs_mean')}, pairs_max, {_six('video_recall', 'temporal_recall', 'joint_recall', 'conditional_temporal_recall')}, video_misses, joint_misses FROM psum",
    "candidate_policy_recommended": f"WITH {GRID}, b AS (SELECT CASE WHEN max(joint_recall) >= 1 - 1e-12 THEN 1 ELSE max(joint_recall) END AS goal FROM psum) SELECT policy_id, round(joint_recall, 6) AS joint_recall, row_number() OVER (ORDER BY joint_recall < goal - 1e-12, pairs_max, video_k, windows_m, policy_id) = 1 AS recommended FROM psum, b",
    "candidate_failures": f"WITH {GRID} SELECT policy_id, query_id, CASE WHEN NOT video_kept THEN 'CANDIDATE_VIDEO_MISS' ELSE 'CANDIDATE_WINDOW_MISS' END AS failure_type FROM res WHERE NOT (video_kept AND window_kept)",
    "candidate_blend_50_50": f"WITH {BLEND} SELECT query_id, window_id, round(blend, 6) AS blend FROM bl",
    "rerank_final_order": f"WITH {BLEND}, f AS (SELECT query_id, video_id, round(max(blend), 9) AS fs FROM bl GROUP BY ALL) SELECT query_id, video_id, video_rank AS first_rank, row_number() OVER (PARTITION BY query_id ORDER BY fs IS NULL, fs DESC, CASE WHEN fs IS NULL THEN video_rank END, video_id) AS final_rank FROM vr LEFT JOIN f USING (query_id, video_id)",
    "supporting_windows": f"WITH {BLEND} SELECT sc.query_id, sc.video_id, sc.window_id, row_number() OVER (PARTITION BY sc.query_id, sc.video_id ORDER BY bl.blend IS NULL, round(bl.blend, 9) DESC, CASE WHEN bl.blend IS NULL THEN sc.score END DESC, sc.start_s, sc.window_id) AS support_rank FROM sc LEFT JOIN bl ON bl.query_id = sc.query_id AND bl.window_id = sc.window_id QUALIFY support_rank <= 3",
    "temporal_overlap_relevance": f"WITH {JUDGED} SELECT query_id, window_id, overlap_s, relevant FROM judged0 WHERE overlap_s > 0",
    "retrieval_metrics": f"WITH {METRICS} SELECT method_id, query_id, first_relevant_rank, video_rank, top_story_window_id, top_video_id, {_six('story_score_margin', 'video_score_margin')}, positive_video_count, {_six('story_rr', 'video_rr')}, video_recall_at_3 FROM m",
    "metric_summary": f"WITH {METRICS} SELECT method_id, count(*) AS query_count, round(avg(story_rr), 6) AS story_mrr, round(avg(video_rr), 6) AS video_mrr, round(avg(story_recall_at_3), 6) AS story_recall_at_3, round(avg(video_recall_at_3), 6) AS video_recall_at_3, round(avg(video_rank), 6) AS video_rank_mean, round(median(video_rank), 6) AS video_rank_median, round(median(first_relevant_rank), 6) AS story_first_rank_median, sum(zero_evidence::INT)::BIGINT AS zero_evidence_query_count FROM m GROUP BY method_id",
    "metric_breakdowns_grouping_sets": f"WITH {METRICS}, x AS (SELECT *, (query_id % 3)::VARCHAR AS l, CASE WHEN video_rank = 1 THEN 'easy' ELSE 'hard' END AS d FROM m WHERE method_id = 'exact') SELECT CASE WHEN grouping(l) = 0 THEN 'correct_label' WHEN grouping(d) = 0 THEN 'difficulty' ELSE 'overall' END AS breakdown_type, coalesce(l, d, 'all') AS breakdown_value, count(*) AS query_count, round(avg(video_rr), 6) AS video_mrr, round(avg(story_rr), 6) AS story_mrr FROM x GROUP BY GROUPING SETS ((), (l), (d))",
    "paired_method_comparison": f"WITH {METRICS} SELECT query_id, candidate_method, {rel('s1', 's0')} AS story_relation, {rel('v1', 'v0')} AS video_relation, {_six('story_rr_delta', 'video_rr_delta')}, top_story_changed, top_video_changed, coalesce(v0 = 1 AND v1 <> 1, false) AS rank1_loss FROM c",
    "relation_counts": f"WITH {METRICS}, r AS (SELECT candidate_method, {rel('v1', 'v0')} AS x FROM c) SELECT candidate_method, count(*) FILTER (x = 'better') AS better, count(*) FILTER (x = 'tie') AS tie, count(*) FILTER (x = 'worse') AS worse FROM r GROUP BY ALL",
    "composite_methods": f"WITH {METRICS}, j AS (SELECT a.method_id, a.video_rr AS v, a.story_rr AS s, a.video_rr - b.video_rr AS dv, a.story_rr - b.story_rr AS ds FROM m a JOIN m b USING (query_id) WHERE b.method_id = 'exact') SELECT method_id, count(*) AS query_count, round(avg(v), 6) AS composite_video_rr, round(avg(s), 6) AS composite_story_rr, round(avg(dv), 6) AS video_delta_mean, round(median(dv), 6) AS video_delta_median, count(*) FILTER (dv > 0) AS better, count(*) FILTER (dv = 0) AS tie, count(*) FILTER (dv < 0) AS worse FROM j GROUP BY ALL",
    "pareto_frontier": f"WITH {OPS}, p AS (SELECT model_id || '/' || stage_id AS name, round(tried / (total / 3600), 3) AS up, round(p90_rtf, 6) AS down FROM ops) SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.up >= p.up AND b.down <= p.down AND (b.up > p.up OR b.down < p.down))",
    "eligibility_reasons": "WITH x AS (SELECT doc_id, text, CASE WHEN quality IS NULL THEN 'unlabelled' WHEN quality = 1 THEN 'ok' ELSE 'failed' END AS status, coalesce(toxic = 1, false) AS tox FROM documents LEFT JOIN labels USING (doc_id)) SELECT doc_id, CASE WHEN status <> 'ok' THEN 'status_' || status WHEN trim(text) = '' THEN 'empty_text' WHEN tox THEN 'processed_rejection' END AS reason, status = 'ok' AND trim(text) <> '' AND NOT tox AS searchable FROM x",
    "consecutive_duplicate_windows": f"WITH {WIN}, f AS (SELECT *, {folded('text')} AS f FROM win) SELECT window_id, len(f) >= 30 AND coalesce(f = last_value(CASE WHEN f <> '' THEN f END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY start_s, window_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS duplicate FROM f",
    "exact_duplicate_groups": f"SELECT sha256(n) AS digest, count(*) AS members, min(doc_id) AS first_id FROM (SELECT doc_id, {norm('text')} AS n FROM documents) WHERE n <> '' GROUP BY n HAVING count(*) > 1",
    "near_duplicate_pairs": f"WITH {WIN}, {CHARS} SELECT a.id AS left_id, b.id AS right_id, round(sum(a.w * b.w), 6) AS similarity FROM un a JOIN un b ON a.g = b.g AND a.id < b.id GROUP BY ALL HAVING sum(a.w * b.w) >= 0.9",
    "phrase_mining": f"WITH {WIN}, {GRAMS} ps AS (SELECT window_id, video_id, len(w) AS size, unnest(flatten([[{{'p': array_to_string(w[i : i + k - 1], ' '), 'k': k}} FOR i IN range(1, len(w) - k + 2)] FOR k IN range(4, 9)])) AS g FROM wt), e AS (SELECT window_id, video_id, size, g.p AS phrase, g.k AS n, count(*) AS c FROM ps GROUP BY ALL) SELECT phrase, n, sum(c)::BIGINT AS occurrences, count(DISTINCT window_id) AS windows, count(DISTINCT video_id) AS videos, round(max(least(1.0, c * n / size)), 6) AS coverage, round(count(DISTINCT video_id) * max(least(1.0, c * n / size)), 6) AS suspicion FROM e GROUP BY phrase, n HAVING count(DISTINCT video_id) >= 2",
    "bag_token_f1_agreement": f"WITH {AGREE} SELECT conv_id, turn, rn AS reference_tokens, cn AS candidate_tokens, round(p, 6) AS token_precision, round(rcl, 6) AS token_recall, round(f1, 6) AS token_f1, round(CASE WHEN rn > 0 THEN cn / rn END, 6) AS length_ratio FROM agf",
    "agreement_summary": f"WITH {AGREE}, s AS (SELECT *, 'all_reference_windows' AS subset FROM agf UNION ALL SELECT *, 'trusted_reference_windows' FROM agf WHERE rn > 20) SELECT subset, count(*) AS window_count, round(avg(f1), 6) AS token_f1_mean, round(avg(CASE WHEN rn > 0 THEN cn / rn END), 6) AS length_ratio_mean FROM s GROUP BY subset",
    "operational_percentiles": f"WITH {OPS} SELECT model_id, stage_id, expected, present, successful, failed, empty, round(total, 6) AS total_runtime_s, round(total / audio, 6) AS aggregate_rtf, {_six('mean_rtf', 'median_rtf', 'p90_rtf', 'p95_rtf')}, round(tried / (total / 3600), 6) AS windows_per_hour FROM ops",
    "latency_percentiles": f"WITH {RUNS} SELECT model_id, count(*) AS runs, round(avg(runtime_s), 6) AS mean_ms, round(quantile_cont(runtime_s, 0.5), 6) AS p50_ms, round(quantile_cont(runtime_s, 0.9), 6) AS p90_ms, round(quantile_cont(runtime_s, 0.95), 6) AS p95_ms, round(max(runtime_s), 6) AS max_ms FROM runs WHERE runtime_s IS NOT NULL GROUP BY model_id",
    "status_counters": f"WITH {RUNS} SELECT model_id, status, count(*) AS n FROM runs GROUP BY ALL",
    "physical_windowing_60_45": "WITH v AS (SELECT doc_id::VARCHAR AS video_id, len(text)::BIGINT * 16000 AS samples FROM documents WHERE len(text) > 0), s AS (SELECT video_id, samples, unnest(range(0, samples, 720000)) AS sample_start FROM v), k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY sample_start) - 1 AS window_index FROM s WHERE sample_start = 0 OR samples - sample_start >= 240000) SELECT video_id || '_' || printf('%04d', window_index) AS window_id, video_id, window_index, sample_start, least(sample_start + 960000, samples) AS sample_end, sample_start / 16000 AS start_s, least(sample_start + 960000, samples) / 16000 AS end_s FROM k",
    "event_sliding_windows_60_45": "WITH e AS (SELECT *, epoch(ts) AS t FROM events), w AS (SELECT *, unnest([floor(t / 45) * 45, floor(t / 45) * 45 - 45]) AS start FROM e) SELECT start::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w WHERE t >= start AND t < start + 60 GROUP BY ALL",
    "window_identity_full_outer": f"WITH {WIN}, a AS (SELECT DISTINCT window_id FROM win WHERE role <> 'assistant'), b AS (SELECT DISTINCT window_id FROM win WHERE role <> 'system') SELECT coalesce(a.window_id, b.window_id) AS window_id, CASE WHEN b.window_id IS NULL THEN 'left_only' WHEN a.window_id IS NULL THEN 'right_only' ELSE 'both' END AS side FROM a FULL JOIN b ON a.window_id = b.window_id",
    "missing_extra_ids": "SELECT DISTINCT doc_id, 'missing' AS problem FROM documents ANTI JOIN labels USING (doc_id) UNION ALL SELECT DISTINCT doc_id, 'extra' FROM labels ANTI JOIN documents USING (doc_id)",
    "split_leakage": "SELECT md5(text) AS digest FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT md5(text) FROM documents WHERE doc_id % 2 = 1",
    "axis_contiguity": "SELECT conv_id AS video_id, count(*) AS n, min(turn) AS low, max(turn) AS high, count(DISTINCT turn) AS different FROM conversations GROUP BY conv_id HAVING min(turn) <> 0 OR max(turn) <> count(*) - 1 OR count(DISTINCT turn) <> count(*)",
    "temporal_monotonic": "WITH x AS (SELECT user_id, event_id, epoch_us(ts) AS a, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) SELECT user_id, event_id, a AS \"at\", b AS before FROM x WHERE a < b",
    "row_contract": f"WITH {WIN} SELECT 'positive_duration' AS \"check\", count(*) FILTER (NOT end_s > start_s) AS violations FROM win UNION ALL SELECT 'start_not_negative', count(*) FILTER (NOT start_s >= 0) FROM win UNION ALL SELECT 'has_video', count(*) FILTER (video_id IS NULL) FROM win UNION ALL SELECT 'short_text', count(*) FILTER (NOT coalesce(len(text) < 200, false)) FROM win",
    "field_mismatches": "SELECT 'lang' AS field, count(*) FILTER (lang IS DISTINCT FROM 'en') AS mismatches FROM documents UNION ALL SELECT 'n_chars', count(*) FILTER (n_chars IS DISTINCT FROM len(text)) FROM documents",
    "query_category_classify": f"WITH x AS (SELECT doc_id, lower(text) AS l FROM documents) SELECT doc_id, CASE WHEN regexp_matches(l, '{_NUMBER}') OR regexp_matches(l, '(^|[^\\p{{L}}\\p{{N}}_])\\d+([.,]\\d+)?\\s*%[\\p{{L}}\\p{{N}}_]') THEN 'number_or_measurement' WHEN {' OR '.join(f'''contains(l, '{x}')''' for x in NAMED)} THEN 'person_organization_location' ELSE 'other' END AS category FROM x",
    "document_identity_hash": "SELECT doc_id, sha256('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"n_chars\":' || n_chars || ',\"source\":\"' || source || '\"}') AS identity FROM documents",
    "view_pivot_spread": f"WITH {RUNS}, p AS (SELECT stage_id, model_id, round(avg(runtime_s), 6) AS v FROM runs GROUP BY ALL) SELECT stage_id, round(max(v) - min(v), 6) AS spread FROM p GROUP BY stage_id",
    "value_counts_with_nulls": "SELECT lang, quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL",
    "window_count_distribution": f"WITH {WIN}, p AS (SELECT video_id, count(*) AS windows, max(end_s) AS d FROM win GROUP BY ALL) SELECT windows, count(*) AS videos, min(d) AS shortest, max(d) AS longest FROM p GROUP BY windows",
    "normalised_texts": f"SELECT doc_id, md5({norm('text')}) AS matching, md5({folded('text')}) AS folded, md5({agree('text')}) AS agreement FROM documents",
    "fraction_parse": "SELECT o_orderkey, round(CASE WHEN o_custkey % 5 <> 0 THEN (o_orderkey % 7)::DOUBLE / (o_custkey % 5) END, 6) AS value FROM orders",
    "video_id_checks": r"SELECT page_id, coalesce(regexp_matches(url, '^[A-Za-z0-9][A-Za-z0-9._-]*$'), false) AS valid, regexp_matches(printf('K%02d_V%03d', page_id % 100, page_id), '^[KL]\d{2}_V\d{3}$') AS corpus_valid FROM pages",
    "extreme_pairs": f"WITH {METRICS}, x AS (SELECT candidate_method, query_id, round(video_rr_delta, 9) AS delta FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY candidate_method ORDER BY delta DESC, query_id) AS t, row_number() OVER (PARTITION BY candidate_method ORDER BY delta, query_id) AS b FROM x) SELECT candidate_method, query_id, round(delta, 6) AS delta FROM r WHERE t <= 5 OR b <= 5 OR delta < -0.5",
    "identity_of_table": f"WITH h AS (SELECT sha256('{{' || concat_ws(',', '\"doc_id\":' || doc_id, '\"quality\":' || quality, '\"toxic\":' || toxic) || '}}') AS h FROM labels) SELECT count(*) AS n, sha256(concat_ws(':', count(*), {', '.join(f"sum(('0x' || substr(h, {1 + 8 * k}, 8))::BIGINT)" for k in range(8))})) AS digest FROM h",
    "latest_status": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "unit_aliases": "SELECT event_id, event_id || ' kg and ' || user_id || ' kg kg of kg' AS aliased FROM events",
}

_VIEWS = METRICS + """,
vw AS (SELECT query_id, method_id AS view, video_rank, video_rr FROM m WHERE method_id = 'exact' OR video_rank = 1),
vc AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, a.video_rank AS processed_rank, b.video_rank AS raw_rank, coalesce(a.video_rr, 0) - coalesce(b.video_rr, 0) AS rr_delta
       FROM (SELECT * FROM vw WHERE view = 'exact') a FULL JOIN (SELECT * FROM vw WHERE view = 'coarse') b ON a.query_id = b.query_id)"""
_ROLE = f"""wt AS (SELECT role, window_id, video_id, {toks(norm("text"))} AS w FROM win),
ps AS (SELECT role, window_id, video_id, len(w) AS size, unnest(flatten([[{{'p': array_to_string(w[i : i + k - 1], ' '), 'k': k}} FOR i IN range(1, len(w) - k + 2)] FOR k IN range(4, 9)])) AS g FROM wt),
e AS (SELECT role, window_id, video_id, size, g.p AS phrase, g.k AS n, count(*) AS c FROM ps GROUP BY ALL),
f AS (SELECT role AS model_id, phrase, n, sum(c)::BIGINT AS occurrences, count(DISTINCT video_id) AS videos, count(DISTINCT video_id) * max(least(1.0, c * n / size)) AS suspicion FROM e GROUP BY ALL HAVING count(DISTINCT video_id) >= 2)"""
_REPEATS = f"""wt AS (SELECT window_id, text, {toks(norm("text"))} AS w FROM win),
tk AS (SELECT window_id, i, w[i] AS x FROM (SELECT window_id, w, unnest(range(1, len(w) + 1)) AS i FROM wt)),
isl AS (SELECT window_id, x, i - row_number() OVER (PARTITION BY window_id, x ORDER BY i) AS grp FROM tk),
rl AS (SELECT window_id, count(*) AS n FROM isl GROUP BY window_id, x, grp),
rn AS (SELECT window_id, max(n) AS longest, count(*) FILTER (n >= 2) AS runs FROM rl GROUP BY window_id),
gg AS (SELECT window_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT window_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM wt, (VALUES (3), (4), (5)) v(k))),
gc AS (SELECT window_id, k, g, count(*) AS c FROM gg GROUP BY ALL),
gs AS (SELECT window_id, k, sum(c)::BIGINT AS total, count(*) AS uniq, max(c) AS most, max_by(g, {{'c': c, 'g': g}}) AS top, (sum(c) - count(*)) / sum(c) AS ratio FROM gc GROUP BY ALL)"""
SQL |= {
    "token_repetition_diagnostics": f"WITH {WIN}, {_REPEATS} SELECT wt.window_id, len(text) AS raw_characters, len(w) AS raw_tokens, coalesce(longest, 0) AS longest_run, coalesce(runs, 0) AS repeated_runs, round(greatest(coalesce(a.ratio, 0), coalesce(b.ratio, 0), coalesce(c.ratio, 0)), 6) AS repetition_score, coalesce(a.total, 0) AS ngram_3_total, coalesce(a.uniq, 0) AS ngram_3_unique, coalesce(a.most, 0) AS ngram_3_maximum_occurrence, CASE WHEN a.most > 1 THEN a.top END AS ngram_3_most_repeated, 0.1::DOUBLE AS real_time_factor FROM wt LEFT JOIN rn USING (window_id) LEFT JOIN gs a ON a.window_id = wt.window_id AND a.k = 3 LEFT JOIN gs b ON b.window_id = wt.window_id AND b.k = 4 LEFT JOIN gs c ON c.window_id = wt.window_id AND c.k = 5",
    "runtime_gap": f"WITH {OPS} SELECT a.stage_id, a.model_id AS model_a, b.model_id AS model_b, round(a.mean_rtf - b.mean_rtf, 6) AS mean_rtf_gap, round(a.p90_rtf - b.p90_rtf, 6) AS p90_rtf_gap FROM ops a JOIN ops b ON a.stage_id = b.stage_id AND a.model_id < b.model_id",
    "view_comparison": f"WITH {_VIEWS} SELECT query_id, processed_rank, raw_rank, {rel('processed_rank', 'raw_rank')} AS relation, round(rr_delta, 6) AS rr_delta FROM vc",
    "view_summary": f"WITH {_VIEWS}, r AS (SELECT {rel('processed_rank', 'raw_rank')} AS relation, rr_delta FROM vc) SELECT relation, count(*) AS queries, round(avg(rr_delta), 6) AS delta_mean, round(median(rr_delta), 6) AS delta_median FROM r GROUP BY relation",
    "pair_gates": f"WITH {_VIEWS}, j AS (SELECT b.view AS fast_view, a.view AS slow_view, a.video_rr - b.video_rr AS d FROM vw a JOIN vw b USING (query_id) WHERE a.view = 'exact' AND b.view = 'coarse') SELECT fast_view, slow_view, count(*) AS queries, round(avg(d), 6) AS deficit, avg(d) <= 0.02 AS passes FROM j GROUP BY ALL",
    "inspection_cases": "SELECT lang AS \"case\", doc_id FROM documents WHERE lang IN ('de', 'en', 'es', 'fr') QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) = 1",
    "top_phrases_by_role": f"WITH {WIN}, {_ROLE} SELECT model_id, phrase, occurrences, videos, row_number() OVER (PARTITION BY model_id ORDER BY suspicion DESC, videos DESC, occurrences DESC, phrase) AS place FROM f QUALIFY place <= 10",
    "completed_windows": "SELECT documents.doc_id, lang, quality, CASE WHEN labels.doc_id IS NULL THEN 'missing' ELSE 'ok' END AS status FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id",
    "metric_regression": f"WITH {METRICS}, a AS (SELECT method_id, avg(video_rr) AS actual FROM m GROUP BY ALL), e AS (SELECT unnest(['exact', 'coarse', 'other']) AS method_id, (SELECT actual FROM a WHERE method_id = 'exact') AS expected) SELECT method_id, round(actual, 6) AS actual, round(expected, 6) AS expected, CASE WHEN actual IS NULL THEN 'missing' WHEN abs(actual - expected) > 1e-9 THEN 'different' ELSE 'same' END AS status FROM e LEFT JOIN a USING (method_id)",
    "json_lines_round_trip": "SELECT * FROM conversations",
    "csv_round_trip": "SELECT * FROM labels",
    "release_videos": f"WITH {WIN}, n AS (SELECT *, {norm('text')} AS t FROM win) SELECT video_id::VARCHAR AS video_id, count(*) AS windows, count(*) FILTER (t <> '') AS eligible_windows, max(end_s) AS duration_s FROM n GROUP BY video_id",
    "score_cache_round_trip": f"WITH {JUDGED} SELECT method_id, query_id, window_id, round(score, 6) + 0.0 AS score FROM judged",
}


def oracle_sql() -> dict[str, str]:
    from tessera.plans.review_oracles import REVIEWS

    return SQL | REVIEWS

