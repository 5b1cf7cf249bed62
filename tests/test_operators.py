import pytest
from pyspark.sql import functions as F

from tessera.operators import diagnostics as d
from tessera.operators import evaluation as e
from tessera.operators import governance as g
from tessera.operators import ranking as k
from tessera.operators import retrieval as r
from tessera.operators import windowing as w

SCORES = "query_id string, window_id string, video_id string, start_s double, score double"


def scored(spark, rows):
    return spark.createDataFrame(rows, SCORES)


def test_windows(spark):
    v = spark.createDataFrame([("a", 10 * 16000), ("b", 104 * 16000), ("c", 105 * 16000), ("d", 0)], "video_id string, samples long")
    got = {}
    for x in w.physical_windows(v).orderBy("window_id").collect():
        got.setdefault(x.video_id, []).append((x.start_s, x.end_s))
    assert got == {"a": [(0, 10)], "b": [(0, 60), (45, 104)], "c": [(0, 60), (45, 105), (90, 105)]}


def test_worst_ties(spark):
    s = scored(spark, [("q", str(i), "v", 0.0, x) for i, x in enumerate([0.9, 0.5, 0.5 + 1e-13, 0.1])])
    assert [x.r for x in s.withColumn("r", k.worst_tied_rank(["query_id"])).orderBy("window_id").collect()] == [1, 3, 3, 4]


def test_bm25_counts_terms_once(spark):
    docs = spark.createDataFrame([(1, ["hổ", "vàng"], True), (2, ["mèo"], True), (3, ["hổ"], False)], "doc_id long, terms array<string>, eligible boolean")
    q = spark.createDataFrame([("a", ["hổ"]), ("b", ["hổ", "hổ"]), ("c", ["ho"])], "query_id string, terms array<string>")
    rows = {(x.query_id, x.doc_id): x.score for x in r.bm25(docs, q).collect()}
    assert set(rows) == {("a", 1), ("b", 1)} and rows["a", 1] == rows["b", 1] > 0


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    a, b = [x.n for x in df.select(r.l2_normalise(F.col("v")).alias("n")).collect()]
    assert a == pytest.approx([0.6, 0.8]) and b is None
    v = spark.createDataFrame([(1, [1.0, 0.0], True), (2, [1.0, 0.0], False), (3, [-1.0, 0.0], True)], "doc_id long, embedding array<double>, eligible boolean")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    assert [x.score for x in r.dense_scores(v, q).orderBy("doc_id").collect()] == [1.0, -2.0, -1.0]
    more = spark.createDataFrame([(str(i), [1.0, 0.0]) for i in range(5)], "query_id string, embedding array<double>")
    assert r.dense_scores(v, more, most_queries=2).count() == 15


def test_min_max(spark):
    same = spark.createDataFrame([("q", i, 4.2) for i in range(3)], "query_id string, doc_id long, score double")
    assert {x.score for x in r.normalised(same).collect()} == {0.0}
    sparse = spark.createDataFrame([("q", 1, 2.0), ("q", 2, 4.0)], "query_id string, doc_id long, score double")
    assert {x.doc_id: x.score for x in r.normalised_sparse(sparse, 3).collect()} == {1: 0.5, 2: 1.0}
    assert {x.doc_id: x.score for x in r.normalised_sparse(sparse, 2).collect()} == {1: 0.0, 2: 1.0}


def test_pool_and_orders(spark):
    rows = [("q", f"{v}{i}", v, float(i), x) for v, xs in {"a": [0.9, 0.2], "b": [0.8, 0.7], "c": [0.7, 0.6], "d": [0.1, 0.0]}.items() for i, x in enumerate(xs)]
    s = scored(spark, rows)
    assert [x.window_id for x in k.capped_pool(s, 3, 2, 4).orderBy("pair_rank").collect()] == ["a0", "b0", "c0", "a1"]
    first = e.video_scores(s).select("query_id", "video_id", F.col("display_rank").alias("first_rank"))
    final = spark.createDataFrame([("q", "a", 0.1), ("q", "b", 0.2), ("q", "c", 0.9)], "query_id string, video_id string, score double")
    assert [(x.video_id, x.first_rank) for x in k.final_order(first, final).orderBy("final_rank").collect()] == [("c", 3), ("b", 2), ("a", 1), ("d", 4)]
    spans = {x.video_id: x.score for x in k.video_best_span(s, 2).collect()}
    assert spans["a"] == pytest.approx(0.55)
    peak = k.peaks(s).where("video_id = 'a'").first()
    assert peak.isolation_gap == pytest.approx(0.7) and peak.third_score is None


def test_floor_keeps_every_video(spark):
    s = scored(spark, [("q", "a0", "a", 0.0, -0.5)])
    videos, queries = spark.createDataFrame([("a",), ("b",)], "video_id string"), spark.createDataFrame([("q",)], "query_id string")
    assert {x.video_id: x.score for x in k.video_max_floor(s, videos, queries).collect()} == {"a": 0.0, "b": 0.0}


def test_pareto(spark):
    m = spark.createDataFrame([("a", 1.0, 5.0), ("b", 2.0, 6.0), ("c", 0.5, 6.0), ("d", 2.0, 6.0), ("e", 3.0, 6.0)], "name string, up double, down double")
    assert {x.name for x in k.pareto_frontier(m, "name", "up", "down").collect()} == {"a", "e"}


def test_metrics(spark):
    q = spark.createDataFrame([("q", "a", 30.0)], "query_id string, correct_video string, answer_time_s double")
    s = scored(spark, [("q", "a0", "a", 0.0, 0.5), ("q", "a1", "a", 300.0, 0.9), ("q", "b0", "b", 0.0, 0.9)]).withColumn("end_s", F.col("start_s") + 60)
    m = e.query_metrics(e.relevance(s, q)).first()
    assert (m.first_relevant_rank, m.video_rank, m.top_video_id, m.story_rr) == (2, 2, "a", 0.5)
    assert m.story_score_margin == pytest.approx(-0.4)


def test_relations(spark):
    df = spark.createDataFrame([(1, 2), (2, 1), (1, 1), (None, 3), (None, None)], "a int, b int")
    assert [x.r for x in df.select(e.rank_relation(F.col("a"), F.col("b")).alias("r")).collect()] == ["better", "worse", "tie", "worse", "tie"]


def test_bootstrap_is_fixed(spark):
    df = spark.createDataFrame([("m", float(x)) for x in range(10)], "k string, v double")
    a, b = (e.bootstrap_interval(x, "k", "v", samples=50).first() for x in (df, df.orderBy(F.desc("v"))))
    assert a == b and a.low < 4.5 < a.high


def test_consecutive_duplicates(spark):
    long = "một câu đủ dài để được xem là lặp lại"
    rows = [("v", "0", 0.0, long), ("v", "1", 45.0, ""), ("v", "2", 90.0, long.upper()), ("v", "3", 135.0, "ngắn"), ("v", "4", 180.0, "ngắn"), ("u", "5", 0.0, long)]
    df = spark.createDataFrame(rows, "video_id string, window_id string, start_s double, text string")
    assert [x.duplicate for x in w.consecutive_duplicates(df, F.col("text")).orderBy("window_id").collect()] == [False, False, True, False, False, False]


def test_processed(spark):
    from tessera.functions.text import BOILERPLATE

    rows = [("v", "0", 0.0, BOILERPLATE[0]), ("v", "1", 45.0, f"tin tức hôm nay rất nhiều và rất dài để phần này thắng {BOILERPLATE[3]}"), ("v", "2", 90.0, None)]
    df = spark.createDataFrame(rows, "video_id string, window_id string, start_s double, raw_text string")
    a, b, c = w.processed(df).orderBy("window_id").collect()
    assert a.retrieval_text == "" and a.rejections == ["dominant_known_boilerplate"]
    assert b.retrieval_text == "tin tức hôm nay rất nhiều và rất dài để phần này thắng" and b.warnings == ["partial_known_boilerplate"]
    assert c.warnings == ["empty_output"] and c.transformations == ["empty_output"]


def test_near_pairs_against_all_pairs(spark):
    import math
    from collections import Counter

    texts = {f"w{i}": x for i, x in enumerate(["the quick brown fox jumps", "the quick brown fox jumped", "the quick brown fox jumps", "another thing entirely here", "the the the", ""])}
    df = spark.createDataFrame(list(texts.items()), "window_id string, text string")
    got = {(x.left_id, x.right_id): x.similarity for x in d.near_pairs(df, 0.7).collect()}

    def grams(s):
        return Counter(f" {x} "[i : i + n] for x in s.split() for n in range(3, min(5, len(x) + 2) + 1) for i in range(len(x) + 3 - n))

    held = {i: grams(x) for i, x in texts.items() if x}
    df_ = Counter(g for c in held.values() for g in c)
    vec = {i: {g: n * (math.log((1 + len(held)) / (1 + df_[g])) + 1) for g, n in c.items()} for i, c in held.items()}
    norm = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vec.items()}
    first = {}
    for i, x in texts.items():
        first.setdefault(x, i)
    ids = sorted(v for x, v in first.items() if x)
    want = {(i, j): s for i in ids for j in ids if i < j and (s := sum(vec[i][g] * vec[j].get(g, 0) for g in vec[i]) / norm[i] / norm[j]) >= 0.7}
    assert got == pytest.approx(want)


def test_reasons(spark):
    df = spark.createDataFrame([("ok", "x", []), ("bad", "x", []), (None, "x", []), ("ok", " ", []), ("ok", "x", ["r"])], "s string, t string, r array<string>")
    rows = df.select(d.zero_reason(F.col("s"), F.col("t"), F.col("r")).alias("z"), d.searchable(F.col("s"), F.col("t"), F.col("r")).alias("p")).collect()
    assert [x.z for x in rows] == [None, "status_bad", "status_missing", "empty_text", "processed_rejection"]
    assert [x.p for x in rows] == [True, False, False, False, False]


def test_governance(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(2,), (3,)], "id int")
    assert {x.id: x.side for x in g.identity_sides(a, b, ["id"]).collect()} == {1: "left_only", 2: "both", 3: "right_only"}
    assert {x.id: x.problem for x in g.missing_and_extra(a, b, "id").collect()} == {1: "missing", 3: "extra"}
    assert g.same_rows(a, a).count() == 0 and g.same_rows(a, b).count() == 2
    assert [x.id for x in g.leakage(a, b, "id").collect()] == [2]
    x = spark.createDataFrame([(1, 0.5, None), (2, 1.0, "a")], "id int, v double, s string")
    y = spark.createDataFrame([(1, 0.5, "b"), (2, 1.1, "a")], "id int, v double, s string")
    assert {r_.field: r_.mismatches for r_ in g.field_mismatches(x, y, ["id"], ["v", "s"]).collect()} == {"v": 1, "s": 1}
    same = g.table_identity(x, ["id", "v", "s"]).first()
    assert same == g.table_identity(x.orderBy(F.desc("id")), ["id", "v", "s"]).first() != g.table_identity(y, ["id", "v", "s"]).first()
    done = g.acceptance(x, {"some": F.count("*") > 0, "many": F.count("*") > 5}).first()
    assert (done.accepted, done.blockers) == (False, ["many"])


def test_empty_tables(spark):
    s = scored(spark, [])
    assert k.candidate_pool(s, 3, 2).count() == 0 and k.peaks(s).count() == 0 and e.video_scores(s).count() == 0
    assert d.near_pairs(spark.createDataFrame([], "window_id string, text string")).count() == 0


def test_reports(spark):
    from tessera.operators import reports as p

    rows = [("a0", "a", 0, "one two three"), ("a1", "a", 1, "one two three"), ("a2", "a", 2, "else"), ("b0", "b", 0, "One, two three!"), ("b1", "b", 1, "")]
    df = spark.createDataFrame(rows, "window_id string, video_id string, window_index int, text string")
    got = {(r.left_id, r.right_id): (r.relationship, r.exact) for r in p.duplicate_report(df).collect()}
    assert got == {("a0", "a1"): ("adjacent_same_video", True), ("a0", "b0"): ("cross_video", True), ("a1", "a2"): ("adjacent_same_video", False), ("b0", "b1"): ("adjacent_same_video", False)}
    assert [r.exact for r in p.duplicate_report(df, most=2).collect()] == [True, True]
    cases = p.inspection_cases(df, {"long": (F.lit(True), F.length("text")), "none": (F.lit(False), F.length("text"))}, "window_id").collect()
    assert [(r.case, r.window_id) for r in cases] == [("long", "b0")]
    m = spark.createDataFrame([("q", "w", "raw", 2, 0.5), ("q", "w", "processed", 1, 1.0), ("q", "p", "raw", 1, 1.0)], "query_id string, model_id string, view string, video_rank int, video_rr double")
    assert p.view_comparison(m, "processed", "raw", ["model_id", "query_id"]).where("model_id = 'w'").first().relation == "better"
    assert {(r.fast_view, r.slow_view): r.passes for r in p.pair_gates(m, "p", "w", 0.1).collect()} == {("raw", "raw"): True, ("raw", "processed"): True}
    assert p.gap_summary(m.where("view = 'raw'"), ["query_id"], "model_id", "w", "p", ["video_rr"]).first().video_rr_gap == -0.5
    splits = spark.createDataFrame([("a", "core"), ("b", "holdout")], "video_id string, split string")
    assert [p.scope(df, splits, n).count() for n in ("all", "core", "holdout", "non_holdout")] == [5, 3, 2, 3]
    s = spark.createDataFrame([([([0.0, 1.5], " x  y ")],)], "s array<struct<timestamp:array<double>,text:string>>")
    assert tuple(s.select(p.canonical_segments(F.col("s"), "chunks").alias("c")).first().c[0]) == (0, 0.0, 1.5, "x y")
    assert set(p.pivot_by_view(m.where("model_id = 'w'"), ["video_rr"], ["raw", "processed"]).columns) == {"query_id", "raw", "processed"}


def test_ties_start_at_a_groups_first_score(spark):
    chain = [1.0, 1 - 0.8e-12, 1 - 1.6e-12, 0.5, 0.5, 0.5 - 0.9e-12, 0.1, float("-inf")]
    s = scored(spark, [(q, f"{i}{q}", "v", 0.0, x) for q in "ab" for i, x in enumerate(chain)])
    got = [r.rank for r in k.worst_tied(s, ["query_id"]).where("query_id = 'b'").orderBy("window_id").collect()]
    assert got == [2, 2, 3, 6, 6, 6, 7, 8]
    assert k.worst_tied(s.limit(0), ["query_id"]).count() == 0


def test_pool_contract(spark):
    pool = spark.createDataFrame([("a", "1", "v", "x"), ("a", "2", "w", "y"), ("b", "1", "v", "x"), ("b", "1", "v", " "), ("d", "1", "v", "x")], "query_id string, window_id string, video_id string, text string")
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "query_id string")
    got = sorted((r.query_id, r.problem) for r in g.pool_contract(pool, asked, 2, 1).collect())
    assert got == [("b", "empty_text"), ("b", "repeated_window"), ("b", "video_count"), ("c", "no_pool"), ("d", "unknown_query")]


def test_frontier_and_spacing(spark):
    import random

    rng = random.Random(2)
    rows = [(str(i), float(rng.randrange(40)), float(rng.randrange(40))) for i in range(500)]
    want = {n for n, u, d_ in rows if not any(x >= u and y <= d_ and (x > u or y < d_) for _, x, y in rows)}
    assert {r.name for r in k.pareto_frontier(spark.createDataFrame(rows, "name string, up double, down double"), "name", "up", "down").collect()} == want
    ids = spark.range(1000).repartition(5)
    assert [r.id for r in k.evenly_spaced(ids, "id", 4).orderBy("id").collect()] == [0, 333, 666, 999]
    assert k.evenly_spaced(ids.limit(0), "id", 4).count() == 0 and [r.place for r in k.evenly_spaced(ids.limit(1), "id", 4).collect()] == [0]


def test_dense_top_equals_all_scores(spark):
    import random

    rng = random.Random(6)
    v = spark.createDataFrame([(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)], i % 7 != 0) for i in range(200)], "doc_id long, embedding array<double>, eligible boolean").repartition(6)
    q = v.where("doc_id % 20 = 1").select(F.col("doc_id").alias("query_id"), "embedding")
    every = k.top(r.dense_scores(v, q).where("score > -2"), ["query_id"], [F.col("score").desc(), F.col("doc_id")], 5)
    key = lambda d_: sorted((x.query_id, x.rank, x.doc_id, x.score) for x in d_.collect())
    assert key(r.dense_top(v, q, 5)) == key(every) == key(r.dense_top(v, q, 5, most_queries=3))


def test_tfidf_of_few_and_many_queries(spark, monkeypatch):
    docs = spark.createDataFrame([(1, ["hổ", "vàng", "hổ"], True), (2, ["vàngs", "x"], True), (3, [], True), (4, ["hổ"], False), (5, ["qq"], True)], "doc_id long, terms array<string>, eligible boolean")
    q = spark.createDataFrame([("a", ["hổ", "to"]), ("b", ["vàng", "vàng"]), ("c", [])], "query_id string, terms array<string>")
    key = lambda d_: {(x.query_id, x.doc_id): pytest.approx(x.score, abs=1e-12) for x in d_.collect()}
    few = key(r.tfidf_cosine(docs, q))
    monkeypatch.setattr(r, "MATRIX_ENTRIES", 0)
    many = key(r.tfidf_cosine(docs, q))
    assert few == many and len(few) >= 3


def test_bm25_of_few_and_many_queries(spark, monkeypatch):
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, f"v{i % 5}" if i % 11 else None, [rng.choice(words) for _ in range(rng.randrange(0, 25))], i % 9 != 0) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, video_id string, terms array<string>, eligible boolean").repartition(5)
    q = spark.createDataFrame([(f"q{i}", [rng.choice([*words, "never"]) for _ in range(rng.randrange(0, 8))]) for i in range(12)], "query_id string, terms array<string>")
    key = lambda d_: {(x.query_id, x.doc_id): pytest.approx(x.score, abs=1e-9) for x in d_.collect()}
    few = key(r.bm25(docs, q))
    top = {(x.query_id, x.doc_id, x.rank) for x in k.top(r.bm25_in_batches(docs, q, top_k=3, digits=9), ["query_id"], [F.col("score").desc(), F.col("doc_id")], 3).collect()}
    best = {(x.query_id, x.video_id): pytest.approx(x.score, abs=1e-9) for x in k.video_max(r.bm25_in_batches(docs, q, best_of="video_id")).collect()}
    monkeypatch.setattr(r, "MATRIX_ENTRIES", 0)
    every = r.bm25(docs, q)
    assert key(every) == few
    assert {(x.query_id, x.video_id): pytest.approx(x.score, abs=1e-9) for x in r.bm25_in_batches(docs, q, best_of="video_id").collect()} == best
    assert top == {(x.query_id, x.doc_id, x.rank) for x in k.top(every.withColumn("score", F.round("score", 9)), ["query_id"], [F.col("score").desc(), F.col("doc_id")], 3).collect()}
    assert best == {(x.query_id, x.video_id): x.score for x in k.video_max(every.join(docs.select("doc_id", "video_id"), "doc_id")).collect()}
    monkeypatch.undo()
    assert r.bm25(docs.limit(0), q).count() == 0 and r.bm25(docs, q.limit(0)).count() == 0
