"""Small cases of fusion, rerank, contexts and decisions."""

import pytest
from pyspark.sql import functions as F

from quern.operators import answer, catalog, evaluation, retrieval


def channel(spark, rows):
    return spark.createDataFrame([(1, i, r, 1.0 - r / 10) for r, i in enumerate(rows, 1)], "query_id int, id string, rank int, score double")


def fused(spark, v, b, k=60):
    return [r.asDict() for r in retrieval.fuse(channel(spark, v), channel(spark, b), k).orderBy("fused_rank").collect()]


def test_fusion_adds_reciprocal_ranks(spark):
    out = fused(spark, ["A", "B"], ["B", "C"])
    assert [r["id"] for r in out] == ["B", "A", "C"]
    assert out[0]["fused_score"] == pytest.approx(1 / 61 + 1 / 62, abs=1e-9)
    assert (out[0]["vector_rank"], out[0]["bm25_rank"], out[1]["bm25_rank"]) == (2, 1, None)


def test_fusion_ties_keep_the_order_of_appearance(spark):
    assert [r["id"] for r in fused(spark, ["B", "A"], [])] == ["B", "A"]
    assert [r["id"] for r in fused(spark, ["X", "A"], ["A", "X"])] == ["X", "A"]
    assert fused(spark, [], []) == []
    assert fused(spark, ["A"], [], 0)[0]["fused_score"] == pytest.approx(0.5)


def test_normalised(spark):
    out = spark.range(1).select(retrieval.normalised(F.lit(2 / 61)).alias("a"), retrieval.normalised(F.lit(1 / 61)).alias("b")).first()
    assert (out.a, out.b) == (pytest.approx(1.0), pytest.approx(0.5))


def hits(spark):
    return spark.createDataFrame([(1, "a", 1, 0.9), (1, "b", 2, 0.8), (1, "c", 3, 0.7)], "query_id int, id string, pre_rank int, score double")


def results(spark, rows):
    return spark.createDataFrame([(1, i, x) for i, x in rows], "query_id int, index int, relevance double")


@pytest.mark.parametrize("bad", [[(0, 0.1), (1, 0.5)], [(0, 0.1), (1, 0.5), (1, 0.4)], [(0, 0.1), (1, 0.5), (3, 0.4)], [(0, 0.1), (1, 0.5), (2, 1.4)], [(0, 0.1), (1, 0.5), (2, None)], [(0, 0.1), (1, 0.5), (2, 0.4), (2, 0.4)]])
def test_a_faulty_rerank_degrades_the_request(spark, bad):
    out = retrieval.apply_rerank(hits(spark), results(spark, bad)).orderBy("pre_rank").collect()
    assert [(r.id, r.score, r.rerank_rank, r.rerank_degraded) for r in out] == [("a", 0.9, None, True), ("b", 0.8, None, True), ("c", 0.7, None, True)]


def test_a_rerank_orders_by_relevance_then_place(spark):
    out = retrieval.apply_rerank(hits(spark), results(spark, [(0, 0.2), (1, 0.6), (2, 0.6)])).orderBy("rerank_rank").collect()
    assert [(r.id, r.score) for r in out] == [("b", 0.6), ("c", 0.6), ("a", 0.2)]


def test_context_is_cut_at_the_budget(spark):
    h = spark.createDataFrame([(1, "a-c0001", 1, 0.9, "标题甲", "x" * 30), (1, "b", 2, 0.5, None, "y" * 30)], "query_id int, id string, final_rank int, score double, title string, content string").withColumn("passed", F.lit(True))
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    one, none = answer.pack(h, q, 40).orderBy("query_id").collect()
    assert one.truncated and one.char_count <= 40 and one.ids[0] == "a-c0001"
    assert (none.context, none.ids, none.truncated) == ("（无相关资料）", [], False)


def test_context_ending_at_the_budget_is_whole(spark):
    h = spark.createDataFrame([(1, "a", 1, 0.9, "t", "xyz", True), (1, "b", 2, 0.2, "u", "not passed", False)], "query_id int, id string, final_rank int, score double, title string, content string, passed boolean")
    full = len("【文档 1】t\nxyz\n\n")
    out = answer.pack(h, h.select("query_id"), full).first()
    assert out.context == "【文档 1】t\nxyz" and not out.truncated


def test_decisions(spark):
    rows = [("off", False, 1, 0.1, None, None, True), ("none", True, 0, None, None, None, True), ("low", True, 1, 0.2, True, None, True), ("yes", True, 1, 0.9, True, None, True), ("no", True, 1, 0.9, False, None, True), ("shut", True, 1, 0.9, None, "TIMEOUT", True), ("open", True, 1, 0.9, None, "TIMEOUT", False)]
    r = spark.createDataFrame(rows, "query_id string, enabled boolean, n int, top double, judge_answer boolean, judge_failure string, fail_closed boolean").withColumns({"mode": F.lit("HYBRID"), "applied": F.lit(False)})
    out = {x.query_id: x for x in answer.gate(r).collect()}
    assert {k: (v.decision, v.answerable) for k, v in out.items()} == {
        "off": ("ANSWERABILITY_DISABLED", False), "none": ("NO_HITS", False), "low": ("LOW_SCORE_REFUSAL", False), "yes": ("JUDGE_ACCEPT", True), "no": ("JUDGE_REFUSE", False), "shut": ("JUDGE_DEGRADED", False), "open": ("JUDGE_DEGRADED", True),
    }
    assert answer.invariant_errors(answer.gate(r)).count() == 0


def test_confusion_of_the_published_counts(spark):
    rows = [(True, False)] * 60 + [(False, False)] + [(True, True)] + [(False, True)] * 16
    out = evaluation.confusion(spark.createDataFrame(rows, "answerable boolean, refused boolean")).first()
    assert (out.tp, out.fp, out.fn, out.tn) == (60, 1, 1, 16)
    assert (out.false_answer_rate, out.false_refusal_rate, out.refusal_accuracy) == (0.0588, 0.0164, 0.9744)


def test_rates_without_denominators_are_null(spark):
    out = evaluation.confusion(spark.createDataFrame([(True, False)], "answerable boolean, refused boolean")).first()
    assert out.false_answer_rate is None and out.false_refusal_rate == 0.0


def test_rank_metrics_of_the_published_ranks(spark):
    rows = [(1, 1, 1)] * 58 + [(1, 1, 2)] * 3
    out = evaluation.rank_metrics(spark.createDataFrame(rows, "total int, covered int, first_rank int")).first()
    assert (out.hit_at_1, out.hit_at_3, out.mrr) == (0.9508, 1.0, 0.9754)
    none = evaluation.rank_metrics(spark.createDataFrame([(1, 0, None)], "total int, covered int, first_rank int")).first()
    assert none.mrr is None and none.hit_at_1 == 0.0


def test_stages(spark):
    e = spark.createDataFrame([(1, "e1"), (1, "e2")], "query_id int, id string")
    stages = {"vector": ["e1", "e2", "x1"], "bm25": ["x1", "e1"], "union": ["e1", "e2", "x1"], "fused": ["e1", "x1", "e2"], "pre_rerank": ["e1", "x1", "e2"], "reranked": ["x1", "e1", "e2"]}
    t = spark.createDataFrame([(1, s, i, r) for s, ids in stages.items() for r, i in enumerate(ids, 1)], "query_id int, stage string, id string, rank int")
    out = {r.stage: r.recall for r in evaluation.stage_recall(e, t).collect()}
    assert out["vector"] == out["union"] == out["fused"] == out["reranked"] == 1.0
    assert tuple(evaluation.rerank_effect(e, t).first()) == (0, 1, 1)


def test_evidence_by_any_anchor(spark):
    e = spark.createDataFrame([(1, 1, "h9", None, None, "t2"), (1, 2, None, " ", None, None), (1, 3, None, "c1", None, None)], "query_id int, evidence_id int, content_hash string, chunk_id string, title_path string, anchor_path string")
    h = spark.createDataFrame([(1, 1, "h1", "c1", "t1"), (1, 2, "h2", "c2", "t2"), (1, 3, "h9", "c3", "t3")], "query_id int, rank int, content_hash string, chunk_id string, title_path string")
    assert {r.evidence_id: r.first_rank for r in evaluation.match_evidence(e, h).collect()} == {1: 2, 2: None, 3: 1}


def test_event_streams(spark):
    b = spark.createDataFrame([(1, ": ping\n\nevent: stage\ndata: a\ndata: b\n\ndata:c\n\nevent: x\n\n")], "stream_id int, body string")
    assert [(r.event, r.data) for r in catalog.parse_events(b).orderBy("i").collect()] == [("stage", "a\nb"), ("message", "c")]
    e = spark.createDataFrame([(1, 1, "stage"), (1, 2, "token"), (1, 3, "citations"), (1, 4, "done"), (2, 1, "token"), (2, 2, "citations"), (2, 3, "error"), (3, 1, "canceled")], "stream_id int, seq int, event string")
    assert {r.stream_id: r.valid for r in catalog.grammar(e).collect()} == {1: True, 2: False, 3: True}


def test_vector_search_handles_nulls_and_no_queries(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "id long, vector array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, vector array<float>")
    assert [(r.query_id, r.id, r.score) for r in retrieval.vector(v, q, 1).collect()] == [(1, 1, 1.0)]
    assert retrieval.vector(v, q.limit(0), 1).count() == 0


def test_admission_against_a_plain_queue(spark):
    import random

    r = random.Random(3)
    rows = [(i % 3, i, r.randrange(5000), r.randrange(1, 700)) for i in range(600)]
    for permits, wait in ((2, 0), (4, 500), (1, 300)):
        want = {}
        for server in range(3):
            free = [-1] * permits
            for _, i, start, takes in sorted((x for x in rows if x[0] == server), key=lambda x: (x[2], x[1])):
                at = max(start, min(free))
                want[i] = at if at - start <= wait else None
                if want[i] is not None:
                    free[free.index(min(free))] = at + takes
        out = catalog.admission(spark.createDataFrame(rows, "server long, id long, start_ms long, duration_ms long"), permits, wait).collect()
        assert {x.id: x.started_ms for x in out} == want and all(x.admitted == (x.started_ms is not None) for x in out)


def test_activation_and_index_checks(spark):
    v = spark.createDataFrame([(1, 1, "COMPLETED", False), (2, 1, "PROCESSING", True), (3, 3, "COMPLETED", True)], "doc_id int, root_id int, status string, is_active boolean")
    out, errors = catalog.activate(v, spark.createDataFrame([(1,), (9,)], "doc_id int"))
    assert {r.doc_id: r.is_active for r in out.collect()} == {1: True, 2: False, 3: True}
    assert [tuple(r) for r in errors.collect()] == [(9, None, "NOT_FOUND")]
    assert [r.error for r in catalog.activate(v, spark.createDataFrame([(2,)], "doc_id int"))[1].collect()] == ["STATUS_NOT_ACTIVATABLE"]
    c = spark.createDataFrame([(1, "a", [1.0, 2.0]), (1, "b", None), (2, "c", [1.0]), (3, "d", [1.0, 2.0])], "doc_id int, chunk_id string, vector array<double>")
    assert sorted((r.doc_id, r.error) for r in catalog.index_errors(c, 2).collect()) == [(1, "COUNT_MISMATCH"), (2, "DIMENSION_MISMATCH")]


def test_rewrites(spark):
    from quern.operators.answer import parse_rewrite

    rows = ['{"rewritten": true, "query": "a \\"b\\" c"}', '{"rewritten": true, "query": " "}', '{"rewritten": true, "query": 5}', '{"rewritten": false}', "", None, '{"rewritten": 1, "query": "x"}', "{broken"]
    out = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, raw string").select("i", parse_rewrite("raw").alias("r")).orderBy("i").collect()
    assert [(x.r.rewritten, x.r.query, x.r.failure is None) for x in out] == [(True, 'a "b" c', True), (False, None, False), (False, None, False), (False, None, True), *[(False, None, False)] * 4]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from quern import shared

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session())
