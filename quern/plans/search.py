"""Queries of search and answering, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import answer, evaluation, retrieval
from quern.plans.base import DOCUMENTS, FINAL, FUSED, LEXICAL, PRE, RERANKED, VECTOR, Search, active, documents, lexical_channel, question_vectors, questions, table, vector_channel, vectors

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def chain(*parts: str) -> str:
    return "WITH " + ",".join(parts)


TO_FUSED, TO_PRE = (VECTOR, LEXICAL, FUSED), (VECTOR, LEXICAL, FUSED, PRE)
TO_FINAL = (*TO_PRE, RERANKED, FINAL)
_HITS = "query_id, id, vector_rank, bm25_rank, fused_rank, rerank_rank, final_rank, score, passed"


@query(chain(*TO_FINAL) + f" SELECT {_HITS} FROM top")
def mode_hybrid_rerank(spark, sf):
    return Search(spark, sf).top.select(*_HITS.split(", "))


@query(chain(*TO_PRE) + ", top AS (SELECT *, pre_rank AS final_rank, score >= 0.30 AS passed FROM pre WHERE pre_rank <= 6) SELECT query_id, id, vector_rank, bm25_rank, fused_rank, final_rank, score, passed FROM top")
def mode_hybrid(spark, sf):
    return Search(spark, sf, "HYBRID").top.select("query_id", "id", "vector_rank", "bm25_rank", "fused_rank", "final_rank", "score", "passed")


@query(chain(VECTOR) + ", pre AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS final_rank FROM vec WHERE id % 3 <> 0) SELECT query_id, id, rank AS vector_rank, final_rank, score, score >= 0.30 AS passed FROM pre WHERE final_rank <= 6")
def mode_vector(spark, sf):
    return Search(spark, sf, "VECTOR").top.select("query_id", "id", "vector_rank", "final_rank", "score", "passed")


@query(chain(LEXICAL) + " SELECT query_id, id, score, rank FROM lex")
def bm25_topk(spark, sf):
    return lexical_channel(spark, sf)


@query(chain(LEXICAL) + " SELECT doc_id, dl AS length, term, tf FROM post")
def postings(spark, sf):
    return retrieval.postings(table(spark, sf, "documents"), questions(spark, sf))[0]


@query(chain(LEXICAL) + " SELECT term, df, n, round(avgdl, 6) AS avgdl FROM dfs CROSS JOIN stats")
def df_stats(spark, sf):
    return retrieval.document_frequencies(table(spark, sf, "documents"), questions(spark, sf)).withColumn("avgdl", F.round("avgdl", 6))


@query(chain(VECTOR) + " SELECT query_id, id, score, rank FROM vec")
def vector_topk(spark, sf):
    return vector_channel(spark, sf)


@query(chain(VECTOR) + " SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vpairs WHERE qkb = vkb) WHERE rank <= 30")
def vector_topk_kb(spark, sf):
    return retrieval.vector(vectors(spark, sf), question_vectors(spark, sf), tenant=True)


@query(chain(*TO_FUSED) + " SELECT query_id, id, vector_rank, vector_score, bm25_rank, bm25_score, fused_score, fused_rank FROM fused")
def rrf_fuse(spark, sf):
    return retrieval.fuse(vector_channel(spark, sf), lexical_channel(spark, sf))


@query(chain(*TO_FUSED) + " SELECT query_id, id, round(least(1.0, fused_score / (2.0::DOUBLE / 61)), 6) AS normalised FROM fused")
def rrf_normalize(spark, sf):
    f = retrieval.fuse(vector_channel(spark, sf), lexical_channel(spark, sf))
    return f.select("query_id", "id", F.round(retrieval.normalised(F.col("fused_score")), 6).alias("normalised"))


@query(chain(VECTOR) + ", dup AS (SELECT query_id, id, rank, score FROM vec UNION ALL SELECT query_id, id, rank + 30, score FROM vec) SELECT query_id, id, min(rank) AS rank, arg_min(score, rank) AS score FROM dup GROUP BY ALL")
def first_occurrence_rank(spark, sf):
    v = vector_channel(spark, sf)
    return retrieval.first_ranks(v.unionByName(v.withColumn("rank", F.col("rank") + 30)))


@query(chain(*TO_PRE) + " SELECT query_id, id, fused_rank, pre_rank, score FROM pre")
def validity_filter(spark, sf):
    return Search(spark, sf).pre.select("query_id", "id", "fused_rank", "pre_rank", "score")


@query(chain(*TO_PRE, RERANKED) + " SELECT query_id, id, pre_rank, rerank_score, rerank_rank FROM reranked")
def rerank(spark, sf):
    return Search(spark, sf).after.select("query_id", "id", "pre_rank", "rerank_score", "rerank_rank")


@query(chain(*TO_PRE) + ", n AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM pre), r AS (SELECT *, CASE WHEN query_id % 2 = 0 THEN pre_rank / n END AS rerank_score FROM n) SELECT query_id, id, pre_rank, round(rerank_score, 6) AS rerank_score, CASE WHEN query_id % 2 = 0 THEN row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, pre_rank) END AS rerank_rank, query_id % 2 <> 0 AS rerank_degraded, round(coalesce(rerank_score, score), 6) AS score FROM r")
def rerank_degraded(spark, sf):
    pre = Search(spark, sf).pre
    n = pre.groupBy("query_id").agg(F.count("*").alias("n"))
    made = pre.join(n, "query_id").select("query_id", (F.col("pre_rank") - 1).alias("index"), (F.col("pre_rank") / F.col("n")).alias("relevance"))
    # Answers of odd questions lack their first place.
    out = retrieval.apply_rerank(pre, made.where((F.col("query_id") % 2 == 0) | (F.col("index") > 0)))
    return out.select("query_id", "id", "pre_rank", F.round("rerank_score", 6).alias("rerank_score"), "rerank_rank", "rerank_degraded", F.round("score", 6).alias("score"))


@query(chain(*TO_PRE) + " SELECT query_id, count(*) AS n, false AS rerank_applied FROM pre GROUP BY query_id")
def rerank_noop(spark, sf):
    after = retrieval.no_rerank(Search(spark, sf).pre)
    return after.groupBy("query_id").agg(F.count("*").alias("n"), F.max(F.col("rerank_rank").isNotNull()).alias("rerank_applied"))


_TRACE = """, un AS (SELECT query_id, id, min(o) AS o FROM (SELECT query_id, id, rank AS o FROM vec UNION ALL SELECT query_id, id, rank + 1000000000 FROM lex) GROUP BY ALL),
trace AS (SELECT query_id, 'vector' AS stage, id, rank FROM vec UNION ALL SELECT query_id, 'bm25', id, rank FROM lex UNION ALL SELECT query_id, 'union', id, row_number() OVER (PARTITION BY query_id ORDER BY o, id) FROM un
 UNION ALL SELECT query_id, 'fused', id, fused_rank FROM fused UNION ALL SELECT query_id, 'pre_rerank', id, pre_rank FROM pre UNION ALL SELECT query_id, 'reranked', id, rerank_rank FROM reranked UNION ALL SELECT query_id, 'final', id, final_rank FROM top)"""


@query(chain(*TO_FINAL) + _TRACE + " SELECT query_id, stage, id, rank FROM trace")
def stage_trace(spark, sf):
    return Search(spark, sf, reuse=True).trace


@query(chain(*TO_FINAL) + _TRACE + " SELECT query_id, id, " + ", ".join(f"min(rank) FILTER (stage = '{s}') AS \"{s}\"" for s in retrieval.STAGES) + " FROM trace GROUP BY query_id, id")
def stage_ranks_pivot(spark, sf):
    return retrieval.stage_ranks(Search(spark, sf, reuse=True).trace)


@query(chain(*TO_FINAL) + """ SELECT query_id, id, CASE WHEN rerank_rank <> fused_rank THEN '重排调整：融合 #' || fused_rank || ' → 重排 #' || rerank_rank
 WHEN fused_rank <> vector_rank THEN 'RRF 融合调整：向量 #' || vector_rank || coalesce(' · BM25 #' || bm25_rank, '') || ' → 融合 #' || fused_rank
 WHEN bm25_rank IS NOT NULL AND vector_rank IS NULL THEN '仅 BM25 通道召回：BM25 #' || bm25_rank WHEN vector_rank IS NOT NULL AND bm25_rank IS NULL THEN '仅向量通道召回：向量 #' || vector_rank END AS reason FROM top""")
def rank_change_reason(spark, sf):
    return Search(spark, sf).top.select("query_id", "id", retrieval.rank_reason().alias("reason"))


_PACK = """, h AS (SELECT t.query_id, t.id, t.final_rank, t.score, '【文档 ' || row_number() OVER w || '】' || d.source || '.md' || chr(10) || d.text || chr(10) || chr(10) AS part, row_number() OVER w AS i
   FROM top t JOIN documents d ON d.doc_id = t.id WHERE t.passed WINDOW w AS (PARTITION BY t.query_id ORDER BY t.score DESC, t.final_rank)),
e AS (SELECT *, sum(length(part)) OVER (PARTITION BY query_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS stop FROM h),
c AS (SELECT *, stop - length(part) AS start FROM e),
packed AS (SELECT query_id, regexp_replace(string_agg(substr(part, 1, CAST(6000 - start AS INT)), '' ORDER BY i) FILTER (start < 6000), '\\s+$', '') AS context, string_agg(CAST(id AS VARCHAR), ',' ORDER BY i) FILTER (start < 6000) AS ids, bool_or(stop > 6000) AS truncated FROM c GROUP BY query_id)"""


def _packed(spark, sf, s):
    texts = s.docs.select(F.col("doc_id").alias("id"), F.concat("source", F.lit(".md")).alias("title"), F.col("text").alias("content"))
    return answer.pack(s.top.join(texts, "id"), s.queries)


@query(chain(*TO_FINAL) + _PACK + " SELECT b.item_id AS query_id, sha256(coalesce(context, '（无相关资料）')) AS context_sha, CAST(length(coalesce(context, '（无相关资料）')) AS INT) AS char_count, coalesce(ids, '') AS ids, coalesce(truncated, false) AS truncated FROM benchmark b LEFT JOIN packed p ON p.query_id = b.item_id")
def context_pack(spark, sf):
    p = _packed(spark, sf, Search(spark, sf))
    return p.select("query_id", F.sha2(F.col("context").cast("binary"), 256).alias("context_sha"), "char_count", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "truncated")


@query(chain(*TO_FINAL) + """, n AS (SELECT query_id, count(*) AS n, bool_or(passed) AS p, max(t) AS t FROM (SELECT query_id, passed, coalesce(sum(length(part)) FILTER (passed) OVER (PARTITION BY query_id) > 6000, false) AS t FROM (
  SELECT t.query_id, t.passed, '【文档 ' || row_number() OVER (PARTITION BY t.query_id, t.passed ORDER BY t.score DESC, t.final_rank) || '】' || d.source || '.md' || chr(10) || d.text || chr(10) || chr(10) AS part FROM top t JOIN documents d ON d.doc_id = t.id)) GROUP BY query_id)
 SELECT b.item_id AS query_id, concat_ws(',', CASE WHEN b.item_id % 4 = 0 THEN 'RERANK_DEGRADED' END, CASE WHEN n IS NULL THEN 'NO_HITS' END, CASE WHEN NOT p THEN 'ALL_BELOW_THRESHOLD' END, CASE WHEN t THEN 'CONTEXT_TRUNCATED' END) AS issues FROM benchmark b LEFT JOIN n ON n.query_id = b.item_id""")
def debug_issues(spark, sf):
    s = Search(spark, sf, reuse=True)
    return answer.issues(s.queries, s.top, _packed(spark, sf, s), s.queries.where("query_id % 4 = 0"))


@query(chain(*TO_FINAL) + " SELECT query_id, final_rank, id, CASE WHEN id % 5 = 0 THEN '' ELSE d.source || '.md' END AS doc_name, coalesce(vector_score, bm25_score) AS channel_score FROM top JOIN documents d ON d.doc_id = id WHERE passed")
def citations(spark, sf):
    return answer.citations(Search(spark, sf).top, active(spark, sf).where("doc_id % 5 <> 0"))


_TOPS = ", q AS (SELECT b.item_id AS query_id, count(t.id) AS n, max(t.score) AS top FROM benchmark b LEFT JOIN top t ON t.query_id = b.item_id AND b.item_id % 6 <> 0 GROUP BY b.item_id)"


def _requests(spark, sf):
    s = Search(spark, sf)
    h = s.top.where("query_id % 6 <> 0").groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("top"), F.max(F.col("rerank_rank").isNotNull()).alias("applied"))
    r = s.queries.select("query_id").join(h, "query_id", "left")
    i = F.col("query_id")
    return r.select(
        "query_id", (i % 5 != 0).alias("enabled"), F.lit("HYBRID_RERANK").alias("mode"), F.coalesce("applied", F.lit(False)).alias("applied"), F.coalesce("n", F.lit(0)).alias("n"), "top", (i % 3 == 0).alias("judge_answer"),
        F.when(i % 4 == 1, "TIMEOUT").alias("judge_failure"), (i % 8 == 1).alias("fail_closed"),
    )


@query(chain(*TO_FINAL) + _TOPS + " SELECT query_id, coalesce(top, 0.0) AS top, CASE WHEN n > 0 THEN 0.75 ELSE 0.30 END::DOUBLE AS threshold, n = 0 OR coalesce(top, 0) < CASE WHEN n > 0 THEN 0.75 ELSE 0.30 END AS insufficient FROM q")
def refusal_policy(spark, sf):
    r = _requests(spark, sf)
    limit = answer.threshold(F.col("mode"), F.col("applied")).cast("double")
    return r.select("query_id", F.coalesce("top", F.lit(0.0)).alias("top"), limit.alias("threshold"), answer.insufficient(F.col("mode"), F.col("applied"), F.col("top"), F.col("n"), F.lit(True)).alias("insufficient"))


_GATE = _TOPS + """, g AS (SELECT *, CASE WHEN query_id % 5 = 0 THEN 'ANSWERABILITY_DISABLED' WHEN n = 0 THEN 'NO_HITS' WHEN top < 0.75 THEN 'LOW_SCORE_REFUSAL' WHEN query_id % 4 = 1 THEN 'JUDGE_DEGRADED' WHEN query_id % 3 = 0 THEN 'JUDGE_ACCEPT' ELSE 'JUDGE_REFUSE' END AS decision FROM q),
gate AS (SELECT query_id, decision, CASE decision WHEN 'ANSWERABILITY_DISABLED' THEN NOT (n = 0 OR top < 0.75) WHEN 'JUDGE_DEGRADED' THEN query_id % 8 <> 1 ELSE decision = 'JUDGE_ACCEPT' END AS answerable, decision LIKE 'JUDGE%' AS judge_invoked, decision = 'JUDGE_DEGRADED' AS degraded,
 CASE WHEN decision = 'JUDGE_DEGRADED' THEN 'TIMEOUT' END AS failure_type, printf('%.3f', floor(coalesce(top, 0.0) * 1000 + 0.5) / 1000) AS top_text, CASE WHEN n > 0 THEN '0.75' ELSE '0.30' END AS threshold_text FROM g)"""


@query(chain(*TO_FINAL) + _GATE + " SELECT * FROM gate")
def answerability_gate(spark, sf):
    return answer.gate(_requests(spark, sf))


@query(chain(*TO_FINAL) + _GATE + " SELECT count(*) AS decisions, count(*) FILTER (degraded <> (failure_type IS NOT NULL)) AS errors FROM gate")
def decision_invariant(spark, sf):
    g = answer.gate(_requests(spark, sf))
    return g.agg(F.count("*").alias("decisions"), F.count_if(F.col("degraded") != F.col("failure_type").isNotNull()).alias("errors"))


def holding(docs, asked):
    """docs (doc_id, text) with each query_id of asked (query_id, text) whose text they hold, and that text as passage.

    A passage's longest inner word, with a blank or line feed on either side, is
    a whole word of every text that holds it, so it is the key of a join. Words
    at its ends are not: in a text they may go on. A passage without inner words
    has the empty key, which all texts have.
    """
    pieces = F.split("text", r"[ \n]", -1)
    inner = F.filter(F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0))), lambda x: x != "")
    longest = F.array_max(F.transform(inner, lambda x: F.struct(F.length(x).alias("n"), x.alias("word"))))["word"]
    keyed = asked.where("text is not null").select("query_id", F.col("text").alias("passage"), F.coalesce(longest, F.lit("")).alias("word"))
    keys = sorted(r.word for r in keyed.select("word").distinct().collect())
    words = F.array_union(F.array_intersect(pieces, F.array(*map(F.lit, keys)).cast("array<string>")), F.array(F.lit("")))
    return docs.select("doc_id", "text", F.explode(words).alias("word")).where(F.col("word").isin(keys)).join(keyed, "word").where(F.contains("text", "passage"))


@query(chain(*TO_FUSED) + ", e AS (SELECT b.item_id AS query_id, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), m AS (SELECT e.query_id, e.id AS evidence_id, f.fused_rank FROM e LEFT JOIN fused f ON f.query_id = e.query_id AND f.id = e.id) SELECT query_id, evidence_id, fused_rank AS first_rank FROM m")
def evidence_match(spark, sf):
    return _matched(spark, sf).select("query_id", "evidence_id", "first_rank")


def _evidence(spark, sf):
    """(query_id, evidence_id, anchors): documents that hold a question's text."""
    near = holding(table(spark, sf, "documents").select("doc_id", "text"), questions(spark, sf))
    none = F.lit(None).cast("string")
    return near.select("query_id", F.col("doc_id").alias("evidence_id"), none.alias("content_hash"), F.col("doc_id").cast("string").alias("chunk_id"), none.alias("title_path"), none.alias("anchor_path"))


def _matched(spark, sf):
    f = retrieval.fuse(vector_channel(spark, sf), lexical_channel(spark, sf))
    none = F.lit(None).cast("string")
    hits = f.select("query_id", F.col("fused_rank").alias("rank"), F.col("id").cast("string").alias("chunk_id"), none.alias("content_hash"), none.alias("title_path"))
    return evaluation.match_evidence(_evidence(spark, sf), hits)


_ITEMS = ", e AS (SELECT b.item_id AS query_id, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), items AS (SELECT e.query_id, count(*) AS total, count(f.fused_rank) AS covered, min(f.fused_rank) AS first_rank FROM e LEFT JOIN fused f ON f.query_id = e.query_id AND f.id = e.id GROUP BY e.query_id)"
_R4 = "floor(({0})::DOUBLE * 1e4 + 0.5) / 1e4"


@query(chain(*TO_FUSED) + _ITEMS + " SELECT count(*) AS answerable, " + ", ".join(f"{_R4.format(f'count(*) FILTER (first_rank <= {k}) / count(*)')} AS hit_at_{k}" for k in (1, 3, 5)) + f", {_R4.format('sum(1.0::DOUBLE / first_rank) / count(*)')} AS mrr, {_R4.format('sum(covered) / sum(total)')} AS recall, {_R4.format('avg(covered / total)')} AS coverage_macro, {_R4.format('avg(CASE WHEN covered = total THEN 1.0 ELSE 0 END)')} AS full_coverage FROM items")
def rank_metrics(spark, sf):
    return evaluation.rank_metrics(evaluation.per_item(_matched(spark, sf)))


@query(chain(*TO_FUSED) + _ITEMS + " SELECT slot, count(*) AS n FROM (SELECT CASE WHEN first_rank IS NULL THEN 'not_found' WHEN first_rank <= 5 THEN 'rank' || first_rank END AS slot FROM items) WHERE slot IS NOT NULL GROUP BY slot")
def rank_distribution(spark, sf):
    return evaluation.rank_distribution(evaluation.per_item(_matched(spark, sf)))


@query(chain(*TO_FUSED) + _ITEMS + ", m AS (SELECT *, CASE query_id % 3 WHEN 0 THEN 'SINGLE_CHUNK' WHEN 1 THEN 'MULTI_CHUNK' ELSE 'FOLLOW_UP' END AS evidence_mode, query_id % 7 = 0 AS refused FROM items) SELECT evidence_mode, count(*) AS n, " + ", ".join(f"{_R4.format(f'count(*) FILTER (first_rank <= {k}) / count(*)')} AS hit_at_{k}" for k in (1, 3, 5)) + f", {_R4.format('coalesce(sum(1.0::DOUBLE / first_rank), 0) / count(*)')} AS mrr, {_R4.format('count(*) FILTER (covered = total) / count(*)')} AS full_coverage, {_R4.format('sum(covered) / sum(total)')} AS recall, count(*) FILTER (refused) AS refused, {_R4.format('count(*) FILTER (refused) / count(*)')} AS false_refusal_rate FROM m GROUP BY evidence_mode")
def evidence_mode_breakdown(spark, sf):
    mode = F.when(F.col("query_id") % 3 == 0, "SINGLE_CHUNK").when(F.col("query_id") % 3 == 1, "MULTI_CHUNK").otherwise("FOLLOW_UP")
    return evaluation.evidence_modes(evaluation.per_item(_matched(spark, sf)).withColumns({"evidence_mode": mode, "refused": F.col("query_id") % 7 == 0}))


_REL = ", e AS (SELECT DISTINCT b.item_id AS query_id, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query(chain(*TO_FINAL) + _TRACE + _REL + f", t AS (SELECT query_id, count(*) AS total FROM e GROUP BY 1), s AS (SELECT unnest(['vector', 'bm25', 'union', 'fused', 'reranked']) AS stage), f AS (SELECT query_id, stage, count(DISTINCT id) AS found FROM trace JOIN e USING (query_id, id) GROUP BY ALL) SELECT s.stage, count(*) AS items, count(*) FILTER (found = total) AS recalled, {_R4.format('count(*) FILTER (found = total) / count(*)')} AS recall FROM t CROSS JOIN s LEFT JOIN f ON f.query_id = t.query_id AND f.stage = s.stage GROUP BY s.stage")
def stage_recall(spark, sf):
    rel = _evidence(spark, sf).select("query_id", F.col("evidence_id").alias("id"))
    return evaluation.stage_recall(rel, Search(spark, sf, reuse=True).trace)


@query(chain(*TO_FINAL) + _REL + " SELECT count(*) FILTER (rerank_rank < pre_rank) AS promoted, count(*) FILTER (rerank_rank IS NULL OR rerank_rank > pre_rank) AS degraded, count(*) FILTER (rerank_rank = pre_rank) AS stable FROM e JOIN reranked USING (query_id, id)")
def rerank_effect(spark, sf):
    rel = _evidence(spark, sf).select("query_id", F.col("evidence_id").alias("id"))
    return evaluation.rerank_effect(rel, Search(spark, sf, reuse=True).trace)


@query(chain(*TO_FUSED) + ", a AS (SELECT query_id AS seq, min(rank) AS base_rank FROM vec WHERE id % 2 = 0 GROUP BY 1), b AS (SELECT query_id AS seq, min(fused_rank) AS rank FROM fused WHERE id % 2 = 0 AND query_id % 5 <> 0 GROUP BY 1), c AS (SELECT a.seq, base_rank, rank, CASE WHEN b.seq IS NULL THEN 'unknown' WHEN rank < base_rank THEN 'better' WHEN rank > base_rank THEN 'worse' ELSE 'flat' END AS change FROM a LEFT JOIN b USING (seq)) SELECT *, CAST(CASE change WHEN 'worse' THEN 0 WHEN 'better' THEN 1 WHEN 'flat' THEN 2 ELSE 3 END AS INT) AS \"order\" FROM c")
def run_compare(spark, sf):
    v = vector_channel(spark, sf)
    f = retrieval.fuse(v, lexical_channel(spark, sf))
    best = lambda d, r: d.where("id % 2 = 0").groupBy(F.col("query_id").alias("seq")).agg(F.min(r).alias("first_rank"))
    return evaluation.compare_runs(best(v, "rank"), best(f.where("query_id % 5 <> 0"), "fused_rank"))


@query(chain(*TO_FUSED) + ", un AS (SELECT query_id, id, min(o) AS o FROM (SELECT query_id, id, rank AS o FROM vec UNION ALL SELECT query_id, id, rank + 1000000000 FROM lex) GROUP BY ALL) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY o, id) AS rank FROM un")
def union_channels(spark, sf):
    return retrieval.union_candidates(vector_channel(spark, sf), lexical_channel(spark, sf))


@query(f"WITH {DOCUMENTS} SELECT b.item_id AS query_id, coalesce(r.rewrite, '') <> '' AND length(r.rewrite) <= 200 AND b.item_id % 3 <> 0 AS used FROM benchmark b LEFT JOIN (SELECT item_id, CASE WHEN item_id % 4 = 0 THEN '' WHEN item_id % 4 = 1 THEN repeat('x', 201) ELSE 'again: ' || substr(text, 1, 50) END AS rewrite FROM benchmark) r USING (item_id)")
def rewrite_trigger(spark, sf):
    i = F.col("query_id")
    text = F.when(i % 4 == 0, "").when(i % 4 == 1, F.repeat(F.lit("x"), F.lit(201))).otherwise(F.concat(F.lit("again: "), F.substring("text", 1, 50)))
    _, how = answer.effective_query(F.col("text"), F.when(i % 3 == 0, 0).otherwise(2), F.lit(True), F.lit(True), text)
    return questions(spark, sf).select("query_id", (how == "REWRITTEN").alias("used"))


__all__ = ["QUERIES", "SQL", "documents"]
