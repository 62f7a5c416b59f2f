"""Domain tables from the driver's tables, as DataFrames and as SQL common table expressions.

A document's knowledge base is its language, its name its source, and documents
come in the order of their ids. Questions are the benchmark's items; question i
has the vector of vec_id i, and document i that of vec_id i.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import retrieval
from quern.shared import cut


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    kind = F.when(F.col("doc_id") % 7 == 0, "CSV").otherwise("MD")
    status = F.when(F.col("doc_id") % 5 == 0, "FAILED").otherwise("COMPLETED")
    return d.select("doc_id", F.col("lang").alias("kb_id"), F.concat("source", F.lit(".md")).alias("name"), kind.alias("file_type"), status.alias("status"), "text", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


DOCUMENTS = "document AS (SELECT doc_id, lang AS kb_id, source || '.md' AS name, CASE WHEN doc_id % 7 = 0 THEN 'CSV' ELSE 'MD' END AS file_type, CASE WHEN doc_id % 5 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status, text, sha256(text) AS sha FROM documents)"


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return v.join(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("kb_id")), "id")


def question_vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    kb = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.col("lang").alias("kb_id"))
    return questions(spark, sf).select("query_id").join(v, "query_id").join(kb, "query_id", "left")


def vector_channel(spark: SparkSession, sf: str, k: int = retrieval.CANDIDATES, tenant: bool = False) -> DataFrame:
    return retrieval.vector(vectors(spark, sf), question_vectors(spark, sf), k, tenant)


def lexical_channel(spark: SparkSession, sf: str, k: int = retrieval.CANDIDATES) -> DataFrame:
    return retrieval.bm25(table(spark, sf, "documents"), questions(spark, sf), k)


_WORDS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"

VECTOR = """
vpairs AS (SELECT q.item_id AS query_id, v.vec_id AS id, qd.lang AS qkb, vd.lang AS vkb,
    round((1 + list_cosine_similarity(CAST(qv.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))) / 2, 6) AS score
  FROM benchmark q JOIN embeddings qv ON qv.vec_id = q.item_id LEFT JOIN documents qd ON qd.doc_id = q.item_id
  CROSS JOIN embeddings v JOIN documents vd ON vd.doc_id = v.vec_id),
vec AS (SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vpairs) WHERE rank <= 30)"""

LEXICAL = f"""
tok AS (SELECT doc_id, {_WORDS.format("text")} AS ts FROM documents),
qterm AS (SELECT DISTINCT item_id AS query_id, unnest({_WORDS.format("text")}) AS term FROM benchmark),
stats AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tok),
post AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM tok) WHERE term IN (SELECT term FROM qterm) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
lscore AS (SELECT q.query_id, p.doc_id AS id, round(sum(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * p.tf / (p.tf + 1.2 * (1 - 0.75 + 0.75 * p.dl / s.avgdl))), 6) AS score
  FROM qterm q JOIN dfs d USING (term) JOIN post p USING (term) CROSS JOIN stats s GROUP BY ALL),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM lscore) WHERE rank <= 30)"""

FUSED = """
both_ AS (SELECT coalesce(v.query_id, l.query_id) AS query_id, coalesce(v.id, l.id) AS id, v.rank AS vector_rank, v.score AS vector_score, l.rank AS bm25_rank, l.score AS bm25_score,
    round(coalesce(1 / (60.0::DOUBLE + v.rank), 0) + coalesce(1 / (60.0::DOUBLE + l.rank), 0), 9) AS fused_score
  FROM vec v FULL OUTER JOIN lex l ON v.query_id = l.query_id AND v.id = l.id),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, coalesce(vector_rank, bm25_rank + 1000000000), id) AS fused_rank FROM both_)"""

#: Documents whose id is a multiple of three are taken as inactive versions.
PRE = """
cand AS (SELECT *, coalesce(vector_score, 0.0) AS score FROM fused WHERE fused_rank <= 30),
pre AS (SELECT c.*, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS pre_rank FROM cand c WHERE id IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0))"""

RERANKED = f"""
scored AS (SELECT p.* EXCLUDE (score), round(coalesce(len(list_intersect(qw, dw)) / len(qw), 0), 6) AS rerank_score FROM (
    SELECT p.*, list_distinct({_WORDS.format("b.text")}) AS qw, list_distinct({_WORDS.format("substr(d.text, 1, 800)")}) AS dw FROM pre p JOIN benchmark b ON b.item_id = p.query_id JOIN documents d ON d.doc_id = p.id) p),
reranked AS (SELECT * EXCLUDE (qw, dw), rerank_score AS score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, pre_rank) AS rerank_rank FROM scored)"""

FINAL = """
top AS (SELECT *, score >= 0.30 AS passed FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_rank, pre_rank) AS final_rank FROM reranked) WHERE final_rank <= 6)"""


def active(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 3 != 0).alias("is_active"), F.concat("source", F.lit(".md")).alias("name"))


class Search:
    """All steps of one search mode, each from the one before.

    The fused candidates, a few for each query, are written down: both channels
    run once, and joins with the documents know how small the other side is.
    With `reuse`, so are the hits that several results are made from.
    """

    def __init__(self, spark: SparkSession, sf: str, mode: str = "HYBRID_RERANK", reuse: bool = False):
        self.docs = table(spark, sf, "documents")
        self.queries = questions(spark, sf)
        vec = vector_channel(spark, sf)
        self.fused = cut(retrieval.vector_only(vec) if mode == "VECTOR" else retrieval.fuse(vec, lexical_channel(spark, sf)), "fused")
        self.pre = retrieval.valid(retrieval.candidates(self.fused), active(spark, sf))
        self.after = retrieval.rerank(self.pre, self.queries, self.docs) if mode == "HYBRID_RERANK" else retrieval.no_rerank(self.pre)
        if reuse:
            self.after = cut(self.after, "reranked")
        self.top = retrieval.final(self.after)
        self.trace = retrieval.trace(self.fused, self.after, self.top)
