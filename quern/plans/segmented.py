"""Queries of dictionary segmentation: documents and questions without blanks, the questions' words as dictionary."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import retrieval, segment
from quern.plans.base import questions, table

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


#: Runs of letters, and in them every word at every place, by length; a letter that no word covers, and a run of digits, are words of their own.
_WORDS = r"dict AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}{2,}')) AS word FROM benchmark), sizes AS (SELECT DISTINCT len(word) AS n FROM dict)"
_TOKENS = r"""
{0}src AS ({1}),
{0}run AS (SELECT id, unnest(regexp_extract_all(x, '\p{{L}}+')) AS run, generate_subscripts(regexp_extract_all(x, '\p{{L}}+'), 1) AS no FROM {0}src),
{0}place AS (SELECT id, no, run, unnest(range(1, len(run) + 1)) AS i FROM {0}run),
{0}hit AS (SELECT id, no, i, word FROM (SELECT id, no, i, substr(run, i, n) AS word, n FROM {0}place JOIN sizes ON i + n - 1 <= len(run)) JOIN dict USING (word)),
{0}covered AS (SELECT DISTINCT id, no, unnest(range(i, i + len(word))) AS i FROM {0}hit),
{0}term AS (SELECT id, word AS term FROM {0}hit UNION ALL SELECT id, substr(run, i, 1) FROM {0}place ANTI JOIN {0}covered USING (id, no, i) UNION ALL SELECT id, unnest(regexp_extract_all(x, '\p{{N}}+')) FROM {0}src)"""
_DOCS = "SELECT doc_id AS id, replace(lower(text), ' ', '') AS x FROM documents"
_ASKED = "SELECT item_id AS id, replace(lower(text), ' ', '') AS x FROM benchmark"


def _without_blanks(df):
    return df.withColumn("text", F.replace("text", F.lit(" "), F.lit("")))


def _tokenizer(spark, sf):
    words = questions(spark, sf).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{2,})"))).alias("word"))
    return segment.segmenter(words, unspaced=r"\p{L}")


@query(f"WITH {_WORDS}, {_TOKENS.format('d', _DOCS)} SELECT id AS doc_id, term, count(*) AS tf FROM dterm GROUP BY ALL")
def segmented_terms(spark, sf):
    split = _tokenizer(spark, sf)
    each = _without_blanks(table(spark, sf, "documents")).select("doc_id", F.explode(split("text")).alias("term"))
    return each.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


_BM25 = f"""
WITH {_WORDS}, {_TOKENS.format("d", _DOCS)}, {_TOKENS.format("q", _ASKED)},
dl AS (SELECT documents.doc_id, count(term) AS dl FROM documents LEFT JOIN dterm ON dterm.id = doc_id GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), qt AS (SELECT DISTINCT id AS query_id, term FROM qterm),
post AS (SELECT id AS doc_id, term, count(*) AS tf FROM dterm WHERE term IN (SELECT term FROM qt) GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
scored AS (SELECT query_id, doc_id AS id, round(sum(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * p.tf / (p.tf + 1.2 * (1 - 0.75 + 0.75 * dl / s.avgdl))), 6) AS score
  FROM qt JOIN dfs d USING (term) JOIN post p USING (term) JOIN dl USING (doc_id) CROSS JOIN stats s GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 30
"""


@query(_BM25)
def bm25_segmented(spark, sf):
    return retrieval.bm25(_without_blanks(table(spark, sf, "documents")), _without_blanks(questions(spark, sf)), tokenizer=_tokenizer(spark, sf))
