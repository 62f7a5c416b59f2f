"""Queries of the lexical index on disk, and of the versioned table of chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import chunking, lexical
from quern.plans.base import _WORDS, DOCUMENTS, LEXICAL, documents, questions, table
from quern.plans.library import _CHUNKS
from quern.shared import new_path
from quern.sources import store

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _index(spark, sf):
    path = new_path(spark, "lexical")
    lexical.build(table(spark, sf, "documents"), path)
    return path


@query(f"WITH {LEXICAL} SELECT query_id, id, score, rank FROM lex")
def bm25_topk_index(spark, sf):
    return lexical.search(spark, _index(spark, sf), questions(spark, sf))


@query(f"WITH tok AS (SELECT doc_id, unnest({_WORDS.format('text')}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS occurrences FROM tok GROUP BY term")
def index_terms(spark, sf):
    path = _index(spark, sf)
    seen = spark.read.parquet(f"{path}/blocks").groupBy("term").agg(F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)).alias("occurrences"))
    return spark.read.parquet(f"{path}/terms").join(seen, "term").select("term", "df", "occurrences")


def _committed(spark, sf):
    """All chunks, then a commit that replaces every fourth document and deletes those of remainder three by ten."""
    path = new_path(spark, "store")
    c = chunking.length_overlap(documents(spark, sf).where("doc_id is not null"), keep=("kb_id",))
    store.commit(c.select("doc_id", "chunk_id", "seq", "kb_id", F.sha2(F.col("content").cast("binary"), 256).alias("sha")), path)
    gone = table(spark, sf, "documents").where("doc_id % 10 = 3").select("doc_id")
    store.commit(store.read(spark, path).where("doc_id % 4 = 0 and seq = 0").withColumn("sha", F.lit("new")), path, deleted=gone)
    return path


@query(f"WITH {DOCUMENTS}, {_CHUNKS} SELECT chunk_id, kb_id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE sha256(content) END AS sha FROM chunk WHERE (doc_id % 4 <> 0 OR seq = 0) AND doc_id % 10 <> 3")
def index_commit(spark, sf):
    return store.read(spark, _committed(spark, sf)).select("chunk_id", "kb_id", "sha")


@query(f"WITH {DOCUMENTS}, {_CHUNKS} SELECT chunk_id, kb_id, sha256(content) AS sha FROM chunk")
def index_version(spark, sf):
    return store.read(spark, _committed(spark, sf), 1).select("chunk_id", "kb_id", "sha")


@query(f"WITH {DOCUMENTS}, {_CHUNKS} SELECT chunk_id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE sha256(content) END AS sha FROM chunk WHERE (doc_id % 4 <> 0 OR seq = 0) AND doc_id % 10 <> 3 AND kb_id = 'de'")
def index_compact(spark, sf):
    path = _committed(spark, sf)
    store.compact(spark, path)
    return store.read(spark, path).where("kb_id = 'de'").select("chunk_id", "sha")
