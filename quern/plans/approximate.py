"""Queries of the vector index: exact ones by SQL, with all lists, and what it finds with some."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import ann
from quern.plans.base import VECTOR, question_vectors, table, vectors
from quern.shared import new_path

QUERIES, SQL = {}, {}
DIMS = 64


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _index(spark, sf):
    path = new_path(spark, "ann")
    ann.build(vectors(spark, sf), path, DIMS)
    return path


@query(f"WITH {VECTOR} SELECT query_id, id, score, rank FROM vec")
def vector_topk_lists(spark, sf):
    return ann.search(spark, _index(spark, sf), question_vectors(spark, sf), nprobe=None, num_candidates=None)


@query(f"WITH {VECTOR} SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vpairs WHERE qkb = vkb) WHERE rank <= 30")
def vector_topk_lists_kb(spark, sf):
    return ann.search(spark, _index(spark, sf), question_vectors(spark, sf), nprobe=None, num_candidates=None, tenant=True)


#: Every vector is in one list, and blocks and lists count all of them.
@query("SELECT count(*) AS vectors, count(*) AS in_blocks, count(*) AS in_lists, CAST(sum(vec_id) AS BIGINT) AS ids FROM embeddings WHERE embedding IS NOT NULL")
def vector_index_counts(spark, sf):
    path = new_path(spark, "ann")
    ann.build(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), path, DIMS)
    rows = spark.read.parquet(f"{path}/vectors").agg(F.count("*").alias("vectors"), F.sum("id").alias("ids"))
    blocks = spark.read.parquet(f"{path}/codes").agg(F.sum("n").alias("in_blocks"))
    lists = spark.read.parquet(f"{path}/lists").agg(F.sum("n").alias("in_lists"))
    return rows.withColumns({c: df.select(c).scalar() for c, df in (("in_blocks", blocks), ("in_lists", lists))}).select("vectors", "in_blocks", "in_lists", "ids")
