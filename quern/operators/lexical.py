"""A lexical index that outlives a query: postings in blocks by word and range of documents, pruned by the largest score of a block.

Documents are dealt into ranges of a fixed number as they are read. A block has
the postings of one word in one range, and the largest part of a score that any
of them gives (Ding and Suel, 2011, with blocks that share their borders). For a
question the parts of its words add up to a bound for each range: the ranges of
the highest bounds are scored first, and of the others only those whose bounds
reach the k-th score found there. Nothing that could be among the k best is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import tokens
from quern.operators.retrieval import CANDIDATES, K1, B, Best, Tokenizer
from quern.shared import cut

#: Documents of a range; folders that words are dealt to by hash; ranges of the highest bounds that are scored first for each question.
RANGE, BUCKETS, FIRST = 128, 64, 4
#: Words of documents that a task writes to a folder, about, if words are spread evenly over the folders.
SHARE = 1 << 20
#: Questions that meet a range at once.
TOGETHER = 512
#: Columns of the tables of an index, by its type of ids.
TABLES = {
    "blocks": "term string, range long, ids array<{0}>, places array<int>, tfs array<int>, lengths array<int>, largest double, bucket int",
    "terms": "term string, df long, bucket int",
    "stats": "n long, mean double, id_type string",
}


def _read(spark: SparkSession, path: str, name: str, id_type: str = "bigint") -> DataFrame:
    return spark.read.schema(TABLES[name].format(id_type)).parquet(f"{path}/{name}")


def _bucket(term: str = "term"):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int").alias("bucket")


def build(docs: DataFrame, path: str, tokenizer: Tokenizer = tokens) -> None:
    """Write the index of docs (doc_id, text) to path.

    Texts are read and split once; a task packs the postings of its own ranges,
    and only these are shuffled, by folder and shares of ranges, so a word that all
    documents have is dealt out to many tasks. Null and empty texts count as documents
    of no words. Rows with equal or null ids are documents of their own. An
    empty table gives an index that finds nothing.
    """
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()

    def pack(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for lo in range(0, whole.num_rows, RANGE):
                b = whole.slice(lo, RANGE)
                ids, lists = b.column(0), b.column(1)
                length = np.diff(lists.offsets.to_numpy())
                coded = lists.flatten().dictionary_encode()
                row = np.repeat(np.arange(b.num_rows), length)
                key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) << 32 | row, return_counts=True)
                term, place = key >> 32, (key & 0xFFFFFFFF).astype(np.int32)
                at = np.append(np.searchsorted(term, np.arange(len(coded.dictionary))), len(term)).astype(np.int32)
                packed = [pa.ListArray.from_arrays(at, x) for x in (ids.take(pa.array(place)), pa.array(place), pa.array(tf.astype(np.int32)), pa.array(length[place].astype(np.int32)))]
                m = len(coded.dictionary)
                # A row without a word says how many documents and words the range has.
                none = [pa.nulls(1, x.type) for x in packed]
                yield pa.RecordBatch.from_arrays([pa.array([*coded.dictionary.to_pylist(), None], pa.string()), pa.array(np.full(m + 1, number)), *(pa.concat_arrays([x, y]) for x, y in zip(packed, none, strict=True)), pa.array([*[None] * m, b.num_rows], pa.int64()), pa.array([*[None] * m, int(length.sum())], pa.int64())], names=names)
                number += 1

    schema = f"term string, range long, ids array<{id_type}>, places array<int>, tfs array<int>, lengths array<int>, docs long, words long"
    names = [f.split()[0] for f in schema.split(", ")]
    packed = cut(docs.select("doc_id", tokenizer("text").alias("terms")).mapInArrow(pack, schema), "postings")
    n, words = packed.agg(F.sum("docs"), F.sum("words")).first()
    mean = (words or 0) / n if n else 0.0
    spark.createDataFrame([(n or 0, mean, id_type)], TABLES["stats"]).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    part = lambda tf, length: tf / (tf + K1 * (1 - B + B * length / mean))
    # Most blocks have one posting; they need no function of lists.
    largest = F.when(F.size("tfs") == 1, part(F.get("tfs", F.lit(0)), F.get("lengths", F.lit(0)))).otherwise(F.array_max(F.zip_with("tfs", "lengths", part)))
    # Shares of a folder are by hash of the range: nothing is sampled, so postings are read once.
    share = F.pmod(F.xxhash64("range"), F.lit(max(1, -(-(words or 0) // (BUCKETS * SHARE)))))
    blocks = packed.where("term is not null").select("term", "range", "ids", "places", "tfs", "lengths", _bucket()).repartition("bucket", share)
    blocks = blocks.select("term", "range", "ids", "places", "tfs", "lengths", largest.alias("largest"), "bucket")
    blocks.sortWithinPartitions("bucket", "term", "range").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
    df = packed.where("term is not null").groupBy("term").agg(F.sum(F.size("tfs")).alias("df")).select("term", "df", _bucket())
    df.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = CANDIDATES, tokenizer: Tokenizer = tokens, first: int = FIRST) -> DataFrame:
    """The k best documents of each of queries (query_id, text) by BM25, as `retrieval.bm25` gives them: (query_id, id, score, rank).

    Only the index is read, of it the folders of the questions' words, and the
    postings of ranges that bounds allow. Questions may be any number; they
    meet the index by joins on words and ranges. Questions without words that
    the index has find nothing; those with equal ids count as one with all their words.
    """
    stats = _read(spark, path, "stats").first()
    words = queries.select("query_id", F.explode(tokenizer("text")).alias("term")).distinct()
    buckets = [r[0] for r in words.select(_bucket()).distinct().collect()]
    here = lambda name: _read(spark, path, name, stats.id_type).where(F.col("bucket").isin(buckets))
    idf = F.log(1 + (stats.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = cut(words.join(here("terms"), "term").select("query_id", "term", idf.alias("idf")), "words")
    # Only the questions' words; they are no more than the questions have, and without them no posting of another word is moved.
    blocks = here("blocks").join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
    bounds = asked.join(blocks.select("term", "range", "largest"), "term").groupBy("query_id", "range").agg(F.sum(F.col("idf") * F.col("largest")).alias("bound"))
    bounds = cut(bounds.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "range"))), "bounds")
    start = bounds.where(F.col("place") <= first).select("query_id", "range", F.lit(None).cast("double").alias("least"))
    best = cut(_scored(start, asked, blocks.join(F.broadcast(start.select("range").distinct()), "range", "left_semi"), stats, k), "scores")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    least = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).groupBy("query_id").agg(F.min(F.when(F.col("rank") == k, F.col("score"))).alias("least"))
    others = surviving(bounds, least, first).join(least, "query_id", "left").select("query_id", "range", "least")
    found = best.union(_scored(others, asked, blocks, stats, k))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def surviving(bounds: DataFrame, least: DataFrame, first: int) -> DataFrame:
    """The ranges after the first whose bounds reach the k-th score so far; all of them where there is none. Scores are rounded to six places."""
    rest = bounds.where(F.col("place") > first).join(least, "query_id", "left")
    return rest.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 2e-6)).select("query_id", "range", "bound", "place")


def _scored(ranges: DataFrame, asked: DataFrame, blocks: DataFrame, stats, k: int) -> DataFrame:
    """(query_id, id, score) of the documents of ranges (query_id, range, least) that have a word of the question: of each range the k best, none below
    least. A range's blocks and its questions' words meet in one group of bounded size."""
    q_type, mean = asked.schema["query_id"].dataType.simpleString(), stats.mean
    parts = -(-asked.select("query_id").distinct().count() // TOGETHER) or 1
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part")
    wanted = ranges.join(asked, "query_id").select("range", part, "query_id", "term", "idf", "least")
    held = blocks.select("range", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "term", "ids", "places", "tfs", "lengths")

    def score(here: pa.Table, theirs: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": theirs["query_id"].slice(0, 0), "id": pa.array([], here.schema.field("ids").type.value_type), "score": pa.array([], pa.float64())})
        if not here.num_rows or not theirs.num_rows:
            return empty
        here, theirs = here.combine_chunks(), theirs.combine_chunks()
        at = pc.index_in(theirs["term"], here["term"].combine_chunks())
        theirs, at = theirs.filter(at.is_valid()).combine_chunks(), at.drop_null().to_numpy()
        if not len(at):
            return empty
        lists = {c: here[c].combine_chunks() for c in ("ids", "places", "tfs", "lengths")}
        start = lists["ids"].offsets.to_numpy()
        start, many = start[at] - start[0], np.diff(start)[at]
        ids, place, tf, length = (x.flatten().to_numpy(zero_copy_only=False) for x in lists.values())
        asked = theirs["query_id"].combine_chunks().dictionary_encode()
        names, q = asked.dictionary.to_numpy(zero_copy_only=False), asked.indices.to_numpy()
        owner = np.repeat(np.arange(len(at)), many)
        posting = start[owner] + np.arange(len(owner)) - np.repeat(np.append(0, np.cumsum(many))[:-1], many)
        value = theirs["idf"].to_numpy()[owner] * tf[posting] / (tf[posting] + K1 * (1 - B + B * length[posting] / mean))
        cell = q[owner].astype(np.int64) * RANGE + place[posting]
        found = np.flatnonzero(np.bincount(cell))
        points = np.bincount(cell, value)[found].round(6)
        row = np.zeros(RANGE, np.int64)
        row[place] = np.arange(len(place))
        best = Best(len(names), k)
        floor = theirs["least"].combine_chunks().fill_null(-np.inf).to_numpy()
        best.least[q] = floor
        good = points >= best.least[found // RANGE]
        best.add(found[good] // RANGE, ids[row[found[good] % RANGE]], points[good])
        return pa.Table.from_batches(list(best.batches(names))).cast(empty.schema)

    return wanted.groupBy("range", "part").cogroup(held.groupBy("range", "part")).applyInArrow(lambda theirs, here: score(here, theirs), f"query_id {q_type}, id {stats.id_type}, score double")
