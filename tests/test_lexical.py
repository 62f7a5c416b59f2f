"""The lexical index against the search that reads texts: the same rows, no text read again, ranges pruned."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import lexical, retrieval, segment


def key(df):
    return sorted(map(tuple, df.select("query_id", "rank", "id", "score").collect()), key=str)


def frames(spark, n=1500):
    r = random.Random(9)
    text = lambda m: " ".join(f"w{int(r.random() ** 3 * 400)}" for _ in range(m))
    rows = [(i, text(r.randrange(1, 60)) + (" common" if i % 3 else ""), 1.0) for i in range(n)] + [(n, None, 1.0), (n + 1, "", 1.0), (n + 2, "same words here", 1.0), (n + 2, "same words here", 1.0), (n + 3, "same words here", 1.0)]
    asked = [(q, text(r.randrange(1, 8))) for q in range(30)] + [(90, None), (91, ""), (92, "nowhere"), (93, "common common w1"), (94, "same words"), (95, "w399")]
    return spark.createDataFrame(rows, "doc_id long, text string, term double").repartition(4), spark.createDataFrame(asked, "query_id long, text string")


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    docs, asked = frames(spark)
    path = f"file://{tmp_path_factory.mktemp('lexical')}"
    old, lexical.RANGE = lexical.RANGE, 16
    lexical.build(docs, path)
    lexical.RANGE = old
    return docs, asked, path


@pytest.mark.parametrize("k", [1, 5, 30, 5000])
@pytest.mark.parametrize("first", [0, 4])
def test_same_rows_as_without_an_index(spark, made, k, first):
    docs, asked, path = made
    got = key(lexical.search(spark, path, asked, k, first=first))
    assert got == key(retrieval.bm25(docs, asked, k)) and got


def test_a_second_search_reads_no_text(spark, made):
    docs, asked, path = made
    out = lexical.search(spark, path, asked, 5)
    files = {f.rsplit("/", 2)[0].split("/bucket=")[0] for f in out.inputFiles()}
    assert files and not any("documents" in f for f in out.inputFiles())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema", 1)[1] and "PartitionFilters: [bucket" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_bounds_prune(spark, made):
    docs, asked, path = made
    stats = lexical._read(spark, path, "stats").first()
    blocks, terms = (lexical._read(spark, path, x) for x in ("blocks", "terms"))
    idf = F.log(1 + (stats.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    words = asked.select("query_id", F.explode(retrieval.tokens("text")).alias("term")).distinct().join(terms, "term").select("query_id", "term", idf.alias("idf"))
    bounds = words.join(blocks, "term").groupBy("query_id", "range").agg(F.sum(F.col("idf") * F.col("largest")).alias("bound")).withColumn("place", F.lit(9))
    least = retrieval.bm25(docs, asked, 3).where("rank = 3").select("query_id", F.col("score").alias("least"))
    kept, all_ = lexical.surviving(bounds, least, 0).count(), bounds.count()
    assert kept < 0.6 * all_
    # No range of a document among the best is lost.
    top = {(q, i) for q, _, i, _ in key(retrieval.bm25(docs, asked, 3))}
    place = {(r.query_id, i) for r in lexical.surviving(bounds, least, 0).join(words, "query_id").join(blocks, ["term", "range"]).select("query_id", "ids").collect() for i in r.ids}
    assert top <= place


def test_statistics_and_empty_tables(spark, made, tmp_path):
    docs, asked, path = made
    stats = lexical._read(spark, path, "stats").first()
    n, mean = docs.agg(F.count("*"), F.avg(F.size(retrieval.tokens("text")))).first()
    assert (stats.n, stats.mean) == (n, pytest.approx(mean))
    lexical.build(docs.limit(0), f"file://{tmp_path}/e")
    assert lexical.search(spark, f"file://{tmp_path}/e", asked).collect() == []
    lexical.build(docs.where("text is null"), f"file://{tmp_path}/n")
    assert lexical.search(spark, f"file://{tmp_path}/n", asked).collect() == []
    assert lexical.search(spark, path, asked.limit(0)).collect() == []


def test_with_a_dictionary(spark, tmp_path):
    split = segment.segmenter(spark.createDataFrame([("持久化",), ("集群",), ("状态",)], "w string"))
    docs = spark.createDataFrame([("a", "数据持久化方案"), ("b", "集群状态检查"), ("c", "集群")], "doc_id string, text string")
    asked = spark.createDataFrame([(7, "持久化"), (8, "集群的状态")], "query_id long, text string")
    lexical.build(docs, f"file://{tmp_path}/z", split)
    assert key(lexical.search(spark, f"file://{tmp_path}/z", asked, tokenizer=split)) == key(retrieval.bm25(docs, asked, tokenizer=split)) != []


def test_questions_meet_ranges_in_groups(spark, sf, tmp_path, monkeypatch):
    docs, asked = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet").selectExpr("item_id as query_id", "text")
    lexical.build(docs, str(tmp_path))
    monkeypatch.setattr(lexical, "TOGETHER", 3)
    got = lexical.search(spark, str(tmp_path), asked, first=1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, retrieval.bm25(docs, asked).collect()))


def test_a_frequent_word_is_dealt_out_by_shares_of_ranges(spark, made, tmp_path, monkeypatch):
    docs, asked, path = made
    monkeypatch.setattr(lexical, "SHARE", 50, raising=False)
    monkeypatch.setattr(lexical, "RANGE", 16)
    kind = type(docs)
    plans, repartition = [], kind.repartitionByRange
    monkeypatch.setattr(kind, "repartitionByRange", lambda self, *a: plans.append(a) or repartition(self, *a))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    lexical.build(docs, f"file://{tmp_path}/i")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert not plans  # a sample would read all postings once more
    blocks = [lexical._read(spark, p, "blocks") for p in (path, f"file://{tmp_path}/i")]
    rows = [sorted((r.term, tuple(r.ids), r.largest, r.bucket) for r in b.collect()) for b in blocks]
    assert rows[0] == rows[1]
    assert blocks[1].where("term = 'common'").select(F.input_file_name()).distinct().count() > 1
    assert key(lexical.search(spark, f"file://{tmp_path}/i", asked, 5)) == key(retrieval.bm25(docs, asked, 5))
