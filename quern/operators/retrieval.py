"""Retrieval: lexical and vector channels, fusion, validity, rerank, final hits and the trace of stages.

Channels are tables (query_id, id, rank, score). Scores are rounded to six
decimals before anything is ranked, so that ties are ties everywhere.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import tokens
from quern.shared import cut

#: Defaults: candidates of a channel, the constant of reciprocal ranks, hits that stay, least score, characters that a reranker sees.
CANDIDATES, RRF_K, TOP_K, MIN_SCORE, RERANK_CHARS = 30, 60, 6, 0.30, 800
#: Fixed values of the lexical score.
K1, B = 1.2, 0.75
#: Queries that go to every task at once, at most; more are searched in blocks.
QUERIES = 4096
#: Words, scores, and pairs of a document's word and a query that are worked on at once, whatever a batch holds.
WORDS, SCORES, PAIRS = 1 << 20, 1 << 20, 1 << 19


def _top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


Tokenizer = Callable[[str], Column]


def vocabulary(queries: DataFrame, tokenizer: Tokenizer = tokens) -> list[str]:
    """The distinct words of a query set, in order."""
    return sorted(r[0] for r in queries.select(F.explode(tokenizer("text")).alias("term")).distinct().collect())


def index(docs: DataFrame, words: list[str], tokenizer: Tokenizer = tokens) -> DataFrame:
    """(doc_id, length, terms, tfs): for each document its number of words and, of those in `words`, places and occurrences.

    A document's words are counted where it is read, so nothing is shuffled.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        known = pa.array(words, pa.string())
        for b in (x for whole in batches for x in _slices(whole, np.diff(whole.column(1).offsets.to_numpy()), WORDS)):
            lists = b.column(1)
            length = np.diff(lists.offsets.to_numpy())
            coded = lists.flatten().dictionary_encode()
            place = pc.fill_null(pc.index_in(coded.dictionary, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            term = place[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
            row = np.repeat(np.arange(b.num_rows), length)
            key, tf = np.unique((row << 32 | term)[term >= 0], return_counts=True)
            at = np.append(0, np.cumsum(np.bincount(key >> 32, minlength=b.num_rows))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (key & 0xFFFFFFFF, tf)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(length.astype(np.int32)), *lists], names=["doc_id", "length", "terms", "tfs"])

    return docs.select("doc_id", tokenizer("text").alias("terms")).mapInArrow(run, f"doc_id {id_type}, length int, terms array<int>, tfs array<int>")


def _slices(batch: pa.RecordBatch, cost: np.ndarray, most: int, rows: int = 1 << 31):
    """A batch in runs of rows whose costs add up to `most`; a row that costs more is a run of its own."""
    total, lo = np.append(0, np.cumsum(cost, dtype=np.int64)), 0
    while lo < batch.num_rows:
        hi = min(max(lo + 1, int(np.searchsorted(total, total[lo] + most, "right")) - 1), lo + rows)
        yield batch.slice(lo, hi - lo)
        lo = hi


def statistics(indexed: DataFrame, words: int) -> tuple[int, float, np.ndarray]:
    """Number of documents, mean length, and how many documents hold each of the words; one row a word comes to the driver."""
    n, mean = indexed.agg(F.count("*"), F.avg("length")).first()
    df = np.zeros(words, np.int64)
    for r in indexed.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r[0]] = r[1]
    return n, mean or 0.0, df


def postings(docs: DataFrame, queries: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, term, tf, length) of the index, and its one row of statistics (n, avgdl). With queries (query_id, text), of their terms only.

    Statistics are those of the whole index, whatever a query is filtered by.
    """
    split = docs.select("doc_id", tokens("text").alias("terms")).withColumn("length", F.size("terms"))
    stats = split.agg(F.count("*").alias("n"), F.avg("length").alias("avgdl"))
    each = split.select("doc_id", "length", F.explode("terms").alias("term"))
    if queries is not None:
        each = each.join(queries.select(F.explode(tokens("text")).alias("term")).distinct(), "term", "left_semi")
    return each.groupBy("doc_id", "length", "term").agg(F.count("*").alias("tf")), stats


def document_frequencies(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(term, df, n, avgdl) of the queries' terms."""
    found, stats = postings(docs, queries)
    return found.groupBy("term").agg(F.count("*").alias("df")).withColumns({c: stats.select(c).scalar() for c in ("n", "avgdl")})


def bm25(docs: DataFrame, queries: DataFrame, k: int = CANDIDATES, tokenizer: Tokenizer = tokens) -> DataFrame:
    """The k best documents of each query by BM25 over the words they share (any of them), as the tokenizer splits texts into words.

    The texts are read once, into an index by document that is written down;
    statistics and scores come from it. Queries go to the tasks in blocks of a
    fixed number, and each task keeps its k best of each query before anything
    is shuffled, so a word that most documents have is no hot key. What a task
    works on at once is bounded, however many documents or words a batch has.
    """
    spark, id_type, q_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    words = vocabulary(queries, tokenizer)
    place = {w: i for i, w in enumerate(words)}
    indexed = cut(index(docs, words, tokenizer), "index")
    n, mean, df = statistics(indexed, len(words))
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    asked = queries.select("query_id", F.array_distinct(tokenizer("text")).alias("terms")).orderBy("query_id").collect()
    parts = []
    for at in range(0, len(asked), QUERIES):
        block = asked[at : at + QUERIES]
        names = np.array([r["query_id"] for r in block])
        pairs = np.array([(place[t], i) for i, r in enumerate(block) for t in r["terms"]], np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        first, of = np.searchsorted(pairs[:, 0], np.arange(len(words) + 1)), pairs[:, 1]

        def run(batches, names=names, first=first, of=of):
            many, best = np.diff(first), Best(len(names), k)
            for whole in batches:
                at = whole.column(2).offsets.to_numpy()
                total = np.append(0, np.cumsum(many[whole.column(2).flatten().to_numpy()]))
                for b in _slices(whole, np.diff(total[at - at[0]]), PAIRS, max(1, SCORES // len(names))):
                    ids, length = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy()
                    row = np.repeat(np.arange(b.num_rows), np.diff(b.column(2).offsets.to_numpy()))
                    term, tf = b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy()
                    part = idf[term] * tf / (tf + K1 * (1 - B + B * length[row] / mean))
                    each = many[term]
                    owner = np.repeat(np.arange(len(term)), each)
                    q = of[first[term][owner] + np.arange(len(owner)) - np.repeat(np.append(0, np.cumsum(each))[:-1], each)]
                    cell = q * b.num_rows + row[owner]
                    score = np.bincount(cell, part[owner], len(names) * b.num_rows).round(6)
                    hit = np.flatnonzero((np.bincount(cell, minlength=len(score)) > 0) & (score >= np.repeat(best.least, b.num_rows)))
                    best.add(hit // b.num_rows, ids[hit % b.num_rows], score[hit])
            yield from best.batches(names)

        parts.append(indexed.mapInArrow(run, f"query_id {q_type}, id {id_type}, score double"))
    return _merged(spark, parts, q_type, id_type, k)


class Best:
    """The k best rows of each query, numbered from 0, by score and id, of all that a task adds; no more than a few times their number is held."""

    def __init__(self, queries: int, k: int):
        self.k, self.most, self.held, self.rows = k, max(1 << 16, 2 * queries * k), [], 0
        #: Scores below a query's k-th so far are not needed.
        self.least = np.full(queries, -np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.held.append((query, ids, score))
        self.rows += len(query)
        if self.rows > self.most:
            self._merge()

    def _merge(self) -> None:
        query, ids, score = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((ids, -score, query))
        query = query[order]
        many = np.bincount(query, minlength=len(self.least))
        keep = np.arange(len(query)) - np.repeat(np.append(0, np.cumsum(many))[:-1], many) < self.k
        order, query = order[keep], query[keep]
        last = np.cumsum(np.minimum(many, self.k)) - 1
        full = many >= self.k
        self.least[full] = score[order][last[full]]
        self.held, self.rows = [(query, ids[order], score[order])], len(query)

    def batches(self, names: np.ndarray):
        if self.held:
            self._merge()
            query, ids, score = self.held[0]
            yield pa.RecordBatch.from_arrays([pa.array(names[query]), pa.array(ids), pa.array(score)], names=["query_id", "id", "score"])


def _merged(spark, parts: list[DataFrame], q_type: str, id_type: str, k: int) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], f"query_id {q_type}, id {id_type}, score double, rank int")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _top(out, k, F.desc("score"), F.asc("id"))


def vector(vectors: DataFrame, queries: DataFrame, k: int = CANDIDATES, tenant: bool = False) -> DataFrame:
    """The k nearest vectors (id, vector) of each query (query_id, vector) by (1 + cosine) / 2, exactly; with tenant only those of the query's kb_id.

    Queries go to the tasks in blocks of a fixed number; vectors are scored in
    runs that bound the scores held at once, and each task keeps its k best of
    each query before anything is shuffled. With tenant, vectors of tenants that
    no query of a block asks for are not read, and no query is multiplied with
    another tenant's vectors.

    Null vectors find nothing and are not found. All queries must have one
    length, and a vector of another one is an error that names it; so is a null
    or NaN among its numbers. Equal ids are rows of their own.
    """
    cols = ["query_id", "vector", *["kb_id"] * tenant]
    spark, id_type, q_type = vectors.sparkSession, vectors.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    asked = queries.select(*cols).where("vector is not null")
    source = vectors.select("id", F.col("vector").cast("array<double>").alias("vector"), *["kb_id"] * tenant).where("vector is not null")
    sizes = asked.groupBy(F.size("vector").alias("d")).count().orderBy("d").limit(2).collect()
    if len(sizes) > 1:
        raise ValueError(f"questions have vectors of {sizes[0].d} and of {sizes[1].d} numbers")
    n = asked.count()
    parts = []
    for at in range(max(1, -(-n // QUERIES)) if n else 0):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(-(-n // QUERIES))) == at).collect()
        if not block:
            continue
        q = np.array([r["vector"] for r in block], np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        names, kb = np.array([r["query_id"] for r in block]), np.array([r["kb_id"] for r in block], object) if tenant else None

        def run(batches, q=q, names=names, kb=kb):
            best = Best(len(names), k)
            for whole in batches:
                for lo in range(0, whole.num_rows, step := max(1, SCORES // len(names))):
                    b = whole.slice(lo, step)
                    ids, x = b.column(0).to_numpy(zero_copy_only=False), _matrix(b, q.shape[1])
                    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                    theirs = np.array(b.column(2).to_pylist(), object) if kb is not None else None
                    for t in [None] if kb is None else sorted(set(theirs) & set(kb)):
                        rows, mine = (np.arange(b.num_rows), np.arange(len(names))) if t is None else (np.flatnonzero(theirs == t), np.flatnonzero(kb == t))
                        score = ((1 + q[mine] @ x[rows].T) / 2).round(6)
                        # Ties of the k-th score stay until the ids decide.
                        least = np.partition(score, len(rows) - k, axis=1)[:, len(rows) - k] if len(rows) > k else np.zeros(len(mine))
                        i, j = np.nonzero(score >= np.maximum(least, best.least[mine])[:, None])
                        best.add(mine[i], ids[rows[j]], score[i, j])
            yield from best.batches(names)

        here = source.where(F.col("kb_id").isin(sorted({r["kb_id"] for r in block} - {None}))) if tenant else source
        parts.append(here.mapInArrow(run, f"query_id {q_type}, id {id_type}, score double"))
    return _merged(spark, parts, q_type, id_type, k)


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """The vectors of a batch (id, vector, ...), all of d numbers."""
    column = batch.column(1)
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    bad = np.flatnonzero(size != d)
    if bad.size:
        raise ValueError(f"the vector of {batch.column(0)[int(bad[0])].as_py()} has {size[bad[0]]} numbers, the questions' have {d}")
    x = flat.reshape(batch.num_rows, d)
    if (odd := np.flatnonzero(np.isnan(x).any(axis=1))).size:
        raise ValueError(f"the vector of {batch.column(0)[int(odd[0])].as_py()} holds something that is no number")
    return x


def first_ranks(channel: DataFrame) -> DataFrame:
    """A channel whose ids may repeat, each at its first rank."""
    return channel.groupBy("query_id", "id").agg(F.min("rank").alias("rank"), F.min_by("score", "rank").alias("score"))


def fuse(vec: DataFrame, lex: DataFrame, k: int = RRF_K) -> DataFrame:
    """All candidates (query_id, id, vector_rank, vector_score, bm25_rank, bm25_score, fused_score, fused_rank).

    Each channel that has a candidate adds 1 / (k + rank), k being 1 at least.
    Ties go to the candidates in the order of the vector channel, then of the
    lexical one, then of the id.
    """
    v = first_ranks(vec).select("query_id", "id", F.col("rank").alias("vector_rank"), F.col("score").alias("vector_score"))
    b = first_ranks(lex).select("query_id", "id", F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"))
    k = max(1, k)
    part = lambda c: F.coalesce(1 / (F.lit(float(k)) + F.col(c)), F.lit(0.0))
    both = v.join(b, ["query_id", "id"], "full_outer").withColumn("fused_score", F.round(part("vector_rank") + part("bm25_rank"), 9))
    seen = F.coalesce(F.col("vector_rank"), F.col("bm25_rank") + 1_000_000_000)
    return both.withColumn("fused_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fused_score"), seen, "id")))


def normalised(score: Column, k: int = RRF_K) -> Column:
    """A fused score as a share of the best possible one of two channels, 1 at most."""
    return F.least(F.lit(1.0), score / (2.0 / (max(1, k) + 1)))


def vector_only(vec: DataFrame) -> DataFrame:
    """The columns of fuse for a search without the lexical channel: order and ranks are those of the vectors."""
    v = first_ranks(vec)
    return v.select(
        "query_id", "id", F.col("rank").alias("vector_rank"), F.col("score").alias("vector_score"), F.lit(None).cast("int").alias("bm25_rank"), F.lit(None).cast("double").alias("bm25_score"),
        F.lit(None).cast("double").alias("fused_score"), F.col("rank").alias("fused_rank"),
    )


def candidates(fused: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """The first `limit` candidates; score is the vector's, 0 for those of the lexical channel only."""
    return fused.where(F.col("fused_rank") <= limit).withColumn("score", F.coalesce("vector_score", F.lit(0.0)))


def valid(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits of documents (doc_id, is_active) that exist and are active, numbered anew as pre_rank. It comes after the cut, so fewer may remain."""
    # Hits are few, so documents are reduced to theirs where they are read.
    alive = documents.where("is_active").select(F.col("doc_id").alias("id")).join(hits.select("id").distinct(), "id", "left_semi").distinct()
    order = Window.partitionBy("query_id").orderBy("fused_rank")
    return hits.join(alive, "id", "left_semi").withColumn("pre_rank", F.row_number().over(order))


def word_overlap(query: Column, text: Column) -> Column:
    """A stand-in for a relevance model: the share of the query's distinct words that the text has."""
    q = F.array_distinct(tokens(query))
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(q, tokens(text))).cast("double"), F.size(q)), F.lit(0.0)), 6)


def rerank(hits: DataFrame, queries: DataFrame, texts: DataFrame, scorer: Callable[[Column, Column], Column] = word_overlap) -> DataFrame:
    """Hits with rerank_score and rerank_rank; the score becomes the relevance of the text's first RERANK_CHARS characters, ties keep their order."""
    q = queries.select("query_id", F.col("text").alias("__query"))
    t = texts.select(F.col("doc_id").alias("id"), F.substring("text", 1, RERANK_CHARS).alias("__text"))
    scored = hits.join(q, "query_id").join(t, "id").withColumn("rerank_score", scorer(F.col("__query"), F.col("__text"))).drop("__query", "__text")
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "pre_rank")
    return scored.withColumn("rerank_rank", F.row_number().over(order)).withColumn("score", F.col("rerank_score"))


def apply_rerank(hits: DataFrame, results: DataFrame) -> DataFrame:
    """Hits with the relevances of a model's answer (query_id, index, relevance): index is a place among the hits, from 0.

    An answer holds if it has each place once and every relevance is from 0 to
    1; otherwise the request is degraded and its hits keep order and score.
    """
    n = hits.groupBy("query_id").agg(F.count("*").alias("__n"))
    good = F.col("index").isNotNull() & (F.col("index") >= 0) & (F.col("index") < F.col("__n")) & F.coalesce(F.col("relevance").between(0, 1), F.lit(False))
    fine = results.join(n, "query_id").groupBy("query_id", "__n").agg(F.countDistinct(F.when(good, F.col("index"))).alias("d"), F.count("*").alias("c"), F.min(good).alias("g"))
    fine = fine.where("d = __n and c = __n and g").select("query_id")
    ok = results.join(fine, "query_id", "left_semi").select("query_id", (F.col("index") + 1).alias("pre_rank"), F.col("relevance").alias("rerank_score"))
    out = hits.join(ok, ["query_id", "pre_rank"], "left")
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "pre_rank")
    out = out.withColumn("rerank_rank", F.when(F.col("rerank_score").isNotNull(), F.row_number().over(order)))
    return out.withColumn("rerank_degraded", F.col("rerank_score").isNull()).withColumn("score", F.coalesce("rerank_score", "score"))


def no_rerank(hits: DataFrame) -> DataFrame:
    """Hits as they are; without a rerank_rank rerank does not count as applied."""
    return hits.withColumn("rerank_score", F.lit(None).cast("double")).withColumn("rerank_rank", F.lit(None).cast("int"))


def final(hits: DataFrame, top_k: int = TOP_K, min_score: float = MIN_SCORE) -> DataFrame:
    """The first top_k hits with final_rank and passed: hits below min_score are marked, not dropped."""
    order = Window.partitionBy("query_id").orderBy(F.coalesce("rerank_rank", "pre_rank"), "pre_rank")
    out = hits.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= top_k)
    return out.withColumn("passed", F.col("score") >= F.lit(min_score))


def union_candidates(vec: DataFrame, lex: DataFrame) -> DataFrame:
    """The distinct candidates in the order of the vector channel, then of the lexical one, as (query_id, id, rank)."""
    both = vec.select("query_id", "id", F.col("rank").cast("long").alias("o")).unionByName(lex.select("query_id", "id", (F.col("rank") + 1_000_000_000).cast("long").alias("o")))
    return both.groupBy("query_id", "id").agg(F.min("o").alias("o")).select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy("o", "id")).alias("rank"))


def trace(fused: DataFrame, after: DataFrame, top: DataFrame) -> DataFrame:
    """One row (query_id, stage, id, rank) for each candidate of each stage. Every candidate of both channels is in fused, with its ranks there."""
    stage = lambda name, rank: F.struct(F.lit(name).alias("stage"), F.col(rank).cast("int").alias("rank"))
    def rows(df, *stages):
        return df.select("query_id", "id", F.explode(F.array(*[stage(*s) for s in stages])).alias("s")).select("query_id", "s.stage", "id", "s.rank").where("rank is not null")

    place = F.coalesce(F.col("vector_rank"), F.col("bm25_rank") + 1_000_000_000)
    joined = fused.withColumn("union_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(place, "id")))
    out = rows(joined, ("vector", "vector_rank"), ("bm25", "bm25_rank"), ("union", "union_rank"), ("fused", "fused_rank"))
    return out.unionByName(rows(after, ("pre_rerank", "pre_rank"), ("reranked", "rerank_rank"))).unionByName(rows(top, ("final", "final_rank")))


STAGES = ("vector", "bm25", "union", "fused", "pre_rerank", "reranked", "final")


def stage_ranks(traced: DataFrame) -> DataFrame:
    """One row for each candidate with its rank at every stage."""
    return traced.groupBy("query_id", "id").pivot("stage", list(STAGES)).agg(F.min("rank"))


def rank_reason() -> Column:
    """Why a hit stands where it stands, by the first rule that has something to say; null if nothing changed."""
    v, b, f, r = (F.col(c) for c in ("vector_rank", "bm25_rank", "fused_rank", "rerank_rank"))
    s = lambda c: c.cast("string")
    return (
        F.when(r != f, F.concat(F.lit("重排调整：融合 #"), s(f), F.lit(" → 重排 #"), s(r)))
        .when(f != v, F.concat(F.lit("RRF 融合调整：向量 #"), s(v), F.coalesce(F.concat(F.lit(" · BM25 #"), s(b)), F.lit("")), F.lit(" → 融合 #"), s(f)))
        .when(b.isNotNull() & v.isNull(), F.concat(F.lit("仅 BM25 通道召回：BM25 #"), s(b)))
        .when(v.isNotNull() & b.isNull() & f.isNotNull(), F.concat(F.lit("仅向量通道召回：向量 #"), s(v)))
    )
