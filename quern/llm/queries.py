"""The queries opN_ of the subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, decontam, embdup, hardneg, linedup, neardup, pii, quality, sharding, sufarr, toxicity, triebpe, whitening
from quern.llm.common import table

SHARDS = [f"shard-{i:03d}" for i in range(64)]
RANKS, MERGES = "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARDS)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    net = toxicity.train(docs, labels.where(~held_out))
    scored = toxicity.score(docs, net)
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, with_decoded=True)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii.KINDS]
    base = F.filter("found", lambda s: s["rank"] < 4)
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined("found").alias("spans"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdup.link_embeddings(table(spark, sf_dir, "embeddings"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sufarr.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    later = linedup.later_lines(docs, least_words=1).groupBy(F.col("doc").alias("doc_id")).agg(F.count("*").alias("n_removed"), F.array_join(F.array_sort(F.collect_list("line")).cast("array<string>"), ",").alias("removed_lines"))
    out = docs.select("doc_id").join(later, "doc_id", "left")
    return out.select("doc_id", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("removed_lines", F.lit("")).alias("removed_lines"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = triebpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(MERGES), with_decoded=True)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", label_col=label)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_decontamination, op3_minhash_near_dedup, op4_quality, op5_toxicity, op6_byte_bpe, op7_pii, op8_embedding_near_dedup, op9_suffix_array_dedup, op10_line_dedup, op11_whitening, op12_trie_bpe, op13_hard_negatives)}


#: Brute force within labels; components by the closure of links.
EMBEDDING_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT c.a AS vec_id, coalesce(n_links, 0) AS n_links, component_id, c.a = component_id AS kept FROM c LEFT JOIN n ON n.a = c.a
"""

#: Lines that share a word of their prefixes, compared as whole sets.
LINE_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents),
s AS (SELECT doc_id, no, list_distinct(regexp_extract_all(lower(line), '[0-9a-z\x{80}-\x{10ffff}]+')) AS w FROM l), t AS (SELECT *, len(w) AS n FROM s WHERE len(w) >= 1),
d AS (SELECT word, count(*) AS df FROM (SELECT unnest(w) AS word FROM t) GROUP BY word),
e AS (SELECT t.doc_id, t.no, t.n, u.word, row_number() OVER (PARTITION BY t.doc_id, t.no ORDER BY d.df, u.word) AS place FROM t, unnest(t.w) AS u(word) JOIN d ON d.word = u.word),
x AS (SELECT * FROM e WHERE place <= n - ceil(0.8 * n - 1e-9) + 1),
c AS (SELECT DISTINCT a.doc_id AS da, a.no AS na, b.doc_id AS db, b.no AS nb FROM x a JOIN x b ON a.word = b.word AND (a.doc_id, a.no) < (b.doc_id, b.no) AND a.n >= 0.8 * b.n - 1e-9 AND b.n >= 0.8 * a.n - 1e-9),
g AS (SELECT DISTINCT db AS doc_id, nb AS no FROM c JOIN t p ON p.doc_id = da AND p.no = na JOIN t q ON q.doc_id = db AND q.no = nb WHERE len(list_intersect(p.w, q.w)) >= 0.8 * (p.n + q.n - len(list_intersect(p.w, q.w))) - 1e-9)
SELECT d.doc_id, count(g.no) AS n_removed, coalesce(string_agg(CAST(g.no AS VARCHAR), ',' ORDER BY g.no), '') AS removed_lines FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id GROUP BY d.doc_id
"""


#: All anchors against all rows; sums of integers are exact in doubles.
NEGATIVE_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT p.*, s.other_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other_id) AS r
    FROM p JOIN s ON p.anchor_id = s.anchor_id WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 3
"""


def shard_sql() -> str:
    """Place of a key by its MD5, and the shard in that place of the table, which is given as it is filled by turns."""
    owners = ",".join(map(str, sharding.lookup_table(SHARDS).tolist()))
    size = sharding.TABLE_SIZE
    return f"""WITH k AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {size} AS slot FROM documents),
t AS (SELECT string_split('{owners}', ',') AS owner)
SELECT doc_id, slot, 'shard-' || lpad(owner[slot + 1], 3, '0') AS shard FROM k, t"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express; the others are tested against brute force."""
    return {"op1_sharding": shard_sql(), "op8_embedding_near_dedup": EMBEDDING_SQL, "op10_line_dedup": LINE_SQL, "op13_hard_negatives": NEGATIVE_SQL}
