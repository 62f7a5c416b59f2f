"""From raw documents to tokens: quality, repeated lines, near copies, benchmark leaks, byte-level BPE.

Each stage works on all that the one before it kept, judged on its own input.
Ids tell documents apart: rows that repeat an id are kept or dropped together,
kept if any of them would be, and those with a null id cannot be judged one by
one, so no stage drops them. Ties are settled as the operators state. Other
columns stay as they are. An empty table stays empty in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import shared
from quern.llm import bpe, decontam, linedup, neardup, quality
from quern.llm.common import table

#: The rank file of the last stage.
RANKS = "byte_bpe_multi_50k.tiktoken"


def _only(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of docs whose ids are (or, with left_anti, are not) in ids, and those with a null id; joined in one way at every size."""
    known = docs.where("doc_id is not null").join(ids.select("doc_id").distinct().hint("merge"), "doc_id", how).select(docs.columns)
    return known.union(docs.where("doc_id is null"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity their language's trusted documents allow, and all with a null id.

    A null or empty text has no perplexity and goes, unless its id is null. A
    perplexity at the threshold is allowed. Without trusted documents all
    others stay.
    """
    return _only(docs, quality.classify(docs, table(spark, sf_dir, "labels")).where("keep"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat earlier ones, n_chars being that of the text that stays.

    A document whose lines have all gone goes, too, and so does one whose text
    is null or empty, whatever its id: nothing of it is left. Lines without
    words stay. Of equal lines the first stays: that of the smallest id, then
    of the smallest number. Rows with a null id keep their lines.
    """
    kept = linedup.remove_lines(docs, linedup.later_lines(docs, least_words=1))
    return kept.where(F.length("text") > 0).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the smallest id, and all with a null id or without words."""
    return _only(docs, neardup.near_duplicates(docs).where("kept"))


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark, null and empty texts among them, and all with a null id."""
    return _only(docs, decontam.contaminated(docs, table(spark, sf_dir, "benchmark")), "left_anti")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the packed ids, and digests of them and of what they decode to, a row for each row; null and empty texts have no tokens."""
    out = bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, with_decoded=True)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", leak_stage),
    ("byte_bpe", token_stage),
]

#: SQL can express neither the language model nor the signatures, the latent space and the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again, and what a stage wrote and shuffled on its way goes then."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        made = len(shared.WRITTEN)
        docs = shared.cut(stage(spark, docs, sf_dir), f"stage-{name}")
        *used, now = shared.WRITTEN[made:]
        shared.delete(spark, used + ([before] if before else []))
        shared.release(spark)
        before = now
    return docs
