"""What follows retrieval: contexts, citations, prompts, and the decision to answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Defaults: characters of a context; thresholds of the rerank and the cosine scale; the text of an empty context; the longest rewritten question.
CONTEXT_CHARS, RERANK_THRESHOLD, COSINE_THRESHOLD, EMPTY_CONTEXT, REWRITE_CHARS = 6000, 0.75, 0.30, "（无相关资料）", 200


def pack(hits: DataFrame, queries: DataFrame, budget: int = CONTEXT_CHARS) -> DataFrame:
    """(query_id, context, char_count, ids, truncated) from hits (query_id, id, score, final_rank, passed, title, content).

    Only hits that passed the threshold count. Sections come in the order of
    scores. The one that crosses the budget is cut and still counts; later ones
    don't. A query without such hits has a fixed text.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "final_rank")
    n = hits.where("passed").withColumn("i", F.row_number().over(order))
    part = F.concat(F.lit("【文档 "), F.col("i").cast("string"), F.lit("】"), F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")), F.lit("\n\n"))
    n = n.withColumn("part", part).withColumn("end", F.sum(F.length("part")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    n = n.withColumn("start", F.col("end") - F.length("part"))
    used = F.col("start") < budget
    cut = F.expr(f"substring(part, 1, cast(greatest(0, {budget} - start) as int))")
    packed = n.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.when(used, F.struct("i", cut.alias("text"), "id")))).alias("s"), F.max(F.col("end") > budget).alias("truncated")
    )
    text = F.regexp_replace(F.array_join(F.transform("s", lambda x: x["text"]), ""), r"\s+$", "")
    packed = packed.select("query_id", text.alias("context"), F.transform("s", lambda x: x["id"]).alias("ids"), "truncated")
    out = queries.select("query_id").join(packed, "query_id", "left").withColumn("context", F.coalesce("context", F.lit(EMPTY_CONTEXT)))
    return out.select("query_id", "context", F.length("context").alias("char_count"), F.coalesce("ids", F.expr("array()").cast(packed.schema["ids"].dataType)).alias("ids"), F.coalesce("truncated", F.lit(False)).alias("truncated"))


def citations(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """One row for each passed hit: the name of its document (empty if there is none) and the score of its channel, not the final one."""
    names = documents.select(F.col("doc_id").alias("id"), F.col("name").alias("doc_name"))
    channel = F.coalesce("vector_score", "bm25_score")
    return hits.where("passed").join(names, "id", "left").select("query_id", "final_rank", "id", F.coalesce("doc_name", F.lit("")).alias("doc_name"), channel.alias("channel_score"))


def issues(queries: DataFrame, hits: DataFrame, packed: DataFrame, degraded: DataFrame | None = None) -> DataFrame:
    """(query_id, issues): codes of what a reader should know, in a fixed order; no hits end the list."""
    h = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.max("passed").alias("any_passed"))
    out = queries.select("query_id").join(h, "query_id", "left").join(packed.select("query_id", "truncated"), "query_id", "left")
    out = out.join(degraded.select("query_id").distinct().withColumn("bad", F.lit(True)), "query_id", "left") if degraded is not None else out.withColumn("bad", F.lit(None).cast("boolean"))
    some = F.col("n").isNotNull()
    codes = F.array(
        F.when(F.col("bad"), "RERANK_DEGRADED"), F.when(~some, "NO_HITS"), F.when(some & ~F.col("any_passed"), "ALL_BELOW_THRESHOLD"), F.when(some & F.col("truncated"), "CONTEXT_TRUNCATED")
    )
    return out.select("query_id", F.array_join(F.array_compact(codes), ",").alias("issues"))


def threshold(mode: Column, applied: Column) -> Column:
    """The threshold on the scale that the top score has."""
    return F.when((mode == "HYBRID_RERANK") & applied, RERANK_THRESHOLD).otherwise(COSINE_THRESHOLD)


def insufficient(mode: Column, applied: Column, top: Column, n: Column, enabled: Column) -> Column:
    return enabled & ((n == 0) | (F.coalesce(top, F.lit(0.0)) < threshold(mode, applied)))


def gate(requests: DataFrame) -> DataFrame:
    """Decisions on requests (query_id, enabled, mode, applied, n, top, judge_answer, judge_failure, fail_closed).

    Disabled: the threshold alone. Else no hits and low scores refuse, a judge's
    answer decides, and a judge that fails leaves a degraded decision, which
    answers unless failures close. refusal_enabled is taken as true.
    """
    low = insufficient(F.col("mode"), F.col("applied"), F.col("top"), F.col("n"), F.lit(True))
    kind = (
        F.when(~F.col("enabled"), "ANSWERABILITY_DISABLED").when(F.col("n") == 0, "NO_HITS").when(low, "LOW_SCORE_REFUSAL")
        .when(F.col("judge_failure").isNotNull(), "JUDGE_DEGRADED").when(F.col("judge_answer"), "JUDGE_ACCEPT").otherwise("JUDGE_REFUSE")
    )
    out = requests.withColumn("decision", kind)
    answer = F.when(F.col("decision") == "ANSWERABILITY_DISABLED", ~low).when(F.col("decision") == "JUDGE_DEGRADED", ~F.col("fail_closed")).otherwise(F.col("decision") == "JUDGE_ACCEPT")
    bad = F.col("decision") == "JUDGE_DEGRADED"
    return out.select(
        "query_id", "decision", answer.alias("answerable"), F.col("decision").startswith("JUDGE").alias("judge_invoked"), bad.alias("degraded"), F.when(bad, F.col("judge_failure")).alias("failure_type"),
        F.format_string("%.3f", F.coalesce("top", F.lit(0.0))).alias("top_text"), F.format_string("%.2f", threshold(F.col("mode"), F.col("applied"))).alias("threshold_text"),
    )


def invariant_errors(decisions: DataFrame) -> DataFrame:
    """Decisions that are degraded without a failure or have a failure without being degraded."""
    return decisions.where(F.col("degraded") != F.col("failure_type").isNotNull())


def parse_judgement(raw: str | Column) -> Column:
    """A struct (answerable, confidence, reason) of a model's answer, null if it is no such answer: the outermost braces of the text, fences aside, with a
    Boolean, a number from 0 to 1 and a text."""
    body = F.regexp_extract(F.col(raw) if isinstance(raw, str) else raw, r"(?s)\{.*\}", 0)
    yes, sure, why = (F.get_json_object(body, f"$.{k}") for k in ("answerable", "confidence", "reason"))
    number = sure.try_cast("double")
    fine = yes.isin("true", "false") & number.between(0, 1)
    return F.when(F.coalesce(fine, F.lit(False)), F.struct((yes == "true").alias("answerable"), number.alias("confidence"), F.coalesce(why, F.lit("")).alias("reason")))


def parse_rewrite(raw: str | Column) -> Column:
    """A struct (rewritten, query, failure) of a rewriter's answer: the outermost braces of the text, fences aside, with a Boolean `rewritten` and, if that
    is true, a text `query` of 1 to REWRITE_CHARS characters. Anything else is an INVALID_RESPONSE; the query is null unless it was rewritten."""
    body = F.regexp_extract(F.coalesce(F.col(raw) if isinstance(raw, str) else raw, F.lit("")), r"(?s)\{.*\}", 0)
    json = F.from_json(body, "rewritten string, query string")
    # A member's type shows in its JSON text: strings keep their quotes there.
    flag = F.regexp_extract(body, r'(?s)"rewritten"\s*:\s*(true|false)\b', 1)
    text = F.when(F.regexp_like(body, F.lit(r'(?s)"query"\s*:\s*"')), F.trim(json["query"]))
    good = (flag == "false") | ((flag == "true") & F.coalesce((text != "") & (F.length(text) <= REWRITE_CHARS), F.lit(False)))
    good = good & json["rewritten"].isNotNull()
    return F.struct(
        F.coalesce(good & (flag == "true"), F.lit(False)).alias("rewritten"), F.when(good & (flag == "true"), text).alias("query"),
        F.when(~F.coalesce(good, F.lit(False)), "INVALID_RESPONSE").alias("failure"),
    )


def effective_query(question: Column, history: Column, enabled: Column, rewritten: Column, text: Column) -> tuple[Column, Column]:
    """(the question that every retrieval step uses, how it came about) of a rewriter's answer; generation keeps the original."""
    how = (
        F.when(~enabled | (F.coalesce(history, F.lit(0)) == 0) | (F.trim(question) == ""), "SKIPPED")
        .when(rewritten.isNull(), "FALLBACK").when(~rewritten, "UNCHANGED").when((F.trim(F.coalesce(text, F.lit(""))) == "") | (F.length(text) > REWRITE_CHARS), "FALLBACK").otherwise("REWRITTEN")
    )
    return F.when(how == "REWRITTEN", text).otherwise(question), how


def last_turns(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each conversation (conv_id, turn, role, text) by users and assistants, numbered in their order."""
    said = messages.where(F.lower("role").isin("user", "assistant"))
    last = said.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("text")))).where(F.col("back") <= n)
    return last.withColumn("seq", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text"))).drop("back")


def prompt(turns: DataFrame) -> DataFrame:
    """(conv_id, prompt): each conversation's turns as lines of role and text."""
    line = F.concat(F.upper("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("l")).select("conv_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("prompt"))
