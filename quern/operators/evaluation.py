"""Evaluation: evidence matching, rank metrics, confusion, breakdowns, latency, stages, and comparing runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.numbers import nearest_rank, ratio, round4
from quern.operators.numbering import numbered

#: Categories, modes of evidence and roles that a data set may have.
CATEGORIES = ("DIRECT", "TERM_VARIATION", "FOLLOW_UP", "OUT_OF_KB", "CONFUSABLE", "PARTIAL_EVIDENCE")
FAILURE_MODES = ("OUT_OF_KB", "PARTIAL_EVIDENCE", "MISSING_CONDITION", "ENTITY_MISMATCH", "SCOPE_MISMATCH", "NUMERIC_MISMATCH", "VERSION_CONFLICT", "UNSUPPORTED_INFERENCE")
EVIDENCE_MODES, ROLES = ("SINGLE_CHUNK", "MULTI_CHUNK", "FOLLOW_UP"), ("user", "assistant")
ANCHORS = ("content_hash", "chunk_id", "title_path", "anchor_path")


def has_anchor(e: Column) -> Column:
    """Whether any anchor of an evidence struct is there and not blank."""
    out = F.lit(False)
    for a in ANCHORS:
        out = out | F.coalesce(F.trim(e[a]) != "", F.lit(False))
    return out


def item_errors(items: DataFrame) -> DataFrame:
    """items with errors, the codes of the rules that a row breaks in their order; rows without any are accepted.

    Columns: question, answerable (null: no Boolean), category, failure_mode,
    evidence_mode, evidence (array of structs with the anchors), tempting
    (likewise), missing_requirement, history (array of role and content).
    """
    none = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    among = lambda c, values: F.coalesce(F.col(c).isin(*values), F.lit(False))
    listed = lambda c: F.coalesce(c, F.expr("array()").cast(items.schema[c].dataType))
    yes, no = F.coalesce("answerable", F.lit(False)), F.coalesce(~F.col("answerable"), F.lit(False))
    evidence, tempting, history = listed("evidence"), listed("tempting"), listed("history")

    def anchored(e):  # here an anchor that is there counts, even a blank one
        return F.coalesce(*[e[a] for a in ANCHORS]).isNotNull()

    rules = [
        ("QUESTION_BLANK", none(F.col("question"))),
        ("CATEGORY_MISSING", none(F.col("category"))),
        ("CATEGORY_UNKNOWN", ~none(F.col("category")) & ~among("category", CATEGORIES)),
        ("ANSWERABLE_NO_BOOLEAN", F.col("answerable").isNull()),
        ("HISTORY_INVALID", ~F.forall(history, lambda h: F.coalesce(F.lower(h["role"]).isin(*ROLES), F.lit(False)) & ~none(h["content"]))),
        ("FAILURE_MODE_UNKNOWN", ~none(F.col("failure_mode")) & ~among("failure_mode", FAILURE_MODES)),
        ("EVIDENCE_MODE_UNKNOWN", ~none(F.col("evidence_mode")) & ~among("evidence_mode", EVIDENCE_MODES)),
        ("FAILURE_MODE_NOT_ALLOWED", yes & ~none(F.col("failure_mode"))),
        ("EVIDENCE_MODE_NOT_ALLOWED", no & ~none(F.col("evidence_mode"))),
        ("FAILURE_MODE_MISSING", no & none(F.col("failure_mode"))),
        ("TEMPTING_NOT_ANCHORED", no & ~F.forall(tempting, anchored)),
        ("NEGATIVE_FIELDS_NOT_ALLOWED", yes & ((F.size(tempting) > 0) | ~none(F.col("missing_requirement")))),
        ("EVIDENCE_MISSING", yes & (F.size(evidence) == 0)),
        ("EVIDENCE_NOT_ANCHORED", yes & ~F.forall(evidence, anchored)),
        ("MULTI_CHUNK_NEEDS_TWO", yes & F.coalesce(F.col("evidence_mode") == "MULTI_CHUNK", F.lit(False)) & (F.size(evidence) < 2)),
        ("FOLLOW_UP_NEEDS_HISTORY", yes & F.coalesce(F.col("evidence_mode") == "FOLLOW_UP", F.lit(False)) & (F.size(history) == 0)),
    ]
    return items.withColumn("errors", F.array_compact(F.array(*[F.when(bad, code) for code, bad in rules])))


def match_evidence(evidence: DataFrame, hits: DataFrame) -> DataFrame:
    """evidence (query_id, evidence_id, anchors) with first_rank, the least rank of a hit (query_id, rank, content_hash, chunk_id, title_path) that any
    anchor matches; null if none does. One equality join for each anchor, so nothing is compared pair by pair."""
    found = None
    for anchor, column in (("content_hash", "content_hash"), ("chunk_id", "chunk_id"), ("title_path", "title_path"), ("anchor_path", "title_path")):
        e = evidence.where(F.coalesce(F.trim(anchor) != "", F.lit(False))).select("query_id", "evidence_id", F.col(anchor).alias("k"))
        one = e.join(hits.select("query_id", "rank", F.col(column).alias("k")), ["query_id", "k"]).select("query_id", "evidence_id", "rank")
        found = one if found is None else found.unionByName(one)
    best = found.groupBy("query_id", "evidence_id").agg(F.min("rank").alias("first_rank"))
    return evidence.select("query_id", "evidence_id").join(best, ["query_id", "evidence_id"], "left")


def per_item(matched: DataFrame) -> DataFrame:
    """(query_id, total, covered, first_rank) of matched evidence."""
    return matched.groupBy("query_id").agg(F.count("*").alias("total"), F.count("first_rank").alias("covered"), F.min("first_rank").alias("first_rank"))


def rank_metrics(items: DataFrame, top_k: int = 6) -> DataFrame:
    """One row of hit@1, hit@3, hit@5, MRR, recall and coverage over answerable items (total, covered, first_rank).

    MRR is null, not 0, if there is no hit at all. Recall covers all hits.
    """
    n = F.count("*")
    hit = lambda k: ratio(F.count_if(F.col("first_rank") <= min(k, top_k)), n)
    share = F.when(F.col("total") > 0, F.col("covered") / F.col("total"))
    return items.agg(
        n.alias("answerable"), hit(1).alias("hit_at_1"), hit(3).alias("hit_at_3"), hit(5).alias("hit_at_5"), round4(F.sum(1.0 / F.col("first_rank")) / n).alias("mrr"),
        ratio(F.sum("covered"), F.sum("total")).alias("recall"), round4(F.avg(share)).alias("coverage_macro"), round4(F.avg((F.col("covered") == F.col("total")).cast("double"))).alias("full_coverage"),
    )


def rank_distribution(items: DataFrame) -> DataFrame:
    """(slot, n): items by first rank from 1 to 5, and not_found; ranks beyond 5 are in no slot."""
    slot = F.when(F.col("first_rank").isNull(), "not_found").when(F.col("first_rank") <= 5, F.concat(F.lit("rank"), F.col("first_rank").cast("string")))
    return items.select(slot.alias("slot")).where("slot is not null").groupBy("slot").agg(F.count("*").alias("n"))


def outcomes(items: DataFrame) -> DataFrame:
    """items (answerable, refused) with outcome: TP answered rightly, FP answered wrongly, FN and TN refused."""
    a, r = F.col("answerable"), F.col("refused")
    return items.withColumn("outcome", F.when(a & ~r, "TP").when(~a & ~r, "FP").when(a & r, "FN").otherwise("TN"))


def confusion(items: DataFrame, *by: str) -> DataFrame:
    """Counts of outcomes and their rates, of all items or by columns; a rate without a denominator is null."""
    c = {k: F.count_if(F.col("outcome") == k) for k in ("TP", "FP", "FN", "TN")}
    tp, fp, fn, tn = c.values()
    rates = {
        "false_answer_rate": ratio(fp, fp + tn), "false_refusal_rate": ratio(fn, fn + tp), "answer_precision": ratio(tp, tp + fp), "answer_recall": ratio(tp, tp + fn),
        "refusal_precision": ratio(tn, tn + fn), "refusal_recall": ratio(tn, tn + fp), "refusal_accuracy": ratio(tp + tn, F.count("*")),
    }
    return outcomes(items).groupBy(*by).agg(F.count("*").alias("n"), *[x.alias(k.lower()) for k, x in c.items()], *[x.alias(k) for k, x in rates.items()])


def breakdown(items: DataFrame, by: str) -> DataFrame:
    """(by, n, refused, misjudged) of evaluated items."""
    return items.groupBy(by).agg(F.count("*").alias("n"), F.count_if("refused").alias("refused"), F.count_if(F.col("answerable") == F.col("refused")).alias("misjudged"))


def failure_modes(items: DataFrame) -> DataFrame:
    """(failure_mode, n, answered, refused, false_answer_rate) of evaluated items that are not answerable."""
    return items.where(~F.col("answerable")).groupBy("failure_mode").agg(
        F.count("*").alias("n"), F.count_if(~F.col("refused")).alias("answered"), F.count_if("refused").alias("refused"), ratio(F.count_if(~F.col("refused")), F.count("*")).alias("false_answer_rate")
    )


def evidence_modes(items: DataFrame) -> DataFrame:
    """Rank metrics by evidence_mode of answerable items (total, covered, first_rank, refused); means are over all of a mode."""
    n = F.count("*")
    hit = lambda k: ratio(F.count_if(F.col("first_rank") <= k), n)
    return items.groupBy("evidence_mode").agg(
        n.alias("n"), hit(1).alias("hit_at_1"), hit(3).alias("hit_at_3"), hit(5).alias("hit_at_5"), round4(F.coalesce(F.sum(1.0 / F.col("first_rank")), F.lit(0.0)) / n).alias("mrr"),
        ratio(F.count_if(F.col("covered") == F.col("total")), n).alias("full_coverage"), ratio(F.sum("covered"), F.sum("total")).alias("recall"), F.count_if("refused").alias("refused"),
        ratio(F.count_if("refused"), n).alias("false_refusal_rate"),
    )


def latency(items: DataFrame, column: str, *by: str) -> DataFrame:
    """(n, avg, p50, p95, max) of a column; percentiles are values that occur, by the nearest rank."""
    return items.where(F.col(column).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), round4(F.avg(column)).alias("avg"), nearest_rank(column, 0.5).alias("p50"), nearest_rank(column, 0.95).alias("p95"), F.max(column).alias("max")
    )


def judge_costs(items: DataFrame) -> DataFrame:
    """(attempted, executed, evaluated, judge_rate, degraded_rate, judge_latency) of items (failed, judge_invoked, degraded, judge_ms)."""
    ran = ~F.col("failed")
    asked = ran & F.col("judge_invoked")
    return items.agg(
        F.count("*").alias("attempted"), F.count_if(ran).alias("executed"), F.count_if(ran & ~F.col("degraded")).alias("evaluated"), ratio(F.count_if(asked), F.count_if(ran)).alias("judge_rate"),
        ratio(F.count_if(ran & F.col("degraded")), F.count_if(asked)).alias("degraded_rate"), ratio(F.sum(F.when(asked, F.col("judge_ms"))), F.count_if(asked)).alias("judge_latency"),
    )


def degraded_by_type(items: DataFrame) -> DataFrame:
    return items.where("degraded").groupBy(F.coalesce("failure_type", F.lit("UNKNOWN")).alias("failure_type")).agg(F.count("*").alias("n"))


def rewrites(items: DataFrame) -> DataFrame:
    """(invoked, rewritten, unchanged, fallback, avg_ms, p95_ms) of items (rewrite, rewrite_ms)."""
    of = lambda k: F.count_if(F.col("rewrite") == k)
    ms = F.when(F.col("rewrite_ms") > 0, F.col("rewrite_ms"))
    return items.withColumn("__ms", ms).agg(
        F.count_if(F.col("rewrite") != "SKIPPED").alias("invoked"), of("REWRITTEN").alias("rewritten"), of("UNCHANGED").alias("unchanged"), of("FALLBACK").alias("fallback"),
        round4(F.avg("__ms")).alias("avg_ms"), nearest_rank("__ms", 0.95).alias("p95_ms"),
    )


def evidence_snapshot(relevant: DataFrame, traced: DataFrame) -> DataFrame:
    """(query_id, id, stages): for each relevant id (query_id, id) the stages that hold it with its rank there, by name; empty where none does."""
    there = relevant.select("query_id", "id").distinct().join(traced, ["query_id", "id"], "left").where("stage is null or rank is not null")
    held = F.concat_ws(":", "stage", F.col("rank").cast("string"))
    return there.groupBy("query_id", "id").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("stage").isNotNull(), held))), ",").alias("stages"))


def evidence_union(relevant: DataFrame, traced: DataFrame) -> DataFrame:
    """(query_id, ids): the relevant ids that any stage holds."""
    held = relevant.select("query_id", "id").distinct().join(traced.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi")
    return relevant.select("query_id").distinct().join(held.groupBy("query_id").agg(F.array_sort(F.collect_set("id")).alias("ids")), "query_id", "left")


def stage_recall(relevant: DataFrame, traced: DataFrame) -> DataFrame:
    """(stage, items, recalled, recall): items whose relevant ids (query_id, id) are all among a stage's candidates."""
    need = relevant.select("query_id", "id").distinct()
    total = need.groupBy("query_id").agg(F.count("*").alias("total"))
    there = traced.select("query_id", "stage", "id").distinct().join(need, ["query_id", "id"]).groupBy("query_id", "stage").agg(F.count("*").alias("found"))
    # The stages are few and fixed; every item takes part in each.
    stages = F.explode(F.array(*[F.lit(s) for s in ("vector", "bm25", "union", "fused", "reranked")])).alias("stage")
    each = total.select("query_id", "total", stages).join(there, ["query_id", "stage"], "left")
    done = F.count_if(F.col("found") == F.col("total"))
    return each.groupBy("stage").agg(F.count("*").alias("items"), done.alias("recalled"), ratio(done, F.count("*")).alias("recall"))


def rerank_effect(relevant: DataFrame, traced: DataFrame) -> DataFrame:
    """(promoted, degraded, stable): how relevant candidates moved in the rerank; one that is missing afterwards has fallen, one that was not there before
    is left out."""
    of = lambda s, name: traced.where(F.col("stage") == s).select("query_id", "id", F.col("rank").alias(name))
    both = relevant.select("query_id", "id").distinct().join(of("pre_rerank", "a"), ["query_id", "id"]).join(of("reranked", "b"), ["query_id", "id"], "left")
    return both.agg(F.count_if(F.col("b") < F.col("a")).alias("promoted"), F.count_if(F.col("b").isNull() | (F.col("b") > F.col("a"))).alias("degraded"), F.count_if(F.col("b") == F.col("a")).alias("stable"))


def compare_runs(base: DataFrame, other: DataFrame) -> DataFrame:
    """(seq, base_rank, rank, change, position) of items (seq, first_rank): better, worse, flat or unknown by first rank; worse ones come first."""
    b, o = base.select("seq", F.col("first_rank").alias("base_rank")), other.select("seq", F.col("first_rank").alias("rank"), F.lit(True).alias("there"))
    big = 1_000_000_000
    x, y = F.coalesce("base_rank", F.lit(big)), F.coalesce("rank", F.lit(big))
    change = F.when(F.col("there").isNull(), "unknown").when(y < x, "better").when(y > x, "worse").otherwise("flat")
    out = b.join(o, "seq", "left").withColumn("change", change).drop("there")
    place = F.when(F.col("change") == "worse", 0).when(F.col("change") == "better", 1).when(F.col("change") == "flat", 2).otherwise(3)
    return out.withColumn("order", place)


def comparability(pairs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """pairs (pair_id, base struct, other struct) with the names of the fields that differ, comma-joined, and comparable."""
    diff = F.array_compact(F.array(*[F.when(~F.col("base")[f].eqNullSafe(F.col("other")[f]), f) for f in fields]))
    return pairs.select("pair_id", F.array_join(diff, ",").alias("differs"), (F.size(diff) == 0).alias("comparable"))


def metric_delta(metrics: DataFrame) -> DataFrame:
    """metrics (name, kind, lower_is_better, base, other) with delta and verdict: flat below 5e-5 for ratios and 1 for milliseconds."""
    d = F.col("other") - F.col("base")
    least = F.when(F.col("kind") == "ms", 1.0).otherwise(5e-5)
    good = F.when(F.col("lower_is_better"), d < 0).otherwise(d > 0)
    return metrics.select("name", round4(d).alias("delta"), F.when(d.isNull(), "unknown").when(F.abs(d) < least, "flat").when(good, "better").otherwise("worse").alias("verdict"))


def load_summary(calls: DataFrame) -> DataFrame:
    """(n, succeeded, mean, p50, p95, wall) of calls (ok, ms, started_ms)."""
    fine = F.when(F.col("ok"), F.col("ms"))
    return calls.withColumn("__ms", fine).agg(
        F.count("*").alias("n"), F.count_if("ok").alias("succeeded"), round4(F.avg("__ms")).alias("mean"), nearest_rank("__ms", 0.5).alias("p50"), nearest_rank("__ms", 0.95).alias("p95"),
        (F.max(F.col("started_ms") + F.col("ms")) - F.min("started_ms")).alias("wall"),
    )


def numbered_versions(versions: DataFrame, by: str, order: str) -> DataFrame:
    """Versions numbered from 1 within a data set."""
    return numbered(versions, [by], order, "version_no")


def name_conflicts(rows: DataFrame, name: str) -> DataFrame:
    """(name, n) of names that more than one row has."""
    return rows.groupBy(name).agg(F.count("*").alias("n")).where("n > 1")


def type_conflicts(have: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """Rows of `have` (key, type) that are asked for (key, type) as another type."""
    other = asked.select(key, F.col("type").alias("__asked"))
    return have.join(other, key).where(F.col("type") != F.col("__asked")).drop("__asked")


def run_items(items: DataFrame, runs: DataFrame) -> DataFrame:
    """The items (seq, ...) of a data set with what a run said of them (seq, ...); null where it said nothing."""
    return items.join(runs, "seq", "left")


def config_snapshots(configs: DataFrame, by: str, strategy: str, **settings: float) -> DataFrame:
    """(by, strategies, settings): the distinct strategies of a group in order, and the effective settings."""
    found = configs.groupBy(by).agg(F.array_join(F.array_sort(F.collect_set(strategy)), ",").alias("strategies"))
    return found.withColumns({k: F.lit(v) for k, v in settings.items()})


def summaries(runs: DataFrame, metrics: str, **members: str) -> DataFrame:
    """runs without their JSON metrics, but with members of it as numbers of four decimals."""
    return runs.withColumns({k: F.round(F.get_json_object(metrics, f"$.{v}").cast("double"), 4) for k, v in members.items()}).drop(metrics)
