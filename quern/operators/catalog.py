"""Knowledge bases, documents and their versions, chunks as a table, sessions, tasks and their stages."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.numbering import numbered

#: The stages of an ingestion in their order.
STAGES = ("QUEUED", "PARSING", "CLEANING", "CHUNKING", "EMBEDDING", "INDEXING", "COMPLETED")


def duplicates(docs: DataFrame) -> DataFrame:
    """docs (kb_id, doc_id, sha) with first_id, the first document of a knowledge base with the same content, and is_duplicate.

    Firsts are an aggregation with map-side minima, so that a content that very
    many documents share is no single task's work.
    """
    first = docs.groupBy("kb_id", "sha").agg(F.min("doc_id").alias("first_id"))
    same = docs["kb_id"].eqNullSafe(first["kb_id"]) & docs["sha"].eqNullSafe(first["sha"])
    return docs.join(first, same).select(docs["*"], "first_id").withColumn("is_duplicate", F.col("doc_id") != F.col("first_id"))


def versions(docs: DataFrame) -> DataFrame:
    """docs (kb_id, name, file_type, doc_id) with root_id, version_no and is_active: an upload of the same name and type is a new version and the active one."""
    out = numbered(docs, ["kb_id", "name", "file_type"], "doc_id", "version_no", "root_id", "__newest")
    return out.select(*docs.columns, "root_id", "version_no", (F.col("doc_id") == F.col("__newest")).alias("is_active"))


def activate(versioned: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(versions, errors) after each asked version (doc_id, one a root) becomes the active one of its root.

    Only COMPLETED and FAILED versions may; others change nothing and are
    errors (doc_id, status, error), as are ids that are no version.
    """
    found = asked.select("doc_id").distinct().join(versioned.select("doc_id", "root_id", "status"), "doc_id", "left")
    able = F.coalesce(F.col("status").isin("COMPLETED", "FAILED"), F.lit(False))
    why = F.when(F.col("root_id").isNull(), "NOT_FOUND").otherwise("STATUS_NOT_ACTIVATABLE")
    errors = found.where(~able).select("doc_id", "status", why.alias("error"))
    now = found.where(able).groupBy("root_id").agg(F.max("doc_id").alias("__now"))
    out = versioned.join(now, "root_id", "left").withColumn("is_active", F.coalesce(F.col("doc_id") == F.col("__now"), F.col("is_active"))).select(versioned.columns)
    return out, errors


def after_delete(versioned: DataFrame, deleted: DataFrame) -> DataFrame:
    """What is left of versions (root_id, doc_id, version_no, status, is_active) without deleted (doc_id). Where the active one went, the newest COMPLETED
    one becomes active, if there is any."""
    gone = versioned.join(deleted, "doc_id", "left_semi").where("is_active").select("root_id").distinct().withColumn("lost", F.lit(True))
    left = versioned.join(deleted, "doc_id", "left_anti").join(gone, "root_id", "left")
    newest = F.max(F.when(F.col("status") == "COMPLETED", F.col("version_no"))).over(Window.partitionBy("root_id"))
    return left.withColumn("is_active", F.when(F.col("lost"), F.coalesce(F.col("version_no") == newest, F.lit(False))).otherwise(F.col("is_active"))).drop("lost")


def latest(versioned: DataFrame) -> DataFrame:
    """(root_id, version_no, doc_id) of the highest version."""
    return versioned.groupBy("root_id").agg(F.max("version_no").alias("version_no"), F.max_by("doc_id", "version_no").alias("doc_id"))


def index_errors(chunks: DataFrame, dims: int) -> DataFrame:
    """(doc_id, error) of documents whose chunks (doc_id, chunk_id, vector) may not be written: before anything is deleted, each chunk needs a vector of
    the index's dimensions."""
    bad = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count("vector").alias("vectors"), F.count_if(F.size("vector") != dims).alias("wrong"))
    return bad.select("doc_id", F.when(F.col("chunks") != F.col("vectors"), "COUNT_MISMATCH").when(F.col("wrong") > 0, "DIMENSION_MISMATCH").alias("error")).where("error is not null")


def rebuild_chunks(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """The index with all chunks of the fresh documents replaced; twice is the same as once."""
    return index.join(fresh.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(fresh)


def delete_chunks(index: DataFrame, gone: DataFrame, by: str = "doc_id") -> DataFrame:
    return index.join(gone.select(by).distinct(), by, "left_anti")


def page(df: DataFrame, *order: Column, number: int = 1, size: int = 20) -> DataFrame:
    """A page, counted from 1, of at most 100 rows."""
    size = min(100, max(1, size))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def page_bounds(total: Column, size: Column, asked: Column) -> tuple[Column, Column]:
    """(number of pages, the page shown): one page at least, and the asked one within them."""
    size = F.least(F.greatest(F.coalesce(size, F.lit(20)), F.lit(1)), F.lit(100))
    pages = F.greatest(F.lit(1), F.ceil(total / size)).cast("long")
    return pages, F.least(F.greatest(F.coalesce(asked, F.lit(1)), F.lit(1)), pages).cast("long")


def by_statuses(docs: DataFrame, *statuses: str) -> DataFrame:
    """Documents in any of the statuses, newest first: those in processing are asked for one status at a time and shown together."""
    return docs.where(F.col("status").isin(*statuses)).orderBy(F.desc("doc_id"))


def without_prefix(objects: DataFrame, path: str, prefixes: DataFrame) -> DataFrame:
    """Objects whose path starts with none of the prefixes (one column `prefix`, each ending with a slash). Paths and prefixes meet at the folder, not pair by pair."""
    cut = objects.select(path).distinct().withColumn("__d", F.explode(F.sequence(F.lit(2), F.size(F.split(path, "/")))))
    gone = cut.withColumn("prefix", F.concat(F.array_join(F.slice(F.split(path, "/"), F.lit(1), F.col("__d") - 1), "/"), F.lit("/"))).join(prefixes.select("prefix").distinct(), "prefix").select(path).distinct()
    return objects.join(gone, path, "left_anti")


def sessions(messages: DataFrame) -> DataFrame:
    """(conv_id, messages, last_turn) of each session."""
    return messages.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"))


def deletion_summary(docs: DataFrame, messages: DataFrame) -> DataFrame:
    """(kb_id, documents, sessions, messages): what goes with a knowledge base, zeros included; docs (doc_id, kb_id), messages (conv_id) of sessions that
    bear the id of a document."""
    said = messages.join(docs, F.col("conv_id") == F.col("doc_id")).groupBy("kb_id").agg(F.countDistinct("conv_id").alias("sessions"), F.count("*").alias("messages"))
    n = docs.groupBy("kb_id").agg(F.count("*").alias("documents"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return n.join(said, "kb_id", "full").select("kb_id", zero("documents"), zero("sessions"), zero("messages"))


def kb_rollup(kbs: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(kb_id, document_count, chunk_count), zeros included."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("c"))
    d = docs.join(n, "doc_id", "left").groupBy("kb_id").agg(F.count("*").alias("document_count"), F.coalesce(F.sum("c"), F.lit(0)).alias("chunk_count"))
    return kbs.select("kb_id").join(d, "kb_id", "left").select("kb_id", F.coalesce("document_count", F.lit(0)).alias("document_count"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))


def transitions(log: DataFrame) -> DataFrame:
    """log (doc_id, seq, stage) with previous and legal: the first stage, the next one, or the same again; COMPLETED is the last."""
    no = lambda c: F.array_position(F.array(*map(F.lit, STAGES)), c)
    prev = F.lag("stage").over(Window.partitionBy("doc_id").orderBy("seq"))
    step = no(F.col("stage")) - no(F.col("previous"))
    legal = F.when(F.col("previous").isNull(), F.col("stage") == STAGES[0]).otherwise(step.isin(0, 1) & ~((step == 0) & (F.col("stage") == STAGES[-1])))
    return log.withColumn("previous", prev).withColumn("legal", legal)


def resume_from(stage: Column) -> Column:
    """Where a failed task goes on: what follows chunking needs the chunks again."""
    return F.when(stage.isin("EMBEDDING", "INDEXING"), "CHUNKING").otherwise(stage)


def compare_and_set(rows: DataFrame, column: str, expected: Column, value: Column, when: Column | None = None) -> DataFrame:
    """rows with the column set where it has the expected value, and changed."""
    hit = F.coalesce((F.col(column) == expected) & (F.lit(True) if when is None else when), F.lit(False))
    return rows.withColumn("changed", hit).withColumn(column, F.when(F.col("changed"), value).otherwise(F.col(column)))


def recover(tasks: DataFrame) -> DataFrame:
    """Tasks (status, attempt) as a start finds them: running ones are queued again, as another attempt."""
    running = F.col("status") == "RUNNING"
    return tasks.withColumn("attempt", F.col("attempt") + F.when(running, 1).otherwise(0)).withColumn("status", F.when(running, "QUEUED").otherwise(F.col("status")))


def patch(rows: DataFrame, changes: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """rows with the columns of changes where these are not null."""
    c = changes.select(key, *[F.col(x).alias(f"__{x}") for x in columns])
    return rows.join(c, key, "left").select(*[F.coalesce(f"__{x}", x).alias(x) if x in columns else F.col(x) for x in rows.columns])


def cascade(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """The children of parents that are there."""
    return children.join(parents.select(key).distinct(), key, "left_semi")


def parse_events(bodies: DataFrame) -> DataFrame:
    """(stream_id, i, event, data) of event streams (stream_id, body): blocks end with an empty line, comments are skipped, data lines are joined, the
    default name is message, and blocks without data are none. A carriage return counts as the end of a line with a line feed only; a field without a
    colon has an empty value."""
    blocks = bodies.select("stream_id", F.posexplode(F.split(F.regexp_replace("body", "\r(\n|$)", "$1"), "\n\n")).alias("i", "block"))
    lines = F.split("block", "\n")

    def values(name):
        return F.transform(F.filter(lines, lambda x: (x == name) | F.startswith(x, F.lit(f"{name}:"))), lambda x: F.regexp_replace(x, f"(?s)^{name}:? ?", ""))

    name = F.nullif(F.try_element_at(values("event"), F.lit(-1)), F.lit(""))
    out = blocks.select("stream_id", "i", F.coalesce(name, F.lit("message")).alias("event"), values("data").alias("d"))
    return out.where(F.size("d") > 0).select("stream_id", "i", "event", F.array_join("d", "\n").alias("data"))


def grammar(events: DataFrame) -> DataFrame:
    """(stream_id, names, valid) of events (stream_id, seq, event): stages, tokens, citations once and done; or stages and tokens, then error or canceled."""
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "event"))), lambda x: x["event"]), " ")
    return events.groupBy("stream_id").agg(names.alias("names")).withColumn("valid", F.col("names").rlike(r"^(stage )*(token )*(citations done|error|canceled)$"))


def idle_gaps(events: DataFrame, seconds: int = 120) -> DataFrame:
    """events (stream_id, ts, id) that come more than `seconds` after the one before, with the gap."""
    prev = F.lag("ts").over(Window.partitionBy("stream_id").orderBy("ts", "id"))
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(prev.cast("timestamp"))
    return events.withColumn("gap_s", (gap / 1_000_000)).where(F.col("gap_s") > seconds).select("stream_id", "id", "gap_s")


def heartbeats(events: DataFrame, every: int = 15) -> DataFrame:
    """(stream_id, beats): signs of life that a stream sends while it waits, one after each `every` seconds without an event (stream_id, ts, id)."""
    prev = F.lag("ts").over(Window.partitionBy("stream_id").orderBy("ts", "id"))
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(prev.cast("timestamp"))
    beats = F.when(gap > 0, F.floor((gap - 1) / (every * 1_000_000)))
    return events.select("stream_id", beats.alias("b")).groupBy("stream_id").agg(F.coalesce(F.sum("b"), F.lit(0)).alias("beats"))


def admission(requests: DataFrame, permits: int, wait_ms: int = 0) -> DataFrame:
    """requests (server, id, start_ms, duration_ms) with started_ms and admitted.

    A server has a number of permits; a request takes one for its duration. One
    that finds none waits, first come first served, at most wait_ms, and is
    refused if none comes free by then. What is admitted depends on all that
    came before, so each server is a fold in order of start and id; its state is
    the times at which permits come free.
    """
    schema = T.StructType([requests.schema["server"], requests.schema["id"], T.StructField("start_ms", T.LongType()), T.StructField("started_ms", T.LongType()), T.StructField("admitted", T.BooleanType())])
    rows = requests.select("server", "id", F.col("start_ms").cast("long").alias("start_ms"), F.col("duration_ms").cast("long").alias("duration_ms"))
    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        free, now = [], None  # runs of one server come one after the other
        for b in batches:
            started, ok = [], []
            for server, start, takes in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if server != now or not free:
                    now, free = server, [-(1 << 62)] * permits
                at = max(start, free[0])
                ok.append(at - start <= wait_ms)
                started.append(at if ok[-1] else None)
                if ok[-1]:
                    heapq.heapreplace(free, at + takes)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(started, pa.int64()), pa.array(ok, pa.bool_())], names=schema.names)

    return rows.repartition(n, "server").sortWithinPartitions("server", "start_ms", "id").mapInArrow(run, schema)
