"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is one of bytes (n-grams of UTF-8 in a 64-bit integer), so all
languages and unseen words have probabilities. Counts, continuation counts,
totals of contexts and discounts are aggregations and joins on the n-grams,
dealt by n-gram or context; the result is one probability for each n-gram that
trusted text holds and one back-off weight for each context.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import U64, buffers, giving_back, group_bounds, mix, slices, utf8
from quern.shared import cut, new_path

#: Bytes of an n-gram, at most 7.
ORDER = 5
#: The quantile of trusted documents' perplexities, by language, above which a document is rejected.
QUANTILE = 0.995
#: What is added to the logarithm of that quantile.
MARGIN = 0.1
#: One in so many trusted documents, by a hash of the id, is left out of the counts and sets the quantiles: what a model has seen is no measure of what it hasn't.
FOLDS = 8
#: Bytes of text, about, and most rows of a block of documents, whose n-grams are looked up together. A text is never cut.
BLOCK_BYTES, BLOCK_ROWS = 6 << 20, 100_000
#: Bytes of text whose n-grams are held at once, about.
SLICE = 1 << 19
#: Shards of the model; and the blocks that one copy of a shard serves, so that more blocks take more tasks.
SHARDS, SERVED = 256, 32_768


def grams(data: np.ndarray, offs: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each byte the n-gram that ends with it; before a row's first byte stand bytes of value 0."""
    n, rows = len(data), len(offs) - 1
    lengths = np.diff(offs)
    wide = np.zeros(n + (order - 1) * rows, np.uint8)
    at = np.arange(n) + np.repeat((np.arange(rows) + 1) * (order - 1), lengths)
    wide[at] = data
    keys = np.zeros(len(wide), U64)
    for k in range(order):
        keys[order - 1 :] |= wide[order - 1 - k : len(wide) - k or None].astype(U64) << U64(8 * k) if len(wide) >= order else U64(0)
    return keys[at].astype(np.int64)


def _counted(order: int):
    """gram, n of the texts in the first column, summed by task before anything is shuffled."""

    def run(batches):
        keys, counts, held = [], [], 0

        def merged():
            both, back = np.unique(np.concatenate(keys), return_inverse=True)
            return both, np.bincount(back, np.concatenate(counts), len(both)).astype(np.int64)

        for whole in batches:
            for batch in slices(whole, 0, SLICE):
                k, c = np.unique(grams(*buffers(batch.column(0)), order), return_counts=True)
                keys.append(k)
                counts.append(c)
                held += len(k)
                if held > 1_000_000:
                    k, c = merged()
                    keys, counts, held = [k], [c], 0
                    if len(k) > 2_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], names=["gram", "n"])
                        keys, counts = [], []
        if keys:
            yield pa.RecordBatch.from_arrays([*map(pa.array, merged())], names=["gram", "n"])

    return run


def count_grams(texts: DataFrame, text_col: str = "text", order: int = ORDER) -> DataFrame:
    """gram, n: occurrences in all texts."""
    parts = texts.select(utf8(text_col).alias("__text")).mapInArrow(giving_back(_counted(order)), "gram long, n long")
    return parts.groupBy("gram").agg(F.sum("n").alias("n"))


def fit(texts: DataFrame, text_col: str = "text", order: int = ORDER) -> DataFrame:
    """The model of all texts, as fit_counts gives it."""
    return fit_counts(count_grams(texts, text_col, order), order)


def fit_counts(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """The model as rows (kind, key, value) from (gram, n), the n-grams of `order` bytes.

    Kind k, 1 to order: the natural logarithm of the interpolated probability of
    the last byte of n-gram `key` of k bytes after the others. Kind -k: that of
    the weight by which the order below counts after the context `key` of k - 1
    bytes. N-grams that are not there have the weight of their context times
    the probability of one order less, and below order 1 stands 1 / 256.
    """
    now = cut(counted, "grams")
    counts = {order: now}
    for k in range(order - 1, 0, -1):  # continuation counts: distinct bytes before
        counts[k] = counts[k + 1].groupBy(F.expr(f"gram & {(1 << 8 * k) - 1}").alias("gram")).agg(F.count("*").alias("n"))
    lower = None
    parts = []
    for k in range(1, order + 1):
        table = counts[k] if k == order else cut(counts[k], f"grams-{k}")
        of = {r["n"]: r["c"] for r in table.where("n <= 4").groupBy("n").agg(F.count("*").alias("c")).collect()}
        n1, n2, n3, n4 = (of.get(i, 0) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        ratio = lambda a, b: a / b if b else 1.0
        d = [min(max(x, 0.05), i - 0.05) for i, x in ((1, 1 - 2 * y * ratio(n2, n1)), (2, 2 - 3 * y * ratio(n3, n2)), (3, 3 - 4 * y * ratio(n4, n3)))]
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        keyed = table.select("gram", "n", off.alias("off"), F.expr("gram div 256").alias("context"))
        context = keyed.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("off") / F.sum("n")).alias("weight"))
        grown = keyed.join(context, "context").select("gram", "weight", ((F.col("n") - F.col("off")) / F.col("total")).alias("own"), F.expr(f"gram & {(1 << 8 * (k - 1)) - 1}").alias("below"))
        if lower is None:
            p = grown.select("gram", (F.col("own") + F.col("weight") / 256).alias("p"))
        else:
            p = grown.join(lower.select(F.col("gram").alias("below"), F.col("p").alias("q")), "below").select("gram", (F.col("own") + F.col("weight") * F.col("q")).alias("p"))
        lower = cut(p, f"model-{k}")
        parts.append(lower.select(F.lit(k).alias("kind"), F.col("gram").alias("key"), F.log("p").alias("value")))
        parts.append(context.select(F.lit(-k).alias("kind"), F.col("context").alias("key"), F.log("weight").alias("value")))
    model = parts[0]
    for x in parts[1:]:
        model = model.unionByName(x)
    return cut(model, "model")


class Lookup:
    """Values of integer keys: open addressing in arrays a quarter full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 4 - 1).bit_length()) if len(keys) else 4
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.float32)
        at, left = self.slots(keys), np.arange(len(keys))
        while len(left):
            free = np.flatnonzero(self.keys[at] == -1)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.values[at[won]] = keys[left[won]], values[left[won]]
            lost = np.ones(len(left), bool)
            lost[won] = False
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, whether there); 0 for keys that are not there."""
        at = self.slots(keys)
        got = self.keys[at]
        there = got == keys
        values = self.values[at]
        open_ = np.flatnonzero(~there & (got != -1))
        values[~there] = 0
        step = at[open_]
        while len(open_):
            step = (step + 1) & ((1 << self.bits) - 1)
            got = self.keys[step]
            hit = got == keys[open_]
            values[open_[hit]], there[open_[hit]] = self.values[step[hit]], True
            more = ~hit & (got != -1)
            open_, step = open_[more], step[more]
        return values, there


def log_probabilities(tables: dict[int, Lookup], keys: np.ndarray, order: int) -> np.ndarray:
    """Natural logarithms of the probabilities of the last bytes of n-grams."""
    out, there = tables[order](keys)
    left = np.flatnonzero(~there)
    for k in range(order, 0, -1):
        if not len(left):
            break
        rest = keys[left]
        out[left] += tables[-k]((rest & ((1 << 8 * k) - 1)) >> 8)[0]
        if k == 1:
            out[left] -= np.float32(np.log(256))
            break
        value, there = tables[k - 1](rest & ((1 << 8 * (k - 1)) - 1))
        out[left] += value
        left = left[~there]
    return out


def pack(df: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Blocks (block, ids, rows) of the rows of df as they are read, dealt to buckets by block and written to the shared folder.

    rows holds the block's id, kept columns and text (columns 0, 1, ...) as a
    compressed Arrow stream. A block has about BLOCK_BYTES of text and is one row,
    so whatever is found out about it meets it by its number; as the table is
    bucketed, no such join shuffles the texts again.
    """
    spark = df.sparkSession
    source = df.select(F.col(id_col).alias("c0"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(keep, 1)], utf8(text_col).alias("text"))
    at = 1 + len(keep)
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(source.schema[0].dataType)), T.StructField("rows", T.BinaryType())])

    def run(batches):
        held, size, rows, block = [], 0, 0, TaskContext.get().partitionId() << 32

        def packed():
            sink = pa.BufferOutputStream()
            table = pa.Table.from_batches(held)
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(table)
            ids = table.column(0).combine_chunks()
            ids = ids if isinstance(ids, pa.Array) else ids.chunk(0)
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=schema.names)

        for whole in batches:
            for batch in slices(whole, at, BLOCK_BYTES):
                held.append(batch)
                rows += batch.num_rows
                size += len(buffers(batch.column(at))[0])
                if size >= BLOCK_BYTES or rows >= BLOCK_ROWS:
                    yield packed()
                    held, size, rows, block = [], 0, 0, block + 1
        if held:
            yield packed()

    # Buckets hold about as much as a split of a file does, or less.
    known = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    buckets = min(100_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), known >> 27 if known < 1 << 60 else 0))
    path = new_path(spark, "blocks")
    name = "quern_" + path.rpartition("-")[2]
    source.mapInArrow(giving_back(run), schema).write.format("parquet").bucketBy(buckets, "block").option("path", path).option("compression", "uncompressed").saveAsTable(name)
    blocks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files stay where they are
    return blocks


def unpack(rows: pa.BinaryScalar, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of a block in slices."""
    for whole in pa.ipc.open_stream(pa.BufferReader(rows.as_buffer())):
        yield from slices(whole, whole.num_columns - 1, most)
    pa.default_memory_pool().release_unused()


def _count_chosen(packed: DataFrame, ids: DataFrame, order: int) -> DataFrame:
    """gram, n of the rows whose ids are in ids (one distinct column). Only the ids travel: to the numbers of their rows in a block, and these to the block."""
    wanted = packed.select("block", F.posexplode("ids").alias("i", "id")).join(ids.toDF("id"), "id").groupBy("block").agg(F.collect_list("i").alias("wanted"))

    def chosen(batches):
        for batch in batches:
            for rows, mine in zip(batch.column(0), batch.column(1), strict=True):
                numbers, at = np.sort(mine.values.to_numpy()), 0
                for part in unpack(rows):
                    use = numbers[np.searchsorted(numbers, at) : np.searchsorted(numbers, at + part.num_rows)] - at
                    at += part.num_rows
                    if len(use):
                        yield pa.RecordBatch.from_arrays([part.column(part.num_columns - 1).take(pa.array(use))], names=["text"])

    run = _counted(order)
    parts = packed.join(wanted.hint("shuffle_hash"), "block").select("rows", "wanted").mapInArrow(giving_back(lambda batches: run(chosen(batches))), "gram long, n long")
    return parts.groupBy("gram").agg(F.sum("n").alias("n"))


def shard_of(kind: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The shard of entries and n-grams (kind: order) by the two bytes before the last one, which every table of three bytes and more has."""
    two = np.where(kind > 0, key >> 8, key) & 0xFFFF
    return (mix(two.astype(U64)) % U64(SHARDS)).astype(np.int64)


#: An entry of the model on its way to a shard.
ENTRY = np.dtype([("kind", "i1"), ("key", "<i8"), ("value", "<f4")])
DEALT = "part long, tag int, block long, payload binary"


def _deal_model(copies: int):
    def run(batches):
        held, n = [], 0

        def dealt():
            kind, key, value = (np.concatenate([h[i] for h in held]) for i in range(3))
            shard = shard_of(kind, key)
            order = np.argsort(shard, kind="stable")
            entries = np.empty(len(order), ENTRY)
            entries["kind"], entries["key"], entries["value"] = kind[order], key[order], value[order]
            bounds = group_bounds([shard[order]])
            raw = [entries[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            shards = shard[order][bounds[:-1]]
            for c in range(copies):
                yield pa.RecordBatch.from_arrays([pa.array(shards * copies + c), pa.array(np.zeros(len(raw), np.int32)), pa.array(np.zeros(len(raw), np.int64)), pa.array(raw, pa.binary())], names=["part", "tag", "block", "payload"])

        for b in batches:
            held.append(tuple(b.column(i).to_numpy() for i in range(3)))
            n += b.num_rows
            if n > 1_000_000:
                yield from dealt()
                held, n = [], 0
        if n:
            yield from dealt()

    return run


def _deal_grams(copies: int, order: int):
    """For each block its distinct n-grams, a row for each shard."""

    def run(batches):
        for batch in batches:
            for block, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys = np.zeros(0, np.int64)
                for part in unpack(rows):
                    keys = np.union1d(keys, grams(*buffers(part.column(part.num_columns - 1)), order))
                if not len(keys):
                    continue
                shard = shard_of(np.full(len(keys), order), keys)
                by = np.argsort(shard, kind="stable")
                bounds = group_bounds([shard[by]])
                raw = [keys[by[a:b]].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                part = shard[by][bounds[:-1]] * copies + (block ^ block >> 32) % copies
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.ones(len(raw), np.int32)), pa.array(np.full(len(raw), block)), pa.array(raw, pa.binary())], names=["part", "tag", "block", "payload"])

    return run


def _resolve(small: np.ndarray, order: int):
    """The logarithms of probabilities of the n-grams of a part, whose entries come first."""

    def run(batches):
        now, entries, tables = None, [], None
        for batch in batches:
            blocks, asked, logs = [], [], []
            for part, tag, block, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if part != now:
                    now, entries, tables = part, [small], None
                if not tag:
                    entries.append(np.frombuffer(payload.as_buffer(), ENTRY))
                    continue
                if tables is None:
                    mine = np.concatenate(entries)
                    tables = {k: Lookup(mine["key"][mine["kind"] == k], mine["value"][mine["kind"] == k]) for k in (*range(-order, 0), *range(1, order + 1))}
                raw = payload.as_py()
                blocks.append(block)
                asked.append(raw)
                logs.append(log_probabilities(tables, np.frombuffer(raw, np.int64), order).astype(np.float32).tobytes())
            if blocks:
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(asked, pa.binary()), pa.array(logs, pa.binary())], names=["block", "grams", "logs"])

    return run


def _perplexities(packed: DataFrame, model: DataFrame, columns: list[T.StructField], order: int) -> DataFrame:
    n = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = max(1, packed.count() // SERVED)
    # Tables of one and two bytes have 256, 65536, 1 and 256 entries at most, so every task gets them.
    few = model.where("abs(kind) <= 2").toArrow()
    small = np.empty(len(few), ENTRY)
    small["kind"], small["key"], small["value"] = (few[c].to_numpy() for c in ("kind", "key", "value"))
    entries = model.where("abs(kind) > 2").select(F.col("kind").cast("tinyint"), "key", F.col("value").cast("float"))
    asked = packed.select("block", "rows").mapInArrow(giving_back(_deal_grams(copies, order)), DEALT)
    dealt = entries.mapInArrow(giving_back(_deal_model(copies)), DEALT).unionByName(asked)
    found = dealt.repartition(n, "part").sortWithinPartitions("part", "tag").mapInArrow(giving_back(_resolve(small, order)), "block long, grams binary, logs binary")
    found = found.groupBy("block").agg(F.collect_list(F.struct("grams", "logs")).alias("found"))
    schema = T.StructType([*columns, T.StructField("n_bytes", T.LongType()), T.StructField("perplexity", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for rows, mine in zip(batch.column(0), batch.column(1), strict=True):
                mine = mine.as_py() or []
                table = Lookup(np.frombuffer(b"".join(m["grams"] for m in mine), np.int64), np.frombuffer(b"".join(m["logs"] for m in mine), np.float32))
                for part in unpack(rows):
                    data, offs = buffers(part.column(part.num_columns - 1))
                    values, there = table(grams(data, offs, order))
                    if not there.all():
                        raise RuntimeError("a block's n-grams have no probabilities")
                    sums, count = np.append(0, np.cumsum(values, dtype=np.float64)), np.diff(offs)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        value = np.exp(-(sums[offs[1:]] - sums[offs[:-1]]) / count)
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(count), pa.array(value, mask=count == 0)], names=schema.names)

    return packed.join(found.hint("shuffle_hash"), "block", "left").select("rows", "found").mapInArrow(giving_back(run), schema)


def perplexities(df: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), order: int = ORDER) -> DataFrame:
    """For each row of df: its id, the columns of `keep`, n_bytes and perplexity by byte; null for a null or empty text.

    Texts are packed into blocks. The distinct n-grams of a block are dealt to
    shards of the model by two of their bytes; all entries that an n-gram may
    back off to are in its shard, so one join answers it, and what it answers
    returns to the block. Rows with equal or null ids are rows of their own; an
    empty table gives an empty table.
    """
    packed = pack(df, id_col, text_col, keep)
    return _perplexities(packed, model, [df.schema[c] for c in (id_col, *keep)], order)


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", order: int = ORDER, quantile: float = QUANTILE) -> DataFrame:
    """For each row of df: its id, lang, n_bytes, perplexity, threshold and keep.

    Trusted text is that of every row that labels mark with 1. Of these
    documents one in FOLDS sets the quantiles and the others are counted; where
    none is set aside, the counted ones set them. A document is kept if its
    perplexity is at most the quantile of its language, with the margin; a null
    language is one of its own, and one without trusted documents takes the
    quantile of all. Shorter texts have noisier means, so the logarithm's margin
    grows by 1 / sqrt(bytes). A null or empty text has no perplexity and is
    rejected. Without trusted text everything else is kept. Rows that repeat an
    id, and those with a null one, are rows of their own. An empty table gives
    an empty table.
    """
    trusted = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("__id")).where("__id is not null").distinct()
    aside = F.pmod(F.xxhash64("__id"), F.lit(FOLDS)) == 0
    packed = pack(df, id_col, text_col, (lang_col,))
    model = fit_counts(_count_chosen(packed, trusted.where(~aside), order), order)
    columns = [T.StructField("__id", df.schema[id_col].dataType), T.StructField("__lang", df.schema[lang_col].dataType)]
    scored = cut(_perplexities(packed, model, columns, order), "perplexities")
    level = F.log("perplexity") - SHORT / F.sqrt(F.greatest(F.col("n_bytes"), F.lit(1)))
    seen = scored.where("perplexity is not null").join(trusted, "__id", "left_semi").withColumn("__level", level)
    marked = seen.where(aside)
    if not marked.limit(1).count():
        marked = seen
    cuts = marked.groupBy("__lang").agg(F.percentile_approx("__level", quantile, 100_000).alias("__own"))
    overall = marked.agg(F.percentile_approx("__level", quantile, 100_000)).first()[0]
    out = scored.join(cuts.withColumnRenamed("__lang", "__l"), F.col("__lang").eqNullSafe(F.col("__l")), "left")
    threshold = F.exp(F.coalesce(F.col("__own"), F.lit(overall).cast("double")) + MARGIN + SHORT / F.sqrt(F.greatest(F.col("n_bytes"), F.lit(1))))
    keep = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= threshold, F.lit(True))
    return out.select(F.col("__id").alias(id_col), F.col("__lang").alias("lang"), "n_bytes", "perplexity", threshold.alias("threshold"), keep.alias("keep"))


#: How much the margin of the logarithm grows for short texts.
SHORT = 2.0
