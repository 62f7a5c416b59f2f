"""Hard negatives by block matrix products: partial score tiles of dimension chunks are shuffled together and added, then reduced to top ranks.

Vectors are dealt into blocks of rows, and each block into chunks of dimensions,
as in SUMMA (van de Geijn and Watts, 1997): every cell of a grid gets some blocks
of anchors and some of rows, and multiplies their chunks. The int64 products of
one pair of blocks meet by a shuffle, are added, and only the best of the sum
leave the task. Positives need scores within a label only, and their blocks hold
one label; negatives need the others, in blocks of all labels.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import giving_back
from quern.shared import cut, new_path, release

#: Anchors and rows of a block; dimensions of a chunk; blocks of each side that a cell of the grid multiplies.
ANCHORS, ROWS, CHUNK, CELL = 128, 2048, 32, 4
#: Bytes of partial tiles, at two a cell, that wait on disk at once, about.
ROUND = 3 << 30
#: A component takes part if its integer is no larger: products of two are then exact in 64 bits.
LARGEST = 1 << 24
BLOCK = "len int, label string, block long, chunk int, m int, ids binary, labels array<string>, x binary, size long, windows binary"
TILE = "a_block long, b_block long, a_m int, b_m int, tile binary, a_ids binary, b_ids binary, a_labels array<string>, b_labels array<string>, a_windows binary"
TILE_COLUMNS, BLOCK_COLUMNS = ([f.split()[0] for f in x.split(", ")] for x in (TILE, BLOCK))


def usable(df: DataFrame, id_col: str, label_col: str | Column, vec_col: str, scale: int) -> DataFrame:
    """id, label (as a string) and integer vector of the rows that take part, one an id."""
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    v = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), v.alias("v")).where("id is not null and label is not null and v is not null")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) <= LARGEST / scale - 1)))
    rows = rows.select("id", "label", F.transform("v", lambda x: F.floor(x * scale).cast("int")).alias("x"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "x")).alias("r")).select("id", "r.label", "r.x")


def blocks(rows: DataFrame, most: int, by_label: bool) -> DataFrame:
    """Blocks of at most so many rows of one length (and label), and of each a row for each chunk of dimensions. rows: id, label, x and, if told, w.

    Range partitions by label deal a label of any size out to many tasks;
    without labels rows are dealt by the hash of their ids, which are distinct.
    """
    order = ["label", "id"] if by_label else ["id"]
    parts = max(1, math.ceil(rows.count() / (most * CELL)))
    dealt = (rows.repartitionByRange(parts, *order) if by_label else rows.repartition(parts, "id")).sortWithinPartitions(F.size("x"), *order)

    @giving_back
    def pack(batches):
        from pyspark import TaskContext

        number, held, key = TaskContext.get().partitionId() << 32, [], None
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = (len(r[2]), r[1] if by_label else None)
                if held and (now != key or len(held) == most):
                    yield _packed(held, number, by_label)
                    held, number = [], number + 1
                held.append(r)
                key = now
        if held:
            yield _packed(held, number, by_label)

    return cut(dealt.mapInArrow(pack, BLOCK), "blocks")


def _packed(held: list[tuple], number: int, by_label: bool) -> pa.RecordBatch:
    x = np.array([r[2] for r in held], np.int32).reshape(len(held), -1)
    d, m = x.shape[1], len(held)
    chunks = range(0, max(d, 1), CHUNK)
    k, alone = len(chunks), [None] * (len(chunks) - 1)
    # What belongs to the rows and not to dimensions goes with the first chunk.
    found = pa.array([np.array([v for r in held for v in (r[3] or [])] if len(held[0]) > 3 else [], np.int64).tobytes(), *alone], pa.binary())
    size = pa.array([int(np.abs(x).max(initial=0))] * k, pa.int64())
    columns = [
        pa.array([d] * k, pa.int32()), pa.array([held[0][1] if by_label else None] * k, pa.string()), pa.array([number] * k, pa.int64()), pa.array(range(k), pa.int32()), pa.array([m] * k, pa.int32()), pa.array([np.array([r[0] for r in held], np.int64).tobytes(), *alone], pa.binary()),
        pa.array([[r[1] for r in held], *alone], pa.list_(pa.string())), pa.array([np.ascontiguousarray(x[:, c : c + CHUNK]).tobytes() for c in chunks], pa.binary()), size, found,
    ]
    return pa.RecordBatch.from_arrays(columns, names=BLOCK_COLUMNS)


def product(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """The int64 products of integer rows a and b, by floating-point units where these are exact; most: no product of two entries is larger."""
    if most * max(1, a.shape[1]) < 1 << 53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def narrow(tile: np.ndarray) -> bytes:
    """Bytes of an int64 tile for the way through a shuffle: 16 bits a cell, then places and values of the few that need more; if these are many, the fewest bits that hold all."""
    flat = tile.ravel()
    large = np.flatnonzero((flat >= 1 << 15) | (flat < -(1 << 15)))
    if 16 * len(large) < max(1, flat.size):
        return flat.astype(np.int16).tobytes() + large.tobytes() + flat[large].tobytes()
    return flat.astype(np.int32 if int(np.abs(flat).max()) < 1 << 31 else np.int64).tobytes()


def wide(data: bytes, shape: tuple[int, int]) -> np.ndarray:
    cells = shape[0] * shape[1]
    bits = {2: np.int16, 4: np.int32, 8: np.int64}[len(data) // cells] if cells else np.int64
    tile = np.frombuffer(data, bits, cells).astype(np.int64)
    if bits == np.int16 and len(data) > 2 * cells:
        large = np.frombuffer(data, np.int64, offset=2 * cells).reshape(2, -1)
        tile[large[0]] = large[1]
    return tile.reshape(shape)


def tiles(a: DataFrame, b: DataFrame, same_label: bool) -> DataFrame:
    """Partial tiles of all pairs of blocks of one length (and label): one for each chunk.

    A block of rows goes to each column of the grid, one of anchors to each
    row of it, so that a cell's key is shared by a bounded number of blocks.
    Spark takes a side for as large as its file, without the copies, and would
    broadcast it through the driver; the hint has both sides shuffled.
    """
    n, m = (max(1, math.ceil(x.where("chunk = 0").count() / CELL)) for x in (a, b))
    cell = lambda k: F.pmod(F.xxhash64("block"), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = a.withColumn("col", cell(n)).withColumn("row", each(m)).select(*(F.col(c).alias(f"a_{c}") for c in a.columns), "col", "row")
    b = b.withColumn("row", cell(m)).withColumn("col", each(n)).select(*(F.col(c).alias(f"b_{c}") for c in b.columns), "col", "row")
    on = (a.a_len == b.b_len) & (a.a_chunk == b.b_chunk) & (a.col == b.col) & (a.row == b.row)
    both = a.join(b.hint("merge"), on & (a.a_label == b.b_label) if same_label else on).select("a_block", "b_block", "a_m", "b_m", "a_x", "b_x", F.col("a_size") * F.col("b_size"), "a_ids", "b_ids", "a_labels", "b_labels", "a_windows")

    @giving_back
    def multiply(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                am, bm, ax, bx, most = (batch.column(c)[k].as_py() for c in range(2, 7))
                tile = product(np.frombuffer(ax, np.int32).reshape(am, -1), np.frombuffer(bx, np.int32).reshape(bm, -1), most)
                one = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*(one.column(c) for c in range(4)), pa.array([narrow(tile)], pa.binary()), *(one.column(c) for c in range(7, 12))], names=TILE_COLUMNS)

    return both.mapInArrow(multiply, TILE)


def reduced(partial: DataFrame, reduce, schema: str) -> DataFrame:
    """The rows that `reduce` makes of each pair of blocks: of its anchors' ids, labels and windows, its rows' ids and labels, and the sum of its tiles."""

    @giving_back
    def over(batches):
        key = total = known = None
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(i)[k].as_py() for i, c in enumerate(TILE_COLUMNS)}
                now, tile = (r["a_block"], r["b_block"]), wide(r["tile"], (r["a_m"], r["b_m"]))
                if now != key:
                    if key is not None and len(made := reduce(*known, total)):
                        yield made
                    key, total = now, tile
                else:
                    total = total + tile
                if r["a_ids"] is not None:
                    ids = [np.frombuffer(r[c], np.int64) for c in ("a_ids", "b_ids", "a_windows")]
                    known = ids[0], np.array(r["a_labels"], object), ids[2], ids[1], np.array(r["b_labels"], object)
        if key is not None and len(made := reduce(*known, total)):
            yield made

    return partial.repartition("a_block", "b_block").sortWithinPartitions("a_block", "b_block").mapInArrow(over, schema)


def by_turns(a: DataFrame, b: DataFrame, same_label: bool, reduce, schema: str, first) -> DataFrame:
    """What `first` keeps of the rows that `reduce` makes, written down; so many blocks of anchors at a time that their partial tiles take about ROUND bytes."""
    spark, path, on = a.sparkSession, new_path(a.sparkSession, "turns"), ["len", "label"] if same_label else ["len"]
    ours, theirs = a.groupBy(on).agg(F.sum("m").cast("double").alias("ours")), b.where("chunk = 0").groupBy(on).agg(F.sum("m").alias("theirs"))
    turns = max(1, math.ceil(2 * (ours.join(theirs, on).agg(F.sum(F.col("ours") * F.col("theirs"))).first()[0] or 0) / ROUND))
    for k in range(turns):
        part = a.where(F.pmod(F.hash("block"), F.lit(turns)) == k) if turns > 1 else a
        made = first(reduced(tiles(part, b, same_label), reduce, schema))
        made.write.mode("append").option("compression", "zstd").parquet(path)
        out = made.schema
        del made
        if turns > 1:
            release(spark)
    return spark.read.schema(out).parquet(path)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, of equal ones those of the smallest ids."""
    if len(scores) > k:
        among = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    else:
        among = np.arange(len(scores))
    return among[np.lexsort((ids[among], -scores[among]))[:k]]


def hard_negatives(df: DataFrame, anchor: Column | str, id_col: str = "vec_id", label_col: str | Column = "label", vec_col: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of each anchor and positive.

    Components c become floor(scale c), scores are integer inner products, and
    higher ones come first, of equal ones the smaller id. An anchor is a row
    that `anchor`, an expression over id_col, holds for; its positives are its
    first other rows of the label; for each the first rows of other labels whose
    scores are at least low and at most high hundredths of the positive's.

    Rows with a null id, label or vector, or null, non-finite or (scaled)
    components over about 2**24 take no part. Of rows that repeat an id the one of
    the smallest label, then the smallest vector takes part. Vectors of
    different lengths have no score with each other, empty ones one of 0. A
    positive of a negative score has no window, so no negatives; anchors
    without positives and an empty table give no rows. A label of any size is
    dealt into blocks; a task holds one tile at a time.
    """
    rows = cut(usable(df, id_col, label_col, vec_col, scale), "rows")
    chosen = rows.withColumnRenamed("id", id_col).where(anchor).withColumnRenamed(id_col, "id").select("id", "label", "x")

    def first_positives(ids, labels, _, others, their_labels, scores):
        out = []
        for k, i in enumerate(ids):
            there = np.flatnonzero(others != i)
            at = there[best(scores[k][there], others[there], positives)]
            out.append((np.full(len(at), i), others[at], scores[k][at]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=["anchor_id", "positive_id", "positive_score"])

    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    highest = lambda found: found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives).drop("place")
    found = by_turns(blocks(chosen, ANCHORS, True), blocks(rows, ROWS, True), True, first_positives, "anchor_id long, positive_id long, positive_score long", highest)
    # An anchor takes its windows along: its positives and their scores, at most twice `positives` numbers.
    own = found.groupBy(F.col("anchor_id").alias("id")).agg(F.flatten(F.collect_list(F.array("positive_id", "positive_score"))).alias("w"))
    pad = F.concat("w", F.array_repeat(F.lit(-1).cast("long"), 2 * positives - F.size("w")))
    chosen = cut(chosen.join(own.hint("merge"), "id").select("id", "label", "x", pad.alias("w")), "anchors")

    def first_negatives(ids, labels, windows, others, their_labels, scores):
        bounds = [[(p, s, -(-low * s // 100), high * s // 100) for p, s in w if s >= 0] for w in windows.reshape(len(ids), positives, 2).tolist()]
        least, most = np.array([min((x[2] for x in w), default=1) for w in bounds]), np.array([max((x[3] for x in w), default=0) for w in bounds])
        kinds = {x: n for n, x in enumerate(dict.fromkeys([*labels, *their_labels]))}
        mine, theirs = (np.array([kinds[x] for x in y]) for y in (labels, their_labels))
        out, any_window = [], (scores >= least[:, None]) & (scores <= most[:, None]) & (mine[:, None] != theirs)
        for k in np.flatnonzero(any_window.any(1)):
            there = np.flatnonzero(any_window[k])
            s = scores[k][there]
            for positive, score, lowest, top in bounds[k]:
                inside = np.flatnonzero((s >= lowest) & (s <= top))
                at = inside[best(s[inside], others[there[inside]], negatives)]
                out.append((np.full(len(at), ids[k]), np.full(len(at), positive), np.full(len(at), score), others[there[at]], s[at]))
        out.append(tuple(np.zeros(0, np.int64) for _ in range(5)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    by_window = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = lambda made: made.withColumn("rank", F.row_number().over(by_window)).where(F.col("rank") <= negatives)
    made = by_turns(blocks(chosen, ANCHORS, False), blocks(rows, ROWS, False), False, first_negatives, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long", ranked)
    return made.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
