"""Near copies among embeddings: rotated binary codes, multi-index Hamming tables, exact cosines.

Iterative quantisation (Gong and Lazebnik, 2011) learns, on a bounded sample, a
rotation under which the signs of the principal components are balanced codes.
A code is cut into chunks; two vectors are candidates if they share a label and
any chunk (Norouzi et al., 2012), and the original vectors decide.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import components, cut, forest, group_bounds, mix, whole_runs

#: Rows that a rotation is fitted on, at most, and lengths of vectors that one is fitted for, the commonest; vectors of other lengths are turned at
#: random, which finds as much. All rows are indexed.
FIT_ROWS, FIT_LENGTHS = 20_000, 64
#: Codes of a bucket that are compared at once; larger buckets are cut into pairs of blocks.
BLOCK = 1024
#: The share of links at the threshold that the tables may miss, by the angle between random signs; and how many deviations more bits than expected
#: two codes may differ in.
MISS, DEVIATIONS = 1e-3, 4.5


def table_shape(n: int, angle: float) -> tuple[int, int, int]:
    """(bits of a chunk, chunks, most bits in which codes differ) for n vectors and the angle of a link: buckets grow slowly with n, and the recall stays."""
    bits = min(30, max(8, math.ceil(math.log2(max(2, n))) - 8))
    p = angle / math.pi
    same = (1 - p) ** bits
    chunks = max(2, math.ceil(math.log(MISS) / math.log(1 - same))) if same < 1 else 2
    total = bits * chunks
    return bits, chunks, math.ceil(total * p + DEVIATIONS * (total * p * (1 - p)) ** 0.5)


def centred_angle(x: np.ndarray, threshold: float) -> float:
    """The angle about the mean of unit vectors whose cosine is the threshold, for vectors as near to the mean as one in twenty is."""
    r = float(np.quantile(np.linalg.norm(x - x.mean(axis=0), axis=1), 0.05)) if len(x) else 1.0
    return 2 * math.asin(min(1.0, math.sqrt(max(0.0, 2 - 2 * threshold)) / max(2 * r, 1e-12)))


def random_rotation(d: int, bits: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """No mean, and orthogonal axes at random, the same ones for a length everywhere."""
    rng = np.random.default_rng([seed, d])
    return np.zeros(d), np.concatenate([np.linalg.qr(rng.normal(size=(d, d)))[0][:, : min(d, bits - k)] for k in range(0, bits, d)], axis=1)


def fit_rotations(x: np.ndarray, bits: int, centre: bool = True, rounds: int = 30, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The mean (zeros, if vectors are not to be centred), and a matrix whose products with centred vectors have the code in their signs.

    Bits beyond the dimensions come from further rotations with other starts.
    """
    rng = np.random.default_rng(seed)
    mean = x.mean(axis=0) if centre else np.zeros(x.shape[1])
    _, _, axes = np.linalg.svd(np.cov((x - mean).T) if len(x) > 1 else np.eye(x.shape[1]))
    out = []
    while bits > 0:
        d = min(bits, x.shape[1])
        # The whole space is kept and rotated; signs of its first d axes are used.
        v = (x - mean) @ axes.T
        r, _ = np.linalg.qr(rng.normal(size=(v.shape[1], v.shape[1])))
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        out.append((axes.T @ r)[:, :d])
        bits -= d
    return mean, np.concatenate(out, axis=1)


def _valid(vector: str):
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return F.when(fine, v)


def link_embeddings(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """One row for each row of df: its id, n_links, component_id and kept.

    Rows link if their labels are equal and not null and the cosine of their
    vectors, in double precision, is at least the threshold. A null vector, one
    that is empty, zero or holds a null or non-finite component, and a row with
    a null label or a null id link with nothing. Vectors of different lengths
    don't link. Equal vectors are compared once and count as often as they
    occur, rows that repeat an id included. component_id is the smallest id
    that links reach; a row without links is its own component. Ids are whole numbers, or texts of such;
    other ids are an error, as the smallest one names a component. An empty
    table gives an empty table.

    Every candidate is checked, so no link is below the threshold; the tables
    find all but about MISS of those at the threshold and more of the closer
    ones. Only codes go through the tables; a vector is fetched for a bucket
    where another code is near enough to its own. A bucket of any size is
    compared in blocks, without emitting pairs.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), _valid(vector_col).alias("v"))
    rows = rows.withColumn("ok", F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    rows = rows.withColumn("key", F.when(F.col("ok"), F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")).cast("binary"), 256)))
    unique = rows.where("ok").groupBy("label", "key").agg(F.min("id").alias("u"), F.count("*").alias("copies"), F.first("v").alias("v"), F.size(F.first("v")).alias("dims"))
    unique = cut(unique.withColumn("vid", F.monotonically_increasing_id()), "vectors")  # a number of its own, as rows may repeat an id
    n = unique.count()
    common = [r.dims for r in unique.groupBy("dims").count().orderBy(F.desc("count"), "dims").limit(FIT_LENGTHS).collect()]
    samples, plain = {}, math.acos(min(1.0, threshold))
    for d in common:
        sample = unique.where(F.col("dims") == d).orderBy(F.xxhash64("label", "key"), "vid").select("v").limit(FIT_ROWS)
        x = np.array([r.v for r in sample.collect()], np.float64)
        samples[d] = x / np.linalg.norm(x, axis=1, keepdims=True)
    angles = {d: centred_angle(x, threshold) for d, x in samples.items()}
    # Vectors that share a direction stay where they are: about their mean, links would be too wide.
    centre = {d: a <= 1.25 * plain for d, a in angles.items()}
    bits, chunks, radius = table_shape(n, max([plain, *[a for d, a in angles.items() if centre[d]]]))
    fitted = {d: fit_rotations(x, bits * chunks, centre[d]) for d, x in samples.items()}

    code_schema = "bucket long, chunk int, vid long, code binary"

    def coded(batches):
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            seed, vid, vectors = (batch.column(i) for i in range(3))
            vid, seed = (c.to_numpy(zero_copy_only=False) for c in (vid, seed))
            lengths = np.diff(vectors.offsets.to_numpy())
            flat, at = vectors.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(lengths))
            for d in np.unique(lengths):
                here = np.flatnonzero(lengths == d)
                mean, turn = fitted[int(d)] if int(d) in fitted else random_rotation(int(d), bits * chunks)
                signs = (_unit(flat[at[here][:, None] + np.arange(d)]) - mean) @ turn >= 0
                packed = pa.array([c.tobytes() for c in np.packbits(signs, axis=1)], pa.binary())
                codes = signs.reshape(len(here), chunks, bits).astype(np.int64) @ weights
                for k in range(chunks):
                    bucket = mix(seed[here].astype(np.uint64) ^ mix(((codes[:, k] * chunks + k) * 65_537 + d).astype(np.uint64))).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(len(here), k, np.int32)), pa.array(vid[here]), packed], names=["bucket", "chunk", "vid", "code"])

    entries = cut(unique.select(F.xxhash64("label").alias("seed"), "vid", "v").mapInArrow(coded, code_schema), "codes")
    large = cut(entries.groupBy("bucket", "chunk").count().where(F.col("count") > BLOCK).select("bucket", "chunk", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "large")
    spread = entries.join(large, ["bucket", "chunk"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    keyed = spread.select(F.xxhash64("bucket", "chunk", i, j).alias("key"), i.alias("i"), j.alias("j"), "bucket", "chunk", "own", "vid", "code")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "i", "j", "bucket", "chunk"]

    def pairs(signs, own, i, j, chunk):
        """Pairs of rows whose codes are near enough; each counts in the first table that it shares, and between two blocks only across them."""
        left, right = (np.flatnonzero(own == i), np.flatnonzero(own == j)) if i != j else (np.arange(len(own)),) * 2
        near = signs.shape[1] - signs[left] @ signs[right].T <= 2 * radius
        a, b = np.nonzero(np.triu(near, 1) if i == j else near)
        a, b = left[a], right[b]
        if chunk and len(a):
            earlier = signs[:, : chunk * bits].reshape(len(own), chunk, bits)
            fresh = np.concatenate([~(earlier[a[k : k + 65_536]] == earlier[b[k : k + 65_536]]).all(axis=2).any(axis=1) for k in range(0, len(a), 65_536)])
            a, b = a[fresh], b[fresh]
        return a, b

    def read_signs(codes):
        flat = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
        return np.unpackbits(flat, axis=1)[:, : bits * chunks].astype(np.float32) * 2 - 1

    def neighbours(batches):
        """The rows that another code of their bucket, or pair of blocks, is near enough to."""
        for t in whole_runs(batches, 5, 8192):
            key, i, j, bucket, chunk, own = (t.column(k).to_numpy() for k in range(6))
            signs, at = read_signs(t.column(7).to_pylist()), group_bounds([key, i, j, bucket, chunk])
            use = np.zeros(len(key), bool)
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                if hi - lo > 1:
                    for side in pairs(signs[lo:hi], own[lo:hi], i[lo], j[lo], int(chunk[lo])):
                        use[lo + side] = True
            if use.any():
                yield from t.take(pa.array(np.flatnonzero(use))).combine_chunks().to_batches()

    near = cut(keyed.repartition(partitions, "key").sortWithinPartitions(*order).mapInArrow(neighbours, keyed.schema), "near")
    vectors = near.join(unique.select("vid", "u", "copies", F.xxhash64("label").alias("lab"), "v"), "vid").select("key", "i", "j", "bucket", "chunk", "own", "vid", "code", "u", "copies", "lab", "v")

    def compared(batches):
        for t in whole_runs(batches, 5, 4096):
            key, i, j, bucket, chunk, own, vid = (t.column(k).to_numpy() for k in range(7))
            u, copies, lab = (t.column(k).to_numpy() for k in (8, 9, 10))
            lists = t.column(11).combine_chunks()
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            lengths = np.diff(at)
            signs, bounds = read_signs(t.column(7).to_pylist()), group_bounds([key, i, j, bucket, chunk])
            found = []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                a, b = pairs(signs[lo:hi], own[lo:hi], i[lo], j[lo], int(chunk[lo]))
                # A hash may bring several labels or lengths together; they are kept apart.
                same = (lab[lo + a] == lab[lo + b]) & (lengths[lo + a] == lengths[lo + b])
                a, b = a[same], b[same]
                if not len(a):
                    continue
                hit = np.zeros(len(a), bool)
                for d in np.unique(lengths[lo + a]):
                    mine = np.flatnonzero(lengths[lo : hi] == d)
                    x = np.zeros((hi - lo, d))
                    x[mine] = _unit(flat[at[lo + mine][:, None] + np.arange(d)])
                    these = np.flatnonzero(lengths[lo + a] == d)
                    if len(these) > (hi - lo) ** 2 // 64:
                        hit[these] = (x @ x.T)[a[these], b[these]] >= threshold
                    else:
                        hit[these] = np.einsum("ij,ij->i", x[a[these]], x[b[these]]) >= threshold
                a, b = a[hit], b[hit]
                if len(a):
                    links = np.bincount(a, copies[lo + b], hi - lo) + np.bincount(b, copies[lo + a], hi - lo)
                    keep = np.flatnonzero(links)
                    found.append((vid[lo + keep], u[lo + keep], links[keep].astype(np.int64), u[lo + forest(hi - lo, a, b)[keep]]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["vid", "u", "links", "root"])

    found = cut(vectors.repartition(partitions, "key").sortWithinPartitions(*order).mapInArrow(compared, "vid long, u long, links long, root long"), "links")
    totals = found.groupBy("vid").agg(F.sum("links").alias("links"))
    reach = components(found.select(F.col("u").alias("a"), F.col("root").alias("b")))
    classes = unique.select("vid", "label", "key", "u", "copies").join(totals, "vid", "left").join(reach.withColumnRenamed("node", "u"), "u", "left")
    classes = classes.select("label", "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "u").alias("component_id"))
    # Rows that link with nothing have a null key and stay out of the join.
    linked = rows.where("ok").select("id", "label", "key").join(classes, ["label", "key"]).select("id", "n_links", "component_id")
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)
