"""What the operators share: the shared folder, text slices, word hashes, components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.shared import cut

U64 = np.uint64
#: An odd multiplier and its inverse modulo 2**64, for polynomial hashes.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(col: str | Column) -> Column:
    """Text as bytes, null as empty."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("binary"), F.lit(b""))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string array without nulls, and the offsets of its values in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, text: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most so many bytes of text, at least one row each; each row stays whole."""
    if not batch.num_rows:
        return
    _, offs = buffers(batch.column(text))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def giving_back(run):
    """run, a function over batches, after which the worker gives back what it no longer needs: the next task may be another stage's."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return wrapped


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n or len(_POWERS["up"]) > 4 * n + (1 << 23):
        m = max(n, 1 << 16)
        _POWERS["up"], _POWERS["down"] = powers(BASE, m), powers(BASE_INV, m)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them (the finaliser of SplitMix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span; equal content gives equal hashes wherever it stands."""
    if not len(starts):
        return np.zeros(0, U64)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


#: Letters and digits of ASCII and every byte of longer code points belong to words.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Everything but ASCII white space and controls.
INK_BYTE = np.ones(256, bool)
INK_BYTE[:33] = False


def words(data: np.ndarray, offs: np.ndarray, belongs: np.ndarray = WORD_BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each word: a longest run of bytes that belong to words, within a row."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = belongs[data]
    left = np.zeros(n + 1, bool)
    left[1:] = inside
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = left.copy()
    before[edge] = False  # a row's first byte has no word byte before it
    starts = np.flatnonzero(inside & ~before[:n])
    here = np.zeros(n + 1, bool)
    here[:n] = inside
    here[edge] = False
    ends = np.flatnonzero(left & ~here)
    # Starts rise, so counting them between offsets is far cheaper than looking each one up.
    row = np.repeat(np.arange(len(offs) - 1), np.diff(np.searchsorted(starts, offs)))
    return starts, ends, row


def components(edges: DataFrame) -> DataFrame:
    """node, component of an undirected graph given as rows (a, b): the smallest node that links reach.

    Alternating large and small stars (Kiveris et al., 2014), until nothing is
    left to do, which takes about the squared logarithm of the nodes in rounds.
    Each is written to the shared folder; only a count returns to the driver. A
    node with very many neighbours takes part through map-side minima, and the
    joins that hand a minimum to its neighbours are ones that AQE can split.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()
        now = cut(small, "star")
        # Done once every node has one neighbour, and none of these has another.
        if not (now.groupBy("a").count().where("count > 1").limit(1).count() or now.alias("x").join(now.alias("y"), F.col("x.b") == F.col("y.a")).limit(1).count()):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def whole_runs(batches: Iterator[pa.RecordBatch], keys: int, least: int = 1) -> Iterator[pa.Table]:
    """Tables of whole groups, of about `least` rows at least, from batches sorted by their first `keys` columns (integers without nulls)."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        if len(held) > 1:
            last = held[-2]
            change[0] = any(columns[i][0] != last.column(i)[-1].as_py() for i in range(keys))
        if (at := np.flatnonzero(change)).size:
            held[-1] = batch.slice(0, at[-1])
            if whole := [b for b in held if b.num_rows]:
                yield pa.Table.from_batches(whole).combine_chunks()
            held = [batch.slice(at[-1])]
            rows = held[0].num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_bounds(columns: list[np.ndarray]) -> np.ndarray:
    """Places where a group of equal rows starts, and the number of rows."""
    n = len(columns[0])
    change = np.zeros(n, bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(change), n)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the edges (a, b) reach."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            return root


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """UTF-8 with the letters of ASCII and Latin-1 in lower case."""
    out = _LOWER[data]
    if len(data) > 1:
        second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[second] += 32
    return out
