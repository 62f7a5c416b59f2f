"""Shards by a permutation-filled lookup table (Maglev; Eisenbud et al., 2016)."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A prime, at least a hundred times the number of shards, so that shares differ by about 1 %.
TABLE_SIZE = 65537


def _two_hashes(name: str, size: int) -> tuple[int, int]:
    digest = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:16], "big") % (size - 1) + 1


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> np.ndarray:
    """For each slot the index of the shard that owns it.

    Each shard prefers the slots in the order offset + k * skip (mod size); size
    is a prime, so that is a permutation. The shards take turns, in the given
    order, and each claims the first slot it prefers that is free, until no slot
    is. Shares differ by one slot at most, and when a shard goes, few slots of
    the others change hands.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if size < len(shards) or size < 3 or any(size % p == 0 for p in range(2, int(size**0.5) + 1)):
        raise ValueError(f"{size} is no prime of at least the number of shards")
    offset, skip = zip(*(_two_hashes(s, size) for s in shards), strict=True)
    owner, turn, filled = np.full(size, -1, np.int32), [0] * len(shards), 0
    while True:
        for i in range(len(shards)):
            while owner[slot := (offset[i] + turn[i] * skip[i]) % size] >= 0:
                turn[i] += 1
            owner[slot] = i
            turn[i] += 1
            filled += 1
            if filled == size:
                return owner


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The first 60 bits of the MD5 of the key as text, modulo the table size; a null key counts as an empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size))


def _placed(df: DataFrame, shards: list[str], key_col: str, size: int) -> DataFrame:
    """(slot, row, shard): the rows of df as structs, so that none of their columns can clash."""
    rows = [(i, shards[k]) for i, k in enumerate(lookup_table(shards, size).tolist())]
    lookup = df.sparkSession.createDataFrame(rows, T.StructType([T.StructField("slot", T.LongType(), False), T.StructField("shard", T.StringType(), False)]))
    return df.select(slot_of(F.col(key_col), size).alias("slot"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")).join(F.broadcast(lookup), "slot", "left")


def assign_shards(df: DataFrame, shards: list[str], key_col: str = "doc_id", size: int = TABLE_SIZE) -> DataFrame:
    """One row for each row of df: its key, `slot` and `shard`.

    Equal keys always share a shard, null ones included; no source, label or
    size of text plays a part, so a hot group spreads. The table has `size` rows
    whatever the data are, so it is broadcast: placement is one look-up, without
    a shuffle. An empty table gives an empty table. The key's column may have
    any name but `slot` and `shard`, which the result would have twice.
    """
    if key_col in ("slot", "shard"):
        raise ValueError(f"the result has a column {key_col} of its own")
    return _placed(df.select(key_col), shards, key_col, size).select(F.col("row")[key_col].alias(key_col), "slot", "shard")


def write_shards(df: DataFrame, path: str, shards: list[str], key_col: str = "doc_id", size: int = TABLE_SIZE, folder: str = "__shard") -> None:
    """df as Parquet, one folder a shard, each with its own files from every task, so no shard passes through one task.

    Rows with a null key go where assign_shards puts them; all columns of df are
    written, whatever their names, but for one that is called as the folders
    are, which is an error. An empty table writes no shard.
    """
    if folder in df.columns:
        raise ValueError(f"df has a column {folder}")
    placed = _placed(df, shards, key_col, size)
    placed.select(*[F.col("row")[c].alias(c) for c in df.columns], F.col("shard").alias(folder)).write.partitionBy(folder).parquet(path)
