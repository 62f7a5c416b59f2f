"""Texts to vectors, through an embedder that is a parameter."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Dimensions of the local embedder.
DIMS = 64
#: Letters of the longest word whose hash a worker remembers, and how many words.
REMEMBERED = 64, 1 << 18
_WORD = re.compile(r"[^\W_]+")
#: What is between the words of a text without other letters, which is split faster so.
_BETWEEN = {i: " " for i in range(128) if not chr(i).isalnum()}


class _Hashes(dict):
    """The first 32 bits of words' MD5."""

    def __missing__(self, word: str) -> int:
        out = int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big")
        if len(word) <= REMEMBERED[0] and len(self) < REMEMBERED[1]:
            self[word] = out
        return out


_HASHES = _Hashes()


def hashed_words(texts: list[str], dims: int = DIMS) -> np.ndarray:
    """A local, deterministic embedder: each word adds one at the place that the first 32 bits of its MD5 name; vectors have length 1, or are zero."""
    out = np.zeros((len(texts), dims))
    for i, text in enumerate(texts):
        text = text.lower()
        words = text.translate(_BETWEEN).split() if text.isascii() else _WORD.findall(text)
        hashes = [_HASHES[w] for w in words]
        out[i] = np.bincount(np.array(hashes, np.int64) % dims, minlength=dims)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def embed(df: DataFrame, id_col: str, text_col: str, embedder: Callable[[list[str]], np.ndarray] = hashed_words, batch: int = 256) -> DataFrame:
    """(id_col, vector) of all rows; null texts count as empty. The embedder gets at most `batch` texts at once and gives a row of numbers for each."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                b = whole.slice(lo, batch)
                x = np.asarray(embedder([t or "" for t in b.column(1).to_pylist()]), np.float64)
                at = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], names=[id_col, "vector"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, vector array<double>")
