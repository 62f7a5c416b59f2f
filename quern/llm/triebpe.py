"""Byte-level BPE encoding over a trie of distinct words, and decoding.

A sequence of tokens is what BPE makes of its bytes exactly if each two
neighbours are what BPE makes of theirs (Berglund and van der Merwe, 2023). So
the last token of a prefix follows from those of shorter prefixes: it is the one
token at the prefix's end that agrees with the last token of what precedes it.
The distinct words of a slice of texts form a trie; going through it depth
first, with the last tokens of the path at hand, finds the last token of each
prefix once, however many words begin with it. A word's tokens are read off
backwards.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import giving_back, slices, utf8

#: What byte-level splitting cuts a text into, as the library has it. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on whose classes all versions of Unicode agree: up to Cyrillic, and general punctuation. Others are looked up one by one.
OTHERS = r"[^\x00-ԯ‐-‧‰-⁞€]"
#: Characters of words that a worker remembers the tokens of, about; it starts anew beyond.
REMEMBERED = 8 << 20
_LOADED: dict[str, BytePairs] = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: itself if printable, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Trie:
    """Distinct words as branches in depth-first order: a word, and the depth at which it leaves the path of the word before."""

    def __init__(self, words: Iterable[bytes]):
        self.branches: list[tuple[bytes, int]] = []
        for word in sorted(words):
            self._insert(word)

    def _insert(self, word: bytes) -> None:
        depth = 0
        if self.branches:
            before = self.branches[-1][0]
            most = min(len(before), len(word))
            if before[:most] == word[:most]:
                depth = most
            else:
                while before[depth] == word[depth]:
                    depth += 1
        self.branches.append((word, depth))

    def nodes(self) -> int:
        return sum(len(word) - depth for word, depth in self.branches)


class BytePairs:
    """The tokenizer of a file of the tokenizers library: byte-level splitting, merges by rank, tokens added to the vocabulary."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        model, pre = made["model"], made["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        added = made["added_tokens"]
        if model["type"] != "BPE" or odd or made["normalizer"] or made["post_processor"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or (made["decoder"] or {}).get("type") != "ByteLevel":
            raise ValueError("the file is not of a plain byte-level BPE")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that look at what is beside them are not supported")
        letters = byte_letters()
        spelt = {t: bytes(letters[c] for c in t) for t in model["vocab"] if all(c in letters for c in t)}
        self.parts: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        vocab = model["vocab"]
        self.bytes_of = {i: spelt.get(t, t.encode()) for t, i in vocab.items()}
        for b, c in ((b, c) for c, b in letters.items() if c in vocab):
            self.rank[vocab[c]] = -1
        for n, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            if not (left in self.rank and right in self.rank) or whole in self.rank:
                raise ValueError("a merge of tokens that are not made yet, or of one that is")
            self.parts[whole], self.pairs[left, right], self.rank[whole] = (left, right), n, n
        self.id_of = {self.bytes_of[i]: i for i in self.rank}
        if len(self.rank) - len(self.parts) != 256:
            raise ValueError("the vocabulary lacks bytes")
        #: Lengths of the tokens that end with three given bytes, longest first.
        ends: dict[bytes, set[int]] = {}
        for token in self.id_of:
            if len(token) > 2:
                ends.setdefault(token[-3:], set()).add(len(token))
        self.lengths = {k: (*sorted(v, reverse=True), *([2] if k[1:] in self.id_of else []), 1) for k, v in ends.items()}
        self.packed = {i: int(i).to_bytes(4, "little") for i in self.rank}
        self.added = {t["content"]: t["id"] for t in added}
        self.bytes_of |= {t["id"]: t["content"].encode() for t in added}
        self.cut_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        self.split, self.others = regex.compile(PATTERN), regex.compile(OTHERS)
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.same_class: dict[str, bool] = {}
        self.neighbours: dict[int, bool] = {}
        self.remembered: dict[str, bytes] = {}
        self.size = 0

    def agree(self, a: int, b: int) -> bool:
        """Whether BPE makes the tokens a and b of their bytes.

        Their merges are undone, the last first (of equal ranks, the right one,
        as the left is made first). If the two symbols that face each other at
        some moment merge before either goes into its own token, a and b never
        come about.
        """
        left_until = right_until = len(self.pairs)
        while True:
            n = self.pairs.get((a, b))
            if n is not None and n < left_until and n <= right_until:
                return False
            x, y = self.rank[a], self.rank[b]
            if x < 0 and y < 0:
                return True
            if x > y:
                a, left_until = self.parts[a][1], x
            else:
                b, right_until = self.parts[b][0], y

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Each distinct word, and its ids as little-endian unsigned 32-bit integers, packed."""
        lengths, id_of, neighbours, bytes_of, packed = self.lengths.get, self.id_of.get, self.neighbours, self.bytes_of, self.packed
        short, last = (2, 1), [0]  # the last tokens of the path's prefixes, by their length
        for word, depth in Trie(words).branches:
            del last[depth + 1 :]
            for end in range(depth + 1, len(word) + 1):
                for n in lengths(word[end - 3 : end] if end > 2 else None, short):
                    if n < end:
                        token = id_of(word[end - n : end])
                        if token is not None:
                            key = last[end - n] << 32 | token
                            fits = neighbours.get(key)
                            if fits is None:
                                fits = neighbours[key] = self.agree(last[end - n], token)
                            if fits:
                                break
                    elif n == end and (token := id_of(word[:end])) is not None:
                        break
                last.append(token)
            ids, end = [], len(word)
            while end:
                token = last[end]
                ids.append(packed[token])
                end -= len(bytes_of[token])
            ids.reverse()
            yield word, b"".join(ids)
        if len(neighbours) > 4 << 20:
            neighbours.clear()

    def words(self, text: str) -> list[str]:
        """The pieces that are encoded apart; the classes of characters are the library's, whose version of Unicode may be another one."""
        for c in set(self.others.findall(text)):
            if c not in self.same_class:
                probe = f"a{c}1{c}{c} {c}!"
                self.same_class[c] = self.split.findall(probe) == [probe[i:k] for _, (i, k) in self.library.pre_tokenize_str(probe)]
            if not self.same_class[c]:
                return [text[i:k] for _, (i, k) in self.library.pre_tokenize_str(text)]
        return self.split.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        runs: list[list] = []
        for text in texts:
            parts = self.cut_added.split(text) if self.cut_added else [text]
            runs.append([self.added[p] if k % 2 else self.words(p) for k, p in enumerate(parts)])
        if self.size > REMEMBERED:
            self.remembered.clear()
            self.size = 0
        new = {w for run in runs for p in run if not isinstance(p, int) for w in p if w not in self.remembered}
        for word, ids in self.encode_words(w.encode() for w in new):
            self.remembered[word.decode()] = ids
            self.size += len(word)
        of = self.remembered.__getitem__
        return [b"".join(int(p).to_bytes(4, "little") if isinstance(p, int) else b"".join(map(of, p)) for p in run) for run in runs]

    def decode(self, packed: bytes) -> bytes:
        """The text of packed ids in UTF-8; bytes that are none become U+FFFD, and ids without a token nothing."""
        found = b"".join(map(self.bytes_of.get, np.frombuffer(packed, "<u4").tolist(), iter(lambda: b"", None)))
        return found.decode("utf-8", "replace").encode()


def coder(path: str) -> BytePairs:
    """The tokenizer of a file, loaded once a process."""
    key = os.path.realpath(path)
    if key not in _LOADED:
        _LOADED[key] = BytePairs(path)
    return _LOADED[key]


def _run(fn, df: DataFrame, id_col: str, in_col: str, fields: list[T.StructField]) -> DataFrame:
    source = df.select(F.col(id_col), utf8(in_col).alias("__in"))
    schema = T.StructType([source.schema[0], *fields])

    @giving_back
    def over(batches):
        for batch in batches:
            for part in slices(batch, 1, 2 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), *fn(part.column(1))], names=schema.names)

    return source.mapInArrow(over, schema)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_decoded: bool = False) -> DataFrame:
    """One row for each row of df: its id, `ids` (little-endian unsigned 32-bit integers, packed) and, if asked for, `decoded`, their text in UTF-8.

    Ids are those of the tokenizers library with the file at path and
    add_special_tokens=False: tokens added to the vocabulary are found in the
    text, everything else is split and merged. Null and empty texts have no
    ids. Bytes that are no UTF-8 are read as U+FFFD. Rows with equal or null
    ids are rows of their own; an empty table gives an empty table. A slice of
    texts of about 2 MB is encoded at once, a longer text in one piece; memory
    follows its length, and time too, whatever its words look like.
    """
    fields = [T.StructField("ids", T.BinaryType()), *[T.StructField("decoded", T.BinaryType())] * with_decoded]

    def run(texts):
        pairs = coder(path)
        ids = pairs.encode([t.decode("utf-8", "replace") for t in texts.to_pylist()])
        return [pa.array(ids, pa.binary()), *([pa.array([pairs.decode(x) for x in ids], pa.binary())] if with_decoded else [])]

    return _run(run, df, id_col, text_col, fields)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row for each row of df: its id and `decoded`, the text of its packed ids in UTF-8, tokens added to the vocabulary included.

    Null and empty ids give an empty text, ids without a token nothing, and
    bytes that are no UTF-8 U+FFFD, as in the library.
    """
    return _run(lambda packed: [pa.array([coder(path).decode(x) for x in packed.to_pylist()], pa.binary())], df, id_col, ids_col, [T.StructField("decoded", T.BinaryType())])
