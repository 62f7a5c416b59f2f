"""Word segmentation by a dictionary: every word of it in a text, found in one pass of an automaton over a double-array trie.

In a trie kept as two arrays (Aoe, 1989) the child of node s by character c is
base[s] + c, if check there is s. With a failure link at each node, to the
longest proper suffix that is a node (Aho and Corasick, 1975), one pass meets all
words, overlapping ones too. A batch of texts is cut into lanes that overlap by
the longest word less one, and all lanes take a step at once.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import col

#: Characters that are written without blanks between words, as a class of a regular expression.
UNSPACED = r"\p{Han}"
#: Bytes of a dictionary that is sent to all tasks, at most.
DICTIONARY_BYTES = 64 << 20
#: Places of a lane, at least, and characters of a batch that are gone through at once.
LANE, BATCH = 256, 1 << 18


class DoubleArray:
    """A trie of words with failure links, as arrays; node 0 is the root, and code 0 stands for characters that no word has."""

    def __init__(self, words: Iterable[str]):
        words = sorted({w for w in words if w})
        letters = sorted({c for w in words for c in w})
        self.codes = {ord(c): k + 1 for k, c in enumerate(letters)}
        coded = [[self.codes[ord(c)] for c in w] for w in words]
        self.longest = max(map(len, words), default=1)
        width, self.base, self.check, self.length = len(letters) + 2, [0], [0], {}
        free, first = [], 1  # free[i]: whether slot i is; first: no slot before it is tried

        def grow(n):
            free.extend([True] * (n - len(free)))
            self.base.extend([0] * (n - len(self.base)))
            self.check.extend([-1] * (n - len(self.check)))

        grow(2 * width)
        free[0] = False
        level, order = [(0, 0, len(coded), 0)], [(0, 0, 0)]
        while level:
            below = []
            for node, lo, hi, depth in level:
                if lo < hi and len(coded[lo]) == depth:
                    self.length[node] = depth
                    lo += 1
                groups = []
                while lo < hi:
                    code, at = coded[lo][depth], lo
                    while lo < hi and coded[lo][depth] == code:
                        lo += 1
                    groups.append((code, at, lo))
                if not groups:
                    continue
                slot, tried = max(first, groups[0][0]), 0
                while True:
                    if slot + width >= len(free):
                        grow(2 * len(free))
                    if free[slot] and slot >= groups[0][0] and all(free[slot - groups[0][0] + c] for c, _, _ in groups):
                        break
                    slot, tried = slot + 1, tried + 1
                if tried > 64:  # what is left before here is nearly full
                    first = max(first, slot - 32)
                while not free[first]:
                    first += 1
                self.base[node] = slot - groups[0][0]
                for code, a, b in groups:
                    child = self.base[node] + code
                    free[child], self.check[child] = False, node
                    below.append((child, a, b, depth + 1))
                    order.append((child, node, code))
            level = below
        fail, out = [0] * len(self.base), [0] * len(self.base)
        for node, parent, code in order[1:]:
            at = parent
            while at:
                at = fail[at]
                to = self.base[at] + code
                if self.check[to] == at:
                    fail[node] = to
                    break
            out[node] = fail[node] if fail[node] in self.length else out[fail[node]]
        # Free slots name no node, so that no step ends in one; the root is nobody's child.
        self.base, self.check, self.fail, self.out = (np.array(x, np.int32) for x in (self.base, self.check, fail, out))
        self.check[0] = -1
        ends = np.zeros(len(self.base), np.int32)
        ends[list(self.length)] = list(self.length.values())
        self.length = ends

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of all words in an array of codes, in no order."""
        n, over = len(codes), self.longest - 1
        lane = max(LANE, 4 * over)
        lanes = -(-n // lane)
        wide = np.zeros(over + lanes * lane, np.int32)
        wide[over : over + n] = codes
        place = np.arange(lanes) * lane
        state, ends, lengths = np.zeros(lanes, np.int32), [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for t in range(over + lane):
            c = wide[place + t]
            to = self.base[state] + c
            bad = np.flatnonzero((self.check[to] != state) | (c == 0))
            while bad.size:
                at = state[bad]
                to[bad[at == 0]] = 0
                bad = bad[at > 0]
                state[bad] = at = self.fail[state[bad]]
                to[bad] = self.base[at] + c[bad]
                bad = bad[(self.check[to[bad]] != at) | (c[bad] == 0)]
            state = to
            if t >= over:  # what ends before belongs to the lane before
                found = np.where(self.length[state] > 0, state, self.out[state])
                hit = np.flatnonzero(found)
                while hit.size:
                    ends.append(place[hit] + t - over + 1)
                    lengths.append(self.length[found[hit]])
                    found[hit] = self.out[found[hit]]
                    hit = hit[found[hit] > 0]
        lengths = np.concatenate(lengths).astype(np.int64)
        return np.concatenate(ends) - lengths, lengths


@functools.cache
def members(characters: str) -> np.ndarray:
    """Whether each code point is in a class of characters."""
    import regex

    out = np.zeros(0x110000, bool)
    out[[ord(c) for c in regex.findall(characters, "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])))]] = True
    return out


class Segmenter:
    """Texts to words: those of a dictionary wherever they stand in characters of the class `unspaced`, and runs of other letters and digits."""

    def __init__(self, words: Iterable[str], unspaced: str = UNSPACED):
        import regex

        self.inside = members(unspaced)
        self.trie = DoubleArray(w for w in (w.lower() for w in words) if all(self.inside[ord(c)] for c in w))
        self.code = np.zeros(0x110000, np.int32)
        self.code[list(self.trie.codes)] = list(self.trie.codes.values())
        self.runs = regex.compile(rf"[[\p{{L}}\p{{N}}]--[{unspaced}]]+", regex.V1)

    def split(self, texts: list[str]) -> list[list[str]]:
        """The words of each text (in lower case already) by start, longer ones first."""
        return self.words(texts).to_pylist()

    def words(self, texts: list[str]) -> pa.Array:
        """split as an array of lists; a word is copied as bytes, so none is an object."""
        joined = "\n".join(texts)  # a line feed is in no word
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        start, length = self.trie.find(self.code[points])
        # Places that a word covers; characters of the class elsewhere are words of their own.
        edge = np.zeros(len(points) + 1, np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + length, -1)
        alone = np.flatnonzero(self.inside[points] & (np.cumsum(edge)[:-1] == 0))
        other = [m.span() for m in self.runs.finditer(joined)]
        start = np.concatenate([start, alone, np.array([a for a, _ in other], np.int64)])
        length = np.concatenate([length, np.ones(len(alone), np.int64), np.array([b - a for a, b in other], np.int64)])
        order = np.lexsort((-length, start))
        start, length = start[order], length[order]
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        byte = np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))  # where each character starts
        first, size = byte[start], byte[start + length] - byte[start]
        at = np.append(0, np.cumsum(size))
        held = data[np.repeat(first - at[:-1], size) + np.arange(at[-1])]
        found = pa.StringArray.from_buffers(len(start), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(held))
        places = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        return pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), found)


def segmenter(words: DataFrame, unspaced: str = UNSPACED) -> Callable[[str | Column], Column]:
    """A tokenizer, Column to Column, by the dictionary words (one column).

    In characters of the class `unspaced` every word of the dictionary is a
    token wherever it stands, also within others, and a character that none
    covers is one, too; runs of other letters and digits are tokens as they are.
    Tokens come in lower case by start, longer ones first. A null text has no
    tokens; words that are null, empty or have other characters are never
    found, and without any each character is a token.

    The dictionary goes to all tasks, so it is measured first: over
    DICTIONARY_BYTES it is an error, before any of it is sent.
    """
    name = words.columns[0]
    words = words.select(F.lower(F.col(name)).alias("word")).where("word <> ''").distinct()
    size = words.agg(F.sum(F.octet_length("word")).alias("size")).first().size or 0
    if size > DICTIONARY_BYTES:
        raise ValueError(f"a dictionary of {size} bytes is too large to send to all tasks")
    made = words.sparkSession.sparkContext.broadcast([r.word for r in words.orderBy("word").collect()])
    held: dict[int, Segmenter] = {}

    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if 0 not in held:
            held[0] = Segmenter(made.value, unspaced)
        for texts in batches:
            lengths = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
            lo = 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(lengths, (lengths[lo - 1] if lo else 0) + BATCH, "right")))
                yield held[0].words(texts.slice(lo, hi - lo).to_pylist())
                lo = hi

    def tokenizer(c: str | Column) -> Column:
        return F.arrow_udf(split, "array<string>")(F.lower(F.coalesce(col(c), F.lit(""))))

    return tokenizer
