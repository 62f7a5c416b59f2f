"""Near-equal lines by an exact set-similarity join.

The words of a line are a set, put in a global order from rare to frequent. Two
sets whose Jaccard similarity reaches the threshold share a word among their
first n - ceil(t * n) + 1 (Chaudhuri et al., 2006; Xiao et al., 2008), so lines
meet at these words; lengths and places in the order exclude most others, and
the whole sets decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import U64, buffers, cut, forest, giving_back, group_bounds, lower_bytes, mix, slices, span_hashes, utf8, whole_runs, words

#: Least similarity, and the least number of distinct words of a line that takes part.
SIMILARITY, LEAST_WORDS = 0.8, 5
#: Counters of the frequency sketch: a bound on what goes to the driver and back, whatever the input. Words that share a counter share a rarity,
#: which costs time and no result.
COUNTERS = 1 << 18
#: Lines of a group that are compared at once; larger groups are cut into pairs of blocks.
BLOCK = 1024
CHUNK_BYTES = 2 << 20
#: Words that occur at least so often deal their lines by length, too.
HOT = 1 << 15
#: Pairs of a word's lines that are held at once, about; more are reduced to what they connect.
PAIRS = 1 << 21
#: Lines of a key that one task compares with each other; those of a key with more are dealt out to tasks by pairs of blocks of half as many.
SPLIT = 16_384
#: Lines that a task remembers, about.
REMEMBERED = 400_000


def read_lines(data: np.ndarray, offs: np.ndarray):
    """(row, number) of each line, and (line, hash) of each word. Lines end with a line feed."""
    breaks = np.flatnonzero(data == 10)
    data = lower_bytes(data)
    starts, ends, wrow = words(data, offs)
    h = span_hashes(data, starts, ends)
    # A row has as many lines as line feeds and one; a line starts with its row or after a line feed.
    row_of = np.searchsorted(offs, breaks, "right") - 1
    count = np.bincount(row_of, minlength=len(offs) - 1) + 1
    first = np.append(0, np.cumsum(count))
    row = np.repeat(np.arange(len(offs) - 1), count)
    number = np.arange(first[-1]) - first[row]
    before = np.append(0, np.append(np.searchsorted(starts, breaks), len(starts)))
    line = np.repeat(np.arange(len(breaks) + 1), np.diff(before)) + wrow
    return row, number, line, h


def frequency_sketch(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """COUNTERS sums of word occurrences over all texts, by a hash of the word."""

    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for whole in batches:
            for batch in slices(whole, 0, CHUNK_BYTES):
                data, offs = buffers(batch.column(0))
                data = lower_bytes(data)
                starts, ends, _ = words(data, offs)
                total += np.bincount((span_hashes(data, starts, ends) % U64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["i", "n"])

    got = df.select(utf8(text_col).alias("text")).mapInArrow(giving_back(run), "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[got["i"].to_numpy()] = got["n"].to_numpy()
    return out


def _classes(sketch: np.ndarray) -> np.ndarray:
    """Counts as 8-bit steps of a logarithm."""
    return np.minimum(255, 6 * np.log2(1 + sketch)).astype(np.uint8)


def ordered_sets(line: np.ndarray, h: np.ndarray, lines: int, classes: np.ndarray):
    """(line, hash) of the distinct words of each line, lines in order, words from rare to frequent; and the number of words of each line."""
    bits = max(1, int(lines).bit_length())
    rank = classes[(h % U64(COUNTERS)).astype(np.int64)].astype(U64)
    key = (line.astype(U64) << U64(64 - bits)) | (rank << U64(56 - bits)) | (h >> U64(8 + bits))
    order = np.argsort(key)
    line, h = line[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
    line, h = line[new], h[new]
    return line, h, np.bincount(line, minlength=lines)


def _ceil_share(n: np.ndarray, t: float) -> np.ndarray:
    return np.ceil(t * n - 1e-9).astype(np.int64)


def bitmaps(h: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, in two integers: those that its words hash to. Words of one set only that differ in their bits bound what is common."""
    bit = U64(1) << (h & U64(63))
    upper = ((h >> U64(6)) & U64(1)).astype(bool)
    out = []
    for part in (np.where(upper, U64(0), bit), np.where(upper, bit, U64(0))):
        whole = np.zeros(len(n), U64)
        some = np.flatnonzero(n)
        if len(some):
            whole[some] = np.bitwise_or.reduceat(part, first[some])
        out.append(whole)
    return out[0], out[1]


def wide_bitmaps(h: np.ndarray, first: np.ndarray, n: np.ndarray, parts: int = 8) -> np.ndarray:
    """64 * parts bits of each set, one row of integers a set."""
    out = np.zeros((len(n), parts), U64)
    some = np.flatnonzero(n)
    bit, part = U64(1) << (h & U64(63)), ((h >> U64(6)) % U64(parts)).astype(np.int8)
    for k in range(parts):
        if len(some):
            out[some, k] = np.bitwise_or.reduceat(np.where(part == k, bit, U64(0)), first[some])
    return out


ROWS = T.StructType([T.StructField(c, T.LongType()) for c in ("word", "doc", "at", "low", "high")])
#: at packs line << 21 | distinct words (11 bits, more as the largest) << 10 | place in the order (10 bits, likewise); removed lines have no words.
_MOST_N, _MOST_P = 2047, 1023


def _pack(number, n, place):
    return (number << 21) | (np.minimum(n, _MOST_N) << 10) | np.minimum(place, _MOST_P)


def _alike(t: float) -> int:
    """Sets of at most so many words reach t with equal sets only."""
    n = 0
    while (n + 1) / (n + 2) < t - 1e-9:
        n += 1
    return n


def _prefixes(classes: np.ndarray, t: float, least: int):
    hot, alike = int(min(255, 6 * np.log2(1 + HOT))), _alike(t)

    def run(batches):
        seen = [np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)]  # hashes of sets, rising, and where they stand
        for whole in batches:
            for batch in slices(whole, 1, CHUNK_BYTES):
                data, offs = buffers(batch.column(1))
                row, number, line, h = read_lines(data, offs)
                if not len(h):
                    continue
                line, h, n = ordered_sets(line, h, len(row), classes)
                doc = batch.column(0).to_numpy()[row]
                first = np.append(0, np.cumsum(n))
                # Lines with equal sets: the first stays, the others go; here those of the chunk.
                a = np.append(U64(0), np.cumsum(mix(h)))
                b = np.append(U64(0), np.cumsum(mix(h ^ U64(0xABCDEF0123456789))))
                use = np.flatnonzero(n >= least)
                a, b = a[first[use + 1]] - a[first[use]], b[first[use + 1]] - b[first[use]]
                order = np.lexsort((number[use], doc[use], b, a))
                use, a, b = use[order], a[order], b[order]
                fresh = np.ones(len(use), bool)
                fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                # A row that repeats an id repeats its lines at the same places; these are not later.
                lead = use[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] if len(use) else use
                other = ~fresh & ((doc[use] != doc[lead]) | (number[use] != number[lead]))
                gone, use, a, b = use[other], use[fresh], a[fresh], b[fresh]
                # And those that repeat an earlier line of this task; what is forgotten is found later.
                if len(seen[0]) > REMEMBERED:
                    seen = [x[:0] for x in seen]
                at = np.searchsorted(seen[0], a)
                i = np.minimum(at, len(seen[0]) - 1)
                known = (seen[0][i] == a) & (seen[1][i] == b) if len(seen[0]) else np.zeros(len(a), bool)
                where, line_no = doc[use], number[use]
                again = known.copy()
                again[known] = (seen[2][i[known]] < where[known]) | ((seen[2][i[known]] == where[known]) & (seen[3][i[known]] < line_no[known]))
                first_ = np.flatnonzero(known & ~again)
                seen[2][i[first_]], seen[3][i[first_]] = where[first_], line_no[first_]
                fresh = np.flatnonzero(~known)
                seen = [np.insert(x, at[fresh], y[fresh]) for x, y in zip(seen, (a, b, where, line_no), strict=True)]
                gone, use, a = np.concatenate([gone, use[again]]), use[~again], a[~again]
                if len(gone):
                    none = pa.array(np.zeros(len(gone), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(mix(doc[gone].astype(U64)).astype(np.int64)), pa.array(doc[gone]), pa.array(number[gone] << 21), none, none], names=ROWS.names)
                if not len(use):
                    continue
                low, high = bitmaps(h, first[:-1], n)
                p = n[use] - _ceil_share(n[use], t) + 1
                owner = np.repeat(use, p)
                place = np.arange(p.sum()) - np.repeat(np.append(0, np.cumsum(p))[:-1], p)
                word = h[first[owner] + place]
                # The shortest lines meet equal ones at their whole sets; a frequent word's lines meet by lengths too, each those of its own class and of the next.
                short = n[owner] <= alike
                again = np.flatnonzero((classes[(word % U64(COUNTERS)).astype(np.int64)] >= hot) & ~short)
                size = np.floor(np.log(n[owner[again]]) / -np.log(t) + 1e-9).astype(U64) if t < 1 else n[owner[again]].astype(U64)
                key = np.where(short, np.repeat(a, p), word)
                key[again] = mix(word[again] ^ (size * U64(0x9E3779B97F4A7C15)))
                key = np.concatenate([key, mix(word[again] ^ ((size + U64(1)) * U64(0x9E3779B97F4A7C15)))]).astype(np.int64)
                at = _pack(number[owner], n[owner], place)
                rest = (np.concatenate([x, x[again]]) for x in (doc[owner], at, low[owner].astype(np.int64), high[owner].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*map(pa.array, (key, *rest))], names=ROWS.names)

    return run


#: Lines whose key has too many come out as they are, with -2 as the head's line, their place packed in `line`, and their key and bits.
GROUPS = T.StructType([T.StructField(c, T.LongType()) for c in ("doc", "line", "head_doc", "head_line", "word", "low", "high")])
LATER = -2


def _rows(*columns: np.ndarray, more: tuple[np.ndarray, ...] | None = None) -> pa.RecordBatch:
    n = len(columns[0])
    rest = map(pa.array, more) if more else [pa.nulls(n, pa.int64())] * 3
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), *rest], names=GROUPS.names)


def bounded_runs(batches, least: int, most: int):
    """(whether rows are parts of a group of more than `most`, table): groups of at most so many (and a batch) whole, several at once; larger ones in parts, never held whole.

    Batches are sorted by their first column, an integer.
    """
    held, rows, large = [], 0, None  # large: the key whose rows come in parts
    for batch in batches:
        while batch.num_rows:
            key = batch.column(0).to_numpy()
            if large is not None:
                n = int(np.searchsorted(key, large, "right"))
                if n:
                    yield True, pa.Table.from_batches([batch.slice(0, n)])
                batch = batch.slice(n)
                if batch.num_rows:
                    large = None
                continue
            held.append(batch)
            rows += batch.num_rows
            last = key[-1]
            # Rows at the end that may go on in the next batch.
            open_ = sum(b.num_rows - int(np.searchsorted(b.column(0).to_numpy(), last, "left")) for b in held)
            if open_ > most:
                table = pa.Table.from_batches(held).combine_chunks()
                if rows > open_:
                    yield False, table.slice(0, rows - open_)
                yield True, table.slice(rows - open_)
                held, rows, large = [], 0, last
            elif rows - open_ >= least:
                table = pa.Table.from_batches(held).combine_chunks()
                yield False, table.slice(0, rows - open_)
                held, rows = table.slice(rows - open_).to_batches(), open_
            break
    if held:
        yield False, pa.Table.from_batches(held).combine_chunks()


def similar_pairs(word, n, place, low, high, t: float):
    """Pairs of rows that share a word and pass the filters of length, place and bits, or pairs that connect the same; none that reaches t fails them."""
    order = np.lexsort((n, word))
    word, n, place = word[order], n[order], place[order]
    end = np.repeat(group_bounds([word])[1:], np.diff(group_bounds([word])))
    # The shorter line needs only a prefix in which an equal or longer one must meet it.
    i = np.flatnonzero(_able(n, place, t) & (np.arange(len(n)) + 1 < end))
    a, b = _walk(i, i + 1, end[i], n, place, low[order].view(U64), high[order].view(U64), t)
    return order[a], order[b]


def pairs_across(left, n, place, low, high, t: float):
    """As similar_pairs, of rows of one word: pairs of a row in `left` (a mask) and one that is not."""
    order = np.lexsort((n, ~left))
    m = int(left.sum())
    n, place, low, high = n[order], place[order], low[order].view(U64), high[order].view(U64)
    able = _able(n, place, t)
    found = []
    # The shorter line of a pair walks through the longer ones of the other side; of equally long ones the left.
    for own, lo, hi, side in ((np.flatnonzero(able[:m]), m, len(n), "left"), (m + np.flatnonzero(able[m:]), 0, m, "right")):
        at = lo + np.searchsorted(n[lo:hi], n[own], side)
        some = at < hi
        found.append(_walk(own[some], at[some], np.full(int(some.sum()), hi), n, place, low, high, t))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return order[a], order[b]


def _able(n, place, t: float):
    return (place < n - _ceil_share(n, 2 * t / (1 + t)) + 1) | (n >= _MOST_N) | (place >= _MOST_P)


def _walk(i, j, end, n, place, low, high, t: float):
    """Pairs (i, j) that pass the filters, for each i from its first j on to its end; n[j] rises and is n[i] at least."""
    found_i, found_j, held = [], [], 0
    while len(i):
        big = (n[i] >= _MOST_N) | (place[i] >= _MOST_P) | (place[j] >= _MOST_P)
        near = (n[i] >= t * n[j] - 1e-9) | (n[i] >= _MOST_N)
        i, j, end, big = i[near], j[near], end[near], big[near]
        need = np.ceil(t / (1 + t) * (n[i] + n[j]) - 1e-9)
        most = np.minimum(n[i] - place[i], n[j] - place[j]) + np.minimum(place[i], place[j])
        differ = np.bitwise_count(low[i] ^ low[j]).astype(np.int64) + np.bitwise_count(high[i] ^ high[j])
        ok = big | ((most >= need) & (n[i] + n[j] - differ >= 2 * need))
        found_i.append(i[ok])
        found_j.append(j[ok])
        held += len(found_i[-1])
        if held > PAIRS:  # near copies: what they connect is enough
            root = forest(len(n), np.concatenate(found_i), np.concatenate(found_j))
            linked = np.flatnonzero(root != np.arange(len(n)))
            found_i, found_j, held = [linked], [root[linked]], 0
        j = j + 1
        more = j < end
        i, j, end = i[more], j[more], end[more]
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (i, j)


def _named(doc, at, a, b):
    """Members of the groups that pairs (a, b) connect, as rows of GROUPS."""
    root = forest(len(doc), a, b)
    i = np.unique(np.concatenate([a, b]))
    order = np.lexsort((at[i] >> 21, doc[i], root[i]))
    i = i[order]
    g = group_bounds([root[i]])
    head = np.repeat(i[g[:-1]], np.diff(g))
    return _rows(doc[i], at[i] >> 21, doc[head], at[head] >> 21)


def _groups(t: float):
    """Members (doc, line, head_doc, head_line) of groups of lines that share a word and pass the filters, named by their earliest line; removed lines
    have -1 as the head's line, and lines of a key with too many are left for _split_groups. Near copies share many words, and their earliest line most
    of these, so most groups of one family have one name."""

    def run(batches):
        for large, table in bounded_runs(batches, 50_000, SPLIT):
            word, doc, at, low, high = (table.column(i).to_numpy() for i in range(5))
            gone = (at >> 10) & _MOST_N == 0
            if gone.any():
                i = np.flatnonzero(gone)
                none = np.full(len(i), -1)
                yield _rows(doc[i], at[i] >> 21, none, none)
            i = np.flatnonzero(~gone)
            if large:
                none = np.full(len(i), LATER)
                yield _rows(doc[i], at[i], none, none, more=(word[i], low[i], high[i]))
                continue
            bounds = group_bounds([word[i]])
            i = i[np.repeat(np.diff(bounds) > 1, np.diff(bounds))]
            if not len(i):
                continue
            a, b = similar_pairs(word[i], (at[i] >> 10) & _MOST_N, at[i] & _MOST_P, low[i], high[i], t)
            if len(a):
                # What such pairs connect at a word is a group.
                yield _named(doc[i], at[i], a, b)

    return run


def _split_groups(t: float):
    """As _groups, of one block with itself or of two with each other; batches are sorted by key, word, i and j."""

    def run(batches):
        for table in whole_runs(batches, 4):
            key, word, i, j, own, doc, at, low, high = (table.column(k).to_numpy() for k in range(9))
            bounds = group_bounds([key, word, i, j])
            for x, y in zip(bounds[:-1], bounds[1:], strict=True):
                n, place = (at[x:y] >> 10) & _MOST_N, at[x:y] & _MOST_P
                if i[x] == j[x]:
                    a, b = similar_pairs(word[x:y], n, place, low[x:y], high[x:y], t)
                else:
                    a, b = pairs_across(own[x:y] == i[x], n, place, low[x:y], high[x:y], t)
                if len(a):
                    yield _named(doc[x:y], at[x:y], a, b)

    return run


def _large_keys(members: DataFrame, similarity: float, parts: int) -> DataFrame:
    """Groups (doc, line, head_doc, head_line) of the lines whose keys have too many for one task: each pair of blocks of a key is compared by itself."""
    rows = members.where(F.col("head_line") == LATER).select("word", "doc", F.col("line").alias("at"), "low", "high")
    blocks = rows.groupBy("word").agg(F.ceil(F.count("*") / (SPLIT // 2)).cast("long").alias("blocks"))
    spread = rows.join(blocks, "word").withColumn("own", F.pmod(F.xxhash64("doc", "at"), F.col("blocks")))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    keyed = spread.select(F.xxhash64("word", i, j).alias("key"), "word", i.alias("i"), j.alias("j"), "own", "doc", "at", "low", "high")
    return keyed.repartition(parts, "key").sortWithinPartitions("key", "word", "i", "j").mapInArrow(giving_back(_split_groups(similarity)), GROUPS).select("doc", "line", "head_doc", "head_line")


def _line_sets(classes: np.ndarray):
    """doc, line, set (hashes, rising) of the asked lines of documents (doc, text, asked)."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 1, CHUNK_BYTES):
                data, offs = buffers(batch.column(1))
                row, number, line, h = read_lines(data, offs)
                asked = batch.column(2)
                arow = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))
                anum = asked.flatten().to_numpy()
                first = np.searchsorted(row, np.arange(batch.num_rows + 1))
                ok = anum < np.diff(first)[arow]
                want = np.unique(first[arow[ok]] + anum[ok])
                wanted = np.zeros(len(row), bool)
                wanted[want] = True
                use = wanted[line]
                line, h = line[use], h[use]
                order = np.lexsort((h, line))
                line, h = line[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
                line, h = line[new], h[new]
                at = np.searchsorted(line, np.append(want, len(row)))
                raw = [h[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[row[want]]), pa.array(number[want]), pa.array(raw, pa.binary())], names=["doc", "line", "set"])

    return run


def later_matches(bounds: np.ndarray, raw: list[bytes], own: np.ndarray | None, t: float) -> np.ndarray:
    """Which rows have a Jaccard similarity of at least t with an earlier one of their group (of another block, where own tells blocks apart).

    Rows come in order within groups, whose bounds are given; raw has their sets,
    hashes in rising order. All groups advance together: first each row meets
    the first of its group, which most copies match, then those that are left
    meet the row before, the one before that, and so on.
    """
    n = np.array([len(x) >> 3 for x in raw])
    flat, at = np.frombuffer(b"".join(raw), U64), np.append(0, np.cumsum(n))
    bits = wide_bitmaps(flat, at[:-1], n)
    # Row and upper bits of a hash in one rising key; the whole hash decides.
    key = (np.repeat(np.arange(len(n)), n).astype(U64) << U64(40)) | (flat >> U64(24))
    first = np.repeat(bounds[:-1], np.diff(bounds))
    gone = np.zeros(len(n), bool)

    def meet(i, j):
        near = (n[i] >= t * n[j] - 1e-9) & (n[j] >= t * n[i] - 1e-9)
        if own is not None:
            near &= own[i] != own[j]
        i, j = i[near], j[near]
        differ = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
        near = n[i] + n[j] - differ >= 2 * (t / (1 + t) * (n[i] + n[j]) - 1e-9)
        i, j = i[near], j[near]
        ends = np.cumsum(n[j])
        lo = 0
        while lo < len(j):  # about a million words at once
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 20), "right")))
            a, b = i[lo:hi], j[lo:hi]
            start = np.append(0, np.cumsum(n[b]))[:-1]
            owner = np.repeat(np.arange(len(b)), n[b])
            word = flat[at[b][owner] + np.arange(len(owner)) - start[owner]]
            place = np.minimum(np.searchsorted(key, (a[owner].astype(U64) << U64(40)) | (word >> U64(24))), len(flat) - 1)
            hit = (flat[place] == word) & (place < at[a + 1][owner])
            common = np.bincount(owner, hit, len(b))
            gone[b[common >= t * (n[a] + n[b] - common) - 1e-9]] = True
            lo = hi

    j = np.flatnonzero(np.arange(len(n)) > first)
    meet(first[j], j)
    j, step = j[~gone[j]], 1
    while len(j := j[(j - step > first[j]) & ~gone[j]]):
        meet(j - step, j)
        step += 1
    return gone


def _decide(t: float):
    def run(batches):
        for table in whole_runs(batches, 5, 16_384):
            key, g, h, i, j, own, doc, line = (table.column(k).to_numpy() for k in range(8))
            bounds = group_bounds([key, g, h, i, j])
            group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            order = np.lexsort((line, doc, group))
            # Rows that repeat an id repeat their lines.
            once = np.append(True, (group[order][1:] != group[order][:-1]) | (doc[order][1:] != doc[order][:-1]) | (line[order][1:] != line[order][:-1]))
            order = order[once]
            raw = table.column(8).combine_chunks().take(pa.array(order)).to_pylist()
            # Within a block all pairs count, between two blocks those across them.
            side = np.where(i[order] == j[order], -1 - np.arange(len(order)), own[order])
            gone = order[later_matches(group_bounds([group[order]]), raw, side, t)]
            if len(gone):
                yield pa.RecordBatch.from_arrays([pa.array(doc[gone]), pa.array(line[gone])], names=["doc", "line"])

    return run


def later_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row (doc, line) for each line that repeats an earlier one; lines count from 0.

    A line's words are its runs of letters and digits, in lower case, each once.
    Lines with fewer distinct words than least_words take no part. A line repeats
    another if the Jaccard similarity of their sets is at least `similarity` and
    the other is earlier: in a document of a smaller id, or earlier in the same
    one; that the other may go as well does not matter. Null and empty texts
    have no such lines; rows with a null id take no part; of rows that repeat an
    id, lines of one number count as one. Ids are whole numbers, or texts of such, as
    the smaller one comes first; other ids are an error. An empty table gives an
    empty table.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col(id_col).cast("long").alias("doc"), utf8(text_col).alias("text")).where("doc is not null")
    classes = _classes(frequency_sketch(docs))
    rows = docs.mapInArrow(giving_back(_prefixes(classes, similarity, least_words)), ROWS)
    members = cut(rows.repartition(n, "word").sortWithinPartitions("word").mapInArrow(giving_back(_groups(similarity)), GROUPS), "groups")
    equal = members.where("head_line = -1").select("doc", "line")
    found = members.where("head_line >= 0").select("doc", "line", "head_doc", "head_line")
    if members.where(F.col("head_line") == LATER).limit(1).count():
        found = found.unionByName(_large_keys(members, similarity, n))
    kept = cut(found.distinct(), "members")
    large = cut(kept.groupBy("head_doc", "head_line").count().where(F.col("count") > BLOCK).select("head_doc", "head_line", F.ceil(F.col("count") / BLOCK).cast("long").alias("blocks")), "large")
    asked = kept.groupBy("doc").agg(F.collect_set("line").alias("asked"))
    sets = cut(docs.join(asked.hint("merge"), "doc").mapInArrow(giving_back(_line_sets(classes)), "doc long, line long, set binary").dropDuplicates(["doc", "line"]), "sets")
    # Few groups are large, so that their table says itself how it is joined.
    spread = kept.join(large, ["head_doc", "head_line"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    spread = spread.withColumn("own", F.pmod(F.xxhash64("doc", "line"), F.col("blocks")).cast("long"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).join(sets, ["doc", "line"])
    i, j = F.least("own", "other"), F.greatest("own", "other")
    keyed = spread.select(F.xxhash64("head_doc", "head_line", i, j).alias("key"), F.col("head_doc").alias("g"), F.col("head_line").alias("h"), i.alias("i"), j.alias("j"), "own", "doc", "line", "set")
    similar = keyed.repartition(n, "key").sortWithinPartitions("key", "g", "h", "i", "j").mapInArrow(giving_back(_decide(similarity)), "doc long, line long")
    return cut(equal.unionByName(similar).distinct(), "later")


def remove_lines(df: DataFrame, later: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df without the lines of later (doc, line), other columns as they are, whatever their names.

    Documents of which no line stays stay, with an empty text; null texts stay
    null, and rows with a null id stay as they are. All rows of an id lose the
    lines of its numbers. An empty table gives an empty table.
    """
    lines = later.groupBy("doc").agg(F.collect_set("line").alias("gone")).select(F.struct("doc", "gone").alias("later"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    joined = rows.join(lines, F.col(f"row.`{id_col}`") == F.col("later.doc"), "left")
    names = df.columns
    at = names.index(text_col)

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                out = []
                for text, gone in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1), strict=True):
                    if text is not None and gone.is_valid:
                        gone = set(gone.values.to_pylist())
                        text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
                    out.append(text)
                columns = batch.columns[:-1]
                columns[at] = pa.array(out, columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.select("row.*", "later.gone").mapInArrow(giving_back(run), df.schema)
