"""Benchmark passages in documents, paraphrased ones too: latent semantic search, then subsequences and answers.

Passages (overlapping windows of words) are TF-IDF vectors over the words of the
benchmark's items. A randomised singular value decomposition of the matrix of
all passages and the items (Halko et al., 2011; one pass, by a sketch of its Gram
matrix) gives a latent space; passages whose cosine with an item is large enough
there are compared with it word by word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import buffers, giving_back, lower_bytes, slices, span_hashes, utf8, words

#: Words of a passage, and from one passage's start to the next. Items of more than LONG words are searched by their own passages.
PASSAGE, STRIDE, LONG = 64, 32, 96
#: The most dimensions of the latent space.
RANK = 128
#: Words in more than this share of passages have no weight, unless they are among the ANSWER_WORDS rarest of an item's passage.
COMMON = 0.002
#: Least cosine of a candidate; least share of an item's words in the longest common subsequence; least share of its rarest words that occur.
COSINE, SUBSEQUENCE, ANSWER, ANSWER_WORDS = 0.35, 0.6, 0.5, 8
#: Passages, and items' passages, whose cosines are held at once; terms of a row of the sketch on its way.
ROWS, UNITS, TERMS = 2048, 2048, 256
CHUNK_BYTES = 1 << 20


def _word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = lower_bytes(data)
    starts, ends, row = words(data, offs)
    return span_hashes(data, starts, ends), row


def _term(vocabulary: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in the vocabulary, -1 for other words."""
    if not len(vocabulary):
        return np.full(len(h), -1, np.int64)
    i = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return np.where(vocabulary[i] == h, i, -1)


def passage_counts(term: np.ndarray, place: np.ndarray, first: np.ndarray, terms: int):
    """(passage, term, occurrences) of the weighted words; passage is the number of its row's first passage plus its own.

    place: a word's place in its row; first: for each word, the number of its row's first passage. Word w is in the passages that start at
    w // STRIDE * STRIDE and PASSAGE - STRIDE words earlier.
    """
    k = place // STRIDE
    both = np.concatenate([first + k, (first + k - 1)[k > 0]])
    t = np.concatenate([term, term[k > 0]])
    key, n = np.unique(both * terms + t, return_counts=True)
    return key // terms, key % terms, n


def longest_common_subsequence(a: list[int], b: list[int]) -> int:
    """Length, with one bit for each element of a (Hyyrö, 2004)."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        if m := where.get(y, 0):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _latent(z: np.ndarray, omega: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors of X, as columns, from Z = X'X omega (a Nyström approximation)."""
    shift = np.finfo(np.float64).eps * np.linalg.norm(z) * len(z) ** 0.5
    z = z + shift * omega
    core = omega.T @ z
    w, v = np.linalg.eigh((core + core.T) / 2)
    keep = w > max(w.max(), 0) * 1e-12
    root = z @ (v[:, keep] / np.sqrt(w[keep]))
    u, s, _ = np.linalg.svd(root, full_matrices=False)
    return u[:, s > s.max() * 1e-9][:, :rank] if len(s) and s.max() > 0 else np.zeros((len(z), 0))


def units(h: np.ndarray, row: np.ndarray, items: int) -> tuple[list[int], list[np.ndarray]]:
    """(item, words) of what is searched: short items as a whole, long ones in passages, the last of which ends with the item."""
    owner, out = [], []
    for i in range(items):
        x = h[row == i] if items < 64 else h[np.searchsorted(row, i) : np.searchsorted(row, i + 1)]
        starts = [0] if len(x) <= LONG else [*range(0, len(x) - PASSAGE, STRIDE), len(x) - PASSAGE]
        for a in starts if len(x) else []:
            owner.append(i)
            out.append(x[a:] if len(x) <= LONG else x[a : a + PASSAGE])
    return owner, out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row (doc_id, item_id, cosine, subsequence, answer) for each document and item of which it holds a passage.

    Words are runs of letters and digits in lower case, so case and punctuation
    play no part. Every passage of every whole text is searched for every item;
    an item of more than LONG words is found by any of its own passages. Words
    that most passages share have no weight in the search, but count in the
    subsequence. Items and texts that are null or have no words match nothing;
    a null id stays null; rows that repeat an id give one row an item, with the
    best values; items that repeat both id and text are searched once. Empty
    tables give an empty table.

    The benchmark is the query set: its distinct rows go to the driver and the
    tasks. One vocabulary, one set of weights and one latent space serve all
    items; the texts are read three times, whatever the number of items.
    """
    item_type = benchmark.schema[item_col].dataType
    items = benchmark.select(F.col(item_col).alias("item"), utf8(item_text_col).alias("text")).where(F.octet_length("text") > 0).distinct()
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("item_id", item_type), *[T.StructField(c, T.DoubleType()) for c in ("cosine", "subsequence", "answer")]])
    texts = docs.select(F.col(id_col).alias("doc"), utf8(text_col).alias("text"))
    rows = items.orderBy("item", "text").toArrow()
    out = _search(texts, rows["item"].combine_chunks(), rows["text"].to_pylist(), schema)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    best = F.max(F.struct("subsequence", "cosine", "answer"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.cosine", "b.subsequence", "b.answer")


def _search(texts: DataFrame, names: pa.Array, item_texts: list[bytes], schema: T.StructType) -> DataFrame | None:
    data = np.frombuffer(b"".join(item_texts), np.uint8)
    h, row = _word_hashes(data, np.append(0, np.cumsum([len(t) for t in item_texts])))
    owner, each = units(h, row, len(item_texts))
    if not each:
        return None
    owner = np.array(owner)
    vocabulary = np.unique(h)
    v = len(vocabulary)
    spark = texts.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    # How many passages hold a word: over blocks that don't overlap, of all texts.
    def count(batches):
        df, total = np.zeros(v + 1, np.int64), 0
        for whole in batches:
            for batch in slices(whole, 0, CHUNK_BYTES):
                h, row = _word_hashes(*buffers(batch.column(0)))
                if not len(h):
                    continue
                first = np.searchsorted(row, np.arange(batch.num_rows))
                k = (np.arange(len(h)) - first[row]) // PASSAGE
                of = np.cumsum(np.append(True, (k[1:] != k[:-1]) | (row[1:] != row[:-1]))) - 1
                total += int(of[-1]) + 1
                t = _term(vocabulary, h)
                key = np.unique((of * (v + 1) + t)[t >= 0])
                df += np.bincount(key % (v + 1), minlength=v + 1)
        df[v] = total
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "n"])

    got = texts.select("text").mapInArrow(giving_back(count), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(v + 1, np.int64)
    df[got["term"].to_numpy()] = got["n"].to_numpy()
    total, df = int(df[v]), df[:v]
    idf = np.log((1 + total) / (1 + df)) + 0.1
    rarest = [x[np.argsort(-idf[x], kind="stable")][:ANSWER_WORDS] for x in (np.unique(_term(vocabulary, e)) for e in each)]
    heavy = np.union1d(np.flatnonzero(df <= max(1.0, COMMON * total)), np.concatenate(rarest))
    rank = min(RANK, len(each), len(heavy))
    rng = np.random.default_rng(3)
    omega = rng.normal(size=(len(heavy), min(len(heavy), rank + 16))).astype(np.float32)
    slot = np.full(v, -1)
    slot[heavy] = np.arange(len(heavy))
    weight = idf[heavy]

    def passages(t, row, rows):
        """(passage, term among the heavy ones, weight) of a chunk's words, and for each row the number of its first passage and word."""
        first_word = np.searchsorted(row, np.arange(rows + 1))
        n = np.diff(first_word)
        first = np.append(0, np.cumsum(-(-n // STRIDE)))
        t = np.where(t >= 0, slot[t], -1)
        use = np.flatnonzero(t >= 0)
        place = use - first_word[row[use]]
        p, t, c = passage_counts(t[use], place, first[row[use]], len(heavy))
        return p, t, (1 + np.log(c)) * weight[t], first, first_word

    def sketch(batches):
        z = np.zeros(omega.shape)
        for whole in batches:
            for batch in slices(whole, 0, CHUNK_BYTES):
                h, row = _word_hashes(*buffers(batch.column(0)))
                p, t, w, *_ = passages(_term(vocabulary, h), row, batch.num_rows)
                if len(p):
                    _add_gram(z, p, t, w.astype(np.float32), omega)
        at = [k for k in range(0, len(z), TERMS) if z[k : k + TERMS].any()]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([z[k : k + TERMS].astype(np.float32).tobytes() for k in at], pa.binary())], names=["term", "z"])

    def added(batches):
        """One row for each term that rows start with: their sum."""
        now, z = None, None
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([z.tobytes()], pa.binary())], names=["term", "z"])
                    now, z = k, 0.0
                z = z + np.frombuffer(raw, np.float32).astype(np.float64)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([z.tobytes()], pa.binary())], names=["term", "z"])

    z = np.zeros(omega.shape)
    parts = texts.select("text").mapInArrow(giving_back(sketch), "term long, z binary").repartition(partitions, "term").sortWithinPartitions("term")
    for r in parts.mapInArrow(giving_back(added), "term long, z binary").collect():
        z[r.term : r.term + TERMS] = np.frombuffer(r.z).reshape(-1, z.shape[1])
    # The items are rows of the matrix too, so that those which occur once or never have their place in the space.
    ui, ut = np.repeat(np.arange(len(each)), [len(x) for x in each]), slot[_term(vocabulary, np.concatenate(each))]
    key, c = np.unique((ui * len(heavy) + ut)[ut >= 0], return_counts=True)
    ui, ut = key // len(heavy), key % len(heavy)
    uw = (1 + np.log(c)) * weight[ut]
    own = np.zeros(omega.shape)
    _add_gram(own, ui, ut, uw.astype(np.float32), omega)
    z += own * (1 + total / len(each))
    space = _latent(z, omega.astype(np.float64), rank)
    q = np.zeros((len(each), space.shape[1]))
    np.add.at(q, ui, space[ut] * uw[:, None])
    norms = np.linalg.norm(q, axis=1)
    q = np.where(norms[:, None] > 0, q / np.maximum(norms, 1e-300)[:, None], 0).astype(np.float32)
    space32 = space.astype(np.float32)
    # Answer words: for each word of the vocabulary the units that it is one of the rarest of; and how many of a unit's must occur.
    at = np.argsort(np.concatenate(rarest), kind="stable")
    answer_of = np.repeat(np.arange(len(each)), [len(x) for x in rarest])[at]
    answer_first = np.searchsorted(np.concatenate(rarest)[at], np.arange(v + 1))
    need = np.array([-(-len(x) * ANSWER // 1) for x in rarest])
    lengths = np.array([len(x) for x in each])
    lists, answers = [x.tolist() for x in each], [set(vocabulary[x].tolist()) for x in rarest]

    def search(batches):
        for whole in batches:
            for batch in slices(whole, 1, CHUNK_BYTES):
                h, row = _word_hashes(*buffers(batch.column(1)))
                t = _term(vocabulary, h)
                p, pt, w, first, first_word = passages(t, row, batch.num_rows)
                if not len(p):
                    continue
                # Places of answer words, in one rising key of unit and place.
                use = np.flatnonzero(t >= 0)
                many = np.diff(answer_first)[t[use]]
                k = np.repeat(answer_first[t[use]], many) + np.arange(many.sum()) - np.repeat(np.append(0, np.cumsum(many))[:-1], many)
                wide = len(h) + 1
                where = np.sort(answer_of[k] * wide + np.repeat(use, many))
                at = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
                ends = np.append(at[1:], len(p))
                found: list[tuple] = []
                for i in range(0, len(at), ROWS):
                    a, b = at[i], ends[min(len(at), i + ROWS) - 1]
                    x = np.add.reduceat(space32[pt[a:b]] * w[a:b, None].astype(np.float32), at[i : i + ROWS] - a, axis=0)
                    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
                    for j in range(0, len(q), UNITS):
                        cosine = x @ q[j : j + UNITS].T
                        pi, pj = np.nonzero(cosine >= COSINE)
                        if not len(pi):
                            continue
                        value, passage, unit = cosine[pi, pj], p[at[i + pi]], pj + j
                        r = np.searchsorted(first, passage, "right") - 1
                        lo = first_word[r] + (passage - first[r]) * STRIDE
                        # The passage, and as much around it as the item may reach beyond.
                        hi = np.minimum(first_word[r + 1], lo + PASSAGE + lengths[unit])
                        lo = np.maximum(first_word[r], lo - lengths[unit])
                        seen = np.searchsorted(where, unit * wide + hi) - np.searchsorted(where, unit * wide + lo)
                        for c in np.flatnonzero(seen >= need[unit]):  # occurrences; that distinct words suffice is seen below
                            near, u = h[lo[c] : hi[c]].tolist(), int(unit[c])
                            answer = len(answers[u].intersection(near)) / len(answers[u])
                            if answer >= ANSWER and (common := longest_common_subsequence(lists[u], near) / len(lists[u])) >= SUBSEQUENCE:
                                found.append((int(r[c]), int(owner[u]), float(value[c]), common, answer))
                if found:
                    rows, own, *values = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), names.take(pa.array(own)), *[pa.array(x, pa.float64()) for x in values]], names=schema.names)

    return texts.mapInArrow(giving_back(search), schema)


def _add_gram(z: np.ndarray, p: np.ndarray, t: np.ndarray, w: np.ndarray, omega: np.ndarray, step: int = 20_000) -> None:
    """z += X'X omega for the rows of X that p numbers, in rising order."""
    at = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
    ends = np.append(at[1:], len(p))
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(ends, at[lo] + step, "right")))
        a, b = at[lo], ends[hi - 1]
        xo = np.add.reduceat(omega[t[a:b]] * w[a:b, None], at[lo:hi] - a, axis=0)
        back = np.repeat(xo, ends[lo:hi] - at[lo:hi], axis=0) * w[a:b, None]
        order = np.argsort(t[a:b], kind="stable")
        ts = t[a:b][order]
        g = np.flatnonzero(np.append(True, ts[1:] != ts[:-1]))
        z[ts[g]] += np.add.reduceat(back[order], g, axis=0)
        lo = hi
