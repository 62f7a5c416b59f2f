"""Near copies of documents: weighted signatures by thrown darts, banded joining, exact similarities.

DartMinHash (Christiani, 2020): every unit of a shingle's weight is a region
into which darts fall at random but always the same way, each with a rank and a
coordinate of the signature. A coordinate keeps the earliest dart in the regions
that the document covers. Only darts up to a rank that suits the document's
weight are thrown, about k ln k + 2k of them whatever its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import U64, buffers, components, cut, forest, giving_back, group_bounds, mix, slices, span_hashes, utf8, whole_runs, words

#: Words of a shingle, least similarity, bands, and coordinates of a band.
SHINGLE, SIMILARITY, BANDS, BAND_ROWS = 5, 0.8, 24, 4
#: Pairs of a bucket are measured if their signatures agree in this share of coordinates: four standard deviations below SIMILARITY.
AGREE = SIMILARITY - 4 * (SIMILARITY * (1 - SIMILARITY) / (BANDS * BAND_ROWS)) ** 0.5
#: Signatures of a bucket that are compared at once; larger buckets are cut into pairs of blocks.
BLOCK = 1024


def shingles(data: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of each shingle, sorted by row. The n-th occurrence of a shingle in a row is a cell of its own, so
    the Jaccard similarity of cells is the weighted one of shingles. A row of 1 to size - 1 words has one shingle of them all."""
    starts, ends, row = words(data, offs)
    h = span_hashes(data, starts, ends)
    n, rows = len(h), len(offs) - 1
    count = np.bincount(row, minlength=rows)
    first = np.append(0, np.cumsum(count))
    out = np.zeros(n, U64)
    place = np.arange(n) - first[row]
    for k in range(size):
        out[: n - k or None] = out[: n - k or None] * U64(0xD1342543DE82EF95) + h[k:] if k < n else out
    good = place + size <= count[row]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        folded = np.array([int(np.add.reduce(mix(h[first[r] : first[r + 1]] + np.arange(count[r]).astype(U64)))) for r in short], U64)
        out, row = np.concatenate([mix(out[good]), mix(folded + U64(1))]), np.concatenate([row[good], short])
    else:
        out, row = mix(out[good]), row[good]
    order = np.lexsort((out, row)) if rows >= 1 << 16 else np.argsort((row.astype(U64) << U64(48)) | (out >> U64(16)), kind="stable")
    row, out = row[order], out[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    nth = np.arange(len(out)) - np.repeat(at, np.diff(np.append(at, len(out))))
    return row, mix(out + nth.astype(U64) * U64(0x9E3779B97F4A7C15))


def dart_signatures(row: np.ndarray, cell: np.ndarray, rows: int, k: int) -> np.ndarray:
    """rows x k values: for each coordinate the earliest dart, its rank in the upper half; rows without cells have zeros."""
    weight = np.bincount(row, minlength=rows)
    out = np.full(rows * k, np.iinfo(np.uint64).max, U64)
    todo = np.flatnonzero(weight)
    reach = np.zeros(rows)
    reach[todo] = (k * np.log(k) + 2 * k) / weight[todo]
    scale = float(2**64)
    while len(todo):
        live = np.zeros(rows, bool)
        live[todo] = True
        use = np.flatnonzero(live[row])
        r, state, rank = row[use], cell[use], np.zeros(len(use))
        while len(r):  # the next dart of each region: gaps between ranks are exponential
            state = mix(state + U64(0xA0761D6478BD642F))
            rank = rank - np.log((state.astype(np.float64) + 1.0) / scale)
            hit = rank <= reach[r]
            r, state, rank = r[hit], state[hit], rank[hit]
            dart = mix(state ^ U64(0x5851F42D4C957F2D))
            slot = r * k + ((dart >> U64(33)) % U64(k)).astype(np.int64)
            np.minimum.at(out, slot, (rank.astype(np.float32).view(np.uint32).astype(U64) << U64(32)) | (dart & U64(0xFFFFFFFF)))
        gaps = (out.reshape(rows, k) == np.iinfo(np.uint64).max).any(axis=1)
        todo = todo[gaps[todo]]
        reach[todo] *= 2
    out[np.repeat(weight == 0, k)] = 0
    return out.reshape(rows, k)


def sketch(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key (of the sequence of words; null without words), bands and sig (16 bits of each coordinate)."""
    source = df.select(F.col(id_col).cast("long").alias("id"), utf8(F.lower(F.col(text_col))).alias("text"))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])
    k = BANDS * BAND_ROWS

    def run(batches):
        import hashlib

        for whole in batches:
            for batch in slices(whole, 1, 2 << 20):
                data, offs = buffers(batch.column(1))
                starts, ends, wrow = words(data, offs)
                wh = span_hashes(data, starts, ends)
                at = np.searchsorted(wrow, np.arange(batch.num_rows + 1))
                keys = [hashlib.blake2b(wh[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(at[:-1], at[1:], strict=True)]
                sig = dart_signatures(*shingles(data, offs), batch.num_rows, k)
                band = np.zeros((batch.num_rows, BANDS), U64)
                for j in range(BAND_ROWS):
                    band = mix(band * U64(31) + sig[:, j::BAND_ROWS])
                band = band.astype(np.int64)
                small = (mix(sig.ravel()) >> U64(48)).astype("<u2").reshape(batch.num_rows, k)
                lists = pa.ListArray.from_arrays(np.arange(0, band.size + 1, BANDS, dtype=np.int32), pa.array(band.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), lists, pa.array([s.tobytes() for s in small], pa.binary())], names=schema.names)

    return source.mapInArrow(giving_back(run), schema)


def _agreeing(sig: np.ndarray, own: np.ndarray | None, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of different parts (and of different blocks, where own tells blocks apart) that agree enough, by falling agreement."""
    n = len(sig)
    a, b, s = [], [], []
    for i in range(0, n, 64):
        agree = (sig[i : i + 64, None, :] == sig[None, :, :]).mean(axis=2) if n <= 256 else np.stack([(x == sig).mean(axis=1) for x in sig[i : i + 64]])
        x, y = np.nonzero(agree >= AGREE)
        keep = (y > x + i) & (part[x + i] != part[y])
        if own is not None:
            keep &= own[x + i] != own[y]
        a.append(x[keep] + i)
        b.append(y[keep])
        s.append(agree[x[keep], y[keep]])
    a, b, s = np.concatenate(a), np.concatenate(b), np.concatenate(s)
    order = np.lexsort((b, a, -s))
    return a[order], b[order]


def _best_edges(sig: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Edges of two disjoint spanning forests of the pairs that agree enough, by falling agreement, and whether such pairs are left."""
    n = len(sig)
    a, b = _agreeing(sig, own, np.arange(n))
    out = [(a[:0], b[:0])]
    for _ in range(2):
        if not len(a):
            break
        # Borůvka: each tree takes its best edge out, the first in the order.
        root, picked = np.arange(n), np.zeros(len(a), bool)
        while True:
            ra, rb = root[a], root[b]
            apart = np.flatnonzero(ra != rb)
            if not len(apart):
                break
            best = np.full(n, len(a))
            np.minimum.at(best, ra[apart], apart)
            np.minimum.at(best, rb[apart], apart)
            picked[np.unique(best[best < len(a)])] = True
            root = forest(n, a[picked], b[picked])
        out.append((a[picked], b[picked]))
        a, b = a[~picked], b[~picked]
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out]), len(a) > 0


def _links_between(sig: np.ndarray, own: np.ndarray | None, part: np.ndarray, flat: np.ndarray, at: np.ndarray, t: float) -> tuple[list[int], list[int]]:
    """Links that connect all parts which the pairs that agree enough connect, each such pair measured unless links connect it already. Row r has the cells flat[at[r] : at[r + 1]]."""
    a, b = _agreeing(sig, own, part)
    found: tuple[list[int], list[int]] = [], []
    if not len(a):
        return found
    root, size = np.unique(part, return_inverse=True)[1], np.diff(at)
    values, cell = np.unique(flat, return_inverse=True)
    mark = np.zeros(len(values), bool)
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    bounds = group_bounds([a])
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        x, ys = a[lo], b[lo:hi]
        ys = ys[root[ys] != root[x]]
        if not len(ys):
            continue
        mark[cell[at[x] : at[x + 1]]] = True
        for k in range(0, len(ys), 256):
            y = ys[k : k + 256]
            first = np.append(0, np.cumsum(size[y]))
            hit = mark[cell[np.arange(first[-1]) + np.repeat(at[y] - first[:-1], size[y])]]
            common = np.add.reduceat(hit.astype(np.int64), first[:-1])
            y = y[common >= t * (size[x] + size[y] - common)]
            y = y[np.unique(root[y], return_index=True)[1]]
            y = y[root[y] != root[x]]
            found[0].extend([x] * len(y))
            found[1].extend(y)
            root[np.isin(root, root[y])] = root[x]
        mark[cell[at[x] : at[x + 1]]] = False
    return found


def _members(unique: DataFrame) -> DataFrame:
    """band, value, i, j, blocks, own, part, rep: the representatives of each bucket, or of each pair (i, j) of blocks of a large one; each is a part of its own."""
    at = unique.select("rep", F.posexplode("bands").alias("band", "value"))
    buckets = at.groupBy("band", "value").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("s"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("n > 1")
    # Buckets with the same members, as copies have in all bands, are compared once.
    once = cut(buckets.groupBy("n", "s", "lo", "hi").agg(F.min(F.struct("band", "value")).alias("b")).select("b.band", "b.value", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "buckets")
    members = at.join(once, ["band", "value"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return members.select("band", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "blocks", "own", F.col("rep").alias("part"), "rep")


def _apart(unique: DataFrame, left: DataFrame, classes: DataFrame) -> DataFrame:
    """The members, as above, of the buckets or pairs of blocks in left (band, value, i, j, blocks) that hold several classes; each class is a part."""
    at = unique.select("rep", F.posexplode("bands").alias("band", "value"))
    members = at.join(left, ["band", "value"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).where("own = i or own = j")
    members = members.join(classes.select(F.col("node").alias("rep"), "component"), "rep", "left").select("band", "value", "i", "j", "blocks", "own", F.coalesce("component", "rep").alias("part"), "rep")
    members = cut(members, "apart")
    several = members.groupBy("band", "value", "i", "j").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("band", "value", "i", "j")
    return members.join(several, ["band", "value", "i", "j"])


def _keyed(members: DataFrame, values: DataFrame) -> DataFrame:
    """The members with the values of their representatives; those of a bucket or pair of blocks come one after the other."""
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = members.join(values, "rep").select(F.xxhash64("band", "value", "i", "j").alias("key"), "i", "j", "band", "value", "own", "rep", "part", "blocks", *[c for c in values.columns if c != "rep"])
    return keyed.repartition(n, "key").sortWithinPartitions("key", "i", "j", "band", "value")


def candidates(unique: DataFrame) -> DataFrame:
    """Pairs (x, y), x < y, of representatives that share a band and whose signatures agree enough: of each bucket, or of each pair of blocks of
    a large one, the best such pairs that connect all that such pairs connect, twice over. Their number is linear in the bucket's. Rows without
    x and y name the buckets or pairs of blocks (band, value, i, j, blocks) that have more such pairs."""
    names = ["x", "y", "band", "value", "i", "j", "blocks"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches):
        for t in whole_runs(batches, 5, 8192):
            key, i, j, band, value, own, rep, _, blocks = (t.column(c).to_numpy() for c in range(9))
            sig = np.frombuffer(b"".join(t.column(9).to_pylist()), "<u2").reshape(len(rep), -1)
            bounds = group_bounds([key, i, j, band, value])
            xs, ys, left = [], [], []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if hi - lo > 1:
                    a, b, more = _best_edges(sig[lo:hi], own[lo:hi] if i[lo] != j[lo] else None)
                    xs.append(rep[lo:hi][a])
                    ys.append(rep[lo:hi][b])
                    if more:
                        left.append(lo)
            if xs:
                x, y = np.concatenate(xs), np.concatenate(ys)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), *[pa.nulls(len(x), k) for k in types[2:]]], names=names)
            if left:
                yield pa.RecordBatch.from_arrays([*[pa.nulls(len(left), k) for k in types[:2]], *[pa.array(c[left], k) for c, k in zip((band, value, i, j, blocks), types[2:], strict=True)]], names=names)

    return _keyed(_members(unique), unique.select("rep", "sig")).mapInArrow(giving_back(run), "x long, y long, band int, value long, i int, j int, blocks int").distinct()


def further_links(unique: DataFrame, sets: DataFrame, left: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between classes, from all pairs of the buckets or pairs of blocks in left that agree enough. A set travels once for each of these, whatever the number of pairs."""

    def run(batches):
        for t in whole_runs(batches, 5, 256):
            key, i, j, band, value, own, rep, part = (t.column(c).to_numpy() for c in range(8))
            sig = np.frombuffer(b"".join(t.column(9).to_pylist()), "<u2").reshape(len(rep), -1)
            cells = t.column(10).combine_chunks()
            at, flat = cells.offsets.to_numpy().astype(np.int64), cells.values.to_numpy()
            bounds = group_bounds([key, i, j, band, value])
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                a, b = _links_between(sig[lo:hi], own[lo:hi] if i[lo] != j[lo] else None, part[lo:hi], flat[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], similarity)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(rep[lo:hi][a]), pa.array(rep[lo:hi][b])], names=["a", "b"])

    return _keyed(_apart(unique, left, classes), unique.select("rep", "sig").join(sets, "rep")).mapInArrow(giving_back(run), "a long, b long")


def _sets(docs: DataFrame) -> DataFrame:
    """rep, cells: the exact weighted shingle sets of (id, text)."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 1, 2 << 20):
                row, cell = shingles(*buffers(batch.column(1)))
                at = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, pa.array(cell.astype(np.int64)))], names=["rep", "cells"])

    return docs.mapInArrow(giving_back(run), "rep long, cells array<long>")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of df: its id, class_id and kept.

    Documents are near copies if their multisets of five-word shingles (words
    in lower case, punctuation apart) have a weighted Jaccard similarity of at
    least `similarity`; classes are what such pairs connect, class_id is the
    smallest id in it, and the document of that id is kept. Every pair that
    connects a class is measured exactly, and so is every pair between classes
    that shares a band and whose signatures agree enough. Texts of one to four words have one
    shingle; a null or wordless text and a row with a null id are classes of
    their own, and are kept. Of rows that repeat an id and the words, all are
    kept or none. Ids are whole numbers, or
    texts of such; other ids are an error, as the smallest id names a class. An
    empty table gives an empty table.

    The bands find a pair at the similarity with probability 1 - (1 -
    0.8**4)**24, more than 0.99999. Copies with the same words are one node.
    """
    seen = cut(sketch(df, id_col, text_col), "sketches")
    words_ = seen.where("id is not null and key is not null")
    unique = cut(words_.groupBy("key").agg(F.min(F.struct("id", "bands", "sig")).alias("m")).select("key", F.col("m.id").alias("rep"), "m.bands", "m.sig"), "unique")
    found = cut(candidates(unique), "pairs")
    pairs, left = found.where("x is not null").select("x", "y"), found.where("x is null").select("band", "value", "i", "j", "blocks")
    needed = pairs.select(F.col("x").alias("id")).union(pairs.select(F.col("y").alias("id"))).distinct()
    texts = df.select(F.col(id_col).cast("long").alias("id"), utf8(F.lower(F.col(text_col))).alias("text")).join(needed.hint("merge"), "id", "left_semi")
    sets = cut(_sets(texts).dropDuplicates(["rep"]), "sets")
    both = pairs.join(sets.select(F.col("rep").alias("x"), F.col("cells").alias("cx")), "x").join(sets.select(F.col("rep").alias("y"), F.col("cells").alias("cy")), "y")
    common = F.size(F.array_intersect("cx", "cy"))
    near = both.select("x", "y", common.alias("c"), (F.size("cx") + F.size("cy")).alias("n")).where(F.col("c") >= similarity * (F.col("n") - F.col("c")))
    classes = components(near.select(F.col("x").alias("a"), F.col("y").alias("b")))
    # The pairs that the forests left out matter where they lie between classes. Each document of such a pair is in a forest, so its set is there.
    further = cut(further_links(unique, sets, left, classes, similarity), "further")
    if further.limit(1).count():
        classes = components(classes.select(F.col("node").alias("a"), F.col("component").alias("b")).union(further))
    known = unique.select("key", "rep").join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("class_id"))
    linked = words_.select("id", "key").join(known, "key").select("id", "class_id")
    out = linked.unionByName(seen.where("id is null or key is null").select("id", F.col("id").alias("class_id")))
    return out.select(F.col("id").alias(id_col), "class_id", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"))
