"""Repeated byte strings by sorted suffixes, found across all documents.

Equal strings of LENGTH bytes must meet in one task, without every suffix being
shuffled. Each string is assigned to its anchor, the GRAM bytes in it whose hash
is least; equal strings have equal anchors at the same place. The strings of a
document that share an anchor are neighbours, so together they are a fragment
of LENGTH bytes and a few more, and about one byte in forty starts one. Equal
fragments are met by a hash of their content, and only anchors with differing
fragments send text to the suffix sort: two-stage sorting (Itoh and Tanaka,
1999), which sorts only suffixes smaller than their successors, induces the
others by scanning the buckets, and then compares neighbours.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import U64, buffers, cut, giving_back, group_bounds, mix, slices, span_hashes, utf8, whole_runs

#: Bytes of a string that may not repeat, and of an anchor.
LENGTH, GRAM = 100, 24
#: Fragments of an anchor that go to one task; strings of a more frequent one are dealt by their own content.
HOT = 4096
#: Bytes that are sorted at once, about; and bytes of text that a task collapses at once.
SORTED_BYTES, CHUNK_BYTES = 1 << 20, 2 << 20


def suffix_order(data: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """All suffixes in the order of their first `depth` bytes at least (ties in any order), by two-stage sorting."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    pad = np.zeros(n + depth + 16, np.uint8)
    pad[:n] = data
    first = np.zeros(n + depth + 8, U64)
    for k in range(8):
        first |= pad[k : k + len(first)].astype(U64) << U64(56 - 8 * k)
    # Smaller than the successor: decided by the next byte that differs; at the end of the data nothing follows, which is smaller.
    change = np.flatnonzero(data[1:] != data[:-1])
    run = np.searchsorted(change, np.arange(n))
    up = np.append(data[change + 1] > data[change], False)
    small = up[run]
    # Stage one: these suffixes are sorted directly, eight bytes at a time, as long as some are tied.
    idx = np.flatnonzero(small)
    idx = idx[np.argsort(first[idx], kind="stable")]
    key = first[idx]
    tied = np.zeros(len(idx) + 1, bool)
    tied[1:-1] = key[1:] == key[:-1]
    same_end = span_hashes(pad, np.arange(n), np.arange(n) + depth)
    for at in range(8, depth, 8):
        inside = tied[:-1] | tied[1:]
        where = np.flatnonzero(inside)
        if not len(where):
            break
        group = np.cumsum(~tied[:-1])[where]
        bounds = group_bounds([group])
        # Groups that agree to the full depth are done.
        h = same_end[idx[where]]
        differ = np.add.reduceat((h != np.repeat(h[bounds[:-1]], np.diff(bounds))).astype(np.int64), bounds[:-1]) > 0
        open_ = np.repeat(differ, np.diff(bounds))
        where, group = where[open_], group[open_]
        if not len(where):
            break
        part = first[idx[where] + at]
        order = np.lexsort((part, group))
        idx[where] = idx[where][order]
        part = part[order]
        again = np.zeros(len(where), bool)
        again[1:] = (group[1:] == group[:-1]) & (part[1:] == part[:-1])
        tied[:] = False
        tied[where] = again
    # Stage two: bucket by bucket, what precedes a placed suffix and is larger than it follows in the same order.
    size = np.bincount(data, minlength=256)
    start = np.append(0, np.cumsum(size))
    out = np.empty(n, np.int64)
    fill = start[:-1].copy()
    heads = data[idx]
    cuts = np.searchsorted(heads, np.arange(257))
    last = data[-1]
    out[fill[last]] = n - 1
    fill[last] += 1
    for c in range(256):
        if not size[c]:
            continue
        now = out[start[c] : fill[c]]
        while len(now):  # runs of one byte, shorter ones first
            before = now[now > 0] - 1
            now = before[data[before] == c]
            out[fill[c] : fill[c] + len(now)] = now
            fill[c] += len(now)
        mine = idx[cuts[c] : cuts[c + 1]]
        out[start[c + 1] - len(mine) : start[c + 1]] = mine
        whole = out[start[c] : start[c + 1]]
        before = whole[whole > 0] - 1
        larger = before[data[before] > c]
        if len(larger):
            b = data[larger]
            order = np.argsort(b, kind="stable")
            count = np.bincount(b, minlength=256)
            at = np.append(0, np.cumsum(count))
            sorted_ = larger[order]
            for d in np.flatnonzero(count):
                out[fill[d] : fill[d] + count[d]] = sorted_[at[d] : at[d + 1]]
            fill += count
    return out


def common_to(data: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Whether data[a:a + depth] equals data[b:b + depth], for each pair; both must end within data."""
    out = np.ones(len(a), bool)
    left = np.arange(len(a))
    for k in range(depth):
        if k % 4 == 0:
            left = left[out[left]]
        if not len(left):
            break
        out[left] &= data[a[left] + k] == data[b[left] + k]
    return out


def repeated(data: np.ndarray, starts: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Which strings data[s:s + depth], s in the rising starts, equal one that starts earlier."""
    allowed = np.zeros(len(data) + 1, bool)
    allowed[starts] = True
    order = suffix_order(data, depth)
    order = order[allowed[order]]
    out = np.zeros(len(starts), bool)
    if len(order) > 1:
        bounds = np.append(0, np.append(np.flatnonzero(~common_to(data, order[:-1], order[1:], depth)) + 1, len(order)))
        least = np.repeat(np.minimum.reduceat(order, bounds[:-1]), np.diff(bounds))
        out[np.searchsorted(starts, order[order != least])] = True
    return out


def anchors(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, first, last, anchor, hash): for each fragment the starts of its first and last string and its anchor, as places in data."""
    n = len(data)
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if n < length:
        return *none, np.zeros(0, U64)
    width = length - gram + 1
    g = span_hashes(data, np.arange(n - gram + 1), np.arange(n - gram + 1) + gram)
    bits = U64(int(n).bit_length())
    least = ((g >> bits) << bits) | np.arange(len(g), dtype=U64)  # the leftmost of equal hashes
    step, have = 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    at = (least & ((U64(1) << bits) - U64(1))).astype(np.int64)  # by the start of the string
    end = np.repeat(offs[1:], np.diff(offs))[: len(at)]
    ok = np.flatnonzero(np.arange(len(at)) + length <= end)
    if not len(ok):
        return *none, np.zeros(0, U64)
    a = at[ok]
    new = np.ones(len(ok), bool)
    new[1:] = (a[1:] != a[:-1]) | (ok[1:] != ok[:-1] + 1)
    i = np.flatnonzero(new)
    first, last = ok[i], ok[np.append(i[1:], len(ok)) - 1]
    return np.searchsorted(offs, first, "right") - 1, first, last, a[i], g[a[i]]


#: Kinds of rows between the tasks.
SINGLE, MARK, FRAGMENT, REMOVED, FETCH = range(5)
ROWS = T.StructType([T.StructField("mh", T.LongType()), T.StructField("fh", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("at", T.LongType()), T.StructField("kind", T.LongType()), T.StructField("frag", T.BinaryType())])


def _batch(mh, fh, doc, at, kind, frag=None):
    n = len(doc)
    cols = [np.broadcast_to(np.asarray(x).astype(np.int64), n) for x in (mh, fh, doc, at, kind)]
    return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(frag, pa.binary()) if frag is not None else pa.nulls(n, pa.binary())], names=ROWS.names)


def _ranges(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of documents, those that touch or overlap joined."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    if not len(doc):
        return doc, lo, hi
    new = np.ones(len(doc), bool)
    # Ranges of one document, sorted by start; ends rise with starts except for those within another.
    base = np.zeros(len(doc), np.int64)
    base[1:] = doc[1:] != doc[:-1]
    base = np.cumsum(base)
    span = int(hi.max()) + 1
    reach = np.maximum.accumulate(base * span + hi) - base * span
    new[1:] = (base[1:] != base[:-1]) | (lo[1:] > reach[:-1])
    i = np.flatnonzero(new)
    return doc[i], lo[i], np.maximum.reduceat(hi, i)


def _elsewhere(fresh: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows that follow a fresh one with the same content at another place; at the same place they are that of a row that repeats its id."""
    first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    return ~fresh & ((doc != doc[first]) | (at != at[first]))


def _find(batches):
    """Rows of each chunk of documents: fragments that only this chunk can decide are decided here."""
    for whole in batches:
        for batch in slices(whole, 1, CHUNK_BYTES):
            data, offs = buffers(batch.column(1))
            row, first, last, anchor, mh = anchors(data, offs)
            if not len(row):
                continue
            doc = batch.column(0).to_numpy()[row]
            fh = mix(span_hashes(data, first, last + LENGTH) + (anchor - first).astype(U64))
            at = first - offs[row]
            order = np.lexsort((at, doc, fh, mh))
            row, first, last, anchor, mh, fh, doc, at = (x[order] for x in (row, first, last, anchor, mh, fh, doc, at))
            fresh = np.ones(len(mh), bool)
            fresh[1:] = (mh[1:] != mh[:-1]) | (fh[1:] != fh[:-1])
            if (gone := _elsewhere(fresh, doc, at)).any():
                d, lo, hi = _ranges(doc[gone], at[gone], (at + last - first + LENGTH)[gone])
                yield _batch(mix(d.astype(U64)), hi, d, lo, REMOVED)
            row, first, last, anchor, mh, fh, doc, at = (x[fresh] for x in (row, first, last, anchor, mh, fh, doc, at))
            packed = (at << 16) | ((last - first) << 8) | (anchor - first)
            bounds = group_bounds([mh])
            many = np.repeat(np.diff(bounds) > 1, np.diff(bounds))
            yield _batch(mh[~many].astype(np.int64), fh[~many].astype(np.int64), doc[~many], packed[~many], SINGLE)
            if many.any():
                head = bounds[:-1][np.diff(bounds) > 1]
                yield _batch(mh[head].astype(np.int64), 0, doc[head] * 0, 0, MARK)
                where = np.flatnonzero(many)
                for k in range(0, len(where), 20_000):
                    i = where[k : k + 20_000]
                    text = [data[a : b + LENGTH].tobytes() for a, b in zip(first[i], last[i], strict=True)]
                    yield _batch(mix(fh[i] ^ mix(mh[i])).astype(np.int64), mh[i].astype(np.int64), doc[i], packed[i], FRAGMENT, text)


def _meet(batches):
    """Decide what fragments of an anchor in all chunks come to."""
    for t in whole_runs(batches, 1, 20_000):
        kind = t["kind"].to_numpy()
        if (later := np.flatnonzero(kind >= FRAGMENT)).size:
            yield from t.take(pa.array(later)).combine_chunks().to_batches()
        now = np.flatnonzero(kind < FRAGMENT)
        if not len(now):
            continue
        mh, fh, doc, at = (t[c].to_numpy()[now] for c in ("mh", "fh", "doc", "at"))
        single = kind[now] == SINGLE
        bounds = group_bounds([mh])
        n = np.diff(bounds)
        # Rows are sorted by mh, fh, doc and at; a mark, of which fh is 0, makes any other fragment a differing one.
        new = np.ones(len(mh), bool)
        new[1:] = (mh[1:] != mh[:-1]) | (fh[1:] != fh[:-1])
        kinds = np.add.reduceat((new & single).astype(np.int64), bounds[:-1])
        marked = np.add.reduceat((~single).astype(np.int64), bounds[:-1]) > 0
        open_ = np.repeat((kinds > 1) | marked, n) & single
        # A mark may stand before singles whose hash is 0 as well: then none is the first, and all are fetched.
        lone = np.ones(len(mh), bool)
        lone[1:] = new[1:] | ~single[:-1]
        if (gone := single & _elsewhere(lone, doc, at)).any():
            d, a = doc[gone], at[gone]
            d, lo, hi = _ranges(d, a >> 16, (a >> 16) + ((a >> 8) & 255) + LENGTH)
            yield _batch(0, hi, d, lo, REMOVED)
        if (ask := open_ & lone).any():
            yield _batch(0, mh[ask], doc[ask], at[ask], FETCH)


def _cut_out(batches):
    """Fragments (fh is the anchor's hash) of documents (doc, text, asked)."""
    for whole in batches:
        for batch in slices(whole, 1, CHUNK_BYTES):
            data, offs = buffers(batch.column(1))
            asked = batch.column(2)
            row = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))
            flat = asked.flatten()
            at, mh = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            doc = batch.column(0).to_numpy()[row]
            a = offs[row] + (at >> 16)
            b = a + ((at >> 8) & 255) + LENGTH
            ok = b <= offs[row + 1]  # rows that repeat an id may hold other texts
            for k in range(0, len(a), 20_000):
                i = np.flatnonzero(ok[k : k + 20_000]) + k
                yield _batch(0, mh[i], doc[i], at[i], FRAGMENT, [data[x:y].tobytes() for x, y in zip(a[i], b[i], strict=True)])


def _by_suffixes(batches):
    """Repeated strings among fragments, whole anchors at a time."""
    for t in whole_runs(batches, 1, SORTED_BYTES // (LENGTH + 40)):
        doc, at = t["doc"].to_numpy(), t["at"].to_numpy()
        order = np.lexsort((at, doc))
        doc, at = doc[order], at[order]
        # Rows that repeat an id give a fragment twice.
        once = np.append(True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1]))
        order, doc, at = order[once], doc[once], at[once] >> 16
        frag = t["frag"].combine_chunks().take(pa.array(order))
        data, offs = buffers(frag)
        n = np.diff(offs) - LENGTH + 1
        owner = np.repeat(np.arange(len(n)), n)
        inner = np.arange(n.sum()) - np.repeat(np.append(0, np.cumsum(n))[:-1], n)
        gone = repeated(data, offs[owner] + inner)
        d, lo = doc[owner[gone]], at[owner[gone]] + inner[gone]
        d, lo, hi = _ranges(d, lo, lo + LENGTH)
        if len(d):
            yield _batch(0, hi, d, lo, REMOVED)


def _strings(batches):
    """For each string of the fragments two hashes and its place, the first of a batch; the others of the batch as removed."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offs = buffers(batch.column(2))
        n = np.diff(offs) - LENGTH + 1
        owner = np.repeat(np.arange(len(n)), n)
        inner = np.arange(n.sum()) - np.repeat(np.append(0, np.cumsum(n))[:-1], n)
        s = offs[owner] + inner
        a = span_hashes(data, s, s + LENGTH)
        b = span_hashes(data[::-1].copy(), len(data) - s - LENGTH, len(data) - s)
        doc, at = batch.column(0).to_numpy()[owner], (batch.column(1).to_numpy()[owner] >> 16) + inner
        order = np.lexsort((at, doc, b, a))
        a, b, doc, at = a[order], b[order], doc[order], at[order]
        fresh = np.ones(len(a), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        gone = _elsewhere(fresh, doc, at)
        use = fresh | gone
        route = np.where(fresh, a, mix(doc.astype(U64)))
        yield _batch(route[use].astype(np.int64), b[use].astype(np.int64), doc[use], at[use], np.where(fresh, SINGLE, REMOVED)[use])


def _first_string(batches):
    for t in whole_runs(batches, 1, 20_000):
        kind, a, b, doc, at = (t[c].to_numpy() for c in ("kind", "mh", "fh", "doc", "at"))
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (kind[1:] != kind[:-1])
        gone = _elsewhere(new, doc, at) | (kind == REMOVED)
        if gone.any():
            d, lo, hi = _ranges(doc[gone], at[gone], at[gone] + LENGTH)
            yield _batch(0, hi, d, lo, REMOVED)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: its id, n_bytes, n_removed, n_spans and kept, the bytes that stay.

    A byte goes if a string of LENGTH bytes that covers it also starts earlier:
    in a document of a smaller id, or earlier in the same one. Strings are
    those of the input. Texts are UTF-8 bytes, null ones empty; no string spans
    two documents. Rows with a null id neither go nor make others go. Of rows
    that repeat an id none is earlier than the other; they should not differ in
    their texts. Ids are whole numbers, or texts of such, as the smaller
    one comes first; other ids are an error. An empty table gives an empty
    table.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col(id_col).cast("long").alias("doc"), utf8(text_col).alias("text"))
    known = docs.where("doc is not null")
    rows = known.mapInArrow(giving_back(_find), ROWS)
    met = cut(rows.repartition(n, "mh").sortWithinPartitions("mh", "kind", "fh", "doc", "at").mapInArrow(giving_back(_meet), ROWS), "met")
    asked = met.where(F.col("kind") == FETCH).groupBy("doc").agg(F.collect_list(F.struct("at", F.col("fh").alias("mh"))).alias("asked"))
    fetched = known.join(asked.hint("merge"), "doc").select("doc", "text", "asked").mapInArrow(giving_back(_cut_out), ROWS)
    fragments = cut(fetched.unionByName(met.where(F.col("kind") == FRAGMENT)).select(F.col("fh").alias("mh"), "doc", "at", "frag"), "fragments")
    hot = cut(fragments.groupBy("mh").count().where(F.col("count") > HOT).select("mh"), "hot")
    cold = fragments.join(hot, "mh", "left_anti").repartition(n, "mh").sortWithinPartitions("mh")
    gone = met.where(F.col("kind") == REMOVED).unionByName(cold.mapInArrow(giving_back(_by_suffixes), ROWS))
    if hot.limit(1).count():
        strings = fragments.join(hot, "mh", "left_semi").select("doc", "at", "frag").mapInArrow(giving_back(_strings), ROWS)
        gone = gone.unionByName(strings.repartition(n, "mh").sortWithinPartitions("mh", "kind", "fh", "doc", "at").mapInArrow(giving_back(_first_string), ROWS))
    spans = gone.groupBy("doc").agg(F.collect_list(F.struct(F.col("at").alias("lo"), F.col("fh").alias("hi"))).alias("spans"))
    source = docs.join(spans.hint("merge"), "doc", "left").select("doc", "text", "spans")
    schema = T.StructType([T.StructField(id_col, T.LongType()), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept", T.BinaryType())])

    def finish(batches):
        for whole in batches:
            for batch in slices(whole, 1, CHUNK_BYTES):
                data, offs = buffers(batch.column(1))
                spans = batch.column(2)
                count = np.where(spans.is_valid().to_numpy(zero_copy_only=False), np.diff(spans.offsets.to_numpy()), 0)
                flat = spans.flatten()
                row = np.repeat(np.arange(batch.num_rows), count)
                limit = np.diff(offs)[row]
                row, lo, hi = _ranges(row, np.minimum(flat.field(0).to_numpy(), limit), np.minimum(flat.field(1).to_numpy(), limit))
                keep = np.zeros(len(data) + 1, np.int64)
                np.add.at(keep, offs[row] + lo, 1)
                np.add.at(keep, offs[row] + hi, -1)
                keep = np.cumsum(keep)[:-1] == 0
                removed = np.bincount(row, hi - lo, batch.num_rows).astype(np.int64)
                left = data[keep]
                at = np.append(0, np.cumsum(np.diff(offs) - removed)).astype(np.int32)
                kept = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(left.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x) for x in (np.diff(offs), removed, np.bincount(row, minlength=batch.num_rows).astype(np.int64))], kept], names=schema.names)

    return source.mapInArrow(giving_back(finish), schema)
