"""Searches keep the k best of each query in bounded pieces, whatever a batch holds."""

import numpy as np
import pyarrow as pa

from quern.operators import retrieval


def test_slices_follow_costs():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6))], names=["i"])
    assert [b.column(0).to_pylist() for b in retrieval._slices(batch, np.array([3, 3, 9, 0, 1, 5]), 6)] == [[0, 1], [2], [3, 4, 5]]
    assert [b.num_rows for b in retrieval._slices(batch, np.zeros(6), 6, 4)] == [4, 2]
    assert list(retrieval._slices(batch.slice(0, 0), np.zeros(0), 6)) == []


def test_best_of_many_parts():
    r = np.random.default_rng(5)
    best, rows = retrieval.Best(3, 4), []
    best.most = 20
    for _ in range(40):
        n = int(r.integers(0, 9))
        q, i, s = r.integers(0, 2, n), r.integers(0, 1000, n), r.integers(0, 9, n) / 8
        best.add(q, i, s)
        rows += zip((q * 10).tolist(), i.tolist(), s.tolist(), strict=True)
        assert best.rows <= best.most + 9
    (out,) = best.batches(np.array([0, 10, 20]))
    want = [x for q in (0, 10) for x in sorted((x for x in rows if x[0] == q), key=lambda x: (-x[2], x[1]))[:4]]
    assert [tuple(x.values()) for x in out.to_pylist()] == want
    assert list(retrieval.Best(0, 4).batches(np.zeros(0))) == []


def test_small_pieces_give_the_same(spark, sf, monkeypatch):
    from quern.plans import base

    for name, f in (("bm25", base.lexical_channel), ("vector", base.vector_channel)):
        whole = sorted(map(tuple, f(spark, sf).collect()))
        for most in ("WORDS", "SCORES", "PAIRS"):
            monkeypatch.setattr(retrieval, most, 50)
        assert sorted(map(tuple, f(spark, sf).collect())) == whole, name
        monkeypatch.undo()
