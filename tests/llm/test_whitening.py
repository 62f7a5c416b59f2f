"""Operator 11 against exact sums and a full eigendecomposition in numpy."""

import numpy as np
import pytest

from quern.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component int, v string, id string"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 1, 5, 6, "v", "id") for i, v in zip(ids, vectors, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def plain(vectors, k=8):
    """x-vectors, deviation of each, eigenvalues, components and trace; all in exact integers up to the covariance."""
    x = np.floor(1024 * np.asarray(vectors, np.float32).astype(float)).astype(object).astype(int).astype(object) + 100_000
    n, s = len(x), x.sum(axis=0)
    off = n * x - s
    v = (off.T @ off).astype(float) / n / n / n
    e, u = np.linalg.eigh(v)
    return n, (off * off).sum(axis=1), off.astype(float) / n, e[::-1][:k], u[:, ::-1][:, :k], np.trace(v)


def compare(out, vectors, ids, k):
    n, deviation, off, e, u, trace = plain(vectors, k)
    got = {}
    for r in out:
        got.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(got) == sorted(ids) and all(sorted(x) == list(range(1, k + 1)) for x in got.values())
    want, have = off @ u / np.sqrt(e), np.array([[got[i][c].whitened for c in range(1, k + 1)] for i in ids])
    assert np.abs(have - want * np.sign((have * want).sum(axis=0))).max() < 1e-8
    assert [got[i][1].deviation for i in ids] == [x if x < 1 << 63 else None for x in deviation] and {r.n for r in out} == {n}
    assert np.allclose([got[ids[0]][c].explained for c in range(1, k + 1)], e / trace, rtol=1e-10)
    assert len({r.identity_error for r in out}) == 1 and out[0].identity_error < 1e-9


@pytest.mark.parametrize("spectrum", ["flat", "steep"])
def test_against_numpy(spark, spectrum):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(700, 40)) * (1.0 if spectrum == "flat" else 30.0 * 0.6 ** np.arange(40.0))
    v = v @ np.linalg.qr(rng.normal(size=(40, 40)))[0]
    bad = [None, [], [None] * 40, [1.0] * 39 + [float("nan")], [float("inf")] * 40, [1.0] * 39, [1e20] + [0.0] * 39]
    df = frame(spark, [*v, *bad]).repartition(5)
    fitted = whitening.fit(df)
    assert fitted.n == 700
    if spectrum == "flat":
        assert (fitted.width, fitted.passes) == (40, whitening.PASSES + 1)
    compare(whitening.whiten(df).collect(), v, list(range(700)), 8)


def test_steep_spectra_need_no_expansion(spark):
    """On the lattice of integers rounding adds a floor of variance, so dimensions must differ by far."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(500, 30)) * np.where(np.arange(30) < 8, 4000.0 / (1 + np.arange(30)), 1e-4)
    fitted = whitening.fit(frame(spark, v), passes=6)
    assert fitted.width == 16 and fitted.passes <= 6
    compare(whitening.whiten(frame(spark, v), passes=6).collect(), v, list(range(500)), 8)


def test_fewer_dimensions_than_components(spark):
    v = np.array([[1.0, 2.0, 3.0], [2.0, 4.0, 6.5], [0.0, 1.0, 7.0], [5.0, 5.0, 5.0], [5.0, 5.0, 5.0]])
    compare(whitening.whiten(frame(spark, v)).collect(), v, list(range(5)), 3)
    line = [[float(i), 2.0 * i, -3.0 * i] for i in range(6)]
    out = whitening.whiten(frame(spark, line)).collect()
    assert {r.component for r in out} == {1} and len(out) == 6 and abs(out[0].explained - 1) < 1e-12


@pytest.mark.parametrize("vectors", [[], [None, []], [[1.0, 2.0]], [[1.0, 2.0]] * 4, [[], []]])
def test_nothing_to_whiten(spark, vectors):
    out = whitening.whiten(frame(spark, vectors))
    assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_equal_and_null_ids_count(spark):
    v = [[1.0, 0.0], [0.0, 1.0], [3.0, 1.0], [1.0, 0.0]]
    out = whitening.whiten(frame(spark, v, [7, 7, None, 7])).collect()
    assert len(out) == 8 and {r.n for r in out} == {4} and sum(r.vec_id is None for r in out) == 2


def test_large_entries_stay_exact(spark):
    v = [[2.0**41, 1.0], [-(2.0**41), 2.0], [3.0, 2.0**40]]
    n, deviation, *_ = plain(v)
    out = whitening.whiten(frame(spark, v)).collect()
    assert {r.vec_id: r.deviation for r in out} == {i: (x if x < 1 << 63 else None) for i, x in enumerate(deviation)}


def test_query(spark, tmp_path):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(200, 12))
    frame(spark, v).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries.op11_whitening(spark, str(tmp_path))
    assert out.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    compare(out.collect(), v, list(range(200)), 8)
