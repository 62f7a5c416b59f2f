"""Whitening of embeddings: exact centring, a randomised range finder with power passes, Rayleigh-Ritz components.

A random basis, somewhat wider than the components asked for, is multiplied by
the covariance again and again (Halko, Martinsson and Tropp, 2011), each time by
one pass over all centred rows. In the basis the covariance is a small matrix,
whose eigenvectors give the components (Rayleigh-Ritz), and the same pass gives
their residuals. If these do not become small in a few passes, the spectrum is
too flat for a narrow basis: it is expanded to all dimensions, where one more
pass gives the components exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of the basis besides the components asked for; passes before it is expanded; the angle, by its residual, that a component may be off.
OVERSAMPLING, PASSES, ANGLE = 8, 3, 1e-13
#: Entries become integers on this lattice: floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: A larger entry has no integer that a double holds exactly.
LARGEST = float(1 << 52) / SCALE


@dataclass
class Fit:
    """Of n integer vectors: sums by dimension, components (columns) by falling eigenvalue of their covariance, its trace, and the basis they come from."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    width: int
    passes: int


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and vector (doubles) of the rows whose vectors hold finite numbers only, of a size that the lattice can hold."""
    vec = F.col(vec_col).cast("array<double>")
    return df.select(F.col(id_col).alias("id"), vec.alias("v")).where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) <= LARGEST)))


def lattice(column: pa.Array, d: int) -> np.ndarray:
    """Integer vectors of a list column without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)
    return np.floor(flat * SCALE).astype(np.int64) + SHIFT


def exact(x: np.ndarray, most: int) -> np.ndarray:
    """x as it is if 64 bits hold numbers up to most, else as Python's integers."""
    return x if most < 1 << 62 else x.astype(object)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly."""
    largest = int(np.abs(x).max(initial=0)) * n + max(map(abs, sums), default=0)
    return exact(x, largest) * n - np.array(sums, dtype=object if largest >= 1 << 62 else np.int64)


def cells(rows: DataFrame, d: int, partial: Callable[[Iterator[np.ndarray]], np.ndarray], kind: str) -> dict[int, float]:
    """Sums over tasks of the flat array that each makes of its integer vectors; only the sums return."""

    def over(batches):
        made = np.asarray(partial(lattice(b.column(0), d) for b in batches if b.num_rows))
        where = np.flatnonzero(made)
        yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(made[where], pa.int64() if kind == "long" else pa.float64())], names=["cell", "value"])

    return dict(map(tuple, rows.select("v").mapInArrow(over, f"cell long, value {kind}").groupBy("cell").agg(F.sum("value").alias("value")).collect()))


def dense(found: dict[int, float], shape: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(int(np.prod(shape)))
    out[list(found)] = list(found.values())
    return out.reshape(shape)


def centred_sums(n: int, sums: list[int], made: Callable[[np.ndarray], list[np.ndarray]]) -> Callable[[Iterator[np.ndarray]], np.ndarray]:
    """A task's sum, over its rows centred exactly, of the arrays that `made` makes of some of them."""

    def partial(rows):
        total = None
        for x in rows:
            now = np.concatenate([a.ravel() for a in made(deviations(x, n, sums).astype(float) / n)])
            total = now if total is None else total + now
        return np.zeros(0) if total is None else total

    return partial


def fit(df: DataFrame, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding", oversampling: int = OVERSAMPLING, passes: int = PASSES, seed: int = 7) -> Fit | None:
    """The fit to all usable vectors of the commonest length (of equally common ones the smallest), None without any.

    Eigenvalues that rounding cannot tell from 0 have no components. What goes
    to the driver is a basis of dimensions times width, whatever the number of
    rows; tasks add up their rows before anything is shuffled.
    """
    rows = usable(df, id_col, vec_col)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths or not lengths[0].d:
        return None
    d, n = int(lengths[0].d), int(lengths[0]["count"])
    rows = rows.where(F.size("v") == d)

    def totals(batches):
        high, low = np.zeros(d, np.int64), np.zeros(d, np.int64)
        for x in batches:
            for k in range(0, len(x), 1024):
                s = x[k : k + 1024].sum(axis=0)  # at most 2**62
                high += s >> 32
                low += s & 0xFFFFFFFF
        return np.concatenate([high, low])

    found = cells(rows, d, totals, "long")
    sums = [(int(found.get(k, 0)) << 32) + int(found.get(d + k, 0)) for k in range(d)]
    width = min(d, components + oversampling)
    basis, rng, done = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0], np.random.default_rng(seed + 1), 0
    while True:
        q = basis
        out = dense(cells(rows, d, centred_sums(n, sums, lambda c: [c.T @ (c @ q), np.atleast_1d(np.vdot(c, c))]), "double"), (d * width + 1,))  # noqa: B023
        done += 1
        product, trace = out[:-1].reshape(d, width) / n, float(out[-1]) / n
        small = q.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors = q @ turn
        if width == d:
            break
        residuals = np.linalg.norm(product @ turn - vectors * values, axis=0)[:components]
        gaps = np.abs(np.subtract.outer(values[:components], values) + np.diag(np.full(width, np.inf))[:components]).min(axis=1)
        if (residuals <= ANGLE * gaps).all():
            break
        if done < passes:
            basis = np.linalg.qr(product)[0]
        else:  # the basis found so far, and directions at random for the rest of the space
            basis, width = np.linalg.qr(np.concatenate([vectors, rng.normal(size=(d, d - width))], axis=1))[0], d
    kept = int((values[:components] > d * np.finfo(float).eps * max(values[0], 0)).sum())
    return Fit(n, sums, values[:kept], vectors[:, :kept], trace, width, done)


def whiten(df: DataFrame, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding", **options) -> DataFrame:
    """A row for each usable vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Entries c become x = floor(1024 c) + 100000. n is the number of vectors;
    deviation the exact sum over dimensions of (n x - sum of x)^2, null where a
    long cannot hold it; whitened the centred x on the component, over the
    root of its eigenvalue; explained the eigenvalue's part of the variance;
    identity_error the largest entry of the whitened values' covariance minus
    the identity, measured over all rows. Signs of components are arbitrary but
    the same for all rows.

    Vectors that are null or hold nulls, non-finite entries or entries over
    2**42 have no rows, nor have those of another length than the commonest.
    Rows with equal or null ids are rows of their own, and count. Fewer
    components come where the variance has fewer dimensions: none if all
    vectors are equal, so none for one vector or an empty table.
    """
    fitted = fit(df, components, id_col, vec_col, **options)
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("component", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("n", "deviation")), *(T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error"))])
    if fitted is None or not len(fitted.values):
        return df.sparkSession.createDataFrame([], schema)
    n, sums, k, d = fitted.n, fitted.sums, len(fitted.values), len(fitted.sums)
    onto, explained = fitted.vectors / np.sqrt(fitted.values), fitted.values / fitted.trace
    rows = usable(df, id_col, vec_col).where(F.size("v") == d)

    def squares(c):
        w = c @ onto
        return [w.T @ w, w.sum(axis=0)]

    out = dense(cells(rows, d, centred_sums(n, sums, squares), "double"), (k * k + k,)) / n
    covariance = out[: k * k].reshape(k, k) - np.outer(out[k * k :], out[k * k :])
    error = float(np.abs(covariance - np.eye(k)).max())

    def over(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                off = deviations(lattice(part.column(1), d), n, sums)
                most = int(np.abs(off).max(initial=0)) ** 2 * d
                wide = exact(off, most)
                square = [x if -(1 << 63) <= x < 1 << 63 else None for x in (wide * wide).sum(axis=1).tolist()]
                rows_here, m = np.repeat(np.arange(len(part)), k), len(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(rows_here)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), pa.array(square, pa.int64()).take(pa.array(rows_here)),
                        pa.array((off.astype(float) / n @ onto).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    names=schema.names,
                )

    return rows.mapInArrow(over, schema)
