"""Embedding whitening by polarisation covariance (operator 11).

Every entry c of a vector becomes the integer x = floor(64 c) + 1000000. Two aggregates
give the covariance exactly: the sums of every dimension, and then, centred, the squares of
every dimension and of the sum of every pair of dimensions. As
Var(a + b) = Var(a) + Var(b) + 2 Cov(a, b), differences of these variances are the
cross-covariances; they are formed on unbounded integers, rounded once and put together for
``eigh``. Centring is by the integer nearest to the mean, whose rest (half a unit at most)
enters exactly: with y = x - r and T the sum of y, the sum of (n y - T)^2 is n (n sum y^2 - T^2).

Spark does the passes over the rows; a task returns one row a dimension or pair, whatever
its share of the rows, and these are summed natively. The driver holds the square of the
vector length. A last aggregate over the whitened values measures how far their
covariance is from the identity.

Defined results: rows whose vector is null or holds a null or non-finite entry are left out;
an empty vector has no component; an empty table gives no row. Vectors of each length are
fitted on their own. Repeated rows count and come out each; a null id stays null. Integers
beyond +-2^58 are held there; a deviation beyond a long is null. A component whose
eigenvalue is zero (up to the rounding of ``eigh``: all vectors equal, fewer vectors than
dimensions) has no whitened value (null), and ``explained`` is null if all variance is zero;
``identity_error`` covers the other components (null if there is none). Of several eigenvectors
of one eigenvalue any orthogonal choice is right; the sign makes the entry of largest size
positive. Columns of other names are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import prepare_python
from callweave.llm.vectors import by_length, column_sums, decimals, floors, largest, longs, roomy, usable_vectors

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def entries(matrix: np.ndarray) -> np.ndarray:
    return floors(matrix, SCALE) + SHIFT


def dimension_sums(vectors: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Vectors and the sums of their entries, by length."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            for _, m in by_length(b.column(0)):
                n, s = total.get(m.shape[1], (0, 0))
                total[m.shape[1]] = n + len(m), s + column_sums(entries(m))
        for d, (n, s) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), decimals(s)], ["dim", "i", "n", "s"])

    rows = vectors.select("v").mapInArrow(add, "dim int, i int, n long, s decimal(38,0)")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in rows.groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        out.setdefault(r["dim"], (r["n"], [0] * r["dim"]))[1][r["i"]] = int(r["s"])
    return out


def pair_squares(y: np.ndarray) -> np.ndarray:
    """Sums of squares: of column i at (i, i), of columns i + j at (i, j), j above i."""
    y = roomy(y, 4 * largest(y) ** 2 * max(1, len(y)))
    d = y.shape[1]
    out = np.zeros((d, d), object)
    for i in range(d):
        z = y[:, i:i + 1] + y[:, i + 1:]
        out[i, i], out[i, i + 1:] = (y[:, i] * y[:, i]).sum(), (z * z).sum(axis=0)
    return out


def centred_squares(vectors: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, list[list[int]]]:
    """The sums of ``pair_squares`` over all centred vectors, by length."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for _, m in by_length(b.column(0)):
                if d := m.shape[1]:
                    total[d] = total.get(d, 0) + pair_squares(entries(m) - centres[d])
        for d, q in total.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(i), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), decimals(q[i, j])], ["dim", "i", "j", "q"])

    rows = vectors.select("v").mapInArrow(add, "dim int, i int, j int, q decimal(38,0)")
    out = {d: [[0] * d for _ in range(d)] for d in centres}
    for r in rows.groupBy("dim", "i", "j").agg(F.sum("q").alias("q")).collect():
        out[r["dim"]][r["i"]][r["j"]] = int(r["q"])
    return out


def covariance(n: int, rest: list[int], squares: list[list[int]]) -> tuple[np.ndarray, float]:
    """Covariance (divisor n) and its trace, each number rounded once. ``rest``: sums of the
    centred columns."""
    d = len(rest)
    own = [n * squares[i][i] - rest[i] ** 2 for i in range(d)]
    out = np.zeros((d, d))
    for i in range(d):
        out[i, i] = own[i] / n ** 2
        for j in range(i + 1, d):
            both = n * squares[i][j] - (rest[i] + rest[j]) ** 2
            out[i, j] = out[j, i] = (both - own[i] - own[j]) / (2 * n ** 2)
    return out, sum(own) / n ** 2


class Basis:
    """Of the vectors of one length: centre, components and their eigenvalues."""

    def __init__(self, n: int, sums: list[int], squares: list[list[int]], components: int):
        self.n, self.centre = n, nearest(n, sums)
        self.rest = [s - n * int(r) for s, r in zip(sums, self.centre)]
        self.mean_rest = np.array([t / n for t in self.rest])
        v, trace = covariance(n, self.rest, squares)
        e, u = np.linalg.eigh(v)
        e, u = e[::-1][:components], u[:, ::-1][:, :components]
        top = np.take_along_axis(u, np.abs(u).argmax(axis=0)[None], axis=0)
        self.axes = u * np.where(top < 0, -1.0, 1.0)
        self.real = e > len(v) * np.finfo(float).eps * max(e[0], 0)
        self.spread = np.sqrt(np.where(self.real, e, 1.0))
        self.explained = np.clip(e, 0, None) / trace if trace else np.full(len(e), np.nan)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (((x - self.centre) - self.mean_rest) @ self.axes) / self.spread

    def deviation(self, x: np.ndarray) -> np.ndarray:
        y = x - self.centre
        size = self.n * largest(y) + max(map(abs, self.rest))
        y = roomy(y, len(self.rest) * size ** 2)
        z = self.n * y - np.array(self.rest, y.dtype)
        return (z * z).sum(axis=1)


def nearest(n: int, sums: list[int]) -> np.ndarray:
    return np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)


def fit(vectors: DataFrame, components: int) -> dict[int, Basis]:
    sums = dimension_sums(vectors)
    squares = centred_squares(vectors, {d: nearest(n, s) for d, (n, s) in sums.items()})
    return {d: Basis(n, s, squares[d], components) for d, (n, s) in sums.items()}


def identity_errors(vectors: DataFrame, bases: dict[int, Basis]) -> dict[int, float | None]:
    """Largest entry of the whitened values' covariance minus the identity, by length."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple] = {}
        for b in batches:
            for _, m in by_length(b.column(0)):
                if d := m.shape[1]:
                    w = bases[d].whiten(entries(m))
                    s, q = total.get(d, (0, 0))
                    total[d] = s + w.sum(axis=0), q + w.T @ w
        for d, (s, q) in total.items():
            i, j = np.triu_indices(len(s))
            i, j, value = np.r_[i, np.arange(len(s))], np.r_[j, np.full(len(s), -1)], np.r_[q[i, j], s]
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(i), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(value)], ["dim", "i", "j", "value"])

    rows = vectors.select("v").mapInArrow(add, "dim int, i int, j int, value double")
    found = {(r["dim"], r["i"], r["j"]): r["value"] for r in rows.groupBy("dim", "i", "j").agg(F.sum("value").alias("value")).collect()}
    out: dict[int, float | None] = {}
    for d, basis in bases.items():
        k = np.flatnonzero(basis.real).tolist()
        means = {i: found[d, i, -1] / basis.n for i in k}
        out[d] = max((abs(found[d, i, j] / basis.n - means[i] * means[j] - (i == j)) for i in k for j in k if i <= j), default=None)
    return out


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: vec_id, component, n, deviation, whitened,
    explained, identity_error."""
    prepare_python(embeddings.sparkSession)
    vectors = usable_vectors(embeddings, vector_col, vec_id=F.col(id_col).cast("long"))
    bases = fit(vectors, components)
    errors = identity_errors(vectors, bases)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for at, m in by_length(b.column(1)):
                if not m.shape[1]:
                    continue
                basis, x = bases[m.shape[1]], entries(m)
                k, error = len(basis.spread), errors[m.shape[1]]
                each = np.repeat(np.arange(len(x)), k)
                tiled = lambda values: np.tile(values, len(x))
                columns = [ids.take(pa.array(at[each])), pa.array(tiled(np.arange(1, k + 1, dtype=np.int32))), pa.array(np.full(len(each), basis.n)),
                           longs(basis.deviation(x)).take(pa.array(each)), pa.array(basis.whiten(x).ravel(), mask=tiled(~basis.real)),
                           pa.array(tiled(basis.explained), from_pandas=True), pa.array([error], pa.float64()).take(pa.array(np.zeros(len(each), np.int64)))]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in OUT.split(", ")])

    return vectors.mapInArrow(rows, OUT)
