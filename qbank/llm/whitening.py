"""Whitening of embeddings by a cyclic Jacobi eigensolver.

Entries are brought to integers (floor of 256 times the entry), so sums are
exact.  The fit list holds each distinct vector once.  Spark adds up its sums,
then the scatter of the vectors less their mean (partial matrices of each task,
added up by aggregation: one matrix reaches the driver).  There symmetric
rotations run over all pairs of dimensions, sweep by sweep, until nothing is
left beside the diagonal; Jacobi keeps small eigenvalues to high relative
accuracy.  The eigenvectors, sorted and scaled, are the whitening matrix: at
most ``most_dimensions`` squared numbers, sent to all tasks, which project every
row.

Defined results: rows whose vector is null, empty, or holds null, non-finite
entries or such as leave the range of exact integers (2 ** 53) are dropped;
repeated rows are returned each; vectors of different lengths are whitened
apart, each length with its own fit; a component without variance (its
eigenvalue is below 1e-12 of the trace) has whitened null and explained 0 and is
not in ``identity_error``, which is 0 if no component is left; a deviation
beyond 63 bits is null; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qbank.llm.common import Table


@dataclass(frozen=True)
class Whitening:
    #: Entries count in units of one over this.
    scale: int = 256
    components: int = 4
    #: Sweeps of rotations at most; some ten are enough.
    sweeps: int = 60
    #: Longer vectors are refused: their matrix would not be small.
    most_dimensions: int = 4096
    #: An eigenvalue below this share of the trace is none.
    least: float = 1e-12


def pairings(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of ``d`` dimensions, in rounds of pairs that share none (the circle method)."""
    m = d + d % 2
    ring, out = np.arange(m), []
    for _ in range(m - 1):
        a, b = ring[: m // 2], ring[m // 2 :][::-1]
        real = (a < d) & (b < d)
        out.append((np.minimum(a, b)[real], np.maximum(a, b)[real]))
        ring = np.r_[ring[0], ring[-1], ring[1:-1]]
    return out


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors (as columns) of a symmetric matrix, by cyclic rotations.

    A sweep rotates every pair of dimensions once; pairs that share none are rotated together.
    """
    a = np.array(matrix, np.float64)
    a = (a + a.T) / 2
    d = len(a)
    v = np.eye(d)
    cycle = pairings(d)
    for _ in range(sweeps):
        moved = False
        for i, j in cycle:
            x = a[i, j]
            # Relative to both diagonal entries, so that small eigenvalues come out as well as large ones.
            turn = np.abs(x) > np.finfo(float).eps / 2 * np.sqrt(np.abs(a[i, i] * a[j, j]))
            if not turn.any():
                continue
            moved = True
            i, j, x = i[turn], j[turn], x[turn]
            theta = (a[j, j] - a[i, i]) / (2 * x)
            t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1))
            c = 1 / np.sqrt(t * t + 1)
            s = t * c
            for m in (a, v):
                left, right = m[:, i], m[:, j]
                m[:, i], m[:, j] = c * left - s * right, s * left + c * right
            left, right = a[i], a[j]
            a[i], a[j] = c[:, None] * left - s[:, None] * right, s[:, None] * left + c[:, None] * right
            a[i, j] = a[j, i] = 0.0
        if not moved:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    v = v[:, order] / np.linalg.norm(v[:, order], axis=0)
    sign = np.where(v[np.abs(v).argmax(0), np.arange(d)] < 0, -1.0, 1.0)
    return np.diag(a)[order].copy(), v * sign


@dataclass
class Fit:
    """What the fit list of one length gives: its size, exact sums, eigenvalues and vectors, and the check of the result."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def matrix(self, p: Whitening) -> np.ndarray:
        """Columns that whiten the first components; null ones are zero."""
        k = min(p.components, len(self.values))
        scale = [1 / np.sqrt(e) if self.real(e, p) else 0.0 for e in self.values[:k]]
        return self.vectors[:, :k] * np.array(scale)

    def real(self, e: float, p: Whitening) -> bool:
        return self.trace > 0 and e > p.least * self.trace


def _valid(vectors: DataFrame, p: Whitening, id_column: str, column: str) -> DataFrame:
    v = F.col(column)
    most = float(1 << 53)
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * p.scale) < most)), F.lit(False))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * p.scale).cast("long"))
    return vectors.where(fine & (F.size(v) > 0)).select(F.col(id_column).alias("vec_id"), x.alias("x"))


def _stacked(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def _added(fit: DataFrame, length: int, width: int, kind: str, part) -> list:  # noqa: ANN001
    """The ``width`` numbers that ``part`` adds up over a batch's vectors, added up over all by Spark."""

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in got:
            if b.num_rows:
                one = part(_stacked(b.column(0), length))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total.ravel())], names=["k", "s"])

    rows = fit.where(F.size("x") == length).select("x").mapInArrow(run, f"k long, s {kind}")
    wide = F.sum(F.col("s").cast("decimal(38,0)")) if kind == "long" else F.sum("s")
    out: list = [0] * width
    for r in rows.groupBy("k").agg(wide.alias("s")).collect():
        out[r.k] = r.s
    return out


def fits(distinct: DataFrame, p: Whitening = Whitening()) -> dict[int, Fit]:
    """The fit of each length that occurs among the distinct vectors ``x``."""
    out = {}
    for length, n in sorted(map(tuple, distinct.groupBy(F.size("x")).count().collect())):
        if length > p.most_dimensions:
            raise ValueError(f"vectors of {length} entries: at most {p.most_dimensions} can be whitened")
        # In halves of 32 bits, so that no sum of a task leaves 64 bits.
        halves = _added(distinct, length, 2 * length, "long", lambda x: np.r_[(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)])
        sums = [(int(halves[k]) << 32) + int(halves[length + k]) for k in range(length)]
        mean = np.array([s / n for s in sums])
        scatter = _added(distinct, length, length * length, "double", lambda x, m=mean: (x - m).T @ (x - m))
        covariance = np.array(scatter, np.float64).reshape(length, length) / n
        values, vectors = jacobi(covariance, p.sweeps)
        fit = Fit(n, sums, values, vectors, float(np.trace(covariance)))
        there = [k for k in range(min(p.components, length)) if fit.real(values[k], p)]
        if there:
            w = fit.matrix(p)[:, there]
            second = _added(distinct, length, (len(there) + 1) * len(there), "double", lambda x, m=mean, w=w: _moments((x - m) @ w))
            second = np.array(second, np.float64).reshape(len(there) + 1, len(there)) / n
            fit.identity_error = float(np.abs(second[:-1] - np.outer(second[-1], second[-1]) - np.eye(len(there))).max())
        out[length] = fit
    return out


def _moments(y: np.ndarray) -> np.ndarray:
    """Second moments, and the first below them."""
    return np.vstack([y.T @ y, y.sum(0)])


def _deviations(x: np.ndarray, fit: Fit) -> list[int | None]:
    """Sums of squares of n * x - S, exactly."""
    reach = max(fit.n * max(int(np.abs(x).max(initial=0)), 1), *(abs(s) for s in fit.sums), 1) * 2
    if reach * reach * x.shape[1] < 1 << 63:
        off = fit.n * x - np.array(fit.sums, np.int64)
        return (off * off).sum(1).tolist()
    exact = ((fit.n * x.astype(object) - np.array(fit.sums, object)) ** 2).sum(1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, p: Whitening = Whitening(), id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each row and leading component."""
    rows = _valid(vectors, p, id_column, column)
    distinct = Table(rows.select("x").distinct(), "vectors")
    of_length = fits(distinct.df, p)
    distinct.drop()

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in got:
            lengths = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for length in np.unique(lengths).tolist():
                fit = of_length[length]
                some = b.take(pa.array(np.flatnonzero(lengths == length)))
                x = _stacked(some.column(1), length)
                y = (x - np.array([s / fit.n for s in fit.sums])) @ fit.matrix(p)
                count, k = y.shape
                real = np.array([fit.real(e, p) for e in fit.values[:k]])
                explained = [e / fit.trace if r else 0.0 for e, r in zip(fit.values[:k].tolist(), real.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0).take(pa.array(np.repeat(np.arange(count), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)),
                        pa.array(np.full(count * k, fit.n)),
                        pa.array(_deviations(x, fit), pa.int64()).take(pa.array(np.repeat(np.arange(count), k))),
                        pa.array(y.ravel(), mask=np.tile(~real, count)),
                        pa.array(np.tile(explained, count), pa.float64()),
                        pa.array(np.full(count * k, fit.identity_error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
