"""Embedding whitening by spectrum slicing.

Spark adds up the vectors and then, shifted by the rounded mean, their products, both as whole numbers, so the covariance
is exact before it is rounded once. It has as many rows as a vector has entries, whatever the number of vectors; its
leading eigenvalues are found on the driver:

* `factor` is a symmetric indefinite LDLᵀ factorisation with pivots of one or two rows. By Sylvester's law of inertia, the
  positive eigenvalues of D are as many as those of V - shift I: a count of the eigenvalues above a shift.
* Counts bisect the spectrum until an interval holds eigenvalue k alone.
* Inverse iteration from the middle of the interval, then Rayleigh quotient iteration, which converges cubically, give
  the eigenvector; a quotient that leaves the interval sends it back to bisection.
* Counts just below and above each value certify its number; values closer than they can tell apart share a subspace.

The vectors are then centred, projected and scaled in a second reading, and the covariance of the result is compared with
the identity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRID, SHIFT, LIMIT = 64, 1_000_000, 1 << 47
_PIVOT = (1 + 17**0.5) / 8


@dataclass(frozen=True)
class Factor:
    """P A Pᵀ = L D Lᵀ with blocks of one or two rows in D."""

    order: np.ndarray
    lower: np.ndarray
    blocks: list[tuple[int, np.ndarray]]

    def above(self) -> int:
        """Positive eigenvalues. A block of two rows has a negative determinant and so one of each sign."""
        return sum(1 if len(d) == 2 else int(d[0, 0] > 0) for _, d in self.blocks)

    def solve(self, b: np.ndarray) -> np.ndarray:
        x = b[self.order].astype(np.float64)
        for i in range(len(x)):
            x[i + 1 :] -= np.multiply.outer(self.lower[i + 1 :, i], x[i])
        for i, d in self.blocks:
            x[i : i + len(d)] = np.linalg.solve(d, x[i : i + len(d)])
        for i in range(len(x) - 1, 0, -1):
            x[:i] -= np.multiply.outer(self.lower[i, :i], x[i])
        out = np.empty_like(x)
        out[self.order] = x
        return out


def factor(matrix: np.ndarray, least: float) -> Factor:
    """LDLᵀ with complete pivoting; a pivot of 0 becomes ``least``, a change below the rounding of the matrix."""
    a, n = matrix.astype(np.float64).copy(), len(matrix)
    order, lower, blocks, i = np.arange(n), np.eye(n), [], 0

    def swap(p: int, q: int) -> None:
        if p != q:
            a[[p, q]] = a[[q, p]]
            a[:, [p, q]] = a[:, [q, p]]
            order[[p, q]] = order[[q, p]]
            lower[[p, q], :i] = lower[[q, p], :i]

    while i < n:
        rest = np.abs(a[i:, i:])
        diagonal = rest.diagonal()
        r = int(diagonal.argmax())
        off = rest - np.diag(diagonal)
        p, q = sorted(divmod(int(off.argmax()), n - i))
        if diagonal[r] >= _PIVOT * off[p, q]:
            swap(i, i + r)
            size = 1
            if abs(a[i, i]) < least:
                a[i, i] = least
        else:
            swap(i, i + p)
            swap(i + 1, i + q)
            size = 2
        d = a[i : i + size, i : i + size].copy()
        column = a[i + size :, i : i + size].copy()
        lower[i + size :, i : i + size] = np.linalg.solve(d, column.T).T
        a[i + size :, i + size :] -= lower[i + size :, i : i + size] @ column.T
        blocks.append((i, d))
        i += size
    return Factor(order, lower, blocks)


class Spectrum:
    """Leading eigenpairs of a symmetric matrix without negative eigenvalues."""

    def __init__(self, matrix: np.ndarray):
        self.matrix, self.n = matrix, len(matrix)
        self.norm = float(np.abs(matrix).sum(axis=1).max()) if self.n else 0.0
        self.rounding = 4 * self.n * np.finfo(float).eps * self.norm
        self.counts = {-self.norm: self.n, 2 * self.norm: 0}

    def shifted(self, shift: float) -> Factor:
        return factor(self.matrix - shift * np.eye(self.n), np.finfo(float).eps * self.norm)

    def above(self, shift: float) -> int:
        """Eigenvalues above ``shift``."""
        if shift not in self.counts:
            self.counts[shift] = self.shifted(shift).above()
        return self.counts[shift]

    def bracket(self, k: int) -> tuple[float, float]:
        """The narrowest known interval that holds eigenvalue k."""
        return max(s for s, c in self.counts.items() if c >= k), min(s for s, c in self.counts.items() if c < k)

    def isolated(self, k: int) -> tuple[float, float]:
        """An interval of known counts with eigenvalue k alone, or one as narrow as rounding."""
        low, high = self.bracket(k)
        while high - low > self.rounding and self.above(low) - self.above(high) > 1:
            self.above((low + high) / 2)
            low, high = self.bracket(k)
        return low, high

    def pairs(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(values, vectors as columns) of the eigenvalues numbered 1 to ``most`` by fall, without those that are 0 by rounding."""
        values, vectors = [], np.empty((self.n, 0))
        positive = min(most, self.above(self.rounding)) if self.norm else 0
        while len(values) < positive:
            k = len(values) + 1
            low, high = self.isolated(k)
            alone = self.above(low) - self.above(high) == 1
            value, vector = self._alone(k, low, high, vectors) if alone else self._together(k, low, high, vectors)
            values += [float(v) for v in value]
            vectors = np.column_stack([vectors, vector])
        values, vectors = np.array(values[:positive]), vectors[:, :positive]
        self.certify(values)
        return values, vectors

    def _start(self, k: int, found: np.ndarray, columns: int = 1) -> np.ndarray:
        x = np.random.default_rng(k).standard_normal((self.n, columns))
        return np.linalg.qr(x - found @ (found.T @ x))[0]

    def _alone(self, k: int, low: float, high: float, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        while True:
            x = self._start(k, found)
            middle = self.shifted((low + high) / 2)
            for _ in range(2):
                x = np.linalg.qr(middle.solve(x))[0]
            done = False
            for _ in range(8):
                value = float((x.T @ self.matrix @ x)[0, 0])
                if done or not low <= value <= high:
                    break
                done = np.linalg.norm(self.matrix @ x - value * x) <= self.rounding / 16
                x = np.linalg.qr(self.shifted(value).solve(x))[0]  # the step after convergence still sharpens the vector
            x = np.linalg.qr(x - found @ (found.T @ x))[0]
            value = float((x.T @ self.matrix @ x)[0, 0])
            if done and low <= value <= high:
                return np.array([value]), x
            if high - low <= self.rounding:
                return self._together(k, low, high, found)
            self.above((low + high) / 2)
            low, high = self.bracket(k)

    def _together(self, k: int, low: float, high: float, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values that rounding does not tell apart: an orthonormal base of their subspace, found by inverse iteration."""
        x = self._start(k, found, max(1, self.above(low) - self.above(high)))
        middle = self.shifted((low + high) / 2)
        for _ in range(6):
            x = middle.solve(x)
            x = np.linalg.qr(x - found @ (found.T @ x))[0]
        values = np.einsum("ij,ij->j", x, self.matrix @ x)
        fall = np.argsort(-values, kind="stable")
        return values[fall], x[:, fall]

    def certify(self, values: np.ndarray) -> None:
        """Counts beside each value say that it has its number."""
        margin = 4 * self.rounding
        for k, value in enumerate(values, 1):
            if self.above(value - margin) < k or self.above(value + margin) >= k:
                raise ArithmeticError(f"eigenvalue {k} has not its number: {value}")


def grid(vectors: pd.Series, size: int) -> np.ndarray:
    """Whole numbers of vectors of ``size`` finite entries: floor(64 c) + 1000000; beyond 2^47 either way they stop there."""
    c = np.concatenate(vectors.to_list()).astype(np.float64).reshape(len(vectors), size)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(GRID * c), -LIMIT, LIMIT).astype(np.int64) + SHIFT


def _whole(rows: np.ndarray) -> np.ndarray:
    """``rows``, as Python's numbers if sums of products could pass 64 bits."""
    most = float(np.abs(rows).max(initial=0))
    return rows if most * most * max(len(rows), 1) < 2.0**62 else rows.astype(object)


def moments(rows: DataFrame, size: int) -> tuple[int, list[int], np.ndarray]:
    """(n, sums per dimension, covariance) of ``rows`` (vec, of ``size`` entries)."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, np.zeros(size, object)
        for frame in frames:
            total, n = total + grid(frame["vec"], size).sum(axis=0).astype(object), n + len(frame)
        yield pd.DataFrame({"i": range(size), "n": n, "total": [str(t) for t in total]})

    parts = rows.mapInPandas(sums, "i int, n long, total string").groupBy("i")
    parts = parts.agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("i").collect()  # one row per dimension
    n, total = int(parts[0]["n"]), [int(p["total"]) for p in parts]
    centre = np.array([(2 * t + n) // (2 * n) for t in total], np.int64)

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros((size, size), object)
        for frame in frames:
            y = _whole(grid(frame["vec"], size) - centre)
            table = table + (y.T @ y).astype(object)
        i, j = np.triu_indices(size)
        yield pd.DataFrame({"i": i, "j": j, "total": [str(t) for t in table[i, j]]})

    cells = rows.mapInPandas(products, "i int, j int, total string").groupBy("i", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    covariance = np.zeros((size, size))
    rest = [t - n * int(c) for t, c in zip(total, centre)]  # sums after the shift
    for cell in cells.collect():  # one row per pair of dimensions
        i, j = cell["i"], cell["j"]
        covariance[i, j] = covariance[j, i] = (n * int(cell["total"]) - rest[i] * rest[j]) / (n * n)
    return n, total, covariance


def whitened(table: DataFrame, components: int = 32, vector: str = "embedding") -> DataFrame:
    """One row per row of ``table`` (vec_id, vector) and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds null or non-finite entries go; so do vectors of another length than most have (of
    lengths that tie, the larger stays). Components whose eigenvalue is 0 by rounding do not exist: a table of one row, of
    equal rows, or of empty vectors gives an empty result, as does an empty table. Repeated rows count and are returned as
    often as they occur; null ids are carried; other columns are not looked at. deviation is null where it passes 64 bits.
    """
    good = table.select("vec_id", F.col(vector).cast("array<double>").alias("vec")).where(
        F.col("vec").isNotNull() & F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    common = good.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = common["size"] if common else 0
    none = table.where("false").selectExpr("vec_id", "0 AS component", "0L AS n", "0L AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error")
    if not size:
        return none
    rows = good.where(F.size("vec") == size)
    n, total, covariance = moments(rows.select("vec"), size)
    values, vectors = Spectrum(covariance).pairs(components)
    if not len(values):
        return none
    scaled, trace, k = vectors / np.sqrt(values), float(np.trace(covariance)), len(values)
    wide = n * (LIMIT + 2 * SHIFT) >= 1 << 62  # n x - S needs more than 64 bits in the worst case
    sums = np.array(total, object) if wide else np.array(total, np.int64)

    def centred(vecs: pd.Series) -> np.ndarray:
        """n x - S as whole numbers."""
        x = grid(vecs, size)
        return n * (x.astype(object) if wide else x) - sums

    def errors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second = np.zeros(k), np.zeros((k, k))
        for frame in frames:
            w = (centred(frame["vec"]) / n).astype(np.float64) @ scaled
            first, second = first + w.sum(axis=0), second + w.T @ w
        i, j = np.triu_indices(k)
        yield pd.DataFrame({"i": [*i, *range(k)], "j": [*j, *[-1] * k], "total": [*second[i, j], *first]})

    table_of = {(r["i"], r["j"]): r["total"] / n for r in rows.select("vec").mapInPandas(errors, "i int, j int, total double")
                .groupBy("i", "j").agg(F.sum("total").alias("total")).collect()}  # one row per pair of components
    error = max(abs(v - table_of[i, -1] * table_of[j, -1] - (i == j)) for (i, j), v in table_of.items() if j >= 0)

    @F.pandas_udf("deviation long, whitened array<double>")
    def project(vecs: pd.Series) -> pd.DataFrame:
        d = centred(vecs)
        w = (d / n).astype(np.float64) @ scaled
        d = _whole_rows(d)
        squares = (d * d).sum(axis=1)
        return pd.DataFrame({"deviation": pd.array([int(s) if s < 1 << 63 else None for s in squares.tolist()], "Int64"), "whitened": list(w)})

    made = rows.select("vec_id", project("vec").alias("made"))
    each = made.select("vec_id", "made.deviation", F.posexplode("made.whitened").alias("at", "whitened"))
    shares = F.array(*[F.lit(float(v / trace)) for v in values])
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                       F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(float(error)).alias("identity_error"))


def _whole_rows(rows: np.ndarray) -> np.ndarray:
    """``rows``, as Python's numbers if the squares of one row could pass 64 bits."""
    most = float(np.abs(rows).max(initial=0))
    return rows if most * most * max(rows.shape[1], 1) < 2.0**62 else rows.astype(object)
