"""Small dense kernels: factorisations and solves of one matrix that fits a row.

They work on numpy arrays; ``per_row`` runs one on every row of a packed frame in Arrow
batches, and ``per_stack`` on all matrices of a batch that have one shape, so that many small systems spread over
the cluster without a shuffle. Results are named tuples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..core import SolverError, Tensor

EPS = np.finfo(float).eps


class Ldlt(NamedTuple):
    lower: np.ndarray
    diagonal: np.ndarray


class Qr(NamedTuple):
    q: np.ndarray
    r: np.ndarray


class PivotedQr(NamedTuple):
    q: np.ndarray
    r: np.ndarray
    order: np.ndarray


class Svd(NamedTuple):
    u: np.ndarray
    values: np.ndarray
    vt: np.ndarray


class Polar(NamedTuple):
    rotation: np.ndarray
    stretch: np.ndarray


class Schur(NamedTuple):
    u: np.ndarray
    t: np.ndarray


class Eigen(NamedTuple):
    values: np.ndarray
    vectors: np.ndarray


class Hessenberg(NamedTuple):
    q: np.ndarray
    h: np.ndarray


@dataclass
class Lu:
    order: np.ndarray
    lower: np.ndarray
    upper: np.ndarray
    sign: int

    def solve(self, b: np.ndarray) -> np.ndarray:
        return triangular_solve(self.upper, triangular_solve(self.lower, np.asarray(b, float)[self.order], "unit_lower"), "upper")

    def determinant(self) -> float:
        return self.sign * float(np.prod(np.diag(self.upper)))


def triangular_solve(t: np.ndarray, b: np.ndarray, mode: str) -> np.ndarray:
    """Solve with the triangle a mode names; strict modes have no diagonal to divide by."""
    if mode.startswith("strictly") or mode == "off_diagonal":
        raise SolverError("breakdown", f"a {mode} matrix is singular")
    t, x = np.asarray(t, float), np.array(b, float)
    n = len(t)
    lower, one = mode.endswith("lower"), mode.startswith("unit")
    for k in range(n) if lower else reversed(range(n)):
        if not one:
            if abs(t[k, k]) <= EPS:
                raise SolverError("breakdown", f"diagonal entry {k} is zero")
            x[k] = x[k] / t[k, k]
        rest = slice(k + 1, n) if lower else slice(0, k)
        x[rest] -= np.multiply.outer(t[rest, k], x[k])
    return x


def plu(a: np.ndarray) -> Lu:
    """Rows permuted by the first largest pivot of each column."""
    u = np.array(a, float)
    n = len(u)
    order, lower, sign = np.arange(n), np.eye(n), 1
    for k in range(n):
        best = k + int(np.argmax(np.abs(u[k:, k])))
        if abs(u[best, k]) <= EPS:
            raise SolverError("breakdown", f"no pivot in column {k}")
        if best != k:
            u[[k, best]], order[[k, best]] = u[[best, k]], order[[best, k]]
            lower[[k, best], :k] = lower[[best, k], :k]
            sign = -sign
        lower[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
        u[k + 1 :] -= np.outer(lower[k + 1 :, k], u[k])
        u[k + 1 :, k] = 0.0
    return Lu(order, lower, u, sign)


def plu_solve(a, b):
    return plu(a).solve(b)


def llt(a: np.ndarray) -> np.ndarray:
    """Lower factor of a positive definite matrix, of which the lower triangle is read."""
    rest = np.tril(np.array(a, float))
    out = np.zeros_like(rest)
    for k in range(len(rest)):
        if not rest[k, k] > 0:
            raise SolverError("breakdown", f"diagonal entry {k} is not positive")
        out[k:, k] = rest[k:, k] / np.sqrt(rest[k, k])
        rest[k + 1 :, k + 1 :] -= np.tril(np.outer(out[k + 1 :, k], out[k + 1 :, k]))
    return out


def llt_solve(a, b):
    lower = llt(a)
    return triangular_solve(lower.T, triangular_solve(lower, b, "lower"), "upper")


def ldlt(a: np.ndarray) -> Ldlt:
    """Unit lower factor and diagonal; a zero pivot leaves its column empty."""
    rest = np.tril(np.array(a, float))
    n = len(rest)
    lower, d = np.eye(n), np.zeros(n)
    for k in range(n):
        d[k] = rest[k, k]
        if abs(d[k]) <= EPS:
            continue
        lower[k + 1 :, k] = rest[k + 1 :, k] / d[k]
        rest[k + 1 :, k + 1 :] -= np.tril(np.outer(lower[k + 1 :, k], rest[k + 1 :, k]))
    return Ldlt(lower, d)


def ldlt_solve(a, b):
    lower, d = ldlt(a)
    if (np.abs(d) <= EPS).any():
        raise SolverError("breakdown", "a diagonal entry is zero")
    y = triangular_solve(lower, b, "unit_lower")
    return triangular_solve(lower.T, (y.T / d).T, "unit_upper")


def _signed(q: np.ndarray, r: np.ndarray) -> Qr:
    """The same product with a diagonal of r that is not negative."""
    k = min(r.shape[-2:])
    s = np.where(np.diagonal(r, axis1=-2, axis2=-1) < 0, -1.0, 1.0)
    q, r = q.copy(), r.copy()
    q[..., :k] *= s[..., None, :]
    r[..., :k, :] *= s[..., None]
    return Qr(q, r)


def qr(a):
    return _signed(*np.linalg.qr(np.asarray(a, float), mode="reduced"))


def qr_full(a):
    return _signed(*np.linalg.qr(np.asarray(a, float), mode="complete"))


def gram_schmidt(a: np.ndarray) -> np.ndarray:
    """Orthonormal columns; one that depends on those before becomes zero."""
    q = np.array(a, float)
    for k in range(q.shape[1]):
        before = q[:, k] @ q[:, k]
        for j in range(k):
            q[:, k] -= (q[:, j] @ q[:, k]) * q[:, j]
        left = q[:, k] @ q[:, k]
        q[:, k] = q[:, k] / np.sqrt(left) if left >= EPS * before and left > 0 else 0.0
    return q


def qr_gram_schmidt(a):
    q = gram_schmidt(a)
    return Qr(q, np.triu(q.T @ np.asarray(a, float)))


def qr_solve(a, b):
    """Least squares for as many rows as columns or more."""
    q, r = qr(a)
    if (np.abs(np.diag(r)) <= EPS * max(1.0, np.abs(r).max(initial=0))).any():
        raise SolverError("breakdown", "the columns depend on each other")
    return triangular_solve(r, q.T @ np.asarray(b, float), "upper")


def qr_solve_full(a, b):
    """Least squares by the complete factors: the rows of R below the last column are zero and left out."""
    a = np.asarray(a, float)
    q, r = qr_full(a)
    n = a.shape[1]
    if (np.abs(np.diag(r)) <= EPS * max(1.0, np.abs(r).max(initial=0))).any():
        raise SolverError("breakdown", "the columns depend on each other")
    return triangular_solve(r[:n], (q.T @ np.asarray(b, float))[:n], "upper")


def qr_col_pivot(a: np.ndarray) -> PivotedQr:
    """Q, R and column order; each step takes the column with the most left outside."""
    r = np.array(a, float)
    m, n = r.shape
    q, order = np.eye(m), np.arange(n)
    for k in range(min(m, n)):
        best = k + int(np.argmax((r[k:, k:] ** 2).sum(axis=0)))
        r[:, [k, best]], order[[k, best]] = r[:, [best, k]], order[[best, k]]
        v = r[k:, k].copy()
        size = np.linalg.norm(v)
        if size == 0:
            break
        v[0] += size if v[0] >= 0 else -size
        v /= np.linalg.norm(v)
        r[k:] -= 2 * np.outer(v, v @ r[k:])
        q[:, k:] -= 2 * np.outer(q[:, k:] @ v, v)
    return PivotedQr(q, np.triu(r), order)


def rank(a, tol: float = 1e-10) -> int:
    """Diagonal entries of the pivoted R above tol times the first, up to the first that is not."""
    d = np.abs(np.diag(qr_col_pivot(a)[1]))
    if not len(d) or d[0] == 0:
        return 0
    low = np.flatnonzero(d <= tol * d[0])
    return int(low[0]) if len(low) else len(d)


def svd(a):
    """Thin factors, singular values falling."""
    return Svd(*np.linalg.svd(np.asarray(a, float), full_matrices=False))


def spectral_norm(a) -> float:
    a = np.asarray(a, float)
    return float(svd(a)[1][0]) if a.size else 0.0


def condition_number(a) -> float:
    a = np.asarray(a, float)
    if not a.size:
        return 0.0
    s = svd(a)[1]
    return float("inf") if s[-1] <= np.finfo(float).tiny else float(s[0] / s[-1])


def polar(f) -> Polar:
    """Rotation (determinant 1) and symmetric factor; a matrix that is not square stays whole."""
    f = np.asarray(f, float)
    if f.shape[0] != f.shape[1]:
        return Polar(np.eye(f.shape[0]), f)
    u, s, vt = svd(f)
    if np.linalg.det(u @ vt) < 0:
        u[:, -1], s[-1] = -u[:, -1], -s[-1]
    return Polar(u @ vt, vt.T @ np.diag(s) @ vt)


#: Shifts of the iteration for the Schur form: both eigenvalues of the last block of 2 at once, or the nearer one.
STRATEGIES = ("francis", "wilkinson")


def _last_block(h: np.ndarray, end: int) -> tuple[float, float]:
    """Trace and determinant of the block of 2 that ends at a row."""
    m = h[end - 1 : end + 1, end - 1 : end + 1]
    return m[0, 0] + m[1, 1], m[0, 0] * m[1, 1] - m[0, 1] * m[1, 0]


def _turn(block: np.ndarray, trace: float, det: float, strategy: str, odd: bool) -> np.ndarray:
    """Orthogonal matrix that turns an active block once. odd: an unusual shift, as the usual ones led nowhere."""
    if odd:
        size = np.abs(np.diag(block, -1)).sum()
        trace, det = 1.5 * size, size * size
    elif (strategy == "wilkinson" or len(block) == 2) and trace * trace >= 4 * det:
        gap = np.sqrt(trace * trace / 4 - det)
        shift = min((trace / 2 + gap, trace / 2 - gap), key=lambda x: abs(x - block[-1, -1]))
        return np.linalg.qr(block - shift * np.eye(len(block)))[0]
    # Both shifts at once: the first column of the polynomial decides, and the Hessenberg form is restored from there.
    column = block @ block[:, 0] - trace * block[:, 0]
    column[0] += det
    first = np.linalg.qr(column[:, None], mode="complete")[0]
    return first @ hessenberg_reduce(first.T @ block @ first).q


def schur(a, max_iter: int = 1000, strategy: str = "francis") -> Schur:
    """Orthogonal U and block-triangular T with a = U T Uᵀ; blocks of 2 hold complex pairs.

    The Hessenberg form is turned by shifted QR steps until an entry below the diagonal vanishes; blocks
    that are done are left out of further steps. Steps beyond max_iter raise 'diverged'.
    """
    t = np.array(a, float)
    if t.ndim != 2 or t.shape[0] != t.shape[1]:
        raise SolverError("breakdown", "only a square matrix has a Schur form")
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    u, t = hessenberg_reduce(t)
    end, steps, here = len(t) - 1, 0, 0
    while end > 0:
        below = np.abs(np.diag(t, -1)[:end])
        small = below <= EPS * (np.abs(np.diag(t)[:end]) + np.abs(np.diag(t)[1 : end + 1]) + np.finfo(float).tiny)
        t[np.flatnonzero(small) + 1, np.flatnonzero(small)] = 0.0
        split = np.flatnonzero(small)
        start = int(split[-1]) + 1 if len(split) else 0
        if start == end:
            end, here = end - 1, 0
            continue
        trace, det = _last_block(t, end)
        if start == end - 1 and trace * trace < 4 * det:
            end, here = end - 2, 0
            continue
        if steps >= max_iter:
            raise SolverError("diverged", f"no Schur form in {max_iter} steps")
        steps, here = steps + 1, here + 1
        own = slice(start, end + 1)
        q = _turn(t[own, own], trace, det, strategy, here % 10 == 0)
        t[own, :] = q.T @ t[own, :]
        t[:, own] = t[:, own] @ q
        u[:, own] = u[:, own] @ q
        # Rounding below the second diagonal.
        t[own, own] = np.triu(t[own, own], -1)
    return Schur(u, t)


def eigenvalues_of_schur(t) -> np.ndarray:
    """Of each diagonal block of 1 or 2."""
    out, k, n = [], 0, len(t)
    while k < n:
        size = 2 if k + 1 < n and abs(t[k + 1, k]) > 1e-12 * (abs(t[k, k]) + abs(t[k + 1, k + 1]) + 1e-300) else 1
        out.extend(np.linalg.eigvals(t[k : k + size, k : k + size]))
        k += size
    return np.array(out)


def symmetric_eigen(a):
    """Rising eigenvalues and orthonormal columns."""
    return Eigen(*np.linalg.eigh(np.asarray(a, float)))


def tridiagonal_eigen(diagonal, off):
    return symmetric_eigen(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))


def hessenberg_reduce(a):
    """Orthogonal Q and upper Hessenberg H with a = Q H Qᵀ."""
    h = np.array(a, float)
    n = len(h)
    q = np.eye(n)
    for k in range(n - 2):
        p = np.eye(n)
        p[k + 1 :, k + 1 :] = np.linalg.qr(h[k + 1 :, [k]], mode="complete")[0]
        h, q = p.T @ h @ p, q @ p
        h[k + 2 :, k] = 0.0
    return Hessenberg(q, h)


def eigen(a):
    """Eigenvalues and Schur vectors of a general matrix."""
    u, t = schur(a)
    return Eigen(eigenvalues_of_schur(t), u)


def determinant(a) -> float:
    a = np.asarray(a, float)
    try:
        return plu(a).determinant() if len(a) else 1.0
    except SolverError:
        return 0.0


def cofactor(a) -> np.ndarray:
    a = np.asarray(a, float)
    n = len(a)
    minor = lambda i, j: np.delete(np.delete(a, i, 0), j, 1)
    return np.array([[(-1.0) ** (i + j) * determinant(minor(i, j)) for j in range(n)] for i in range(n)])


def inverse(a) -> np.ndarray:
    """Up to 3 rows by cofactors (a singular matrix gives infinities or NaN); larger singular ones raise."""
    a = np.asarray(a, float)
    n = len(a)
    if n <= 3:
        with np.errstate(divide="ignore", invalid="ignore"):
            c = cofactor(a)
            return c.T / (a[0] @ c[0])
    q, r = np.linalg.qr(a)
    if (np.abs(np.diag(r)) <= EPS * np.abs(r).max()).any():
        raise SolverError("breakdown", "the matrix is singular")
    return triangular_solve(r, q.T, "upper")


def pseudoinverse(a, tol: float | None = None) -> np.ndarray:
    a = np.asarray(a, float)
    u, s, vt = svd(a)
    tol = max(a.shape) * EPS * (s[0] if len(s) else 0.0) if tol is None else tol
    return vt.T @ (np.divide(1.0, s, out=np.zeros_like(s), where=s > tol)[:, None] * u.T)


def givens(a: float, b: float) -> tuple[float, float]:
    """Cosine and sine that turn (a, b) to (r, 0)."""
    if b == 0:
        return 1.0, 0.0
    r = float(np.hypot(a, b))
    return a / r, b / r


def per_row(df: DataFrame, fn: Callable[[dict], dict], schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """fn on each row of a packed frame, with the columns to keep beside what it gives.

    A row whose kernel raises SolverError is left out; if the schema has a column status, it stays instead, with
    the kind of the error there ('ok' elsewhere) and nulls in what fn would give.
    """
    told = "status" in [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                kept = {c: row[c] for c in keep}
                try:
                    rows.append(kept | fn(row) | ({"status": "ok"} if told else {}))
                except SolverError as e:
                    if told:
                        rows.append(kept | {"status": e.kind})
            if rows:
                yield from pa.Table.from_pylist(rows, arrow).to_batches()

    arrow = _arrow_schema(schema)
    return df.mapInArrow(run, schema)


def _arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def per_stack(df: DataFrame, fn: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str, keep: tuple[str, ...], name: str = "a") -> DataFrame:
    """fn on all matrices of a batch that have one shape, as one array of three dimensions.

    df: nrow, ncol and a row-major array. fn gives an array by name of schema, its first dimension that of the
    matrices; what is left of each is a row-major array (or a number). Columns to keep stand beside.
    """
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = np.stack([batch.column(c).to_numpy() for c in ("nrow", "ncol")], axis=1)
            for shape in np.unique(shapes, axis=0):
                part = batch.filter(pa.array((shapes == shape).all(axis=1)))
                stack = np.asarray(part.column(name).flatten(), float).reshape(part.num_rows, *shape)
                columns = [part.column(c) for c in keep]
                for value in fn(stack).values():
                    value = np.asarray(value)
                    flat = value.reshape(part.num_rows, -1)
                    columns.append(pa.array(list(flat)) if value.ndim > 1 else pa.array(value))
                yield pa.record_batch([c.cast(t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def llt_stack(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower factors of a stack of matrices, and which of them are positive definite; the others' factors are NaN."""
    rest, out = np.tril(stack), np.zeros_like(stack, float)
    fine = np.ones(len(stack), bool)
    for k in range(stack.shape[1]):
        pivot = rest[:, k, k]
        fine &= pivot > 0
        out[:, k:, k] = rest[:, k:, k] / np.sqrt(np.where(pivot > 0, pivot, np.nan))[:, None]
        rest[:, k + 1 :, k + 1 :] -= np.tril(out[:, k + 1 :, k, None] * out[:, None, k + 1 :, k])
    return out, fine


DIRECT = {"plu": plu_solve, "llt": llt_solve, "ldlt": ldlt_solve, "qr": qr_solve, "qr_full": qr_solve_full}


def solve(a: Tensor, b: Tensor, solver: str | Callable[[np.ndarray, np.ndarray], np.ndarray] = "plu") -> Tensor:
    """Solve one system of coordinate tensors by a direct solver: a name of DIRECT, or any function of (matrix, right side).

    The system is gathered, so it has to fit the driver (to_numpy refuses larger ones); see the
    iterative solvers for spread ones.
    """
    from ..sources import from_numpy, to_numpy

    x = (DIRECT[solver] if isinstance(solver, str) else solver)(to_numpy(a), to_numpy(b))
    return from_numpy(a.spark, x)


def matrix_of(row: dict, name: str = "a") -> np.ndarray:
    """Row-major packed matrix of a row (nrow, ncol and the array)."""
    return np.asarray(row[name], float).reshape(int(row["nrow"]), int(row["ncol"]))
