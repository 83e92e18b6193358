"""Iterative solvers and Krylov methods, written once over a vector space.

``Local`` holds vectors as numpy arrays. ``Spread`` holds them as tensors of coordinate rows:
a matrix-vector product is a join and a sum, a dot product an aggregate, and each new
vector is a written table, so that lineage stays short and a lost executor costs a re-read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import numpy as np
from pyspark.sql import functions as F

from ..core import SolverError, Tensor
from ..tables import Tables
from .dense import givens, plu_solve, triangular_solve
from .products import matmul

TINY = np.finfo(float).tiny
LIMIT = 1e30


class Space(Protocol):
    def apply(self, v): ...
    def dot(self, a, b) -> float: ...
    def mix(self, *terms): ...
    def zero(self): ...


class Local:
    """A numpy matrix."""

    def __init__(self, a):
        self.a = np.asarray(a, float)

    def apply(self, v):
        return self.a @ v

    def dot(self, a, b):
        return float(a @ b)

    def mix(self, *terms):
        return sum(c * v for c, v in terms)

    def zero(self):
        return np.zeros(len(self.a))

    def scaled_by_diagonal(self, v):
        return v / np.diag(self.a)


class Spread:
    """A matrix of coordinate rows; it and each new vector are written as tables under the shared folder."""

    def __init__(self, a: Tensor):
        self.tables = Tables(a.spark, "spread")
        self.a = self._keep(a)

    def _keep(self, t: Tensor) -> Tensor:
        return t.with_(self.tables.put(t.df))

    def apply(self, v):
        return self._keep(matmul(self.a, v).with_(kind="vector"))

    def dot(self, a, b):
        return float(matmul(a, b).df.first()["v"])

    def mix(self, *terms):
        parts = [t.df.select("i0", (F.col("v") * float(c)).alias("v")) for c, t in terms]
        df = reduce(lambda x, y: x.unionByName(y), parts).groupBy("i0").agg(F.sum("v").alias("v"))
        return self._keep(Tensor(df, terms[0][1].shape, sparse=True))

    def zero(self):
        from ..sources import zeros

        return zeros(self.a.spark, (self.a.shape[0],))

    def scaled_by_diagonal(self, v):
        d = self.a.df.where("i0 = i1").select("i0", F.col("v").alias("d"))
        return self._keep(v.with_(v.df.join(d, "i0").select("i0", (F.col("v") / F.col("d")).alias("v"))))


@dataclass
class Solution:
    x: object
    residual_norm: float
    iterations: int


def space_of(a) -> Space:
    return a if hasattr(a, "apply") else Spread(a) if isinstance(a, Tensor) else Local(a)


def _size(space, v) -> float:
    return float(np.sqrt(max(space.dot(v, v), 0.0)))


def _start(space, b, x0):
    x = space.zero() if x0 is None else x0
    r = b if x0 is None else space.mix((1, b), (-1, space.apply(x)))
    return x, r


def jacobi(a, b, tol=1e-10, max_iter=1000, x0=None) -> Solution:
    """x += r / diagonal, until the residual's norm is below tol."""
    space = space_of(a)
    x, r = _start(space, b, x0)
    for k in range(max_iter):
        x = space.mix((1, x), (1, space.scaled_by_diagonal(r)))
        r = space.mix((1, b), (-1, space.apply(x)))
        size = _size(space, r)
        if size < tol:
            return Solution(x, size, k + 1)
        if not size <= LIMIT:
            raise SolverError("diverged", f"residual {size:g} after {k + 1} steps")
    raise SolverError("diverged", f"no convergence in {max_iter} steps")


def gauss_seidel(a, b, tol=1e-10, max_iter=1000, x0=None) -> Solution:
    """Each unknown in turn from the newest others: one task, as every step needs the one before."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    if (np.diag(a) == 0).any():
        raise SolverError("breakdown", "a diagonal entry is zero")
    lower, upper = np.tril(a), np.triu(a, 1)
    x = np.zeros(len(b)) if x0 is None else np.array(x0, float)
    for k in range(max_iter):
        x = triangular_solve(lower, b - upper @ x, "lower")
        size = float(np.linalg.norm(b - a @ x))
        if size < tol:
            return Solution(x, size, k + 1)
        if not size <= LIMIT:
            raise SolverError("diverged", f"residual {size:g} after {k + 1} steps")
    raise SolverError("diverged", f"no convergence in {max_iter} steps")


class Preconditioner(Protocol):
    def apply(self, r): ...


class JacobiPreconditioner:
    def __init__(self, a):
        self.space = space_of(a)

    def apply(self, r):
        return self.space.scaled_by_diagonal(r)


class SsorPreconditioner:
    """Forward sweep, scaling by the diagonal, backward sweep, and a factor of 2 - omega."""

    def __init__(self, a, omega: float = 1.0):
        a = np.asarray(a, float)
        d = np.diag(a)
        self.forward, self.backward = np.tril(a, -1) + np.diag(d / omega), np.triu(a, 1) + np.diag(d / omega)
        self.d, self.factor = d / omega, 2.0 - omega

    def apply(self, r):
        return self.factor * triangular_solve(self.backward, self.d * triangular_solve(self.forward, r, "lower"), "upper")


def conjugate_gradient(a, b, tol=1e-10, max_iter=1000, x0=None, preconditioner: Preconditioner | None = None) -> Solution:
    """For symmetric positive definite matrices; the residual is looked at before each step."""
    space = space_of(a)
    x, r = _start(space, b, x0)
    z = preconditioner.apply(r) if preconditioner else r
    p, rz = z, space.dot(r, z)
    for k in range(max_iter + 1):
        size = _size(space, r)
        if size < tol:
            return Solution(x, size, k)
        q = space.apply(p)
        curve = space.dot(p, q)
        if abs(curve) < TINY:
            raise SolverError("breakdown", "a direction has no curvature")
        step = rz / curve
        x, r = space.mix((1, x), (step, p)), space.mix((1, r), (-step, q))
        z = preconditioner.apply(r) if preconditioner else r
        before, rz = rz, space.dot(r, z)
        p = space.mix((1, z), (rz / before, p))
    raise SolverError("diverged", f"no convergence in {max_iter} steps")


def preconditioned_conjugate_gradient(a, b, preconditioner, tol=1e-10, max_iter=1000, x0=None):
    return conjugate_gradient(a, b, tol, max_iter, x0, preconditioner)


def bicgstab(a, b, tol=1e-10, max_iter=1000, x0=None) -> Solution:
    space = space_of(a)
    x, r = _start(space, b, x0)
    shadow, p = r, r
    rho = space.dot(shadow, r)
    for k in range(max_iter + 1):
        size = _size(space, r)
        if size < tol:
            return Solution(x, size, k)
        if size > LIMIT:
            raise SolverError("diverged", f"residual {size:g} after {k} steps")
        v = space.apply(p)
        against = space.dot(shadow, v)
        if abs(rho) < TINY or abs(against) < TINY:
            raise SolverError("breakdown", "the shadow residual is orthogonal")
        alpha = rho / against
        s = space.mix((1, r), (-alpha, v))
        if (half := _size(space, s)) < tol:
            return Solution(space.mix((1, x), (alpha, p)), half, k + 1)
        t = space.apply(s)
        tt = space.dot(t, t)
        if tt < TINY:
            raise SolverError("breakdown", "the stabiliser vanishes")
        omega = space.dot(t, s) / tt
        if abs(omega) < TINY:
            raise SolverError("breakdown", "the stabilising step vanishes")
        x, r = space.mix((1, x), (alpha, p), (omega, s)), space.mix((1, s), (-omega, t))
        before, rho = rho, space.dot(shadow, r)
        beta = rho / before * alpha / omega
        p = space.mix((1, r), (beta, p), (-beta * omega, v))
    raise SolverError("diverged", f"no convergence in {max_iter} steps")


def arnoldi(a, b, k: int) -> tuple[list, np.ndarray]:
    """Orthonormal basis of the Krylov space of b and the Hessenberg matrix; ends early when the space is full."""
    space = space_of(a)
    basis = [space.mix((1 / _size(space, b), b))]
    h = np.zeros((k + 1, k))
    for j in range(k):
        v = space.apply(basis[j])
        for _ in range(2):
            for i, q in enumerate(basis):
                c = space.dot(q, v)
                h[i, j] += c
                v = space.mix((1, v), (-c, q))
        h[j + 1, j] = _size(space, v)
        if h[j + 1, j] <= np.finfo(float).eps * max(1.0, np.abs(h[: j + 1, j]).max()):
            return basis, h[: j + 1, : j + 1]
        basis.append(space.mix((1 / h[j + 1, j], v)))
    return basis, h


def gmres(a, b, tol=1e-10, max_iter=1000, x0=None) -> Solution:
    """Without restarts; the Hessenberg matrix is made triangular by rotations as it grows."""
    space = space_of(a)
    x, r = _start(space, b, x0)
    size = _size(space, r)
    if size < tol:
        return Solution(x, size, 0)
    basis, columns, turns, g = [space.mix((1 / size, r))], [], [], [size]
    for k in range(max_iter):
        v = space.apply(basis[k])
        column = []
        for q in basis:
            c = space.dot(q, v)
            column.append(c)
            v = space.mix((1, v), (-c, q))
        below = _size(space, v)
        for i, (c, s) in enumerate(turns):
            column[i], column[i + 1] = c * column[i] + s * column[i + 1], c * column[i + 1] - s * column[i]
        c, s = givens(column[k], below)
        turns.append((c, s))
        column[k] = c * column[k] + s * below
        columns.append(column)
        g.append(-s * g[k])
        g[k] *= c
        if abs(g[-1]) < tol or below <= TINY or k + 1 == max_iter:
            n = k + 1
            upper = np.zeros((n, n))
            for j, col in enumerate(columns):
                upper[: len(col), j] = col[:n]
            y = triangular_solve(upper, np.array(g[:n]), "upper")
            x = space.mix((1, x), *zip(y.tolist(), basis, strict=False))
            left = _size(space, space.mix((1, b), (-1, space.apply(x))))
            if left < max(tol * 10, tol) or abs(g[-1]) < tol:
                return Solution(x, left, n)
            raise SolverError("diverged" if k + 1 == max_iter else "breakdown", f"residual {left:g} after {n} steps")
        basis.append(space.mix((1 / below, v)))
    raise SolverError("diverged", f"no convergence in {max_iter} steps")


def lanczos(a, v1, k: int) -> tuple[list, np.ndarray]:
    """Basis and tridiagonal matrix of a symmetric matrix; v1 is taken as it is."""
    space = space_of(a)
    basis, t = [v1], np.zeros((k, k))
    for j in range(k):
        v = space.apply(basis[j])
        t[j, j] = space.dot(basis[j], v)
        for _ in range(2):
            for q in basis:
                v = space.mix((1, v), (-space.dot(q, v), q))
        if j + 1 == k:
            break
        size = _size(space, v)
        if size <= np.finfo(float).eps:
            return basis, t[: j + 1, : j + 1]
        t[j, j + 1] = t[j + 1, j] = size
        basis.append(space.mix((1 / size, v)))
    return basis, t


def power_method(a, guess=None, tol=1e-10, max_iter=1000, seed: int = 0) -> tuple[float, object]:
    """Largest eigenvalue (Rayleigh quotient) and its vector; a zero guess becomes the first unit vector."""
    space = space_of(a)
    if guess is None:
        if not isinstance(space, Local):
            raise ValueError("a spread matrix needs a guess")
        guess = np.random.default_rng(seed).standard_normal(len(space.a))
    size = _size(space, guess)
    if size == 0:
        guess, size = np.eye(len(space.a))[0], 1.0
    v = space.mix((1 / size, guess))
    for _ in range(max_iter):
        w = space.apply(v)
        size = _size(space, w)
        if size == 0:
            return 0.0, v
        new = space.mix((1 / size, w))
        change = min(_size(space, space.mix((1, new), (-1, v))), _size(space, space.mix((1, new), (1, v))))
        v = new
        if change < tol:
            return space.dot(v, space.apply(v)), v
    raise SolverError("diverged", f"no convergence in {max_iter} steps")


@dataclass
class Level:
    a: np.ndarray
    restrict: np.ndarray | None = None
    prolong: np.ndarray | None = None


def build_hierarchy(a, levels: int) -> list[Level]:
    """Coarser matrices of a one-dimensional grid, by weights (1, 2, 1) around every second point."""
    out = [Level(np.asarray(a, float))]
    while len(out) < levels and (m := (len(out[-1].a) - 1) // 2) >= 1:
        n = len(out[-1].a)
        prolong = np.zeros((n, m))
        for j in range(m):
            prolong[2 * j : 2 * j + 3, j] = (0.5, 1.0, 0.5)
        out[-1].restrict, out[-1].prolong = prolong.T / 2, prolong
        out.append(Level(out[-1].restrict @ out[-1].a @ prolong))
    return out


def vcycle(levels: list[Level], b, x, sweeps: int = 2, omega: float = 2 / 3) -> np.ndarray:
    """Damped Jacobi before and after the coarser level's correction; the coarsest is solved."""
    top = levels[0]
    if len(levels) == 1:
        return plu_solve(top.a, b)
    d = np.diag(top.a)
    for _ in range(sweeps):
        x = x + omega * (b - top.a @ x) / d
    coarse = top.restrict @ (b - top.a @ x)
    x = x + top.prolong @ vcycle(levels[1:], coarse, np.zeros(len(coarse)), sweeps, omega)
    for _ in range(sweeps):
        x = x + omega * (b - top.a @ x) / d
    return x


def multigrid(levels: list[Level], b, tol=1e-10, max_iter=100, x0=None) -> Solution:
    b = np.asarray(b, float)
    x = np.zeros(len(b)) if x0 is None else np.asarray(x0, float)
    for k in range(max_iter):
        size = float(np.linalg.norm(b - levels[0].a @ x))
        if size < tol:
            return Solution(x, size, k)
        x = vcycle(levels, b, x)
    size = float(np.linalg.norm(b - levels[0].a @ x))
    if size < tol:
        return Solution(x, size, max_iter)
    raise SolverError("diverged", f"residual {size:g} after {max_iter} cycles")
