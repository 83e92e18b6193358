"""Dense kernels, solvers and geometry on golden values."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tensorloom import sources as S
from tensorloom.core import SolverError, Tensor
from tensorloom.functions import packed
from tensorloom.functions import quaternion as Q
from tensorloom.operators import dense as D
from tensorloom.operators import geometry as G
from tensorloom.operators import iterative as I

SYSTEMS = [([[4, 1], [1, 3]], [1, 2], [1 / 11, 7 / 11], True), ([[4, 1, 1], [1, 4, 1], [1, 1, 4]], [6, 6, 6], [1, 1, 1], True), ([[3, 1, 0], [0, 3, 1], [0, 0, 3]], [4, 4, 3], [1, 1, 1], False)]


@pytest.mark.parametrize(("a", "b", "x", "definite"), SYSTEMS)
def test_solvers(a, b, x, definite):
    a, b = np.array(a, float), np.array(b, float)
    for solve in (D.plu_solve, D.qr_solve):
        assert np.allclose(solve(a, b), x)
    for solve in (I.jacobi, I.gauss_seidel, I.gmres, I.bicgstab):
        found = solve(a, b)
        assert np.allclose(found.x, x)
        assert found.residual_norm < 1e-8
    if definite:
        assert np.allclose(D.llt_solve(a, b), x)
        assert np.allclose(D.ldlt_solve(a, b), x)
        plain = I.conjugate_gradient(a, b)
        assert plain.iterations <= len(b)
        for p in (I.JacobiPreconditioner(a), I.SsorPreconditioner(a)):
            assert np.allclose(I.preconditioned_conjugate_gradient(a, b, p).x, x)


def test_failures():
    with pytest.raises(SolverError) as e:
        D.llt([[1, 2], [2, 1]])
    assert e.value.kind == "breakdown"
    for bad in (lambda: D.plu([[0.0, 0], [0, 1]]), lambda: D.triangular_solve(np.eye(2), [1, 1], "strictly_lower"), lambda: D.ldlt_solve(np.zeros((2, 2)), [1, 1]), lambda: D.inverse(np.ones((4, 4))), lambda: D.schur(np.ones((2, 3))), lambda: I.gauss_seidel(np.zeros((2, 2)), [1, 1])):
        with pytest.raises(SolverError):
            bad()
    with pytest.raises(SolverError) as e:
        I.jacobi([[1, 5], [7, 1]], np.array([1.0, 1.0]))
    assert e.value.kind == "diverged"
    assert not np.isfinite(D.inverse(np.ones((2, 2)))).all()


def test_least_squares():
    assert np.allclose(D.qr_solve([[1, 0], [0, 1], [1, 1]], [1, 1, 3]), 4 / 3)
    assert np.allclose(D.qr_solve([[1, 0], [0, 1], [1, 1], [1, -1]], [2, 3, 5, -1]), [2, 3])


def test_spectra():
    assert np.allclose(D.svd(np.diag([3.0, 5]))[1], [5, 3])
    assert np.isclose(D.svd([[1, 2], [2, 4]])[1][1], 0)
    assert np.allclose(D.symmetric_eigen([[4, 1, 1], [1, 4, 1], [1, 1, 4]])[0], [3, 3, 6])
    assert np.allclose(np.abs(D.eigen([[0, -1], [1, 0]])[0]), 1)
    assert np.isclose(D.spectral_norm(np.diag([2, 5, 3])), 5)
    assert D.condition_number(np.diag([1.0, 0])) == np.inf
    assert D.condition_number(np.zeros((0, 0))) == 0
    value, vector = I.power_method([[2, 1], [1, 2]])
    assert np.isclose(value, 3)
    assert np.allclose(np.abs(vector), np.sqrt(0.5))
    assert np.allclose(D.tridiagonal_eigen([2, 2], [1])[0], [1, 3])


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 6), st.integers(0, 3))
def test_factorisations(seed, n, more):
    a = np.random.default_rng(seed).normal(size=(n + more, n))
    square = a[:n] + np.eye(n) * 3
    q, r = D.qr(a)
    assert np.allclose(q @ r, a)
    assert (np.diag(r) >= 0).all()
    q, r, order = D.qr_col_pivot(a)
    assert np.allclose(q @ r, a[:, order])
    assert np.allclose(D.pseudoinverse(a), np.linalg.pinv(a))
    lu = D.plu(square)
    assert np.allclose(square[lu.order], lu.lower @ lu.upper)
    assert np.isclose(lu.determinant(), np.linalg.det(square))
    u, t = D.schur(square)
    assert np.allclose(u @ t @ u.T, square)
    assert np.allclose(np.sort_complex(D.eigenvalues_of_schur(t)), np.sort_complex(np.linalg.eigvals(square)))
    rot, stretch = D.polar(square)
    assert np.allclose(rot @ stretch, square)
    assert np.isclose(np.linalg.det(rot), 1)
    assert np.allclose(square @ D.inverse(square), np.eye(n))


def test_gram_schmidt_and_rank():
    q = D.gram_schmidt([[1, 2, 0], [0, 0, 1], [0, 0, 0]])
    assert np.allclose(q, [[1, 0, 0], [0, 0, 1], [0, 0, 0]])
    assert D.rank(np.outer([1.0, 2, 3], [1.0, 1, 1])) == 1
    assert D.rank(np.zeros((2, 2))) == 0
    assert D.givens(3, 4) == (0.6, 0.8)
    assert D.givens(3, 0) == (1.0, 0.0)


def test_krylov():
    a = np.array([[2, 1, 0], [1, 3, 1], [0, 1, 4.0]])
    v, t = I.lanczos(a, np.array([1.0, 0, 0]), 3)
    v = np.array(v).T
    assert np.allclose(v.T @ v, np.eye(3))
    assert np.allclose(v.T @ a @ v, t)
    q, h = I.arnoldi(a, np.array([1.0, 2, 3]), 2)
    q = np.array(q).T
    assert np.allclose(a @ q[:, :2], q @ h)
    assert len(I.arnoldi(np.eye(3), np.ones(3), 3)[0]) == 1


def test_multigrid():
    n = 7
    a = (n + 1) ** 2 * (2 * np.eye(n) - np.eye(n, k=1) - np.eye(n, k=-1))
    levels = I.build_hierarchy(a, 5)
    assert [len(x.a) for x in levels] == [7, 3, 1]
    assert levels[0].restrict.shape == (3, 7)
    assert np.allclose(levels[0].restrict[0], [0.25, 0.5, 0.25, 0, 0, 0, 0])
    assert np.allclose(I.multigrid(levels, a.sum(axis=1)).x, 1)


def test_spread_solvers(spark):
    a = S.from_values(spark, [[4, 1], [1, 3]]).with_(sparse=True)
    b = S.from_values(spark, [1, 2])
    for solve in (I.conjugate_gradient, I.jacobi):
        found = solve(a, b, tol=1e-4)
        got = [r["v"] for r in found.x.densify().df.orderBy("i0").collect()]
        assert np.allclose(got, [1 / 11, 7 / 11], atol=1e-3)
    value, _ = I.power_method(Tensor(a.df, (2, 2), sparse=True), b, tol=1e-2)
    assert abs(value - np.linalg.eigvalsh([[4, 1], [1, 3]])[-1]) < 1e-2


def test_transforms():
    t = G.translation(1, 2, 3) @ G.rotation(0.7, (1, 1, 0)) @ G.scaling(2, 3, 4)
    assert t.mode == G.Mode.AFFINE
    assert np.allclose((t.inverse() @ t).matrix, np.eye(4))
    shift, rot, scale = G.trs_decompose(t)
    assert np.allclose(shift, [1, 2, 3])
    assert np.allclose(scale, [2, 3, 4])
    assert np.allclose(rot, G.rotation(0.7, (1, 1, 0)).linear)
    assert (G.perspective(1, 1, 1, 9) @ t).mode == G.Mode.PROJECTIVE
    assert np.allclose(G.rotation(np.pi / 2, (0, 0, 1)).linear @ [1, 0, 0], [0, 1, 0])
    assert G.trs_decompose(G.scaling(-1, 2, 3))[2][0] < 0
    assert np.allclose(G.infinite_perspective(1, 1.5, 0.1).matrix, G.perspective(1, 1.5, 0.1, 1e12).matrix, atol=1e-6)


def test_columns(spark):
    one = spark.range(1)
    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    get = lambda *c: [float(x) for x in one.select(*c).first()]
    assert get(G.distance(lit(0, 0, 0), lit(3, 4, 0))) == [5]
    assert get(*G.reflect(lit(1, -1, 0), lit(0, 1, 0))) == [1, 1, 0]
    assert get(*G.refract(lit(0, -1, 0), lit(0, 1, 0), 1.0)) == [0, -1, 0]
    assert get(*G.refract(lit(1, 0, 0), lit(0, 1, 0), 2.0)) == [0, 0, 0]
    flat = G.Transform(np.eye(4), G.Mode.ISOMETRY)
    assert np.allclose(get(*G.project(lit(0, 0, -10), flat, G.perspective(np.pi / 2, 1, 1, 100), (0, 0, 100, 100)))[:2], 50)
    q = Q.angle_axis(*lit(np.pi / 2, 0, 1, 0))
    assert np.allclose(get(*(q[n] for n in "wxyz")), [np.sqrt(0.5), 0, np.sqrt(0.5), 0])
    e0 = F.array(*lit(1, 0, 0))
    assert one.select(packed.cross(e0, F.array(*lit(0, 1, 0)))).first()[0] == [0, 0, 1]
    assert one.select(packed.compare(e0, F.array(*lit(1, 0)))).first()[0] == 1
    assert one.select(packed.strided(F.array(*lit(0, 1, 2, 3, 4)), 1, 4, 2)).first()[0] == [1, 3]
    assert one.select(packed.gather(e0, [0, 0])).first()[0] == [1, 1]
    half = Q.slerp(Q.quaternion(1, 0, 0, 0), Q.quaternion(-1, 0, 0, 0), F.lit(0.5))
    assert get(half["w"]) == [1]


def test_per_row(spark):
    df = spark.createDataFrame([(1, 2, 2, [2.0, 1.0, 4.0, 3.0])], "id long, nrow int, ncol int, a array<double>")
    out = D.per_row(df, lambda r: {"id": r["id"], "det": D.determinant(D.matrix_of(r))}, "id long, det double")
    assert out.first().det == pytest.approx(2.0)
