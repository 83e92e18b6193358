"""Sparse direct solvers, statuses, Schur strategies, checked references and other kernels on golden and random values."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tensorloom import sources as S
from tensorloom.core import SolverError, Tensor
from tensorloom.operators import arithmetic as A
from tensorloom.operators import dense as D
from tensorloom.operators import geometry as G
from tensorloom.operators import indexing as X
from tensorloom.operators import products as P
from tensorloom.operators import reductions as R
from tensorloom.operators import sparse_direct as SD


def entries(a):
    return SD.Entries.of(((i, j, v) for (i, j), v in np.ndenumerate(a) if v), a.shape)


def random_sparse(seed, n, m=None, share=0.2):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, m or n))
    return np.where(rng.random(a.shape) < share, a, 0.0)


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 25))
def test_sparse_solvers_match_dense_ones(seed, n):
    a, x = random_sparse(seed, n), np.arange(1.0, n + 1)
    square = a + n * np.eye(n)
    assert np.allclose(SD.umfpack_solve(entries(square), square @ x), x)
    assert np.allclose(SD.spqr_solve(entries(square), square @ x), x)
    definite = a @ a.T + np.eye(n)
    factor = SD.cholmod_factor(entries(definite))
    assert np.allclose(factor.solve(definite @ x), x)
    assert np.isclose(factor.determinant(), np.linalg.det(definite))
    tall = np.vstack((random_sparse(seed + 1, 2 * n, n), np.eye(n)))
    b = np.random.default_rng(seed).normal(size=len(tall))
    assert np.allclose(SD.spqr_solve(entries(tall), b), np.linalg.lstsq(tall, b, rcond=None)[0])
    thin = random_sparse(seed, n, max(1, n // 3), 0.4)
    assert SD.spqr_rank(entries(thin)) == np.linalg.matrix_rank(thin)


def test_sparse_breakdowns_and_fill():
    for solve, a in ((SD.cholmod_solve, [[1.0, 2], [2, 1]]), (SD.umfpack_solve, [[1.0, 1], [1, 1]]), (SD.umfpack_solve, [[0.0, 0], [1, 1]]), (SD.umfpack_solve, [[1.0, 0, 1]])):
        with pytest.raises(SolverError) as e:
            solve(entries(np.array(a)), np.ones(len(a)))
        assert e.value.kind == "breakdown"
    # An arrow whose first row is full: in the given order its factor would be full too.
    n = 30
    arrow = np.eye(n) * n
    arrow[0], arrow[:, 0] = 1, 1
    arrow[0, 0] = n
    assert SD.cholmod_factor(entries(arrow)).nnz() == 2 * n - 1
    assert SD.spqr_rank(entries(np.zeros((3, 3)))) == 0


def test_groups_of_systems(spark):
    rows = [(g, i, j, float(v)) for g, a in enumerate(([[4, 1], [1, 3]], [[1, 2], [2, 1]])) for i, row in enumerate(a) for j, v in enumerate(row)]
    rows += [(g, i, 2, b) for g in (0, 1) for i, b in enumerate((1.0, 2.0))]
    got = SD.solve_groups(spark.createDataFrame(rows, "g long, i0 long, i1 long, v double"), "g", SD.cholmod_solve, 2).orderBy("g", "i0").collect()
    assert [(r.g, r.i0, r.status) for r in got] == [(0, 0, "ok"), (0, 1, "ok"), (1, None, "breakdown")]
    assert np.allclose([r.v for r in got[:2]], [1 / 11, 7 / 11])
    assert got[2].v is None


def test_status_of_rows(spark):
    df = spark.createDataFrame([(1, 2, 2, [4.0, 1.0, 1.0, 3.0]), (2, 2, 2, [1.0, 2.0, 2.0, 1.0])], "id long, nrow int, ncol int, a array<double>")
    run = lambda r: {"x": float(D.llt(D.matrix_of(r))[0, 0])}
    assert [tuple(r) for r in D.per_row(df, run, "id long, x double, status string", keep=("id",)).orderBy("id").collect()] == [(1, 2.0, "ok"), (2, None, "breakdown")]
    assert [tuple(r) for r in D.per_row(df, run, "id long, x double", keep=("id",)).collect()] == [(1, 2.0)]
    assert D.per_row(df.limit(0), run, "id long, x double", keep=("id",)).collect() == []
    more = df.unionByName(spark.createDataFrame([(3, 1, 1, [9.0])], df.schema))

    def stacked(stack):
        lower, fine = D.llt_stack(stack)
        return {"l": lower, "fine": fine}

    got = {r.id: (r.l, r.fine) for r in D.per_stack(more, stacked, "id long, l array<double>, fine boolean", keep=("id",)).collect()}
    assert np.allclose(got[1][0], D.llt([[4, 1], [1, 3]]).ravel())
    assert [got[k][1] for k in (1, 2, 3)] == [True, False, True]
    assert got[3][0] == [3.0]


@pytest.mark.parametrize("strategy", D.STRATEGIES)
def test_schur(strategy):
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 5, 8, 12):
        for a in (rng.normal(size=(n, n)), np.diag(np.arange(1.0, n + 1)), np.roll(np.eye(n), 1, axis=0)):
            u, t = D.schur(a, strategy=strategy)
            assert np.allclose(u @ t @ u.T, a)
            assert np.allclose(u @ u.T, np.eye(n))
            assert np.allclose(np.tril(t, -2), 0)
            below = np.flatnonzero(np.diag(t, -1))
            assert (np.diff(below) > 1).all()
            assert np.allclose(np.sort_complex(D.eigenvalues_of_schur(t)), np.sort_complex(np.linalg.eigvals(a)), atol=1e-6)
    with pytest.raises(SolverError) as e:
        D.schur(rng.normal(size=(6, 6)), max_iter=1, strategy=strategy)
    assert e.value.kind == "diverged"
    with pytest.raises(ValueError, match="strategy"):
        D.schur(np.eye(2), strategy="none")


def test_solver_of_choice(spark):
    a, b = S.from_values(spark, [[4, 1], [1, 3]]), S.from_values(spark, [1, 2])
    for solver in (*D.DIRECT, lambda m, v: np.linalg.solve(m, v)):
        assert np.allclose(S.to_numpy(D.solve(a, b, solver)), [1 / 11, 7 / 11])
    assert np.allclose(D.qr_solve_full([[1, 0], [0, 1], [1, 1]], [1, 1, 3]), 4 / 3)
    f = D.qr([[1.0, 0], [0, 1], [1, 1]])
    assert (f.q @ f.r).shape == (3, 2)


def test_references_and_extents(spark):
    t = S.from_rows(spark.createDataFrame([(0, 1, 3.0), (2, 2, 0.0)], "i long, j long, v double"), ["i", "j"], "v", (3, 3))
    assert t.coeff_ref(0, 1) == 3
    assert t.coeff_ref(2, 2) == 0
    assert t.with_coeff(5.0, 0, 1).coeff(0, 1) == 5
    for bad in (lambda: t.coeff_ref(1, 1), lambda: t.with_coeff(1.0, 1, 1)):
        with pytest.raises(KeyError):
            bad()
    with pytest.raises(IndexError):
        t.coeff_ref(3, 0)
    assert t.as_extents(3, None).shape == (3, 3)
    for shape in ((3, 2), (3,), (3, 3, 1)):
        with pytest.raises(ValueError, match="is not"):
            t.as_extents(*shape)
    assert t.as_dynamic().shape == (3, 3)
    open_ = Tensor(t.df, (None, 3), sparse=True)
    assert open_.as_extents(5, 3).shape == (5, 3)
    assert open_.as_dynamic().shape == (3, 3)
    assert {(r.i0, r.v) for r in t.nnz_by(1).df.collect()} == {(1, 1.0), (2, 1.0)}


def test_zeros_take_part(spark):
    def make(cells, shape=(3, 3)):
        return S.from_rows(spark.createDataFrame(cells, "i long, j long, v double"), ["i", "j"], "v", shape)

    a, b = make([(0, 1, -3.0), (1, 0, -4.0), (1, 1, -1.0), (1, 2, -2.0)]), make([(0, 1, 2.0), (2, 2, 5.0)])
    values = lambda t: {r.i0: r.v for r in t.df.collect()}
    assert values(R.rowwise(a, F.max)) == {0: 0.0, 1: -1.0}
    assert values(R.rowwise(a, F.min)) == {0: -3.0, 1: -4.0}
    assert values(R.rowwise(a, F.avg)) == {0: -1.0, 1: pytest.approx(-7 / 3)}
    assert values(R.colwise(a, F.product)) == {0: 0.0, 1: 0.0, 2: 0.0}
    assert values(R.rowwise(a, F.count)) == {0: 3, 1: 3, 2: 3}
    assert values(R.rowwise(a, F.sum)) == {0: -3.0, 1: -7.0}
    assert R.max_coeff(a).df.first().v == 0
    assert R.min_coeff(a).df.first().v == -4
    assert tuple(R.extreme_with_index(a, least=False).first()) == (0.0, 0, 0)
    assert tuple(R.extreme_with_index(a).first()) == (-4.0, 1, 0)
    assert tuple(R.extreme_with_index(make([(0, 0, 1.0), (0, 1, 0.0)])).first()) == (0.0, 0, 1)
    whole = make([(i, j, 1.0 + i + j) for i in range(2) for j in range(2)], (2, 2))
    assert tuple(R.extreme_with_index(whole).first()) == (1.0, 0, 0)
    assert R.min_coeff(whole).df.first().v == 1
    assert tuple(R.extreme_with_index(make([], (2, 2))).first()) == (0.0, 0, 0)
    low = A.combine("min", a, b)
    assert low.sparse
    assert {(r.i0, r.i1): r.v for r in low.df.collect()} == {(0, 1): -3.0, (1, 0): -4.0, (1, 1): -1.0, (1, 2): -2.0, (2, 2): 0.0}
    more = A.combine("lt", a, b).densify()
    assert {(r.i0, r.i1) for r in more.df.collect() if r.v} == {(0, 1), (1, 0), (1, 1), (1, 2), (2, 2)}
    dense = A.combine("eq", a, b)
    assert sum(r.v for r in dense.df.collect()) == 4
    beside = A.combine("sub", whole, make([(0, 0, 1.0)], (2, 2)).densify())
    assert {(r.i0, r.i1): r.v for r in beside.df.collect()}[0, 0] == 0
    for plan in (R.min_coeff(a).df, R.extreme_with_index(a), low.df):
        assert "Range (0, 9" not in plan._jdf.queryExecution().toString(), "no grid is made"


def test_masks_and_rounding(spark):
    t = S.from_values(spark, [float("nan"), float("inf"), -1e300, 2.5, -2.5])
    at = lambda x: [r.v for r in S.to_local(x)]
    for name, want in (("floor", [2, -3]), ("ceil", [3, -2]), ("round", [3, -3])):
        got = at(A.math(t, name))
        assert np.isnan(got[0])
        assert got[1:] == [float("inf"), -1e300, *want]
    got = at(A.combine("mod", S.from_values(spark, [5.0, -5, 5, float("inf")]), S.from_values(spark, [0.0, 3, float("inf"), 2])))
    assert np.isnan(got[0])
    assert np.isnan(got[3])
    assert got[1:3] == [-2, 5]
    a, b = A.combine("gt", t, 0.0), A.combine("lt", t, 0.0)
    assert at(A.combine("eq", a, b)) == [True, False, False, False, False]
    assert at(A.combine("ne", a, b)) == [False, True, True, True, True]
    assert A.equals(a, a)
    assert not A.equals(a, b)
    assert at(A.combine("logical_or", a, b)) == [False, True, True, True, True]
    assert at(A.combine("logical_and", a, a)) == at(a)


def test_products_in_chunks(spark):
    rng = np.random.default_rng(0)
    a, b = random_sparse(1, 12, 3, 0.9), random_sparse(2, 3, 15, 0.9)
    make = lambda m: S.from_rows(spark.createDataFrame([(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(m) if v], "i long, j long, v double"), ["i", "j"], "v", m.shape)
    for chunk in (None, 1, 4, 1000):
        assert np.allclose(S.to_numpy(P.matmul(make(a), make(b), chunk)), a @ b)
    t = S.from_numpy(spark, rng.normal(size=(3, 3, 2, 3)))
    got = P.contract(t, 0, 1, 3)
    assert np.allclose(S.to_numpy(got), np.einsum("iiji->j", S.to_numpy(t)))
    for bad in ((0,), (0, 2), (1, 1)):
        with pytest.raises(ValueError, match="dimensions"):
            P.contract(t, *bad)


def test_scans_and_long_fibers(spark, monkeypatch):
    t = S.from_values(spark, [[1, 2, 3], [4, 5, 6]])
    got = R.scan_fibers(t, lambda v, w: F.sum(v).over(w), 0)
    assert S.to_numpy(got).tolist() == [[1, 3, 6], [4, 9, 15]]
    assert S.to_numpy(R.scan_fibers(t, lambda v, w: F.max(v).over(w), 1, within=1)).tolist() == [[1, 2, 3], [4, 5, 6]]
    monkeypatch.setattr(R, "LONGEST_FIBER", 2)
    with pytest.raises(ValueError, match="longer"):
        R.transform_fibers(t, np.cumsum)


def test_accessors_and_sources(spark):
    for angle in (0.5, 3.0, np.pi, 0.0):
        turn = G.rotation(angle, (1, 2, 2))
        assert np.isclose(turn.angle, angle)
        if 0 < angle < np.pi:
            assert np.allclose(turn.axis, np.array([1, 2, 2]) / 3)
        elif angle:
            assert np.allclose(np.abs(turn.axis), np.array([1, 2, 2]) / 3)
    one, two = (spark.range(100).repartition(k).select("id", S.random_column(1, "normal", by=["id"]).alias("v")).orderBy("id").collect() for k in (2, 5))
    assert one == two
    assert X.lift(S.from_values(spark, [1, 2])).shape == (2, None)


def test_tables_need_a_shared_folder():
    from types import SimpleNamespace

    from tensorloom.tables import Tables

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint"):
        Tables(session, "x")
