"""Coordinate operators on small golden values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom import sources as S
from tensorloom.core import Tensor, grid
from tensorloom.operators import arithmetic as A
from tensorloom.operators import indexing as X
from tensorloom.operators import products as P
from tensorloom.operators import reductions as R
from tensorloom.plans import chain, chain_order, gram_packed


def rows(t):
    """Nested lists of a small tensor."""
    t = t.densify()
    flat = [r["v"] for r in S.to_local(t)]
    for n in reversed(t.shape[1:]):
        flat = [flat[k : k + n] for k in range(0, len(flat), n)]
    return flat


@pytest.fixture
def vals(spark):
    return lambda nested: S.from_values(spark, nested)


@pytest.fixture
def sparse(spark):
    def make(nested):
        cells = [(i, j, float(v)) for i, row in enumerate(nested) for j, v in enumerate(row) if v]
        return S.from_rows(spark.createDataFrame(cells, "i long, j long, v double"), ["i", "j"], "v", (len(nested), len(nested[0])))

    return make


M = [[1, 0, 2], [0, 3, 0], [4, 0, 5]]
N = [[0, 6, 0], [7, 0, 8], [0, 9, 0]]


def test_elementwise(vals):
    a, b = vals([1, 2, 3]), vals([10, 20, 30])
    assert rows(A.combine("add", a, b)) == [11, 22, 33]
    assert rows(A.combine("sub", b, a)) == [9, 18, 27]
    assert rows(A.combine("mul", vals([2, 3, 4]), vals([5, 6, 7]))) == [10, 18, 28]
    assert rows(A.combine("div", b, vals([2, 4, 5]))) == [5, 5, 6]
    assert rows(A.combine("mod", vals([-7, 7]), 3.0)) == [-1, 1]
    assert rows(A.combine("min", a, 2.0)) == [1, 2, 2]
    assert rows(A.combine("sub", 10.0, a)) == [9, 8, 7]
    assert rows(A.combine("add", a, S.scalar(a.spark, 5))) == [6, 7, 8]
    assert rows(A.negate(a)) == [-1, -2, -3]


def test_ieee(vals):
    assert rows(A.combine("div", vals([1, -1]), 0.0)) == [math.inf, -math.inf]
    assert math.isnan(rows(A.combine("div", vals([0]), 0.0))[0])
    assert rows(A.math(vals([0, 1]), "log"))[0] == -math.inf
    nan = vals([float("nan"), 1.0])
    assert rows(A.combine("lt", nan, 2.0)) == [False, True]
    assert rows(A.combine("eq", nan, nan)) == [False, True]
    assert rows(A.combine("max", vals([1, 1]), nan)) == [1, 1]


def _logs_of_odd_values(spark, name):
    """Logarithms of NULL, zeros of both signs, -1, NaN, both infinities, 1 and 8, as told by SQL."""
    odd = [None, 0.0, -0.0, -1.0, math.nan, math.inf, -math.inf, 1.0, 8.0]
    df = spark.createDataFrame(list(enumerate(odd)), "i0 long, v double")
    return [r["v"] for r in A.math(Tensor(df, (len(odd),)), name).df.orderBy("i0").collect()]


def _same_logs(got, of_8):
    want = [None, -math.inf, -math.inf, math.nan, math.nan, math.inf, math.nan, 0.0]
    assert list(map(repr, got[:-1])) == list(map(repr, want))
    assert math.isclose(got[-1], of_8, rel_tol=1e-15)


def test_log_keeps_nulls(spark):
    _same_logs(_logs_of_odd_values(spark, "log"), math.log(8))


def test_log2_keeps_nulls(spark):
    _same_logs(_logs_of_odd_values(spark, "log2"), 3.0)


def test_log10_keeps_nulls(spark):
    _same_logs(_logs_of_odd_values(spark, "log10"), math.log10(8))


def test_selection(vals):
    a, b = vals([1, 5, 3, 7]), vals([2, 3, 3, 1])
    pick = A.select_order(A.combine("spaceship", a, b), vals([-10, -20, -30, -40]), vals([0] * 4), vals([10, 20, 30, 40]))
    assert rows(pick) == [-10, 20, 0, 40]
    assert rows(A.select(A.combine("gt", a, b), a, b)) == [2, 5, 3, 7]
    unordered = A.select_order(A.combine("spaceship", vals([float("nan")]), 1.0), vals([1]), vals([2]), vals([3]))
    assert rows(unordered) == [3]


def test_sparse(sparse, spark, vals):
    a, b = sparse(M), sparse(N)
    assert rows(P.matmul(a, vals([1, 2, 3]))) == [7, 6, 19]
    assert rows(P.matmul(a, a)) == [[9, 0, 12], [0, 9, 0], [24, 0, 33]]
    assert rows(P.matmul(sparse([[1, 0, 2], [0, 3, 0]]), sparse([[4, 0], [0, 5], [6, 0]]))) == [[16, 0], [0, 15]]
    assert rows(A.combine("add", a, b)) == [[1, 6, 2], [7, 3, 8], [4, 9, 5]]
    assert A.combine("sub", a, a).prune().nnz() == 0
    assert A.combine("mul", a, b).nnz() == 0
    twice = spark.createDataFrame([(1, 1, 3.0), (1, 1, 7.0), (None, 1, 1.0)], "i long, j long, v double")
    t = S.from_rows(twice, ["i", "j"], "v", (2, 2))
    assert t.coeff(1, 1) == 10
    assert t.coeff(0, 1) == 0
    with pytest.raises(IndexError):
        t.coeff(2, 0)
    gone = A.combine("add", sparse([[1, 1]]), sparse([[-1, 1]]))
    assert gone.nnz() == 2
    assert gone.prune().nnz() == 1


def test_zero_keeping(sparse):
    a = sparse([[4, 0], [0, 9]])
    assert A.math(a, "sqrt").nnz() == 2
    assert rows(A.math(a, "cos"))[0][1] == 1.0
    assert rows(A.combine("add", a, 1.0)) == [[5, 1], [1, 10]]
    assert rows(R.mean(a))[0] == 13 / 4
    assert rows(R.product(a))[0] == 0
    assert rows(R.min_coeff(a))[0] == 0


def test_indexing(vals, spark):
    m = vals([[1, 2, 3], [4, 5, 6], [7, 8, 9]])
    assert rows(X.reshape(vals([1, 2, 3, 4, 5, 6]), 2, 3)) == [[1, 2, 3], [4, 5, 6]]
    assert rows(X.transpose(m)) == [[1, 4, 7], [2, 5, 8], [3, 6, 9]]
    assert rows(X.slice_(m, [2, 0, 2], 1)) == [8, 2, 8]
    assert rows(X.slice_(m, X.strided(0, 3, 2), slice(None))) == [[1, 2, 3], [7, 8, 9]]
    assert X.slice_(m, X.strided(0, 3, 2), slice(None)).shape == (2, 3)
    assert rows(X.bottom_rows(m, 1)) == [[7, 8, 9]]
    assert rows(X.right_cols(m, 1)) == [[3], [6], [9]]
    assert rows(X.diagonal(m)) == [1, 5, 9]
    assert rows(X.with_slice(m, vals([[0]]), 1, 1))[1] == [4, 0, 6]
    assert X.swizzle(m, 1, None, 0).shape == (3, 1, 3)
    assert rows(X.homogeneous(S.unit(spark, 3, 0))) == [1, 0, 0, 1]
    assert rows(X.homogeneous(S.unit(spark, 3, 0), "vector")) == [1, 0, 0, 0]
    assert rows(X.homogeneous(vals([[1, 2], [3, 4]]), "affine")) == [[1, 2], [3, 4], [0, 1]]
    assert rows(A.combine("add", m, X.repeat_right(vals([10, 20, 30])))) == [[11, 12, 13], [24, 25, 26], [37, 38, 39]]
    assert X.anti_slice(vals([1, 2]), 1).shape == (2, 1)
    assert X.anti_slice(vals([1, 2]), 1).as_kind("vector").shape == (2,)
    for bad in (lambda: X.slice_(m, 3, 0), lambda: X.strided(-1, 2), lambda: X.reshape(m, 2, 2), lambda: X.slice_(m, X.strided(2, 2), 0)):
        with pytest.raises((IndexError, ValueError)):
            bad()


def test_triangles(vals):
    m = vals([[1, 2, 3], [4, 5, 6], [7, 8, 9]])
    assert rows(A.triangular(m, "lower")) == [[1, 0, 0], [4, 5, 0], [7, 8, 9]]
    assert rows(A.triangular(m, "unit_upper")) == [[1, 2, 3], [0, 1, 6], [0, 0, 1]]
    assert rows(A.triangular(m, "off_diagonal")) == [[0, 2, 3], [4, 0, 6], [7, 8, 0]]


def test_products(vals, spark):
    x, y = S.unit(spark, 3, 0), S.unit(spark, 3, 1)
    assert rows(P.cross(x, y)) == [0, 0, 1]
    assert rows(P.cross(y, x)) == [0, 0, -1]
    a, b = vals([[1, 2], [3, 4]]), vals([[5, 6], [7, 8]])
    assert rows(P.full_contract(P.outer(a, b))) == [69]
    assert rows(P.contract(P.outer(a, b), 1, 2)) == rows(P.matmul(a, b))
    f, g = vals([1, 2]).as_kind("form"), vals([3, 5]).as_kind("form")
    assert rows(P.wedge(f, g)) == [[0, -1], [1, 0]]
    assert rows(P.form_times(f, vals([3, 4]))) == [11]
    assert P.form_times(f, a).kind == "form"
    assert rows(P.form_times(f, a)) == [7, 10]
    assert rows(P.diagonal_pairing(a, b)) == [1 * 5 + 4 * 8]
    assert rows(P.gram(a)) == [[10, 14], [14, 20]]
    with pytest.raises(ValueError):
        P.matmul(a, vals([1, 2, 3]))


def test_reductions(vals, sparse):
    assert tuple(R.extreme_with_index(vals([0, 1, 2])).first()) == (0, 0)
    assert tuple(R.extreme_with_index(vals([1, 2, 2, 0]), least=False).first()) == (2, 1)
    m = vals([[1, -2], [3, 4]])
    assert rows(R.inf_norm(m)) == [7]
    assert rows(R.one_norm(m)) == [6]
    assert rows(R.total(m)) == [6]
    assert rows(R.trace(m)) == [5]
    assert rows(R.norm(vals([3, 4]))) == [5]
    assert rows(R.norm_powered(vals([-2, 1]), 3)) == [9]
    assert rows(R.rowwise(m, F.sum)) == [-1, 7]
    assert rows(R.colwise(m, F.sum)) == [4, 2]
    assert rows(R.normalized(vals([3, 4]))) == [0.6, 0.8]
    assert rows(R.normalize_fibers(vals([[3, 4], [0, 2]]))) == [[0.6, 0.8], [0, 1]]
    assert rows(R.transform_fibers(sparse([[1, 0, 2]]), lambda v: v[::-1])) == [[2, 0, 1]]
    assert rows(R.any_(A.combine("gt", m, 3.0))) == [True]
    assert rows(R.all_(A.combine("gt", m, 3.0))) == [False]


def test_empty(spark):
    z = S.zeros(spark, (0,))
    assert rows(R.total(z)) == [0]
    assert rows(R.product(z)) == [1]
    assert rows(R.min_coeff(z)) == [1.7976931348623157e308]
    assert rows(S.zeros(spark, (2, 2))) == [[0, 0], [0, 0]]


def test_sources(spark):
    assert rows(S.identity(spark, 2)) == [[1, 0], [0, 1]]
    assert rows(S.identity(spark, (3,))) == [1, 0, 0]
    assert rows(S.iota(spark, (2, 3), axis=1)) == [[0, 1, 2], [0, 1, 2]]
    assert rows(S.linear_space(spark, 0, 1, 5)) == [0, 0.25, 0.5, 0.75, 1]
    one, two = (S.random(spark, (50,), seed=3, distribution="normal") for _ in range(2))
    assert rows(one) == rows(two)
    assert {v for v in rows(S.random(spark, (60,), 1, "integer", 2, 4))} == {2, 3, 4}
    assert [tuple(r) for r in grid(spark, (2, 2)).collect()] == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert S.constant(spark, 2, ()).coeff() == 2


def test_parquet_and_format(spark, tmp_path, sparse):
    t = sparse(M)
    S.write_parquet(t, str(tmp_path / "m"))
    back = S.read_parquet(spark, str(tmp_path / "m"), t.shape)
    assert A.equals(t, back)
    assert back.format() == "[1, 0, 2;0, 3, 0;4, 0, 5]"
    assert not A.equals(t, sparse(N))
    assert [tuple(r) for r in S.compressed(t).orderBy("outer").collect()][0] == (0, [0, 2], [1.0, 2.0])


def test_chain(vals, spark):
    assert chain_order((10, 100, 5, 50)) == ((0, 1), 2)
    assert chain_order((5, 50, 10, 100)) == ((0, 1), 2)
    assert chain_order((50, 5, 100, 10)) == (0, (1, 2))
    a, b = vals([[1, 2], [3, 4]]), vals([[0, 1], [1, 0]])
    assert rows(chain(a, b, vals([[1], [1]]))) == [[3], [7]]
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],), (None,)], "e array<double>")
    assert rows(gram_packed(df, "e", 2)) == [[10, 14], [14, 20]]


def test_shapes(spark, vals):
    with pytest.raises(ValueError):
        A.combine("add", vals([1, 2]), vals([1, 2, 3]))
    with pytest.raises(ValueError):
        X.repeat_left(vals([1])).densify().size  # noqa: B018
    with pytest.raises(ValueError):
        Tensor(vals([1]).df, (1,), kind="other")


def test_operators(vals):
    a, b = vals([1, 2, 3]).as_kind("array"), vals([4, 5, 6]).as_kind("array")
    assert rows(a + b) == [5, 7, 9]
    assert rows(10 - a) == [9, 8, 7]
    assert rows(a * b) == [4, 10, 18]
    assert rows(b / a % 2) == [0, 0.5, 0]
    assert rows(2 * a >= b) == [False, False, True]
    m = vals([[1, 2], [3, 4]])
    assert rows(m * m.T) == rows(m @ m.T) == [[5, 11], [11, 25]]
    assert rows(-m) == [[-1, -2], [-3, -4]]
    f = vals([1, 2]).as_kind("form")
    assert rows(f * vals([3, 4])) == [11]
    assert rows(f ^ vals([3, 5]).as_kind("form")) == [[0, -1], [1, 0]]
    i, j = vals([0, 1, 0, 0]).as_kind("quaternion"), vals([0, 0, 1, 0]).as_kind("quaternion")
    assert rows(i * j) == [0, 0, 0, 1]
    assert rows(j * i) == [0, 0, 0, -1]
    assert rows(i * i) == [-1, 0, 0, 0]
    with pytest.raises(TypeError):
        vals([1, 2]) * vals([1, 2])
    with pytest.raises(TypeError):
        m / m


def test_numpy_fill_resize(vals, spark):
    m = vals([[1, 2], [3, 4]])
    assert S.to_numpy(m).tolist() == [[1, 2], [3, 4]]
    assert rows(S.from_numpy(spark, S.to_numpy(m))) == rows(m)
    with pytest.raises(ValueError):
        S.to_numpy(m, most=3)
    assert rows(X.fill(m, 7)) == [[7, 7], [7, 7]]
    assert rows(X.fill(m, 0)) == [[0, 0], [0, 0]]
    assert rows(X.resize(m, 1, 3)) == [[1, 2, 0]]
    assert rows(X.slice_(m, vals([1, 0, 1]), 0)) == [3, 1, 3]
    assert [tuple(r) for r in S.to_packed(m).orderBy("i0").collect()] == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]


def test_search_and_product_take_all_rows(spark, tmp_path):
    from tensorloom.catalog import queries

    rng = np.random.default_rng(5)
    x = rng.normal(size=(1201, 64))
    spark.createDataFrame([(k, 0, e.tolist()) for k, e in enumerate(x)], "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    values = rng.uniform(0, 500, 1201)
    spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    x = x.astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    c = x[::50] @ x.T
    got = {(r.q, r.vec_id): r.v for r in queries()["cosine_search"](spark, str(tmp_path)).collect()}
    assert set(got) == {(50 * i, j) for i, j in zip(*np.nonzero(c >= 0.2), strict=True)}
    assert {q for q, _ in got} == set(range(0, 1201, 50))
    assert all(abs(v - c[q // 50, j]) < 1e-6 for (q, j), v in got.items())
    assert queries()["product"](spark, str(tmp_path)).first()["v"] == pytest.approx(np.prod(1 + values / (100 * len(values))), rel=1e-8)
