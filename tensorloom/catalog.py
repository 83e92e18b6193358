"""Registered queries of the tensor operators and their SQL.

Matrices: L holds quantities by (supplier, part), E the embeddings by (vector, component), A
and B a price and a size per part, V the values of events. Index columns are i0, i1, ..; sums are
rounded on both sides, as their order is free.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sources as S
from .core import Tensor, grid
from .functions import ieee, packed
from .functions import quaternion as Q
from .operators import arithmetic as A
from .operators import dense as D
from .operators import geometry as G
from .operators import indexing as X
from .operators import iterative as I
from .operators import products as P
from .operators import reductions as R
from .operators import sparse_direct as SD
from .plans import chain, cosine_search, gram_packed
from .streaming import live_compress, to_memory

WIDTH = 64
_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None):
    def put(fn):
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return put


class Data:
    """The tables of a folder as tensors. Shapes come from row counts: keys run from 0."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def n(self, name: str) -> int:
        return self.table(name).count()

    def quantities(self, where: str = "true") -> Tensor:
        rows = self.table("lineitem").where(where)
        return S.from_rows(rows, ["l_suppkey", "l_partkey"], "l_quantity", (self.n("supplier"), self.n("part")))

    def embeddings(self) -> Tensor:
        return S.from_packed(self.table("embeddings"), "vec_id", "embedding", self.n("embeddings"), WIDTH)

    def packed(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))

    def vector(self, table: str, key: str, value: str) -> Tensor:
        return Tensor(self.table(table).select(F.col(key).alias("i0"), F.col(value).cast("double").alias("v")), (self.n(table),))

    def price(self) -> Tensor:
        return self.vector("part", "p_partkey", "p_retailprice")

    def part_size(self) -> Tensor:
        return self.vector("part", "p_partkey", "p_size")

    def events(self) -> Tensor:
        return self.vector("events", "event_id", "value")

    def centroids(self) -> Tensor:
        """Mean embedding of each label: labels by components."""
        rows = self.embeddings().df.join(self.table("embeddings").select(F.col("vec_id").alias("i0"), F.col("label").cast("long").alias("l")), "i0")
        return Tensor(rows.groupBy(F.col("l").alias("i0"), "i1").agg(F.avg("v").alias("v")), (10, WIDTH))

    def systems(self) -> DataFrame:
        """Packed symmetric matrices of 4 rows, one per label: 5 I + sums of products of components."""
        e = lambda k: F.element_at("e", k + 1)
        sums = [(F.sum(e(p) * e(q)) + (5.0 if p == q else 0.0)) for p in range(4) for q in range(4)]
        return self.packed().groupBy(F.col("label").cast("long").alias("label")).agg(F.array(*sums).alias("a")).withColumns({"nrow": F.lit(4), "ncol": F.lit(4)})

    def tall(self) -> DataFrame:
        """Packed matrices of 6 rows and 3 columns, one per label: sums of component products."""
        e = lambda k: F.element_at("e", k + 1)
        sums = [F.sum(e(p) * e(q + 6)) + (2.0 if p == q else 0.0) for p in range(6) for q in range(3)]
        return self.packed().groupBy(F.col("label").cast("long").alias("label")).agg(F.array(*sums).alias("a")).withColumns({"nrow": F.lit(6), "ncol": F.lit(3)})


def rounded(t: Tensor | DataFrame, digits: int = 6, *columns: str) -> DataFrame:
    df = t.df if isinstance(t, Tensor) else t
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns or ("v",)})


def query(name: str, sql: str | None):
    """Register a function of Data."""

    def put(fn):
        register(name, sql)(lambda spark, sf_dir: fn(Data(spark, sf_dir)))
        return fn

    return put


_L = "L AS (SELECT l_suppkey AS i0, l_partkey AS i1, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
_LA = "LA AS (SELECT l_suppkey AS i0, l_partkey AS i1, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2)"
_LR = "LR AS (SELECT l_suppkey AS i0, l_partkey AS i1, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)"
_E = "E AS (SELECT vec_id AS i0, CAST(g.p AS BIGINT) AS i1, CAST(embedding[g.p + 1] AS DOUBLE) AS v FROM embeddings, range(64) g(p))"
_A = "A AS (SELECT p_partkey AS i0, p_retailprice AS v FROM part)"
_B = "B AS (SELECT p_partkey AS i0, CAST(p_size AS DOUBLE) AS v FROM part)"
_V = "V AS (SELECT event_id AS i0, value AS v FROM events)"
_C = f"{_E}, C AS (SELECT CAST(label AS BIGINT) AS i0, i1, avg(E.v) AS v FROM E JOIN embeddings ON vec_id = i0 GROUP BY 1, 2)"
_G = f"{_E}, G AS (SELECT a.i1 AS i0, b.i1 AS i1, sum(a.v * b.v) AS v FROM E a JOIN E b ON a.i0 = b.i0 GROUP BY 1, 2)"
_X = "X AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"
_M = f"{_X}, M AS (SELECT CAST(label AS BIGINT) AS label, p.p AS i0, q.q AS i1, sum(e[p.p + 1] * e[q.q + 1]) + CASE WHEN p.p = q.q THEN 5 ELSE 0 END AS v FROM X, range(4) p(p), range(4) q(q) GROUP BY 1, 2, 3)"
_T = f"{_X}, T AS (SELECT CAST(label AS BIGINT) AS label, p.p AS i0, q.q AS i1, sum(e[p.p + 1] * e[q.q + 7]) + CASE WHEN p.p = q.q THEN 2 ELSE 0 END AS v FROM X, range(6) p(p), range(3) q(q) GROUP BY 1, 2, 3)"

# ---------------------------------------------------------------- sources and storage


@query("coo_compress", f"WITH {_L} SELECT * FROM L")
def _(d):
    return d.quantities().df


@query("coeff_lookup", f"WITH {_L}, K AS (SELECT range AS i0, range * 7 % 100 AS k1 FROM range(20)) SELECT K.i0, coalesce(L.v, 0) AS v FROM K LEFT JOIN L ON L.i0 = K.i0 % 10 AND L.i1 = K.k1")
def _(d):
    places = d.spark.range(20).select(F.col("id").alias("k"), (F.col("id") % 10).alias("i0"), (F.col("id") * 7 % 100).alias("i1"))
    return X.coefficients(d.quantities(), places).df


@query("identity", "SELECT range AS i0, range AS i1, CAST(1 AS DOUBLE) AS v FROM range(12)")
def _(d):
    return S.identity(d.spark, (12, 20)).df


@query("unit_vector", "SELECT CAST(3 AS BIGINT) AS i0, CAST(1 AS DOUBLE) AS v")
def _(d):
    return S.unit(d.spark, 8, 3).df


@query("constant", "SELECT a.range AS i0, b.range AS i1, CAST(2.5 AS DOUBLE) AS v FROM range(6) a, range(5) b")
def _(d):
    return S.constant(d.spark, 2.5, (6, 5)).df


@query("ones_plus_zeros", "SELECT a.range AS i0, b.range AS i1, CAST(1 AS DOUBLE) AS v FROM range(6) a, range(5) b")
def _(d):
    return A.combine("add", S.ones(d.spark, (6, 5)), S.zeros(d.spark, (6, 5))).df


@query("iota", "SELECT a.range AS i0, b.range AS i1, CAST(b.range + 3 AS DOUBLE) AS v FROM range(6) a, range(5) b")
def _(d):
    return S.iota(d.spark, (6, 5), axis=1, start=3).df


@query("linear_space", "SELECT range AS i0, round(2 + range * (9.0 - 2) / 49, 9) AS v FROM range(50)")
def _(d):
    return rounded(S.linear_space(d.spark, 2, 9, 50), 9)


def _spread_of(t: Tensor) -> DataFrame:
    """What is known of random values: how many, how many differ, and rounded moments."""
    return t.df.agg(F.count("*").alias("n"), F.count_distinct("v").alias("different"), F.round(F.avg("v"), 1).alias("mean"), F.round(F.stddev_pop("v"), 1).alias("deviation"), F.bool_and(F.col("v") >= 2).alias("low"), F.bool_and(F.col("v") < 5).alias("high"))


_MOMENTS = "SELECT CAST({n} AS BIGINT) AS n, CAST({d} AS BIGINT) AS different, CAST({m} AS DOUBLE) AS mean, CAST({s} AS DOUBLE) AS deviation, {low} AS low, {high} AS high"
query("random_uniform", _MOMENTS.format(n=200_000, d=200_000, m=3.5, s=0.9, low="true", high="true"))(lambda d: _spread_of(S.random(d.spark, (400, 500), seed=5, low=2, high=5)))
query("random_normal", _MOMENTS.format(n=200_000, d=200_000, m=2.0, s=3.0, low="false", high="false"))(lambda d: _spread_of(S.random(d.spark, (200_000,), seed=5, distribution="normal", low=2, high=3)))
query("random_integer", _MOMENTS.format(n=200_000, d=3, m=3.0, s=0.8, low="true", high="true"))(lambda d: _spread_of(S.random(d.spark, (200_000,), seed=5, distribution="integer", low=2, high=4)))


@query("random_source", "SELECT count(*) AS n, true AS alike, true AS inside FROM events")
def _(d):
    """An unbounded source: the same values by row, however the rows are dealt."""
    here = d.table("events").select("event_id", S.random_column(3, by=["event_id"]).alias("a"))
    there = d.table("events").repartition(7, "user_id").select("event_id", S.random_column(3, by=["event_id"]).alias("b"))
    return here.join(there, "event_id").agg(F.count("*").alias("n"), F.bool_and(F.col("a") == F.col("b")).alias("alike"), F.bool_and((F.col("a") >= 0) & (F.col("a") < 1)).alias("inside"))


for _layout, _outer, _inner in (("rows", "i0", "i1"), ("columns", "i1", "i0")):
    query(f"compressed_{_layout}", f"WITH {_L} SELECT {_outer} AS outer_i, list({_inner} ORDER BY {_inner}) AS indices, list(v ORDER BY {_inner}) AS vals FROM L GROUP BY 1")(
        lambda d, x=_layout: S.compressed(d.quantities(), x[:-1]).select(F.col("outer").alias("outer_i"), "indices", F.col("values").alias("vals"))
    )


@query("from_values", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(1.5 AS DOUBLE)), (0, 1, -2), (1, 0, 0), (1, 1, 4)) t(i0, i1, v)")
def _(d):
    return S.from_values(d.spark, [[1.5, -2], [0, 4]]).df


@query("to_local", f"WITH {_A} SELECT i0 AS n, v FROM A WHERE i0 < 20")
def _(d):
    return d.spark.createDataFrame([(n, r["v"]) for n, r in enumerate(S.to_local(X.head(d.price(), 20)))], "n long, v double")


@query("format", f"WITH {_B} SELECT '[' || string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ', ' ORDER BY i0) || ']' AS s FROM B WHERE i0 < 12")
def _(d):
    return d.spark.createDataFrame([(X.head(d.part_size(), 12).format(),)], "s string")


@query("live_compress", "SELECT l_suppkey AS i0, round(sum(l_quantity), 6) AS v FROM lineitem GROUP BY 1")
def _(d):
    """The table read as a stream, to its end."""
    path = f"{d.dir}/lineitem.parquet"
    stream = d.spark.readStream.schema(d.table("lineitem").schema).parquet(path if path.endswith("/") else path[:-1] + "[t]")
    name = f"live_{uuid.uuid4().hex[:12]}"
    to_memory(live_compress(stream, ["l_suppkey"], "l_quantity"), name).awaitTermination()
    return rounded(d.spark.table(name))


# ---------------------------------------------------------------- index space


@query("transpose", f"WITH {_L} SELECT i1 AS i0, i0 AS i1, v FROM L")
def _(d):
    return X.transpose(d.quantities()).df


@query("extract_diagonal", f"WITH {_L} SELECT s.range AS i0, coalesce(L.v, 0) AS v FROM (SELECT range FROM range((SELECT count(*) FROM supplier))) s LEFT JOIN L ON L.i0 = s.range AND L.i1 = s.range")
def _(d):
    return X.diagonal(d.quantities()).densify().df


@query("from_diagonal", f"WITH {_A} SELECT i0, i0 AS i1, v FROM A")
def _(d):
    return S.from_diagonal(d.price()).df


@query("slice_strided", f"WITH {_E} SELECT (i0 - 10) // 3 AS i0, (i1 - 4) // 2 AS i1, v FROM E WHERE i0 >= 10 AND i0 < 100 AND (i0 - 10) % 3 = 0 AND i1 >= 4 AND i1 < 44 AND (i1 - 4) % 2 = 0")
def _(d):
    return X.slice_(d.embeddings(), X.strided(10, 90, 3), X.strided(4, 40, 2)).df


@query("gather_rows", f"WITH {_E}, K AS (SELECT * FROM (VALUES (0, 7), (1, 3), (2, 7), (3, 0)) k(n, o)) SELECT CAST(n AS BIGINT) AS i0, i1, v FROM K JOIN E ON E.i0 = o")
def _(d):
    return X.slice_(d.embeddings(), [7, 3, 7, 0], slice(None)).df


@query("gather_by_tensor", f"WITH {_E}, {_B} SELECT B.i0, E.i1, E.v FROM B JOIN E ON E.i0 = CAST(B.v AS BIGINT)")
def _(d):
    return X.slice_(d.embeddings(), d.part_size(), slice(None)).df


@query("resize", f"WITH {_E} SELECT * FROM E WHERE i0 < 30 AND i1 < 7")
def _(d):
    return X.resize(d.embeddings(), 30, 7).df


@query("dense_solve", f"WITH {_G}, n AS (SELECT i0 FROM G WHERE i0 = i1) SELECT i0, CAST(i0 + 1 AS DOUBLE) AS v FROM n, range(2)")
def _(d):
    """The Gram matrix, solved by two direct solvers for a right side that is made of it and counts from 1."""
    g = A.combine("add", gram_packed(d.table("embeddings"), "embedding", WIDTH), S.identity(d.spark, WIDTH))
    b = P.matmul(g, S.iota(d.spark, WIDTH, start=1))
    return rounded(D.solve(g, b, "llt").df.unionByName(D.solve(g, b).df))


@query("row", f"WITH {_E} SELECT i1 AS i0, v FROM E WHERE i0 = 5")
def _(d):
    return X.row(d.embeddings(), 5).df


@query("col", f"WITH {_E} SELECT i0, v FROM E WHERE i1 = 5")
def _(d):
    return X.col(d.embeddings(), 5).df


@query("top_rows", f"WITH {_E} SELECT * FROM E WHERE i0 < 20")
def _(d):
    return X.top_rows(d.embeddings(), 20).df


@query("bottom_rows", f"WITH {_E}, n AS (SELECT count(*) AS n FROM embeddings) SELECT i0 - (n - 20) AS i0, i1, v FROM E, n WHERE i0 >= n - 20")
def _(d):
    return X.bottom_rows(d.embeddings(), 20).df


@query("left_cols", f"WITH {_E} SELECT * FROM E WHERE i1 < 9")
def _(d):
    return X.left_cols(d.embeddings(), 9).df


@query("right_cols", f"WITH {_E} SELECT i0, i1 - 55 AS i1, v FROM E WHERE i1 >= 55")
def _(d):
    return X.right_cols(d.embeddings(), 9).df


@query("segment", f"WITH {_A} SELECT i0 - 5 AS i0, v FROM A WHERE i0 >= 5 AND i0 < 25")
def _(d):
    return X.segment(d.price(), 5, 20).df


@query("packed_head_tail", f"WITH {_X} SELECT vec_id, e[1:3] AS h, e[62:64] AS t FROM X")
def _(d):
    return d.packed().select("vec_id", packed.head(F.col("e"), 3).alias("h"), packed.tail(F.col("e"), 3).alias("t"))


@query("reshape", f"WITH {_E} SELECT i0, i1 // 8 AS i1, i1 % 8 AS i2, v FROM E")
def _(d):
    t = d.embeddings()
    return X.reshape(t, t.shape[0], 8, 8).df


@query("swizzle3", f"WITH {_E} SELECT i1 % 8 AS i0, CAST(0 AS BIGINT) AS i1, i0 AS i2, i1 // 8 AS i3, v FROM E")
def _(d):
    t = d.embeddings()
    return X.swizzle(X.reshape(t, t.shape[0], 8, 8), 2, None, 0, 1).df


@query("homogeneous_position", f"WITH {_A} SELECT * FROM A UNION ALL SELECT count(*), 1.0 FROM part")
def _(d):
    return X.homogeneous(d.price(), "position").df


@query("homogeneous_vector", f"WITH {_A} SELECT * FROM A UNION ALL SELECT count(*), 0.0 FROM part")
def _(d):
    return X.homogeneous(d.price(), "vector").df


@query("homogeneous_affine", f"WITH {_C} SELECT * FROM (SELECT i0, i1, round(v, 9) + 0.0 AS v FROM C UNION ALL SELECT 10, 63, 1.0)")
def _(d):
    return rounded(X.homogeneous(d.centroids(), "affine"), 9)


@query("diagonal_embed", f"WITH {_A} SELECT i0, i0 AS i1, v FROM A")
def _(d):
    return X.diagonal_embed(d.price()).df


@query("lift", f"WITH {_E} SELECT E.i0, E.i1, round(E.v + label, 9) + 0.0 AS v FROM E JOIN embeddings ON vec_id = i0")
def _(d):
    return rounded(A.combine("add", d.embeddings(), X.lift(d.vector("embeddings", "vec_id", "label"))), 9)


@query("fill", "SELECT a.range AS i0, b.range AS i1, CAST(2.5 AS DOUBLE) AS v FROM range((SELECT count(*) FROM embeddings)) a, range(64) b")
def _(d):
    return X.fill(d.embeddings(), 2.5).df


@query("with_coeff", f"WITH {_A} SELECT i0, CASE WHEN i0 = 3 THEN CAST(-1 AS DOUBLE) ELSE v END AS v FROM A")
def _(d):
    return d.price().as_extents(None).with_coeff(-1.0, 3).df


@query("nnz_by_row", f"WITH {_L} SELECT i0, CAST(count(*) AS DOUBLE) AS v FROM L GROUP BY 1")
def _(d):
    return d.quantities().nnz_by(0).df


@query("nnz", f"WITH {_L} SELECT count(*) AS n FROM L")
def _(d):
    return d.spark.createDataFrame([(d.quantities().nnz(),)], "n long")


@query("repeat_broadcast", f"WITH {_E}, {_A} SELECT E.i0, E.i1, E.v + A.v AS v FROM E JOIN A ON A.i0 = E.i1")
def _(d):
    return A.combine("add", d.embeddings(), X.repeat_left(X.head(d.price(), WIDTH))).df


@query("with_slice", f"WITH {_E} SELECT i0, i1, CASE WHEN i0 >= 2 AND i0 < 6 AND i1 >= 3 AND i1 < 5 THEN CAST(7 AS DOUBLE) ELSE v END AS v FROM E")
def _(d):
    return X.with_slice(d.embeddings(), S.constant(d.spark, 7, (4, 2)), 2, 3).df


@query("cast", f"WITH {_V} SELECT i0, CAST(trunc(v) AS BIGINT) AS v FROM V")
def _(d):
    return d.events().cast("long").df


for _mode, _where in {"lower": "i0 >= i1", "upper": "i0 <= i1", "strictly_lower": "i0 > i1", "strictly_upper": "i0 < i1", "off_diagonal": "i0 <> i1"}.items():
    query(f"triangular_{_mode}", f"WITH {_G} SELECT i0, i1, round(v, 6) + 0.0 AS v FROM G WHERE {_where}")(lambda d, m=_mode: rounded(A.triangular(P.gram(d.embeddings()), m)))
query("triangular_unit_upper", f"WITH {_G} SELECT i0, i1, CASE WHEN i0 = i1 THEN 1.0 ELSE round(v, 6) + 0.0 END AS v FROM G WHERE i0 <= i1")(lambda d: rounded(A.triangular(P.gram(d.embeddings()), "unit_upper")))
query("triangular_unit_lower", f"WITH {_G} SELECT i0, i1, CASE WHEN i0 = i1 THEN 1.0 ELSE round(v, 6) + 0.0 END AS v FROM G WHERE i0 >= i1")(lambda d: rounded(A.triangular(P.gram(d.embeddings()), "unit_lower")))

# ---------------------------------------------------------------- coefficient-wise

_AB = f"WITH {_A}, {_B}"
for _op, _expr in {"add": "A.v + B.v", "sub": "A.v - B.v", "mul": "A.v * B.v", "div": "A.v / B.v", "mod": "A.v % B.v", "min": "least(A.v, B.v * 30)", "max": "greatest(A.v, B.v * 30)"}.items():
    _times = 30.0 if _op in ("min", "max") else 1.0
    query(f"ew_{_op}", f"{_AB} SELECT A.i0, round({_expr}, 6) + 0.0 AS v FROM A JOIN B ON A.i0 = B.i0")(lambda d, o=_op, k=_times: rounded(A.combine(o, d.price(), A.combine("mul", d.part_size(), k))))
for _op, _expr in {"add": "v + 1.5", "sub": "1.5 - v", "mul": "v * 1.5", "div": "v / 1.5", "mod": "v % 7"}.items():
    _left, _right = {"sub": (1.5, None), "mod": (None, 7.0)}.get(_op, (None, 1.5))
    query(f"scalar_{_op}", f"WITH {_A} SELECT i0, round({_expr}, 6) + 0.0 AS v FROM A")(lambda d, o=_op, x=_left, y=_right: rounded(A.combine(o, d.price() if x is None else x, d.price() if y is None else y)))
for _op, _sign in {"and": "&", "or": "|"}.items():
    query(f"bit_{_op}", f"{_AB} SELECT A.i0, CAST(floor(A.v) AS BIGINT) {_sign} CAST(B.v AS BIGINT) AS v FROM A JOIN B ON A.i0 = B.i0")(lambda d, o=_op: A.combine(o, A.math(d.price(), "floor"), d.part_size()).df)
query("bit_xor", f"{_AB} SELECT A.i0, xor(CAST(floor(A.v) AS BIGINT), CAST(B.v AS BIGINT)) AS v FROM A JOIN B ON A.i0 = B.i0")(lambda d: A.combine("xor", A.math(d.price(), "floor"), d.part_size()).df)
query("bit_not", f"WITH {_B} SELECT i0, ~CAST(v AS BIGINT) AS v FROM B")(lambda d: A.bit_not(d.part_size()).df)
for _op, _sign in {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items():
    query(f"cmp_{_op}", f"WITH {_B} SELECT i0, v {_sign} 25 AS v FROM B")(lambda d, o=_op: A.combine(o, d.part_size(), 25.0).df)
query("spaceship", f"WITH {_B} SELECT i0, CAST(CASE WHEN v < 25 THEN -1 WHEN v = 25 THEN 0 ELSE 1 END AS TINYINT) AS v FROM B")(lambda d: A.combine("spaceship", d.part_size(), 25.0).df)
query("negate", f"WITH {_A} SELECT i0, -v AS v FROM A")(lambda d: A.negate(d.price()).df)
query("select_mask", f"{_AB} SELECT A.i0, CASE WHEN B.v > 25 THEN A.v ELSE B.v END AS v FROM A JOIN B ON A.i0 = B.i0")(lambda d: A.select(A.combine("gt", d.part_size(), 25.0), d.price(), d.part_size()).df)
query("select_order", f"{_AB} SELECT A.i0, CASE WHEN B.v < 25 THEN A.v WHEN B.v = 25 THEN 0 ELSE -A.v END AS v FROM A JOIN B ON A.i0 = B.i0")(
    lambda d: A.select_order(A.combine("spaceship", d.part_size(), 25.0), d.price(), A.combine("mul", d.price(), 0.0), A.negate(d.price())).df
)
query("logical_not", f"WITH {_B} SELECT i0, NOT (v > 25) AS v FROM B")(lambda d: A.logical_not(A.combine("gt", d.part_size(), 25.0)).df)
query("ieee_division", f"WITH {_B} SELECT i0, CASE WHEN v = 25 THEN 'Infinity' ELSE 'finite' END AS v FROM B")(
    lambda d: A.combine("div", 1.0, A.combine("sub", d.part_size(), 25.0)).df.select("i0", F.when(F.abs("v") == float("inf"), "Infinity").otherwise("finite").alias("v"))
)

for _op, _sign in {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items():
    query(f"cmp_arrays_{_op}", f"{_AB} SELECT A.i0, floor(A.v / 40) {_sign} B.v AS v FROM A JOIN B ON A.i0 = B.i0")(lambda d, o=_op: A.combine(o, A.math(A.combine("div", d.price(), 40.0), "floor"), d.part_size()).df)
_MASKS = lambda d: (A.combine("gt", d.part_size(), 25.0), A.combine("lt", d.price(), 950.0))
for _op, _expr in {"eq": "a = b", "ne": "a <> b", "logical_and": "a AND b", "logical_or": "a OR b"}.items():
    query(f"mask_{_op}", f"{_AB} SELECT i0, {_expr} AS v FROM (SELECT A.i0, B.v > 25 AS a, A.v < 950 AS b FROM A JOIN B ON A.i0 = B.i0)")(lambda d, o=_op: A.combine(o, *_MASKS(d)).df)


@query("equals", f"WITH {_L}, {_LA} SELECT true AS same, (SELECT sum(v) FROM L) = (SELECT sum(v) FROM LA) AS other, true AS masks")
def _(d):
    a = d.quantities()
    found = (A.equals(a, X.transpose(X.transpose(a))), A.equals(a, d.quantities("l_returnflag = 'A'")), A.equals(m := _MASKS(d)[0], A.logical_not(A.logical_not(m))))
    return d.spark.createDataFrame([tuple(map(bool, found))], "same boolean, other boolean, masks boolean")


#: Of values by place: not a number, infinite, too large for whole numbers, a value, and the same with another sign.
_ODD = "CASE i0 % 5 WHEN 0 THEN 'NaN' WHEN 1 THEN 'inf' WHEN 2 THEN 'large' ELSE 'fine' END"


def _told(t: Tensor) -> DataFrame:
    """Kind of each value, and the value where it is neither odd nor large."""
    v = F.col("v")
    kind = F.when(F.isnan(v), "NaN").when(F.abs(v) == float("inf"), "inf").when(F.abs(v) >= 1e200, "large").otherwise("fine")
    return t.df.select("i0", kind.alias("kind"), F.when(kind == "fine", F.round(v, 6) + F.lit(0.0)).otherwise(F.lit(0.0)).alias("v"))


def _odd_values(d: Data) -> Tensor:
    k = F.col("i0") % 5
    t = d.events()
    return t.with_(t.df.select("i0", F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 2, F.lit(-1e300)).when(k == 3, F.col("v")).otherwise(-F.col("v")).alias("v")))


for _name, _fn in {"floor": "floor", "ceil": "ceil", "round": "round"}.items():
    query(f"ieee_{_name}", f"WITH {_V} SELECT i0, {_ODD} AS kind, CASE i0 % 5 WHEN 3 THEN {_fn}(v) WHEN 4 THEN {_fn}(-v) ELSE 0 END + 0.0 AS v FROM V")(lambda d, n=_name: _told(A.math(_odd_values(d), n)))
query("ieee_mod", f"{_AB} SELECT A.i0, CASE WHEN B.v = 25 THEN 'NaN' ELSE 'fine' END AS kind, CASE WHEN B.v = 25 THEN 0 ELSE round(-A.v % (B.v - 25), 6) + 0.0 END AS v FROM A JOIN B ON A.i0 = B.i0")(
    lambda d: _told(A.combine("mod", A.negate(d.price()), A.combine("sub", d.part_size(), 25.0)))
)

_UNIT = {"sqrt", "cbrt", "log", "log2", "log10", "floor", "ceil", "round", "sign", "abs", "negate"}
_FN = {"exp2": "pow(2, {x})", "log": "ln({x})", "ceil": "ceil({x})", "negate": "-{x}", "round": "round({x})", "sign": "CAST(sign({x}) AS DOUBLE)"}
for _name in ieee.MATH:
    _x = "v" if _name in _UNIT else "(v / 500)"
    _body = _FN.get(_name, f"{_name}({{x}})").format(x=_x)
    query(f"math_{_name}", f"WITH {_V} SELECT i0, round({_body}, 9) + 0.0 AS v FROM V")(lambda d, n=_name, u=_name in _UNIT: rounded(A.math(d.events() if u else A.combine("div", d.events(), 500.0), n), 9))
query("math_pow", f"WITH {_V} SELECT i0, round(pow(v / 500, 2.5), 7) AS v FROM V")(lambda d: rounded(A.power(A.combine("div", d.events(), 500.0), 2.5), 7))
query("unary_expr", f"WITH {_V} SELECT i0, round(v * v + 1, 6) AS v FROM V")(lambda d: rounded(A.unary_expr(d.events(), lambda v: v * v + 1)))
query("angles", f"WITH {_V} SELECT i0, round(radians(v), 9) AS r, round(degrees(v), 6) AS g FROM V")(lambda d: d.events().df.select("i0", F.round(F.radians("v"), 9).alias("r"), F.round(F.degrees("v"), 6).alias("g")))

# ---------------------------------------------------------------- products

query("spmv", f"WITH {_L}, {_A} SELECT L.i0, round(sum(L.v * A.v), 3) AS v FROM L JOIN A ON L.i1 = A.i0 GROUP BY 1")(lambda d: rounded(P.matmul(d.quantities(), d.price()), 3))
query("spmv_norm", f"WITH {_L}, {_A}, Y AS (SELECT sum(L.v * A.v) AS v FROM L JOIN A ON L.i1 = A.i0 GROUP BY L.i0) SELECT round(sqrt(sum(v * v)), 1) AS v FROM Y")(lambda d: rounded(R.norm(P.matmul(d.quantities(), d.price())), 1))
query("matmul", f"WITH {_L} SELECT a.i0, b.i0 AS i1, sum(a.v * b.v) AS v FROM L a JOIN L b ON a.i1 = b.i1 GROUP BY 1, 2 HAVING sum(a.v * b.v) <> 0")(lambda d: P.matmul(m := d.quantities(), X.transpose(m)).df)
query("matmul_gram", f"WITH {_G} SELECT i0, i1, round(v, 6) + 0.0 AS v FROM G")(lambda d: rounded(P.gram(d.embeddings())))
query("gram_packed", f"WITH {_G} SELECT i0, i1, round(v, 6) + 0.0 AS v FROM G")(lambda d: rounded(gram_packed(d.table("embeddings"), "embedding", WIDTH)))
query("matmul_chain", f"WITH {_L}, {_LA}, Y AS (SELECT LA.i0, sum(LA.v * A.p_retailprice) AS v FROM LA JOIN part A ON LA.i1 = p_partkey GROUP BY 1), W AS (SELECT L.i1 AS i0, sum(L.v * Y.v) AS v FROM L JOIN Y ON L.i0 = Y.i0 GROUP BY 1) SELECT i0, CAST(0 AS BIGINT) AS i1, round(v, 2) AS v FROM W")(
    lambda d: rounded(chain(X.transpose(d.quantities()), d.quantities("l_returnflag = 'A'"), X.anti_slice(d.price(), 1)), 2)
)
query("sparse_add", f"WITH {_LA}, {_LR} SELECT i0, i1, sum(v) AS v FROM (SELECT * FROM LA UNION ALL SELECT * FROM LR) GROUP BY 1, 2 HAVING sum(v) <> 0")(lambda d: A.combine("add", d.quantities("l_returnflag = 'A'"), d.quantities("l_returnflag = 'R'")).prune().df)
query("sparse_sub", f"WITH {_LA}, {_LR} SELECT i0, i1, sum(v) AS v FROM (SELECT * FROM LA UNION ALL SELECT i0, i1, -v FROM LR) GROUP BY 1, 2 HAVING sum(v) <> 0")(lambda d: A.combine("sub", d.quantities("l_returnflag = 'A'"), d.quantities("l_returnflag = 'R'")).prune().df)
query("sparse_hadamard", f"WITH {_LA}, {_LR} SELECT LA.i0, LA.i1, LA.v * LR.v AS v FROM LA JOIN LR ON LA.i0 = LR.i0 AND LA.i1 = LR.i1")(lambda d: A.combine("mul", d.quantities("l_returnflag = 'A'"), d.quantities("l_returnflag = 'R'")).df)
_BOTH = "FROM LA FULL JOIN LR ON LA.i0 = LR.i0 AND LA.i1 = LR.i1"
_PARTS = lambda d: (d.quantities("l_returnflag = 'A'"), d.quantities("l_returnflag = 'R'"))
for _op, _expr in {"min": "least(coalesce(LA.v, 0), coalesce(LR.v, 0))", "max": "greatest(coalesce(LA.v, 0), coalesce(LR.v, 0))", "gt": "coalesce(LA.v, 0) > coalesce(LR.v, 0)", "ne": "coalesce(LA.v, 0) <> coalesce(LR.v, 0)"}.items():
    query(f"sparse_{_op}", f"WITH {_LA}, {_LR} SELECT coalesce(LA.i0, LR.i0) AS i0, coalesce(LA.i1, LR.i1) AS i1, {_expr} AS v {_BOTH}")(lambda d, o=_op: A.combine(o, *_PARTS(d)).df)
query("matmul_chunked", f"WITH {_L} SELECT a.i0, b.i0 AS i1, sum(a.v * b.v) AS v FROM L a JOIN L b ON a.i1 = b.i1 GROUP BY 1, 2 HAVING sum(a.v * b.v) <> 0")(lambda d: P.matmul(m := d.quantities(), X.transpose(m), chunk=16).df)
query("to_packed", f"WITH {_E} SELECT i0, list(v ORDER BY i1) AS vector FROM E GROUP BY 1")(lambda d: S.to_packed(d.embeddings()))
query("hamilton", f"WITH {_C}, p AS (SELECT i1 AS i, v FROM C WHERE i0 = 0 AND i1 < 4), q AS (SELECT i1 AS i, v FROM C WHERE i0 = 1 AND i1 < 4), u AS (SELECT p.i AS i, q.i AS j, p.v * q.v AS v FROM p, q) SELECT CAST(CASE WHEN i = 0 OR j = 0 THEN i + j WHEN i = j THEN 0 ELSE 6 - i - j END AS BIGINT) AS i0, round(sum(CASE WHEN i = 0 OR j = 0 THEN v WHEN i = j THEN -v WHEN (j - i + 3) % 3 = 1 THEN v ELSE -v END), 9) + 0.0 AS v FROM u GROUP BY 1")(
    lambda d: rounded(X.head(X.row(c := d.centroids(), 0), 4).as_kind("quaternion") * X.head(X.row(c, 1), 4).as_kind("quaternion"), 9)
)
query("dot", f"WITH {_A}, {_B} SELECT round(sum(A.v * B.v), 2) AS v FROM A JOIN B ON A.i0 = B.i0")(lambda d: rounded(P.dot(d.price(), d.part_size()), 2))
query("dot_pairs", f"WITH {_X} SELECT a.vec_id, round(list_dot_product(a.e, b.e), 9) + 0.0 AS v FROM X a JOIN X b ON b.vec_id = a.vec_id + 1")(
    lambda d: rounded(d.packed().alias("a").join(d.packed().alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1).select("a.vec_id", packed.dot(F.col("a.e"), F.col("b.e")).alias("v")), 9)
)
query("cross_packed", f"WITH {_X} SELECT vec_id, round(e[2] * e[6] - e[3] * e[5], 9) + 0.0 AS x, round(e[3] * e[4] - e[1] * e[6], 9) + 0.0 AS y, round(e[1] * e[5] - e[2] * e[4], 9) + 0.0 AS z FROM X")(
    lambda d: rounded(d.packed().select("vec_id", packed.cross(packed.segment(F.col("e"), 0, 3), packed.segment(F.col("e"), 3, 3)).alias("c")).select("vec_id", *(F.get("c", F.lit(k)).alias(n) for k, n in enumerate("xyz"))), 9, "x", "y", "z")
)
query("outer", f"WITH {_C} SELECT a.i1 AS i0, b.i1 AS i1, round(a.v * b.v, 9) + 0.0 AS v FROM C a, C b WHERE a.i0 = 0 AND b.i0 = 1")(lambda d: rounded(P.outer(X.row(c := d.centroids(), 0), X.row(c, 1)), 9))
query("form_vector", f"WITH {_C} SELECT round(sum(a.v * b.v), 9) + 0.0 AS v FROM C a JOIN C b ON a.i1 = b.i1 WHERE a.i0 = 0 AND b.i0 = 1")(lambda d: rounded(P.form_times(X.row(c := d.centroids(), 0).as_kind("form"), X.row(c, 1)), 9))
query("form_matrix", f"WITH {_C}, F AS (SELECT i0, v FROM C WHERE i1 = 0) SELECT C.i1 AS i0, round(sum(F.v * C.v), 9) + 0.0 AS v FROM F JOIN C ON F.i0 = C.i0 GROUP BY 1")(lambda d: rounded(P.form_times(X.col(c := d.centroids(), 0).as_kind("form"), c), 9))
query("form_tensor", f"WITH {_C}, F AS (SELECT i0, v FROM C WHERE i1 = 0) SELECT C.i1 // 8 AS i0, C.i1 % 8 AS i1, round(sum(F.v * C.v), 9) + 0.0 AS v FROM F JOIN C ON F.i0 = C.i0 GROUP BY 1, 2")(lambda d: rounded(P.form_times(X.col(c := d.centroids(), 0), X.reshape(c, 10, 8, 8)), 9))
query("wedge", f"WITH {_C}, a AS (SELECT i1 AS i, v FROM C WHERE i0 = 0), b AS (SELECT i1 AS i, v FROM C WHERE i0 = 1) SELECT p.i AS i0, q.i AS i1, round(p.v * bq.v - q.v * bp.v, 9) + 0.0 AS v FROM a p, a q, b bp, b bq WHERE bp.i = p.i AND bq.i = q.i")(lambda d: rounded(P.wedge(X.row(c := d.centroids(), 0), X.row(c, 1)), 9))
query("contract", f"WITH {_E} SELECT i0, round(sum(v), 9) + 0.0 AS v FROM E WHERE i1 // 8 = i1 % 8 GROUP BY 1")(lambda d: rounded(P.contract(X.reshape(t := d.embeddings(), t.shape[0], 8, 8), 1, 2), 9))
query("contract_three", f"WITH {_E} SELECT i0, round(sum(v), 9) + 0.0 AS v FROM E WHERE i1 // 16 = i1 // 4 % 4 AND i1 // 4 % 4 = i1 % 4 GROUP BY 1")(lambda d: rounded(P.contract(X.reshape(t := d.embeddings(), t.shape[0], 4, 4, 4), 1, 2, 3), 9))
query("full_contract", f"WITH {_C}, D AS (SELECT i0, v FROM C WHERE i1 = 0), H AS (SELECT i1 AS i0, v FROM C WHERE i0 = 0 AND i1 < 10) SELECT round(sum(D.v * H.v), 9) + 0.0 AS v FROM D JOIN H ON D.i0 = H.i0")(lambda d: rounded(P.full_contract(P.outer(X.col(c := d.centroids(), 0), X.head(X.row(c, 0), 10))), 9))
query("diagonal_pairing", f"WITH {_C} SELECT round(sum(v * v), 9) + 0.0 AS v FROM C WHERE i0 = i1")(lambda d: rounded(P.diagonal_pairing(c := X.left_cols(d.centroids(), 10), c), 9))
query("cosine_search", f"WITH {_X}, N AS (SELECT b.vec_id AS q, a.vec_id, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS c FROM X a, X b WHERE b.vec_id % 50 = 0) SELECT q, vec_id, round(c, 6) + 0.0 AS v FROM N WHERE c >= 0.2")(
    lambda d: rounded(cosine_search(d.packed(), "vec_id", "e", WIDTH, F.col("vec_id") % 50 == 0, 0.2))
)

# ---------------------------------------------------------------- reductions

query("sum", f"WITH {_V} SELECT round(sum(v), 3) AS v FROM V")(lambda d: rounded(R.total(d.events()), 3))
query("product", f"WITH {_V} SELECT round(product(1 + v / (100 * (SELECT count(*) FROM V))), 9) AS v FROM V")(lambda d: rounded(R.product(A.unary_expr(t := d.events(), lambda v: 1 + v / (100.0 * t.shape[0]))), 9))
query("product_sparse", "SELECT CAST(0 AS DOUBLE) AS v")(lambda d: R.product(d.quantities()).df)
query("any", f"WITH {_V} SELECT bool_or(v > 100) AS v FROM V")(lambda d: R.any_(A.combine("gt", d.events(), 100.0)).df)
query("all", f"WITH {_V} SELECT bool_and(v > 0) AS v FROM V")(lambda d: R.all_(A.combine("gt", d.events(), 0.0)).df)
query("mean_coeff", f"WITH {_L} SELECT round(sum(v) / ((SELECT count(*) FROM supplier) * (SELECT count(*) FROM part)), 9) AS v FROM L")(lambda d: rounded(R.mean(d.quantities()), 9))
query("min_with_index", f"WITH {_V} SELECT v, i0 FROM V ORDER BY v, i0 LIMIT 1")(lambda d: R.extreme_with_index(d.events()))
query("max_with_index", f"WITH {_V} SELECT v, i0 FROM V ORDER BY v DESC, i0 LIMIT 1")(lambda d: R.extreme_with_index(d.events(), least=False))
query("min_max_coeff", f"WITH {_L} SELECT CAST(0 AS DOUBLE) AS lo, max(v) AS hi FROM L")(lambda d: R.min_coeff(m := d.quantities()).df.select(F.col("v").alias("lo")).join(R.max_coeff(m).df.select(F.col("v").alias("hi"))))
_DIFF = f"{_LA}, {_LR}, D AS (SELECT i0, i1, sum(v) AS v FROM (SELECT * FROM LA UNION ALL SELECT i0, i1, -v FROM LR) GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM part)"
for _name, _agg, _expr in (("max", F.max, "CASE WHEN count(*) < max(n) THEN greatest(max(v), 0) ELSE max(v) END"), ("min", F.min, "CASE WHEN count(*) < max(n) THEN least(min(v), 0) ELSE min(v) END"), ("avg", F.avg, "round(sum(v) / max(n), 9) + 0.0")):
    query(f"sparse_rowwise_{_name}", f"WITH {_DIFF} SELECT i0, {_expr} AS v FROM D, n GROUP BY 1")(lambda d, f=_agg, n=_name: rounded(R.rowwise(A.combine("sub", *_PARTS(d)), f), 9))
query("sparse_extremes", f"WITH {_DIFF} SELECT CAST('least' AS VARCHAR) AS kind, v, i0, i1 FROM (SELECT * FROM D ORDER BY v, i0, i1 LIMIT 1) UNION ALL SELECT 'first zero', CAST(0 AS DOUBLE), a.range, b.range FROM (SELECT a.range, b.range FROM range((SELECT count(*) FROM supplier)) a, range((SELECT count(*) FROM part)) b WHERE (a.range, b.range) NOT IN (SELECT (i0, i1) FROM LA) ORDER BY 1, 2 LIMIT 1) t(a, b), LATERAL (SELECT t.a AS range) a, LATERAL (SELECT t.b AS range) b")(
    lambda d: R.extreme_with_index(A.combine("sub", *_PARTS(d))).select(F.lit("least").alias("kind"), "v", "i0", "i1").unionByName(R.extreme_with_index(_PARTS(d)[0]).select(F.lit("first zero").alias("kind"), "v", "i0", "i1"))
)
query("trace", f"WITH {_G} SELECT round(sum(v), 6) AS v FROM G WHERE i0 = i1")(lambda d: rounded(R.trace(P.gram(d.embeddings()))))
for _p in (1, 2, 3, 4):
    query(f"norm_l{_p}", f"WITH {_V} SELECT round(pow(sum(pow(abs(v), {_p})), 1.0 / {_p}), 4) AS v FROM V")(lambda d, p=_p: rounded(R.norm(d.events(), p), 4))
query("norm_powered", f"WITH {_V} SELECT round(sum(pow(abs(v / 500), 3)), 6) AS v FROM V")(lambda d: rounded(R.norm_powered(A.combine("div", d.events(), 500.0), 3)))
query("normalized", f"WITH {_V} SELECT i0, round(v / (SELECT sqrt(sum(v * v)) FROM V), 9) AS v FROM V")(lambda d: rounded(R.normalized(d.events()), 9))
query("normalized_packed", f"WITH {_X} SELECT vec_id, p.p AS i1, round(e[p.p + 1] / sqrt(list_dot_product(e, e)), 9) + 0.0 AS v FROM X, range(64) p(p)")(
    lambda d: rounded(d.packed().select("vec_id", F.posexplode(packed.normalized(F.col("e"))).alias("i1", "v")).withColumn("i1", F.col("i1").cast("long")), 9)
)
query("packed_equal", f"WITH {_X} SELECT a.vec_id, a.e = b.e AS same, CAST(CASE WHEN a.e < b.e THEN -1 WHEN a.e = b.e THEN 0 ELSE 1 END AS TINYINT) AS sign FROM X a JOIN X b ON b.vec_id = a.vec_id // 2 * 2")(
    lambda d: d.packed().alias("a").join(d.packed().select(F.col("vec_id").alias("k"), F.col("e").alias("f")), F.expr("k = a.vec_id div 2 * 2")).select("vec_id", packed.equal(F.col("e"), F.col("f")).alias("same"), packed.compare(F.col("e"), F.col("f")).alias("sign"))
)
query("frobenius_norm", f"WITH {_L} SELECT round(sqrt(sum(v * v)), 6) AS v FROM L")(lambda d: rounded(R.frobenius_norm(d.quantities())))
query("one_norm", f"WITH {_L} SELECT max(s) AS v FROM (SELECT sum(abs(v)) AS s FROM L GROUP BY i1)")(lambda d: R.one_norm(d.quantities()).df)
query("inf_norm", f"WITH {_L} SELECT max(s) AS v FROM (SELECT sum(abs(v)) AS s FROM L GROUP BY i0)")(lambda d: R.inf_norm(d.quantities()).df)
query("rowwise_sum", f"WITH {_L} SELECT i0, sum(v) AS v FROM L GROUP BY 1")(lambda d: R.rowwise(d.quantities(), F.sum).df)
query("rowwise_norm", f"WITH {_L} SELECT i0, round(sqrt(sum(v * v)), 6) AS v FROM L GROUP BY 1")(lambda d: rounded(R.rowwise(d.quantities(), R.l2)))
query("colwise_sum", f"WITH {_L} SELECT i1 AS i0, sum(v) AS v FROM L GROUP BY 1")(lambda d: R.colwise(d.quantities(), F.sum).df)
query("colwise_norm", f"WITH {_E} SELECT i1 AS i0, round(sqrt(sum(v * v)), 6) AS v FROM E GROUP BY 1")(lambda d: rounded(R.colwise(d.embeddings(), R.l2)))
query("partial_reduction", f"WITH {_E} SELECT i1 // 8 AS i0, round(max(v), 9) + 0.0 AS v FROM E GROUP BY 1")(lambda d: rounded(R.reduce_dims(X.reshape(t := d.embeddings(), t.shape[0], 8, 8), (0, 2), F.max), 9))
query("rowwise_normalize", f"WITH {_L} SELECT i0, i1, round(v / sqrt(sum(v * v) OVER (PARTITION BY i0)), 9) AS v FROM L")(lambda d: rounded(R.normalize_fibers(d.quantities(), 0), 9))
query("rowwise_transform", f"WITH {_E} SELECT i0, i1, round(v - avg(v) OVER (PARTITION BY i0), 9) + 0.0 AS v FROM E")(lambda d: rounded(R.transform_fibers(d.embeddings(), lambda x: x - x.mean(), 0), 9))
query("colwise_scan", f"WITH {_E} SELECT i0, i1, round(sum(v) OVER (PARTITION BY i1 ORDER BY i0), 7) + 0.0 AS v FROM E")(lambda d: rounded(R.scan_fibers(d.embeddings(), lambda v, w: F.sum(v).over(w), 1), 7))
query("colwise_transform", f"WITH {_E} SELECT i0, i1, round(sum(v) OVER (PARTITION BY i1 ORDER BY i0), 7) + 0.0 AS v FROM E")(lambda d: rounded(R.transform_fibers(d.embeddings(), np.cumsum, 1), 7))

# ---------------------------------------------------------------- dense kernels
#
# The SQL computes each factor by itself, unrolled from the cells of a matrix: m00, m01, ..


def _wide(source: str, rows: int, cols: int, name: str = "W") -> str:
    cells = ", ".join(f"sum(v) FILTER (i0 = {i} AND i1 = {j}) AS m{i}{j}" for i in range(rows) for j in range(cols))
    return f"{name} AS (SELECT label, {cells} FROM {source} GROUP BY 1)"


def _minus(*terms: str) -> str:
    return "".join(f" - {t}" for t in terms)


def _cholesky_sql(n: int, cell, name: str = "l") -> str:
    """Lower factor of a symmetric matrix of cells, column by column."""
    out = []
    for j in range(n):
        out.append(f"sqrt({cell(j, j)}{_minus(*(f'{name}{j}{k} * {name}{j}{k}' for k in range(j)))}) AS {name}{j}{j}")
        out += [f"({cell(i, j)}{_minus(*(f'{name}{i}{k} * {name}{j}{k}' for k in range(j)))}) / {name}{j}{j} AS {name}{i}{j}" for i in range(j + 1, n)]
    return ", ".join(out)


def _told_sql(ctes: str, source: str, cells: list[tuple], digits: int = 6) -> str:
    """Rows (label, part, i0, i1, v) out of columns; cells: part, i0, i1, expression."""
    items = ", ".join(f"{{'part': '{p}', 'i0': {i}, 'i1': {j}, 'v': CAST({v} AS DOUBLE)}}" for p, i, j, v in cells)
    return f"WITH {ctes} SELECT label, u.part AS part, CAST(u.i0 AS BIGINT) AS i0, CAST(u.i1 AS BIGINT) AS i1, round(u.v, {digits}) + 0.0 AS v FROM (SELECT label, unnest([{items}]) AS u FROM {source})"


def kernel(name: str, sql: str, tall: bool = False, digits: int = 6):
    """Register a kernel on the packed systems: fn(matrix) -> arrays by part, given back as cells (label, part, i0, i1, v)."""

    def put(fn):
        def run(row: dict) -> dict:
            parts = {p: np.atleast_2d(np.asarray(v, float)) for p, v in fn(D.matrix_of(row)).items()}
            return {"cells": [{"part": p, "i0": i, "i1": j, "v": float(v)} for p, m in parts.items() for (i, j), v in np.ndenumerate(m)]}

        def build(d: Data) -> DataFrame:
            found = D.per_row(d.tall() if tall else d.systems(), run, "label long, cells array<struct<part:string,i0:bigint,i1:bigint,v:double>>", keep=("label",))
            return rounded(found.select("label", F.inline("cells")), digits)

        query(name, sql)(build)
        return fn

    return put


def _all(part: str, rows: int, cols: int, cell) -> list[tuple]:
    return [(part, i, j, cell(i, j)) for i in range(rows) for j in range(cols)]


_m = lambda i, j: f"m{i}{j}"
_zero_above = lambda i, j: f"l{i}{j}" if j <= i else "0"
_W4 = f"{_M}, {_wide('M', 4, 4)}, F AS (SELECT *, {_cholesky_sql(4, _m)} FROM W)"
# Pivots and multipliers of a symmetric matrix by its Cholesky factor.
_unit_lower = lambda i, j: "1" if i == j else f"l{i}{j} / l{j}{j}" if j < i else "0"
_pivoted_upper = lambda i, j: f"l{i}{i} * l{j}{i}" if i <= j else "0"

kernel("llt", _told_sql(_W4, "F", _all("L", 4, 4, _zero_above)))(lambda a: {"L": D.llt(a)})
kernel("ldlt", _told_sql(_W4, "F", [*_all("L", 4, 4, _unit_lower), *(("D", 0, k, f"l{k}{k} * l{k}{k}") for k in range(4))]))(lambda a: {"L": (f := D.ldlt(a)).lower, "D": f.diagonal})
# The last row first: the pivots have to find the order back.
kernel("plu", _told_sql(_W4, "F", [*(("P", 0, k, (k + 1) % 4) for k in range(4)), *_all("L", 4, 4, _unit_lower), *_all("U", 4, 4, _pivoted_upper)]))(
    lambda a: {"P": (f := D.plu(np.roll(a, 1, axis=0))).order, "L": f.lower, "U": f.upper}
)
kernel("determinant", _told_sql(_W4, "F", [("det", 0, 0, "pow(l00 * l11 * l22 * l33, 2) / 1000"), ("odd", 0, 0, "-pow(l00 * l11 * l22 * l33, 2) / 1000")], 4), digits=4)(lambda a: {"det": D.determinant(a) / 1000, "odd": D.determinant(a[[1, 0, 2, 3]]) / 1000})

# Of tall matrices, R is the Cholesky factor of the Gram matrix, and the columns of Q follow.
_gram = lambda i, j: "(" + " + ".join(f"m{k}{i} * m{k}{j}" for k in range(6)) + ")"
_Q = ", ".join(f"(m{i}{j}{_minus(*(f'l{j}{k} * q{i}{k}' for k in range(j)))}) / l{j}{j} AS q{i}{j}" for j in range(3) for i in range(6))
_W6 = f"{_T}, {_wide('T', 6, 3)}, C AS (SELECT *, {_cholesky_sql(3, _gram)} FROM W), F AS (SELECT *, {_Q} FROM C)"
_Q_CELLS, _R_CELLS = _all("Q", 6, 3, lambda i, j: f"q{i}{j}"), _all("R", 3, 3, lambda i, j: f"l{j}{i}" if i <= j else "0")
kernel("qr", _told_sql(_W6, "F", [*_Q_CELLS, *_R_CELLS]), True)(lambda a: {"Q": (f := D.qr(a)).q, "R": f.r})
kernel("qr_gram_schmidt", _told_sql(_W6, "F", [*_Q_CELLS, *_R_CELLS]), True)(lambda a: {"Q": (f := D.qr_gram_schmidt(a)).q, "R": f.r})
kernel("gram_schmidt", _told_sql(_W6, "F", _Q_CELLS), True)(lambda a: {"Q": D.gram_schmidt(a)})
kernel("qr_full", _told_sql(_W6, "F", [*_Q_CELLS, *_R_CELLS, *_all("below", 3, 3, lambda i, j: "0"), *_all("QQ", 6, 6, lambda i, j: int(i == j))]), True)(
    lambda a: {"Q": (f := D.qr_full(a)).q[:, :3], "R": f.r[:3], "below": f.r[3:], "QQ": f.q.T @ f.q}
)
# The largest column comes first, and the volume of all columns is that of the diagonal.
_LONGEST = "sqrt(greatest(" + ", ".join(_gram(k, k) for k in range(3)) + "))"
kernel("qr_col_pivot", _told_sql(_W6, "F", [("first", 0, 0, _LONGEST), ("volume", 0, 0, "l00 * l11 * l22"), *_all("A", 6, 3, _m)]), True)(
    lambda a: {"first": abs((f := D.qr_col_pivot(a)).r[0, 0]), "volume": abs(np.prod(np.diag(f.r))), "A": (f.q @ f.r)[:, np.argsort(f.order)]}
)
kernel("rank", f"WITH {_T} SELECT label, 'rank' AS part, CAST(0 AS BIGINT) AS i0, CAST(i1 AS BIGINT) AS i1, CAST(CASE i1 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 0 END AS DOUBLE) AS v FROM T WHERE i0 = 0", True)(
    lambda a: {"rank": [D.rank(a), D.rank(np.column_stack((a[:, :2], a[:, 0] - 2 * a[:, 1]))), D.rank(0 * a)]}
)


def _spectrum_sql(cell) -> str:
    """Eigenvalues e0 <= e1 <= e2 of a symmetric matrix of 3, by the cosine of a third of an angle."""
    c = {(i, j): cell(i, j) for i in range(3) for j in range(i + 1)}
    b = lambda i, j: f"({c[max(i, j), min(i, j)]}{' - q' if i == j else ''})"
    det = f"({b(0, 0)} * ({b(1, 1)} * {b(2, 2)} - {b(1, 2)} * {b(1, 2)}) - {b(0, 1)} * ({b(0, 1)} * {b(2, 2)} - {b(1, 2)} * {b(0, 2)}) + {b(0, 2)} * ({b(0, 1)} * {b(1, 2)} - {b(1, 1)} * {b(0, 2)}))"
    off = " + ".join(f"2 * {b(i, j)} * {b(i, j)}" for i, j in ((1, 0), (2, 0), (2, 1)))
    return (f"({c[0, 0]} + {c[1, 1]} + {c[2, 2]}) / 3 AS q, sqrt(({' + '.join(f'{b(k, k)} * {b(k, k)}' for k in range(3))} + {off}) / 6) AS p, acos(greatest(least({det} / (2 * p * p * p), 1), -1)) / 3 AS phi, "
            "q + 2 * p * cos(phi) AS e2, q + 2 * p * cos(phi + 2 * pi() / 3) AS e0, 3 * q - e0 - e2 AS e1")


_W3 = f"{_M}, {_wide('M', 3, 3)}, F AS (SELECT *, {_spectrum_sql(_m)} FROM W)"
_VALUES = [("values", 0, k, f"e{k}") for k in range(3)]
_BLOCK3 = _all("A", 3, 3, _m)
kernel("symmetric_eigen", _told_sql(_W3, "F", [*_VALUES, *_BLOCK3], 4), digits=4)(lambda a: {"values": (f := D.symmetric_eigen(a[:3, :3])).values, "A": f.vectors @ np.diag(f.values) @ f.vectors.T})
for _strategy in D.STRATEGIES:
    kernel(f"schur_{_strategy}" if _strategy != "francis" else "schur", _told_sql(_W3, "F", [*_VALUES, *_BLOCK3, *_all("below", 1, 3, lambda i, j: "0")], 4), digits=4)(
        lambda a, s=_strategy: {"values": np.sort(np.diag((f := D.schur(a[:3, :3], strategy=s)).t)), "A": f.u @ f.t @ f.u.T, "below": f.t[[1, 2, 2], [0, 0, 1]]}
    )
kernel("eigen", _told_sql(f"{_M}, {_wide('M', 3, 3)}", "W", [("pair", 0, 0, "m00"), ("pair", 0, 1, "m11"), ("alone", 0, 0, "-m22")]))(
    lambda a: {"pair": [(z := max(D.eigen([[a[0, 0], -a[1, 1], a[0, 1]], [a[1, 1], a[0, 0], a[0, 2]], [0, 0, -a[2, 2]]]).values, key=lambda x: x.imag)).real, z.imag], "alone": min(x.real for x in D.eigen([[a[0, 0], -a[1, 1], a[0, 1]], [a[1, 1], a[0, 0], a[0, 2]], [0, 0, -a[2, 2]]]).values)}
)
kernel("tridiagonal_eigen", _told_sql(f"{_M}, {_wide('M', 3, 3)}, F AS (SELECT *, {_spectrum_sql(lambda i, j: '0' if abs(i - j) == 2 else _m(i, j))} FROM W)", "F", _VALUES, 4), digits=4)(lambda a: {"values": D.tridiagonal_eigen(np.diag(a)[:3], np.diag(a, 1)[:2])[0]})
kernel("hessenberg", _told_sql(f"{_M}, {_wide('M', 4, 4)}", "W", [("first", 0, 0, "sqrt(m10 * m10 + m20 * m20 + m30 * m30)"), *_all("below", 1, 3, lambda i, j: "0"), *_all("A", 4, 4, _m)]))(
    lambda a: {"first": abs((f := D.hessenberg_reduce(a)).h[1, 0]), "below": f.h[[2, 3, 3], [0, 0, 1]], "A": f.q @ f.h @ f.q.T}
)
kernel("svd", _told_sql(f"{_T}, {_wide('T', 6, 3)}, F AS (SELECT *, {_spectrum_sql(_gram)} FROM W)", "F", [*(("values", 0, k, f"sqrt(greatest(e{2 - k}, 0))") for k in range(3)), *_all("A", 6, 3, _m)], 4), True, 4)(
    lambda a: {"values": (f := D.svd(a)).values, "A": f.u @ np.diag(f.values) @ f.vt}
)
kernel("spectral_norm", _told_sql(_W3, "F", [("norm", 0, 0, "e2"), ("condition", 0, 0, "e2 / e0")], 4), digits=4)(lambda a: {"norm": D.spectral_norm(a[:3, :3]), "condition": D.condition_number(a[:3, :3])})
kernel("power_method", _told_sql(_W3, "F", [("value", 0, 0, "e2")], 4), digits=4)(lambda a: {"value": I.power_method(a[:3, :3], np.array([1.0, 0.9, 0.8]), tol=1e-9, max_iter=100_000)[0]})
_TURN = np.array([[np.cos(0.5), -np.sin(0.5), 0, 0], [np.sin(0.5), np.cos(0.5), 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]])
_turn = lambda i, j: {(0, 0): "cos(0.5)", (1, 1): "cos(0.5)", (0, 1): "-sin(0.5)", (1, 0): "sin(0.5)"}.get((i, j), int(i == j))
kernel("polar", _told_sql(f"{_M}, {_wide('M', 4, 4)}", "W", [*_all("rotation", 4, 4, _turn), *_all("stretch", 4, 4, _m)]))(lambda a: {"rotation": (f := D.polar(_TURN @ a)).rotation, "stretch": f.stretch})

# Inverses by the adjugate of the leading block of 3, and by the matrix itself.
_adj = lambda i, j: f"(m{(j + 1) % 3}{(i + 1) % 3} * m{(j + 2) % 3}{(i + 2) % 3} - m{(j + 1) % 3}{(i + 2) % 3} * m{(j + 2) % 3}{(i + 1) % 3})"
_DET3 = "(" + " + ".join(f"m0{k} * {_adj(k, 0)}" for k in range(3)) + ")"
kernel("inverse", _told_sql(f"{_M}, {_wide('M', 4, 4)}", "W", [*_all("small", 3, 3, lambda i, j: f"{_adj(i, j)} / {_DET3}"), *_all("eye", 4, 4, lambda i, j: int(i == j))]))(lambda a: {"small": D.inverse(a[:3, :3]), "eye": a @ D.inverse(a)})
kernel("cofactor", _told_sql(f"{_M}, {_wide('M', 3, 3)}", "W", _all("C", 3, 3, lambda i, j: _adj(j, i))))(lambda a: {"C": D.cofactor(a[:3, :3])})
kernel("pseudoinverse", _told_sql(_W6, "F", [*_all("PA", 3, 3, lambda i, j: int(i == j)), *_all("AP", 6, 6, lambda i, j: " + ".join(f"q{i}{k} * q{j}{k}" for k in range(3)))]), True)(lambda a: {"PA": (p := D.pseudoinverse(a)) @ a, "AP": a @ p})

# The Krylov matrices of a start vector b: the first entries are b'Ab and what A b has beside b.
_AB4 = [" + ".join(f"{w} * m{i}{j}" for j, w in enumerate((1, 2, 3, 4))) for i in range(4)]
_AV4 = [" + ".join(f"{w} * m{i}{j}" for j, w in enumerate((0.5, -0.5, 0.5, 0.5))) for i in range(4)]


def _krylov_sql(rows: list[str], start: tuple, eye: int) -> str:
    size = sum(x * x for x in start)
    first, whole = "(" + " + ".join(f"{w} * ({r})" for w, r in zip(start, rows, strict=True)) + f") / {size}", "(" + " + ".join(f"({r}) * ({r})" for r in rows) + f") / {size}"
    return _told_sql(f"{_M}, {_wide('M', 4, 4)}", "W", [("h", 0, 0, first), ("h", 0, 1, f"sqrt({whole} - ({first}) * ({first}))"), *_all("VV", eye, eye, lambda i, j: int(i == j))])


kernel("arnoldi", _krylov_sql(_AB4, (1, 2, 3, 4), 4))(lambda a: {"h": [(f := I.arnoldi(a, np.arange(1.0, 5.0), 3))[1][0, 0], f[1][1, 0]], "VV": (v := np.array(f[0])) @ v.T})
kernel("lanczos", _krylov_sql(_AV4, (0.5, -0.5, 0.5, 0.5), 3))(lambda a: {"h": [(f := I.lanczos(a, np.array([0.5, -0.5, 0.5, 0.5]), 3))[1][0, 0], f[1][1, 0]], "VV": (v := np.array(f[0])) @ v.T})


def solver(name: str, fn, tall: bool = False):
    """Register a solver: fn(matrix, right side), for a solution that counts on from the label."""

    def run(row: dict) -> dict:
        a = D.matrix_of(row)
        x = row["label"] + 1.0 + np.arange(a.shape[1])
        return {"x": [float(v) for v in fn(a, a @ x)]}

    source = f"WITH {_T} SELECT label, i1, CAST(label + i1 + 1 AS DOUBLE) AS v FROM T WHERE i0 = 0" if tall else f"WITH {_M} SELECT label, i0 AS i1, CAST(label + i0 + 1 AS DOUBLE) AS v FROM M WHERE i1 = 0"

    @query(name, source)
    def _(d):
        found = D.per_row(d.tall() if tall else d.systems(), run, "label long, x array<double>", keep=("label",))
        return rounded(found.select("label", F.posexplode("x").alias("i1", "v")).withColumn("i1", F.col("i1").cast("long")))


for _mode in ("lower", "upper", "unit_lower", "unit_upper"):
    def _triangle(a, b, m=_mode):
        part = np.tril(a) if m.endswith("lower") else np.triu(a)
        if m.startswith("unit"):
            np.fill_diagonal(part, 1.0)
        return D.triangular_solve(part, part @ np.linalg.solve(a, b), m)

    solver("triangular_solve" if _mode == "lower" else f"triangular_solve_{_mode}", _triangle)
for _name, _solve in {"plu": D.plu_solve, "llt": D.llt_solve, "ldlt": D.ldlt_solve}.items():
    solver(f"{_name}_solve", _solve)
for _name, _solve in {"qr": D.qr_solve, "qr_full": D.qr_solve_full, "spqr": lambda a, b: SD.spqr_solve(SD.Entries.of(((i, j, v) for (i, j), v in np.ndenumerate(a)), a.shape), b)}.items():
    solver(f"{_name}_solve", _solve, True)
solver("jacobi", lambda a, b: I.jacobi(a, b).x)
solver("gauss_seidel", lambda a, b: I.gauss_seidel(a, b).x)
solver("conjugate_gradient", lambda a, b: I.conjugate_gradient(a, b).x)
solver("pcg_jacobi", lambda a, b: I.conjugate_gradient(a, b, preconditioner=I.JacobiPreconditioner(a)).x)
solver("pcg_ssor", lambda a, b: I.conjugate_gradient(a, b, preconditioner=I.SsorPreconditioner(a)).x)
solver("gmres", lambda a, b: I.gmres(a, b).x)
solver("bicgstab", lambda a, b: I.bicgstab(a, b).x)


def _shifted_systems(d: Data) -> DataFrame:
    """The systems less (4 + label) on the diagonal: some are no longer positive definite."""
    return d.systems().withColumn("a", F.expr("transform(a, (x, k) -> x - IF(k % 5 = 0, 4D + label / 2D, 0D))"))


_SHIFT = lambda i, j: f"(m{i}{j} - 4 - label / 2)" if i == j else f"m{i}{j}"
# Pivots without roots: a matrix is positive definite where all are positive.
_PIVOTS = ", ".join(e for j in range(4) for e in (f"{_SHIFT(j, j)}{_minus(*(f'u{k}{j} * u{k}{j} / d{k}' for k in range(j)))} AS d{j}", *(f"{_SHIFT(j, i)}{_minus(*(f'u{k}{j} * u{k}{i} / d{k}' for k in range(j)))} AS u{j}{i}" for i in range(j + 1, 4))))
_STATUS = f"WITH {_M}, {_wide('M', 4, 4)}, F AS (SELECT *, {_PIVOTS} FROM W) SELECT label, CASE WHEN d0 > 0 AND d1 > 0 AND d2 > 0 AND d3 > 0 THEN 'ok' ELSE 'breakdown' END AS status, CASE WHEN d0 > 0 AND d1 > 0 AND d2 > 0 AND d3 > 0 THEN round(d0 * d1 * d2 * d3, 4) + 0.0 ELSE 0 END AS det FROM F"


@query("llt_status", _STATUS)
def _(d):
    """A matrix that is not positive definite has a status of its own and stops nothing."""
    found = D.per_row(_shifted_systems(d), lambda row: {"det": float(np.prod(np.diag(D.llt(D.matrix_of(row)))) ** 2)}, "label long, det double, status string", keep=("label",))
    return found.select("label", "status", (F.round(F.coalesce("det", F.lit(0.0)), 4) + F.lit(0.0)).alias("det"))


@query("llt_stack", _STATUS)
def _(d):
    """The same for all matrices of a batch at once."""

    def run(stack):
        lower, fine = D.llt_stack(stack)
        return {"det": np.where(fine, np.prod(np.diagonal(lower, axis1=1, axis2=2), axis=1) ** 2, 0.0), "fine": fine}

    found = D.per_stack(_shifted_systems(d), run, "label long, det double, fine boolean", keep=("label",))
    return found.select("label", F.when(F.col("fine"), "ok").otherwise("breakdown").alias("status"), (F.round("det", 4) + F.lit(0.0)).alias("det"))


@query("qr_stack", _told_sql(_W6, "F", _R_CELLS))
def _(d):
    found = D.per_stack(d.tall(), lambda stack: {"r": D.qr(stack).r}, "label long, r array<double>", keep=("label",))
    cells = found.select("label", F.posexplode("r").alias("p", "v"))
    return rounded(cells.select("label", F.lit("R").alias("part"), F.expr("cast(p div 3 as bigint)").alias("i0"), (F.col("p") % 3).cast("long").alias("i1"), "v"))


# Sparse systems by return flag: what suppliers and parts (modulo 40) share, made symmetric and dominated by its diagonal.
_SIDE = 40


def _sparse_systems(d: Data, symmetric: bool) -> DataFrame:
    rows = d.table("lineitem").select(F.ascii("l_returnflag").cast("long").alias("g"), (F.col("l_suppkey") % _SIDE).alias("i0"), (F.col("l_partkey") % _SIDE).alias("i1"), F.col("l_quantity").alias("v")).where("i0 <> i1 AND (i0 + i1) % 7 = 0")
    rows = rows.unionByName(rows.select("g", F.col("i1").alias("i0"), F.col("i0").alias("i1"), "v")) if symmetric else rows
    cells = rows.groupBy("g", "i0", "i1").agg(F.sum("v").alias("v"))
    sums = d.spark.range(_SIDE).select(F.col("id").alias("i0")).join(F.broadcast(rows.select("g").distinct())).join(cells.groupBy("g", "i0").agg(F.sum("v").alias("s")), ["g", "i0"], "left")
    whole = cells.unionByName(sums.select("g", "i0", F.col("i0").alias("i1"), (F.coalesce("s", F.lit(0.0)) + 1).alias("v")))
    right = whole.groupBy("g", "i0").agg(F.sum(F.col("v") * (F.col("i1") + 1)).alias("v")).select("g", "i0", F.lit(_SIDE).cast("long").alias("i1"), "v")
    return whole.unionByName(right)


_COUNTED = f"SELECT DISTINCT CAST(ascii(l_returnflag) AS BIGINT) AS g, a.range AS i0, CAST(a.range + 1 AS DOUBLE) AS v, 'ok' AS status FROM lineitem, range({_SIDE}) a WHERE l_suppkey % {_SIDE} <> l_partkey % {_SIDE} AND (l_suppkey % {_SIDE} + l_partkey % {_SIDE}) % 7 = 0"
for _name, _solve in {"cholmod": SD.cholmod_solve, "umfpack": SD.umfpack_solve, "spqr_square": SD.spqr_solve}.items():
    query(f"{_name}_solve", _COUNTED)(lambda d, f=_solve, n=_name: rounded(SD.solve_groups(_sparse_systems(d, n == "cholmod"), "g", f, _SIDE)))


@query("spqr_rank", "SELECT CAST((SELECT count(*) FROM supplier) AS BIGINT) AS n, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS spqr FROM lineitem")
def _(d):
    """Of a diagonal of quantities, of which suppliers without a line leave an empty row."""
    m = d.table("lineitem").groupBy(F.col("l_suppkey").alias("i0")).agg(F.sum("l_quantity").alias("v"))
    n = d.n("supplier")
    return d.spark.createDataFrame([(n, SD.spqr_rank(SD.Entries.from_tensor(S.from_diagonal(Tensor(m, (n,), sparse=True)))))], "n long, spqr long")


@query("multigrid", "SELECT range AS i0, CAST(range % 8 + 1 AS DOUBLE) AS v FROM range(63)")
def _(d):
    def solve(row: dict) -> dict:
        n = row["n"]
        a = 2.0 * np.eye(n) - np.eye(n, k=1) - np.eye(n, k=-1)
        return {"v": I.multigrid(I.build_hierarchy(a, 4), a @ (np.arange(n) % 8 + 1.0)).x.tolist()}

    rows = D.per_row(d.spark.createDataFrame([(63,)], "n int"), solve, "v array<double>")
    return rounded(rows.select(F.posexplode("v").alias("i0", "v")).withColumn("i0", F.col("i0").cast("long")))


def _chain_matrix(d: Data, n: int) -> Tensor:
    """Sparse matrix with 40 on the diagonal and -1 beside it."""
    rows = d.spark.range(n).select(F.col("id").alias("i0"), F.explode(F.expr("array(struct(id AS j, 40D AS v), struct(id - 1 AS j, -1D AS v), struct(id + 1 AS j, -1D AS v))")).alias("c"))
    return Tensor(rows.select("i0", F.col("c.j").alias("i1"), F.col("c.v").alias("v")).where(f"i1 >= 0 AND i1 < {n}"), (n, n), sparse=True)


# A system of a row per part, spread over the cluster, whose solution is the parts' sizes.
for _name, _solve in {"cg": I.conjugate_gradient, "jacobi": I.jacobi, "bicgstab": I.bicgstab, "gmres": I.gmres}.items():
    def _spread(d, f=_solve):
        a = _chain_matrix(d, d.n("part"))
        return rounded(f(a, P.matmul(a, d.part_size()).with_(kind="vector"), tol=1e-2).x.densify(), 1)

    query(f"{_name}_spread", f"WITH {_B} SELECT i0, round(v, 1) AS v FROM B")(_spread)


@query("lanczos_spread", f"WITH {_B}, Z AS (SELECT sqrt(sum(v * v)) AS z FROM B), U AS (SELECT i0, v / z AS v FROM B, Z), Y AS (SELECT a.i0, 40 * a.v - coalesce(b.v, 0) - coalesce(c.v, 0) AS y, a.v FROM U a LEFT JOIN U b ON b.i0 = a.i0 - 1 LEFT JOIN U c ON c.i0 = a.i0 + 1) SELECT round(sum(y * v), 6) AS diagonal, round(sqrt(sum(y * y) - sum(y * v) * sum(y * v)), 6) AS beside FROM Y")
def _(d):
    _, t = I.lanczos(_chain_matrix(d, d.n("part")), R.normalized(d.part_size()), 2)
    return rounded(d.spark.createDataFrame([(float(t[0, 0]), float(t[1, 0]))], "diagonal double, beside double"), 6, "diagonal", "beside")


# ---------------------------------------------------------------- geometry


def _points(d: Data) -> DataFrame:
    return d.packed().select("vec_id", *(F.element_at("e", k + 1).alias(n) for k, n in enumerate(("x", "y", "z", "u", "p", "q", "r", "s"))))


def _point_query(name: str, sql: str, columns, names: str = "xyz"):
    @query(name, f"WITH {_X}, N AS (SELECT vec_id, e[1] AS x, e[2] AS y, e[3] AS z, e[4] AS u, e[5] AS p, e[6] AS q, e[7] AS r, e[8] AS s FROM X) SELECT vec_id, {sql} FROM N")
    def _(d):
        found = _points(d).select("vec_id", *(c.alias(n) for c, n in zip(columns(), names, strict=True)))
        doubles = [n for n, kind in found.dtypes if kind == "double"]
        return rounded(found, 8, *doubles) if doubles else found


def _cells(**parts: str) -> str:
    return ", ".join(f"round({v}, 8) + 0.0 AS {k}" for k, v in parts.items())


_XYZ = lambda: (F.col("x"), F.col("y"), F.col("z"))
_PQR = lambda: (F.col("p"), F.col("q"), F.col("r"))
_QUAT = lambda: Q.quaternion(F.col("x"), F.col("y"), F.col("z"), F.col("u"))
_QUAT2 = lambda: Q.quaternion(F.col("p"), F.col("q"), F.col("r"), F.col("s"))
_LEN = "(x * x + y * y + z * z + u * u)"

_point_query("translation", _cells(x="x + 1", y="y + 2", z="z + 3"), lambda: G.translation(1, 2, 3).apply(*_XYZ()))
_point_query("scaling", _cells(x="x * 2", y="y * 3", z="z * 4"), lambda: G.scaling(2, 3, 4).apply(*_XYZ()))
_point_query("rotation", _cells(x="x * cos(0.5) - y * sin(0.5)", y="x * sin(0.5) + y * cos(0.5)", z="z"), lambda: G.rotation(0.5, (0, 0, 2)).apply(*_XYZ()))
_point_query("trs_apply", _cells(x="2 * x * cos(0.5) - 3 * y * sin(0.5) + 1", y="2 * x * sin(0.5) + 3 * y * cos(0.5) + 2", z="4 * z + 3"), lambda: (G.translation(1, 2, 3) @ G.rotation(0.5, (0, 0, 1)) @ G.scaling(2, 3, 4)).apply(*_XYZ()))
_point_query("transform_inverse", _cells(x="x", y="y", z="z"), lambda: ((t := G.translation(1, 2, 3) @ G.rotation(0.5, (1, 2, 2)) @ G.scaling(2, 3, 4)).inverse() @ t).apply(*_XYZ()))
_point_query("look_at", _cells(x="x", y="y", z="z - 5"), lambda: G.look_at((0, 0, 5), (0, 0, 0), (0, 1, 0)).apply(*_XYZ()))
_point_query("ortho", _cells(x="x / 2", y="y / 3", z="-z * 2 / 9 - 11.0 / 9"), lambda: G.ortho(-2, 2, -3, 3, 1, 10).apply(*_XYZ()))
_point_query("perspective", _cells(x="x / tan(0.5) / 1.5 / (5 - z)", y="y / tan(0.5) / (5 - z)", z="(11.0 / 9 * (5 - z) - 20.0 / 9) / (5 - z)"), lambda: (G.perspective(1.0, 1.5, 1, 10) @ G.look_at((0, 0, 5), (0, 0, 0), (0, 1, 0))).apply(*_XYZ()))
_point_query("project_unproject", _cells(x="x", y="y", z="z"), lambda: G.unproject(G.project(_XYZ(), v := G.look_at((0, 0, 5), (0, 0, 0), (0, 1, 0)), f := G.perspective(1.0, 1.5, 1, 10), (0, 0, 640, 480)), v, f, (0, 0, 640, 480)))
_point_query("project", _cells(x="(x / tan(0.5) / 1.5 / (5 - z) * 0.5 + 0.5) * 640", y="(y / tan(0.5) / (5 - z) * 0.5 + 0.5) * 480", z="(11.0 / 9 * (5 - z) - 20.0 / 9) / (5 - z) * 0.5 + 0.5"), lambda: G.project(_XYZ(), G.look_at((0, 0, 5), (0, 0, 0), (0, 1, 0)), G.perspective(1.0, 1.5, 1, 10), (0, 0, 640, 480)))
_point_query("frustum", _cells(x="(2 * x / 5 + z / 5) / (5 - z) + 1 / (z - 5)", y="(2 * y / 4 + (z - 5) / -2) / (5 - z)", z="(11.0 / 9 * (5 - z) - 20.0 / 9) / (5 - z)"), lambda: (G.frustum(-2, 3, -3, 1, 1, 10) @ G.look_at((0, 0, 5), (0, 0, 0), (0, 1, 0))).apply(*_XYZ()))
_point_query("infinite_perspective", _cells(x="x / tan(0.5) / 1.5 / (5 - z)", y="y / tan(0.5) / (5 - z)", z="(5 - z - 2) / (5 - z)"), lambda: (G.infinite_perspective(1.0, 1.5, 1) @ G.look_at((0, 0, 5), (0, 0, 0), (0, 1, 0))).apply(*_XYZ()))
_point_query("distance", _cells(v="sqrt((x - p) * (x - p) + (y - q) * (y - q) + (z - r) * (z - r))"), lambda: (G.distance(_XYZ(), _PQR()),), ("v",))
_point_query("reflect", _cells(x="x - 2 * 0.6 * (0.6 * x + 0.8 * y)", y="y - 2 * 0.8 * (0.6 * x + 0.8 * y)", z="z"), lambda: G.reflect(_XYZ(), (F.lit(0.6), F.lit(0.8), F.lit(0.0))))
_point_query(
    "refract",
    _cells(**{c: f"CASE WHEN 1 - 2.25 * (1 - z * z) < 0 THEN 0 ELSE 1.5 * {c} - (1.5 * z + sqrt(greatest(1 - 2.25 * (1 - z * z), 0))) * {n} END" for c, n in (("x", 0), ("y", 0), ("z", 1))}),
    lambda: G.refract(_XYZ(), (F.lit(0.0), F.lit(0.0), F.lit(1.0)), 1.5),
)
_point_query("face_forward", _cells(x="CASE WHEN x * p + y * q + z * r < 0 THEN x ELSE -x END", y="CASE WHEN x * p + y * q + z * r < 0 THEN y ELSE -y END", z="CASE WHEN x * p + y * q + z * r < 0 THEN z ELSE -z END"), lambda: G.face_forward(_XYZ(), _PQR(), _XYZ()))
_point_query("quat_mul", _cells(w="x * p - y * q - z * r - u * s", x="x * q + y * p + z * s - u * r", y="x * r - y * s + z * p + u * q", z="x * s + y * r - z * q + u * p"), lambda: [Q.mul(_QUAT(), _QUAT2())[n] for n in "wxyz"], "wxyz")
_point_query("quat_norm", _cells(n=f"sqrt{_LEN}", d="x * p + y * q + z * r + u * s"), lambda: (Q.norm(_QUAT()), Q.dot(_QUAT(), _QUAT2())), "nd")
_point_query("quat_inverse", _cells(w=f"x / {_LEN}", x=f"-y / {_LEN}", y=f"-z / {_LEN}", z=f"-u / {_LEN}"), lambda: [Q.inverse(_QUAT())[n] for n in "wxyz"], "wxyz")


_N = f"sqrt{_LEN}"
_MATRIX = {"a": "1 - 2 * (z * z + u * u) / L", "b": "2 * (y * z - x * u) / L", "c": "2 * (y * u + x * z) / L", "f": "2 * (z * u - x * y) / L", "i": "1 - 2 * (y * y + z * z) / L"}
_point_query("quat_rotation_matrix", _cells(**{k: v.replace("L", _LEN) for k, v in _MATRIX.items()}), lambda: [F.get(Q.to_matrix(Q.normalized(_QUAT())), F.lit(k)) for k in (0, 1, 2, 5, 8)], "abcfi")


@query("quat_from_matrix", f"WITH {_X}, N AS (SELECT vec_id, e[1] AS x, e[2] AS y, e[3] AS z, e[4] AS u FROM X) SELECT vec_id, {_cells(**{k: f'{c} / {_N}' for k, c in zip('wxyz', 'xyzu', strict=True)})} FROM N")
def _(d):
    """Back from the matrix, with the sign (of two that stand for one rotation) that the quaternion had."""
    unit = _points(d).select("vec_id", Q.normalized(_QUAT()).alias("n"))
    back = unit.select("vec_id", "n", Q.to_matrix(F.col("n")).alias("m")).select("vec_id", "n", Q.from_matrix(F.col("m")).alias("b"))
    signed = back.withColumn("s", F.signum(Q.dot(F.col("n"), F.col("b"))))
    return rounded(signed.select("vec_id", *((F.col("s") * F.col("b")[n]).alias(n) for n in "wxyz")), 8, *"wxyz")


_point_query("quat_equal", "x = p AND y = q AND z = r AND u = s AS same, true AS own", lambda: (Q.equal(_QUAT(), _QUAT2()), Q.equal(_QUAT(), _QUAT())), ("same", "own"))
_point_query(
    "from_euler", _cells(w="cos(x/2)*cos(y/2)*cos(z/2) + sin(x/2)*sin(y/2)*sin(z/2)", x="sin(x/2)*cos(y/2)*cos(z/2) - cos(x/2)*sin(y/2)*sin(z/2)", y="cos(x/2)*sin(y/2)*cos(z/2) + sin(x/2)*cos(y/2)*sin(z/2)", z="cos(x/2)*cos(y/2)*sin(z/2) - sin(x/2)*sin(y/2)*cos(z/2)"),
    lambda: [Q.from_euler(*_XYZ())[n] for n in "wxyz"], "wxyz",
)
_point_query("quat_rotate", _cells(x="x * cos(0.5) - y * sin(0.5)", y="x * sin(0.5) + y * cos(0.5)", z="z"), lambda: [F.get(Q.rotate(Q.angle_axis(F.lit(0.5), F.lit(0.0), F.lit(0.0), F.lit(1.0)), *_XYZ()), F.lit(k)) for k in range(3)])
_point_query("euler_angles", _cells(x="x", y="y", z="z"), lambda: [Q.to_euler(Q.from_euler(*_XYZ()))[n] for n in ("pitch", "yaw", "roll")])
_point_query("slerp", _cells(w="cos((0.25 + 0.3 * x) / 1)", z="sin(0.25 + 0.3 * x)"), lambda: [Q.slerp(Q.angle_axis(F.lit(0.5), F.lit(0.0), F.lit(0.0), F.lit(1.0)), Q.angle_axis(0.5 + 2 * F.col("x"), F.lit(0.0), F.lit(0.0), F.lit(1.0)), F.lit(0.3))[n] for n in "wz"], "wz")


#: A turn by 0.5 about the unit axis (1, 2, 2) / 3, row by row.
_AXIS = (1 / 3, 2 / 3, 2 / 3)
_SPIN = [f"{_AXIS[i] * _AXIS[j]} * (1 - cos(0.5)) + " + ("cos(0.5)" if i == j else f"{(1 if (i - j) % 3 == 1 else -1) * _AXIS[3 - i - j]} * sin(0.5)") for i in range(3) for j in range(3)]


@query("trs_decompose", "WITH t AS (SELECT label, CAST(count(*) AS DOUBLE) AS n FROM embeddings GROUP BY 1) SELECT CAST(label AS BIGINT) AS label, CAST(u.i0 AS BIGINT) AS i0, round(u.shift, 9) AS shift, round(u.scale, 9) AS scale, " + ", ".join(f"round(u.r{j}, 9) + 0.0 AS r{j}" for j in range(3)) + " FROM (SELECT label, unnest([" + ", ".join(f"{{'i0': {i}, 'shift': n + {i}, 'scale': n * {i + 2}, " + ", ".join(f"'r{j}': {_SPIN[3 * i + j]}" for j in range(3)) + "}" for i in range(3)) + "]) AS u FROM t)")
def _(d):
    """Of a transform per label, made of the number of its vectors."""
    out = []
    for r in d.table("embeddings").groupBy(F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n")).collect():
        n = float(r["n"])
        shift, turn, scale = G.trs_decompose(G.translation(n, n + 1, n + 2) @ G.rotation(0.5, (1, 2, 2)) @ G.scaling(2 * n, 3 * n, 4 * n))
        out += [(r["label"], i, float(shift[i]), float(scale[i]), *map(float, turn[i])) for i in range(3)]
    return rounded(d.spark.createDataFrame(out, "label long, i0 long, shift double, scale double, r0 double, r1 double, r2 double"), 9, "shift", "scale", "r0", "r1", "r2")


@query("accessors", "SELECT 0.5 AS angle, round(1 / 3.0, 9) AS x, round(2 / 3.0, 9) AS y, CAST(3 AS DOUBLE) AS factor, CAST(7 AS DOUBLE) AS shift")
def _(d):
    turn = G.rotation(0.5, (1, 2, 2))
    return rounded(d.spark.createDataFrame([(turn.angle, float(turn.axis[0]), float(turn.axis[1]), float(G.scaling(2, 3, 4).factors[1]), float(G.translation(5, 6, 7).vector[2]))], "angle double, x double, y double, factor double, shift double"), 9, "angle", "x", "y", "factor", "shift")


_DET2 = "D AS (SELECT l_suppkey, sum(l_quantity) AS a, sum(l_linenumber) AS b, sum(l_tax) AS c, sum(l_discount) AS d FROM lineitem GROUP BY 1)"


@query("inv2", f"WITH {_DET2} SELECT l_suppkey, round(a * d - b * c, 4) + 0.0 AS det, round(d / (a * d - b * c), 6) + 0.0 AS i00 FROM D")
def _(d):
    sums = d.table("lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("a"), F.sum("l_linenumber").alias("b"), F.sum("l_tax").alias("c"), F.sum("l_discount").alias("d"))
    det = F.col("a") * F.col("d") - F.col("b") * F.col("c")
    return sums.select("l_suppkey", (F.round(det, 4) + 0.0).alias("det"), (F.round(ieee.div(F.col("d"), det), 6) + 0.0).alias("i00"))


@query("grid", "SELECT a.range AS i0, b.range AS i1, c.range AS i2 FROM range(4) a, range(3) b, range(5) c")
def _(d):
    return grid(d.spark, (4, 3, 5))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
