"""Tensors as DataFrames of coordinate rows.

A tensor of rank r is a DataFrame with index columns ``i0 .. i{r-1}`` (BIGINT, from 0) and
a value column ``v``. Its shape is metadata, never taken from the rows: trailing zero rows
would be lost. A sparse tensor leaves zeros out; a dense one has a row per cell. An
extent of None is a broadcast dimension, without bound until it meets a bounded one.
"""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("data", "array", "vector", "form", "matrix", "tensor", "quaternion")


class SolverError(RuntimeError):
    """A kernel that could not finish: kind is 'breakdown' or 'diverged'."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def index_columns(rank: int, prefix: str = "i") -> list[str]:
    return [f"{prefix}{k}" for k in range(rank)]


def grid(spark: SparkSession, shape: tuple[int, ...]) -> DataFrame:
    """All index tuples of a shape, row-major, from one range: no join."""
    if any(n is None or n < 0 for n in shape):
        raise ValueError(f"shape {shape} has an unbounded or negative extent")
    cells = spark.range(prod(shape))
    step, out = 1, []
    for k in reversed(range(len(shape))):
        at = F.floor(F.col("id") / step) if step == 1 else F.expr(f"id div {step}")
        out.insert(0, (F.pmod(at, F.lit(max(shape[k], 1))) if k else at).cast("long").alias(f"i{k}"))
        step *= max(shape[k], 1)
    return cells.select(*out) if out else cells.select()


class Tensor:
    """A DataFrame of coordinates with shape, kind and sparsity."""

    def __init__(self, df: DataFrame, shape: tuple, kind: str | None = None, sparse: bool = False):
        shape = tuple(shape)
        if any(n is not None and n < 0 for n in shape):
            raise ValueError("extents must not be negative")
        kind = kind or {1: "vector", 2: "matrix"}.get(len(shape), "tensor")
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind}")
        if (want := [*index_columns(len(shape)), "v"]) != df.columns:
            df = df.select(*want)
        self.df, self.shape, self.kind, self.sparse = df, shape, kind, sparse

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def idx(self) -> list[str]:
        return index_columns(self.rank)

    @property
    def size(self) -> int:
        if None in self.shape:
            raise ValueError("a broadcast dimension has no size until it is combined")
        return prod(self.shape)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def with_(self, df: DataFrame | None = None, shape: tuple | None = None, kind: str | None = None, sparse: bool | None = None) -> Tensor:
        return Tensor(self.df if df is None else df, self.shape if shape is None else shape, kind or (self.kind if shape is None or len(shape) == self.rank else None), self.sparse if sparse is None else sparse)

    def as_kind(self, kind: str) -> Tensor:
        """The same rows under another kind; vector, matrix and quaternion drop extents of 1 that are too many."""
        want = {"vector": 1, "form": 1, "quaternion": 1, "matrix": 2}.get(kind)
        t = self
        if want is not None and t.rank > want:
            kept = [k for k, n in enumerate(t.shape) if n != 1]
            extra = [k for k, n in enumerate(t.shape) if n == 1]
            kept = sorted(kept + extra[: max(0, want - len(kept))])
            if len(kept) != want:
                raise ValueError(f"shape {t.shape} is no {kind}")
            t = Tensor(t.df.select(*(F.col(f"i{k}").alias(f"i{n}") for n, k in enumerate(kept)), "v"), tuple(t.shape[k] for k in kept), sparse=t.sparse)
        if kind == "quaternion" and t.shape != (4,):
            raise ValueError("a quaternion has 4 components")
        return Tensor(t.df, t.shape, kind, t.sparse)

    def values(self, column: Column) -> Tensor:
        """The same cells with other values."""
        return self.with_(self.df.select(*self.idx, column.alias("v")))

    def compress(self) -> Tensor:
        """Duplicates summed; explicit zeros stay."""
        return self.with_(self.df.groupBy(*self.idx).agg(F.sum("v").alias("v")), sparse=True)

    def prune(self) -> Tensor:
        """Without explicit zeros."""
        return self.with_(self.df.where("v <> 0"), sparse=True)

    def densify(self) -> Tensor:
        """A row for each cell; missing ones are 0. Rows must be compressed."""
        if not self.sparse:
            return self
        kind = dict(self.df.dtypes)["v"]
        if self.rank == 0:
            value = F.coalesce(F.sum("v"), F.lit(0.0)) if kind != "boolean" else F.coalesce(F.bool_or("v"), F.lit(False))
            return self.with_(self.df.agg(value.cast(kind).alias("v")), sparse=False)
        cells = grid(self.spark, self.shape)
        return self.with_(cells.join(self.df, self.idx, "left").select(*self.idx, F.coalesce("v", F.lit(0).cast(kind)).alias("v")), sparse=False)

    def cast(self, dtype: str) -> Tensor:
        """Values cast; fractions are cut towards zero."""
        return self.values(F.col("v").cast(dtype))

    def coeff(self, *at: int):
        """One value; 0 where a sparse tensor has no row."""
        self.check_index(at)
        found = self.df.where(" AND ".join(f"i{k} = {int(x)}" for k, x in enumerate(at)) or "true").agg(F.sum("v").alias("v")).first()["v"]
        return 0.0 if found is None else found

    def coeff_ref(self, *at: int) -> float:
        """The value of an entry that is there; KeyError where a sparse tensor stores none."""
        self.check_index(at)
        found = self.df.where(" AND ".join(f"i{k} = {int(x)}" for k, x in enumerate(at)) or "true").agg(F.sum("v").alias("v"), F.count("*").alias("n")).first()
        if not found["n"]:
            raise KeyError(f"no entry at {at}")
        return found["v"]

    def with_coeff(self, value: float, *at: int) -> Tensor:
        """The same tensor with the value of an entry that is there; KeyError where a sparse tensor stores none."""
        self.coeff_ref(*at)
        here = F.lit(True)
        for k, x in enumerate(at):
            here = here & (F.col(f"i{k}") == int(x))
        return self.values(F.when(here, F.lit(value)).otherwise(F.col("v")))

    def as_extents(self, *shape: int | None) -> Tensor:
        """The same cells under a shape that has to agree; None takes any extent."""
        if len(shape) != self.rank or any(None not in (m, n) and m != n for m, n in zip(self.shape, shape, strict=True)):
            raise ValueError(f"shape {self.shape} is not {shape}")
        return self.with_(shape=tuple(m if n is None else n for m, n in zip(self.shape, shape, strict=True)))

    def as_dynamic(self) -> Tensor:
        """The same cells under the extents that the rows themselves show: a broadcast dimension gets one, others stay."""
        if None not in self.shape:
            return self
        found = self.df.agg(*(F.coalesce(F.max(c) + 1, F.lit(0)).alias(c) for c in self.idx)).first()
        return self.with_(shape=tuple(found[c] if n is None else n for c, n in zip(self.idx, self.shape, strict=True)))

    def check_index(self, at: tuple) -> None:
        if len(at) != self.rank or any(x < 0 or (n is not None and x >= n) for x, n in zip(at, self.shape, strict=False)):
            raise IndexError(f"index {at} is outside shape {self.shape}")

    def nnz(self) -> int:
        return self.df.count()

    def nnz_by(self, axis: int = 0) -> Tensor:
        """Stored entries of each fiber along an axis."""
        counts = self.df.groupBy(F.col(f"i{axis}").alias("i0")).agg(F.count("*").cast("double").alias("v"))
        return Tensor(counts, (self.shape[axis],), sparse=True)

    # Operators follow the kind: * is element-wise on arrays, the matrix product on matrices, the
    # outer product on tensors, a contraction on forms and the Hamilton product on quaternions.

    def _arithmetic(self, op: str, other, swap: bool = False) -> Tensor:
        from .operators.arithmetic import combine

        return combine(op, other, self) if swap else combine(op, self, other)

    def __add__(self, other):
        return self._arithmetic("add", other)

    def __radd__(self, other):
        return self._arithmetic("add", other, True)

    def __sub__(self, other):
        return self._arithmetic("sub", other)

    def __rsub__(self, other):
        return self._arithmetic("sub", other, True)

    def __neg__(self):
        return self.values(-F.col("v"))

    def __truediv__(self, other):
        if isinstance(other, Tensor) and other.rank and self.kind != "array":
            raise TypeError(f"a {self.kind} is divided by numbers only")
        return self._arithmetic("div", other)

    def __mod__(self, other):
        if self.kind != "array":
            raise TypeError(f"a {self.kind} has no remainder")
        return self._arithmetic("mod", other)

    def __mul__(self, other):
        from .operators import products

        if not isinstance(other, Tensor) or other.rank == 0 or self.rank == 0 or self.kind in ("array", "data"):
            return self._arithmetic("mul", other)
        rule = {"matrix": products.matmul, "tensor": products.outer, "form": products.form_times, "quaternion": products.hamilton}.get(self.kind)
        if rule is None:
            raise TypeError(f"a {self.kind} has no product with a {other.kind}; see dot, cross and outer")
        return rule(self, other)

    def __rmul__(self, other):
        return self._arithmetic("mul", other, True)

    def __matmul__(self, other):
        from .operators.products import matmul

        return matmul(self, other)

    def __xor__(self, other):
        from .operators.products import wedge

        return wedge(self, other) if self.kind == "form" else self._arithmetic("xor", other)

    def __and__(self, other):
        return self._arithmetic("and", other)

    def __or__(self, other):
        return self._arithmetic("or", other)

    def __lt__(self, other):
        return self._arithmetic("lt", other)

    def __le__(self, other):
        return self._arithmetic("le", other)

    def __gt__(self, other):
        return self._arithmetic("gt", other)

    def __ge__(self, other):
        return self._arithmetic("ge", other)

    @property
    def T(self) -> Tensor:  # noqa: N802
        from .operators.indexing import transpose

        return transpose(self)

    def format(self) -> str:
        """Text of a small tensor: [a, b] for vectors, [row;row] for matrices."""
        dense = self.densify().df
        rows = (dense.orderBy(*self.idx) if self.rank else dense).collect()
        if self.rank == 0:
            return f"{rows[0]['v']:g}"
        if self.rank == 1:
            return "[" + ", ".join(f"{r['v']:g}" for r in rows) + "]"
        width = max(self.shape[-1], 1)
        lines = [", ".join(f"{r['v']:g}" for r in rows[a : a + width]) for a in range(0, len(rows), width)]
        return "[" + ";".join(lines) + "]"


def same_shape(a: Tensor, b: Tensor) -> tuple:
    """Joint shape of two tensors; None gives way to the other's extent."""
    if a.rank != b.rank or any(m != n and None not in (m, n) for m, n in zip(a.shape, b.shape, strict=True)):
        raise ValueError(f"shapes {a.shape} and {b.shape} do not agree")
    return tuple(n if m is None else m for m, n in zip(a.shape, b.shape, strict=True))
