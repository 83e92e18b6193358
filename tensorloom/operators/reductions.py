"""Reductions of whole tensors and of chosen dimensions, norms, fiber transforms."""

from __future__ import annotations

from collections.abc import Callable
from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..core import Tensor
from ..functions import ieee
from .indexing import linear


def _scalar(t: Tensor, value: Column) -> Tensor:
    return Tensor(t.df.agg(value.alias("v")), ())


def _filled(t: Tensor) -> Tensor:
    return t.densify() if t.sparse else t


def total(t: Tensor) -> Tensor:
    return _scalar(t, F.coalesce(F.sum(F.col("v")), F.lit(0.0)))


def product(t: Tensor) -> Tensor:
    """Product of all cells; the zeros of a sparse tensor count."""
    rows = F.count("*")
    value = F.coalesce(F.product(F.col("v")), F.lit(1.0))
    return _scalar(t, F.when(rows < t.size, F.lit(0.0)).otherwise(value) if t.sparse else value)


def any_(t: Tensor) -> Tensor:
    return _scalar(t, F.coalesce(F.bool_or(F.col("v")), F.lit(False)))


def all_(t: Tensor) -> Tensor:
    value = F.coalesce(F.bool_and(F.col("v")), F.lit(True))
    return _scalar(t, value & (F.count("*") == t.size) if t.sparse else value)


def trace(t: Tensor) -> Tensor:
    return Tensor(t.df.where("i0 = i1").agg(F.coalesce(F.sum(F.col("v")), F.lit(0.0)).alias("v")), ())


def _norm_sum(p: float) -> Column:
    return F.coalesce(F.sum(F.col("v") * F.col("v")) if p == 2 else F.sum(F.pow(F.abs(F.col("v")), F.lit(float(p)))), F.lit(0.0))


def norm_powered(t: Tensor, p: float = 2) -> Tensor:
    """Sum of |x| to the power p."""
    return _scalar(t, _norm_sum(p))


def norm(t: Tensor, p: float = 2) -> Tensor:
    return _scalar(t, F.sqrt(_norm_sum(2)) if p == 2 else F.pow(_norm_sum(p), F.lit(1.0 / p)))


frobenius_norm = norm


def normalized(t: Tensor) -> Tensor:
    """t over its norm; a zero tensor gives NaN."""
    n = norm(t).df.select(F.col("v").alias("n"))
    return t.with_(t.df.join(F.broadcast(n)).select(*t.idx, ieee.div(F.col("v"), F.col("n")).alias("v")))


def mean(t: Tensor) -> Tensor:
    """Sum over the number of cells, zeros included."""
    return _scalar(t, ieee.div(F.coalesce(F.sum(F.col("v")), F.lit(0.0)), F.lit(float(t.size))))


def _extreme(t: Tensor, least: bool) -> Tensor:
    """Of the stored cells, and of a zero if a sparse tensor stores fewer than it has."""
    fine = F.when(~F.isnan(F.col("v")), F.col("v"))
    empty = F.lit(1.7976931348623157e308 if least else -1.7976931348623157e308)
    best = F.min(fine) if least else F.max(fine)
    if t.sparse:
        best = F.when(F.count("*") < t.size, F.coalesce((F.least if least else F.greatest)(best, F.lit(0.0)), F.lit(0.0))).otherwise(best)
    return _scalar(t, F.coalesce(best, empty))


def min_coeff(t: Tensor) -> Tensor:
    """Least value; NaN is passed over, and an empty tensor gives the largest double."""
    return _extreme(t, True)


def max_coeff(t: Tensor) -> Tensor:
    return _extreme(t, False)


def extreme_with_index(t: Tensor, least: bool = True):
    """One row (v, i0, ..): the value and its first place in row-major order; NaN is passed over."""
    key = F.col("v") if least else -F.col("v")
    cells = t.df.where(~F.isnan(F.col("v"))).select(key.alias("k"), *t.idx)
    if t.sparse and t.rank:
        cells = cells.unionByName(first_absent(t).select(F.lit(0.0).alias("k"), *t.idx))
    best = cells.agg(F.min(F.struct("k", *t.idx)).alias("m"))
    return best.select(((F.col("m.k") if least else -F.col("m.k")) + F.lit(0.0)).alias("v"), *(F.col(f"m.{c}").alias(c) for c in t.idx))


def first_absent(t: Tensor) -> DataFrame:
    """Indices of the first cell, in row-major order, that a sparse tensor stores no row for (at most one row).

    It is the place 0 or one behind a stored cell, so a join of the stored cells finds it and no grid is made.
    """
    stored = t.df.select(linear(t.shape).alias("at"))
    behind = stored.select((F.col("at") + 1).alias("at")).unionByName(t.spark.range(1).select(F.col("id").alias("at"))).where(F.col("at") < t.size)
    first = behind.join(stored, "at", "left_anti").agg(F.min("at").alias("at")).where("at IS NOT NULL")
    columns, step = [], 1
    for k in reversed(range(t.rank)):
        place = F.expr(f"at div {step}")
        columns.insert(0, (F.pmod(place, F.lit(t.shape[k])) if k else place).cast("long").alias(f"i{k}"))
        step *= t.shape[k]
    return first.select(*columns)


def _with_zeros(agg: Callable, n: int) -> Callable[[Column], Column] | None:
    """An aggregate of stored cells that is that of all n cells of a fiber, by how many are stored; None if there is none."""
    fewer = F.count("*") < n
    by_count = {
        F.max: lambda v: F.when(fewer, F.greatest(F.max(v), F.lit(0.0))).otherwise(F.max(v)),
        F.min: lambda v: F.when(fewer, F.least(F.min(v), F.lit(0.0))).otherwise(F.min(v)),
        F.avg: lambda v: F.sum(v) / n, F.mean: lambda v: F.sum(v) / n,
        F.product: lambda v: F.when(fewer, F.lit(0.0)).otherwise(F.product(v)),
    }
    return agg if agg in ZERO_FREE else by_count.get(agg)


def reduce_dims(t: Tensor, dims: tuple[int, ...], agg: Callable[[Column], Column], filled: bool | None = None) -> Tensor:
    """Any aggregate over some dimensions, zeros of a sparse tensor included.

    Sums, norms, extremes, means and products need stored cells only; any other aggregate of a sparse tensor
    fills zeros in first, unless filled is false: then the caller says that zeros change nothing.
    """
    n = prod(t.shape[k] for k in dims)
    if t.sparse and filled is not False:
        counted = None if filled else _with_zeros(agg, n)
        t, agg = (t.densify(), agg) if counted is None else (t, counted)
    rest = [k for k in range(t.rank) if k not in dims]
    out = t.df.groupBy(*(F.col(f"i{k}").alias(f"i{n}") for n, k in enumerate(rest))).agg(agg(F.col("v")).alias("v"))
    return Tensor(out, tuple(t.shape[k] for k in rest), sparse=t.sparse)


def rowwise(t: Tensor, agg: Callable[[Column], Column]) -> Tensor:
    """A value per row."""
    return reduce_dims(t, (1,), agg)


def colwise(t: Tensor, agg: Callable[[Column], Column]) -> Tensor:
    """A value per column."""
    return reduce_dims(t, (0,), agg)


def l1(v: Column) -> Column:
    return F.sum(F.abs(v))


def l2(v: Column) -> Column:
    return F.sqrt(F.sum(v * v))


#: Aggregates that zeros do not change.
ZERO_FREE = (F.sum, F.bool_or, l1, l2)


def one_norm(t: Tensor) -> Tensor:
    """Largest sum of absolute values of a column."""
    return _scalar(colwise(t, l1), F.coalesce(F.max(F.col("v")), F.lit(0.0)))


def inf_norm(t: Tensor) -> Tensor:
    """Largest sum of absolute values of a row."""
    return _scalar(rowwise(t, l1), F.coalesce(F.max(F.col("v")), F.lit(0.0)))


def normalize_fibers(t: Tensor, axis: int = 0) -> Tensor:
    """Rows (axis 0) or columns (axis 1) over their norms."""
    w = Window.partitionBy(f"i{axis}")
    return t.values(ieee.div(F.col("v"), F.sqrt(F.sum(F.col("v") * F.col("v")).over(w))))


#: Cells of a fiber that is handed to a function as one array: 32 MB.
LONGEST_FIBER = 4_000_000


def scan_fibers(t: Tensor, fn: Callable[[Column, WindowSpec], Column], axis: int = 0, within: int | None = None) -> Tensor:
    """A window expression along each row (axis 0) or column (axis 1): fn(v, window).

    The window runs over a fiber in order, up to each cell; within: over that many cells before it only. No fiber
    is held as an array, so its length has no bound. Zeros of a sparse tensor are filled in.
    """
    outer, inner = f"i{axis}", f"i{1 - axis}"
    window = Window.partitionBy(outer).orderBy(inner).rowsBetween(Window.unboundedPreceding if within is None else -within, Window.currentRow)
    return _filled(t).values(fn(F.col("v"), window))


def transform_fibers(t: Tensor, fn: Callable[[np.ndarray], np.ndarray], axis: int = 0) -> Tensor:
    """fn on each row (axis 0) or column (axis 1) as one array; it must keep the length.

    A fiber of more than LONGEST_FIBER cells is refused, as one task would have to hold it: see scan_fibers.
    """
    outer, inner = f"i{axis}", f"i{1 - axis}"
    n = t.shape[1 - axis]
    if n > LONGEST_FIBER:
        raise ValueError(f"fibers of {n} cells are longer than {LONGEST_FIBER}")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        fiber = np.zeros(n)
        fiber[rows[inner]] = rows["v"]
        out = np.asarray(fn(fiber), float)
        if out.shape != (n,):
            raise ValueError("a transform must keep the fiber's length")
        return pd.DataFrame({outer: rows[outer].iloc[0], inner: np.arange(n), "v": out})

    full = _filled(t)
    return full.with_(full.df.groupBy(outer).applyInPandas(run, f"{outer} long, {inner} long, v double"))

