"""Where tensors come from and go to: literals, ranges, triplets, packed columns, Parquet."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import Tensor, grid, index_columns


def constant(spark: SparkSession, value: float, shape: tuple) -> Tensor:
    return Tensor(grid(spark, shape).withColumn("v", F.lit(float(value))), shape) if shape else scalar(spark, value)


def scalar(spark: SparkSession, value: float) -> Tensor:
    """Rank 0: combines with any shape."""
    return Tensor(spark.range(1).select(F.lit(float(value)).alias("v")), ())


def zeros(spark: SparkSession, shape: tuple) -> Tensor:
    """No rows at all."""
    fields = [T.StructField(c, T.LongType(), False) for c in index_columns(len(shape))]
    return Tensor(spark.createDataFrame([], T.StructType([*fields, T.StructField("v", T.DoubleType())])), shape, sparse=True)


def ones(spark: SparkSession, shape: tuple) -> Tensor:
    return constant(spark, 1.0, shape)


def identity(spark: SparkSession, shape: tuple | int) -> Tensor:
    """1 where all indices are equal; of rank 1, 1 at index 0 only."""
    shape = (shape, shape) if isinstance(shape, int) else tuple(shape)
    n = min(shape) if len(shape) > 1 else min(1, shape[0])
    return Tensor(spark.range(n).select(*(F.col("id").alias(c) for c in index_columns(len(shape))), F.lit(1.0).alias("v")), shape, sparse=True)


def unit(spark: SparkSession, n: int, at: int) -> Tensor:
    if not 0 <= at < n:
        raise IndexError(f"{at} is outside [0, {n})")
    return Tensor(spark.range(at, at + 1).select(F.col("id").alias("i0"), F.lit(1.0).alias("v")), (n,), sparse=True)


def iota(spark: SparkSession, shape: tuple | int, axis: int = 0, start: float = 0.0) -> Tensor:
    """start plus the index along axis."""
    shape = (shape,) if isinstance(shape, int) else tuple(shape)
    return Tensor(grid(spark, shape).withColumn("v", F.col(f"i{axis}").cast("double") + F.lit(float(start))), shape)


def linear_space(spark: SparkSession, start: float, stop: float, n: int) -> Tensor:
    """n values from start to stop, both included; of one value the step is not a number."""
    step = (stop - start) / (n - 1) if n > 1 else float("nan")
    return iota(spark, n).values(F.lit(float(start)) + F.col("v") * F.lit(step))


def random(spark: SparkSession, shape: tuple, seed: int, distribution: str = "uniform", low: float = 0.0, high: float = 1.0) -> Tensor:
    """Random values that depend on seed and index alone, so that every read has the same ones.

    uniform: [low, high); normal: mean low, deviation high; integer: low to high, both included.
    """
    bits = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *index_columns(len(shape))), F.lit(1 << 53)) / F.lit(float(1 << 53))
    u = bits(0)
    if distribution == "uniform":
        value = low + u * (high - low)
    elif distribution == "normal":
        value = low + high * F.sqrt(-2 * F.ln(1 - u)) * F.cos(bits(1) * 6.283185307179586)
    elif distribution == "integer":
        value = F.floor(low + u * (high - low + 1)).cast("double")
    else:
        raise ValueError(f"unknown distribution {distribution}")
    return Tensor(grid(spark, shape).withColumn("v", value), shape)


def random_column(seed: int, distribution: str = "uniform", *, by: list[str] | None = None) -> Column:
    """An unbounded random source: a value for each row it is put beside.

    by: columns that name a row; the value then depends on them and the seed alone. Without them
    it follows partitions, and another plan gives other values.
    """
    if not by:
        return {"uniform": F.rand, "normal": F.randn}[distribution](seed)
    u, w = (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *by), F.lit(1 << 53)) / F.lit(float(1 << 53)) for salt in (0, 1))
    return u if distribution == "uniform" else F.sqrt(-2 * F.ln(1 - u)) * F.cos(w * 6.283185307179586)


def from_rows(df: DataFrame, indices: list[str], value: str | Column, shape: tuple, kind: str | None = None) -> Tensor:
    """Sparse tensor of triplets: duplicates are summed, rows of null index or value left out."""
    value = F.col(value) if isinstance(value, str) else value
    named = df.select(*(F.col(c).cast("long").alias(f"i{k}") for k, c in enumerate(indices)), value.cast("double").alias("v"))
    return Tensor(named.dropna(), shape, kind, sparse=True).compress()


def from_values(spark: SparkSession, nested) -> Tensor:
    """Dense tensor of nested Python lists (small)."""
    shape, level = [], nested
    while isinstance(level, (list, tuple)):
        shape.append(len(level))
        level = level[0] if level else 0.0

    def cells(part, at):
        if len(at) == len(shape):
            yield (*at, float(part))
        else:
            if len(part) != shape[len(at)]:
                raise ValueError("rows of different lengths")
            for k, x in enumerate(part):
                yield from cells(x, (*at, k))

    ddl = ", ".join([*(f"i{k} long" for k in range(len(shape))), "v double"])
    return Tensor(spark.createDataFrame(list(cells(nested, ())), ddl), tuple(shape))


def from_packed(df: DataFrame, row: str, vector: str, n_rows: int, width: int) -> Tensor:
    """Dense matrix of a packed column: a row of the matrix per row."""
    out = df.select(F.col(row).cast("long").alias("i0"), F.posexplode(F.col(vector).cast("array<double>")).alias("p", "v"))
    return Tensor(out.select("i0", F.col("p").cast("long").alias("i1"), "v"), (n_rows, width))


def from_diagonal(t: Tensor) -> Tensor:
    """Sparse square matrix with a vector on its diagonal."""
    return Tensor(t.df.select("i0", F.col("i0").alias("i1"), "v"), (t.shape[0], t.shape[0]), sparse=True)


def read_parquet(spark: SparkSession, path: str, shape: tuple, sparse: bool = True) -> Tensor:
    return Tensor(spark.read.parquet(path), shape, sparse=sparse)


def write_parquet(t: Tensor, path: str, layout: str = "row") -> None:
    """Rows by leading index (row) or by last index (column), sorted within files."""
    order = t.idx if layout == "row" else t.idx[::-1]
    t.df.repartitionByRange(*order[:1]).sortWithinPartitions(*order).write.parquet(path)


def compressed(t: Tensor, layout: str = "row") -> DataFrame:
    """Compressed fibers: outer index, and its sorted inner indices and values as arrays."""
    outer, inner = ("i0", "i1") if layout == "row" else ("i1", "i0")
    pairs = F.array_sort(F.collect_list(F.struct(F.col(inner).alias("at"), "v")))
    return t.compress().df.groupBy(F.col(outer).alias("outer")).agg(pairs.alias("p")).select("outer", F.col("p.at").alias("indices"), F.col("p.v").alias("values"))


def to_packed(t: Tensor) -> DataFrame:
    """A row (i0, vector) per row of a matrix, zeros filled in; a row has to fit one task."""
    pairs = F.array_sort(F.collect_list(F.struct("i1", "v")))
    return t.densify().df.groupBy("i0").agg(pairs.alias("p")).select("i0", F.col("p.v").alias("vector"))


def to_numpy(t: Tensor, most: int = 4_000_000) -> np.ndarray:
    """A tensor of at most ``most`` cells on the driver, for the dense kernels."""
    if t.size > most:
        raise ValueError(f"{t.size} cells are more than {most}")
    out = np.zeros(t.shape)
    rows = t.df.toPandas()
    out[tuple(rows[c].to_numpy() for c in t.idx)] = rows["v"]
    return out


def from_numpy(spark: SparkSession, a: np.ndarray) -> Tensor:
    """Dense tensor of an array on the driver."""
    a = np.asarray(a, float)
    columns = {f"i{k}": x.ravel() for k, x in enumerate(np.indices(a.shape))}
    return Tensor(spark.createDataFrame(pd.DataFrame({**columns, "v": a.ravel()})), a.shape)


def multigrid_sizes(n: int, levels: int) -> list[int]:
    """Sizes of a one-dimensional grid hierarchy: half of what lies between the ends."""
    out = [n]
    while len(out) < levels and (out[-1] - 1) // 2 >= 1:
        out.append((out[-1] - 1) // 2)
    return out


def to_local(t: Tensor) -> Iterable:
    """Rows one after another, in row-major order."""
    return (t.df.orderBy(*t.idx) if t.rank else t.df).toLocalIterator()
