"""Vectors packed in ARRAY<DOUBLE> columns, one per row: all of it inside JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import ieee


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def zip_with(a: Column, b: Column, fn) -> Column:
    return F.zip_with(a, b, fn)


def add(a, b):
    return F.zip_with(a, b, lambda x, y: x + y)


def sub(a, b):
    return F.zip_with(a, b, lambda x, y: x - y)


def mul(a, b):
    return F.zip_with(a, b, lambda x, y: x * y)


def div(a, b):
    return F.zip_with(a, b, ieee.div)


def scale(a, s):
    return F.transform(a, lambda x: x * s)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda n, x: n + x)


def dot(a: Column, b: Column) -> Column:
    return total(mul(a, b))


def norm_powered(a: Column, p: float) -> Column:
    """Sum of |x| to the power p."""
    return total(F.transform(a, lambda x: F.pow(F.abs(x), F.lit(float(p)))))


def norm(a: Column, p: float = 2) -> Column:
    return F.sqrt(dot(a, a)) if p == 2 else F.pow(norm_powered(a, p), F.lit(1.0 / p))


def normalized(a: Column) -> Column:
    """a over its norm; the zero vector gives NaN."""
    n = norm(a)
    return F.transform(a, lambda x: ieee.div(x, n))


def cross(a: Column, b: Column) -> Column:
    at = lambda c, k: F.get(c, F.lit(k))
    return F.array(*(at(a, i) * at(b, j) - at(a, j) * at(b, i) for i, j in ((1, 2), (2, 0), (0, 1))))


def segment(a: Column, start: int, size: int) -> Column:
    if start < 0 or size < 0:
        raise ValueError("indices are not negative")
    return F.slice(a, start + 1, size)


def head(a: Column, size: int) -> Column:
    return segment(a, 0, size)


def tail(a: Column, size: int) -> Column:
    return F.slice(a, F.size(a) - size + 1, F.lit(size)) if size else F.slice(a, 1, 0)


def strided(a: Column, start: int, size: int, stride: int) -> Column:
    return F.filter(segment(a, start, size), lambda x, k: k % stride == 0)


def gather(a: Column, at: list[int]) -> Column:
    if any(k < 0 for k in at):
        raise ValueError("indices are not negative")
    return F.array(*(F.element_at(a, k + 1) for k in at))


def homogeneous(a: Column, mode: str = "position") -> Column:
    """With a last component: 1 for positions, 0 for vectors."""
    return F.concat(a, F.array(F.lit({"position": 1.0, "vector": 0.0}[mode])))


def math(a: Column, name: str) -> Column:
    return F.transform(a, ieee.MATH[name])


def equal(a: Column, b: Column) -> Column:
    """Whole vectors alike, exactly; NaN is like nothing."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, ieee.equal), lambda x: F.coalesce(x, F.lit(False)))


def compare(a: Column, b: Column) -> Column:
    """Order by length, then lexicographically: -1, 0, 1."""
    return F.when(F.size(a) != F.size(b), F.signum(F.size(a) - F.size(b))).when(a < b, -1).when(a == b, 0).otherwise(1).cast("tinyint")
