"""Coefficient-wise arithmetic, comparisons, masks and selection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..core import Tensor, same_shape
from ..functions import ieee
from .indexing import resolve

OPS: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": ieee.div, "mod": ieee.mod,
    "min": lambda a, b: F.when(ieee.less(b, a), b).otherwise(a), "max": lambda a, b: F.when(ieee.less(a, b), b).otherwise(a),
    "and": lambda a, b: a.cast("long").bitwiseAND(b.cast("long")), "or": lambda a, b: a.cast("long").bitwiseOR(b.cast("long")), "xor": lambda a, b: a.cast("long").bitwiseXOR(b.cast("long")),
    "eq": ieee.equal, "ne": lambda a, b: ~ieee.equal(a, b), "lt": ieee.less, "le": lambda a, b: ieee.less(a, b) | ieee.equal(a, b), "gt": lambda a, b: ieee.less(b, a), "ge": lambda a, b: ieee.less(b, a) | ieee.equal(a, b),
    "spaceship": ieee.spaceship, "logical_and": lambda a, b: a & b, "logical_or": lambda a, b: a | b,
}


#: Operators that are 0 (or false) at (0, 0): of two sparse operands only stored cells matter.
ZERO_KEEPING = {"min", "max", "and", "or", "xor", "ne", "lt", "gt", "spaceship", "logical_and", "logical_or"}


def _zero(t: Tensor) -> Column:
    return F.lit(0).cast(dict(t.df.dtypes)["v"])


def _pairs(a: Tensor, b: Tensor, how: str = "inner"):
    """Rows of both side by side, joined on their bounded dimensions."""
    shape = same_shape(a, b)
    a, b = (x if x.shape == shape else resolve(x, shape) if x.shape.count(None) == x.rank else x for x in (a, b))
    on = [f"i{k}" for k in range(len(shape)) if a.shape[k] is not None and b.shape[k] is not None]
    left = a.df.select(*(f"i{k}" for k in range(len(shape)) if a.shape[k] is not None), F.col("v").alias("va"))
    right = b.df.select(*(f"i{k}" for k in range(len(shape)) if b.shape[k] is not None), F.col("v").alias("vb"))
    return left.join(right, on, how), shape


def combine(op: str | Callable, a: Tensor | float, b: Tensor | float) -> Tensor:
    """op on each pair of cells; numbers and tensors of rank 0 go with every cell.

    Sparse operands: sums and differences union the rows; products keep common rows; operators that keep zeros
    join all stored cells; with a dense operand its rows are all there is; everything else fills zeros in first.
    """
    fn = OPS[op] if isinstance(op, str) else op
    for x, other, left in ((a, b, True), (b, a, False)):
        if not isinstance(x, Tensor):
            keeps = op == "mul" or (op == "div" and not left)
            t = other if keeps or not other.sparse else other.densify()
            value = F.lit(x)
            return t.values(fn(value, F.col("v")) if left else fn(F.col("v"), value))
    for x, other, left in ((a, b, True), (b, a, False)):
        if x.rank == 0 and other.rank:
            t = other.densify() if not (op == "mul" or (op == "div" and not left)) else other
            one = x.densify().df.select(F.col("v").alias("s"))
            # One row: its broadcast is bounded.
            df = t.df.join(F.broadcast(one))
            value = fn(F.col("s"), F.col("v")) if left else fn(F.col("v"), F.col("s"))
            return t.with_(df.select(*t.idx, value.alias("v")))
    if op in ("add", "sub") and (a.sparse and b.sparse):
        shape = same_shape(a, b)
        a, b = resolve(a, shape), resolve(b, shape)
        other = b.df.withColumn("v", -F.col("v")) if op == "sub" else b.df
        return Tensor(a.df.unionByName(other), shape, a.kind, True).compress()
    if op == "mul" and (a.sparse or b.sparse):
        both, shape = _pairs(a, b)
        return Tensor(both.withColumn("v", F.col("va") * F.col("vb")), shape, a.kind, True)
    if None in (*a.shape, *b.shape):
        a, b = (x if None in x.shape else x.densify() for x in (a, b))
        both, shape = _pairs(a, b)
        return Tensor(both.withColumn("v", fn(F.col("va"), F.col("vb"))), shape, a.kind)
    keeps = a.sparse and b.sparse and op in ZERO_KEEPING
    if a.sparse and b.sparse and not keeps:
        a = a.densify()
    how = "full_outer" if keeps else "left" if b.sparse else "right" if a.sparse else "inner"
    zeros = _zero(a), _zero(b)
    both, shape = _pairs(a, b, how)
    return Tensor(both.withColumn("v", fn(*(F.coalesce(c, z) for c, z in zip(("va", "vb"), zeros, strict=True)))), shape, a.kind, keeps)


def negate(t: Tensor) -> Tensor:
    return t.values(-F.col("v"))


def math(t: Tensor, name: str) -> Tensor:
    """A function of ieee.MATH on each cell; zeros are filled in unless it keeps them."""
    t = t if name in ieee.ZERO_PRESERVING else t.densify()
    return t.values(ieee.MATH[name](F.col("v")))


def power(t: Tensor, p: float) -> Tensor:
    return t.densify().values(F.pow(F.col("v"), F.lit(float(p))))


def unary_expr(t: Tensor, fn: Callable[[Column], Column], keeps_zero: bool = False) -> Tensor:
    """Any function of a column on each cell."""
    return (t if keeps_zero else t.densify()).values(fn(F.col("v")))


def bit_not(t: Tensor) -> Tensor:
    return t.densify().values(F.bitwise_not(F.col("v").cast("long")))


def logical_not(t: Tensor) -> Tensor:
    return t.densify().values(~F.col("v"))


def equals(a: Tensor, b: Tensor) -> bool:
    """Whole tensors alike, exactly; rows that one lacks are zeros."""
    if a.shape != b.shape:
        return False
    both = a.df.select(*a.idx, F.col("v").alias("va")).join(b.df.select(*b.idx, F.col("v").alias("vb")), a.idx, "full_outer") if a.rank else a.densify().df.select(F.col("v").alias("va")).join(b.densify().df.select(F.col("v").alias("vb")))
    same = ieee.equal(F.coalesce("va", _zero(a)), F.coalesce("vb", _zero(b)))
    return both.where(~same).isEmpty()


def select(mask: Tensor, yes: Tensor, no: Tensor) -> Tensor:
    """yes where mask holds, no elsewhere."""
    m = mask.densify().df.withColumnRenamed("v", "m")
    a, b = (x.densify().df.withColumnRenamed("v", c) for x, c in ((yes, "a"), (no, "b")))
    df = m.join(a, mask.idx).join(b, mask.idx)
    return yes.with_(df.select(*mask.idx, F.when(F.col("m"), F.col("a")).otherwise(F.col("b")).alias("v")), sparse=False)


def select_order(order: Tensor, lt: Tensor, eq: Tensor, gt: Tensor) -> Tensor:
    """By the sign of order: lt, eq, or gt, which unordered cells (NULL) take too."""
    df = order.densify().df.withColumnRenamed("v", "o")
    for t, c in ((lt, "a"), (eq, "b"), (gt, "c")):
        df = df.join(t.densify().df.withColumnRenamed("v", c), order.idx)
    return lt.with_(df.select(*order.idx, F.when(F.col("o") < 0, F.col("a")).when(F.col("o") == 0, F.col("b")).otherwise(F.col("c")).alias("v")), sparse=False)


_TRIANGLES = {"lower": "i0 >= i1", "upper": "i0 <= i1", "unit_lower": "i0 > i1", "unit_upper": "i0 < i1", "strictly_lower": "i0 > i1", "strictly_upper": "i0 < i1", "off_diagonal": "i0 <> i1"}


def triangular(t: Tensor, mode: str) -> Tensor:
    """The part of a matrix a mode leaves; unit modes put 1 on the diagonal."""
    part = t.df.where(_TRIANGLES[mode])
    if mode.startswith("unit"):
        ones = t.spark.range(min(t.shape)).select(F.col("id").alias("i0"), F.col("id").alias("i1"), F.lit(1.0).alias("v"))
        part = part.unionByName(ones)
    return t.with_(part, sparse=True)
