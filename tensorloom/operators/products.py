"""Products: equi-joins on shared indices, then sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import Tensor
from .arithmetic import combine


def _renamed(t: Tensor, names: list[str], value: str):
    return t.df.select(*(F.col(f"i{k}").alias(n) for k, n in enumerate(names)), F.col("v").alias(value))


def _result(df, names: list[str], shape: tuple, kind=None) -> Tensor:
    return Tensor(df.select(*(F.col(n).alias(f"i{k}") for k, n in enumerate(names)), "v"), shape, kind, sparse=True)


def matmul(a: Tensor, b: Tensor, chunk: int | None = None) -> Tensor:
    """Sum over the last index of a and the first of b; exact zeros are left out of sparse results.

    The join's products are summed on the map side before the shuffle on (row, column). With chunk, the
    entries of b under one index are dealt to chunks of about that many, and the entries of a under it go to each:
    an index that a large part of all entries share is then many tasks' work.
    """
    if a.shape[-1] != b.shape[0]:
        raise ValueError(f"shapes {a.shape} and {b.shape} do not agree")
    left = [f"l{k}" for k in range(a.rank - 1)]
    right = [f"r{k}" for k in range(1, b.rank)]
    one, two, on = _renamed(a, [*left, "k"], "va"), _renamed(b, ["k", *right], "vb"), ["k"]
    if chunk and right:
        chunks = two.groupBy("k").agg(F.ceil(F.count("*") / chunk).cast("int").alias("c"))
        one = one.join(chunks, "k").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("c") - 1))).drop("c")
        two = two.join(chunks, "k").withColumn("part", F.pmod(F.xxhash64(*right), F.col("c")).cast("int")).drop("c")
        on = ["k", "part"]
    pairs = one.join(two, on)
    names = [*left, *right]
    out = pairs.groupBy(*names).agg(F.sum(F.col("va") * F.col("vb")).alias("v")) if names else pairs.agg(F.coalesce(F.sum(F.col("va") * F.col("vb")), F.lit(0.0)).alias("v"))
    result = _result(out, names, (*a.shape[:-1], *b.shape[1:]))
    return result.prune() if a.sparse and b.sparse and names else result.with_(sparse=bool(names))


def dot(a: Tensor, b: Tensor) -> Tensor:
    return matmul(a, b)


def gram(a: Tensor) -> Tensor:
    """Columns against columns: the transpose of a times a."""
    return matmul(Tensor(a.df.select(F.col("i1").alias("i0"), F.col("i0").alias("i1"), "v"), a.shape[::-1], sparse=a.sparse), a)


def cross(a: Tensor, b: Tensor) -> Tensor:
    """Of vectors of 3: pairs of different indices, signed, summed by the third."""
    pairs = _renamed(a, ["p"], "va").join(_renamed(b, ["q"], "vb"), F.col("p") != F.col("q"))
    sign = F.when(F.pmod(F.col("q") - F.col("p"), F.lit(3)) == 1, 1.0).otherwise(-1.0)
    out = pairs.groupBy((3 - F.col("p") - F.col("q")).alias("i0")).agg(F.sum(sign * F.col("va") * F.col("vb")).alias("v"))
    return Tensor(out, (3,), "vector", sparse=True)


def outer(a: Tensor, b: Tensor) -> Tensor:
    """All products of a cell of a and a cell of b: as many rows as the result has cells."""
    left, right = [f"l{k}" for k in range(a.rank)], [f"r{k}" for k in range(b.rank)]
    both = _renamed(a, left, "va").join(_renamed(b, right, "vb"))
    out = both.withColumn("v", F.col("va") * F.col("vb"))
    return _result(out, [*left, *right], (*a.shape, *b.shape), "tensor" if a.rank + b.rank > 2 else None).with_(sparse=a.sparse or b.sparse)


tensor_product = outer


def form_times(f: Tensor, x: Tensor) -> Tensor:
    """A form on a vector (a number), a matrix (a form) or a tensor: sums over one index pair."""
    out = matmul(f, x)
    return out.as_kind("form") if out.rank == 1 else out


def diagonal_pairing(f: Tensor, x: Tensor) -> Tensor:
    """Sum of f(i, .., i) x(i, .., i, rest): one index for all paired dimensions."""
    from .indexing import diagonal

    rest = list(range(f.rank, x.rank))
    same = " AND ".join(f"i0 = i{k}" for k in range(1, f.rank)) or "true"
    right = x.df.where(same).select(F.col("i0").alias("k"), *(F.col(f"i{k}").alias(f"r{k}") for k in rest), F.col("v").alias("vb"))
    pairs = diagonal(f).df.select(F.col("i0").alias("k"), F.col("v").alias("va")).join(right, "k")
    product = F.sum(F.col("va") * F.col("vb"))
    names = [f"r{k}" for k in rest]
    out = pairs.groupBy(*names).agg(product.alias("v")) if names else pairs.agg(F.coalesce(product, F.lit(0.0)).alias("v"))
    return _result(out, names, tuple(x.shape[k] for k in rest))


def wedge(a: Tensor, b: Tensor) -> Tensor:
    """a(I) b(J) minus the same with the index blocks swapped."""
    forward = outer(a, b)
    blocks = [*range(a.rank, a.rank + b.rank), *range(a.rank)] if a.shape == b.shape else None
    if blocks is None:
        raise ValueError("the wedge of forms of different shapes is not defined")
    swapped = Tensor(forward.df.select(*(F.col(f"i{k}").alias(f"i{n}") for n, k in enumerate(blocks)), "v"), forward.shape, sparse=True)
    return combine("sub", forward.with_(sparse=True), swapped)


def contract(t: Tensor, *dims: int) -> Tensor:
    """Trace over dimensions, two or more: sums of the cells whose indices there are all alike."""
    if len(dims) < 2 or len(set(dims)) < len(dims) or len({t.shape[k] for k in dims}) > 1:
        raise ValueError("two dimensions or more, all different and of one extent, are needed")
    rest = [k for k in range(t.rank) if k not in dims]
    same = t.df.where(" AND ".join(f"i{dims[0]} = i{k}" for k in dims[1:]))
    names = [f"i{k}" for k in rest]
    out = same.groupBy(*names).agg(F.sum("v").alias("v")) if rest else same.agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))
    return _result(out, names, tuple(t.shape[k] for k in rest))


def full_contract(t: Tensor) -> Tensor:
    """Number left when index m is paired with index rank - 1 - m."""
    if t.rank % 2:
        raise ValueError("only an even rank can be contracted in full")
    same = F.lit(True)
    for m in range(t.rank // 2):
        same = same & (F.col(f"i{m}") == F.col(f"i{t.rank - 1 - m}"))
    return Tensor(t.df.where(same).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v")), ())


def hamilton(a: Tensor, b: Tensor) -> Tensor:
    """Product of quaternions, scalar first: unit products are signed units, 16 in all."""
    units = []
    for i in range(4):
        for j in range(4):
            if i == 0 or j == 0:
                units.append((i, j, i + j, 1.0))
            elif i == j:
                units.append((i, j, 0, -1.0))
            else:
                units.append((i, j, 6 - i - j, 1.0 if (j - i) % 3 == 1 else -1.0))
    table = F.broadcast(a.spark.createDataFrame(units, "p long, q long, i0 long, sign double"))
    pairs = table.join(_renamed(a, ["p"], "va"), "p").join(_renamed(b, ["q"], "vb"), "q")
    return Tensor(pairs.groupBy("i0").agg(F.sum(F.col("sign") * F.col("va") * F.col("vb")).alias("v")), (4,), "quaternion", sparse=True)
