"""Projections of the index space: slices, gathers, permutations, reshapes, broadcasts."""

from __future__ import annotations

from math import prod

from pyspark.sql import functions as F

from ..core import Tensor, grid, index_columns

#: A list of indices up to this long is joined by broadcast: 16 bytes a row.
BROADCAST_INDICES = 100_000


def strided(start: int, size: int, stride: int = 1) -> tuple[int, int, int]:
    """A slice of every stride-th index out of ``size`` from start."""
    if start < 0 or size < 0 or stride < 1:
        raise ValueError("a slice has start and size of 0 or more, and a stride of 1 or more")
    return start, size, stride


def slice_(t: Tensor, *specs) -> Tensor:
    """One spec per dimension: slice(None) for all of it, an int (drops the dimension),
    strided(...), a list of indices in any order, with repeats, or a vector tensor of them."""
    if len(specs) != t.rank:
        raise ValueError(f"{t.rank} specs are needed")
    df, columns, shape = t.df, [], []
    for k, spec in enumerate(specs):
        col, n = F.col(f"i{k}"), t.shape[k]
        if isinstance(spec, slice):
            if spec != slice(None):
                raise ValueError("use strided() for parts")
            columns.append(col)
            shape.append(n)
        elif isinstance(spec, int):
            if not 0 <= spec < n:
                raise IndexError(f"{spec} is outside [0, {n})")
            df = df.where(col == spec)
        elif isinstance(spec, tuple):
            start, size, stride = spec
            if start + size > n:
                raise IndexError(f"[{start}, {start + size}) is outside [0, {n})")
            df = df.where((col >= start) & (col < start + size))
            if stride > 1:
                df = df.where(F.pmod(col - start, F.lit(stride)) == 0)
            columns.append(F.expr(f"(i{k} - {start}) div {stride}"))
            shape.append(1 + (size - 1) // stride if size else 0)
        elif isinstance(spec, Tensor):
            # Indices that come as data are joined; those outside the extent find nothing.
            df = df.join(spec.densify().df.select(F.col("i0").alias(f"g{k}"), F.col("v").cast("long").alias(f"i{k}")), f"i{k}")
            columns.append(F.col(f"g{k}"))
            shape.append(spec.shape[0])
        else:
            at = [int(x) for x in spec]
            if any(not 0 <= x < n for x in at):
                raise IndexError(f"an index is outside [0, {n})")
            new = t.spark.createDataFrame(list(enumerate(at)), f"g{k} long, i{k} long")
            df = df.join(F.broadcast(new) if len(at) <= BROADCAST_INDICES else new, f"i{k}")
            columns.append(F.col(f"g{k}"))
            shape.append(len(at))
    return Tensor(df.select(*(c.alias(f"i{k}") for k, c in enumerate(columns)), "v"), tuple(shape), sparse=t.sparse)


def _axis(t: Tensor, axis: int, spec) -> Tensor:
    return slice_(t, *(spec if k == axis else slice(None) for k in range(t.rank)))


def row(t, i):
    return _axis(t, 0, i)


def col(t, j):
    return _axis(t, 1, j)


def head(t, n, axis=0):
    return _axis(t, axis, strided(0, n))


def tail(t, n, axis=0):
    return _axis(t, axis, strided(t.shape[axis] - n, n))


def segment(t, start, n, axis=0):
    return _axis(t, axis, strided(start, n))


def top_rows(t, n):
    return head(t, n, 0)


def bottom_rows(t, n):
    return tail(t, n, 0)


def left_cols(t, n):
    return head(t, n, 1)


def right_cols(t, n):
    return tail(t, n, 1)


def swizzle(t: Tensor, *order: int | None) -> Tensor:
    """Dimensions in a new order; None inserts one of extent 1."""
    if sorted(k for k in order if k is not None) != list(range(t.rank)):
        raise ValueError("each dimension has to stand once")
    columns = [F.lit(0).cast("long") if k is None else F.col(f"i{k}") for k in order]
    return Tensor(t.df.select(*(c.alias(f"i{n}") for n, c in enumerate(columns)), "v"), tuple(1 if k is None else t.shape[k] for k in order), sparse=t.sparse)


def transpose(t: Tensor) -> Tensor:
    return swizzle(t, 1, 0)


def anti_slice(t: Tensor, *dims: int) -> Tensor:
    """Dimensions of extent 1 put in at the places given."""
    rest = iter(range(t.rank))
    return swizzle(t, *(None if k in dims else next(rest) for k in range(t.rank + len(dims))))


def linear(shape: tuple, prefix: str = "i"):
    """Row-major place of a cell."""
    place = F.lit(0).cast("long")
    for k, n in enumerate(shape):
        place = place * F.lit(n) + F.col(f"{prefix}{k}")
    return place


def reshape(t: Tensor, *shape: int) -> Tensor:
    """The same cells in row-major order under another shape."""
    if t.size != prod(shape):
        raise ValueError(f"{t.shape} has not as many cells as {shape}")
    df = t.df.select(linear(t.shape).alias("at"), "v")
    columns, step = [], 1
    for k in reversed(range(len(shape))):
        place = F.expr(f"at div {max(step, 1)}")
        columns.insert(0, (F.pmod(place, F.lit(max(shape[k], 1))) if k else place).alias(f"i{k}"))
        step *= shape[k]
    return Tensor(df.select(*columns, "v"), shape, sparse=t.sparse)


def repeat_left(t: Tensor, count: int = 1) -> Tensor:
    """Broadcast dimensions in front; they take the extent of what they are combined with."""
    columns = [F.lit(0).cast("long").alias(f"i{k}") for k in range(count)]
    return Tensor(t.df.select(*columns, *(F.col(f"i{k}").alias(f"i{k + count}") for k in range(t.rank)), "v"), (*[None] * count, *t.shape), sparse=t.sparse)


def repeat_right(t: Tensor, count: int = 1) -> Tensor:
    columns = [F.lit(0).cast("long").alias(f"i{t.rank + k}") for k in range(count)]
    return Tensor(t.df.select(*t.idx, *columns, "v"), (*t.shape, *[None] * count), sparse=t.sparse)


lift = repeat_right


def resolve(t: Tensor, shape: tuple) -> Tensor:
    """Broadcast dimensions written out to a bounded shape."""
    df = t.df
    for k, (have, want) in enumerate(zip(t.shape, shape, strict=True)):
        if have is None:
            df = df.withColumn(f"i{k}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(want - 1).cast("long")))) if want else df.where("false")
        elif have != want:
            raise ValueError(f"{t.shape} does not fit {shape}")
    return Tensor(df, shape, sparse=t.sparse)


def homogeneous(t: Tensor, mode: str = "position") -> Tensor:
    """A last row more: 1 for positions, 0 for vectors, the unit row for affine matrices."""
    n = t.shape[0]
    if mode == "affine":
        last = t.spark.range(1).select(F.lit(n).cast("long").alias("i0"), F.lit(t.shape[1] - 1).cast("long").alias("i1"), F.lit(1.0).alias("v"))
        return Tensor(t.df.unionByName(last), (n + 1, *t.shape[1:]), sparse=True)
    value = {"position": 1.0, "vector": 0.0}[mode]
    rest = t.shape[1:]
    last = (grid(t.spark, rest).select(F.lit(n).cast("long").alias("i0"), *(F.col(f"i{k}").alias(f"i{k + 1}") for k in range(len(rest)))) if rest else t.spark.range(1).select(F.lit(n).cast("long").alias("i0"))).withColumn("v", F.lit(value))
    return Tensor(t.df.unionByName(last), (n + 1, *rest), sparse=t.sparse)


def diagonal(t: Tensor) -> Tensor:
    """Cells of equal indices, up to the least extent; zeros of a sparse tensor stay out."""
    same = " AND ".join(f"i0 = i{k}" for k in range(1, t.rank)) or "true"
    return Tensor(t.df.where(same).select("i0", "v"), (min(t.shape),), sparse=t.sparse)


def diagonal_embed(t: Tensor) -> Tensor:
    return Tensor(t.df.select("i0", F.col("i0").alias("i1"), "v"), (t.shape[0],) * 2, sparse=True)


def with_slice(t: Tensor, part: Tensor, *starts: int) -> Tensor:
    """t with a block, of part's shape, replaced by part's cells."""
    if len(starts) != t.rank or any(s < 0 or s + n > m for s, n, m in zip(starts, part.shape, t.shape, strict=True)):
        raise IndexError("the block is outside the tensor")
    inside = F.lit(True)
    for k, (s, n) in enumerate(zip(starts, part.shape, strict=True)):
        inside = inside & (F.col(f"i{k}") >= s) & (F.col(f"i{k}") < s + n)
    moved = part.df.select(*((F.col(c) + s).alias(c) for c, s in zip(index_columns(t.rank), starts, strict=True)), "v")
    return t.with_(t.df.where(~inside).unionByName(moved), sparse=t.sparse or part.sparse)


def fill(t: Tensor, value: float) -> Tensor:
    """The same shape with one value everywhere."""
    return Tensor(grid(t.spark, t.shape).withColumn("v", F.lit(float(value))), t.shape, t.kind) if value else t.with_(t.df.where("false"), sparse=True)


def resize(t: Tensor, *shape: int) -> Tensor:
    """Another shape of the same rank: cells outside it go, new ones are zeros."""
    if len(shape) != t.rank:
        raise ValueError("the rank stays")
    inside = F.lit(True)
    for k, n in enumerate(shape):
        inside = inside & (F.col(f"i{k}") < n)
    grown = any(m is not None and n > m for m, n in zip(t.shape, shape, strict=True))
    return t.with_(t.df.where(inside), shape, sparse=t.sparse or grown)


def coefficients(t: Tensor, places) -> Tensor:
    """Values at a frame of places (k, i0, ..): a vector by k; 0 where a sparse tensor has no row."""
    found = places.join(t.df, t.idx, "left").select(F.col("k").cast("long").alias("i0"), F.coalesce("v", F.lit(0.0)).alias("v"))
    return Tensor(found, (places.count(),))
