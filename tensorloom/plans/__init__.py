"""Plans over several operators: order of a chain of products, Gram matrices and cosines of packed rows."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import Tensor
from ..operators.products import matmul


def chain_order(dims: tuple[int, ...]):
    """Nested pairs of factor numbers with the fewest multiplications for factors of dims[k] x dims[k+1]."""

    @lru_cache(None)
    def best(a: int, b: int):
        if a == b:
            return 0, a
        options = []
        for cut in range(a, b):
            left, right = best(a, cut), best(cut + 1, b)
            options.append((left[0] + right[0] + dims[a] * dims[cut + 1] * dims[b + 1], (left[1], right[1])))
        return min(options, key=lambda o: o[0])

    return best(0, len(dims) - 2)[1]


def chain(*factors: Tensor) -> Tensor:
    """Product of matrices, in the order that multiplies least."""
    dims = tuple([factors[0].shape[0], *(f.shape[1] for f in factors)])

    def build(node):
        return factors[node] if isinstance(node, int) else matmul(build(node[0]), build(node[1]))

    return build(chain_order(dims))


def gram_packed(df: DataFrame, vector: str, width: int) -> Tensor:
    """Transpose of a tall matrix times itself, from packed rows.

    Each task multiplies its rows in one dense product and sends width * width sums,
    whatever the number of rows: the shuffle does not grow with the data but with the tasks.
    """

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            column = batch.column("x")
            x = np.asarray(column.flatten(), float).reshape(-1, width)
            total += x.T @ x
        i, j = np.indices(total.shape)
        yield pa.record_batch({"i0": pa.array(i.ravel()), "i1": pa.array(j.ravel()), "v": pa.array(total.ravel())})

    rows = df.select(F.col(vector).cast("array<double>").alias("x")).where("x IS NOT NULL")
    parts = rows.mapInArrow(run, "i0 long, i1 long, v double")
    return Tensor(parts.groupBy("i0", "i1").agg(F.sum("v").alias("v")), (width, width))


#: Rows in one block of vectors.
BLOCK_ROWS = 512


def _blocks(width: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                keys = part.column("key").to_numpy(zero_copy_only=False)
                x = np.asarray(part.column("x").flatten(), float).reshape(-1, width)
                yield pa.record_batch({"keys": pa.array([keys.tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary())})

    return run


def cosine_search(df: DataFrame, key: str, vector: str, width: int, queries: Column, least: float) -> DataFrame:
    """Rows (q, key, v): cosine v of each query, a row of df that meets the condition queries, with every row, where it is least or more.

    Both sides go in blocks of rows, every pair of blocks is one dense product, and no side has
    to fit in memory. Rows of null key or vector are left out; the cosine of a zero vector is no number.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("x"), queries.alias("asked")).where("key IS NOT NULL AND x IS NOT NULL")
    packed = lambda part: part.select("key", "x").mapInArrow(_blocks(width), "keys binary, x binary")

    def run(batches):
        for batch in batches:
            for keys, x, asked, f in zip(*(batch.column(c) for c in ("keys", "x", "asked", "f")), strict=True):
                keys, asked = (np.frombuffer(b.as_py(), np.int64) for b in (keys, asked))
                x, f = (np.frombuffer(b.as_py(), float).reshape(-1, width) for b in (x, f))
                norm = lambda m: np.sqrt((m * m).sum(axis=1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    cosine = (f @ x.T) / (norm(f)[:, None] * norm(x))
                    i, j = np.nonzero(cosine >= least)
                yield pa.record_batch({"q": pa.array(asked[i]), key: pa.array(keys[j]), "v": pa.array(cosine[i, j])})

    pairs = packed(rows).crossJoin(packed(rows.where("asked")).toDF("asked", "f"))
    return pairs.mapInArrow(run, f"q long, {key} long, v double")
