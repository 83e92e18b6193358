"""Packed rows: many small items of one owner shuffle as byte blobs, one row per target."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.types import StructType

from ._words import U64, mix


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket of 64-bit hashes: n ranges of equal width, in the order of the hashes."""
    return ((h >> U64(32)) * U64(n) >> U64(32)).astype(np.int32)


def home_of(ids: np.ndarray, n: int) -> np.ndarray:
    return bucket_of(mix(ids.astype(np.int64).view(U64) + U64(0x632BE59BD9B4E019)), n)


def deal(target: np.ndarray, n: int, owners: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """For each target that has items: target, owners, items of each owner, and the columns, as bytes."""
    order = np.argsort(target.astype(np.uint16) if n <= 65536 else target, kind="stable")
    cuts = np.searchsorted(target[order], np.arange(n + 1))
    for t in np.flatnonzero(np.diff(cuts)):
        own = order[cuts[t] : cuts[t + 1]]
        mine = owners[own]
        heads = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
        counts = np.diff(heads, append=len(mine)).astype(np.uint32)
        yield int(t), mine[heads].astype(np.int64).tobytes(), counts.tobytes(), *(c[own].tobytes() for c in columns)


def joined(table: pa.Table, name: str, dtype) -> np.ndarray:
    parts = [np.frombuffer(x, dtype) for x in table.column(name).to_pylist() if x]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def owners_of(table: pa.Table) -> np.ndarray:
    """Owner of each item of a dealt table."""
    return np.repeat(joined(table, "owners", np.int64), joined(table, "counts", np.uint32))


def extended(schema: StructType, ddl: str) -> StructType:
    """schema with more fields."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([batch_of(rows, schema)])
