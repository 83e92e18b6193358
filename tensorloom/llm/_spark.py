"""Shared Spark plumbing: tables that cut lineage, connected components, Arrow slices."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a new local one where none is set and executors are threads (tests).

    Elsewhere a missing setting is an error: no other machine could read a local folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tensorloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Rows of an Arrow batch where the session sets none: documents are kilobytes each.
BATCH_ROWS = 2000


def text_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small, unless the session says how large they are."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_ROWS))


class Workspace:
    """Intermediate tables of one run, under the shared folder.

    A written table cuts lineage, so a lost executor costs a re-read and not a
    recomputation. Tables go when they are dropped, or when the JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        text_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._made = 0
        jvm_path = self._jvm_path(self.root)
        jvm_path.getFileSystem(self._conf()).deleteOnExit(jvm_path)

    def _conf(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def _jvm_path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def table(self, df: DataFrame) -> DataFrame:
        self._made += 1
        path = f"{self.root}/{self._made}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._workspace_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = self._jvm_path(df._workspace_path)
            path.getFileSystem(self._conf()).delete(path, True)


@contextlib.contextmanager
def without_old_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of an action made within go when it ends, and not when the driver next collects garbage.

    For steps whose results are written or collected: nothing reads their shuffles again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(spark: SparkSession, items: int, per_bucket: int) -> int:
    """Buckets so that each holds about per_bucket items; a partition each at least."""
    return max(shuffle_partitions(spark), -(-int(items) // per_bucket), 1)


def release() -> None:
    """Give freed memory back to the system: workers are kept, and large tasks follow one another."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts in one slice stay near max_bytes; no text is cut."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        lengths = batch.column(column)
        size = pc.fill_null(pc.binary_length(lengths), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        at = 0
        while at < n:
            before = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows that agree in keys, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        cols = [batch.column(k).to_pylist() for k in keys]
        at = 0
        marks = list(zip(*cols, strict=True))
        for i, mark in enumerate(marks):
            if mark != last:
                if i > at:
                    held.append(batch.slice(at, i - at))
                if held:
                    yield pa.Table.from_batches(held)
                held, at, last = [], i, mark
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


#: Words of the bounded bitmap below, of 64 bits each: 1 MB.
BITMAP_WORDS = 1 << 17


def _bit_place(column: Column) -> tuple[Column, Column]:
    h = F.xxhash64(column)
    return F.pmod(h, F.lit(BITMAP_WORDS)), F.pmod(F.shiftright(h, 40), F.lit(64)).cast("int")


def split(big: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of big whose key may be in wanted (one column of that name), and those whose key is not.

    The filter is a bitmap of fixed size (BITMAP_WORDS rows at most), whatever the
    tables' sizes, so its broadcast has a proven bound. Some keys that are not wanted
    are among the first rows: an exact join has to follow, which then shuffles few rows. A full
    bitmap costs time, never rows.
    """
    word, bit = _bit_place(F.col(key))
    one = F.expr("1L")
    bits = wanted.select(word.alias("__word"), F.call_function("shiftleft", one, bit).alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    marked = big.withColumn("__word", word).join(F.broadcast(bits), "__word", "left")
    hit = F.coalesce(F.col("__bits").bitwiseAND(F.call_function("shiftleft", one, bit)) != 0, F.lit(False))
    return tuple(marked.where(side).select(*big.columns) for side in (hit, ~hit))


def prefilter(big: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of big that an inner join with wanted can need, and a few others."""
    return split(big, key, wanted)[0]


def without(big: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """Rows of big whose key is not in dropped; rows of null key stay."""
    maybe, rest = split(big, key, dropped)
    return rest.unionByName(maybe.join(dropped.select(key).distinct(), key, "left_anti"))


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node.

    Each round maps every node to that of its neighbours and itself which comes first
    in an order drawn anew by hash, and contracts the edges; in expectation this
    shrinks any graph, chains included, by a constant factor. All of it is joins and
    pre-aggregated minima: nothing gathers the neighbours of a node.
    """
    left = ws.table(edges.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps: list[DataFrame] = []
    while not left.isEmpty():
        seed = F.lit(len(maps))
        first = lambda c: F.struct(F.xxhash64(seed, c).alias("h"), F.col(c).alias("v"))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(first("b")).alias("low"))
        step = ws.table(low.select(F.col("a").alias("node"), F.least("low", first("a"))["v"].alias("root")))
        maps.append(step)
        sides = left.join(step.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(step.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        after = ws.table(sides.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        ws.drop(left)
        left = after
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = maps[-1]
    for step in reversed(maps[:-1]):
        later = found.select(F.col("node").alias("root"), F.col("root").alias("final"))
        found = step.join(later, "root", "left").select("node", F.coalesce("final", "root").alias("root"))
    found = ws.table(found)
    least = found.groupBy("root").agg(F.min("node").alias("least"))
    out = ws.table(found.join(least, "root").select("node", F.col("least").alias("root")))
    ws.drop(left, found, *maps)
    return out
