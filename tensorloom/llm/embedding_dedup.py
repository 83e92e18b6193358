"""Embedding near-dedup by sorted projection passes.

Each pass draws random hyperplanes; the signs of a vector's projections, concatenated, are
its code, and vectors are sorted by it. Near vectors agree in their codes' first bits, so they stand
close together in some pass:

1. *Windows*: each vector is compared with the WINDOW next ones of the order, whatever their
   codes, in the sorted partitions themselves; where two partitions meet, the rows at
   their border are compared in a step of their own. Vectors travel as one byte a component, with the
   length of what that leaves out, which bounds the error of every cosine: pairs that are surely
   linked are united on the spot, and only those that may be and are still apart are
   sent on, to be compared in double precision.
2. *Union*: the classes of all passes are united by connected components.
3. *Links*: two linked vectors are in one component, so the number of links of each vector is counted
   exactly, in double precision, among the members of its component. Large components are cut into
   blocks and every pair of blocks is compared: what a window left out is found here.

The number of passes follows from the chance wanted that a pair right at the threshold shares a window: first
by the number of vectors, then by how many bits the vectors of the first passes had to share with others to stand
within a window of them.

Equal vectors are one row throughout. Pairs are counted where they are compared and never listed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Workspace, components, prefilter, runs, shuffle_partitions

#: Vectors of the sorted order that each is compared with, vectors of a block of a large component, bits of a code.
WINDOW, BLOCK, BITS = 1024, 1024, 48
#: Bytes of a sorted partition.
PART_BYTES = 16 << 20
#: Large components (16 bytes each) that are broadcast; more of them are joined.
BROADCAST_ROWS = 50_000
#: Chance that some pass brings a pair at the threshold together.
RECALL = 0.999
#: Rounding of single precision in a product of unit vectors.
SLACK = 1e-5


def agreement(threshold: float) -> float:
    """Chance that a pair right at the threshold agrees in one bit."""
    return 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi


def plan(n: int, threshold: float, recall: float = RECALL, window: int = WINDOW) -> int:
    """Passes for n vectors whose codes are spread evenly."""
    bits = max(0, math.ceil(math.log2(n / window))) if n > window else 0
    return passes_for({bits: 1}, threshold, recall)


def passes_for(needed: dict[int, int], threshold: float, recall: float) -> int:
    """Passes until the pairs at the threshold are found with the chance wanted; needed: how many vectors stand
    within a window of those that share so many bits with them."""
    bits, counts = np.array(list(needed), float), np.array(list(needed.values()), float)
    if not counts.sum():
        return 1
    missed = 1 - agreement(threshold) ** bits
    passes = 1
    while (counts * missed**passes).sum() / counts.sum() > 1 - recall:
        passes += 1
    return passes


def usable(column) -> F.Column:
    """Not null, no null or non-finite component, not zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(column, fine) & F.exists(column, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision; the largest component first, so that squares stay finite."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(column: pa.Array):
    """Rows of a list column by their length: numbers of rows, and a matrix."""
    sizes = np.diff(np.asarray(column.offsets))
    values = np.asarray(column.flatten())
    ends = np.cumsum(sizes)
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        yield d, rows, values[(ends[rows] - d)[:, None] + np.arange(d)]


# ---------------------------------------------------------------- sorted passes

_CODED = "pass int, dim int, code long, class long, scale float, error float, short binary"
_FOUND = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("side", pa.int32()), ("pass", pa.int32()), ("dim", pa.int32()), ("scale", pa.float32()), ("error", pa.float32()), ("short", pa.binary())])
_FOUND_SQL = "kind int, a long, b long, side int, pass int, dim int, scale float, error float, short binary"
#: Kinds of rows found: united pairs, pairs to compare, needed bits and how many rows need them, rows at borders.
UNITED, MAYBE, NEEDED, BORDER = range(4)


def _codes(passes: range, seed: int):
    """Codes of these passes, and each vector in bytes."""
    planes: dict[int, list[np.ndarray]] = {}

    def run(batches):
        for batch in batches:
            for d, rows, x in _by_length(batch.column("vector")):
                if d not in planes:
                    planes[d] = [np.random.default_rng([seed, d, p]).standard_normal((d, BITS)) for p in passes]
                x = unit(x)
                scale = (np.abs(x).max(axis=1) / 127).astype(np.float32)
                short = np.rint(x / scale[:, None].astype(np.float64)).astype(np.int8)
                error = np.sqrt(((x - short * scale[:, None].astype(np.float64)) ** 2).sum(axis=1)) * (1 + 1e-6)
                ids, n = batch.column("class").to_numpy()[rows], len(rows)
                told = [pa.array(ids, pa.int64()), pa.array(scale), pa.array(error.astype(np.float32)), pa.array([s.tobytes() for s in short], pa.binary())]
                for p, plane in zip(passes, planes[d], strict=True):
                    code = (x @ plane > 0) @ (1 << np.arange(BITS, dtype=np.int64)[::-1])
                    yield pa.record_batch([pa.array(np.full(n, p, np.int32)), pa.array(np.full(n, d, np.int32)), pa.array(code.astype(np.int64)), *told], names=["pass", "dim", "code", "class", "scale", "error", "short"])

    return run


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Classes of label (each row's smallest member) with these pairs united, in place."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not ((further := label[label]) == label).all():
            label[:] = further


def _matrix(table: pa.Table) -> np.ndarray:
    short = np.frombuffer(b"".join(table.column("short").to_pylist()), np.int8).reshape(table.num_rows, -1)
    return short.astype(np.float32) * table.column("scale").to_numpy()[:, None]


def _near(table: pa.Table, threshold: float, window: int, cut: int | None = None):
    """Pairs of rows within a window that are linked, or may be: (i, j, sure); with cut, only those across it."""
    error = table.column("error").to_numpy().astype(np.float64)
    most = 2 * error.max() + error.max() ** 2 + SLACK
    for at in range(0, table.num_rows if cut is None else cut, window):
        ahead = _matrix(table.slice(at, 2 * window))
        i, j = np.nonzero(ahead[: window if cut is None else min(window, cut - at)] @ ahead.T >= threshold - most)
        own = (i < j) & (j - i <= window) if cut is None else (i < cut - at) & (j >= cut - at) & (j - i <= window)
        i, j = i[own], j[own]
        cosine = np.einsum("ij,ij->i", ahead[i], ahead[j]).astype(np.float64)
        i, j = i + at, j + at
        slack = error[i] + error[j] + error[i] * error[j] + SLACK
        may = cosine >= threshold - slack
        yield i[may], j[may], (cosine >= threshold + slack)[may]


def _united(ids: np.ndarray, near) -> tuple[np.ndarray, list[tuple]]:
    """Classes of rows by the pairs that are sure, and rows of found: those classes, and pairs between them that may be linked."""
    label, rest = np.arange(len(ids)), []
    for i, j, sure in near:
        unite(label, i[sure], j[sure])
        rest.append((i[~sure], j[~sure]))
    moved = np.flatnonzero(label != np.arange(len(ids)))
    out = [(UNITED, ids[moved], ids[label[moved]])]
    for i, j in rest:
        apart = label[i] != label[j]
        out.append((MAYBE, np.minimum(ids[i[apart]], ids[j[apart]]), np.maximum(ids[i[apart]], ids[j[apart]])))
    return label, out


def _pairs_found(rows: list[tuple]):
    for kind, a, b in rows:
        if n := len(a):
            none = pa.nulls(n)
            yield pa.record_batch([pa.array(np.full(n, kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), *(none.cast(t) for t in _FOUND.types[3:])], schema=_FOUND)


def _windows(threshold: float, window: int):
    """Of one partition of the sorted order: what its windows find, and its first and last rows for the borders."""

    def run(batches):
        table = pa.Table.from_batches(held) if (held := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        part = TaskContext.get().partitionId()
        keys = np.stack([table.column(c).to_numpy() for c in ("pass", "dim")])
        heads = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0))))
        ends = np.append(heads[1:], table.num_rows)
        for a, b in zip(heads.tolist(), ends.tolist(), strict=True):
            rows = table.slice(a, b - a)
            label, found = _united(rows.column("class").to_numpy(), _near(rows, threshold, window))
            yield from _pairs_found(found)
            if b - a > window:
                code = rows.column("code").to_numpy()
                # A vector that is united with the last one of its window lies among its own copies.
                shared = BITS - np.frexp((code[window:] ^ code[:-window]).astype(np.float64))[1]
                bits, counts = np.unique(np.where(label[window:] == label[:-window], 0, np.minimum(shared + 1, BITS)), return_counts=True)
                yield from _pairs_found([(NEEDED, bits, counts)])
        first, last = table.slice(0, min(window, ends[0])), table.slice(max(table.num_rows - window, heads[-1]))
        for side, border, rows in ((1, part - 1, first), (0, part, last)):
            n = rows.num_rows
            yield from pa.table([pa.array(np.full(n, BORDER, np.int32)), rows.column("class"), pa.array(np.full(n, border, np.int64)), pa.array(np.full(n, side, np.int32)), *(rows.column(c) for c in ("pass", "dim", "scale", "error", "short"))], schema=_FOUND).to_batches()

    return run


def _borders(threshold: float, window: int):
    """Of the last rows of one partition and the first ones of the next (in their order): pairs across."""

    def run(table: pa.Table) -> pa.Table:
        sides = [table.filter(pc.equal(table.column("side"), k)) for k in (0, 1)]
        batches = []
        if all(s.num_rows for s in sides) and all(sides[0].column(c)[0] == sides[1].column(c)[0] for c in ("pass", "dim")):
            both = pa.concat_tables(sides).combine_chunks()
            batches = list(_pairs_found(_united(both.column("a").to_numpy(), _near(both, threshold, window, sides[0].num_rows))[1]))
        return pa.Table.from_batches(batches, _FOUND)

    return run


def _passes(classes: DataFrame, ws: Workspace, passes: range, n_parts: int, threshold: float, window: int, seed: int) -> DataFrame:
    keys = ["pass", "dim", "code", "class"]
    coded = classes.select("class", "vector").mapInArrow(_codes(passes, seed), _CODED)
    found = ws.table(coded.repartitionByRange(n_parts, *keys).sortWithinPartitions(*keys).mapInArrow(_windows(threshold, window), _FOUND_SQL))
    # Partitions without rows stand between no two that have some.
    parts = sorted(r[0] for r in found.where(f"kind = {BORDER} AND side = 0").select("b").distinct().collect())
    edge = found.where(f"kind = {BORDER}")
    if parts and parts != list(range(parts[0], parts[-1] + 1)):
        before = ws.spark.createDataFrame([(p - 1, q) for q, p in zip(parts, parts[1:], strict=False)], "b long, last long")
        edge = edge.join(F.broadcast(before), "b", "left").withColumn("b", F.when(F.col("side") == 1, F.coalesce("last", "b")).otherwise(F.col("b"))).select(*found.columns)
    across = edge.groupBy("b").applyInArrow(_borders(threshold, window), _FOUND_SQL)
    return found.where(f"kind <> {BORDER}").unionByName(across).select("kind", "a", "b")


def _verified(threshold: float):
    def run(batches):
        for batch in batches:
            fine = np.zeros(batch.num_rows, bool)
            for _, rows, x in _by_length(batch.column("x")):
                y = next(m for _, _, m in _by_length(batch.column("y").take(pa.array(rows))))
                fine[rows] = np.einsum("ij,ij->i", unit(x), unit(y)) >= threshold
            yield batch.select(["a", "b"]).filter(pa.array(fine))

    return run


# ---------------------------------------------------------------- links within components


def _count(threshold: float, step: int = 512):
    """Of each pair of blocks of a component: links of each vector."""

    def run(batches):
        for table in runs(batches, ["root", "left", "right"]):
            ids, copies, side = (table.column(c).to_numpy() for c in ("class", "copies", "side"))
            same = table.column("left")[0] == table.column("right")[0]
            x = unit(next(m for _, _, m in _by_length(table.column("vector").combine_chunks())))
            a = np.arange(len(ids)) if same else np.flatnonzero(side == 0)
            b = a if same else np.flatnonzero(side == 1)
            links = np.zeros(len(ids), np.int64)
            for at in range(0, len(a), step):
                near = x[a[at : at + step]] @ x[b].T >= threshold
                if same:
                    near[np.arange(len(near)), np.arange(at, at + len(near))] = False
                links[a[at : at + step]] += near @ copies[b]
                if not same:
                    links[b] += copies[a[at : at + step]] @ near
            yield pa.record_batch({"class": pa.array(ids), "links": pa.array(links)})

    return run


def _links(classes: DataFrame, joined: DataFrame, ws: Workspace, threshold: float, block: int) -> DataFrame:
    """Linked vectors (copies counted) of each class that has some, among the members of its component."""
    named = joined.select(F.col("node").alias("class"), "root")
    sizes = ws.table(named.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1"))
    # Most components fit a block; a short list of the others spares the vectors a shuffle.
    large = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes
    members = prefilter(classes, "class", named.select("class")).join(named, "class").join(large, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    members = members.withColumn("at", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    right = members.withColumn("left", F.explode(F.expr("sequence(0, at)"))).withColumn("right", F.col("at")).withColumn("side", F.lit(1))
    left = members.where("at < blocks - 1").withColumn("right", F.explode(F.expr("sequence(at + 1, blocks - 1)"))).withColumn("left", F.col("at")).withColumn("side", F.lit(0))
    keys = ["root", "left", "right"]
    pairs = right.unionByName(left).select(*keys, "side", "class", "copies", "vector")
    counted = pairs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_count(threshold), "class long, links long")
    return counted.groupBy("class").agg(F.sum("links").alias("links"))


def embedding_near_dedup(vectors: DataFrame, threshold: float = 0.95, *, recall: float = RECALL, window: int = WINDOW, block: int = BLOCK, seed: int = 20240601) -> DataFrame:
    """Group vectors whose cosine (in double precision) is threshold or more.

    vectors: vec_id (integer, unique), embedding (array of a float type); other columns are left out.
    Returns one row per vector: vec_id, n_links (other vectors linked directly),
    component_id (smallest vec_id reachable by links, itself included), kept (vec_id =
    component_id). A vector that is null, zero or empty, or holds a null or non-finite component
    links with nothing, nor do vectors of different lengths. Equal vectors always link. An empty table gives an empty one.
    Each pair at the threshold is found with a chance of about ``recall``, closer ones with more; no pair
    below it is linked. Links between vectors of one component are all counted, whether or not a pass
    brought them together: a component of m different vectors costs m * m / 2 products.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "embedding-dedup")
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("vector"))
    fine = rows.where(usable(F.col("vector")))
    classes = ws.table(fine.groupBy("vector").agg(F.min("vec_id").alias("class"), F.count("*").alias("copies")))
    size = classes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("vector") + 40), F.lit(0)).alias("bytes")).first()

    def passes(at: range) -> DataFrame:
        n_parts = max(1, -(-size["bytes"] * len(at) // PART_BYTES), min(shuffle_partitions(spark), -(-size["n"] * len(at) // (16 * window))))
        return _passes(classes, ws, at, n_parts, threshold, window, seed)

    first = plan(size["n"], threshold, recall, window)
    found = ws.table(passes(range(first)))
    needed = {r["a"]: r["n"] for r in found.where(f"kind = {NEEDED}").groupBy("a").agg(F.sum("b").alias("n")).collect()}
    if (wanted := passes_for(needed, threshold, recall)) > first:
        found = ws.table(found.unionByName(passes(range(first, wanted))))
    maybe = found.where(f"kind = {MAYBE}").select("a", "b").distinct()
    x, y = (classes.select(F.col("class").alias(c), F.col("vector").alias(v)) for c, v in (("a", "x"), ("b", "y")))
    verified = maybe.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verified(threshold), "a long, b long")
    joined = components(found.where(f"kind = {UNITED}").select("a", "b").unionByName(verified), ws)
    links = _links(classes, joined, ws, threshold, block)
    named = classes.join(links, "class", "left").join(joined.select(F.col("node").alias("class"), "root"), "class", "left")
    named = named.select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "class").alias("component_id"))
    out = fine.join(named, "vector").select("vec_id", "n_links", "component_id")
    rest = rows.where(~usable(F.col("vector"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
