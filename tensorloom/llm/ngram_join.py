"""N-gram Jaccard join by signature trees.

Documents are sets of word n-grams; two link when the Jaccard similarity of their
sets reaches a threshold. The join is exact for sets of 64-bit gram hashes:

1. *Profile*: one scan gives each document its set size and a fingerprint of its set.
   Equal sets are one node from here on, so copies cost nothing further.
2. *Routing*: a census of grams, dealt out by hash as packed blobs, finds how many
   different sets hold each gram. Of two linked sets each holds, among its
   ``size - ceil(t * size) + 1`` rarest grams, one that the other has there too, so a set
   whose rarest grams are its own has no partner, and sets that share such a gram
   meet in one *candidate group*. Grams of very many documents are held out of the
   blobs (a list of proven bounded size) and stand last in the order.
3. *Signature trees*: each candidate group, cut into blocks of bounded bytes, becomes a
   tree whose nodes hold OR-combined token bitmaps, AND-combined ones and size ranges. A dual
   traversal leaves out pairs of nodes whose greatest possible overlap is below what
   their sizes need, and pairs already known to be connected, and compares the rest
   exactly. Blocks of one group share pivots; what they leave apart is compared in
   a second traversal, block against block.
4. *Components* over the verified links.
5. *Links*: two linked sets are in one component, so the links of each set are counted exactly among the
   sets of its component, block against block, by products of incidence matrices.

Links leave a tree as a spanning forest, and what is counted as a number per set, never as all pairs of a group.
Grams are dealt in one step while buckets are few, and in two when there are more than DEALT: a mapper deals
to ranges of buckets, and tasks that hold one range of many mappers deal on, so that blobs stay long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Workspace, buckets_for, components, prefilter, release, runs, slices, without
from ._words import U64, Words, gram_hashes, mix

#: A gram is heavy in a batch if this part of its documents have it, and HEAVY_LEAST at least.
HEAVY_SHARE, HEAVY_LEAST = 1 / 128, 32
#: Grams of one routing bucket, of one mapper flush, and of one block of a signature tree.
BUCKET_GRAMS, FLUSH_GRAMS, BLOCK_GRAMS = 2_000_000, 600_000, 400_000
#: Buckets that a mapper deals to at most.
DEALT = 4096
#: Sets of a block whose links are counted, and columns of an incidence matrix that are multiplied at once.
LINK_SETS, INCIDENCE = 1024, 4096
LEAF, FANOUT, BITS, PIVOTS = 16, 8, 2048, 16


def gram_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct gram hashes of each row; a row of fewer than k words is one gram."""
    h = words.hashes()
    grams = gram_hashes(h, k)
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            yield gram_hashes(h[a:b], int(b - a)) ^ mix(np.full(1, b - a, U64))
        else:
            yield np.zeros(0, U64)


def fingerprint(grams: np.ndarray) -> int:
    """64 bits that stand for the whole set, as a signed integer."""
    if not len(grams):
        return 0
    total = mix(grams + U64(0x9E3779B97F4A7C15)).sum(dtype=U64)
    parity = np.bitwise_xor.reduce(mix(grams ^ U64(0xA5A5A5A5A5A5A5A5)))
    x = np.array([total], U64) + np.array([parity], U64) * U64(0x9FB21C651E98DF25) + U64(len(grams))
    return int(mix(x).view(np.int64)[0])


def prefix_length(size: int, percent: int) -> int:
    """Rarest grams among which linked sets share one: size - ceil(t * size) + 1."""
    return size - -(-percent * size // 100) + 1


# ---------------------------------------------------------------- profile


def _profile(k: int):
    def run(batches):
        held: list[np.ndarray] = []
        docs = 0

        def heavy() -> pa.RecordBatch | None:
            nonlocal docs
            if not held:
                return None
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts >= max(HEAVY_LEAST, docs * HEAVY_SHARE)
            held.clear()
            docs = 0
            m = int(keep.sum())
            return pa.record_batch({"kind": pa.array(np.ones(m, np.int32)), "a": pa.array(keys[keep].view(np.int64)), "b": pa.array(np.zeros(m, np.int64)), "n": pa.array(counts[keep].astype(np.int64))})

        size = 0
        for batch in slices(batches, "text"):
            fps, ns = [], []
            for grams in gram_sets(Words(batch.column("text")), k):
                fps.append(fingerprint(grams))
                ns.append(len(grams))
                held.append(grams)
                docs += 1
                size += len(grams)
            yield pa.record_batch({"kind": pa.array(np.zeros(len(ns), np.int32)), "a": batch.column("doc_id").cast(pa.int64()), "b": pa.array(fps, pa.int64()), "n": pa.array(ns, pa.int64())})
            if size >= FLUSH_GRAMS:
                yield heavy()
                size = 0
                release()
        if held:
            yield heavy()

    return run


# ---------------------------------------------------------------- routing

_ROUTED = "target int, fps binary, counts binary, keys binary, extra binary"
_ROUTED_TYPE = pa.schema([("target", pa.int32()), *((x, pa.binary()) for x in ("fps", "counts", "keys", "extra"))])


def _short(counts: np.ndarray) -> bytes:
    """Counts in one byte each where they fit, else in two or four; the number of owners tells which."""
    most = counts.max(initial=0)
    return counts.astype(np.uint8 if most < 256 else np.uint16 if most < 65_536 else np.uint32).tobytes()


def _long(counts: bytes, owners: int) -> np.ndarray:
    return np.frombuffer(counts, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(counts) // max(owners, 1)] if owners else np.uint8)


def _owners(table: pa.Table) -> np.ndarray:
    """Owner of each gram of dealt rows."""
    parts = []
    for fps, counts in zip(table.column("fps").to_pylist(), table.column("counts").to_pylist(), strict=True):
        owners = np.frombuffer(fps, np.int64)
        parts.append(np.repeat(owners, _long(counts, len(owners))))
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(n) >> U64(32)).astype(np.int32)


def _merged(grams: np.ndarray, owner: np.ndarray, n_buckets: int, n_owners: int) -> np.ndarray:
    """How many grams of each set fall together with another one of it by bucket and low 32 bits, which is all that is sent."""
    key = mix(((_bucket(grams, n_buckets).astype(U64) << U64(32)) | (grams & U64(0xFFFFFFFF))) + owner.astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    again = order[1:][key[order][1:] == key[order][:-1]]
    return np.bincount(owner[again], minlength=n_owners)


def _gram_rows(target: np.ndarray, n: int, fps: np.ndarray, owner: np.ndarray, grams: np.ndarray, wide: bool):
    """Rows of dealt grams by target; wide: whole grams, as they will be dealt on."""
    order = np.argsort(target.astype(np.uint16) if n <= 65535 else target, kind="stable")
    sent = target[order]
    heads = np.flatnonzero(np.concatenate(([True], sent[1:] != sent[:-1]))) if len(sent) else ()
    for a, b in zip(heads, np.append(heads[1:], len(sent)) if len(sent) else (), strict=True):
        own = order[a:b]
        mine = owner[own]
        starts = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
        yield int(sent[a]), fps[mine[starts]].tobytes(), _short(np.diff(starts, append=len(mine))), (grams[own] if wide else grams[own].astype(np.uint32)).tobytes(), b""


def _home_rows(target: np.ndarray, fps: np.ndarray, counts: np.ndarray, extra: list[np.ndarray]):
    """Rows of what sets have besides, by home."""
    order = np.argsort(target, kind="stable")
    sent = target[order]
    heads = np.flatnonzero(np.concatenate(([True], sent[1:] != sent[:-1]))) if len(sent) else ()
    for a, b in zip(heads, np.append(heads[1:], len(sent)) if len(sent) else (), strict=True):
        own = order[a:b]
        yield -1 - int(sent[a]), fps[own].tobytes(), counts[:, own].astype(np.int32).tobytes(), b"", np.concatenate([extra[i] for i in own]).tobytes()


def _range(bucket: np.ndarray, n_buckets: int, n_ranges: int) -> np.ndarray:
    """Range of each bucket, of n_ranges as many."""
    return (bucket.astype(np.int64) * n_ranges // n_buckets).astype(np.int32)


def _route(k: int, percent: int, n_buckets: int, heavy_keys: np.ndarray, heavy_counts: np.ndarray):
    """Blobs of grams by bucket (or range of buckets); and, as targets below zero, what a set has besides."""
    n_ranges = min(n_buckets, DEALT)
    wide = n_ranges < n_buckets

    def flush(held: dict[int, np.ndarray]):
        if not held:
            return
        fps = np.fromiter(held, np.int64, len(held))
        sizes = np.array([len(x) for x in held.values()])
        owner = np.repeat(np.arange(len(fps)), sizes)
        grams = np.concatenate(list(held.values()))
        light = np.ones(len(grams), bool)
        extra = [np.zeros(0, U64)] * len(fps)
        if len(heavy_keys):
            at = np.minimum(np.searchsorted(heavy_keys, grams), len(heavy_keys) - 1)
            light = heavy_keys[at] != grams
        n_light = np.bincount(owner[light], minlength=len(fps)) - _merged(grams[light], owner[light], n_buckets, len(fps))
        if not light.all():
            ends = np.cumsum(sizes)
            for i in np.unique(owner[~light]).tolist():
                need = prefix_length(int(sizes[i]), percent) - int(n_light[i])
                if need > 0:
                    own = slice(ends[i] - sizes[i], ends[i])
                    places = at[own][~light[own]]
                    extra[i] = heavy_keys[places[np.lexsort((heavy_keys[places], heavy_counts[places]))[:need]]]
        # What each set has besides: its size and light grams, and heavy ones of its prefix.
        home = _range(_bucket(mix(fps.view(U64)), n_buckets), n_buckets, n_ranges)
        yield from _home_rows(home, fps, np.stack([sizes, n_light, [len(x) for x in extra]]), extra)
        grams, owner = grams[light], owner[light]
        yield from _gram_rows(_range(_bucket(grams, n_buckets), n_buckets, n_ranges), n_ranges, fps, owner, grams, wide)

    def batch_of(rows) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ROUTED_TYPE.types, strict=True)], schema=_ROUTED_TYPE)

    def run(batches):
        held: dict[int, np.ndarray] = {}
        size = 0
        for batch in slices(batches, "text"):
            for grams in gram_sets(Words(batch.column("text")), k):
                if len(grams) and (fp := fingerprint(grams)) not in held:
                    held[fp] = grams
                    size += len(grams)
            if size >= FLUSH_GRAMS:
                yield batch_of(list(flush(held)))
                held, size = {}, 0
                release()
        if held:
            yield batch_of(list(flush(held)))

    return run


def _deal_on(n_buckets: int):
    """Of one range of buckets, and a part of the mappers: the same rows by bucket."""

    def run(table: pa.Table) -> pa.Table:
        release()
        if table.column("target")[0].as_py() < 0:
            fps = _joined(table, "fps", np.int64)
            counts = np.concatenate([np.frombuffer(x, np.int32).reshape(3, -1) for x in table.column("counts").to_pylist()], axis=1)
            extra = np.split(_joined(table, "extra", U64), np.cumsum(counts[2])[:-1])
            rows = list(_home_rows(_bucket(mix(fps.view(U64)), n_buckets), fps, counts, extra))
        else:
            grams, fps = _joined(table, "keys", U64), _owners(table)
            # Sets that several mappers hold are told once.
            order = np.lexsort((grams, fps))
            grams, fps = grams[order], fps[order]
            new = np.concatenate(([True], (grams[1:] != grams[:-1]) | (fps[1:] != fps[:-1])))
            grams, fps = grams[new], fps[new]
            rows = list(_gram_rows(_bucket(grams, n_buckets), n_buckets, *np.unique(fps, return_inverse=True), grams, False))
        return pa.Table.from_batches([pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ROUTED_TYPE.types, strict=True)], schema=_ROUTED_TYPE)])

    return run


def _joined(table: pa.Table, name: str, dtype) -> np.ndarray:
    parts = [np.frombuffer(x, dtype) for x in table.column(name).to_pylist() if x]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


_RETURNED = "home int, bucket int, fps binary, counts binary, keys binary, dfs binary, extra binary"


def _census(n_buckets: int):
    """Of one bucket: the grams that two sets or more hold, dealt out to the sets' homes."""
    schema = pa.schema([("home", pa.int32()), ("bucket", pa.int32()), *((x, pa.binary()) for x in ("fps", "counts", "keys", "dfs", "extra"))])

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("target")[0].as_py()
        if bucket < 0:
            n = table.num_rows
            return pa.table([pa.array([-1 - bucket] * n, pa.int32()), pa.array([-1] * n, pa.int32()), table.column("fps"), pa.array([b""] * n, pa.binary()), table.column("counts"), pa.array([b""] * n, pa.binary()), table.column("extra")], schema=schema)
        release()
        keys = _joined(table, "keys", np.uint32)
        fps = _owners(table)
        order = np.argsort(keys)
        keys, fps = keys[order], fps[order]
        same = keys[1:] == keys[:-1]
        shared = np.zeros(len(keys), bool)
        shared[1:] |= same
        shared[:-1] |= same
        keys, fps = keys[shared], fps[shared]
        order = np.lexsort((fps, keys))
        keys, fps = keys[order], fps[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (fps[1:] != fps[:-1])
        keys, fps = keys[new], fps[new]
        if not len(keys):
            return schema.empty_table()
        heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        counts = np.diff(heads, append=len(keys))
        # Only the order matters, and it is the same everywhere: large counts may tie.
        df = np.minimum(np.repeat(counts, counts), 65_535).astype(np.uint16)
        keep = df >= 2
        keys, fps, df = keys[keep], fps[keep], df[keep]
        home = _bucket(mix(fps.view(U64)), n_buckets)
        order = np.lexsort((fps, home))
        home, keys, fps, df = home[order], keys[order], fps[order], df[order]
        heads = np.flatnonzero(np.diff(home, prepend=-1))
        ends = np.append(heads, len(home))[1:]
        rows = []
        for a, b in zip(heads, ends, strict=True):
            own = fps[a:b]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            rows.append((int(home[a]), bucket, own[first].tobytes(), _short(np.diff(first, append=len(own))), keys[a:b].tobytes(), df[a:b].tobytes(), b""))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema) if rows else schema.empty_table()

    return run


def _prefixes(percent: int):
    """Of one home: the routing keys of each set that may have a partner."""
    schema = pa.schema([("bucket", pa.int32()), ("gram", pa.int64()), ("fp", pa.int64()), ("n", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        own = table.filter(pc.less(table.column("bucket"), 0))
        rest = table.filter(pc.greater_equal(table.column("bucket"), 0))
        fps = _joined(own, "fps", np.int64)
        counts = [np.frombuffer(x, np.int32).reshape(3, -1) for x in own.column("keys").to_pylist()]
        counts = np.concatenate(counts, axis=1).astype(np.int64) if counts else np.zeros((3, 0), np.int64)
        extra = _joined(own, "extra", U64)
        ends = np.cumsum(counts[2])
        fps, first = np.unique(fps, return_index=True)
        n, n_light, n_extra = counts[:, first]
        ends = ends[first]
        need = n - (percent * n + 99) // 100 + 1
        keys = _joined(rest, "keys", np.uint32)
        dfs = _joined(rest, "dfs", np.uint16)
        holders = _owners(rest)
        sizes = [len(x) // 4 for x in rest.column("keys").to_pylist()]
        bucket = np.repeat(rest.column("bucket").to_numpy().astype(np.int32), sizes) if sizes else np.zeros(0, np.int32)
        owner = np.searchsorted(fps, holders)
        alone = n_light - np.bincount(owner, minlength=len(fps))
        take = np.minimum(need, n_light) - alone
        live = take[owner] > 0
        owner, keys, dfs, bucket = owner[live], keys[live], dfs[live], bucket[live]
        order = np.lexsort((keys, bucket, dfs, owner))
        owner, keys, bucket = owner[order], keys[order], bucket[order]
        heads = np.searchsorted(owner, np.arange(len(fps)))
        rank = np.arange(len(owner)) - heads[owner]
        inside = rank < take[owner]
        out = [(bucket[inside], keys[inside].astype(np.int64), fps[owner[inside]], n[owner[inside]])]
        for i in np.flatnonzero(n_extra):
            grams = extra[ends[i] - n_extra[i] : ends[i]]
            out.append((np.full(len(grams), -1, np.int32), grams.view(np.int64), np.full(len(grams), fps[i]), np.full(len(grams), n[i])))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)

    return run


# ---------------------------------------------------------------- signature trees


class SignatureTree:
    """Tree over sets: a node holds the OR and the AND of its sets' bitmaps and their size range."""

    def __init__(self, sets: list[np.ndarray]):
        # Neighbours in size and in smallest gram stand together, which keeps nodes tight.
        self.order = sorted(range(len(sets)), key=lambda i: (len(sets[i]).bit_length(), int(sets[i][0]), len(sets[i])))
        self.sets = [sets[i] for i in self.order]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        bits = np.zeros((len(sets), BITS), bool)
        for row, s in zip(bits, self.sets, strict=True):
            row[(s >> U64(64 - BITS.bit_length() + 1)).astype(np.int64)] = True
        self.bitmaps = np.packbits(bits, axis=1).view(U64)
        self.levels = [(self.bitmaps, self.bitmaps, self.sizes, self.sizes, np.arange(len(sets) + 1))]
        width = LEAF
        while True:
            ors, ands, low, high, edges = self.levels[-1]
            cuts = np.arange(0, len(low), width)
            self.levels.append((np.bitwise_or.reduceat(ors, cuts, axis=0), np.bitwise_and.reduceat(ands, cuts, axis=0), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.append(edges[cuts], len(sets))))
            width = FANOUT
            if len(cuts) <= 1:
                break


def may_link(ors_a, ands_a, low_a, high_a, ors_b, ands_b, low_b, high_b, percent: int) -> np.ndarray:
    """False where no set of node a can overlap one of node b as far as their sizes need.

    Each bit that all sets of one node have and no set of the other has is a token
    outside the overlap. Sets of x and y tokens need an overlap of p(x+y)/(100+p).
    """
    miss_a = np.bitwise_count(ands_a & ~ors_b).sum(axis=-1, dtype=np.int64)
    miss_b = np.bitwise_count(ands_b & ~ors_a).sum(axis=-1, dtype=np.int64)
    p, q = percent, 100 + percent
    # overlap <= x - miss for x in [low, high]: the widest case is the largest x and the smallest y.
    return ((100 * high_a - q * miss_a >= p * low_b) & (100 * high_b - q * miss_b >= p * low_a) & (100 * high_b >= p * low_a) & (100 * high_a >= p * low_b)
            & (np.bitwise_count(ors_a & ors_b).sum(axis=-1, dtype=np.int64) > 0))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def dual_traversal(a: SignatureTree, b: SignatureTree, root_a: np.ndarray, root_b: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Verified links that connect what root_a and root_b (class of each set) leave apart.

    a and b may be the same tree. The roots are updated, so that a pair of nodes
    whose sets are all connected already is not opened.
    """
    stack = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while stack:
        la, i, lb, j = stack.pop()
        A, B = a.levels[la], b.levels[lb]
        if a is b and la == lb and j < i:
            continue
        sa, sb = slice(A[4][i], A[4][i + 1]), slice(B[4][j], B[4][j + 1])
        ra, rb = root_a[sa], root_b[sb]
        if (ra == ra[0]).all() and (rb == ra[0]).all():
            continue
        if not may_link(A[0][i], A[1][i], A[2][i], A[3][i], B[0][j], B[1][j], B[2][j], B[3][j], percent):
            continue
        if la > 1 or lb > 1:
            def under(tree, level, k):
                return range(k * FANOUT, min((k + 1) * FANOUT, len(tree.levels[level - 1][2])))

            if la >= lb:
                kids = [(la - 1, x, lb, j) for x in under(a, la, i)]
                if a is b and la == lb:
                    kids = [(la - 1, x, lb - 1, y) for x in under(a, la, i) for y in under(b, lb, j)]
            else:
                kids = [(la, i, lb - 1, y) for y in under(b, lb, j)]
            stack.extend(reversed(kids))
            continue
        ors_a, ors_b = a.bitmaps[sa], b.bitmaps[sb]
        ok = may_link(ors_a[:, None], ors_a[:, None], a.sizes[sa][:, None], a.sizes[sa][:, None], ors_b[None], ors_b[None], b.sizes[sb][None], b.sizes[sb][None], percent)
        for x, y in zip(*np.nonzero(ok), strict=True):
            x, y = x + sa.start, y + sb.start
            if root_a[x] != root_b[y] and linked(a.sets[x], b.sets[y], percent):
                old, new = root_b[y], root_a[x]
                root_b[root_b == old] = new
                root_a[root_a == old] = new
                yield x, y


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _sets_of(k: int, columns: list[str]):
    def run(batches):
        for batch in slices(batches, "text"):
            sets = list(gram_sets(Words(batch.column("text")), k))
            # A doc_id that stands for two texts brings both: only the one with this fingerprint counts.
            own = pa.array(np.array([fingerprint(s) for s in sets], np.int64) == batch.column("fp").to_numpy())
            out = pa.record_batch([*(batch.column(c) for c in columns), pa.array([s.tobytes() for s in sets], pa.binary())], names=[*columns, "grams"])
            yield out.filter(own)

    return run


def _in_blocks(percent: int):
    """Links within each block (rows sorted by group and block)."""

    def run(batches):
        for table in runs(batches, ["grp", "block"]):
            fps = table.column("fp").to_numpy()
            fps, first = np.unique(fps, return_index=True)
            if len(fps) < 2:
                continue
            grams = table.column("grams").take(pa.array(first)).to_pylist()
            tree = SignatureTree([np.frombuffer(g, U64) for g in grams])
            ids = fps[tree.order]
            root = np.arange(len(ids))
            found = [(ids[x], ids[y]) for x, y in dual_traversal(tree, tree, root, root, percent)]
            if found:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=_LINKS)

    return run


def _across(percent: int):
    """Links between the two sides of each pair of blocks (rows sorted by pair)."""

    def run(batches):
        for table in runs(batches, ["grp", "left", "right"]):
            sides = []
            for side in (0, 1):
                part = table.filter(pc.equal(table.column("side"), side))
                grams = part.column("grams").to_pylist()
                if grams:
                    tree = SignatureTree([np.frombuffer(g, U64) for g in grams])
                    order = np.array(tree.order)
                    sides.append((tree, part.column("fp").to_numpy()[order], part.column("class").to_numpy()[order].copy()))
            if len(sides) < 2:
                continue
            (ta, ids_a, root_a), (tb, ids_b, root_b) = sides
            found = [(ids_a[x], ids_b[y]) for x, y in dual_traversal(ta, tb, root_a, root_b, percent)]
            if found:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=_LINKS)

    return run


def _resolve_across(sets: DataFrame, sizes: DataFrame, links: DataFrame, ws: Workspace, percent: int, block_grams: int) -> DataFrame:
    """Links between blocks of one group: all sets outside a group's largest class against all."""
    wide = sizes.where("blocks > 1").select("grp", "blocks")
    own = sets.join(wide, "grp").select("grp", "blocks", "fp", "n", "grams").dropDuplicates(["fp"])
    named = components(links, ws)
    own = ws.table(own.join(named.select(F.col("node").alias("fp"), F.col("root").alias("class")), "fp", "left").withColumn("class", F.coalesce("class", "fp")))
    classes = own.groupBy("grp", "class").agg(F.sum("n").alias("total"))
    largest = classes.groupBy("grp").agg(F.max(F.struct("total", "class")).alias("most"), F.sum("total").alias("all"))
    largest = largest.select("grp", F.col("most.class").alias("main"), F.ceil((F.col("all") - F.col("most.total")) / block_grams).cast("int").alias("few"), F.ceil(F.col("most.total") / block_grams).cast("int").alias("many"))
    own = own.join(largest.where("few > 0"), "grp")
    place = lambda n: F.pmod(F.xxhash64(F.lit("across"), "fp"), F.greatest(n, F.lit(1))).cast("int")
    # Blocks outside the main class are numbered from 0, those of the main class follow.
    own = own.withColumn("at", F.when(F.col("class") == F.col("main"), F.col("few") + place(F.col("many"))).otherwise(place(F.col("few"))))
    minor = F.col("at") < F.col("few")
    right = own.withColumn("left", F.explode(F.when(minor, F.expr("sequence(0, at)")).otherwise(F.expr("sequence(0, few - 1)")))).withColumn("right", F.col("at")).withColumn("side", F.lit(1))
    left = own.where(minor).withColumn("right", F.explode(F.expr("sequence(at, few + many - 1)"))).withColumn("left", F.col("at")).withColumn("side", F.lit(0))
    pairs = right.unionByName(left).select("grp", "left", "right", "side", "fp", "class", "grams")
    return pairs.repartition("grp", "left", "right").sortWithinPartitions("grp", "left", "right", "side").mapInArrow(_across(percent), "a long, b long")


# ---------------------------------------------------------------- links


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Grams that each set of a shares with each of b, by products of incidence matrices over the grams of both."""
    keys, owner = [np.concatenate(x) for x in (a, b)], [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b)]
    both = np.intersect1d(*keys)
    out = np.zeros((len(a), len(b)))
    places = [np.searchsorted(both, k) for k in keys]
    held = [p < len(both) for p in places]
    held = [h & (both[np.minimum(p, max(len(both) - 1, 0))] == k) if len(both) else h for h, p, k in zip(held, places, keys, strict=True)]
    for at in range(0, len(both), INCIDENCE):
        sides = []
        for size, h, p, o in zip((len(a), len(b)), held, places, owner, strict=True):
            own = h & (p >= at) & (p < at + INCIDENCE)
            m = np.zeros((size, min(INCIDENCE, len(both) - at)), np.float32)
            m[o[own], p[own] - at] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _count_links(percent: int):
    """Of each pair of blocks of a component: links of each set, copies of the other set counted."""

    def run(batches):
        for table in runs(batches, ["root", "left", "right"]):
            release()
            fps, copies, side = (table.column(c).to_numpy() for c in ("fp", "copies", "side"))
            sets = [np.frombuffer(g, U64) for g in table.column("grams").to_pylist()]
            same = table.column("left")[0] == table.column("right")[0]
            a = np.arange(len(fps)) if same else np.flatnonzero(side == 0)
            b = a if same else np.flatnonzero(side == 1)
            links = np.zeros(len(fps), np.int64)
            if len(a) and len(b):
                x, y = ([sets[i] for i in at] for at in (a, b))
                both = overlaps(x, y)
                near = 100 * both >= percent * (np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y]) - both)
                if same:
                    np.fill_diagonal(near, False)
                links[a] += near @ copies[b]
                if not same:
                    links[b] += copies[a] @ near
            yield pa.record_batch({"fp": pa.array(fps), "links": pa.array(links)})

    return run


def _links(sets: DataFrame, found: DataFrame, nodes: DataFrame, percent: int, block_grams: int) -> DataFrame:
    """Linked rows (those of other sets) of each set that has some."""
    copies = nodes.groupBy("fp").agg(F.count("*").alias("copies"))
    members = sets.select("fp", "n", "grams").dropDuplicates(["fp"]).join(found.select("fp", F.col("class").alias("root")), "fp").join(copies, "fp")
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.sum("n") / block_grams), F.ceil(F.count("*") / LINK_SETS)).cast("int").alias("blocks"))
    members = members.join(sizes, "root").withColumn("at", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    right = members.withColumn("left", F.explode(F.expr("sequence(0, at)"))).withColumn("right", F.col("at")).withColumn("side", F.lit(1))
    left = members.where("at < blocks - 1").withColumn("right", F.explode(F.expr("sequence(at + 1, blocks - 1)"))).withColumn("left", F.col("at")).withColumn("side", F.lit(0))
    keys = ["root", "left", "right"]
    pairs = right.unionByName(left).select(*keys, "side", "fp", "copies", "grams")
    counted = pairs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_count_links(percent), "fp long, links long")
    return counted.groupBy("fp").agg(F.sum("links").alias("links"))


# ---------------------------------------------------------------- operator


def ngram_jaccard_join(docs: DataFrame, ngram: int = 5, percent: int = 80, *, links: bool = False, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """Group documents whose sets of word n-grams have a Jaccard similarity of percent/100 or more.

    docs: doc_id (integer) and text; other columns and rows of null doc_id are left out. Returns one
    row per row: doc_id, n_shingles (set size) and component_id (smallest doc_id
    reachable by links, itself included); with links also n_links (other rows linked directly), for which all sets of a
    component are compared: of m different ones m * m / 2 pairs. ASCII letters are lower-cased; words are
    runs of anything but ASCII white space; a text of fewer words than ngram is one gram.
    A null or empty text, or one of white space, has an empty set, which links with
    nothing. Repeated texts link with each other. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "ngram-join")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    profile = ws.table(docs.mapInArrow(_profile(ngram), "kind int, a long, b long, n long"))
    nodes = profile.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("fp"), "n")
    total = nodes.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("grams")).first()
    # At most 2 * grams / (docs * HEAVY_SHARE) keys, that is 256 times the mean set size.
    heavy = profile.where("kind = 1").groupBy("a").agg(F.sum("n").alias("c")).where(F.col("c") >= max(HEAVY_LEAST, total["docs"] * HEAVY_SHARE / 2)).toPandas()
    keys = heavy["a"].to_numpy(np.int64).view(U64)
    order = np.argsort(keys)
    n_buckets = buckets_for(spark, total["grams"], BUCKET_GRAMS)
    routed = docs.mapInArrow(_route(ngram, percent, n_buckets, keys[order], heavy["c"].to_numpy(np.int64)[order]), _ROUTED)
    if n_buckets > DEALT:
        lanes = -(-n_buckets // DEALT)
        routed = routed.withColumn("lane", F.spark_partition_id() % lanes).groupBy("target", "lane").applyInArrow(_deal_on(n_buckets), _ROUTED)
    census = routed.groupBy("target").applyInArrow(_census(n_buckets), _RETURNED)
    prefixes = ws.table(census.groupBy("home").applyInArrow(_prefixes(percent), "bucket int, gram long, fp long, n long"))

    centres = prefixes.groupBy("bucket", "gram").agg(F.min("fp").alias("centre"), F.max("fp").alias("other")).where("centre <> other").drop("other")
    met = prefixes.join(centres, ["bucket", "gram"]).select(F.col("fp").alias("a"), F.col("centre").alias("b"))
    groups = components(met, ws).select(F.col("node").alias("fp"), F.col("root").alias("grp"))
    firsts = nodes.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    members = ws.table(groups.join(firsts, "fp"))
    sizes = members.groupBy("grp").agg(F.ceil(F.sum("n") / block_grams).cast("int").alias("blocks"), *(F.min(F.struct(F.xxhash64(F.lit(i), "fp"), "fp"))["fp"].alias(f"p{i}") for i in range(PIVOTS)))
    sizes = ws.table(sizes)
    texts = prefilter(docs, "doc_id", members.select("doc_id")).join(members, "doc_id")
    sets = ws.table(texts.select("grp", "fp", "n", "text").mapInArrow(_sets_of(ngram, ["grp", "fp", "n"]), "grp long, fp long, n long, grams binary"))
    placed = sets.join(sizes, "grp")
    pivot = F.array(*(F.col(f"p{i}") for i in range(PIVOTS)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    blocks = F.when((F.col("blocks") > 1) & F.array_contains(pivot, F.col("fp")), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    placed = placed.select("grp", F.explode(blocks).alias("block"), "fp", "grams")
    edges = ws.table(placed.repartition("grp", "block").sortWithinPartitions("grp", "block").mapInArrow(_in_blocks(percent), "a long, b long"))
    if not sizes.where("blocks > 1").isEmpty():
        edges = edges.unionByName(ws.table(_resolve_across(sets, sizes, edges, ws, percent, block_grams)))

    found = components(edges, ws).select(F.col("node").alias("fp"), F.col("root").alias("class"))
    classes = nodes.join(found, "fp", "left").withColumn("class", F.coalesce("class", "fp"))
    # A table of its own, so that the join below can split a large class.
    least = ws.table(classes.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least")))
    out = classes.join(least, "class", "left")
    columns = ["doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")]
    if links:
        # Of equal sets each row links with all others; their number is a table, so that the join can split a large set.
        same = nodes.where("n > 0").groupBy("fp").agg((F.count("*") - 1).alias("copies"))
        told = ws.table(same.join(_links(sets, found, nodes, percent, block_grams), "fp", "left").select("fp", (F.col("copies") + F.coalesce("links", F.lit(0))).alias("n_links")))
        out = out.join(told, "fp", "left")
        columns.append(F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return out.select(*columns)


def keep_one(docs: DataFrame, ngram: int = 5, percent: int = 80) -> DataFrame:
    """docs without near duplicates: of each component the document of the smallest doc_id stays.

    All columns of docs are kept. Rows of null doc_id stay, and rows of one doc_id stay or go together.
    """
    found = ngram_jaccard_join(docs, ngram, percent).where("doc_id <> component_id").select("doc_id")
    return without(docs, "doc_id", Workspace(docs.sparkSession, "near-copies").table(found))
