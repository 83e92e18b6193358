"""Language-model scoring with a hidden Markov model.

1. *Counts* of every word of the training documents (packed by hash, combined within a
   batch, merged in buckets). The SYMBOLS most frequent words are symbols of their own;
   each other word belongs to the symbol of its class (by its first two bytes).
2. *Baum-Welch* over all training documents and these symbols: each partition adds up expected
   counts by forward and backward recursion, the counts are summed across partitions in two
   levels, and the driver normalises a matrix of fixed size.
3. *Words within classes*: the trained model's state posteriors are gathered for every other word of the
   corpus, dealt to buckets by its hash and summed there, one round of expectation and maximisation.
   A word's share of its class in a state is its add-one share times a ratio, which is
   stored in a byte per state; one place of a class is for unseen words. What this
   gathers grows with the vocabulary and no task or driver holds all of it. Documents are
   kept in blocks of about BLOCK_TOKENS tokens: a block adds up the posteriors of each of its words and
   sends them once, and a bucket sends each block the ratios of its words once, however often they occur.
4. A text's score is its exact log10 likelihood by the scaled forward recursion, the end symbol included.

Learning (2 and the posteriors of 3) runs in single precision, sums of counts and scores in double.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blobs import batch_of, bucket_of, joined, table_of
from ._spark import Workspace, buckets_for, release, slices, without_old_shuffles
from ._words import U64, Words

#: Words with a symbol of their own, classes of the others, latent states, rounds of Baum-Welch.
SYMBOLS, CLASSES, STATES, ROUNDS = 8192, 256, 8, 5
FLUSH_WORDS, BUCKET_WORDS, CHUNK_TOKENS = 600_000, 2_000_000, 300_000
#: Tokens of a block of documents, unless one document has more.
BLOCK_TOKENS = 3_000_000
#: Tokens whose moves are added up at once.
MOVE_BLOCK = 1 << 16
#: Symbols in one row of expected counts, and rows that one task of a level adds up.
COUNT_BLOCK, FAN_IN = 512, 64
#: Occurrences that pull a word's ratios towards 1, and steps of a ratio's natural logarithm in one unit.
PULL, STEPS = 2.0, 16.0
#: Ratios by their byte, from -128 on.
RATIOS = np.exp(np.arange(-128, 128) / STEPS)


def _classes(words: Words) -> np.ndarray:
    """Class of each word: its first two bytes (the first one twice if it has no other)."""
    first = words.data[words.start].astype(np.int64)
    second = words.data[np.minimum(words.start + 1, words.end - 1)]
    return ((first * 31 + second) % CLASSES).astype(np.uint8)


# ---------------------------------------------------------------- counts

_PART = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("classes", pa.binary())])
_PART_SQL = "bucket int, keys binary, counts binary, classes binary"


def _count(n_buckets: int):
    def run(batches):
        held, size = [], 0

        def flush():
            keys, classes = (np.concatenate(c) for c in zip(*held, strict=True))
            keys, first, counts = np.unique(keys, return_index=True, return_counts=True)
            target = bucket_of(keys, n_buckets)
            cuts = np.searchsorted(target, np.arange(n_buckets + 1))
            return batch_of([(int(t), keys[a:b].tobytes(), counts[a:b].astype(np.int64).tobytes(), classes[first[a:b]].tobytes()) for t, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a], _PART)

        for batch in slices(batches, "text"):
            words = Words(batch.column("text"))
            held.append((words.hashes(), _classes(words)))
            size += len(words.start)
            if size >= FLUSH_WORDS:
                yield flush()
                held, size = [], 0
                release()
        if size:
            yield flush()

    return run


_MERGED = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("classes", pa.binary()), ("tokens", pa.int64()), ("distinct", pa.int64()), ("class_mass", pa.list_(pa.int64()))])
_MERGED_SQL = "bucket int, keys binary, counts binary, classes binary, tokens long, distinct long, class_mass array<long>"


def _merge(table: pa.Table) -> pa.Table:
    release()
    keys, counts, classes = joined(table, "keys", U64), joined(table, "counts", np.int64), joined(table, "classes", np.uint8)
    order = np.argsort(keys, kind="stable")
    keys, counts, classes = keys[order], counts[order], classes[order]
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    keys, counts, classes = keys[heads], np.add.reduceat(counts, heads), classes[heads]
    mass = np.bincount(classes, weights=counts + 1, minlength=CLASSES).astype(np.int64)
    return table_of([(table.column("bucket")[0].as_py(), keys.tobytes(), counts.tobytes(), classes.tobytes(), int(counts.sum()), len(keys), mass.tolist())], _MERGED)


def _most_frequent(n: int):
    def run(batches):
        for batch in batches:
            for keys, counts, classes in zip(*(batch.column(c).to_pylist() for c in ("keys", "counts", "classes")), strict=True):
                keys, counts, classes = np.frombuffer(keys, U64), np.frombuffer(counts, np.int64), np.frombuffer(classes, np.uint8)
                top = np.lexsort((keys, -counts))[:n]
                yield pa.record_batch({"key": pa.array(keys[top].view(np.int64)), "n": pa.array(counts[top]), "class": pa.array(classes[top].astype(np.int32))})

    return run


# ---------------------------------------------------------------- encoding

#: A row per block: of its documents one after another doc_id, held_out, tokens, sums and symbols; the hashes of
#: its words without a symbol, sorted, and their classes; and of each place of such a word the word's number among them.
_BLOCK = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("doc_ids", "held_out", "sizes", "log_sum", "n_known", "class_log", "symbols", "keys", "classes", "places"))])
_BLOCK_SQL = "block long, doc_ids binary, held_out binary, sizes binary, log_sum binary, n_known binary, class_log binary, symbols binary, keys binary, classes binary, places binary"


def planes(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on as their lowest bytes, then their next ones, as far as any number has them."""
    low = x.astype("<u8").view(np.uint8).reshape(-1, 8)
    return low[:, : int(np.flatnonzero(low.any(axis=0)).max(initial=0)) + 1].T.tobytes()


def numbers(data: bytes, n: int) -> np.ndarray:
    """The n numbers of planes."""
    out = np.zeros((n, 8), np.uint8)
    if n:
        given = np.frombuffer(data, np.uint8).reshape(-1, n)
        out[:, : len(given)] = given.T
    return out.view("<u8").ravel().astype(np.int64)


def _encode(keys: np.ndarray, logs: np.ndarray, class_logs: np.ndarray, end_log: float, end_known: bool):
    """Blocks of texts as symbols, with what their frequent words add to their scores.

    keys: the frequent words' hashes, sorted; logs: their log10(count + 1).
    """
    end = len(keys) + CLASSES

    def run(batches):
        block = TaskContext.get().partitionId() << 36
        held, size = [], 0

        def flush():
            *columns, rare, classes = (np.concatenate(c) for c in zip(*held, strict=True))
            words, first, at = np.unique(rare, return_index=True, return_inverse=True)
            return batch_of([(block, *(c.tobytes() for c in columns), words.tobytes(), classes[first].tobytes(), planes(at))], _BLOCK)

        for batch in slices(batches, "text"):
            words = Words(batch.column("text"))
            h = words.hashes()
            classes = _classes(words)
            at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
            own = keys[at] == h if len(keys) else np.zeros(len(h), bool)
            symbols = np.where(own, at, len(keys) + classes.astype(np.int64)).astype(np.uint16)
            row = np.repeat(np.arange(batch.num_rows), words.counts())
            per_row = lambda x: np.bincount(row, weights=x, minlength=batch.num_rows).astype(np.float64)  # noqa: E731, B023
            gain = per_row(np.where(own, logs[at] if len(keys) else 0.0, 0.0)) + end_log
            mass = per_row(np.where(own, 0.0, class_logs[classes]))
            known = per_row(own).astype(np.int64) + end_known
            if size and size + len(symbols) + batch.num_rows > BLOCK_TOKENS:
                yield flush()
                held, size, block = [], 0, block + 1
                release()
            held.append((
                batch.column("doc_id").to_numpy(), batch.column("held_out").to_numpy(zero_copy_only=False).astype(np.uint8), words.counts().astype(np.int64) + 1,
                gain, known, mass, np.insert(symbols, words.first[1:], np.uint16(end)), h[~own], classes[~own],
            ))
            size += len(symbols) + batch.num_rows
        if size:
            yield flush()
        release()

    return run


def _blocks(batches, *columns: str):
    """Of each block its values of columns."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def _like_lengths(sizes: np.ndarray):
    """Numbers of texts, in runs of like length of about CHUNK_TOKENS tokens: the steps of a run are those of its longest text."""
    order = np.argsort(sizes, kind="stable")
    ends = np.cumsum(sizes[order])
    at = 0
    while at < len(order):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_TOKENS, side="right")))
        yield order[at:upto]
        at = upto


def _runs(sizes: bytes, symbols: bytes, left_out: bytes = b""):
    """Runs of a block's documents of like length, without those that are left out: their numbers and their texts."""
    sizes, symbols = np.frombuffer(sizes, np.int64), np.frombuffer(symbols, np.uint16)
    ends = np.cumsum(sizes)
    docs = np.flatnonzero(np.frombuffer(left_out, np.uint8) == 0) if left_out else np.arange(len(sizes))
    for picked in _like_lengths(sizes[docs]):
        yield docs[picked], [symbols[ends[i] - sizes[i] : ends[i]] for i in docs[picked]]


# ---------------------------------------------------------------- hidden Markov model


class Hmm:
    """start (states), move (states x states), emit (states x symbols): probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def initial(cls, weights: np.ndarray, states: int, seed: int = 7) -> Hmm:
        """Emissions near the symbols' own frequencies, each state with a bias of its own."""
        rng = np.random.default_rng(seed)
        emit = (weights + 1.0) * np.exp(rng.normal(0.0, 1.0, (states, len(weights))))
        move = np.full((states, states), 0.05 / max(states - 1, 1))
        np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=1, keepdims=True))

    @staticmethod
    def from_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray, weights: np.ndarray) -> Hmm:
        """Maximisation, smoothed by one start, one move and the symbols' frequencies."""
        scale = lambda x: x / x.sum(axis=-1, keepdims=True)
        prior = (weights + 1.0) / (weights + 1.0).sum()
        return Hmm(scale(start + 1.0), scale(move + 1.0), scale(emit + 0.002 * emit.sum(axis=1, keepdims=True) * prior + 1e-6))

    def run(self, texts: list[np.ndarray], learn: bool = False, *, factors: tuple | None = None, posteriors: bool = False):
        """Natural-log likelihood of each text; with learn, the expected counts too, and with
        posteriors instead of them the states' probabilities at each token of all texts, one after another.

        factors: which tokens of all texts have emissions of their own, and what theirs are times those of
        their symbol (a row of all states for each). Texts run side by side, the longest first, so that
        those still running at a step are the first rows. Forward variables are scaled to sum 1 at each step.
        """
        learn = learn or posteriors
        sizes = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-sizes, kind="stable")
        ends = sizes[order]
        steps = int(ends[0]) if len(ends) else 0
        if not steps:
            nothing = np.zeros(len(texts))
            if posteriors:
                return np.zeros((0, len(self.start)), np.float32)
            return (nothing, np.zeros_like(self.start), np.zeros_like(self.move), np.zeros_like(self.emit)) if learn else nothing
        active = np.searchsorted(-ends, -np.arange(steps), side="left")
        heads = np.concatenate(([0], np.cumsum(active)))
        row = np.repeat(np.arange(len(ends)), ends)
        step = np.arange(len(row)) - np.repeat(np.cumsum(ends) - ends, ends)
        place = heads[step] + row
        by_step = np.empty(len(row), np.uint16)
        by_step[place] = np.concatenate([texts[i] for i in order])
        # Learning stores every step and is content with single precision; scores are not.
        kind = np.float32 if learn else np.float64
        move, one = self.move.astype(kind), np.ones(len(self.start), kind)
        shown = self.emit.T.astype(kind)[by_step]
        if factors is not None or posteriors:
            # Of each token, in the order of texts: its row in the order of steps.
            began = np.empty(len(texts), np.int64)
            began[order] = np.cumsum(ends) - ends
            spot = place[np.repeat(began - np.cumsum(sizes) + sizes, sizes) + np.arange(len(row))]
        if factors is not None:
            own, times = factors
            shown[spot[own]] *= times
        alpha = shown if not learn else shown.copy()
        scale = np.empty(len(row), kind)
        alpha[: heads[1]] *= self.start.astype(kind)
        cuts = heads.tolist()
        for t in range(steps):
            a, b = cuts[t], cuts[t + 1]
            now = alpha[a:b]
            if t:
                now *= before[: b - a] @ move
            c = now @ one
            now /= c[:, None]
            scale[a:b] = c
            before = now
        likelihood = np.zeros(len(texts))
        likelihood[order] = np.bincount(row, weights=np.log(scale.astype(np.float64))[place], minlength=len(texts))
        if not learn:
            return likelihood
        # Of each step but the first: emission times beta over scale, which is what the step before sees ahead.
        shown /= scale[:, None]
        beta = np.ones_like(shown)
        back = np.ascontiguousarray(move.T)
        for t in range(steps - 1, 0, -1):
            a, b = cuts[t], cuts[t + 1]
            shown[a:b] *= beta[a:b]
            np.matmul(shown[a:b], back, out=beta[cuts[t - 1] : cuts[t - 1] + b - a])
        if posteriors:
            alpha *= beta
            alpha /= (alpha @ one)[:, None]
            return alpha[spot]
        # Tokens that follow another, in blocks: sums in double precision without a copy of all of it.
        moved = np.zeros_like(self.move)
        for at in range(int(heads[1]), len(by_step), MOVE_BLOCK):
            places = np.arange(at, min(at + MOVE_BLOCK, len(by_step)))
            which = np.searchsorted(heads, places, side="right") - 1
            moved += alpha[places - active[which - 1]].T.astype(np.float64) @ shown[places]
        moved *= self.move
        alpha *= beta
        alpha /= (alpha @ one)[:, None]
        emitted = np.stack([np.bincount(by_step, weights=alpha[:, k], minlength=self.emit.shape[1]) for k in range(len(self.start))])
        return likelihood, alpha[: heads[1]].sum(axis=0, dtype=np.float64), moved, emitted


_COUNTS = "part long, kind int, block int, counts binary"


def _expect(model: Hmm):
    """Expected counts of a partition: rows of (partition, kind, block, values)."""

    def run(batches):
        total = None
        for block in _blocks(batches, "sizes", "symbols", "held_out"):
            for _, texts in _runs(*block):
                likelihood, *counts = model.run(texts, learn=True)
                counts.append(np.array([likelihood.sum(), sum(map(len, texts))]))
                total = counts if total is None else [a + b for a, b in zip(total, counts, strict=True)]
        release()
        if total is not None:
            start, move, emit, rest = total
            rows = [(-1, 0, np.concatenate((start, move.ravel(), rest)))]
            rows += [(k, b, emit[k, b * COUNT_BLOCK : (b + 1) * COUNT_BLOCK]) for k in range(len(emit)) for b in range(-(-emit.shape[1] // COUNT_BLOCK))]
            part = TaskContext.get().partitionId()
            yield pa.record_batch({"part": pa.array([part] * len(rows), pa.int64()), "kind": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([r[1] for r in rows], pa.int32()), "counts": pa.array([r[2].astype(np.float64).tobytes() for r in rows], pa.binary())})

    return run


def _sum_counts(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.float64) for x in table.column("counts").to_pylist())
    return pa.table({"part": pa.array([table.column("part")[0].as_py() // FAN_IN], pa.int64()), "kind": table.column("kind").slice(0, 1), "block": table.column("block").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def summed(parts: DataFrame) -> DataFrame:
    """Sums by (kind, block), in two levels: no task takes a row from each task of the level before."""
    near = parts.groupBy(F.expr(f"part div {FAN_IN}").alias("near"), "kind", "block").applyInArrow(_sum_counts, _COUNTS)
    return near.groupBy("kind", "block").applyInArrow(_sum_counts, _COUNTS)


def baum_welch(encoded: DataFrame, weights: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> tuple[Hmm, np.ndarray, list[float]]:
    """Model of all documents of encoded that are not held out, the share of each state in each symbol as the
    last round expected it, and the log10 likelihood a token before each round."""
    model, n, history = Hmm.initial(weights, states), len(weights), []
    shares = np.full((states, n), 1 / states)
    for _ in range(rounds):
        # states * symbols / COUNT_BLOCK rows reach the driver, however large the corpus is.
        rows = summed(encoded.select("sizes", "symbols", "held_out").mapInArrow(_expect(model), _COUNTS)).collect()
        if not rows:
            break
        emit = np.zeros((states, n))
        for r in rows:
            values = np.frombuffer(r["counts"], np.float64)
            if r["kind"] < 0:
                start, move, rest = values[:states], values[states : states + states * states].reshape(states, states), values[-2:]
            else:
                emit[r["kind"], r["block"] * COUNT_BLOCK : r["block"] * COUNT_BLOCK + len(values)] = values
        history.append(float(rest[0] / rest[1] / np.log(10)))
        model = Hmm.from_counts(start, move, emit, weights)
        smooth = emit + 1e-3 * emit.sum(axis=1, keepdims=True) / emit.sum() + 1e-9
        shares = smooth / smooth.sum(axis=0)
    return model, shares, history


# ---------------------------------------------------------------- words within classes

_ASKED = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("classes", pa.binary()), ("counts", pa.binary()), ("states", pa.binary())])
_ASKED_SQL = "bucket int, block long, keys binary, classes binary, counts binary, states binary"


def _ask(n_buckets: int, n_own: int, model: Hmm):
    """Words of each block by bucket, with their places in its training documents and the sums of the posteriors there, in bytes."""
    states = len(model.start)

    def run(batches):
        for block, sizes, held, symbols, keys, classes, places in _blocks(batches, "block", "sizes", "held_out", "symbols", "keys", "classes", "places"):
            keys, classes, out = np.frombuffer(keys, U64), np.frombuffer(classes, np.uint8), np.frombuffer(held, np.uint8)
            if not len(keys):
                continue
            row, at, cuts = _rare(sizes, symbols, places, n_own)
            posterior = np.zeros((len(at), states), np.uint8)
            for docs, texts in _runs(sizes, symbols, held):
                told = np.concatenate(texts)
                inside = (told >= n_own) & (told < n_own + CLASSES)
                posterior[_spans(cuts, docs)] = np.rint(model.run(texts, posteriors=True)[inside] * 255).astype(np.uint8)
            counts = np.bincount(at[out[row] == 0], minlength=len(keys))
            sums = np.stack([np.bincount(at, weights=posterior[:, k], minlength=len(keys)) for k in range(states)], axis=1).astype(np.int64)
            # Keys are sorted and buckets are ranges of them.
            ends = np.searchsorted(bucket_of(keys, n_buckets), np.arange(n_buckets + 1))
            yield batch_of([(t, block, keys[a:b].tobytes(), classes[a:b].tobytes(), planes(counts[a:b]), planes(sums[a:b].ravel())) for t, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if b > a], _ASKED)
            release()

    return run


def _rare(sizes: bytes, symbols: bytes, places: bytes, n_own: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each place of a word without a symbol: its document's number in the block and its word's; and where
    each document's places begin, with one entry more at the end."""
    sizes, symbols = np.frombuffer(sizes, np.int64), np.frombuffer(symbols, np.uint16)
    spots = np.flatnonzero((symbols >= n_own) & (symbols < n_own + CLASSES))
    cuts = np.searchsorted(spots, np.concatenate(([0], np.cumsum(sizes))))
    return np.repeat(np.arange(len(sizes)), np.diff(cuts)), numbers(places, len(spots)), cuts


def _spans(cuts: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """Places cuts[i] to cuts[i + 1] of each i of picked, one after another."""
    n = np.diff(cuts)[picked]
    return np.repeat(cuts[picked] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


_TOLD = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary()), ("ratios", pa.binary())])
_TOLD_SQL = "block long, bucket int, counts binary, ratios binary"


def ratios_of(counts: np.ndarray, expected: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Bytes of a word's ratios: its expected share of each state over that of its class, pulled towards 1.

    counts: occurrences of each word; expected: of them, by state; shares: states' shares in the word's class.
    """
    ratio = (expected + PULL * shares) / ((counts + PULL)[:, None] * shares)
    return np.clip(np.rint(np.log(ratio) * STEPS), -128, 127).astype(np.int8)


def _tell(states: int, shares: np.ndarray):
    """Of one bucket: counts and ratios of its words, to each block that has them in the order of its words; and
    (block -1) what the words add to the masses of classes in each state. shares: states x classes."""

    def run(table: pa.Table) -> pa.Table:
        release()
        bucket = table.column("bucket")[0].as_py()
        keys = joined(table, "keys", U64)
        sizes = [len(x) // 8 for x in table.column("keys").to_pylist()]
        words, first, at = np.unique(keys, return_index=True, return_inverse=True)
        sums = lambda x: np.bincount(at, weights=x, minlength=len(words)).astype(np.float64)
        counts = sums(np.concatenate([numbers(x, n) for x, n in zip(table.column("counts").to_pylist(), sizes, strict=True)])).astype(np.int64)
        classes = joined(table, "classes", np.uint8)[first]
        given = np.concatenate([numbers(x, n * states).reshape(-1, states) for x, n in zip(table.column("states").to_pylist(), sizes, strict=True)])
        expected = np.stack([sums(given[:, k]) for k in range(states)], axis=1)
        expected *= (counts / np.maximum(expected.sum(axis=1), 1e-9))[:, None]
        # Words that only held-out documents have are unseen: no count, ratios of 1, nothing in the masses.
        ratios = np.where((counts > 0)[:, None], ratios_of(counts, expected, shares.T[classes]), np.int8(0))
        mass = np.zeros((states, CLASSES))
        for k in range(states):
            mass[k] = np.bincount(classes, weights=(counts > 0) * (counts + 1) * RATIOS[ratios[:, k].astype(np.int64) + 128], minlength=CLASSES)
        rows = [(-1, bucket, b"", mass.tobytes())]
        start = 0
        for block, n in zip(table.column("block").to_pylist(), sizes, strict=True):
            mine = at[start : start + n]
            rows.append((block, bucket, planes(counts[mine]), ratios[mine].tobytes()))
            start += n
        return table_of(rows, _TOLD)

    return run


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("log_sum", pa.float64()), ("score", pa.float64())])


def _score(model: Hmm, masses: np.ndarray, n_own: int):
    """Of one block: every document's likelihood, with the ratios of its words over their classes' masses (states x classes)."""
    states = len(model.start)

    def run(table: pa.Table) -> pa.Table:
        release()
        block = table.filter(pc.is_valid(table.column("sizes"))).to_pylist()[0]
        told = table.filter(pc.is_null(table.column("sizes"))).sort_by("bucket")
        # Words are sorted and buckets are ranges of them: what the buckets told, one after another, is in the words' order.
        ratios = joined(told, "ratios", np.int8).reshape(-1, states)
        c = np.concatenate([np.zeros(0, np.int64), *(numbers(x, len(r) // states) for x, r in zip(told.column("counts").to_pylist(), told.column("ratios").to_pylist(), strict=True))])
        row, at, cuts = _rare(block["sizes"], block["symbols"], block["places"], n_own)
        n = len(cuts) - 1
        sums = np.bincount(row, weights=np.log10(c[at] + 1.0), minlength=n).astype(np.float64)
        known = np.bincount(row, weights=c[at] > 0, minlength=n).astype(np.int64)
        likelihood = np.zeros(n)
        for docs, texts in _runs(block["sizes"], block["symbols"]):
            symbols = np.concatenate(texts)
            own = np.flatnonzero((symbols >= n_own) & (symbols < n_own + CLASSES))
            given = ratios[at[_spans(cuts, docs)]]
            times = RATIOS[given.astype(np.int64) + 128] / masses.T[symbols[own] - n_own]
            likelihood[docs] = model.run(texts, factors=(own, times))
        of = lambda name, kind: np.frombuffer(block[name], kind)
        score = likelihood / np.log(10) + sums - of("class_log", np.float64)
        columns = of("doc_ids", np.int64), of("held_out", np.uint8) == 1, of("sizes", np.int64), of("n_known", np.int64) + known, of("log_sum", np.float64) + sums, score
        return pa.table([pa.array(x) for x in columns], schema=_SCORED)

    return run


# ---------------------------------------------------------------- operator


@dataclass
class LanguageModel:
    """keys: hashes of the words with symbols of their own, sorted; mass: of each class, the sum of
    count + 1 of its words and 1; masses: the same by state, each word times its ratio."""

    hmm: Hmm
    keys: np.ndarray
    tokens: int
    distinct: int
    mass: np.ndarray
    masses: np.ndarray
    history: list[float]


def learn(docs: DataFrame, ws: Workspace, symbols: int = SYMBOLS, states: int = STATES, rounds: int = ROUNDS) -> tuple[LanguageModel, DataFrame, DataFrame]:
    """Model of the rows of docs (doc_id, held_out, text) that are not held out, all rows encoded in blocks,
    and what these are told of their words."""
    spark = docs.sparkSession
    train = docs.where("NOT held_out")
    size = train.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count("*").alias("ends")).first()
    n_buckets = buckets_for(spark, size["bytes"] // 24, BUCKET_WORDS)
    counted = train.select("text").mapInArrow(_count(n_buckets), _PART_SQL)
    counts = ws.table(counted.groupBy("bucket").applyInArrow(_merge, _MERGED_SQL))
    totals = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("distinct"), *(F.coalesce(F.sum(F.col("class_mass")[c]), F.lit(0)).alias(f"c{c}") for c in range(CLASSES))).first()
    ends = size["ends"]
    n, v = totals["tokens"] + ends, totals["distinct"] + (ends > 0)
    # `symbols` rows at most.
    top = counts.select("keys", "counts", "classes").mapInArrow(_most_frequent(symbols), "key long, n long, class int").orderBy(F.desc("n"), "key").limit(symbols).toPandas()
    ws.drop(counts)
    keys = top["key"].to_numpy(np.int64).view(U64)
    order = np.argsort(keys)
    keys, own, classes = keys[order], top["n"].to_numpy(np.int64)[order], top["class"].to_numpy(np.int64)[order]
    mass = np.array([totals[f"c{c}"] for c in range(CLASSES)], np.float64) - np.bincount(classes, weights=own + 1, minlength=CLASSES)
    encoded = ws.table(docs.mapInArrow(_encode(keys, np.log10(own + 1.0), np.log10(mass + 1.0), float(np.log10(ends + 1.0)), ends > 0), _BLOCK_SQL))

    weights = np.concatenate((own, np.maximum(mass, 0.0), [float(ends)])).astype(np.float64)
    model, shares, history = baum_welch(encoded, weights, states, rounds)

    asks = encoded.agg(F.coalesce(F.sum(F.octet_length("keys")), F.lit(0)).alias("keys")).first()
    n_rare = max(16, -(-asks["keys"] // (2 * BUCKET_WORDS)))
    asked = encoded.select("block", "sizes", "held_out", "symbols", "keys", "classes", "places").mapInArrow(_ask(n_rare, len(keys), model), _ASKED_SQL)
    told = ws.table(asked.groupBy("bucket").applyInArrow(_tell(states, shares[:, len(keys) : len(keys) + CLASSES]), _TOLD_SQL))
    parts = told.where("block < 0").select(F.col("bucket").cast("long").alias("part"), F.lit(0).alias("kind"), F.lit(0).alias("block"), F.col("ratios").alias("counts"))
    found = summed(parts).first()
    masses = (np.frombuffer(found["counts"], np.float64).reshape(states, CLASSES) if found else np.zeros((states, CLASSES))) + 1
    masses = masses / (mass + 1)
    return LanguageModel(model, keys, n, v, mass + 1, masses, history), encoded, told


def hmm_score(docs: DataFrame, held_out: F.Column, *, symbols: int = SYMBOLS, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Train on the rows of docs that are not held out, and score every row.

    docs: doc_id (integer) and text; other columns and rows of null doc_id are left out; held_out:
    boolean column of docs (null: not held out). ASCII letters are lower-cased; a text's tokens are its words (runs
    of anything but ASCII white space) and one end; a null, empty or blank text is the end alone.
    Returns a row per row: doc_id, held_out, n_tokens, n_known (tokens that training has), train_tokens,
    base_score (sum of log10((c + 1) / (N + V + 1)) by training counts) and score (log10
    probability of the text under the model). Rows of one doc_id are scored each by its own text. Without
    training rows every word is unseen.
    """
    if symbols + CLASSES + 1 > 65536:
        raise ValueError("symbols are stored in 16 bits")
    ws = Workspace(docs.sparkSession, "hmm")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text").where("doc_id IS NOT NULL")
    with without_old_shuffles(docs.sparkSession):
        model, encoded, told = learn(docs, ws, symbols, states, rounds)
    both = told.where("block >= 0").unionByName(encoded.drop("keys", "classes"), allowMissingColumns=True)
    scored = both.groupBy("block").applyInArrow(_score(model.hmm, model.masses, len(model.keys)), "doc_id long, held_out boolean, n_tokens long, n_known long, log_sum double, score double")
    base = F.col("log_sum") - F.col("n_tokens") * F.lit(float(np.log10(model.tokens + model.distinct + 1.0)))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
