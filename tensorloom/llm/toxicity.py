"""Toxicity by multiple-instance learning.

Labels are known for documents, not sentences. Each sentence gets a probability from a
logistic model over hashed words and word beginnings, a document's is the noisy-or of its
sentences (one minus the chance that no sentence is toxic), and the weights are
learned through that combination from document labels. Scoring then also says
which sentences carry the document's score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blobs import extended
from ._spark import release, slices
from ._words import NON_ALNUM, U64, Words, delimiter_mask, span_hashes

#: Hash bits of the weights, and lengths in bytes of the word beginnings used beside whole words.
BITS, BEGINNINGS = 18, (3, 4, 5, 6, 7)
#: The bounded sample that the model is fitted on: documents of each label, and bytes of text in all.
SAMPLE_DOCS, SAMPLE_BYTES = 4000, 24 << 20
ENDS = delimiter_mask(b".!?\n")
START_BIAS = -4.0


def features(words: Words, picked: np.ndarray) -> np.ndarray:
    """Feature numbers, a row for each picked word: the word and its beginnings, salted by length."""
    shift = U64(64 - BITS)
    start, end = words.start[picked], words.end[picked]
    out = np.empty((len(start), 1 + len(BEGINNINGS)), np.int32)
    out[:, 0] = span_hashes(words.data, start, end) >> shift
    for k, size in enumerate(BEGINNINGS, 1):
        part = span_hashes(words.data, start, np.minimum(end, start + size))
        out[:, k] = (part * U64(0x9E3779B97F4A7C15 + 2 * size)) >> shift
    return out


def sentences(words: Words) -> np.ndarray:
    """Number of each word's sentence; sentences end at . ! ? and line ends, and with their text."""
    n = len(words.start)
    if not n:
        return np.zeros(0, np.int64)
    ends = np.concatenate(([0], np.cumsum(ENDS[words.data])))[words.start]
    new = np.concatenate(([True], ends[1:] != ends[:-1]))
    heads = words.first[:-1]
    new[heads[heads < n]] = True
    return np.cumsum(new) - 1


class Sentences:
    """Distinct words of each distinct sentence of each row.

    picked: words that count (a word once in a sentence); which: their sentence; owner: row of
    each sentence; once: false for sentences that their row holds before.
    """

    def __init__(self, words: Words):
        which = sentences(words)
        self.heads = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1]))) if len(which) else np.zeros(0, np.int64)
        h = words.hashes()
        key = (which.astype(U64) << U64(36)) | (h >> U64(28))
        _, picked = np.unique(key, return_index=True)
        self.picked = np.sort(picked)
        self.which = which[self.picked]
        self.owner = np.searchsorted(words.first, self.heads, side="right") - 1
        mark = np.bincount(self.which, weights=(h[self.picked] >> U64(11)).astype(np.float64), minlength=len(self.heads))
        order = np.lexsort((mark, self.owner))
        self.once = np.ones(len(order), bool)
        self.once[order[1:]] = (self.owner[order[1:]] != self.owner[order[:-1]]) | (mark[order[1:]] != mark[order[:-1]])


def noisy_or(p: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """1 - product of (1 - p) by owner; 0 where there is none."""
    return 0.0 - np.expm1(np.bincount(owner, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, words: Words) -> tuple[np.ndarray, np.ndarray, Sentences]:
        """Score of each row, and of each sentence."""
        parts = Sentences(words)
        z = np.bincount(parts.which, weights=self.weights[features(words, parts.picked)].sum(axis=1), minlength=len(parts.heads)) + self.bias
        p = _sigmoid(z)
        return noisy_or(p[parts.once], parts.owner[parts.once], len(words.first) - 1), p, parts


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, rounds: int = 14, rate: float = 0.15, decay: float = 1e-5, batch: int = 32, seed: int = 3) -> Model:
    """Gradient steps (each feature with its own rate) on the weighted log loss of the noisy-or.

    docs: features of each sentence's words, a row for each word, and the words' sentence numbers (from 0).
    """
    w, bias = np.zeros(1 << BITS), START_BIAS
    squares, bias_squares = np.full(1 << BITS, 1e-2), 1.0
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            picked = [i for i in order[at : at + batch] if len(docs[i][0])]
            if not picked:
                continue
            sizes = [int(docs[i][1][-1]) + 1 for i in picked]
            base = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(picked)), sizes)
            feats = np.concatenate([docs[i][0] for i in picked])
            which = np.concatenate([docs[i][1] + b for i, b in zip(picked, base, strict=True)])
            p = _sigmoid(np.bincount(which, weights=w[feats].sum(axis=1), minlength=len(owner)) + bias)
            total = np.clip(noisy_or(p, owner, len(picked)), 1e-9, 1 - 1e-9)
            y, cost = labels[picked], weights[picked]
            # Of -log(total) by a sentence's logit: -(1 - total) / total * p; of -log(1 - total): p.
            slope = (cost * np.where(y > 0, -(1 - total) / total, 1.0))[owner] * p / len(picked)
            used, back = np.unique(feats, return_inverse=True)
            g = np.bincount(back.ravel(), weights=np.repeat(slope[which], feats.shape[1])) + decay * w[used]
            squares[used] += g * g
            w[used] -= rate * g / np.sqrt(squares[used])
            gb = slope.sum()
            bias_squares += gb * gb
            bias -= rate * gb / np.sqrt(bias_squares)
    return Model(w.astype(np.float32), float(bias))


def featurized(texts: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For fit: the features of each text's distinct sentences, a row for each word, and the words' sentence numbers."""
    out = []
    rows = pa.table({"text": texts}).to_batches()
    for batch in slices(rows, "text"):
        words = Words(batch.column("text"), NON_ALNUM)
        parts = Sentences(words)
        kept = parts.once[parts.which]
        picked, which = parts.picked[kept], (np.cumsum(parts.once) - 1)[parts.which[kept]]
        feats = features(words, picked)
        for a, b in zip(*(np.searchsorted(picked, words.first[k:][: batch.num_rows]) for k in (0, 1)), strict=True):
            out.append((feats[a:b], (which[a:b] - (which[a] if b > a else 0)).astype(np.int32)))
    return out


def fitting(sizes: np.ndarray, room: int) -> np.ndarray:
    """Which texts are taken, in their order, if one that does not fit in what is left of room is passed over."""
    out = np.zeros(len(sizes), bool)
    for i, size in enumerate(sizes.tolist()):
        if size <= room:
            out[i] = True
            room -= size
    return out


def train(docs: DataFrame, labels: DataFrame, *, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on a bounded sample of labelled documents: the first sample_docs of each label in hash
    order, but for texts that do not fit in what those before leave of sample_bytes (half for each label).

    docs: doc_id, text; labels: doc_id, toxic (0, 1; others are left out). The sample's labels
    are weighed by how many documents have them. Without a document of each label the model
    gives every text of one sentence the chance of the starting bias; a sample that misses a label
    which documents have raises ValueError.
    """
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    # Two rows of sample_docs ids at most.
    ranked = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs) for y in (0, 1)]
    picked = F.broadcast(ranked[0].unionByName(ranked[1]))
    sizes = docs.select("doc_id", F.octet_length("text").alias("size")).join(picked, "doc_id").select("doc_id", "toxic", "size", F.xxhash64("doc_id").alias("h")).toPandas().sort_values(["h", "doc_id"])
    taken = np.zeros(len(sizes), bool)
    for y in (0, 1):
        at = np.flatnonzero(sizes["toxic"] == y)
        taken[at] = fitting(sizes["size"].fillna(0).to_numpy(np.int64)[at], sample_bytes // 2)
    sizes = sizes[taken]
    if sizes["toxic"].nunique() < 2:
        if known.join(docs.select("doc_id"), "doc_id", "left_semi").agg(F.count_distinct("toxic")).first()[0] == 2:
            raise ValueError("no text of one of the labels fits in the sample")
        return Model(np.zeros(1 << BITS, np.float32), START_BIAS)
    spark = docs.sparkSession
    ids = F.broadcast(spark.createDataFrame(sizes[["doc_id", "toxic"]].astype("int64")))
    rows = docs.select("doc_id", "text").join(ids, "doc_id").select("doc_id", "toxic", "text").toArrow().sort_by("doc_id")
    data = featurized(rows.column("text"))
    y = rows.column("toxic").to_numpy().astype(np.int64)
    share = np.array([totals[0], totals[1]], float) / np.bincount(y, minlength=2)
    weights = share[y] / share[y].mean()
    del rows
    model = fit(data, y, weights)
    # The driver has more to do: what the sample took goes back to the system.
    del data
    release()
    return model


_FLAGGED = "array<struct<start:bigint,end:bigint,score:double>>"
_FLAG_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _score(model: Model, columns: list[str], threshold: float):
    def run(batches):
        for batch in slices(batches, "text"):
            n = batch.num_rows
            words = Words(batch.column("text"), NON_ALNUM)
            scores, p, parts = model.scores(words)
            owner, heads = parts.owner, parts.heads
            flags: list[list] = [[] for _ in range(n)]
            tails = np.append(heads[1:], len(words.start)) - 1
            for s in np.flatnonzero(p >= threshold):
                i = int(owner[s])
                base = words.offsets[i]
                a, b = words.start[heads[s]], words.end[tails[s]]
                chars = lambda x, y: int(((words.data[x:y] & 0xC0) != 0x80).sum())  # noqa: E731, B023
                start = chars(base, a)
                flags[i].append({"start": start, "end": start + chars(a, b), "score": float(p[s])})
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(scores), pa.array(flags, _FLAG_TYPE)], names=[*columns, "score", "offending"])

    return run


def score_toxicity(docs: DataFrame, model: Model, *, keep: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """The kept columns of docs with score (0 to 1) and offending: the sentences whose own probability is
    threshold or more, with their places in characters.

    Only text enters a score. Null, empty and wordless texts have score 0 and no sentences.
    """
    keep = ["doc_id"] if keep is None else keep
    schema = extended(docs.select(*keep).schema, f"score double, offending {_FLAGGED}")
    source = docs.select(*dict.fromkeys([*keep, "text"]))
    return source.mapInArrow(_score(model, keep, threshold), schema)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs, all columns, without the texts whose score is threshold or more."""
    columns = docs.columns
    schema = docs.schema

    def run(batches):
        for batch in slices(batches, "text"):
            scores = model.scores(Words(batch.column("text"), NON_ALNUM))[0]
            yield batch.filter(pa.array(scores < threshold))

    return docs.select(*columns).mapInArrow(run, schema)
