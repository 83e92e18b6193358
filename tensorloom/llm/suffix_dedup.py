"""Repeated passages by a sparse suffix array.

A passage of ``min_words`` words is a window. Each window has one minimiser: the
smallest hash among its k-word runs (k = min_words // 2 + 1). Suffixes are kept only at
minimiser positions, about two in ``min_words / 2``; equal passages have them at equal
places. Two passes:

1. The kept suffixes are dealt out by ranges of the hash of their first k words and
   sorted: the buckets in order are the sparse suffix array. Neighbours that agree in
   these words mark both suffixes. (The order is that of the hash of the first k words: an order by the words
   themselves would deal all suffixes that begin with a frequent word to one task.)
2. From each marked suffix matches are extended to the left and to the right: every window
   that the suffix is the minimiser of (it starts up to min_words - k words to the left
   and ends as many to the right) is hashed whole, sorted, and compared with its
   neighbours. The first place of a window in the order of (doc_id, word) is kept,
   later ones are repeats; overlapping windows join into maximal passages. (Comparing the words beside all suffixes
   of one k-run with each other, in one place, would gather every document that quotes a passage in one task, as
   what stands around a quotation differs; windows that lie within it are alike and combine, those that cross
   its end are dealt apart.)

Both passes combine within a batch before they shuffle: of a suffix or window that a
batch holds often, one entry is sent. So a passage that a third of all documents
share sends an entry per batch, not per document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blobs import batch_of, bucket_of, deal, home_of, joined, owners_of, table_of
from ._spark import Workspace, buckets_for, prefilter, release, slices, split
from ._words import U64, Words, window_hashes

#: Items of a bucket, and words that a mapper gathers before it sends.
BUCKET_ITEMS, FLUSH_WORDS = 1_000_000, 600_000


def minimisers(grams: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest gram of each run of width grams."""
    if len(grams) < width:
        return np.zeros(0, np.int64)
    best = grams.copy()
    place = np.arange(len(grams))
    # Doubling: best[i] is the smallest of grams[i : i + span].
    span = 1
    while span < width:
        step = min(span, width - span)
        a, b = best[:-step], best[step:]
        later = b < a
        place = np.where(later, place[step:], place[:-step])
        best = np.where(later, b, a)
        span += step
    return place


def _windows(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows that lie within one row: their first words, rows, minimisers, and all grams."""
    k = size // 2 + 1
    grams = window_hashes(hashes, k)
    place = minimisers(grams, size - k + 1)
    starts = np.arange(len(place))
    row = np.searchsorted(words.first, starts, side="right") - 1
    inside = starts + size <= words.first[row + 1]
    return starts[inside], row[inside], place[inside], grams


_SENT = pa.schema([("target", pa.int32()), ("owners", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary()), ("places", pa.binary()), ("marks", pa.binary())])
_SENT_SQL = "target int, owners binary, counts binary, keys binary, places binary, marks binary"


def _distinct(keys: np.ndarray, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries in order of document and place; a row that is there twice says nothing twice."""
    order = np.lexsort((places, ids))
    keys, ids, places = keys[order], ids[order], places[order]
    new = np.ones(len(keys), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (places[1:] != places[:-1]) | (keys[1:] != keys[:-1])
    return keys[new], ids[new], places[new]


def _firsts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of each distinct key, in order of place, and how often each is there."""
    _, first, counts = np.unique(keys, return_index=True, return_counts=True)
    order = np.argsort(first)
    return first[order], counts[order]


def _send_suffixes(size: int, n_buckets: int):
    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        gathered = 0

        def flush():
            keys, ids, places = _distinct(*(np.concatenate(c) for c in zip(*held, strict=True)))
            first, counts = _firsts(keys)
            marks = (counts > 1).astype(np.uint8)
            rows = list(deal(bucket_of(keys[first], n_buckets), n_buckets, ids[first], keys[first].astype(np.uint32), places[first], marks))
            # What the batch itself holds twice is marked here; one entry has told the bucket.
            twice = np.ones(len(keys), bool)
            twice[first] = counts > 1
            home = home_of(ids[twice], n_buckets)
            for t, owners, counts_, places_ in deal(home, n_buckets, ids[twice], places[twice]):
                rows.append((-1 - t, owners, counts_, b"", places_, b""))
            return batch_of(rows, _SENT)

        for batch in slices(batches, "text"):
            words = Words(batch.column("text"))
            _, _, place, grams = _windows(words, words.hashes(), size)
            place = np.unique(place)
            row = np.searchsorted(words.first, place, side="right") - 1
            ids = batch.column("doc_id").to_numpy()
            held.append((grams[place], ids[row], (place - words.first[row]).astype(np.uint32)))
            gathered += len(words.start)
            if gathered >= FLUSH_WORDS:
                yield flush()
                held, gathered = [], 0
                release()
        if held:
            yield flush()

    return run


_HOME = pa.schema([("home", pa.int32()), ("owners", pa.binary()), ("counts", pa.binary()), ("places", pa.binary()), ("marks", pa.binary())])
_HOME_SQL = "home int, owners binary, counts binary, places binary, marks binary"


def _to_homes(ids, places, marks, n_buckets: int) -> pa.Table:
    order = np.argsort(ids, kind="stable")
    ids, places, marks = ids[order], places[order], marks[order]
    return table_of(list(deal(home_of(ids, n_buckets), n_buckets, ids, places, marks)), _HOME)


def _passed_on(table: pa.Table) -> pa.Table:
    n = table.num_rows
    home = -1 - table.column("target")[0].as_py()
    marks = [x or b"\0" * (len(p) // 4) for x, p in zip(table.column("marks").to_pylist(), table.column("places").to_pylist(), strict=True)]
    return pa.table([pa.array([home] * n, pa.int32()), table.column("owners"), table.column("counts"), table.column("places"), pa.array(marks, pa.binary())], schema=_HOME)


def _compare(key_type, n_buckets: int):
    """Sort one bucket and compare neighbours: what stands twice goes home, marked 1 where it is the first."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("target")[0].as_py() < 0:
            return _passed_on(table)
        release()
        keys = joined(table, "keys", key_type)
        places = joined(table, "places", np.uint32)
        often = joined(table, "marks", np.uint8).astype(bool)
        ids = owners_of(table)
        order = np.argsort(keys)
        keys, places, often, ids = keys[order], places[order], often[order], ids[order]
        same = keys[1:] == keys[:-1]
        shared = often.copy()
        shared[1:] |= same
        shared[:-1] |= same
        keys, places, ids = keys[shared], places[shared], ids[shared]
        order = np.lexsort((places, ids, keys))
        keys, places, ids, often = keys[order], places[order], ids[order], often[shared][order]
        # A row that is there twice sends the same entry twice, which is no repeat.
        again = np.zeros(len(keys), bool)
        again[1:] = (keys[1:] == keys[:-1]) & (ids[1:] == ids[:-1]) & (places[1:] == places[:-1])
        heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        real = np.add.reduceat((~again).astype(np.int64), heads) + np.add.reduceat(often.astype(np.int64), heads) > 1 if len(heads) else np.zeros(0, bool)
        keep = ~again & np.repeat(real, np.diff(heads, append=len(keys)))
        keys, places, ids = keys[keep], places[keep], ids[keep]
        first = np.ones(len(keys), np.uint8)
        first[1:] = keys[1:] != keys[:-1]
        return _to_homes(ids, places, first, n_buckets)

    return run


def _marked_suffixes(table: pa.Table) -> pa.Table:
    """Of one home: the marked suffixes of each document."""
    ids, places = owners_of(table), joined(table, "places", np.uint32)
    order = np.lexsort((places, ids))
    ids, places = ids[order], places[order]
    heads = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else np.zeros(0, np.int64)
    ends = np.append(heads, len(ids))[1:]
    return pa.table({"doc_id": pa.array(ids[heads], pa.int64()), "marked": pa.array([np.unique(places[a:b]).tobytes() for a, b in zip(heads, ends, strict=True)], pa.binary())})


def _send_windows(size: int, n_buckets: int):
    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        gathered = 0

        def flush():
            keys, ids, places = _distinct(*(np.concatenate(c) for c in zip(*held, strict=True)))
            first, counts = _firsts(keys)
            marks = (counts > 1).astype(np.uint8)
            rows = list(deal(bucket_of(keys[first], n_buckets), n_buckets, ids[first], keys[first], places[first], marks))
            later = np.ones(len(keys), bool)
            later[first] = False
            for t, owners, counts_, places_ in deal(home_of(ids[later], n_buckets), n_buckets, ids[later], places[later]):
                rows.append((-1 - t, owners, counts_, b"", places_, b""))
            return batch_of(rows, _SENT)

        for batch in slices(batches, "text"):
            words = Words(batch.column("text"))
            hashes = words.hashes()
            starts, row, place, _ = _windows(words, hashes, size)
            ids = batch.column("doc_id").to_numpy()
            marked = np.zeros(len(hashes), bool)
            for i, blob in enumerate(batch.column("marked").to_pylist()):
                marked[np.frombuffer(blob, np.uint32) + words.first[i]] = True
            ask = marked[place]
            starts, row = starts[ask], row[ask]
            held.append((window_hashes(hashes, size)[starts], ids[row], (starts - words.first[row]).astype(np.uint32)))
            gathered += len(starts)
            if gathered >= FLUSH_WORDS:
                yield flush()
                held, gathered = [], 0
                release()
        if gathered:
            yield flush()

    return run


_PASSAGES = pa.schema([("doc_id", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("kept", pa.bool_())])


def _passages(size: int):
    """Of one home: maximal runs of words that windows cover, repeats before first places."""

    def run(table: pa.Table) -> pa.Table:
        ids, starts = owners_of(table), joined(table, "places", np.uint32).astype(np.int64)
        first = joined(table, "marks", np.uint8).astype(bool)
        order = np.lexsort((starts, ids))
        ids, starts, first = ids[order], starts[order], first[order]
        out = [[], [], [], []]
        heads = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else np.zeros(0, np.int64)
        for a, b in zip(heads, np.append(heads, len(ids))[1:], strict=True):
            at, kind = starts[a:b], first[a:b]
            length = int(at[-1]) + size
            cover = np.zeros((2, length + 1), np.int32)
            for k in (0, 1):
                mine = at[kind == bool(k)]
                np.add.at(cover[k], mine, 1)
                np.add.at(cover[k], mine + size, -1)
            repeat, kept = np.cumsum(cover, axis=1) > 0
            state = np.concatenate(([0], np.where(repeat, 1, np.where(kept, 2, 0))[:length], [0]))
            edges = np.flatnonzero(state[1:] != state[:-1])
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                if s := state[x + 1]:
                    for column, value in zip(out, (ids[a], x, y, s == 2), strict=True):
                        column.append(value)
        return pa.table([pa.array(c, t) for c, t in zip(out, _PASSAGES.types, strict=True)], schema=_PASSAGES)

    return run


def repeated_passages(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Passages of min_words words or more that stand at two places or more, in one document or several.

    docs: doc_id (integer) and text; other columns and rows of null doc_id are left out, and rows
    of one doc_id with the same text are one.
    ASCII letters are lower-cased; words are runs of anything but ASCII white space.
    Returns a row for each run of repeated words: doc_id, start_word, end_word (exclusive),
    and kept: false where each word lies in a window that stands earlier too, by
    doc_id and place, true for first places. Documents without one have no row.
    """
    if min_words < 2:
        raise ValueError("min_words must be 2 or more")
    spark = docs.sparkSession
    ws = Workspace(spark, "suffix-dedup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    # About a word in six bytes; two suffixes in each window's width.
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_buckets = buckets_for(spark, size // 6 * 4 // min_words, BUCKET_ITEMS)
    sent = docs.mapInArrow(_send_suffixes(min_words, n_buckets), _SENT_SQL)
    homes = sent.groupBy("target").applyInArrow(_compare(np.uint32, n_buckets), _HOME_SQL)
    marked = ws.table(homes.groupBy("home").applyInArrow(_marked_suffixes, "doc_id long, marked binary"))
    texts = prefilter(docs, "doc_id", marked.select("doc_id")).join(marked, "doc_id")
    windows = marked.agg(F.coalesce(F.sum(F.octet_length("marked")), F.lit(0))).first()[0] // 4 * min_words // 4
    n_buckets = buckets_for(spark, windows, BUCKET_ITEMS)
    sent = texts.mapInArrow(_send_windows(min_words, n_buckets), _SENT_SQL)
    homes = sent.groupBy("target").applyInArrow(_compare(U64, n_buckets), _HOME_SQL)
    return homes.groupBy("home").applyInArrow(_passages(min_words), "doc_id long, start_word long, end_word long, kept boolean")


def _cut(columns: list[str]):
    def run(batches):
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"))
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            out = []
            for i, (text, cuts) in enumerate(zip(texts, batch.column("__cuts").to_pylist(), strict=True)):
                if cuts:
                    base, at, parts = words.offsets[i], 0, []
                    for a, b in sorted((c["start_word"], c["end_word"]) for c in cuts):
                        begin = int(words.start[words.first[i] + a] - base)
                        parts.append(text[at:begin])
                        at = int(words.end[words.first[i] + b - 1] - base)
                    text = b"".join([*parts, text[at:]])
                out.append(text)
            texts = pa.array(out, pa.large_binary()).cast(pa.large_string())
            yield pa.record_batch([texts.cast(pa.string()) if c == "text" else pc.utf8_length(texts).cast(pa.int64()) if c == "n_chars" else batch.column(c) for c in columns], names=columns)

    return run


def remove_repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """docs, all rows and columns, with repeats of passages cut from text; first places stay.

    The white space around a cut stays. n_chars, if docs has it, is set anew.
    """
    passages = Workspace(docs.sparkSession, "suffix-cuts").table(repeated_passages(docs, min_words).where("NOT kept"))
    cuts = passages.groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias("__cuts"))
    columns = docs.columns
    schema = docs.schema
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.col("n_chars").cast("long"))
        schema = docs.schema
    maybe, rest = split(docs, "doc_id", passages.select("doc_id"))
    joined_rows = maybe.join(cuts, "doc_id", "left").select(*columns, "__cuts").unionByName(rest.withColumn("__cuts", F.lit(None).cast(cuts.schema["__cuts"].dataType)))
    return joined_rows.mapInArrow(_cut(columns), schema)
