"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark texts and documents are normalised alike: ASCII letters lower-cased, words
of letters, digits and non-ASCII characters, one space between words. Each window of
consecutive item words is a pattern, bounded by spaces, and one automaton reads a
normalised text once. A match's end gives its last word by counting spaces; words are
mapped to places in the original text.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Workspace, slices
from ._words import NON_ALNUM, Words

#: Words of benchmark text in one automaton (about 65 bytes of patterns each). A larger
#: benchmark is dealt to several automata, each of which reads the documents once.
AUTOMATON_WORDS = 200_000
#: Bytes of benchmark text that are taken to the driver and sent to every worker; more are refused.
MOST_BYTES = 256 << 20


def _table() -> bytes:
    table = bytearray(range(256))
    for b in NON_ALNUM:
        table[b] = 0x20
    for b in range(65, 91):
        table[b] = b + 32
    return bytes(table)


_NORMAL = _table()


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


class Automaton:
    """Windows of item words; one byte is one character, so that places are byte places."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        owners: dict[bytes, set[str]] = {}
        for item, text in items:
            words = normal_words(text)
            for at in range(max(1, len(words) - window + 1) if words else 0):
                owners.setdefault(b" ".join(words[at : at + window]), set()).add(item)
        self._auto = ahocorasick.Automaton()
        for pattern, own in owners.items():
            self._auto.add_word(f" {pattern.decode('latin-1')} ", (pattern.count(b" ") + 1, own))
        self._any = bool(owners)
        if owners:
            self._auto.make_automaton()

    def scan(self, text: str | None) -> tuple[int, np.ndarray, np.ndarray, set[str]]:
        """Words of the text, merged ranges of hit words (starts and ends), and the items."""
        words = normal_words(text)
        none = np.zeros(0, np.int64)
        if not self._any or not words:
            return len(words), none, none, set()
        line = f" {b' '.join(words).decode('latin-1')} "
        found = list(self._auto.iter(line))
        if not found:
            return len(words), none, none, set()
        blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 0x20)
        # The match ends on the blank after its last word; blank k stands before word k.
        ends = np.searchsorted(blanks, [end for end, _ in found])
        starts = ends - [value[0] for _, value in found]
        hit = np.zeros(len(words) + 1, np.int32)
        np.add.at(hit, starts, 1)
        np.add.at(hit, ends, -1)
        inside = np.concatenate(([False], np.cumsum(hit)[:-1] > 0, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        return len(words), edges[::2], edges[1::2], set().union(*(value[1] for _, value in found))


_made: dict[tuple, Automaton] = {}


def automaton_of(items: list[tuple[str, str | None]], window: int) -> Automaton:
    """The automaton of these items, made once in each worker, which keeps the latest one."""
    key = (window, tuple(items))
    if key not in _made:
        _made.clear()
        _made[key] = Automaton(items, window)
    return _made[key]


def _spans(text: str, starts: np.ndarray, ends: np.ndarray) -> list[dict]:
    """Word ranges with their places in the original text, in characters."""
    words = Words(pa.array([text], pa.large_string()), NON_ALNUM)
    places = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
    return [{"first_word": int(a), "end_word": int(b), "start": int(places[words.start[a]]), "end": int(places[words.end[b - 1]])} for a, b in zip(starts, ends, strict=True)]


_SPAN = "struct<first_word:bigint,end_word:bigint,start:bigint,end:bigint>"
_SPAN_TYPE = pa.struct([(x, pa.int64()) for x in ("first_word", "end_word", "start", "end")])


def _scan(items: list[tuple[str, str | None]], window: int, keep: tuple[str, ...]):
    def run(batches):
        auto = automaton_of(items, window)
        for batch in slices(batches, "text"):
            counts, spans, names = [], [], []
            for text in batch.column("text").to_pylist():
                n, starts, ends, found = auto.scan(text)
                counts.append(n)
                spans.append(_spans(text, starts, ends) if len(starts) else [])
                names.append(sorted(found))
            yield pa.record_batch([*(batch.column(c).cast(pa.int64()) for c in keep), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(_SPAN_TYPE)), pa.array(names, pa.list_(pa.string()))], names=[*keep, "n_words", "spans", "items"])

    return run


def _merged(rows: DataFrame) -> DataFrame:
    """One row per row number out of one per row number and automaton; spans that touch become one."""
    both = rows.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    empty = F.expr(f"cast(array() as array<{_SPAN}>)")

    def add(done, x):
        last = F.element_at(done, -1)
        joined = F.struct(last["first_word"].alias("first_word"), F.greatest(last["end_word"], x["end_word"]).alias("end_word"), last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end_word"] >= x["first_word"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    return both.withColumn("spans", F.aggregate(F.array_sort("spans"), empty, add)).drop("row")


def _groups(benchmark: DataFrame, automaton_words: int) -> list[list[tuple[str, str | None]]]:
    """Benchmark items, in groups of which each fits an automaton. A benchmark of more than MOST_BYTES raises ValueError."""
    bench = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item IS NOT NULL AND text IS NOT NULL")
    # Every word takes two bytes at least, so this bounds the words of a group.
    size, large = bench.agg(F.coalesce(F.sum(F.octet_length("text") / 2 + 1), F.lit(0.0)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if large > MOST_BYTES:
        raise ValueError(f"a benchmark of {large} bytes is larger than {MOST_BYTES}: scan for its parts one after another")
    groups = max(1, -(-int(size) // (3 * automaton_words)))
    parts = [bench] if groups == 1 else [bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == k) for k in range(groups)]
    return [[(r["item"], r["text"]) for r in part.collect()] for part in parts]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, *, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """Find benchmark text in documents.

    docs: doc_id (integer) and text; benchmark: item_id and text; other columns are left out.
    A window is a run of ``window`` consecutive words of an item; an item of fewer words, but
    not none, is one window. Returns per document: doc_id, n_words, spans (ranges of
    words inside any window's occurrence, with their places in the text), and items
    (item_ids as strings, sorted, of which a window occurs); rows of one doc_id, or of none, have a row of result each. Nulls have no words; an
    empty benchmark hits nothing; items that repeat are each reported.
    """
    docs, keep = docs.select("doc_id", "text"), ("doc_id",)
    groups = _groups(benchmark, automaton_words)
    if len(groups) > 1:
        # Row numbers have to be the same for every automaton, so they are written.
        docs, keep = Workspace(docs.sparkSession, "decontamination").table(docs.withColumn("row", F.monotonically_increasing_id())), ("row", "doc_id")
    schema = ", ".join([*(f"{c} bigint" for c in keep), f"n_words bigint, spans array<{_SPAN}>, items array<string>"])
    found = [docs.mapInArrow(_scan(items, window, keep), schema) for items in groups]
    if len(found) == 1:
        return found[0]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return _merged(rows)


def _clean(items: list[tuple[str, str | None]], window: int):
    def run(batches):
        auto = automaton_of(items, window)
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array([not len(auto.scan(t)[1]) for t in batch.column("text").to_pylist()], pa.bool_()))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, *, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """docs, all columns, without the documents that hold a window of any benchmark item."""
    for items in _groups(benchmark, automaton_words):
        docs = docs.mapInArrow(_clean(items, window), docs.schema)
    return docs
