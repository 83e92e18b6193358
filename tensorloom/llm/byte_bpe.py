"""Byte-level BPE encoding and decoding with the tokenizers library.

A text is split by the vocabulary's pattern; the bytes of each piece are mapped to the
printable characters that byte-level vocabularies use, and the tokenizers library merges
them. Pieces repeat, so each task keeps a bounded table from piece to ids and
sends the library only pieces that it has not seen. Decoding looks up each id's
characters, maps them back to bytes, and only then reads UTF-8, so that a character
whose bytes lie in several tokens comes back whole.
"""

from __future__ import annotations

import base64
import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame

from ._blobs import extended
from ._spark import release, slices

#: Pieces that each of a task's two tables holds (about 60 MB). A full table becomes the older
#: one, from which pieces that come up again move to the new one.
TABLE_PIECES = 300_000


def byte_characters() -> list[str]:
    """Character of each byte: printable ones stand for themselves, others follow 255 in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Token bytes and ids of a vocabulary file: base64 and rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines.splitlines() if line)}


def merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two tokens of lower rank whose merge makes this one."""
    limit = ranks[token]
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
        if rank >= limit:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], b"".join(parts[1:])


class ByteBpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        chars = byte_characters()
        shown = lambda raw: "".join(map(chars.__getitem__, raw))
        self._characters = chars
        vocab = {shown(token): rank for token, rank in ranks.items()}
        merges = [tuple(map(shown, merge_of(token, ranks))) for token in sorted((t for t in ranks if len(t) > 1), key=ranks.get)]
        self._model = tokenizers.Tokenizer(tokenizers.models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
        self._pattern = regex.compile(pattern)
        back = {c: b for b, c in enumerate(chars)}
        self.size = max(ranks.values()) + 1
        self._bytes: list[bytes] = [b""] * self.size
        for token, rank in vocab.items():
            self._bytes[rank] = bytes(map(back.__getitem__, token))
        self._lengths = np.array([len(b) for b in self._bytes], np.int64)
        self._table: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> None:
        new = list(pieces)
        chars = self._characters
        mapped = ["".join(map(chars.__getitem__, p.encode())) for p in new]
        for at in range(0, len(new), 4096):
            found = self._model.encode_batch_fast(mapped[at : at + 4096], add_special_tokens=False)
            self._table.update((piece, array("i", one.ids).tobytes()) for piece, one in zip(new[at : at + 4096], found, strict=True))

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; none for a null or empty one."""
        if not text:
            return np.zeros(0, np.int32)
        pieces = self._pattern.findall(text)
        table = self._table
        if unseen := set(pieces).difference(table):
            if len(table) + len(unseen) > TABLE_PIECES:
                self._older, self._table = table, {}
                table, unseen = self._table, set(pieces)
            older = self._older
            table.update((p, older[p]) for p in unseen if p in older)
            self._learn(unseen.difference(older))
        return np.frombuffer(b"".join(map(table.__getitem__, pieces)), np.int32)

    def forget(self) -> None:
        """Empty the tables, so that a worker that goes on to other work does not hold them."""
        self._table, self._older = {}, {}
        release()

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids; characters that were split between tokens are whole again."""
        return b"".join([self._bytes[i] for i in ids.tolist()])

    def offsets(self, text: str | None, ids: np.ndarray) -> np.ndarray:
        """Where in the text (in characters) each token starts; a token that starts inside a
        character has that character's place."""
        raw = np.frombuffer((text or "").encode(), np.uint8)
        if not len(ids):
            return np.zeros(0, np.int32)
        starts = np.cumsum(self._lengths[ids]) - self._lengths[ids]
        return (np.cumsum((raw & 0xC0) != 0x80) - 1)[starts].astype(np.int32)


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBpe:
    """The vocabulary at a path that every executor has (an installed package's file)."""
    # A task has one core: threads of the library would only take turns on it.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    with open(path, "rb") as f:
        return ByteBpe(read_ranks(f.read()), pattern)


def _list_of(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


def bpe_encode(docs: DataFrame, path: str, pattern: str, *, text: str = "text", offsets: bool = False, keep_tables: bool = True) -> DataFrame:
    """docs with ``ids`` (array<int>), and with ``offsets`` the place of each token in characters.

    Every column of docs stays but an old one named ids or offsets. A null or empty text
    has no ids. No special tokens are added; their strings are ordinary text. keep_tables: workers keep
    their tables of pieces for the next task; without, memory is free for other stages.
    """
    added = ["ids", "offsets"] if offsets else ["ids"]
    kept = [c for c in docs.columns if c not in added or c == text]
    docs = docs.select(*kept)

    def run(batches):
        bpe = load(path, pattern)
        for batch in slices(batches, text, 2 << 20):
            texts = batch.column(text).to_pylist()
            ids = [bpe.encode(t) for t in texts]
            more = [_list_of(ids)]
            if offsets:
                more.append(_list_of([bpe.offsets(t, i) for t, i in zip(texts, ids, strict=True)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*kept, *added])
        if not keep_tables:
            bpe.forget()

    return docs.mapInArrow(run, extended(docs.schema, ", ".join(f"{name} array<int>" for name in added)))


def bpe_decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """encoded with ``decoded`` (binary): the bytes of ``ids``; null ids decode to no bytes."""
    kept = [c for c in encoded.columns if c != "decoded"]
    encoded = encoded.select(*kept)

    def run(batches):
        bpe = load(path, pattern)
        for batch in batches:
            rows = [bpe.decode(np.asarray(x.values)) if x.is_valid else b"" for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.binary())], names=[*kept, "decoded"])

    return encoded.mapInArrow(run, extended(encoded.schema, "decoded binary"))


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path and pattern of a public vocabulary that is installed beside this package."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN
