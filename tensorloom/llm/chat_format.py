"""Chat formatting by columnar byte assembly.

Turns become segments (header, escaped text, footer). For a batch of whole conversations
the lengths of all segments, their cumulative offsets and the gather index are computed in numpy,
and one preallocated buffer takes all headers and contents: it is the Arrow string column
of the result. No text is joined in Python.

Template::

    system     [SYS] text [/SYS]
    user       [INST] text [/INST]
    assistant  <s>text</s>
    others     [ROLE:name] text [/ROLE]

A control string inside a text gets a backslash after its first character, and one more
if it has some already, so that no text holds a control string and the escape can
be undone exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Header and footer of each role that has its own.
ROLES = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
OTHER_FOOTER = " [/ROLE]"
_TAILS = r"/?s>|/?SYS\]|/?INST\]|ROLE:|/ROLE\]"
_ESCAPE = rf"([<\[])(\\*)({_TAILS})"
_UNESCAPE = re.compile(rf"([<\[])(\\*)\\({_TAILS})")
_HEADER = re.compile(r"\[SYS\] |\[INST\] |<s>|\[ROLE:([^\]]*)\] ")
_BY_HEADER = {head: (role, foot) for role, (head, foot) in ROLES.items()}


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def _marks(role: str | None) -> tuple[bytes, bytes]:
    """Header and footer; a null role is an empty one."""
    head, foot = ROLES.get(role) or (f"[ROLE:{quote(role or '', safe=' ')}] ", OTHER_FOOTER)
    return head.encode(), foot.encode()


def assemble(batch: pa.Table, conv: str = "conv_id") -> pa.RecordBatch:
    """Formatted conversations of rows that are sorted by conversation and turn."""
    n = batch.num_rows
    conv_ids = batch.column(conv).combine_chunks()
    keys = pc.fill_null(conv_ids, 0).to_numpy(zero_copy_only=False)
    null = np.asarray(conv_ids.is_null())
    heads_at = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (null[1:] != null[:-1]))))
    roles = batch.column("role").combine_chunks().dictionary_encode()
    names = roles.dictionary.to_pylist()
    marks = [_marks(x) for x in names] + [_marks(None)]
    which = pc.fill_null(roles.indices, len(names)).to_numpy(zero_copy_only=False)
    texts = pc.fill_null(batch.column("text").combine_chunks().cast(pa.large_string()), "")
    texts = pc.replace_substring_regex(texts, _ESCAPE, r"\1\2\\\3")
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    # All source bytes side by side: contents first, then every header and footer once.
    pool = b"".join(x for pair in marks for x in pair)
    sizes = np.array([len(x) for pair in marks for x in pair], np.int64)
    places = len(raw) + np.cumsum(sizes) - sizes
    source = np.concatenate((raw, np.frombuffer(pool, np.uint8)))
    start = np.stack((places[2 * which], offs[:-1], places[2 * which + 1]), axis=1).ravel()
    length = np.stack((sizes[2 * which], np.diff(offs), sizes[2 * which + 1]), axis=1).ravel()
    end = np.cumsum(length)
    total = int(end[-1]) if n else 0
    gather = np.arange(total) + np.repeat(start - (end - length), length)
    out = source[gather]
    turn_ends = end[2::3]
    bounds = np.concatenate((heads_at, [n]))
    text_offsets = np.concatenate(([0], turn_ends))[bounds]
    formatted = pa.LargeStringArray.from_buffers(len(heads_at), pa.py_buffer(text_offsets.astype(np.int64)), pa.py_buffer(out))
    # The loss mask: byte ranges of assistant contents within their conversation.
    spoken = np.flatnonzero(which == names.index("assistant")) if "assistant" in names else np.zeros(0, np.int64)
    owner = np.searchsorted(heads_at, spoken, side="right") - 1
    cuts = pa.array(np.searchsorted(owner, np.arange(len(heads_at) + 1)).astype(np.int32))
    begin = (end[1::3] - length[1::3])[spoken] - text_offsets[owner]
    stop = end[1::3][spoken] - text_offsets[owner]
    return pa.record_batch({
        conv: conv_ids.take(pa.array(heads_at)),
        "formatted": formatted.cast(pa.string()) if total < 2**31 else formatted,
        "loss_start": pa.ListArray.from_arrays(cuts, pa.array(begin, pa.int64())),
        "loss_end": pa.ListArray.from_arrays(cuts, pa.array(stop, pa.int64())),
    })


def _whole(batches: Iterator[pa.RecordBatch], conv: str, max_bytes: int = 8 << 20) -> Iterator[pa.Table]:
    """Tables of about max_bytes that hold whole conversations, from sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        # Small steps bound the memory of the gather index, at 16 bytes a byte.
        step = max(1, int(batch.num_rows * max_bytes / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            ids = part.column(conv).to_pylist()
            last = len(ids)
            while last and ids[last - 1] == ids[-1]:
                last -= 1
            if held and ids[0] != held[-1].column(conv)[-1].as_py():
                yield pa.Table.from_batches(held)
                held = []
            if last:
                yield pa.Table.from_batches([*held, part.slice(0, last)])
                held = []
            held.append(part.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def format_chat(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Format conversations: one row each with conv_id, formatted (string), and loss_start and
    loss_end (arrays: byte ranges of assistant texts in formatted).

    turns: conv_id (integer), turn, role, text; other columns are left out. Rows are
    taken by turn (nulls first); rows of one turn by role and text. Null text is empty, null
    role is an empty name, and rows of null conv_id are one conversation.
    """
    rows = turns.select(conv, "turn", "role", "text")

    def run(batches):
        for table in _whole(batches, conv):
            yield assemble(table, conv)

    sorted_rows = rows.repartition(conv).sortWithinPartitions(conv, "turn", "role", "text")
    kind = dict(rows.dtypes)[conv]
    return sorted_rows.mapInArrow(run, f"{conv} {kind}, formatted string, loss_start array<bigint>, loss_end array<bigint>")


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and unescaped texts of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        head = _HEADER.match(formatted, at)
        role, foot = _BY_HEADER.get(head[0]) or (unquote(head[1]), OTHER_FOOTER)
        stop = formatted.index(foot, head.end())
        out.append((role, unescape(formatted[head.end() : stop])))
        at = stop + len(foot)
    return out
