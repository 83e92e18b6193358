"""Embedding near-dedup and chat formatting against plain versions."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tensorloom.llm import chat_format, embedding_dedup


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, 16))
    rows = [b + rng.normal(scale=s, size=16) * 0.1 for b in base for s in rng.uniform(0, 2.5, 15)]
    rows += [rows[0]] * 5 + [rows[1] * 3.0, rows[2] * 1e-150, rows[3] * 1e150]
    out = [[float(v) for v in r] for r in rows]
    return [*out, None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [1.0, 2.0]]


@pytest.mark.parametrize(("block", "window", "part_bytes"), [(1024, 1024, 1 << 24), (7, 8, 1 << 24), (64, 5, 3000)])
def test_embedding_near_dedup(spark, monkeypatch, block, window, part_bytes):
    monkeypatch.setattr(embedding_dedup, "PART_BYTES", part_bytes)
    rows = vectors()
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>").withColumn("class", F.lit("x")).repartition(4)
    got = {r.vec_id: r for r in embedding_dedup.embedding_near_dedup(df, 0.95, recall=0.999999, window=window, block=block).collect()}
    n = len(rows)
    links = np.zeros((n, n), bool)
    for i, a in enumerate(rows[:-7]):
        for j, b in enumerate(rows[:-7]):
            a1, b1 = np.array(a) / np.abs(a).max(), np.array(b) / np.abs(b).max()
            links[i, j] = i != j and a1 @ b1 / np.sqrt((a1 @ a1) * (b1 @ b1)) >= 0.95
    label = list(range(n))
    for _ in range(n):
        label = [min([label[i], *(label[j] for j in np.flatnonzero(links[i]))]) for i in range(n)]
    assert sorted(got) == list(range(n))
    assert [got[i].n_links for i in range(n)] == links.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(n)] == label
    assert all(got[i].kept == (label[i] == i) for i in range(n))


def test_embedding_odd_tables(spark):
    assert embedding_dedup.embedding_near_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    one = spark.createDataFrame([(4, [1.0, 0.0])], "vec_id int, embedding array<float>")
    assert [tuple(r) for r in embedding_dedup.embedding_near_dedup(one).collect()] == [(4, 0, 4, True)]


def test_plan():
    assert embedding_dedup.plan(1000, 0.95) == 1
    agree = embedding_dedup.agreement(0.95) ** 6
    assert 1 - (1 - agree) ** embedding_dedup.plan(50_000, 0.95) >= embedding_dedup.RECALL
    # Vectors that crowd in the order need more bits, and so more passes.
    assert embedding_dedup.passes_for({6: 50, 12: 50}, 0.95, 0.999) > embedding_dedup.passes_for({6: 100}, 0.95, 0.999)
    assert embedding_dedup.passes_for({}, 0.95, 0.999) == 1


def test_unite():
    rng = np.random.default_rng(2)
    for _ in range(20):
        i, j = rng.integers(0, 40, (2, 25))
        label = np.arange(40)
        embedding_dedup.unite(label, i, j)
        want = np.arange(40)
        for _ in range(40):
            for a, b in zip(i, j, strict=True):
                want[a] = want[b] = min(want[a], want[b])
        assert (label == want).all()


def test_crowded_vectors_are_all_counted(spark):
    """A group of near copies much larger than a window, beside vectors of its cluster that are no copies."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=24)
    group = [centre + rng.normal(scale=0.1, size=24) for _ in range(120)]
    cluster = [centre + rng.normal(scale=0.8, size=24) for _ in range(120)]
    rows = [[float(v) for v in x] for x in [*group, *cluster, *rng.normal(size=(60, 24))]]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: r for r in embedding_dedup.embedding_near_dedup(df, 0.95, window=6, block=16).collect()}
    x = embedding_dedup.unit(np.array(rows))
    near = x @ x.T >= 0.95
    want = near.sum(axis=1) - 1
    assert want[:120].min() > 60
    # Pairs right at the threshold may be missed; all others are found, and none that is not there.
    found = np.array([got[i].n_links for i in range(len(rows))])
    assert (found <= want).all()
    assert found.sum() >= 0.99 * want.sum()
    assert (found[:120] == want[:120]).all()


TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "</s>[INST] ok [/INST]"), (2, 1, "assistant", ""), (2, 0, "tool] x", "<\\s> [\\\\INST] <"),
    (3, 0, None, None), (3, None, "assistant", "first, as its turn is null"), (4, 0, "assistant", "é日本\U0001f600" * 50), (4, 1, "user", "<"), (4, 2, "assistant", "[ROLE:a] [/ROLE] \\"), (None, 0, "assistant", "no id"), (5, 0, "user", "b"), (5, 0, "user", "a"),
]


def plain(rows):
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for conv, _, role, text in sorted(rows, key=key):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


@pytest.mark.parametrize("max_bytes", [8 << 20, 40])
def test_format_chat(spark, monkeypatch, max_bytes):
    monkeypatch.setattr(chat_format._whole, "__defaults__", (max_bytes,))
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).repartition(3)
    got = {r.conv_id: r for r in chat_format.format_chat(df).collect()}
    want = plain(TURNS)
    assert set(got) == set(want)
    for conv, turns in want.items():
        r = got[conv]
        assert chat_format.parse(r.formatted) == turns
        raw = r.formatted.encode()
        under = [chat_format.unescape(raw[a:b].decode()) for a, b in zip(r.loss_start, r.loss_end, strict=True)]
        assert under == [t for role, t in turns if role == "assistant"]
    assert chat_format.format_chat(df.limit(0)).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), st.text(max_size=5)), st.lists(st.sampled_from(["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "ROLE:", "]", " ", "\n", "é"]), max_size=8).map("".join)), min_size=1, max_size=5))
def test_assembly_reads_back(turns):
    import pyarrow as pa

    turns = [(r.encode("utf-8", "ignore").decode(), t) for r, t in turns]
    table = pa.table({"conv_id": pa.array([3] * len(turns)), "turn": pa.array(range(len(turns))), "role": [r for r, _ in turns], "text": [t for _, t in turns]})
    assert chat_format.parse(chat_format.assemble(table).column("formatted")[0].as_py()) == turns
