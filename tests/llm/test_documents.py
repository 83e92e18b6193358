"""Operators on documents against brute force, with nulls, empty and odd texts, copies and clashing columns."""

import hashlib
import math
import random
import re
import time
import uuid
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tensorloom.llm import byte_bpe, decontamination, hmm_lm, license_scan, ngram_join, sharding, suffix_dedup, toxicity
from tensorloom.llm._spark import Workspace, components, prefilter, shared_dir, without_old_shuffles
from tensorloom.llm._words import NON_ALNUM, Words

VOCAB = ["the", "of", "And", "word", "été", "straße", "x1", "don't", "日本", "z", "alpha", "beta", "gamma", "delta", "eps"]


def texts(seed=1, n=60):
    rng = random.Random(seed)
    make = lambda k: " ".join(rng.choice(VOCAB) + str(rng.randrange(40)) for _ in range(k))
    out = [None, "", "   \n\t", "one", "One", "two words", "a b c", "\x1c\x85 odd  spaces", "\U0001f600 emoji \U0001f600"]
    base = [make(k) for k in (8, 30, 60, 120, 400)]
    for _ in range(n):
        words = rng.choice(base).split(" ")
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = make(1)
        out.append(" ".join(words))
    out += base + base + [make(90) + "\n" + base[3] + " " + make(70) for _ in range(4)]
    rng.shuffle(out)
    return out


def frame(spark, rows, extra=True):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(5)
    if extra:
        for name in ("fp", "grams", "n", "class", "a", "target", "marked", "home", "score", "items", "_word"):
            df = df.withColumn(name, F.lit(name))
    return df


def lower(text):
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())


def words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", lower(text))


def alnum(text):
    return re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))


def roots(n, links):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def jaccard_classes(rows, k, percent):
    sets = [frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w := words(t)) >= k else frozenset([tuple(w)] if w else []) for t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return [len(s) for s in sets], roots(len(rows), links)


def jaccard_links(rows, k, percent):
    sets = [frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w := words(t)) >= k else frozenset([tuple(w)] if w else []) for t in rows]
    return [sum(bool(a) and i != j and 100 * len(a & b) >= percent * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]


@pytest.mark.parametrize(("ngram", "percent", "block", "heavy", "dealt"), [(4, 85, 1_000_000, 32, 4096), (2, 60, 500, 3, 4096), (3, 70, 300, 2, 3), (1, 50, 400, 4, 7)])
def test_ngram_join(spark, monkeypatch, ngram, percent, block, heavy, dealt):
    monkeypatch.setattr(ngram_join, "HEAVY_LEAST", heavy)
    monkeypatch.setattr(ngram_join, "FLUSH_GRAMS", 2000)
    monkeypatch.setattr(ngram_join, "DEALT", dealt)
    monkeypatch.setattr(ngram_join, "BUCKET_GRAMS", 1500)
    monkeypatch.setattr(ngram_join, "INCIDENCE", 50)
    rows = texts(ngram)
    got = ngram_join.ngram_jaccard_join(frame(spark, rows), ngram, percent, links=True, block_grams=block).collect()
    sizes, least = jaccard_classes(rows, ngram, percent)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == sorted(zip(range(len(rows)), sizes, least, jaccard_links(rows, ngram, percent), strict=True))
    plain = ngram_join.ngram_jaccard_join(frame(spark, rows), ngram, percent, block_grams=block)
    assert plain.columns == ["doc_id", "n_shingles", "component_id"]


def test_grams_that_fall_together_are_counted_once():
    grams = np.array([5, (9 << 40) | 7, (9 << 40) | (3 << 32) | 7, (200 << 55) | 7], np.uint64)
    assert ngram_join._merged(grams, np.array([0, 0, 0, 0]), 4, 2).tolist() == [1, 0]
    assert ngram_join._merged(grams, np.array([0, 0, 1, 1]), 4, 2).tolist() == [0, 0]


def test_ngram_join_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.ngram_jaccard_join(empty).collect() == []
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (3, None), (2, "other words here and there now")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in ngram_join.ngram_jaccard_join(twice).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (2, 2), (3, 3)]
    kept = ngram_join.keep_one(twice)
    assert kept.columns == ["doc_id", "text"]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 1), (False, 3), (True, 0)]


def test_signature_tree_prunes_nothing_that_links():
    rng = np.random.default_rng(0)
    base = [np.unique(rng.integers(0, 1 << 63, 80).astype(np.uint64)) for _ in range(6)]
    sets = [np.unique(np.concatenate((b[rng.random(len(b)) > 0.08], rng.integers(0, 1 << 63, 4).astype(np.uint64)))) for b in base for _ in range(40)]
    tree = ngram_join.SignatureTree(sets)
    root = np.arange(len(sets))
    list(ngram_join.dual_traversal(tree, tree, root, root, 70))
    want = roots(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if ngram_join.linked(tree.sets[i], tree.sets[j], 70)])
    groups = lambda r: sorted(map(tuple, {x: np.flatnonzero(np.array(r) == x).tolist() for x in set(map(int, r))}.values()))
    assert groups(root) == groups(want)
    top = [x[0] for x in tree.levels[-1][:2]]
    assert (top[0] == np.bitwise_or.reduce(tree.bitmaps)).all()
    assert (top[1] == np.bitwise_and.reduce(tree.bitmaps)).all()


def brute_passages(rows, size):
    places = defaultdict(list)
    split = [words(t) for t in rows]
    for i, w in enumerate(split):
        for j in range(len(w) - size + 1):
            places[tuple(w[j : j + size])].append((i, j))
    state = [np.zeros(len(w), int) for w in split]
    for found in places.values():
        if len(found) > 1:
            for k, (i, j) in enumerate(sorted(found)):
                part = state[i][j : j + size]
                if k:
                    part[:] = 1
                else:
                    part[part == 0] = 2
    return state


@pytest.mark.parametrize(("size", "flush"), [(50, 600_000), (10, 500), (3, 300), (2, 600_000)])
def test_repeated_passages(spark, monkeypatch, size, flush):
    monkeypatch.setattr(suffix_dedup, "FLUSH_WORDS", flush)
    rows = [*texts(size), "same " * 120, "same " * 80]
    want = brute_passages(rows, size)
    got = [np.zeros(len(s), int) for s in want]
    for r in suffix_dedup.repeated_passages(frame(spark, rows), size).collect():
        got[r.doc_id][r.start_word : r.end_word] = 2 if r.kept else 1
    assert all((a == b).all() for a, b in zip(got, want, strict=True))
    cut = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(frame(spark, rows), size).collect()}
    for i, t in enumerate(rows):
        left = [w for w, s in zip(re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode()), want[i], strict=True) if s != 1]
        assert re.findall(rb"[^\x20\x09-\x0d]+", (cut[i] or "").encode()) == left
    assert cut[rows.index(None)] is None


def test_repeated_passages_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.repeated_passages(empty).collect() == []
    text = " ".join(f"w{k}" for k in range(60))
    twice = spark.createDataFrame([(1, text, 9), (1, text, 9), (None, text, 9)], "doc_id long, text string, n_chars int")
    assert suffix_dedup.repeated_passages(twice).collect() == []
    same = suffix_dedup.remove_repeats(twice)
    assert [(r.text, r.n_chars) for r in same.collect()] == [(text, len(text))] * 3
    with pytest.raises(ValueError):
        suffix_dedup.repeated_passages(twice, 1)


def test_minimisers():
    grams = np.array([5, 3, 3, 9, 1, 7, 1, 8, 2], np.uint64)
    for width in range(1, 10):
        want = [int(np.argmin(grams[j : j + width])) + j for j in range(len(grams) - width + 1)]
        assert suffix_dedup.minimisers(grams, width).tolist() == want
    assert len(suffix_dedup.minimisers(grams, 10)) == 0


def check_hmm(rows, got, held_out, states, symbols, rounds):
    """Counts, base score and the score itself by a plain forward pass over words, one text after another."""
    tokens = [[*words(t), None] for t in rows]
    learned = [ws for ws, out in zip(tokens, held_out, strict=True) if not out]
    train = Counter(w for ws in learned for w in ws)
    n, v = sum(train.values()), len(train)
    key = lambda w: int(Words(pa.array([w.decode()])).hashes()[0])
    own = sorted(sorted((w for w in train if w is not None), key=lambda w: (-train[w], np.int64(np.uint64(key(w)).view(np.int64))))[:symbols], key=key)
    number = {w: i for i, w in enumerate(own)}
    of_class = lambda w: (w[0] * 31 + w[min(1, len(w) - 1)]) % hmm_lm.CLASSES
    number[None] = len(own) + hmm_lm.CLASSES
    symbol = lambda w: number.get(w, len(own) + of_class(w) if w is not None else None)
    rare = {w: c for w, c in train.items() if w is not None and w not in number}
    mass = np.bincount([of_class(w) for w in rare], weights=[c + 1 for c in rare.values()], minlength=hmm_lm.CLASSES).astype(float)
    weights = np.concatenate(([train[w] for w in own], mass, [train[None]]))
    model, shares = hmm_lm.Hmm.initial(weights, states), np.full((states, len(weights)), 1 / states)
    told = [np.array([symbol(w) for w in ws], np.uint16) for ws in learned]
    for _ in range(rounds if told else 0):
        _, start, move, emit = model.run(told, learn=True)
        model = hmm_lm.Hmm.from_counts(start, move, emit, weights)
        smooth = emit + 1e-3 * emit.sum(axis=1, keepdims=True) / emit.sum() + 1e-9
        shares = smooth / smooth.sum(axis=0)
    expected = {w: np.zeros(states) for w in rare}
    posterior = model.run(told, posteriors=True)
    for w, p in zip((w for ws in learned for w in ws), posterior, strict=True):
        if w in expected:
            expected[w] += np.rint(p * 255)
    ratio = {}
    for w, c in rare.items():
        g = shares[:, len(own) + of_class(w)]
        e = expected[w] * c / expected[w].sum()
        ratio[w] = np.exp(np.clip(np.rint(16 * np.log((e + 2 * g) / ((c + 2) * g))), -128, 127) / 16)
    masses = np.ones((states, hmm_lm.CLASSES))
    for w, c in rare.items():
        masses[:, of_class(w)] += (c + 1) * ratio[w]

    def emission(w):
        p = model.emit[:, symbol(w)]
        if w is None or w in number:
            return p
        return p * (rare.get(w, 0) + 1) * ratio.get(w, np.ones(states)) / masses[:, of_class(w)]

    # Each state's emissions are a distribution: words, the end, and a place of each class for unseen words.
    whole = sum(emission(w) for w in train) + (model.emit[:, len(own) : -1] / masses).sum(axis=1)
    if train:
        assert np.allclose(whole, 1.0)
    assert len(got) == len(rows)
    for ws, r in zip(tokens, got, strict=True):
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(train[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9, abs_tol=1e-12)
        alpha, score = model.start, 0.0
        for k, w in enumerate(ws):
            alpha = (alpha @ model.move if k else alpha) * emission(w)
            score += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
        assert math.isclose(r.score, score, rel_tol=1e-4), (r.score, score)


def test_hmm_score(spark):
    rows = texts(3, 80)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    got = sorted(hmm_lm.hmm_score(frame(spark, rows), held, symbols=20, states=3, rounds=3).collect(), key=lambda r: r.doc_id)
    out = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(rows))]
    assert [r.held_out for r in got] == out
    check_hmm(rows, got, out, 3, 20, 3)
    told = [r for r in got if r.held_out]
    assert sum(r.score for r in told) > sum(r.base_score for r in told)


def test_hmm_score_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert hmm_lm.hmm_score(empty, F.lit(False)).collect() == []
    r = hmm_lm.hmm_score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(True)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0)
    assert math.isclose(r.base_score, 0.0, abs_tol=1e-12)


def test_hmm_score_wordless_and_repeated_rows(spark):
    blank = spark.createDataFrame([(1, None), (2, ""), (3, " \n")], "doc_id long, text string").repartition(2)
    for out in (False, True):
        got = hmm_lm.hmm_score(blank, F.lit(out), symbols=5, states=2, rounds=2).collect()
        check_hmm([None] * 3, got, [out] * 3, 2, 5, 2)
    # Blank rows with a partition to themselves, and several texts under one doc_id.
    rows = [None, "", "one two two", "three", "two one rare0 rare1", "one"]
    parts = spark.createDataFrame([(i, t) for i, t in enumerate(rows[:2])], "doc_id long, text string").coalesce(1)
    rest = spark.createDataFrame([(7, t) for t in rows[2:]], "doc_id long, text string")
    got = hmm_lm.hmm_score(parts.unionByName(rest), F.col("doc_id") == -1, symbols=2, states=2, rounds=2).collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 7, 7, 7, 7]
    first = sorted((r for r in got if r.doc_id < 7), key=lambda r: r.doc_id)
    rest = sorted((r for r in got if r.doc_id == 7), key=lambda r: (r.n_tokens, r.base_score))
    by_size = sorted(rows[2:], key=lambda t: len(words(t)))
    # "one" is the more frequent of the two texts of one word.
    by_size[:2] = ["three", "one"]
    check_hmm([*rows[:2], *by_size], [*first, *rest], [False] * 6, 2, 2, 2)


def test_hmm_words_are_told_once_a_block(spark):
    rows = [(i, "x x x x " + " ".join(f"rare{k}" for k in range(50) if k % 7 != i % 7), i % 5 == 0) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").coalesce(1)
    _, _, told, *_ = hmm_lm.learn(docs, Workspace(spark, "told"), symbols=1, states=2, rounds=1)
    # 50 words without a symbol, each in most of 100 documents of one block: a byte a word and state is sent.
    assert told.where(F.col(told.columns[0]) >= 0).agg(F.sum(F.octet_length("ratios"))).first()[0] == 2 * 50


def test_hmm_blocks_hold_whole_texts(monkeypatch):
    monkeypatch.setattr(hmm_lm, "BLOCK_TOKENS", 10)
    monkeypatch.setattr(hmm_lm, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 2)))
    rows = ["a b a", None, " ".join(["c"] * 60), "", "d a"]
    batches = [pa.record_batch({"doc_id": pa.array([i]), "held_out": pa.array([False]), "text": pa.array([t], pa.string())}) for i, t in enumerate(rows)]
    blocks = [b.to_pylist()[0] for b in hmm_lm._encode(np.zeros(0, np.uint64), np.zeros(0), np.zeros(hmm_lm.CLASSES), 0.0, True)(batches)]
    assert [b["block"] for b in blocks] == [(2 << 36) + k for k in range(3)]
    assert [np.frombuffer(b["sizes"], np.int64).tolist() for b in blocks] == [[4, 1], [61], [1, 3]]
    assert [len(b["keys"]) // 8 for b in blocks] == [2, 1, 2]


def test_whole_numbers_in_planes():
    for x, size in (([], 0), ([0], 1), ([0, 255], 2), ([256, 1, 70000], 9), ([2**40, 3, 0], 18)):
        data = hmm_lm.planes(np.array(x, np.int64))
        assert len(data) == size
        assert hmm_lm.numbers(data, len(x)).tolist() == x


def test_shuffle_files_go_with_their_action(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(re.findall(r"shuffle_\w+", disk.getAllFiles().mkString("\n")))
    before = files()
    with without_old_shuffles(spark):
        spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().write.parquet(f"{shared_dir(spark)}/counts-{uuid.uuid4().hex}")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_state_posteriors_match_enumeration():
    from itertools import product

    rng = np.random.default_rng(4)
    model = hmm_lm.Hmm(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), rng.dirichlet(np.ones(5), 2))
    told = [rng.integers(0, 5, n).astype(np.uint16) for n in (3, 5, 1)]
    want = []
    for x in told:
        p = np.zeros((len(x), 2))
        for z in product(range(2), repeat=len(x)):
            q = model.start[z[0]] * model.emit[z[0], x[0]] * np.prod([model.move[a, b] * model.emit[b, c] for a, b, c in zip(z, z[1:], x[1:], strict=False)])
            for t, s in enumerate(z):
                p[t, s] += q
        want.append(p / p.sum(axis=1, keepdims=True))
    assert np.allclose(model.run(told, posteriors=True), np.concatenate(want), atol=1e-5)


def test_counts_are_summed_in_levels(spark):
    rows = [(p, k, b, np.array([p, k, b], float).tobytes()) for p in range(200) for k in (-1, 0) for b in range(2)]
    got = hmm_lm.summed(spark.createDataFrame([(p, k, b, bytearray(c)) for p, k, b, c in rows], hmm_lm._COUNTS)).collect()
    assert sorted((r.kind, r.block, *np.frombuffer(r.counts).tolist()) for r in got) == [(k, b, 19900.0, 200.0 * k, 200.0 * b) for k in (-1, 0) for b in range(2)]


def test_hmm_is_a_distribution_and_counts_match_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    model = hmm_lm.Hmm(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), rng.dirichlet(np.ones(5), 2))
    told = [rng.integers(0, 5, n).astype(np.uint16) for n in (4, 1, 7, 7, 2)]
    likelihood, start, move, emit = model.run(told, learn=True)
    want = [0.0, np.zeros(2), np.zeros((2, 2)), np.zeros((2, 5))]
    for x in told:
        total, s, m, e = 0.0, np.zeros(2), np.zeros((2, 2)), np.zeros((2, 5))
        for z in product(range(2), repeat=len(x)):
            p = model.start[z[0]] * model.emit[z[0], x[0]]
            for a, b, c in zip(z, z[1:], x[1:], strict=False):
                p *= model.move[a, b] * model.emit[b, c]
            total += p
            s[z[0]] += p
            for a, b in zip(z, z[1:], strict=False):
                m[a, b] += p
            for a, c in zip(z, x, strict=True):
                e[a, c] += p
        want = [want[0] + math.log(total), want[1] + s / total, want[2] + m / total, want[3] + e / total]
    assert math.isclose(model.run(told).sum(), want[0], rel_tol=1e-12)
    for a, b in zip((start, move, emit), want[1:], strict=True):
        assert np.allclose(a, b, atol=1e-5)
    assert math.isclose(sum(math.exp(model.run([np.array(x, np.uint16)])[0]) for x in product(range(5), repeat=3)), 1.0, rel_tol=1e-9)


def test_byte_bpe(spark):
    import base64

    import public_tokenizers
    import tiktoken

    path, pattern = byte_bpe.vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rows = [*texts(5), "<|endoftext|> a", "it's  we'll\r\n\r\n  x", "a" * 3000, "\x00\x01﻿", "é ‍\U0001f469"]
    df = frame(spark, rows).withColumn("ids", F.lit(1)).withColumn("offsets", F.lit(1))
    got = byte_bpe.bpe_decode(byte_bpe.bpe_encode(df, path, pattern, offsets=True), path, pattern).collect()
    assert len(got) == len(rows)
    for r in got:
        text = rows[r.doc_id] or ""
        assert list(r.ids) == own.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()
        assert list(r.offsets) == own.decode_with_offsets(list(r.ids))[1] if text else r.offsets == []
    assert byte_bpe.bpe_encode(frame(spark, rows).limit(0), path, pattern).collect() == []


def test_byte_bpe_table_is_bounded(monkeypatch):
    monkeypatch.setattr(byte_bpe, "TABLE_PIECES", 20)
    bpe = byte_bpe.load(*byte_bpe.vocabulary())
    bpe._table.clear()
    for t in texts(6):
        assert bpe.decode(bpe.encode(t)) == (t or "").encode()


ITEMS = [(1, " ".join(f"q{k}" for k in range(30))), (2, "Short item, here"), (3, "q5 q6 q7 q8 q9 q10 q11 q12 q13 q14"), (4, None), (5, ""), (6, "!!!"), (7, "Short item, here"), (None, "x y")]


@pytest.mark.parametrize("automaton_words", [200_000, 10])
def test_decontaminate(spark, automaton_words):
    rows = [*texts(7, 10), "say q3 Q4, q5 q6 q7 q8 q9 q10 q11 q12 q13 q14 end", "é short ITEM here short item here", "q1 q2 q3", ITEMS[0][1] + " " + ITEMS[0][1]]
    bench = spark.createDataFrame(ITEMS, "item_id int, text string").withColumn("spans", F.lit(0))
    got = {r.doc_id: r for r in decontamination.decontaminate(frame(spark, rows), bench, 10, automaton_words=automaton_words).collect()}
    windows = defaultdict(set)
    for item, t in ITEMS:
        w = alnum(t)
        for j in range(max(1, len(w) - 9) if w and item is not None else 0):
            windows[tuple(w[j : j + 10])].add(str(item))
    for i, t in enumerate(rows):
        w, hit, items = alnum(t), set(), set()
        for window, own in windows.items():
            for j in range(len(w) - len(window) + 1):
                if tuple(w[j : j + len(window)]) == window:
                    hit.update(range(j, j + len(window)))
                    items |= own
        r = got[i]
        assert (r.n_words, {k for s in r.spans for k in range(s.first_word, s.end_word)}, list(r["items"])) == (len(w), hit, sorted(items))
        for s in r.spans:
            assert alnum(t[s.start : s.end]) == w[s.first_word : s.end_word]
    clean = decontamination.drop_contaminated(frame(spark, rows), bench, 10, automaton_words=automaton_words)
    assert {r.doc_id for r in clean.collect()} == {i for i in got if not got[i].spans}
    none = decontamination.decontaminate(frame(spark, rows), bench.limit(0))
    assert none.where("size(spans) > 0").isEmpty()
    assert none.count() == len(rows)


def test_benchmark_too_large(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "MOST_BYTES", 10)
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "eleven bytes")], "item_id long, text string")
    for run in (decontamination.decontaminate, decontamination.drop_contaminated):
        with pytest.raises(ValueError, match="larger"):
            run(docs, bench)


def test_decontaminate_rows_of_one_id(spark):
    one, two = (f"w {t} w" for t in (ITEMS[0][1], "q1 q2 q3"))
    rows = [(1, one), (1, two), (1, one), (None, one), (None, None), (None, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id int, text string")
    found = [sorted(map(str, decontamination.decontaminate(df, bench, 10, automaton_words=n).collect())) for n in (200_000, 10)]
    assert len(found[0]) == len(rows)
    assert found[0] == found[1]


def test_license_scan(spark):
    permission = license_scan.NOTICES[7][1]
    rows = [*texts(8, 10), "MIT\nlicense; mit license", "the General Public License", permission.upper(), permission.replace("obtaining", "getting") + " x", permission[:60], "Licensed under CC BY-NC 4.0.", "licensed under cc by-sa 4.0", "license mit"]
    got = {r.doc_id: r for r in license_scan.license_scan(frame(spark, rows)).collect()}
    for i, t in enumerate(rows):
        w = alnum(t)
        want = []
        for k, template in enumerate(license_scan.TEMPLATES):
            p = alnum(template.text)
            distinct = set(p)
            width = len(p) if template.phrase else min(len(p), len(w))
            for j in range(len(w) - width + 1 if width else 0):
                block = w[j : j + width]
                if template.phrase:
                    if block == p:
                        want.append((k, j, j + width, 1.0))
                elif len(distinct & set(block)) >= max(1, math.ceil(template.threshold * len(distinct) - 1e-9)):
                    want.append((k, j, j + width, len(distinct & set(block)) / len(distinct)))
        assert (got[i].n_words, [tuple(m) for m in got[i].matches]) == (len(w), want)
    assert license_scan.license_scan(frame(spark, rows).limit(0)).collect() == []


def test_license_bodies(spark):
    clauses = {k: [t for label, t in license_scan.CLAUSES if label == k] for k in ("mit", "bsd", "apache", "gpl")}
    # Warranty clauses and numbered conditions without the opening words, and a template of over 63 distinct words.
    rows = ["some words " * 9 + clauses["mit"][-1], clauses["bsd"][1].upper(), clauses["apache"][20], clauses["gpl"][40], *(" ".join(VOCAB) + f" {i}" for i in range(4))]
    long = license_scan.Template("long", " ".join(t for k in clauses.values() for t in k))
    assert len(set(alnum(long.text))) > 63
    rows.append(" ".join(long.text.split()[50:]))
    templates = (*license_scan.ALL_TEMPLATES, long)
    got = {r.doc_id: r for r in license_scan.license_scan(frame(spark, rows), templates).collect()}
    labels = [{templates[m.template].label for m in got[i].matches} for i in range(len(rows))]
    assert labels[:8] == [{"mit"}, {"bsd"}, {"apache"}, {"gpl"}, set(), set(), set(), set()]
    assert "long" in labels[8]
    for i in (0, 1, 2, 3):
        w = alnum(rows[i])
        for k, t in enumerate(templates):
            own, width = set(alnum(t.text)), min(len(alnum(t.text)), len(w))
            if not t.phrase:
                n = [len(own & set(w[j : j + width])) for j in range(len(w) - width + 1)]
                want = [(j, j + width, x / len(own)) for j, x in enumerate(n) if x >= max(1, math.ceil(t.threshold * len(own) - 1e-9))]
                assert [(m.start_word, m.end_word, m.containment) for m in got[i].matches if m.template == k] == want


def toxic_rows():
    rng = random.Random(4)
    bad = ["vile", "scummy", "rotten"]
    rows = []
    for i in range(400):
        sentences = [" ".join(rng.choice(VOCAB) + str(rng.randrange(9)) for _ in range(rng.randrange(3, 12))) for _ in range(rng.randrange(1, 8))]
        y = i % 4 == 0
        if y:
            k = rng.randrange(len(sentences))
            sentences[k] += " " + rng.choice(bad) + rng.choice(["", "er", "est"])
        rows.append((i, ". ".join(sentences) + ".", int(y)))
    return rows


def test_toxicity(spark):
    rows = toxic_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, truth int")
    labels = df.selectExpr("doc_id", "truth AS toxic").where("doc_id < 300").unionByName(spark.createDataFrame([(7, None), (None, 1), (8, 5)], "doc_id long, toxic int"))
    model = toxicity.train(df, labels)
    odd = spark.createDataFrame([(900, None, 0), (901, "", 0), (902, "!!", 0), (903, "word " * 20000, 0)], "doc_id long, text string, truth int")
    got = toxicity.score_toxicity(df.unionByName(odd), model, keep=["doc_id", "text", "truth"]).collect()
    assert len(got) == 404
    held = [r for r in got if r.doc_id >= 300]
    assert np.mean([(r.score >= 0.3) == bool(r.truth) for r in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in got)
    assert [r.score for r in sorted(held, key=lambda r: r.doc_id) if r.doc_id in (900, 901, 902)] == [0.0, 0.0, 0.0]
    found = [r.text[s.start : s.end] for r in held if r.truth for s in r.offending]
    assert found
    assert np.mean([any(b in f for b in ("vile", "scummy", "rotten")) for f in found]) > 0.9
    kept = toxicity.drop_toxic(df, model)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.score < 0.3 and r.doc_id < 900}


def plain_toxicity(model, text):
    """Noisy-or of a text's distinct sentences, each a sum of weights over its distinct words, one by one."""
    spans, said = [], lower(text)
    for part in re.split(rb"[.!?\n]", said):
        found = frozenset(re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", part))
        if found and found not in spans:
            spans.append(found)
    clean = 1.0
    for found in spans:
        z = model.bias
        for w in found:
            one = Words(pa.array([w.decode()], pa.large_string()), NON_ALNUM)
            z += sum(float(model.weights[f]) for f in toxicity.features(one, np.arange(1))[0])
        clean *= 1 - min(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), 1 - 1e-12)
    return 1 - clean


def test_toxicity_by_brute_force(spark):
    rng = np.random.default_rng(6)
    model = toxicity.Model(rng.normal(scale=0.4, size=1 << toxicity.BITS).astype(np.float32), -1.5)
    said = ["", None, "!?", "Vile. vile! clean words here\nclean words here. été ÉTÉ, Ünder", "no end", "a b a. b a! a b c", *texts(8, 20)]
    rows = [*enumerate(said), (3, "another text of one doc_id. vile"), (None, "a row of null id. vile")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("toxic", F.lit(1)).repartition(3)
    got = toxicity.score_toxicity(df, model, keep=["doc_id", "text"]).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(map(key, got)) == sorted(map(key, rows))
    for r in got:
        assert math.isclose(r.score, plain_toxicity(model, r.text), rel_tol=1e-5, abs_tol=1e-9)
        assert math.copysign(1, r.score) == 1


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = toxicity.train(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_toxicity(df, model).first().score < 0.3
    assert toxicity.score_toxicity(df.limit(0), model).collect() == []


def test_license_scan_odd_tables(spark):
    said = ["MIT License", None, "", "an mit license, and the MIT\tlicense", "apache license " * 3000]
    rows = [*enumerate(said), (0, "no words of one"), (0, "MIT License"), (None, "MIT license")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("matches", F.lit("clash")).withColumn("n_words", F.lit(None).cast("int")).repartition(3)
    got = license_scan.license_scan(df, license_scan.TEMPLATES).collect()
    base = lambda r: sum(license_scan.TEMPLATES[m.template].phrase for m in r.matches)
    found = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, base(r)) for r in got)
    assert found == sorted([(False, 0, 2, 1), (False, 0, 4, 0), (False, 0, 2, 1), (False, 1, 0, 0), (False, 2, 0, 0), (False, 3, 7, 2), (False, 4, 6000, 3000), (True, 0, 2, 1)])
    assert license_scan.license_scan(df.limit(0), license_scan.TEMPLATES).collect() == []


def test_repeats_do_not_add_up():
    model = toxicity.Model(np.zeros(1 << toxicity.BITS, np.float32), -2.0)
    score = lambda t: model.scores(Words(pa.array([t], pa.large_string()), NON_ALNUM))[0][0]
    assert math.isclose(score("a b. a b. a b."), score("a b."))
    assert score("a b. c d.") > score("a b.")


def test_lookup_table():
    names = [f"s{k}" for k in range(13)]
    table = sharding.lookup_table(names, 1009)
    counts = np.bincount(table, minlength=13)
    assert counts.sum() == 1009
    assert counts.max() - counts.min() <= 1
    # The brute-force version walks each shard's whole permutation.
    orders = []
    for name in names:
        digest = hashlib.sha256(name.encode()).digest()
        start, step = int.from_bytes(digest[:8], "big") % 1009, int.from_bytes(digest[8:16], "big") % 1008 + 1
        orders.append([(start + k * step) % 1009 for k in range(1009)])
        assert len(set(orders[-1])) == 1009
    want, turn = {}, 0
    while len(want) < 1009:
        want[next(s for s in orders[turn % 13] if s not in want)] = turn % 13
        turn += 1
    assert table.tolist() == [want[s] for s in range(1009)]
    smaller = sharding.lookup_table(names[:-1], 1009)
    moved = (table != smaller) & (table != 12)
    assert moved.mean() < 0.2
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 10)


def test_place(spark, tmp_path):
    names = ["a", "b", "c"]
    df = spark.createDataFrame([(1, 5), (1, 6), (None, 7), (2, 8)], "k long, shard int")
    got = sharding.place(df, "k", names, 101)
    assert got.columns == ["k", "slot", "shard"]
    rows = got.collect()
    table = sharding.lookup_table(names, 101)
    assert len(rows) == 4
    assert all(r.shard == table[r.slot] for r in rows)
    assert len({r.slot for r in rows if r.k == 1}) == 1
    assert sharding.place(df.limit(0), "k", names).collect() == []
    sharding.write_shards(df.select("k"), "k", names, str(tmp_path / "out"), file_rows=1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_components_and_prefilter(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(7, 7)]
    ws = Workspace(spark, "test")
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), ws).collect()}
    want = roots(200, edges)
    touched = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: want[x] for x in touched}
    big, few = spark.range(5000).withColumnRenamed("id", "k"), spark.createDataFrame([(5,), (77,), (77,)], "k long")
    kept = {r.k for r in prefilter(big, "k", few).collect()}
    assert {5, 77} <= kept
    assert len(kept) < 50


def test_toxicity_learns_from_the_whole_sample(spark):
    assert toxicity.SAMPLE_BYTES == 24 << 20
    # Words that agree in seven bytes share a feature that words agreeing in six do not have.
    words = Words(pa.array(["abcdefgh abcdefgx abcdefxx"], pa.large_string()), NON_ALNUM)
    f = toxicity.features(words, np.arange(3))
    assert [len(set(f[0]) & set(f[k])) for k in (1, 2)] == [5, 4]
    # Sentence numbers are held once for a word, not once for a feature.
    (feats, which), = toxicity.featurized(pa.chunked_array([pa.array(["a b. c d."], pa.large_string())]))
    assert feats.shape == (4, 1 + len(toxicity.BEGINNINGS))
    assert feats.dtype == which.dtype == np.int32
    assert which.tolist() == [0, 0, 1, 1]


def test_toxicity_passes_over_texts_that_do_not_fit(spark):
    assert toxicity.fitting(np.array([50, 3, 8, 4, 3]), 10).tolist() == [False, True, False, True, True]
    rows = toxic_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, truth int")
    room = 2 * max(sum(len(t) for _, t, y in rows if y == k) for k in (0, 1))
    # A text of each label that is first in hash order and longer than the room.
    first = df.selectExpr("min(xxhash64(doc_id))").first()[0]
    early = [r.id for r in spark.range(1000, 200000).where(f"xxhash64(id) < {first}").limit(2).collect()]
    both = df.unionByName(spark.createDataFrame([(i, "x" * room, y) for y, i in enumerate(early)], "doc_id long, text string, truth int"))
    model = toxicity.train(both, both.selectExpr("doc_id", "truth AS toxic"), sample_bytes=room)
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(df, model).collect()}
    assert np.mean([(scores[i] >= 0.3) == bool(y) for i, _, y in rows]) > 0.9
    with pytest.raises(ValueError, match="sample"):
        toxicity.train(df, df.selectExpr("doc_id", "truth AS toxic"), sample_bytes=2)


def test_tables_need_a_shared_folder():
    from types import SimpleNamespace

    from tensorloom.llm._spark import shared_dir

    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master)))
