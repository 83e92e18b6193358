"""The corpus pipeline, stage by stage, against plain versions, on a table with odd rows."""

import random
import re

import pytest
import tiktoken
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

import public_tokenizers  # noqa: E402
from tests.llm.test_documents import alnum, brute_passages, jaccard_classes, lower, words  # noqa: E402

from tensorloom.llm.toxicity import Model, train  # noqa: E402

ITEM = "what is the boiling point of water at the top of mount everest in degrees"


def documents():
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("river stone cloud window paper garden music train winter silver".split()) + str(rng.randrange(60)) for _ in range(n))
    base = [text(120) for _ in range(12)]
    passage = text(70)
    near = base[0].split(" ")
    near[7] = "changed"
    said = [*base, base[1], base[1], " ".join(near), f"{text(40)}. {passage} {text(30)}", f"{text(20)} {passage}. {text(50)}", f"{text(30)} {ITEM.upper()} {text(30)}", None, "", "  \n ", "one", f"so vile and rotten. {text(60)}", text(30_000)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "kept") for i, t in enumerate(said)]
    rows += [(3, rows[3][1], "en", "again", len(base[3]), "repeated row"), (4, text(90), "fr", None, None, "another text of one id"), (None, text(80), None, "x", 1, "null id"), (None, None, None, None, None, None)]
    toxic = [(100 + i, f"{text(15)}. you vile scummy rotten thing. {text(15)}" if i % 2 else text(30), "en", "t", 0, "label") for i in range(60)]
    return rows + toxic, [(100 + i, i % 2, i % 2) for i in range(60)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, target string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs, labels = documents()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def plain_stages(spark, folder):
    """What each stage leaves, by plain loops over the rows of the stage before."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model: Model = train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    from tests.llm.test_documents import plain_toxicity

    rows = [tuple(r) for r in docs.collect()]
    rows = [r for r in rows if plain_toxicity(model, r[1]) < 0.3]
    yield rows
    ids = [r for r in rows if r[0] is not None]
    _, roots = jaccard_classes([r[1] for r in ids], 5, 80)
    least = {}
    for r, k in zip(ids, roots, strict=True):
        least[k] = min(least.get(k, r[0]), r[0])
    # A text without words links with nothing; rows of one doc_id stay or go together.
    gone = {r[0] for r, k in zip(ids, roots, strict=True) if words(r[1]) and least[k] != r[0]}
    rows = [r for r in rows if r[0] not in gone]
    yield rows
    ids = sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=lambda r: (r[0], r[1] or ""))
    assert len({k for k, _ in ids}) == len(ids) - 1
    # The two texts of one doc_id share no passage with any other, so their order does not matter.
    state = {k: s for k, s in zip(ids, brute_passages([t for _, t in ids], 50), strict=True)}
    out = []
    for r in rows:
        cut = state.get((r[0], r[1]))
        if cut is not None and (cut == 1).any():
            raw, spans = r[1].encode(), [m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", lower(r[1]))]
            runs, i = [], 0
            while i < len(cut):
                j = i
                while j < len(cut) and cut[j] == cut[i]:
                    j += 1
                if cut[i] == 1:
                    runs.append((spans[i][0], spans[j - 1][1]))
                i = j
            for a, b in reversed(runs):
                raw = raw[:a] + raw[b:]
            r = (r[0], raw.decode(), *r[2:4], len(raw.decode()), *r[5:])
        else:
            r = (*r[:4], None if r[1] is None else len(r[1]), *r[5:])
        out.append(r)
    rows = out
    yield rows
    item = alnum(ITEM)
    windows = {tuple(item[i : i + 10]) for i in range(len(item) - 9)}
    rows = [r for r in rows if not any(tuple(w[i : i + 10]) in windows for w in [alnum(r[1])] for i in range(len(w) - 9))]
    yield rows
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    from tiktoken.load import load_tiktoken_bpe

    bpe = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(str(ranks)), special_tokens={})
    yield [(r[0], r[2], r[3], bpe.encode_ordinary(r[1] or "")) for r in rows]


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, ((name, stage), want) in enumerate(zip(corpus_pipeline.STAGES, plain_stages(spark, folder), strict=True)):
        got = stage(spark, docs, folder)
        if k < 4:
            assert got.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", "), name
            assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)), name
            docs = spark.createDataFrame(want, SCHEMA).repartition(4)
        else:
            assert sorted(repr((r.doc_id, r.lang, r.source, list(r.ids))) for r in got.collect()) == sorted(map(repr, want)), name
    assert sorted(repr((r.doc_id, r.lang, r.source, list(r.ids))) for r in corpus_pipeline.run(spark, folder).collect()) == sorted(map(repr, want))


def test_empty_tables(spark, folder, tmp_path):
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).collect() == [], name
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_only_odd_rows(spark, folder):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "x", 0), (1, "", "en", "x", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.select("*", F.lit("x").alias("row")), folder).count() == 3, name
