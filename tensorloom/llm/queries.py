"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import text_batches
from .byte_bpe import bpe_encode, load, vocabulary
from .chat_format import format_chat, parse, unescape
from .decontamination import decontaminate
from .embedding_dedup import embedding_near_dedup
from .hmm_lm import hmm_score
from .license_scan import ALL_TEMPLATES, license_scan
from .ngram_join import ngram_jaccard_join
from .sharding import place
from .sql import oracle_sql
from .suffix_dedup import repeated_passages
from .toxicity import score_toxicity, train


__all__ = ["oracle_sql", "queries"]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _fold(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n)) == 2


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose 4-word shingles have a Jaccard similarity of 0.85 or more, with the number of links of each."""
    return ngram_jaccard_join(_read(spark, sf_dir, "documents"), ngram=4, percent=85, links=True)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that repeat, with their first places."""
    return repeated_passages(_read(spark, sf_dir, "documents"), min_words=50)


def op3_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under a model of those outside fold 2 of 7."""
    return hmm_score(_read(spark, sf_dir, "documents"), _fold(7))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of vectors whose cosine is 0.95 or more."""
    return embedding_near_dedup(_read(spark, sf_dir, "embeddings"), threshold=0.95)


def _chat_digest(batches):
    for batch in batches:
        rows = []
        for conv, text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
            turns = parse(text)
            whole = hashlib.sha256()
            for role, said in turns:
                whole.update(f"{role}\n{said}\n".encode())
            raw = text.encode()
            under = "".join(unescape(raw[a:b].decode()) for a, b in zip(starts, ends, strict=True))
            rows.append((conv, len(turns), whole.hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest(), len(text)))
        if rows:
            yield pa.record_batch([pa.array(c) if i else pa.array(c, pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of one that quotes control strings, read back from the formatted text."""
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return format_chat(turns.unionByName(extra)).mapInArrow(_chat_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _bpe_digest(path: str, pattern: str):
    def run(batches):
        bpe = load(path, pattern)
        names = [str(i) for i in range(bpe.size)]
        for batch in batches:
            ids = [np.asarray(x.values) for x in batch.column("ids")]
            told = [hashlib.sha256(" ".join([names[i] for i in x.tolist()]).encode()).hexdigest() for x in ids]
            decoded = [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]
            yield pa.record_batch([batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(told, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of the bytes they decode to."""
    path, pattern = vocabulary()
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    encoded = bpe_encode(docs, path, pattern).select("doc_id", "ids")
    return encoded.mapInArrow(_bpe_digest(path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 10 words in documents."""
    found = decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), window=10)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end_word"] - x["first_word"])
    out = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of each document among 64, by a lookup table of 65537 slots."""
    return place(_read(spark, sf_dir, "documents").select("doc_id"), "doc_id", [f"shard-{k:03d}" for k in range(64)])


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document by a model of the labels outside fold 2 of 4."""
    docs = _read(spark, sf_dir, "documents")
    model = train(docs, _read(spark, sf_dir, "labels").where(~_fold(4)))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", _fold(4).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("offending").cast("long").alias("n_offending"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases, notices and clauses in each document."""
    found = license_scan(_read(spark, sf_dir, "documents"))
    label = F.array(*(F.lit(t.label) for t in ALL_TEMPLATES))
    phrase = F.array(*(F.lit(t.phrase) for t in ALL_TEMPLATES))
    base = F.filter("matches", lambda m: F.get(phrase, m["template"]))
    names = lambda matches: F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: F.get(label, m["template"])))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(F.transform(base, lambda m: m["start_word"])).alias("first_word"), F.array_max(F.transform(base, lambda m: m["start_word"])).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("matches")).alias("labels"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("score"),
    )


_QUERIES = (op1_ngram_jaccard_join, op2_suffix_dedup, op3_hmm_lm, op4_embedding_near_dedup, op5_chat_format, op6_byte_bpe, op7_decontamination, op8_sharding, op9_toxicity, op10_license_scan)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}
