"""Corpus pipeline: raw documents to token ids, in five stages.

Each stage is a function of (spark, docs, sf_dir); it works on all that the stage before kept, and
its result is written as Parquet and read again as the next one's docs. All but the
last return the columns of ``documents``; columns beside them stay, whatever their names. An empty table
gives an empty one in every stage. Rows of null doc_id are judged by their own text where a stage looks at one row
(toxicity, decontamination, encoding) and left alone where it compares rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tensorloom.llm._spark import Workspace, text_batches
from tensorloom.llm.byte_bpe import bpe_encode, vocabulary
from tensorloom.llm.decontamination import drop_contaminated
from tensorloom.llm.ngram_join import keep_one
from tensorloom.llm.suffix_dedup import remove_repeats
from tensorloom.llm.toxicity import drop_toxic, train
from tensorloom.session import share_package


def _ready(spark: SparkSession) -> None:
    share_package(spark)
    text_batches(spark)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose toxicity is 0.3 or more, by a model of all labels.

    Null, empty and wordless texts score 0 and stay; rows that repeat stay or go together. Without labels nothing is dropped
    but texts of so many sentences that the starting chances add up to 0.3.
    """
    _ready(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic(docs, train(docs, labels), threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates (five-word shingles, Jaccard 0.8): that of the smallest doc_id.

    Null, empty and wordless texts are no copies of each other and stay; rows of one doc_id stay or go together, so a
    row that is there twice stays twice.
    """
    _ready(spark)
    return keep_one(docs, ngram=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words or more that stand elsewhere before, by doc_id and place; the first place stays.

    No row is dropped: a text that is cut whole stays as what white space it had. A row that is there twice is no repeat of
    itself; cuts of one doc_id are made in all its rows. n_chars is set to the characters left (null for a null text).
    """
    _ready(spark)
    return remove_repeats(docs, min_words=50)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold 10 consecutive words of a benchmark item, or a shorter item whole.

    Null texts have no words and stay; null and empty items match nothing; an empty benchmark drops nothing.
    """
    _ready(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text (doc_id, lang, source, ids); a null or empty text has none, and every row has a row."""
    _ready(spark)
    return bpe_encode(docs, *vocabulary(), keep_tables=False).select("doc_id", "lang", "source", "ids")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: No stage but the last is expressible in SQL: a trained model, components, a suffix array.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        done = ws.table(stage(spark, docs, sf_dir))
        if hasattr(docs, "_workspace_path"):
            ws.drop(docs)
        docs = done
    return docs
