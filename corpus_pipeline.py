"""The corpus pipeline: documents go through five operators, each reading what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablens.llm.bpe import bpe
from tablens.llm.decontamination import decontaminate
from tablens.llm.jaccard_join import jaccard_join
from tablens.llm.language import with_language
from tablens.llm.line_dedup import passage_dedup
from tablens.llm.queries import table, tokenizer
from tablens.storage import scratch_path

LEAST_SCORE = 0.25  # of the language; lower means that the text is like no learned language


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled rows show; null and letterless texts go."""
    found = with_language(docs, F.lit(True))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages of lines; those that lose all their text go."""
    cleaned = passage_dedup(docs)
    lost = F.col("removed_lines") > 0
    counted = cleaned.withColumn(
        "n_chars", F.when(lost, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    )
    return counted.where(~lost | F.col("text").rlike(r"[^\p{IsWhite_Space}]")).select(docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id.

    Rows with one id count as one document; rows without an id stay, as do texts without words.
    """
    groups = jaccard_join(docs)
    stay = groups.where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(stay, "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; rows without an id stay."""
    leaks = decontaminate(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of the text decoded from them."""
    return bpe(docs, tokenizer("byte_bpe_50k.json"), with_decoded=False)


STAGES = [
    ("language ID", known_language),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("BPE encoding and decoding", tokens),
]

ORACLE_SQL = None  # language scores and tokenizers are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
