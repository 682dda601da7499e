"""Cleaning of a training corpus as a fixed sequence of stages over ``documents``.

Toxic documents go; lines that match an earlier line go, and with them documents of which no word is left; of each class
of near-duplicate documents the first stays; sources are mixed to their target weights, which repeats documents; what is
left is encoded for training and decoded again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mealgrid.core.scratch import written
from mealgrid.llm import bpe, line_dedup, minhash, mixing, toxicity
from mealgrid.llm.common import WORD, table
from mealgrid.llm.queries import rank_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones, does not reject."""
    return toxicity.keep_clean(docs, toxicity.model_of(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that match an earlier line; the character count follows the text."""
    left = line_dedup.remove_lines(docs).where((F.col("n_removed") == 0) | F.col("doc.text").rlike(WORD)).select("doc.*")
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class: five-word shingles, similarity of at least 0.8."""
    return minhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources asks for."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed ids of every text, and whether they decode to its bytes."""
    shared = bpe.vocabulary_of(spark, rank_file())
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", "text", F.sha2(text, 256).alias("digest"))
    return bpe.round_trip(rows, shared).select(
        "doc_id",
        "source",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        "ids",
        (F.sha2("decoded", 256) == F.col("digest")).alias("decodes"),
    )


#: Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of documents.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: A classifier and similarity joins are nothing that SQL can express; tests/llm/test_pipeline.py replays the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
