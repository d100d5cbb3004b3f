"""The corpus pipeline: rules, toxicity, near duplicates, repeated passages, packing.

Every stage takes all documents that the one before it kept, as a written table, and returns documents (the last: packed pieces).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.llm import packing, pieces, quality, simhash, suffix_levels, toxicity
from barflow.llm.common import settle, table
from barflow.llm.queries import SEQUENCE, TOXIC, tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    rules = quality.fit_list(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules, keep=COLUMNS).where("kept").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below the threshold."""
    model = toxicity.fit_documents(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, COLUMNS).where(F.col("toxicity") < TOXIC).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    return simhash.keep_one(docs, width=5, least=0.8).select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 200-byte strings that occur elsewhere too."""
    left = suffix_levels.remove_bytes(docs, keep=[c for c in COLUMNS if c != "text"], as_text=True).withColumnRenamed("kept", "text")
    return left.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in training sequences."""
    return packing.pack(pieces.settled(docs, tokenizer_file("word_bpe_49k.json"), SEQUENCE), SEQUENCE)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeated_passages),
    ("best_fit_packing", pack),
]

# Learned rules, compression and tokenization are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
