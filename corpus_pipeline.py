"""The corpus pipeline: toxicity, exact dedup, SimHash near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.llm import bpe, content_sort, mixing, simhash, toxicity
from tabsight.llm.common import id_remainder, stored
from tabsight.llm.queries import BYTE_RANKS, MIX

TOXIC_FROM = 0.5


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go; learns from the labels of the training remainders."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn = docs.where(id_remainder(F.col("doc_id"), 5) != 0)
    model = toxicity.train(toxicity.labelled(learn, labels, "toxic"))
    return toxicity.drop_toxic(docs, model, TOXIC_FROM)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return content_sort.drop_copies(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints stays."""
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by the raked probabilities stay."""
    return mixing.sample(docs, MIX)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and round trip of each document, as digests."""
    return bpe.digests(docs, BYTE_RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", clean),
    ("exact_dedup", distinct),
    ("simhash_near_dedup", unlike),
    ("source_mixing", mixed),
    ("byte_bpe", encoded),
]

# The toxicity stage is a trained model and the draws follow it: no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
