"""From raw documents to packed sequences of token ids.

Each stage works on all rows that its predecessor kept; its result is written as
Parquet and read again. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kickframe.llm import exact_dedup, minhash, mixing, packing, toxicity
from kickframe.session import stage

#: One pass of nine tenths of what is there; the crawl makes room where there is too much.
RECIPE = mixing.Recipe(
    budget=0.9, epochs=1, seed=23,
    domains={"src0": "crawl", "src1": "books", "src2": "books", "src3": "reference", "src4": "reference", "src5": "reference"},
    weights={"domain": {"crawl": 2, "web": 4, "books": 3, "reference": 3}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 1}})


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the factorization machine calls toxic; it learns from the labels of these documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, toxicity.train(docs, labels))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each text."""
    return exact_dedup.dedupe(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of near copies."""
    return minhash.dedupe(docs, words=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bring sources to their weights."""
    return mixing.mix(docs, RECIPE)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack token ids into sequences of 4096."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), words="blank", end=1)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: Trained scores, near copies and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
