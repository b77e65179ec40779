"""Corpus pipeline: quality rules, near duplicates, substring dedup, mixing and tokens over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of ``docs``; their
decisions take effect: rejected documents go, one document of each group of near duplicates stays, repeated passages
leave the texts (``n_chars`` follows), and documents repeat as often as the mix takes them. The last returns the ids of
each text. Between stages the rows are written as Parquet in the cluster's shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vialume.llm import op5_sentencepiece, op6_mixing, op7_substring, op8_quality, op10_jaccard
from vialume.llm.store import materialize
from vialume.session import ship

PIECES = "piece_bpe_32k.model"
#: Near duplicates share four fifths of their runs of five words; op10_jaccard_components has its own contract.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return op8_quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return op10_jaccard.representatives(docs, NEAR_SHINGLE, NEAR_PERCENT)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    out = op7_substring.dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return op6_mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return op5_sentencepiece.token_ids(docs, public_tokenizers.path(PIECES))


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("substring dedup", substring_dedup), ("mixing", mixing), ("sentencepiece", tokens)]
#: Perplexity and piece merging can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{k}")
    return docs
