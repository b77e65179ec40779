"""Registered queries of the text operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vialume.llm import op1_license, op2_warc, op3_jpeg, op4_sharding, op5_sentencepiece, op6_mixing, op7_substring, op8_quality, op9_token_counts, op10_jaccard
from vialume.session import ship

PIECES, RANKS = "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_license.scan(_table(spark, sf_dir, "documents"))


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = op2_warc.write_archive(_table(spark, sf_dir, "pages"))
    return op2_warc.parse(op2_warc.restore(spark, path))


def op3_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_jpeg.media_features(op3_jpeg.store_texts(_table(spark, sf_dir, "documents")))


def op4_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_sharding.assign(_table(spark, sf_dir, "documents"))


def op5_sentencepiece_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_sentencepiece.token_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op6_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_mixing.mix(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_substring.digests(_table(spark, sf_dir, "documents"))


def op8_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_quality.rules(_table(spark, sf_dir, "documents"))


def op9_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_token_counts.section_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op10_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_jaccard.linked(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_warc_archive, op3_jpeg_media, op4_bounded_ring, op5_sentencepiece_digests, op6_curriculum_mix, op7_substring_dedup, op8_perplexity_rules, op9_section_tokens, op10_jaccard_components)}

SQL: dict[str, str] = {"op1_license_scan": op1_license.scan_sql(), "op2_warc_archive": op2_warc.archive_sql(), "op6_curriculum_mix": op6_mixing.mix_sql(), "op7_substring_dedup": op7_substring.digests_sql(), "op10_jaccard_components": op10_jaccard.linked_sql()}
