"""The registered queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe
from .centroid_clustering import centroid_clustering
from .exact_dedup import exact_dedup
from .line_dedup import digest as line_digest
from .line_dedup import line_dedup
from .minhash_dedup import minhash_dedup
from .packing import pack_documents
from .periodic_runs import digest as run_digest
from .periodic_runs import periodic_runs, with_planted_runs
from .quality_classifier import quality_classifier
from .quality_rules import quality_rules
from .simhash_dedup import simhash_dedup
from .sql import SQL
from .substring_dedup import digest as substring_digest
from .substring_dedup import substring_dedup
from .suffix_dedup import digest as suffix_digest
from .suffix_dedup import suffix_dedup
from .token_counts import rolled_up

__all__ = ["QUERIES", "SQL"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(line_dedup(table(spark, sf_dir, "documents")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("first_rejection")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = {v: public_tokenizers.path(f"{v}.tiktoken") for v in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    return rolled_up(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), versions, public_tokenizers.PATTERN)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digest(substring_dedup(table(spark, sf_dir, "documents")))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = bpe.encode(table(spark, sf_dir, "documents"), tokens, public_tokenizers.PATTERN)
    return bpe.digests(bpe.decode(encoded, tokens))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_digest(suffix_dedup(table(spark, sf_dir, "documents")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, encode_special_tokens=False)


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(periodic_runs(with_planted_runs(table(spark, sf_dir, "documents"))))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(table(spark, sf_dir, "documents"), shingle=2)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_dedup, op2_quality_rules, op3_token_counts, op4_substring_dedup, op5_quality_classifier, op6_byte_bpe, op7_exact_dedup, op8_suffix_dedup, op9_packing, op10_simhash_dedup, op11_periodic_runs, op12_minhash_dedup, op13_centroid_clustering)}
