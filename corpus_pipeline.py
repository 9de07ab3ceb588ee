"""Corpus pipeline: quality rules, exact dedup, SimHash near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. A decision names a row by
its doc_id and 128 bits of its text, never by the doc_id alone, so different texts under one doc_id, or without
one, are documents of their own. Of equal texts one row stays, also where none has a doc_id. Empty input gives an
empty result at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from evidencelake.llm.common import Scratch
from evidencelake.llm.exact_dedup import exact_filter
from evidencelake.llm.packing import pack_documents
from evidencelake.llm.quality_rules import quality_filter
from evidencelake.llm.simhash_dedup import simhash_filter
from evidencelake.llm.substring_dedup import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule cascade keeps."""
    return quality_filter(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact_filter(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest doc_id."""
    return simhash_filter(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-word passages that a document with a smaller doc_id holds too."""
    return without_repeats(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 ids, with their sequence and offset."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, encode_special_tokens=False)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("simhash_dedup", near), ("substring_dedup", substrings), ("packing", packing)]

#: Fingerprints and token ids cannot be expressed in SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
