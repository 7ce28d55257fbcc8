"""Corpus pipeline: quality rules, near-duplicate removal, repeat removal, source mixing, packing.

Each stage works on everything its predecessor kept. Stages return the columns of ``documents`` (the last one returns
its batches) and are written as Parquet into the shared scratch folder and read again.

Defined cases are those of the operators; an empty table passes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabula.llm import mixing, ngram_join, packing, quality, suffix_dedup
from tabula.llm.common import documents
from tabula.session import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the adaptive quality rules."""
    return quality.accepted(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the least id."""
    return ngram_join.keep_one(docs)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that an earlier document, or an earlier place, already has."""
    return suffix_dedup.strip_repeats(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Segments in length buckets and batches."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_stage), ("n-gram Jaccard join", near_duplicate_stage), ("suffix-array dedup", repeat_stage),
          ("source mixing", mixing_stage), ("packing", packing_stage)]

#: Cutting bytes out of UTF-8 texts and decoding what is left is beyond SQL; a brute-force version tests the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
