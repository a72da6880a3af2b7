"""From raw documents to packed training sequences: five stages, each a table that the next one reads.

quality classifier, near duplicates by SimHash, repeated passages by suffix intervals, mix by source, packing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from planlens.llm import mixing, packing, quality, simhash, suffix
from planlens.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine does not reject; it learns from ``labels`` outside the held-out fold."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and of texts with a similarity of 0.8 or more over five words."""
    return simhash.drop_near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 100 bytes or more that an earlier document, or an earlier part of the same, has."""
    return suffix.drop_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their target weights, as runs of the blocks taken, in each pass over a document."""
    return mixing.mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length, each a sequence."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_filter), ("SimHash near-dedup", near_duplicates), ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", source_mix), ("packing", sequences)]

#: The stages learn, hash and draw; SQL expresses none of them.  tests/llm compares them with plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
