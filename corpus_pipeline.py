"""The corpus pipeline: quality rules, near copies, repeated passages, mixing, packing.

Each stage reads what its predecessor kept, as Parquet, and its decisions take
effect: rejected documents and near copies go, repeated passages are cut out,
rows come as often as the mix takes them, and the last stage says where the
pieces of each stand.

Odd rows are treated alike in all stages: null and empty texts fail the base
rules and go; texts of any length are read whole; repeated rows share one
verdict; rows with null id are kept by near copies and passages; ties go to the
smallest id; an empty table gives an empty result; further columns of
``documents``, of whatever name, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import jaccard, mixing, packing, passages, rules
from lodestone.llm.common import Scratch, scratch_closed, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    return rules.quality_documents(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the Jaccard join: that of smallest doc_id."""
    return jaccard.without_near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document holds."""
    return passages.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("mix_sources", mix_sources), ("pack_sequences", pack_sequences)]

#: Learned rules, chains and packings have no SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        scratch = Scratch(spark, f"pipeline-{name}")
        with scratch_closed():  # what the stage wrote for itself goes once its result is written
            docs = scratch.save(stage(spark, docs, sf_dir), "out")
        if last is not None:
            last.close()
        last = scratch
    return docs
