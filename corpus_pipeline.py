"""The corpus pipeline: quality rules, near-dedup, suffix-array dedup, benchmark decontamination, packing.

Every stage works on all rows that the one before kept, and all but the last return the columns of `documents`. Defined results, in each
stage: nulls in any column and empty texts are ordinary rows (an empty text fails the quality rules, and so ends there); very long texts
are handled whole; repeated rows are judged alike; columns beyond those of `documents` are kept up to packing, whatever their names; an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import decontam, neardup, packing, quality, suffixdedup
from keyloom.llm.common import materialise, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines. Repeated rows all pass or all go."""
    return quality.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class, once; a null doc_id comes last. Texts without a word are kept, equal rows once."""
    return neardup.deduplicate(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that start more than once, n_chars with them. A text may become empty and its row stays; a null
    text stays null."""
    return suffixdedup.strip(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; those with a null or empty text stay. An empty benchmark drops nothing."""
    return decontam.remove(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of a power of two of tokens, every id of every document in one; a null or empty text is its end id."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", pack),
]

#: SQL can't express the stages after the first; a test holds the whole run against the stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{k + 1}")
    return docs
