"""Training-data pipeline over ``documents``: quality, toxicity, near-duplicates,
repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all
but the last return the columns of ``documents``. Learned stages take labels from
``labels`` of the same folder and fit on the documents they are given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from curlew.llm.packing import pack
from curlew.llm.quality import filter_quality
from curlew.llm.shared import staged, table
from curlew.llm.simhash import deduplicate
from curlew.llm.suffix_dedup import remove_repeats
from curlew.llm.toxicity import filter_toxic


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least 0.5 (null and empty texts are scored too).
    Null labels and ids of ``labels`` are no labels; without labels of both kinds all
    documents have one score."""
    return filter_quality(docs, table(spark, sf_dir, "labels"), threshold=0.5)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.7; nulls as in ``quality``."""
    return filter_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: sets of five-word shingles with a Jaccard
    similarity of at least 0.8. The one with the smallest doc_id stays; documents with a
    null doc_id stay, and of empty texts one."""
    return deduplicate(docs, shingle=5, threshold=0.8, max_bits=7)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without strings of 200 bytes that occur more than once; a character that
    is only partly covered stays, a null text stays null."""
    return remove_repeats(docs, length=200)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in sequences of 1024 tokens; a null text is one
    end token, a null doc_id is kept."""
    return pack(docs, capacity=1024, end_id=2)


STAGES = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("simhash", near_duplicates),
    ("suffix", repeated_passages),
    ("packing", packing),
]

# The stages learn models, hash shingles and tokenise: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each earlier one is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
