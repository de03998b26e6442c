"""The corpus pipeline: quality rules, near copies, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the
last return the columns of documents; n_chars follows the text. Any further columns, whatever
their names, pass through. Rows without a doc_id are documents told apart by their texts; an
empty table gives an empty result in every stage; texts are worked on whole, however long.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import common, jaccard_trie, packing, pii, quality, recompression


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that stages so far have written on their way.
_spent: list = []


def _stage(f: Stage) -> Stage:
    """f, before which the tables of earlier stages go that its documents do not read: their results are written."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.ship(spark)
        common.drop(_spent, [docs])
        mark = common.made_so_far()
        out = f(spark, docs, sf_dir)
        _spent[:] = [x for x in _spent if x in common.made_since(0)] + common.made_since(mark)
        return out

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars, where the table has it, is the length of the text that is left."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null and blank texts, and those of under 50 words, among them. Repeated rows share a verdict."""
    return quality.quality_filtered(docs)


@_stage
def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by Jaccard similarity of 0.8 of five-word shingles one stays, that of the smallest doc_id (none before any); of repeated rows one, too."""
    return jaccard_trie.near_copies_removed(docs, width=5, percent=80)


@_stage
def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under a 20-word window that starts earlier, in a smaller doc_id or the same text, go; other texts, null ones too, stay as they are. Repeated rows lose the same words."""
    return _sized(recompression.dedup_substrings(docs, with_text=True).select(*[F.col(common.quoted(c)) for c in docs.columns]))


@_stage
def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; texts without any, null ones too, stay as they are. Rows are independent of each other."""
    return _sized(pii.redacted(docs))


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of several lengths; a text without words has one piece in no sequence. Repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_copies", near_copies_stage),
    ("substring_dedup", repeats_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the estimated quality rules nor the span classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}", release=True)
    return STAGES[-1][1](spark, docs, sf_dir)
