"""The training-data pipeline: quality rules, near-dedup, decontamination, PII, packing.

Every stage takes (spark, docs, sf_dir), docs being what the stage before it wrote, and
works on all of its rows.  All but the last return the columns of documents; the last
returns a row for each packed piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from buildlens.llm import decontaminate, line_crf, minhash_dedup, packing, pii
from buildlens.llm.common import checkpoint, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or consist of boilerplate lines go.

    Null and empty texts have no words, so they go.  Rows that repeat are judged alike; ties
    of line states go to content; texts of any length are judged whole; without labels only the base
    rule decides.  All columns stay as they are.
    """
    return line_crf.keep_quality(docs, line_crf.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least id.

    Texts without words are in no group and stay, as do rows without an id; a row that repeats id and
    text stays once.  Texts of any length are compared whole.
    """
    return minhash_dedup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go.

    Null and empty texts hold none and stay; rows that repeat go or stay together; long texts are
    searched whole; with an empty benchmark all rows stay.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to the tag of its kind.

    All rows stay, repeated ones too; null texts stay null and empty ones empty; texts of any length
    are searched whole; n_chars is counted anew where a text changes.
    """
    return pii.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 token ids: a row a piece.

    Null and empty texts are one piece, the closing id; long texts are cut into pieces; rows that
    repeat are packed each; an empty table gives an empty one.
    """
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", redaction),
    ("packing", best_fit_packing),
]

#: SQL can express neither the trained stages nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; between two stages the rows are written to the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpoint(docs)
    return docs
