"""The training-data pipeline: quality rules, line dedup, near dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next
stage's documents. All but the last return the columns of ``documents``. Ids are whole numbers. Columns that
are not named here may hold nulls and pass through, extra columns too, whatever their names; an empty table
gives an empty table. Texts of any length are read whole, one at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywick.llm.bpe import round_trip_digests
from tallywick.llm.common import fresh, read_table, staged
from tallywick.llm.decontaminate import drop_contaminated
from tallywick.llm.line_dedup import dedup_lines
from tallywick.llm.quality import keep_good
from tallywick.llm.queries import vocabulary_path
from tallywick.llm.simhash import keep_representatives

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or a certified cutoff go, the others stay as they are.

    Null and empty texts have no words and go. A null lang is a stratum of its own. Rows without an id are
    judged but have no label; repeated rows are judged alike and all stay or go.
    """
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines aligned with an earlier document are deleted, n_chars follows, and documents left without a word go.

    Earlier is a smaller doc_id (null last), then a smaller hash of the text, so there are no ties; rows that
    repeat both are one document and are changed alike. A document that loses no line stays as it is, null
    and empty texts too.
    """
    (removed,) = fresh(docs, "n_removed_lines")
    left = dedup_lines(docs, n_removed=removed)
    some = F.col("text").rlike(r"[^\x20\x09-\x0D]") | (F.col(removed) == 0)
    return left.filter(some).withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest doc_id of those linked by a similarity of 0.8 over five words.

    Of repeated rows one stays. Of rows of one doc_id and different texts in a group the smaller text hash
    stays. A row without an id stays only where its group has no other. Texts without a word are one group.
    """
    return keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts hold none and stay; rows without an id and repeated rows are judged like others.
    """
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of each text encoded and decoded again, one row for each row.

    Null and empty texts have no tokens and the digests of nothing; null ids and repeated rows stay.
    """
    return round_trip_digests(docs, vocabulary_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: SQL expresses neither the alignment of the line dedup nor the encoding: tests/llm has a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder but for the last."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
