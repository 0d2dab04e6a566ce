"""A corpus pipeline out of the operators: language ID, exact dedup, near-dedup, mixing to weights, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's docs. All but the last return the columns of ``documents``; each works on every row its predecessor kept.

Defined cases, in every stage: an empty table gives no rows; extra columns, whatever their names, are carried along (packing
reads doc_id and text alone); a null doc_id sorts last; rows are told apart by their place in the table, not by doc_id, so
repeated rows and ids are rows of their own; texts are read whole, however long. Nulls in text, lang and source are said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verisift.llm.common import materialise, table
from verisift.llm.exact_dedup import drop_copies
from verisift.llm.language_id import with_language
from verisift.llm.mixing import mixed_rows
from verisift.llm.near_dedup import keep_one_of_each
from verisift.llm.packing import pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: null and empty texts, texts without a letter.

    All other documents stay, whatever their language and score. Rows of null ``lang`` are predicted, not learned from; if no row has a
    ``lang``, nothing can be told and all go. A tie of two languages is told as the first by code point, so it stays.
    """
    return with_language(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space the row with the smallest doc_id stays; of repeated rows of one id, one.

    Null and empty texts are equal, and one of them stays.
    """
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest doc_id stays; of repeated rows of one id, one.

    Texts of fewer than five words are one shingle, so they are near-duplicates if their words are equal; texts without words are
    near-duplicates of each other.
    """
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them: 0 to 3 times, repeats as rows.

    A null source is a source of its own. Of repeated rows each is drawn by itself. Texts without words have size 0; the mix
    counts words, so they weigh nothing in it.
    """
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences, in the columns of operator 8. A null or empty text is its end id alone."""
    return pack(docs).drop("ids")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Language ID, near-dedup and packing are out of SQL's reach; tests/llm hold every stage of the chain against brute force on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
