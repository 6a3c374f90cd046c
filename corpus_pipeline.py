"""A corpus from raw documents to packed sequences, in four stages.

Each stage takes all that the one before kept and returns the columns of documents; the last one
returns the places of the pieces. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.llm import bin_completion, golay_simhash, js_quality, ppm_langid
from punctual.llm.common import ship, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are close enough to good text of some language.

    Null and empty texts have no words and go. Whole texts of any length are judged. Equal rows share a verdict, rows are judged one
    by one whatever their ids. All columns stay, whatever their names. An empty table stays empty.
    """
    return js_quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised and explains them.

    Null and empty texts and those without a letter go. Whole texts of any length are scored; equal texts share a verdict. Learned is from the
    labelled rows that are not held out. All columns stay, whatever their names. An empty table stays empty.
    """
    ship(spark)
    return ppm_langid.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id.

    Null and empty texts have one fingerprint and are one group. Whole texts of any length are hashed. Rows without an id come last; of rows that
    share the least id the first by the hash of all columns stays. All columns stay, whatever their names. An empty table stays empty.
    """
    ship(spark)
    return golay_simhash.keep_first(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens.

    Null and empty texts are one end token. Texts of over 2048 tokens are cut, of any length. Rows are packed one by one, repeated ones and those
    without an id too. Other columns aren't read. An empty table gives no pieces.
    """
    ship(spark)
    return bin_completion.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL expresses neither code lengths, fingerprint components nor packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
