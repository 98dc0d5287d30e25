"""From raw documents to packed training sequences: language ID, exact dedup, near dedup, mixing, packing.

Null and empty texts, and those without a letter, go in the first stage. Nulls in other columns are values like any others. Of repeated rows one
stays after exact dedup; rows with one key and different texts are separate documents throughout. Texts of any length go
through whole. Columns beyond those of documents, whatever their names, stay until packing, which gives pieces. No documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emenda.llm import exact_dedup, langid, mixing, ngram_join, packing
from emenda.llm.common import materialise, read_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go; a null ``lang`` is filled with the one found (it stays null where no label could be learnt)."""
    return langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the row with the smallest doc_id stays."""
    return ngram_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences."""
    return packing.pack(docs, forget=True)  # the workers live on, beside the other stages' data


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("mix_sources", mix), ("best_fit_packing", packing_stage)]

#: Language ID and the join can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each reads what its predecessor wrote. No documents give no rows."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
