"""The corpus pipeline: quality classifier, exact dedup, MinHash near-dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written and read again as the next stage's documents.
All but the last keep the columns of `documents`; the last gives the packed pieces of every document that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import exact_dedup, near_dedup, packing, quality
from rasterloom.llm.common import Stage, kept_rows, settled, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labelled ones among them. Null and empty texts have the
    score of an empty text; repeated rows and ties have one score each; without labels of both kinds all have the prior's score;
    an empty table gives no rows, and other columns are passed on."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one that the exact dedup keeps: the longest with white space, then the least id, then the first row.
    Null texts are empty ones, which are equal; an empty table gives no rows, and other columns are passed on."""
    docs = settled(docs)
    return kept_rows(docs, exact_dedup.decide(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the first row of the least id (null is the greatest). Null and empty texts
    stay, each on its own; an empty table gives no rows, and other columns are passed on."""
    docs = settled(docs)
    return kept_rows(docs, near_dedup.decide(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents. Null and empty texts are one token, the end; repeated rows are packed each; an empty
    table gives no rows; columns other than id and text end here."""
    return packing.pack_documents(docs)


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("minhash near-dedup", near_stage), ("best-fit packing", packing_stage)]

#: The classifier's scores aren't expressible in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each over the stored result of the one before, which is then dropped."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        after = Stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            before.drop()
        docs, before = after.df, after
    return docs
