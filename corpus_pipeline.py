"""The corpus pipeline: quality rules, near-duplicates, secrets, packing.

Each stage takes what the one before it kept; all but the last return the columns of `documents`. Nulls in any column and empty tables pass
every stage; columns besides those of `documents` are dropped. Each function says what becomes of null and empty texts, ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common, packing, quality, queries, secret_scan, setsketch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without boilerplate lines; n_chars follows. A null or empty text has no words, so its row goes; repeated rows stay or go together."""
    common.ship(spark)
    return quality.kept_documents(docs, COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): the one with the smallest id.

    A text without words is like no other and stays. Of rows with the same id and text one stays; which one isn't told where their other
    columns differ. Of texts under the same id all that are alike count as one document.
    """
    common.ship(spark)
    return setsketch.one_of_each(docs.select(*COLUMNS), size=5, limit=80)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated rows each; what the scan finds is replaced in their texts, and n_chars follows (it stays where the text is null)."""
    common.ship(spark)
    clean = secret_scan.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with the sequence and offset that each is packed at. A null or empty text is its end id alone; repeated rows are packed each; sequences number as they are made."""
    common.ship(spark)
    return packing.pack_documents(docs, queries.vocabulary())


STAGES = [("quality rules", quality_stage), ("near-duplicates", dedup_stage), ("secret scan", secrets_stage), ("best-fit packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = common.Tables(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = tables.write(f"stage{i}", docs)
    tables.drop()  # the last stage has checkpointed its result
    return docs


#: Shingle links over whole texts, decoding worklists and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
