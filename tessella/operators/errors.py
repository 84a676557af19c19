"""Failures as rows: a grouped step yields, in one pass, rows or one row that says why a course gave none; they are split afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A row for each course and step that failed.
ERRORS = "doc_id string, step string, message string"


def message(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def good(rows: DataFrame) -> DataFrame:
    """The rows of a tagged step without its failures. Keep the step's result first if both sides are read, else it runs twice."""
    return rows.filter("error IS NULL").drop("error")


def bad(rows: DataFrame, step: str) -> DataFrame:
    """The failures of a tagged step as rows of ERRORS."""
    return rows.filter("error IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(step).alias("step"), F.col("error").alias("message"))
