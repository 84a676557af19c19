"""Where results go: one JSON document a course, in a file named after its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import metadata as M
from tessella.sources import course_source


def stem(source: Column, default: str) -> Column:
    """A source's name without its folders and suffix."""
    last = F.regexp_replace(F.coalesce(source, F.lit("")), r"/+\z", "")
    name = F.regexp_replace(F.regexp_extract(last, r"([^/]*)\z", 1), r"(?<=.)\.[^.]+\z", "")
    return F.when(name.isin("", "Unknown"), default).otherwise(name)


def named(rows: DataFrame, source: Column, suffix: str, default: str) -> DataFrame:
    """rows (doc_id, each once, and others) with `name`: <stem>_<suffix>.json; where stems are alike but for case, the first in order of doc_id has it and the others a number behind the stem.

    A number that makes the name of another stem yields to it: the names that courses have by themselves stay theirs. Names are told apart
    on doc_id and stem alone; what a row holds is only joined to its name.
    """
    stems = rows.select("doc_id", stem(source, default).alias("stem"))
    alike = Window.partitionBy(F.lower("stem")).orderBy(F.col("doc_id").cast("string"))
    stems = stems.withColumn("copy", F.row_number().over(alike))
    taken = stems.filter("copy = 1").select(F.lower("stem").alias("taken")).distinct()
    stems = stems.withColumn("stem", F.when(F.col("copy") == 1, F.col("stem")).otherwise(F.concat("stem", F.lit("_"), F.col("copy").cast("string"))))
    clash = stems.join(taken, (F.lower("stem") == F.col("taken")) & (F.col("copy") > 1), "left")
    name = F.when(F.col("taken").isNotNull(), F.concat("stem", F.lit("_"), F.col("doc_id").cast("string"))).otherwise(F.col("stem"))
    return rows.join(clash.select("doc_id", F.concat(name, F.lit(f"_{suffix}.json")).alias("name")), "doc_id")


def as_json(documents: DataFrame) -> DataFrame:
    """name, json of doc_id, document."""
    rows = named(documents, F.col("document.course_metadata.source"), "evaluation", "course_evaluation")
    return rows.select("name", F.to_json("document", {"ignoreNullFields": "false"}).alias("json"))


def metadata_json(rows: DataFrame) -> DataFrame:
    """name, json of rows of metadata."""
    fields = F.struct(*M.TEXTS, *M.LISTS, "toc")
    return named(rows, F.col("source"), "metadata", "course").select("name", F.to_json(fields, {"ignoreNullFields": "false"}).alias("json"))


def write_files(files: DataFrame, path: str) -> None:
    """name, json as files in a folder; a run that fails leaves none of them."""
    course_source.register(files.sparkSession)
    files.write.format("course_files").mode("overwrite").save(path)


def write_json(documents: DataFrame, path: str) -> None:
    write_files(as_json(documents), path)
