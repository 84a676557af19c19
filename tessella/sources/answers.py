"""Answers of a model, kept: each prompt is asked once, whatever fails in between."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.errors import message
from tessella.operators.scoring import call_with_retry

ANSWERS = "key string, raw string"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system that a path or address names, and the path in it."""
    if "://" not in path:
        path = path.removeprefix("file:")
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


class Loose:
    """Answers as small files by key, each there as a whole or not at all: written aside, then renamed."""

    def __init__(self, path: str):
        self.fs, self.at = file_system(path)

    def get(self, key: str) -> str | None:
        try:
            with self.fs.open_input_stream(f"{self.at}/{key}.json") as f:
                return json.loads(f.read())["raw"]
        except FileNotFoundError:
            return None

    def put(self, key: str, raw: str) -> None:
        aside = f"{self.at}/_{uuid.uuid4().hex}"
        with self.fs.open_output_stream(aside) as f:
            f.write(json.dumps({"key": key, "raw": raw}).encode())
        self.fs.move(aside, f"{self.at}/{key}.json")


class AnswerStore:
    """A folder that the driver and all executors see: `table` holds answers, `loose` those that came since it was written last.

    A key is the hash of model, version and prompt. What has a key here is never asked again. A task writes each answer down as it comes, so a
    task that is run again, or a run that is killed and repeated, finds what has been answered; only a call that was under way is lost.
    """

    def __init__(self, spark: SparkSession, path: str, model: str = "", version: str = "1"):
        self.spark, self.path, self.model, self.version = spark, path.rstrip("/"), model, version
        fs, at = file_system(self.path)
        fs.create_dir(f"{at}/loose", recursive=True)
        fs.create_dir(f"{at}/table", recursive=True)

    def keyed(self, prompts: DataFrame) -> DataFrame:
        return prompts.withColumn("key", F.sha2(F.to_json(F.array(F.lit(self.model), F.lit(self.version), F.col("prompt"))), 256))

    def answers(self) -> DataFrame:
        """key, raw of all that is answered."""
        table = self.spark.read.schema(ANSWERS).parquet(f"{self.path}/table")
        loose = self.spark.read.schema(ANSWERS).json(f"{self.path}/loose")
        return table.unionByName(loose).dropDuplicates(["key"])

    def settle(self) -> None:
        """Loose answers into the table; they are taken away when the table has them. Killed in between, both hold them, which changes nothing."""
        loose = self.spark.read.schema(ANSWERS).json(f"{self.path}/loose").withColumn("at", F.input_file_name())
        found = [r.at for r in loose.select("at").distinct().toLocalIterator()]
        self.spark.read.schema(ANSWERS).json(f"{self.path}/loose").write.mode("append").parquet(f"{self.path}/table")
        fs, at = file_system(self.path)
        for name in (f.rsplit("/", 1)[1] for f in found):
            fs.delete_file(f"{at}/loose/{name}")

    def score(self, prompts: DataFrame, call: Callable[[str], str], tries: int = 3) -> DataFrame:
        """prompts: doc_id, batch, prompt. doc_id, ord, raw, error for each; calls the model for prompts without an answer, each distinct one once.

        Failures aren't kept: they are tried again by the next run.
        """
        rows = self.keyed(prompts.select("doc_id", F.col("batch").alias("ord"), "prompt"))
        folder = f"{self.path}/loose"

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            loose = Loose(folder)
            for pdf in batches:
                out = []
                for key, prompt in pdf.itertuples(index=False):
                    try:
                        if loose.get(key) is None:
                            loose.put(key, call_with_retry(call, prompt, tries))
                    except Exception as e:
                        out.append((key, message(e)))
                yield pd.DataFrame(out, columns=["key", "error"])

        todo = rows.select("key", "prompt").dropDuplicates(["key"]).join(self.answers().select("key"), "key", "left_anti")
        failed = f"{self.path}/failed-{uuid.uuid4().hex}"
        todo.mapInPandas(run, "key string, error string").write.parquet(failed)
        errors = self.spark.read.schema("key string, error string").parquet(failed)
        known = self.answers().join(errors, "key", "full_outer")
        return rows.join(known, "key", "left").select("doc_id", "ord", "raw", "error")
