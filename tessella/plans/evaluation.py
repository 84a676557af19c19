"""The whole evaluation of courses as one plan, from blocks to documents."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessella.functions import values as V
from tessella.operators import aggregate, blocks, errors, scoring


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: that of checkpoints, from spark.checkpoint.dir. Where that is unset, a local session uses a folder of its warehouse."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not at:
            if not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            at = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints-{uuid.uuid4().hex}"
        sc.setCheckpointDir(at)
    return sc._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """df computed once: checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df computed once, as compressed Parquet in the shared folder: for what holds texts, since checkpoints are as large as the rows in memory."""
    at = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


@contextlib.contextmanager
def clustered(df: DataFrame, key: str) -> Iterator[DataFrame]:
    """df in buckets of `key`, as compressed Parquet in the shared folder, removed in the end. Joins, windows and groups by the key read it in place,
    without shuffling it: tasks write straight into the buckets, a file each, as many buckets as shuffles have partitions."""
    spark, name = df.sparkSession, f"clustered_{uuid.uuid4().hex}"
    at = f"{shared_folder(spark)}/{name}"
    try:
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", at).format("parquet").saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # its files are not the catalog's
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@dataclass(frozen=True)
class Evaluation:
    """documents: doc_id, document; errors: a row for each course and step that failed; segments: what was scored; metrics: the run's counts, there already."""

    documents: DataFrame
    errors: DataFrame
    segments: DataFrame
    metrics: dict


def metrics() -> list:
    """What a run has seen: a count of segments for each type, and of those that were left incomplete, and all characters."""
    kinds = [F.count_if(F.col("segment_type") == k).alias(k) for k in V.SEGMENT_TYPES]
    return [F.count("*").alias("segments"), F.count_if("incomplete").alias("incomplete"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"), *kinds]


def run(course_blocks: DataFrame, metadata: DataFrame, responses: DataFrame, course_responses: DataFrame, max_words: int = V.MAX_WORDS, limit: int = 0, model: str = "") -> Evaluation:
    """responses: doc_id, ord, raw; course_responses: doc_id, scores, reasoning, overall_score.

    Blocks are merged once and scored segments are read once: counts are observed as they are written. A course that fails has an error row and no segments.
    """
    tagged = kept(blocks.merge_blocks(course_blocks, max_words, chunked=True, errors=True))
    segments = aggregate.first_segments(blocks.number_segments(errors.good(tagged)), limit)
    seen = Observation()
    matched = scoring.match_responses(segments, scoring.parse_responses(responses)).observe(seen, *metrics())
    evaluated = kept(matched)  # read by every gate and digest
    documents = aggregate.course_documents(metadata, evaluated, course_responses, model)
    return Evaluation(documents, errors.bad(tagged, "segments"), evaluated, seen.get)


def evaluate(course_blocks: DataFrame, metadata: DataFrame, responses: DataFrame, course_responses: DataFrame, max_words: int = V.MAX_WORDS, limit: int = 0) -> DataFrame:
    """doc_id, document of every course."""
    return run(course_blocks, metadata, responses, course_responses, max_words, limit).documents
