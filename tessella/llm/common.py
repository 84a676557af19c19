"""What the operators of this subpackage share: the shared folder, tables in it, and deployment."""

from __future__ import annotations

import atexit
import ctypes
import functools
import os
import shutil
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: ASCII white space, as every contract here has it: x20 and x09 to x0D.
SPACE = r"[\x20\x09-\x0D]"

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    On a cluster whose executors lack this path, send the package with --py-files instead.
    """
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in have:
        env["PYTHONPATH"] = ":".join([ROOT, *have])


def trim() -> None:
    """Gives memory that is free back to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    own = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if own:
        own(0)


def settled(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow or mapInPandas that gives freed memory back to the system when a task ends: workers live on between tasks."""

    @functools.wraps(run)
    def own(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return own


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local master uses a folder of its warehouse; a cluster must name one."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = spark.conf.get("tessella.own.checkpoint.dir", None)
        if not at:
            at = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared-{uuid.uuid4().hex}"
            spark.conf.set("tessella.own.checkpoint.dir", at)
            atexit.register(shutil.rmtree, at.removeprefix("file:"), ignore_errors=True)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(at)
    return at


class Tables:
    """Intermediate Parquet tables in the shared folder, dropped when they are no longer read."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.at = f"{shared_dir(spark).rstrip('/')}/tables/{label}-{uuid.uuid4().hex}"

    def write(self, name: str, df: DataFrame, codec: str = "zstd") -> DataFrame:
        """Cut lineage: write df and give it back as read from the table."""
        df.write.mode("overwrite").option("compression", codec).parquet(f"{self.at}/{name}")
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.at}/{name}")

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def keep(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, cleaned by Spark when nothing refers to it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
