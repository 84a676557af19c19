"""Courses as they arrive: each new file of blocks is segmented and written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessella.operators import blocks as B
from tessella.operators import errors
from tessella.plans.evaluation import kept

BLOCKS = "doc_id string, block_idx int, heading string, text string"


def segment_arrivals(spark: SparkSession, inbox: str, outbox: str, checkpoint: str, max_words: int = B.V.MAX_WORDS) -> StreamingQuery:
    """Files of whole courses (Parquet of BLOCKS) in `inbox` become segments in `outbox`, failures rows in `outbox`_errors. A batch that is run again replaces itself."""

    def handle(batch: DataFrame, epoch: int) -> None:
        tagged = kept(B.merge_blocks(batch, max_words, chunked=True, errors=True))
        B.number_segments(errors.good(tagged)).write.mode("overwrite").parquet(f"{outbox}/epoch={epoch}")
        errors.bad(tagged, "segments").write.mode("overwrite").parquet(f"{outbox.rstrip('/')}_errors/epoch={epoch}")

    return spark.readStream.schema(BLOCKS).parquet(inbox).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
