"""Best-fit packing by hierarchical residuals.

Items are packed best-fit, longest first, inside groups of bounded size; nearly full bins leave, and
underfull bins go on as items of the next, smaller round of groups until one group is left. Where the
underfull bins of all documents are more than one group holds, rounds end when they no longer shrink.
Null and empty texts are the end id alone. Repeated rows are packed each for itself; columns other
than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, keep, settled, ship
from .tokens import encoded

CAPACITY = 2048
END_ID = 0
#: Items that one group packs in memory, and groups of a round that meet in one of the next.
GROUP_ITEMS = 100_000
FAN_IN = 8
#: A bin with less room than capacity / NEARLY is nearly full.
NEARLY = 64


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if kept): documents cut where longer than a sequence; the first piece is the shorter one."""
    ship(docs.sparkSession)

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("doc_id").to_pylist()
            out: list[list] = [[] for _ in range(6 if keep_ids else 5)]
            for doc, ids in zip(own, encoded(tokenizer, batch.column("text"), END_ID), strict=True):
                first = (len(ids) - 1) % capacity + 1
                for piece, start in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[start : start + (capacity if piece else first)]
                    for to, x in zip(out, (doc, piece, start, len(part), zlib.crc32(part.tobytes()), part.tolist() if keep_ids else None), strict=False):
                        to.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=False)], names=list(names[: len(out)]))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and how full each bin gets. Longest first, each into the fullest bin that has room."""
    where, offset, used = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for item in np.argsort(-sizes, kind="stable"):
        size = int(sizes[item])
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, at = capacity, len(used)
            used.append(0)
        where[item], offset[item] = at, used[at]
        used[at] += size
        if room > size:
            if not by_room[room - size]:
                rooms |= 1 << (room - size)
            by_room[room - size].append(at)
    return where, offset, np.array(used, np.int64)


def pack(items: DataFrame, tables: Tables, capacity: int = CAPACITY) -> DataFrame:
    """items: item, size (1..capacity). Returns item, bin, offset."""

    def round_of(items: DataFrame, level: int, groups: int) -> DataFrame:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("item", kind="stable")
            where, offset, used = best_fit(pdf["size"].to_numpy(), capacity)
            bins = (level << 56) + (int(pdf["g"].iloc[0]) << 28) + where
            return pd.DataFrame({"item": pdf["item"], "bin": bins, "offset": offset, "used": used[where]})

        dealt = items.withColumn("g", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(groups)))
        return dealt.groupBy("g").applyInPandas(run, "item long, bin long, offset long, used long")

    def under(placed: DataFrame) -> DataFrame:
        return placed.filter(F.col("used") < capacity - capacity // NEARLY).select(F.col("bin").alias("item"), F.col("used").alias("size")).distinct()

    count = items.count()
    groups = max(1, -(-count // GROUP_ITEMS))
    first = tables.write("round0", round_of(items, 0, groups))
    left = under(first)
    chain, level, before = None, 0, count
    while groups > 1 and (n := left.count()) > 1:
        fewer = max(1, -(-groups // FAN_IN), -(-n // GROUP_ITEMS))
        if fewer >= groups and n >= before:
            break
        groups, before, level = fewer, n, level + 1
        placed = tables.write(f"round{level}", round_of(left, level, groups))
        left = under(placed)
        step = placed.select(F.col("item").alias("from"), F.col("bin").alias("to"), F.col("offset").alias("by"))
        if chain is None:
            chain = step
        else:
            last = step.select(F.col("from").alias("to"), F.col("to").alias("on"), F.col("by").alias("more"))
            chain = chain.join(last, "to", "left").select("from", F.coalesce("on", "to").alias("to"), (F.col("by") + F.coalesce("more", F.lit(0))).alias("by"))
    if chain is None:
        return first.select("item", "bin", "offset")
    return first.join(chain, first["bin"] == chain["from"], "left").select("item", F.coalesce("to", "bin").alias("bin"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """docs: doc_id, text. The pieces of every document with sequence_id and offset."""
    tables = Tables(docs.sparkSession, "packing")
    cut = tables.write("pieces", pieces(docs, tokenizer, capacity, keep_ids).withColumn("item", F.monotonically_increasing_id()))
    placed = pack(cut.select("item", F.col("length").alias("size")), tables, capacity)
    out = keep(cut.join(placed, "item").withColumnRenamed("bin", "sequence_id").drop("item"))
    tables.drop()
    return out


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the sequences themselves, from pieces packed with their ids. At most `capacity` ids meet in a group."""
    in_order = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(in_order, lambda x: x["ids"])).alias("ids"))
