"""Token ids in files of patched frame-of-reference blocks.

A file holds the ids of some documents in a row, in blocks of 128: each block's least id is taken off,
the rest is packed at the width that fits PERCENT of the block's ids, and the high bits of the others
stand in an exception list. The header indexes where each block starts, so a document is read without
unpacking those before it. Files are the rows of a table in the shared folder (file_no, image), written
by Spark's committer: a lost executor's half-written file never shows. Their order is that of doc_id.
Null and empty texts are the end id alone; rows of one doc_id follow each other by text; null ids come first.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, keep, settled, ship
from .tokens import encoded

END_ID = 2
BLOCK = 128
PERCENT = 90
FILE_IDS = 1 << 20
MAGIC = b"TPFR"
HEAD = struct.Struct("<4sIQQQQ")  # magic, version, documents, ids, blocks, exceptions


def packed_words(low: np.ndarray, width: int) -> np.ndarray:
    """Rows of 128 values below 2**width as rows of 4 * width words: four lanes, each of 32 values."""
    out = np.zeros((len(low), width, 4), np.uint32)
    for t in range(32):
        word, shift = divmod(t * width, 32)
        lane = low[:, 4 * t : 4 * t + 4]
        out[:, word] |= lane << np.uint32(shift)
        if shift + width > 32:
            out[:, word + 1] |= lane >> np.uint32(32 - shift)
    return out.reshape(len(low), 4 * width)


def unpacked_words(words: np.ndarray, width: int) -> np.ndarray:
    words = words.reshape(len(words), width, 4)
    out = np.zeros((len(words), BLOCK), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for t in range(32):
        word, shift = divmod(t * width, 32)
        lane = words[:, word] >> np.uint32(shift)
        if shift + width > 32:
            lane = lane | (words[:, word + 1] << np.uint32(32 - shift))
        out[:, 4 * t : 4 * t + 4] = lane & mask
    return out


def to_file(doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of a file. known: whether the doc_id isn't null."""
    blocks = -(-len(ids) // BLOCK)
    grid = np.concatenate((ids, np.full(blocks * BLOCK - len(ids), ids[-1] if len(ids) else 0, np.uint32))).reshape(blocks, BLOCK)
    least = grid.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rest = grid - least[:, None]
    kth = -(-BLOCK * PERCENT // 100) - 1
    typical = np.partition(rest, kth, axis=1)[:, kth] if blocks else least
    width = np.ceil(np.log2(typical.astype(np.float64) + 1)).astype(np.uint8)
    high = rest >> width[:, None].astype(np.uint32) if blocks else rest
    row, column = np.nonzero(high)
    low = rest & ((np.uint32(1) << width.astype(np.uint32)) - np.uint32(1))[:, None]
    starts = np.concatenate(([0], np.cumsum(4 * width.astype(np.uint64)))).astype(np.uint64)
    body = np.zeros(int(starts[-1]), np.uint32)
    for w in np.unique(width):
        if w:
            own = np.flatnonzero(width == w)
            body[(starts[own][:, None] + np.arange(4 * int(w), dtype=np.uint64)).astype(np.int64)] = packed_words(low[own], int(w))
    exceptions = np.bincount(row, minlength=blocks).astype(np.uint8)
    head = HEAD.pack(MAGIC, 1, len(doc_ids), len(ids), blocks, len(row))
    parts = (doc_ids.astype("<i8"), known.astype(np.uint8), lengths.astype("<u8"), starts.astype("<u8"), least.astype("<u4"), width, exceptions, column.astype(np.uint8), high[row, column].astype("<u4"), body.astype("<u4"))
    return head + b"".join(x.tobytes() for x in parts)


class TokenFile:
    """A file's index; ids(a, b) unpacks only the blocks that hold them."""

    def __init__(self, image: bytes):
        magic, version, docs, self.n, blocks, exceptions = HEAD.unpack_from(image)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token file")
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(image, kind, n, at)
            at += got.nbytes
            return got

        self.doc_ids, self.known, self.lengths = take("<i8", docs), take("u1", docs), take("<u8", docs).astype(np.int64)
        self.starts, self.least, self.width = take("<u8", blocks + 1).astype(np.int64), take("<u4", blocks), take("u1", blocks)
        self.patches = np.concatenate(([0], np.cumsum(take("u1", blocks), dtype=np.int64)))
        self.column, self.high = take("u1", exceptions), take("<u4", exceptions)
        self.body = take("<u4", int(self.starts[-1]))

    def ids(self, a: int, b: int) -> np.ndarray:
        first, last = a // BLOCK, -(-b // BLOCK)
        if b <= a:
            return np.zeros(0, np.uint32)
        width = self.width[first:last]
        grid = np.zeros((last - first, BLOCK), np.uint32)
        for w in np.unique(width):
            if w:
                own = np.flatnonzero(width == w)
                grid[own] = unpacked_words(self.body[self.starts[first:last][own][:, None] + np.arange(4 * int(w))], int(w))
        low, high = self.patches[first], self.patches[last]
        row = np.repeat(np.arange(last - first), np.diff(self.patches[first : last + 1]))
        grid[row, self.column[low:high]] |= self.high[low:high] << width[row].astype(np.uint32)
        grid += self.least[first:last, None]
        return grid.ravel()[a - first * BLOCK : b - first * BLOCK]


def write_files(docs: DataFrame, tables: Tables, tokenizer: str, end: int = END_ID) -> DataFrame:
    """docs: doc_id, text. The table of files: file_no, n_ids, image."""
    ship(docs.sparkSession)

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_no, doc_ids, lengths, ids, held = TaskContext.get().partitionId() << 24, [], [], [], 0

        def file() -> pa.RecordBatch:
            known = np.array([x is not None for x in doc_ids], np.uint8)
            image = to_file(np.array([x or 0 for x in doc_ids], np.int64), known, np.array(lengths, np.int64), np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array([file_no]), pa.array([held]), pa.array([image], pa.binary())], names=["file_no", "n_ids", "image"])

        for batch in batches:
            for doc, got in zip(batch.column("doc_id").to_pylist(), encoded(tokenizer, batch.column("text"), end), strict=True):
                doc_ids.append(doc)
                lengths.append(len(got))
                ids.append(got)
                held += len(got)
                if held >= FILE_IDS:
                    yield file()
                    file_no, doc_ids, lengths, ids, held = file_no + 1, [], [], [], 0
        if doc_ids:
            yield file()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return tables.write("files", rows.mapInArrow(run, "file_no long, n_ids long, image binary"), "uncompressed")


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_no, image in zip(batch.column("file_no").to_pylist(), batch.column("image"), strict=True):
                got = TokenFile(image.as_py())
                ids, ends = got.ids(0, got.n), np.cumsum(got.lengths)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(ends - got.lengths, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(crc), file_no)), pa.array(got.doc_ids, mask=got.known == 0), pa.array(ends - got.lengths), pa.array(got.lengths), pa.array(crc, pa.int64())], names=["file_no", "doc_id", "at", "n_tokens", "ids_crc32"])

    docs = files.select("file_no", "image").mapInArrow(run, "file_no long, doc_id long, at long, n_tokens long, ids_crc32 long")
    sizes = files.select("file_no", F.shiftright("file_no", 24).alias("part"), "n_ids")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = sizes.select("file_no", "part", before(Window.partitionBy("part").orderBy("file_no")).alias("inside"))
    #: One row for each task that wrote: this window holds as many rows as the writing stage had tasks.
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("base"))
    bases = inside.join(parts, "part").select("file_no", (F.col("inside") + F.col("base")).alias("base"))
    return docs.join(bases, "file_no").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def export_files(files: DataFrame, folder: str) -> None:
    """Each image as a file of its own in a folder that all executors see at this path."""

    def run(rows) -> None:
        for row in rows:
            with open(f"{folder}/ids-{row.file_no:016x}.tpfr", "wb") as to:
                to.write(row.image)

    files.foreachPartition(run)


def token_files(docs: DataFrame, tokenizer: str, end: int = END_ID) -> DataFrame:
    """Writes the files, reads them back, and says where each document's ids stand."""
    tables = Tables(docs.sparkSession, "token-files")
    out = keep(read_files(write_files(docs, tables, tokenizer, end)))
    tables.drop()
    return out
