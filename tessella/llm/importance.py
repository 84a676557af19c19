"""Resampling documents towards a target distribution, by hashed words, in two passes of Arrow batches.

The first pass counts the words of all documents, and of all target texts, in 10,000 buckets: each partition
gives one vector, and a treeReduce adds them. A bucket's gain is the logarithm of how much likelier it is in the
target. The second pass gathers the gains, broadcast (80 kB whatever the corpus), into a mean a document and adds
Gumbel noise that follows from the document's id, so that the highest scores are a draw without replacement in
proportion to the weights. Ranks need no global sort: scores are whole numbers in a span known from the gains, so
how many documents stand above each score is one more vector.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, keep, settled, ship
from .shingles import slices, split_words

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS, PERCENT = 20, 10
#: Levels of the tree that adds the partitions' vectors.
LEVELS = 3
#: What isn't in a word, after A-Z have become lower case.
BETWEEN = r"[^0-9a-z\x{80}-\x{10FFFF}]+"


def word_buckets(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word of the texts in a row, and how many words each text has."""
    flat, counts = split_words(pc.replace_substring_regex(pc.ascii_lower(texts), BETWEEN, " "), lower=False)
    coded = flat.dictionary_encode()
    own = np.fromiter((zlib.crc32(w) % buckets for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.int64, len(coded.dictionary))
    return own[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else own, counts


def summed(rows: DataFrame, size: int, count: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """The sum of one vector of `size` counts from each partition: the numbers that `count` yields for its batches, counted."""

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for numbers in count(batch):
                total += np.bincount(numbers, minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    vectors = rows.mapInArrow(run, "counts binary").rdd.map(lambda r: np.frombuffer(r.counts, np.int64))
    if not vectors.getNumPartitions():
        return np.zeros(size, np.int64)
    return vectors.treeReduce(add, LEVELS)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """texts: text. How many words of all of them fall into each bucket; null texts have none."""
    ship(texts.sparkSession)

    def count(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, part in slices(batch.column("text")):
            yield word_buckets(part, buckets)[0]

    return summed(texts.select("text"), buckets, count)


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over its share in the source, both with one added."""
    n, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    ratio = lambda s, t: float(t + 1) * float(all_source + n) / (float(s + 1) * float(all_target + n))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(h: int) -> int:
    """Gumbel noise in thousandths from 32 bits."""
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """docs: doc_id, text. doc_id, n_features, weight, score: the floored mean gain of a document's words, and that with noise."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(batch.column("text")):
                gains = shared.value
                found, counts = word_buckets(part, len(gains))
                own = np.repeat(np.arange(len(part)), counts)
                total = np.bincount(own, weights=gains[found], minlength=len(part)).astype(np.int64)  # whole numbers, exact below 2**53
                weight = total // np.maximum(counts, 1)
                ids = batch.column("doc_id").slice(at, len(part))
                score = [None if i is None else w + noise(int(hashlib.sha256(b"%d:%d" % (seed, i)).hexdigest()[:8], 16)) for i, w in zip(ids.to_pylist(), weight.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(counts), pa.array(weight), pa.array(score, pa.int64())], names=["doc_id", "n_features", "weight", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_features long, weight long, score long")


def ranks(scores: DataFrame, low: int, high: int, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """scores, with rank: 1, 2, 3 and so on for the drawn percentage of documents of enough words, by score, then doc_id; else null.

    All scores lie from low to high. A rank is the number of documents above the score, which a vector tells, and the place among those
    of the same score, which are few: the noise spreads equal weights over thousands of scores.
    """
    able = (F.col("n_features") >= least_words) & F.col("score").isNotNull()

    def count(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield batch.column("score").to_numpy(zero_copy_only=False) - low

    counts = summed(scores.filter(able).select("score"), high - low + 1, count)
    drawn = percent * int(counts.sum()) // 100
    above = int(counts.sum()) - np.cumsum(counts)
    some = np.flatnonzero((counts > 0) & (above < drawn))
    spark = scores.sparkSession
    place = spark.createDataFrame([(int(s) + low, int(above[s])) for s in some], "score long, above long")  # at most one row for each possible score
    inside = able & (F.col("score") >= (int(some[0]) + low if len(some) else high + 1))
    by_id = Window.partitionBy("score").orderBy("doc_id")
    at = F.col("above") + F.row_number().over(by_id)
    first = scores.filter(inside).join(F.broadcast(place), "score").withColumn("rank", at)
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank")
    rest = scores.filter(~F.coalesce(inside, F.lit(False)))
    return first.select(*scores.columns, rank).unionByName(rest.select(*scores.columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """docs: doc_id, text; target: text. Every document with n_features, weight, score and its rank in the draw.

    A null, empty or wordless text has no features and the weight 0; it isn't drawn unless least_words is 0. A null doc_id has no
    noise, so no score and no rank, though its words count. Repeated rows count, are scored and ranked each (those of one doc_id follow
    each other). With an empty target or no documents, gains come from the one that every count is raised by. Other columns are dropped.
    """
    tables = Tables(docs.sparkSession, "importance")
    gains = gains_of(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scores = tables.write("scores", scored(docs, gains, seed))
    low, high = min(0, int(gains.min())) + noise(0), max(0, int(gains.max())) + noise((1 << 32) - 1)
    out = keep(ranks(scores, low, high, least_words, percent))
    tables.drop()
    return out


ORACLE_SQL = r"""
WITH steps AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
words_of AS (SELECT 0 AS side, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
    UNION ALL SELECT 1, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
seen AS (SELECT side, id, w, count(*) AS n FROM words_of GROUP BY ALL),
codes AS (SELECT w, list_transform(range(1, CAST(length(hex(w)) AS BIGINT), 2), lambda i: CAST('0x' || substr(hex(w), i, 2) AS BIGINT)) AS bytes FROM (SELECT DISTINCT w FROM seen)),
buckets AS (SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 10000 AS b FROM codes, steps),
counts AS (SELECT b, sum(CASE WHEN side = 0 THEN n ELSE 0 END) AS s, sum(CASE WHEN side = 1 THEN n ELSE 0 END) AS t FROM seen JOIN buckets USING (w) GROUP BY b),
sums AS (SELECT coalesce(sum(s), 0) AS ss, coalesce(sum(t), 0) AS tt FROM counts),
gains AS (SELECT b, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(ss + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(tt + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM counts, sums),
own AS (SELECT id AS doc_id, sum(n) AS n, sum(n * gain) AS total FROM seen JOIN buckets USING (w) JOIN gains USING (b) WHERE side = 0 GROUP BY id),
weights AS (SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END AS BIGINT) AS weight,
    CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM documents LEFT JOIN own USING (doc_id)),
scores AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM weights),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scores)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN n_features >= 20 AND r <= 10 * n // 100 THEN r END AS BIGINT) AS rank FROM ranked
"""
