"""Exact top-k inner products from an impact-ordered index, score at a time.

Vectors become whole numbers floor(scale * x). The index is blocks of vectors whose postings lie in
segments by quantised impact (the bit length of a component's size). Segments are processed by
descending impact for many queries at once; what is left of a vector bounds what it can still gain.
Processing stops when those bounds prove which few vectors can be members, and these are rescored in
whole numbers. Vectors that are null or hold null or non-finite components take no part, nor do rows
without an id; rows that repeat an id count once (the least vector). Only vectors of one length meet.
Scores must fit a long; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, keep, ship

SCALE = 64
BLOCK, QUERY_BLOCK = 8192, 8192
#: Queries scored together in memory, and how many possible members each may have on average when processing stops.
TOGETHER, FEW = 256, 64


def whole_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, size, v: array<long>."""
    fine = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    rows = rows.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("size", F.size("v"))


def packed(rows: DataFrame, blocks: int, name: str) -> DataFrame:
    """size, `name`, ids, matrix: blocks of vectors as little-endian longs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        matrix = np.concatenate([np.zeros(0, np.int64), *pdf["v"]]).astype("<i8")
        return pd.DataFrame({"size": [pdf["size"].iloc[0]], name: [pdf[name].iloc[0]], "ids": [pdf["vec_id"].to_numpy("<i8").tobytes()], "matrix": [matrix.tobytes()]})

    dealt = rows.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("size", name).applyInPandas(run, f"size int, {name} int, ids binary, matrix binary")


def segments(matrix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By descending quantised impact: the components of a segment, zeros elsewhere, and the length of what is left of each vector after it."""
    level = np.ceil(np.log2(np.abs(matrix.astype(np.float64)) + 1)).astype(np.int64)
    levels = np.unique(level)[::-1]
    for at in levels[levels > 0]:
        left = np.where(level < at, matrix, 0).astype(np.float64)
        yield np.where(level == at, matrix, 0), np.sqrt((left * left).sum(axis=1))


def best(queries: np.ndarray, query_ids: np.ndarray, matrix: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Query id, the ids and exact scores of its k best in this block, ties to smaller ids."""
    if not len(ids):
        return
    size = matrix.shape[1]
    top = int(np.abs(queries).max(initial=0)) * int(np.abs(matrix).max(initial=0)) * max(1, size)
    kind = np.float32 if top < 1 << 24 else np.float64
    slack = 1e-9 * top + (1.0 if top >= 1 << 52 else 0.0)  # rounding, where sums aren't exact
    parts = [(part.T.astype(kind), left) for part, left in segments(matrix)]
    for at in range(0, len(queries), TOGETHER):
        q, own = queries[at : at + TOGETHER], query_ids[at : at + TOGETHER]
        length = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        score = np.zeros((len(q), len(ids)), kind)
        place = np.searchsorted(ids, own)
        mine = np.flatnonzero(ids[np.minimum(place, len(ids) - 1)] == own)
        possible = None
        for part, left in parts:
            score += q.astype(kind) @ part
            bound = np.outer(length, left).astype(kind)
            low = score - bound
            low[mine, place[mine]] = -np.inf
            limit = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(q), -np.inf)
            bound += score
            possible = bound >= (limit * (1 - 1e-6 * np.sign(limit)) - 1 - slack)[:, None]
            if possible.sum() <= FEW * len(q):
                break
        if possible is None:
            possible = np.ones(score.shape, bool)
        possible[mine, place[mine]] = False
        for i in range(len(q)):
            who = np.flatnonzero(possible[i])
            exact = matrix[who] @ q[i]
            order = np.lexsort((ids[who], -exact))[:k]
            yield int(own[i]), ids[who][order], exact[order]


def top_k(rows: DataFrame, k: int = 20, query_filter: str = "vec_id % 20 = 0", scale: int = SCALE) -> DataFrame:
    """rows: vec_id, embedding. query_id, rank, vec_id, score for every row that the filter names."""
    ship(rows.sparkSession)
    tables = Tables(rows.sparkSession, "impact-index")
    vectors = tables.write("vectors", whole_vectors(rows, scale))
    n = vectors.count()
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-vectors.filter(query_filter).count() // QUERY_BLOCK))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    index = packed(vectors, blocks, "block").withColumn("part", every(query_blocks))
    queries = packed(vectors.filter(query_filter), query_blocks, "part").withColumn("block", every(blocks))

    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(index) and len(queries):
            (ids, matrix), (query_ids, wanted) = ((np.frombuffer(x["ids"].iloc[0], "<i8"), np.frombuffer(x["matrix"].iloc[0], "<i8")) for x in (index, queries))
            size = int(index["size"].iloc[0])
            for query, who, score in best(wanted.reshape(len(query_ids), size), query_ids, matrix.reshape(len(ids), size), ids, k):
                found.append(pd.DataFrame({"query_id": query, "vec_id": who, "score": score}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    keys = ["size", "block", "part"]
    near = index.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score long")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    out = keep(ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    tables.drop()
    return out


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
"""
