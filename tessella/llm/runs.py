"""Maximal periodic runs of words, by a suffix tree of each text.

The tree is held as its leaves in order (a suffix array) and the depths at which neighbours part: each such
depth is a branching of the tree, with the leaves on both sides of it. A branching at depth d holds a branching
tandem repeat at i if leaf i is on one side and leaf i + d on the other: two copies of d words, and the word behind
them differs. Only the smaller side is walked, looking for i + d and for i - d, so a text of n words takes
O(n log n) steps. Rotating a repeat to the left, as long as the word before it fits, gives a maximal run; repeats
of several periods merge into the run of the smallest. Texts of a slice share the arrays, but no branching holds
two texts: words of different texts are different.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled, ship
from .shingles import slices, split_words

#: A run has at least so many words, and so many whole copies of its period.
LEAST, COPIES = 24, 3
SLICE_BYTES = 4 << 20
#: Leaves of smaller sides that are looked at together.
TOGETHER = 1 << 20
RUNS = "array<struct<start:long,length:long,period:long>>"


def suffix_tree(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """order: the suffixes sorted; place: where each stands in it; depth[k]: what the suffixes at k - 1 and k have in common (0 at both ends).

    Prefixes of twice the length are compared each round; only groups of equal ones are sorted again. The ranks of each round
    stay, to tell how far two neighbours agree when they part.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    depth = np.zeros(n + 1, np.int64)
    fresh = np.concatenate(([True], words[order][1:] != words[order][:-1]))
    at = np.arange(n)
    place = np.full(n + 1, -1, np.int32)  # behind the end nothing stands
    place[order] = np.maximum.accumulate(np.where(fresh, at, 0))
    rounds, h = [], 1
    active = at[~(fresh & np.concatenate((fresh[1:], [True])))]
    while len(active):
        rounds.append(place.copy())
        suffix = order[active]
        key = place[suffix].astype(np.int64) * (n + 2) + place[np.minimum(suffix + h, n)] + 1
        by = np.argsort(key, kind="stable")
        order[active], key = suffix[by], key[by]
        group = key // (n + 2)
        parts = np.concatenate(([True], key[1:] != key[:-1]))
        new = active[np.flatnonzero(parts[1:] & (group[1:] == group[:-1])) + 1]
        x, y = order[new - 1] + h, order[new] + h
        shared = np.full(len(new), h, np.int64)
        for k in range(len(rounds) - 2, -1, -1):
            same = rounds[k][np.minimum(x, n)] == rounds[k][np.minimum(y, n)]
            step = same.astype(np.int64) << k
            x, y, shared = x + step, y + step, shared + step
        depth[new] = shared
        place[order[active]] = np.maximum.accumulate(np.where(parts, active, 0))
        active = active[~(parts & np.concatenate((parts[1:], [True])))]
        h *= 2
    return order, place, depth


def branchings(depth: np.ndarray) -> tuple[np.ndarray, ...]:
    """at, low, left, right of each branching: its leaves are those from left to at and from at to right; all of its node's are from low to right."""
    inner = np.flatnonzero(depth)
    low, left, right = [], [], np.zeros(len(inner), np.int64)
    stack: list[tuple[int, int, int, int]] = []  # depth, place, where its node begins, number
    before = base = -2
    for number, (k, d) in enumerate(zip(inner.tolist(), depth[inner].tolist(), strict=True)):
        if k != before + 1:
            for *_, own in stack:
                right[own] = before + 1
            stack, base = [], k - 1
        while stack and stack[-1][0] > d:
            right[stack.pop()[3]] = k
        if stack and stack[-1][0] == d:
            low.append(stack[-1][2])
            left.append(stack[-1][1])
        else:
            low.append(stack[-1][1] if stack else base)
            left.append(low[-1])
        stack.append((d, k, low[-1], number))
        before = k
    for *_, own in stack:
        right[own] = before + 1
    return inner, np.array(low, np.int64), np.array(left, np.int64), right


def tandem_repeats(order: np.ndarray, place: np.ndarray, depth: np.ndarray, copies: int) -> tuple[np.ndarray, np.ndarray]:
    """start, period of each branching tandem repeat that is the end of `copies` copies or more."""
    at, low, left, right = branchings(depth)
    d = depth[at]
    small_left = at - left <= right - at
    begin, size = np.where(small_left, left, at), np.where(small_left, at - left, right - at)
    other_low, other_high = np.where(small_left, at, left), np.where(small_left, right, at)
    ends = np.cumsum(size)
    starts, periods = [], []
    a, n = 0, len(order)
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + TOGETHER, "right")))
        own = np.repeat(np.arange(a, b), size[a:b])
        leaf = order[begin[own] + np.arange(len(own)) - (ends[own] - size[own] - (ends[a - 1] if a else 0))]
        for i, j in ((leaf, leaf + d[own]), (leaf - d[own], leaf - d[own])):
            there = place[np.clip(j, 0, n)]
            hit = np.flatnonzero((j >= 0) & (j < n) & (there >= other_low[own]) & (there < other_high[own]))
            first, node = i[hit], own[hit]
            for k in range(1, copies - 1):  # the copies before
                j = first - k * d[node]
                there = place[np.maximum(j, 0)]
                hit = np.flatnonzero((j >= 0) & (there >= low[node]) & (there < right[node]))
                first, node = first[hit], node[hit]
            starts.append(first)
            periods.append(d[node])
        a = b
    return (np.concatenate(starts), np.concatenate(periods)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def rotated(words: np.ndarray, start: int, period: int, floor: int) -> int:
    """How far to the left the repeat at start can be rotated."""
    step = 64
    while start > floor:
        a = max(floor, start - step)
        other = np.flatnonzero(words[a:start] != words[a + period : start + period])
        if len(other):
            return a + int(other[-1]) + 1
        start, step = a, 2 * step
    return start


def maximal_runs(words: np.ndarray, text: np.ndarray, firsts: np.ndarray, least: int = LEAST, copies: int = COPIES) -> np.ndarray:
    """words of all texts in a row, the text of each, and where each text begins. Rows (text, start, length, period), sorted; starts count from the text's."""
    if not len(words):
        return np.zeros((0, 4), np.int64)
    own = text * (int(words.max()) + 1) + words
    starts, periods = tandem_repeats(*suffix_tree(own), copies)
    found = []
    ends = starts + 2 * periods
    held: list[tuple[int, int]] = []
    last = -1
    for k in np.lexsort((periods, ends)).tolist():
        i, q, end = int(starts[k]), int(periods[k]), int(ends[k])
        if end != last:
            held, last = [], end
        if any(q % p == 0 and i >= s for s, p in held):
            continue  # a period of several smaller ones
        doc = int(text[i])
        s = rotated(own, i, q, int(firsts[doc]))
        held.append((s, q))
        if end - s >= max(least, copies * q):
            found.append((doc, s - int(firsts[doc]), end - s, q))
    return np.array(sorted(found, key=lambda r: (r[0], r[1], r[3])), np.int64).reshape(-1, 4)


def find_runs(docs: DataFrame, least: int = LEAST, copies: int = COPIES) -> DataFrame:
    """docs: doc_id, text. doc_id, n_words, runs (start, length, period, by start and period), collapsed.

    Words are `[^\\x20\\x09-\\x0D]+`. A run is a stretch of at least `least` words and `copies` of its smallest period that no
    neighbouring word extends; `collapsed` is the text's words, joined by one space, without those that a run holds after its first period.
    A null, empty or blank text has no words and no runs; repeated rows give a row each; a null doc_id stays; other columns are
    dropped. No row is moved; a text is what a task works on, in memory of some 100 bytes a word.
    """
    if copies < 2:
        raise ValueError("a run has two copies at least")
    ship(docs.sparkSession)
    fields = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for at, texts in slices(batch.column("text"), SLICE_BYTES):
                flat, counts = split_words(texts, lower=False)
                ends = np.cumsum(counts)
                firsts = ends - counts
                text = np.repeat(np.arange(len(texts)), counts)
                codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                long = np.flatnonzero(counts[text] >= least) if len(text) else text  # shorter texts hold no run
                kept_counts = np.where(counts >= least, counts, 0)
                found = maximal_runs(codes[long], text[long], np.cumsum(kept_counts) - kept_counts, least, copies)
                edges = np.zeros(len(flat) + 1, np.int64)
                place = firsts[found[:, 0]] + found[:, 1]
                np.add.at(edges, place + found[:, 3], 1)
                np.add.at(edges, place + found[:, 2], -1)
                stays = np.cumsum(edges)[:-1] == 0
                left = np.concatenate(([0], np.cumsum(stays)))[np.concatenate(([0], ends))]
                collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), flat.filter(pa.array(stays))), pa.scalar(" ", flat.type))
                offsets = np.searchsorted(found[:, 0], np.arange(len(texts) + 1)).astype(np.int32)
                runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(found[:, k]) for k in (1, 2, 3)], fields=list(fields)))
                yield pa.RecordBatch.from_arrays([doc_ids.slice(at, len(texts)), pa.array(counts), runs, collapsed.cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id, text: a tenth of the documents, told by the crc32 of their ids, repeat a stretch of their words to the end; the others stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.translate("text", "\t\n\x0b\x0c\r", " " * 5), " "), lambda w: w != "")
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    rows = rows.withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10))
    rows = rows.withColumn("a", F.col("g") % F.nullif("n", F.lit(0)))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    periodic = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("words", at(i))), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, periodic).otherwise(F.col("text")).alias("text"))


def digest_of(runs: Column) -> Column:
    line = lambda r: F.concat(*(F.concat(r[c].cast("string"), F.lit(end)) for c, end in (("start", ","), ("length", ","), ("period", "\n"))))
    return F.sha2(F.array_join(F.transform(runs, line), "").cast("binary"), 256)


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest length / period (start, length, period, exponent_milli), runs_sha256, collapsed_sha256."""
    more = lambda x, y: x["length"] * y["period"] - y["length"] * x["period"]  # noqa: E731  exact, in whole numbers
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda x, y: F.when(more(y, x) > 0, y).otherwise(x))  # the first of equals: the smallest start, then period
    rows = found.withColumn("best", best)
    milli = F.expr("1000 * best.length div best.period").cast("long")
    digests = (digest_of(F.col("runs")).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"), *digests)
