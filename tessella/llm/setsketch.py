"""Near-duplicates by SetSketch registers: band, estimate jointly by likelihood, verify on full sets.

Texts with equal shingle sets are one class. Register bands give buckets of classes; every class is
held against its bucket's centre first, and what isn't in one component by then is compared pair by
pair inside its bucket, in blocks, so no link between different texts that share a bucket is lost and
no group is expanded into all its pairs. Null and blank texts have empty sets and link with nothing.
Repeated rows each get a row; a null doc_id names a component only if all its members
have none, and then each of its different texts is kept.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, shingles
from .common import Tables, keep, settled, ship

#: Registers of two bytes; the first BANDS * ROWS are banded, all serve the estimate.
REGISTERS, BANDS, ROWS = 256, 32, 4
#: Equal registers at similarity s have a probability of about 1 - SHARE * (1 - s), so a link of 0.8 shares a band but for 5e-8.
#: Registers of unrelated sets agree with (BASE - 1) / 4 at most: a band of theirs with 2.5e-16, so that chance pairs stay rare among any number of sets.
BASE, RATE, TOP = 1.0005, 20.0, 65535
SHARE = (BASE - 1) / (BASE * np.log(BASE))
#: Estimates have a deviation of 0.026 at 0.8; pairs this far below the limit, over 7 deviations, are not verified.
SLACK = 0.2
BLOCK, FAN = 2048, 256

_rng = np.random.default_rng(20)
_MUL = (_rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64) | 1).astype(np.uint32)


def registers(elements: np.ndarray) -> np.ndarray:
    """Register i: floor(1 - log_b x), x the least of exponential variates that hash i gives the elements, kept in 0..TOP. Merge by maximum."""
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    short = (elements >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 512):
        np.minimum(least, np.multiply.outer(short[at : at + 512], _MUL).min(axis=0), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint16)


def likelihood(more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The similarity of greatest likelihood, from how many registers of a are above and below those of b and the set sizes."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    same = REGISTERS - more - less
    p = lambda x: np.clip(-np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1.0)

    def fit(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-12, 1.0))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(24):
        third = (high - low) / 3
        left = fit(low + third) < fit(high - third)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2


def alike(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float) -> np.ndarray:
    """Whether rows of registers are likely enough to have this similarity; most are told by their equal registers alone."""
    enough = REGISTERS * (1 - SHARE * (1 - least))
    good = (a == b).sum(axis=1) >= enough - 3 * np.sqrt(enough * (1 - enough / REGISTERS))
    at = np.flatnonzero(good)
    if len(at):
        x, y = np.broadcast_to(a, b.shape)[at], b[at]
        good[at] = likelihood((x > y).sum(axis=1), (x < y).sum(axis=1), n_a[at].astype(float), n_b[at].astype(float)) >= least
    return good


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Rows of equal keys together, from batches that are sorted by them."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        change = np.flatnonzero((batch[keys].to_numpy()[1:] != batch[keys].to_numpy()[:-1]).any(axis=1)) + 1
        parts = [batch.iloc[a:b] for a, b in zip([0, *change], [*change, len(batch)], strict=True)]
        if held and (held[-1][keys].iloc[-1].to_numpy() != parts[0][keys].iloc[0].to_numpy()).any():
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            held = []
        held.append(parts[0])
        for part in parts[1:]:
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            held = [part]
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


def sketch_rows(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key, registers for each row of docs."""

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key, regs = [], [], []
            for own in shingles.shingle_sets(batch.column("text"), size):
                n.append(len(own))
                key.append(xxhash.xxh3_128_digest(own.tobytes()))
                regs.append(registers(own).tobytes() if len(own) else b"")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "text_key", "n_shingles", "set_key", "registers"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(run, "doc_id long, text_key long, n_shingles long, set_key binary, registers binary")


def band_rows(classes: DataFrame) -> DataFrame:
    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), regs.shape[:2]).copy()
            for k in range(ROWS):
                key = shingles.mixed(key * np.uint64(0x100000001B3) + regs[:, :, k] + np.uint64(1))
            key = (key << np.uint64(8)) | np.arange(BANDS, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("cid").to_numpy(), BANDS)), pa.array(key.ravel().view(np.int64))], names=["cid", "band"])

    return classes.select("cid", "registers").mapInArrow(run, "cid long, band long")


def likely(pairs: DataFrame, classes: DataFrame, limit: int) -> DataFrame:
    """Pairs x, y whose sizes allow the limit and whose registers make it likely enough."""
    side = lambda c: classes.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("registers").alias(f"r{c}"))
    rows = pairs.join(side("x"), "x").join(side("y"), "y").filter(100 * F.least("nx", "ny") >= limit * F.greatest("nx", "ny"))

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("rx", "ry"))
            good = alike(a, b, batch.column("nx").to_numpy(), batch.column("ny").to_numpy(), limit / 100 - SLACK)
            yield pa.RecordBatch.from_arrays([batch.column("x").filter(pa.array(good)), batch.column("y").filter(pa.array(good))], names=["x", "y"])

    return rows.select("x", "y", "nx", "ny", "rx", "ry").mapInArrow(run, "x long, y long")


def cell_pairs(cell: pd.DataFrame, limit: int) -> Iterator[tuple[int, np.ndarray]]:
    """i and the rows j of a cell whose pairs with i are likely links of different components. A pair belongs to the first band that it shares."""
    regs = np.frombuffer(b"".join(cell["registers"]), np.uint16).reshape(-1, REGISTERS)
    root, n, side = (cell[c].to_numpy() for c in ("root", "n", "side"))
    alone, number = cell["lo"].iloc[0] == cell["hi"].iloc[0], cell["band"].iloc[0] & 0xFF
    roots, at, sizes = np.unique(root, return_inverse=True, return_counts=True)
    most = at == sizes.argmax()  # all pairs have a row outside the largest component
    for i in np.flatnonzero(~most):
        j = np.flatnonzero((root != root[i]) & (most | (np.arange(len(root)) > i)) & (alone | (side != side[i])) & (100 * np.minimum(n, n[i]) >= limit * np.maximum(n, n[i])))
        if len(j):
            shared = (regs[j, : BANDS * ROWS] == regs[i, : BANDS * ROWS]).reshape(len(j), BANDS, ROWS).all(axis=2)
            j = j[shared.argmax(axis=1) == number]
        if len(j):
            j = j[alike(regs[i], regs[j], np.full(len(j), n[i]), n[j], limit / 100 - SLACK)]
        if len(j):
            yield int(i), j


CELL = "band long, lo long, hi long, side long, cid long, root long, n long, registers binary"


def involved(cells: DataFrame, limit: int) -> DataFrame:
    """The rows of sorted cells that are in a likely pair: at most as many as there are members."""

    @settled
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell in runs(batches, ["band", "lo", "hi"]):
            needed = np.zeros(len(cell), bool)
            for i, j in cell_pairs(cell, limit):
                needed[i] = needed[j] = True
            if needed.any():
                yield cell[needed]

    return cells.mapInPandas(run, CELL)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    low, high = (a, b) if len(a) <= len(b) else (b, a)
    place = np.searchsorted(high, low)
    return int((high[np.minimum(place, len(high) - 1)] == low).sum())


def cell_links(cells: DataFrame, limit: int) -> DataFrame:
    """Links a, b on full sets inside sorted cells with `elements`; a pair that others have joined by then isn't held against each other."""

    @settled
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell in runs(batches, ["band", "lo", "hi"]):
            sets, cid, links = [np.frombuffer(x, np.uint64) for x in cell["elements"]], cell["cid"].to_numpy(), []
            group = np.unique(cell["root"], return_inverse=True)[1]
            for i, js in cell_pairs(cell, limit):
                for j in js:
                    if group[i] != group[j]:
                        both = overlap(sets[i], sets[j])
                        if 100 * both >= limit * (len(sets[i]) + len(sets[j]) - both):
                            links.append((cid[i], cid[j]))
                            group[group == group[j]] = group[i]
            if links:
                yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return cells.mapInPandas(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, limit: int) -> DataFrame:
    """Links a, b among the pairs x, y, on full sets. sets: cid, elements. A frequent x is dealt over several groups."""
    fan = pairs.groupBy("x").agg(F.ceil(F.count("*") / FAN).cast("long").alias("fan"))
    dealt = pairs.join(fan, "x").withColumn("salt", F.pmod(F.xxhash64("y"), F.col("fan")))
    centre = dealt.select("x", "salt").distinct().join(sets.withColumnRenamed("cid", "x"), "x").select("x", "salt", F.col("x").alias("y"), "elements", F.lit(0).alias("late"))
    member = dealt.join(sets.withColumnRenamed("cid", "y"), "y").select("x", "salt", "y", "elements", F.lit(1).alias("late"))

    @settled
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, at = None, None
        for batch in batches:
            links = []
            for x, salt, y, raw, late in zip(batch["x"], batch["salt"], batch["y"], batch["elements"], batch["late"], strict=True):
                got = np.frombuffer(raw, np.uint64)
                if not late:
                    own, at = got, (x, salt)
                    continue
                assert at == (x, salt)
                both = overlap(own, got)
                if 100 * both >= limit * (len(own) + len(got) - both):
                    links.append((x, y))
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    rows = centre.unionByName(member).repartition("x", "salt").sortWithinPartitions("x", "salt", "late")
    return rows.mapInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, limit: int = 80) -> DataFrame:
    """docs: doc_id, text. A row per row: doc_id, text_key, n_shingles, component_id, kept.

    Links join texts whose sets of `size`-word shingles have 100 * intersection >= limit * union.
    """
    spark = docs.sparkSession
    ship(spark)
    tables = Tables(spark, "setsketch")
    rows = tables.write("rows", sketch_rows(docs, size))
    classes = rows.filter("n_shingles > 0").groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
    classes = tables.write("classes", classes.select(F.monotonically_increasing_id().alias("cid"), "set_key", "rep.doc_id", "rep.text_key", "least", "n", "registers"))
    bands = tables.write("bands", band_rows(classes))
    buckets = bands.groupBy("band").agg(F.min("cid").alias("x"), F.count("*").alias("size")).filter("size > 1")
    members = tables.write("members", bands.join(buckets, "band").select("band", "cid", "x", "size"))
    tables.drop("bands")
    stars = tables.write("pairs1", likely(members.filter("cid <> x").select("x", F.col("cid").alias("y")).distinct(), classes, limit))

    def sets_of(wanted: DataFrame, name: str) -> DataFrame:
        """cid, elements: the full sets of these classes, from the text of one row each."""
        wanted = wanted.distinct().join(classes.select("cid", "doc_id", "text_key"), "cid")
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
        found = texts.join(wanted.withColumnRenamed("doc_id", "own_id"), F.col("doc_id").eqNullSafe(F.col("own_id")) & (texts["text_key"] == wanted["text_key"])).select("cid", "text")

        @settled
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array([x.tobytes() for x in shingles.shingle_sets(batch.column("text"), size)], pa.binary())], names=["cid", "elements"])

        return tables.write(name, found.mapInArrow(run, "cid long, elements binary").dropDuplicates(["cid"]), "lz4")

    links = tables.write("links1", verified(stars, sets_of(stars.select(F.explode(F.array("x", "y")).alias("cid")), "sets1"), limit))
    tables.drop("sets1")
    roots = tables.write("roots1", graph.components(links, tables))
    placed = members.filter("size > 2").join(roots, members["cid"] == roots["node"], "left").select("band", "cid", F.coalesce("root", "cid").alias("root"))
    mixed = placed.groupBy("band").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("long")).select("band", "blocks")
    cells = placed.join(mixed, "band").withColumn("side", F.pmod(F.xxhash64("cid"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = cells.join(classes.select("cid", "n", "registers"), "cid").select("band", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "cid", "root", "n", "registers")
    whole = lambda df: df.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi", "cid")
    rest = tables.write("rest", involved(whole(cells), limit))
    if not rest.isEmpty():
        more = tables.write("links2", cell_links(whole(rest.join(sets_of(rest.select("cid"), "sets2"), "cid")), limit))
        tables.drop("sets2")
        roots = tables.write("roots2", graph.components(links.unionByName(more), tables))
    named = classes.join(roots, classes["cid"] == roots["node"], "left").select("set_key", "least", F.coalesce("root", "cid").alias("root"))
    named = tables.write("named", named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("set_key", "component_id"))
    found = rows.select("doc_id", "text_key", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = keep(found.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")))
    tables.drop()
    return out


def one_of_each(docs: DataFrame, size: int = 5, limit: int = 80) -> DataFrame:
    """The documents that stay: of each component the one with its id, once even if its row is repeated."""
    flags = near_duplicates(docs, size, limit).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key")).distinct()
    columns = docs.columns
    keyed = docs.withColumn("kept_key", F.xxhash64("text")).withColumn("kept_id", F.col("doc_id").cast("long"))
    flags = flags.withColumnRenamed("kept_id", "flag_id").withColumnRenamed("kept_key", "flag_key")
    kept = keyed.join(flags, F.col("kept_id").eqNullSafe(F.col("flag_id")) & (F.col("kept_key") == F.col("flag_key")), "left_semi")
    return kept.dropDuplicates(["kept_id", "kept_key"]).select(*columns)
