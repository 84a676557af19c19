"""SentencePiece encoding and decoding by a relational lattice.

A text with spaces written as ▁ and one ▁ before it falls into units: a run of ▁ and what follows up
to the next. No piece reaches from another character into a ▁, so units are encoded on their own, each
distinct one once: all its substrings up to the longest piece's length are joined to the piece table,
the matches are the unit's edges, and a Spark aggregate folds over them. For a unigram model the fold
is Viterbi over the edges by end. A BPE model's scores are the ranks of its merges, and the best sum of
ranks isn't what such a model encodes to; there the fold goes over the edges by rank, then place, and
gives the library's ids; the model's type decides. Units of over LONG characters, for which the
fold's 64-bit set of cuts is too small, are encoded in Python, by a heap of merges or Viterbi. The ids
are decoded again, each distinct unit once, and the texts put together from them.

Null and empty texts have no ids. Characters without a piece are written as byte pieces (BPE with byte
fallback) or one unknown piece. Repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, keep, settled, ship, trim
from .shingles import slices

#: Units of more characters don't fit the fold's 64-bit set of cuts.
LONG = 60
CHUNK_BYTES = 24 << 20
#: Distinct units of BLOCK_TASKS reading tasks are dealt to as many buckets: that bounds what meets in one.
BUCKETS, BLOCK_TASKS = 1024, 256
#: Partitions for each chunk's units while they have all their edges.
PARTITIONS = 4
#: Units of a chunk whose ids are put together at a time.
TOGETHER = 400_000
#: Characters by which the longest piece that begins like a substring is looked up.
HEAD = 3
UNIGRAM, BPE = 1, 2
UNIT = re.compile(r" [ ]*[^ ]+| +")


def piece_rows(model_path: str) -> pd.DataFrame:
    """piece, id, score of the model's ordinary pieces. As many rows as its vocabulary has: that bounds what is broadcast."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_byte(i) or m.is_unknown(i) or m.is_unused(i))]
    return pd.DataFrame({"piece": [m.id_to_piece(i) for i in ids], "id": ids, "score": [float(m.get_score(i)) for i in ids]})


def special_ids(model_path: str) -> tuple[int, int]:
    """The id of the first byte piece (-1 without byte fallback) and that of the unknown piece."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_path)
    first = m.piece_to_id("<0x00>")
    return (first if m.is_byte(first) else -1), m.unk_id()


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte, at = raw[at], at + 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(raw):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        at += size
        yield number, raw[at - size : at]


def model_type(model_path: str) -> int:
    """UNIGRAM or BPE, as the model's trainer specification (field 2, its field 3) says."""
    with open(model_path, "rb") as file:
        spec = next((v for k, v in fields(file.read()) if k == 2), b"")
    kind = next((v for k, v in fields(spec) if k == 3), UNIGRAM)
    if kind not in (UNIGRAM, BPE):
        raise ValueError(f"model type {kind} is neither unigram nor BPE")
    return kind


def late_pieces(scores: dict[str, float]) -> set[str]:
    """Pieces that merge after a longer piece which they begin or end: only they can make a merge possible whose rank has passed."""
    found = set()
    for whole, score in scores.items():
        for k in range(1, len(whole)):
            parts = whole[:k], whole[k:]
            if all(len(x) == 1 or x in scores for x in parts):
                found.update(x for x in parts if len(x) > 1 and scores[x] < score)
    return found


# ---- lattice


def power(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))


def bits(code: Column, at: int, size: int) -> Column:
    """`size` bits of a code, from bit `at` on."""
    return (F.shiftright(code, at) if at else code).bitwiseAND(F.lit((1 << size) - 1))


def edges_of(units: DataFrame, rows: pd.DataFrame, kind: int = BPE) -> DataFrame:
    """units: bucket, unit, in which ▁ are spaces, and its length n. bucket, unit, n, edges: array of (code, ends, inner; score for unigram
    models), best rank first, then leftmost.

    code holds, from its highest bits, rank, start, stop, whether the piece is late, and id + 1 (0 for a character without a piece, which
    only unigram models need as an edge); units of which no substring is a piece have no row. ends
    and inner are the cuts at and between the edge's ends, as bits. Substrings are no longer than the longest piece that begins with the
    same HEAD characters. Units are in order before their edges are made, so that these come in order.
    """
    spark = units.sparkSession
    heads = rows.assign(head=rows["piece"].str.slice(0, HEAD), most=rows["piece"].str.len()).groupby("head", as_index=False)["most"].max()
    rank = rows["score"].rank(method="dense", ascending=False).astype("int64")
    table = spark.createDataFrame(pd.DataFrame({"piece": rows["piece"], "known": rank * (1 << 33) + rows["late"].astype("int64") * (1 << 20) + rows["id"].astype("int64") + 1, "score": rows["score"]}))
    least = 1 if kind == UNIGRAM else 2  # what merges leave of single characters needs no edge
    starts = units.filter(F.col("n") >= least).sortWithinPartitions("unit", "bucket").select("unit", "bucket", F.explode(F.sequence(F.lit(0), F.col("n") - least)).alias("start"))
    starts = starts.withColumn("head", F.substring("unit", F.col("start") + 1, F.lit(HEAD))).join(F.broadcast(spark.createDataFrame(heads)), "head", "left")
    most = F.least(F.greatest(F.coalesce("most", F.lit(least)), F.lit(HEAD - 1)).cast("int"), F.length("unit") - F.col("start"))
    spans = starts.select("unit", "bucket", "start", F.explode(F.sequence(F.lit(least), most)).alias("len"))
    spans = spans.select("unit", "bucket", "start", "len", F.substring("unit", F.col("start") + 1, F.col("len")).alias("piece"))
    found = spans.join(F.broadcast(table), "piece", "left" if kind == UNIGRAM else "inner").filter("known IS NOT NULL OR len = 1")
    place = F.shiftleft(F.col("start").cast("long"), 27).bitwiseOR(F.shiftleft((F.col("start") + F.col("len")).cast("long"), 21))
    stop = F.col("start") + F.col("len")
    columns = [F.coalesce("known", F.lit(0)).bitwiseOR(place).alias("code"), power(F.col("start")).bitwiseOR(power(stop)).alias("ends"), (power(stop) - power(F.col("start") + 1)).alias("inner")]
    edge = F.struct(*columns, *(["score"] if kind == UNIGRAM else []))
    return found.groupBy("unit", "bucket").agg(F.sort_array(F.collect_list(edge)).alias("edges")).withColumn("n", F.length("unit"))


def able(cuts: Column, e: Column) -> Column:
    """Whether an edge's two parts are what stands between its ends."""
    return (cuts.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(cuts.bitwiseAND(e["inner"])) == 1)


def merge_cuts(edges: Column, n: Column) -> Column:
    """The set of cuts, as bits, that BPE leaves in a unit of n characters: a fold over the edges, best rank first, leftmost first.

    -1 where a merge made another one possible whose turn had passed.
    """
    passed = lambda cuts, e: (bits(e["code"], 20, 1) == 1) & F.exists(edges, lambda f: (f["code"] < e["code"]) & able(cuts, f))

    def step(cuts: Column, e: Column) -> Column:
        fewer = cuts.bitwiseAND(F.bitwise_not(e["inner"]))
        return F.when((cuts >= 0) & able(cuts, e), F.when(passed(fewer, e), F.lit(-1).cast("long")).otherwise(fewer)).otherwise(cuts)

    return F.aggregate(edges, power(n + 1) - F.lit(1).cast("long"), step)


def slow_cuts(edges: Column, n: Column) -> Column:
    """The same where merges must turn back: the best edge that is possible is looked for anew after each merge."""

    def step(cuts: Column, _: Column) -> Column:
        best = F.get(F.filter(edges, lambda e: able(cuts, e)), F.lit(0))
        return F.coalesce(cuts.bitwiseAND(F.bitwise_not(best["inner"])), cuts)

    return F.aggregate(F.sequence(F.lit(1), n), power(n + 1) - F.lit(1).cast("long"), step)


def viterbi_cuts(edges: Column, n: Column, unknown: float) -> Column:
    """The set of cuts of the path with the greatest sum of scores; characters without a piece score `unknown`; ties to the earliest start."""
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("left"), F.lit(1).cast("long").alias("cuts")))

    def step(best: Column, stop: Column) -> Column:
        here = F.filter(edges, lambda e: bits(e["code"], 21, 6) == stop)
        at = lambda e: bits(e["code"], 27, 6).cast("int")
        ways = F.transform(here, lambda e: F.struct((F.get(best, at(e))["score"] + F.coalesce(e["score"], F.lit(unknown))).alias("score"), (-at(e)).alias("left"), F.get(best, at(e))["cuts"].bitwiseOR(power(stop)).alias("cuts")))
        return F.array_append(best, F.array_max(ways))

    return F.element_at(F.aggregate(F.sequence(F.lit(1), n), first, step), -1)["cuts"]


def tokens_of(edges: Column, cuts: Column) -> Column:
    """The low bits of the codes of the edges between the cuts, in order of their starts. Characters without one are between them."""
    own = F.filter(edges, lambda e: (cuts.bitwiseAND(e["ends"]) == e["ends"]) & (cuts.bitwiseAND(e["inner"]) == 0))
    return F.array_sort(F.transform(own, lambda e: bits(e["code"], 0, 33)))


class Characters:
    """Ids of what stands for one character: its piece, else its byte pieces, else the unknown piece."""

    def __init__(self, rows: pd.DataFrame, bytes_from: int, unknown: int):
        self.ids = {p.replace("▁", " "): [i] for p, i in zip(rows["piece"], rows["id"], strict=True) if len(p) == 1}
        self.bytes_from, self.unknown = bytes_from, unknown

    def of(self, text: str) -> list[int]:
        out: list[int] = []
        for c in text:
            out += self.ids.get(c) or ([self.bytes_from + x for x in c.encode()] if self.bytes_from >= 0 else [self.unknown])
        return out

    def unit(self, unit: str, tokens: Iterable[int]) -> list[int]:
        """The ids of a unit, from its tokens_of."""
        out, at = [], 0
        for x in tokens:
            start, stop, own = x >> 27, x >> 21 & 63, (x & 0xFFFFF) - 1
            if start > at:
                out += self.of(unit[at:start])
            out += [own] if own >= 0 else self.of(unit[start:stop])
            at = stop
        return out + self.of(unit[at:]) if at < len(unit) else out


def merged_spans(unit: str, ranks: dict[str, tuple[float, int]]) -> list[tuple[int, int]]:
    """BPE of one unit of any length by a heap of merges: start and stop of each piece."""
    text = list(unit)
    left, right = list(range(-1, len(text) - 1)), [*range(1, len(text)), -1]
    heap: list[tuple[float, int, int, int]] = []

    def offer(a: int, b: int) -> None:
        if a >= 0 and b >= 0 and (got := ranks.get(text[a] + text[b])):
            heapq.heappush(heap, (-got[0], a, b, len(text[a]) + len(text[b])))

    for i in range(len(text) - 1):
        offer(i, i + 1)
    while heap:
        _, a, b, size = heapq.heappop(heap)
        if not text[a] or not text[b] or right[a] != b or len(text[a]) + len(text[b]) != size:
            continue
        text[a], text[b], right[a] = text[a] + text[b], "", right[b]
        if right[b] >= 0:
            left[right[b]] = a
        offer(left[a], a)
        offer(a, right[a])
    return [(i, i + len(t)) for i, t in enumerate(text) if t]


def best_path(unit: str, pieces: dict[str, tuple[float, int]], longest: int, unknown: float) -> list[tuple[int, int]]:
    """Viterbi over one unit of any length: start and stop of each piece of the best path."""
    score, back = [0.0], [0]
    for stop in range(1, len(unit) + 1):
        ways = [(score[a] + pieces[unit[a:stop]][0], -a) for a in range(max(0, stop - longest), stop) if unit[a:stop] in pieces]
        if unit[stop - 1] not in pieces:
            ways.append((score[stop - 1] + unknown, 1 - stop))
        got = max(ways)
        score.append(got[0])
        back.append(-got[1])
    out, stop = [], len(unit)
    while stop:
        out.append((back[stop], stop))
        stop = back[stop]
    return out[::-1]


def fold_units(units: DataFrame, rows: pd.DataFrame, kind: int = BPE) -> DataFrame:
    """units: bucket, unit, n. bucket, unit, tokens of the units that the fold can hold and that have an edge."""
    rows = rows.assign(piece=rows["piece"].str.replace("▁", " "))
    late = late_pieces(dict(zip(rows["piece"], rows["score"], strict=True)))
    lattice = edges_of(units.filter(F.col("n") <= LONG), rows.assign(late=rows["piece"].isin(late)), kind)
    if kind == UNIGRAM:
        lattice = lattice.withColumn("cuts", viterbi_cuts(F.col("edges"), F.col("n"), float(rows["score"].min()) - 10))
    else:
        lattice = lattice.withColumn("fast", merge_cuts(F.col("edges"), F.col("n")))
        lattice = lattice.withColumn("cuts", F.when(F.col("fast") >= 0, F.col("fast")).otherwise(slow_cuts(F.col("edges"), F.col("n"))))
    return lattice.select("bucket", "unit", tokens_of(F.col("edges"), F.col("cuts")).alias("tokens"))


def long_encoder(rows: pd.DataFrame, characters: Characters, kind: int = BPE) -> Callable[[str], list[int]]:
    """Ids of units of any length: merges by a heap, or Viterbi, in memory in proportion to one unit."""
    ranks = {p: (s, i) for p, i, s in zip(rows["piece"].str.replace("▁", " "), rows["id"], rows["score"], strict=True)}
    longest, least = max(map(len, ranks)), min(s for s, _ in ranks.values()) - 10

    def ids_of(unit: str) -> list[int]:
        out: list[int] = []
        for a, b in best_path(unit, ranks, longest, least) if kind == UNIGRAM else merged_spans(unit, ranks):
            out += [ranks[unit[a:b]][1]] if unit[a:b] in ranks else characters.of(unit[a:b])
        return out

    return ids_of


# ---- documents


def by_planes(values: np.ndarray) -> bytes:
    """Numbers of 32 bits compressed with like bytes of all together."""
    planes = np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def from_planes(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def chunk_rows(docs: DataFrame, places: bool) -> DataFrame:
    """Runs of documents. Of each the distinct units (without their first space) by bucket: chunk, digest, parts, each with the number of its
    first unit and its units in one string, between ▁ (no unit holds one); or, with `places`: chunk, digest, doc_id, n_units and the number of each unit, compressed as place."""

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        chunk = task << 24
        for batch in batches:
            for at, part in slices(batch.column("text"), CHUNK_BYTES):
                part = pc.replace_substring(part, "▁", " ")
                empty = pc.equal(pc.binary_length(part), 0)
                odd = pc.match_substring_regex(part, "^ |  | $")
                lists = pc.split_pattern(pc.if_else(pc.or_(odd, empty), pa.scalar(None, part.type), part), " ")
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = pc.drop_null(lists).flatten()
                spaced = [[u[1:] for u in UNIT.findall(" " + part[int(i)].as_py())] for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False))]
                if spaced:
                    flat = pa.concat_arrays([flat.cast(pa.large_string()), pa.array([u for x in spaced for u in x], pa.large_string())])
                coded = flat.dictionary_encode()
                index, units = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
                del lists, flat, coded
                if spaced:  # they stand behind all others: put each back in its place
                    rows, sizes = np.flatnonzero(odd.to_numpy(zero_copy_only=False)), np.array([len(x) for x in spaced])
                    order = np.argsort(np.concatenate((np.repeat(np.arange(len(part)), counts), np.repeat(rows, sizes))), kind="stable")
                    counts[rows], index = sizes, index[order]
                bucket = (pd.util.hash_array(units.to_numpy(zero_copy_only=False), categorize=False) % BUCKETS).astype(np.int32)
                dealt = pc.sort_indices(pa.table({"b": bucket, "u": units}), sort_keys=[("b", "ascending"), ("u", "ascending")]).to_numpy()
                units = units.take(pa.array(dealt)).cast(pa.string())
                digest = xxhash.xxh64_intdigest(b"".join(x for x in units.buffers()[1:])) >> 1
                if places:
                    number = np.empty(len(units), np.int32)
                    number[dealt] = np.arange(len(units))
                    arrays = [batch.column("doc_id").slice(at, len(part)), pa.array(counts)]
                    rest = {"place": pa.array([by_planes(number[index])], pa.binary())}
                    names = ["doc_id", "n_units"]
                else:
                    own, base = np.unique(bucket[dealt], return_index=True)
                    lists = pa.ListArray.from_arrays(pa.array([*base, len(units)], pa.int32()), units)
                    arrays = [pa.StructArray.from_arrays([pa.array(own + task // BLOCK_TASKS * BUCKETS, pa.int32()), pa.array(base, pa.int32()), pc.binary_join(lists, "▁")], names=["bucket", "base", "units"])]
                    rest, names = {}, ["parts"]
                arrays = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in arrays]
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([digest]), *arrays, *rest.values()], names=["chunk", "digest", *names, *rest])
                chunk += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    more = "doc_id array<long>, n_units array<long>, place binary" if places else "parts array<struct<bucket: int, base: int, units: string>>"
    return rows.mapInArrow(run, f"chunk long, digest long, {more}")


def gathered(parts: DataFrame, coded: DataFrame, rows: pd.DataFrame, characters: Characters, kind: int) -> DataFrame:
    """parts: bucket, chunk, digest, base, units; coded: bucket, unit, tokens. chunk, digest, base, sizes, ids: the ids of each part's units, compressed."""
    long_ids = long_encoder(rows, characters, kind)

    def run(parts: pd.DataFrame, coded: pd.DataFrame) -> pd.DataFrame:
        known = dict(zip(coded["unit"], coded["tokens"], strict=True))
        number: dict[str, int] = {}
        ids: list[list[int]] = []
        places = []
        for units in (x.split("▁") for x in parts["units"]):
            place = np.empty(len(units), np.int64)
            for i, unit in enumerate(units):
                at = number.get(unit)
                if at is None:
                    at = number[unit] = len(ids)
                    own = " " + unit
                    ids.append(long_ids(own) if len(own) > LONG else characters.unit(own, known[own].tolist() if own in known else ()))
                place[i] = at
            places.append(place)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        table = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
        packed = [(by_planes(sizes[x]), by_planes(spread(table, sizes, x)[0])) for x in places]
        return pd.DataFrame({"chunk": parts["chunk"], "digest": parts["digest"], "base": parts["base"], "sizes": [x for x, _ in packed], "ids": [x for _, x in packed]})

    coded = coded.select(F.col("bucket").alias("dealt"), "unit", "tokens")  # both sides come from one exchange: their columns need names of their own
    return parts.groupBy("bucket").cogroup(coded.groupBy("dealt")).applyInPandas(run, "chunk long, digest long, base int, sizes binary, ids binary")


def id_bytes(rows: pd.DataFrame, bytes_from: int, unknown: int) -> list[bytes]:
    """What each id spells."""
    spelt = [b""] * (max(int(rows["id"].max()), bytes_from + 255, unknown) + 1)
    spelt[unknown] = " ⁇ ".encode()
    for i, piece in zip(rows["id"], rows["piece"], strict=True):
        spelt[i] = piece.replace("▁", " ").encode()
    if bytes_from >= 0:
        spelt[bytes_from : bytes_from + 256] = [bytes([x]) for x in range(256)]
    return spelt


def spread(values: np.ndarray, sizes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of `values` that `place` names, in a row, and where each begins and the last ends."""
    starts, n = (np.cumsum(sizes) - sizes)[place], sizes[place]
    ends = np.cumsum(n)
    return values[np.repeat(starts - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], np.concatenate(([0], ends))


def encode_documents(docs: DataFrame, model_path: str, keep_ids: bool = False) -> DataFrame:
    """docs: doc_id, text. A row for each row: doc_id, n_tokens, ids_crc32 (little-endian unsigned 32-bit ids), and of the text that the ids decode
    to its n_bytes and text_crc32 (UTF-8, without the first space); and ids if kept. docs is read twice; its rows must come in the same
    order within partitions (as from files), or an error is raised."""
    spark: SparkSession = docs.sparkSession
    ship(spark)
    tables = Tables(spark, "lattice")
    chunks = tables.write("chunks", chunk_rows(docs, places=False))
    parts = chunks.select("chunk", "digest", F.explode("parts").alias("p")).select("p.bucket", "chunk", "digest", "p.base", "p.units").repartition(max(8, PARTITIONS * chunks.count()), "bucket")
    #: All columns are looked at, and lengths come from the aggregate, so that no filter differs below the exchange: both uses of `parts` share it.
    units = parts.select("bucket", "chunk", "digest", "base", F.explode_outer(F.split("units", "▁")).alias("unit")).withColumn("unit", F.concat(F.lit(" "), "unit"))
    looked = [F.min(c).alias(c) for c in ("chunk", "digest", "base")]
    units = units.groupBy("bucket", "unit").agg(*looked, F.max(F.length("unit")).alias("n")).filter("chunk >= 0 AND digest >= 0 AND base >= 0").select("bucket", "unit", "n")
    rows, (first, unknown), kind = piece_rows(model_path), special_ids(model_path), model_type(model_path)
    told = gathered(parts, fold_units(units, rows, kind), rows, Characters(rows, first, unknown), kind)
    spelt = id_bytes(rows, first, unknown)

    def run(chunk: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        row, told = chunk.iloc[0], told.sort_values("base")
        if (told["digest"] != row["digest"]).any():
            raise RuntimeError("documents came in another order when they were read again")
        sizes, ids = (np.concatenate([np.zeros(0, np.int32), *map(from_planes, told[c])]) for c in ("sizes", "ids"))
        sizes = sizes.astype(np.int64)
        letters = [spelt[i] for i in ids]
        ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, letters), np.int64, len(letters)))))
        n_letters = np.diff(ends[np.concatenate(([0], np.cumsum(sizes)))])
        letters, ids = np.frombuffer(b"".join(letters), np.uint8), ids.astype(np.uint32)
        place, counts = from_planes(row["place"]), np.asarray(row["n_units"], np.int64)
        own: list[np.ndarray] = []
        read: list[tuple[int, int]] = []
        bounds = np.concatenate(([0], np.cumsum(counts)))
        at = 0
        while at < len(counts):  # runs of documents, so that memory doesn't grow with the chunk
            stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + TOGETHER, "right")) - 1)
            part, cuts = place[bounds[at] : bounds[stop]], bounds[at : stop + 1] - bounds[at]
            (tokens, token_at), (text, text_at) = spread(ids, sizes, part), spread(letters, n_letters, part)
            own += [tokens[a:b] for a, b in zip(token_at[cuts][:-1], token_at[cuts][1:], strict=True)]
            read += [(max(0, b - a - 1), zlib.crc32(text[a + 1 : b])) for a, b in zip(text_at[cuts][:-1], text_at[cuts][1:], strict=True)]
            at = stop
        trim()
        out = {"doc_id": pd.array(row["doc_id"], "Int64"), "n_tokens": [len(x) for x in own], "ids_crc32": [zlib.crc32(x) for x in own], "n_bytes": [n for n, _ in read], "text_crc32": [c for _, c in read]}
        return pd.DataFrame(out | ({"ids": [x.astype(np.int32) for x in own]} if keep_ids else {}))

    schema = "doc_id long, n_tokens long, ids_crc32 long, n_bytes long, text_crc32 long" + (", ids array<int>" if keep_ids else "")
    again = chunk_rows(docs, places=True)  # split again: places take more room than texts
    out = keep(again.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(run, schema))
    tables.drop()
    return out


def decode(rows: DataFrame, model_path: str) -> DataFrame:
    """rows: doc_id (unique), ids. doc_id, text: pieces are joined by id and put together in order; byte pieces become what they spell."""
    base, _ = special_ids(model_path)
    table = piece_rows(model_path).assign(piece=lambda x: x["piece"].str.replace("▁", " "))[["id", "piece"]]
    spelt = pd.DataFrame({"id": range(base, base + 256), "raw": [f"{x:02X}" for x in range(256)]})
    table = pd.concat([table.assign(raw=[p.encode().hex().upper() for p in table["piece"]])[["id", "raw"]], spelt])
    pieces = rows.sparkSession.createDataFrame(table)
    each = rows.select("doc_id", F.posexplode("ids").alias("at", "id")).join(F.broadcast(pieces), "id")
    raw = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "raw"))), lambda x: x["raw"]), "")
    text = each.groupBy("doc_id").agg(raw.alias("raw")).select("doc_id", F.substring(F.decode(F.unhex("raw"), "UTF-8"), F.lit(2), F.length("raw")).alias("text"))
    return rows.select("doc_id").join(text, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
