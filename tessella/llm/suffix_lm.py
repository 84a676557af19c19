"""Language-model scoring by a probabilistic suffix tree over the bytes of lower-cased text.

Contexts are up to DEPTH symbols long. One is retained if it occurs LEAST_COUNT times (less often in
small corpora) and its next-symbol distribution diverges from that of its suffix by more than it costs
to write down, so the model grows with the corpus. Grams are counted exactly over all training documents
and dealt to SHARDS by the last two symbols of their context, which all longer contexts of a place share:
a shard tells its retained contexts on its own, and only contexts of under two symbols are shared by all
(256 * 256 counts at most). A text is scored by the longest retained suffix at each symbol: runs of texts
ask the shards for the grams they hold. Nothing of the model is on the driver or broadcast but those counts.

Null and empty texts are the end alone. Documents without an id are training documents; repeated rows
count and are scored each for itself; columns other than doc_id and text are ignored. docs is read
several times; its rows must come in the same order within partitions (as from files), or an error is raised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, keep, settled, ship, trim
from .shingles import distinct, slices, split_words

DEPTH = 6
#: The evidence a context needs: LEAST_COUNT places, or this share of the symbols where that is less.
LEAST_COUNT, LEAST_SHARE = 20, 5e-6
SHARDS = 512
END = 0xFF  # no byte of UTF-8; also stands before each text
FOLDS, HELD_OUT = 7, 2
CHUNK_BYTES = 24 << 20
SCORE_BYTES = 6 << 20
#: Distinct grams that a task holds before it sends them on.
HELD_GRAMS = 4 << 20
#: Words are dealt to so many buckets, and to so many for each chunk's worth of text where that is more.
BUCKETS, BUCKETS_A_CHUNK = 1024, 32
#: An odd factor and its inverse modulo 2 ** 16.
MIX = 40503
UNMIX = pow(MIX, -1, 1 << 16)
SYMBOLS = 256  # 0xFE and 0xFF don't occur in UTF-8; END takes the place of the latter


def byte_stream(texts: pa.Array, before: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts, each with `before` ENDs before it and one behind it; and where each text's bytes begin."""
    texts = pc.ascii_lower(texts)
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    first = int(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset])
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[first : first + int(sizes.sum())] if sizes.sum() else np.zeros(0, np.uint8)
    gap = before + 1
    stream = np.full(len(raw) + gap * len(sizes), END, np.uint8)
    shift = np.arange(len(sizes)) * gap + before
    stream[np.arange(len(raw)) + np.repeat(shift, sizes)] = raw
    return stream, np.cumsum(sizes) - sizes + shift


def codes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Turned codes of DEPTH + 1 bytes that end at each symbol of the texts, each text's end included; and how many each text has.

    Turned: the last two symbols of the context, mixed, stand in front, so that sorted codes of a shard are a run.
    """
    stream, starts = byte_stream(texts, DEPTH)
    two = stream[:-1].astype(np.uint16) << np.uint16(8) | stream[1:]
    n = len(stream) - DEPTH
    out = np.empty(n, np.uint64)
    for at in range(0, n, 1 << 15):  # pieces stay in the processor's cache
        own = slice(at, min(n, at + (1 << 15)))
        last = two[own.start + DEPTH - 2 : own.stop + DEPTH - 2] * np.uint16(MIX)
        older = two[own].astype(np.uint32) << np.uint32(16) | two[own.start + 2 : own.stop + 2]
        out[own] = last.astype(np.uint64) << np.uint64(40) | older.astype(np.uint64) << np.uint64(8) | stream[own.start + DEPTH : own.stop + DEPTH]
    real = np.ones(len(stream), bool)
    real[(starts[:, None] - np.arange(1, DEPTH + 1)).ravel()] = False
    return out[real[DEPTH:]], np.diff(starts, append=len(stream) + DEPTH) - DEPTH


# ---- counting


def turned_back(codes: np.ndarray) -> np.ndarray:
    """Codes with their symbols in the order of the text."""
    key = ((codes >> np.uint64(40)) * np.uint64(UNMIX)) & np.uint64(0xFFFF)
    return (codes >> np.uint64(8) & np.uint64(0xFFFFFFFF)) << np.uint64(24) | key << np.uint64(8) | codes & np.uint64(0xFF)


def squeezed(values: np.ndarray) -> bytes:
    """Numbers as bytes, like places of all together."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def spread(raw: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(raw, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def merged(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, sorted, with the sums of their counts."""
    order = np.argsort(codes)
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))[: len(codes)]
    return codes[first], np.add.reduceat(n, first) if len(first) else n


def by_shard(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shards of turned, sorted codes, and the bounds of each one's run."""
    shards = ((codes >> np.uint64(40)) * np.uint64(SHARDS) >> np.uint64(16)).astype(np.int32)
    bounds = np.concatenate(([0], np.flatnonzero(np.diff(shards)) + 1, [len(codes)])) if len(codes) else np.zeros(1, np.int64)
    return shards[bounds[:-1]], bounds


def count_grams(docs: DataFrame) -> DataFrame:
    """docs: text. shard, n, codes, counts: the distinct grams of some texts that belong to a shard; and as shard -1 how often each symbol follows each."""

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        pairs = np.zeros(1 << 16, np.int64)

        def rows(shards: np.ndarray, bounds: np.ndarray, codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            at = list(zip(bounds[:-1], bounds[1:], strict=True))
            packed = [[squeezed(np.diff(codes[a:b], prepend=np.uint64(0))) for a, b in at], [squeezed(n[a:b].astype(np.int32)) for a, b in at]]
            return pa.RecordBatch.from_arrays([pa.array(shards), pa.array(np.diff(bounds).astype(np.int32)), *(pa.array(x, pa.binary()) for x in packed)], names=["shard", "n", "codes", "counts"])

        def sent() -> pa.RecordBatch:
            codes, n = merged(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            return rows(*by_shard(codes), codes, n)

        for batch in batches:
            for _, part in slices(batch.column("text"), SCORE_BYTES):
                codes, n = np.unique(codes_of(part)[0], return_counts=True)
                pairs += np.bincount((turned_back(codes) & np.uint64(0xFFFF)).astype(np.int64), n, 1 << 16).astype(np.int64)
                held.append((codes, n))
                if sum(len(x) for x, _ in held) > HELD_GRAMS:
                    held[:] = [merged(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    if len(held[0][0]) > HELD_GRAMS // 2:
                        yield sent()
        if held:
            yield sent()
        seen = np.flatnonzero(pairs)
        if len(seen):
            yield rows(np.array([-1], np.int32), np.array([0, len(seen)]), seen.astype(np.uint64), pairs[seen])

    return docs.select("text").mapInArrow(run, "shard int, n int, codes binary, counts binary")


def unpacked(codes: bytes, counts: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(spread(codes, n, np.uint64), dtype=np.uint64), spread(counts, n, np.int32).astype(np.int64)


def pair_counts(grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """code (symbol before, symbol), n over all training texts: at most 256 * 256 rows come to the driver."""

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes, n = unpacked(row["codes"], row["counts"], row["n"])
                yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(n)], names=["code", "n"])

    rows = grams.filter("shard = -1").select("n", "codes", "counts").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    found = rows.toPandas().sort_values("code")
    return found["code"].to_numpy(np.uint64), found["n"].to_numpy(np.int64)


# ---- the tree


class Level:
    """All contexts of one length: which symbols follow each how often. pairs: (context, symbol) codes, sorted."""

    def __init__(self, pairs: np.ndarray, n: np.ndarray):
        self.pairs, self.n = pairs, n
        ctx = pairs >> np.uint64(8)
        self.first = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1])))[: len(pairs)]
        self.names = ctx[self.first]
        self.symbols = np.diff(self.first, append=len(pairs))
        self.total = np.add.reduceat(n, self.first) if len(self.first) else n

    def suffixes(self, k: int) -> Level:
        """The level of contexts of k symbols."""
        return Level(*merged(self.pairs & np.uint64((1 << (8 * (k + 1))) - 1), self.n))

    def retained(self, shorter: Level, k: int, least: float) -> Level:
        """The contexts of k symbols that occur often enough and gain more by their own distribution than half a log of their count for each
        symbol. shorter: the level of their suffixes."""
        at = np.searchsorted(shorter.pairs, self.pairs & np.uint64((1 << (8 * k)) - 1))
        owner = np.repeat(np.arange(len(shorter.names)), shorter.symbols)[at]
        every = np.repeat(self.total, self.symbols)
        gain = self.n * np.log((self.n / every) / (shorter.n[at] / shorter.total[owner]))
        gain = np.add.reduceat(gain, self.first) if len(self.first) else gain
        kept = np.repeat((self.total >= least) & (gain > 0.5 * self.symbols * np.log(self.total)), self.symbols)
        return Level(self.pairs[kept], self.n[kept])


class Contexts:
    """Retained contexts of some lengths, looked up in sorted arrays."""

    def __init__(self, levels: list[tuple[int, Level]]):
        self.levels = [(k, x) for k, x in sorted(levels, key=lambda x: x[0]) if len(x.names)]

    @classmethod
    def of(cls, k: np.ndarray, pairs: np.ndarray, n: np.ndarray) -> Contexts:
        return cls([(int(x), Level(pairs[k == x], n[k == x])) for x in np.unique(k)])

    def fold(self, codes: np.ndarray, p: np.ndarray) -> np.ndarray:
        """p: the chances by shorter contexts. Those by the longest retained context of each code."""
        for k, level in self.levels:
            part = codes & np.uint64((1 << (8 * (k + 1))) - 1)
            at = np.minimum(np.searchsorted(level.names, part >> np.uint64(8)), len(level.names) - 1)
            hit = np.flatnonzero(level.names[at] == part >> np.uint64(8))
            at, part = at[hit], part[hit]
            place = np.minimum(np.searchsorted(level.pairs, part), len(level.pairs) - 1)
            seen = np.where(level.pairs[place] == part, level.n[place], 0).astype(float)
            p[hit] = seen + (level.symbols[at] * p[hit] if k else 1.0)
            p[hit] /= level.total[at] + (level.symbols[at] if k else SYMBOLS)
        return p


def least_count(total: int) -> float:
    return max(2, min(LEAST_COUNT, LEAST_SHARE * total))


def short_contexts(pairs: np.ndarray, n: np.ndarray) -> Contexts:
    """The empty context and the retained ones of one symbol."""
    one = Level(pairs, n)
    none = one.suffixes(0)
    return Contexts([(0, none), (1, one.retained(none, 1, least_count(int(n.sum()))))])


def shard_levels(codes: np.ndarray, n: np.ndarray, pairs: np.ndarray, pair_n: np.ndarray) -> list[tuple[int, Level]]:
    """The retained contexts of two symbols and more among a shard's grams."""
    least = least_count(int(pair_n.sum()))
    level, out = Level(codes, n), []
    for k in range(DEPTH, 1, -1):
        shorter = level.suffixes(k - 1) if k > 2 else Level(pairs, pair_n)
        out.append((k, level.retained(shorter, k, least)))
        level = shorter
    return out


MODEL = "shard int, m int, k binary, pairs binary, n binary"


def train(docs: DataFrame, tables: Tables) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """docs: text. The counts of symbol pairs, and a row for each shard of the tree: the retained (context, symbol) codes with length and count."""
    grams = tables.write("grams", count_grams(docs))
    pairs, pair_n = pair_counts(grams)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        codes, n = zip(*(unpacked(*x) for x in zip(rows["codes"], rows["counts"], rows["n"], strict=True)), strict=True)
        levels = shard_levels(*merged(turned_back(np.concatenate(codes)), np.concatenate(n)), pairs, pair_n)
        k = np.repeat([k for k, _ in levels], [len(x.pairs) for _, x in levels]).astype(np.uint8)
        columns = [k, np.concatenate([x.pairs for _, x in levels]), np.concatenate([x.n for _, x in levels])]
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "m": [len(k)]} | {c: [squeezed(x)] for c, x in zip(("k", "pairs", "n"), columns, strict=True)})

    model = tables.write("model", grams.filter("shard >= 0").groupBy("shard").applyInPandas(run, MODEL))
    tables.drop("grams")
    return pairs, pair_n, model


# ---- scoring


def questions(docs: DataFrame) -> DataFrame:
    """shard, chunk, part, n, codes: the distinct codes of each part of a chunk's texts, by the shard that knows them."""

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, texts in chunks_of(batches):
            for part, (_, own) in enumerate(slices(texts, SCORE_BYTES)):
                codes = distinct(codes_of(own)[0])
                shards, bounds = by_shard(codes)
                packed = [squeezed(np.diff(codes[a:b], prepend=np.uint64(0))) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                m = len(packed)
                yield pa.RecordBatch.from_arrays([pa.array(shards), pa.array([chunk] * m, pa.int64()), pa.array([part] * m, pa.int32()), pa.array(np.diff(bounds).astype(np.int32)), pa.array(packed, pa.binary())], names=["shard", "chunk", "part", "n", "codes"])

    return docs.mapInArrow(run, "shard int, chunk long, part int, n int, codes binary")


def answers(asked: DataFrame, model: DataFrame, pairs: np.ndarray, pair_n: np.ndarray) -> DataFrame:
    """chunk, part, shard, n, m, values, which: log10 of the chances of each code asked for. A shard's contexts come before its questions."""
    known = model.select("shard", F.lit(-1).cast("long").alias("chunk"), F.lit(0).alias("part"), F.col("m").alias("n"), F.col("pairs").alias("codes"), "k", F.col("n").alias("counts"))
    rows = asked.withColumn("k", F.lit(None).cast("binary")).withColumn("counts", F.lit(None).cast("binary")).unionByName(known)

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, own, now = short_contexts(pairs, pair_n), None, None
        for batch in batches:
            out: list[tuple] = []
            for shard, chunk, part, n, raw, k, counts in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if chunk < 0:
                    own, now = Contexts.of(spread(k, n, np.uint8), spread(raw, n, np.uint64), spread(counts, n, np.int64)), shard
                    continue
                codes = turned_back(np.cumsum(spread(raw, n, np.uint64), dtype=np.uint64))
                p = low.fold(codes, np.full(len(codes), 1.0 / SYMBOLS))
                if now == shard:
                    p = own.fold(codes, p)
                values, which = np.unique(np.log10(p).astype(np.float32), return_inverse=True)
                out.append((chunk, part, shard, n, len(values), squeezed(values), squeezed(which.astype(np.int32))))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=["chunk", "part", "shard", "n", "m", "values", "which"])

    rows = rows.select("shard", "chunk", "part", "n", "codes", "k", "counts").repartition("shard").sortWithinPartitions("shard", "chunk", "part")
    return rows.mapInArrow(run, "chunk long, part int, shard int, n int, m int, values binary, which binary")


def scored(texts: pa.Array, told: pd.DataFrame) -> np.ndarray:
    """log10 probability of each text of a chunk, from the answers to all its questions."""
    told = told.sort_values(["part", "shard"])
    out = [np.zeros(0)]
    for part, (_, own) in enumerate(slices(texts, SCORE_BYTES)):
        codes, counts = codes_of(own)
        order = np.argsort(codes)
        codes = codes[order]
        place = np.cumsum(np.concatenate(([False], codes[1:] != codes[:-1])), dtype=np.int32)
        del codes
        mine = told[told["part"] == part]
        logs = np.concatenate([spread(v, int(m), np.float32)[spread(w, int(n), np.int32)] for v, w, n, m in zip(mine["values"], mine["which"], mine["n"], mine["m"], strict=True)])
        if len(logs) != place[-1] + 1:
            raise RuntimeError("documents came in another order when they were read again")
        each = np.empty(len(place))
        each[order] = logs[place]
        del order, place
        out.append(np.add.reduceat(each, np.cumsum(counts) - counts))
    return np.concatenate(out)


# ---- words


def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, pa.Array], pa.Array]]:
    """chunk, the other columns, texts: runs of documents of some CHUNK_BYTES, numbered alike whenever the rows are read. All readers take the
    same columns, since the order after a repartition can depend on them."""
    chunk = TaskContext.get().partitionId() << 24
    for batch in batches:
        for at, part in slices(batch.column("text"), CHUNK_BYTES):
            yield chunk, {c: batch.column(c).slice(at, len(part)) for c in batch.schema.names if c != "text"}, part
            chunk += 1


def words_of(texts: pa.Array, buckets: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, int]:
    """The distinct words by bucket, their buckets; the number of each word of the texts, how many each text has; and a digest of the words."""
    flat, counts = split_words(texts)
    coded = flat.dictionary_encode()
    index, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    bucket = (pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) % buckets).astype(np.int32)
    dealt = pc.sort_indices(pa.table({"b": bucket, "w": words}), sort_keys=[("b", "ascending"), ("w", "ascending")]).to_numpy()
    number = np.empty(len(words), np.int64)
    number[dealt] = np.arange(len(words))
    words = words.take(pa.array(dealt)).cast(pa.string())
    return words, bucket[dealt], number[index], counts, xxhash.xxh64_intdigest("\n".join(words.to_pylist()).encode()) >> 1


def word_parts(docs: DataFrame, buckets: int) -> DataFrame:
    """docs: text, held. bucket, chunk, digest, base, words, train: the distinct words of a chunk in a bucket, the number of the first, and how
    often each stands in training documents."""

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, columns, texts in chunks_of(batches):
            words, bucket, index, counts, digest = words_of(texts, buckets)
            training = np.repeat(~columns["held"].to_numpy(zero_copy_only=False).astype(bool), counts)
            train = np.bincount(index[training], minlength=len(words)).astype(np.int32)
            own, base = np.unique(bucket, return_index=True)
            ends = pa.array([*base, len(words)], pa.int32())
            lists = [pc.binary_join(pa.ListArray.from_arrays(ends, words), " "), pa.ListArray.from_arrays(ends, pa.array(train))]
            m = len(own)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([chunk] * m, pa.int64()), pa.array([digest] * m, pa.int64()), pa.array(base, pa.int32()), *(x.slice(0, m) for x in lists)], names=["bucket", "chunk", "digest", "base", "words", "train"])

    return docs.mapInArrow(run, "bucket int, chunk long, digest long, base int, words string, train array<int>")


def word_counts(parts: DataFrame) -> DataFrame:
    """chunk, digest, base, m, c (how often each word of the part stands in all training documents), and for the bucket's first row n and v:
    the words and distinct words of training documents in the bucket."""

    def run(parts: pd.DataFrame) -> pd.DataFrame:
        number: dict[str, int] = {}
        places = [np.fromiter((number.setdefault(w, len(number)) for w in x.split(" ")), np.int64) for x in parts["words"]]
        c = np.bincount(np.concatenate(places), np.concatenate([*parts["train"]]), len(number)).astype(np.int64)
        one = np.zeros(len(parts), np.int64)
        one[0] = 1
        return pd.DataFrame({"chunk": parts["chunk"], "digest": parts["digest"], "base": parts["base"], "m": [len(x) for x in places], "c": [squeezed(c[x]) for x in places], "n": one * c.sum(), "v": one * (c > 0).sum()})

    return parts.groupBy("bucket").applyInPandas(run, "chunk long, digest long, base int, m int, c binary, n long, v long")


def whole_chunks(docs: DataFrame, buckets: int) -> DataFrame:
    """docs: doc_id, held, text. A row for each chunk: its documents' texts, compressed, and the words that each has."""

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, columns, texts in chunks_of(batches):
            words, _, index, counts, digest = words_of(texts, buckets)
            own, times = np.unique(np.repeat(np.arange(len(texts)), counts) * max(1, len(words)) + index, return_counts=True)
            doc, word = np.divmod(own, max(1, len(words)))
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            raw = b"".join(x.as_buffer().to_pybytes() for x in texts)
            lists = [columns["doc_id"], columns["held"], pa.array(counts + 1), pa.array(sizes), pa.array(np.bincount(doc, minlength=len(texts)))]
            arrays = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
            packed = [squeezed(word.astype(np.int32)), squeezed(times.astype(np.int32)), pa.compress(raw, codec="zstd", asbytes=True)]
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([digest]), *arrays, *(pa.array([x], pa.binary()) for x in packed)], names=["chunk", "digest", "doc_id", "held", "n_tokens", "sizes", "distinct", "word", "times", "raw"])

    arrays = "doc_id array<long>, held array<boolean>, n_tokens array<long>, sizes array<long>, distinct array<long>"
    return docs.mapInArrow(run, f"chunk long, digest long, {arrays}, word binary, times binary, raw binary")


def score_documents(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. A row per row: held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    ship(spark)
    tables = Tables(spark, "suffix-lm")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held"))
    pairs, pair_n, model = train(rows.filter("NOT held"), tables)
    buckets = max(BUCKETS, BUCKETS_A_CHUNK * (int(pair_n.sum()) // CHUNK_BYTES + 1))
    words = tables.write("words", word_counts(word_parts(rows, buckets)))
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    ends = rows.filter("NOT held").count()
    n, v = n + ends, v + (ends > 0)
    told = answers(questions(rows), model, pairs, pair_n)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(chunk: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        row, told = chunk.iloc[0], rows[rows["c"].isna()]
        rows = rows[rows["c"].notna()].sort_values("base")
        if (rows["digest"] != row["digest"]).any():
            raise RuntimeError("documents came in another order when they were read again")
        c = np.concatenate([np.zeros(0, np.int64), *(spread(x, int(m), np.int64) for x, m in zip(rows["c"], rows["m"], strict=True))])
        logs = np.log10((c + 1.0) / (n + v + 1.0))
        counts, m = np.asarray(row["n_tokens"]), int(np.sum(row["distinct"]))
        doc = np.repeat(np.arange(len(counts)), row["distinct"])
        word, times = spread(row["word"], m, np.int32), spread(row["times"], m, np.int32)
        sizes = np.asarray(row["sizes"], np.int64)
        raw = pa.decompress(row["raw"], int(sizes.sum()), codec="zstd") if sizes.sum() else pa.py_buffer(b"")
        texts = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)), raw])
        out = pd.DataFrame({
            "doc_id": pd.array(row["doc_id"], "Int64"),
            "held_out": np.asarray(row["held"], bool),
            "n_tokens": counts,
            "n_known": np.bincount(doc, times * (c[word] > 0), len(counts)).astype(np.int64) + int(ends > 0),
            "train_tokens": n,
            "base_score": np.bincount(doc, times * logs[word], len(counts)) + np.log10((ends + 1.0) / (n + v + 1.0)),
            "score": scored(texts, told),
        })
        trim()
        return out

    sides = words.select("chunk", "digest", "base", "m", "c").unionByName(told, allowMissingColumns=True)
    out = keep(whole_chunks(rows, buckets).groupBy("chunk").cogroup(sides.groupBy("chunk")).applyInPandas(run, schema))
    tables.drop()
    return out
