"""Word shingles of whole texts as 64-bit hashes, in bounded slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 8 << 20


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(start, texts) of runs of rows that hold about `limit` bytes; nulls become empty. A longer text is a run of its own."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0, int)
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield at, texts.slice(at, end - at)
        at = end


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words `[^\\x20\\x09-\\x0D]+` of the texts in a row, with the number of words of each text. Lower-cases A-Z only."""
    trimmed = pc.ascii_trim_whitespace(texts)
    counts = pc.list_value_length(words := pc.ascii_split_whitespace(pc.ascii_lower(trimmed) if lower else trimmed)).to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
    flat = words.flatten()
    if blank.any():
        firsts = np.concatenate(([0], np.cumsum(counts)))[:-1][blank]
        mask = np.ones(len(flat), bool)
        mask[firsts] = False
        flat = flat.filter(pa.array(mask))
        counts[blank] = 0
    return flat, counts


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, sorted. A sort is several times faster here than np.unique's hash table."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def word_hashes(flat: pa.Array) -> np.ndarray:
    coded = flat.dictionary_encode()
    own = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return own[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else own


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: windows of `size` words; fewer words count as one shingle."""
    for _, part in slices(texts):
        flat, counts = split_words(part)
        words = word_hashes(flat)
        chain = words.copy()
        for k in range(1, size):
            chain[: len(words) - k] = mixed(chain[: len(words) - k] + np.uint64(k)) + words[k:] if len(words) > k else chain[:0]
        at = 0
        for n in counts:
            if n >= size:
                yield distinct(chain[at : at + n - size + 1])
            elif n:
                yield np.array([xxhash.xxh64_intdigest(words[at : at + n].tobytes(), seed=int(n))], np.uint64)
            else:
                yield np.zeros(0, np.uint64)
            at += n
