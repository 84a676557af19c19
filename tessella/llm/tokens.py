"""Ids of whole texts by the tokenizers library, encoded once for each distinct unit.

A byte-level tokenizer of this kind never lets a token reach from a non-space character into white
space after it, so a text may be cut before any space that follows a non-space character, and its ids
are those of its units in a row. Only units not seen lately are given to the library: to its BPE
model where a unit is made of runs of letters, signs behind them and single line ends, else to the whole tokenizer.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
import pyarrow.compute as pc  # noqa: E402

from .shingles import slices  # noqa: E402

#: Distinct units in each of the two generations that a worker remembers.
REMEMBERED = 150_000
SLICE_BYTES = 8 << 20
#: Where a space may not begin a unit, in Arrow's expressions and in Python's.
SPACE_AFTER_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}] "
#: Signs that never begin a word of their own behind letters, as an apostrophe may.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
CUT = re.compile(r"(?<=\S)(?= )")


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself if it prints in Latin-1, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class UnitEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _run(self, unit: str) -> bytes:
        """Ids of one run of letters, with or without a space before it."""
        word = unit.replace(" ", self.letters[32]) if unit.isascii() else unit.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.library.model.tokenize(word)]).tobytes()

    def _known(self, unit: str) -> bytes | None:
        got = self.young.get(unit)
        if got is None:
            got = self.old.get(unit)
            if got is not None:
                self.young[unit] = got
        return got

    def _word(self, unit: str) -> bytes | None:
        """Ids of a run of letters and the signs behind it, each a word to the library. Only the letters are remembered: signs vary. None if it is anything else."""
        core = unit.rstrip(SIGNS)
        if not (core[1:] if core[:1] == " " else core).isalpha():
            return None
        got = self.young.get(core)
        if got is None:
            got = self.old.get(core)
            self.young[core] = got = self._run(core) if got is None else got
        if len(core) == len(unit):
            return got
        tail = unit[len(core) :]
        return got + (self.young.get(tail) or self._plain(tail))

    def _split(self, unit: str) -> bytes | None:
        """Words with one line end between each two; a line end between other characters is a word of its own to the library."""
        if "\n" not in unit:
            return self._word(unit)
        words = [self._word(x) for x in unit.split("\n")]
        return None if None in words or "\n " in unit else self._plain("\n").join(words)

    def units(self, units: list[str]) -> list[bytes]:
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        found, other = list(map(self.young.get, units)), []
        for at, got in enumerate(found):
            if got is None:
                unit = units[at]
                got = self._split(unit)
                found[at] = got = self._known(unit) if got is None else got
                if got is None:
                    other.append(at)
        for first in range(0, len(other), 20_000):
            part = other[first : first + 20_000]
            for at, got in zip(part, self.library.encode_batch_fast([units[i] for i in part], add_special_tokens=False), strict=True):
                found[at] = self.young[units[at]] = np.array(got.ids, np.uint32).tobytes()
        return found

    def _plain(self, tail: str) -> bytes:
        got = self._known(tail)
        if got is None:
            got = self.young[tail] = np.array(self.library.encode(tail, add_special_tokens=False).ids, np.uint32).tobytes()
        return got

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has. Texts aren't null."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        unsafe = pc.match_substring_regex(texts, SPACE_AFTER_SPACE)
        split = pc.split_pattern(pc.if_else(unsafe, pa.scalar("", texts.type), texts), " ")
        coded = split.flatten().dictionary_encode()
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        firsts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        own, heads = np.unique(index[firsts], return_inverse=True)
        index[firsts] = len(pieces) + heads
        known = self.units([" " + x for x in pieces] + [pieces[i] for i in own])
        for at in np.flatnonzero(unsafe.to_numpy(zero_copy_only=False)):  # one unit of the whole text's ids
            index[firsts[at]] = len(known)
            known.append(b"".join(self.units(CUT.split(texts[int(at)].as_py()))))
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        table = np.frombuffer(b"".join(known), np.uint32)
        starts = np.cumsum(sizes) - sizes
        n = sizes[index]
        ends = np.cumsum(n)
        ids = table[np.repeat(starts[index] - (ends - n), n) + np.arange(ends[-1])]
        per_text = np.concatenate(([0], ends))
        return ids, per_text[firsts + counts] - per_text[firsts]


_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """One for each worker, which keeps what it has learned from task to task."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


def encoded(path: str, texts: pa.Array, end: int) -> Iterator[np.ndarray]:
    """The ids of each text, and the id `end` behind them."""
    for _, part in slices(texts, SLICE_BYTES):
        ids, counts = encoder(path).encode(part)
        stop = np.array([end], np.uint32)
        at = 0
        for n in counts:
            yield np.concatenate((ids[at : at + n], stop))
            at += n
