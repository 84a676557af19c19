"""Byte-level BPE, encoded by dynamic programming over prefixes, and decoded.

A merge list has one encoding for each run of bytes, and each prefix of the run is encoded by a prefix of
it. So each prefix has one last token: the token that ends there and is compatible with the last token of
what stands before it. Two tokens are compatible if no merge crosses their border while each of them is
built. A suffix automaton over the vocabulary tells, byte by byte, which tokens end at a place; the last
tokens, followed back from the end, are the ids.

The automaton and the merges are arrays whose size follows from the vocabulary alone; they are broadcast.
A text is cut into units as `tokens` does, and each distinct unit is encoded once while a worker remembers it.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, ship
from .shingles import slices
from .tokens import REMEMBERED, SLICE_BYTES, UnitEncoder, byte_letters

#: Places for pairs of tokens that a worker remembers as compatible or not.
PAIRS = 1 << 20
#: Bytes of words that go together, and how many do.
LONG, TOGETHER = 64, 50_000
#: Bytes of texts in a slice.
SLICE = 4 << 20
NEVER = 1 << 62
SHIFT = 24


@dataclass(frozen=True)
class Vocabulary:
    """pieces: the bytes of each id. left, right, born: the merge that makes a token (-1 for a byte); rules: the merges' pairs in order.

    length, link, token and arcs are the automaton's: a state's longest string, its suffix link, the token that this string is
    (or -1), and (state << 8 | byte, state) of its arcs. added: texts that are ids of their own, before anything is merged.
    """

    pieces: list[bytes]
    left: np.ndarray
    right: np.ndarray
    born: np.ndarray
    rules: np.ndarray
    length: np.ndarray
    link: np.ndarray
    token: np.ndarray
    arcs: np.ndarray
    added: dict[str, int]


def suffix_automaton(strings: list[bytes]) -> tuple[list[int], list[int], list[dict[int, int]], list[int]]:
    """length, link and arcs of each state of the automaton of all substrings of all strings, and the state of each string."""
    length, link, arcs, ends = [0], [-1], [{}], []

    def state(n: int, up: int, out: dict[int, int]) -> int:
        length.append(n)
        link.append(up)
        arcs.append(out)
        return len(length) - 1

    def split(p: int, c: int) -> int:
        """The state that p's arc by c leads to, split if it holds longer strings than p's with c behind them."""
        q = arcs[p][c]
        if length[q] == length[p] + 1:
            return q
        own = state(length[p] + 1, link[q], dict(arcs[q]))
        link[q] = own
        while p >= 0 and arcs[p].get(c) == q:
            arcs[p][c] = own
            p = link[p]
        return own

    for text in strings:
        last = 0
        for c in text:
            if c in arcs[last]:
                last = split(last, c)
                continue
            new, p = state(length[last] + 1, 0, {}), last
            while p >= 0 and c not in arcs[p]:
                arcs[p][c] = new
                p = link[p]
            link[new] = split(p, c) if p >= 0 else 0
            last = new
        ends.append(last)
    return length, link, arcs, ends


def crossed(rules: dict[int, int], left, right, born, a: int, b: int, made: bool = False) -> bool:
    """Whether a merge joins something at the end of a with something at the start of b before both are whole.

    What ends a is, in turn, a itself, its right part, that one's right part and so on, each until the merge that takes it up;
    likewise what starts b. Merges of one rank go from the left, so at one rank the border yields to a and not to b.
    With `made`, the merge of a and b themselves doesn't count.
    """
    x, dies = a, NEVER
    while x >= 0:
        y, ends = b, NEVER
        while y >= 0:
            rank = rules.get(x << SHIFT | y)
            if rank is not None and rank < dies and rank <= ends and not (made and x == a and y == b):
                return True
            ends, y = born[y], left[y]
        dies, x = born[x], right[x]
    return False


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """Reads a tokenizer's file; raises ValueError where the file asks for something that this encoding doesn't do."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    model, before = found["model"], found.get("pre_tokenizer") or {}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    if model["type"] != "BPE" or not plain or found.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        raise ValueError(f"{path}: only plain byte-level BPE models are encoded")
    added = {t["content"]: t["id"] for t in found.get("added_tokens") or []}
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in found.get("added_tokens") or []):
        raise ValueError(f"{path}: added tokens that take up what stands beside them aren't encoded")
    own = {letter: byte for byte, letter in byte_letters().items()}
    ids = model["vocab"]
    pieces = [b""] * (max([*ids.values(), *added.values()]) + 1)
    for word, i in ids.items():
        pieces[i] = bytes(own[c] for c in word)
    for word, i in added.items():
        pieces[i] = word.encode()
    left, right, born = (np.full(len(pieces), -1, np.int64) for _ in range(3))
    rules, fine = {}, np.array([len(p) == 1 for p in pieces])
    for rank, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        x, y, made = ids[a], ids[b], ids[a + b]
        if born[made] >= 0 or max(born[x], born[y]) >= rank:
            raise ValueError(f"{path}: merges must make each token once, from tokens made before")
        left[made], right[made], born[made] = x, y, rank
        rules[x << SHIFT | y] = rank
    bytes_known = {p for p in pieces if len(p) == 1}
    if len(bytes_known) < 256:
        raise ValueError(f"{path}: some bytes have no token")
    flat = [x.tolist() for x in (left, right, born)]
    for made in np.argsort(born, kind="stable")[np.count_nonzero(born < 0) :].tolist():
        x, y = flat[0][made], flat[1][made]
        fine[made] = fine[x] and fine[y] and not crossed(rules, *flat, x, y, made=True)
    used = np.flatnonzero(fine).tolist()  # a token that its own bytes aren't encoded to never stands in a result
    length, link, arcs, ends = suffix_automaton([pieces[i] for i in used])
    token = np.full(len(length), -1, np.int64)
    token[ends] = used
    flat_arcs = np.array([(s << 8 | c, to) for s, out in enumerate(arcs) for c, to in out.items()], np.int64)
    return Vocabulary(pieces, left, right, born, np.array(list(rules), np.int64), np.array(length), np.array(link), token, flat_arcs, added)


class PrefixEncoder(UnitEncoder):
    """Ids of texts by the method above. What is an added token, and where words begin and end, is settled before.

    The words of a slice advance together, byte by byte; long ones, of which there are few, go alone by the same steps.
    """

    def __init__(self, v: Vocabulary):
        from tokenizers import pre_tokenizers

        self.cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.added = v.added
        self.any_added = re.compile("|".join(map(re.escape, sorted(v.added, key=len, reverse=True)))) if v.added else None
        self.left, self.right, self.born = v.left, v.right, v.born
        by = np.argsort(v.rules)
        self.rules, self.ranks = v.rules[by], by
        self.size = np.array([len(p) for p in v.pieces])
        self.length, self.link, self.token = v.length, v.link, v.token
        by = np.argsort(v.arcs[:, 0])
        self.arcs, self.leads = v.arcs[by, 0], v.arcs[by, 1]
        self.first = self._first_tokens()
        self.pairs, self.fits = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _first_tokens(self) -> np.ndarray:
        """For each state, the nearest on its way by suffix links, itself included, whose longest string is a token."""
        first = np.zeros(len(self.length), np.int64)
        for s in np.argsort(self.length, kind="stable")[1:].tolist():  # a link leads to a shorter one
            first[s] = s if self.token[s] >= 0 else first[self.link[s]]
        return first

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`crossed`, for many pairs."""
        out = np.zeros(len(a), bool)
        who, x, dies = np.arange(len(a)), a, np.full(len(a), NEVER)
        while len(who):
            own, y, ends = np.arange(len(who)), b[who], np.full(len(who), NEVER)
            while len(own):
                key = x[own] << SHIFT | y
                at = np.minimum(np.searchsorted(self.rules, key), len(self.rules) - 1)
                rank = self.ranks[at]
                hit = (self.rules[at] == key) & (rank < dies[own]) & (rank <= ends)
                out[who[own[hit]]] = True
                further = ~hit & (self.left[y] >= 0)
                own, ends, y = own[further], self.born[y[further]], self.left[y[further]]
            further = ~out[who] & (self.right[x] >= 0)
            who, dies, x = who[further], self.born[x[further]], self.right[x[further]]
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Remembers pairs by a hash of both tokens; a pair that falls on another's place takes it."""
        key = a << SHIFT | b
        at = (key * 0x9E3779B1 >> 7) % PAIRS
        new = np.flatnonzero(self.pairs[at] != key)
        out = self.fits[at]
        if len(new):
            pairs, back = np.unique(key[new], return_inverse=True)
            fits = ~self.apart(pairs >> SHIFT, pairs & ((1 << SHIFT) - 1))
            out[new] = fits[back]
            at = (pairs * 0x9E3779B1 >> 7) % PAIRS
            self.pairs[at] = pairs
            self.fits[at] = fits
            self.fits[at] = self._own(at, pairs, fits)
        return out

    def _own(self, at: np.ndarray, pairs: np.ndarray, fits: np.ndarray) -> np.ndarray:
        """What belongs to the pair that ended up at each place, where several of one call fell on it."""
        kept = self.pairs[at]
        return fits[np.searchsorted(pairs, kept)]

    def ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of runs of bytes that merges may join as they like."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        begin = np.cumsum(sizes) - sizes
        text = np.frombuffer(b"".join([words[k] for k in order]), np.uint8).astype(np.int64)
        last = np.zeros(len(text), np.int64)
        state, held = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for at in range(int(sizes[0]) if len(words) else 0):
            m = int(np.searchsorted(-sizes, -at, "left"))  # words of more than `at` bytes
            byte = text[begin[:m] + at]
            todo = np.arange(m)
            while len(todo):  # the start has an arc for each byte
                key = state[todo] << 8 | byte[todo]
                arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
                hit = self.arcs[arc] == key
                state[todo[hit]] = self.leads[arc[hit]]
                held[todo[hit]] += 1
                todo = todo[~hit]
                state[todo] = self.link[state[todo]]
                held[todo] = self.length[state[todo]]
            s = state[:m]
            s = self.first[np.where(held[:m] == self.length[s], s, self.link[s])]
            todo = np.arange(m)
            while len(todo):  # the longest token that ends here and fits, of which there is one
                t = self.token[s]
                before = at + 1 - self.size[t]
                fits = before == 0
                some = np.flatnonzero(~fits)
                fits[some] = self.compatible(last[begin[todo[some]] + before[some] - 1], t[some])
                last[begin[todo[fits]] + at] = t[fits]
                todo, s = todo[~fits], self.first[self.link[s[~fits]]]
        return self._followed(last, begin, sizes, order)

    def _followed(self, last: np.ndarray, begin: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> list[bytes]:
        """The tokens from the end of each word back to its start, in order."""
        counts, rounds = np.zeros(len(sizes), np.int64), []
        who, at = np.flatnonzero(sizes), sizes[sizes > 0]
        while len(who):
            t = last[begin[who] + at - 1]
            rounds.append((who, t))
            counts[who] += 1
            at = at - self.size[t]
            who, at = who[at > 0], at[at > 0]
        ends = np.cumsum(counts)
        flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
        for n, (who, t) in enumerate(rounds, 1):
            flat[ends[who] - n] = t
        out = [b""] * len(sizes)
        raw = flat.tobytes()
        for k, b, n in zip(order.tolist(), (4 * ends).tolist(), (4 * counts).tolist(), strict=True):
            out[k] = raw[b - n : b]
        return out

    def encoded_words(self, words: list[str]) -> list[bytes]:
        """The ids of words; long ones one by one, so that short ones don't wait for them."""
        raw = [w.encode() for w in words]
        short = [k for k, w in enumerate(raw) if len(w) <= LONG]
        out = [b""] * len(words)
        for at in range(0, len(short), TOGETHER):
            part = short[at : at + TOGETHER]
            for k, got in zip(part, self.ids([raw[k] for k in part]), strict=True):
                out[k] = got
        for k, w in enumerate(raw):
            if len(w) > LONG:
                out[k] = self.alone(w)
        return out

    def alone(self, word: bytes) -> bytes:
        """The same steps, one word at a time."""
        if not hasattr(self, "plain"):
            self.plain = {n: getattr(self, n).tolist() for n in ("length", "link", "token", "size", "first", "left", "right", "born")}
            self.plain |= {"arcs": dict(zip(self.arcs.tolist(), self.leads.tolist(), strict=True)), "rules": dict(zip(self.rules.tolist(), self.ranks.tolist(), strict=True)), "fits": {}}
        length, link, token, size, first, left, right, born, arcs, rules, known = self.plain.values()
        last, state, held = array("i"), 0, 0
        for at, byte in enumerate(word, 1):
            to = arcs.get(state << 8 | byte)
            while to is None:
                state = link[state]
                held = length[state]
                to = arcs.get(state << 8 | byte)
            state, held = to, held + 1
            s = first[state if held == length[state] else link[state]]
            while True:
                t = token[s]
                before = at - size[t]
                if not before:
                    break
                pair = last[before - 1] << SHIFT | t
                if pair not in known:
                    if len(known) > PAIRS:
                        known.clear()
                    known[pair] = not crossed(rules, left, right, born, last[before - 1], t)
                if known[pair]:
                    break
                s = first[link[s]]
            last.append(t)
        out, at = array("I"), len(word)
        while at:
            out.append(last[at - 1])
            at -= size[last[at - 1]]
        out.reverse()
        return out.tobytes()

    def _words(self, text: str) -> list[str | bytes]:
        """The words of any text, and the ids of added tokens between them."""
        if not self.any_added or not self.any_added.search(text):
            return [text[a:b] for _, (a, b) in self.cut.pre_tokenize_str(text)] if text else []
        out, at = [], 0
        for found in [*self.any_added.finditer(text), None]:
            part = text[at : found.start() if found else len(text)]
            out += [part[a:b] for _, (a, b) in self.cut.pre_tokenize_str(part)] if part else []
            if found:
                out.append(np.array([self.added[found.group()]], np.uint32).tobytes())
                at = found.end()
        return out

    def units(self, units: list[str]) -> list[bytes]:
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        young, old, new, words = self.young, self.old, [], {}
        for unit in units:
            if unit in young:
                continue
            got = old.get(unit)
            if got is not None:
                young[unit] = got
                continue
            if one_word(unit):
                words[unit] = None
                continue
            parts = [unit[:-1], unit[-1]] if unit[-1:] in (".", ",") and one_word(unit[:-1]) else self._words(unit)
            new.append((unit, parts))
            for w in parts:
                if type(w) is str:
                    words[w] = young.get(w)
        todo = [w for w, got in words.items() if got is None]
        words.update(zip(todo, self.encoded_words(todo), strict=True))
        for unit, parts in new:
            young[unit] = b"".join([words[w] if type(w) is str else w for w in parts])
        young.update((w, got) for w, got in words.items() if one_word(w))
        return [young[unit] for unit in units]


def one_word(unit: str) -> bool:
    """Letters, with or without a space before them, which are a word wherever they stand."""
    return (unit[1:] if unit[:1] == " " else unit).isalpha()


_encoders: dict[str, PrefixEncoder] = {}


def encoder(path: str, shared: Broadcast) -> PrefixEncoder:
    """One for each worker, of the vocabulary that it used last."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = PrefixEncoder(shared.value)
    return _encoders[path]


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """docs: doc_id, text. doc_id, ids (binary: little-endian unsigned 32-bit) of whole texts, as the tokenizers library gives them.

    A null or empty text has no ids. Repeated rows give a row each, a null doc_id stays; other columns are dropped; no row is moved.
    A document's ids stand in one cell, so a text may hold some 2 GB at most.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for at, texts in slices(batch.column("text"), SLICE):
                ids, counts = encoder(path, shared).encode(texts)
                ends = np.cumsum(counts)
                cells = [ids[b - n : b].tobytes() for n, b in zip(counts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids.slice(at, len(texts)), pa.array(cells, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def decode_ids(rows: DataFrame, path: str) -> DataFrame:
    """rows: doc_id, ids. doc_id, ids, text: the bytes that the ids stand for, added tokens too; what isn't UTF-8 becomes U+FFFD. Null ids give a null text."""
    ship(rows.sparkSession)
    pieces = rows.sparkSession.sparkContext.broadcast(vocabulary(path).pieces)

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            piece, at, texts, held = pieces.value.__getitem__, 0, [], 0
            for ids in batch.column("ids"):
                texts.append(b"".join(map(piece, np.frombuffer(ids.as_py(), "<u4").tolist())).decode("utf-8", "replace") if ids.is_valid else None)
                held += len(texts[-1] or "")
                if held > SLICE_BYTES or at + len(texts) == len(batch):
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, len(texts)) for c in ("doc_id", "ids")), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])
                    at, texts, held = at + len(texts), [], 0

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text's ids and of what they decode to."""
    rows = decode_ids(encode_texts(docs, path), path)
    n = (F.octet_length("ids") / 4).cast("long")
    return rows.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
