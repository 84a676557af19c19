"""Periodic runs, importance resampling and BPE, each against a brute-force version or the library, on small tables with odd rows."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import bpe, importance, runs
from tessella.llm.queries import vocabulary

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fibonacci(n):
    x, y = ["a"], ["a", "b"]
    while len(y) < n:
        x, y = y, y + x
    return y[:n]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    rows = [None, "", "  \n\t ", "one", "one\x0btwo\rthree\x0c\n four", "a " * 500, "x" * 3000, "Ünï ſtrange 日本語 🙂 text,  marks\x1c. \x85 <|endoftext|>don't I'VE", " ".join(fibonacci(600))]
    for _ in range(150):
        kinds, n = rng.choice([1, 2, 2, 3, 4, 30, 200]), rng.randrange(0, 130)
        w = [f"W{rng.randrange(kinds)}" + rng.choice(["", "", ".", "-x"]) * (kinds > 30) for _ in range(n)]
        if w and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 2))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        rows.append(rng.choice([" ", "\n", " \t"]).join(w))
    rows.append(" ".join(f"{rng.choice(string.ascii_lowercase)}{rng.randrange(40)}" for _ in range(6000)))
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    """With columns that clash with names the operators use inside, repeated rows and an id that is null."""
    rows = [(i, t, 1, "x", [1], 5) for i, t in enumerate(texts)]
    rows += [(3, "one", 2, "y", None, 6), (None, "no id here, at all " * 9, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, score long, rank string, runs array<int>, start long").repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# ---- 11


def brute_runs(w, least=24, copies=3):
    """Every stretch of equal words q apart, for every q; a stretch's smallest q counts."""
    found = {}
    for q in range(1, len(w) // copies + 1):
        k = 0
        while k + q < len(w):
            e = k
            while e + q < len(w) and w[e] == w[e + q]:
                e += 1
            if e - k + q >= copies * q and e > k:
                found.setdefault((k, e - k + q), q)
            k = max(e, k + 1) if e == k else e + 1
    return sorted((s, n, q) for (s, n), q in found.items() if n >= max(least, copies * q))


def planted(doc, text):
    w, h = WORD.findall(text or ""), zlib.crc32(str(doc).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("least,copies", [(24, 3), (1, 2), (6, 4)])
def test_runs_equal_brute_force(docs, texts, least, copies):
    got = Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in runs.find_runs(docs, least, copies).collect())
    want = Counter()
    for i, t in [*enumerate(texts), (3, "one"), (None, "no id here, at all " * 9)]:
        w = WORD.findall(t or "")
        found = brute_runs(w, least, copies)
        want[i, len(w), tuple(found), collapsed(w, found)] += 1
    assert got == want


def test_run_digests_of_planted_periods_equal_brute_force(spark, texts):
    rows = [(i * 7 + k, t) for k in range(3) for i, t in enumerate(texts) if len(t or "") < 9000]
    got = {}
    for r in runs.run_digests(runs.find_runs(runs.with_planted_periods(spark.createDataFrame(rows, "doc_id long, text string")))).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    want, periodic = {}, 0
    for doc, text in rows:
        w = planted(doc, text)
        found = brute_runs(w)
        periodic += bool(found)
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else None
        digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        want.setdefault(doc, []).append((len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest, hashlib.sha256(collapsed(w, found).encode()).hexdigest()))
    key = lambda rows: sorted(rows, key=str)
    assert periodic > 50 and {d: key(r) for d, r in got.items()} == {d: key(r) for d, r in want.items()}


def test_tree_of_deep_texts():
    one = np.zeros(100_000, np.int64)
    assert runs.maximal_runs(one, one, np.zeros(1, np.int64)).tolist() == [[0, 0, 100_000, 1]]
    rng = np.random.default_rng(1)
    block = rng.integers(0, 5000, 30_000)
    w = np.concatenate((rng.integers(0, 5000, 777), np.tile(block, 4)[:100_001]))
    assert runs.maximal_runs(w, w * 0, np.zeros(1, np.int64)).tolist() == [[0, 777, 100_001, 30_000]]


def test_walk_of_smaller_sides_is_n_log_n():
    rng = np.random.default_rng(2)
    for w in (np.zeros(4096, np.int64), rng.integers(0, 2, 4096), rng.integers(0, 300, 4096)):
        at, low, left, right = runs.branchings(runs.suffix_tree(w)[2])
        assert np.minimum(at - left, right - at).sum() <= 4096 * 12 / 2 and (low <= left).all() and (at < right).all()


def test_runs_of_nothing(none):
    assert runs.run_digests(runs.find_runs(runs.with_planted_periods(none))).count() == 0


# ---- 12


def brute_draw(rows, target, least=20, percent=10):
    features = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    bucket = lambda w: zlib.crc32(w.encode()) % 10000
    s, t = Counter(bucket(w) for _, x in rows for w in features(x)), Counter(bucket(w) for x in target for w in features(x))
    n, m = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n + 10000) / ((s[b] + 1) * (m + 10000))))
    out = []
    for doc, text in rows:
        fs = features(text)
        weight = sum(gain(bucket(w)) for w in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, len(fs), weight, None if doc is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= least and x[0] is not None), key=lambda x: (-x[3], x[0]))
    place = {}
    for r, x in enumerate(able[: percent * len(able) // 100], 1):
        place.setdefault(x[0], []).append(r)
    return sorted(((*x, place[x[0]].pop(0) if place.get(x[0]) and x[1] >= least else None) for x in out), key=str)


@pytest.mark.parametrize("percent", [10, 50, 100, 0])
def test_draw_equals_brute_force(spark, docs, texts, percent):
    target = ["W1 W2 w3 text, 日本語", None, "", "a a b"]
    got = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent)
    rows = [*enumerate(texts), (3, "one"), (None, "no id here, at all " * 9)]
    assert sorted(map(tuple, got.collect()), key=str) == brute_draw(rows, target, percent=percent)


def test_draw_of_ties_and_repeated_rows(spark):
    rows = [(i // 2, "same words " * 20) for i in range(400)]
    got = importance.resample(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame([], "text string"), percent=50)
    assert sorted(map(tuple, got.collect()), key=str) == brute_draw(rows, [], percent=50)


def test_draw_of_nothing(spark, none):
    assert importance.resample(none, spark.createDataFrame([("x",)], "text string")).count() == 0


def test_draw_equals_its_sql_on_texts_beyond_ascii(spark, docs):
    con = duckdb.connect()
    rows = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text")
    target = spark.createDataFrame([(0, "W1 W2 w3 Ünï 日本語"), (1, None)], "item_id long, text string")
    con.register("documents", rows.toPandas())
    con.register("benchmark", target.toPandas())
    got = importance.resample(rows, target)
    want = con.execute(importance.ORACLE_SQL).fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


# ---- 13


def test_scores_span_what_the_gains_tell(spark):
    """The bounds of the histogram of scores hold for every hash and every gain."""
    low, high = importance.noise(0), importance.noise((1 << 32) - 1)
    assert low < 0 < high and high - low < 30_000
    rng = random.Random(5)
    assert all(low <= importance.noise(rng.randrange(1 << 32)) <= high for _ in range(20_000))
    rows = [(i, " ".join(rng.choices(["a", "b", "c"], k=25))) for i in range(2000)]
    got = importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("c c c d",)], "text string"), percent=100)
    assert [r.rank for r in got.orderBy(F.desc("score"), "doc_id").collect()] == list(range(1, 2001))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_prefixes_give_the_librarys_ids(library):
    rng = random.Random(4)
    e = bpe.PrefixEncoder(bpe.vocabulary(vocabulary()))
    texts = ["", " ", "a" * 700, " " * 90, "-" * 333, "don't we'll I'VE <|endoftext|> x<|endoftext|>", "\t\t x\r\n\r\n y   "]
    for letters in ("abetho sniE'rslv.,!?12 \n\t  éß日🙂́‍\xa0\x1c\x85", "aeths no", "ae-=_*. ", "aab"):
        texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 90))) for _ in range(700)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(e.units([text])[0], np.uint32).tolist() == want.ids
        raw = [w.encode() for w in e._words(text) if isinstance(w, str)]
        assert e.ids(raw) == [e.alone(w) for w in raw]


def test_last_token_of_each_prefix_is_its_encodings_last(library):
    e = bpe.PrefixEncoder(bpe.vocabulary(vocabulary()))
    word = " antidisestablishmentarianismsssss"
    for n in range(1, len(word) + 1):
        assert np.frombuffer(e.ids([word[:n].encode()])[0], np.uint32).tolist() == library.encode(word[:n], add_special_tokens=False).ids


def test_automaton_knows_all_substrings():
    strings = [b"abab", b"babb", b"aab", b"b"]
    length, link, arcs, ends = bpe.suffix_automaton(strings)
    inside = {s[i:j] for s in strings for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for n in range(1, 5):
        for x in range(1 << n):
            word, state = bytes(b"ab"[x >> k & 1] for k in range(n)), 0
            for c in word:
                state = arcs[state].get(c, -1) if state >= 0 else -1
            assert (state >= 0) == (word in inside)
    assert [length[s] for s in ends] == [len(s) for s in strings]


def test_pairs_are_compatible_as_merges_tell(library):
    v = bpe.vocabulary(vocabulary())
    e, rng = bpe.PrefixEncoder(v), random.Random(8)
    apart, pairs = 0, [(rng.randrange(3000), rng.randrange(3000)) for _ in range(4000)]
    fits = e.compatible(*(np.array(x) for x in zip(*pairs, strict=True)))
    assert (fits == e.compatible(*(np.array(x) for x in zip(*pairs, strict=True)))).all()
    for (a, b), fit in zip(pairs, fits.tolist(), strict=True):
        word = (v.pieces[a] + v.pieces[b]).decode("latin-1").translate({k: x for k, x in bpe.byte_letters().items()})
        want = [t.id for t in library.model.tokenize(word)] == [a, b]
        apart += not want
        assert fit == want
    assert 100 < apart < 3900


def test_round_trips_equal_the_library(docs, texts, library):
    got = Counter(tuple(r) for r in bpe.round_trips(docs, vocabulary()).collect())
    want = Counter()
    for i, t in [*enumerate(texts), (3, "one"), (None, "no id here, at all " * 9)]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert got == want


def test_ids_that_are_not_text(spark, library):
    ids = [[220, 47490], [50256], [], [94, 95, 187]]
    rows = spark.createDataFrame([(i, np.array(x, "<u4").tobytes()) for i, x in enumerate(ids)] + [(9, None)], "doc_id long, ids binary")
    got = {r.doc_id: r.text for r in bpe.decode_ids(rows, vocabulary()).collect()}
    assert got == {i: library.decode(x, skip_special_tokens=False) for i, x in enumerate(ids)} | {9: None}


def test_bpe_of_nothing_and_of_other_models(none):
    assert bpe.round_trips(none, vocabulary()).count() == 0
    with pytest.raises(ValueError):
        bpe.vocabulary(vocabulary("word_bpe_49k.json"))


def test_very_long_text(spark):
    """One row of some 20 MB goes through all three."""
    rng = random.Random(3)
    text = " ".join(rng.choices([f"{a}{b}{rng.randrange(100)}" for a in string.ascii_letters for b in "aeiou"], k=4_000_000))
    df = spark.createDataFrame([(1,)], "doc_id long").withColumn("text", F.lit(text))
    assert runs.find_runs(df).first().n_words == 4_000_000
    r = bpe.round_trips(df, vocabulary()).first()
    assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert importance.resample(df, df.select("text")).first().n_features == 4_000_000
