"""The pipeline on a small corpus, stage by stage, against plain versions."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm.queries import oracle_sql, queries, vocabulary
from tests.llm.test_operators import base_rule, components, library_ids, plain_spans

SECRET = "password = abcdefgh12345"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    rows = [(i, text(rng.randrange(12, 400))) for i in range(60)]
    base = rows[7][1]
    rows += [(100 + i, base) for i in range(6)]  # exact copies
    rows += [(200 + i, base + f" tail{i}") for i in range(4)]  # near copies
    rows += [(300, "too short"), (301, None), (302, "again and again and again and " * 20), (303, text(50) + f" {SECRET} " + text(30)), (304, text(9000))]
    full = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    return str(at), full


def test_pipeline_equals_plain_stages(spark, corpus):
    sf, rows = corpus
    kept = [r for r in rows if not base_rule(r[1])[5]]
    comp = components([(r[0], r[1]) for r in kept], 5)
    kept = [r for r, (i, _, c) in zip(kept, comp, strict=True) if i == c]

    def clean(t):
        for a, kind, b in reversed(plain_spans(t)):
            t = t[:a] + ("[ASSIGN REMOVED]", "[ACCESS REMOVED]", "[HEX REMOVED]")[kind] + t[b:]
        return t

    want = {r[0]: ids + [0] for r, ids in zip(kept, library_ids([clean(r[1]) for r in kept]), strict=True)}
    got: dict = {}
    sizes: dict = {}
    for r in corpus_pipeline.run(spark, sf).orderBy("doc_id", "piece").collect():
        assert zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    assert got == {d: len(x) for d, x in want.items()} and max(sizes.values()) <= 2048
    assert {7, 303, 304} <= set(got) and not {100, 200, 300, 301, 302} & set(got)


def test_stages_keep_the_columns_and_take_more(spark, corpus):
    sf, rows = corpus
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("set_key", F.lit("x")).withColumn("host", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, sf)
        assert out.columns == list(corpus_pipeline.COLUMNS)
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert not any(re.search("abcdefgh12345", r.text) for r in docs.collect()) and all(r.n_chars == len(r.text) for r in docs.collect())


def test_boilerplate_lines_leave_the_texts(spark):
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(i, f"Home | About\n{text(i)}\n  \nAll  rights RESERVED\nlast {i}", "en", "s", 0) for i in range(30)]
    rows += [(50, f"{text(50)}\n\nown line", "en", "s", 7), (51, f"home | about\n{text(51)}", "en", "other", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.quality_stage(spark, docs, "").collect()}
    for i in range(30):
        want = f"{text(i)}\n  \nlast {i}"
        assert got[i] == (want, len(want))
    assert got[50] == (rows[30][1], 7) and got[51] == (rows[31][1], 7)


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries()) == list(range(1, 14))
    assert set(oracle_sql()) <= set(queries()) and vocabulary()
