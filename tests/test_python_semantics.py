"""Rounding and title case, held against Python's own; the plans that must run a Python step once."""

import math
import random

from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions import values as V
from tessella.functions.numbers import py_round
from tessella.operators import blocks, scoring


def test_rounding_equals_python_on_hard_halves(spark):
    rng = random.Random(2)
    values = [2.675, 0.125, 0.375, 1.005, 2.5, 0.5, 1.5, -0.125, -2.675, 0.0, 7.0, 1e15, 123456.785, 0.285, 1.115]
    values += [k / 1000 for k in range(5, 10000, 10)] + [k / 8 for k in range(-50, 400)] + [rng.uniform(0, 10) for _ in range(500)]
    values += [math.nextafter(k / 1000, s) for k in range(5, 3000, 10) for s in (-1e9, 1e9)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*values, None])], "i int, x double")
    got = {r.i: (r.a, r.b) for r in df.select("i", py_round("x").alias("a"), py_round("x", 1).alias("b")).collect()}
    assert got[len(values)] == (None, None)
    assert all(got[i] == (round(v, 2), round(v, 1)) for i, v in enumerate(values))


def test_title_case_equals_python(spark):
    texts = ["PYTHON'S 3D GUIDE", "ÉCOLE D'ÉTÉ", "THINK OS: A BRIEF INTRODUCTION", "A", "1ST EDITION", "Mixed Case stays", "ÄÖÜ-ß"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.u for r in df.select("t", T.py_title("t").alias("u")).collect()} == {t: t.title() for t in texts if "ß" not in t} | {"ÄÖÜ-ß": "Äöü-SS"}
    title = df.select("t", T.first_match(F.concat(F.lit("Title: "), F.col("t")), (V.TITLES[0],)).alias("u")).collect()
    assert {r.u for r in title if r.t == "THINK OS: A BRIEF INTRODUCTION"} == {"Think Os: A Brief Introduction"}


def test_segments_run_one_python_step(spark):
    df = spark.createDataFrame([("a", 0, "Chapter 1", "x y z"), ("a", 1, None, "w " * 30), ("b", 0, None, None)], "doc_id string, block_idx int, heading string, text string")
    out = blocks.segment_documents(df, 10)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1 and "MapInPandas" not in plan.replace("FlatMapGroupsInPandas", "")
    assert out.filter("doc_id = 'a'").count() == 4


def test_metadata_on_segments(spark):
    segments = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "doc_id string, segment_id int")
    rows = spark.createDataFrame([("a", "T", 1)], "doc_id string, title string, segment_id int")
    got = {(r.doc_id, r.segment_id): r.metadata and r.metadata.title for r in scoring.with_metadata(segments, rows).collect()}
    assert got == {("a", 1): "T", ("a", 2): "T", ("b", 1): None}


def test_a_named_source_is_read_by_its_kind(spark, tmp_path):
    from tessella.sources import readers

    (tmp_path / "m.json").write_text('{"title": "T"}')
    (tmp_path / "m.txt").write_text("Title: U\n")
    (tmp_path / "m.html").write_text("<p>")
    (tmp_path / "m.bin").write_text("x")
    pdf = lambda path: readers.html_metadata(spark, f"pdf:{path[-5:]}")

    def read(source, body=""):
        return readers.from_source(spark, "c", source, lambda url: body, pdf).first()

    assert (read(f"{tmp_path}/m.json").title, read(f"{tmp_path}/m.txt").title) == ("T", "U")
    assert read(f"{tmp_path}/m.html").source == "c.pdf" and read(f"{tmp_path}/m.bin").doc_id == "pdf:m.bin"
    assert read(f"{tmp_path}/none.json").doc_id == "c" and not read(f"{tmp_path}/none.json").title
    assert read("www.x.org/m", '{"title": "V"}').title == "V" and read("http://x.org/m", "<p>").source == "http://x.org/m"


def test_outlines_of_broken_files_say_why(spark):
    from tessella.operators import errors
    from tessella.sources import readers

    def reader(content):
        if content == b"bad":
            raise ValueError
        yield 1, "One", 3
        yield 2, "Two", 4

    files = spark.createDataFrame([("a", bytearray(b"ok")), ("b", bytearray(b"bad"))], "doc_id string, content binary")
    tagged = readers.outline_of(files, reader)
    assert [tuple(r) for r in errors.good(tagged).orderBy("ord").collect()] == [("a", 0, 1, "One", 3), ("a", 1, 2, "Two", 4)]
    assert [tuple(r) for r in errors.bad(tagged, "outline").collect()] == [("b", "outline", "ValueError: ")]
