"""The functions of plain SQL text against the column functions."""

import random

from pyspark.sql import functions as F

from tessella.functions import numbers
from tessella.functions import sql as Q
from tessella.functions import text as T
from tessella.operators import lines
from tests.test_operators import CASES, WORD


def test_scalar_functions(spark):
    Q.register(spark, "string")
    rng = random.Random(1)
    numbers_ = [2.675, 5.365, 0.125, 4.945, -2.5, 1e14, None] + [rng.random() * 10 for _ in range(200)] + [rng.randrange(1000) / 8 for _ in range(200)]
    texts = ["abc Def", "ÉCOLE d'été o'neil", None, "X1y", " a  b\n", "", "Access for free at", "x\n[TABLE:\na | b c\n]\n[CODE]\ny\n[/CODE]\n- z\nprose here ©"]
    df = spark.createDataFrame([(x, rng.choice(texts)) for x in numbers_], "x double, t string")
    df.createOrReplaceTempView("given_values")
    got = spark.sql("SELECT py_round(x, 2), py_round(x, 1), py_title(t), word_count(t), strip_text(t), text_lines(t), normal_heading(t), prose_density(t), copyright_score(t) FROM given_values")
    want = df.select(numbers.py_round("x", 2), numbers.py_round("x", 1), T.py_title("t"), T.word_count("t"), T.stripped("t"), T.lines_of("t"), T.normal_heading("t"), T.prose_density("t"), T.copyright_score("t"))
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]


def test_segment_types(spark):
    Q.register(spark, "string")
    spark.createDataFrame([*CASES, (None, None, True, "instructional"), ("", "", False, "instructional")], "heading string, body string, before boolean, kind string").createOrReplaceTempView("cases")
    assert spark.sql("SELECT * FROM cases WHERE segment_type(heading, body, before) <> kind").collect() == []


def test_lines_of_a_table_of_words(spark):
    Q.register(spark, "string")
    rng = random.Random(2)
    rows = [(f"d{d}", p, n, rng.choice(["word", "(cid:7)", "12"]), rng.random() * 500, 0.0, 0.0, 0.0, float(rng.randrange(90, 120)), rng.choice([None, 9.0, 14.5]), rng.choice([None, "CourierNew", "X-Bold", "T"]), 800.0) for d in range(3) for p in range(4) for n in range(rng.randrange(0, 40))]
    words = spark.createDataFrame(rows, WORD).repartition(4)
    words.createOrReplaceTempView("words")
    got = spark.sql("SELECT * FROM course_lines(TABLE(words) PARTITION BY (doc_id, page_idx) ORDER BY (x0, word_seq))")
    want = lines.lines_from_words(words).select("doc_id", "page_idx", F.col("y_key").cast("double").alias("y_key"), "text", "max_size", "is_code", "is_bold")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    spark.sql("SELECT * FROM words WHERE false").createOrReplaceTempView("no_words")
    assert spark.sql("SELECT * FROM course_lines(TABLE(no_words) PARTITION BY (doc_id, page_idx) ORDER BY (x0, word_seq))").count() == 0


def test_a_page_comes_in_several_arrow_batches():
    import pyarrow as pa

    page = {"doc_id": ["d"] * 5, "page_idx": pa.array([7] * 5, pa.int32()), "doctop": [100.0, 100.5, 130.0, 101.0, 130.0], "text": ["a", "(cid:3)", "c", "d", "e"], "size": [9.0, None, 8.0, 12.0, None], "fontname": [None, "X-Bold", "T", "T", "CourierNew"]}
    own = Q.CourseLines()
    for batch in pa.table(page).to_batches(max_chunksize=2):
        assert not list(own.eval(batch))
    (lines,) = own.terminate()
    assert [tuple(r.values()) for r in lines.to_pylist()] == [("d", 7, 100.0, "a [?] d", 12.0, False, True), ("d", 7, 130.0, "c e", 8.0, True, False)]
    assert lines.schema.field("page_idx").type == pa.int32() and not list(Q.CourseLines().terminate())
