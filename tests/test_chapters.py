"""Printed contents, chapters on their pages, and the cascade from words to blocks, each against plain Python."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.functions import values as V
from tessella.operators import blocks as B
from tessella.operators import lines as L
from tessella.plans import cascade, evaluation

PAGES = "doc_id string, page_idx int, text string"
TOC = "doc_id string, ord int, number string, title string"
WORD = "doc_id string, page_idx int, word_seq int, text string, x0 double, x1 double, top double, bottom double, doctop double, size double, fontname string, page_h double"
OUTLINE = "doc_id string, ord int, title string, page_idx int"


def entries(spark, pages):
    df = spark.createDataFrame([("d", i, t) for i, t in pages], PAGES)
    return [(r.ord, r.number, r.title, r.page_number) for r in B.contents_entries(df).orderBy("ord").collect()]


def test_printed_contents(spark):
    one, two = "1. First Steps ..... 3\n1.1 Detail ..... 4\nPart II Second Part .... 9", "Chapter 3 Third   12\n\nAppendix .... xiv"
    first = [(0, "1", "First Steps", 3), (1, "Part II", "Second Part", 9)]
    more = [(2, "Chapter 3", "Third", 12), (3, None, "Appendix", 14)]
    assert entries(spark, [(0, "cover"), (1, "\nTable of Contents\n" + one), (2, two), (3, "plain"), (4, one)]) == first + more
    assert entries(spark, [(0, "x\ny\nINDEX\n"), (1, "nothing yet"), (2, one), (3, two), (4, one)]) == first + more  # four pages from the heading on
    assert entries(spark, [(1, "Contents\n" + one), (3, two)]) == first  # a page that is missing ends them
    assert entries(spark, [(0, one), (1, None), (2, "")]) == [] and entries(spark, [(15, "Contents\n" + one)]) == []
    assert entries(spark, [(0, "a\nb\nc\nd\ne\nContents\n" + one)]) == []  # not among the first five lines
    assert entries(spark, [(0, "Contents\n" + one), (1, two), (2, "plain"), (3, "Contents\n" + one)]) == first + more  # a second list isn't read


def plain_location(toc, pages):
    """The rules one by one: pages (page, head, is_contents) in order, toc (ord, number, title)."""
    titled = [e for e in sorted(toc, key=lambda e: e[0]) if e[2]]
    if len(titled) < 2:
        return []
    cursor, found = max((p + 1 for p, _, c in pages if c), default=0), []
    for order, number, title in titled:
        words = [w for w in title.lower().split() if len(w) > 2][:3]
        number = (number or "").strip()
        for page, head, contents in sorted(pages):
            if page < cursor or contents or not head.strip() or (words and sum(w in head for w in words) < min(2, len(words))):
                continue
            if number and not (re.match(rf"\s*chapter\s+{re.escape(number)}\b", head, re.I) or re.match(rf"\s*{re.escape(number)}\s+\S", head, re.I)):
                continue
            if not number and not words:
                continue
            found.append((order, f"Chapter {number}: {title}" if number else title, page))
            cursor = page + 1
            break
    return found if len(found) > 1 else []


def test_chapters_are_found_by_their_own_numbers(spark):
    rng = random.Random(7)
    words = ["sorting", "graph", "of", "search", "methods", "a", "tree", "c++", "intro"]
    toc, heads = [], []
    for doc in range(150):
        numbers = rng.choice([["0", "1", "2", "3"], ["3", "5", None, "9"], [None] * 4, ["I", "II", "IV", ""], ["1.", "2", "2", "A"]])
        titles = [" ".join(rng.choices(words, k=rng.randrange(0, 5))) for _ in numbers]
        toc += [(f"d{doc}", i, n, t.title() if rng.random() < 0.5 else t) for i, (n, t) in enumerate(zip(numbers, titles, strict=True))]
        for page in range(rng.randrange(0, 14)):
            k = rng.randrange(len(numbers))
            opening = rng.choice(["", "chapter {n} ", "Chapter  {n}: ", "{n} ", "74 chapter {n}. ", "  {n}\n", "{n}", "chapter {n}x "]).format(n=numbers[k] or "1")
            heads.append((f"d{doc}", page, (opening + titles[k] + rng.choice(["", " more", "\n"])).lower(), rng.random() < 0.1))
    got = {}
    for r in B.locate_chapters(spark.createDataFrame(toc, TOC).repartition(3), spark.createDataFrame(heads, "doc_id string, page_idx int, head string, is_contents boolean")).collect():
        got.setdefault(r.doc_id, []).append((r.ord, r.heading, r.start))
    want = {}
    for doc in {t[0] for t in toc}:
        found = plain_location([t[1:] for t in toc if t[0] == doc], [h[1:] for h in heads if h[0] == doc])
        if found:
            want[doc] = found
    assert len(want) > 20 and {d: sorted(x) for d, x in got.items()} == want


def test_location_of_odd_entries(spark):
    heads = spark.createDataFrame([("d", 0, "chapter 0 introduction to sorting", False), ("d", 1, "chapter 1 graph search methods", None), ("d", 2, None, False), ("e", 0, "x", False)], "doc_id string, page_idx int, head string, is_contents boolean")
    toc = spark.createDataFrame([("d", 0, "0", "Introduction to Sorting"), ("d", 1, "1", "Graph Search Methods"), ("d", 2, None, None), ("d", 3, None, "a b"), ("e", 0, "1", "x"), ("f", 0, "1", "y"), ("f", 1, "2", "z")], TOC)
    assert [tuple(r) for r in B.locate_chapters(toc, heads).orderBy("ord").collect()] == [("d", 0, "Chapter 0: Introduction to Sorting", 0), ("d", 1, "Chapter 1: Graph Search Methods", 1)]
    assert B.locate_chapters(toc.filter("false"), heads).count() == 0 and B.locate_chapters(toc, heads.filter("false")).count() == 0


def test_unit_titles_stand_on_the_same_line_or_the_next(spark):
    pages = spark.createDataFrame([("d", i, t) for i, t in enumerate(["UNIT I: Intro\nmore", "Unit – 2\n  Second one \nx", "unit III", "x" * 199 + "UNIT 4"])], PAGES)
    assert [(r.heading, r.start) for r in B.unit_starts(pages).orderBy("start").collect()] == [("Unit 1: Intro", 0), ("Unit 2: Second one", 1), ("Unit 3", 2)]


def words_of(doc, pages):
    """Pages of lines (y, text, size, font)."""
    return [(doc, p, n, w, 10.0 * n, 10.0 * n + 8, y, y + 10, y, s, f, 800.0) for p, lines in enumerate(pages) for y, text, s, f in lines for n, w in enumerate(text.split())]


def line(text, y=200.0, size=10.0, font="Times"):
    return (y, text, size, font)


def test_each_document_is_settled_by_its_first_fitting_tier(spark, monkeypatch):
    body = lambda t: [line(t), line("more of it", 230.0)]
    head = lambda t: line(t, 20.0)
    rows = words_of("toc", [[head("Contents"), *body("cover text")], [head("Chapter 4 Sorting things"), *body("one")], body("two"), [head("5 Graph things"), *body("three")]])
    rows += words_of("outline", [body("front"), body("first"), body("second")])
    rows += words_of("far", [body("front"), body("first"), body("second"), [line("Big Header", size=30.0), line("under it", 230.0)]])
    rows += words_of("unit", [body("before"), [head("UNIT I Start"), *body("u one")], [head("UNIT II"), *body("u two")]])
    rows += words_of("plain", [[line("Strong words", font="Times-Bold"), line("text", 230.0)], [line("12", 200.0), line("tail", 230.0)]])
    words = spark.createDataFrame(rows, WORD)
    counts = words.groupBy("doc_id").agg((F.max("page_idx") + 1).alias("pages")).unionByName(spark.createDataFrame([("empty", 3)], "doc_id string, pages int"))
    toc = spark.createDataFrame([("toc", 0, "4", "Sorting things"), ("toc", 1, "5", "Graph things")] + [("far", i, str(i + 50), "Not there") for i in range(9)], TOC)
    outline = spark.createDataFrame([("outline", 0, " A ", 1), ("outline", 1, "B", 2), ("outline", 2, "B again", 2), ("outline", 3, "Z", 99), ("far", 0, "A", 0), ("far", 1, "B", 2), ("plain", 0, "Only", 0)], OUTLINE)
    read = []
    body_lines = cascade.body_lines
    monkeypatch.setattr(cascade, "body_lines", lambda words, *a, **k: read.append((k.get("in_place", False), sorted(r.doc_id for r in words.select("doc_id").distinct().collect()))) or body_lines(words, *a, **k))
    out = {}
    for r in cascade.course_blocks(words, counts, toc, outline).orderBy("doc_id", "block_idx").collect():
        out.setdefault(r.doc_id, []).append((r.tier, r.heading, r.text))
    assert out == {
        "toc": [(0, "Frontmatter", "cover text\nmore of it"), (0, "Chapter 4: Sorting things", "one\nmore of it\n\ntwo\nmore of it"), (0, "Chapter 5: Graph things", "three\nmore of it")],
        "outline": [(1, "A", "first\nmore of it"), (1, "B", "second\nmore of it")],
        "far": [(3, None, "\n".join(f"{x}\nmore of it" for x in ("front", "first", "second"))), (3, "Big Header", "under it")],
        "unit": [(2, "Frontmatter", "before\nmore of it"), (2, "Unit 1: Start", "u one\nmore of it"), (2, "Unit 2: u two", "u two\nmore of it")],  # a title may stand on the next line
        "plain": [(3, "Strong words", "text\ntail")],
    }
    assert read == [(False, ["toc"]), (False, ["far", "outline"]), (False, ["unit"]), (True, ["far", "plain"])]  # the last tier sees only what is left


def test_marks_of_figures_code_and_tables(spark):
    lines = [line("Prose", 100.0), line("x = 1", 120.0, font="CourierNew"), line("Fig. 1.2 A loop", 140.0), line("y = 2", 160.0, font="Mono"), line("End", 400.0), line("17", 420.0), line("in table", 300.0)]
    words = spark.createDataFrame(words_of("d", [lines, []]), WORD)
    tables = spark.createDataFrame([("d", 0, 0.0, 290.0, 700.0, 320.0, [["a", None], [None, None], [" b ", "c"]])], "doc_id string, page_idx int, x0 double, top double, x1 double, bottom double, cells array<array<string>>")
    ocr = spark.createDataFrame([("d", 0, "not read"), ("d", 1, "seen\n 3 \nagain")], PAGES)
    text = {r.page_idx: r.text for r in cascade.body_pages(cascade.body_lines(words, tables, ocr)).collect()}
    code = "[CODE]\nx = 1\n[FIGURE Fig. 1.2: A loop]\ny = 2\n[/CODE]"
    assert text == {0: f"[TABLE:\na | \nb | c\n]\nProse\n{code}\nEnd", 1: "seen\nagain"}
    text = {r.page_idx: r.text for r in cascade.body_pages(cascade.body_lines(words, tables, in_place=True)).collect()}
    assert text == {0: f"Prose\n{code}\n[TABLE:\na | \nb | c\n]\nEnd"}
    inside = spark.createDataFrame([("d", 0, 0.0, 150.0, 1.0, 151.0, [["t"]])], tables.schema)
    text = cascade.body_pages(cascade.body_lines(words, inside, in_place=True)).first().text  # a table ends a run of code
    assert "[CODE]\nx = 1\n[FIGURE Fig. 1.2: A loop]\n[/CODE]\n[TABLE:\nt\n]\n[CODE]\ny = 2\n[/CODE]" in text or "x = 1\n[/CODE]\n" in text


def test_median_counts_words_with_a_size_only(spark):
    rows = [("a", 0, i, "w", 0.0, 1.0, 0.0, 1.0, 0.0, s, "T", 800.0) for i, s in enumerate([None, None, None, 9.0, 11.0])] + [("b", 0, 0, "w", 0.0, 1.0, 0.0, 1.0, 0.0, None, "T", 800.0)]
    got = {r.doc_id: (r.median, r.threshold) for r in L.median_sizes(spark.createDataFrame(rows, WORD)).collect()}
    assert got == {"a": (11.0, 11.0 * V.HEADER_RATIO), "b": (10.0, 14.0)}


def test_cascade_of_nothing(spark):
    none = lambda s: spark.createDataFrame([], s)
    assert cascade.course_blocks(none(WORD), none("doc_id string, pages int"), none(TOC), none(OUTLINE)).count() == 0


@pytest.mark.parametrize("raw,page", [("iix", 10), ("xiv", 14), ("mcmxciv", 1994), ("23", 23), ("q", None), ("", None), (None, None)])
def test_roman_pages(spark, raw, page):
    from tessella.functions import text as T

    assert spark.createDataFrame([(raw,)], "t string").select(T.roman("t").alias("x")).first().x == page


def test_words_are_read_once_and_joined_in_place(spark):
    """The cascade used to compute and shuffle all words again in each tier."""
    seen = spark.sparkContext.accumulator(0)

    def through(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [r for d in range(12) for r in words_of(f"d{d}", [[line("UNIT I Start", 20.0), line(f"one {d}")], [line("UNIT II", 20.0), line("two")]][: 1 + d % 2])]
    words = spark.createDataFrame(rows, WORD).repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        none = lambda s: spark.createDataFrame([], s)
        counts = spark.createDataFrame([(f"d{d}", 1 + d % 2) for d in range(12)], "doc_id string, pages int")
        out = cascade.course_blocks(words.mapInArrow(through, words.schema), counts, none(TOC), none(OUTLINE)).collect()
        odd = [x for d in range(1, 12, 2) for x in ((f"d{d}", 2, "Unit 1: Start", f"one {d}"), (f"d{d}", 2, "Unit 2: two", "two"))]
        even = [(f"d{d}", 3, None, f"one {d}") for d in range(0, 12, 2)]
        assert sorted(((r.doc_id, r.tier, r.heading, r.text) for r in out), key=str) == sorted(odd + even, key=str)
        assert seen.value == len(rows)
        with evaluation.clustered(words, "doc_id") as own:
            at = own.inputFiles()[0].removeprefix("file:")
            plan = own.join(counts.hint("shuffle_hash"), "doc_id").groupBy("doc_id", "page_idx").count()._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and own.count() == len(rows) and os.path.exists(at)  # the counts alone are dealt out
        assert not os.path.exists(at) and not [t for t in spark.catalog.listTables() if t.name.startswith("clustered_")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
