"""Contracts of the course operators on tiny tables."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions import values as V
from tessella.operators import aggregate, blocks, lines, metadata, scoring
from tessella.plans import evaluation
from tessella.sources import readers, sinks
from tessella.streaming import arrivals


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'int'}" for k, v in cols.items()))
    return df.select(expr.alias("x")).first().x


# ---- lines

WORD = "doc_id string, page_idx int, word_seq int, text string, x0 double, x1 double, top double, bottom double, doctop double, size double, fontname string, page_h double"


def words(spark, rows):
    return spark.createDataFrame([("d", 0, i, t, x, x + 5.0, y, y + 10.0, y, s, f, 800.0) for i, (y, x, t, s, f) in enumerate(rows)], WORD)


def lined(spark, rows, **k):
    return [(r.text, r.max_size, r.is_code, r.is_bold) for r in lines.lines_from_words(words(spark, rows), **k).orderBy("y_key").collect()]


def test_words_become_lines(spark):
    assert lined(spark, []) == []
    assert [x[0] for x in lined(spark, [(100.0, 10.0, "Hello", 10.0, "Times"), (100.0, 50.0, "world", 10.0, "Times"), (120.0, 10.0, "Goodbye", 10.0, "Times")])] == ["Hello world", "Goodbye"]
    assert lined(spark, [(100.0, 80.0, "world", 18.0, "X-Bold"), (100.0, 10.0, "Hello", None, "CourierNew")]) == [("Hello world", 18.0, True, True)]
    assert lined(spark, [(100.0, 5.0, "(cid:32)", 10.0, None)]) == [("[?]", 10.0, False, False)]
    assert [x[0] for x in lined(spark, [(100.0, 5.0, "3", 20.0, "T"), (100.0, 50.0, "Introduction", 12.0, "T"), (200.0, 5.0, "4", 20.0, "T")], threshold=F.lit(14.0))] == ["Introduction"]
    assert [x[0] for x in lined(spark, [(101.0, 5.0, "a", 9.0, "T"), (99.0, 9.0, "b", 9.0, "T")])] == ["a b"]  # halves go to even: 50.5 and 49.5 to 50


def test_median_is_the_upper_one(spark):
    df = words(spark, [(100.0, float(i), "w", s, "T") for i, s in enumerate([1.0, 2.0, 3.0, 9.0])])
    assert lines.median_sizes(df).first().median == 3.0


def test_code_marks_tables_and_headers(spark):
    rows = spark.createDataFrame([("d", 0, float(i), t, c) for i, (t, c) in enumerate([("a", False), ("b", True), ("c", True), ("12", False), ("d", True)])], "doc_id string, page_idx int, y_key double, text string, is_code boolean")
    assert lines.page_text(lines.with_code_marks(rows)).first().text == "a\n[CODE]\nb\nc\n[/CODE]\n[CODE]\nd\n[/CODE]"
    heads = spark.createDataFrame([("d", i, t, h) for i, (t, h) in enumerate([("x", False), ("H1", True), ("H2", True), ("y", False), ("z", False)])], "doc_id string, ord int, text string, is_header boolean")
    assert [(r.block_idx, r.heading, r.text) for r in lines.header_blocks(heads).orderBy("block_idx").collect()] == [(0, None, "x"), (1, "H2", "y\nz")]


# ---- blocks

BLOCK = "doc_id string, block_idx int, heading string, text string"


def merge(spark, rows, limit):
    df = spark.createDataFrame([("d", i, h, t) for i, (h, t) in enumerate(rows)], BLOCK)
    return [(r.heading, r.text) for r in blocks.merge_blocks(df, limit).orderBy("block_idx").collect()]


def test_merging(spark):
    assert merge(spark, [("Ch1", "a b c"), ("Ch2", "d e f")], 5) == [("Ch1", "a b c"), ("Ch2", "d e f")]
    assert merge(spark, [("A", "a b"), ("B", "c d"), ("C", " ".join("x" * 20))], 5) == [("A", "a b\n\nc d"), ("C", " ".join("x" * 20))]
    assert merge(spark, [(None, "a"), ("Data Types", "b")], 500) == [("Data Types", "a\n\nb")]
    assert merge(spark, [("A", "a"), ("Chapter 2", "b"), ("X", "Unit 3 begins")], 500) == [("A", "a"), ("Chapter 2", "b"), ("X", "Unit 3 begins")]
    assert merge(spark, [("A", "a")], 5) == [("A", "a")] and merge(spark, [], 5) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.booleans()), max_size=14), st.integers(3, 20))
def test_merging_equals_the_plain_loop(rows, limit):
    texts = [(f"h{i}" if i % 2 else None, " ".join([f"w{i}"] * n)) for i, (n, _) in enumerate(rows)]
    barred = [b for _, b in rows]
    plain = [[h, t, b] for (h, t), b in zip(texts, barred, strict=True)]
    while True:
        able = [(len(plain[i][1].split()) + len(plain[i + 1][1].split()), i) for i in range(len(plain) - 1) if not plain[i + 1][2]]
        able = [x for x in able if x[0] < limit]
        if not able:
            break
        i = min(able)[1]
        plain[i : i + 2] = [[plain[i][0] or plain[i + 1][0], plain[i][1] + "\n\n" + plain[i + 1][1], plain[i][2]]]
    assert blocks.merged(texts, limit, barred) == [(h, t) for h, t, _ in plain]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["w", "end.", "x\n\n", "y\n", "stop!"]), max_size=80), st.integers(2, 12))
def test_chunks_keep_all_words_within_the_limit(parts, limit):
    text = " ".join(parts)
    got = blocks.chunks_of(text, limit)
    assert [w for c in got for w in c.split()] == text.split() and all(len(c.split()) <= limit for c in got)


def test_chunks_of_known_texts():
    assert blocks.chunks_of("short text", 5) == ["short text"]
    assert len(blocks.chunks_of("One two three four five. Six seven eight nine ten.", 5)) == 2
    assert [len(c.split()) for c in blocks.chunks_of(" ".join("w" * 50), 10)] == [10] * 5
    assert len(blocks.chunks_of("\n\n".join([" ".join("w" * 50)] * 10), 100)) >= 2


def test_chapters_units_and_ranges(spark):
    toc = spark.createDataFrame([("d", 0, "1", "Getting Started"), ("d", 1, "2", "Missing Words Here"), ("d", 2, "3", "Control Flow")], "doc_id string, ord int, number string, title string")
    heads = spark.createDataFrame([("d", 0, "contents getting started", True), ("d", 1, "chapter 1 getting started", False), ("d", 2, "getting started again", False), ("d", 3, "3 control flow", False)], "doc_id string, page_idx int, head string, is_contents boolean")
    assert [(r.ord, r.start) for r in blocks.locate_chapters(toc, heads).orderBy("ord").collect()] == [(0, 1), (2, 3)]
    pages = spark.createDataFrame([("d", i, t) for i, t in enumerate(["cover", "UNIT - I\nFirst topic", "more", "Unit 2\n", "UNIT II again"])] + [("e", 0, "UNIT I")], "doc_id string, page_idx int, text string")
    starts = blocks.unit_starts(pages)
    assert [(r.doc_id, r.heading, r.start) for r in starts.orderBy("start").collect()] == [("d", "Unit 1: First topic", 1), ("d", "Unit 2", 3)]
    counts = pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("pages"))
    got = blocks.range_blocks(blocks.page_ranges(starts, counts), pages).orderBy("block_idx").collect()
    assert [(r.heading, r.text.split("\n")[0]) for r in got] == [("Frontmatter", "cover"), ("Unit 1: First topic", "UNIT - I"), ("Unit 2", "Unit 2")]


# ---- classification

TABLE_ROWS = "\n[TABLE:\na | b\n]"
CASES = [
    ("Introduction to Python", "Prose of it.", True, "instructional"),
    ("Acknowledgments", "Thanks.", True, "frontmatter"),
    ("Dedication", "To all.", True, "frontmatter"),
    ("Preface", "x", True, "preface"),
    ("About this book", "x", True, "preface"),
    ("Introduction", "x", True, "preface"),
    ("Preface", "x", False, "frontmatter"),
    ("Table of Contents", "Chapter 1 ... 3", True, "reference_table"),
    (None, "Table of Contents\nChapter 1 ... 3", True, "frontmatter"),
    ("Solution", "x", True, "solution"),
    ("Answer to Exercise 1", "x", True, "solution"),
    ("Exercise 3", "prose", True, "exercise"),
    ("1. Built-in functions", "prose", True, "instructional"),
    ("Exercises", "Practice 1 a\nExercise 2 b\nQ3. c\nQ4. d", True, "exercise"),
    ("Appendix A", "x", True, "reference_table"),
    ("Access. The future of education.", "prose of a chapter", True, "instructional"),
    ("Key Terms", "x", True, "glossary"),
    ("Glossary", "x", True, "glossary"),
    ("Chapter Summary", "- a", True, "summary"),
    (None, "1. What?\na. x\nb. y\nc. z\nd. w\n2. Why?\na. x\nb. y\nc. z\nd. w", True, "assessment"),
    (None, "1. What?\na. x\nb. y", True, "instructional"),
    (None, "Prose line." + TABLE_ROWS * 10, True, "reference_table"),
    (None, "p" * 400 + TABLE_ROWS * 5, True, "instructional"),
    (None, "Creative Commons. All rights reserved. ISBN 1. Published by us.", True, "frontmatter"),
    ("frontmatter", "Welcome to this book, and more.", True, "preface"),
    (None, "This college is an autonomous institution.", True, "frontmatter"),
    (None, "A term: means x\n" * 2 + "Other Term: means y\nThird Term — is z\nMore Words: are w\n", True, "glossary"),
]


@pytest.mark.parametrize("heading,text,before,kind", CASES)
def test_classification(spark, heading, text, before, kind):
    assert one(spark, T.segment_type("h", "t", F.lit(before)), h=heading, t=text) == kind


def test_text_functions(spark):
    assert one(spark, T.word_count("t"), t=None) == 0 and one(spark, T.word_count("t"), t=" a b\n") == 2
    assert one(spark, T.roman("t"), t="xiv") == 14 and one(spark, T.roman("t"), t="iix") is not None and one(spark, T.roman("t"), t="q") is None
    assert one(spark, T.whole_number("t"), t="7.0") == 7 and one(spark, T.whole_number("t"), t="7.5") is None and one(spark, T.whole_number("t"), t="x") is None
    assert one(spark, T.prose_density("t"), t="") == 0.0
    assert one(spark, T.without_fence("t"), t="```json\n{}\n```") == "{}"
    assert one(spark, T.real_author("t"), t="Windows User") == "" and one(spark, T.real_author("t"), t="Ann Lee") == "Ann Lee"
    assert one(spark, T.first_match("t", V.SUBJECTS), t="A course in Data Science, by x") == "Data Science"




# ---- scoring and gates


def scored(spark, rows):
    """(type, scores, text, incomplete) in one course."""
    dims = ",".join(f"{d}:int" for d in V.MODULE_DIMS)
    why = ",".join(f"{d}_rationale:string" for d in V.MODULE_DIMS)
    data = [("d", i, None, t, kind, tuple([s] * 5), tuple([f"why {i}"] * 5), f"summary {i}", inc) for i, (kind, s, t, inc) in enumerate(rows, 1)]
    return spark.createDataFrame(data, f"doc_id string, segment_id int, heading string, text string, segment_type string, scores struct<{dims}>, reasoning struct<{why}>, summary string, incomplete boolean")


def gate(spark, rows):
    return aggregate.module_gate(scored(spark, rows)).first()


def test_gates(spark):
    assert gate(spark, [("instructional", 9, "x" * 10, False), ("instructional", 3, "x" * 20, False)]).goal_focus == 5.0
    g = gate(spark, [("instructional", 8, "x", False), ("exercise", 2, "x" * 99, False)])
    assert (g.overall_score, g.scored_segments, g.excluded_segments, g.total_segments, g.excluded_types) == (8.0, 1, 1, 2, ["exercise"])
    assert gate(spark, [("instructional", 10, "x", False), ("instructional", 0, "x", True)]).overall_score == 10.0
    assert gate(spark, [("instructional", 0, "x", True)]).overall_score == 0.0
    assert gate(spark, [("instructional", 4, "", False), ("instructional", 6, "", False)]).overall_score == 5.0


def test_digests_and_ranks(spark):
    ev = scored(spark, [("instructional", s, "text", False) for s in (5, 2, 9)])
    assert {r.digest for r in aggregate.rationale_digests(ev).collect()} == {"Across 3 segment(s) (scores 2–9/10): | Weakest: why 2 | Typical: why 1 | Strongest: why 3"}
    c = aggregate.course_digest(ev).first()
    assert (c.mean, c.weakest_id, c.strongest_ids) == ("5.3", 2, [3, 1, 2])


def test_responses_in_all_their_shapes(spark):
    ok = ", ".join(f'"{d}": 7' for d in V.MODULE_DIMS)
    e = lambda i, first="7", more="": f'{{"segment_id": {i}, "scores": {{{ok.replace("7", first, 1)}}}{more}}}'
    raws = [f"[{e(1)}]", f'{{"evaluations": [{e(2)}]}}', f'```json\n{{"submit_module_evaluations": {{"evaluations": [{e(3)}]}}}}\n```', f'{{"items": [{e(4)}, {e(4, "3")}]}}', e(5), f'{{"other": [{e(6)}]}}', "nonsense", f'[{e(7, chr(34) + "7.5" + chr(34))}]', f'[{e(8, chr(34) + "7" + chr(34))}]']
    parsed = scoring.parse_responses(spark.createDataFrame([("d", i, r) for i, r in enumerate(raws)], "doc_id string, ord int, raw string"))
    segments = spark.createDataFrame([("d", i, None, "t", "instructional" if i < 10 else "exercise") for i in range(1, 11)], "doc_id string, segment_id int, heading string, text string, segment_type string")
    got = {r.segment_id: (r.scores.goal_focus, r.incomplete) for r in scoring.match_responses(segments, parsed).collect()}
    assert got == {1: (7, False), 2: (7, False), 3: (7, False), 4: (3, False), 5: (7, False), 6: (7, False), 7: (0, True), 8: (7, False), 9: (0, True), 10: (0, False)}


def test_retries():
    calls, waits = [], []

    def call(p):
        calls.append(p)
        if len(calls) < 3:
            raise RuntimeError("503 overloaded")
        return "ok"

    assert scoring.call_with_retry(call, "p", sleep=waits.append) == "ok" and waits == [5.0, 10.0]
    with pytest.raises(RuntimeError):
        scoring.call_with_retry(lambda p: (_ for _ in ()).throw(RuntimeError("denied")), "p", sleep=waits.append)


def test_failed_batches_give_an_error(spark):
    prompts = spark.createDataFrame([("d", 0, "good"), ("d", 1, "bad")], "doc_id string, batch int, prompt string")
    got = scoring.score_prompts(prompts, lambda p: "[]" if p == "good" else 1 / 0).collect()
    assert [tuple(r)[1:] for r in got] == [(0, "[]", None), (1, None, "ZeroDivisionError: division by zero")]


def test_response_contract_and_prompts(spark):
    schema = scoring.response_schema()
    assert schema["properties"]["scores"]["required"] == list(V.MODULE_DIMS)
    rubric = spark.createDataFrame([("module", 0, "a", "A", "d", 1.0, ["c"], ["q"], [("low", "1-3")])], "gate string, ord int, id string, name string, description string, weight double, criteria array<string>, questions array<string>, guide array<struct<band:string,text:string>>")
    assert scoring.rubric_text(rubric).first().text == "### A (`a`), weight 1.0\nd\n\nCriteria, 0 to 2 each:\n  C1: c\n\nScoring guide:\n  - low: 1-3\n\nQuestions to answer first:\n  1. q"


def test_similar_summaries_and_partial_courses(spark):
    ev = scored(spark, [("instructional", 5, "t", False)] * 3).withColumn("summary", F.element_at(F.array(F.lit("a b c d e"), F.lit("A b c d x"), F.lit("q w e r t")), F.col("segment_id")))
    assert [(r.i, r.j) for r in aggregate.similar_pairs(ev).collect()] == [(1, 2)]
    seg = spark.createDataFrame([("p", None, "body", "instructional"), ("q", "Chapter 1", "body", "instructional"), ("r", None, "Preface", "exercise")], "doc_id string, heading string, text string, segment_type string")
    assert {r.doc_id: r.partial for r in aggregate.partial_courses(seg).collect()} == {"p": True, "q": False, "r": False}


# ---- sources, sinks, the whole


def test_metadata_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"title": "T", "level": "Undergraduate Introductory", "author": "one two three four five six seven", "prerequisites": ["old"], "toc": [{"title": "One", "page_number": 3}]}')
    (tmp_path / "b.txt").write_text("Title: First: part\nLearning outcomes stated: x, , y\ntitle: Last")
    (tmp_path / "c.json").write_text("not json")
    rows = {r.doc_id: r for r in readers.json_metadata(spark, f"{tmp_path}/*.json").collect()}
    assert (rows["a"].title, rows["a"].level, rows["a"].author, rows["a"].source, rows["a"].toc[0].page_number) == ("T", "undergraduate_introductory", "", "a.json", 3)
    assert rows["c"].title == "" and rows["c"].source == "c.json"
    text = readers.text_metadata(spark, f"{tmp_path}/*.txt")
    assert (text.first().title, text.first().learning_outcomes_stated) == ("Last", ["x", "y"])
    fetched = readers.url_metadata(spark, "u", "http://x", lambda u: '{"title": "Net"}')
    assert fetched.first().title == "Net" and readers.url_metadata(spark, "u", "http://x", lambda u: "<html>").first().source == "http://x"
    assert readers.url_metadata(spark, "u", "http://x", lambda u: 1 / 0).first().source == "u.pdf"
    both = readers.by_precedence([text, fetched.withColumn("doc_id", F.lit("b")), fetched])
    assert {r.doc_id: r.title for r in both.collect()} == {"b": "Last", "u": "Net"}
    assert metadata.summary(text).filter("label = 'title'").first().value == "Last"


def test_rubrics_and_files(spark, tmp_path):
    (tmp_path / "r.yaml").write_text("module_rubrics:\n  - id: a\n    name: A\n    criteria: [x]\n    scoring_guide: {low: l, top: t}\n")
    r = readers.rubrics(spark, str(tmp_path / "r.yaml")).first()
    assert (r.gate, r.id, [g.band for g in r.guide]) == ("module", "a", ["low", "top"])
    for n in ("one.pdf", "two.pdf", "no.txt"):
        (tmp_path / n).write_bytes(b"x" if n == "one.pdf" else b"bad")
    files = readers.course_files(spark, str(tmp_path))

    def reader(content):
        if content == b"bad":
            raise OSError
        yield (0, 0, "word", 1.0, 2.0, 3.0, 4.0, 3.0, 10.0, "T", 800.0)

    assert sorted((r.doc_id, r.text, r.error) for r in readers.words_of(files, reader).collect()) == [("one", "word", None), ("two", None, "OSError: ")]


def test_recognised_text_only_for_bare_pages(spark):
    w = words(spark, [(100.0, 1.0, "w", 9.0, "T")])
    pages = spark.createDataFrame([("d", 0), ("d", 1)], "doc_id string, page_idx int")
    ocr = spark.createDataFrame([("d", 0, "skip"), ("d", 1, "line\n 12 \n\nmore")], "doc_id string, page_idx int, text string")
    assert sorted(r.line for r in readers.with_ocr(w, pages, ocr).collect()) == ["line", "more"]


def test_whole_evaluation(spark, tmp_path):
    rows = [("d", 0, "Preface", "Welcome."), ("d", 1, "Chapter 1", "Words of the first."), ("d", 2, "Chapter 2", "Words of the second.")]
    ok = ", ".join(f'"{d}": 6' for d in V.MODULE_DIMS)
    responses = spark.createDataFrame([("d", 0, f'[{{"segment_id": 2, "scores": {{{ok}}}, "summary": "s"}}]')], "doc_id string, ord int, raw string")
    course = spark.createDataFrame([("d", (9, 5, 7, 8, 7), ("a",) * 5, 7.25)], "doc_id string, scores struct<" + ",".join(f"{d}:int" for d in V.COURSE_DIMS) + ">, reasoning struct<" + ",".join(f"{d}_rationale:string" for d in V.COURSE_DIMS) + ">, overall_score double")
    meta = metadata.conformed(spark.createDataFrame([("d", "T")], "doc_id string, title string"))
    docs = evaluation.evaluate(spark.createDataFrame(rows, BLOCK), meta, responses, course, max_words=6)
    d = docs.first().document
    assert (d.assessment.module_gate.overall_score, d.assessment.course_gate.overall_score) == (6.0, 7.25)
    assert d.assessment.course_gate.rubrics["prerequisite_alignment"].score == 9.0
    assert [s.segment_type for s in d.segments] == ["preface", "instructional", "instructional"] and [s.incomplete for s in d.segments] == [False, False, True]
    assert (d.evaluation_meta.total_segments, d.evaluation_meta.instructional_segments_scored) == (3, 1)
    assert sinks.as_json(docs).first().name == "course_evaluation_evaluation.json"
    sinks.write_json(docs, str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["course_evaluation_evaluation.json"]


def test_arrivals_are_segmented_once(spark, tmp_path):
    inbox, outbox, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for i in range(2):
        spark.createDataFrame([(f"d{i}", 0, "Chapter 1", "Words.")], BLOCK).coalesce(1).write.mode("append").parquet(inbox)
        arrivals.segment_arrivals(spark, inbox, outbox, state).awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(outbox).collect()) == ["d0", "d1"]


def test_partitioning_changes_nothing(spark):
    rng = random.Random(1)
    rows = [(f"d{d}", i, rng.choice([None, "Chapter 3", "Notes"]), " ".join(["w"] * rng.randrange(1, 60))) for d in range(6) for i in range(12)]
    df = spark.createDataFrame(rows, BLOCK)
    got = [sorted(map(tuple, blocks.segment_documents(df.repartition(n), 50).collect()), key=str) for n in (1, 7)]
    assert got[0] == got[1] and all(re.search(r"\w", r[3]) for r in got[0])


def test_course_and_metadata_prompts(spark):
    ev = scored(spark, [("instructional", 5, "first text", False), ("instructional", 2, "second text", False), ("preface", 0, "y" * 5000, False)])
    got = aggregate.course_prompts(ev, ev.select("doc_id", "segment_id", "heading", "text", "segment_type")).first().prompt
    assert "Module 1: summary 1 [goal_focus=5" in got and "## Weakest module\n2 (untitled), avg 2.0\nsecond text" in got and "goal_focus: why 2" in got and "[... truncated for brevity ...]" in got and "part of a larger course" in got
    assert {r.segment_type: r.segments for r in aggregate.run_metrics(ev).collect()} == {"instructional": 2, "preface": 1}
    rows = spark.createDataFrame([("d", "c" * 7000, "r" * 20000)], "doc_id string, cover string, raw string")
    prompt = metadata.prompts(rows, "rules")
    assert len(prompt.first().prompt) == len("rules\n\nCOVER:\n\n\nTEXT:\n") + 6000 + 15000

    def broken(p):
        raise OSError("down")

    assert [r.raw for r in metadata.enriched(prompt, [broken, lambda p: '{"title": "x"}'], wait=0.0).collect()] == ['{"title": "x"}']
    assert [(r.raw, r.error) for r in metadata.enriched(prompt, [broken], wait=0.0).collect()] == [(None, "OSError: down")]


def test_command_line(spark, tmp_path):
    from tessella import __main__ as cli

    spark.createDataFrame([("d", 0, "Chapter 1", "Words.")], BLOCK).write.parquet(str(tmp_path / "blocks.parquet"))
    spark.createDataFrame([], "doc_id string, ord int, raw string").write.parquet(str(tmp_path / "responses.parquet"))
    spark.createDataFrame([], "doc_id string, scores struct<" + ",".join(f"{d}:int" for d in V.COURSE_DIMS) + ">, reasoning struct<" + ",".join(f"{d}_rationale:string" for d in V.COURSE_DIMS) + ">, overall_score double").write.parquet(str(tmp_path / "course.parquet"))
    cli.main(["--input", str(tmp_path), "--output", str(tmp_path / "out")])
    assert '"incomplete": true' in (tmp_path / "out" / "d_evaluation.json").read_text()


def test_documents_over_several_batches_merge_without_a_frame_each(spark):
    from tessella.operators import blocks as B

    rows = [(d, i, f"Chapter {i}" if i % 4 == 0 else None, " ".join(["w"] * (i + 1))) for d in [None, 1, 2, 3] for i in range(7)]
    df = spark.createDataFrame(rows, "doc_id long, block_idx int, heading string, text string").repartition(3)
    want = sorted((d is not None, d or 0, i, h, t) for d in [None, 1, 2, 3] for i, (h, t) in enumerate(B.merged([r[2:] for r in rows if r[0] == d], 9, [i % 4 == 0 and i > 0 for i in range(7)])))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "3")
    try:
        merged = B.merge_blocks(df, 9)
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.block_idx, r.heading, r.text) for r in merged.collect()) == want
    finally:
        spark.conf.set(size, before)
    assert "InPandas" not in merged._jdf.queryExecution().toString()
