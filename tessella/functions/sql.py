"""The scalar functions, and lines of words, as functions of plain SQL text.

register(spark) makes temporary functions of a session. They are expressions that the optimizer sees through, but for course_lines, a table
function that takes a table of words, dealt by page:

    SELECT * FROM course_lines(TABLE(words) PARTITION BY (doc_id, page_idx) ORDER BY (x0, word_seq))
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import arrow_udtf

from . import values as V

if TYPE_CHECKING:
    import pyarrow as pa


def text(pattern: str) -> str:
    """A raw SQL literal."""
    return f"r'{pattern}'" if "'" not in pattern else f'r"{pattern}"'


def count_of(words: tuple[str, ...], column: str) -> str:
    return " + ".join(f"CAST(contains({column}, {text(w)}) AS INT)" for w in words)


def anywhere(patterns: tuple[str, ...], column: str, form: str = "(?i){}") -> str:
    return " OR ".join(f"{column} RLIKE {text(form.format(p))}" for p in patterns)


SPLITTER = "134217729D"
#: A pattern that must match all of a text.
WHOLE = r"(?i)^(?:{})\z"
LINE_ENDS = r"r'\R|[\x1c-\x1e]'"
TABLES, CODE = r"r'(?s)\[TABLE:(.*?)\n\]'", r"r'(?s)\[CODE\].*?\[/CODE\]'"

# Expressions over SQL text, for functions that can't call each other inside a subquery or a lambda.


def word_count(t: str) -> str:
    return rf"CAST(regexp_count({t}, r'(?U)\S+') AS INT)"


def strip_text(t: str) -> str:
    return rf"regexp_replace({t}, r'(?U)^\s+|\s+$', '')"


def text_lines(t: str) -> str:
    return f"filter(transform(split({t}, {LINE_ENDS}), x -> {strip_text('x')}), x -> x <> '')"


def normal_heading(h: str) -> str:
    low = strip_text(f"lower(coalesce({h}, ''))")
    return f"CASE WHEN {low} IN ({', '.join(map(text, V.RUNNING_HEADERS))}) THEN '' ELSE {low} END"


def prose_density(t: str) -> str:
    plain = f"split(regexp_replace(regexp_replace({t}, {TABLES}, ''), {CODE}, ''), {LINE_ENDS})"
    rows = rf"flatten(transform(regexp_extract_all({t}, {TABLES}, 1), x -> split(x, r'\R')))"
    prose = f"filter({plain}, x -> {strip_text('x')} <> '' AND NOT x RLIKE {text(V.BULLET_LINE)})"
    wordy = "filter(" + rows + r", r -> " + word_count(r"regexp_replace(r, r'\s*\|\s*', ' ')") + " > 10)"
    return f"CASE WHEN {t} = '' THEN 0D ELSE (aggregate({prose}, 0, (n, x) -> n + length(x)) + aggregate({wordy}, 0, (n, x) -> n + length(x))) / length({t}) END"


def exercise_lines(xs: str) -> str:
    hit = f"NOT s.code AND x NOT IN ('[CODE]', '[/CODE]') AND x RLIKE {text(V.EXERCISE_LINE)}"
    step = f"named_struct('n', s.n + CAST({hit} AS INT), 'code', CASE x WHEN '[CODE]' THEN true WHEN '[/CODE]' THEN false ELSE s.code END)"
    return f"aggregate({xs}, named_struct('n', 0, 'code', false), (s, x) -> {step}, s -> s.n)"


def copyright_score(t: str) -> str:
    return f"CASE WHEN contains({t}, '©') THEN 2 ELSE 0 END + {count_of(V.COPYRIGHT_WORDS, f'lower({t})')}"


def py_round(x: str, digits: str) -> str:
    """2 * 10**digits * x without error, as a double and what it lacks, against the odd number between two results."""
    start = f"named_struct('x', {x}, 's', 2 * pow(10D, {digits}), 'p', {x} * (2 * pow(10D, {digits})))"
    halves = f"named_struct('x', a.x, 's', a.s, 'p', a.p, 'xh', a.x * {SPLITTER} - (a.x * {SPLITTER} - a.x), 'sh', a.s * {SPLITTER} - (a.s * {SPLITTER} - a.s), 'low', CAST(floor(a.p / 2) AS DOUBLE))"
    lacks = "((a.xh * a.sh - a.p) + a.xh * (a.s - a.sh) + (a.x - a.xh) * a.sh) + (a.x - a.xh) * (a.s - a.sh)"
    over = "a.p - a.low * 2 - 1"
    up = f"CASE WHEN {over} > 0 THEN 1 WHEN {over} < 0 THEN 0 WHEN {lacks} > 0 THEN 1 WHEN {lacks} < 0 THEN 0 ELSE pmod(a.low, 2D) END"
    return f"transform(transform(array({start}), a -> {halves}), a -> CASE WHEN abs(a.x) < 1e13D THEN (a.low + {up}) / (a.s / 2) ELSE a.x END)[0]"


def py_title(t: str) -> str:
    letters = f"split({t}, '')"
    return rf"array_join(transform({letters}, (x, i) -> CASE WHEN i > 0 AND get({letters}, i - 1) RLIKE r'[\p{{Lu}}\p{{Ll}}\p{{Lt}}]' THEN lower(x) ELSE upper(x) END), '')"


def segment_type(heading: str, t: str, before: str) -> str:
    """The ordered rules of classification; what they look at is computed once, in a subquery."""
    first = f"lower({strip_text('substring_index(a.body, chr(10), 1)')})"
    rules = (
        (f"a.h <> '' AND a.h RLIKE {text(V.PREFACE_HEADING)} AND a.before", "preface"),
        (f"a.h = 'frontmatter' AND a.before AND {count_of(V.PREFACE_PHRASES, 'a.low')} >= 2", "preface"),
        (f"a.h RLIKE {text(V.REFERENCE_HEADING)}", "reference_table"),
        (rf"regexp_count(a.t, r'\[TABLE:') >= 2 AND {prose_density('a.t')} <= {V.PROSE_LIMIT}D", "reference_table"),
        (f"a.h RLIKE {text(V.SOLUTION)} OR substring(a.body, 1, 60) RLIKE {text(V.SOLUTION)}", "solution"),
        (f"a.h RLIKE {text(V.EXERCISE_HEADING)} OR a.h RLIKE {text(V.EXERCISE_LINE)} OR (a.tasks >= 3 AND a.tasks >= 0.4D * size(a.xs))", "exercise"),
        (f"a.h RLIKE {text(V.GLOSSARY_HEADING)} OR regexp_count(a.t, {text(V.DEFINITION_LINE)}) >= 5", "glossary"),
        (f"a.h RLIKE {text(V.SUMMARY_HEADING)}", "summary"),
        (f"size(filter(a.xs, x -> x RLIKE {text(V.OPTION_LINE)})) >= 3 AND size(filter(a.xs, x -> x RLIKE {text(V.QUESTION_LINE)})) >= 2", "assessment"),
        (f"{anywhere(V.FRONT_PARTS, 'a.h')} OR {anywhere(V.FRONT_PARTS, first, WHOLE)}", "frontmatter"),
        (f"lower(substring(a.t, 1, 500)) RLIKE {text(V.INSTITUTION)}", "frontmatter"),
        (f"substring(a.t, 1, 2000) RLIKE {text(V.UNIT_WORD)} AND substring(a.t, 1, 2000) RLIKE {text(V.TEXTBOOK)}", "frontmatter"),
        (f"{copyright_score('a.t')} >= {V.COPYRIGHT_LIMIT}", "frontmatter"),
    )
    cases = " ".join(f"WHEN {rule} THEN '{kind}'" for rule, kind in rules)
    parts = rf"{normal_heading(heading)} AS h, {t} AS t, lower({t}) AS low, regexp_replace({t}, r'(?U)^\s+', '') AS body, {before} AS before, {text_lines(t)} AS xs, {exercise_lines(text_lines(t))} AS tasks"
    return f"SELECT CASE {cases} ELSE 'instructional' END FROM (SELECT {parts}) AS a"


OWN = "coalesce(t, '')"
#: Name with parameters, type, body.
FUNCTIONS = (
    ("word_count(t STRING)", "INT", word_count(OWN)),
    ("strip_text(t STRING)", "STRING", strip_text("t")),
    ("text_lines(t STRING)", "ARRAY<STRING>", text_lines(OWN)),
    ("py_round(x DOUBLE, digits INT)", "DOUBLE", py_round("x", "digits")),
    ("py_title(t STRING)", "STRING", py_title(OWN)),
    ("normal_heading(h STRING)", "STRING", normal_heading("h")),
    ("prose_density(t STRING)", "DOUBLE", prose_density(OWN)),
    ("copyright_score(t STRING)", "INT", copyright_score(OWN)),
    ("segment_type(heading STRING, t STRING, before_first_chapter BOOLEAN)", "STRING", segment_type("heading", OWN, "before_first_chapter")),
)


class CourseLines:
    """Words of a page, in order of x0, to its lines by baseline. They come as Arrow batches; a page's words are held until it ends."""

    def __init__(self) -> None:
        self.page, self.lines = None, {}

    def eval(self, words: pa.RecordBatch) -> Iterator[pa.Table]:
        if words.num_rows:
            self.page = words.slice(0, 1).select(["doc_id", "page_idx"])
        for doctop, text, size, font in zip(*(words.column(c).to_pylist() for c in ("doctop", "text", "size", "fontname")), strict=True):
            own = self.lines.setdefault(round(doctop / 2) * 2, ([], [], set()))
            own[0].append(text)
            own[1].append(size or 0.0)
            own[2].add(font or "")
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        import re

        import pyarrow as pa

        if not self.lines:
            return
        n, lines = len(self.lines), self.lines.values()
        has = lambda pattern: [any(re.search(pattern, f) for f in fonts) for _, _, fonts in lines]
        doc, page = (pa.array(self.page.column(c).to_pylist() * n, self.page.schema.field(c).type) for c in ("doc_id", "page_idx"))
        texts = [re.sub(V.CID, "[?]", " ".join(words)) for words, _, _ in lines]
        columns = [doc, page, pa.array(map(float, self.lines), pa.float64()), pa.array(texts, pa.string()), pa.array([max(sizes) for _, sizes, _ in lines], pa.float64()), pa.array(has(V.MONOSPACE), pa.bool_()), pa.array(has(V.HEAVY), pa.bool_())]
        yield pa.table(columns, names=["doc_id", "page_idx", "y_key", "text", "max_size", "is_code", "is_bold"])


LINES = "doc_id long, page_idx int, y_key double, text string, max_size double, is_code boolean, is_bold boolean"


def register(spark: SparkSession, doc_id: str = "long") -> None:
    """Makes the functions known to a session; `doc_id` is the type of that column in tables of words."""
    for head, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.udtf.register("course_lines", arrow_udtf(CourseLines, returnType=LINES.replace("doc_id long", f"doc_id {doc_id}")))
