"""Scalar text functions as column expressions. `wide` patterns treat all Unicode space as space."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import values as V


#: What ends a line.
LINE_ENDS = r"\R|[\x1c-\x1e]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_of(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def word_count(c: Column | str) -> Column:
    """Runs of non-space; 0 for null and empty."""
    return F.regexp_count(text_of(c), F.lit(r"(?U)\S+")).cast("int")


def stripped(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def lines_of(c: Column | str) -> Column:
    """Stripped lines that aren't blank."""
    return F.filter(F.transform(F.split(text_of(c), LINE_ENDS), stripped), lambda x: x != "")


def is_page_number(line: Column | str) -> Column:
    return stripped(line).rlike(r"(?U)^\d+\z") | (stripped(line) == "")


def without_cid(c: Column | str) -> Column:
    return F.regexp_replace(col(c), V.CID, "[?]")


def figure_caption(line: Column, is_code: Column, size: Column, threshold: Column) -> Column:
    """A figure's line as a marker; other lines as they are."""
    return F.when(line.rlike(V.FIGURE) & ~is_code & (size < threshold), F.regexp_replace(line, V.FIGURE, r"[FIGURE $1: $2]")).otherwise(line)


def table_text(cells: Column, tier: int = 1) -> Column:
    """A table of array<array<string>> as its marker, cut to a length inside it (tiers 0 to 2) or with the marker (tier 3)."""
    rows = F.filter(cells, lambda r: F.exists(r, lambda c: c.isNotNull()))
    body = F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(stripped(c), F.lit(""))), " | ")), "\n")
    if tier < 3:
        return F.when(body == "", "[TABLE]").otherwise(F.concat(F.lit("[TABLE:\n"), F.substring(body, 1, V.TABLE_CHARS), F.lit("\n]")))
    whole = F.concat(F.lit("[TABLE:\n"), body, F.lit("\n]"))
    cut = F.concat(F.substring(whole, 1, V.TABLE_CHARS), F.lit("\n...]"))
    return F.when(body == "", "[TABLE]").when(F.length(whole) > V.TABLE_CHARS, cut).otherwise(whole)


def prose_density(c: Column | str) -> Column:
    """Share of characters in prose lines, prose in tables included; 0 for empty."""
    text, table, code = text_of(c), r"(?s)\[TABLE:(.*?)\n\]", r"(?s)\[CODE\].*?\[/CODE\]"
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + F.length(x))
    rows = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(table), 1), lambda t: F.split(t, r"\R")))
    wordy = F.filter(rows, lambda r: word_count(F.regexp_replace(r, r"\s*\|\s*", " ")) > 10)
    plain = F.split(F.regexp_replace(F.regexp_replace(text, table, ""), code, ""), r"\R|[\x1c-\x1e]")
    prose = F.filter(plain, lambda x: (stripped(x) != "") & ~x.rlike(V.BULLET_LINE))
    return F.when(text == "", 0.0).otherwise((total(prose) + total(wordy)) / F.length(text))


def copyright_score(c: Column | str) -> Column:
    low = F.lower(text_of(c))
    return reduce(lambda n, w: n + F.contains(low, F.lit(w)).cast("int"), V.COPYRIGHT_WORDS, F.when(F.contains(low, F.lit("©")), 2).otherwise(0))


def definition_lines(c: Column | str) -> Column:
    return F.regexp_count(text_of(c), F.lit(V.DEFINITION_LINE))


def option_lines(lines: Column) -> Column:
    return F.size(F.filter(lines, lambda x: x.rlike(V.OPTION_LINE)))


def question_lines(lines: Column) -> Column:
    return F.size(F.filter(lines, lambda x: x.rlike(V.QUESTION_LINE)))


def exercise_lines(lines: Column) -> Column:
    """Lines outside code that look like an exercise; a code run that isn't closed hides the rest."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(False).alias("code"))

    def step(s: Column, x: Column) -> Column:
        hit = ~s["code"] & (x != "[CODE]") & (x != "[/CODE]") & x.rlike(V.EXERCISE_LINE)
        return F.struct((s["n"] + hit.cast("int")).alias("n"), F.when(x == "[CODE]", True).when(x == "[/CODE]", False).otherwise(s["code"]).alias("code"))

    return F.aggregate(lines, zero, step, lambda s: s["n"])


def normal_heading(c: Column | str) -> Column:
    low = stripped(F.lower(text_of(c)))
    return F.when(low.isin(*V.RUNNING_HEADERS), "").otherwise(low)


def py_title(c: Column | str) -> Column:
    """Title case as Python has it: a letter after anything but a letter is a capital, all others are small."""
    letters = F.split(text_of(c), "")
    cased = lambda x: F.coalesce(x.rlike(r"[\p{Lu}\p{Ll}\p{Lt}]"), F.lit(False))
    return F.array_join(F.transform(letters, lambda x, i: F.when((i > 0) & cased(F.get(letters, i - 1)), F.lower(x)).otherwise(F.upper(x))), "")


def first_group(c: Column | str, patterns: tuple[str, ...]) -> Column:
    """Group 1, stripped, of the first pattern that matches; null if none does."""
    found = F.lit(None).cast("string")
    for p in reversed(patterns):
        found = F.when(text_of(c).rlike(p), stripped(F.regexp_extract(text_of(c), p, 1))).otherwise(found)
    return found


def first_match(c: Column | str, patterns: tuple[str, ...]) -> Column:
    """Group 1 of the first pattern that matches, stripped, in title case if it is all capitals; '' if none does, or if nothing is left of it."""
    best = F.coalesce(F.regexp_replace(first_group(c, patterns), "[.,;:]+$", ""), F.lit(""))
    return F.when(best == F.upper(best), py_title(best)).otherwise(best)


def level(c: Column | str) -> Column:
    low = F.translate(F.lower(stripped(text_of(c))), " -", "__")
    return F.when(low.isin(*V.LEVELS), low).otherwise("")


def short_name(c: Column | str) -> Column:
    """'' for a name of over six words."""
    return F.when(word_count(c) > 6, "").otherwise(text_of(c))


def real_author(c: Column | str) -> Column:
    low = F.lower(text_of(c))
    bad = low.rlike(V.BAD_AUTHOR) | low.rlike(V.TOOL_AUTHOR) | ~F.contains(low, F.lit(" ")) | (word_count(c) > 6)
    return F.when(bad, "").otherwise(text_of(c))


def clean_title(c: Column | str) -> Column:
    t = stripped(F.regexp_replace(text_of(c), V.COURSE_CODE, " "))
    t = stripped(F.regexp_replace(stripped(F.regexp_replace(t, V.TITLE_LABEL, "")), r"\[\s*\]", ""))
    return F.when(F.length(t) >= 3, t).otherwise("")


def roman(c: Column | str) -> Column:
    """Page numbers: decimal digits pass through, in Roman ones a digit before a greater one is taken off, anything else is null."""
    low = F.lower(stripped(text_of(c)))
    digits = F.transform(F.reverse(F.split(low, "")), lambda x: reduce(lambda e, kv: F.when(x == kv[0], kv[1]).otherwise(e), V.ROMAN_DIGITS.items(), F.lit(0)))
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"))
    total = F.aggregate(digits, zero, lambda s, d: F.struct((s["sum"] + F.when(d < s["last"], -d).otherwise(d)).alias("sum"), d.alias("last")), lambda s: s["sum"])
    return F.when(low.rlike(r"^\d+$"), low.try_cast("int")).when(low.rlike("^[ivxlcdm]+$") & (total > 0), total)


def unit_number(c: Column | str) -> Column:
    """Roman numbers to ten and runs of decimal digits; null for anything else, be it a number with a sign, a point or spaces."""
    up = F.upper(col(c))
    digits = F.when(up.rlike(r"^[0-9]+\z"), up.try_cast("int"))
    return F.coalesce(reduce(lambda e, kv: F.when(up == kv[0], kv[1]).otherwise(e), V.ROMAN_UNITS.items(), F.lit(None).cast("int")), digits)


def isbn(c: Column | str) -> Column:
    return stripped(F.regexp_extract(text_of(c), V.ISBN, 1))


def year(c: Column | str) -> Column:
    return F.coalesce(F.array_max(F.regexp_extract_all(F.substring(text_of(c), 1, 2000), F.lit(V.YEAR), 1)), F.lit(""))


def by_type(c: Column | str, kind: Column | str) -> Column:
    """Text cut to the length that its segment's type is shown at."""
    limit = F.when(col(kind).isin("frontmatter", "preface"), V.CONTEXT_CHARS).otherwise(V.OTHER_CHARS)
    return F.when(F.length(text_of(c)) > limit, F.concat(F.substring(text_of(c), F.lit(1), limit), F.lit("\n[... truncated for brevity ...]"))).otherwise(text_of(c))


def union_text(a: Column | str, b: Column | str) -> Column:
    both = F.concat(F.coalesce(col(a), F.array().cast("array<string>")), F.coalesce(col(b), F.array().cast("array<string>")))
    return F.coalesce(F.nullif(F.array_join(both, ", "), F.lit("")), F.lit("None specified"))


def without_fence(c: Column | str) -> Column:
    return stripped(F.regexp_replace(F.regexp_replace(stripped(text_of(c)), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def whole_number(c: Column | str) -> Column:
    """'7', '7.0' and true are whole numbers; '7.5' and words are null."""
    x = F.when(F.lower(col(c)) == "true", "1").when(F.lower(col(c)) == "false", "0").otherwise(col(c)).try_cast("double")
    return F.when(x == F.floor(x), x.cast("int"))


def type_parts(heading: Column | str, text: Column | str) -> dict[str, Column]:
    """What the rules of classification look at; as columns of their own they are computed once."""
    t = text_of(text)
    body = F.regexp_replace(t, r"(?U)^\s+", "")
    return {"p_heading": normal_heading(heading), "p_text": t, "p_lines": lines_of(t), "p_low": F.lower(t), "p_start": F.substring(body, 1, 60), "p_first": F.lower(stripped(F.substring_index(body, "\n", 1)))}


def segment_type(heading: Column | str, text: Column | str, before_first_chapter: Column, parts: dict[str, Column] | None = None) -> Column:
    """The ordered rules of classification as one CASE."""
    h, t, lines, low, start, first = (parts or type_parts(heading, text)).values()
    count = lambda words: reduce(lambda n, w: n + F.contains(low, F.lit(w)).cast("int"), words, F.lit(0))
    n_exercise = exercise_lines(lines)
    any_front = reduce(lambda a, b: a | b, (h.rlike("(?i)" + p) for p in V.FRONT_PARTS))
    whole_front = reduce(lambda a, b: a | b, (first.rlike(rf"(?i)^(?:{p})\z") for p in V.FRONT_PARTS))
    legal = count(V.COPYRIGHT_WORDS) + F.when(F.contains(t, F.lit("©")), 2).otherwise(0)
    return (
        F.when((h != "") & h.rlike(V.PREFACE_HEADING) & before_first_chapter, "preface")
        .when((h == "frontmatter") & before_first_chapter & (count(V.PREFACE_PHRASES) >= 2), "preface")
        .when(h.rlike(V.REFERENCE_HEADING), "reference_table")
        .when(F.contains(t, F.lit("[TABLE:")) & (F.regexp_count(t, F.lit(r"\[TABLE:")) >= 2) & (prose_density(t) <= V.PROSE_LIMIT), "reference_table")
        .when(h.rlike(V.SOLUTION) | start.rlike(V.SOLUTION), "solution")
        .when(h.rlike(V.EXERCISE_HEADING) | h.rlike(V.EXERCISE_LINE) | ((n_exercise >= 3) & (n_exercise >= 0.4 * F.size(lines))), "exercise")
        .when(h.rlike(V.GLOSSARY_HEADING) | (definition_lines(t) >= 5), "glossary")
        .when(h.rlike(V.SUMMARY_HEADING), "summary")
        .when((F.size(lines) >= 5) & (option_lines(lines) >= 3) & (question_lines(lines) >= 2), "assessment")
        .when(any_front | whole_front, "frontmatter")
        .when(F.lower(F.substring(t, 1, 500)).rlike(V.INSTITUTION), "frontmatter")
        .when(F.substring(t, 1, 2000).rlike(V.UNIT_WORD) & F.substring(t, 1, 2000).rlike(V.TEXTBOOK), "frontmatter")
        .when(legal >= V.COPYRIGHT_LIMIT, "frontmatter")
        .otherwise("instructional")
    )


def with_segment_type(df: DataFrame, before_first_chapter: Column) -> DataFrame:
    """df (heading, text) with segment_type."""
    parts = type_parts("heading", "text")
    return df.withColumns(parts).withColumn("segment_type", segment_type("heading", "text", before_first_chapter, {c: F.col(c) for c in parts})).drop(*parts)
