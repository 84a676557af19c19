"""Course metadata: heuristics over page text, precedence of sources, and the last fallback of file properties."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions import values as V
from tessella.operators.errors import message

TEXTS = ("title", "author", "publisher", "level", "target_audience", "draft_notes", "source", "subject", "description", "isbn", "year")
LISTS = ("prerequisites_stated", "prerequisites_inferred", "learning_outcomes_stated", "learning_outcomes_inferred", "contributing_authors")
TOC = "array<struct<chapter_number:string,title:string,page_number:int>>"
SCHEMA = "doc_id string, " + ", ".join(f"{c} string" for c in TEXTS) + ", " + ", ".join(f"{c} array<string>" for c in LISTS) + f", toc {TOC}"


def empty(name: str) -> Column:
    return F.lit("") if name in TEXTS else F.expr(f"CAST(array() AS {TOC if name == 'toc' else 'array<string>'})")


def conformed(rows: DataFrame) -> DataFrame:
    """doc_id and the known fields: others dropped, missing ones empty, levels and long names normalised."""
    out = []
    for c in (*TEXTS, *LISTS, "toc"):
        own = F.coalesce(F.col(c), empty(c)) if c in rows.columns else empty(c)
        out.append((T.level(own) if c == "level" else T.short_name(own) if c in ("author", "publisher") else own).alias(c))
    return rows.select(F.col("doc_id").cast("string").alias("doc_id"), *out)


def cover_and_raw(words: DataFrame) -> DataFrame:
    """doc_id, cover (3 pages), raw (15 pages, cropped) from words; at most 15 pages of a document are gathered."""
    rows = words.filter(F.col("page_idx") < 15)
    inside = (F.col("top") >= V.META_CROP_TOP * F.col("page_h")) & (F.col("bottom") <= V.META_CROP_BOTTOM * F.col("page_h"))
    joined = lambda keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("word_seq", "text")))), lambda w: w["text"]), " ")
    pages = rows.groupBy("doc_id", "page_idx").agg(joined(F.lit(True)).alias("all"), joined(inside).alias("body"))
    of = lambda keep, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("page_idx", F.col(c).alias("t"))))), lambda p: p["t"]), "\n")
    return pages.groupBy("doc_id").agg(of(F.col("page_idx") < 3, "all").alias("cover"), of(F.lit(True), "body").alias("raw"))


def with_fallback(rows: DataFrame) -> DataFrame:
    """raw and cover replaced by other text of the same pages (alt), where raw has few words and alt is longer."""
    poor = (T.word_count("raw") < V.FALLBACK_WORDS) & (F.length("alt") > F.length("raw"))
    return rows.withColumns({"raw": F.when(poor, F.col("alt")).otherwise(F.col("raw")), "cover": F.when(poor, F.substring("alt", 1, V.COVER_CHARS)).otherwise(F.col("cover"))})


def title_by_size(words: DataFrame) -> DataFrame:
    """doc_id, title: the words nearly as large as the largest of the cover (size 14 or more), in order (in title case if all are capitals); else that word."""
    rows = words.filter((F.col("page_idx") < 3) & (F.length("text") >= 2) & F.col("text").rlike(r"^[\x00-\x7F]+$"))
    best = rows.groupBy("doc_id").agg(F.max("size").alias("largest"), F.max_by("text", F.struct("size", -F.col("page_idx"), -F.col("doctop"), -F.col("word_seq"))).alias("single")).filter("largest >= 14")
    large = rows.join(best, "doc_id").filter(F.col("size") >= 0.9 * F.col("largest"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_idx", "doctop", "word_seq", "text"))), lambda w: w["text"]), " ")
    out = large.groupBy("doc_id").agg(joined.alias("t"), F.first("single").alias("single"), F.count("*").alias("n"))
    best = F.when(F.col("n").between(2, 20), F.col("t")).otherwise(F.col("single"))
    shouted = (best == F.upper(best)) & (best != F.lower(best)) & (F.col("n").between(2, 20))
    title = F.when(shouted, T.py_title(best)).otherwise(best)
    return out.select("doc_id", title.alias("title"))


def largest_words(words: DataFrame, n: int = 15) -> DataFrame:
    """doc_id, n, text, size: the n largest words of the first three pages of each document, ties in page order."""
    by_size = Window.partitionBy("doc_id").orderBy(F.desc("size"), "page_idx", "doctop", "word_seq")
    rows = words.filter("page_idx < 3").withColumn("n", F.row_number().over(by_size))
    return rows.filter(F.col("n") <= n).select("doc_id", "n", "text", "size")


def description(both: Column) -> Column:
    """The first pattern's match of some length that isn't a publisher's boilerplate, cut to a length; '' if there is none."""
    found = F.lit("")
    for p in reversed(V.DESCRIPTIONS):
        raw = T.stripped(F.regexp_extract(both, p, 1))
        plain = ~F.lower(raw).rlike("^(" + "|".join(V.BOILERPLATE) + ")")
        found = F.when((F.length(raw) >= V.DESCRIPTION_LEAST) & plain, F.substring(raw, 1, V.DESCRIPTION_CHARS)).otherwise(found)
    return found


def heuristics(rows: DataFrame) -> DataFrame:
    """rows: doc_id, cover, raw. doc_id and what patterns find in the texts; null texts are empty."""
    rows = rows.select("doc_id", T.text_of("cover").alias("cover"), F.concat(T.text_of("cover"), F.lit("\n\n"), T.text_of("raw")).alias("both"))
    both = F.col("both")
    subject = F.coalesce(F.regexp_replace(T.first_group(both, V.SUBJECTS), "[.,]+$", ""), F.lit(""))
    return rows.select(
        "doc_id",
        T.first_match("cover", V.TITLES).alias("title"),
        T.real_author(T.first_match("cover", V.AUTHORS)).alias("author"),
        T.short_name(T.first_match("cover", V.PUBLISHERS)).alias("publisher"),
        subject.alias("subject"),
        description(both).alias("description"),
        T.isbn(both).alias("isbn"),
        T.year(both).alias("year"),
    )


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """Field by field the first source unless it is empty there, else the second; a table of contents as a whole."""
    a, b = conformed(first).alias("a"), conformed(second).alias("b")
    rows = b.join(a, F.col("a.doc_id") == F.col("b.doc_id"), "left")
    out = [F.coalesce(F.nullif(F.col(f"a.{c}"), F.lit("")), F.col(f"b.{c}")).alias(c) if c in TEXTS else F.when(F.size(f"a.{c}") > 0, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in (*TEXTS, *LISTS, "toc") if c != "source"]
    return rows.select("b.doc_id", *out, F.col("b.source").alias("source"))


def with_properties(rows: DataFrame, properties: DataFrame) -> DataFrame:
    """properties: doc_id, p_title, p_author, p_subject, stem. Fills title, author and subject where they are still empty."""
    rows = rows.join(properties, "doc_id", "left")
    title = F.when(F.lower(T.stripped("p_title")) == F.lower("stem"), "").otherwise(T.clean_title("p_title"))
    author = F.when(F.col("p_author").rlike(r"\p{Lu}"), T.real_author("p_author")).otherwise("")
    subject = F.when((F.length("p_subject") <= 200) & (F.regexp_count("p_subject", F.lit(";")) < 2), F.col("p_subject")).otherwise("")
    fill = {c: F.coalesce(F.nullif(c, F.lit("")), p, F.lit("")) for c, p in (("title", title), ("author", author), ("subject", subject))}
    return rows.withColumns(fill).drop("p_title", "p_author", "p_subject", "stem")


def parse_response(rows: DataFrame) -> DataFrame:
    """rows: doc_id, raw (a model's JSON). doc_id and the known fields; null scalars and lists of other kinds are empty, items cleaned."""
    text = T.without_fence("raw")
    lists = ", ".join(f"{c} array<string>" for c in LISTS)
    j = F.from_json(text, ", ".join(f"{c} string" for c in TEXTS) + f", {lists}, toc array<struct<chapter_number:string,title:string,page_number:string>>")
    clean = lambda xs: F.filter(F.transform(F.coalesce(xs, F.expr("CAST(array() AS array<string>)")), lambda x: T.stripped(F.replace(F.coalesce(x, F.lit("")), F.lit("\n"), F.lit(" ")))), lambda x: x != "")
    toc = F.transform(F.filter(j["toc"], lambda x: F.coalesce(T.stripped(x["title"]), F.lit("")) != ""), lambda x: F.struct(x["chapter_number"].alias("chapter_number"), x["title"].alias("title"), x["page_number"].try_cast("int").alias("page_number")))
    return conformed(rows.select("doc_id", *(j[c].alias(c) for c in TEXTS), *(clean(j[c]).alias(c) for c in LISTS), toc.alias("toc")))


def summary(rows: DataFrame) -> DataFrame:
    """doc_id, label, value, present: a line for each field."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("label"), (F.col(c) if c in TEXTS else F.array_join(F.col(c), ", ")).alias("value")) for c in (*TEXTS, *LISTS))))
    return rows.select("doc_id", each.alias("e")).select("doc_id", "e.label", "e.value", (F.col("e.value") != "").alias("present"))


COVER_PROMPT, RAW_PROMPT = 6000, 15000


def prompts(rows: DataFrame, rules: str) -> DataFrame:
    """rows: doc_id, cover, raw. doc_id, prompt: the rules and as much of both texts as a request takes."""
    return rows.select("doc_id", F.concat_ws("\n\n", F.lit(rules), F.concat(F.lit("COVER:\n"), F.substring("cover", 1, COVER_PROMPT)), F.concat(F.lit("TEXT:\n"), F.substring("raw", 1, RAW_PROMPT))).alias("prompt"))


def enriched(rows: DataFrame, providers: list[Callable[[str], str]], tries: int = 2, wait: float = 3.0) -> DataFrame:
    """rows: doc_id, prompt. doc_id, raw, provider, error: the answer of the first provider that gives a JSON object, and its number.

    A provider is asked again after any failure; an answer that is no JSON object is the next one's turn. Where all fail, raw is null and
    error says how each did.
    """
    from tessella.operators.scoring import call_with_retry

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, prompt in pdf.itertuples(index=False):
                failures, found = [], None
                for number, call in enumerate(providers):
                    try:
                        raw = call_with_retry(call, prompt, tries, wait, every=True)
                        if not isinstance(json.loads(unfenced(raw)), dict):
                            raise ValueError("the answer is no JSON object")
                        found = (doc, raw, number, None)
                        break
                    except Exception as e:  # the next provider's turn
                        failures.append(message(e))
                out.append(found or (doc, None, None, "; ".join(failures)))
            yield pd.DataFrame(out, columns=["doc_id", "raw", "provider", "error"]).astype({"provider": "Int32"})

    return rows.select("doc_id", "prompt").mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, raw string, provider int, error string")


def unfenced(raw: str) -> str:
    return re.sub(r"\s*```$", "", re.sub(r"^```(?:json)?\s*", "", raw.strip()))
