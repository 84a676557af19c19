"""From words to blocks: four ways of finding chapters, each tried on the documents that none before it has settled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions import values as V
from tessella.operators import blocks as B
from tessella.operators import lines as L
from tessella.plans.evaluation import clustered, stored


def whole_pages(words: DataFrame) -> DataFrame:
    """doc_id, page_idx, text: the lines of a whole page, header and footer too."""
    lines = L.lines_from_words(words)
    in_order = F.array_sort(F.collect_list(F.struct("y_key", "text")))
    return lines.groupBy(*L.PAGE).agg(F.array_join(F.transform(in_order, lambda x: x["text"]), "\n").alias("text"))


def body_lines(words: DataFrame, tables: DataFrame | None = None, ocr: DataFrame | None = None, in_place: bool = False, sizes: DataFrame | None = None) -> DataFrame:
    """doc_id, page_idx, y_key, mark, text, is_header of the lines inside pages, with marks of figures, code and tables.

    Words inside a table are left to the table's text, which stands before its page's lines, or `in_place`. Blank lines and page numbers are
    dropped. A figure's caption neither opens nor closes a run of code. A page without words has the lines that were recognised
    (ocr: doc_id, page_idx, text), if any. sizes: the words' median sizes, where they are known.
    """
    body = L.in_body(words)
    own = body if tables is None else L.outside_tables(body, tables)
    sizes = L.median_sizes(words) if sizes is None else sizes
    own = own.join(sizes.select("doc_id", "threshold").hint("shuffle_hash"), "doc_id")
    size, font = F.coalesce("size", F.lit(0.0)), F.col("threshold")
    own = own.filter(~(F.col("text").rlike(r"^\d+\z") & (size >= font)))
    lines = L.lines_from_words(own, others=("threshold",))
    lines = lines.withColumn("text", T.stripped("text")).filter(~T.is_page_number("text"))
    caption = F.col("text").rlike(V.FIGURE) & ~F.col("is_code") & (F.col("max_size") < font)
    header = ~caption & L.is_header(F.col("text"), F.col("max_size"), F.col("is_bold"), font)
    text = T.figure_caption(F.col("text"), F.col("is_code"), F.col("max_size"), font)
    lines = lines.select(*L.PAGE, "y_key", text.alias("text"), "is_code", caption.alias("caption"), header.alias("is_header"))
    if tables is not None:
        y = F.col("top") if in_place else F.col("top") - 1e9
        marks = tables.select(*L.PAGE, y.alias("y_key"), T.table_text(F.col("cells"), 3 if in_place else 1).alias("text"), F.lit(False).alias("is_code"), F.lit(False).alias("caption"), F.lit(False).alias("is_header"))
        lines = lines.unionByName(marks)
    on_page = Window.partitionBy(*L.PAGE).orderBy("y_key")
    run = F.last(F.when(~F.col("caption"), F.col("is_code")), ignorenulls=True).over(on_page)
    out = L.with_code_marks(lines.withColumn("is_code", F.coalesce(run, F.lit(False))), ("is_header",))
    if ocr is None:
        return out
    bare = ocr.join(body.select(*L.PAGE).distinct(), list(L.PAGE), "left_anti")
    read = bare.select(*L.PAGE, F.posexplode(F.split("text", T.LINE_ENDS)).alias("at", "text")).filter(~T.is_page_number("text"))
    return out.unionByName(read.select(*L.PAGE, F.col("at").cast("double").alias("y_key"), F.lit(1).alias("mark"), "text", F.lit(False).alias("is_header")))


def body_pages(lines: DataFrame) -> DataFrame:
    """doc_id, page_idx, text of body_lines."""
    in_order = F.array_sort(F.collect_list(F.struct("y_key", "mark", "text")))
    return lines.groupBy(*L.PAGE).agg(F.array_join(F.transform(in_order, lambda x: x["text"]), "\n").alias("text"))


def course_blocks(words: DataFrame, page_counts: DataFrame, toc: DataFrame, outline: DataFrame, tables: DataFrame | None = None, ocr: DataFrame | None = None) -> DataFrame:
    """doc_id, tier, block_idx, heading, text of each document in page_counts (doc_id, pages), from its words.

    toc: doc_id, ord, number, title of the contents known from metadata; outline: doc_id, ord, title, page_idx; tables: doc_id, page_idx, x0,
    top, x1, bottom, cells. Tier 0 finds the titles of the contents on the pages, tier 1 takes the outline, tier 2 unit markers, tier 3 headers by
    size and weight. A tier settles a document if it finds blocks and, in tiers 1 and 2, about as many as the contents have entries (where
    there are any). Each tier reads the words of the documents that are left, and is written once: tier 3 never runs on the others.
    All words are written once in buckets of documents, where every tier reads them in place: words themselves are never shuffled.
    A document without a word or recognised line has no blocks. Repeated rows of page_counts count once.
    """
    tables = tables if tables is None else tables.select(*L.PAGE, "x0", "top", "x1", "bottom", "cells")
    entries = toc.groupBy("doc_id").agg(F.count("*").alias("toc"), F.count_if(F.coalesce("title", F.lit("")) != "").alias("titled"))
    left = stored(page_counts.groupBy("doc_id").agg(F.max("pages").cast("int").alias("pages")).join(entries, "doc_id", "left"))
    words = words.select(*L.PAGE, "word_seq", "text", "x0", *["x1"] * (tables is not None), "top", "bottom", "doctop", "size", "fontname", "page_h")
    with clustered(words, "doc_id") as words:
        return _tiers(words, stored(L.median_sizes(words)), left, toc, outline, tables, ocr)


def _tiers(words: DataFrame, sizes: DataFrame, left: DataFrame, toc: DataFrame, outline: DataFrame, tables: DataFrame | None, ocr: DataFrame | None) -> DataFrame:
    """left: doc_id, pages, toc, titled."""
    entries = left.select("doc_id", "toc")

    def of(df: DataFrame | None, docs: DataFrame) -> DataFrame | None:
        return df if df is None else df.join(docs.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi")

    def blocks(starts: DataFrame, docs: DataFrame, front: bool = True) -> DataFrame:
        found = starts.select("doc_id").distinct()
        pages = body_pages(body_lines(*(of(x, found) for x in (words, tables, ocr)), sizes=sizes))
        return B.range_blocks(B.page_ranges(starts, docs.select("doc_id", "pages"), front), pages)

    def by_contents(docs: DataFrame) -> DataFrame:
        docs = docs.filter("titled >= 2")
        heads = B.page_heads(whole_pages(of(words, docs)))
        heads = heads.join(B.contents_pages(heads).withColumn("is_contents", F.lit(True)), list(L.PAGE), "left")
        return blocks(stored(B.locate_chapters(of(toc, docs), heads)), docs)

    def by_outline(docs: DataFrame) -> DataFrame:
        starts = B.outline_starts(of(outline, docs), docs.select("doc_id", "pages"))
        several = F.count("*").over(Window.partitionBy("doc_id")) >= 2
        return blocks(stored(starts.withColumn("several", several).filter("several").drop("several")), docs, front=False)

    def by_units(docs: DataFrame) -> DataFrame:
        return blocks(stored(B.unit_starts(whole_pages(of(words, docs)))), docs)

    def by_headers(docs: DataFrame) -> DataFrame:
        lines = body_lines(*(of(x, docs) for x in (words, tables, ocr)), in_place=True, sizes=sizes)
        return L.header_blocks(lines.select("doc_id", F.struct("page_idx", "y_key", "mark").alias("ord"), "text", "is_header"))

    out = None
    for tier, find in enumerate((by_contents, by_outline, by_units, by_headers)):
        found = find(left).select("doc_id", F.lit(tier).alias("tier"), F.col("block_idx").cast("int").alias("block_idx"), "heading", "text")
        if tier in (1, 2):
            n: Column = F.count("*").over(Window.partitionBy("doc_id"))
            near = F.coalesce(F.abs(F.col("n") - F.col("toc")) <= V.TOC_TOLERANCE, F.lit(True))
            found = found.withColumn("n", n).join(entries, "doc_id", "left").filter(near).drop("n", "toc")
        found = stored(found)
        left = left.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
        out = found if out is None else out.unionByName(found)
    return out
