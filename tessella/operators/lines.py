"""Words to lines, code runs, tables and page text.

words: doc_id, page_idx, word_seq, text, x0, x1, top, bottom, doctop, size, fontname (and page_h for the crop).
A page is the unit that is gathered; its words are bounded by what fits on a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions import values as V

PAGE = ("doc_id", "page_idx")


def in_body(words: DataFrame, top: float = V.CROP_TOP, bottom: float = V.CROP_BOTTOM) -> DataFrame:
    """Words inside the page without its running header and footer."""
    return words.filter((F.col("top") >= top * F.col("page_h")) & (F.col("bottom") <= bottom * F.col("page_h")))


def median_sizes(words: DataFrame) -> DataFrame:
    """doc_id, median, threshold: the upper median font size, and that times the ratio of a header. Words without a size don't count; where
    none has one, a default is the median. Counts by size, not words, are gathered."""
    sizes = words.groupBy("doc_id", "size").agg(F.count("size").alias("n"))
    by_size = Window.partitionBy("doc_id").orderBy(F.asc_nulls_first("size"))
    sizes = sizes.withColumn("upto", F.sum("n").over(by_size)).withColumn("all", F.sum("n").over(Window.partitionBy("doc_id")))
    median = F.coalesce(F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("size"))), F.lit(V.DEFAULT_FONT_SIZE))
    return sizes.groupBy("doc_id").agg(median.alias("median"), (median * V.HEADER_RATIO).alias("threshold"))


def outside_tables(words: DataFrame, tables: DataFrame) -> DataFrame:
    """Words that no table box of their page contains. tables: doc_id, page_idx, x0, top, x1, bottom."""
    t = tables.select(*(F.col(c).alias(f"t_{c}") for c in ("doc_id", "page_idx", "x0", "top", "x1", "bottom")))
    inside = (F.col("x0") >= F.col("t_x0")) & (F.col("x1") <= F.col("t_x1")) & (F.col("top") >= F.col("t_top")) & (F.col("bottom") <= F.col("t_bottom"))
    return words.join(t, (F.col("doc_id") == F.col("t_doc_id")) & (F.col("page_idx") == F.col("t_page_idx")) & inside, "left_anti")


def lines_from_words(words: DataFrame, threshold: Column | None = None, others: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, page_idx, y_key, text, max_size, is_code, is_bold, in one aggregation by baseline. `others`: further columns, the same all over a document."""
    size = F.coalesce("size", F.lit(0.0))
    if threshold is not None:  # chapter numbers set large
        words = words.filter(~(F.col("text").rlike(r"^\d+\z") & (size >= threshold)))
    font = F.coalesce("fontname", F.lit(""))
    in_order = F.array_sort(F.collect_list(F.struct("x0", "word_seq", "text")))
    return words.groupBy(*PAGE, *others, (F.bround(F.col("doctop") / 2, 0) * 2).alias("y_key")).agg(
        T.without_cid(F.array_join(F.transform(in_order, lambda w: w["text"]), " ")).alias("text"),
        F.max(size).alias("max_size"),
        F.bool_or(font.rlike(V.MONOSPACE)).alias("is_code"),
        F.bool_or(font.rlike(V.HEAVY)).alias("is_bold"),
    )


def with_code_marks(lines: DataFrame, flags: tuple[str, ...] = ()) -> DataFrame:
    """Lines with [CODE] and [/CODE] as lines of their own around each run of code; `mark` orders them on their line. `flags`: further columns, false for marks."""
    on_page = Window.partitionBy(*PAGE).orderBy("y_key")
    before, after = F.coalesce(F.lag("is_code").over(on_page), F.lit(False)), F.coalesce(F.lead("is_code").over(on_page), F.lit(False))
    mark = lambda at, text: F.struct(F.lit(at).alias("mark"), F.lit(text).alias("text"), *(F.lit(False).alias(c) for c in flags))
    rows = F.array_compact(F.array(
        F.when(F.col("is_code") & ~before, mark(0, "[CODE]")),
        F.struct(F.lit(1).alias("mark"), F.col("text").alias("text"), *flags),
        F.when(F.col("is_code") & ~after, mark(2, "[/CODE]")),
    ))
    return lines.withColumn("rows", rows).select(*PAGE, "y_key", F.explode("rows").alias("r")).select(*PAGE, "y_key", "r.*")


def with_tables(lines: DataFrame, tables: DataFrame, tier: int = 1) -> DataFrame:
    """Table markers (doc_id, page_idx, y, text) among the lines: before them, or at their own height in tier 3."""
    own = tables.select(*PAGE, F.col("y").alias("y_key") if tier == 3 else F.lit(float("-inf")).alias("y_key"), F.lit(-1).alias("mark"), "text")
    return lines.unionByName(own)


def page_text(lines: DataFrame) -> DataFrame:
    """doc_id, page_idx, text of the marked lines of each page, without page numbers."""
    lines = lines.filter(~T.is_page_number("text"))
    in_order = F.array_sort(F.collect_list(F.struct("y_key", "mark", "text")))
    return lines.groupBy(*PAGE).agg(F.array_join(F.transform(in_order, lambda x: x["text"]), "\n").alias("text"))


def is_header(text: Column, size: Column, bold: Column, threshold: Column, use_bold: bool = True) -> Column:
    low = F.regexp_replace(F.lower(text), "[.,:;]+$", "")
    strong = bold & ~low.isin(*V.BOLD_LABELS) & ~text.endswith(":") & ~low.isin(*V.RUNNING_HEADERS) if use_bold else F.lit(False)
    return (F.length(text) < V.HEADER_MAX_CHARS) & ((size >= threshold) | strong)


def header_blocks(lines: DataFrame) -> DataFrame:
    """lines: doc_id, ord, text, is_header. doc_id, block_idx, heading, text: a header opens a block; one without a body is lost."""
    session = F.sum(F.col("is_header").cast("int")).over(Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumn("s", session)
    body = F.array_sort(F.collect_list(F.when(~F.col("is_header"), F.struct("ord", "text"))))
    blocks = rows.groupBy("doc_id", "s").agg(F.max(F.when(F.col("is_header"), F.col("text"))).alias("heading"), body.alias("body")).filter(F.size("body") > 0)
    index = (F.row_number().over(Window.partitionBy("doc_id").orderBy("s")) - 1).alias("block_idx")
    return blocks.select("doc_id", index, "heading", F.array_join(F.transform("body", lambda x: x["text"]), "\n").alias("text"))
