"""Chapters from contents pages, outlines and unit markers, and the choice between them. A document is the unit that is gathered."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions import values as V
from tessella.operators.errors import message

if TYPE_CHECKING:
    import pyarrow as pa


def unit_starts(pages: DataFrame) -> DataFrame:
    """pages: doc_id, page_idx, text. doc_id, heading, start: the first page of each unit; nothing unless two or more ascend."""
    mark = F.regexp_extract(F.substring("text", 1, 200), V.UNIT_MARKER, 1)
    after = T.stripped(F.regexp_extract(F.substring("text", 1, 300), V.UNIT_MARKER + r"(?U)\s*([^\n]*)", 2))
    marks = pages.select("doc_id", "page_idx", mark.alias("mark"), F.substring(after, 1, 80).alias("title"))
    marks = marks.withColumn("unit", T.unit_number("mark")).filter((F.col("mark") != "") & F.col("unit").isNotNull())
    first = Window.partitionBy("doc_id", "unit").orderBy("page_idx")
    marks = marks.withColumn("n", F.row_number().over(first)).filter("n = 1")
    by_unit, whole = Window.partitionBy("doc_id").orderBy("unit"), Window.partitionBy("doc_id")
    marks = marks.withColumn("up", F.coalesce(F.col("page_idx") > F.lag("page_idx").over(by_unit), F.lit(True)))
    marks = marks.withColumn("fine", F.bool_and("up").over(whole) & (F.count("*").over(whole) >= 2)).filter("fine")
    title = T.stripped(F.regexp_replace("title", r"^[\s\-–:]+", ""))
    return marks.select("doc_id", F.concat(F.lit("Unit "), F.col("unit").cast("string"), F.when(title != "", F.concat(F.lit(": "), title)).otherwise("")).alias("heading"), F.col("page_idx").alias("start"))


def outline_starts(outline: DataFrame, page_counts: DataFrame) -> DataFrame:
    """outline: doc_id, ord (depth first), title, page_idx. The first title of each page (null if it is blank), pages past the end clamped, entries without a page left out."""
    rows = outline.filter("page_idx IS NOT NULL").join(page_counts, "doc_id")
    rows = rows.withColumn("start", F.greatest(F.lit(0), F.least("page_idx", F.col("pages") - 1)))
    first = Window.partitionBy("doc_id", "start").orderBy("ord")
    heading = F.nullif(T.stripped("title"), F.lit("")).alias("heading")
    return rows.withColumn("n", F.row_number().over(first)).filter("n = 1").select("doc_id", heading, "start")


def page_ranges(starts: DataFrame, page_counts: DataFrame, frontmatter: bool = True) -> DataFrame:
    """doc_id, heading, start, stop: each start up to the next, the last to the end; pages before the first are Frontmatter."""
    by_start = Window.partitionBy("doc_id").orderBy("start")
    rows = starts.join(page_counts, "doc_id").withColumn("stop", F.greatest(F.coalesce(F.lead("start").over(by_start), F.col("pages")), F.col("start") + 1))
    rows = rows.select("doc_id", "heading", "start", "stop")
    if not frontmatter:
        return rows
    front = rows.groupBy("doc_id").agg(F.min("start").alias("stop")).filter("stop > 0")
    return rows.unionByName(front.select("doc_id", F.lit("Frontmatter").alias("heading"), F.lit(0).alias("start"), "stop"))


def range_blocks(ranges: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, block_idx, heading, text of the pages in each range; blank ones are left out."""
    p = pages.select(F.col("doc_id").alias("p_doc"), "page_idx", "text")
    rows = ranges.join(p, (F.col("doc_id") == F.col("p_doc")) & (F.col("page_idx") >= F.col("start")) & (F.col("page_idx") < F.col("stop")))
    in_order = F.array_sort(F.collect_list(F.struct("page_idx", "text")))
    text = T.stripped(F.array_join(F.transform(in_order, lambda x: x["text"]), "\n\n"))
    rows = rows.groupBy("doc_id", "heading", "start").agg(text.alias("text")).filter("text <> ''")
    index = (F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "heading")) - 1).alias("block_idx")
    return rows.select("doc_id", index, "heading", "text")


def page_heads(pages: DataFrame) -> DataFrame:
    """pages: doc_id, page_idx, text. doc_id, page_idx, head: what a page begins with, in lower case."""
    return pages.select("doc_id", "page_idx", F.lower(F.substring(T.text_of("text"), 1, V.HEAD_CHARS)).alias("head"))


def contents_pages(heads: DataFrame, limit: int = V.CONTENTS_WITHIN) -> DataFrame:
    """heads: doc_id, page_idx, head. The pages of a run that a contents heading opens and dotted lines carry on."""
    heads = heads.filter(F.col("page_idx") < limit)
    lines = T.lines_of("head")
    opens = F.exists(F.slice(lines, 1, 3), lambda x: x.rlike(V.CONTENTS_HEAD))
    dotted = F.size(F.filter(lines, lambda x: x.rlike(V.DOTTED_LINE))) >= 2
    rows = heads.select("doc_id", "page_idx", opens.alias("opens"), dotted.alias("dotted"))
    breaks = F.sum((~F.col("dotted") | F.col("opens")).cast("int")).over(Window.partitionBy("doc_id").orderBy("page_idx"))
    rows = rows.withColumn("run", breaks)
    rows = rows.withColumn("opened", F.bool_or("opens").over(Window.partitionBy("doc_id", "run")))
    return rows.filter(F.col("opened") & (F.col("opens") | F.col("dotted"))).select("doc_id", "page_idx")


def toc_entries(lines: DataFrame) -> DataFrame:
    """lines: doc_id, ord, line and others. Chapter lines of a table of contents: number (null without one), title, page_number; sub-chapters and headings left out."""
    part = lambda i: F.regexp_extract("line", V.TOC_LINE, i)
    title = T.stripped(F.regexp_replace(T.stripped(part(2)), r"\.+$", ""))
    others = [c for c in lines.columns if c != "line"]
    rows = lines.select(*others, F.nullif(T.stripped(part(1)), F.lit("")).alias("number"), title.alias("title"), T.roman(part(3)).alias("page_number"))
    plain = ~F.coalesce(F.col("number").contains("."), F.lit(False))
    return rows.filter((F.col("title") != "") & (F.length("title") <= 200) & plain & ~F.lower("title").isin("contents", "table of contents", "index"))


def contents_entries(pages: DataFrame, within: int = V.CONTENTS_SEARCH, most: int = V.CONTENTS_PAGES) -> DataFrame:
    """pages: doc_id, page_idx, text. doc_id, ord, number, title, page_number of the printed contents.

    They begin on the first of `within` pages with a contents heading among its first five lines, on this page or one of the next, and go on
    for `most` pages from there at most, up to the first page without an entry. A page that is missing, null or blank has none.
    Entries on pages in a row keep the same distance between their page and its place among pages with entries; a gap widens it.
    """
    rows = pages.filter(F.col("page_idx") < within).select("doc_id", "page_idx", "text")
    opens = F.exists(F.slice(T.lines_of("text"), 1, 5), lambda x: x.rlike(V.CONTENTS_HEADING))
    first = F.min(F.when(opens, F.col("page_idx"))).over(Window.partitionBy("doc_id"))
    rows = rows.withColumn("first", first).filter(F.col("page_idx").between(F.col("first"), F.col("first") + most - 1))
    lines = rows.select("doc_id", "page_idx", F.posexplode(F.split("text", T.LINE_ENDS)).alias("ord", "line"))
    found = toc_entries(lines.filter(~F.col("line").rlike(V.CONTENTS_HEADING)))
    by_page = Window.partitionBy("doc_id").orderBy("page_idx")
    found = found.withColumn("gap", F.col("page_idx") - F.dense_rank().over(by_page))
    found = found.withColumn("least", F.min("gap").over(Window.partitionBy("doc_id"))).filter(F.col("gap") == F.col("least"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_idx", "ord")) - 1
    return found.select("doc_id", place.alias("ord"), "number", "title", "page_number")


def locate_chapters(toc: DataFrame, heads: DataFrame) -> DataFrame:
    """toc: doc_id, ord, number, title; heads: doc_id, page_idx, head (of page_heads), is_contents. doc_id, ord, heading, start.

    An ordered fold: each titled entry, in order, takes the first page from the cursor on that names it, and moves the cursor behind that page;
    an entry without a page leaves it. The cursor starts behind the last contents page. A page names an entry if it holds two of the
    title's first three words of over two letters (the one, if there is but one; none are asked for if there is none) and, where the
    entry has a number, begins with that number, with or without "chapter" before it. Nothing is found for an entry without such words
    and number, nor in a document with fewer than two titled entries or fewer than two found.
    What is gathered of a document is its entries and its pages' heads.
    """
    behind = lambda c, n: F.substring(c, n + F.lit(1), F.length(c))
    rest = F.regexp_extract("head", r"(?sU)^\s*chapter\s+(.*)$", 1)
    plain = F.regexp_replace("head", r"(?U)^\s+", "")
    page = F.struct("page_idx", "head", rest.alias("rest"), plain.alias("plain"))
    open_pages = ~F.coalesce(F.col("is_contents"), F.lit(False)) & (T.stripped("head") != "")
    pages = heads.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.when(open_pages, page))).alias("pages"),
        F.coalesce(F.max(F.when(F.col("is_contents"), F.col("page_idx"))) + 1, F.lit(0)).cast("int").alias("cursor"),
    )
    words = F.slice(F.filter(F.split(F.lower("title"), r"(?U)\s+"), lambda w: F.length(w) > 2), 1, 3)
    given = F.lower(T.stripped(T.text_of(F.col("number").cast("string"))))
    heading = F.when(F.coalesce(F.col("number").cast("string"), F.lit("")) != "", F.concat(F.lit("Chapter "), "number", F.lit(": "), "title")).otherwise(F.col("title"))
    entry = F.struct(F.col("ord").cast("int").alias("ord"), heading.alias("heading"), words.alias("words"), given.alias("given"), given.rlike(r"(?U)\w\z").alias("wordy"))
    entries = toc.filter(F.col("title") != "").groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("entries")).filter(F.size("entries") >= 2)

    def names(p: Column, e: Column) -> Column:
        seen = F.size(F.filter(e["words"], lambda w: F.contains(p["head"], w)))
        after = behind(p["rest"], F.length(e["given"]))
        chapter = F.startswith(p["rest"], e["given"]) & (after.rlike(r"(?U)^\w") != e["wordy"])
        bare = F.startswith(p["plain"], e["given"]) & behind(p["plain"], F.length(e["given"])).rlike(r"(?U)^\s+\S")
        return (seen >= F.least(F.lit(2), F.size(e["words"]))) & F.when(e["given"] != "", chapter | bare).otherwise(F.size(e["words"]) > 0)

    def step(s: Column, e: Column) -> Column:
        at = F.get(F.filter("pages", lambda p: (p["page_idx"] >= s["cursor"]) & names(p, e)), F.lit(0))["page_idx"].cast("int")
        hit = lambda x: F.array(F.struct(e["ord"].alias("ord"), e["heading"].alias("heading"), x.alias("start")))
        moved = lambda x: F.when(x.isNull(), s).otherwise(F.struct((x + 1).alias("cursor"), F.concat(s["found"], hit(x)).alias("found")))
        return F.get(F.transform(F.array(at), moved), F.lit(0))

    start = F.struct(F.col("cursor"), F.expr("CAST(array() AS array<struct<ord:int,heading:string,start:int>>)").alias("found"))
    rows = entries.join(pages, "doc_id").select("doc_id", F.aggregate("entries", start, step, lambda s: s["found"]).alias("found"))
    return rows.filter(F.size("found") >= 2).select("doc_id", F.inline("found"))


def choose_tier(tiers: list[DataFrame], toc_sizes: DataFrame) -> DataFrame:
    """The blocks of each document's first tier that has any and, but for tier 0 and the last, is near its contents' size."""
    marked = tiers[0].withColumn("tier", F.lit(0))
    for i, t in enumerate(tiers[1:], 1):
        marked = marked.unionByName(t.withColumn("tier", F.lit(i)))
    counts = marked.groupBy("doc_id", "tier").agg(F.count("*").alias("n")).join(toc_sizes, "doc_id", "left")
    able = (F.col("tier").isin(0, len(tiers) - 1)) | (F.coalesce("toc", F.lit(0)) == 0) | (F.abs(F.col("n") - F.col("toc")) <= V.TOC_TOLERANCE)
    best = counts.filter(able).groupBy("doc_id").agg(F.min("tier").alias("tier"))
    return marked.join(best, ["doc_id", "tier"])


def first_chapters(blocks: DataFrame) -> DataFrame:
    """doc_id, first_chapter_idx: null where no heading opens a chapter."""
    opens = T.stripped("heading").rlike(V.CHAPTER_START)
    return blocks.groupBy("doc_id").agg(F.min(F.when(opens, F.col("block_idx"))).alias("first_chapter_idx"))


def merged(rows: list[tuple[str | None, str]], max_words: int, barred: list[bool]) -> list[tuple[str | None, str]]:
    """Adjacent blocks joined, the smallest pair below the limit first (leftmost of equals), by a heap over a linked list."""
    import heapq
    import re

    size = [len(re.findall(r"\S+", t)) for _, t in rows]
    head, parts = [h for h, _ in rows], [[t] for _, t in rows]
    right = [*range(1, len(rows)), -1] if rows else []
    left, alive, age = list(range(-1, len(rows) - 1)), [True] * len(rows), [0] * len(rows)
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(a: int) -> None:
        b = right[a]
        if b >= 0 and not barred[b] and size[a] + size[b] < max_words:
            heapq.heappush(heap, (size[a] + size[b], a, b, age[a], age[b]))

    for i in range(len(rows)):
        offer(i)
    while heap:
        _, a, b, x, y = heapq.heappop(heap)
        if not (alive[a] and alive[b] and age[a] == x and age[b] == y):
            continue
        parts[a] += parts[b]
        head[a], size[a], alive[b], right[a] = head[a] or head[b], size[a] + size[b], False, right[b]
        age[a] += 1
        if right[a] >= 0:
            left[right[a]] = a
        if left[a] >= 0:
            offer(left[a])
        offer(a)
    return [(head[i], "\n\n".join(parts[i])) for i in range(len(rows)) if alive[i]]


def merge_blocks(blocks: DataFrame, max_words: int = V.MAX_WORDS, chunked: bool = False, errors: bool = False) -> DataFrame:
    """blocks: doc_id, block_idx, heading, text. Chapter and unit openings are never merged into what stands before them.

    With `chunked`, each merged text in pieces, with their chunk_idx. With `errors`, a document whose merging fails gives one row with the
    failure in `error` (see operators/errors.py) and nothing else, and all other rows have a null there; without, its failure is the job's.
    """
    h = F.coalesce(T.stripped("heading"), F.lit(""))
    barred = h.rlike(V.MERGE_BARRIER) | h.rlike(V.UNIT_BARRIER) | F.substring("text", 1, 200).rlike(V.UNIT_BARRIER)
    columns = ["doc_id", "block_idx", *["chunk_idx"] * chunked, "heading", "text", *["error"] * errors]

    def rows_of(doc, rows: list[tuple]) -> list[tuple]:
        try:
            out = merged([(h, t) for h, t, _ in rows], max_words, [b for _, _, b in rows])
            return [(doc, i, j, h, c, None) for i, (h, t) in enumerate(out) for j, c in enumerate(chunks_of(t, max_words) if chunked else [t])]
        except Exception as e:
            if not errors:
                raise
            return [(doc, None, None, None, None, message(e))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows; a document may reach over several batches, and is held until it ends."""
        import pyarrow as pa

        kinds = {"block_idx": pa.int32(), "chunk_idx": pa.int32()}

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            arrays = dict(zip(("doc_id", "block_idx", "chunk_idx", "heading", "text", "error"), zip(*rows, strict=True), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(arrays[c], kinds.get(c, pa.string())) for c in columns], names=columns)

        doc, held = None, []
        for batch in batches:
            kinds["doc_id"], done = batch.schema.field("doc_id").type, []
            for d, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and d != doc:
                    done += rows_of(doc, held)
                    held = []
                doc = d
                held.append(tuple(row))
            if done:
                yield batch_of(done)
        if held and (last := rows_of(doc, held)):
            yield batch_of(last)

    kinds = {"doc_id": blocks.schema["doc_id"].dataType.simpleString(), "block_idx": "int", "chunk_idx": "int"}
    schema = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in columns)
    rows = blocks.repartition("doc_id").sortWithinPartitions("doc_id", F.asc_nulls_last("block_idx"))
    return rows.select("doc_id", "heading", T.text_of("text").alias("text"), barred.alias("barred")).mapInArrow(run, schema)


def chunks_of(text: str, max_words: int) -> list[str]:
    """A text in pieces of max_words at most: paragraphs packed, long ones by sentence, long sentences by word."""
    import re

    def count(s: str) -> int:
        return len(re.findall(r"\S+", s))

    def pack(parts: list[str], glue: str, cost: int, deeper) -> Iterator[str]:
        held, words = [], 0
        for p in parts:
            n = count(p)
            if n > max_words:
                if held:
                    yield glue.join(held)
                held, words = [], 0
                yield from deeper(p)
            elif held and words + n + cost > max_words:
                yield glue.join(held)
                held, words = [p], n
            else:
                held, words = [*held, p], words + n + (cost if held else 0)
        if held:
            yield glue.join(held)

    def slices(sentence: str) -> Iterator[str]:
        words = sentence.split()
        for i in range(0, len(words), max_words):
            yield " ".join(words[i : i + max_words])

    if count(text) <= max_words:
        return [text]
    by_sentence = lambda p: pack(re.split(r"(?<=[.!?])\s+", p), " ", 1, slices)
    return [c.strip() for c in pack(re.split(r"\n\n+", text), "\n\n", 2, by_sentence)]


def chunk_blocks(blocks: DataFrame, max_words: int = V.MAX_WORDS) -> DataFrame:
    """doc_id, block_idx, chunk_idx, heading, text. Only blocks over the limit go through Python."""
    columns = ["doc_id", "block_idx", "chunk_idx", "heading", "text"]
    schema = f"doc_id {blocks.schema['doc_id'].dataType.simpleString()}, block_idx int, chunk_idx int, heading string, text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(d, b, i, h, c) for d, b, h, t in pdf.itertuples(index=False) for i, c in enumerate(chunks_of(t, max_words))], columns=columns)

    rows = blocks.select("doc_id", F.col("block_idx").cast("int").alias("block_idx"), "heading", "text")
    small = rows.filter(T.word_count("text") <= max_words).select("doc_id", "block_idx", F.lit(0).alias("chunk_idx"), "heading", "text")
    return small.unionByName(rows.filter(T.word_count("text") > max_words).mapInPandas(run, schema))


def number_segments(chunks: DataFrame) -> DataFrame:
    """doc_id, segment_id (from 1), heading, text, segment_type of the chunks that aren't blank.

    A document's first chapter is the first block whose heading opens one; all three windows share one exchange by doc_id.
    """
    by_place = Window.partitionBy("doc_id").orderBy("block_idx", "chunk_idx")
    first = F.min(F.when(T.stripped("heading").rlike(V.CHAPTER_START), F.col("block_idx"))).over(Window.partitionBy("doc_id"))
    rows = chunks.withColumn("first_chapter_idx", first).filter(T.stripped("text") != "")
    before = F.col("first_chapter_idx").isNull() | (F.col("block_idx") < F.col("first_chapter_idx"))
    rows = T.with_segment_type(rows, before)
    return rows.select("doc_id", F.row_number().over(by_place).alias("segment_id"), "heading", T.stripped("text").alias("text"), "segment_type")


def segment_documents(blocks: DataFrame, max_words: int = V.MAX_WORDS) -> DataFrame:
    """blocks: doc_id, block_idx, heading, text, to segments: merged and chunked in one step a document, numbered and classified."""
    return number_segments(merge_blocks(blocks, max_words, chunked=True))
