"""Stand-ins over the test tables: a document is a course, its lines are blocks, its tokens are words. With the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import values as V


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, i (from 1), line."""
    rows = docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line"))
    return rows.select("doc_id", (F.col("p") + 1).cast("long").alias("i"), "line")


LINES = "ln AS (SELECT doc_id, CAST(i AS BIGINT) AS i, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"


def words(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of each line, laid out on pages of 20 lines; names of fonts and sizes follow from the token."""
    rows = lines(spark, sf).select("doc_id", "i", F.posexplode(F.split("line", " ", -1)).alias("w", "text")).filter("text <> ''")
    size = (F.lit(10) + F.length("text") % 7).cast("double")
    font = F.when(F.length("text") % 5 == 0, "CourierNew").when(F.length("text") % 11 == 0, "Times-Bold").otherwise("Times")
    top = (F.lit(100) + ((F.col("i") - 1) % 20) * 30).cast("double")
    return rows.select("doc_id", ((F.col("i") - 1) / 20).cast("int").alias("page_idx"), F.col("w").cast("int").alias("word_seq"), "text", (F.col("w") * 9).cast("double").alias("x0"), (F.col("w") * 9 + 8).cast("double").alias("x1"), top.alias("top"), (top + 12).alias("bottom"), top.alias("doctop"), size.alias("size"), font.alias("fontname"), F.lit(800.0).alias("page_h"))


WORDS = LINES + """, tk AS (SELECT doc_id, i, unnest(string_split(line, ' ')) AS text, generate_subscripts(string_split(line, ' '), 1) - 1 AS w FROM ln),
wd AS (SELECT doc_id, CAST((i - 1) // 20 AS INTEGER) AS page_idx, w, text, w * 9.0 AS x0, 100.0 + ((i - 1) % 20) * 30 AS doctop, CAST(10 + len(text) % 7 AS DOUBLE) AS size,
    CASE WHEN len(text) % 5 = 0 THEN 'CourierNew' WHEN len(text) % 11 = 0 THEN 'Times-Bold' ELSE 'Times' END AS fontname FROM tk WHERE text <> '')"""


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Every third line that is a block has a heading: its first sentence, or a chapter's."""
    heading = F.when(F.col("i") % 6 == 4, F.concat(F.lit("Chapter "), (F.col("i") / 6).cast("int").cast("string"))).when(F.col("i") % 3 == 1, F.substring_index("line", ".", 1))
    return lines(spark, sf).select("doc_id", (F.col("i") - 1).cast("int").alias("block_idx"), heading.alias("heading"), F.col("line").alias("text"))


BLOCKS = LINES + ", bl AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS block_idx, CASE WHEN i % 6 = 4 THEN 'Chapter ' || (i // 6) WHEN i % 3 = 1 THEN string_split(line, '.')[1] END AS heading, line AS text FROM ln)"


def segments(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when((F.col("doc_id") + F.col("i")) % 4 == 0, "exercise").when((F.col("doc_id") + F.col("i")) % 13 == 0, "glossary").otherwise("instructional")
    return lines(spark, sf).select("doc_id", F.col("i").cast("int").alias("segment_id"), F.when(F.col("i") % 3 == 1, F.substring_index("line", ".", 1)).alias("heading"), F.col("line").alias("text"), kind.alias("segment_type"))


def evaluated(spark: SparkSession, sf: str) -> DataFrame:
    score = lambda k: ((F.col("doc_id") * 7 + F.col("segment_id") * 3 + k * 5) % 11).cast("int")
    why = lambda k: F.when((F.col("segment_id") + k) % 5 == 0, "").otherwise(F.expr(f"substring(text, {k + 1})"))
    rows = segments(spark, sf)
    scores = F.struct(*(score(k).alias(d) for k, d in enumerate(V.MODULE_DIMS)))
    reasons = F.struct(*(why(k).alias(f"{d}_rationale") for k, d in enumerate(V.MODULE_DIMS)))
    return rows.select("*", scores.alias("scores"), reasons.alias("reasoning"), F.when(F.col("segment_id") % 6 == 5, "").otherwise(F.col("text")).alias("summary"), ((F.col("doc_id") + F.col("segment_id")) % 7 == 0).alias("incomplete"))


SEGMENTS = LINES + """, sg AS (SELECT doc_id, CAST(i AS INTEGER) AS segment_id, CASE WHEN i % 3 = 1 THEN string_split(line, '.')[1] END AS heading, line AS text,
    CASE WHEN (doc_id + i) % 4 = 0 THEN 'exercise' WHEN (doc_id + i) % 13 = 0 THEN 'glossary' ELSE 'instructional' END AS segment_type FROM ln)"""
EVALUATED = SEGMENTS + ", ev AS (SELECT *, " + ", ".join(f"CAST((doc_id * 7 + segment_id * 3 + {k * 5}) % 11 AS INTEGER) AS {d}, CASE WHEN (segment_id + {k}) % 5 = 0 THEN '' ELSE substr(text, {k + 1}) END AS {d}_rationale" for k, d in enumerate(V.MODULE_DIMS)) + """,
    CASE WHEN segment_id % 6 = 5 THEN '' ELSE text END AS summary, (doc_id + segment_id) % 7 = 0 AS incomplete FROM sg)"""


# ---- courses of words for the cascade: two lines a page; what tells chapters stands above the body, where the crop leaves it out


def course_words(spark: SparkSession, sf: str) -> DataFrame:
    """Every fourth document has chapters and printed contents, another an outline alone, another unit markers, another nothing."""
    rows = lines(spark, sf).select("doc_id", ((F.col("i") - 1) / 2).cast("int").alias("page_idx"), (100 + ((F.col("i") - 1) % 2) * 30).cast("double").alias("top"), F.col("line").alias("x"), F.lit(True).alias("body"))
    pages = rows.select("doc_id", "page_idx").distinct()
    p, k = F.col("page_idx"), (F.col("page_idx") / 3).cast("int") + 1
    say = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    head = lambda y, text: F.struct(F.lit(float(y)).alias("top"), text.alias("x"))
    chapters = F.array_compact(F.array(
        F.when(p % 3 == 1, head(40, say("Chapter ", 2 * k, " Topic words ", k))),
        F.when(p % 3 == 2, head(40, F.lit("More topic words"))),
        F.when(p == 0, head(20, F.lit("Contents"))), F.when(p == 0, head(30, F.lit("Topic words 1 ..... 3"))), F.when(p == 0, head(40, F.lit("Topic words 2 ..... 6"))),
    ))
    units = F.array_compact(F.array(F.when(p % 3 == 0, head(40, say("UNIT - ", k, " Subject ", k)))))
    heads = pages.select("doc_id", "page_idx", F.explode(F.when(F.col("doc_id") % 4 == 0, chapters).when(F.col("doc_id") % 4 == 2, units)).alias("h")).select("doc_id", "page_idx", "h.*", F.lit(False).alias("body"))
    words = rows.unionByName(heads).select("doc_id", "page_idx", "top", "body", F.posexplode(F.split("x", " ", -1)).alias("w", "text")).filter("text <> ''")
    size = F.when(F.col("body"), 10 + F.length("text") % 7).otherwise(10).cast("double")
    font = F.when(F.col("body") & (F.length("text") % 5 == 0), "CourierNew").when(F.col("body") & (F.length("text") % 11 == 0), "Times-Bold").otherwise("Times")
    return words.select("doc_id", "page_idx", F.col("w").alias("word_seq"), "text", (F.col("w") * 9).cast("double").alias("x0"), (F.col("w") * 9 + 8).cast("double").alias("x1"), "top", (F.col("top") + 12).alias("bottom"), F.col("top").alias("doctop"), size.alias("size"), font.alias("fontname"), F.lit(800.0).alias("page_h"))


def course_pages(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).groupBy("doc_id").agg((F.max((F.col("i") - 1) / 2).cast("int") + 1).alias("pages"))


def course_toc(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers skip, every fourth entry has none; some documents with an outline have contents that no page names."""
    k = F.explode(F.sequence(F.lit(1), F.when(F.col("doc_id") % 4 == 0, F.ceil(F.col("pages") / 3).cast("int")).otherwise(F.lit(12)))).alias("k")
    rows = course_pages(spark, sf).filter("doc_id % 4 = 0 OR doc_id % 8 = 5").select("doc_id", k)
    own = F.col("doc_id") % 4 == 0
    number = F.when(own & (F.col("k") % 4 != 0), (2 * F.col("k")).cast("string"))
    return rows.select("doc_id", (F.col("k") - 1).alias("ord"), number.alias("number"), F.when(own, F.concat(F.lit("Topic words "), F.col("k").cast("string"))).otherwise("Unseen entry").alias("title"))


def course_outline(spark: SparkSession, sf: str) -> DataFrame:
    """Every second page twice, and one entry past the end."""
    rows = course_pages(spark, sf).filter("doc_id % 4 = 1")
    at = F.explode(F.sequence(F.lit(0), 2 * F.col("pages"))).alias("ord")
    return rows.select("doc_id", at).select("doc_id", "ord", F.concat(F.lit(" Part "), F.col("ord").cast("string")).alias("title"), ((F.col("ord") / 2).cast("int") * 2).alias("page_idx"))


COURSES = LINES + r""", cb AS (SELECT doc_id, CAST((i - 1) // 2 AS INTEGER) AS p, 100.0 + ((i - 1) % 2) * 30 AS y, line AS x, true AS body FROM ln),
pg AS (SELECT doc_id, max(p) + 1 AS pages FROM cb GROUP BY doc_id), ps AS (SELECT DISTINCT doc_id, p, p // 3 + 1 AS k FROM cb),
hd AS (SELECT doc_id, p, 40.0 AS y, 'Chapter ' || 2 * k || ' Topic words ' || k AS x FROM ps WHERE doc_id % 4 = 0 AND p % 3 = 1
    UNION ALL SELECT doc_id, p, 40.0, 'More topic words' FROM ps WHERE doc_id % 4 = 0 AND p % 3 = 2
    UNION ALL SELECT doc_id, p, t.y, t.x FROM ps, (VALUES (20.0, 'Contents'), (30.0, 'Topic words 1 ..... 3'), (40.0, 'Topic words 2 ..... 6')) t(y, x) WHERE doc_id % 4 = 0 AND p = 0
    UNION ALL SELECT doc_id, p, 40.0, 'UNIT - ' || k || ' Subject ' || k FROM ps WHERE doc_id % 4 = 2 AND p % 3 = 0),
al AS (SELECT * FROM cb UNION ALL SELECT *, false FROM hd),
cw AS (SELECT * FROM (SELECT doc_id, p, y, body, unnest(string_split(x, ' ')) AS text, generate_subscripts(string_split(x, ' '), 1) - 1 AS w FROM al) WHERE text <> ''),
cs AS (SELECT *, CAST(CASE WHEN body THEN 10 + len(text) % 7 ELSE 10 END AS DOUBLE) AS size, body AND len(text) % 5 = 0 AS code, body AND len(text) % 5 <> 0 AND len(text) % 11 = 0 AS bold FROM cw),
md AS (SELECT doc_id, xs[CAST(len(xs) // 2 + 1 AS BIGINT)] * 1.4 AS thr FROM (SELECT doc_id, list_sort(list(size)) AS xs FROM cs GROUP BY doc_id)),
wl AS (SELECT doc_id, p, y, string_agg(text, ' ' ORDER BY w) AS text FROM cs GROUP BY doc_id, p, y),
wp AS (SELECT doc_id, p, string_agg(text, chr(10) ORDER BY y) AS text FROM wl GROUP BY doc_id, p),
b1 AS (SELECT doc_id, p, y, thr, string_agg(text, ' ' ORDER BY w) AS text, max(size) AS size, bool_or(code) AS code, bool_or(bold) AS bold FROM cs JOIN md USING (doc_id) WHERE body AND NOT (regexp_full_match(text, '\d+') AND size >= thr) GROUP BY doc_id, p, y, thr),
b2 AS (SELECT *, len(text) < 80 AND (size >= thr OR (bold AND regexp_replace(lower(text), '[.,:;]+$', '') NOT IN (""" + ", ".join(f"'{w}'" for w in (*V.BOLD_LABELS, *V.RUNNING_HEADERS)) + r""") AND text NOT LIKE '%:')) AS head,
    coalesce(lag(code) OVER o, false) AS before, coalesce(lead(code) OVER o, false) AS after FROM b1 WHERE NOT regexp_matches(text, '^\d*$') WINDOW o AS (PARTITION BY doc_id, p ORDER BY y)),
bl AS (SELECT doc_id, p, y, 1 AS m, text, head FROM b2 UNION ALL SELECT doc_id, p, y, 0, '[CODE]', false FROM b2 WHERE code AND NOT before UNION ALL SELECT doc_id, p, y, 2, '[/CODE]', false FROM b2 WHERE code AND NOT after),
bp AS (SELECT doc_id, p, string_agg(text, chr(10) ORDER BY y, m) AS text FROM bl GROUP BY doc_id, p),
tc AS (SELECT doc_id, k, CASE WHEN k % 4 <> 0 THEN CAST(2 * k AS VARCHAR) END AS number, 'Topic words ' || k AS title FROM (SELECT doc_id, unnest(range(1, CAST(ceil(pages / 3) AS BIGINT) + 1)) AS k FROM pg WHERE doc_id % 4 = 0))"""
#: The fold over entries: e is how many are done, cur the cursor; hits are the pages that name an entry, wherever they stand.
LOCATED = r"""hh AS (SELECT doc_id, p, lower(substr(text, 1, 400)) AS head FROM wp WHERE doc_id % 4 = 0),
hits AS (SELECT doc_id, k, list(p ORDER BY p) AS ps FROM tc JOIN hh USING (doc_id) WHERE p > 0 AND CAST(contains(head, 'topic') AS INTEGER) + CAST(contains(head, 'words') AS INTEGER) >= 2
    AND (number IS NULL OR regexp_matches(head, '^\s*chapter\s+' || number || '\b') OR regexp_matches(head, '^\s*' || number || '\s+\S')) GROUP BY doc_id, k),
en AS (SELECT doc_id, k, number, title, coalesce(ps, []) AS ps FROM tc LEFT JOIN hits USING (doc_id, k) WHERE doc_id IN (SELECT doc_id FROM tc GROUP BY doc_id HAVING count(*) >= 2)),
fold AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS e, 1 AS cur, CAST(NULL AS INTEGER) AS hit FROM en
    UNION ALL SELECT f.doc_id, f.e + 1, coalesce(list_filter(en.ps, lambda q: q >= f.cur)[1] + 1, f.cur), list_filter(en.ps, lambda q: q >= f.cur)[1] FROM fold f JOIN en ON en.doc_id = f.doc_id AND en.k = f.e + 1),
lo AS (SELECT f.doc_id, CAST(en.k - 1 AS INTEGER) AS ord, CASE WHEN number IS NULL THEN title ELSE 'Chapter ' || number || ': ' || title END AS heading, f.hit AS start FROM fold f JOIN en ON en.doc_id = f.doc_id AND en.k = f.e
    WHERE f.hit IS NOT NULL QUALIFY count(*) OVER (PARTITION BY f.doc_id) >= 2)"""
CASCADE = r"""s0 AS (SELECT doc_id, heading, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), pages) AS stop FROM lo JOIN pg USING (doc_id)),
s1 AS (SELECT doc_id, heading, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), pages) AS stop, pages FROM (SELECT doc_id, pages, 'Part ' || o AS heading, least(o // 2 * 2, pages - 1) AS start FROM (SELECT doc_id, pages, unnest(range(0, 2 * pages + 1)) AS o FROM pg WHERE doc_id % 4 = 1)
    QUALIFY row_number() OVER (PARTITION BY doc_id, start ORDER BY o) = 1) QUALIFY count(*) OVER (PARTITION BY doc_id) >= 2),
um AS (SELECT doc_id, p, upper(regexp_extract(substr(text, 1, 200), '(?i)UNIT\s*[-–]?\s*([IVX]+|\d+)', 1)) AS mark, regexp_extract(substr(text, 1, 300), '(?i)UNIT\s*[-–]?\s*([IVX]+|\d+)\s*([^\n]*)', 2) AS after FROM wp),
un AS (SELECT doc_id, p, CASE """ + " ".join(f"WHEN mark = '{r}' THEN {n}" for r, n in V.ROMAN_UNITS.items()) + r""" ELSE try_cast(mark AS INTEGER) END AS unit, trim(regexp_replace(substr(trim(after), 1, 80), '^[\s\-–:]+', '')) AS title FROM um WHERE mark <> ''),
uu AS (SELECT doc_id, p AS start, 'Unit ' || unit || CASE WHEN title <> '' THEN ': ' || title ELSE '' END AS heading FROM (SELECT *, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY unit), true) AS up FROM (SELECT * FROM un WHERE unit IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY p) = 1))
    QUALIFY bool_and(up) OVER (PARTITION BY doc_id) AND count(*) OVER (PARTITION BY doc_id) >= 2),
s2 AS (SELECT doc_id, heading, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), pages) AS stop FROM uu JOIN pg USING (doc_id)),
rg AS (SELECT 0 AS tier, * FROM s0 UNION ALL SELECT 0, doc_id, 'Frontmatter', 0, min(start) FROM s0 GROUP BY doc_id HAVING min(start) > 0
    UNION ALL SELECT 1, doc_id, heading, start, stop FROM s1 UNION ALL SELECT 2, * FROM s2 UNION ALL SELECT 2, doc_id, 'Frontmatter', 0, min(start) FROM s2 GROUP BY doc_id HAVING min(start) > 0),
r1 AS (SELECT tier, rg.doc_id, heading, start, """ + r"regexp_replace(string_agg(text, chr(10) || chr(10) ORDER BY p), '^\s+|\s+$', '', 'g')" + r""" AS text FROM rg JOIN bp ON rg.doc_id = bp.doc_id AND p >= start AND p < stop GROUP BY ALL),
ss AS (SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY p, y, m) AS s FROM bl),
r3 AS (SELECT 3 AS tier, doc_id, max(text) FILTER (head) AS heading, s AS start, string_agg(text, chr(10) ORDER BY p, y, m) FILTER (NOT head) AS text FROM ss GROUP BY doc_id, s HAVING count(*) FILTER (NOT head) > 0),
rr AS (SELECT * FROM r1 WHERE text <> '' UNION ALL SELECT * FROM r3),
nn AS (SELECT tier, doc_id, count(*) AS n FROM rr GROUP BY tier, doc_id),
tz AS (SELECT doc_id, count(*) AS toc FROM tc GROUP BY doc_id UNION ALL SELECT doc_id, 12 FROM pg WHERE doc_id % 8 = 5),
ok AS (SELECT doc_id, min(tier) AS tier FROM nn LEFT JOIN tz USING (doc_id) WHERE tier IN (0, 3) OR toc IS NULL OR abs(n - toc) <= 2 GROUP BY doc_id)"""
