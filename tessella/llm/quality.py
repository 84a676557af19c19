"""Quality rules with cross-document line frequency; DataFrame functions only.

Null or blank texts have no words, fail the base rule and are not kept. Repeated rows each get
their row. Columns other than doc_id, text and source are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Tables, keep

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A line is boilerplate of its host if it stands in more distinct texts than both of these.
MIN_LINE_TEXTS = 20
LINE_TEXTS_PERCENT = 5
#: A document is depleted if less than this share of its words stands outside boilerplate.
LEFT_PERCENT = 20
SALTS = 16


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def base_rules(df: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to rows with `body` (not null)."""
    body = F.col("body")
    df = df.withColumn("words", words_of(body)).withColumn("n_words", F.size("words"))
    df = df.withColumn("lines", F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("hashes", F.when(F.col("n_words") >= 5, F.transform("words", lambda w: F.xxhash64(w))))
    df = df.withColumn("grams", F.when(F.col("n_words") >= 5, F.transform(F.sequence(F.lit(0), F.col("n_words") - 5), lambda i: F.xxhash64(*(F.get("hashes", i + k) for k in range(5))))))
    df = df.withColumn("has_repeats", F.coalesce(F.size(F.array_distinct("grams")) < F.size("grams"), F.lit(False)))
    df = df.select(
        *(c for c in df.columns if c not in ("words", "lines", "hashes", "grams", "body", "n_words", "has_repeats")),
        F.col("n_words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.regexp_replace("body", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("has_repeats"), F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("by_gram"),
    )
    same = lambda j, k: F.coalesce(F.get("by_gram", j)["h"] == F.get("by_gram", k)["h"], F.lit(False))
    df = df.withColumn("starts", F.when(F.col("by_gram").isNotNull(), F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size("by_gram") - 1), lambda j: same(j, j - 1) | same(j, j + 1)), lambda j: F.get("by_gram", j)["i"]))))
    covered = F.aggregate(F.sequence(F.lit(0), F.size("starts") - 1), F.lit(0).cast("long"), lambda n, k: n + F.least(F.lit(5), F.coalesce(F.get("starts", k + 1) - F.get("starts", k), F.lit(5))))
    df = df.withColumn("n_repeat_words", F.when(F.col("starts").isNull(), F.lit(0).cast("long")).otherwise(covered)).drop("by_gram", "starts")
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def boilerplate_words(docs: DataFrame, tables: Tables) -> DataFrame:
    """host, text_key, lost, gone: words of each text that stand in lines above the limits of its host, and the places of these lines.

    Exact copies are one text, so a copied document doesn't make its own lines boilerplate.
    """
    lines = docs.select("host", "text_key", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    norm = F.lower(F.trim(F.regexp_replace("line", f"{SPACE}+", " ")))
    lines = lines.select("host", "text_key", "pos", norm.alias("line")).filter("line <> ''")
    lines = lines.select("host", "text_key", "pos", F.xxhash64("line").alias("line_key"), (F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1).alias("n"))
    lines = lines.groupBy("host", "text_key", "pos").agg(F.first("line_key").alias("line_key"), F.first("n").alias("n"))
    lines = tables.write("lines", lines)
    texts = docs.select("host", "text_key").distinct().groupBy("host").agg(F.count("*").alias("texts"))
    often = lines.select("host", "line_key", "text_key").distinct().groupBy("host", "line_key").agg(F.count("*").alias("seen")).filter(F.col("seen") > MIN_LINE_TEXTS)
    often = often.join(texts, "host").filter(100 * F.col("seen") > LINE_TEXTS_PERCENT * F.col("texts")).select("host", "line_key")
    often = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hit = lines.withColumn("salt", F.pmod("text_key", F.lit(SALTS)).cast("int")).join(often, ["host", "line_key", "salt"])
    return hit.groupBy("host", "text_key").agg(F.sum("n").alias("lost"), F.collect_list("pos").alias("gone"))


def judged(docs: DataFrame, carry: tuple[str, ...], places: bool) -> DataFrame:
    """own, the base columns, lost_words and kept, and with `places` the lines to remove as gone (null for none)."""
    tables = Tables(docs.sparkSession, "quality")
    src = docs.select(F.struct(*carry).alias("own"), F.coalesce("text", F.lit("")).alias("body"), F.xxhash64(F.coalesce("source", F.lit(""))).alias("host"))
    src = src.withColumn("text_key", F.xxhash64("body"))
    lost = boilerplate_words(src, tables)
    lost = keep(lost if places else lost.drop("gone"))
    tables.drop()
    lost = lost.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = base_rules(src).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    rows = rows.join(lost, ["host", "text_key", "salt"], "left")
    lost_words = F.coalesce("lost", F.lit(0)).cast("long")
    kept = ~F.col("base_failed") & (100 * (F.col("n_words") - lost_words) >= LEFT_PERCENT * F.col("n_words"))
    return rows.select("own", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", lost_words.alias("lost_words"), kept.alias("kept"), *(["gone"] if places else []))


def quality_rules(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs: doc_id, text, source. Returns `carry`, the base columns, lost_words and kept, a row per row of docs."""
    rows = judged(docs, carry, places=False)
    return rows.select("own.*", *(c for c in rows.columns if c != "own"))


def kept_documents(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The rows of docs that the rules keep, without the lines above the limits of their host; n_chars follows."""
    rows = judged(docs, columns, places=True).filter("kept")
    left = F.array_join(F.filter(F.split("own.text", "\n"), lambda line, i: ~F.array_contains("gone", i)), "\n")
    rows = rows.withColumn("left", F.when(F.col("gone").isNotNull(), left))
    fresh = {"text": F.coalesce("left", "own.text"), "n_chars": F.coalesce(F.length("left").cast("long"), F.col("own.n_chars"))}
    return rows.select(*(fresh[c].alias(c) if c in fresh else F.col(f"own.{c}") for c in columns))


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body, coalesce(source, '') AS host FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT *, len(words) AS n, CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' ')) ELSE [] END AS grams FROM w),
e AS (SELECT doc_id, body, unnest(grams) AS gram, generate_subscripts(grams, 1) AS i FROM g WHERE len(list_distinct(grams)) < len(grams)),
r AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM
    (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM e) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(5, coalesce(after - i, 5))) AS n_repeat_words FROM r GROUP BY doc_id),
l AS (SELECT DISTINCT host, body, i, trim(lower(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line FROM
    (SELECT host, body, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM d)),
n AS (SELECT host, count(DISTINCT body) AS texts FROM d GROUP BY host),
o AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT body) AS seen FROM l WHERE line <> '' GROUP BY host, line) JOIN n USING (host)
    WHERE seen > {MIN_LINE_TEXTS} AND 100 * seen > {LINE_TEXTS_PERCENT} * texts),
lost AS (SELECT host, body, sum(len(string_split(line, ' '))) AS lost FROM l JOIN o USING (host, line) GROUP BY host, body),
b AS (SELECT doc_id, n, len(array_to_string(words, '')) AS word_chars, len(body) - len(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
    FROM g LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (host, body))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
    (n < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n) AS base_failed, CAST(lost AS BIGINT) AS lost_words,
    NOT (n < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n) AND 100 * (n - lost) >= {LEFT_PERCENT} * n AS kept
FROM b
"""
