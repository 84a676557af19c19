"""Where courses come from: files, metadata in several forms, rubrics. Adapters for PDF text and models are plain callables."""

from __future__ import annotations

import logging
import queue
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import metadata as M
from tessella.operators.errors import message

WORDS = "doc_id string, page_idx int, word_seq int, text string, x0 double, x1 double, top double, bottom double, doctop double, size double, fontname string, page_h double"
OUTLINE = "doc_id string, ord int, level int, title string, page_idx int"
#: Seconds that an address has to answer.
FETCH_SECONDS = 10


@dataclass(frozen=True)
class EngineConfig:
    """What a run is given: where courses lie, where results go, rubrics, how many segments (0: all), the model and the metadata."""

    input: str
    output: str = "output"
    config: str = "rubrics.yaml"
    limit: int = 0
    model: str = ""
    metadata: str = ""
    ai: bool = False


def course_files(spark: SparkSession, path: str) -> DataFrame:
    """path, doc_id, content of the PDF files under a folder (whatever the case of their suffix), or of one file; an error if there is no such path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]+)\.(?i:pdf)$", 1).alias("doc_id"), "content")


def parsed(files: DataFrame, schema: str, rows_of: Callable[[str, bytes], list[tuple]]) -> DataFrame:
    """The rows of each file and a null `error`; of a file that fails, one row with its doc_id and the failure (see operators/errors.py)."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, content in zip(pdf["doc_id"], pdf["content"], strict=True):
                try:
                    found = [(*r, None) for r in rows_of(doc, content)]
                except Exception as e:  # one course's failure is not another's
                    found = [(doc, *(None,) * (len(columns) - 1), message(e))]
                yield pd.DataFrame(found, columns=[*columns, "error"], dtype=object)

    return files.select("doc_id", "content").mapInPandas(run, f"{schema}, error string")


def words_of(files: DataFrame, reader: Callable[[bytes], Iterator[tuple]]) -> DataFrame:
    """The words of each file by a reader that yields all columns of WORDS but the first, tagged with `error`."""
    return parsed(files, WORDS, lambda doc, content: [(doc, *r) for r in reader(content)])


def outline_of(files: DataFrame, reader: Callable[[bytes], Iterator[tuple[int, str, int]]]) -> DataFrame:
    """doc_id, ord, level, title, page_idx of each file's outline, tagged with `error`; a file without one gives no row."""
    return parsed(files, OUTLINE, lambda doc, content: [(doc, i, *r) for i, r in enumerate(reader(content))])


def with_ocr(words: DataFrame, pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """doc_id, page_idx, line of recognised text, for pages without words. ocr: doc_id, page_idx, text."""
    bare = pages.join(words.select("doc_id", "page_idx").distinct(), ["doc_id", "page_idx"], "left_anti")
    lines = ocr.join(bare.select("doc_id", "page_idx"), ["doc_id", "page_idx"], "left_semi").select("doc_id", "page_idx", F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter(~T.is_page_number("line"))


def json_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One object a file; unknown keys dropped, the file's name as default source, a broken file as an empty row."""
    rows = spark.read.text(path, wholetext=True).withColumn("name", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    rows = rows.select(F.regexp_replace("name", r"\.json$", "").alias("doc_id"), F.col("value").alias("raw"), "name")
    parsed = M.parse_response(rows)
    return parsed.join(rows.select("doc_id", "name"), "doc_id").withColumn("source", F.coalesce(F.nullif("source", F.lit("")), "name")).drop("name")


def text_metadata(spark: SparkSession, path: str) -> DataFrame:
    """`key: value` lines; the last of a key wins, lists are split on commas."""
    rows = spark.read.text(path, wholetext=True).withColumn("doc_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1))
    lines = rows.select("doc_id", F.posexplode(F.split("value", "\n")).alias("n", "line")).filter(F.instr("line", ":") > 0)
    key = F.replace(T.stripped(F.lower(F.substring_index("line", ":", 1))), F.lit(" "), F.lit("_"))
    value = T.stripped(F.element_at(F.split("line", ":", 2), 2))
    last = lines.select("doc_id", key.alias("k"), value.alias("v"), "n").groupBy("doc_id", "k").agg(F.max_by("v", "n").alias("v"))
    wide = last.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    split = lambda v: F.filter(F.transform(F.split(v, ","), T.stripped), lambda x: x != "")
    return M.conformed(wide.select("doc_id", *(F.col("m")[c].alias(c) for c in M.TEXTS), *(split(F.col("m")[c]).alias(c) for c in M.LISTS)))


def html_metadata(spark: SparkSession, doc_id: str) -> DataFrame:
    """An empty row: HTML metadata is not read, only named as the source."""
    return M.conformed(spark.createDataFrame([(doc_id, f"{doc_id}.pdf")], "doc_id string, source string"))


def within_seconds(fetch: Callable[[str], str], url: str, seconds: float) -> str:
    """What fetch gives, or TimeoutError: a fetch that hangs is left behind in its thread."""
    with_answer: queue.Queue = queue.Queue()

    def run() -> None:
        try:
            with_answer.put((fetch(url), None))
        except Exception as e:
            with_answer.put((None, e))

    threading.Thread(target=run, daemon=True).start()
    try:
        body, failure = with_answer.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError(f"{url} didn't answer in {seconds} s") from None
    if failure:
        raise failure
    return body


def url_metadata(spark: SparkSession, doc_id: str, url: str, fetch: Callable[[str], str], seconds: float = FETCH_SECONDS) -> DataFrame:
    """A body that begins with { is JSON; any other names the address as source, a failed fetch, or one that takes too long, the course's file."""
    try:
        body = within_seconds(fetch, url, seconds)
    except Exception as e:
        logging.getLogger("tessella").warning("%s: %s", url, message(e))
        return html_metadata(spark, doc_id)
    if body.lstrip().startswith("{"):
        return M.parse_response(spark.createDataFrame([(doc_id, body)], "doc_id string, raw string"))
    return M.conformed(spark.createDataFrame([(doc_id, url)], "doc_id string, source string"))


def from_source(spark: SparkSession, doc_id: str, source: str, fetch: Callable[[str], str], pdf: Callable[[str], DataFrame]) -> DataFrame:
    """The metadata that a source named by the user holds: an address, or a file read by its suffix (any but these as PDF); an empty row if it is missing."""
    if source.lower().startswith(("http://", "https://", "www.")):
        return url_metadata(spark, doc_id, source, fetch)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(source)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return M.conformed(spark.createDataFrame([(doc_id,)], "doc_id string"))
    suffix = source.rsplit(".", 1)[-1].lower()
    if suffix == "html":
        return html_metadata(spark, doc_id)
    found = {"json": json_metadata, "txt": text_metadata}.get(suffix)
    return found(spark, source).withColumn("doc_id", F.lit(doc_id)) if found else pdf(source)


def by_precedence(sources: list[DataFrame]) -> DataFrame:
    """Each course's row from the first source that has one."""
    out = M.conformed(sources[0])
    for s in sources[1:]:
        out = out.unionByName(M.conformed(s).join(out.select("doc_id"), "doc_id", "left_anti"))
    return out


def rubrics(spark: SparkSession, path: str) -> DataFrame:
    """gate, ord, id, name, description, weight, criteria, questions, guide (in the file's order) from a YAML file."""
    import yaml

    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f) or {}
    rows = []
    for gate in ("module", "course"):
        for i, r in enumerate(found.get(f"{gate}_rubrics") or []):
            rows.append((gate, i, r["id"], r.get("name", r["id"]), (r.get("description") or "").strip(), float(r.get("weight", 1.0)), r.get("criteria") or [], r.get("evaluation_questions") or [], list((r.get("scoring_guide") or {}).items())))
    return spark.createDataFrame(rows, "gate string, ord int, id string, name string, description string, weight double, criteria array<string>, questions array<string>, guide array<struct<band:string,text:string>>")
