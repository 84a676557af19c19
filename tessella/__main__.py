"""python -m tessella --input FOLDER --output FOLDER: evaluates courses.

The input folder holds what is known of the courses as tables (.parquet): `words` with `outline` and `tables` if there are any, or `blocks`
(doc_id, block_idx, heading, text); or else PDF files, read by --parser. Scores come from recorded answers, `responses` (doc_id, ord, raw) and
`course` (doc_id, raw, or scores, reasoning and overall_score), or from --model, a callable that is asked batch by batch and once for each course.
Documents go to FOLDER/<source>_evaluation.json, failures of single courses to FOLDER/errors.parquet, and the log to FOLDER/evaluate.log.
"""

from __future__ import annotations

import argparse
import logging
import os
import sys
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import values as V
from tessella.operators import aggregate, blocks, errors, metadata, scoring
from tessella.plans import cascade, evaluation
from tessella.sources import answers, course_source, readers, sinks
from tessella.streaming import scoring as live


def options(args: list[str] | None) -> argparse.Namespace:
    """The options given, those of the preset, or the defaults, in this order."""
    parser = argparse.ArgumentParser(prog="tessella", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--input", default="")
    parser.add_argument("--output", default="output")
    parser.add_argument("--config", default="", help="rubrics in YAML, for requests to a model")
    parser.add_argument("--limit", type=int, default=0, help="segments of each course; 0 for all")
    parser.add_argument("--metadata", default="", help="JSON files, one a course")
    parser.add_argument("--model", default="", help="module:callable that answers a prompt; recorded answers if it isn't given")
    parser.add_argument("--ai", default="", help="module:callable, or several with commas between, that fill what metadata lack")
    parser.add_argument("--parser", default="", help="module:callable that opens a PDF file")
    parser.add_argument("--metadata-only", action="store_true", help="write <source>_metadata.json and stop")
    parser.add_argument("--preset", default="", help="a table of --presets: these options under other names, and settings of Spark under [NAME.spark]")
    parser.add_argument("--presets", default="presets.toml")
    first = parser.parse_args(args)
    spark = {}
    if first.preset:
        with open(first.presets, "rb") as f:
            found = tomllib.load(f)
        if first.preset not in found:
            parser.error(f"{first.presets} has no preset {first.preset}; it has {', '.join(sorted(found))}")
        own = {k.replace("-", "_"): v for k, v in found[first.preset].items()}
        spark = flat(own.pop("spark", {}))
        if unknown := sorted(set(own) - set(vars(first))):
            parser.error(f"preset {first.preset} has options that don't exist: {', '.join(unknown)}")
        parser.set_defaults(**own)
    given = parser.parse_args(args)
    if not given.input:
        parser.error("--input is missing")
    given.spark = spark
    return given


def flat(settings: dict, before: str = "spark") -> dict[str, str]:
    """Settings of Spark by their full names; a table of tables is a name with dots."""
    out = {}
    for k, v in settings.items():
        out |= flat(v, f"{before}.{k}") if isinstance(v, dict) else {f"{before}.{k}": str(v).lower() if isinstance(v, bool) else str(v)}
    return out


def logger(folder: str) -> logging.Logger:
    log = logging.getLogger("tessella")
    log.setLevel(logging.INFO)
    log.handlers.clear()
    for handler in (logging.FileHandler(f"{folder}/evaluate.log", encoding="utf-8"), logging.StreamHandler(sys.stdout)):
        handler.setFormatter(logging.Formatter("%(asctime)s [%(levelname)s] %(name)s: %(message)s"))
        log.addHandler(handler)
    return log


class Tables:
    """The tables of the input folder, read if they are there."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.fs, self.at = answers.file_system(self.folder)

    def get(self, name: str) -> DataFrame | None:
        there = self.fs.get_file_info(f"{self.at}/{name}.parquet").type.name != "NotFound"
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet") if there else None


def described(config: readers.EngineConfig, words: DataFrame | None, docs: DataFrame, providers: list) -> DataFrame:
    """Each course's metadata: given ones first, then what patterns and printed contents tell, then what providers answer."""
    spark = docs.sparkSession
    own = metadata.conformed(docs)
    if words is not None:
        texts = metadata.cover_and_raw(words)
        found = metadata.heuristics(texts).join(metadata.title_by_size(words).withColumnRenamed("title", "large"), "doc_id", "left")
        entries = blocks.contents_entries(cascade.whole_pages(words))
        entry = F.struct(F.col("number").alias("chapter_number"), "title", F.col("page_number").cast("int").alias("page_number"))
        toc = entries.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", entry.alias("e")))), lambda x: x["e"]).alias("toc"))
        found = found.join(toc, "doc_id", "left").withColumn("title", F.coalesce(F.nullif("large", F.lit("")), "title")).drop("large")
        own = metadata.merged(found, own)
        if providers:
            asked = evaluation.kept(metadata.enriched(metadata.prompts(texts, "Fill the fields of this course's metadata as JSON."), providers))
            own = metadata.merged(own, metadata.merged(metadata.parse_response(errors.good(asked)), own))
    given = readers.json_metadata(spark, config.metadata) if config.metadata else None
    return metadata.merged(given, own) if given is not None else own


def main(args: list[str] | None = None) -> None:
    given = options(args)
    config = readers.EngineConfig(given.input, given.output, given.config or "rubrics.yaml", given.limit, given.model, given.metadata, bool(given.ai))
    os.makedirs(config.output, exist_ok=True)
    log = logger(config.output)
    spark = SparkSession.builder.appName("tessella").config(map=given.spark).getOrCreate()
    tables = Tables(spark, config.input)
    words, rows, failed = tables.get("words"), tables.get("blocks"), []
    outline = tables.get("outline")
    if words is None and rows is None:
        course_source.register(spark)
        if not course_source.pdf_files(config.input):
            log.warning("no PDF files in %s", config.input)
            return
        read = lambda kind: evaluation.kept(spark.read.format(f"course_{kind}").option("parser", given.parser).load(config.input))
        tagged, entries = read("words"), read("outline")
        failed += [errors.bad(tagged, "words"), errors.bad(entries, "outline")]
        words, outline = errors.good(tagged), errors.good(entries)
    docs = (words if rows is None else rows).select("doc_id").distinct()
    suffix = F.lit(".pdf") if tables.get("words") is None and rows is None else F.lit("")
    docs = docs.withColumn("source", F.concat(F.col("doc_id").cast("string"), suffix))
    providers = [course_source.parser_of(name) for name in given.ai.split(",") if name]
    meta = evaluation.kept(described(config, words, docs, providers))
    if given.metadata_only:
        sinks.write_files(sinks.metadata_json(meta), config.output)
        return
    if rows is None:
        counts = words.groupBy("doc_id").agg((F.max("page_idx") + 1).alias("pages"))
        toc = meta.select("doc_id", F.posexplode("toc").alias("ord", "e")).select("doc_id", "ord", F.col("e.chapter_number").alias("number"), F.col("e.title").alias("title"))
        outline = spark.createDataFrame([], readers.OUTLINE) if outline is None else outline
        rows = cascade.course_blocks(words, counts, toc, outline, tables.get("tables")).drop("tier")
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    responses, course = tables.get("responses"), tables.get("course")
    if config.model:
        responses = asked(spark, given, rows, meta, log)
    done = evaluation.run(rows, meta, responses, course_answers(spark, given, config, course, rows, meta, responses), limit=config.limit, model=config.model)
    sinks.write_json(done.documents, config.output)
    for side in failed:
        done = evaluation.Evaluation(done.documents, done.errors.unionByName(side), done.segments, done.metrics)
    done.errors.write.mode("overwrite").parquet(f"{config.output}/errors.parquet")
    for name, n in done.metrics.items():
        log.info("%s: %s", name, n)
    for r in spark.read.parquet(f"{config.output}/errors.parquet").limit(100).collect():  # the first for the log; all are in the table
        log.error("%s failed in %s: %s", r.doc_id, r.step, r.message)


def rubrics_of(spark: SparkSession, path: str, gate: str) -> str:
    if not path:
        return ""
    found = scoring.rubric_text(readers.rubrics(spark, path)).filter(F.col("gate") == gate).first()
    return found.text if found else ""


def asked(spark: SparkSession, given: argparse.Namespace, rows: DataFrame, meta: DataFrame, log: logging.Logger) -> DataFrame:
    """Answers of the model to all batches of all courses, asked in turn."""
    segments = aggregate.first_segments(blocks.number_segments(errors.good(evaluation.kept(blocks.merge_blocks(rows, chunked=True, errors=True)))), given.limit)
    requests = scoring.batch_requests(segments, scoring.system_prompts(meta, rubrics_of(spark, given.config, "module")))
    at = f"{given.output.rstrip('/')}/_live"
    requests.write.mode("overwrite").parquet(f"{at}/requests")
    rounds = live.score_in_turn(spark, f"{at}/requests", f"{at}/responses", f"{at}/prompts", f"{at}/checkpoint", course_source.parser_of(given.model))
    log.info("all batches are answered after %s rounds", rounds)
    return spark.read.schema(live.RESPONSES).parquet(f"{at}/responses").withColumnRenamed("batch", "ord")


def course_answers(spark: SparkSession, given: argparse.Namespace, config: readers.EngineConfig, course: DataFrame | None, rows: DataFrame, meta: DataFrame, responses: DataFrame) -> DataFrame:
    """doc_id, scores, reasoning, overall_score of courses: recorded ones, or the model's."""
    if config.model:
        segments = aggregate.first_segments(blocks.number_segments(errors.good(evaluation.kept(blocks.merge_blocks(rows, chunked=True, errors=True)))), given.limit)
        evaluated = evaluation.kept(scoring.match_responses(segments, scoring.parse_responses(responses)))
        having = evaluated.filter("segment_type = 'instructional'").select("doc_id").distinct()
        prompts = aggregate.course_prompts(evaluated, segments, meta, rubrics_of(spark, given.config, "course")).join(having, "doc_id", "left_semi")
        store = answers.AnswerStore(spark, f"{given.output.rstrip('/')}/_answers", given.model)
        course = store.score(prompts.withColumn("batch", F.lit(0)), course_source.parser_of(given.model)).select("doc_id", "raw")
    if course is None:
        course = spark.createDataFrame([], "doc_id string, raw string")
    if "raw" not in course.columns:
        return course
    found = scoring.parse_course_response(course)
    scores = F.struct(*(F.coalesce(F.col("scores")[d].try_cast("double").cast("int"), F.lit(0)).alias(d) for d in V.COURSE_DIMS))
    reasons = F.struct(*(F.coalesce(F.col("reasoning")[f"{d}_rationale"], F.lit("")).alias(f"{d}_rationale") for d in V.COURSE_DIMS))
    return found.select("doc_id", scores.alias("scores"), reasons.alias("reasoning"), "overall_score")


if __name__ == "__main__":
    main()
