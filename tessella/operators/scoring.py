"""Batches, prompts, responses and scores of segments; recorded responses or any Scorer stand for live models."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions import values as V
from tessella.functions.numbers import py_round
from tessella.operators.errors import message


def by_id():
    return Window.partitionBy("doc_id").orderBy("segment_id")


def with_batches(segments: DataFrame, size: int = V.BATCH_SIZE) -> DataFrame:
    """Adds batch (from 0): runs of `size` segments of all types in order."""
    return segments.withColumn("batch", F.floor((F.row_number().over(by_id()) - 1) / size).cast("int"))


def cut_narrative(summaries: Column) -> Column:
    """The last summaries in one line, cut to a length."""
    n = F.size(summaries)
    last = F.slice(summaries, F.greatest(F.lit(1), n - V.NARRATIVE_SUMMARIES + 1), F.lit(V.NARRATIVE_SUMMARIES))
    text = F.array_join(last, V.NARRATIVE_GLUE)
    return F.when(F.length(text) > V.NARRATIVE_CHARS, F.concat(F.substring(text, 1, V.NARRATIVE_CHARS), F.lit("..."))).otherwise(text)


def narratives(evaluated: DataFrame) -> DataFrame:
    """doc_id, batch, narrative: the last summaries of earlier batches, cut to a length.

    Each batch keeps its own last few; a window over a course's batches then carries lists of as many at most, by an ordered fold
    over their array, so the work follows the number of batches and not its square.
    """
    last = V.NARRATIVE_SUMMARIES
    said = F.array_sort(F.collect_list(F.when(F.coalesce("summary", F.lit("")) != "", F.struct("segment_id", "summary"))))
    own = evaluated.groupBy("doc_id", "batch").agg(F.transform(said, lambda x: x["summary"]).alias("said"))
    own = own.withColumn("said", F.slice("said", F.greatest(F.lit(1), F.size("said") - last + 1), F.lit(last)))
    courses = own.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("batch", "said"))).alias("batches"))
    tail = lambda xs: F.slice(xs, F.greatest(F.lit(1), F.size(xs) - last + 1), F.lit(last))
    texts, rows = "array<string>", "array<struct<batch:int,past:array<string>>>"
    start = F.struct(F.expr(f"CAST(array() AS {texts})").alias("past"), F.expr(f"CAST(array() AS {rows})").alias("out"))
    step = lambda s, b: F.struct(
        tail(F.concat(s["past"], b["said"])).alias("past"),
        F.concat(s["out"], F.array(F.struct(b["batch"].cast("int").alias("batch"), s["past"].alias("past")))).alias("out"),
    )
    each = courses.select("doc_id", F.inline(F.aggregate("batches", start, step, lambda s: s["out"])))
    return each.select("doc_id", "batch", cut_narrative(F.col("past")).alias("narrative"))


def with_previous(segments: DataFrame) -> DataFrame:
    """Adds previous_id: the instructional segment before this one in its batch."""
    return segments.withColumn("previous_id", F.lag("segment_id").over(Window.partitionBy("doc_id", "batch").orderBy("segment_id")))


def batch_prompts(segments: DataFrame) -> DataFrame:
    """doc_id, batch, prompt of the instructional segments; a batch is what is gathered. Headings are left out on purpose."""
    rows = with_previous(with_batches(segments).filter("segment_type = 'instructional'"))
    part = F.concat(F.lit("--- SEGMENT ID: "), F.col("segment_id").cast("string"), F.lit(" ---\n"), F.coalesce(F.concat(F.lit("[Previous segment covered: "), F.col("previous_id").cast("string"), F.lit("]\n")), F.lit("")), F.col("text"))
    in_order = F.array_sort(F.collect_list(F.struct("segment_id", part.alias("part"))))
    return rows.groupBy("doc_id", "batch").agg(F.array_join(F.transform(in_order, lambda x: x["part"]), "\n\n").alias("prompt"))


PROCEDURE = """Score every segment on each rubric above and on nothing else. A rubric has five criteria, C1 to C5; give each 0 (absent), 1 (partly there) or 2 (fully there).
A rubric's score is the sum of its criteria, 0 to 10. Where the sum and the scoring guide disagree, look at the criteria again; in doubt take the lower score.
Answer in JSON: for each segment its segment_id, criteria_scores, scores, reasoning and a summary of three or four sentences: its topic, what it takes for granted,
what a reader can do after it, and how it leads on.
The text was taken from a PDF. [FIGURE], [TABLE] and [CODE] mark what stood there, [?] a character that was lost: none of it is the author's fault, nor is a heading that fits its text badly."""


def system_prompts(courses: DataFrame, rubrics: str, procedure: str = PROCEDURE) -> DataFrame:
    """courses: doc_id, title, target_audience, learning_outcomes_stated and _inferred (rows of metadata). doc_id, system: what every request of a course begins with."""
    outcomes = T.union_text("learning_outcomes_stated", "learning_outcomes_inferred")
    known = F.concat_ws("\n", F.concat(F.lit("Title: "), T.text_of("title")), F.concat(F.lit("Audience: "), T.text_of("target_audience")), F.concat(F.lit("Learning outcomes: "), outcomes))
    head = F.concat(F.lit("You review parts of a course. About the course, for reference only:\n"), known)
    return courses.select(F.col("doc_id"), F.concat_ws("\n\n", head, F.lit("Rubrics:\n" + rubrics), F.lit(procedure)).alias("system"))


def with_narrative(system: Column, narrative: Column) -> Column:
    """The system half of a request, with what earlier segments covered, if anything."""
    told = F.concat(F.lit("\n\nThe course so far: "), narrative, F.lit("\nSay so where a segment only repeats this."))
    return F.concat(system, F.when(F.coalesce(narrative, F.lit("")) != "", told).otherwise(""))


def batch_requests(segments: DataFrame, systems: DataFrame) -> DataFrame:
    """doc_id, batch, ids, system, user for every batch: the instructional segments' ids in order, and both halves of the request but for the
    narrative, which follows from the answers before. A batch without instructional segments has no user half: nothing is asked."""
    rows = with_batches(segments)
    own = F.array_sort(F.collect_list(F.when(F.col("segment_type") == "instructional", F.col("segment_id"))))
    every = rows.groupBy("doc_id", "batch").agg(own.alias("ids"))
    asked = every.join(batch_prompts(segments).withColumnRenamed("prompt", "user"), ["doc_id", "batch"], "left")
    return asked.join(systems, "doc_id", "left").select("doc_id", "batch", "ids", F.coalesce("system", F.lit("")).alias("system"), "user")


def recorded_prompts(requests: DataFrame, evaluated: DataFrame) -> DataFrame:
    """doc_id, batch, prompt of every request whose answers are all known: what live scoring would have sent. evaluated: with batches."""
    told = requests.filter("user IS NOT NULL").join(narratives(evaluated), ["doc_id", "batch"], "left")
    return told.select("doc_id", "batch", F.concat_ws("\n\n", with_narrative(F.col("system"), F.col("narrative")), "user").alias("prompt"))


def rubric_text(rubrics: DataFrame) -> DataFrame:
    """rubrics: gate, ord, id, name, description, weight, criteria, questions, guide (band, text). gate, text: each with its weight, criteria, guide and questions, what is empty left out."""
    listed = lambda title, xs: F.when(F.size(xs) > 0, F.concat(F.lit(f"\n{title}:\n"), F.array_join(xs, "\n")))
    criteria = F.transform("criteria", lambda x, i: F.concat(F.lit("  C"), (i + 1).cast("string"), F.lit(": "), x))
    questions = F.transform("questions", lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), x))
    guide = F.transform("guide", lambda g: F.concat(F.lit("  - "), g["band"], F.lit(": "), g["text"]))
    head = F.concat(F.lit("### "), "name", F.lit(" (`"), "id", F.lit("`), weight "), F.col("weight").cast("string"))
    part = F.concat_ws("\n", head, F.nullif("description", F.lit("")), listed("Criteria, 0 to 2 each", criteria), listed("Scoring guide", guide), listed("Questions to answer first", questions))
    in_order = F.array_sort(F.collect_list(F.struct("ord", part.alias("part"))))
    return rubrics.groupBy("gate").agg(F.array_join(F.transform(in_order, lambda x: x["part"]), "\n\n").alias("text"))


def response_schema(dims: tuple[str, ...] = V.MODULE_DIMS) -> dict:
    """The contract of a response as JSON schema, from the dimensions."""
    whole = lambda top: {"type": "integer", "minimum": 0, "maximum": top}
    criteria = {"type": "object", "properties": {f"c{i}": whole(2) for i in range(1, 6)}, "required": [f"c{i}" for i in range(1, 6)]}
    keys = ("segment_id", "scores", "reasoning", "criteria_scores", "summary")
    kinds = ({"type": "integer"}, {"type": "object", "properties": {d: whole(V.TOP_SCORE) for d in dims}, "required": list(dims)}, {"type": "object", "properties": {f"{d}_rationale": {"type": "string"} for d in dims}}, {"type": "object", "properties": {d: criteria for d in dims}}, {"type": "string"})
    return {"type": "object", "properties": dict(zip(keys, kinds, strict=True)), "required": ["segment_id", "scores", "reasoning"]}


def evaluations(raw: Column | str) -> Column:
    """The evaluations in a raw response, as array<variant>: a list, what an object holds under a known key, one evaluation alone, or the first list of any object; null if there is none."""
    v = F.try_parse_json(T.without_fence(raw))
    as_list = lambda path: F.try_variant_get(v, path, "array<variant>")
    alone = F.when(F.try_variant_get(v, "$.segment_id", "string").isNotNull(), F.array(v))
    first = F.get(F.filter(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), lambda x: F.try_variant_get(x, "$", "array<variant>").isNotNull()), F.lit(0))
    return F.coalesce(as_list("$"), as_list("$.evaluations"), as_list("$.submit_module_evaluations.evaluations"), as_list("$.items"), alone, F.try_variant_get(first, "$", "array<variant>"))


def evaluation_fields(e: Column | str, dims: tuple[str, ...] = V.MODULE_DIMS) -> dict[str, Column]:
    """segment_id, scores, reasoning, criteria_scores and summary of one evaluation; scores that aren't whole numbers are null."""
    get = lambda path: F.try_variant_get(e, path, "string")
    scores = F.struct(*(T.whole_number(get(f"$.scores.{d}")).alias(d) for d in dims))
    reasons = F.struct(*(F.coalesce(get(f"$.reasoning.{d}_rationale"), F.lit("")).alias(f"{d}_rationale") for d in dims))
    criteria = F.coalesce(F.try_variant_get(e, "$.criteria_scores", "map<string,map<string,int>>"), F.expr("CAST(map() AS map<string,map<string,int>>)"))
    return {"segment_id": T.whole_number(get("$.segment_id")), "scores": scores, "reasoning": reasons, "criteria_scores": criteria, "summary": F.coalesce(get("$.summary"), F.lit(""))}


def parse_responses(responses: DataFrame, dims: tuple[str, ...] = V.MODULE_DIMS) -> DataFrame:
    """responses: doc_id, ord, raw. doc_id, ord, item, segment_id, scores, reasoning, criteria_scores, summary for each evaluation in a raw response."""
    rows = responses.select("doc_id", "ord", F.posexplode(evaluations("raw")).alias("item", "e"))
    return rows.select("doc_id", "ord", "item", *(c.alias(k) for k, c in evaluation_fields("e", dims).items()))


def summaries_in(raw: Column | str, dims: tuple[str, ...] = V.MODULE_DIMS) -> Column:
    """array<struct<segment_id, summary>> of the whole evaluations in a raw response, without exploding it."""
    def one(e: Column) -> Column:
        f = evaluation_fields(e, dims)
        whole = F.forall(F.array(*(f["scores"][d] for d in dims)), lambda x: x.isNotNull())
        return F.struct(f["segment_id"].alias("segment_id"), F.when(whole, f["summary"]).otherwise("").alias("summary"))

    return F.coalesce(F.transform(evaluations(raw), one), F.expr("CAST(array() AS array<struct<segment_id:int,summary:string>>)"))


def violations(responses: DataFrame, dims: tuple[str, ...] = V.MODULE_DIMS) -> DataFrame:
    """responses: doc_id, ord, raw. doc_id, ord, item, segment_id, rule: a row for each rule of response_schema that an evaluation breaks; `no evaluations` with a null item for a response without any.

    Rules: `segment_id`; `scores.<dim>` if it isn't a whole number from 0 to 10; `criteria.<dim>` if its five criteria aren't all 0, 1 or 2;
    `sum.<dim>` if they are, but don't add up to the score; `reasoning` if it is no object.
    """
    rows = responses.select("doc_id", "ord", F.posexplode_outer(evaluations("raw")).alias("item", "e"))
    # a null element of a list is an evaluation without anything; only a response without a list has no item
    fields = evaluation_fields("e", dims)
    rows = rows.select("doc_id", "ord", "item", F.try_variant_get("e", "$.reasoning", "map<string,variant>").isNotNull().alias("reasoned"), *(c.alias(k) for k, c in fields.items()))
    found = [F.when(F.col("segment_id").isNull(), "segment_id"), F.when(~F.col("reasoned"), "reasoning")]
    for d in dims:
        score = F.col(f"scores.{d}")
        five = F.array(*(F.col("criteria_scores")[d][f"c{k}"] for k in range(1, 6)))
        fine = F.coalesce(F.forall(five, lambda x: x.isNotNull() & x.between(0, 2)), F.lit(False))
        total = F.aggregate(five, F.lit(0), lambda n, x: n + x)
        found += [
            F.when(~F.coalesce(score.between(0, V.TOP_SCORE), F.lit(False)), f"scores.{d}"),
            F.when(~fine, f"criteria.{d}").when(score.isNotNull() & (total != score), f"sum.{d}"),
        ]
    rules = F.when(F.col("item").isNull(), F.array(F.lit("no evaluations"))).otherwise(F.array_compact(F.array(*found)))
    return rows.select("doc_id", "ord", "item", "segment_id", F.explode(rules).alias("rule"))


def parse_course_response(responses: DataFrame, dims: tuple[str, ...] = V.COURSE_DIMS) -> DataFrame:
    """responses: doc_id, raw. doc_id, scores, reasoning (maps), overall_score.

    A list gives its first element. What holds scores is, in this order, the object itself (as scores, or as a list of rubrics with id,
    score and rationale), an object under a known key, or the one object among its values.
    """
    get = F.try_variant_get
    v = F.try_parse_json(T.without_fence("raw"))
    rows = responses.select("doc_id", F.coalesce(F.get(get(v, "$", "array<variant>"), F.lit(0)), v).alias("v"))
    holds = lambda x: get(x, "$.scores", "variant").isNotNull() | get(x, "$.rubric_scores", "variant").isNotNull()
    known = [F.when(holds(get("v", f"$.{k}", "variant")), get("v", f"$.{k}", "variant")) for k in ("submit_course_evaluation", "evaluation", "result")]
    objects = F.filter(F.map_values(get("v", "$", "map<string,variant>")), lambda x: get(x, "$", "map<string,variant>").isNotNull())
    only = F.when(F.size(objects) == 1, F.get(objects, F.lit(0)))
    rows = rows.select("doc_id", F.coalesce(F.when(holds(F.col("v")), F.col("v")), *known, only, F.col("v")).alias("inner"))
    rubrics = get("inner", "$.rubric_scores", "array<variant>")
    pairs = lambda key, value: F.map_from_entries(F.transform(F.filter(rubrics, lambda x: get(x, "$.id", "string").isNotNull()), lambda x: F.struct(key(get(x, "$.id", "string")).alias("k"), value(x).alias("s"))))
    listed = pairs(lambda k: k, lambda x: F.coalesce(get(x, "$.score", "string"), F.lit("0")))
    why = pairs(lambda k: F.concat(k, F.lit("_rationale")), lambda x: F.coalesce(get(x, "$.rationale", "string"), get(x, "$.reasoning", "string"), F.lit("")))
    scores = F.coalesce(get("inner", "$.scores", "map<string,string>"), listed)
    rows = rows.select("doc_id", scores.alias("scores"), F.coalesce(get("inner", "$.reasoning", "map<string,string>"), why).alias("reasoning"))
    values = F.filter(F.transform(F.map_values("scores"), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    overall = F.when(F.size(values) > 0, py_round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))).otherwise(0.0)
    return rows.withColumn("overall_score", F.coalesce(overall, F.lit(0.0)))


def with_metadata(segments: DataFrame, metadata: DataFrame) -> DataFrame:
    """The course's row as `metadata` on each of its segments; null where a course has none. The optimizer broadcasts it if it is small."""
    columns = [c for c in metadata.columns if c != "doc_id"]
    return segments.join(metadata.select("doc_id", F.struct(*columns).alias("metadata")), "doc_id", "left")


def match_responses(segments: DataFrame, parsed: DataFrame, dims: tuple[str, ...] = V.MODULE_DIMS) -> DataFrame:
    """Every segment with its scores: the last response of its id; without a whole one it is incomplete. Other types pass by with zeros."""
    last = parsed.filter("segment_id IS NOT NULL").groupBy("doc_id", "segment_id").agg(F.max_by(F.struct("scores", "reasoning", "criteria_scores", "summary"), F.struct("ord", "item")).alias("r"))
    zeros = F.struct(*(F.lit(0).alias(d) for d in dims))
    blank = F.struct(*(F.lit("").alias(f"{d}_rationale") for d in dims))
    none = F.expr("CAST(map() AS map<string,map<string,int>>)")
    whole = F.lit(True)
    for d in dims:
        whole = whole & F.col(f"r.scores.{d}").isNotNull()
    own = segments["segment_type"] == "instructional"
    ok = F.col("ok")
    scored = segments.filter(own).join(last, ["doc_id", "segment_id"], "left").withColumn("ok", F.coalesce(whole, F.lit(False)))
    given = {"scores": zeros, "reasoning": blank, "criteria_scores": none, "summary": F.lit("")}
    scored = scored.select(*segments.columns, *(F.when(ok, F.col(f"r.{c}")).otherwise(empty).alias(c) for c, empty in given.items()), (~ok).alias("incomplete"))
    passed = segments.filter(~own).select(*segments.columns, *(empty.alias(c) for c, empty in given.items()), F.lit(False).alias("incomplete"))
    return scored.unionByName(passed)


def call_with_retry(call: Callable[[str], str], prompt: str, tries: int = 3, wait: float = 5.0, sleep: Callable[[float], None] = time.sleep, every: bool = False) -> str:
    """Tries again after bad JSON or a passing failure of the service (`every`: after any failure), waiting twice as long each time; else raises."""
    for n in range(tries):
        try:
            return call(prompt)
        except Exception as e:
            passing = every or isinstance(e, ValueError) or any(s in str(e).lower() for s in V.RETRY_SIGNS)
            if not passing or n == tries - 1:
                raise
            sleep(wait * 2**n)
    raise AssertionError


def score_prompts(prompts: DataFrame, call: Callable[[str], str], tries: int = 3) -> DataFrame:
    """prompts: doc_id, batch, prompt. doc_id, ord, raw, error; a batch whose calls fail has no raw but the last failure, and its segments are incomplete."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, batch, prompt in pdf.itertuples(index=False):
                try:
                    out.append((doc, batch, call_with_retry(call, prompt, tries), None))
                except Exception as e:  # one batch's failure is not another's
                    out.append((doc, batch, None, message(e)))
            yield pd.DataFrame(out, columns=["doc_id", "ord", "raw", "error"])

    return prompts.select("doc_id", "batch", "prompt").mapInPandas(run, f"doc_id {prompts.schema['doc_id'].dataType.simpleString()}, ord int, raw string, error string")


def score_columns(dims: tuple[str, ...] = V.MODULE_DIMS) -> Column:
    return F.array(*(F.col(f"scores.{d}") for d in dims))
