"""Module and course gates, digests and the document of a course.

evaluated: doc_id, segment_id, heading, text, segment_type, scores, reasoning, summary, incomplete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions import values as V
from tessella.functions.numbers import py_round

POOL = "segment_type = 'instructional' AND NOT incomplete"


def mean_of(*cols: Column) -> Column:
    total = cols[0].cast("double")
    for c in cols[1:]:
        total = total + c
    return total / len(cols)


def first_segments(segments: DataFrame, limit: int = 0) -> DataFrame:
    """The first segments of each course; 0 for all."""
    return segments.filter(F.col("segment_id") <= limit) if limit else segments


def module_gate(evaluated: DataFrame, dims: tuple[str, ...] = V.MODULE_DIMS, more: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, each dimension weighted by length (plain mean if all texts are empty, 0 if none counts), overall_score, counts, excluded types.

    Floating-point sums depend on their order, so a score's share, score * (length / all lengths), is added segment by segment in their
    order: a course's scores and lengths are gathered, not its texts. `more`: further aggregates of a course, in the same pass.
    """
    pool = F.expr(POOL)
    own = F.struct("segment_id", F.length("text").alias("chars"), *(F.col(f"scores.{d}").alias(d) for d in dims))
    counts = [
        F.count("*").alias("total_segments"),
        F.count_if(pool).alias("scored_segments"),
        F.count_if(~pool).alias("excluded_segments"),
        F.array_sort(F.collect_set(F.when(F.col("segment_type") != "instructional", F.col("segment_type")))).alias("excluded_types"),
        F.bool_or(F.col("segment_type") == "instructional").alias("has_instructional"),
    ]
    rows = evaluated.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(pool, own))).alias("pool"), *counts, *more)
    total = F.aggregate("pool", F.lit(0).cast("long"), lambda n, x: n + x["chars"])
    rows = rows.withColumn("chars", total)

    def share(x: Column, d: str) -> Column:
        return F.when(F.col("chars") > 0, x[d] * (x["chars"] / F.col("chars"))).otherwise(x[d].cast("double"))

    zeros = F.struct(*(F.lit(0.0).alias(d) for d in dims))
    sums = F.aggregate("pool", zeros, lambda s, x: F.struct(*((s[d] + share(x, d)).alias(d) for d in dims)))
    by = F.when((F.col("chars") > 0) | (F.size("pool") == 0), F.lit(1)).otherwise(F.size("pool"))
    rows = rows.withColumn("sums", sums).withColumn("by", by)
    rows = rows.withColumns({d: py_round(F.col(f"sums.{d}") / F.col("by")) for d in dims}).drop("pool", "chars", "sums", "by")
    return rows.withColumn("overall_score", py_round(mean_of(*(F.col(d) for d in dims))))


def unpivoted(evaluated: DataFrame, dims: tuple[str, ...] = V.MODULE_DIMS) -> DataFrame:
    """doc_id, segment_id, dim, score, rationale of the pool."""
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(f"scores.{d}").alias("score"), F.col(f"reasoning.{d}_rationale").alias("rationale")) for d in dims)))
    return evaluated.filter(POOL).select("doc_id", "segment_id", each.alias("e")).select("doc_id", "segment_id", "e.*")


def rationale_digests(evaluated: DataFrame, dims: tuple[str, ...] = V.MODULE_DIMS) -> DataFrame:
    """doc_id, dim, digest: weakest, typical and strongest rationale, picked by rank instead of gathering all texts."""
    rows = unpivoted(evaluated, dims).filter(F.coalesce("rationale", F.lit("")) != "")
    by_score = Window.partitionBy("doc_id", "dim").orderBy("score", "segment_id")
    rows = rows.withColumn("i", F.row_number().over(by_score) - 1).withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "dim")))
    at = lambda i, c: F.max(F.when(F.col("i") == i, F.col(c)))
    last = F.col("n") - 1
    low, high, n = at(F.lit(0), "score"), at(last, "score"), F.max("n")
    digest = F.concat_ws(
        " | ",
        F.concat(F.lit("Across "), n.cast("string"), F.lit(" segment(s) (scores "), low.cast("string"), F.lit("–"), high.cast("string"), F.lit("/10):")),
        F.concat(F.lit("Weakest: "), F.substring(at(F.lit(0), "rationale"), 1, 220)),
        F.when(n > 2, F.concat(F.lit("Typical: "), F.substring(at(F.floor(F.col("n") / 2), "rationale"), 1, 150))),
        F.concat(F.lit("Strongest: "), F.substring(at(last, "rationale"), 1, 220)),
    )
    return rows.groupBy("doc_id", "dim").agg(digest.alias("digest"))


def ranked(evaluated: DataFrame, dims: tuple[str, ...] = V.MODULE_DIMS) -> DataFrame:
    """Instructional segments with a summary: mean, and their places from the weakest and from the strongest (ties in order)."""
    rows = evaluated.filter("segment_type = 'instructional' AND summary <> ''").withColumn("mean", mean_of(*(F.col(f"scores.{d}") for d in dims)))
    own = Window.partitionBy("doc_id")
    return rows.withColumn("weak", F.row_number().over(own.orderBy("mean", "segment_id"))).withColumn("strong", F.row_number().over(own.orderBy(F.desc("mean"), "segment_id")))


def course_digest(evaluated: DataFrame, top: int = 3, dims: tuple[str, ...] = V.MODULE_DIMS) -> DataFrame:
    """doc_id, mean (one decimal), the weakest segment's id, name, mean, evidence and rationales, the strongest ids and lines.

    The mean of means is taken from whole numbers, so it doesn't depend on an order.
    """
    rows = ranked(evaluated)
    name = F.coalesce(F.nullif("heading", F.lit("")), F.lit("untitled"))
    shown = F.format_string("%.1f", py_round(F.col("mean"), 1))
    line = F.concat(F.lit("ID "), F.col("segment_id").cast("string"), F.lit(" ("), name, F.lit("): avg "), shown)
    why = [F.concat(F.lit(f"{d}: "), F.substring(F.nullif(F.col(f"reasoning.{d}_rationale"), F.lit("")), 1, V.RATIONALE_CHARS)) for d in dims]
    points = sum((F.col(f"scores.{d}") for d in dims[1:]), F.col(f"scores.{dims[0]}"))
    rows = rows.select("doc_id", "segment_id", points.alias("points"), "weak", "strong", "text", name.alias("name"), shown.alias("shown"), line.alias("line"), F.concat_ws("\n", *why).alias("why"))
    best = F.array_sort(F.collect_list(F.when(F.col("strong") <= top, F.struct("strong", "segment_id", "line")))).alias("best")
    weakest = lambda c: F.max(F.when(F.col("weak") == 1, F.col(c)))
    out = rows.groupBy("doc_id").agg(
        F.format_string("%.1f", py_round(F.sum("points") / (F.count("*") * len(dims)), 1)).alias("mean"),
        F.count("*").alias("summaries"),
        weakest("segment_id").alias("weakest_id"), weakest("name").alias("weakest_name"), weakest("shown").alias("weakest_mean"),
        F.max(F.when(F.col("weak") == 1, T.stripped(F.substring("text", 1, V.EVIDENCE_CHARS)))).alias("evidence"), weakest("why").alias("rationales"), best,
    )
    return out.withColumns({"strongest_ids": F.transform("best", lambda x: x["segment_id"]), "strongest": F.transform("best", lambda x: x["line"])}).drop("best")


def score_lines(evaluated: DataFrame, dims: tuple[str, ...] = V.MODULE_DIMS) -> DataFrame:
    """doc_id, segment_id, line: its name, its scores and its summary."""
    scores = F.concat_ws(", ", *(F.concat(F.lit(f"{d}="), F.col(f"scores.{d}").cast("string")) for d in dims))
    name = F.coalesce(F.concat(F.lit("**"), F.nullif("heading", F.lit("")), F.lit("**")), F.concat(F.lit("Module "), F.col("segment_id").cast("string")))
    return evaluated.select("doc_id", "segment_id", F.concat(name, F.lit(": "), F.col("summary"), F.lit(" ["), scores, F.lit("]")).alias("line"))


def similar_pairs(evaluated: DataFrame, limit: float = V.SIMILARITY_LIMIT, first: int = V.SIMILAR_PAIRS) -> DataFrame:
    """doc_id, i, j: the first pairs of summaries whose words overlap by more than the limit of the smaller set.

    A pair needs more than limit * n of the n words of its smaller set, so it shares one of that set's n - floor(limit * n) rarest words
    of the course: only these are looked up among the words of larger sets, and words that many summaries hold are hardly ever among
    them. What is found that way is verified on the sets.
    """
    words = F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower("summary"), r"(?U)\s+", " ")), " "))
    sets = evaluated.filter("segment_type = 'instructional' AND summary <> ''").select("doc_id", "segment_id", words.alias("words")).filter(F.size("words") > 3)
    each = sets.select("doc_id", "segment_id", F.size("words").alias("n"), F.explode("words").alias("word"))
    held = each.withColumn("held", F.count("*").over(Window.partitionBy("doc_id", "word")))
    rarest = Window.partitionBy("doc_id", "segment_id").orderBy("held", "word")
    rare = held.withColumn("r", F.row_number().over(rarest)).filter(F.col("r") <= F.col("n") - F.floor(limit * F.col("n") - 1e-9)).filter("held > 1")
    small = rare.select("doc_id", "word", F.col("segment_id").alias("a"), F.col("n").alias("na"))
    large = held.filter("held > 1").select("doc_id", "word", F.col("segment_id").alias("b"), F.col("n").alias("nb"))
    found = small.join(large, ["doc_id", "word"]).filter("na < nb OR (na = nb AND a < b)").select("doc_id", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).distinct()
    of = lambda k: sets.select("doc_id", F.col("segment_id").alias(k), F.col("words").alias(f"w{k}"))
    pairs = found.join(of("i"), ["doc_id", "i"]).join(of("j"), ["doc_id", "j"])
    near = pairs.filter(F.size(F.array_intersect("wi", "wj")) / F.least(F.size("wi"), F.size("wj")) > limit)
    return near.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("i", "j"))).filter(F.col("k") <= first).select("doc_id", "i", "j")


def partial_courses(segments: DataFrame) -> DataFrame:
    """doc_id, partial: no sign of contents in other segments and no first chapter among the instructional ones."""
    other = F.col("segment_type") != "instructional"
    sign = other & (T.text_of("text").rlike(V.TOC_SIGNAL) | T.text_of("heading").rlike(V.TOC_SIGNAL))
    first = ~other & T.text_of("heading").rlike(V.FIRST_CHAPTER)
    return segments.groupBy("doc_id").agg((~F.coalesce(F.bool_or(sign | first), F.lit(False))).alias("partial"))


def gate_report(overall: Column, scores: dict[str, Column], rationales: dict[str, Column]) -> Column:
    rubrics = F.map_from_entries(F.array(*(F.struct(F.lit(d).alias("key"), F.struct(s.cast("double").alias("score"), F.coalesce(rationales[d], F.lit("")).alias("rationale")).alias("value")) for d, s in scores.items())))
    return F.struct(overall.alias("overall_score"), rubrics.alias("rubrics"))


def with_tree(gate: DataFrame, evaluated: DataFrame, course: DataFrame) -> DataFrame:
    """gate (of module_gate) with `tree`: both gates. course: doc_id, scores (struct of COURSE_DIMS), reasoning, overall_score; missing ones are zeros."""
    digests = rationale_digests(evaluated).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "digest"))).alias("why"))
    own = course.select("doc_id", F.struct("scores", "reasoning", "overall_score").alias("course"))
    rows = gate.join(digests, "doc_id", "left").join(own, "doc_id", "left")
    module = gate_report(F.col("overall_score"), {d: F.col(d) for d in V.MODULE_DIMS}, {d: F.col("why")[d] for d in V.MODULE_DIMS})
    scores = {d: F.coalesce(F.col(f"course.scores.{d}"), F.lit(0)) for d in V.COURSE_DIMS}
    reasons = {d: F.col(f"course.reasoning.{d}_rationale") for d in V.COURSE_DIMS}
    whole = gate_report(F.coalesce("course.overall_score", F.lit(0.0)), scores, reasons)
    return rows.withColumn("tree", F.struct(module.alias("module_gate"), whole.alias("course_gate"))).drop("why", "course")


def assessment_trees(evaluated: DataFrame, course: DataFrame) -> DataFrame:
    """doc_id, tree: both gates."""
    return with_tree(module_gate(evaluated), evaluated, course).select("doc_id", "tree")


def course_documents(metadata: DataFrame, evaluated: DataFrame, course: DataFrame, model: str = "", version: str = "2.0") -> DataFrame:
    """doc_id, document: one nested struct for each course: metadata, both gates as a tree and as they are, its segments in order (a course is what is gathered), and what the run was."""
    inner = F.struct(*(c for c in evaluated.columns if c != "doc_id"))
    by_id = lambda x, y: F.when(x["segment_id"] < y["segment_id"], -1).when(x["segment_id"] > y["segment_id"], 1).otherwise(0)
    segments = F.array_sort(F.collect_list(F.struct("segment_id", inner.alias("s"))), by_id).alias("segments")
    rows = with_tree(module_gate(evaluated, more=(segments,)), evaluated, course)
    at = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp")
    counts = (F.col("total_segments"), F.col("scored_segments").alias("instructional_segments_scored"), F.col("excluded_segments"))
    meta = F.struct(F.lit(model).alias("model_used"), at, F.lit(version).alias("prompt_version"), *counts)
    gate = F.struct(*V.MODULE_DIMS, "overall_score")
    rows = rows.select("doc_id", "tree", gate.alias("gate"), F.transform("segments", lambda x: x["s"]).alias("segments"), meta.alias("meta"))
    own = metadata.select("doc_id", F.struct(*(c for c in metadata.columns if c != "doc_id")).alias("m"))
    rows = own.join(rows, "doc_id", "left").join(course.select("doc_id", F.struct("scores", "reasoning", "overall_score").alias("course")), "doc_id", "left")
    rows = rows.withColumn("course", F.struct(
        F.struct(*(F.coalesce(F.col(f"course.scores.{d}"), F.lit(0)).alias(d) for d in V.COURSE_DIMS)).alias("scores"),
        F.struct(*(F.coalesce(F.col(f"course.reasoning.{d}_rationale"), F.lit("")).alias(f"{d}_rationale") for d in V.COURSE_DIMS)).alias("reasoning"),
        F.coalesce("course.overall_score", F.lit(0.0)).alias("overall_score"),
    ))
    document = F.struct(F.col("m").alias("course_metadata"), F.col("tree").alias("assessment"), F.col("gate").alias("module_gate"), F.col("course").alias("course_gate"), "segments", F.col("meta").alias("evaluation_meta"))
    return rows.select("doc_id", document.alias("document"))


def gathered(rows: DataFrame, text: Column, order: str, name: str, glue: str = "\n") -> DataFrame:
    """doc_id and the rows' texts in order as one; a course is what is gathered."""
    xs = F.array_sort(F.collect_list(F.struct(F.col(order), text.alias("x"))))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(xs, lambda r: r["x"]), glue).alias(name))


COURSE_PROCEDURE = """Score the course as a whole on each rubric above: five criteria of 0, 1 or 2 each, their sum is the rubric's score. Answer in JSON with scores, criteria_scores and reasoning.
A domain's name without a task is no relevance to practice. Headings that fit their text badly come from the extraction."""
PARTIAL = "The file looks like a part of a larger course: don't mark down what other files may hold."


def course_prompts(evaluated: DataFrame, segments: DataFrame, courses: DataFrame | None = None, rubrics: str = "") -> DataFrame:
    """doc_id, prompt of a course's one request. courses: rows of metadata; rubrics: rubric_text of the course gate.

    First what is known of the course, the rubrics and a note where it looks like a part of a larger one; then what stands around the modules,
    the modules' scores and summaries, their mean, the weakest one with its text and rationales, the strongest ones and repeated pairs.
    """
    modules = gathered(score_lines(evaluated.filter("segment_type = 'instructional' AND summary <> ''")), F.col("line"), "segment_id", "modules")
    pair = F.concat(F.lit("Segments "), F.col("i").cast("string"), F.lit(" and "), F.col("j").cast("string"))
    in_order = F.array_sort(F.collect_list(F.struct("i", "j", pair.alias("x"))))
    pairs = similar_pairs(evaluated).groupBy("doc_id").agg(F.array_join(F.transform(in_order, lambda p: p["x"]), "; ").alias("pairs"))
    name = F.coalesce(F.nullif("heading", F.lit("")), F.upper("segment_type"))
    label = F.concat(F.lit("### "), name, F.lit(" (ID "), F.col("segment_id").cast("string"), F.lit(")\n"))
    around = gathered(segments.filter("segment_type <> 'instructional'"), F.concat(label, T.by_type("text", "segment_type")), "segment_id", "around", "\n\n")
    rows = partial_courses(segments)
    for side in (modules, course_digest(evaluated), pairs, around):
        rows = rows.join(side, "doc_id", "left")
    part = lambda title, *c: F.concat(F.lit(f"## {title}\n"), *c)
    note = F.when(F.col("partial"), F.lit(PARTIAL))
    about = F.lit(None).cast("string")
    if courses is not None:
        lists = lambda k: T.union_text(f"m.{k}_stated", f"m.{k}_inferred")
        known = {"Title": T.text_of("m.title"), "Author": F.coalesce(F.nullif("m.author", F.lit("")), F.lit("Unknown")), "Audience": T.text_of("m.target_audience"), "Level": F.coalesce(F.nullif("m.level", F.lit("")), F.lit("Not specified"))}
        known |= {"Prerequisites": lists("prerequisites"), "Learning outcomes": lists("learning_outcomes"), "Description": F.coalesce(F.nullif("m.description", F.lit("")), F.lit("Not provided"))}
        about = part("Course", F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), c) for k, c in known.items())))
        own = courses.select("doc_id", F.struct(*(c for c in courses.columns if c != "doc_id")).alias("m"))
        rows = rows.join(own, "doc_id", "left")
    ruled = [part("Rubrics", F.lit(rubrics)), F.lit(COURSE_PROCEDURE)] if rubrics else []
    weakest = part("Weakest module", F.col("weakest_id").cast("string"), F.lit(" ("), F.col("weakest_name"), F.lit("), avg "), F.col("weakest_mean"), F.lit("\n"), F.col("evidence"))
    sections = [
        about, *ruled, note, part("Around the modules", F.col("around")), part("Modules", F.col("modules")),
        part("Mean", F.lit("of "), F.col("summaries").cast("string"), F.lit(" modules: "), F.col("mean"), F.lit("/10")), weakest,
        F.when(F.col("rationales") != "", part("Why", F.col("rationales"))), F.when(F.size("strongest") > 0, part("Strongest modules", F.array_join("strongest", "\n"))), part("Repeated summaries", F.col("pairs")),
    ]
    return rows.select("doc_id", F.concat_ws("\n\n", *sections).alias("prompt"))


def run_metrics(evaluated: DataFrame) -> DataFrame:
    """segment_type, courses, segments, incomplete, chars: what a run has seen, for its log."""
    return evaluated.groupBy("segment_type").agg(F.approx_count_distinct("doc_id").alias("courses"), F.count("*").alias("segments"), F.count_if("incomplete").alias("incomplete"), F.sum(F.length("text")).alias("chars"))
