"""Requests in turn, answers kept, contracts checked, failures as rows."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.functions import values as V
from tessella.operators import blocks, errors, metadata, scoring
from tessella.plans import evaluation
from tessella.sources.answers import AnswerStore
from tessella.streaming import scoring as live

SEGMENT = "doc_id string, segment_id int, heading string, text string, segment_type string"


def answer(ids, score=7, **more):
    own = {d: score for d in V.MODULE_DIMS}
    return json.dumps([{"segment_id": i, "scores": own, "reasoning": {}, "summary": f"s{i}", **more} for i in ids])


@pytest.fixture
def segments(spark):
    rows = [("a", i, None, f"text {i}", "instructional" if i % 4 else "exercise") for i in range(1, 24)]
    rows += [("b", i, None, f"text {i}", "exercise" if i <= 10 else "instructional") for i in range(1, 18)]  # two batches without a request
    rows += [("c", i, None, f"text {i}", "instructional") for i in range(1, 13)]
    return spark.createDataFrame(rows, SEGMENT)


def given(spark, segments):
    systems = segments.select("doc_id").distinct().withColumn("system", F.concat(F.lit("about "), "doc_id"))
    return scoring.batch_requests(segments, systems)


def folders(path):
    return [str(path / x) for x in ("requests", "responses", "prompts", "state")]


def prompts_in(spark, path):
    return sorted((r.doc_id, r.batch, r.prompt) for r in spark.read.schema("doc_id string, batch int, prompt string").parquet(path).collect())


def test_turns_equal_one_pass_also_after_a_restart(spark, segments, tmp_path):
    """Recorded answers fed batch by batch, in another order with repeats, each feeding a run of its own from the checkpoint; then all at once."""
    requests = given(spark, segments)
    ids = {(r.doc_id, r.batch): r.ids for r in requests.collect()}
    recorded = [(d, b, answer(x), None) for (d, b), x in ids.items() if x]
    parsed = scoring.parse_responses(spark.createDataFrame([(d, b, raw) for d, b, raw, _ in recorded], "doc_id string, ord int, raw string"))
    evaluated = scoring.with_batches(scoring.match_responses(segments, parsed))
    want = sorted(tuple(r) for r in scoring.recorded_prompts(requests, evaluated).select("doc_id", "batch", "prompt").collect())
    seen = []
    for way in ("by batch", "at once"):
        at = folders(tmp_path / way)
        requests.coalesce(1).write.parquet(at[0])
        spark.createDataFrame([], live.RESPONSES).write.parquet(at[1])
        fed = sorted(recorded, key=lambda r: -r[1]) if way == "by batch" else recorded
        for part in [[r] for r in [*fed, fed[0]]] if way == "by batch" else [fed]:
            spark.createDataFrame(part, live.RESPONSES).coalesce(1).write.mode("append").parquet(at[1])
            live.ask(spark, *at).awaitTermination()
        seen.append(prompts_in(spark, at[2]))
    assert seen == [want, want]
    assert any("The course so far: s" in p for _, _, p in want) and all(p.startswith("about") for _, _, p in want)


def test_a_course_whose_answer_is_missing_stays_incomplete(spark, segments, tmp_path):
    at = folders(tmp_path)
    requests = given(spark, segments)
    requests.filter("NOT (doc_id = 'c' AND batch = 1)").write.parquet(at[0])
    asked = []

    def call(prompt):
        if "about a" in prompt and "text 7\n" in prompt + "\n" and "ID: 7 " in prompt:
            raise RuntimeError("denied")
        ids = [int(x.split(" ")[0]) for x in prompt.split("SEGMENT ID: ")[1:]]
        return answer(ids)

    rounds = live.score_in_turn(spark, *at, call, tries=1)
    asked = {(d, b) for d, b, _ in prompts_in(spark, at[2])}
    assert asked == {("a", b) for b in range(5)} | {("b", 2), ("b", 3), ("c", 0)} and rounds == 5  # a failed batch is answered, a missing one isn't
    responses = spark.read.schema(live.RESPONSES).parquet(at[1]).withColumnRenamed("batch", "ord")
    assert [r.error for r in responses.filter("raw IS NULL").collect()] == ["RuntimeError: denied"]
    left = scoring.match_responses(segments, scoring.parse_responses(responses)).filter("incomplete").select("doc_id", "segment_id").collect()
    assert sorted(map(tuple, left)) == [("a", 6), ("a", 7), ("a", 9), ("a", 10)] + [("c", i) for i in range(6, 13)]
    assert live.score_in_turn(spark, *at, call, tries=1) == 0  # nothing is asked twice


def test_narratives_keep_the_last_few(spark, segments):
    ev = scoring.with_batches(segments).withColumn("summary", F.when(F.col("segment_id") % 3 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("s"), F.col("segment_id").cast("string"))))
    got = {r.batch: r.narrative for r in scoring.narratives(ev.filter("doc_id = 'c'")).collect()}
    assert got == {0: "", 1: "s1 | s2 | s4 | s5", 2: "s4 | s5 | s7 | s8 | s10"}


def test_each_prompt_is_asked_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    prompts = spark.createDataFrame([(f"d{i}", 0, f"prompt {i % 7}") for i in range(12)], "doc_id string, batch int, prompt string").repartition(4)
    broken = str(tmp_path / "broken")

    def call(prompt):
        import os
        import uuid

        if os.path.exists(broken) and prompt.endswith(("3", "5")):
            os._exit(1)  # the worker is lost, and the job with it
        (log / f"{prompt}-{uuid.uuid4().hex}").touch()
        return prompt.upper()

    store = AnswerStore(spark, str(tmp_path / "store"), "m")
    (tmp_path / "broken").touch()
    with pytest.raises(Exception):  # noqa: B017
        store.score(prompts, call, 1).collect()
    (tmp_path / "broken").unlink()
    for again in range(3):
        got = {r.doc_id: r.raw for r in store.score(prompts, call, 1).collect()}
        assert got == {f"d{i}": f"PROMPT {i % 7}" for i in range(12)}
        if again == 0:
            store.settle()
    calls = sorted(p.name.split("-")[0] for p in log.iterdir())
    assert calls == [f"prompt {i}" for i in range(7)]
    other = AnswerStore(spark, str(tmp_path / "store"), "another model")
    assert {r.error for r in other.score(prompts, lambda p: 1 / 0, 1).collect()} == {"ZeroDivisionError: division by zero"}
    assert other.score(prompts.filter("false"), call).count() == 0


def test_contract_violations(spark):
    good = {f"c{k}": 2 for k in range(1, 6)}
    own = {"segment_id": 1, "scores": {d: 10 for d in V.MODULE_DIMS}, "criteria_scores": {d: good for d in V.MODULE_DIMS}, "reasoning": {}}
    bad = json.loads(json.dumps(own))
    bad["scores"]["goal_focus"], bad["scores"]["text_readability"], bad["scores"]["example_coherence"] = 11, "x", 9
    bad["criteria_scores"]["pedagogical_clarity"]["c3"] = 3
    del bad["criteria_scores"]["example_concreteness"]["c5"], bad["segment_id"], bad["reasoning"]
    raws = [json.dumps([own]), json.dumps({"evaluations": [own, bad]}), "no json", None]
    got = scoring.violations(spark.createDataFrame([("d", i, r) for i, r in enumerate(raws)], "doc_id string, ord int, raw string")).collect()
    assert sorted((r.ord, r.item, r.rule) for r in got if r.item is not None) == sorted(
        (1, 1, rule) for rule in ("segment_id", "reasoning", "scores.goal_focus", "sum.goal_focus", "scores.text_readability", "criteria.pedagogical_clarity", "criteria.example_concreteness", "sum.example_coherence")
    )
    assert [(r.ord, r.rule) for r in got if r.item is None] == [(2, "no evaluations"), (3, "no evaluations")]


def test_a_poisoned_course_leaves_the_others(spark, monkeypatch):
    rows = [(f"d{d}", i, f"Chapter {i}", "some words here") for d in range(4) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id string, block_idx int, heading string, text string")
    poison = df.withColumn("text", F.when(F.col("doc_id") == "d2", F.repeat(F.lit("w "), 40)).otherwise(F.col("text")))

    def chunks_of(text, limit, plain=blocks.chunks_of):
        if text.startswith("w w"):
            raise ValueError("poisoned")
        return plain(text, limit)

    monkeypatch.setattr(blocks, "chunks_of", chunks_of)
    tagged = evaluation.kept(blocks.merge_blocks(poison, 10, chunked=True, errors=True))
    assert [tuple(r) for r in errors.bad(tagged, "segments").collect()] == [("d2", "segments", "ValueError: poisoned")]
    clean = evaluation.kept(blocks.merge_blocks(df.filter("doc_id <> 'd2'"), 10, chunked=True))
    assert sorted(map(tuple, errors.good(tagged).collect())) == sorted(map(tuple, clean.collect()))
    with pytest.raises(Exception, match="poisoned"):
        blocks.merge_blocks(poison, 10, chunked=True).collect()
    none = spark.createDataFrame([], "doc_id string, ord int, raw string")
    course = spark.createDataFrame([], "doc_id string, scores struct<" + ",".join(f"{d}:int" for d in V.COURSE_DIMS) + ">, reasoning struct<" + ",".join(f"{d}_rationale:string" for d in V.COURSE_DIMS) + ">, overall_score double")
    done = evaluation.run(poison, metadata.conformed(df.select("doc_id").distinct()), none, course, max_words=10)
    assert done.metrics["segments"] == done.segments.count() == 9 and done.metrics["incomplete"] == 9 and done.metrics["instructional"] == 9
    assert {r.doc_id: r.document.segments is None for r in done.documents.collect()} == {"d0": False, "d1": False, "d2": True, "d3": False}


def test_providers_are_tried_in_turn(spark):
    rows = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "three")], "doc_id string, prompt string")

    def first(prompt):
        if prompt == "one":
            return '```json\n{"title": "A"}\n```'
        if prompt == "two":
            return "no json"
        raise OSError("down")

    got = {r.doc_id: (r.provider, r.error) for r in metadata.enriched(rows, [first, lambda p: '{"title": "B"}' if p == "two" else "[1]"], wait=0.0).collect()}
    assert got == {"a": (0, None), "b": (1, None), "c": (None, "OSError: down; ValueError: the answer is no JSON object")}


class Counted:
    """A state of one key in memory that counts its calls."""

    def __init__(self, calls):
        self.calls, self.rows = calls, {}

    def __getattr__(self, name):
        def call(*a):
            self.calls.append(name)
            return {"get": lambda: self.rows.get(()), "exists": lambda: () in self.rows, "update": lambda v: self.rows.update({(): v}), "containsKey": lambda k: k in self.rows, "getValue": lambda k: self.rows.get(k), "updateValue": lambda k, v: self.rows.update({k: v}), "removeKey": lambda k: self.rows.pop(k, None)}[name](*a)

        return call


def test_what_arrives_in_its_turn_takes_no_calls_of_the_state():
    from pyspark.sql import Row

    from tessella.streaming.scoring import Turns

    calls, turns = [], Turns()
    turns.course, turns.requests, turns.answers = (Counted(calls) for _ in range(3))
    ask = lambda b: Row(batch=b, answer=False, ids=[b], system="s", user=None if b == 3 else f"u{b}", summaries=None)
    tell = lambda b, x: Row(batch=b, answer=True, ids=[b], system=None, user=None, summaries=[f"{x}{b}"])
    said = [(r.batch, r.narrative) for r in turns.handleInputRows(("d",), iter([*map(ask, range(50)), *(tell(b, "x") for b in range(40)), tell(42, "x")]), None)]
    assert [b for b, _ in said] == [b for b in range(41) if b != 3] and said[3] == (4, "x0 | x1 | x2")
    assert len(calls) == 2 + 10 + 1  # the course, and what waits
    said = [(r.batch, r.narrative[-3:]) for r in turns.handleInputRows(("d",), iter([tell(39, "late"), tell(42, "again"), tell(41, "x"), tell(40, "x"), tell(40, "again")]), None)]
    assert said == [(41, "x40"), (42, "x41"), (43, "x42")]
    assert set(turns.requests.rows) == {(b,) for b in range(43, 50)} and not turns.answers.rows
