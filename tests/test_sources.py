"""The data sources: what is opened for a filter, failures as rows, files written as a whole or not at all; the command line from files to documents."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.functions import values as V
from tessella.operators import errors
from tessella.sources import course_source, readers, sinks

PARSER = "tests.fake_pdf:Fake"


@pytest.fixture
def folder(spark, tmp_path):
    course_source.register(spark)
    at = tmp_path / "pdf"
    at.mkdir()
    for name, pages in (("one", 3), ("two", 50), ("Three", 2)):
        found = {"name": name, "pages": [[f"{name}{p}", "word"] for p in range(pages)], "outline": [[0, f"{name} A", 0], [1, "B", 1]], "log": str(tmp_path / "log")}
        (at / f"{name}.{'PDF' if name == 'two' else 'pdf'}").write_text(json.dumps(found))
    (at / "bad.pdf").write_text("no json")
    (at / "other.txt").write_text("x")
    return at


def opened(tmp_path):
    log = tmp_path / "log"
    lines = log.read_text().splitlines() if log.exists() else []
    log.unlink(missing_ok=True)
    return sorted(x for x in lines if x.startswith("open")), [int(x.split()[1]) for x in lines if x.startswith("page")]


def test_words_and_outlines_of_files(spark, folder, tmp_path):
    rows = spark.read.format("course_words").option("parser", PARSER).load(str(folder)).collect()
    fine = [r for r in rows if r.error is None]
    assert len(fine) == 2 * 55 and {r.doc_id for r in fine} == {"one", "two", "Three"} and fine[0].text and fine[0].size == 10.0
    assert [(r.doc_id, r.page_idx) for r in rows if r.error] == [("bad", None)]
    assert opened(tmp_path)[0] == ["open Three", "open one", "open two"]
    entries = spark.read.format("course_outline").option("parser", PARSER).load(str(folder))
    assert [tuple(r) for r in errors.good(entries).filter("doc_id = 'one'").collect()] == [("one", 0, 0, "one A", 0), ("one", 1, 1, "B", 1)]
    assert [r.doc_id for r in errors.bad(entries, "outline").collect()] == ["bad"]
    alone = spark.read.format("course_words").option("parser", PARSER).load(str(folder / "two.PDF"))
    assert alone.select("doc_id").distinct().first().doc_id == "two"
    with pytest.raises(Exception, match="doesn't exist"):
        spark.read.format("course_words").option("parser", PARSER).load(str(folder / "nowhere")).collect()


def test_filters_open_only_what_they_name(spark, folder, tmp_path):
    words = spark.read.format("course_words").option("parser", PARSER).option("pages_per_task", 4).load(str(folder))
    opened(tmp_path)
    got = words.filter("doc_id = 'two' AND page_idx >= 10 AND page_idx < 20")
    assert sorted({r.page_idx for r in got.collect()}) == list(range(10, 20))
    files, pages = opened(tmp_path)
    assert set(files) == {"open two"} and len(files) == 3 and sorted(pages) == list(range(10, 20))  # three ranges of four pages
    assert words.filter("doc_id = 'two' AND page_idx >= 10 AND page_idx < 20").rdd.getNumPartitions() == 3
    assert {r.page_idx for r in words.filter(F.col("doc_id").isin("one", "Three") & (F.col("page_idx") == 1)).collect()} == {1}
    files, pages = opened(tmp_path)
    assert set(files) == {"open one", "open Three"} and pages == [1, 1]
    assert words.filter("doc_id = 'none'").count() == 0 and words.filter("doc_id = 'one' AND doc_id = 'two'").count() == 0 and opened(tmp_path) == ([], [])


def document(doc, source, **more):
    return (doc, json.dumps({"course_metadata": {"source": source}, **more}))


def documents(spark, sources):
    return spark.createDataFrame([(f"d{i}", ((s,), None, [], "é", 5.0)) for i, s in enumerate(sources)], "doc_id string, document struct<course_metadata:struct<source:string>,nothing:string,list:array<int>,text:string,score:double>")


def test_names_follow_the_sources(spark):
    sources = ["a/b/Think OS.pdf", "think os.txt", "http://x/y/notes.v2.pdf", None, "", "Unknown", ".hidden", "x_2.pdf", "x.pdf", "x.md", "dir/"]
    got = {json.loads(r.json)["course_metadata"]["source"]: r.name for r in sinks.as_json(documents(spark, sources)).collect()}
    names = [r.name for r in sinks.as_json(documents(spark, sources)).collect()]
    assert len({n.lower() for n in names}) == len(sources)
    assert got["a/b/Think OS.pdf"] == "Think OS_evaluation.json" and got["think os.txt"] == "think os_2_evaluation.json" and got["http://x/y/notes.v2.pdf"] == "notes.v2_evaluation.json"
    assert got[".hidden"] == ".hidden_evaluation.json" and got["x_2.pdf"] == "x_2_evaluation.json" and got["x.pdf"] == "x_evaluation.json" and got["x.md"] == "x_2_d9_evaluation.json" and got["dir/"] == "dir_evaluation.json"
    assert {"course_evaluation_evaluation.json", "course_evaluation_2_evaluation.json", "course_evaluation_3_evaluation.json"} <= set(names)


def test_documents_are_files_with_an_indent(spark, tmp_path):
    sinks.write_json(documents(spark, ["one.pdf", "two.pdf"]).repartition(2), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["one_evaluation.json", "two_evaluation.json"]
    assert (tmp_path / "out" / "one_evaluation.json").read_text() == '{\n  "course_metadata": {\n    "source": "one.pdf"\n  },\n  "nothing": null,\n  "list": [],\n  "text": "é",\n  "score": 5.0\n}'


def test_a_failed_run_leaves_no_file(spark, tmp_path):
    files = spark.createDataFrame([(f"f{i}", "{}" if i != 7 else "broken") for i in range(10)], "name string, json string").repartition(4)
    with pytest.raises(Exception):  # noqa: B017
        sinks.write_files(files, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or list((tmp_path / "out").iterdir()) == []
    course_source.register(spark)
    fine = files.filter("name <> 'f7'")
    fine.write.format("course_files").mode("append").save(str(tmp_path / "out"))
    assert len(list((tmp_path / "out").iterdir())) == 9
    with pytest.raises(Exception, match="there already"):
        fine.write.format("course_files").mode("append").save(str(tmp_path / "out"))
    assert len(list((tmp_path / "out").iterdir())) == 9


def test_an_address_has_some_seconds_to_answer(spark):
    import time

    assert readers.url_metadata(spark, "u", "http://x", lambda u: time.sleep(5) or "{}", seconds=0.2).first().source == "u.pdf"


def test_from_files_to_documents(spark, tmp_path):
    """PDF files, a model asked in turn, failures of one course, names, the log."""
    from tessella import __main__ as cli

    course_source.register(spark)
    (tmp_path / "in").mkdir()
    for name in ("one", "two"):
        found = {"name": name, "pages": [["Welcome", "to", name], ["Chapter", "1", "words"], ["Chapter", "2", "more"]], "outline": [[0, "Chapter 1", 1], [0, "Chapter 2", 2]], "log": str(tmp_path / "log")}
        (tmp_path / "in" / f"{name}.pdf").write_text(json.dumps(found))
    (tmp_path / "in" / "bad.pdf").write_text("no json")
    (tmp_path / "rubrics.yaml").write_text("module_rubrics:\n  - id: a\n    name: Aim\n    criteria: [x]\ncourse_rubrics:\n  - id: b\n    name: Whole\n")
    cli.main(["--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--parser", PARSER, "--model", "tests.fake_model:answer", "--config", str(tmp_path / "rubrics.yaml")])
    names = sorted(p.name for p in (tmp_path / "out").iterdir() if p.suffix == ".json")
    assert names == ["one_evaluation.json", "two_evaluation.json"]
    d = json.loads((tmp_path / "out" / "one_evaluation.json").read_text())
    assert list(d) == ["course_metadata", "assessment", "module_gate", "course_gate", "segments", "evaluation_meta"]
    assert d["module_gate"] == {**dict.fromkeys(V.MODULE_DIMS, 6.0), "overall_score": 6.0} and d["course_gate"]["overall_score"] == 7.0 and d["assessment"]["course_gate"]["overall_score"] == 7.0
    raw = (tmp_path / "out" / "one_evaluation.json").read_text()
    assert raw == json.dumps(d, indent=2, ensure_ascii=False)  # byte for byte, so are the names and their order
    assert list(d["segments"][0]) == ["segment_id", "heading", "text", "segment_type", "scores", "reasoning", "criteria_scores", "summary", "incomplete"]
    assert list(d["evaluation_meta"]) == ["model_used", "timestamp", "prompt_version", "total_segments", "instructional_segments_scored", "excluded_segments"]
    assert list(d["assessment"]) == ["module_gate", "course_gate"] and list(d["course_gate"]) == ["scores", "reasoning", "overall_score"]
    assert [s["incomplete"] for s in d["segments"]] == [False] * len(d["segments"]) and d["evaluation_meta"]["prompt_version"] == "2.0"
    assert [tuple(r)[:2] for r in spark.read.parquet(str(tmp_path / "out" / "errors.parquet")).orderBy("step").collect()] == [("bad", "outline"), ("bad", "words")]
    log = (tmp_path / "out" / "evaluate.log").read_text()
    assert "bad failed in words" in log and "segments: 4" in log.replace("segments: 2", "segments: 4")
    cli.main(["--input", str(tmp_path / "in"), "--output", str(tmp_path / "meta"), "--parser", PARSER, "--metadata-only"])
    assert "one_metadata.json" in {p.name for p in (tmp_path / "meta").iterdir()}
    (tmp_path / "empty").mkdir()
    cli.main(["--input", str(tmp_path / "empty"), "--output", str(tmp_path / "none")])
    assert "no PDF files" in (tmp_path / "none" / "evaluate.log").read_text()


def test_presets_stand_between_given_options_and_defaults(tmp_path):
    from tessella import __main__ as cli

    (tmp_path / "p.toml").write_text('[night]\ninput = "a"\nlimit = 3\nmetadata-only = true\n[night.spark]\nsql.shuffle.partitions = 7\nui.enabled = false\n[odd]\nspeed = 1\n')
    given = cli.options(["--presets", str(tmp_path / "p.toml"), "--preset", "night", "--limit", "5"])
    assert (given.input, given.limit, given.output, given.metadata_only) == ("a", 5, "output", True)
    assert given.spark == {"spark.sql.shuffle.partitions": "7", "spark.ui.enabled": "false"}
    for bad in (["--preset", "odd"], ["--preset", "none"], []):
        with pytest.raises(SystemExit):
            cli.options(["--presets", str(tmp_path / "p.toml"), *bad])
