"""Labels that are asked for once: counting callers, lost runs, errors asked about again."""

import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from docmill.operators import answers, qualify, tools
from docmill.sources import readers

SCHEMA = "pos int, id string, title string, categorie string, content string"


def counting(path, fail=()):
    """A caller that leaves a file for each call, and one of the numbers in flight."""

    def call(item):
        mark = f"{path}/{item['id']}-{time.time_ns()}-{threading.get_ident()}"
        open(f"{mark}.now", "x").close()
        running = sum(x.endswith(".now") for x in os.listdir(path))
        time.sleep(0.005)
        os.rename(f"{mark}.now", f"{mark}.{running}")
        if item["id"] in fail:
            raise RuntimeError("refused with Bearer abc")
        return json.dumps({"level": "N1", "tags": ["A", "a", "B", "c"], "summary": item["content"][:3]})

    return call


def calls(path):
    return sorted(x.split("-")[0] for x in os.listdir(path))


@pytest.fixture
def items(spark):
    rows = [(i, str(i), f"t{i}", None, "text" * i) for i in range(40)] + [(40, "3", "t3", "", "text" * 3), (41, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(7)


def test_calls_are_counted_by_the_log(spark, items, tmp_path):
    def caller(item):
        if item["id"] == "5":
            raise RuntimeError("refused")
        return '{"level": "N1"}'

    log = str(tmp_path / "log")
    a = answers.ask(items, caller, log, concurrency=8, retries=2, backoff_ms=0)
    assert a.log.calls() == 40 + 3 and answers.ask(items, caller, log).log.calls() == 40 + 3
    assert answers.AnswerLog(spark, str(tmp_path / "none")).calls() == 0


def test_each_item_is_asked_once(items, tmp_path):
    log, marks = str(tmp_path / "log"), tmp_path / "calls"
    marks.mkdir()
    a = answers.ask(items, counting(marks), log, concurrency=3, retries=0, wave=5)
    got = {r.pos: r for r in a.labels.collect()}
    assert a.labels.count() == len(got) == 42 and a.n_asked == 41  # an item given twice is one request
    assert calls(marks) == sorted([*map(str, range(40)), ""]) and a.duration_ms > 0
    assert max(int(x.rsplit(".", 1)[1]) for x in os.listdir(marks)) <= 3  # in flight
    assert (got[40].level, got[40].tags, got[40].summary, got[41].id) == ("N1", ["a", "b"], "tex", "")
    again = answers.ask(items, counting(marks), log, concurrency=3)
    assert again.n_asked == 0 and len(os.listdir(marks)) == 41 and again.labels.count() == 42
    assert answers.ask(items, counting(marks), log, prompt="another").n_asked == 41  # another prompt is another request


def test_a_cut_run_goes_on(items, tmp_path):
    log, marks = str(tmp_path / "log"), tmp_path / "calls"
    marks.mkdir()
    first = answers.ask(items.where("pos < 10"), counting(marks), log, retries=0)
    assert first.n_asked == 10
    assert answers.ask(items, counting(marks), log, retries=0).n_asked == 31 and len(os.listdir(marks)) == 41


def test_errors_are_kept_or_asked_again(items, tmp_path):
    log, marks = str(tmp_path / "log"), tmp_path / "calls"
    marks.mkdir()
    few = items.where("pos < 4")
    a = answers.ask(few, counting(marks, ("1", "2")), log, retries=1, backoff_ms=0)
    assert sorted((r.id, r.level, r.error) for r in a.labels.where("error IS NOT NULL").collect()) == [(i, "UNKNOWN", "refused with Bearer [SECRET_REDACTED]") for i in "12"]
    assert len(os.listdir(marks)) == 6 and answers.ask(few, counting(marks), log).n_asked == 0
    b = answers.ask(few, counting(marks), log, again=True)
    assert b.n_asked == 2 and b.labels.where("error IS NULL").count() == 4 and a.log.rows().count() == 6


def test_empty_and_clashing(spark, items, tmp_path):
    none = answers.ask(items.where("false"), counting(tmp_path), str(tmp_path / "log"))
    assert none.n_asked == 0 and none.labels.count() == 0
    clash = items.where("pos < 3").withColumns({c: F.lit("own") for c in ("level", "tags", "error", "slot")})
    marks = tmp_path / "calls"
    marks.mkdir()
    assert {r.level for r in answers.ask(clash, counting(marks), str(tmp_path / "log2")).labels.collect()} == {"N1"}


def test_tool_asks_once_for_all_outputs(spark, tmp_path):
    marks = tmp_path / "calls"
    marks.mkdir()
    (tmp_path / "a.json").write_text(json.dumps([{"summary": "old", "id": i, "body_markdown": f"body {i}", "z": {"k": [1, None]}} for i in range(20)]))
    df = readers.read_json(spark, str(tmp_path / "a.json"), objects=True)
    tool = tools.qualifier(counting(marks, ("7",)), backoff_ms=0)
    config = tools.with_options(tool, max_retries=1, answers=str(tmp_path / "log"))
    r = tool.run(df, config, "a.json")
    data = [json.loads(x.text) for x in r.data.orderBy("pos").collect()]
    assert list(data[3]) == ["summary", "id", "body_markdown", "z", "level", "tags"] and data[3]["summary"] == "bod" and data[3]["z"] == {"k": [1, None]}
    told = r.diagnostics.first()
    assert (told.totalItems, told.qualifiedItems, told.failedItems, told.rowCount) == (20, 19, 1, 20)
    assert told.durationMs > 0 and told.averageMsPerItem == round(told.durationMs / 20) and told.inputFiles == ["a.json"]
    assert [x.text for x in r.warnings.collect()] == told.warnings == told.errors == ["Item 7: qualification OpenAI echouee. refused with Bearer [SECRET_REDACTED]"]
    assert told.emptyFieldCount == 20 + 1  # a null in each, and the summary of the item that failed
    tool.run(df, config, "a.json")
    assert len(os.listdir(marks)) == 21


def test_null_fields_fall_through(spark):
    rows = [(1, '{"id": 5, "t": null, "title": "T", "c": {"a": [1, "x"]}, "content": "late"}'), (2, '{"c": null, "body_markdown": null, "content": "late", "categorie": true}')]
    df = spark.createDataFrame(rows, "pos int, text string").withColumn("record", F.parse_json("text"))
    got = {r.pos: r[1:] for r in qualify.item_fields(df, "c", "t", "none").collect()}
    assert got == {1: ("5", "T", "", '{"a":[1,"x"]}'), 2: ("", "", "true", "late")}
