"""Preview tables of JSON files of every shape, and of results; extensions of names."""

import json
import random

from pyspark.sql import functions as F

from docmill.sources import preview, readers


def plain_table(value):
    """The table of a whole JSON value, step by step."""
    text = lambda x: x if isinstance(x, str) else '""' if x is None else json.dumps(x, separators=(",", ":"))
    if isinstance(value, list) and not any(isinstance(x, dict) for x in value):
        return ["element"], [["" if x is None else "true" if x is True else str(x)] for x in value[:10]]
    if isinstance(value, dict):
        return ["cle", "valeur"], [[k, text(v)] for k, v in list(value.items())[:10]]
    objects = [x for x in value[:10] if isinstance(x, dict)] if isinstance(value, list) else []
    if not objects:
        return None
    heads = []
    for x in objects:
        heads += [k for k in x if k not in heads]
    return heads[:12], [[text(x.get(h)) for h in heads[:12]] for x in objects]


def test_tables_of_files(spark):
    rng = random.Random(2)
    files = {"scalars": [1, None, "a", True] * 4, "object": {f"k{i}": [i] if i % 2 else None for i in range(15)}, "late": [5] * 10 + [{"a": 1}], "one": ["x"], "none": [{}, {}]}
    for n in range(20):
        files[f"f{n}"] = [{rng.choice("abcdefghijklmnopqrst") * rng.randrange(1, 3): rng.choice([1, "t", None, [1, {}], False]) for _ in range(rng.randrange(6))} if rng.random() < 0.8 else rng.choice([3, None, "s"]) for _ in range(rng.randrange(1, 60))]
    rows = [(f, i, json.dumps(x), isinstance(v, dict)) for f, v in files.items() for i, x in enumerate([v] if isinstance(v, dict) else v, 1)]
    rng.shuffle(rows)
    got = {r.file: r for r in preview.preview_tables(spark.createDataFrame(rows, "file string, pos long, text string, lone boolean").repartition(9)).collect()}
    for f, v in files.items():
        made = plain_table(v)
        assert (got[f].headers, got[f].rows) == (made if made else (None, None)), f
        assert got[f].n_items == (1 if isinstance(v, dict) else len(v))


def test_many_files_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(preview, "OPEN", 3)
    rows = [(f"f{i % 40}", i, json.dumps({"a": i}), False) for i in range(2000)]
    got = preview.preview_tables(spark.createDataFrame(rows, "file string, pos long, text string, lone boolean")).collect()
    assert len(got) == 40 and all(r.n_items == 50 and r.rows == [[str(int(r.file[1:]) + 40 * k)] for k in range(10)] for r in got)
    assert preview.preview_tables(spark.createDataFrame([], "file string, pos long, text string")).count() == 0


def test_result_preview(spark):
    d = spark.createDataFrame([(i, json.dumps({"n": i, "t": "é"})) for i in range(25)], "pos long, value string").repartition(3)
    text, cut, note = preview.result_preview(d, ("pos",))
    assert json.loads(text) == [{"n": i, "t": "é"} for i in range(10)] and not cut and note == "JSON limite aux 10 premiers elements sur 25."
    text, cut, note = preview.result_preview(d.where("pos < 3"), ("pos",), chars=20)
    assert len(text) == 20 and cut and note == "Sortie formatee limitee a 20 caracteres."
    assert preview.result_preview(d.where("false"), ("pos",)) == ("[]", False, "")


def test_extensions(spark):
    d = spark.createDataFrame([("a.JSON",), ("b.tar.Gz",), ("none",), ("dot.",)], "name string").select(readers.extension(F.col("name")).alias("e"))
    assert [r.e for r in d.collect()] == ["json", "gz", "", ""]
