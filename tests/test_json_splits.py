"""JSON files read in splits: every cut of small files against Python's json, and a larger one in many tasks."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest

from docmill.functions import jsvalue
from docmill.sources import jsonsplit, readers


def value(rng, depth):
    r = rng.random()
    if depth == 0 or r < 0.4:
        return rng.choice([None, True, 1.5, "a,b", 'q"uo,te\\', "\\\\", "]},{[", "é\n,", "", "x" * rng.randrange(9)])
    if r < 0.7:
        return [value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b,", '"k', "]"]): value(rng, depth - 1) for _ in range(rng.randrange(4))}


def expected(v, array=False):
    items = v if isinstance(v, list) else [v]
    return [jsvalue.write(jsvalue.parse(json.dumps(x if isinstance(x, dict) or array else {"value": x}))) for x in items]


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "64b", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_states_at_commas():
    rng = random.Random(3)
    for _ in range(300):
        text = json.dumps(value(rng, 4), ensure_ascii=rng.random() < 0.5, indent=rng.choice((None, 1)))
        parts = text.split(",")
        inside, depth, want = False, 0, []
        at = 0
        for p in parts:
            for c in p:
                escaped = inside and at and text[at - 1] == "\\" and (at - len(text[:at].rstrip("\\"))) % 2 == 1
                if c == '"' and not escaped:
                    inside = not inside
                elif not inside:
                    depth += (c in "[{") - (c in "]}")
                at += 1
            at += 1
            want.append((inside, depth))
        odd, outer, _ = jsonsplit.ends(pa.array(parts))
        assert list(zip(odd.tolist(), outer.tolist(), strict=True)) == want
        # from any fragment on, the state follows from that before it
        k = rng.randrange(len(parts))
        odd, outer, inner = jsonsplit.ends(pa.array(["junk", *parts[k:]]).slice(1))
        inside, depth = want[k - 1] if k else (False, 0)
        assert [(bool(o ^ inside), int(depth + (i if inside else u))) for o, u, i in zip(odd, outer, inner, strict=True)] == want[k:]


def test_items_of_files_in_many_splits(spark, tmp_path, small_splits):
    rng = random.Random(5)
    want = {}
    for n in range(12):
        v = [value(rng, 3) for _ in range(rng.randrange(0, 25))] if n % 4 else value(rng, 3)
        (tmp_path / f"f {n}+%.json").write_text(json.dumps(v, ensure_ascii=False, indent=rng.choice((None, 2))))
        want[f"f {n}+%.json"] = expected(v)
    df = readers.read_json(spark, str(tmp_path))
    got = {name: [] for name in want}
    for r in df.orderBy("file", "pos").collect():
        got[r.file].append((r.pos, r.text))
    assert {k: [t for _, t in v] for k, v in got.items()} == want and all([p for p, _ in v] == list(range(1, len(v) + 1)) for v in got.values())
    assert jsonsplit.fragments(spark, str(tmp_path)).select("block").distinct().count() > 3


@pytest.mark.parametrize("text", ['[1,]', "[1,,2]", "[1", '["a]', "[1},2]", "[1],[2]", "[1]x", "", " \n", '{"a":1}}', "[,1]", "nul"])
def test_bad_files(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text or "\n")
    with pytest.raises(Exception, match="JSON|Expecting|Extra"):
        readers.read_json(spark, str(tmp_path / "bad.json")).collect()


def test_one_array_in_many_tasks(spark, tmp_path):
    rng = np.random.default_rng(1)
    items = [{"id": i, "text": "word, " * int(rng.integers(0, 200)), "more": [{"k": "]"}] * int(rng.integers(0, 3))} for i in range(20000)]
    (tmp_path / "big.json").write_text(json.dumps(items))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        df = readers.read_json(spark, str(tmp_path / "big.json"), objects=True)
        assert jsonsplit.fragments(spark, str(tmp_path / "big.json")).select("block").distinct().count() >= 8
        got = {r.pos: json.loads(r.text) for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == dict(enumerate(items, 1))


def test_deep_and_odd_texts(spark, tmp_path):
    deep = "[" * 3000 + '"x"' + "]" * 3000
    (tmp_path / "a.json").write_text('[{"a": "\\ud800x", "token": "\\udc00"}, {"b": %s}, {"%s": "1.2.3.4"}, {"\\ud801": ["\ufdd0"]}]' % (deep, "9" * 5000))
    from docmill.operators import dynamic

    df = readers.read_json(spark, str(tmp_path / "a.json"), objects=True)
    got = [r.record for r in dynamic.transform(df.select("pos", "text")).orderBy("pos").collect()]
    assert got[0] == '{"a":"\\ud800x","token":"[SECRET_REDACTED]"}' and got[1] == '{"b":%s}' % deep
    assert got[2] == '{"%s":"[IP_REDACTED]"}' % ("9" * 5000) and got[3] == '{"\\ud801":["\ufdd0"]}'
    docs = dynamic.documents(dynamic.transform(df.select("pos", "text")), "a.json", "json", "json-cleaner").orderBy("pos").collect()
    assert len(docs) == 4 and '"a":"\\ud800x"' in docs[0].value


def test_dynamic_paths_are_kept():
    from docmill.operators import dynamic

    out = []
    dynamic.texts({"a": ["x", {"b": "y", "c": 1}], "": "z"}, "", out)
    assert out == [("a[0]", "x"), ("a[1].b", "y"), ("", "z")]
