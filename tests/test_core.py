"""Literal vectors of the text rules, and every query against its SQL at the smallest scale."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from docmill.functions import dates, keys, markdown, redact, text
from docmill.operators import diagnostics, qualify, records, tickets
from docmill.plans.catalogue import ORACLES, QUERIES
from docmill.sources import readers
from docmill.streaming.rows import redacted_stream

SF = "/root/testdata/sf0.001"


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize("value, out", [(" a\u00a0 b\r\n\r\n\r\nc ", "a b\n\nc"), ("\ufeffx\u2003", "x"), ("x\u0085", "x\u0085"), ("", "")])
def test_whitespace(spark, value, out):
    assert one(spark, value, text.normalize_whitespace) == out


@pytest.mark.parametrize("value, out", [("&amp;lt;", "<"), ("&#233;&#xE9;", "éé"), ("&copy;", "&copy;"), ("&#x1F600;", "\U0001f600"), ("&#99999999;", "&#99999999;")])
def test_entities(spark, value, out):
    assert one(spark, value, text.decode_entities) == out


@pytest.mark.parametrize("value, out, n", [("Ã©tÃ©", "été", 2), ("ÃƒÂ©", "é", 2), ("Âge", "Âge", 0), ("résolu", "résolu", 0), ("a\u0085b", "ab", 1)])
def test_encoding(spark, value, out, n):
    assert one(spark, value, lambda c: F.struct(*text.fix_encoding(c))) == (out, n)


@pytest.mark.parametrize("value, out", [("password: x, y", "password: [SECRET_REDACTED], y"), ("éapi_key='k';", "éapi_key='[SECRET_REDACTED]';"), ("access_token=x", "access_token=x"), ('token "x" tail', 'token "x" tail'), ("1.2.3.4", "[IP_REDACTED]"), (r"\\h\s\f x", "[INTERNAL_PATH_REDACTED] x")])
def test_redaction(spark, value, out):
    assert one(spark, value, lambda c: redact.redact(c)[0]) == out


def test_markdown(spark):
    html = '<h1>T <b>x</b></h1><p>a <a href="/u">l</a></p><ul><li>i</li></ul><pre>c</pre><!-- n -->'
    d = markdown.html_to_markdown(spark.createDataFrame([(html,)], "h string"), "h")
    assert d.first()["markdown"] == "# T x\n\na [l](/u)\n\n- i\n\n```\nc\n```"


@pytest.mark.parametrize(
    "value, article, ticket",
    [
        ("45000", "2023-03-15T00:00:00.000Z", "2023-03-15T00:00:00.000Z"),
        ("45000,5", None, "2023-03-15T12:00:00.000Z"),
        ("1736239170123", "2025-01-07T08:39:30.123Z", "2025-01-07T08:39:30.123Z"),
        ("2024-13-45", None, None),
        ("2024-13-45 10:00", None, "2025-02-14T10:00:00.000Z"),
        ("2025-01-07T08:39:30+02:00", "2025-01-07T06:39:30.000Z", "2025-01-07T06:39:30.000Z"),
        ("2025-01-07T08:39:30.123Z", "2025-01-07T08:39:30.123Z", "2025-01-07T08:39:30.123Z"),
        ("2025-01-07 08:39", "2025-01-07T08:39:00.000Z", "2025-01-07T08:39:00.000Z"),
        ("07/01/2025 08:39", "2025-07-01T08:39:00.000Z", "2025-01-07T08:39:00.000Z"),
        ("7/1/2025", "2025-07-01T00:00:00.000Z", "2025-07-01T00:00:00.000Z"),
        ("99/99/2024", None, "2032-06-07T00:00:00.000Z"),
        ("Jan 5, 2025", "2025-01-05T00:00:00.000Z", "2025-01-05T00:00:00.000Z"),
        ("Tue, 07 Jan 2025 08:39:30 GMT", "2025-01-07T08:39:30.000Z", "2025-01-07T08:39:30.000Z"),
        ("7 January 2025 08:39 -0130", "2025-01-07T10:09:00.000Z", "2025-01-07T10:09:00.000Z"),
        ("soon", None, None),
        ("5", None, None),
    ],
)
def test_dates(spark, value, article, ticket):
    for want, is_ticket in ((article, False), (ticket, True)):
        got = one(spark, value, lambda c, t=is_ticket: dates.parse_date(c, ticket=t))
        assert got["iso"] == want and got["raw"] == (None if want else value)


def test_keys():
    assert keys.normalize_keys(["Crééà le", "Nom", "Nom", ""]) == ["creea_le", "nom", "nom_1", "field_4"]


def test_table_source(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Nom,Nom\na,b,c\n , \n\"x,y\",z\n")
    assert [tuple(r) for r in readers.read_table(spark, str(tmp_path / "t.csv")).drop("file").collect()] == [(1, "a", "b", "c"), (2, "x,y", "z", "")]


def test_failed_labels_are_kept(spark):
    def caller(item):
        raise RuntimeError("Bearer abc")

    d = spark.createDataFrame([("1", "", "", "t")], "id string, title string, categorie string, content string")
    assert tuple(qualify.qualify(d, caller, retries=1, backoff_ms=1).first()) == ("1", "UNKNOWN", [], "", "Bearer [SECRET_REDACTED]")


def test_stream(spark, tmp_path):
    s = spark.readStream.schema(spark.read.parquet(f"{SF}/documents.parquet").schema).parquet(f"{SF}/documents.parquet*")
    q = redacted_stream(s).writeStream.format("memory").queryName("redacted").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("redacted").count() == spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    d = QUERIES[name](spark, SF)
    cols = sorted(d.columns)
    fix = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    got = [fix(r) for r in d.select(*cols).collect()]
    assert got
    if name in ORACLES:
        c = duckdb.connect()
        for f in os.listdir(SF):
            c.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
        want = [fix(r) for r in c.sql(f"SELECT {', '.join(f'\"{x}\"' for x in cols)} FROM ({ORACLES[name]})").fetchall()]
        assert sorted(map(str, got)) == sorted(map(str, want))


_ODD = [
    *[(i, f"some words {i}\tof\x0btext", "en") for i in range(-6, 7)],
    *[(11, None, "en"), (12, "", "en"), (13, " \n\u00a0", "en"), (14, "a b", None), (16, "a b", " "), (None, "a b", ""), (15, None, None), (20, "", " ")],
    *[(21 + i, f"a{chr(c)}b", "en") for i, c in enumerate((0x1C, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))],
]


@pytest.mark.parametrize("rows", [_ODD, [(i, None, "en") for i in range(4)], []], ids=["odd", "no_text", "no_rows"])
def test_document_diagnostics_on_odd_rows(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES["document_diagnostics"](spark, str(tmp_path)).collect()]
    assert got == c.sql(ORACLES["document_diagnostics"]).fetchall()


def test_diagnostics_by_the_tools_rules(spark):
    d = spark.createDataFrame([("a\u2003b c", "en"), ("", None), (" \ufeff", "x"), (None, " "), ("é", "x")], "content string, lang string")
    assert tuple(diagnostics.diagnostics(d, fields=("lang",)).first()) == (5, 4, 5, 6)
    assert tuple(diagnostics.diagnostics(d.where("false"), fields=("lang",)).first()) == (0, 0, 0, 0)


def test_links_on_whole_texts(spark, tmp_path):
    texts = {3: "word " * 100, 9: "short", 21: "\n".join(["word " * 40] * 3), 24: "a " * 60000 + "end"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plain = {r.doc_id: r for r in QUERIES["markdown_plain"](spark, str(tmp_path)).collect()}
    assert all(plain[i].plain.split()[: len(t.split())] == t.split() for i, t in texts.items())
    assert [plain[i].n_links for i in texts] == [1, 5, 5, 0]
    m = {r.doc_id: r for r in QUERIES["menu_metrics"](spark, str(tmp_path)).collect()}
    assert [m[i].is_menu for i in texts] == [False, True, False, False] and m[21].n_outside >= 599 and m[24].n_outside == len(texts[24])


def test_ticket_texts_are_not_gathered(spark):
    said = [(1, 1, "La solution est là", "a"), (1, 2, "corriger en 2.10", None), (2, 1, "une erre", "x"), (2, 2, "ur maj", "y"), (3, 1, None, "UPDOWN.io")]
    m = spark.createDataFrame([(t, p, None, "", c, a) for t, p, c, a in said], "ticket_id long, pos long, sort_time long, subject string, content string, author string")
    t = spark.createDataFrame([(i, "", "", "", "", 1.0) for i in (1, 2, 3, 4)], "ticket_id long, subject string, category string, type string, team string, hours double")
    d = tickets.process(t, m)
    got = {r.ticket_id: r for r in d.collect()}
    assert "collect_list" not in d._jdf.queryExecution().optimizedPlan().toString() and not any("\n" in x for terms in tickets.TERMS.values() for x in terms)
    assert {"resolution_explicit", "correction_version"} <= set(got[1].flags) and "anomalie_metier" not in got[2].flags
    assert got[3].ticket_kind == "monitoring" and got[4].ticket_kind == "empty"


def test_json_values():
    from docmill.functions import jsvalue

    text = '{"b": 1.0, "2": "x", "a": [1e21, 1e-7, 0.00001, 12345678901234567890, -0.5, true, null], "1": {"z": {}, "y": []}, "b": 2}'
    assert jsvalue.write(jsvalue.parse(text)) == '{"1":{"z":{},"y":[]},"2":"x","b":2,"a":[1e+21,1e-7,0.00001,12345678901234567000,-0.5,true,null]}'
    assert jsvalue.write({"a": [1.0, {"b": "é\n"}], "c": []}, 2) == '{\n  "a": [\n    1,\n    {\n      "b": "é\\n"\n    }\n  ],\n  "c": []\n}'
    for bad in ("{", "NaN", '{"a": Infinity}'):
        with pytest.raises(ValueError):
            jsvalue.parse(bad)


def test_dynamic_records(spark):
    from docmill.operators import dynamic

    rows = [
        (1, '{"b": " x ", "a": {"c": ["password: k1, ", 3, {"d": "1.2.3.4"}]}, "token": "", "drop": "1.2.3.4", "n": 1.0, "e": "  ", "z": null}'),
        (2, '{"old": "rÃ©solu", "new": "first", "k": ["", null, {}], "cert_file": "a.pem"}'),
        (3, None),
    ]
    d = dynamic.transform(spark.createDataFrame(rows, "pos int, text string"), exclude=("drop",), renames={"old": "new", "b": ""})
    got = {r.pos: r for r in d.collect()}
    assert got[1].record == '{"b":"x","a":{"c":["password: [SECRET_REDACTED],",3,{"d":"[IP_REDACTED]"}]},"token":"[SECRET_REDACTED]","n":1}'
    assert got[2].record == '{"new":"first","k":["",null,{}],"cert_file":"[CERTIFICATE_REDACTED]"}' and got[2].n_fixes == 1 and got[2].n_empty == 2
    assert [(f.type, f.fieldPath) for f in got[1].findings] == [("secret", "a.c[0]"), ("ip", "a.c[2].d"), ("secret", "token")]
    assert (got[1].n_secret, got[1].n_ip, got[2].n_certificate, got[3].record) == (2, 1, 1, None)
    r = dynamic.diagnostics(d.where("pos < 3"), ["x.json"], most_findings=2).first()
    assert (r.rowCount, r.emptyFieldCount, r.redactionCounts.secret, len(r.redactionFindings)) == (2, 2, 2, 2)
    words = len(("[" + got[1].record + "," + got[2].record + "]").split())
    assert r.estimatedTokens == -(-words * 13 // 10)
    docs = dynamic.documents(d.where("pos = 1"), "x.json", "json", "json-cleaner").first()
    assert docs.content == 'b: x\na: {"c":["password: [SECRET_REDACTED],",3,{"d":"[IP_REDACTED]"}]}\ntoken: [SECRET_REDACTED]\nn: 1'
    assert docs.value.startswith('{"metadata":{"source_file":"x.json","source_type":"json","tool":"json-cleaner","row":1,"b":"x","token":"[SECRET_REDACTED]","n":1},"content":"b: x\\na')


def test_json_files(spark, tmp_path):
    for name, text in (("a", '[{"b": 1, "a": 2}, 5]'), ("o", '{"x": [1]}'), ("s", '"text"'), ("bad", "{"), ("none", " \n")):
        (tmp_path / f"{name}.json").write_text(text)
    read = lambda n, **k: [(r.file, r.pos, r.text) for r in readers.read_json(spark, str(tmp_path / f"{n}.json"), **k).orderBy("pos").collect()]
    assert read("a") == [("a.json", 1, '{"b":1,"a":2}'), ("a.json", 2, '{"value":5}')]
    assert read("o") == [("o.json", 1, '{"x":[1]}')] and read("s") == [("s.json", 1, '{"value":"text"}')]
    for name, more in (("bad", {}), ("none", {}), ("o", {"array": True}), ("a", {"objects": True})):
        with pytest.raises(Exception, match="JSON|Expecting"):
            read(name, **more)
    with pytest.raises(ValueError):
        readers.one_input([])


def test_sheets(spark, tmp_path):
    import datetime

    (tmp_path / "t.xlsx").write_bytes(b"x")
    sheet = [[None, None], ["Nom", "Créé le", None], ["a", datetime.date(2025, 1, 7), 3], [" ", "", None], ["b", None, None]]
    rows = readers.read_sheets(spark, str(tmp_path / "t.xlsx"), lambda content: sheet).drop("file").collect()
    assert [r.asDict() for r in rows] == [{"row": 1, "nom": "a", "cree_le": "2025-01-07", "field_3": "3"}, {"row": 2, "nom": "b", "cree_le": "", "field_3": ""}]


def test_document_lines(spark):
    d = spark.createDataFrame([(1, "x" * 80, "y" * 81, None, 2.0, True), (2, "\U0001f600" * 40, "", "t", 0.5, False)], "row int, short string, long string, tool string, n double, ok boolean")
    lines = [r.value for r in records.to_jsonl(records.to_document(d, "row", "f.csv", "csv", "table")).collect()]
    one_, two = (json.loads(x) for x in lines)
    assert list(one_["metadata"]) == ["source_file", "source_type", "tool", "row", "short", "n", "ok"] and one_["metadata"]["tool"] is None and '"n":2,' in lines[0]
    assert two["metadata"]["long"] == "" and two["metadata"]["short"] == "\U0001f600" * 40 and two["content"].endswith("tool: t\nn: 0.5\nok: false")


def test_sinks(spark, tmp_path):
    from docmill.sources import sinks

    rows = spark.createDataFrame([(i, f'{{"a":{i}}}') for i in range(5)], "pos int, value string")
    sinks.write_json_array(rows, str(tmp_path / "out"), ["pos"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == json.dumps([{"a": i} for i in range(5)], indent=2) + "\n"
    sinks.write_json_array(rows.where("false"), str(tmp_path / "none"), ["pos"])
    assert "".join(p.read_text() for p in (tmp_path / "none").glob("part-*")) == "[]\n"
    pages = spark.createDataFrame([("my_file-a.pdf", 2, "two"), ("my_file-a.pdf", 1, None)], "file string, page int, text string")
    sinks.write_markdown(sinks.pages_to_markdown(pages), str(tmp_path / "md"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "md" / "file=my_file-a.pdf").glob("part-*")))
    assert text == "# my file a\n\n## Page 1\n\n\n\n## Page 2\n\ntwo\n"
    sizes = [one(spark, str(n), lambda c: sinks.format_bytes(c.cast("long"))) for n in (5, 2048, 3 * 1024 * 1024)]
    assert sizes == ["5 o", "2.0 Ko", "3.0 Mo"]


def test_tickets_from_items(spark):
    items = [
        '{"id": 7, "sujet": "Été &amp; test", "client": "ACME", "heures_passees": "1,5", "cree_le": "bientôt", "etiquettes": ["a", "b"], "messages": [{"contenu_texte": "La solution rÃ©solue en 2.10 est de relancer", "sujet": "ETE &amp; TEST", "date": "07/01/2025"}, 5, {"contenu_texte": "La solution résolue en 2.10 est de relancer", "date": "x"}, {"contenu_texte": " "}]}',
        '"no"',
    ]
    d = spark.createDataFrame(list(enumerate(items, 1)), "pos int, j string").select("pos", F.parse_json("j").alias("item"))
    t, m, w = tickets.from_items(d)
    p = tickets.scored(tickets.clean_tickets(t), tickets.judged_messages(m, "ticket_subject"))
    r = tickets.ticket_records(p).first()
    assert (r.ticket_id, r.sujet, r.client, r.heures_passees, r.cree_le, r.cree_le_raw, r.etiquettes) == ("7", "Été &amp; test", "ACME", 1.5, None, "bientôt", "a,b")
    assert {"resolution_explicit", "correction_version", "heures_passees", "doublon_probable"} <= set(r.relevance_flags)
    q = tickets.clean_messages(m, "ticket_subject")
    said = tickets.message_records(q).collect()
    assert [(x.sujet, x.contenu_texte, x.date) for x in said] == [("", "La solution résolue en 2.10 est de relancer", "2025-01-07T00:00:00.000Z")]
    assert tickets.report(p).first().n_removed == 3
    # message 3 says what message 1 says, so its date is of no interest
    w = w.unionByName(tickets.date_warnings(tickets.clean_tickets(t), tickets.final_messages(tickets.judged_messages(m, "ticket_subject"))))
    assert [x.text for x in w.orderBy("pos", "seq").collect()] == ["Ticket 7: message 2 ignored because it is not an object.", "Ticket 7: cree_le date not converted.", "Element 2: ticket ignored because it is not an object."]


def test_qualifier_parts():
    item = {"id": "1", "title": "é", "categorie": "", "content": "c"}
    r = qualify.request(item, "p1", "2")
    assert r["prompt"] == {"id": "p1", "version": "2"} and json.loads(r["input"][0]["content"][0]["text"]) == item and "version" not in qualify.request(item, "p1")["prompt"]
    with pytest.raises(ValueError):
        qualify.request(item, None)
    assert qualify.response_text({"output_text": " ", "output": [{"content": [{"text": "a"}, {"text": 5}, 3]}, None, {"content": [{"text": "b "}]}]}) == "a\nb"
    assert qualify.response_text({"output_text": "x"}) == "x" and qualify.response_text(None) == ""
    assert [qualify.clamp(v, 5, 1, 20) for v in (None, 0, 7.9, 99, float("nan"), True)] == [5, 1, 7, 20, 5, 5]


def test_tools(spark, tmp_path):
    from docmill.operators import tools

    assert {k: len(v) for k, v in tools.by_kind().items()} == {"converter": 2, "processor": 2, "qualifier": 1}
    (tmp_path / "a.json").write_text('[{"id": 1, "title": "<b>T</b>", "token": "x", "body_markdown": "hello"}, {"id": 2, "content": null, "t": "' + "y" * 90 + '"}]')
    df = readers.read_json(spark, str(tmp_path / "a.json"))
    tool = tools.get_tool("json-cleaner")
    with pytest.raises(ValueError):
        tool.run(df, tools.with_options(tool, output_mode="document"))
    r = tool.run(df, tools.with_options(tool, output_mode="jsonl"), "a.json")
    lines = [x.value for x in r.output.orderBy("pos").collect()]
    assert json.loads(lines[0])["metadata"]["token"] == "[SECRET_REDACTED]" and json.loads(lines[0])["metadata"]["title"] == "T" and "t" not in json.loads(lines[1])["metadata"]
    assert r.report_output.first().rowCount == 2 and tool.run(df).documents is None
    off = tool.run(df, tools.with_options(tool, redact_sensitive=False)).data.orderBy("pos").first()
    assert '"token":"x"' in off.record and off.n_secret == 0
    sent = []
    q = tools.qualifier(qualify.client_caller(lambda request: {"output_text": '{"level": "N1", "tags": ["A"]}'} if not sent else None, "p"), 1)
    got = q.run(df)
    assert [(x.level, x.tags) for x in got.data.orderBy("pos").collect()] == [("N1", ["a"])] * 2
    assert got.diagnostics.first().qualifiedItems == 2 and q.run(df, tools.with_options(q, enable_qualification=False)).diagnostics.first().qualifiedItems == 0
    t = tools.get_tool("support-ticket-cleaner").run(df)
    assert t.report_output.first().inputTickets == 2 and t.warnings.count() == 0
    a = tools.get_tool("odoo-knowledge-cleaner")
    assert a.run(df, tools.with_options(a, min_body_length=0, output_mode="rag")).documents.count() == 2


def test_pdf_tool(spark, tmp_path):
    from docmill.operators import tools

    (tmp_path / "f.pdf").write_bytes(b"one|two 1.2.3.4")
    pages = readers.file_pages(spark, str(tmp_path / "f.pdf"), lambda content: [[x, "end"] for x in content.decode().split("|")]).withColumnRenamed("path", "file")
    tool = tools.get_tool("pdf-to-markdown")
    text = [r.markdown for r in tool.run(pages).output.orderBy("page").collect()]
    assert text[1:] == ["\n## Page 1\n\none end", "\n## Page 2\n\ntwo [IP_REDACTED] end"]
    docs = tool.run(pages, tools.with_options(tool, output_mode="rag")).output.collect()
    assert sorted((d.metadata.page, d.content) for d in docs) == [(1, "one end"), (2, "two [IP_REDACTED] end")]


def test_command_line(spark, tmp_path, capsys):
    from docmill import __main__ as cli

    (tmp_path / "t.csv").write_text("Nom,Secret\nann,x\nbob,\n")
    out = tmp_path / "out"
    assert cli.main(["csv-xlsx-to-json", str(tmp_path / "t.csv"), str(out), "--rename", "nom:name", "--report", str(tmp_path / "report")]) == 0
    assert json.loads("".join(p.read_text() for p in sorted(out.glob("part-*")))) == [{"name": "ann", "secret": "[SECRET_REDACTED]"}, {"name": "bob", "secret": "[SECRET_REDACTED]"}]
    assert cli.main(["json-cleaner", "a.json", "b.json", str(out)]) == 1
    for bad in (["--rename", "a"], ["--pretty", "maybe"], ["--min-body-length", "-1"], ["--unknown"]):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(["json-cleaner", "a", "b", *bad])
    assert cli.yes_no("Oui") and not cli.yes_no("non") and cli.name_list(" a, ,b") == ("a", "b")


def model_markdown(html):
    """HTML to Markdown step by step with Python's re: an independent plain model."""
    import re

    ws = "[\t-\r    -     　﻿]"
    run = lambda p, to, s: re.sub(p, to, s, flags=re.I | re.A)
    trim = lambda s: re.sub(rf"\A{ws}+|{ws}+\Z", "", s)

    def entities(s):
        for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
            s = run(a, b, s)
        s = run(r"&#([0-9]+);", lambda m: chr(int(m[1])), s)
        return run(r"&#x([0-9a-f]+);", lambda m: chr(int(m[1], 16)), s)

    tags = lambda s: re.sub(r"<[^>]+>", " ", s)
    inline = lambda s: trim(re.sub(r"[ \t]+", " ", entities(tags(s)).replace(" ", " ")))

    def link(m):
        label = trim(re.sub(rf"\A(?:{ws}|[-–—•·|>])+", "", inline(m[2])))
        href = re.search(rf"""href{ws}*={ws}*["']([^"']+)["']""", m[1], re.I)
        return "" if not label else f"[{label}]({href[1]})" if href else label

    s = html
    for p in (r"<!--[\s\S]*?-->", r"<script\b[^>]*>[\s\S]*?</script>", r"<style\b[^>]*>[\s\S]*?</style>"):
        s = run(p, " ", s)
    s = run(r"<pre\b[^>]*>([\s\S]*?)</pre>", lambda m: (lambda x: f"\n\n```\n{x}\n```\n\n" if x else "\n\n")(trim(entities(tags(m[1])))), s)
    s = run(r"<code\b[^>]*>([\s\S]*?)</code>", lambda m: f"`{inline(m[1])}`" if inline(m[1]) else "", s)
    for n in (1, 2, 3):
        s = run(rf"<h{n}\b[^>]*>([\s\S]*?)</h{n}>", lambda m, n=n: f"\n\n{'#' * n} {inline(m[1])}\n\n", s)
    s = run(r"<a\b([^>]*)>([\s\S]*?)</a>", link, s)
    s = run(r"<(strong|b)\b[^>]*>([\s\S]*?)</\1>", lambda m: f"**{inline(m[2])}**", s)
    s = run(r"<(em|i)\b[^>]*>([\s\S]*?)</\1>", lambda m: f"_{inline(m[2])}_", s)
    s = run(r"<li\b[^>]*>([\s\S]*?)</li>", lambda m: f"\n- {inline(m[1])}", s)
    for p, to in ((r"</?(ul|ol)\b[^>]*>", "\n"), (rf"<br{ws}*/?>", "\n"), (r"</(p|div|section|article|tr)>", "\n\n"), (r"<(p|div|section|article|span|table|tbody|thead|tr|td|th)\b[^>]*>", "")):
        s = run(p, to, s)
    s = entities(tags(s))
    for p, to in ((r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (rf"\n-{ws}+", "\n- "), (r"\n{3,}", "\n\n"), (r"\r\n?", "\n"), (" ", " "), (r"[ \t]+", " "), (r"[ \t]*\n[ \t]*", "\n"), (r"\n{3,}", "\n\n")):
        s = re.sub(p, to, s)
    return trim(s)


def test_markdown_against_model(spark):
    """Every whole page of the smallest tables, and hand-made ones, against the plain model."""
    odd = ["<p>a<b>c</p><i>x</b></i> &amp;lt; &#233;&#xE9;", "<h2>T <a href='/x'>l</a></h2><A HREF = \"/y\"> • m </a><a>n</a><a href='/z'> </a>", "<pre> a\n <b>x</b></pre><code></code><ul>\n<li> p <li>q</li></ul>", "  x\r\n\r\n\r\ny <br/>z<script>1</script >", "</p></div>", ""]
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("html").unionByName(spark.createDataFrame([(x,) for x in odd], "html string"))
    rows = markdown.html_to_markdown(pages, "html").collect()
    assert len(rows) > 10 and all(r.markdown == model_markdown(r.html) for r in rows)
    p = {r.url: r for r in QUERIES["article_pages"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = p[r.url].body_markdown
        assert body is not None and (body == model_markdown(r.html) or p[r.url].n_secret + p[r.url].n_certificate + p[r.url].n_ip + p[r.url].n_path > 0 or p[r.url].status == "short")
