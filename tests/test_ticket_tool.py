"""The ticket tool: objects with their messages, switches one by one, diagnostics; order and repeats without a window."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docmill.operators import gather, ordering, tickets, tools
from docmill.sources import sinks

ITEMS = [
    {
        "id": 7,
        "sujet": "VÃ©rifier  l'accÃ¨s token: abc",
        "client": "ACME",
        "heures_passees": "1,5",
        "cree_le": "bientôt",
        "messages": [
            {"contenu_texte": "La solution est de relancer le serveur 10.1.2.3 en version 2.10, merci de patienter", "sujet": "b", "date": "08/01/2025", "auteur": "Zoé  M"},
            5,
            {"contenu_texte": "rÃ©solu : mot de passe: hunter2, corriger l'erreur \u0007de la base", "sujet": "password: x1", "auteur": "Bob"},
            {"contenu_texte": "rÃ©solu : mot de passe: hunter2, corriger l'erreur \u0007de la base", "sujet": "password: x1", "date": "plus tard"},
            {"contenu_texte": "Une anomalie  est\r\nconstatée dans le module de facturation", "date": "07/01/2025"},
            {"contenu_texte": "  "},
            {"contenu_texte": "Une erreur de plus dans le module", "date": "jamais"},
        ],
    },
    "no ticket",
    {"ticket_id": "T-2", "sujet": "divers", "messages": []},
    {"sujet": "Impossible de se connecter", "heures_passees": 2, "categorie": " Facturation ", "messages": [{"contenu_texte": "Impossible de synchroniser les données clients du site"}]},
]


def items(spark, objects=ITEMS):
    return spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(objects, 1)], "pos int, text string").withColumn("record", F.parse_json("text"))


def written(lines, path):
    sinks.write_lines(lines, str(path))
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


TOOL = tools.TOOLS["support-ticket-cleaner"]


@pytest.fixture(scope="module")
def result(spark):
    return TOOL.run(items(spark), tools.with_options(TOOL, keep_author=True), "t.json")


def test_messages_in_their_tickets(result, tmp_path):
    text = written(result.lines, tmp_path / "out")
    out = json.loads(text)
    assert text == json.dumps(out, indent=2, ensure_ascii=False) + "\n"
    assert [t.get("ticket_id") for t in out] == ["7", "T-2", None] and [len(t["messages"]) for t in out] == [4, 0, 1]
    assert list(out[0]) == ["ticket_id", "sujet", "client", "heures_passees", "cree_le_raw", "messages", "ticket_kind", "relevance_score", "relevance_flags", "rag_candidate"]
    assert out[0]["sujet"] == "Vérifier l'accès token: [SECRET_REDACTED]" and out[0]["heures_passees"] == 1.5 and out[2]["heures_passees"] == 2 and out[2]["categorie"] == "Facturation"
    said = out[0]["messages"]
    # by time, then undated ones in source order; of two that say the same the first
    assert [m["sujet"] for m in said] == ["", "b", "password: [SECRET_REDACTED]", ""]
    assert [m.get("date") for m in said] == ["2025-01-07T00:00:00.000Z", "2025-01-08T00:00:00.000Z", None, None] and [m.get("date_raw") for m in said] == [None, None, None, "jamais"]
    assert said[0]["contenu_texte"] == "Une anomalie est\nconstatée dans le module de facturation"
    assert said[2]["contenu_texte"] == "résolu : mot de passe: [SECRET_REDACTED], corriger l'erreur de la base"
    assert [m.get("auteur") for m in said] == [None, "Zoé M", "Bob", None]


def test_compact_objects(spark, tmp_path):
    r = TOOL.run(items(spark), tools.with_options(TOOL, pretty=False))
    out = json.loads(written(r.lines, tmp_path / "out"))
    assert "auteur" not in json.dumps(out) and [len(t["messages"]) for t in out] == [4, 0, 1]
    assert json.loads(written(r.lines.where("false"), tmp_path / "none")) == []


def test_diagnostics_have_all_fields(result, tmp_path):
    d = result.diagnostics.first().asDict(recursive=True)
    assert list(d) == [x.split()[0] for x in gather.SCHEMA.split(", ")] and len(d) == 23
    out = json.loads(written(result.lines, tmp_path / "out"))
    blank = lambda x: sum(map(blank, x.values() if isinstance(x, dict) else x)) if isinstance(x, (dict, list)) else int(isinstance(x, str) and not x.strip())
    words = len(json.dumps(out, separators=(",", ":"), ensure_ascii=False).split())
    assert d["rowCount"] == 4 and d["emptyFieldCount"] == blank(out) == 3 and d["estimatedTokens"] == -(-words * 13 // 10) and d["durationMs"] > 0
    assert d["redactionCounts"] == {"secret": 5, "certificate": 0, "ip": 1, "internalPath": 0}  # repeats count too
    assert [(f["type"], f["fieldPath"]) for f in d["redactionFindings"]] == [("secret", "sujet"), ("ip", "messages[0].contenu_texte"), *[("secret", f"messages[{i}].{x}") for i in (2, 3) for x in ("contenu_texte", "sujet")]]
    assert d["warnings"] == ["Ticket 7: message 2 ignored because it is not an object.", "Ticket 7: message 7 date not converted.", "Ticket 7: cree_le date not converted.", "Element 2: ticket ignored because it is not an object."]
    r = result.report.first()
    assert (r.inputTickets, r.outputTickets, r.removedMessages, r.ticketsWithoutUsefulMessages, r.redactedSecrets, r.redactedIps) == (4, 3, 3, 1, 5, 1) and r.warnings == d["warnings"]
    assert result.findings.count() == 6


@pytest.mark.parametrize(
    "option, text",
    [
        ({"redact_sensitive": False}, "mot de passe: hunter2"),
        ({"redact_kinds": ("ip",)}, "token: abc"),
        ({"redact_kinds": ("secret",)}, "10.1.2.3"),
        ({"fix_encoding": False}, "rÃ©solu"),
        ({"strip_control_chars": False}, "\\u0007"),
        ({"normalize_whitespace": False}, "Une anomalie  est\\r\\nconstatée"),
        ({"keep_author": True}, "Zoé M"),
        ({"keep_client": True, "redact_client": True}, "[CLIENT_REDACTED]"),
    ],
)
def test_switches(spark, tmp_path, result, option, text):
    standard = written(TOOL.run(items(spark)).lines, tmp_path / "standard")
    assert text not in standard and text in written(TOOL.run(items(spark), tools.with_options(TOOL, **option)).lines, tmp_path / "out")


def test_exports_by_score(spark, tmp_path):
    out = json.loads(written(TOOL.run(items(spark), tools.with_options(TOOL, min_score=60)).lines, tmp_path / "out"))
    assert out and all(t["relevance_score"] >= 60 for t in out) and len(out) < 3


def test_article_switches(spark):
    tool = tools.TOOLS["odoo-knowledge-cleaner"]
    body = "<p>rÃ©glage  du serveur 10.1.2.3, token: abc</p><img src=\"data:image/png;base64,AAAA\"> " + "texte " * 30
    df = items(spark, [{"id": 1, "titre": "A\u0007  b", "corps": body, "created_at": "x"}, {"id": 2, "actif": False}, {"corps": "court"}, 3])
    r = tool.run(df, None, "a.json")
    base = r.data.first()
    assert "réglage du serveur [IP_REDACTED], token: [SECRET_REDACTED]" in base.body_markdown and "base64" not in base.body_markdown and base.title == "A b"
    d = r.diagnostics.first()
    assert (d.rowCount, d.exportedArticles, d.excludedEmptyArticles, d.excludedInactiveArticles, d.removedBase64Images, d.redactionCounts.ip) == (4, 1, 1, 1, 1, 1)
    assert d.emptyFieldCount == 4 and d.warnings == ["Article 1: date de creation non convertie.", "Element 4: article ignore car ce n'est pas un objet."]
    assert [(f.type, f.fieldPath) for f in d.redactionFindings] == [("secret", "article_1.corps"), ("ip", "article_1.corps")]
    for option, text in (({"redact_sensitive": False}, "token: abc"), ({"fix_encoding": False}, "rÃ©glage"), ({"remove_base64_images": False}, "")):
        got = tool.run(df, tools.with_options(tool, **option)).data.first()
        assert text in got.body_markdown and (text not in base.body_markdown if text else got.n_images == 0)
    off = tool.run(df, tools.with_options(tool, strip_control_chars=False, normalize_whitespace=False)).data.first()
    assert off.title == "A\u0007  b"
    docs = tool.run(df, tools.with_options(tool, output_mode="rag"))
    told = docs.diagnostics.first()
    content = docs.documents.first().content
    assert told.documentCount == 1 and told.estimatedTokens == -(-len(content.split()) * 13 // 10)


def test_places_of_hot_groups(spark):
    """A group of half the rows lies over many partitions; places are those of a window."""
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else rng.choice((None, "a", "b", f"g{rng.randrange(200)}")), rng.choice((None, rng.randrange(100))), i) for i in range(5000)]
    d = spark.createDataFrame(rows, "g string, t long, pos long").repartition(6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        order = [F.col("t").isNull().asc(), F.col("t").asc(), F.col("pos").asc()]
        got = {r.pos: r.place for r in ordering.ranked(d, "g", order).collect()}
        assert "Window" not in ordering.ranked(d, "g", order)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    groups = {}
    for g, t, pos in rows:
        groups.setdefault(g, []).append((t is None, t or 0, pos))
    assert got == {pos: k for g in groups.values() for k, (*_, pos) in enumerate(sorted(g), 1)}
    assert ordering.ranked(d.where("false"), "g", order).count() == 0


def test_dealt_join_of_hot_keys(spark):
    big = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(3000)], "pos long, k string")
    small = big.groupBy("k").agg(F.min("pos").alias("first"))
    counts = big.groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        got = ordering.dealt_join(big, small.where("k <> 'k0'"), "k", counts, 3000, ("pos",), how, least=100)
        assert got.count() == (2999 if how == "inner" else 3000) and got.where("k = 'hot'").agg(F.min("first")).first()[0] == 1


def test_one_ticket_with_all_messages(spark, tmp_path):
    m = spark.range(4000).select(F.lit(1).cast("long").alias("ticket_id"), F.col("id").alias("pos"), (-F.col("id")).alias("sort_time"), F.lit("").alias("subject"), F.concat(F.lit("Une erreur de synchronisation, la numero "), F.col("id") % 3000, F.lit(" de la serie")).alias("content"), F.lit("").alias("author"))
    t = spark.createDataFrame([(1, "x", 1.0)], "ticket_id long, subject string, hours double")
    r = tools.clean_tickets(t, m, None, TOOL.defaults)
    (out,) = json.loads(written(r.lines, tmp_path / "out"))
    assert [int(x["contenu_texte"].split()[6]) for x in out["messages"]] == list(range(2999, -1, -1))
    assert tickets.clean_messages(m).where("drop_reason = 'duplicate'").count() == 1000
