"""The command line: tickets, articles, labels, sheets and PDF pages; what it tells of a run."""

import json

from docmill import __main__ as cli


def rows_of_sheet(content):
    return [line.split("|") for line in content.decode().splitlines()]


def pages_of_pdf(content):
    return [[p, "end"] for p in content.decode().split("|")]


def label(item):
    if item["title"] == "bad":
        raise RuntimeError("refused")
    return json.dumps({"level": "N2", "tags": [item["categorie"]], "summary": item["content"]})


def text(path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def run(capsys, *argv):
    code = cli.main(list(map(str, argv)))
    out = capsys.readouterr()
    return code, json.loads(out.out.strip().splitlines()[-1]) if code == 0 else out.err


def test_tickets_and_report(spark, tmp_path, capsys):
    (tmp_path / "t.json").write_text(json.dumps([{"id": 1, "sujet": "x", "messages": [{"contenu_texte": "Une erreur bloque la synchronisation des comptes", "auteur": "Al"}]}, {"id": 2}]))
    code, told = run(capsys, "support-ticket-cleaner", tmp_path / "t.json", tmp_path / "out", "--keep-author", "yes", "--pretty", "no", "--report", tmp_path / "report")
    out = json.loads(text(tmp_path / "out"))
    assert code == 0 and [t["ticket_id"] for t in out] == ["1", "2"] and out[0]["messages"][0]["auteur"] == "Al"
    assert told["rowCount"] == 2 and told["inputFiles"] == ["t.json"] and len(told) == 23
    assert json.loads(text(tmp_path / "report"))["outputTickets"] == 2


def test_labels(spark, tmp_path, capsys):
    (tmp_path / "a.json").write_text(json.dumps([{"id": i, "nom": "bad" if i == 3 else "ok", "kind": "K", "body": f"text {i}"} for i in range(4)]))
    args = ("json-qualifier", tmp_path / "a.json", tmp_path / "out", "--caller", "tests.test_cli:label", "--content-field", "body", "--title-field", "nom", "--category-field", "kind", "--retries", "0", "--concurrency", "2", "--answers", tmp_path / "log")
    code, told = run(capsys, *args)
    out = json.loads(text(tmp_path / "out"))
    assert code == 0 and [x["level"] for x in out] == ["N2", "N2", "N2", "UNKNOWN"] and out[1] == {"id": 1, "nom": "ok", "kind": "K", "body": "text 1", "level": "N2", "tags": ["k"], "summary": "text 1"}
    assert (told["qualifiedItems"], told["failedItems"]) == (3, 1)
    code, told = run(capsys, *args[:3], "--enable-openai-qualification", "no")
    assert code == 0 and told["warnings"] == ["Qualification OpenAI desactivee."] and json.loads(text(tmp_path / "out"))[0] == {"id": 0, "nom": "ok", "kind": "K", "body": "text 0"}
    assert run(capsys, *args[:3])[0] == 1


def test_sheets_pdf_and_lines_in_order(spark, tmp_path, capsys):
    (tmp_path / "s.xlsx").write_text("Nom|Nom\nann|1\nbob|2\n")
    assert run(capsys, "csv-xlsx-to-json", tmp_path / "s.xlsx", tmp_path / "out")[0] == 1
    code, told = run(capsys, "csv-xlsx-to-json", tmp_path / "s.xlsx", tmp_path / "out", "--parser", "tests.test_cli:rows_of_sheet")
    assert code == 0 and json.loads(text(tmp_path / "out")) == [{"nom": "ann", "nom_1": "1"}, {"nom": "bob", "nom_1": "2"}]
    (tmp_path / "my_doc.pdf").write_text("one|two")
    code, told = run(capsys, "pdf-to-markdown", tmp_path / "my_doc.pdf", tmp_path / "md", "--parser", "tests.test_cli:pages_of_pdf")
    md = text(tmp_path / "md" / "file=my_doc.pdf")
    assert code == 0 and md == "# my doc\n\n## Page 1\n\none end\n\n## Page 2\n\ntwo end\n" and told["documentCount"] == 2 and told["estimatedTokens"] == -(-len(md.split()) * 13 // 10)
    (tmp_path / "l.json").write_text(json.dumps([{"n": i} for i in range(300)]))
    code, _ = run(capsys, "json-cleaner", tmp_path / "l.json", tmp_path / "lines", "--mode", "jsonl")
    assert code == 0 and [json.loads(x)["metadata"]["n"] for x in text(tmp_path / "lines").splitlines()] == list(range(300))
    code, told = run(capsys, "json-cleaner", tmp_path / "l.json", tmp_path / "rag", "--mode", "rag")
    assert code == 0 and [x["content"] for x in json.loads(text(tmp_path / "rag"))] == [f"n: {i}" for i in range(300)] and told["documentCount"] == 300
