"""The tools: what each takes, its defaults, and a run that gives data, documents, text lines, a report and diagnostics as DataFrames."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions.redact import KINDS
from docmill.operators import answers, articles, diagnostics, dynamic, gather, qualify, tickets
from docmill.operators.ordering import dealt_join, ranked
from docmill.operators.rules import Rules, blanks_in_json, is_blank
from docmill.sources import readers, sinks
from docmill.sources.scratch import kept


@dataclass(frozen=True)
class Config:
    """One set of options for all tools; None means that the tool's default is left as it is."""

    output_mode: str = "canonical"
    remove_empty_fields: bool | None = None
    normalize_whitespace: bool = True
    fix_encoding: bool = True
    strip_html: bool = False
    strip_control_chars: bool = True
    remove_base64_images: bool = True
    redact_sensitive: bool = True
    redact_kinds: tuple[str, ...] = KINDS
    excluded_fields: tuple[str, ...] = ()
    field_renames: dict[str, str] = field(default_factory=dict)
    include_inactive: bool = False
    min_body_length: int = 100
    include_menu_pages: bool = False
    include_menu_pages_in_canonical: bool = False
    enable_qualification: bool = True
    concurrency: int = 5
    max_retries: int = 2
    answers: str | None = None
    prompt: str = ""
    content_field: str = "body_markdown"
    title_field: str = "title"
    category_field: str = "categorie"
    min_score: int = 0
    only_rag_candidates: bool = False
    keep_author: bool = False
    keep_client: bool = True
    redact_client: bool = False
    pretty: bool = True

    @property
    def kinds(self) -> tuple[str, ...]:
        """Kinds that are redacted: none if the master switch is off."""
        return self.redact_kinds if self.redact_sensitive else ()

    @property
    def rules(self) -> Rules:
        """The switches of the text rules, with findings listed."""
        return Rules(self.fix_encoding, self.strip_control_chars, self.normalize_whitespace, self.remove_base64_images, self.kinds, find=True)


@dataclass(frozen=True)
class Result:
    """What a run gives; ``output`` is the one that counts: text, else documents, else data. The run has happened: all read tables that it has kept.

    ``diagnostics`` is one row of all fields (gather.SCHEMA), in which warnings and findings are the first few; ``warnings`` and ``findings``
    have all. ``lines`` are objects that take several rows each (key, at, value).
    """

    data: DataFrame | None = None
    documents: DataFrame | None = None
    text: DataFrame | None = None
    report: DataFrame | None = None
    diagnostics: DataFrame | None = None
    warnings: DataFrame | None = None
    findings: DataFrame | None = None
    messages: DataFrame | None = None
    lines: DataFrame | None = None

    @property
    def output(self) -> DataFrame | None:
        return next((x for x in (self.text, self.documents, self.data) if x is not None), None)

    @property
    def report_output(self) -> DataFrame | None:
        return self.report if self.report is not None else self.diagnostics


@dataclass(frozen=True)
class Tool:
    id: str
    name: str
    kind: str
    extensions: tuple[str, ...]
    modes: tuple[str, ...]
    defaults: Config
    apply: Callable[[DataFrame, Config, str], Result]
    source_name: str = "input.json"

    def run(self, df: DataFrame, config: Config | None = None, source_name: str | None = None) -> Result:
        """The tool over its records; a mode that it doesn't offer is an error."""
        config = config or self.defaults
        if config.output_mode not in self.modes:
            raise ValueError(f"{self.id} offers {', '.join(self.modes)}, not {config.output_mode}")
        return self.apply(df, config, source_name or self.source_name)


#: What a run warns of.
NOTHING = {"csv-xlsx-to-json": "Aucune ligne de donnees detectee apres les en-tetes.", "json-cleaner": "Le JSON ne contient aucun objet exploitable."}
NO_PAGE = "Aucune page detectee dans le PDF."
NOT_ASKED = "Qualification OpenAI desactivee."


def _records(kind: str, tool: str):
    """Tables and JSON: rows with pos and text (a record as JSON)."""

    def run(df: DataFrame, c: Config, name: str) -> Result:
        spark, began = df.sparkSession, time.monotonic()
        done = dynamic.transform(
            df.select("pos", "text"), "text", exclude=c.excluded_fields, renames=c.field_renames, remove_empty=c.remove_empty_fields is not False, fix_encoding=c.fix_encoding, images=c.remove_base64_images,
            html=c.strip_html, control=c.strip_control_chars, whitespace=c.normalize_whitespace, kinds=c.kinds,
        )
        done, n = gather.counted(done, gather.redaction_sums() | {"rows": F.count("*"), "n_images": F.sum("n_images"), "n_empty": F.sum("n_empty"), "n_words": 1 + F.sum("n_blank_runs")}, "records")
        docs, told = None, {"emptyFieldCount": n["n_empty"]}
        if c.output_mode != "canonical":
            docs, m = gather.counted(dynamic.documents(done, name, kind, tool), {"rows": F.count("*"), "n_empty": F.sum("n_empty"), "n_words": F.sum("n_words")}, "documents")
            n, told = n | {"n_words": m["n_words"]}, {"documentCount": m["rows"], "emptyFieldCount": m["n_empty"]}
        text = docs.select("pos", "value") if c.output_mode == "jsonl" else None
        found = dynamic.findings(done)
        warnings = [] if n["rows"] else [NOTHING[tool]]
        told |= {"rowCount": n["rows"], "removedBase64Images": n["n_images"], "redactionFindings": gather.first_findings(found, ("pos", "k")), "warnings": warnings}
        return Result(done, docs, text, diagnostics=gather.diagnostics(spark, [name], began, n, n["n_words"] or 1, **told), warnings=spark.createDataFrame([(w,) for w in warnings], "text string"), findings=found)

    return run


def _articles(df: DataFrame, c: Config, name: str) -> Result:
    """JSON items: rows with pos and record (variant). Menu pages have a switch for each mode."""
    spark, began, rag = df.sparkSession, time.monotonic(), c.output_mode == "rag"
    menu = c.include_menu_pages if rag else c.include_menu_pages_in_canonical
    done = articles.process(df.select("pos", F.col("record").alias("item")), c.min_body_length, c.include_inactive, menu, c.rules)
    is_, kept_, judged = (lambda s: F.col("status") == s), F.col("status") == "kept", F.col("status").isin("kept", "menu")
    fields = ("article_id", "title", "categorie", "url", "created_at", "updated_at")
    empty = sum((F.when(F.col(f).isNull(), 1).otherwise(is_blank(F.col(f))) for f in fields), F.lit(0) if rag else is_blank(F.col("body_markdown")))
    blanks = sum((blanks_in_json(F.col(f)) for f in (*fields, "body_markdown")), F.lit(0))
    sums = gather.redaction_sums() | {
        "rows": F.count("*"),
        "n_images": F.sum("n_images"),
        "out": F.count_if(kept_),
        "short": F.count_if(is_("short")),
        "inactive": F.count_if(is_("inactive")),
        "menu_out": F.count_if(is_("menu")),
        "menu": F.count_if(judged & F.col("is_menu")),
        "mostly": F.count_if(judged & (F.col("link_ratio") >= 0.7)),
        "links": F.sum(F.when(judged, F.col("n_links"))),
        "judged": F.count_if(judged),
        "n_empty": F.sum(F.when(kept_, empty)),
        "n_words": 1 + F.sum(F.when(kept_, blanks)),
    }
    done, n = gather.counted(done, sums, "articles")
    docs, words = None, n["n_words"] or 1
    if rag:
        docs, m = gather.counted(articles.to_documents(done, name, "odoo-knowledge-cleaner"), {"n_words": F.sum(diagnostics.words(F.col("content")))}, "documents")
        words = m["n_words"]
    warnings = done.where(F.size("warnings") > 0).select("pos", F.posexplode("warnings").alias("seq", "text"))
    found = articles.findings(done)
    told = gather.diagnostics(
        spark, [name], began, n, words, rowCount=n["rows"], documentCount=n["out"] if rag else None, emptyFieldCount=n["n_empty"], redactionFindings=gather.first_findings(found, ("pos", "k")), removedBase64Images=n["n_images"],
        excludedEmptyArticles=n["short"], excludedInactiveArticles=n["inactive"], excludedMenuPages=n["menu_out"], detectedMenuPages=n["menu"], averageInternalLinksPerArticle=gather.average_links(spark, n["links"], n["judged"]),
        articlesWithMostlyLinks=n["mostly"], exportedArticles=n["out"], warnings=gather.first_lines(warnings, ("pos", "seq")),
    )
    return Result(done.where("status = 'kept'"), docs, diagnostics=told, warnings=warnings, findings=found)


def _tickets(df: DataFrame, c: Config, name: str) -> Result:
    """JSON items: rows with pos and record (variant)."""
    began = time.monotonic()
    return clean_tickets(*tickets.from_items(df.select("pos", F.col("record").alias("item")), c.rules), c, name, began)


def clean_tickets(t: DataFrame, m: DataFrame, ignored: DataFrame | None, c: Config, name: str = "support-tickets.json", began: float | None = None) -> Result:
    """The ticket tool over tables: tickets (ticket_id, ...), messages (ticket_id, pos, ...) and warnings (pos, seq, text) on items that were left out; see tickets.from_items.

    Messages are read once and kept, then tickets; what goes out reads these. No ticket is gathered: see tickets.ticket_lines.
    """
    spark, began, rules = t.sparkSession, time.monotonic() if began is None else began, c.rules
    for column, of in (("label", F.lit("")), ("ignored", F.lit(0))):
        t = t if column in t.columns else t.withColumn(column, of)
    t = tickets.clean_tickets(t, rules)
    if "ticket_subject" not in m.columns:
        m = tickets.with_subjects(m, t)
    judged = kept(tickets.with_own_counts(tickets.judged_messages(m, "ticket_subject", rules), c.keep_author, rules), "messages")
    out = F.col("score") >= c.min_score
    if c.only_rag_candidates:
        out = out & F.col("rag_candidate")
    client = F.col("client") if c.keep_client and not c.redact_client else F.lit(None)
    written = [F.col(f) for f in ("ticket", "priority", "subject", "category", "team", "type", "labels")] + [client, F.col("created.raw")]
    own = lambda of: sum((of(F.nullif(x, F.lit(""))) for x in written), F.lit(0))
    sums = {k: F.sum(F.col(k) + F.col(f"left_{f}")) if f else F.sum(k) for k, f in (("n_fixes", "fixes"), *((n, None) for n in tickets.COUNTERS.values()))} | {
        "rows": F.count("*"),
        "said": F.sum("n_messages"),
        "out": F.count_if(out),
        "candidates": F.count_if(out & F.col("rag_candidate")),
        "removed": F.sum(F.col("n_removed") + F.col("ignored")),
        "auto": F.sum("n_auto"),
        "without": F.count_if(F.col("n_messages") == 0),
        "n_empty": F.sum(F.when(out, F.col("left_empty") + own(is_blank))),
        "n_words": 1 + F.sum(F.when(out, F.col("left_blanks") + own(blanks_in_json))),
    }
    done, n = gather.counted(tickets.scored(t, judged), sums, "tickets")
    exported = done.where(out)
    records = tickets.ticket_records(exported, c.keep_client, c.redact_client)
    left = tickets.final_messages(judged)
    told = tickets.date_warnings(done, left) if "date" in m.columns else None
    warnings = ignored if told is None else told if ignored is None else ignored.unionByName(told)
    n_ignored = 0 if ignored is None else ignored.where("seq = 0").count()
    lines = gather.first_lines(warnings, ("pos", "seq"))
    found = tickets.findings(done, judged)
    # the number of messages of a ticket is known, so those of many are dealt out
    counts = exported.select("ticket_id", F.col("n_messages").alias("n"))
    mine = dealt_join(left, exported.select("ticket_id"), "ticket_id", counts, n["said"], ("pos",))
    ordered = ranked(mine, "ticket_id", tickets.message_order(backwards=True))
    messages = tickets.message_records(ordered, c.keep_author)
    objects = tickets.ticket_lines(records.join(exported.select(F.col("ticket_id").alias("key"), "n_messages"), "key"), messages, c.pretty)
    report = spark.createDataFrame([(n["rows"] + n_ignored, n["out"], n["removed"], n["auto"], n["without"], n["candidates"], n["n_secret"], n["n_ip"], lines)], REPORT)
    diag = gather.diagnostics(spark, [name], began, n, n["n_words"] or 1, rowCount=n["rows"] + n_ignored, emptyFieldCount=n["n_empty"], redactionFindings=gather.first_findings(found, ("pos", "seq", "k")), warnings=lines)
    return Result(records, report=report, diagnostics=diag, warnings=warnings, findings=found, messages=messages, lines=objects)


#: Fields of the report on tickets.
REPORT = "inputTickets long, outputTickets long, removedMessages long, removedAutoMessages long, ticketsWithoutUsefulMessages long, ragCandidates long, redactedSecrets long, redactedIps long, warnings array<string>"


def _pages(df: DataFrame, c: Config, name: str) -> Result:
    """Pages of files: rows with file, page and text."""
    spark, began, rag = df.sparkSession, time.monotonic(), c.output_mode == "rag"
    clean = F.transform(F.array(F.coalesce("text", F.lit(""))), lambda t: dynamic.clean_text(t, c.fix_encoding, c.remove_base64_images, False, c.strip_control_chars, c.normalize_whitespace, c.kinds, False))
    pages = df.withColumn("_clean", F.element_at(clean, 1)).withColumn("text", F.col("_clean.text"))
    words = diagnostics.words(F.col("text"))
    sums = {"n_fixes": F.sum("_clean.fixes"), "n_images": F.sum("_clean.images")} | {n: F.sum(f"_clean.{k}") for k, n in dynamic.COUNTERS.items()}
    sums |= {"rows": F.count("*"), "n_words": F.sum(words if rag else words + 3), "n_empty": F.sum(is_blank(F.col("text")))}
    pages, n = gather.counted(pages, sums, "pages")
    # a document has its title, and three words over each page
    titles = 0 if rag else pages.select("file").distinct().select(F.sum(diagnostics.words(sinks.markdown_title(F.col("file"))) + 1).alias("n")).first().n or 0
    placeholder = F.element_at(F.create_map(*[F.lit(x) for kv in dynamic.PLACEHOLDER.items() for x in kv]), F.col("f.type"))
    found = pages.select("file", "page", F.posexplode("_clean.found").alias("k", "f")).select("file", "page", "k", "f.type", F.concat(F.lit("page_"), F.col("page").cast("string")).alias("fieldPath"), placeholder.alias("placeholder"), "f.preview")
    warnings = [] if n["rows"] else [NO_PAGE]
    told = gather.diagnostics(
        spark, [name], began, n, n["n_words"] + titles, documentCount=n["rows"], emptyFieldCount=n["n_empty"] if rag else 0, removedBase64Images=n["n_images"],
        redactionFindings=gather.first_findings(found, ("file", "page", "k")), warnings=warnings,
    )
    pages = pages.drop("_clean")
    docs = sinks.page_documents(pages, F.col("file")) if rag else None
    return Result(documents=docs, text=sinks.pages_to_markdown(pages) if docs is None else None, diagnostics=told, warnings=spark.createDataFrame([(w,) for w in warnings], "text string"), findings=found)


def qualifier(caller: Callable[[dict], str], backoff_ms: int = 400) -> Tool:
    """The tool that labels JSON items through an injected caller; switched off, it passes items through.

    Answers go into a log (``answers`` of the config, else a new one), so each item is asked about once: data, diagnostics and warnings
    read the log, and so does a later run over it. ``prompt`` names what items are asked with.
    """

    def run(df: DataFrame, c: Config, name: str) -> Result:
        spark, began = df.sparkSession, time.monotonic()
        df = kept(df.select("pos", "text"), "items")
        nothing = spark.createDataFrame([], "pos int, level string, tags array<string>, summary string, error string, id string")
        items = qualify.item_fields(df.withColumn("record", F.try_parse_json("text")), c.content_field, c.title_field, c.category_field)
        asked = answers.ask(items, caller, c.answers, c.prompt, c.concurrency, c.max_retries, backoff_ms) if c.enable_qualification else None
        labels = asked.labels if asked else nothing
        labelled = qualify.with_labels(qualify.merge(items.select("pos", "id").join(df, "pos"), labels))
        labelled, n = gather.counted(labelled, {"rows": F.count("*"), "n_empty": F.sum("n_empty"), "n_words": 1 + F.sum("n_blank_runs")}, "labelled")
        failed = labels.where("error IS NOT NULL")
        who = F.when(F.col("id") != "", F.col("id")).otherwise(F.concat(F.lit("item_"), F.col("pos").cast("string")))
        warnings = failed.select("pos", F.rtrim(F.concat(F.lit("Item "), who, F.lit(": qualification OpenAI echouee. "), F.coalesce("error", F.lit("")))).alias("text"))
        n_failed = failed.count() if asked else 0
        lines = gather.first_lines(warnings, ("pos",)) if asked else [NOT_ASKED]
        told = gather.diagnostics(
            spark, [name], began, None, n["n_words"] or 1, n_items=n["rows"], rowCount=n["rows"], emptyFieldCount=n["n_empty"], totalItems=n["rows"], qualifiedItems=n["rows"] - n_failed if asked else 0, failedItems=n_failed,
            errors=lines if asked else [], warnings=lines, **({"durationMs": asked.duration_ms} if asked else {}),
        )
        data = labelled.select("pos", "text", "level", "tags", "summary")
        return Result(data, diagnostics=told, warnings=warnings if asked else spark.createDataFrame([(NOT_ASKED,)], "text string"))

    return Tool("json-qualifier", "JSON with labels", "processor", ("json",), ("canonical",), Config(), run)


RECORD_MODES = ("canonical", "rag", "jsonl")
TOOLS = {
    t.id: t
    for t in (
        Tool("csv-xlsx-to-json", "Tables to JSON", "converter", ("csv", "xlsx", "xls"), RECORD_MODES, Config(remove_empty_fields=True), _records("csv", "csv-xlsx-to-json"), "input.csv"),
        Tool("pdf-to-markdown", "PDF to Markdown", "converter", ("pdf",), ("document", "rag"), Config(output_mode="document"), _pages, "input.pdf"),
        Tool("json-cleaner", "JSON cleaner", "processor", ("json",), RECORD_MODES, Config(remove_empty_fields=True, strip_html=True), _records("json", "json-cleaner")),
        Tool("support-ticket-cleaner", "Support tickets", "processor", ("json",), ("canonical",), Config(), _tickets, "support-tickets.json"),
        Tool("odoo-knowledge-cleaner", "Knowledge articles", "qualifier", ("json",), ("canonical", "rag"), Config(), _articles, "odoo-knowledge.json"),
    )
}


def get_tool(tool_id: str) -> Tool:
    if tool_id not in TOOLS:
        raise ValueError(f"unknown tool {tool_id}; known: {', '.join(TOOLS)}")
    return TOOLS[tool_id]


def by_kind() -> dict[str, list[Tool]]:
    out: dict[str, list[Tool]] = {}
    for t in TOOLS.values():
        out.setdefault(t.kind, []).append(t)
    return out


def with_options(tool: Tool, **options) -> Config:
    """The tool's defaults with options of a command line over them; those that are None stay."""
    return replace(tool.defaults, **{k: v for k, v in options.items() if v is not None})


def as_json(table: DataFrame) -> DataFrame:
    """Rows of a table source as pos and text, for the record tools."""
    return table.select(F.col("row").alias("pos"), F.to_json(F.struct(*[c for c in table.columns if c not in ("file", "row")])).alias("text"))


__all__ = ["TOOLS", "Config", "Result", "Tool", "as_json", "by_kind", "get_tool", "qualifier", "readers", "with_options"]
