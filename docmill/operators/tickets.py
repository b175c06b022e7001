"""Support tickets: message clean-up, de-duplication and order, classification, score, report."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.batches import slices
from docmill.functions.dates import parse_date, rounded_hours
from docmill.functions.jstext import WS, B, contains_any, search_text, sub, trim, units
from docmill.functions.jsvalue import parse, write
from docmill.functions.redact import PLACEHOLDER
from docmill.functions.terms import holds, scanned
from docmill.functions.text import normalize_whitespace
from docmill.operators.articles import variant_text
from docmill.operators.ordering import dealt_join, ranked
from docmill.operators.records import js_text, json_object, json_value
from docmill.operators.rules import COUNTERS, FOUND, Rules, blanks_in_json, cleaned, is_blank
from docmill.sources.readers import first_present
from docmill.sources.scratch import kept

#: The terms of each signal, in search form.
MONITORING = ("updown alert", "updown.io", "[down]", "[up]", "status page", "downtime details")
SPAM = ("mailinblack", "delivrer mon email", "ma messagerie est protegee", "anti-spam", "antispam")
NOTIFICATION = ("antai", "validation de la notification", "changement de prestataire", "va-pilote", "mif restant")
RESOLUTION = ("corrig", "resolu", "solution", "contournement", "mise a jour corrective", "maj corrective")
PROCEDURE = ("relancer", "verifier", "synchroniser", "modifier", "parametrer", "parametrage")
ANOMALY = ("anomalie", "erreur", "impossible", "ne fonctionne pas", "bloque", "dysfonctionnement", "incident", "rejet", "echec", "incorrect", "incoherence")
TECHNICAL = ("alerte", "alert", "down", "up", "downtime", "supervision", "cpu", "disque", "certificat expire", "sauvegarde", "serveur")
SURVEY = ("demande d'evaluation du service", "evaluer nos services", "cliquez sur l'un de ces smileys", "enquete de satisfaction")
BASE = {"support_case": 40, "internal_infra": 20, "notification": 10, "monitoring": 5, "spam_or_auto": -50, "empty": -50, "unknown": 0}
TERMS = {"monitoring": MONITORING, "spam": SPAM, "notification": NOTIFICATION, "resolution": RESOLUTION, "procedure": PROCEDURE, "anomaly": ANOMALY, "technical": TECHNICAL, "downtime": ("downtime details",), "fix": ("mise a jour corrective", "maj corrective")}
#: Names of a ticket's and a message's fields, the first one present wins; and what stands for a client.
TICKET_KEYS = {
    "ticket": ("sequence_des_id_des_tickets", "ticket_id", "id"),
    "subject": ("sujet",),
    "priority": ("gravite", "priorite"),
    "category": ("categorie_perimetre", "categorie"),
    "team": ("equipe_d_assistance",),
    "type": ("type",),
    "labels": ("etiquettes",),
    "client": ("client",),
    "hours": ("heures_passees",),
    "created": ("cree_le",),
}
MESSAGE_KEYS = {"content": ("contenu_texte",), "subject": ("sujet",), "author": ("auteur",), "date": ("date",)}
CLIENT_PLACEHOLDER = "[CLIENT_REDACTED]"
VAGUE_CATEGORIES = ("divers", "autre", "general", "n/a")
VAGUE_SUBJECTS = ("test", "client critique", "divers")


def only_links(text: Column) -> Column:
    """Little besides links."""
    bare = sub(sub(sub(text, r"(?i)https?://[^\s]+", " "), r"\[[^\]]+\]\([^)]+\)", " "), rf"(?i){B}voir le ticket{B}", " ")
    return units(normalize_whitespace(bare)) < 20


def link_or_alert(text: Column, search: Column) -> Column:
    """Little besides links, or a technical alert without a procedure."""
    return only_links(text) | (contains_any(search, TECHNICAL) & ~contains_any(search, PROCEDURE))


def weak_reason(text: Column, search: Column) -> Column:
    """auto, weak or null: the first rule that holds."""
    compact = F.trim(sub(search, "[^a-z0-9]+", " "))
    signal = contains_any(search, RESOLUTION + PROCEDURE + ANOMALY)
    has = lambda *terms: contains_any(search, terms)
    return (
        F.when(compact.isin("a faire terminee", "a faire termine", "voir le ticket", "merci le service support"), "weak")
        .when(contains_any(search, SPAM + SURVEY), "auto")
        .when(has("votre demande a bien ete recue") & ~signal, "auto")
        .when(has("pas de retour client") & has("cloture") & ~signal, "weak")
        .when(has("merci") & has("le service support") & (units(text) < 160) & ~signal, "weak")
        .when(link_or_alert(text, search) & ~signal, "weak")
    )


def same_subject(message: Column, ticket: Column) -> Column:
    """Subjects with the same words, whatever their case, marks and blanks; an empty one is like no other."""
    fold = lambda c: trim(sub(search_text(c), f"[{WS}]+", " "))
    return (fold(message) != "") & (fold(message) == fold(ticket))


def judged_messages(messages: DataFrame, ticket_subject: str | None = None, rules: Rules = Rules()) -> DataFrame:
    """Messages (ticket_id, pos, sort_time, subject, content, author) with text, topic, search, reason, same, counters and found.

    ``text`` and ``topic`` (the subject, empty where it is that of the ticket, column ``ticket_subject``) are repaired,
    cleaned and redacted. Reasons: empty, auto, weak, or null. ``same`` is a digest of ticket, topic and text: messages without a
    reason that share one are repeats. Counters (n_fixes and one of each kind) and ``found`` (type, preview, field) have the topic's share
    only in messages without a reason.
    """
    m = messages.withColumn("_both", F.transform(F.array("content", "subject"), lambda c: cleaned(c, rules)))
    text, topic = F.col("_both")[0], F.col("_both")[1]
    m = m.withColumn("text", text["text"])
    m = m.withColumn("search", search_text(F.col("text")))
    m = m.withColumn("reason", F.when(F.col("text") == "", "empty").otherwise(weak_reason(F.col("text"), F.col("search"))))
    judged = F.col("reason").isNull()
    field = lambda c, name: F.transform(c["found"], lambda f: F.struct(f["type"].alias("type"), f["preview"].alias("preview"), F.lit(name).alias("field")))
    found = F.concat(field(text, "contenu_texte"), F.when(judged, field(topic, "sujet")).otherwise(F.array()))
    m = m.withColumns({n: text[k] + F.when(judged, topic[k]).otherwise(0) for k, n in ({"n": "n_fixes"} | COUNTERS).items()} | {"found": found, "topic": topic["text"]}).drop("_both")
    if ticket_subject:
        m = m.withColumn("topic", F.when(same_subject(F.col("topic"), F.col(ticket_subject)), "").otherwise(F.col("topic")))
    return m.withColumn("same", F.sha2(F.to_json(F.array(F.col("ticket_id").cast("string"), "topic", "text")), 256))


def message_order(backwards: bool = False) -> list[Column]:
    """Dated messages by time, then undated ones, each in source order; or from the last to the first."""
    by = (F.col("sort_time").isNull(), F.col("sort_time"), F.col("pos"))
    return [c.desc() for c in by] if backwards else [c.asc() for c in by]


def clean_messages(messages: DataFrame, ticket_subject: str | None = None, rules: Rules = Rules()) -> DataFrame:
    """Messages (see :func:`judged_messages`) with drop_reason and place.

    drop_reason: the reason, else duplicate of an earlier one with the same topic and text. Kept
    ones have their place from 1: dated ones by time, then undated ones, each in source order.

    Repeats are told by the least position of each digest, which is joined back with frequent digests dealt out; places by ranges. So
    a ticket of any share of the messages, and a text that is repeated as often, is spread over many tasks.
    """
    m = kept(judged_messages(messages, ticket_subject, rules), "judged")
    judged = m.where("reason IS NULL")
    firsts = kept(judged.groupBy("same").agg(F.min("pos").alias("first"), F.count("*").alias("n")), "firsts")
    d = dealt_join(judged, firsts.drop("n"), "same", firsts.select("same", "n"), m.count(), ("pos",)).withColumn("drop_reason", F.when(F.col("pos") > F.col("first"), "duplicate")).drop("first", "same", "reason")
    left = ranked(d.where("drop_reason IS NULL"), "ticket_id", message_order())
    gone = d.where("drop_reason IS NOT NULL").unionByName(m.where("reason IS NOT NULL").withColumn("drop_reason", F.col("reason")).drop("same", "reason"))
    return left.unionByName(gone.withColumn("place", F.lit(None).cast("int")))


#: Fixed value: what a number of a version looks like.
VERSION = rf"{B}[0-9]+\.[0-9]+"


def version(c: Column) -> Column:
    return contains_any(c, TERMS["fix"]) | F.regexp_like(c, F.lit(VERSION))


#: Counts of a message that matter only if it stays.
OWN_COUNTS = ("blanks", "empty", "fixes")


def with_own_counts(judged: DataFrame, keep_author: bool = False, rules: Rules = Rules()) -> DataFrame:
    """The messages with ``own``: of their output form, runs of white space and blank fields, and corrections of the author; and auteur, its clean text if it is kept."""
    author = cleaned(F.col("author"), rules, False) if keep_author else F.struct(F.lit(None).cast("string").alias("text"), F.lit(0).alias("n"))
    d = judged.withColumn("_author", author).withColumn("auteur", F.nullif(F.col("_author.text"), F.lit("")))
    raw = F.col("date.raw") if "date" in d.columns else F.lit(None).cast("string")
    held_ = [F.col("topic"), F.col("text"), F.col("auteur"), raw]
    counts = (sum((blanks_in_json(c) for c in held_), F.lit(0)), sum((is_blank(c) for c in held_), F.lit(0)), F.col("_author.n"))
    return d.withColumn("own", F.struct(*[c.alias(n) for c, n in zip(counts, OWN_COUNTS, strict=True)])).drop("_author")


def final_messages(judged: DataFrame) -> DataFrame:
    """The messages that stay: of those that say the same, the first. Repeats meet as sums, so a text of any frequency is a few rows."""
    names = [c for c in judged.columns if c not in ("ticket_id", "same", "reason")]
    return judged.where("reason IS NULL").groupBy("ticket_id", "same").agg(F.min_by(F.struct(*names), "pos").alias("m")).select("ticket_id", "m.*")


def summarize(judged: DataFrame) -> DataFrame:
    """Of each ticket: counts of its messages (see :func:`judged_messages`), and which terms (TERMS, version) their contents and authors hold.

    Messages count as lines of one text. No term holds a line end, so none spans two messages and each is looked through on its own.
    Repeats are summed first, so only different messages are shuffled by their ticket, and of these sums.
    """
    said = search_text(F.concat_ws("\n", F.coalesce("content", F.lit("")), F.coalesce("subject", F.lit(""))))
    own = [F.col("own")] if "own" in judged.columns else []
    m = judged.select("ticket_id", "pos", "same", "reason", "text", "search", "n_fixes", *COUNTERS.values(), *own, said.alias("said"), search_text(F.coalesce("author", F.lit(""))).alias("who"))
    numbered = F.regexp_like("said", F.lit(VERSION))
    m = m.select(*[c for c in m.columns if c != "text"], numbered.alias("numbered"), (units(F.col("text")) >= 40).alias("long"), only_links(F.col("text")).alias("links"))
    m = scanned(m, {"said": "said_bits", "who": "who_bits", "search": "text_bits"}, TERMS, drop=("said", "who", "search"))
    left, has = F.col("reason").isNull(), lambda c, *names: holds(F.col(f"{c}_bits"), TERMS, *names)
    m = m.withColumns({
        "useful": left & (F.col("long") | has("text", "resolution", "procedure", "anomaly")),
        "solid": left & ~(F.col("links") | (has("text", "technical") & ~has("text", "procedure"))),
        "said_version": F.col("numbered") | has("said", "fix"),
    })
    terms = [F.max(has(c, name)).alias(f"{c}_{name}") for c in ("said", "who") for name in TERMS]
    sums = [F.sum(c).alias(c) for c in ("n_fixes", *COUNTERS.values())]
    alike = m.groupBy("ticket_id", "reason", F.when(left, F.col("same")).alias("same")).agg(F.count("*").alias("n"), F.bool_or("useful").alias("useful"), F.bool_or("solid").alias("solid"), *sums, *terms, *[F.min_by("own", "pos").alias("own") for _ in own], F.bool_or("said_version").alias("said_version"))
    return alike.groupBy("ticket_id").agg(
        F.count_if(left).alias("n_messages"),
        F.count_if("useful").alias("n_useful"),
        F.count_if("solid").alias("n_solid"),
        F.sum(F.when(F.col("reason") == "auto", F.col("n")).otherwise(0)).alias("n_auto"),
        F.sum(F.when(left, F.col("n") - 1).otherwise(0)).alias("n_duplicate"),
        (F.sum("n") - F.count_if(left)).alias("n_removed"),
        *sums,
        *[F.bool_or(f"{c}_{name}").alias(f"{c}_{name}") for c in ("said", "who") for name in TERMS],
        F.bool_or("said_version").alias("said_version"),
        *[F.sum(F.when(left, F.col("own")[n]).otherwise(0)).alias(f"left_{n}") for _ in own for n in OWN_COUNTS],
    )


def classify(t: DataFrame) -> DataFrame:
    """Adds ticket_kind; needs subject_search, team_search, category_search, n_messages and the terms held."""
    who = lambda name: contains_any(F.col("subject_search"), TERMS[name]) | F.col(f"who_{name}")
    every = lambda name: who(name) | F.col(f"said_{name}")
    infra = F.contains("team_search", F.lit("infra")) | (trim(F.col("category_search")) == "infra_saas")
    kind = (
        F.when(who("monitoring") | F.col("said_downtime"), "monitoring")
        .when(every("spam"), "spam_or_auto")
        .when(every("notification"), "notification")
        .when(infra & every("technical"), F.when(every("monitoring"), "monitoring").otherwise("internal_infra"))
        .when(F.col("n_messages") == 0, "empty")
        .when((F.col("n_messages") >= 2) | every("anomaly") | every("procedure") | (units(F.col("subject_search")) >= 12), "support_case")
        .otherwise("unknown")
    )
    return t.withColumn("ticket_kind", kind)


def score(t: DataFrame) -> DataFrame:
    """Adds score (0 to 100), flags in rule order, and rag_candidate; needs also type_search and hours."""
    t = t.withColumn("head", F.concat_ws("\n", "subject_search", "category_search", "type_search"))
    head, kind, hours = F.col("head"), F.col("ticket_kind"), F.col("hours")
    solved, how, wrong = (contains_any(head, TERMS[x]) | F.col(f"said_{x}") for x in ("resolution", "procedure", "anomaly"))
    rules = (
        (solved, 25, "resolution_explicit"),
        (solved & (version(head) | F.col("said_version")), 0, "correction_version"),
        (how, 20, "procedure_reproductible"),
        (wrong, 15, "anomalie_metier"),
        ((F.col("category_search") != "") & ~F.col("category_search").isin(*VAGUE_CATEGORIES), 10, "categorie_exploitable"),
        (F.col("n_useful") >= 2, 10, "echanges_humains_utiles"),
        (hours > 0.25, 5, "heures_passees"),
        (kind == "spam_or_auto", -40, "spam_auto"),
        ((kind == "monitoring") & ~how & ~solved, -35, "monitoring_pur"),
        ((kind == "notification") & ~how & ~solved, -30, "notification_auto"),
        (F.contains("type_search", F.lit("ne pas utiliser")), -25, "type_ne_pas_utiliser"),
        (hours == 0, -20, "heures_nulles"),
        (F.col("n_useful") == 0, -20, "aucun_message_utile"),
        (F.col("n_useful") > 0, 0, "messages_utiles"),
        (F.col("n_solid") == 0, -15, "contenu_faible"),
        (F.col("n_duplicate") > 0, -15, "doublon_probable"),
        (trim(F.col("subject_search")).isin(*VAGUE_SUBJECTS), -10, "sujet_vague"),
    )
    total = F.element_at(F.create_map(*[F.lit(x) for kv in BASE.items() for x in kv]), kind)
    for when, delta, _ in rules:
        total = total + F.when(when, delta).otherwise(0)
    flags = F.filter(F.array(*[F.when(w, F.lit(name)) for w, _, name in rules]), lambda x: x.isNotNull())
    t = t.withColumns({"score": F.greatest(F.lit(0), F.least(F.lit(100), total)), "flags": flags}).drop("head")
    return t.withColumn("rag_candidate", (F.col("score") >= 70) & (kind == "support_case"))


FIELDS = ("ticket", "subject", "priority", "category", "team", "type", "labels", "client")
COUNTS = ("n_messages", "n_useful", "n_solid", "n_auto", "n_duplicate", "n_removed", "n_fixes", *COUNTERS.values())


def clean_tickets(tickets: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Tickets (ticket_id, hours, and any of FIELDS and created, as text) with clean fields, dates, counters and what was found; absent fields are empty. Only the subject is redacted."""
    plain = [f for f in FIELDS if f != "subject"]
    of = lambda f: F.col(f) if f in tickets.columns else F.lit("")
    t = tickets.withColumns({"_plain": F.transform(F.array(*[of(f) for f in plain]), lambda c: cleaned(c, rules, False)), "_subject": cleaned(of("subject"), rules)})
    t = t.withColumns({f: F.col("_plain")[i]["text"] for i, f in enumerate(plain)} | {"subject": F.col("_subject.text")})
    t = t.withColumns({"own_fixes": sum((F.col("_plain")[i]["n"] for i in range(len(plain))), F.col("_subject.n"))} | {f"own_{n}": F.col("_subject")[k] for k, n in COUNTERS.items()} | {"own_found": F.col("_subject.found")})
    return t.withColumn("created", parse_date(F.col("created") if "created" in tickets.columns else F.lit(None).cast("string"), ticket=True)).drop("_plain", "_subject")


def with_subjects(messages: DataFrame, cleaned_tickets: DataFrame) -> DataFrame:
    """The messages with ticket_subject, the clean subject of their ticket; tickets of many messages are dealt to several tasks."""
    n = messages.groupBy("ticket_id").agg(F.count("*").alias("n"))
    return dealt_join(messages, cleaned_tickets.select("ticket_id", F.col("subject").alias("ticket_subject")), "ticket_id", n, messages.count(), ("pos",), "left")


def process(tickets: DataFrame, messages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Classified and scored tickets with clean fields, their messages' counts, and what was corrected and redacted in both."""
    t = clean_tickets(tickets, rules)
    return scored(t, judged_messages(with_subjects(messages, t), "ticket_subject", rules))


def scored(cleaned_tickets: DataFrame, judged: DataFrame) -> DataFrame:
    """Tickets of :func:`clean_tickets` with their messages' counts, kind and score."""
    s = summarize(judged)
    t = cleaned_tickets.join(s, "ticket_id", "left").fillna(0, [*COUNTS, *(c for c in s.columns if c.startswith("left_"))]).fillna(False, [c for c in s.columns if c.startswith(("said_", "who_"))])
    t = t.withColumns({"n_fixes": F.col("n_fixes") + F.col("own_fixes")} | {n: F.col(n) + F.col(f"own_{n}") for n in COUNTERS.values()})
    for name in ("subject", "category", "type", "team"):
        t = t.withColumn(f"{name}_search", search_text(F.col(name)))
    return score(classify(t))


def exported(processed: DataFrame, min_score: int = 0, only_candidates: bool = False) -> DataFrame:
    """Tickets that go out: of ``min_score`` at least and, if asked, candidates only."""
    d = processed.where(F.col("score") >= min_score)
    return d.where("rag_candidate") if only_candidates else d


def ticket_records(processed: DataFrame, keep_client: bool = True, redact_client: bool = False) -> DataFrame:
    """Tickets in their output form; what is empty is null, and so left out by to_json. Messages are rows of their own (message_records), or nested by :func:`ticket_lines`."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    client = blank("client") if keep_client else F.lit(None).cast("string")
    return processed.select(
        F.col("ticket_id").alias("key"),
        blank("ticket").alias("ticket_id"),
        blank("priority").alias("priorite"),
        blank("subject").alias("sujet"),
        blank("category").alias("categorie"),
        blank("team").alias("equipe_d_assistance"),
        (F.when(client.isNotNull(), F.lit(CLIENT_PLACEHOLDER)) if redact_client else client).alias("client"),
        F.col("hours").alias("heures_passees"),
        F.col("created.iso").alias("cree_le"),
        F.col("created.raw").alias("cree_le_raw"),
        blank("type").alias("type"),
        blank("labels").alias("etiquettes"),
        "ticket_kind",
        F.col("score").alias("relevance_score"),
        F.col("flags").alias("relevance_flags"),
        "rag_candidate",
    )


def message_records(messages: DataFrame, keep_author: bool = False) -> DataFrame:
    """Kept messages in their output form, with their ticket's key and place; ``date`` (a column of parse_date, if there) gives the date."""
    d = messages.where("drop_reason IS NULL") if "drop_reason" in messages.columns else messages
    author = F.col("auteur") if "auteur" in d.columns else F.nullif(cleaned(F.col("author"), Rules(), False)["text"], F.lit(""))
    date = (F.col("date.iso"), F.col("date.raw")) if "date" in d.columns else (F.lit(None).cast("string"),) * 2
    return d.select(F.col("ticket_id").alias("key"), "place", F.col("topic").alias("sujet"), F.col("text").alias("contenu_texte"), date[0].alias("date"), date[1].alias("date_raw"), (author if keep_author else F.lit(None).cast("string")).alias("auteur"))


#: Fields of a ticket before and after its messages.
HEAD = ("ticket_id", "priorite", "sujet", "categorie", "equipe_d_assistance", "client", "heures_passees", "cree_le", "cree_le_raw", "type", "etiquettes")
TAIL = ("ticket_kind", "relevance_score", "relevance_flags", "rag_candidate")


def ticket_lines(records: DataFrame, messages: DataFrame, pretty: bool = True) -> DataFrame:
    """The tickets of ticket_records (with n_messages) as JSON objects that hold their messages: key, at, value.

    An object is its values in the order of ``at``, a line each: its head and ``"messages": [``, the messages (message_records, place
    counted from the last one, which has 1), and the end. So a ticket with any share of all messages is written without ever being
    held as a whole; :func:`docmill.sources.sinks.write_lines` puts the lines in order.
    """
    number = lambda f: js_text(F.col(f), "double") if f == "heures_passees" else json_value(F.col(f))
    some = lambda names: json_object([(f, F.when(F.col(f).isNotNull(), number(f))) for f in names])
    n = F.col("n_messages")
    heads = records.select("key", F.lit(0).cast("long").alias("at"), F.lit("head").alias("kind"), some(HEAD).alias("value"), (n == 0).alias("last"))
    ends = records.select("key", F.lit(2**62).alias("at"), F.lit("end").alias("kind"), some(TAIL).alias("value"), (n == 0).alias("last"))
    said = messages.select("key", (F.lit(2**61) - F.col("place")).alias("at"), F.lit("message").alias("kind"), some(("sujet", "contenu_texte", "date", "date_raw", "auteur")).alias("value"), (F.col("place") == 1).alias("last"))
    rows = heads.unionByName(said).unionByName(ends)

    def line(kind: str, value: str, last: bool) -> str:
        """``last``: the last message, or an end without messages."""
        if kind == "head":
            text = "  " + write(parse(value), 2, 1)[:-4] if pretty else value[:-1]
            return text + (",\n    " if pretty else ",") + ('"messages": [' if pretty else '"messages":[') + ("]," if last else "")
        if kind == "message":
            return ("      " + write(parse(value), 2, 3) if pretty else value) + ("" if last else ",")
        text = write(parse(value), 2, 1)[2:] if pretty else value[1:]
        return text if last else ("    ],\n" if pretty else "],") + text

    def run(batches):
        for b in slices(batches):
            out = [line(*x) for x in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["key", "at", "value"])

    return rows.mapInArrow(run, f"key {records.schema['key'].dataType.simpleString()}, at long, value string")


def from_items(items: DataFrame, rules: Rules = Rules()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tickets, messages and warnings of JSON items (pos from 1, item variant); tickets are keyed by position.

    Items and messages that are no objects are left out with a warning (an ignored message still counts as removed: column
    ``ignored`` of the tickets). Messages have the clean subject of their ticket. Warnings: pos, seq, text, in the order of the
    items; those on dates come from :func:`date_warnings`, as only messages that stay have them.
    """
    is_object = lambda c: F.coalesce(F.startswith(F.schema_of_variant(c), F.lit("OBJECT")), F.lit(False))
    as_map = lambda c: F.try_variant_get(c, "$", "map<string,variant>")
    d = items.withColumn("m", F.when(is_object(F.col("item")), as_map(F.col("item"))))
    t = d.where("m IS NOT NULL").select(F.col("pos").cast("long").alias("ticket_id"), *[variant_text(first_present(F.col("m"), k)).alias(n) for n, k in TICKET_KEYS.items()], F.coalesce(F.try_variant_get(first_present(F.col("m"), ("messages",)), "$", "array<variant>"), F.array().cast("array<variant>")).alias("said"))
    name = lambda text, pos: F.when(text != "", F.concat(F.lit("Ticket "), text)).otherwise(F.concat(F.lit("Ticket at index "), pos.cast("string")))
    t = t.withColumn("label", name(cleaned(F.col("ticket"), rules, False)["text"], F.col("ticket_id"))).withColumn("ticket_subject", cleaned(F.col("subject"), rules)["text"])
    m = t.select("ticket_id", "label", "ticket_subject", F.posexplode("said").alias("at", "x"))
    told = F.concat(F.col("label"), F.lit(": message "), (F.col("at") + 1).cast("string"), F.lit(" ignored because it is not an object."))
    bad = m.where(~is_object(F.col("x"))).select(F.col("ticket_id").alias("pos"), (F.col("at") + 1).cast("long").alias("seq"), told.alias("text"))
    m = m.where(is_object(F.col("x"))).withColumn("x", as_map(F.col("x")))
    m = m.select("ticket_id", "label", "ticket_subject", (F.col("at") + 1).cast("long").alias("pos"), *[variant_text(first_present(F.col("x"), k)).alias(n) for n, k in MESSAGE_KEYS.items()])
    m = m.withColumn("date", parse_date(F.col("date"), ticket=True)).withColumn("sort_time", F.col("date.ms"))
    ignored = d.where("m IS NULL").select(F.col("pos").cast("long").alias("pos"), F.lit(0).cast("long").alias("seq"), F.concat(F.lit("Element "), F.col("pos").cast("string"), F.lit(": ticket ignored because it is not an object.")).alias("text"))
    t = t.withColumn("ignored", F.size(F.filter("said", lambda x: ~is_object(x)))).withColumn("hours", rounded_hours(F.col("hours"))).drop("said", "ticket_subject")
    return t, m, ignored.unionByName(bad)


def date_warnings(cleaned_tickets: DataFrame, left: DataFrame) -> DataFrame:
    """Warnings (pos, seq, text) on dates of tickets, and of messages that stay, that could not be read; both have ``label``."""
    dates = left.where(F.col("date.raw").isNotNull()).select(F.col("ticket_id").alias("pos"), F.col("pos").alias("seq"), F.concat(F.col("label"), F.lit(": message "), F.col("pos").cast("string"), F.lit(" date not converted.")).alias("text"))
    created = cleaned_tickets.where(F.col("created.raw").isNotNull()).select(F.col("ticket_id").alias("pos"), F.lit(2**62).alias("seq"), F.concat(F.col("label"), F.lit(": cree_le date not converted.")).alias("text"))
    return dates.unionByName(created)


def findings(cleaned_tickets: DataFrame, judged: DataFrame) -> DataFrame:
    """What was redacted, a row each: pos, seq, k, type, fieldPath, placeholder, preview, in the order of tickets and of their messages."""
    placeholder = F.element_at(F.create_map(*[F.lit(x) for kv in PLACEHOLDER.items() for x in kv]), F.col("f.type"))
    mine = cleaned_tickets.select(F.col("ticket_id").alias("pos"), F.lit(0).cast("long").alias("seq"), F.lit("sujet").alias("fieldPath"), F.posexplode("own_found").alias("k", "f"))
    said = judged.select(F.col("ticket_id").alias("pos"), F.col("pos").cast("long").alias("seq"), F.posexplode("found").alias("k", "f")).withColumn("fieldPath", F.concat(F.lit("messages["), (F.col("seq") - 1).cast("string"), F.lit("]."), F.col("f.field")))
    columns = ("pos", "seq", "k", F.col("f.type").alias("type"), "fieldPath", placeholder.alias("placeholder"), F.col("f.preview").alias("preview"))
    return mine.select(*columns).unionByName(said.select(*columns))


def report(processed: DataFrame, min_score: int = 0, only_candidates: bool = False) -> DataFrame:
    """One row: candidates among exported tickets, removals over all."""
    out = F.col("score") >= min_score
    if only_candidates:
        out = out & F.col("rag_candidate")
    ignored = F.sum("ignored") if "ignored" in processed.columns else F.lit(0)
    return processed.agg(F.count("*").alias("n_tickets"), F.count_if(out).alias("n_exported"), F.count_if(out & F.col("rag_candidate")).alias("n_candidates"), (F.sum("n_removed") + ignored).alias("n_removed"), F.sum("n_auto").alias("n_auto"), F.sum("n_duplicate").alias("n_duplicate"), F.count_if(F.col("n_messages") == 0).alias("n_without_messages"), *[F.sum(c).alias(c) for c in ("n_fixes", *COUNTERS.values())])
