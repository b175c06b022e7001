"""Knowledge articles: fields by aliases, exclusion of inactive, short and menu articles, documents and report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.dates import parse_date
from docmill.functions.jstext import PICTOGRAPHS, WS, let, sub, trim, units
from docmill.functions.markdown import html_to_markdown, menu_metrics, plain_text
from docmill.functions.redact import KINDS, PLACEHOLDER
from docmill.functions.text import normalize_whitespace, remove_inline_images, strip_control
from docmill.operators.records import js_text
from docmill.operators.rules import COUNTERS, Rules, fixed, safe, tidy
from docmill.sources.readers import first_present

#: Names of each field, the first one present wins; and texts that mean active.
ACTIVE_KEYS = ("actif", "active")
ID_KEYS = ("id", "external_id")
TEXT_KEYS = {
    "title": ("titre", "title", "nom_d_affichage", "display_name"),
    "display": ("nom_d_affichage", "display_name"),
    "categorie": ("article_parent", "categorie", "category"),
    "url": ("url_de_l_article", "url"),
}
BODY_KEYS = ("corps", "body", "html")
DATE_KEYS = {"created": ("cra_a_le", "cree_le", "created_at", "create_date"), "updated": ("mis_a_jour_le", "updated_at", "write_date")}
ACTIVE = ("true", "1", "yes", "oui", "vrai")
DATE_WARNING = {"created": "date de creation non convertie.", "updated": "date de mise a jour non convertie."}
MIN_BODY = 100
#: What findings call the fields, in the order in which they are told.
PATHS = {"title": "titre", "display": "nom_d_affichage", "categorie": "article_parent", "url": "url_de_l_article", "body": "corps"}


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_number(v: Column) -> Column:
    return _kind(v).isin("BIGINT", "DOUBLE", "FLOAT") | _kind(v).startswith("DECIMAL")


def _scalar_text(v: Column) -> Column:
    number = js_text(F.try_variant_get(v, "$", "double"), "double")
    return (
        F.when(v.isNull() | (_kind(v) == "VOID"), F.lit(""))
        .when(_is_number(v), number)
        .when(_kind(v).startswith("OBJECT"), F.lit("[object Object]"))
        .otherwise(F.try_variant_get(v, "$", "string"))
    )


def variant_text(v: Column) -> Column:
    """A JSON value as text: null and absent are empty, items of an array are joined by commas."""
    items = F.try_variant_get(v, "$", "array<variant>")
    return F.when(_kind(v).startswith("ARRAY"), F.array_join(F.transform(items, _scalar_text), ",")).otherwise(_scalar_text(v))


def is_active(v: Column) -> Column:
    """Booleans as they are, numbers but 0, the texts of ``ACTIVE``; what is neither, or absent, is active."""
    said = F.lower(trim(F.try_variant_get(v, "$", "string"))).isin(*ACTIVE)
    return (
        F.when(_kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(_is_number(v), F.try_variant_get(v, "$", "double") != 0)
        .when(_kind(v) == "STRING", said)
        .otherwise(F.lit(True))
    )


def category(c: Column) -> Column:
    """Without pictographs, signs and leading bullets."""
    c = sub(sub(strip_control(c), f"[{PICTOGRAPHS}]"), rf"[^\p{{L}}\p{{N}}{WS}'/&().,-]", " ")
    return normalize_whitespace(sub(c, rf"\A[{WS}\-–—•·|>]+"))


def process(items: DataFrame, min_body: int = MIN_BODY, include_inactive: bool = False, include_menu: bool = False, rules: Rules = Rules()) -> DataFrame:
    """One row for each item (pos from 1, item variant), with its status and what was found in it.

    Status: not_object, inactive (nothing of it is cleaned or counted), short (plain body under ``min_body``
    units; its counters count), menu, or kept. Of kept and menu articles: article_id, title, categorie, url
    and dates (null where there is none), body_markdown, is_menu, and warnings on dates; and what was redacted (type, preview, path), if ``rules`` asks.
    """
    item, m = F.col("item"), F.col("m")
    d = items.withColumn("m", F.when(_kind(item).startswith("OBJECT"), F.try_variant_get(item, "$", "map<string,variant>")))
    d = d.withColumn("live", m.isNotNull() & (F.lit(include_inactive) | is_active(first_present(m, ACTIVE_KEYS))))
    fields = TEXT_KEYS | {"body": BODY_KEYS} | DATE_KEYS | {"article_id": ID_KEYS}
    d = d.withColumns({n: F.when(F.col("live"), variant_text(first_present(m, k))) for n, k in fields.items()} | {"no_id": F.coalesce(_kind(first_present(m, ID_KEYS)), F.lit("VOID")) == "VOID"})
    texts = (*TEXT_KEYS, "body")
    # one lambda over all fields, so that the plan holds the repair once
    d = d.withColumn("_fixed", F.transform(F.array(*texts), lambda c: F.when(c.isNotNull(), fixed(c, rules))))
    d = d.withColumns({t: F.col("_fixed")[i]["text"] for i, t in enumerate(texts)} | {"n_fixes": sum((F.col("_fixed")[i]["n"] for i in range(len(texts))), F.lit(0))}).drop("_fixed")
    body, images = remove_inline_images(F.col("body")) if rules.images else (F.col("body"), F.when(F.col("body").isNotNull(), F.lit(0)))
    d = html_to_markdown(d.withColumns({"body": body, "n_images": images}), "body", "body")
    d = d.withColumn("_safe", F.transform(F.array(*texts), lambda c: F.when(c.isNotNull(), let(tidy(c, rules), lambda t: safe(t, rules)))))
    d = d.withColumns({t: F.col("_safe")[i]["text"] for i, t in enumerate(texts)} | {f"{t}_found": F.col("_safe")[i] for i, t in enumerate(texts)}).drop("_safe")
    d = d.withColumn("categorie", category(F.col("categorie"))).withColumn("plain", plain_text(F.col("body"))).withColumn("menu", menu_metrics(F.col("body")))
    d = d.withColumns({n: parse_date(F.col(n)) for n in DATE_KEYS})
    counters = {n: sum((F.col(f"{t}_found.{k}") for t in texts), F.lit(0)) for k, n in COUNTERS.items()}
    # plain texts come trimmed, and have as many units as characters at least
    short = (F.length("plain") < min_body) & (units(F.col("plain")) < min_body)
    status = F.when(m.isNull(), "not_object").when(~F.col("live"), "inactive").when(short, "short").when(F.col("menu.is_menu") & F.lit(not include_menu), "menu").otherwise("kept")
    place = {"body": F.concat(F.lit("article_"), F.col("pos").cast("string"), F.lit(".corps"))}
    told = lambda t: F.transform(F.coalesce(F.col(f"{t}_found.found"), F.array()), lambda f: F.struct(f["type"].alias("type"), f["preview"].alias("preview"), place.get(t, F.lit(PATHS[t])).alias("path")))
    found = F.concat(*[told(t) for t in PATHS]) if rules.find else F.array().cast("array<struct<type:string,preview:string,path:string>>")
    named = F.concat(F.lit("Article "), F.col("pos").cast("string"))
    warnings = [F.when(F.col(f"{n}.raw").isNotNull(), F.concat(named, F.lit(": " + w))) for n, w in DATE_WARNING.items()]
    ignored = F.concat(F.lit("Element "), F.col("pos").cast("string"), F.lit(": article ignore car ce n'est pas un objet."))
    blank = lambda n: F.nullif(F.col(n), F.lit(""))
    out = F.struct(
        "pos",
        "status",
        F.when(F.col("no_id"), F.col("pos").cast("string")).otherwise(F.col("article_id")).alias("article_id"),
        F.coalesce(blank("title"), blank("display"), named).alias("title"),
        blank("categorie").alias("categorie"),
        blank("url").alias("url"),
        F.col("created.iso").alias("created_at"),
        F.col("updated.iso").alias("updated_at"),
        F.col("body").alias("body_markdown"),
        F.col("menu.is_menu").alias("is_menu"),
        F.col("menu.n_links").alias("n_links"),
        F.col("menu.link_ratio").alias("link_ratio"),
        "n_fixes",
        "n_images",
        *[c.alias(n) for n, c in counters.items()],
        found.alias("found"),
        F.when(F.col("status").isin("menu", "kept"), F.array_compact(F.array(*warnings))).when(F.col("status") == "not_object", F.array(ignored)).alias("warnings"),
    )
    # a generator, so that filters on what it gives stay above it: pushed below, they would repeat the whole clean-up
    return d.withColumn("status", status).select(F.inline(F.array(out)))


def findings(processed: DataFrame) -> DataFrame:
    """What was redacted, a row each: pos, k, type, fieldPath, placeholder, preview."""
    placeholder = F.element_at(F.create_map(*[F.lit(x) for kv in PLACEHOLDER.items() for x in kv]), F.col("f.type"))
    return processed.select("pos", F.posexplode("found").alias("k", "f")).select("pos", "k", "f.type", F.col("f.path").alias("fieldPath"), placeholder.alias("placeholder"), "f.preview")


def to_documents(processed: DataFrame, source_file: str = "articles.json", tool: str = "articles") -> DataFrame:
    """metadata and content of kept articles: title as heading (unless the body has it), category, address, body."""
    d = processed.where("status = 'kept'")
    heading = F.concat(F.lit("# "), F.col("title"))
    body = F.col("body_markdown")
    parts = [
        F.when(~F.startswith(trim(body), heading), heading),
        F.concat(F.lit("Categorie: "), F.col("categorie")),
        F.concat(F.lit("URL: "), F.col("url")),
        F.nullif(body, F.lit("")),
    ]
    fixed = [F.lit(v).alias(n) for n, v in (("source_file", source_file), ("source_type", "json"), ("tool", tool))]
    menu = F.when(F.col("is_menu"), F.lit(True)).alias("quality_flags.is_menu_page")
    metadata = F.struct(*fixed, "article_id", "title", "categorie", "url", "created_at", "updated_at", menu)
    return d.select("pos", metadata.alias("metadata"), F.concat_ws("\n\n", *parts).alias("content"))


def two_decimals(x: Column) -> Column:
    """A double from 0, rounded at two decimals by its exact binary value, halves up."""
    bits = ((x - F.floor(x)) * float(1 << 60)).cast("bigint").cast("decimal(20,0)")
    hundredths = F.floor((bits * F.lit(200).cast("decimal(3,0)") + F.lit(str(1 << 60)).cast("decimal(20,0)")) / F.lit(str(1 << 61)).cast("decimal(20,0)"))
    return (F.floor(x) * 100 + hundredths).cast("double") / 100.0


def report(processed: DataFrame) -> DataFrame:
    """One row of counts. Links are averaged over kept and menu articles; inactive ones count nowhere else."""
    judged = F.col("status").isin("kept", "menu")
    counters = ("n_fixes", "n_images", *COUNTERS.values())
    d = processed.agg(
        F.count("*").alias("n_items"),
        *[F.count_if(F.col("status") == s).alias(n) for s, n in (("kept", "n_articles"), ("inactive", "n_inactive"), ("short", "n_short"), ("menu", "n_menu_excluded"))],
        F.count_if(judged & F.col("is_menu")).alias("n_menu"),
        F.count_if(judged & (F.col("link_ratio") >= 0.7)).alias("n_mostly_links"),
        (F.sum(F.when(judged, F.col("n_links"))) / F.count_if(judged)).alias("mean"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters],
    )
    return d.withColumn("avg_links", F.coalesce(two_decimals(F.col("mean")), F.lit(0.0))).drop("mean")
