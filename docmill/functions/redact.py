"""Redaction of secrets, certificate files, addresses and internal paths, with counts and findings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.jstext import WS, B, let, literal

_S = f"[{WS}]"
#: Where a match starts at a word's first letter, the word boundary is this, behind a class that few places pass.
_START = "(?<![A-Za-z0-9_])"
_REST = rf"""[^{WS}"',;)]+"""
#: What each kind looks like, in the order in which kinds are replaced.
RULES = (
    ("secret", rf"""(?i)(?=[PTASMptasm]){_START}((?:server\.)?(?:password|passwd|pwd|token|api[_-]?key|secret|mot{_S}+de{_S}+passe){_S}*[:=]{_S}*)(["']?)([^"',;{WS}][^"',;\n\r]*?)(\2)(?={_S}*(?:[,;}}\]\n\r]|\z))""", "$1$2[SECRET_REDACTED]$2"),
    ("certificate", rf"(?i)(?:[A-Za-z0-9_](?<![A-Za-z0-9_]{{2}})|[./\\:-](?<=[A-Za-z0-9_][./\\:-]))[A-Za-z0-9_./\\:-]*\.(?:p12|pem|key){B}", "[CERTIFICATE_REDACTED]"),
    ("ip", rf"(?=[0-9]){_START}(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){{3}}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9]){B}", "[IP_REDACTED]"),
    ("internalPath", rf"\\\\[A-Za-z0-9._$-]+\\{_REST}", "[INTERNAL_PATH_REDACTED]"),
    ("internalPath", rf"(?i)(?=[A-Za-z]:){_START}[A-Za-z]:\\(?:srv|server|data|apps|inetpub|www|var|opt|etc|users)\\{_REST}", "[INTERNAL_PATH_REDACTED]"),
    ("internalPath", rf"(?i)/(?:srv|var/www|opt|etc)/{_REST}", "[INTERNAL_PATH_REDACTED]"),
)
#: What a text in lower case must hold for a rule to match at all: searches for plain text, which cost far less than the rule's own.
_HINTS = (
    lambda low: _any(low, ":", "=") & _any(low, "passw", "pwd", "token", "key", "secret", "passe"),
    lambda low: _any(low, ".p12", ".pem", ".key"),
    lambda low: F.regexp_like(low, F.lit(r"\.(?<=[0-9]\.)[0-9]")),
    lambda low: _any(low, "\\\\"),
    lambda low: _any(low, ":\\"),
    lambda low: _any(low, "/srv/", "/var/www/", "/opt/", "/etc/"),
)
#: What a text must hold for letter case to matter to a hint; others are not put in lower case, which costs more than all hints.
_CASED = (":", "=", "/", ".p", ".P", ".k", ".K")
KINDS = ("secret", "certificate", "ip", "internalPath")
PLACEHOLDER = {"secret": "[SECRET_REDACTED]", "certificate": "[CERTIFICATE_REDACTED]", "ip": "[IP_REDACTED]", "internalPath": "[INTERNAL_PATH_REDACTED]"}
_SECRET_KEY = re.compile(r"(?:^|[._-])(?:password|passwd|pwd|token|api[_-]?key|secret|mot\s*de\s*passe)(?:$|[._-])", re.I)
_CERT_KEY = re.compile(r"(?:cert|certificate|keystore|truststore|private[_-]?key|pem|p12)", re.I)


def _any(c: Column, *parts: str) -> Column:
    out = F.contains(c, F.lit(parts[0]))
    for p in parts[1:]:
        out = out | F.contains(c, F.lit(p))
    return out


def _through(c: Column, kinds: tuple[str, ...], start, step) -> Column:
    """The state ``start(text)`` after ``step(state, rule)`` for each rule whose hint the text gives; text and states are worked out once.

    No placeholder makes a hint, so the text as it was tells them for all rules.
    """

    def told(text: Column) -> Column:
        return let(F.when(_any(text, *_CASED), F.lower(text)).otherwise(text), lambda low: let(F.array(*[hint(low) for hint in _HINTS]), lambda on: run(text, on)))

    def run(text: Column, on: Column) -> Column:
        state = start(text)
        for i, rule in enumerate(RULES):
            if rule[0] in kinds:
                state = let(state, hinted(on[i], rule))
        return state

    def hinted(on: Column, rule: tuple):
        return lambda s: F.when(on, step(s, *rule)).otherwise(s)

    return let(c, told)


def redacted(c: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """Struct of the redacted text and the number of matches of each kind, each counted just before it is replaced.

    A text goes through the rules it gives a hint of; each step is worked out once.
    """
    return _through(c, kinds, lambda text: F.struct(text.alias("text"), *[F.lit(0).alias(k) for k in KINDS]), _step)


def _step(s: Column, kind: str, pattern: str, to: str) -> Column:
    def put(n: Column) -> Column:
        new = F.regexp_replace(s["text"], F.lit(pattern), F.lit(to if "$1" in to else literal(to)))
        return F.when(n > 0, F.struct(new.alias("text"), *[(s[k] + n if k == kind else s[k]).alias(k) for k in KINDS])).otherwise(s)

    return let(F.regexp_count(s["text"], F.lit(pattern)), put)


def matches(c: Column, kinds: tuple[str, ...] = KINDS, reveal: bool = False) -> Column:
    """An array of (type, preview) of what each rule matches, in the order of rules, each on the text of the one before."""
    none = F.array().cast("array<struct<type:string,preview:string>>")
    return _through(c, kinds, lambda text: F.struct(text.alias("text"), none.alias("found")), lambda s, *rule: _match_step(s, *rule, reveal))["found"]


def _match_step(s: Column, kind: str, pattern: str, to: str, reveal: bool) -> Column:
    seen = lambda m: F.struct(F.lit(kind).alias("type"), (m if reveal else F.concat(F.substring(m, 1, 2), F.lit("***"))).alias("preview"))

    def put(held: Column) -> Column:
        new = F.regexp_replace(s["text"], F.lit(pattern), F.lit(to if "$1" in to else literal(to)))
        return F.when(F.size(held) > 0, F.struct(new.alias("text"), F.concat(s["found"], F.transform(held, seen)).alias("found"))).otherwise(s)

    return let(F.regexp_extract_all(s["text"], F.lit(pattern), F.lit(0)), put)


def redact(c: Column, kinds: tuple[str, ...] = KINDS) -> tuple[Column, dict[str, Column]]:
    """Redacted text and the number of matches of each kind."""
    out = redacted(c, kinds)
    return out["text"], {k: out[k] for k in KINDS}


def redact_columns(df: DataFrame, col: str, out: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``df`` with the redacted text in ``out`` and n_secret, n_certificate, n_ip, n_path."""
    names = {"secret": "n_secret", "certificate": "n_certificate", "ip": "n_ip", "internalPath": "n_path"}
    df = df.withColumn("_redacted", redacted(F.col(col), kinds))
    return df.withColumns({n: F.col("_redacted")[k].cast("long") for k, n in names.items()} | {out: F.col("_redacted")["text"]}).drop("_redacted")


def findings(df: DataFrame, id_col: str, col: str, reveal: bool = False, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """A row for each match: id, seq, type, placeholder, preview. Previews are masked unless ``reveal``."""
    placeholder = F.element_at(F.create_map(*[F.lit(x) for kv in PLACEHOLDER.items() for x in kv]), F.col("f.type"))
    found = df.select(F.col(id_col), F.posexplode(matches(F.col(col), kinds, reveal)).alias("seq", "f"))
    return found.select(id_col, "seq", "f.type", placeholder.alias("placeholder"), "f.preview")


def key_kind(key: str) -> str | None:
    """What a field's name says of its value: decided once, when the plan is built."""
    if _SECRET_KEY.search(key):
        return "secret"
    return "certificate" if _CERT_KEY.search(key) else None


def redact_by_key(c: Column, key: str) -> tuple[Column, Column]:
    """Value of a string field after the rule on its name, and 1 where the rule took it."""
    kind = key_kind(key)
    if kind is None:
        return c, F.lit(0)
    took = c.isNotNull() & (c != PLACEHOLDER[kind])
    return F.when(took, F.lit(PLACEHOLDER[kind])).otherwise(c), took.cast("int")
