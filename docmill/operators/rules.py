"""The text rules that the tools share, with their switches, and what they find."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.functions.jstext import WS, let, trim
from docmill.functions.redact import KINDS, matches, redacted
from docmill.functions.text import clean, repaired

COUNTERS = {"secret": "n_secret", "certificate": "n_certificate", "ip": "n_ip", "internalPath": "n_path"}
FOUND = "array<struct<type:string,preview:string>>"


@dataclass(frozen=True)
class Rules:
    """Switches of the clean-up. ``kinds`` are redacted; ``find`` also lists what is, masked unless ``reveal``."""

    fix_encoding: bool = True
    control: bool = True
    whitespace: bool = True
    images: bool = True
    kinds: tuple[str, ...] = KINDS
    find: bool = False
    reveal: bool = False


def fixed(c: Column, rules: Rules) -> Column:
    """Struct of a text after the repair of its encoding, and n, the corrections; null is empty."""
    c = F.coalesce(c, F.lit(""))
    return repaired(c) if rules.fix_encoding else F.struct(c.alias("text"), F.lit(0).alias("n"))


def safe(c: Column, rules: Rules) -> Column:
    """Struct of the redacted text, the matches of each kind, and found: what they are, if asked."""

    def told(r: Column) -> Column:
        some = sum((r[k] for k in KINDS), F.lit(0)) > 0
        found = F.when(some, matches(c, rules.kinds, rules.reveal)).otherwise(F.array().cast(FOUND)) if rules.find else F.array().cast(FOUND)
        return F.struct(r["text"].alias("text"), *[r[k].alias(k) for k in KINDS], found.alias("found"))

    return let(redacted(c, rules.kinds), told)


def tidy(c: Column, rules: Rules) -> Column:
    return clean(c, control=rules.control, whitespace=rules.whitespace)


def cleaned(c: Column, rules: Rules, redaction: bool = True) -> Column:
    """Struct of a field's text (repaired, cleaned and, if asked, redacted), n (corrections), the matches of each kind, and found."""

    def run(r: Column) -> Column:
        text = tidy(r["text"], rules)
        done = let(text, lambda t: safe(t, rules)) if redaction else F.struct(text.alias("text"), *[F.lit(0).alias(k) for k in KINDS], F.array().cast(FOUND).alias("found"))
        return let(done, lambda d: F.struct(d["text"].alias("text"), r["n"].alias("n"), *[d[k].alias(k) for k in KINDS], d["found"].alias("found")))

    return let(fixed(c, rules), run)


def blanks_in_json(c: Column) -> Column:
    """Runs of white space that a text has as JSON, where line ends and tabs are escapes: what its words are told by. Null has none."""
    return F.coalesce(F.regexp_count(c, F.lit(f"[{WS.replace(chr(92) + 't-' + chr(92) + 'r', '')}]+")), F.lit(0))


def is_blank(c: Column) -> Column:
    """1 for a text of white space only, 0 for others and null."""
    return F.when(trim(c) == "", 1).otherwise(0)
