"""Dates of articles and tickets: spreadsheet serials, seconds, milliseconds, and written dates, all to ISO strings in UTC.

Written forms that are read (others stay as they are, with a warning by the caller):

- ISO: year, year-month or date, with time (minutes or seconds, fractions of a second) and with Z or an offset;
- month/day/year, one or two digits, with or without time;
- day and month name, or month name and day, with year, weekday, time, GMT, UTC, Z or an offset;
- tickets also: date and time whose parts roll over, and day/month/year with two digits each, which goes first.

A time without zone is UTC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.functions.jstext import let, trim

EXCEL_EPOCH_MS = -2209161600000
#: First three letters of the months' names.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_NUMBER = r"\A[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
_NAMES = "|".join(MONTHS)
_ZONE = r"(Z|GMT|UTC)?(?:GMT|UTC)?([+-][0-9]{2}:?[0-9]{2})?"
_CLOCK = rf"([0-9]{{1,2}}):([0-9]{{2}})(?::([0-9]{{2}})(?:\.([0-9]+))?)?[ ]*{_ZONE}"
_DAY = r"(?:(?:sun|mon|tue|wed|thu|fri|sat)[a-z]*\.?,?[ ]+)?"
#: Patterns with the groups' numbers of year, month, day, hour, minute, second, fraction and offset (0: none).
_ISO = r"\A([0-9]{4})(?:-([0-9]{2})(?:-([0-9]{2}))?)?(?:[T ]([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:\.([0-9]+))?)?(Z)?([+-][0-9]{2}:?[0-9]{2})?)?\z"
_FREE = (
    (_ISO, (1, 2, 3, 4, 5, 6, 7, 9)),
    (rf"(?i)\A([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{4}})(?:,?[ ]+{_CLOCK})?\z", (3, 1, 2, 4, 5, 6, 7, 9)),
    (rf"(?i)\A{_DAY}([0-9]{{1,2}})[ -]+({_NAMES})[a-z]*\.?,?[ -]+([0-9]{{4}})(?:,?[ ]+{_CLOCK})?\z", (3, 2, 1, 4, 5, 6, 7, 9)),
    (rf"(?i)\A{_DAY}({_NAMES})[a-z]*\.?[ ]+([0-9]{{1,2}}),?[ ]+([0-9]{{4}})(?:,?[ ]+{_CLOCK})?\z", (3, 1, 2, 4, 5, 6, 7, 9)),
)
_ROLLING = (
    (r"\A([0-9]{4})-([0-9]{2})-([0-9]{2})[ T]([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?\z", (1, 2, 3, 4, 5, 6, 0, 0)),
    (r"\A([0-9]{2})/([0-9]{2})/([0-9]{4})(?:[ T]([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?)?\z", (3, 2, 1, 4, 5, 6, 0, 0)),
)


def number_ms(v: Column) -> Column:
    """Milliseconds of a number by its size: day serial, seconds or milliseconds; null for other sizes."""
    day = (v > 20000) & (v < 80000)
    ms = F.when(day, F.lit(float(EXCEL_EPOCH_MS)) + v * 86400000).when((v > 1e12) & (v < 4102444800000), v).when((v > 1e9) & (v < 4102444800), v * 1000)
    return ms.cast("bigint")


def _parts(s: Column, pattern: str, groups: tuple[int, ...]) -> Column:
    """Struct of the numbers in a written date; an absent month or day is 1, other absent parts are 0."""
    text = lambda i: F.regexp_extract(s, pattern, i) if i else F.lit("")
    number = lambda i, absent=0: F.coalesce(F.nullif(text(i), F.lit("")).try_cast("int"), F.lit(absent))
    year, month, day, hour, minute, second, fraction, offset = groups
    named = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(text(month), 1, 3))).cast("int")
    zone = F.regexp_replace(text(offset), ":", "")
    minutes = F.coalesce(F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int"), F.lit(0))
    return F.struct(
        number(year).alias("y"),
        F.when(named > 0, named).otherwise(number(month, 1)).alias("m"),
        number(day, 1).alias("d"),
        number(hour).alias("h"),
        number(minute).alias("i"),
        number(second).alias("s"),
        F.rpad(F.substring(text(fraction), 1, 3), 3, "0").try_cast("int").alias("ms"),
        F.when(F.startswith(zone, F.lit("-")), -minutes).otherwise(minutes).alias("zone"),
    )


def _ms(p: Column) -> Column:
    """Milliseconds of the parts; what lies beyond a month, day or clock rolls over."""
    days = F.datediff(F.add_months(F.make_date(p["y"], F.lit(1), F.lit(1)), p["m"] - 1), F.to_date(F.lit("1970-01-01"))) + p["d"] - 1
    return days.cast("bigint") * 86400000 + ((p["h"] * 60 + p["i"] - p["zone"]) * 60 + p["s"]).cast("bigint") * 1000 + p["ms"]


def _strict(p: Column) -> Column:
    """Milliseconds where month, day and clock exist (day 31 is accepted in any month, and rolls over)."""
    clock = ((p["h"] < 24) & (p["i"] < 60) & (p["s"] < 60)) | ((p["h"] == 24) & (p["i"] == 0) & (p["s"] == 0) & (p["ms"] == 0))
    return F.when(p["m"].between(1, 12) & p["d"].between(1, 31) & clock, _ms(p))


def _rolled(p: Column) -> Column:
    return _ms(F.struct(F.when(p["y"] < 100, p["y"] + 1900).otherwise(p["y"]).alias("y"), *[p[n].alias(n) for n in ("m", "d", "h", "i", "s", "ms", "zone")]))


def written_ms(s: Column, ticket: bool = False) -> Column:
    """Milliseconds of a written date, null for what is none; a pattern's parts are taken apart only where it matches."""
    out = None
    for forms, ms in ((_ROLLING, _rolled), (_FREE, _strict)) if ticket else ((_FREE, _strict),):
        for pattern, groups in forms:
            held, value = F.regexp_like(s, F.lit(pattern)), let(_parts(s, pattern, groups), ms)
            out = F.when(held, value) if out is None else out.when(held, value)
    return out


def iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_date(raw: Column, ticket: bool = False) -> Column:
    """Struct (iso, ms, raw): raw is kept where a non-empty value is no date. ``ticket`` adds decimal commas and the forms of tickets."""
    s = trim(raw)
    digits = F.regexp_replace(s, r"\A([^,]*),", "$1.") if ticket else s
    num = F.when(F.regexp_like(digits, F.lit(_NUMBER)), digits.try_cast("double"))
    ms = F.coalesce(number_ms(num), F.when(num.isNull(), written_ms(s, ticket)))
    return let(ms, lambda x: F.struct(iso(x).alias("iso"), x.alias("ms"), F.when(x.isNull() & (raw != ""), raw).alias("raw")))


def rounded_hours(raw: Column) -> Column:
    """Hours from text with decimal point or comma; what is no number is 0; halves round up at two decimals."""
    s = F.regexp_replace(trim(raw), r"\A([^,]*),", "$1.")
    v = F.when(F.regexp_like(s, F.lit(_NUMBER)), s.try_cast("double"))
    return F.coalesce(F.floor(v * 100 + 0.5) / 100.0, F.lit(0.0))
