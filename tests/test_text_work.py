"""What the text steps cost: each pattern stands in a plan once, however the steps are nested; and odd characters through the quick ways."""

from pyspark.sql import functions as F

from docmill.functions import jstext, redact, text
from docmill.functions.text import CP1252


def patterns(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(")


def test_each_rule_stands_once_in_a_plan(spark):
    d = spark.range(1).select("id", F.col("id").cast("string").alias("t"))
    assert patterns(redact.findings(d, "id", "t")) <= len(redact.RULES)
    assert patterns(d.select(text.strip_html(F.col("t")))) <= 2 * (5 + len(text.ENTITIES))  # the plan names its one column by its expression, so each is there twice


def redecoded(s: str) -> str:
    back = {chr(c): b for c, b in ((ord(x), b) for b, x in CP1252.items())}
    low = lambda c: back.get(c, ((ord(c) - 0x10000) >> 10 if ord(c) > 0xFFFF else ord(c)) & 255)
    return bytes(map(low, s)).decode("utf-8", "replace").removeprefix("\ufeff")


def test_redecoding_of_any_character(spark):
    # valid UTF-8 by low bytes: the number of marks for bad bytes is the engine's own
    said = ["Ã©tÃ©", "lâ€™eau", "plain", "", "\u4e41\u4e42Ã©", "\u0441\u0442 Ã©", "\U00010041x\U0001f441", "ï»¿Ã©", "\ud7ff".encode("utf-16", "surrogatepass").decode("utf-16")[:0] + "\ud741Ã¨"]
    got = [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").repartition(1).sortWithinPartitions("i").select(text._redecode(F.col("s"))).collect()]
    want = [redecoded(s) for s in said]
    assert [(g, w) for g, w in zip(got, want) if "\ufffd" not in w and g != w] == [] and [("\ufffd" in g) for g in got] == [("\ufffd" in w) for w in want]


def test_trim_takes_all_white_space(spark):
    white = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
    d = spark.createDataFrame([(white + "a \u00a0b" + white,), (white,), ("\u200bx",), (None,)], "s string")
    assert [r[0] for r in d.select(jstext.trim(F.col("s"))).collect()] == ["a \u00a0b", "", "\u200bx", None]


def test_redaction_at_word_edges(spark):
    said = ["xpassword=a, Password = 'b', server.token:c", "a.key é.pem _x.p12 -y.key- ..z.PEM a.keys /k/.key", "x1.2.3.4 é1.2.3.4 1.2.3.4.5 (10.0.0.1)", "xC:\\etc\\a éC:\\srv\\b c:\\www\\c", "mot\u00a0de passe : z"]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in said], "s string").repartition(1).select(redact.redacted(F.col("s"))["text"]).collect()]
    assert sorted(got) == sorted([
        "xpassword=a, Password = '[SECRET_REDACTED]', server.token:[SECRET_REDACTED]",
        "[CERTIFICATE_REDACTED] é.pem [CERTIFICATE_REDACTED] -[CERTIFICATE_REDACTED]- ..[CERTIFICATE_REDACTED] a.keys /[CERTIFICATE_REDACTED]",
        "x1.2.3.4 é[IP_REDACTED] [IP_REDACTED].5 ([IP_REDACTED])",
        "xC:\\etc\\a é[INTERNAL_PATH_REDACTED] [INTERNAL_PATH_REDACTED]",
        "mot\u00a0de passe : [SECRET_REDACTED]",
    ])


def test_gates_keep_what_the_rules_change(spark):
    rows = ["PASSWORD = Abc1; x", "Cert in a/b.KEY now", "see C.Pem", "at /OPT/app/x", "C:\\DATA\\y", "10.0.0.1", "nothing \u00e9 here.", "\u00c3\u00a9t\u00c3\u00a9", "a\u0085b\u009fc", "x\ufffd", "\x00a\x08\tb\x0b\x1f\x7f\n"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = d.select("i", redact.redacted(F.col("t"))["text"].alias("safe"), text.repaired(F.col("t"))["text"].alias("fixed"), text.strip_control(F.col("t")).alias("stripped")).orderBy("i").collect()
    assert [r.safe for r in got[:7]] == ["PASSWORD = [SECRET_REDACTED]; x", "Cert in [CERTIFICATE_REDACTED] now", "see [CERTIFICATE_REDACTED]", "at [INTERNAL_PATH_REDACTED]", "[INTERNAL_PATH_REDACTED]", "[IP_REDACTED]", "nothing \u00e9 here."]
    assert [r.fixed for r in got[6:10]] == ["nothing \u00e9 here.", "\u00e9t\u00e9", "abc", "x\ufffd"]
    assert got[10].stripped == "a\tb\n"
