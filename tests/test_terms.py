"""Terms by one automaton against a search for each."""

import random

from docmill.functions import terms
from docmill.operators import tickets


def test_scanned_against_searches(spark):
    rng = random.Random(4)
    words = [t for ts in tickets.TERMS.values() for t in ts] + ["alerte rouge", "x", "do", "wn", "é", "mise a jour"]
    texts = [None, "", "up", "downtime details", "mise a jour corrective"] + ["".join(rng.choice(words)[: rng.randrange(1, 30)] + rng.choice(("", " ")) for _ in range(rng.randrange(8))) for _ in range(400)]
    d = spark.createDataFrame([(i, t, t, "own") for i, t in enumerate(texts)], "pos long, a string, b string, c string").repartition(3)
    out = terms.scanned(d, {"a": "a_bits", "b": "b_bits"}, tickets.TERMS, drop=("b",))
    assert out.columns == ["pos", "a", "c", "a_bits", "b_bits"]
    got = out.select("pos", "a_bits", "b_bits", *[terms.holds(out.a_bits, tickets.TERMS, n).alias(n) for n in tickets.TERMS], terms.holds(out.a_bits, tickets.TERMS, "spam", "anomaly").alias("either")).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.pos] or ""
        want = {n: any(t in text for t in ts) for n, ts in tickets.TERMS.items()}
        assert {n: r[n] for n in want} == want and r.a_bits == r.b_bits and r.either == (want["spam"] or want["anomaly"])
    assert terms.scanned(d.where("false"), {"a": "x"}, {"g": ("t",)}).count() == 0
