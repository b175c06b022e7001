"""Periodic runs, SimHash and the filter audit against brute force; nulls, empty and long texts, ties, repeats, clashes, empty tables."""

import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docmill.llm import filter_audit, runs, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_runs(x, least=6, times=4):
    n, out = len(x), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and x[i] == x[i + p]:
                i += 1
            if i > s and i + p - s >= max(least, times * p):
                out.append((s, i + p - s, p))
            i += i == s
    return sorted(r for r in out if not any(x[r[0] : r[0] + r[1] - q] == x[r[0] + q : r[0] + r[1]] for q in range(1, r[2])))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=25), st.lists(st.sampled_from([b"a", b"b", b"A"]), min_size=1, max_size=7), st.integers(0, 6), st.lists(st.sampled_from([b"a", b"b"]), max_size=25))
def test_runs_against_brute_force(head, root, times, tail):
    words = head + root * times + tail
    assert runs.runs_in(words) == brute_runs(words)
    assert runs.runs_in(words, 1, 3) == brute_runs(words, 1, 3)


def test_runs_in_one_prefix():
    fibonacci = [b"a", b"b"]
    while len(fibonacci) < 600:
        fibonacci += fibonacci[: len(fibonacci) // 2 + 1]
    for words in (fibonacci, [b"x"] * 500, [b"x", b"x", b"y"] * 90 + [b"x"] * 90, [str(i).encode() for i in range(500)]):
        assert runs.runs_in(words) == brute_runs(words)


def test_collisions_are_seen():
    """With a base under which different words look equal, the words themselves decide."""
    x = [1, 2] * 12
    assert runs._runs(x, 6, 4, 0) == [(0, 24, 2)]
    with pytest.raises(runs.Collision):
        runs._runs([1, 2, 3, 4, 5, 6, 7, 8, 9] * 4 + [5] + [1, 2, 3, 4, 5, 6, 7, 8, 9, 4] * 4, 6, 4, 0)


def corpus():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = line(300)
    out = [None, "", " \t\n", "one", "x x x x x x", "A a A a A a A a", base, base, base.upper(), base + " tail", (line(9) + "\n") * 50, "no\xa0break " * 7, line(30000)]
    out += [base.replace(rng.choice(words) + " ", "edit ", 2) for _ in range(25)]
    out += [line(rng.randrange(1, 250)) for _ in range(60)] + [line(3).capitalize() + "#" for _ in range(5)]
    rows = [(i, t, None, (None, "", "a", "b")[i % 4], None) for i, t in enumerate(out)]
    rows += [(None, base, None, "a", None), (None, "null id", None, None, None), (3, "another of id 3", None, "b", None), rows[6], rows[6], rows[9]]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(f"own {c}") for c in ("runs", "fp", "part", "mask", "digest", "least", "key", "t", "n", "good", "component", "i", "j")}).repartition(5)


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    d = tmp_path_factory.mktemp("audit")
    docs.write.parquet(f"{d}/documents.parquet")
    said = [(i, i % 2, i % 3 == 0) for i in range(0, 100, 2)] + [(4, 1, False), (4, None, None), (None, 1, True), (9999, 1, True)]
    spark.createDataFrame([(i, q, None if x is None else int(x)) for i, q, x in said], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op11_query(spark, rows, folder):
    got = sorted(map(tuple, runs.op11_periodic_runs(spark, folder).collect()), key=str)
    want = []
    for doc_id, text, *_ in rows:
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if len(words) < 5000:
            found = brute_runs(words)
        else:
            found = runs.runs_in([w.encode() for w in words])
        gone = {i for s, n, p in found for i in range(s + p, s + n)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        milli = 1000 * best[1] // best[2] if found else None
        want.append((doc_id, len(found), *best, milli, sha("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()), sha(" ".join(w for i, w in enumerate(words) if i not in gone).encode())))
    assert got == sorted(want, key=str)
    assert sum(r[1] for r in got) > 5


def slow_fingerprint(text):
    import xxhash

    words = [w for w in (text or "").encode().lower().replace(b"\x0b", b" ").split() if w]
    if not words:
        return 0
    k = min(4, len(words))
    hs = [xxhash.xxh64(b" ".join(words[i : i + k]), seed=42).intdigest() for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def joined(items, near):
    """Least member of each one's component, by comparing all pairs."""
    comp = list(range(len(items)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in itertools.combinations(range(len(items)), 2):
        if near(items[a], items[b]):
            x, y = sorted((find(a), find(b)))
            comp[y] = x
    return [find(i) for i in range(len(items))]


def test_op12_query(spark, rows, folder):
    assert slow_fingerprint("x") == spark.sql("SELECT xxhash64('x') AS h").first().h % 2**64  # Spark's own hash has this seed
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.op12_simhash(spark, folder).collect()), key=str)
    fps = [slow_fingerprint(r[1]) for r in rows]
    comp = joined(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (doc_id, *_), c in zip(rows, comp, strict=True):
        if doc_id is not None:
            least[c] = min(least.get(c, doc_id), doc_id)
    assert got == sorted(((r[0], f"{fp:016x}", least.get(c)) for r, fp, c in zip(rows, fps, comp, strict=True)), key=str)


def test_near_components(spark, monkeypatch):
    """Chains, groups at every distance and hot keys that are dealt to parts; each number of tables."""
    rng = np.random.default_rng(2)
    fps = []
    for _ in range(40):
        x = int(rng.integers(0, 2**63)) * 2
        for _ in range(int(rng.integers(1, 12))):
            for b in rng.choice(64, int(rng.integers(1, 8)), replace=False).tolist():
                x ^= 1 << b
            fps.append(x)
    hub = int(rng.integers(0, 2**63))
    fps += [hub ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (80, 2))] + [0, 0, 2**64 - 1]
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    for radius, few in ((4, None), (4, 5), (2, 5), (6, None)):
        if few:
            monkeypatch.setattr(simhash, "hot_share", lambda rows, least=0, heavy=0, few=few: few)
            monkeypatch.setattr(simhash, "ROWS", 50)
        d = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long").repartition(3).withColumn(simhash.OWN + "row", F.col("doc_id"))
        got = {r.doc_id: r.component_id for r in simhash.near_components(d, radius).collect()}
        assert got == dict(enumerate(joined(fps, lambda a, b, radius=radius: (a ^ b).bit_count() <= radius)))
        monkeypatch.undo()


def test_tables_meet_all_pairs():
    rng = random.Random(1)
    for n in (10, 10**6, 10**8, 10**11):
        masks = simhash.layout(n, 4)
        for _ in range(2000):
            d = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not d & m for m in masks)
    assert len(simhash.layout(10**5, 4)) == 5 < len(simhash.layout(10**9, 4))


@pytest.mark.parametrize("radius", [1, 3, 4, 6])
def test_counters_against_popcount(radius):
    rng = np.random.default_rng(radius)
    fp = np.repeat(rng.integers(0, 2**63, 5, dtype=np.uint64), 70)
    for _ in range(3):
        fp ^= np.uint64(1) << rng.integers(0, 64, len(fp)).astype(np.uint64)
    start, size, cross = np.array([0, 1, 131]), np.array([1, 130, 219]), np.array([0, 0, 77])
    want = list(range(len(fp)))
    for s, m, c in zip(start, size, cross, strict=True):
        ok = lambda a, b, s=s, c=c: (int(fp[s + a]) ^ int(fp[s + b])).bit_count() <= radius and (not c or a < c <= b)
        want[s : s + m] = [s + x for x in joined(range(m), ok)]
    assert simhash.near_in(fp, start, size, cross, radius).tolist() == want


def test_op13_query(spark, rows, folder):
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.op13_filter_audit(spark, folder).collect()}
    good = {i for i in range(0, 100, 2) if i % 2} | {4}
    toxic = {i for i in range(0, 100, 2) if i % 3 == 0}
    docs = []
    for doc_id, text, _, source, _ in rows:
        text = text or ""
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text)}
        fails["E"] = doc_id is not None and any(r[0] is not None and r[0] < doc_id and (r[1] or "") == text for r in rows)
        docs.append((source or "", {f for f, x in fails.items() if x}, doc_id in good, doc_id in toxic))
    want, total = {}, {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for k, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                fail = sum(f in d[1] for d in mine)
                want[part, order, k] = (len(left), len(gone), fail - len(gone), sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone))
                total[part, f] = total.get((part, f), 0) + len(gone)
    assert got == {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in want.items()}
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {r[:3]: r[3:] for r in con.sql(f"SELECT {', '.join(names)} FROM ({filter_audit.OP13_SQL})").fetchall()} == got


def test_empty_tables(spark, docs, folder):
    none = docs.where("false")
    assert runs.find_runs(none).count() == 0
    assert simhash.fingerprints(none).count() == 0 and simhash.near_components(simhash.fingerprints(none)).count() == 0
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    assert filter_audit.audit(none, labels).count() == 0
    assert filter_audit.audit(docs, labels.where("false")).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0
