"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.llm import ann, chat_format, components, jaccard, language_id, licenses, mixing, packing, quality, suffix_dedup, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = " ".join(rng.choice(words) for _ in range(400))
    out = [None, "", "  \t", "one", "two words", base, base, base.upper(), base + " tail", base[: len(base) // 2], "ab" * 300, base * 20, "é" * 120]
    for _ in range(30):
        ws = base.split()
        for _ in range(rng.randrange(0, 6)):
            ws[rng.randrange(len(ws))] = "edit" + str(rng.randrange(99))
        out.append(" ".join(ws))
    for _ in range(20):
        out.append(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 200))))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, DOCS).withColumns({"t": F.lit("clash"), "k": F.lit(1), "n": F.lit(2)})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def reference_components(rows, k, num, den):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    comp = {d: d for d in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("k, num", [(3, 90), (5, 80)])
def test_jaccard(docs, k, num):
    got = {r[0]: (r[1], r[2]) for r in jaccard.near_classes(docs, k, num, 100).collect()}
    assert got == reference_components(list(enumerate(texts())), k, num, 100)


def test_divide_skip():
    rng = np.random.default_rng(1)
    q = np.unique(rng.integers(0, 200, 90).astype(np.uint64))
    sets = [np.unique(np.concatenate([q[rng.random(len(q)) < p], rng.integers(200, 300, 9).astype(np.uint64)])) for p in (0.1, 0.5, 0.9, 0.95, 1, 0.85)]
    for t in (1, 30, 60, 80):
        need = np.full(len(sets), t)
        assert jaccard.divide_skip(q, sets, need).tolist() == [i for i, s in enumerate(sets) if len(np.intersect1d(q, s)) >= t]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def reference_cut(rows):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = True
            seen.add(w)
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[d] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(docs, monkeypatch):
    cut = suffix_dedup.cut_repeats(docs)
    assert cut.columns == [*docs.columns, "n_bytes", "n_removed", "n_spans", "kept"]
    assert {r.t for r in cut.select("t").collect()} == {"clash"}
    got = {r[0]: tuple(r[1:]) for r in cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()}
    assert got == reference_cut(list(enumerate(texts())))


def test_suffix_dedup_repeated_rows(spark):
    rng = random.Random(5)
    a, b = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(60)) for x in "ab")
    rows = [(1, a), (1, a), (1, a), (2, b), (3, a[:300] + b), (4, None), (4, None), (None, a), (5, b), (5, b)]
    got = [tuple(r) for r in suffix_dedup.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()]
    want = reference_cut({r for r in rows if r[0] is not None})
    whole = (len(a), 0, 0, hashlib.sha256(a.encode()).hexdigest())
    assert sorted(map(str, got)) == sorted(str((d, *(want[d] if d is not None else whole))) for d, _ in rows)


def test_suffix_dedup_crowded(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", 3)
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.cut_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()}
    assert got == reference_cut(list(enumerate(texts())))


def test_suffix_dedup_crowded_comes_apart(spark, monkeypatch):
    rng = random.Random(8)
    line = "the one line of forty-odd bytes that all have"
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    sides = [word(60) for _ in range(3)]
    rows = [(i, f"{word(60)}{i} {line}{sides[i % 3]}") for i in range(30)] + [(i, f"{sides[i % 3]}{line} {i}{word(60)}") for i in range(30, 60)] + [(i, sides[0] + line + sides[1]) for i in range(60, 64)]
    wide, widths, made = suffix_dedup.crowded_windows, [], []
    monkeypatch.setattr(suffix_dedup, "GROUP", 3)
    monkeypatch.setattr(suffix_dedup, "crowded_windows", lambda r: widths.append(r.agg(F.max("n")).first()[0]) or wide(r))
    halved = suffix_dedup.halved
    monkeypatch.setattr(suffix_dedup, "halved", lambda r: made.append((r.count(), halved(r).count())) or halved(r))
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()}
    assert got == reference_cut(rows)
    # no run of an anchor that many have is told window by window, and a cut gives two pieces of it at most
    assert all(w is None or w <= 2 for w in widths) and made and all(b <= 2 * a for a, b in made)


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rows = packing.pack(packing.cut(docs)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.length <= 2048
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    for d, text in enumerate(texts()):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        mine = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == d)
        assert sum(m[2] for m in mine) == len(ids)
        assert all(m[2] == 2048 for m in mine[1:])
        assert all(zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) == c for _, s, n, c in mine)


def fewest(lengths, size):
    """The least number of bins, by trying all."""
    best = len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k, r in enumerate(rooms):
            if r >= lengths[i] and r not in rooms[:k]:
                go(i + 1, [*rooms[:k], r - lengths[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, size - lengths[i]])

    go(0, [])
    return best


def test_packing_search():
    rng = random.Random(4)
    for _ in range(150):
        lengths = sorted((rng.randrange(1, 21) for _ in range(rng.randrange(1, 9))), reverse=True)
        bins = packing.search(lengths, 20)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= 20 for b in bins)
        assert len(bins) <= fewest(lengths, 20) + 1
    lengths = [min(2048, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(3000)]
    # next fit wastes a fifth, the search nothing
    assert len(packing.next_fit(lengths, 2048)) > 1.15 * packing.least_bins(lengths, 2048)
    assert len(packing.Search(packing.next_fit(lengths, 2048), lengths, 2048).run()) == packing.least_bins(lengths, 2048)
    s = packing.Search([[0], [1, 2], [3]], [9, 5, 5, 7], 10)
    before = sum(f * f for f in s.fill)
    s.run()
    assert sum(f * f for f in s.fill) >= before


def test_packing_passes(spark):
    rng = random.Random(6)
    rows = [(None if i % 50 == 0 else i // 2, 0, 0, min(2048, int(rng.lognormvariate(5.5, 1.2)) + 1), 7) for i in range(1500)] + [(1, 0, 0, 300, 5)] * 200
    p = packing.pack(spark.createDataFrame(rows, packing.PIECES), group=128).collect()
    assert sorted(tuple(r[:5]) for r in p if r.doc_id is not None) == sorted(r for r in rows if r[0] is not None) and len(p) == len(rows)
    by = {}
    for r in p:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))] and sum(n for _, n in places) <= 2048
    assert len(by) <= packing.least_bins([r[3] for r in rows], 2048) + 1


def test_encoder_like_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    encode = packing.encoder(path)
    for s in ("", "a<|endoftext|>b", "日本語 \u00a0\u2003x\r\n\n  it's 12³ \U0001f600", "a" * 5000, " \t \n"):
        assert list(encode(s)) == t.encode(s, add_special_tokens=False).ids


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    for source in {r.source for r in rows}:
        mine = [r for r in rows if r.source == source]
        assert sum(r.taken for r in mine) == int(mine[0].target) <= 3 * mine[0].source_size
        assert all(r.taken <= 3 * r.size for r in mine)


def test_mixed_stage(spark):
    import math
    from collections import Counter

    import corpus_pipeline

    rows = [(None, f"null {i} " + "x " * i, "en", "ab"[i % 2], 1) for i in range(40)] + [(i, f"own {i} y", "en", "abc"[i % 3], 1) for i in range(20)]
    rows += [(None, "same text", "en", "a", 1)] * 9 + [(7, "twice w", "en", "b", 1)] * 3 + [(None, None, "en", None, 0)]
    d = spark.createDataFrame(rows, DOCS)
    want = Counter()
    for r in mixing.mix(d).where("taken > 0").collect():
        want[r.doc_id, r.source, r.size] += math.ceil(r.taken / r.size)
    got = Counter((r.doc_id, r.source, len((r.text or "").split())) for r in corpus_pipeline.mixed(spark, d, "").collect())
    assert got == want and any(k[0] is None for k in got)
    # rows without id are ordered by their texts: the order of the input doesn't matter
    names = [(None, w, "en", "a", 1) for w in "one two three four five six".split()] + [(None, "x " * 50, "en", "b", 1)]
    taken = [Counter(t.text for t in corpus_pipeline.mixed(spark, spark.createDataFrame(r, DOCS), "").collect()) for r in (names, names[::-1])]
    assert taken[0] == taken[1]


def test_chat(spark):
    long_ = "word " * 3000
    turns = [(1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", "\\l<s>[INST]"), (1, 2, "assistant", "tie"), (1, 3, "user", long_), (1, 4, "assistant", long_), (2, 0, None, "x\\"), (None, 0, "tool\nx", "[/ROLE]")]
    d = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    windows = chat_format.chat_windows(d)
    got = {r.conv_id: r for r in chat_format.read_back(windows).collect()}
    for conv in (1, 2, None):
        mine = sorted((t[1], t[2] or "", t[3] or "") for t in turns if t[0] == conv)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256("".join(x for _, r, x in mine if r == "assistant").encode()).hexdigest()
    assert got[1].n_windows > 1


def test_chat_budget(spark):
    turns = [(1, i, "assistant" if i % 2 else "user", "ok") for i in range(3000)]
    turns += [(2, 0, "system", "word " * 3000)] + [(2, i, "user", "x " * 200) for i in range(1, 40)]
    turns += [(3, 0, "system", "be brief")] + [(3, i, "assistant" if i % 2 else "user", "<s>[INST]" * (i % 60)) for i in range(1, 200)] + [(3, 5, "user", None)] * 3
    w = chat_format.chat_windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))).collect()
    import public_tokenizers

    count = chat_format.bpe_counter(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for r, n in zip(w, count([r.formatted for r in w]), strict=True):
        assert n <= r.n_tokens and (r.n_tokens <= 2048 or r.n_turns == 1)
    # each assistant text is a target once; the system turn stays where it fits
    assert [sum(len(r.loss_starts) for r in w if r.conv_id == c) for c in (1, 2, 3)] == [1500, 0, sum(1 for t in turns if t[0] == 3 and t[2] == "assistant")]
    assert all(chat_format.parse(r.formatted)[0] == ("system", "be brief") for r in w if r.conv_id == 3)
    assert not any("word word" in r.formatted for r in w if r.conv_id == 2 and r.window > 0)


def test_op1_query(spark, tmp_path):
    turns = [(4, 1, "assistant", "b", 1), (4, 0, "user", "a", 1), (4, 2, "assistant", None, 1)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string, formatted int").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat_format.op1_chat_format(spark, str(tmp_path)).collect()}
    said = "</s>[INST] ok [/INST]"
    assert set(got) == {4, -7} and got[-7].loss_chars == len(said) and got[-7].n_turns == 2
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert got[-7].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[4].loss_sha256 == hashlib.sha256(b"b").hexdigest()


@pytest.mark.parametrize("text", ["\\", "\\l", "<s>", "</s>[INST] ok [/INST]", "[ROLE]\n[/ROLE]", "<\\s>", "\\\\n"])
def test_escape(text):
    assert chat_format.unescape(chat_format.escape(text)) == text
    assert not any(c in chat_format.escape(text) for c in chat_format.CONTROLS)
    assert chat_format.unescape(chat_format.escape(text, role=True)) == text


def test_language(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    p = language_id.predict(d, language_id.fit(d.where(~language_id.held_out()))).where(language_id.held_out())
    assert p.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_language_edges(docs):
    rows = {r.doc_id: r for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    assert [rows[i].lang_pred for i in range(3)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in rows.values())


def test_quality(spark):
    d, y = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    m = quality.train(*quality.sample(d.where(~language_id.held_out()), y.where(~language_id.held_out())))
    rows = quality.score(d, m).where("held_out").join(y, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_licenses(spark):
    d = spark.createDataFrame([(1, "x Released under the  MIT\nLicense. y"), (2, None), (3, "mit license"), (4, "é " + licenses.TEMPLATES["ISC"].replace("copy, ", ""))], "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.scan(d).collect()}
    assert set(rows) == {1, 4} and rows[1].license == "MIT-notice" and rows[4].license == "ISC" and rows[4].start_char == 2
    assert (rows[1].start_char, rows[1].end_char) == (2, 33)


def test_licenses_stray_words(spark):
    texts = ["Released under the MIT License. See the LICENSE file", "All rights reserved. All rights reserved.", "for all of these works, all rights reserved"]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = sorted((r.doc_id, r.license, r.n_matched, texts[r.doc_id][r.start_char : r.end_char]) for r in rows)
    assert got == [(0, "MIT-notice", 5, "Released under the MIT License"), (1, "all-rights-reserved", 3, "All rights reserved"), (1, "all-rights-reserved", 3, "All rights reserved"), (2, "all-rights-reserved", 3, "all rights reserved")]
    assert len({r.start_char for r in rows if r.doc_id == 1}) == 2


def test_licenses_far_word():
    template = b"licensed under the apache license version 2 0".split()
    words = b"licensed under the apache license version 2 a b c d e 0".split()
    assert licenses.align(*numbered(template, words), 0, 8, 0, len(words), 0.8) == (7, 0, 6)


def numbered(template, words):
    number = {w: i for i, w in enumerate(dict.fromkeys([*template, *words]))}
    return (np.array([number[w] for w in x]) for x in (template, words))


def plain_align(template, words, start, band, lo, hi, coverage):
    """All common subsequences in the band, pair by pair: a pair of places, its matches so far and its first word."""
    size, paths, found = len(template), {}, None
    for i in range(size):
        for j in range(max(lo, start + i - band, 0), min(hi, start + i + band + 1)):
            if words[j] != template[i]:
                continue
            mine = {1: j}
            for (i2, j2), held in paths.items():
                # between two matches a path skips words of both, within the band
                if i2 < i and j2 < j:
                    for m, first in held.items():
                        mine[m + 1] = max(mine.get(m + 1, -1), first)
            paths[i, j] = mine
            for m, first in mine.items():
                if m >= coverage * size and m >= coverage * (j - first + 1):
                    key = (m, first - j, -first)
                    if found is None or key > found[0]:
                        found = key, (m, first, j)
    return found and found[1]


def test_align_against_plain_paths():
    rng = random.Random(9)
    for _ in range(300):
        template = [rng.randrange(4) for _ in range(rng.randrange(1, 12))]
        words = [rng.randrange(5) for _ in range(rng.randrange(0, 8))] + [w for w in template if rng.random() < 0.9] + [rng.randrange(5) for _ in range(rng.randrange(0, 8))]
        start, band, coverage = rng.randrange(-3, 12), rng.randrange(1, 6), rng.choice((0.5, 0.8, 1.0))
        lo = rng.randrange(0, 3)
        hi = rng.randrange(max(lo, len(words) - 3), len(words) + 1) if len(words) >= lo else lo
        assert licenses.align(np.array(template), np.array(words, int), start, band, lo, hi, coverage) == plain_align(template, words, start, band, lo, hi, coverage)


def test_licenses_in_long_notices():
    """Time grows with the text: no hit looks at what lies before it."""
    import time

    index = licenses.Index(licenses.TEMPLATES)
    took = []
    for n in (2000, 16000):
        data = b"All rights reserved. " * n
        words = licenses._TOKEN.findall(data.lower())
        numbers, t = index.numbers(words), index.names.index("All rights reserved") if "All rights reserved" in index.names else 0
        began = time.perf_counter()
        for at in range(0, len(words) - 3, 3):
            licenses.spans(index.numbered[t], numbers, at, at, 8, at, 0.8)
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0]


def vectors(spark, n=120, dim=24):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, dim))
    x[7] = x[40] = x[60]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1020, [0.0] * dim), (1040, [float("nan")] * dim), (1060, [None] * dim)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def nearest(x, ids, q, k):
    s = x @ x[q]
    return [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]


def test_ann(spark):
    x, v = vectors(spark)
    v = v.withColumns({"cell": F.lit("clash"), "q": F.lit(1), "score": F.lit(2)})
    got = {}
    for r in ann.search(v.unionByName(v.where("vec_id < 50")), v.where("vec_id % 20 = 0"), k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    hits = 0
    for q in range(0, 120, 20):
        near = nearest(x, np.arange(120), q, 20)
        hits += len({i for i, _ in got[q]} & {i for i, _ in near})
        assert all(abs(s - float(x[i] @ x[q])) < 1e-9 for i, s in got[q])
        assert got[q] == sorted(got[q], key=lambda z: (-z[1], z[0])) and len(got[q]) == 20
    assert set(got) == set(range(0, 120, 20)) and hits >= 0.9 * 120


def test_ann_exact_with_all_cells(spark):
    """With every cell probed the search is exact: copies, lengths, queries from elsewhere, fewer candidates than k."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 6)) * rng.uniform(0.2, 3, (60, 1))
    x[10:40] = x[10]
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(x)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.where("vec_id % 20 = 0").unionByName(spark.createDataFrame([(-5, rows[3][1]), (900, [1.0] * 6)], "vec_id long, embedding array<double>"))
    cells = (2 * 8) ** 2
    got = {}
    for r in ann.search(v, q, k=20, probes=cells).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for i in (0, 20, 40):
        assert got[i] == [j for j, _ in nearest(x, np.arange(60), i, 20)]
    for i, y in ((-5, x[3]), (900, np.ones(6))):
        s = (x * y).sum(1)
        assert got[i] == np.lexsort((np.arange(60), -s))[:20].tolist()
    few = v.where("vec_id < 7")
    assert ann.search(few, few.where("vec_id = 0"), probes=cells).count() == 6


def test_ann_work(spark):
    """Recall and scored pairs on isotropic vectors: no more than the README says."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = v.toPandas()
    x, ids = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy()
    asked = np.flatnonzero(ids % 20 == 0)
    found = ann.search(v, v.where("vec_id % 20 = 0")).toPandas().groupby("query_id").vec_id.apply(set)
    assert np.mean([len(found[ids[q]] & {i for i, _ in nearest(x, ids, q, 20)}) / 20 for q in asked]) >= 0.9
    scored = ann.candidates(v, v.where("vec_id % 20 = 0"), 20, 8, 2, None, 8192, 16384, 11)["found"].agg(F.sum("scored")).first()[0]
    assert scored < 0.42 * len(asked) * len(x)


def test_topk(spark):
    x, v = vectors(spark)
    ints = topk.quantize(v)
    got = {}
    for r in topk.top_k(ints, ints.where("vec_id % 20 = 0"), block=16, query_block=2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    i = np.floor(256 * x).astype(int)
    i = np.concatenate([i, np.zeros((1, i.shape[1]), int)])
    ids = np.array([*range(120), 1020])
    for q in got:
        s = i @ i[list(ids).index(q)]
        want = [(int(ids[j]), int(s[j])) for j in np.lexsort((ids, -s)) if ids[j] != q][:5]
        assert got[q] == want
    assert set(got) == {*range(0, 120, 20), 1020}


def test_topk_large_components_and_repeats(spark):
    big = 2**40
    rows = [(1, [big, big]), (2, [big, 1]), (3, [-big, 5]), (3, [-big, 5]), (2, [big, 1]), (None, [1, 1]), (4, [1, 2, 3])]
    v = spark.createDataFrame(rows, "vec_id long, ints array<long>").withColumns({"rank": F.lit("own"), "dim": F.lit("own"), "score": F.lit("own")})
    small = spark.createDataFrame([(9, [2, 1])], "vec_id long, ints array<long>")
    got = [(r.rank, r.vec_id, r.score) for r in topk.top_k(v, small, k=9).orderBy("rank").collect()]
    assert got == [(1, 1, 3 * big), (2, 2, 2 * big + 1), (3, 2, 2 * big + 1), (4, 3, 5 - 2 * big), (5, 3, 5 - 2 * big)]
    with pytest.raises(Exception, match="OverflowError|too large"):
        topk.top_k(v, v.where("vec_id = 1")).collect()
    floats = spark.createDataFrame([(1, [1e300, 0.5]), (2, [0.5, -0.1])], "vec_id long, embedding array<double>")
    assert [r.ints for r in topk.quantize(floats.where("vec_id = 2")).collect()] == [[128, -26]]
    with pytest.raises(Exception, match="past 2"):
        topk.quantize(floats).collect()


def test_topk_repeated_queries_and_far_scales(spark):
    rows = [(50, [2, 1]), (50, [2, 1]), (50, [0, 3]), (1, [1, 1]), (2, [1, 0])]
    v = spark.createDataFrame(rows, "vec_id long, ints array<long>")
    got = [(r.vec_id, r.score) for r in topk.top_k(v, v.where("vec_id = 50"), k=5).orderBy("rank").collect()]
    assert got == [(1, 3), (1, 3), (1, 3), (2, 2), (2, 2)]
    # components past 2**53 whose scores fit a long
    floats = spark.createDataFrame([(0, [float(2**46), 0.0]), (1, [0.5, 0.5]), (2, [0.25, 9.0])], "vec_id long, embedding array<double>")
    ints = topk.quantize(floats)
    assert [(r.vec_id, r.score) for r in topk.top_k(ints, ints.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 2**54 * 128), (2, 2**54 * 64)]
    # a query whose square is far past its products
    rng = np.random.default_rng(5)
    c = rng.integers(-256, 256, (300, 64))
    q = rng.integers(-(2**52), 2**52, (1, 64))
    ids = np.arange(300)
    _, found, scores = topk.block_top(q, c, ids, np.array([-1]), 5, (4, 16))
    want = sorted((-sum(int(a) * int(b) for a, b in zip(q[0], x)), i) for i, x in enumerate(c))[:5]
    assert list(zip([-int(s) for s in scores], found.tolist())) == want


def test_empty(spark, empty):
    assert jaccard.near_classes(empty).count() == 0
    assert suffix_dedup.cut_repeats(empty).count() == 0
    assert packing.pack(packing.cut(empty)).count() == 0
    assert mixing.mix(empty).count() == 0
    assert licenses.scan(empty).count() == 0
    assert chat_format.read_back(chat_format.chat_windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
    assert quality.score(empty, quality.train(*quality.sample(empty, spark.createDataFrame([], "doc_id long, quality int")))).count() == 0
    assert language_id.predict(empty, language_id.fit(empty)).count() == 0
    _, v = vectors(spark)
    none = v.where("false")
    assert ann.search(none, none).count() == 0
    assert topk.top_k(topk.quantize(none), topk.quantize(none)).count() == 0
