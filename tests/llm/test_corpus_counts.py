"""Phrases and source divergence against plain Python over whole texts."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidelens.llm import divergence, phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_phrases(rows, least=10, swallowed=50, top=2000):
    f, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, n in f.items():
        found, best = {p: a for p, a in n.items() if len(p) > 1 and a >= least}, []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= swallowed * a and p in (q[:2], q[1:]) for q, b in found.items()):
                continue
            score, k = min((1000000 * a * a // (n[p[:k]] * n[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), n[p[:k]], n[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


WORDS = ["alpha", "Beta", "gamma", "été", "ÉTÉ", "漢", "e", "x-y", "'s", "beta"]


def made(seed, n):
    rng = random.Random(seed)
    return [(rng.choice(["en", "fr", None, "und", ""]), "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "\x0c", "\xa0", " ", "\x85"]) for _ in range(rng.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("params", [phrases.PhraseParams(), phrases.PhraseParams(buckets=6), phrases.PhraseParams(words=12, phrases=20), phrases.PhraseParams(least=3, swallowed=80, top=15)], ids=["usual", "crowded", "flushed", "limits"])
def test_phrases(spark, params, monkeypatch):
    rows = made(1, 400)
    if params.words == 12:
        monkeypatch.setattr(phrases, "BATCH", 50)
    got = phrases.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(3), params=params)
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, params.least, params.swallowed, params.top)


def test_phrases_go_on_from_chunk_to_chunk():
    """Small chunks and batches, sums passed on in the middle of a text, in one process."""
    import pyarrow as pa

    rng = random.Random(2)
    text = " ".join(rng.choice(WORDS) for _ in range(3000)).lower()
    assert b"".join(phrases.chunks(text.encode(), 7)) == text.encode()
    lexicon = phrases.Lexicon()
    parts = [x for c in phrases.chunks(text.encode(), 7) for x in lexicon.encode("en", c).tolist()]
    assert parts == phrases.Lexicon().encode("en", text.encode()).tolist() and len(set(parts)) == len(set(text.split()))
    bits = phrases.Buckets(8, 10)
    h = lexicon.hashed()
    for _ in range(12):
        bits.add([h[1:3], h[2:4]])
    assert set(bits.counts.tolist()) <= {0, 10}
    tiles = list(bits.tiles())
    assert len(tiles) == 1 and pa.decompress(tiles[0][1], 256, codec="zstd").to_pybytes() == bits.counts.tobytes()


def test_scores_pass_64_bits(spark):
    a, left, right = 5_000_000_000_000_001, 6_000_000_000_000_007, 5_100_000_000_000_003
    got = spark.sql(f"SELECT {phrases._score('a', 'l', 'r')} AS s FROM (SELECT {a}L AS a, {left}L AS l, {right}L AS r)").first().s
    assert got == 1000000 * a * a // (left * right)


def plain_divergence(rows, least=3, top=200):
    docs = [("" if g is None else g, "" if s is None else s, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))) for g, s, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(w for d in own for w in set(d[2]))
        kept = sorted((w for w in df if df[w] >= least), key=str.encode)
        counts = {s: Counter(w for d in own if d[1] == s for w in d[2]) for s in {d[1] for d in own}}
        whole = sum(counts.values(), Counter())

        def p(c):
            size = sum(c[w] for w in kept) + len(kept)
            return {w: 1 + 10**9 * (c[w] + 1) // size for w in kept}

        ps, q = {s: p(c) for s, c in counts.items()}, p(whole)
        for s in ps:
            pairs = [(sum((ps[s][w] - ps[o][w]) ** 2 // ps[o][w] for w in kept), o) for o in ps if o != s]
            terms = [((ps[s][w] - q[w]) ** 2 // q[w], w) for w in kept if counts[s][w] > 0 and ps[s][w] > q[w]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, o, v, r) for r, (v, o) in enumerate(ranked, 1) if part == "pair" or r <= top]
    return sorted(out)


def corpus(seed, n, sources=9):
    rng, names = random.Random(seed), [f"w{c}{d}" for c in "abcdefghijé" for d in "xyzXYZ"]
    return [(rng.choice(["en", "fr", None, "", "rare"] if rng.random() < 0.1 else ["en"]), rng.choice(["web"] * 5 + [None, ""] + [f"s{i}" for i in range(sources)]), " ".join(rng.choices(names, k=rng.randint(0, 40))) + rng.choice([" once" + str(rng.random()), " 12 3", ""])) for _ in range(n)]


@pytest.mark.parametrize("cells", [divergence.CELLS, 64, 9])
def test_divergence(spark, monkeypatch, cells):
    """Also with blocks of few terms, and with fewer cells than groups."""
    monkeypatch.setattr(divergence, "CELLS", cells)
    rows = corpus(3, 300)
    got = divergence.divergence(spark.createDataFrame(rows, "lang string, source string, text string").repartition(3), top=8)
    assert sorted(map(tuple, got.collect())) == plain_divergence(rows, top=8)


def test_divergence_flushes(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 2000)
    rows = corpus(4, 200)
    batches = divergence._counted(spark.createDataFrame(rows, "lang string, source string, text string").fillna("").coalesce(1)).collect()
    want = Counter()
    for g, s, t in rows:
        want.update((g or "", s or "", w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(LOWER)))
    got = Counter()
    for r in batches:
        if r.term is not None:
            got[r.lang, r.source, r.term] += r.n
    assert got == want and sum(r.term is None for r in batches) > len({(g, s) for g, s, _ in rows})


def test_proportions():
    import numpy as np

    for c, m in ((1, 3), (5, 7), (8_999_999_999_999, 9_000_000_000_001), (123_456_789_012, 77_000_000_000_003), (1, 9 * 10**13)):
        assert divergence.proportions(np.array([c]), np.array([m]))[0] == 1 + 10**9 * c // m


ODD = [
    (1, None, None, None),
    (1, None, None, None),
    (2, "", "en", None),
    (3, " \t\n", "en", "web"),
    (4, "Word one. " * 30_000, "en", "web"),
    (5, "x" * 300_000, "en", "web"),
    (6, "one two three, one two three; ONE TWO THREE" + " one two three" * 20, "en", "other"),
    (6, "one two three, one two three; ONE TWO THREE" + " one two three" * 20, "en", "other"),
    (None, "one two three", "xx", "other"),
    (7, "été été " * 30, "fr", ""),
]


def test_edges(spark):
    """Nulls, empty, blank and very long texts, repeated rows, ties, and columns with the operators' own names."""
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(c) for c in ("n", "phrase", "term", "found", "a", "rank", "tile", "block", "item", "value")})
    assert sorted(map(tuple, phrases.collocations(docs).collect())) == plain_phrases([(r[2], r[1]) for r in ODD])
    assert sorted(map(tuple, divergence.divergence(docs).collect())) == plain_divergence([(r[2], r[3], r[1]) for r in ODD])
    for f in (phrases.collocations, divergence.divergence):
        assert f(docs.limit(0)).collect() == []
    nothing = divergence.divergence(docs.where("doc_id < 4")).collect()
    assert sorted((r.lang, r.source, r.item, r.value) for r in nothing) == [("en", "", "web", 0), ("en", "web", "", 0)]
