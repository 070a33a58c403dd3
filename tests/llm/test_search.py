import random

import numpy as np
import pytest
import xxhash

from tidelens.llm import bitsliced, components, simhash


def plain(text):
    """The fingerprint, straight from its definition."""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c", "a b c d a b c", "É é x y z w", "x " * 500])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


def brute(values, limit=3):
    root = list(range(len(values)))
    changed = True
    near = [[j for j in range(len(values)) if (values[i] ^ values[j]).bit_count() <= limit] for i in range(len(values))]
    while changed:
        changed = False
        for i, js in enumerate(near):
            m = min(root[j] for j in js)
            if m < root[i]:
                root[i], changed = m, True
    return root


def test_gray_index_finds_every_pair():
    rng = random.Random(5)
    centers = [rng.getrandbits(64) for _ in range(6)]
    values = list({c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (1 << 64) - 1 for c in centers for _ in range(60)} | {rng.getrandbits(64) for _ in range(300)})
    index = simhash.GrayIndex(np.zeros(len(values), np.int64), np.array(values, np.uint64))
    got = {(min(a, b), max(a, b)) for i, j in index.pairs(3) for a, b in zip(index.value[i].tolist(), index.value[j].tolist(), strict=True)}
    want = {(min(a, b), max(a, b)) for x, a in enumerate(values) for b in values[x + 1 :] if (a ^ b).bit_count() <= 3}
    assert got == want


@pytest.mark.parametrize("cap", [4, 1024])
def test_links_and_components(spark, cap):
    """With a low cap the buckets are dealt again; the components stay the same."""
    rng = random.Random(7)
    center = rng.getrandbits(64)
    values = sorted({center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(80)} | {rng.getrandbits(64) for _ in range(60)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), cap=cap)
    roots = {r.node: r.root for r in components.connected_components(links).collect()}
    groups = {}
    for v, r in zip(signed, brute(values), strict=True):
        groups.setdefault(r, set()).add(roots.get(v, v))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_components_of_chains(spark, most, monkeypatch):
    monkeypatch.setattr(components, "ONE_TASK", most)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (5, 5), (None, 3)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 1001: 1000}


def test_near_duplicates_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    values = [plain(t) for _, t in rows]
    want = {rows[i][0]: (f"{v:016x}", rows[r][0]) for i, (v, r) in enumerate(zip(values, brute(values), strict=True))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == want


def jaccard(a, b, size=5):
    def shingles(t):
        w = simhash.words_of(t)
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_similarity_limit(spark):
    """Edited copies of random texts: nearly all above 0.85 are found, none below 0.5."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    base = {i: [rng.choice(words) for _ in range(300)] for i in range(60)}
    texts, pairs = {i: " ".join(w) for i, w in base.items()}, []
    for i, w in base.items():
        copy = list(w)
        for p in rng.sample(range(300), rng.choice([1, 2, 3, 4, 30])):
            copy[p] = rng.choice(words)
        texts[1000 + i] = " ".join(copy)
        pairs.append((i, 1000 + i, jaccard(texts[i], texts[1000 + i])))
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    high = [got[b] == a for a, b, j in pairs if j >= 0.85]
    assert len(high) > 30 and sum(high) >= 0.95 * len(high)
    assert all(got[b] == b for a, b, j in pairs if j < 0.5)
    assert all(got[i] == i for i in base)


def by_jaccard(texts, similarity=0.8):
    """Groups by the exact similarity of every pair that shares a shingle: a dict from id to the smallest id reached."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, simhash.words_of(t)) for i, t in texts.items())}
    root, holders = {i: i for i in sets}, {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sorted(sets.items()):
        for j in {j for x in s for j in holders[x] if j < i}:
            if len(s & sets[j]) >= similarity * len(s | sets[j]) and top(i) != top(j):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in sets}


def contiguous_edits():
    """Pairs of random texts in which one passage was added, dropped or replaced, near to the limit on both sides."""
    rng = random.Random(23)
    words, texts = [f"w{i}" for i in range(5000)], {}
    for i in range(80):
        w, n = rng.choices(words, k=400), rng.randrange(20, 130)
        at, passage = rng.choice([0, 150, 400]), rng.choices(words, k=n)
        texts[i] = " ".join(w)
        texts[1000 + i] = " ".join([w[:at] + passage + w[at:], w[n:], w[: 200 - n // 4] + passage[: n // 2] + w[200 + n // 4 :]][i % 3])
    return texts


def crowd():
    """Copies of one text with few to many edits: a large group, texts just outside it, and texts far from it."""
    rng = random.Random(29)
    words, base, texts = [f"y{i}" for i in range(5000)], [f"z{i}" for i in range(140)], {}
    for i in range(150):
        copy = list(base)
        for at in rng.sample(range(140), rng.choice([0, 1, 2, 3, 4, 5, 6, 8, 12])):
            copy[at] = rng.choice(words)
        texts[5000 + i] = " ".join(copy)
    return texts


@pytest.mark.parametrize(("cap", "block"), [(4, 2000), (4, 1_000_000), (32, 1_000_000)])
def test_similar_documents_by_jaccard(spark, sf, cap, block, monkeypatch):
    """Contiguous edits, a crowd of copies that is a chain, a crowd that shares a passage, and the test table."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    texts = contiguous_edits()
    words = [f"v{i}" for i in range(600)]
    texts |= {2000 + i: " ".join(words[i : i + 200]) for i in range(60)}
    texts |= {3000 + i: " ".join([*words[400:520], *(f"u{i}x{k}" for k in range(40))]) for i in range(40)}
    texts |= crowd()
    want = by_jaccard(texts)
    assert 20 < sum(want[1000 + i] == i for i in range(80)) < 75
    assert {want[i] for i in range(2000, 2060)} == {2000}
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), cap=cap).collect()}
    assert got == want
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = by_jaccard({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(docs, cap=cap).collect()} == want
    assert {r.doc_id for r in simhash.first_of_each(docs).collect()} == {i for i, c in want.items() if i == c}


def test_groups_of_few_words(spark):
    rows = [(1, None), (2, ""), (3, "one"), (4, "ONE"), (5, "one two"), (6, "one two three four"), (7, "one  two\nthree four"), (None, "one")]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 6}


@pytest.mark.parametrize("seed", range(8))
def test_top_k_is_exact(seed):
    rng = np.random.default_rng(seed)
    dims, n = int(rng.integers(1, 9)), int(rng.integers(1, 200))
    x = rng.integers(-9, 9, (n, dims)) * int(rng.choice([1, 1000]))
    ids = rng.permutation(n * 2)[:n].astype(np.int64)
    block = bitsliced.Block.from_bytes(bitsliced.Block.build(ids, x).to_bytes())
    q = rng.integers(-9, 9, (5, dims))
    at, got, score = block.top(np.array([ids[0], -1, -2, -3, -4]), q, 20)
    for i, key in enumerate([ids[0], -1, -2, -3, -4]):
        s = x @ q[i]
        assert (s <= block.reach(q)[i]).all()
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != key][:20]
        mine = sorted(zip(-score[at == i], got[at == i], strict=True))
        assert mine == [(-s[j], ids[j]) for j in order]


def test_top_k_over_blocks(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    p = v.toPandas()
    x, ids = np.floor(64 * np.stack(p.embedding).astype(float)).astype(int), p.vec_id.to_numpy()
    got = bitsliced.top_k(v, block_rows=64, chunk=7).toPandas().sort_values(["query_id", "rank"])
    assert set(got.query_id) == {i for i in ids if i % 20 == 0}
    for key, g in got.groupby("query_id"):
        s = x @ x[np.flatnonzero(ids == key)[0]]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != key][:20]
        assert g.vec_id.tolist() == [ids[j] for j in order] and g.score.tolist() == [s[j] for j in order] and g["rank"].tolist() == list(range(1, 21))


def test_top_k_of_large_components(spark):
    """Components far beyond 2**24 against Python's integers; a score that no long holds is an error."""
    rng = random.Random(8)
    rows = [(i, [rng.choice([1e6, 1.0, -3e7, 0.01]) * rng.uniform(-1, 1), rng.uniform(-1, 1), 1e5 * rng.uniform(-1, 1)]) for i in range(300)]
    exact = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows}
    got = bitsliced.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, every=7, block_rows=32)
    want = {}
    for i in range(0, 300, 7):
        best = sorted((-sum(a * b for a, b in zip(exact[i], exact[j])), j) for j in exact if j != i)[:5]
        want[i] = [(j, -s) for s, j in best]
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found == want and max(s for w in want.values() for _, s in w) > 1 << 60
    big = [(i, [float(1 << 50), 1.0]) for i in (0, 1)]
    with pytest.raises(Exception, match="does not fit a long"):
        bitsliced.top_k(spark.createDataFrame(big, "vec_id long, embedding array<double>")).collect()
    with pytest.raises(Exception, match="exceeds 2"):
        bitsliced.top_k(spark.createDataFrame([(0, [1e300]), (1, [0.0])], "vec_id long, embedding array<double>")).collect()


def test_top_k_rows_follow_the_queries(spark):
    """The search returns at most GROUPS times k rows for a query, however many blocks there are."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = bitsliced.top_k(df, block_rows=16, chunk=5).toPandas().sort_values(["query_id", "rank"])
    whole = bitsliced.top_k(df).toPandas().sort_values(["query_id", "rank"])
    assert got.reset_index(drop=True).equals(whole.reset_index(drop=True)) and len(got) == 45 * 20
    z = np.floor(64 * x).astype(np.int64)
    best, asked = bitsliced.Best(np.arange(0, 900, 20), z[::20], 20), []
    for lo in range(0, 900, 16):
        best.meet(bitsliced.Block.build(np.arange(lo, min(lo + 16, 900)), z[lo : lo + 16]))
        asked.append(len(best.row))
    assert max(asked) <= 45 * 20
    assert [(q, r, s) for q, r, s in zip(best.ids[best.query], best.row, best.score)] == list(got[["query_id", "vec_id", "score"]].itertuples(index=False, name=None))
