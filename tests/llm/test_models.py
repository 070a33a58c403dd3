from itertools import product

import numpy as np
import pytest

from tidelens.llm import common, language, quality_model, toxicity, warc


def held_out(spark, sf, scored, label):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", label)
    return scored.where("held_out").join(labels, "doc_id").toPandas()


def test_quality_on_held_out_rows(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = quality_model.score_quality(docs, quality_model.fit(docs, labels))
    p = held_out(spark, sf, out, "quality")
    assert (p.predicted == p.quality).mean() > 0.95
    assert p.score.between(0, 1).all() and ((p.score >= 0.5) == (p.predicted == 1)).all()


def test_quality_by_hand(spark, sf):
    """The scores of a whole table from the dictionaries, compressing by hand; AUC on held-out rows."""
    import zstandard

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_model.fit(docs, labels)
    good, bad = (zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False) for d in model.dictionaries)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.score for r in quality_model.score_quality(docs, model).collect()}
    assert set(got) == set(texts) and model.weights.shape == (2,) and model.weights[0] > 0
    for i, text in texts.items():
        raw = (text or "").encode()
        parts = [raw[k : k + 256] for k in range(0, len(raw), 256)]
        d = 10 * sum(len(bad.compress(p)) - len(good.compress(p)) for p in parts) / len(raw) if raw else 0.0
        assert np.isclose(got[i], 1 / (1 + np.exp(-(model.weights[0] * d + model.weights[1]))))
    p = held_out(spark, sf, quality_model.score_quality(docs, model), "quality")
    rank = p.score.rank()
    n1, n0 = (p.quality == 1).sum(), (p.quality == 0).sum()
    assert (rank[p.quality == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.98


def test_toxicity_on_held_out_rows(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.score_toxicity(docs, toxicity.fit(docs, labels))
    p = held_out(spark, sf, out, "toxic")
    assert (p.predicted == p.toxic).mean() > 0.9
    texts = {r.doc_id: r.text for r in docs.collect()}
    words = [texts[r.doc_id][slice(*map(int, s.split(":")))] for r in out.where("spans != ''").collect() for s in r.spans.split(",")]
    assert words and all(w and not any(c.isspace() for c in w) for w in words)


def test_language_on_held_out_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    p = language.identify(docs, language.fit(docs)).join(docs.select("doc_id", "lang", common.fold(docs.doc_id, 5).alias("f")), "doc_id").where("f = 0").toPandas()
    assert (p.lang == p.lang_pred).mean() > 0.95 and p.score.between(0, 1).all()


def test_held_out_labels_are_not_used(spark, sf):
    """Changing held-out labels changes nothing."""
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(common.fold(F.col("doc_id"), 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_model.fit(docs, x) for x in (labels, turned))
    assert np.array_equal(a.weights, b.weights) and a.dictionaries == b.dictionaries


def test_marginals_by_enumeration():
    """Forward-backward against the sum over all taggings."""
    rng = np.random.default_rng(2)
    for n in range(1, 8):
        s, t = rng.normal(size=n) * 2, rng.normal(size=(2, 2))
        total, marked = 0.0, np.zeros(n)
        for tags in product((0, 1), repeat=n):
            w = np.exp(sum(s[i] for i in range(n) if tags[i]) + sum(t[a, b] for a, b in zip((0, *tags), tags)))
            total += w
            marked += w * np.array(tags)
        got = toxicity.marginals(s, np.array([0]), np.array([n]), t)
        assert np.allclose(got, marked / total)


def test_chains_never_cross_documents():
    ends = np.array([0, 1, 0, 0, 0, 1, 0], bool)
    first, size = toxicity.chains(ends, np.array([3, 0, 4]))
    assert list(zip(first.tolist(), size.tolist())) == [(0, 2), (2, 1), (3, 3), (6, 1)]
    first, size = toxicity.chains(np.zeros(150, bool), np.array([150]))
    assert size.tolist() == [150]


def test_long_chains_are_walked_whole():
    """Chains of many parts against the plain recurrence, word by word."""
    rng = np.random.default_rng(4)
    size = np.array([1, 63, 64, 65, 128, 129, 700, 3, 5000])
    first, n = np.cumsum(size) - size, int(size.sum())
    s, t = rng.normal(size=n) * 3, rng.normal(size=(2, 2))
    e, a = np.exp(s), np.exp(t)
    f, g = np.empty(n), np.ones(n)
    for lo, k in zip(first, size):
        x = 0.0
        for i in range(lo, lo + k):
            x = f[i] = e[i] * (a[0, 1] + a[1, 1] * x) / (a[0, 0] + a[1, 0] * x)
        for i in range(lo + k - 2, lo - 1, -1):
            y = e[i + 1] * g[i + 1]
            g[i] = (a[1, 0] + a[1, 1] * y) / (a[0, 0] + a[0, 1] * y)
    got = toxicity.forward_backward(s, first, size, t)
    assert np.allclose(got[0], f, rtol=1e-9) and np.allclose(got[1], g, rtol=1e-9)


def held_grams(g, text):
    """The grams of one to three classes that a text holds, two separators before and after it; those of separators only don't count."""
    c = [g._class(ord(x)) for x in "\0\0" + text.lower() + "\0\0"]
    return {tuple(c[i : i + n]) for n in (1, 2, 3) for i in range(len(c) - n + 1)} - {(0,), (0, 0), (0, 0, 0)}


def test_kernel_counts_shared_grams():
    texts = ["abc abd", "xyz", "abc", "été là", "漢字 漢"]
    g = language.Grams(texts)
    x = g.presence(texts)
    for i, j in product(range(len(texts)), repeat=2):
        assert (x[i] * x[j]).sum() == len(held_grams(g, texts[i]) & held_grams(g, texts[j]))
    assert np.array_equal(g.presence(texts), np.vstack([g.presence([t]) for t in texts]))


def test_regression_on_the_full_kernel():
    """With every segment a landmark, the fitted scores are those of ridge regression in the kernel's own feature space."""
    rng = np.random.default_rng(6)
    words = {"a": ["alba", "mare", "luna", "terra", "sole"], "b": ["dwars", "klok", "huis", "brug", "straat"], "c": ["zyx", "qwu", "vyk", "xox", "juq"]}
    segments, labels = zip(*((" ".join(rng.choice(words[y], 6)), y) for _ in range(12) for y in words))
    params = language.LanguageParams(landmarks=len(segments))
    m = language.LanguageModel(list(segments), list(labels), params)
    sets = [held_grams(m.grams, s) for s in segments]
    k = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    values, vectors = np.linalg.eigh(k)
    good = values > 1e-6 * values.max()
    phi = np.c_[vectors[:, good] * np.sqrt(values[good]), np.ones(len(k))]  # phi @ phi.T is the kernel, plus one
    y = np.array([[x == z for z in m.languages] for x in labels], float)
    share = len(m.languages) / len(k)  # languages count alike: here all have as many segments
    w = np.linalg.solve(phi.T @ phi * share + params.ridge * np.trace(phi.T @ phi * share) / phi.shape[1] * np.eye(phi.shape[1]), phi.T @ y * share)
    new = ["luna mare sole", "klok brug dwars", "xox vyk", "terra huis"]
    cross = np.array([[len(held_grams(m.grams, t) & b) / np.sqrt(m.grams.presence([t]).sum() * len(b)) for b in sets] for t in new])
    want = np.c_[cross @ (vectors[:, good] / np.sqrt(values[good])), np.ones(len(new))] @ w
    got = m._kernel(m.grams.presence(new)) @ m.weights + m.bias
    assert np.allclose(got, want, atol=2e-3)
    assert m.predict(new[:3])[0] == ["a", "b", "c"]


def test_ties_go_to_the_first_language():
    m = language.LanguageModel(["same words here"] * 4, ["b", "a", "b", "a"])
    names, scores = m.predict(["same words here", "other"])
    assert names == ["a", "a"] and all(0 <= s <= 1 for s in scores)


def test_long_texts_are_read_in_parts(monkeypatch):
    g = language.Grams(["abc def ghi jkl", "mno pqr"])
    text = "abc def " * 50 + "mno"
    whole = g.presence([text])
    monkeypatch.setattr(language.Grams, "CHUNK", 7)
    part = g.presence([text])
    assert (whole <= part).all() and (part - whole).sum() <= 8  # only grams at the edges of parts may be added


def test_url_keys():
    assert warc.url_key("http://www.Example.com:80/a?b=1#c") == "com,example,www)/a?b=1"
    assert warc.url_key("https://a.b:8443") == "b,a:8443)/"
    assert warc.url_key(None) == "-"
    assert "\t" not in warc.url_key("http://x/\t\n ") and " " not in warc.url_key("http://x/ y")


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_lookup(spark, tmp_path, block):
    rows = [(i, f"http://h{i % 3}.org/p{i % 5}", f"text {i % 4}") for i in range(40)]
    folder = f"file://{tmp_path}/w"
    params = warc.WarcParams(block=block, roll=2000)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_index(warc.write_archives(df, folder, params), folder, params)
    index = warc.CaptureIndex(folder)
    for i, url, html in rows:
        assert [p for p, *_ in index.find(warc.url_key(url))] == sorted(j for j, u, _ in rows if u == url)
        (found,) = index.find(warc.url_key(url), i)
        page, size, digest, kind, to, payload = warc.parse(index.read(*found[1:]))
        last = max(j for j, _, h in rows if h == html)
        assert (page, size, digest) == (i, len(html), warc.digest(html.encode()))
        assert (kind, to, payload) == (("response", None, html.encode()) if i == last else ("revisit", last, b""))
    assert list(index.find("org,none)/")) == []


def test_archive_of_whole_table(spark, sf):
    import duckdb

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = sorted(c.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({warc.ORACLE})").fetchall())
    assert sorted(map(tuple, warc.archive_pages(spark, pages).collect())) == want
