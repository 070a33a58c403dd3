"""Scores of a whole table, computed again word by word and gram by gram."""

import math

import numpy as np
import pytest

from tidelens.llm import language, toxicity


def test_toxicity_word_by_word(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    a = np.exp(np.asarray(m.t, float))
    emission: dict[str, float] = {}

    def tagged(words):
        """The marginals of one sentence: products of what comes before and after, brought to sum one at each word."""
        e = [np.array([1.0, emission.setdefault(w, math.exp(m.bias + sum(m.weights.get(x, 0.0) for x in toxicity.features(w))))]) for w in words]
        start = a[0] * e[0]  # before a sentence stands a word that is not toxic
        before, after = [start / start.sum()], [np.ones(2)]
        for x in e[1:]:
            v = (before[-1] @ a) * x
            before.append(v / v.sum())
        for x in reversed(e[1:]):
            v = a @ (x * after[-1])
            after.append(v / v.sum())
        both = [f * g for f, g in zip(before, reversed(after), strict=True)]
        return [v[1] / v.sum() for v in both]

    seen = 0
    for r in toxicity.score_toxicity(docs, m).collect():
        text, p, sentence = texts[r.doc_id], [], []
        for w in text.split():
            sentence.append(w)
            if w[-1] in ".!?":
                p += tagged(sentence)
                sentence = []
        if sentence:
            p += tagged(sentence)
        x = np.array([math.log(1e-3 + sum(p)), max(p, default=0.0), 1.0])
        want = 1 / (1 + math.exp(-float(x @ m.calibration)))
        assert r.score == pytest.approx(want, rel=1e-6, abs=1e-9), r.doc_id
        places, at = [], 0
        for w in text.split():
            at = text.index(w, at)
            places.append((at, at + len(w)))
            at += len(w)
        sure = [f"{s}:{t}" for (s, t), v in zip(places, p, strict=True) if v >= 0.5]
        assert r.spans.split(",") == sure if sure else r.spans == "", r.doc_id
        seen += len(sure)
    assert seen > 20


def test_language_gram_by_gram(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 3 = 0")  # a third is enough here: each text is on its own
    m = language.fit(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    classes = language.CLASSES

    def vector(text):
        c = [m.grams._class(ord(x)) for x in "\0\0" + text.lower() + "\0\0"]
        x = np.zeros(m.grams.size)
        for n, table in enumerate(m.grams.tables, 1):
            for code in {sum(v * classes ** (n - 1 - k) for k, v in enumerate(c[i : i + n])) for i in range(len(c) - n + 1)}:
                if table[code] >= 0:
                    x[table[code]] = 1
        return x

    for r in language.identify(docs, m).collect():
        text = texts[r.doc_id]
        size = -(-len(text) // max(1, round(len(text) / m.piece)))
        total = np.zeros(len(m.languages))
        for k in range(0, len(text), size):
            x = vector(text[k : k + size])
            kernel = (x @ m.landmarks.astype(float)) / math.sqrt(max(1, x.sum()))
            total += (kernel @ m.weights.astype(float) + m.bias) * len(text[k : k + size])
        mean = np.sort(total / len(text))
        assert r.score == pytest.approx(float(np.clip(mean[-1], 0, 1)), abs=2e-3), r.doc_id
        if mean[-1] - mean[-2] > 4e-3:
            assert r.lang_pred == m.languages[int(total.argmax())], r.doc_id
