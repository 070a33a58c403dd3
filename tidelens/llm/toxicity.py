"""Toxic spans by a linear-chain conditional random field.

Two tags, toxic and other. The labels mark whole documents, so training first labels
tokens: a token of a toxic document is toxic if its word, or a prefix of it, is frequent
in toxic documents and all but absent from the others. The field learns weights for
words, prefixes and suffixes and for the tags' transitions. Forward-backward marginals
over whole texts, sentence by sentence, give the toxic tokens and their offsets; their
expected number and their peak make the document's score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, id_column, map_rows
from .labelled import fit_logistic, labelled_sample, logistic

LETTERS = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"\S+")
PART = 64  # words of a chain that are walked one by one; longer chains are walked part by part, with the same result


@dataclass(frozen=True)
class ToxicityParams:
    #: Bounds of the training sample: texts per label, characters per text, chains without a toxic word.
    rows: int = 1500
    longest: int = 12_000
    plain: int = 20_000
    #: A word or prefix is toxic from these odds on, if chance makes it so with less than exp(-surprise).
    odds: float = 8.0
    surprise: float = 16.0
    steps: int = 60
    ridge: float = 1e-3


def features(word: str) -> list[str]:
    """The features of a token: its letters in lower case, prefixes and a suffix."""
    w = "".join(LETTERS.findall(word.lower()))
    if not w:
        return []
    return ["=" + w, *(f"^{w[:k]}" for k in (3, 4, 5, 6) if len(w) >= k), "$" + w[-3:]]


def chains(ends: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the chains: whole sentences, never across documents. docs: words of each."""
    last = ends.copy()
    last[np.cumsum(docs)[docs > 0] - 1] = True
    stop = np.flatnonzero(last) + 1
    start = np.r_[0, stop[:-1]] if len(stop) else stop
    return start, stop - start


def walk(m: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """x[i] = (m[0, i] * x[i - 1] + m[1, i]) / (m[2, i] * x[i - 1] + m[3, i]) along each chain, from 0 before its first place.

    All chains take a step at a time. Chains longer than PART are cut into parts; the maps of a part, put together,
    give the value that its next part starts from.
    """
    parts = -(-size // PART)
    chain, at = np.repeat(np.arange(len(size)), parts), np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = first[chain] + PART * at
    number = np.minimum(PART, size[chain] - PART * at)
    x = np.zeros(len(chain))
    passed = np.flatnonzero(at < parts[chain] - 1)  # full parts with a next one
    if len(passed):
        a, b, c, d = m[:, begin[passed]]
        for k in range(1, PART):
            e, f, g, h = m[:, begin[passed] + k]
            a, b, c, d = e * a + f * c, e * b + f * d, g * a + h * c, g * b + h * d
            scale = np.maximum(np.maximum(a, b), np.maximum(c, d))
            a, b, c, d = a / scale, b / scale, c / scale, d / scale
        order = np.argsort(at[passed], kind="stable")
        level = np.searchsorted(at[passed][order], np.arange(at[passed].max() + 2))
        for lo, hi in zip(level[:-1].tolist(), level[1:].tolist(), strict=True):
            i = order[lo:hi]
            v = x[passed[i]]
            x[passed[i] + 1] = (a[i] * v + b[i]) / (c[i] * v + d[i])
    out = np.empty(m.shape[1])
    order = np.argsort(-number, kind="stable")
    begin, number, x = begin[order], number[order], x[order]
    alive = np.searchsorted(-number, -np.arange(1, (number[0] if len(number) else 0) + 1), "right")
    for k, n in enumerate(alive.tolist()):
        a, b, c, d = m[:, begin[:n] + k]
        out[begin[:n] + k] = x = (a * x[:n] + b) / (c * x[:n] + d)
    return out


def forward_backward(score: np.ndarray, first: np.ndarray, size: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ratios toxic : other of the forward and backward sums, and exp(score). t: log weights [other, toxic] x [other, toxic]."""
    e, a = np.exp(np.clip(score, -25, 25)), np.exp(t)
    one = np.ones(len(e))
    f = walk(np.array([a[1, 1] * e, a[0, 1] * e, a[1, 0] * one, a[0, 0] * one]), first, size)
    after = np.r_[e[1:], 1.0]
    m = np.array([a[1, 1] * after, a[1, 0] * one, a[0, 1] * after, a[0, 0] * one])
    m[:, first + size - 1] = [[0.0], [1.0], [0.0], [1.0]]  # nothing follows a chain's last word
    g = walk(m[:, ::-1], len(e) - (first + size), size)[::-1]
    return f, g, e


def marginals(score: np.ndarray, first: np.ndarray, size: np.ndarray, t: np.ndarray) -> np.ndarray:
    f, g, _ = forward_backward(score, first, size, t)
    return f * g / (1 + f * g)


def _marked(n: int, other: int, toxic: int, plain: int, p: ToxicityParams) -> bool:
    """Whether a feature of n toxic texts and of `other` plain ones marks toxic words (Chernoff's bound)."""
    share, chance = n / (n + other), toxic / (toxic + plain)
    if n * (plain + 1) < p.odds * (other + 1) * toxic or share <= chance:
        return False
    gain = share * math.log(share / chance) + ((1 - share) * math.log((1 - share) / (1 - chance)) if other else 0.0)
    return (n + other) * gain >= p.surprise


class ToxicityModel:
    CACHE = 500_000

    def __init__(self, sample: list[tuple[str, int]], prior: float = 0.0, params: ToxicityParams = ToxicityParams()) -> None:
        self.weights, self.bias, self.t = self._train(sample, params)
        self._open()
        self.calibration = np.zeros(3)
        x = self._aggregate([t for t, _ in sample])[0]
        self.calibration = fit_logistic(x, np.array([y for _, y in sample]), prior=prior)

    def _open(self) -> None:
        self.cache: dict[str, int] = {}
        self.scores, self.ends = np.empty(self.CACHE), np.empty(self.CACHE, bool)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("cache", "scores", "ends")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._open()

    def _train(self, sample: list[tuple[str, int]], p: ToxicityParams) -> tuple[dict[str, float], float, np.ndarray]:
        known: dict[str, list[str]] = {}
        texts = [([w for w in t.split()], y) for t, y in sample]
        seen = (Counter(), Counter())
        for words, y in texts:
            new: set[str] = set()
            for w in words:
                if w not in known:
                    known[w] = features(w)
                new.update(x for x in known[w] if len(x) > 4 and x[0] != "$" or x[0] == "=")
            seen[y].update(new)
        number = [sum(y == k for _, y in texts) for k in (0, 1)]
        toxic = {x for x, n in seen[1].items() if _marked(n, seen[0][x], number[1], number[0], p)}
        rng = np.random.default_rng(0)
        kept, plain = [], []
        for words, y in texts:
            tags = [bool(y) and any(x in toxic for x in known[w]) for w in words]
            ends = np.array([w[-1] in ".!?" for w in words], bool)
            for a, n in zip(*(x.tolist() for x in chains(ends, np.array([len(words)]))), strict=True):
                (kept if any(tags[a : a + n]) else plain).append((words[a : a + n], tags[a : a + n]))
        if len(plain) > p.plain:
            plain = [plain[i] for i in sorted(rng.permutation(len(plain))[: p.plain])]
        kept += plain
        counts = Counter(x for words, _ in kept for w in words for x in known[w])
        ids = {x: i for i, x in enumerate(sorted(x for x, n in counts.items() if n >= 2))}
        token, at = [], []
        y, size, n = [], [], 0
        for words, tags in kept:
            for w in words:
                for x in known[w]:
                    if x in ids:
                        token.append(n)
                        at.append(ids[x])
                n += 1
            y += tags
            size.append(len(words))
        token, at, y, size = np.array(token, int), np.array(at, int), np.array(y, float), np.array(size, int)
        first = np.cumsum(size) - size
        inner = np.ones(n, bool)
        inner[first] = False
        right = np.flatnonzero(inner)
        w, b, t = np.zeros(len(ids)), -3.0, np.zeros((2, 2))
        both = y.astype(int)
        observed = np.bincount(2 * both[right - 1] + both[right], minlength=4).reshape(2, 2)
        moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, np.array(b), t)]
        for step in range(1, p.steps + 1):
            f, g, e = forward_backward(np.bincount(token, w[at], n) + b, first, size, t)
            q = f * g / (1 + f * g)
            alpha, beta = np.array([np.ones(len(right)), f[right - 1]]), np.array([np.ones(len(right)), e[right] * g[right]])
            pair = alpha[:, None] * np.exp(t)[:, :, None] * beta[None]
            pair = (pair / pair.sum((0, 1))).sum(2) if len(right) else np.zeros((2, 2))
            begin = np.bincount(both[first], minlength=2) - [(1 - q[first]).sum(), q[first].sum()]
            grads = [np.bincount(at, (y - q)[token], len(ids)) - p.ridge * w, np.array((y - q).sum()), observed - pair - 0.1 * t]
            grads[2][0] += begin  # a chain begins as after an other word
            new = []
            for x, gr, m in zip((w, np.array(b), t), grads, moments, strict=True):
                m[0] = 0.9 * m[0] + 0.1 * gr
                m[1] = 0.99 * m[1] + 0.01 * gr * gr
                new.append(x + 0.3 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-6))
            w, b, t = new[0], float(new[1]), new[2]
        return {x: float(w[i]) for x, i in ids.items()}, b, t

    def _learn(self, word: str) -> int:
        """The place of a word's score, and of whether it ends a sentence, in the tables."""
        i = self.cache[word] = len(self.cache)
        self.scores[i] = self.bias + sum(self.weights.get(x, 0.0) for x in features(word))
        self.ends[i] = word[-1] in ".!?"
        return i

    def _aggregate(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text [log expected toxic words, peak, 1]; per word the marginal; words per text."""
        scores, ends, number = [np.zeros(0)], [np.zeros(0, bool)], []
        for t in texts:
            words = t.split()
            number.append(len(words))
            for lo in range(0, len(words), self.CACHE):
                part = words[lo : lo + self.CACHE]
                if len(self.cache) + len(part) > self.CACHE:
                    self.cache.clear()
                places = np.array([self.cache[w] if w in self.cache else self._learn(w) for w in part], int)
                scores.append(self.scores[places])
                ends.append(self.ends[places])
        number, s, e = np.array(number, int), np.concatenate(scores), np.concatenate(ends)
        p = marginals(s, *chains(e, number), self.t) if len(s) else s
        x = np.tile([np.log(1e-3), 0.0, 1.0], (len(texts), 1))
        full = np.flatnonzero(number)
        if len(full):
            at = (np.cumsum(number) - number)[full]
            x[full, 0] = np.log(1e-3 + np.add.reduceat(p, at))
            x[full, 1] = np.maximum.reduceat(p, at)
        return x, p, number

    def score(self, texts: list[str]) -> tuple[list[float], list[str]]:
        """Scores, and start:end code points of the toxic words, comma-joined."""
        scores, spans = [], []
        for lo in range(0, len(texts), 256):
            part = texts[lo : lo + 256]
            x, p, number = self._aggregate(part)
            scores += logistic(x @ self.calibration).tolist()
            ends = np.cumsum(number)
            for i, t in enumerate(part):
                at = np.flatnonzero(p[ends[i] - number[i] : ends[i]] >= 0.5)
                places = [m.span() for m in TOKEN.finditer(t)] if len(at) else []
                spans.append(",".join(f"{places[k][0]}:{places[k][1]}" for k in at.tolist()))
        return scores, spans


def fit(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams(), id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> ToxicityModel | None:
    """Fit on a bounded sample of labelled rows whose fold of five is not 0; None unless both labels occur."""
    sample, prior = labelled_sample(docs, labels, label, 5, 0, params.rows, params.longest, id_col, text_col)
    return ToxicityModel(sample, prior, params) if len({y for _, y in sample}) == 2 else None


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, spans), one row per input row.

    score: 0 to 1, higher for toxic texts; predicted: 1 from 0.5 on; spans: start:end code
    points of the words tagged toxic. Whole texts are tagged; null, empty and blank texts
    get the score of a text without a toxic word, and without a model every text scores
    0. Repeated rows and null ids give a row each; an empty table gives an empty result;
    other columns of docs are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def f(cols):
            texts = [t or "" for t in cols[1]]
            return [cols[0], *(m.score(texts) if m else ([0.0] * len(texts), [""] * len(texts)))]

        return f

    key, kind = id_column(docs, id_col)
    out = map_rows(docs.select(key, docs[text_col]), f"doc_id {kind}, score double, spans string", make)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
