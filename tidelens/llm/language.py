"""Language identification with string kernels.

The kernel counts the character n-grams (one to three letters, blended) that two texts
share, by presence, over the geometric mean of their numbers. Landmark segments of
each language span a Nyström feature space in which one ridge regression per
language (one against the rest) is fitted. A batch of texts is scored by two matrix
products: presence times landmarks, then kernel values times weights.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, id_column, keep_rows, map_rows

CLASSES = 128  # letter classes: 0 is no letter, the last 31 are shared by rarer letters
FREQUENT = CLASSES - 32


@dataclass(frozen=True)
class LanguageParams:
    #: Bounds of the training sample: rows per language, and landmarks per language.
    rows: int = 600
    landmarks: int = 32
    #: Lengths, in characters, of the training segments, dealt in turn.
    segments: tuple[int, ...] = (32, 64, 128, 256, 1024)
    #: Characters of the pieces that a text is scored in; their scores are averaged by length.
    piece: int = 512
    ridge: float = 0.01
    seed: int = 7


class Grams:
    """Maps texts to the n-grams they hold, out of a fixed vocabulary."""

    CHUNK = 1 << 21

    def __init__(self, segments: list[str]) -> None:
        letters = Counter(c for s in segments for c in s.lower() if c.isalpha())
        self.letter = {ord(c): i for i, (c, _) in enumerate(sorted(letters.items(), key=lambda x: (-x[1], x[0]))[:FREQUENT], 1)}
        self.low = np.array([self._class(c) for c in range(0x3000)], np.int32)
        self.tables = [np.full(CLASSES**n, -1, np.int32) for n in (1, 2, 3)]
        self.size = 0
        for grams, table in zip(self._grams(("\0\0" + "\0\0".join(segments) + "\0\0").lower())[0], self.tables, strict=True):
            found = np.unique(grams)
            found = found[found > 0]
            table[found] = np.arange(self.size, self.size + len(found))
            self.size += len(found)

    def _class(self, c: int) -> int:
        return self.letter.get(c) or (FREQUENT + 1 + c % 31 if chr(c).isalpha() else 0)

    def _grams(self, text: str) -> tuple[list[np.ndarray], np.ndarray]:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        high = codes >= len(self.low)
        c = self.low[np.where(high, 0, codes)]
        if high.any():
            values, at = np.unique(codes[high], return_inverse=True)
            c[high] = np.array([self._class(int(v)) for v in values], np.int32)[at]
        pair = c[:-1] * CLASSES + c[1:]
        return [c, pair, pair[:-1] * CLASSES + c[2:]], codes

    def presence(self, texts: list[str]) -> np.ndarray:
        """A row of 0/1 per text, float32."""
        out = np.zeros((len(texts), self.size), bool)
        flat, parts, rows, held = out.reshape(-1), [], [], 0

        def put() -> None:
            # Two separators between texts and at both ends: a gram never joins two texts, whatever their neighbours.
            joined = "\0\0" + "\0\0".join(parts) + "\0\0"
            lengths = np.array([len(x) + 2 for x in parts])
            lengths[0] += 1
            lengths[-1] += 1
            row = np.repeat(np.array(rows, np.int64) * self.size, lengths)
            for n, (grams, table) in enumerate(zip(self._grams(joined)[0], self.tables, strict=True)):
                ids = table[grams]
                at = row[1 if n == 2 else 0 :][: len(ids)]  # a gram of three belongs to its middle
                good = ids >= 0
                flat[at[good] + ids[good]] = True

        for i, text in enumerate(texts):
            text = text.lower()
            for k in range(0, max(1, len(text)), self.CHUNK):
                parts.append(text[max(0, k - 2) : k + self.CHUNK])
                rows.append(i)
                held += len(parts[-1])
                if held >= self.CHUNK:
                    put()
                    parts, rows, held = [], [], 0
        if parts:
            put()
        return out.astype(np.float32)


class LanguageModel:
    def __init__(self, segments: list[str], labels: list[str], params: LanguageParams = LanguageParams()) -> None:
        self.languages, self.piece = sorted(set(labels)), params.piece
        y = np.array([self.languages.index(x) for x in labels], int)
        self.grams = Grams(segments)
        x = self.grams.presence(segments)
        rng = np.random.default_rng(params.seed)
        chosen = np.concatenate([rng.permutation(np.flatnonzero(y == k))[: params.landmarks] for k in range(len(self.languages))])
        lengths = x.sum(1)
        self.landmarks = (x[chosen] / np.sqrt(np.maximum(lengths[chosen], 1))[:, None]).T.copy()
        k = self._kernel(x)
        values, vectors = np.linalg.eigh(k[chosen].astype(float))
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        phi = np.c_[k @ root, np.ones(len(k))]
        target = (y[:, None] == np.arange(len(self.languages))).astype(float)
        weight = 1 / np.bincount(y)[y]  # languages count alike
        gram = phi.T @ (phi * weight[:, None])
        w = np.linalg.solve(gram + params.ridge * np.trace(gram) / len(gram) * np.eye(len(gram)), phi.T @ (target * weight[:, None]))
        self.weights, self.bias = (root @ w[:-1]).astype(np.float32), w[-1].astype(np.float32)

    def _kernel(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.landmarks) / np.sqrt(np.maximum(x.sum(1), 1))[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Languages and scores. A text is scored piece by piece, so a passage in another language weighs as much as it is long."""
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        total = np.zeros((len(texts), len(self.languages)))
        rows, parts = [], []

        def add() -> None:
            s = self._kernel(self.grams.presence(parts)) @ self.weights + self.bias
            np.add.at(total, rows, s * np.array([len(x) for x in parts])[:, None])
            rows.clear()
            parts.clear()

        known = [i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
        for i in known:
            n = max(1, round(len(texts[i]) / self.piece))
            size = -(-len(texts[i]) // n)
            for k in range(0, len(texts[i]), size):
                rows.append(i)
                parts.append(texts[i][k : k + size])
                if len(parts) == 128:
                    add()
        if parts:
            add()
        for i in known:
            mean = total[i] / len(texts[i])
            b = int(mean.argmax())
            names[i], scores[i] = self.languages[b], round(float(np.clip(mean[b], 0, 1)), 5)  # beyond, single-precision sums depend on the batch
        return names, scores


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", params: LanguageParams = LanguageParams(), folds: int = 5) -> LanguageModel | None:
    """Fit on a bounded sample of segments of rows with a language whose fold is not 0; None if there are none."""
    rows = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t"), docs[lang_col].alias("y")).where(F.col("y").isNotNull() & F.col("t").isNotNull() & (fold(F.col("i"), folds) != 0) & F.col("t").rlike(r"\p{L}"))
    counts = dict(rows.groupBy("y").count().collect())
    share = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 2 * params.rows / n))))) if counts else None
    if share is None:
        return None
    draw = F.pmod(F.xxhash64("i", "t"), F.lit(1_000_000)) / 1e6
    h = F.pmod(F.xxhash64("t", "i"), F.lit(1 << 30))
    window = F.get(F.array(*map(F.lit, params.segments)), F.pmod(h, F.lit(len(params.segments))).cast("int"))
    begin = F.pmod(F.floor(h / len(params.segments)), F.greatest(F.lit(1), F.length("t") - window + 1))
    sample = rows.where(draw < F.element_at(share, F.col("y"))).select("y", h.alias("h"), F.substr("t", (begin + 1).cast("int"), window.cast("int")).alias("s"))
    # distinct first: a row that repeats very often must not gather in one task
    sample = sample.where(F.col("s").rlike(r"\p{L}")).distinct().withColumn("n", F.row_number().over(Window.partitionBy("y").orderBy("h", "s"))).where(F.col("n") <= params.rows)
    got = sample.select("s", "y").orderBy("y", "n").collect()
    return LanguageModel([r.s for r in got], [r.y for r in got], params)


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score), one row per input row.

    lang_pred: a learned language, or und with score 0 for null texts, texts without a
    letter and an empty model. Whole texts are scored; of equal scores the first language in
    order wins; repeated rows and null ids give a row each; an empty table gives an empty
    result; other columns of docs are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def f(cols):
            names, scores = m.predict(cols[1]) if m else (["und"] * len(cols[0]), [0.0] * len(cols[0]))
            return [cols[0], names, scores]

        return f

    key, kind = id_column(docs, id_col)
    return map_rows(docs.select(key, docs[text_col]), f"doc_id {kind}, lang_pred string, score double", make)


def language_filter(docs: DataFrame, model: LanguageModel | None, min_score: float = 0.4, text_col: str = "text") -> DataFrame:
    """The rows of docs with a language of at least min_score, all columns as they are.

    Null texts, texts without a letter and, without a model, all texts go; texts count whole; repeated rows
    stay or go together; ids are not looked at; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def f(texts):
            names, scores = m.predict(texts) if m else (["und"] * len(texts), [0.0] * len(texts))
            return [n != "und" and s >= min_score for n, s in zip(names, scores, strict=True)]

        return f

    return keep_rows(docs, text_col, make)
