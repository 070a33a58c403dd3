"""Bounded samples of labelled texts, and a small logistic regression."""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int, longest: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[tuple[str, int]], float]:
    """(sample, prior): at most `rows` texts of each label 0/1, whole, of at most `longest` characters.

    The ids are drawn by hash from labels outside the held-out fold; rows without an id, a
    text or a label take no part, and an id that repeats counts once, with its smallest
    text and largest label. The drawn ids, 2 * rows at most, are what is broadcast.
    Texts that share a passage picked by min-hash with an earlier one of the sample are
    left out: groups of near copies would pass for evidence.
    prior: the log odds of label 1 among all such labels.
    """
    pool = labels.select(labels[id_col].alias("i"), labels[label].cast("int").alias("y")).where(F.col("i").isNotNull() & F.col("y").isin(0, 1) & (fold(F.col("i"), folds) != held_out))
    pool = pool.groupBy("i").agg(F.max("y").alias("y"))
    counts = dict(pool.groupBy("y").count().collect())
    if len(counts) < 2:
        return [], 0.0
    share = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 2 * rows / n)))))
    drawn = pool.withColumn("h", F.xxhash64(F.col("i").cast("string"))).where(F.pmod("h", F.lit(1_000_003)) / 1_000_003 < F.element_at(share, F.col("y")))
    drawn = drawn.withColumn("n", F.row_number().over(Window.partitionBy("y").orderBy("h", "i"))).where(F.col("n") <= rows).select("i", "y")
    texts = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t")).where(F.length("t").between(1, longest))
    got = texts.join(F.broadcast(drawn), "i").groupBy("i").agg(F.min("t").alias("t"), F.max("y").alias("y")).collect()
    sample, seen = [], set()
    for r in sorted(got, key=lambda r: r.i):
        words = r.t.encode("utf-8", "surrogatepass").split()
        shingles = [b" ".join(x) for x in zip(words, words[1:], words[2:], strict=False)] or [b" ".join(words)]
        marks = {(k, min(zlib.crc32(x, k) for x in shingles)) for k in range(3)}
        if not marks & seen:
            sample.append((r.t, r.y))
        seen |= marks
    return sample, math.log(counts[1] / counts[0])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30, prior: float = 0.0) -> np.ndarray:
    """Weights of a logistic regression with an L2 penalty (not on the last column), by Newton steps.

    Classes count alike in the fit; prior, the log odds of class 1, is added to the last weight.
    """
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    penalty = np.eye(x.shape[1]) * ridge
    penalty[-1, -1] = 1e-9
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + len(y) * penalty @ w * 1e-2
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + len(y) * penalty * 1e-2 + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    w[-1] += prior
    return w


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
