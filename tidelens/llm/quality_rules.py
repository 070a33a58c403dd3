"""Quality rules: word counts, repetition, and bands for zstandard compression ratios.

A ratio is compressed bytes over raw bytes, for the whole document and for each fixed
chunk of it. Short texts carry frame overhead and little context, so the band depends
on the length: its limits are given at some lengths and lie on a line over the logarithm
of the length between them. Below the band a text repeats its own phrases or symbols, above
it is noise.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from .common import id_column, keep_rows, map_rows

SPACE, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Limits. bands: (bytes, lowest ratio, highest ratio), ascending; the first and the last hold beyond them.

    The lowest ratios are those that about 1 in 200 good-labelled prose texts of their length stays below. The
    highest lie between that prose and random base64, which is possible from 150 bytes on: below, the two compress alike,
    and no ratio exceeds the limit.
    """

    min_words: int = 10
    window: int = 5
    max_repeat_percent: int = 20
    level: int = 3
    chunk: int = 1024
    bands: tuple[tuple[float, float, float], ...] = (
        (32, 0.95, 1.60),
        (64, 0.85, 1.30),
        (128, 0.75, 1.05),
        (256, 0.62, 0.86),
        (512, 0.56, 0.77),
        (1024, 0.503, 0.70),
        (2048, 0.47, 0.65),
        (4096, 0.446, 0.57),
        (8192, 0.424, 0.545),
        (16384, 0.41, 0.52),
        (65536, 0.385, 0.49),
        (1 << 20, 0.36, 0.47),
    )
    max_bad_chunks: float = 0.5

    def limits(self, size: int) -> tuple[float, float]:
        """The lowest and the highest ratio for so many bytes."""
        at, low, high = zip(*self.bands, strict=True)
        x = np.log2(np.array(at, float))
        return float(np.interp(np.log2(size), x, low)), float(np.interp(np.log2(size), x, high))

    def inside(self, size: int, ratio: float) -> bool:
        low, high = self.limits(size)
        return low <= ratio <= high


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks double"


def repeated_words(words: list[bytes], window: int) -> int:
    """How many words lie in a window of words that occurs twice or more."""
    wins = list(zip(*(words[i:] for i in range(window)), strict=False))
    if len(set(wins)) == len(wins):
        return 0
    seen = Counter(wins)
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.fromiter((i for i, w in enumerate(wins) if seen[w] > 1), np.int64)
    edge[at] += 1
    edge[at + window] -= 1
    return int((np.cumsum(edge) > 0).sum())


def measurer(rules: Rules = Rules()):
    """A function from a text (or None) to the values of SCHEMA."""
    c = zstandard.ZstdCompressor(level=rules.level, write_checksum=False, write_content_size=False)
    whole_chunk = rules.limits(rules.chunk)

    def fits(raw: bytes) -> bool:
        low, high = whole_chunk if len(raw) == rules.chunk else rules.limits(len(raw))
        return low <= len(c.compress(raw)) / len(raw) <= high

    def measure(text: str | None) -> tuple:
        text = text or ""
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        n = len(words)
        lines = [x for x in raw.split(b"\n") if x.strip()]
        repeat = repeated_words(words, rules.window)
        failed = n < rules.min_words or 100 * repeat > rules.max_repeat_percent * n
        ratio = bad = 0.0
        kept = not failed
        if raw:
            ratio = len(c.compress(raw)) / len(raw)
            chunks = [raw[i : i + rules.chunk] for i in range(0, len(raw), rules.chunk)]
            if len(chunks) > 1 and len(chunks[-1]) < rules.chunk // 2:
                chunks[-2:] = [chunks[-2] + chunks[-1]]
            bad = sum(not fits(x) for x in chunks) / len(chunks)
            kept = kept and rules.inside(len(raw), ratio) and bad <= rules.max_bad_chunks
        chars = len(text) - sum(text.count(x) for x in SPACE)
        return n, chars, sum(text.count(x) for x in SYMBOLS), len(lines) - len(set(lines)), repeat, failed, kept, ratio, bad

    return measure


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """(doc_id, SCHEMA), one row per input row.

    Words are runs of other than ASCII white space in the whole text. n_dup_lines: lines
    with a word that equal an earlier line. n_repeat_words: words inside windows of five
    words found twice or more, first ones included. kept: the base rules hold, the ratio of
    the whole text is in its band, and at most max_bad_chunks of its chunks are out of theirs
    (a last chunk under half the size belongs to the one before). Null and empty texts have
    no word and fail; ratio and bad_chunks are then 0. Repeated rows and null ids give a row each; an
    empty table gives an empty result; other columns of docs are not read.
    """

    def make():
        measure = measurer(rules)
        return lambda cols: [cols[0], *(list(x) for x in zip(*map(measure, cols[1]), strict=True))] if cols[0] else [[] for _ in range(10)]

    key, kind = id_column(docs, id_col)
    return map_rows(docs.select(key, docs[text_col]), f"doc_id {kind}, {SCHEMA}", make)


def quality_filter(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that the rules keep, all columns as they are.

    Null, empty and blank texts have no word and go; texts count whole; repeated rows stay or go
    together; ids are not looked at; an empty table gives an empty result.
    """

    def make():
        measure = measurer(rules)
        return lambda texts: [measure(t)[6] for t in texts]

    return keep_rows(docs, text_col, make)
