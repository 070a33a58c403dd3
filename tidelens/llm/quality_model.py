"""Quality scores from zstandard dictionaries.

One dictionary is trained on good texts, one on bad ones. A text is compressed with each,
in short fixed pieces so that the dictionary and not the text's own past gives the context.
The difference of the sizes over the size of the text itself, the bytes in ten that the good
dictionary saves more, is the one feature of a logistic regression on texts that made
no dictionary: the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, id_column, map_rows
from .labelled import fit_logistic, labelled_sample, logistic


@dataclass(frozen=True)
class QualityParams:
    #: Bounds of the training sample: texts per label, and characters per text.
    rows: int = 1500
    longest: int = 20_000
    dictionary: int = 64 << 10
    piece: int = 256
    level: int = 3


class QualityModel:
    def __init__(self, sample: list[tuple[str, int]], prior: float = 0.0, params: QualityParams = QualityParams()) -> None:
        self.params = params
        self.dictionaries = []
        for y in (1, 0):
            pieces = [p for t, z in sample[::2] if z == y for p in self._pieces(t)]
            self.dictionaries.append(self._dictionary(pieces))
        self._open()
        rest = sample[1::2]
        x = np.array([[self.difference(t), 1.0] for t, _ in rest])
        self.weights = fit_logistic(x, np.array([y for _, y in rest]), ridge=1e-4, prior=prior)

    def _dictionary(self, pieces: list[bytes]) -> bytes:
        try:
            return zstandard.train_dictionary(self.params.dictionary, pieces, level=self.params.level).as_bytes()
        except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
            return b"\n".join(pieces)[: self.params.dictionary] or b"\n" * 8

    def _open(self) -> None:
        self.compressors = []
        for d in self.dictionaries:
            kind = zstandard.DICT_TYPE_FULLDICT if d[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
            z = zstandard.ZstdCompressionDict(d, dict_type=kind)
            z.precompute_compress(level=self.params.level)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=z, write_checksum=False, write_content_size=False, write_dict_id=False))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "compressors"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._open()

    def _pieces(self, text: str) -> list[bytes]:
        raw = text.encode("utf-8", "surrogatepass")
        return [raw[i : i + self.params.piece] for i in range(0, len(raw), self.params.piece)]

    def difference(self, text: str) -> float:
        """The compressed size under the bad dictionary less that under the good one, over a tenth of the raw size; 0 for no text."""
        pieces = self._pieces(text)
        if not pieces:
            return 0.0
        good, bad = (sum(len(c.compress(p)) for p in pieces) for c in self.compressors)
        return 10 * (bad - good) / sum(map(len, pieces))

    def score(self, texts: list[str]) -> np.ndarray:
        return logistic(np.array([[self.difference(t), 1.0] for t in texts]).reshape(-1, 2) @ self.weights)


def fit(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams(), id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> QualityModel | None:
    """Fit on a bounded sample of labelled rows whose fold of three is not 1; None unless both labels occur."""
    sample, prior = labelled_sample(docs, labels, label, 3, 1, params.rows, params.longest, id_col, text_col)
    return QualityModel(sample, prior, params) if len({y for _, y in sample}) == 2 else None


def score_quality(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row.

    score: 0 to 1, higher for texts like those of label 1; predicted: 1 from 0.5 on. Whole
    texts are scored; null and empty texts get the score of no difference, and without a
    model every text scores 0.5. Repeated rows and null ids give a row each; an empty table gives an empty result;
    other columns of docs are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def f(cols):
            texts = [t or "" for t in cols[1]]
            scores = m.score(texts) if m else np.full(len(texts), 0.5)
            return [cols[0], scores.tolist()]

        return f

    key, kind = id_column(docs, id_col)
    out = map_rows(docs.select(key, docs[text_col]), f"doc_id {kind}, score double", make)
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
