"""Order-preserving packing by dynamic programming.

The documents of a task form one token stream in the order in which they come. Windows
of at most `length` tokens cut it; a cut is free at a document's end, cheap at a
sentence's end and dearer inside a sentence. With b the places where a soft cut may be
and D the least cost of a plan that ends at one,

    D[j] = penalty[j] + min over i of D[i] + (padding of b[i]..b[j]),

where b[i]..b[j] is one window, or one full window, a hard cut, and one more. Padding is
linear in b[j] - b[i], so each minimum is that of D[i] + b[i] over a sliding range, kept in
a monotone queue: the work is linear in the number of places. The end of a stream is
cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import PRE_SPLIT, automaton, byte_letters, read_vocabulary
from .common import id_column, pieces, tidy


@dataclass(frozen=True)
class Packing:
    length: int = 2048
    sentence_cut: int = 1
    hard_cut: int = 4
    #: A stream is closed at the first document end past so many tokens; bounds a task's memory.
    stream: int = 1 << 20
    end_id: int = 1


class Tokens:
    """Token ids of whole texts, equal to those of the tokenizers library for a byte-level file.

    The library's pattern gives up on white space of a million characters or so: such a text goes to the automaton.
    """

    def __init__(self, path: str) -> None:
        data = read_vocabulary(path)
        self.path = path
        letters = byte_letters()
        special = {x["content"]: x["id"] for x in data.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in k): v for k, v in data["model"]["vocab"].items() if k not in special}
        self.encoding = tiktoken.Encoding(path, pat_str=PRE_SPLIT, mergeable_ranks=ranks, special_tokens=special)
        self.sentence = np.zeros(1 + max([*ranks.values(), *special.values()]), bool)
        for k, v in ranks.items():
            self.sentence[v] = k.rstrip(b" \t\r\"')").endswith((b".", b"!", b"?", b"\n", "。".encode(), "…".encode()))

    def __call__(self, text: str) -> np.ndarray:
        try:
            return self.encoding.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        except ValueError:  # the pattern's stack is full
            return np.array(automaton(self.path).encode(text), np.uint32)


def plan(places: list[int], penalty: list[int], length: int, hard: int) -> tuple[list[float], list[int]]:
    """D and, per place, the place before it (negative, -1 - i: with a hard cut after a full window).

    places: ascending from 0, neighbours at most `length` apart.
    """
    m = len(places)
    cost, value, back = [0] * m, [0] * m, [0] * m
    near, far = [0], []  # monotone queues of places: within one window, and within the second
    n0 = f0 = p = 0
    for j in range(1, m):
        x = places[j]
        low = x - length
        while places[near[n0]] < low:
            n0 += 1
        i = near[n0]
        best = value[i] - low
        while places[p] <= low:
            v = value[p]
            while len(far) > f0 and value[far[-1]] >= v:
                far.pop()
            far.append(p)
            p += 1
        lower = low - length
        while f0 < len(far) and places[far[f0]] < lower:
            f0 += 1
        if f0 < len(far):
            k = far[f0]
            other = value[k] - lower + hard
            if other < best:
                best, i = other, -1 - k
        best += penalty[j]
        cost[j], back[j] = best, i
        v = value[j] = best + x
        while len(near) > n0 and value[near[-1]] >= v:
            near.pop()
        near.append(j)
    return cost, back


def cuts(ends: np.ndarray, sentences: np.ndarray, total: int, p: Packing) -> list[int]:
    """Where windows end in a stream of `total` tokens: document ends and sentence ends are the soft places."""
    soft = np.union1d(np.union1d(ends, sentences), [0])
    soft = soft[soft < total]
    gaps = np.diff(np.r_[soft, total])
    wide = np.flatnonzero(gaps > p.length)
    fill = np.concatenate([np.arange(soft[i] + p.length // 2, soft[i] + gaps[i], p.length // 2) for i in wide]) if len(wide) else np.array([], np.int64)
    places = np.union1d(soft, fill)
    penalty = np.where(np.isin(places, ends), 0, np.where(np.isin(places, fill), p.hard_cut, p.sentence_cut))
    at = places.tolist()
    cost, back = plan(at, penalty.tolist(), p.length, p.hard_cut)
    last = [i for i in range(len(at) - 1, -1, -1) if total - at[i] <= p.length]
    i = min(last, key=lambda i: cost[i] + p.hard_cut * ((total - at[i]).bit_count() - 1))
    out, rest, to = [], total - at[i], at[i]
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            to += 1 << bit
            out.append(to)
    while i:
        out.append(at[i])
        k = back[i]
        if k < 0:
            k = -1 - k
            out.append(at[k] + p.length)
        i = k
    return sorted(set(out))


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", packing: Packing = Packing(), ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]), one row per piece.

    Each document's ids and one end id lie in exactly one piece each; pieces of a sequence
    fill it from offset 0 without a gap. Sequences are packed inside each input
    partition, so nothing is shuffled; sequence_id holds the partition's number. Null and
    empty texts are the end id alone; texts of any length count whole; repeated rows and null
    ids are packed like others; an empty table gives an empty result; other columns of docs
    are not read. ids=True adds the piece's ids as array<int>.
    """
    key, kind = id_column(docs, id_col)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = ", ".join([f"doc_id {kind}", *(f"{x} long" for x in names[1:])]) + (", ids array<int>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(vocabulary)
        sequence = TaskContext.get().partitionId() << 40
        keys, streams, total, id_type = [], [], 0, None
        end = np.array([packing.end_id], np.uint32)

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            sizes = np.array([len(x) for x in streams])
            all_ids = np.concatenate(streams)
            ends = np.cumsum(sizes)
            windows = np.array(cuts(ends, np.flatnonzero(tokens.sentence[all_ids]) + 1, int(ends[-1]), packing))
            bounds = np.union1d(ends, windows)
            starts = np.r_[0, bounds[:-1]]
            doc, seq = np.searchsorted(ends, starts, "right"), np.searchsorted(windows, starts, "right")
            data, pieces = all_ids.astype("<u4").tobytes(), list(zip(starts.tolist(), bounds.tolist(), strict=True))
            columns = [
                pa.array([keys[d] for d in doc.tolist()], id_type),
                pa.array(starts - (ends - sizes)[doc]),
                pa.array(bounds - starts),
                pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in pieces], pa.int64()),
                pa.array(sizes[doc]),
                pa.array(sequence + seq),
                pa.array(starts - np.r_[0, windows[:-1]][seq]),
            ]
            if ids:
                columns.append(pa.ListArray.from_arrays(np.r_[0, bounds].astype(np.int32), pa.array(all_ids.astype(np.int32))))
            sequence += len(windows)
            return pa.RecordBatch.from_arrays(columns, names=[*names, "ids"][: len(columns)])

        for b in pieces(batches):
            id_type = b.column(0).type
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys.append(key)
                streams.append(np.concatenate([tokens(text or ""), end]))
                total += len(streams[-1])
                if total >= packing.stream:
                    yield flush()
                    keys, streams, total = [], [], 0
        if keys:
            yield flush()

    return docs.select(key, docs[text_col]).mapInArrow(tidy(run), schema)
