"""Exact top-k inner products on a bit-sliced index.

Vectors are quantised to integers. A block of rows is stored as bitmaps, one per
attribute and binary digit ("slice"), in the order of the ids. A query adds the slices
that its own digits select, weight by weight, with carry-save adders on whole bitmaps; an
attribute that the query holds with a minus sign takes part by its complement, and what
that and the block's offset shift is one number per query and block. The sums are
bitmaps too: walking from the most significant slice downward keeps the set that still
contains the k largest, and the rows that share the boundary's sum are settled by id.
A task holds many queries with the best rows found so far and meets one block after
another; a query whose k-th best score is above all that a block can reach passes it by.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, tidy

CHUNKS = 16  # chunks of queries that a task holds
GROUPS = 8  # groups that the blocks are dealt to: each returns its best rows for each query, whatever the number of blocks
LARGEST = (1 << 62) - 1  # the largest quantised component; the range of a block then fits 63 bits


class Block:
    """The index of one block: ids ascending, slices[(sign * dims + d) * bits + j], slice 0 of all zeros first."""

    def __init__(self, ids: np.ndarray, offset: int, bits: int, dims: int, slices: np.ndarray, ends: np.ndarray) -> None:
        self.ids, self.offset, self.bits, self.dims, self.slices = ids, offset, bits, dims, slices
        self.ends = ends  # the least and the largest value of each attribute

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray) -> Block:
        order = np.lexsort((*x.T[::-1], ids)) if x.shape[1] else np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        offset = int(x.min(initial=0))
        ends = np.array([x.min(0), x.max(0)]) if len(x) else np.zeros((2, x.shape[1]), np.int64)
        x = x - offset
        bits = int(x.max(initial=0)).bit_length()
        words = -(-len(ids) // 64)
        padded = np.zeros((words * 64, x.shape[1]), np.int64)
        padded[: len(ids)] = x
        digits = (padded.T[:, None, :] >> np.arange(bits)[None, :, None]) & 1
        plain = np.packbits(digits.astype(np.uint8), axis=2, bitorder="little").reshape(x.shape[1] * bits, words * 8)
        return cls(ids, offset, bits, x.shape[1], plain.view(np.uint64).reshape(x.shape[1] * bits, words), ends)

    def to_bytes(self) -> bytes:
        return struct.pack("<qqqq", len(self.ids), self.offset, self.bits, self.dims) + self.ids.astype("<i8").tobytes() + self.ends.astype("<i8").tobytes() + self.slices.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Block:
        n, offset, bits, dims = struct.unpack_from("<qqqq", data)
        ids = np.frombuffer(data, "<i8", n, 32)
        ends = np.frombuffer(data, "<i8", 2 * dims, 32 + 8 * n).reshape(2, dims)
        return cls(ids, offset, bits, dims, np.frombuffer(data, "<u8", offset=32 + 8 * n + 16 * dims).reshape(dims * bits, -(-n // 64)), ends)

    def reach(self, q: np.ndarray) -> np.ndarray:
        """A bound, as a double, that no score of the rows exceeds by more than rounding."""
        dims = min(self.dims, q.shape[1])
        q, (low, high) = q[:, :dims].astype(float), self.ends[:, :dims].astype(float)
        return np.where(q > 0, q, 0) @ high + np.where(q < 0, q, 0) @ low

    def sums(self, q: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Slices (queries x words), least significant first, of sum - constant; the constants, as Python numbers where they are wide."""
        dims = min(self.dims, q.shape[1])  # what one side lacks counts as zero
        q = q[:, :dims]
        size, minus = np.abs(q), q < 0
        words = self.slices.shape[1]
        table = np.concatenate([np.zeros((1, words), np.uint64), self.slices, ~self.slices])
        base = 1 + np.arange(dims) * self.bits + np.where(minus, self.dims * self.bits, 0)
        digits = int(size.max(initial=0)).bit_length()
        wide = self.bits + digits + dims.bit_length() > 61
        kind = object if wide else np.int64
        constant = self.offset * q.astype(kind).sum(1) - ((1 << self.bits) - 1) * np.where(minus, size, 0).astype(kind).sum(1)
        carried: dict[int, list[np.ndarray]] = defaultdict(list)
        out, w = [], 0
        while w < self.bits + digits - 1 or carried.get(w):
            chosen = [np.where(size >> k & 1, base + (w - k), 0) for k in range(digits) if 0 <= w - k < self.bits]
            parts = carried.pop(w, [])
            if chosen:
                at = np.sort(np.concatenate(chosen, axis=1), axis=1)
                at = at[:, at.shape[1] - int((at > 0).sum(1).max(initial=0)) :]
                parts = [*parts, table[at]]
            a = np.concatenate(parts, axis=1) if parts else np.zeros((len(q), 0, words), np.uint64)
            while a.shape[1] > 1:
                n = a.shape[1] // 3
                if n:
                    x, y, z = a[:, :n], a[:, n : 2 * n], a[:, 2 * n : 3 * n]
                    half = x ^ y
                    carried[w + 1].append((x & y) | (z & half))
                    a = np.concatenate([half ^ z, a[:, 3 * n :]], axis=1)
                else:
                    carried[w + 1].append(a[:, :1] & a[:, 1:])
                    a = a[:, :1] ^ a[:, 1:]
            out.append(a[:, 0] if a.shape[1] else np.zeros((len(q), words), np.uint64))
            w += 1
        return out, constant

    def top(self, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, id, score) of the k best rows per query; ties to smaller ids; rows with the query's id excluded."""
        n, words = len(self.ids), self.slices.shape[1]
        slices, constant = self.sums(q)
        ones = np.zeros((1, words * 64), np.uint8)
        ones[:, :n] = 1
        every = np.packbits(ones, axis=1, bitorder="little").view(np.uint64)
        left = np.repeat(every, len(q), axis=0)
        lo, hi = np.searchsorted(self.ids, query_ids, "left"), np.searchsorted(self.ids, query_ids, "right")
        for i in np.flatnonzero(hi > lo):
            for p in range(lo[i], hi[i]):
                left[i, p // 64] &= ~(np.uint64(1) << np.uint64(p % 64))
        need = np.minimum(k, np.bitwise_count(left).sum(1, dtype=np.int64))
        sure = np.zeros_like(left)
        for s in reversed(slices):
            high = left & s
            number = np.bitwise_count(high).sum(1, dtype=np.int64)
            enough = (number >= need)[:, None]
            sure |= np.where(enough, np.uint64(0), high)
            need = np.where(enough[:, 0], need, need - number)
            left = np.where(enough, high, left & ~s)
        bools = lambda m: np.unpackbits(m.view(np.uint8), axis=1, bitorder="little").astype(bool)
        edge = bools(left)
        edge &= np.cumsum(edge, axis=1) <= need[:, None]
        i, p = np.nonzero(bools(sure) | edge)
        score = constant[i]
        for w, s in enumerate(slices):
            score = score + (s[i, p // 64] >> (p % 64).astype(np.uint64) & np.uint64(1)).astype(score.dtype) * (1 << w)
        if score.dtype == object:
            if any(abs(x) >= 1 << 63 for x in score):
                raise OverflowError("a score does not fit a long")
            score = score.astype(np.int64)
        return i, self.ids[p], score


class Best:
    """The k best rows so far for each of some queries."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int) -> None:
        self.ids, self.q, self.k = ids, q, k
        self.query, self.row, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(len(ids), -np.inf)  # the k-th best score, once there are k

    def meet(self, block: Block) -> None:
        # A margin of 2**-40 is far above what a sum of doubles can be off by.
        bound = block.reach(self.q)
        open_ = np.flatnonzero(bound + 2.0**-40 * np.abs(bound) + 1 >= self.least)
        found = [(self.query, self.row, self.score)]
        for lo in range(0, len(open_), 32):
            at = open_[lo : lo + 32]
            i, row, score = block.top(self.ids[at], self.q[at], self.k)
            found.append((at[i], row, score))
        query, row, score = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((row, -score, query))
        query, row, score = query[order], row[order], score[order]
        new = np.r_[True, query[1:] != query[:-1]] if len(query) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        place = np.arange(len(query)) - np.repeat(start, np.diff(np.r_[start, len(query)]))
        keep = place < self.k
        full = place == self.k - 1
        self.least[query[full]] = score[full]
        self.query, self.row, self.score = query[keep], row[keep], score[keep]


def quantised(vectors: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """(id, q): floor(scale * component) as long; rows without an id, or with a null or non-finite component, go.

    A component beyond LARGEST cannot be held and raises an error.
    """

    def one(v: Column) -> Column:
        x = F.floor(F.lit(scale) * v.cast("double"))
        return F.when(F.abs(F.lit(scale) * v.cast("double")) < float(LARGEST), x).otherwise(F.raise_error(F.lit("a quantised component exceeds 2**62")).cast("long"))

    x = F.transform(F.col(vector_col), one)
    fine = F.forall(F.col(vector_col), lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select(F.col(id_col).cast("long").alias("id"), x.alias("q"))


def _matrix(rows: list) -> np.ndarray:
    dims = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), dims), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 2048, chunk: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products for each query, ranks from 1.

    Queries are the rows whose id is divisible by `every`; candidates are all rows but
    those of the query's id. Components become floor(scale * x). Equal scores rank by
    smaller id. Fewer candidates than k: all of them. Vectors that are null or hold a null
    or non-finite component, and rows without an id, take no part; vectors of unequal length
    count as padded with zeros; repeated rows are candidates each, and a query that repeats
    is asked once (per different vector of its id, best scores over all). An empty
    table gives an empty result; other columns are not read. Every block of `block_rows`
    rows, however many, meets every query, unless the block's bound says that none of its rows can be among the best.
    Scores are exact whatever the components; a component beyond 2**62 / scale, or a score among the best
    of a block that does not fit a long, raises an error.
    """
    rows = cut(quantised(vectors, scale, id_col, vector_col))
    total, asked = rows.agg(F.count("*"), F.count_if(F.col("id") % every == 0)).first()
    blocks, chunks = max(1, -(-total // block_rows)), max(1, -(-(asked or 0) // chunk))

    def build(p: pd.DataFrame) -> pd.DataFrame:
        b = Block.build(p["id"].to_numpy(np.int64), _matrix(p["q"].tolist()))
        return pd.DataFrame({"block": [p["block"].iloc[0]], "index": [b.to_bytes()]})

    def bundle(p: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(p["q"].tolist())
        return pd.DataFrame({"chunk": [p["chunk"].iloc[0]], "dims": [m.shape[1]], "ids": [p["id"].to_numpy("<i8").tobytes()], "q": [m.astype("<i8").tobytes()]})

    place = F.xxhash64("id", "q", F.monotonically_increasing_id())
    index = cut(rows.withColumn("block", F.pmod(place, F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(build, "block int, index binary"))
    queries = rows.where(F.col("id") % every == 0).distinct().withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int"))
    queries = cut(queries.groupBy("chunk").applyInPandas(bundle, "chunk int, dims int, ids binary, q binary"))
    groups, askers = min(blocks, GROUPS), -(-chunks // CHUNKS)
    tasks = groups * askers
    other = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(other(groups).alias("g"), (F.col("chunk") % askers).alias("a"), F.lit(-1).alias("block"), "dims", "ids", "q")
    met = index.select((F.col("block") % groups).alias("g"), other(askers).alias("a"), "block", F.lit(0).alias("dims"), F.lit(None).cast("binary").alias("ids"), F.col("index").alias("q"))
    unit = (F.col("a") * groups + F.col("g")).alias("unit")
    pairs = asked.union(met).select(unit, "block", "dims", "ids", "q").repartitionById(tasks, F.col("unit")).sortWithinPartitions("unit", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, best = None, [], None

        def found() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (best.ids[best.query], best.row, best.score)], names=["query_id", "vec_id", "score"])

        for b in batches:
            for at, block, dims, ids, data in zip(*b.columns, strict=True):
                if at.as_py() != now:
                    if best:
                        yield found()
                    now, held, best = at.as_py(), [], None
                if block.as_py() < 0:
                    own = np.frombuffer(ids.as_py(), "<i8")
                    held.append((own, np.frombuffer(data.as_py(), "<i8").reshape(len(own), dims.as_py())))
                elif held:
                    if best is None:
                        width = max(x.shape[1] for _, x in held)
                        best = Best(np.concatenate([i for i, _ in held]), np.vstack([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for _, x in held]), k)
                    best.meet(Block.from_bytes(data.as_py()))
        if best:
            yield found()

    found = pairs.mapInArrow(tidy(search), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
