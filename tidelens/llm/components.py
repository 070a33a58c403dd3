"""Connected components by alternating large-star and small-star steps.

All state stays in DataFrames; each round is cut by a checkpoint in the shared
folder, and nothing but two numbers per round reaches the driver. Links are first reduced
to a forest where they are; up to ONE_TASK of what is left are finished in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tidy

ONE_TASK = 1_000_000  # links of two longs


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest position that each of n positions reaches through the pairs."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            open_ = ra != rb
            if not open_.any():
                break
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (root[root] != root).any():
                root = root[root]
    return root


def tree_links(names: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    """(a, b): each of the names that is not its own root, with that."""
    own = np.flatnonzero(root != np.arange(len(names)))
    return pa.RecordBatch.from_arrays([pa.array(names[own]), pa.array(names[root[own]])], names=["a", "b"])


def _forests(e: DataFrame) -> DataFrame:
    """(u, v): a forest of each partition's links, every node with the smallest that it reaches there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if got:
            u, v = (np.concatenate(x) for x in zip(*got, strict=True))
            names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            yield tree_links(names, forest(len(names), iter([(at[: len(u)], at[len(u) :])]))).rename_columns(["u", "v"])

    return e.mapInArrow(tidy(run), "u long, v long")


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root): for each node with a link to another, the smallest node it reaches.

    edges: two long columns. Rows with a null, loops and repeated rows change nothing;
    an empty table gives an empty result. The smallest node of each component is not
    listed itself. A node with very many neighbours is never gathered: its minimum is
    pre-aggregated and its edges go through a join that AQE can split. A partition of links is held
    in memory while it is reduced, so partitions must be of ordinary size.
    """
    e = cut(
        edges.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
        .select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .distinct()
    )
    links = e.count()
    if links > ONE_TASK:
        e = cut(_forests(e))
        links = e.count()
    if links <= ONE_TASK:
        return cut(_forests(e.coalesce(1)).select(F.col("u").alias("node"), F.col("v").alias("root")))
    seen = _digest(e)
    while seen[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        rest = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        e = cut(rest.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = _digest(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
