"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named parquet table below sf_dir."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a new temporary
    one on a single machine, and an error on a cluster. What is written there stays until somebody deletes it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    folder, context = shared_dir(df.sparkSession), df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return df.checkpoint()


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked to be broadcast if it has at most so many rows. Only for a few numbers per row, already cut."""
    return F.broadcast(df) if df.count() <= rows else df


def perhaps(keys: DataFrame, column: str, bits: int = 27) -> Callable[[Column], Column]:
    """f(whole number): whether it may be in keys' column of whole numbers; never false for one that is. A Bloom filter
    of 1 << bits bits and two places a key, broadcast: 16 MB by default, whatever the number of keys. Some ten million keys
    let about 2 % of others through; with far more it says yes to more, and so only saves less."""
    mask, tile = (1 << bits) - 1, 1 << min(18, bits)

    def places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = h.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(32)) & np.uint64(mask)).astype(np.int64), ((h ^ h >> np.uint64(29)) & np.uint64(mask)).astype(np.int64)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for b in batches:
            for p in places(b.column(0).to_numpy(zero_copy_only=False)):
                seen[p] = True
        for i, part in enumerate(np.packbits(seen, bitorder="little").reshape(-1, tile // 8)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pa.compress(part, codec="zstd", asbytes=True)], pa.binary())], names=["tile", "data"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits_ = None, np.zeros(tile // 8, np.uint8)
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([bits_.tobytes()], pa.binary())], names=["tile", "data"])
        for b in batches:
            for i, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if i != now:
                    if now is not None:
                        yield row()
                    now, bits_ = i, np.zeros(tile // 8, np.uint8)
                bits_ |= np.frombuffer(pa.decompress(data, tile // 8, codec="zstd"), np.uint8)
        if now is not None:
            yield row()

    schema = "tile int, data binary"
    parts = keys.select(F.col(column).cast("long")).mapInArrow(tidy(fill), schema).repartition("tile").sortWithinPartitions("tile").mapInArrow(tidy(join), schema).collect()
    whole = bytearray((1 << bits) // 8)
    for r in parts:
        whole[r.tile * tile // 8 : (r.tile + 1) * tile // 8] = r.data
    sent = keys.sparkSession.sparkContext.broadcast(bytes(whole))

    @F.pandas_udf("boolean")
    def found(h: pd.Series) -> pd.Series:
        data = np.frombuffer(sent.value, np.uint8)
        a, b = ((data[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool) for p in places(h.to_numpy()))
        return pd.Series(a & b)

    return lambda c: found(F.coalesce(c.cast("long"), F.lit(0).cast("long")))  # with a null, pandas would make floats of the numbers


def id_column(docs: DataFrame, id_col: str, name: str = "doc_id") -> tuple[Column, str]:
    """(the id under a name, its type for map_rows): whole numbers are long (int stays int), all else is text."""
    kind = docs.schema[id_col].dataType.simpleString()
    whole = kind in ("tinyint", "smallint", "bigint") or (kind.startswith("decimal") and kind.endswith(",0)"))
    kind = "long" if whole else kind if kind == "int" else "string"
    return docs[id_col].cast(kind).alias(name), kind


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; a null key is in fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds, F.lit(0))


ROWS = 1000  # rows that are Python values at a time


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ROWS rows, which bounds what a worker holds twice."""
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            yield b.slice(i, ROWS)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives memory that it no longer uses back to the system: workers outlive their tasks."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return f


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[list], list[list]]]) -> DataFrame:
    """Run a function over columns of Python values, Arrow batch by Arrow batch.

    make() is called once per task and returns f(columns) -> output columns in the
    order of schema, all of one length. No rows leave their partition.
    """
    from pyspark.sql.types import StructType

    fields = [(x.split()[0], x.split()[1]) for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, types = [n for n, _ in fields], [kinds[t] for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in pieces(batches):
            out = f([c.to_pylist() for c in b.columns])
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=names)

    StructType.fromDDL(schema)
    return df.mapInArrow(tidy(run), schema)


def keep_rows(df: DataFrame, column: str, make: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows of df for which f(values of column) is true, with all columns as they are."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in pieces(batches):
            yield b.filter(pa.array(f(b.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(tidy(run), df.schema)
