"""JSON array files read in pieces: tasks take splits of a file and cut its array between the elements.

A split can begin inside a string or an object. Its text is therefore described for both cases, what holds is summed up over the splits before it,
and only then is the text cut. Elements that lie across chunks are put together by the chunk in which they begin.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .adapters import scratch

#: Bytes of a chunk, as soon as a record ends.
CHUNK = 1 << 20
STEP = np.zeros(256, np.int8)
STEP[list(b"{[")] = 1
STEP[list(b"}]")] = -1
KEYS = ["file", "block", "seq"]
#: whole: the chunk may be cut; quotes: it changes between inside and outside of a string. By whether it begins inside a string: the change of
#: the level over it, the least change on the way, and whether a bracket closes at the level it begins with.
_KIND = pa.schema([("file", pa.string()), ("block", pa.int64()), ("seq", pa.int32()), ("whole", pa.bool_()), ("quotes", pa.int32()), ("change", pa.list_(pa.int64())), ("least", pa.list_(pa.int64())), ("closes", pa.list_(pa.bool_())), ("data", pa.binary())])


def _brackets(data: bytes, inside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places of the brackets outside strings, their steps, the levels after them, and whether the text ends inside a string."""
    bare = np.frombuffer(re.sub(rb"\\.", b"__", data, flags=re.S) if b"\\" in data else data, np.uint8)
    within = (np.cumsum(bare == ord('"'), dtype=np.uint8) + np.uint8(inside)) & 1
    steps = STEP[bare]
    at = np.flatnonzero((steps != 0) & (within == 0))
    return at, steps[at], np.cumsum(steps[at], dtype=np.int64), int(within[-1])


def _described(file: str, block: int, seq: int, data: bytes) -> pa.RecordBatch:
    whole = b"\0" not in data  # else it is not UTF-8
    if block == seq == 0:
        whole &= data.lstrip(b" \t\r\n")[:1] == b"["
        data = data.replace(b"[", b",", 1) if whole else data  # as if an element went before
    row: dict = {"file": file, "block": block, "seq": seq, "whole": whole, "change": [], "least": [], "closes": [], "data": data}
    for inside in (0, 1):
        _, steps, levels, ends = _brackets(data, inside)
        row["quotes"] = ends ^ inside
        row["change"].append(int(levels[-1]) if len(levels) else 0)
        row["least"].append(int(levels.min()) if len(levels) else 0)
        row["closes"].append(bool(((levels == 0) & (steps < 0)).any()))
    return pa.RecordBatch.from_pylist([row], schema=_KIND)


def _chunks(size: int):
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seq = None, 0
        for b in batches:
            files, blocks, values = (b.column(i).to_pylist() for i in range(3))
            begin, n = 0, 0
            for i in range(1, len(values) + 1):
                n += len(values[i - 1])
                if i < len(values) and n < size and blocks[i] == blocks[begin] and files[i] == files[begin]:
                    continue
                here = (files[begin], blocks[begin])
                seq = seq + 1 if here == last else 0
                last = here
                yield _described(*here, seq, b"}".join(values[begin:i]) + b"}")
                begin, n = i, 0

    return chunks


def _cut(with_whole: bool):
    """Of each chunk the elements that lie whole in it, or the parts of those that do not, with the number of the chunk they begin in."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                file, n, owner, inside, level, last, data = (b.column(j)[i].as_py() for j in range(7))
                data = data[:-1] if last else data  # no bracket follows the last record
                at, steps, levels, _ = _brackets(data, inside) if data else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), 0)
                levels = levels + level
                out = np.flatnonzero(levels <= 0)
                if len(out) and not (last and not data[at[out[0]] + 1 :].strip()):
                    raise ValueError(f"{file}: text after the end of the array")
                data = data[: at[out[0]]] if len(out) else data
                ends = (at[(levels == 1) & (steps < 0)] + 1).tolist()
                alone = level == 1 and not inside  # an element begins with the chunk
                if with_whole:
                    bounds = [0, *ends] if alone else ends
                    texts = [data[x:y] for x, y in zip(bounds, bounds[1:], strict=False)]
                    owners: list[int | None] = [None] * len(texts)
                elif ends:
                    texts, owners = [b"" if alone else data[: ends[0]], data[ends[-1] :]], [owner, n]
                else:
                    texts, owners = [b"" if n == 1 and last and data.strip() == b"," else data], [owner]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(texts), pa.string()), pa.array(owners, pa.int64()), pa.array([n] * len(texts), pa.int64()), pa.array(texts, pa.binary())], names=["file", "owner", "n", "data"])

    return cut


def _states(chunks: DataFrame) -> DataFrame:
    """How each chunk begins: inside a string or not, its level, the last chunk before it in which an element ends; and whether its file is an array."""
    w = Window.partitionBy("file").orderBy("block", "seq")
    before, every = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    s = chunks.drop("data").withColumns({"n": F.row_number().over(w).cast("long"), "inside": (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("int"), "last": F.lead("seq").over(w).isNull()})
    s = s.withColumns({c: F.get(c, "inside") for c in ("change", "least", "closes")})
    s = s.withColumns({"level": 1 + F.coalesce(F.sum("change").over(before), F.lit(0)), "array": F.min("whole").over(every) & (F.sum("quotes").over(every) % 2 == 0) & (F.sum("change").over(every) == -2)})
    ends = F.when(F.col("level") > 1, F.col("least") <= 1 - F.col("level")).otherwise(F.col("closes"))
    return s.withColumn("owner", F.coalesce(F.last(F.when(ends, F.col("n")), ignorenulls=True).over(before), F.lit(0)))


def read(spark: SparkSession, path: str, schema: str, pattern: str | None = None, size: int = CHUNK) -> DataFrame:
    """The objects of all arrays of a path, with the file split between tasks. An element that is no such object is a row of nulls.

    The text goes into chunks in the shared folder once. Files that are no array in UTF-8 (one object, damage, other encodings) are read whole,
    as Spark reads a file of one value.
    """
    glob = {"pathGlobFilter": pattern} if pattern else {}
    place = f"{scratch(spark)}/array-{uuid.uuid4().hex}"
    records = spark.read.options(lineSep="}", **glob).text(path).select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary"))
    records.mapInArrow(_chunks(size), "file string, block long, seq int, whole boolean, quotes int, change array<long>, least array<long>, closes array<boolean>, data binary").write.parquet(place)
    chunks = spark.read.parquet(place)
    states = _states(chunks)
    others = [r.file for r in states.where("not array").select("file").distinct().collect()]
    placed = chunks.select(*KEYS, "data").join(F.broadcast(states.where("array").select(*KEYS, "n", "owner", "inside", "level", "last")), KEYS)
    cut = lambda whole: placed.select("file", "n", "owner", "inside", "level", "last", "data").mapInArrow(_cut(whole), "file string, owner long, n long, data binary")
    parts = cut(False).groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("n", "data"))).alias("p"))
    joined = parts.select(F.aggregate(F.col("p.data"), F.lit(b""), lambda a, x: F.concat(a, x)).alias("data"))
    text = F.ltrim(F.col("data").cast("string"), F.lit(" \t\r\n"))
    elements = cut(True).select("data").unionByName(joined).select(text.alias("t")).where("t != ''")
    # Without a comma before it, it is no element.
    element = F.when(F.col("t").startswith(","), F.substr("t", F.lit(2))).otherwise(F.concat(F.lit(","), "t"))
    rows = elements.select(F.from_json(element, schema).alias("r")).select("r.*")
    if others:
        whole = spark.read.schema(schema).options(multiLine=True, **glob).json(path)
        rows = rows.unionByName(whole.where(F.col("_metadata.file_path").isin(others)))
    return rows
