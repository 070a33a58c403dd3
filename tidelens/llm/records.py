"""Token ids in length-delimited binary records, with an offset index beside each file.

A record is framed as readers of TFRecord files know it: the payload's length (8 bytes), a
masked CRC-32C of those 8 bytes, the payload, a masked CRC-32C of the payload; numbers are
little-endian. The payload is an Example message with two features: the document's id
(a number or a string; missing for null) and its token ids as one byte string, two
bytes an id where the vocabulary allows it and four otherwise. A file's index has 24 bytes
per record: the frame's place, its length, and the tokens before it in the file.
So any record is one range read, which is what shuffled reads need. manifest.json lists
the files in order, with the records and tokens before each.

Documents are dealt by id ranges and sorted inside them, so files follow one another in
the order of ids and only one short line per file passes the driver. Files have names of
their own; those of a task that ran again are listed nowhere.
"""

from __future__ import annotations

import json
import random
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import read_vocabulary
from .common import id_column, pieces, shared_dir, tidy
from .packing import Tokens


@dataclass(frozen=True)
class RecordParams:
    end_id: int = 0
    roll: int = 128 << 20  # bytes after which a task begins a new file
    read: int = 4 << 20  # bytes that neighbouring records are framed or read at once
    task: int = 32 << 20  # bytes of records in a unit of reading
    run: int = 64  # neighbouring records that a shuffled read takes together
    window: int = 64  # runs that a shuffled read mixes


ENTRY = np.dtype([("at", "<u8"), ("size", "<u8"), ("before", "<u8")])
#: The reflected polynomial of CRC-32C, and the constant of masked checksums.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8


def _table(columns: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """A linear map of 32 bits as two tables, of its low and its high 16 bits."""
    out = []
    for part in (columns[:16], columns[16:]):
        t = np.zeros(1 << 16, np.uint32)
        for i, c in enumerate(part):
            t[1 << i : 2 << i] = t[: 1 << i] ^ np.uint32(c)
        out.append(t)
    return out[0], out[1]


def _apply(table: tuple[np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    return table[0][x & np.uint32(0xFFFF)] ^ table[1][x >> np.uint32(16)]


@lru_cache
def _shift(level: int) -> tuple[np.ndarray, np.ndarray]:
    """What 4 << level zero bytes do to a checksum's state."""
    if level:
        before = _shift(level - 1)
        return _table([int(c) for c in _apply(before, _apply(before, np.uint32(1) << np.arange(32, dtype=np.uint32)))])
    columns = [1 << i for i in range(32)]
    for _ in range(32):
        columns = [c >> 1 ^ (POLYNOMIAL if c & 1 else 0) for c in columns]
    return _table(columns)


def crc32c(buffers: list[bytes]) -> np.ndarray:
    """CRC-32C of each buffer, halving whole rows of words at a time.

    Zero bytes in front change nothing while the state is zero, so buffers of about one size share a matrix; the
    first state, all ones, is the same as turning round the first four bytes.
    """
    out = np.zeros(len(buffers), np.uint32)
    sizes = np.array([len(b) for b in buffers], np.int64)
    for i in np.flatnonzero(sizes < 4).tolist():
        state = 0xFFFFFFFF
        for b in buffers[i]:
            state ^= b
            for _ in range(8):
                state = state >> 1 ^ (POLYNOMIAL if state & 1 else 0)
        out[i] = state ^ 0xFFFFFFFF
    levels = np.array([((n + 3) // 4 - 1).bit_length() for n in sizes.tolist()])
    for level in np.unique(levels[sizes >= 4]).tolist():
        rows = np.flatnonzero((levels == level) & (sizes >= 4))
        grid = np.zeros((len(rows), 4 << level), np.uint8)
        for k, i in enumerate(rows.tolist()):
            grid[k, grid.shape[1] - sizes[i] :] = np.frombuffer(buffers[i], np.uint8)
        start = (grid.shape[1] - sizes[rows])[:, None] + np.arange(4)
        grid[np.arange(len(rows))[:, None], start] ^= 0xFF
        words = grid.view("<u4")
        for j in range(level):
            words = _apply(_shift(j), words[:, 0::2]) ^ words[:, 1::2]
        out[rows] = ~_apply(_shift(0), words[:, 0])
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    """Checksums of data that holds checksums: turned by 15 bits, and a constant added."""
    return (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(MASK)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, data: bytes) -> bytes:
    return bytes([number << 3 | 2]) + _varint(len(data)) + data


def example(doc_id: int | str | None, ids: bytes) -> bytes:
    """An Example message of the features doc_id (left out for null) and ids."""
    features = b""
    if doc_id is not None:
        kept = _field(1, _field(1, doc_id.encode())) if isinstance(doc_id, str) else _field(3, _field(1, _varint(doc_id & (1 << 64) - 1)))
        features = _field(1, _field(1, b"doc_id") + _field(2, kept))
    return _field(1, features + _field(1, _field(1, b"ids") + _field(2, _field(1, _field(1, ids)))))


def _number(data: memoryview, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _fields(data: memoryview) -> Iterator[tuple[int, memoryview]]:
    at = 0
    while at < len(data):
        tag, at = _number(data, at)
        size, at = _number(data, at)
        yield tag >> 3, data[at : at + size]
        at += size


def parse(payload: bytes) -> tuple[int | str | None, memoryview]:
    """(doc_id, ids) of an Example message that example() made."""
    doc_id, ids = None, memoryview(b"")
    ((_, features),) = _fields(memoryview(payload))
    for _, entry in _fields(features):
        (_, name), (_, feature) = _fields(entry)
        ((kind, values),) = _fields(feature)
        ((_, value),) = _fields(values)
        if bytes(name) == b"ids":
            ids = value
        elif kind == 1:
            doc_id = bytes(value).decode()
        else:
            n = _number(value, 0)[0]
            doc_id = n - (1 << 64) if n >> 63 else n
    return doc_id, ids


def frames(payloads: list[bytes]) -> list[bytes]:
    """The framed records of payloads."""
    lengths = [len(x).to_bytes(8, "little") for x in payloads]
    heads, tails = (masked(crc32c(x)).astype("<u4") for x in (lengths, payloads))
    return [n + h.tobytes() + x + t.tobytes() for n, h, x, t in zip(lengths, heads, payloads, tails, strict=True)]


def payloads(data: bytes, sizes: list[int]) -> list[bytes]:
    """The payloads of framed records that stand one after the other; ValueError if one is damaged."""
    lengths, found, sums, at = [], [], [], 0
    for size in sizes:
        lengths.append(data[at : at + 8])
        found.append(data[at + 12 : at + size - 4])
        sums.append((data[at + 8 : at + 12], data[at + size - 4 : at + size]))
        at += size
    want = [masked(crc32c(x)).astype("<u4") for x in (lengths, found)]
    for n, x, (a, b), h, t in zip(lengths, found, sums, *want, strict=True):
        if int.from_bytes(n, "little") != len(x) or a != h.tobytes() or b != t.tobytes():
            raise ValueError("a record is damaged")
    return found


def id_bytes(vocabulary: str) -> int:
    """Bytes that an id of the vocabulary file takes."""
    data = read_vocabulary(vocabulary)
    top = max([*data["model"]["vocab"].values(), *(x["id"] for x in data.get("added_tokens", []))])
    return 2 if top < 1 << 16 else 4


def write_records(docs: DataFrame, vocabulary: str, folder: str, params: RecordParams = RecordParams(), id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Write the files of docs below folder, in the order of ids (nulls first; equal ids in no given order); what manifest.json holds."""
    key, kind = id_column(docs, id_col)
    width = id_bytes(vocabulary)
    rows = docs.select(key, docs[text_col].alias("text"))
    # Ids that very many rows have are dealt by their texts, and repeated rows by where they come from.
    rows = rows.withColumns({"_t": F.xxhash64("text"), "_p": F.spark_partition_id()})
    rows = rows.repartitionByRange("doc_id", "_t", "_p").sortWithinPartitions("doc_id", "_t").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(vocabulary)
        store, root = fs.FileSystem.from_uri(folder)
        task, made, out, name, at, before, count = TaskContext.get().partitionId(), [], None, "", 0, 0, 0
        waiting, held = [], 0

        def put() -> None:
            nonlocal waiting, held, out, index, name, at, before, count
            if waiting and out is None:
                name, at, before, count = f"tokens-{uuid.uuid4().hex}", 0, 0, 0
                out, index = (store.open_output_stream(f"{root}/{name}.{x}", compression=None) for x in ("records", "index"))
            data = frames([x for x, _ in waiting])
            entries = np.zeros(len(data), ENTRY)
            entries["size"] = [len(x) for x in data]
            n = np.array([n for _, n in waiting], np.uint64)
            entries["at"], entries["before"] = at + np.cumsum(entries["size"]) - entries["size"], before + np.cumsum(n) - n
            for x in data:
                out.write(x)
            index.write(entries.tobytes())
            at, before, count = at + int(entries["size"].sum()), before + int(n.sum()), count + len(data)
            waiting, held = [], 0

        def end() -> None:
            nonlocal out
            out.close()
            index.close()
            made.append((task, len(made), name, count, before, at))
            out = None

        index = None
        for b in batches:
            for piece in pieces([b]):
                for doc, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    ids = np.append(tokens(text or ""), np.uint32(params.end_id))
                    waiting.append((example(doc, ids.astype(f"<u{width}").tobytes()), len(ids)))
                    held += len(waiting[-1][0])
                    if held >= params.read:
                        put()
                        if at >= params.roll:
                            end()
        if waiting:
            put()
        if out:
            end()
        cols = list(zip(*made, strict=True)) or [[]] * 6
        types = (pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 3)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["task", "part", "file", "records", "tokens", "bytes"])

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    rows.mapInArrow(tidy(run), "task int, part int, file string, records long, tokens long, bytes long").write.parquet(f"{folder}/files")
    # One short row per file.
    found = sorted(docs.sparkSession.read.parquet(f"{folder}/files").collect(), key=lambda r: (r.task, r.part))
    files, records, tokens = [], 0, 0
    for r in found:
        files.append({"file": r.file, "records": r.records, "tokens": r.tokens, "bytes": r.bytes, "first": records, "start": tokens})
        records, tokens = records + r.records, tokens + r.tokens
    manifest = {"id_type": kind, "id_bytes": width, "records": records, "tokens": tokens, "files": files}
    with store.open_output_stream(f"{root}/manifest.json", compression=None) as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(folder: str) -> dict:
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/manifest.json", compression=None) as f:
        return json.loads(f.read())


class RecordFile:
    """Range reads of one file by its index, from any machine that sees the folder."""

    def __init__(self, folder: str, file: str, id_bytes: int, read: int = RecordParams.read) -> None:
        store, root = fs.FileSystem.from_uri(folder)
        self.data, self.index = (store.open_input_file(f"{root}/{file}.{x}") for x in ("records", "index"))
        self.width, self.read = f"<u{id_bytes}", read

    def __iter__(self) -> Iterator[tuple[int | str | None, int, np.ndarray]]:
        return self.range(0, self.index.size() // ENTRY.itemsize)

    def range(self, first: int, count: int) -> Iterator[tuple[int | str | None, int, np.ndarray]]:
        """(doc_id, tokens before it in the file, ids) of the records from the first on."""
        entries = np.frombuffer(self.index.read_at(count * ENTRY.itemsize, first * ENTRY.itemsize), ENTRY)
        i = 0
        while i < len(entries):
            start = int(entries["at"][i])
            j = max(i + 1, int(np.searchsorted(entries["at"] + entries["size"], start + self.read, "right")))
            sizes = entries["size"][i:j].tolist()
            for x, before in zip(payloads(self.data.read_at(sum(sizes), start), sizes), entries["before"][i:j].tolist(), strict=True):
                doc_id, ids = parse(x)
                yield doc_id, before, np.frombuffer(ids, self.width).astype("<u4")
            i = j

    def close(self) -> None:
        self.data.close()
        self.index.close()


def _read(spark: SparkSession, folder: str, ids: bool, mix: int | None, params: RecordParams) -> DataFrame:
    manifest = read_manifest(folder)
    kind, width = manifest["id_type"], manifest["id_bytes"]
    schema = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")
    types = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind], pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * ids]
    # A line per file; the units of reading are made on the executors.
    lines = [(x["file"], x["start"], x["records"], params.run if mix is not None else max(1, params.task * x["records"] // max(1, x["bytes"]))) for x in manifest["files"]]
    files = spark.createDataFrame(lines, "file string, start long, records long, step long")
    units = files.select("file", "start", "records", "step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1, F.col("step"))).alias("first"))
    units = units.select("file", "start", "first", F.least("step", F.col("records") - F.col("first")).alias("count"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(x["bytes"] for x in manifest["files"]) // params.task))
    if mix is None:
        units = units.repartition(tasks, "file", "first").sortWithinPartitions("file", "first")
    else:
        units = units.withColumn("h", F.xxhash64(F.lit(mix), "file", "first")).repartitionByRange(tasks, "h").sortWithinPartitions("h").drop("h")

    def batch(rows: list) -> pa.RecordBatch:
        cols = [[d for d, _, _ in rows], [s for _, s, _ in rows], [len(x) for _, _, x in rows], [zlib.crc32(x.tobytes()) for _, _, x in rows]]
        arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=False)]
        if ids:
            ends = np.cumsum([0] + [len(x) for _, _, x in rows]).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*(x for _, _, x in rows), np.zeros(0, "<u4")]).astype(np.int32))))
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, name, rows, tokens, runs, rng = None, None, [], 0, 0, None
        for b in batches:
            for file, start, first, count in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if file != name:
                    if opened:
                        opened.close()
                    opened, name = RecordFile(folder, file, width, params.read), file
                rng = rng or random.Random(f"{mix} {file} {first}")
                for doc_id, before, found in opened.range(first, count):
                    rows.append((doc_id, start + before, found))
                    tokens += len(found)
                    if mix is None and tokens >= params.read // 4:
                        yield batch(rows)
                        rows, tokens = [], 0
                runs += 1
                if mix is not None and (runs == params.window or tokens >= params.read):
                    rng.shuffle(rows)
                    yield batch(rows)
                    rows, tokens, runs = [], 0, 0
        if opened:
            opened.close()
        if rows:
            if mix is not None:
                rng.shuffle(rows)
            yield batch(rows)

    return units.mapInArrow(tidy(run), schema)


def read_records(spark: SparkSession, folder: str, ids: bool = False, params: RecordParams = RecordParams()) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every record below folder, each file by ranges of its index.

    start counts the tokens of all records before; a damaged frame is an error.
    """
    return _read(spark, folder, ids, None, params)


def shuffled_records(spark: SparkSession, folder: str, seed: int, params: RecordParams = RecordParams()) -> DataFrame:
    """What read_records() gives with ids, in an order drawn by seed: runs of records are
    read in random order through the index and mixed with the runs that come beside them."""
    return _read(spark, folder, True, seed, params)


def token_records(docs: DataFrame, vocabulary: str, folder: str | None = None, params: RecordParams = RecordParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents' token ids as records, then read them back: (doc_id, start, n_tokens, ids_crc32), one row per input row.

    Texts are encoded whole and end with params.end_id; null and empty texts are that id
    alone. start is the number of ids before the document in the order of ids: null ids
    come first, rows of one id (repeated ones too) one after the other. Ids are whole
    numbers or text. An empty table gives no file and an empty result. Other
    columns of docs are not read. folder: a new folder that driver and executors share.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_records(docs, vocabulary, folder, params, id_col, text_col)
    return read_records(spark, folder, params=params)
