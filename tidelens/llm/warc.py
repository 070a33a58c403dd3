"""WARC archives and a two-level capture index.

Records are written as gzip members, one per page; a page whose payload another, larger
page id holds as well becomes a revisit record without the payload. The index lists all
captures by reversed-host URL key: blocks of sorted lines, compressed one by one; a
sparse directory per part file with the first key of each block; and a list of the parts.
A lookup bisects the parts, then the part's directory, reads one block by its range,
bisects its lines and reads the record by its range.

Tasks write files under names of their own, and only rows that a finished task returned
lead to a file, so a task that runs again leaves unused files but no wrong entry.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_rows, perhaps, shared_dir


@dataclass(frozen=True)
class WarcParams:
    level: int = 4
    roll: int = 256 << 20  # bytes after which a task begins a new archive file
    block: int = 2000  # lines of an index block
    read: int = 4 << 20  # bytes that neighbouring records are read at once
    task: int = 64 << 20  # bytes of archives that a reading task takes
    date: str = "1970-01-01T00:00:00Z"


NO_ID = -(1 << 63)
#: Payloads with copies (a digest and an id each) that are broadcast; of more a filter is, and each is dealt to SALTS keys.
GROUPS_SENT, SALTS = 200_000, 16


def url_key(url: str | None) -> str:
    """The sort key of a URL: its host's labels reversed, then port, path and query. Null: "-"."""
    if url is None:
        return "-"
    clean = quote(url, safe="".join(chr(c) for c in range(33, 127)))
    try:
        p = urlsplit(clean if "//" in clean else f"//{clean}")
        host, port = (p.hostname or "").rstrip("."), p.port
    except ValueError:  # a broken port or bracket
        return clean
    number = "" if port is None or (p.scheme, port) in (("http", 80), ("https", 443)) else f":{port}"
    return ",".join(reversed(host.split("."))) + number + ")" + (p.path or "/") + (f"?{p.query}" if p.query else "")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record, uncompressed."""
    kind = "response" if refers_to is None else "revisit"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(chr(c) for c in range(33, 127)))}")
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers_to is None:
        block += payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "WARC/1.1\r\n".encode() + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[int | None, int, str, str, int | None, bytes]:
    """(page id, payload bytes, digest, type, refers to, payload) of a record; a response's digest is checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = fields["WARC-Record-ID"][len("<urn:x-page:") : -1]
    named = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if fields["WARC-Type"] == "response":
        if len(payload) != size or digest(payload) != named:
            raise ValueError(f"the record of page {page} is damaged")
        to = None
    else:
        to = int(fields["WARC-Refers-To"][len("<urn:x-page:") : -1])
    return int(page) if page else None, size, named, fields["WARC-Type"], to, payload


def write_archives(pages: DataFrame, folder: str, params: WarcParams = WarcParams(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the archives below folder; (key, page_id, file, offset, length) of every record, kept in folder/captures."""
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), F.coalesce(pages[html_col], F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    groups = cut(rows.groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("sha", "last"))
    if groups.count() <= GROUPS_SENT:
        joined = rows.join(F.broadcast(groups), "sha", "left")
    else:
        # Only pages whose payload may be one of the repeated ones are shuffled, the others go straight to the archive; a
        # payload that very many pages have must not meet its group in one task.
        maybe = perhaps(groups.select(F.xxhash64("sha").alias("h")), "h")
        flagged = rows.withColumn("maybe", maybe(F.xxhash64("sha")))
        salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        some = flagged.where("maybe").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["sha", "salt"], "left")
        joined = flagged.where("NOT maybe").withColumn("last", F.lit(None).cast("long")).select(*rows.columns, "last").unionByName(some.select(*rows.columns, "last"))
    typed = joined.select("page_id", "url", "html", F.when(F.coalesce(F.col("page_id") != F.col("last"), F.col("last").isNotNull()), F.col("last")).alias("to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        try:
            for b in batches:
                made = []
                for page, url, html, to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if out is None or at >= params.roll:
                        if out:
                            out.close()
                        name, at = f"archive-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    z = zlib.compressobj(params.level, zlib.DEFLATED, 31)
                    data = z.compress(record(page, url, html.encode("utf-8", "surrogatepass"), to, params.date)) + z.flush()
                    out.write(data)
                    made.append((url_key(url), page, name, at, len(data)))
                    at += len(data)
                cols = list(zip(*made, strict=True)) or [[]] * 5
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["key", "page_id", "file", "offset", "length"])
        finally:
            if out:
                out.close()

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    typed.mapInArrow(run, "key string, page_id long, file string, offset long, length long").write.parquet(f"{folder}/captures")
    return pages.sparkSession.read.parquet(f"{folder}/captures")


def write_index(captures: DataFrame, folder: str, params: WarcParams = WarcParams()) -> None:
    """Write the sorted blocks, a directory for each part and the list of parts below folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        name, directory, lines, at, out = f"index-{uuid.uuid4().hex}", [], [], 0, None

        def put() -> None:
            nonlocal at, lines, out
            out = out or store.open_output_stream(f"{root}/{name}.gz", compression=None)
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            data = z.compress("\n".join("\t".join(map(str, x)) for x in lines).encode()) + z.flush()
            out.write(data)
            directory.append([lines[0][0], lines[0][1], at, len(data)])
            at, lines = at + len(data), []

        for b in batches:
            for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lines.append(x)
                if len(lines) >= params.block:
                    put()
        if lines:
            put()
        if out:
            out.close()
            with store.open_output_stream(f"{root}/{name}.json") as f:
                f.write(json.dumps(directory).encode())
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([directory[0][1]]), pa.array([name])], names=["key", "page_id", "part"])

    rows = captures.select("key", F.coalesce("page_id", F.lit(NO_ID)).alias("page_id"), "file", "offset", "length")
    rows = rows.repartitionByRange("key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    rows.mapInArrow(run, "key string, page_id long, part string").write.parquet(f"{folder}/parts")
    # One short row per part file, as many as there are shuffle partitions.
    parts = [(r.key, r.page_id, r.part) for r in captures.sparkSession.read.parquet(f"{folder}/parts").collect()]
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_output_stream(f"{root}/parts.json") as f:
        f.write(json.dumps(sorted(parts)).encode())


class CaptureIndex:
    """Looks captures up in an index folder, from any machine that sees the folder."""

    def __init__(self, folder: str) -> None:
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.parts = json.loads(self._all("parts.json"))
        self.first = [(k, i) for k, i, _ in self.parts]
        self.directories: dict[str, tuple[list, list]] = {}
        self.blocks: dict[tuple[str, int], tuple[list, list]] = {}

    def _all(self, name: str) -> bytes:
        with self.store.open_input_stream(f"{self.root}/{name}") as f:
            return f.read()

    def _directory(self, part: str) -> tuple[list, list]:
        if part not in self.directories:
            rows = json.loads(self._all(f"{part}.json"))
            if len(self.directories) > 8:
                self.directories.clear()
            self.directories[part] = ([(k, i) for k, i, _, _ in rows], rows)
        return self.directories[part]

    def _block(self, part: str, offset: int, length: int) -> tuple[list, list]:
        if (part, offset) not in self.blocks:
            with self.store.open_input_file(f"{self.root}/{part}.gz") as f:
                data = f.read_at(length, offset)
            rows = [x.split("\t") for x in zlib.decompress(data, 31).decode().split("\n")]
            if len(self.blocks) > 8:
                self.blocks.clear()
            self.blocks[part, offset] = ([(r[0], int(r[1])) for r in rows], rows)
        return self.blocks[part, offset]

    def find(self, key: str, page_id: int | None = None) -> Iterator[tuple[int, str, int, int]]:
        """(page id, file, offset, length) of the captures of a key, or of one page of it."""
        low = (key, NO_ID if page_id is None else page_id)
        high = (key, 1 << 63) if page_id is None else low
        p = max(0, bisect.bisect_left(self.first, low) - 1)
        for k in range(p, len(self.parts)):
            if self.first[k] > high:
                return
            part = self.parts[k][2]
            first, rows = self._directory(part)
            for j in range(max(0, bisect.bisect_left(first, low) - 1), len(first)):
                if first[j] > high:
                    return
                keys, lines = self._block(part, *rows[j][2:])
                for i in range(bisect.bisect_left(keys, low), bisect.bisect_right(keys, high)):
                    yield keys[i][1], lines[i][2], int(lines[i][3]), int(lines[i][4])

    def read(self, file: str, offset: int, length: int) -> bytes:
        """One record, uncompressed."""
        with self.store.open_input_file(f"{self.root}/{file}") as f:
            return zlib.decompress(f.read_at(length, offset), 31)


def read_captures(keys: DataFrame, folder: str, params: WarcParams = WarcParams()) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the captures of keys (key, page_id), from the archives.

    The keys are sorted like the index, so a task goes through its blocks once; the places
    found are dealt out by file range and sorted, so neighbouring records are read together.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for b in batches:
            index = index or CaptureIndex(folder)
            found = [x[1:] for key, page in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in index.find(key, page)]
            cols = list(zip(*found, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "offset", "length"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        f, name = None, None
        for b in batches:
            places, made, i = list(zip(*(c.to_pylist() for c in b.columns), strict=True)), [], 0
            while i < len(places):
                file, start, length = places[i]
                j, end = i + 1, start + length
                while j < len(places) and places[j][0] == file and places[j][1] == end and end - start < params.read:
                    end += places[j][2]
                    j += 1
                if file != name:
                    if f:
                        f.close()
                    f, name = store.open_input_file(f"{root}/{file}"), file
                data = f.read_at(end - start, start)
                for _, at, length in places[i:j]:
                    made.append(parse(zlib.decompress(data[at - start : at - start + length], 31))[:5])
                i = j
            cols = list(zip(*made, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if f:
            f.close()

    keys = keys.select("key", F.coalesce("page_id", F.lit(NO_ID)).alias("page_id")).distinct()
    sorted_keys = keys.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    places = sorted_keys.mapInArrow(search, "file string, offset long, length long")
    # A place is a few bytes but leads to a whole record: the tasks follow the archives' size, not that of the places.
    size = places.sparkSession.read.parquet(f"{folder}/captures").agg(F.sum("length")).first()[0] or 0
    tasks = max(int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // params.task))
    places = places.repartition(tasks, "file", F.floor(F.col("offset") / (4 * params.read))).sortWithinPartitions("file", "offset")
    return places.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str | None = None, params: WarcParams = WarcParams(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archive pages, index the archives, and read every page's record back through the index.

    (page_id, payload_bytes, payload_digest, record_type, refers_to), one row per input row.
    The payload is the html in UTF-8, whole, empty for null. Of rows with equal payloads
    the one with the largest id is the response and the others revisit it; equal rows with
    that same id are responses too; a null id is never the largest, and rows of
    equal payload without any id are responses. A null url has the key "-". An empty
    table gives empty archives and an empty result; other columns of pages are not
    read. folder: a new folder that driver and executors share.
    """
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_index(write_archives(pages, folder, params, id_col, url_col, html_col), folder, params)
    keys = map_rows(pages.select(pages[id_col].cast("long"), pages[url_col]), "page_id long, key string", lambda: lambda c: [c[0], [url_key(u) for u in c[1]]])
    return read_captures(keys, folder, params)


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS last FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + CAST((CAST(('0x' || substr(h, 1 + 5 * (i // 4), 5)) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM d
"""
