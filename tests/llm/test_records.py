"""Token records against the tokenizers library, a plain checksum and a plain reader."""

import random
import struct
import zlib

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from tidelens.llm import records

FILE = path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(FILE)


def plain_crc32c(data):
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums():
    rng = random.Random(5)
    assert records.crc32c([b"123456789"]).tolist() == [0xE3069283]
    data = [rng.randbytes(n) for n in [*range(40), 63, 64, 65, 1000, 4096, 4099, 70_001]]
    assert records.crc32c(data).tolist() == [plain_crc32c(x) for x in data]
    assert records.crc32c([]).tolist() == []
    crc = plain_crc32c(b"abc")
    assert records.masked(np.array([crc], np.uint32))[0] == ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def want(rows, end=0):
    """(doc_id, start, n_tokens, crc) of rows (doc_id, text), nulls first."""
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_whole_table(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    folder = f"file://{tmp_path}/out"
    small = records.RecordParams(roll=100_000, read=20_000, task=50_000)
    got = records.token_records(docs, FILE, folder, small)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in got.collect()) == want(rows)
    manifest = records.read_manifest(folder)
    assert len(manifest["files"]) > 4 and manifest["records"] == len(rows) and manifest["id_bytes"] == 2

    # The files in order, read as any reader of such frames would.
    seen, ids = [], []
    for x in manifest["files"]:
        data, at = (tmp_path / "out" / f"{x['file']}.records").read_bytes(), 0
        while at < len(data):
            n, check = struct.unpack_from("<QI", data, at)
            payload = data[at + 12 : at + 12 + n]
            (tail,) = struct.unpack_from("<I", data, at + 12 + n)
            assert check == int(records.masked(np.array([plain_crc32c(data[at : at + 8])], np.uint32))[0])
            if n < 500:
                assert tail == int(records.masked(np.array([plain_crc32c(payload)], np.uint32))[0])
            doc, found = records.parse(payload)
            seen.append(doc)
            ids += np.frombuffer(found, "<u2").tolist()
            at += 16 + n
    assert seen == sorted(seen) and len(ids) == manifest["tokens"]

    # In random order, each record once, with its ids.
    mixed = records.shuffled_records(spark, folder, 7, records.RecordParams(run=4, window=8)).collect()
    order = [r.doc_id for r in mixed]
    assert sorted(order) == seen and order != seen
    assert all(list(r.ids) == ids[r.start : r.start + r.n_tokens] for r in mixed)
    near = sum(abs(a - b) == 1 for a, b in zip(order, order[1:], strict=False))
    assert near < len(order) / 4
    assert [r.doc_id for r in records.shuffled_records(spark, folder, 7, records.RecordParams(run=4, window=8)).collect()] == order
    assert [r.doc_id for r in records.shuffled_records(spark, folder, 8, records.RecordParams(run=4, window=8)).collect()] != order


def test_damage_is_found(spark, tmp_path):
    docs = spark.createDataFrame([(i, "some words " * 20) for i in range(50)], "doc_id long, text string").coalesce(1)
    folder = f"file://{tmp_path}/out"
    records.write_records(docs, FILE, folder)
    (file,) = [x for x in (tmp_path / "out").glob("*.records") if x.stat().st_size][:1]
    whole = file.read_bytes()
    for at in (0, 9, 40, len(whole) - 1):
        file.write_bytes(whole[:at] + bytes([whole[at] ^ 4]) + whole[at + 1 :])
        with pytest.raises(Exception, match="damaged"):
            records.read_records(spark, folder).collect()
    file.write_bytes(whole)
    assert len(records.read_records(spark, folder).collect()) == 50


EDGES = [(5, "five words are in here"), (5, "five words are in here"), (5, "another text of that id"), (None, "no id"), (None, None), (1, ""), (2, None), (-3, "漢字 é <|endoftext|> x"), (1 << 40, "word " * 300_000)]


@pytest.mark.parametrize("kind", ["bigint", "int", "decimal(18,0)", "string"])
def test_edges(spark, kind):
    rows = [(None if d is None else d % (1 << 31) if kind == "int" else d, t) for d, t in EDGES]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.select(docs.text.alias("start"), docs.doc_id.cast(kind).alias("doc_id"), docs.text, docs.text.alias("ids"), docs.text.alias("_t"))
    got = [tuple(r) for r in records.token_records(docs, FILE).collect()]
    if kind == "string":
        rows = [(None if d is None else str(d), t) for d, t in rows]
    counts = [(str(d), n, c) for d, t in rows for _, _, n, c in want([(1, t)])]
    assert sorted((str(d), n, c) for d, _, n, c in got) == sorted(counts)
    by_start = sorted(got, key=lambda r: r[1])
    assert [r[1] for r in by_start] == [0, *np.cumsum([r[2] for r in by_start])[:-1]]
    order = [r[0] for r in by_start]
    assert order == [None, None, *sorted(d for d in order if d is not None)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    got = records.token_records(docs, FILE)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.collect() == []


def test_one_id_of_many_rows(spark, tmp_path):
    """A third of all rows have one id: several tasks share them, and the starts have no gap."""
    docs = spark.range(6000).selectExpr("if(id % 3 = 0, 7, id) AS doc_id", "concat('text ', id % 50) AS text").repartition(4)
    folder, key = f"file://{tmp_path}/out", "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        got = records.token_records(docs, FILE, folder).collect()
    finally:
        spark.conf.unset(key)
    by_start = sorted((r.start, r.n_tokens) for r in got)
    assert len(got) == 6000 and all(a + n == b for (a, n), (b, _) in zip(by_start, by_start[1:], strict=False))
    holding = 0
    for x in records.read_manifest(folder)["files"]:
        holding += any(d == 7 for d, _, _ in records.RecordFile(folder, x["file"], 2))
    assert holding > 1
