"""JSON array files that several tasks read."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidelens.plans.queries import QUERIES
from tidelens.sources import arrays, readers, writers

SCHEMA = "id INT, t STRING, x STRUCT<y: ARRAY<STRING>>"


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_011)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _rows(n):
    r = random.Random(5)
    word = lambda: "".join(r.choice('ab{}[]",:\\\n\té😀 /') for _ in range(r.choice((0, 1, 5, 30, 300))))
    return [{"id": i, "t": word() if i % 7 else None, "x": {"y": [word() for _ in range(i % 4)], "z": {}}, "e": []} for i in range(n)]


def test_one_file_is_read_by_several_tasks(spark, tmp_path, small_splits):
    f = f"{tmp_path}/a.json"
    with open(f, "w") as out:
        json.dump(_rows(400), out)
    seen = readers.json_file(spark, f, SCHEMA).select("id", F.spark_partition_id().alias("p")).collect()
    assert sorted(r.id for r in seen) == list(range(400)) and len({r.p for r in seen}) > 3


@pytest.mark.parametrize("layout", [{"indent": 4, "ensure_ascii": False}, {"separators": (",", ":")}])
def test_elements_across_splits_and_chunks(spark, tmp_path, small_splits, layout):
    f, rows = f"{tmp_path}/a.json", _rows(300)
    with open(f, "w") as out:
        out.write(" \n" + json.dumps(rows, **layout) + "\n")
    got = arrays.read(spark, f, SCHEMA, size=500).collect()
    assert sorted(repr((r.id, r.t, list(r.x.y))) for r in got) == sorted(repr((r["id"], r["t"], r["x"]["y"])) for r in rows)


def test_a_folder_holds_arrays_and_other_files(spark, tmp_path):
    texts = {"a": '[{"id":1},\n{"id":2}]', "b": '{"id":3}', "c": "[]", "d": "", "e": " [ ]\n", "f": '[{"id":4}', "g": "[1,2]", "h": '[{"id":5,"t":"]}\\\\"}]'}
    for k, v in texts.items():
        (tmp_path / f"{k}.json").write_text(v)
    (tmp_path / "u.json").write_bytes('[{"id":6},{"id":7}]'.encode("utf-16-le"))
    (tmp_path / "x.txt").write_text('[{"id":9}]')
    want = spark.read.schema(SCHEMA).options(multiLine=True, pathGlobFilter="*.json").json(str(tmp_path)).collect()
    assert sorted(map(repr, readers.json_folder(spark, str(tmp_path), SCHEMA).collect())) == sorted(map(repr, want))


def test_text_after_an_array_is_an_error(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id":1}] [{"id":2}]')
    with pytest.raises(Exception, match="after the end of the array"):
        readers.json_file(spark, f"{tmp_path}/a.json", SCHEMA).collect()


def test_a_folder_of_arrays_has_a_file_for_each_split_of_the_posts(spark, sf, small_splits, monkeypatch):
    seen = []
    monkeypatch.setattr(writers, "json_arrays", lambda df, folder: seen.append(df.rdd.getNumPartitions()))
    monkeypatch.setattr(readers, "json_folder", lambda *_: spark.range(0))
    QUERIES["SRC3"](spark, sf)
    assert seen[0] > 3
