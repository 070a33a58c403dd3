"""The options of a run, kept as JSON beside its results."""

from __future__ import annotations

import json

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(path: str, options: dict) -> None:
    """One JSON object, keys in order; an existing file is replaced."""
    store, place = fs.FileSystem.from_uri(path)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    with store.open_output_stream(place, compression=None) as f:
        f.write(json.dumps(options, indent=4, sort_keys=True, ensure_ascii=False, default=str).encode())


def read(path: str) -> dict:
    store, place = fs.FileSystem.from_uri(path)
    with store.open_input_stream(place, compression=None) as f:
        return json.loads(f.read())


def table(spark: SparkSession, path: str) -> DataFrame:
    """(option, value) of a manifest, or of all manifests that a path with wildcards names; values are JSON text."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.explode(F.from_json("value", "map<string,string>")).alias("option", "value"))
