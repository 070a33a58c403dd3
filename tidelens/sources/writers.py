"""Sinks: files, databases and graph exports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import numbering


def json_lines(df: DataFrame, path: str, mode: str = "error") -> None:
    """One object per line; text is not escaped to ASCII."""
    df.write.mode(mode).json(path)


def json_arrays(df: DataFrame, folder: str, mode: str = "error") -> None:
    """A folder of JSON files, each one array with an object per line; one file for each partition."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for b in batches:
            out = []
            for x in b.column(0).to_pylist():
                out.append(mark + x)
                mark = ","
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if mark == "," else "[]"])], names=["value"])

    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(lines, "value string").write.mode(mode).text(folder)
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(folder)
    store = place.getFileSystem(conf)
    for f in store.listStatus(place):
        name = f.getPath().getName()
        if name.endswith(".txt"):
            store.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(place, name.removesuffix(".txt") + ".json"))


def one_file(df: DataFrame, path: str, mode: str = "error") -> None:
    """A single JSON-lines file, in the frame's order: for exports of bounded size only."""
    df.coalesce(1).write.mode(mode).json(path)


def chunked(df: DataFrame, path: str, rows: int = 10_000, mode: str = "error") -> None:
    """Parquet files of at most so many rows."""
    df.write.mode(mode).option("maxRecordsPerFile", rows).parquet(path)


def csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def by_window(df: DataFrame, path: str, *keys: str, mode: str = "error") -> None:
    """Parquet partitioned by window keys, so that ranges prune folders."""
    # A busy window is split over several tasks, small ones share one.
    df.hint("rebalance", *(F.col(k) for k in keys)).write.mode(mode).partitionBy(*keys).parquet(path)


def jdbc(df: DataFrame, url: str, table: str, user: str, password: str, page: int = 100, driver: str | None = None) -> None:
    """Append in multi-row inserts; a failed task rolls its own transaction back."""
    w = df.write.format("jdbc").option("url", url).option("dbtable", table).option("user", user).option("password", password).option("batchsize", page)
    (w.option("driver", driver) if driver else w).mode("append").save()


def done_rows(results: DataFrame) -> DataFrame:
    """What a run adds to the done table: the distinct (ver, creationdate, id) of its results."""
    return results.select("ver", "creationdate", "id").distinct()


def new_ids(golden: DataFrame, known: DataFrame) -> DataFrame:
    """Golden ids that the exclusion table does not hold yet."""
    return golden.select("id").distinct().join(known, "id", "left_anti")


def snippet_files(snippets: DataFrame, extension: Callable[[str], str] | None = None) -> DataFrame:
    """(file, src): the export name {row}_{id}.{ext} of each snippet, the row numbered within its post."""
    from ..complexity.languages import LANGUAGES

    ext = F.create_map(*(F.lit(x) for n, g in LANGUAGES.items() for x in (n, g.ext)))
    return snippets.select(F.concat_ws("_", F.col("row").cast("string"), F.concat(F.col("id").cast("string"), F.lit("."), F.try_element_at(ext, F.col("language")))).alias("file"), "src")


def gexf(edges: DataFrame, nodes: DataFrame, path: str) -> None:
    """A graph file (edges a, b, weight; nodes node) as a folder of text parts that, one after the other by name, are the file.

    Nodes and edges are numbered in their order over ranges, and tasks write the lines of a range; the first part begins with the head and
    the last one ends with the foot. Edges with an end that is no node are left out.
    """
    quoted = F.col("node")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        quoted = F.replace(quoted, F.lit(mark), F.lit(name))
    named = numbering.numbered(nodes.select("node").distinct(), [F.col("node")], "id")
    ends = edges.select("a", "b", F.col("weight").cast("double").cast("string").alias("weight")).join(named.select(F.col("node").alias("a"), F.col("id").alias("s")), "a").join(named.select(F.col("node").alias("b"), F.col("id").alias("t")), "b")
    placed = numbering.numbered(ends, [F.col("s"), F.col("t")], "id")
    line = lambda section, text: edges.sparkSession.range(1).select(F.lit(section).alias("section"), "id", F.lit(text).alias("value"))
    lines = line(0, '<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="undirected"><nodes>')
    lines = lines.unionByName(named.select(F.lit(1).alias("section"), "id", F.format_string('<node id="%d" label="%s"/>', F.col("id"), quoted).alias("value")))
    lines = lines.unionByName(line(2, "</nodes><edges>"))
    lines = lines.unionByName(placed.select(F.lit(3).alias("section"), "id", F.format_string('<edge id="%d" source="%d" target="%d" weight="%s"/>', "id", "s", "t", "weight").alias("value")))
    lines = lines.unionByName(line(4, "</edges></graph></gexf>"))
    lines.repartitionByRange("section", "id").sortWithinPartitions("section", "id").select("value").write.text(path)
