"""Sources, sinks and streams as registered queries: what is written is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import network
from ..sources import manifest, readers, writers
from ..sources.adapters import EVENT, metrics, posts, scratch, table, tags, votes
from ..streaming import daily
from .registry import query


def _folder(spark) -> str:
    return f"{scratch(spark)}/files-{uuid.uuid4().hex}"


def _post_rows(spark, d):
    return posts(spark, d).select(F.col("id").cast("int").alias("id"), F.date_format("creationdate", "yyyy-MM-dd'T'HH:mm:ss").alias("creationdate"), F.col("language").alias("title"), F.lit("<a><b>").alias("tags"), F.lit("é <p>").alias("body"))


_POSTS = "SELECT CAST(id AS INTEGER) AS id, strftime(creationdate, '%Y-%m-%dT%H:%M:%S') AS creationdate, language AS title, '<a><b>' AS tags, 'é <p>' AS body FROM posts"


@query("SRC3", _POSTS, "posts")
def json_folder(spark, d):
    """A folder of files that are arrays of objects, three or as many as the posts have splits."""
    f, rows = _folder(spark), _post_rows(spark, d)
    writers.json_arrays(rows.repartition(max(3, rows.rdd.getNumPartitions()), "id"), f)
    return readers.json_folder(spark, f, readers.schemas.QUESTIONS)


@query("SRC4", _POSTS, "posts")
def json_single(spark, d):
    """One file that is an array of objects."""
    f = _folder(spark)
    writers.json_arrays(_post_rows(spark, d).coalesce(1), f)
    return readers.json_file(spark, f"{f}/*.json", readers.schemas.QUESTIONS)


@query("SRC5", "SELECT CAST(id AS INTEGER) AS id, language AS title FROM posts", "posts")
def csv_columns(spark, d):
    f = _folder(spark)
    writers.csv(_post_rows(spark, d), f)
    return readers.csv_columns(spark, f, readers.schemas.QUESTIONS, ["id", "title"])


def _metric_rows(spark, d):
    name = F.concat(F.col("nloc").cast("string"), F.lit("_"), F.col("id").cast("string"), F.lit(".py"))
    return metrics(spark, d).select(F.lit("/x").alias("path"), name.alias("file_name"), F.lit("python").alias("language"), F.lit("f").alias("function_name"), F.col("cc").alias("cyclomatic_complexity"), "nloc", F.lit(1).alias("token_count"), F.lit(0).alias("parameter_count"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"))


@query("SRC6", "SELECT CAST(id AS INTEGER) AS id, cc AS cyclomatic_complexity, nloc FROM metrics", "metrics")
def metric_parquet(spark, d):
    f = _folder(spark)
    writers.chunked(_metric_rows(spark, d), f)
    return readers.complexity_parquet(spark, f).select("id", "cyclomatic_complexity", "nloc")


@query("SRC7", "SELECT CAST(id AS INTEGER) AS id, cc AS cyclomatic_complexity, nloc FROM metrics", "metrics")
def metric_lines(spark, d):
    f = _folder(spark)
    writers.json_lines(_metric_rows(spark, d), f)
    return readers.complexity_jsonl(spark, f).select("id", "cyclomatic_complexity", "nloc")


def _results(spark, d):
    return votes(spark, d).select(F.lit(50000).alias("ver"), F.lit("1998-06-03").alias("creationdate"), F.col("id").cast("int").alias("id"), F.concat(F.lit('said "'), F.col("label").cast("string"), F.lit('",\nnext line')).alias("result_long"), "draw")


@query("SRC8", "SELECT CAST(id AS INTEGER) AS id, 'q' AS question, '<Difficulty Level>' || label || '</Difficulty Level>' AS answer FROM votes WHERE draw = 1", "votes")
def golden(spark, d):
    f = _folder(spark)
    rows = votes(spark, d).where("draw = 1").select(F.col("id").cast("int").alias("id"), F.lit("q").alias("question"), F.concat(F.lit("<Difficulty Level>"), F.col("label").cast("string"), F.lit("</Difficulty Level>")).alias("answer"))
    writers.csv(rows, f)
    return readers.golden(spark, f)


@query("SRC9", "SELECT CAST(id AS INTEGER) AS id, 'said \"' || label || '\",' || chr(10) || 'next line' AS result_long FROM votes", "votes")
def one_version(spark, d):
    f = _folder(spark)
    writers.csv(_results(spark, d).drop("draw"), f)
    return readers.results(spark, f).select("id", "result_long")


@query("SRC10", "SELECT CAST(draw + 50000 AS INTEGER) AS run, count(*) AS n FROM votes GROUP BY 1", "votes")
def all_versions(spark, d):
    f = _folder(spark)
    for k in range(1, 6):
        writers.csv(_results(spark, d).where(F.col("draw") == k).drop("draw"), f"{f}/{50000 + k}")
    return readers.all_results(spark, f).groupBy("run").agg(F.count("*").alias("n"))


@query("SRC11", "SELECT CAST(a.id AS INTEGER) AS id, CAST(a.label AS VARCHAR) AS a_1, CAST(b.label AS VARCHAR) AS a_2 FROM votes a JOIN votes b ON a.id = b.id AND b.draw = 4 WHERE a.draw = 1", "votes")
def sheets(spark, d):
    f = _folder(spark)
    paths = []
    for k in (1, 4):
        paths.append(f"{f}/{k}")
        writers.csv(votes(spark, d).where(F.col("draw") == k).select(F.col("id").cast("int").alias("id"), F.col("label").cast("string").alias("answer")), paths[-1])
    return readers.annotators(spark, paths)


@query("SNK1", _POSTS, "posts")
def json_out(spark, d):
    f = _folder(spark)
    writers.json_lines(_post_rows(spark, d), f)
    return spark.read.schema(readers.schemas.QUESTIONS).json(f)


@query("SNK2", "SELECT id, label FROM votes WHERE draw = 3", "votes")
def json_lines(spark, d):
    f = _folder(spark)
    writers.json_lines(votes(spark, d).where("draw = 3").select("id", "label"), f)
    return spark.read.schema("id BIGINT, label INT").json(f)


@query("SNK4", "SELECT 1 AS files, count(*) AS n FROM votes WHERE draw = 3", "votes")
def joined_file(spark, d):
    f = _folder(spark)
    writers.one_file(votes(spark, d).where("draw = 3").select("id", "label"), f)
    rows = spark.read.schema("id BIGINT, label INT").json(f).select(F.col("_metadata.file_path").alias("p"))
    return rows.agg(F.count_distinct("p").cast("int").alias("files"), F.count("*").alias("n"))


@query("SNK6", "SELECT id, price FROM posts WHERE id % 100 = 0", "posts")
def created_view(spark, d):
    name = f"v_{uuid.uuid4().hex}"
    posts(spark, d).createOrReplaceTempView(f"{name}_p")
    spark.sql(f"CREATE TEMPORARY VIEW {name} AS SELECT id, price FROM {name}_p WHERE id % 100 = 0")
    return spark.table(name)


@query("SNK3", "SELECT CAST(draw AS VARCHAR) || '_' || id || '.py' AS file, CAST(label AS VARCHAR) AS src FROM votes", "votes")
def snippet_names(spark, d):
    rows = votes(spark, d).select(F.col("draw").alias("row"), "id", F.lit("python").alias("language"), F.col("label").cast("string").alias("src"))
    return writers.snippet_files(rows)


@query("SNK11", "WITH e AS (SELECT x.tag AS a, y.tag AS b, count(*) AS w FROM tags x JOIN tags y ON x.id = y.id AND x.tag < y.tag WHERE x.id IN (SELECT id FROM tags WHERE tag = 'Brand#5') GROUP BY 1, 2) SELECT 'node' AS kind, count(DISTINCT t) AS n, CAST(NULL AS DOUBLE) AS weight FROM (SELECT a AS t FROM e UNION SELECT b FROM e) UNION ALL SELECT 'edge', count(*), CAST(sum(w) AS DOUBLE) FROM e", "tags")
def graph_file(spark, d):
    """The nodes and edges of an ego network's graph file, read back as text."""
    f = f"{_folder(spark)}.gexf"
    edges = network.edges(network.pairs(network.ego(tags(spark, d), "Brand#5")))
    writers.gexf(edges, network.degrees(edges).select("node"), f)
    lines = spark.read.text(f).select(F.regexp_extract("value", "^<(node|edge) ", 1).alias("kind"), F.regexp_extract("value", 'weight="([^"]*)"', 1).try_cast("double").alias("weight"))
    return lines.where("kind != ''").groupBy("kind").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query("SNK7", "SELECT DISTINCT 50000 AS ver, '1998-06-03' AS creationdate, CAST(id AS INTEGER) AS id FROM votes", "votes")
def done(spark, d):
    return writers.done_rows(_results(spark, d))


@query("SNK8", "SELECT DISTINCT CAST(id AS INTEGER) AS id FROM votes WHERE id % 3 <> 0", "votes")
def excluded(spark, d):
    r = _results(spark, d)
    return writers.new_ids(r, r.where("id % 3 = 0").select("id").distinct())


@query("SNK9", "SELECT CAST(ceil(max(n) / 1000.0) AS INTEGER) > 0 AS ok, max(n) AS n FROM (SELECT count(*) AS n FROM metrics)", "metrics")
def chunks(spark, d):
    f = _folder(spark)
    writers.chunked(metrics(spark, d), f, 1000)
    files = spark.read.parquet(f).groupBy(F.col("_metadata.file_path").alias("p")).agg(F.count("*").alias("n"))
    return files.agg((F.max("n") <= 1000).alias("ok"), F.sum("n").alias("n"))


@query("SNK10", "SELECT id, label FROM votes WHERE draw = 2", "votes")
def csv_out(spark, d):
    f = _folder(spark)
    writers.csv(votes(spark, d).where("draw = 2").select("id", "label"), f)
    return readers.csv_columns(spark, f, "id BIGINT, label INT")


EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def _event_stream(spark, d):
    f = f"{_folder(spark)}/in"
    table(spark, d, "events").write.parquet(f)  # a stream reads a folder
    return daily.source(spark, f, EVENTS)


@query("SRC19", "SELECT * FROM (SELECT 'event' AS option, '1998-06-03' AS value UNION ALL SELECT 'first', strftime(min(o_orderdate), '%Y-%m-%d') FROM orders UNION ALL SELECT 'last', strftime(max(o_orderdate), '%Y-%m-%d') FROM orders UNION ALL SELECT 'posts', CAST(count(*) AS VARCHAR) FROM orders UNION ALL SELECT 'languages', '[\"' || string_agg(DISTINCT o_orderpriority, '\",\"' ORDER BY o_orderpriority) || '\"]' FROM orders)")
def run_manifest(spark, d):
    """A run's options and what its posts cover, written as JSON and read back as rows."""
    f = f"{_folder(spark)}/manifest.json"
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    seen = table(spark, d, "orders").agg(day(F.min("o_orderdate")).alias("first"), day(F.max("o_orderdate")).alias("last"), F.count("*").alias("posts"), F.array_sort(F.collect_set("o_orderpriority")).alias("languages")).first()
    manifest.write(f, {"event": EVENT, **seen.asDict()})
    return manifest.table(spark, f)


_DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def _database(spark, d):
    """Customers written to a database inside the JVM, which needs no server: a stand-in for a real one.

    Only the process that made it sees it, so this works in local mode and fails on executors of their own.
    """
    url = f"jdbc:derby:memory:db{uuid.uuid4().hex};create=true"
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").coalesce(2)
    writers.jdbc(rows, url, "customers", "app", "app", driver=_DERBY)
    return url


@query("SNK5", "SELECT c_custkey, c_name, c_acctbal FROM customer", "", "c_acctbal", 6)
def bulk_insert(spark, d):
    return readers.jdbc(spark, _database(spark, d), "customers", "app", "app", driver=_DERBY).load()


@query("SRC1", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 2 = 0 AND c_acctbal > 0", "", "c_acctbal", 6)
def database(spark, d):
    """A table read in four ranges of its key; columns and the filter on the balance reach the database."""
    top = table(spark, d, "customer").agg(F.max("c_custkey")).first()[0]
    rows = readers.jdbc(spark, _database(spark, d), "customers", "app", "app", split=("c_custkey", 0, top + 1, 4), driver=_DERBY).load()
    return rows.where((F.col("c_custkey") % 2 == 0) & (F.col("c_acctbal") > 0)).select("c_custkey", "c_acctbal")


@query("STREAM1", "SELECT event_type, CAST(floor(date_diff('day', DATE '2024-01-10', CAST(ts AS DATE)) / 7.0) AS INTEGER) AS bin, count(*) AS n, sum(value) AS v FROM events GROUP BY 1, 2", "", "v", 6)
def streamed_windows(spark, d):
    """Event-aligned weeks of a stream, complete; the batch result is the oracle."""
    name = f"weeks_{uuid.uuid4().hex}"
    stream = _event_stream(spark, d)
    weeks = daily.aligned_windows(stream, "ts", "2024-01-10", 7, "1 day", "event_type", n=F.count("*"), v=F.sum("value"))
    q = weeks.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@query("STREAM2", "SELECT event_id, value * 2 AS v FROM events", "", "v", 6)
def resumable(spark, d):
    """Daily work that skips what is done: run, run again, and run from a new checkpoint."""
    f, stream = _folder(spark), _event_stream(spark, d)
    for state in ("first", "first", "second"):
        q = daily.run_available(stream, lambda b: b.select("event_id", (F.col("value") * 2).alias("v")), f"{f}/done", f"{f}/out", f"{f}/{state}", "event_id")
        q.awaitTermination()
    return spark.read.parquet(f"{f}/out").select("event_id", "v")
