"""Scans, filters, joins, aggregations, windows, samples and set operations as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, numbers
from ..functions import text as text_functions
from ..operators import annotation, distributions, quantiles, rollups
from ..sources import calendar
from ..sources.adapters import EVENT, metrics, posts, table, tag_sets, tags, votes
from .registry import query


def dated(spark: SparkSession, d: str) -> DataFrame:
    """posts with days and w, the day and the week from the event."""
    return posts(spark, d).withColumn("days", dates.days_since(F.col("creationdate"), EVENT)).withColumn("w", dates.rel_bin(F.col("creationdate"), EVENT))


def pm(spark: SparkSession, d: str) -> DataFrame:
    """Function metrics with their post's date and language."""
    return metrics(spark, d).join(dated(spark, d).select("id", "creationdate", "language", "days", "w"), "id")


def pt(spark: SparkSession, d: str) -> DataFrame:
    """Tags with their post's date; pct is the tag's fraction of the post."""
    rows = tag_sets(spark, d).select("id", (1 / F.size("tags")).alias("pct"), F.explode("tags").alias("tag"))
    return rows.join(dated(spark, d).select("id", "creationdate", "language", "days", "w"), "id")


def panel(spark: SparkSession, d: str) -> DataFrame:
    return rollups.panel(pm(spark, d), F.col("w"))


def weekly(spark: SparkSession, d: str) -> DataFrame:
    """(t, y, n_func) over all languages."""
    return pm(spark, d).groupBy(F.col("w").alias("t")).agg(F.avg(F.log1p("cc")).alias("y"), F.count("*").alias("n_func"))


# ---- sources and calendars


@query("SRC2", "SELECT id, price FROM posts WHERE price > 300000 AND language = '1-URGENT'", "posts")
def parameterised_sql(spark, d):
    posts(spark, d).createOrReplaceTempView("posts_view")
    return spark.sql("SELECT id, price FROM posts_view WHERE price > :low AND language = :lang", args={"low": 300000.0, "lang": "1-URGENT"})


@query("SRC12", "SELECT id FROM posts WHERE creationdate >= TIMESTAMP '1998-01-01' AND creationdate < TIMESTAMP '1998-02-01'", "posts")
def pruned_range(spark, d):
    return posts(spark, d).where((F.col("creationdate") >= F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("creationdate") < F.lit("1998-02-01").cast("timestamp_ntz"))).select("id")


@query("SRC13", "SELECT language, CAST(floor(days / 28.0) AS INTEGER) AS win28, count(*) AS n FROM dated GROUP BY 1, 2", "dated")
def window_partitions(spark, d):
    return calendar.windows(posts(spark, d), "creationdate", EVENT).groupBy("language", "win28").agg(F.count("*").alias("n"))


def _span(spark, d):
    return calendar.span(posts(spark, d), "creationdate")


_SPAN = "sp AS (SELECT min(CAST(creationdate AS DATE)) AS first, max(CAST(creationdate AS DATE)) AS last FROM posts)"


def _window_start(days: int):
    return F.date_add(F.lit(EVENT).cast("date"), dates.rel_bin(F.col("creationdate"), EVENT, days) * days)


@query("SRC14", f"WITH {_SPAN}, g AS (SELECT CAST(x AS DATE) AS day FROM (SELECT unnest(generate_series(TIMESTAMP '{EVENT}' - INTERVAL 104 WEEK, TIMESTAMP '{EVENT}' + INTERVAL 104 WEEK, INTERVAL 28 DAY)) AS x)), c AS (SELECT DATE '{EVENT}' + CAST(floor(days / 28.0) AS INTEGER) * 28 AS day, count(*) AS n FROM dated GROUP BY 1) SELECT g.day, coalesce(n, 0) AS n FROM g JOIN sp ON g.day + 28 > first AND g.day <= last LEFT JOIN c ON c.day = g.day", "dated")
def four_weeks(spark, d):
    """The windows of four weeks that the posts meet, with their posts."""
    return calendar.with_counts(calendar.every_28_days(_span(spark, d), EVENT, 104, 104), posts(spark, d), _window_start(28))


@query("SRC15", f"WITH {_SPAN}, g AS (SELECT CAST(unnest(generate_series(DATE '{EVENT}' - CAST(floor((DATE '{EVENT}' - first) / 28.0) AS INTEGER) * 28, DATE '{EVENT}' + (CAST(floor((last - DATE '{EVENT}') / 28.0) AS INTEGER) + 1) * 28, INTERVAL 28 DAY)) AS DATE) AS day FROM sp), c AS (SELECT DATE '{EVENT}' + CAST(floor(days / 28.0) AS INTEGER) * 28 AS day, count(*) AS n FROM dated GROUP BY 1) SELECT g.day, coalesce(n, 0) AS n FROM g LEFT JOIN c ON c.day = g.day", "dated")
def around_event(spark, d):
    return calendar.with_counts(calendar.around(_span(spark, d), EVENT, 28), posts(spark, d), _window_start(28))


@query("SRC16", f"WITH {_SPAN}, g AS (SELECT CAST(unnest(generate_series(date_trunc('month', first), date_trunc('month', last), INTERVAL 1 MONTH)) AS DATE) AS day FROM sp), c AS (SELECT CAST(date_trunc('month', creationdate) AS DATE) AS day, count(*) AS n FROM posts GROUP BY 1) SELECT g.day, coalesce(n, 0) AS n FROM g LEFT JOIN c ON c.day = g.day", "posts")
def months(spark, d):
    return calendar.with_counts(calendar.monthly(_span(spark, d)), posts(spark, d), F.trunc(F.to_date("creationdate"), "month"))


@query("SRC17", f"WITH {_SPAN}, g AS (SELECT CAST(unnest(generate_series(date_trunc('month', first), date_trunc('month', last), INTERVAL 1 MONTH)) AS DATE) AS day_from FROM sp) SELECT day_from, day_from + 30 AS day_to, count(id) AS n FROM g LEFT JOIN posts ON CAST(creationdate AS DATE) BETWEEN day_from AND day_from + 30 GROUP BY 1, 2", "posts")
def month_days(spark, d):
    """Windows of 31 days from each month's first day, with their posts: a day lies in its month's window and may lie in that of the month before."""
    per_day = posts(spark, d).groupBy(F.to_date("creationdate").alias("day")).agg(F.count("*").alias("k"))
    month = F.trunc("day", "month")
    near = per_day.select("day", "k", F.explode(F.array(month, F.add_months(month, -1))).alias("m")).where(F.datediff("day", "m") <= 30)
    counts = near.groupBy(F.col("m").alias("day_from")).agg(F.sum("k").alias("n"))
    return calendar.month_windows(_span(spark, d), 30).join(counts, "day_from", "left").fillna(0, ["n"])


@query("SRC18", f"WITH {_SPAN}, g AS (SELECT CAST(unnest(generate_series(first, last, INTERVAL 1 DAY)) AS DATE) AS day FROM sp), c AS (SELECT CAST(creationdate AS DATE) AS day, count(*) AS n FROM posts GROUP BY 1) SELECT g.day, CAST(year(g.day) AS INTEGER) AS year, coalesce(n, 0) AS n FROM g LEFT JOIN c ON c.day = g.day", "posts")
def days(spark, d):
    """Every day that the posts span, without gaps, with its posts."""
    return calendar.with_counts(calendar.calendar(_span(spark, d)), posts(spark, d), F.to_date("creationdate"))


# ---- filters and projections


@query("FLT1", "SELECT p_partkey FROM part WHERE p_name LIKE '%ring%'")
def contains(spark, d):
    return table(spark, d, "part").where(F.col("p_name").contains("ring")).select("p_partkey")


@query("FLT2", "SELECT id FROM posts WHERE creationdate >= TIMESTAMP '1997-01-01' AND creationdate < TIMESTAMP '1997-03-01'", "posts")
def half_open(spark, d):
    return posts(spark, d).where((F.col("creationdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("creationdate") < F.lit("1997-03-01").cast("timestamp_ntz"))).select("id")


@query("FLT3", "SELECT id FROM posts WHERE creationdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-03-01'", "posts")
def closed(spark, d):
    return posts(spark, d).where(F.col("creationdate").between(F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("1997-03-01").cast("timestamp_ntz"))).select("id")


@query("FLT4", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND (isodow(ts) - 1) IN (0, 2, 4)")
def range_and_weekdays(spark, d):
    ts = F.col("ts")
    return table(spark, d, "events").where((ts >= F.lit("2024-01-05").cast("timestamp_ntz")) & (ts < F.lit("2024-01-20").cast("timestamp_ntz")) & F.weekday(ts).isin(0, 2, 4)).select("event_id")


@query("FLT5", "SELECT event_id, isodow(ts) < 6 AS workday FROM events")
def workday(spark, d):
    return table(spark, d, "events").select("event_id", dates.is_workday(F.col("ts")).alias("workday"))


@query("FLT6", "SELECT vec_id, label FROM embeddings WHERE label IN (1, 3, 5)")
def topics_in(spark, d):
    return table(spark, d, "embeddings").where(F.col("label").isin(1, 3, 5)).select("vec_id", "label")


@query("FLT7", "SELECT DISTINCT id FROM tags WHERE tag IN ('Brand#1', 'Brand#7')", "tags")
def tags_overlap(spark, d):
    sets = tags(spark, d).groupBy("id").agg(F.collect_set("tag").alias("t"))
    return sets.where(F.arrays_overlap("t", F.array(F.lit("Brand#1"), F.lit("Brand#7")))).select("id")


@query("FLT8", "SELECT id FROM votes WHERE label IN (0, 2) GROUP BY id", "votes")
def levels_in(spark, d):
    return votes(spark, d).where(F.col("label").isin(0, 2)).select("id").distinct()


def _tag_text(spark, d):
    return tags(spark, d).groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_set("tag")), lambda t: F.concat(F.lit("<"), t, F.lit(">"))), "").alias("tags"))


@query("FLT9", "SELECT DISTINCT id FROM tags WHERE tag IN ('Brand#2', 'Brand#3')", "tags")
def tag_text_filter(spark, d):
    return _tag_text(spark, d).where(text_functions.any_tag(F.col("tags"), ["Brand#2", "Brand#3"])).select("id")


@query("STR17", "SELECT DISTINCT id FROM tags WHERE tag IN ('Brand#4', 'c++', '.net', 'a|b')", "tags")
def escaped_names(spark, d):
    """Names that a pattern would read as its own signs."""
    return _tag_text(spark, d).where(text_functions.any_tag(F.col("tags"), ["Brand#4", "c++", ".net", "a|b"])).select("id")


@query("FLT10", "SELECT doc_id FROM documents WHERE source = 'src1'")
def topic_equal(spark, d):
    return table(spark, d, "documents").where(F.col("source") == "src1").select("doc_id")


@query("FLT10_tags", "SELECT DISTINCT id FROM tags WHERE tag = 'Brand#7'", "tags")
def tag_equal(spark, d):
    return _tag_text(spark, d).where(text_functions.has_tag(F.col("tags"), "Brand#7")).select("id")


@query("FLT11", "SELECT id, nloc, cc FROM metrics WHERE cc > 0 AND nloc IS NOT NULL", "metrics")
def guards(spark, d):
    return metrics(spark, d).where("cc > 0").dropna(subset=["nloc"]).select("id", "nloc", "cc")


@query("FLT12", "SELECT id FROM posts WHERE language IN ('1-URGENT', '5-LOW')", "posts")
def supported(spark, d):
    return posts(spark, d).where(F.col("language").isin("1-URGENT", "5-LOW")).select("id")


@query("FLT13", "SELECT language, rel_week, n_func, y FROM (SELECT *, sum(n_func) OVER (PARTITION BY language) AS a FROM panel) WHERE a >= 1000 AND n_func >= 30", "panel", "y")
def min_support(spark, d):
    return rollups.panel(pm(spark, d), F.col("w"), min_cell=30, min_entity=1000).select("language", "rel_week", "n_func", "y")


@query("FLT14", "SELECT language, rel_week FROM (SELECT *, count(*) FILTER (rel_week < 0) OVER (PARTITION BY language) AS a, count(*) FILTER (rel_week >= 0) OVER (PARTITION BY language) AS b FROM panel) WHERE a >= 50 AND b >= 50", "panel")
def coverage(spark, d):
    return rollups.covered(panel(spark, d)).select("language", "rel_week")


@query("FLT15", "SELECT language, rel_week FROM panel WHERE rel_week >= -52 AND rel_week <= 52", "panel")
def symmetric(spark, d):
    return panel(spark, d).where(F.col("rel_week").between(-52, 52)).select("language", "rel_week")


@query("FLT16", "SELECT id, CAST(floor((date_diff('day', DATE '1998-06-03', CAST(date_trunc('week', creationdate) AS DATE)) / 7.0) / 4) AS INTEGER) AS event_bin FROM posts WHERE floor((date_diff('day', DATE '1998-06-03', CAST(date_trunc('week', creationdate) AS DATE)) / 7.0) / 4) BETWEEN -28 AND 39", "posts")
def clamp_bins(spark, d):
    return posts(spark, d).select("id", dates.event_bin(F.col("creationdate"), EVENT).alias("event_bin")).where(F.col("event_bin").between(-28, 39))


@query("FLT17", "SELECT id, label, count(*) AS votes FROM votes GROUP BY 1, 2 HAVING count(*) = 5", "votes")
def self_consistent(spark, d):
    return annotation.consistent(votes(spark, d), 5)


@query("FLT18", "SELECT id FROM votes GROUP BY id HAVING count(DISTINCT label) = 1", "votes")
def unanimous(spark, d):
    return annotation.unanimous(votes(spark, d))


@query("FLT19", "SELECT id FROM posts WHERE creationdate < TIMESTAMP '1998-06-03'", "posts")
def placebo_rows(spark, d):
    return posts(spark, d).where(F.col("creationdate") < F.lit(EVENT).cast("timestamp_ntz")).select("id")


@query("FLT20", "WITH c AS (SELECT language, CAST(floor(days / 28.0) AS INTEGER) AS bin, count(*) AS n_func FROM pm GROUP BY 1, 2 HAVING count(*) >= 50), s AS (SELECT bin FROM c GROUP BY bin HAVING count(DISTINCT language) >= 5) SELECT language, bin, n_func FROM c WHERE bin IN (SELECT bin FROM s)", "pm")
def bins_covered(spark, d):
    cells = pm(spark, d).groupBy("language", F.floor(F.col("days") / 28).cast("int").alias("bin")).agg(F.count("*").alias("n_func"))
    return rollups.bin_covered(cells, "bin", "language", 5, 50).select("language", "bin", "n_func")


@query("FLT20_ref", "SELECT CAST(coalesce(max(w) FILTER (w = -1), max(w) FILTER (w < 0)) AS INTEGER) AS ref_bin FROM pm", "pm")
def ref_bin(spark, d):
    return pm(spark, d).agg(rollups.reference_bin(None, "w").alias("ref_bin"))


@query("PRJ2", "SELECT id, CASE label WHEN 0 THEN 'Basic' WHEN 1 THEN 'Intermediate' ELSE 'Advanced' END AS level FROM votes WHERE draw = 1", "votes")
def level_names(spark, d):
    return votes(spark, d).where("draw = 1").select("id", F.when(F.col("label") == 0, "Basic").when(F.col("label") == 1, "Intermediate").otherwise("Advanced").alias("level"))


@query("PRJ1", "SELECT m.id, m.cc, p.creationdate FROM metrics m JOIN posts p ON m.id = p.id", "metrics posts")
def project_after_join(spark, d):
    return metrics(spark, d).join(posts(spark, d), "id").select("id", "cc", "creationdate")


@query("PRJ3", "SELECT id, CASE language WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '5-LOW' THEN 'low' END AS display FROM posts", "posts")
def lookup(spark, d):
    names = F.create_map(*map(F.lit, ("1-URGENT", "urgent", "2-HIGH", "high", "5-LOW", "low")))
    return posts(spark, d).select("id", F.try_element_at(names, F.col("language")).alias("display"))


@query("PRJ4", "SELECT label AS topic, count(*) AS n FROM embeddings WHERE label IN (0, 2) GROUP BY 1")
def some_topics(spark, d):
    return table(spark, d, "embeddings").groupBy(F.col("label").alias("topic")).agg(F.count("*").alias("n")).where(F.col("topic").isin(0, 2))


# ---- joins


@query("JOI1", "SELECT p.id, m.cc FROM posts p, metrics m WHERE p.id = m.id", "posts metrics")
def inner(spark, d):
    return posts(spark, d).join(metrics(spark, d), "id").select("id", "cc")


@query("JOI2", "SELECT id FROM posts p WHERE NOT EXISTS (SELECT 1 FROM metrics m WHERE m.id = p.id)", "posts metrics")
def anti(spark, d):
    return posts(spark, d).join(metrics(spark, d), "id", "left_anti").select("id")


@query("JOI3", "SELECT id FROM posts p WHERE NOT EXISTS (SELECT 1 FROM metrics m WHERE m.id = p.id AND m.cc > 25) AND NOT EXISTS (SELECT 1 FROM metrics m WHERE m.id = p.id AND m.nloc = 3)", "posts metrics")
def two_anti(spark, d):
    m = metrics(spark, d)
    return posts(spark, d).join(m.where("cc > 25"), "id", "left_anti").join(m.where("nloc = 3"), "id", "left_anti").select("id")


@query("JOI4", "SELECT id, nloc FROM metrics m WHERE NOT EXISTS (SELECT 1 FROM metrics x WHERE x.id = m.id AND x.nloc = m.nloc AND x.cc > 25)", "metrics")
def anti_two_keys(spark, d):
    m = metrics(spark, d)
    return m.join(m.where("cc > 25").select("id", "nloc"), ["id", "nloc"], "left_anti").select("id", "nloc")


_TARGET = "t AS (SELECT id, creationdate, 50000 AS ver FROM posts), dn AS (SELECT id, ver FROM t WHERE id % 7 <> 0)"


def _next_day(spark, d):
    target = posts(spark, d).select("id", "creationdate", F.lit(50000).alias("ver"))
    return target, annotation.next_open_day(target, target.where("id % 7 != 0"), F.to_date("creationdate"))


@query("JOI5", f"WITH {_TARGET}, o AS (SELECT ver, CAST(creationdate AS DATE) AS day, count(*) AS open FROM t WHERE NOT EXISTS (SELECT 1 FROM dn WHERE dn.id = t.id AND dn.ver = t.ver) GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 1) SELECT t.id, o.ver, o.day FROM t JOIN o ON t.ver = o.ver AND CAST(t.creationdate AS DATE) = o.day", "posts")
def next_day_rows(spark, d):
    target, day = _next_day(spark, d)
    return target.withColumn("day", F.to_date("creationdate")).join(F.broadcast(day), ["ver", "day"]).select("id", "ver", "day")


@query("JOI6", f"WITH {_TARGET}, o AS (SELECT ver, CAST(creationdate AS DATE) AS day FROM t WHERE NOT EXISTS (SELECT 1 FROM dn WHERE dn.id = t.id AND dn.ver = t.ver) GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 1) SELECT t.id, p.price, m.cc FROM t JOIN o ON t.ver = o.ver AND CAST(t.creationdate AS DATE) = o.day JOIN posts p ON p.id = t.id JOIN metrics m ON m.id = t.id", "posts metrics")
def four_way(spark, d):
    target, day = _next_day(spark, d)
    rows = target.withColumn("day", F.to_date("creationdate")).join(F.broadcast(day), ["ver", "day"]).select("id")
    return rows.join(posts(spark, d), "id").join(metrics(spark, d), "id").select("id", "price", "cc")


@query("JOI8", "SELECT p.id, m.cc FROM posts p LEFT JOIN metrics m ON m.id = p.id AND m.nloc = 1", "posts metrics")
def left(spark, d):
    return posts(spark, d).select("id").join(metrics(spark, d).where("nloc = 1"), "id", "left").select("id", "cc")


@query("JOI9", "WITH c AS (SELECT w, language, count(*) AS n FROM pm WHERE language <> '5-LOW' OR w % 2 = 0 GROUP BY 1, 2), g AS (SELECT * FROM (SELECT DISTINCT w FROM c) CROSS JOIN (SELECT DISTINCT language FROM c)) SELECT g.w, g.language, coalesce(c.n, 0) AS n FROM g LEFT JOIN c ON g.w = c.w AND g.language = c.language", "pm")
def completed_grid(spark, d):
    cells = pm(spark, d).where("language != '5-LOW' or w % 2 = 0").groupBy("w", "language").agg(F.count("*").alias("n"))
    return rollups.grid(cells, "w", "language", ["n"], 0)


@query("JOI10", "WITH c AS (SELECT c_nationkey AS nation, CAST(year(o_orderdate) * 10 + quarter(o_orderdate) AS INTEGER) AS q, count(DISTINCT o_custkey) AS pushers FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), g AS (SELECT * FROM (SELECT DISTINCT nation FROM c) CROSS JOIN (SELECT DISTINCT q FROM c)) SELECT g.nation, g.q, coalesce(c.pushers, 0) AS pushers FROM g LEFT JOIN c ON g.nation = c.nation AND g.q = c.q")
def quarter_grid(spark, d):
    return rollups.grid(_pushers(spark, d), "nation", "q", ["pushers"], 0)


def _pushers(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey)
    return rows.groupBy(F.col("c_nationkey").alias("nation"), (F.year("o_orderdate") * 10 + F.quarter("o_orderdate")).cast("int").alias("q")).agg(F.count_distinct("o_custkey").alias("pushers"))


@query("JOI11", "SELECT language, w, n, 100.0 * n / sum(n) OVER (PARTITION BY w) AS share FROM (SELECT language, w, count(*) AS n FROM pm GROUP BY 1, 2)", "pm", "share")
def part_of_total(spark, d):
    return rollups.shares(pm(spark, d), ["w"], "language").select("language", "w", "n", "share")


@query("JOI13", "SELECT a.id, a.label AS a_1, b.label AS a_2, c.label AS a_3, e.label AS a_4 FROM votes a JOIN votes b ON a.id = b.id AND b.draw = 2 JOIN votes c ON a.id = c.id AND c.draw = 3 JOIN votes e ON a.id = e.id AND e.draw = 4 WHERE a.draw = 1", "votes")
def raters_wide(spark, d):
    """Four raters side by side: one aggregation by id in place of three joins."""
    names = [f"a_{k}" for k in range(1, 5)]
    wide = votes(spark, d).where("draw <= 4").groupBy("id").agg(*(F.max(F.when(F.col("draw") == k, F.col("label"))).alias(n) for k, n in enumerate(names, 1)))
    return wide.dropna(subset=names)


@query("JOI14", "SELECT id FROM posts WHERE id IN (SELECT id FROM metrics WHERE cc = 50)", "posts metrics")
def semi(spark, d):
    return posts(spark, d).join(metrics(spark, d).where("cc = 50"), "id", "left_semi").select("id")


@query("JOI15", "WITH f AS (SELECT language, CAST(year(creationdate) AS INTEGER) AS y, min(creationdate) AS lo, max(creationdate) AS hi FROM posts GROUP BY 1, 2) SELECT language, y FROM f WHERE hi >= TIMESTAMP '1996-06-01' AND lo <= TIMESTAMP '1998-02-01'", "posts")
def overlap(spark, d):
    files = posts(spark, d).groupBy("language", F.year("creationdate").alias("y")).agg(F.min("creationdate").alias("lo"), F.max("creationdate").alias("hi"))
    return files.where((F.col("hi") >= F.lit("1996-06-01").cast("timestamp_ntz")) & (F.col("lo") <= F.lit("1998-02-01").cast("timestamp_ntz"))).select("language", "y")


@query("JOI16", "WITH a AS (SELECT id, max(cc) AS v FROM metrics GROUP BY id), b AS (SELECT id, max(cc) AS v FROM metrics WHERE nloc <> 2 GROUP BY id) SELECT a.id, a.v AS v_x, b.v AS v_y FROM a LEFT JOIN b ON a.id = b.id WHERE a.v IS DISTINCT FROM b.v", "metrics")
def run_diff(spark, d):
    m = metrics(spark, d)
    a, b = m.groupBy("id").agg(F.max("cc").alias("v_x")), m.where("nloc != 2").groupBy("id").agg(F.max("cc").alias("v_y"))
    return a.join(b, "id", "left").where(~F.col("v_x").eqNullSafe(F.col("v_y")))


@query("JOI7", "SELECT id, count(*) AS n, max(days) AS days FROM pm GROUP BY id", "pm")
def metrics_of_posts(spark, d):
    return pm(spark, d).groupBy("id").agg(F.count("*").alias("n"), F.max("days").cast("long").alias("days"))


@query("JOI17", "WITH r AS (SELECT language, avg(y) AS effect FROM panel GROUP BY 1), i AS (SELECT language, count(*) AS posts, ln(1 + count(*)) AS intensity FROM dated WHERE days < 0 GROUP BY 1) SELECT r.language, effect, posts, intensity FROM r JOIN i ON r.language = i.language", "panel dated", "effect intensity")
def with_intensity(spark, d):
    effects = panel(spark, d).groupBy("language").agg(F.avg("y").alias("effect"))
    intensity = dated(spark, d).where("days < 0").groupBy("language").agg(F.count("*").alias("posts"), F.log1p(F.count("*")).alias("intensity"))
    return effects.join(intensity, "language")


# ---- aggregations


@query("AGG1", "SELECT count(*) AS n, min(strftime(creationdate, '%Y-%m-%d')) AS first_day FROM posts", "posts")
def scalar(spark, d):
    return posts(spark, d).agg(F.count("*").alias("n"), F.min(dates.day_text(F.col("creationdate"))).alias("first_day"))


for _option, _sql in {"mean": "avg(ln(1 + cc))", "max": "max(ln(1 + cc))", "std": "stddev_samp(ln(1 + cc))", "median": "median(ln(1 + cc))", "sum": "sum(ln(1 + cc))"}.items():

    def _rollup(spark, d, option=_option):
        return rollups.per_post(metrics(spark, d), option)

    query("AGG3" if _option == "median" else f"AGG2_{_option}", f"SELECT id, {_sql} AS value FROM metrics GROUP BY id", "metrics", "value")(lambda spark, d, f=_rollup: f(spark, d))


@query("AGG4", "SELECT t, y, n_func FROM weekly", "weekly", "y")
def weekly_mean(spark, d):
    return weekly(spark, d)


@query("AGG5", "SELECT w, stddev_samp(ln(1 + cc)) AS sd, var_samp(ln(1 + cc)) AS vr FROM pm GROUP BY w", "pm", "sd vr")
def weekly_dispersion(spark, d):
    return rollups.by_bin(pm(spark, d), F.col("w"), "w", sd=F.stddev_samp(F.log1p("cc")), vr=F.var_samp(F.log1p("cc")))


@query("AGG6", "SELECT w, avg(v) AS y FROM (SELECT id, w, max(ln(1 + cc)) AS v FROM pm GROUP BY 1, 2) GROUP BY w", "pm", "y")
def two_levels(spark, d):
    return pm(spark, d).groupBy("id", "w").agg(F.max(F.log1p("cc")).alias("v")).groupBy("w").agg(F.avg("v").alias("y"))


@query("AGG7", "SELECT language, w AS rel_week, avg(ln(1 + cc)) AS y, stddev_samp(ln(1 + cc)) AS y_sd, avg(cc) AS raw_mean, stddev_samp(cc) AS raw_sd, count(*) AS n_func FROM pm GROUP BY 1, 2", "pm", "y y_sd raw_mean raw_sd")
def full_panel(spark, d):
    return panel(spark, d)


@query("AGG8", "SELECT CAST(floor(days / 28.0) AS INTEGER) AS bin, avg(ln(1 + cc)) AS y FROM pm GROUP BY 1", "pm", "y")
def four_week_mean(spark, d):
    return rollups.by_bin(pm(spark, d), dates.rel_bin(F.col("creationdate"), EVENT, 28), "bin", y=F.avg(F.log1p("cc")))


@query("AGG9", "SELECT rel_week, count(*) AS n_obs, count(DISTINCT language) AS n_lang, CAST(sum(n_func) AS BIGINT) AS total_func FROM panel GROUP BY 1", "panel")
def bin_diagnostics(spark, d):
    return panel(spark, d).groupBy("rel_week").agg(F.count("*").alias("n_obs"), F.count_distinct("language").alias("n_lang"), F.sum("n_func").alias("total_func"))


@query("AGG10", "SELECT language, count(cc) AS count, avg(cc) AS mean, stddev_samp(cc) AS std, min(cc) AS min, quantile_cont(cc, 0.25) AS q25, quantile_cont(cc, 0.5) AS q50, quantile_cont(cc, 0.75) AS q75, max(cc) AS max FROM pm GROUP BY 1", "pm", "mean std q25 q50 q75")
def described(spark, d):
    return rollups.describe(pm(spark, d), "cc", ["language"])


@query("AGG11", "SELECT language, tag, count(DISTINCT id) AS posts FROM pt GROUP BY 1, 2", "pt")
def distinct_posts(spark, d):
    # A post's tags are distinct in its row, so the rows of a post and language count once; no table of all posts by tag is held.
    sets = tag_sets(spark, d).join(posts(spark, d).select("id", "language").distinct(), "id")
    return sets.select("language", F.explode("tags").alias("tag")).groupBy("language", "tag").agg(F.count("*").alias("posts"))


@query("AGG12", "SELECT language, count(*) AS n FROM posts GROUP BY 1", "posts")
def value_counts(spark, d):
    return posts(spark, d).groupBy("language").agg(F.count("*").alias("n"))


@query("AGG13", "SELECT DISTINCT language, CAST(year(creationdate) AS INTEGER) AS year FROM posts", "posts")
def distinct(spark, d):
    return posts(spark, d).select("language", F.year("creationdate").alias("year")).distinct()


_LEVELS = "lv AS (SELECT v.id, v.label, d.w FROM (SELECT id, label FROM votes GROUP BY 1, 2 HAVING count(*) = 5 OR count(*) = 3) v JOIN (SELECT id, CAST(floor(days / 7.0) AS INTEGER) AS w FROM dated) d ON v.id = d.id)"


def _levels(spark, d):
    v = votes(spark, d).groupBy("id", "label").agg(F.count("*").alias("k")).where("k in (3, 5)").select("id", "label")
    return v.join(dated(spark, d).select("id", "w"), "id")


@query("AGG14", f"WITH {_LEVELS} SELECT w, label, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY w) AS share FROM lv GROUP BY w, label", "votes dated", "share")
def weekly_level_share(spark, d):
    return rollups.shares(_levels(spark, d), ["w"], "label").select("w", "label", "n", "share")


@query("AGG15", "SELECT w, tag, sum(pct) AS n, 100 * sum(pct) / sum(sum(pct)) OVER (PARTITION BY w) AS share FROM pt GROUP BY w, tag", "pt", "n share")
def weighted_share(spark, d):
    return rollups.shares(pt(spark, d), ["w"], "tag", F.col("pct"))


@query("AGG16", "WITH d AS (SELECT unnest(range(0, 50))::INTEGER AS topic) SELECT d.topic, count(e.vec_id) AS n FROM d LEFT JOIN embeddings e ON e.label = d.topic GROUP BY 1")
def hard_topics(spark, d):
    return distributions.hard_counts(table(spark, d, "embeddings").withColumnRenamed("label", "topic"), [], "topic", spark.range(50).select(F.col("id").cast("int").alias("topic")))


@query("AGG17", "SELECT CAST(i - 1 AS INTEGER) AS topic, sum(CAST(embedding[i] AS DOUBLE)) AS n FROM (SELECT embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1", "", "n", 4)
def soft_topics(spark, d):
    rows = table(spark, d, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("topic_info"))
    return distributions.topic_counts(rows, [])


@query("AGG19", "SELECT tag, count(DISTINCT id) AS n FROM tags GROUP BY tag", "tags")
def tag_counts(spark, d):
    lists = tags(spark, d).groupBy("id").agg(F.collect_list("tag").alias("t"))
    return lists.select(F.explode(F.array_distinct("t")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("AGG20", "SELECT CAST(floor(days / 28.0) AS INTEGER) AS win28, tag, count(*) AS n FROM pt GROUP BY 1, 2", "pt")
def monthly_tags(spark, d):
    return pt(spark, d).groupBy(dates.rel_bin(F.col("creationdate"), EVENT, 28).alias("win28"), "tag").agg(F.count("*").alias("n"))


@query("AGG21", "SELECT tag, n, n / sum(n) OVER () AS p FROM (SELECT tag, count(*) AS n FROM tags GROUP BY 1)", "tags", "p")
def fractional(spark, d):
    return distributions.fractions(tags(spark, d).groupBy("tag").agg(F.count("*").alias("n")), [])


@query("AGG22", "SELECT CAST(floor(days / 28.0) AS INTEGER) AS win28, tag, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY floor(days / 28.0)) AS p FROM pt GROUP BY floor(days / 28.0), tag", "pt", "p")
def windowed_fractions(spark, d):
    counts = pt(spark, d).groupBy(dates.rel_bin(F.col("creationdate"), EVENT, 28).alias("win28"), "tag").agg(F.count("*").alias("n"))
    return distributions.fractions(counts, ["win28"])


_TW = "c AS (SELECT w, tag, count(*) AS n FROM pt GROUP BY 1, 2)"


def _tag_weeks(spark, d):
    return pt(spark, d).groupBy("w", "tag").agg(F.count("*").alias("n"))


@query("AGG23", f"WITH {_TW} SELECT a.w, avg(abs(a.n - b.n)) / 2 / max(m.v) AS gini FROM c a JOIN c b ON a.w = b.w JOIN (SELECT w, avg(n) AS v FROM c GROUP BY 1) m ON m.w = a.w GROUP BY a.w", "pt", "gini")
def gini(spark, d):
    return distributions.gini(_tag_weeks(spark, d), ["w"], "n")


@query("AGG24", f"WITH {_TW}, p AS (SELECT w, n / sum(n) OVER (PARTITION BY w) AS p FROM c) SELECT w, -sum(p * ln(p)) AS entropy FROM p GROUP BY w", "pt", "entropy")
def entropy(spark, d):
    return distributions.entropy(_tag_weeks(spark, d), ["w"], "n")


@query("AGG25", "WITH c AS (SELECT cc, count(*) AS n FROM metrics GROUP BY 1), p AS (SELECT cc, n, n / sum(n) OVER () AS p FROM c) SELECT cc, n, p, coalesce(sum(p) OVER (ORDER BY cc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cdf, 1 - coalesce(sum(p) OVER (ORDER BY cc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ccdf FROM p", "metrics", "p cdf ccdf")
def cumulative(spark, d):
    return distributions.cdf(distributions.fractions(metrics(spark, d).groupBy("cc").agg(F.count("*").alias("n")), []), [], "cc")


@query("AGG26", "SELECT rel_week, sum(n_func * y) / sum(n_func) AS y FROM panel GROUP BY 1", "panel", "y")
def weighted_mean(spark, d):
    return panel(spark, d).groupBy("rel_week").agg(rollups.weighted_mean("y", "n_func").alias("y"))


@query("AGG27", "WITH m AS (SELECT *, sum(y * n_func) OVER (PARTITION BY rel_week) / sum(n_func) OVER (PARTITION BY rel_week) AS mean FROM panel) SELECT rel_week, max(mean) AS mean, CASE WHEN count(*) > 1 THEN sqrt(sum(n_func * (y - mean) ** 2) / sum(n_func) / count(*)) END AS sem FROM m GROUP BY 1", "panel", "mean sem")
def weighted_sem(spark, d):
    return rollups.weighted_sem(panel(spark, d), ["rel_week"], "y", "n_func")


@query("AGG28", "SELECT language, count(*) FILTER (rel_week < 0) AS pre, count(*) FILTER (rel_week >= 0) AS post FROM panel GROUP BY 1", "panel")
def count_sides(spark, d):
    return panel(spark, d).groupBy("language").agg(F.count_if(F.col("rel_week") < 0).alias("pre"), F.count_if(F.col("rel_week") >= 0).alias("post"))


@query("AGG29", "SELECT rel_week, count(*) FILTER (language = '1-URGENT') AS urgent, count(*) FILTER (language = '5-LOW') AS low FROM panel GROUP BY 1", "panel")
def pivoted(spark, d):
    return rollups.pivot_counts(panel(spark, d), "rel_week", "language", ["1-URGENT", "5-LOW"]).select("rel_week", F.col("1-URGENT").alias("urgent"), F.col("5-LOW").alias("low"))


@query("AGG29_empty", "SELECT count(DISTINCT w) * count(DISTINCT tag) - count(DISTINCT (w, tag)) AS empty_cells FROM pt", "pt")
def empty_cells(spark, d):
    return rollups.empty_cells(pt(spark, d), "w", "tag")


@query("AGG30", "SELECT id, 'a_' || draw AS rater, label FROM votes WHERE draw <= 4", "votes")
def melted(spark, d):
    return raters_wide(spark, d).unpivot("id", ["a_1", "a_2", "a_3", "a_4"], "rater", "label")


@query("AGG31", "SELECT id, label FROM votes WHERE draw <= 4 GROUP BY 1, 2 HAVING count(*) = 4 OR (count(*) = 3 AND label = 2)", "votes")
def majority(spark, d):
    return annotation.golden_set(votes(spark, d).where("draw <= 4"), 4, 2)


@query("AGG32", "SELECT draw, 100.0 * avg(CASE WHEN gold = label THEN 1 ELSE 0 END) AS accuracy, count(*) AS n FROM votes GROUP BY ROLLUP (draw)", "votes", "accuracy")
def accuracy(spark, d):
    return annotation.accuracy(votes(spark, d), ["draw"])


@query("AGG33", """WITH c AS (SELECT k AS class, count(*) FILTER (gold = k) AS support, count(*) FILTER (label = k) AS said, count(*) FILTER (gold = k AND label = k) AS hit FROM votes, (SELECT unnest([0, 1, 2]) AS k) GROUP BY k),
  s AS (SELECT CAST(class AS VARCHAR) AS class, coalesce(hit / nullif(said, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall, support, hit FROM c),
  f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM s)
  SELECT class, precision, recall, f1, support FROM f
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM f
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM f
  UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), CAST(sum(support) AS BIGINT) FROM f""", "votes", "precision recall f1")
def report(spark, d):
    return annotation.class_report(votes(spark, d), "gold", "label")


@query("AGG34", "SELECT id, label, votes FROM (SELECT id, label, count(*) AS votes, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, label) AS r FROM votes GROUP BY 1, 2) WHERE r = 1", "votes")
def plurality(spark, d):
    return annotation.plurality(votes(spark, d))


_PRE = "pre AS (SELECT tag, sum(pct) AS v FROM pt WHERE days < 0 GROUP BY 1)"


def _pre_weight(spark, d):
    return pt(spark, d).where("days < 0").groupBy("tag").agg(F.round(F.sum("pct"), 6).alias("v"))


@query("AGG35", "WITH pre AS (SELECT tag, round(sum(pct), 6) AS v FROM pt WHERE days < 0 GROUP BY 1), g AS (SELECT tag, CASE WHEN row_number() OVER (ORDER BY v, tag) <= floor(0.2 * count(*) OVER ()) THEN 'lowest' ELSE 'rest' END AS grp FROM pre) SELECT w, grp, sum(pct) AS n, 100 * sum(pct) / sum(sum(pct)) OVER (PARTITION BY w) AS share FROM pt JOIN g ON pt.tag = g.tag GROUP BY w, grp", "pt", "n share")
def lowest_and_rest(spark, d):
    groups = distributions.lower_and_rest(_pre_weight(spark, d), "tag", "v").select("tag", "grp")
    return rollups.shares(pt(spark, d).join(groups, "tag"), ["w"], "grp", F.col("pct"))


@query("AGG36", "SELECT CAST(floor(vec_id / 50.0) AS INTEGER) AS period, label AS topic, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY floor(vec_id / 50.0)) AS p FROM embeddings GROUP BY floor(vec_id / 50.0), label", "", "p")
def topic_proportion(spark, d):
    counts = table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 50).cast("int").alias("period"), F.col("label").alias("topic")).agg(F.count("*").alias("n"))
    return distributions.fractions(counts, ["period"])


@query("AGG37", "SELECT n_regionkey AS region, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3")
def summed_out(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_regionkey").alias("region"), F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).agg(F.count("*").alias("n"))


@query("AGG38", "WITH c AS (SELECT tag, sum(pct) FILTER (days < 0) AS bb, sum(pct) FILTER (days >= 0) AS aa FROM pt GROUP BY 1) SELECT tag, (aa - bb) / bb AS change FROM c WHERE aa IS NOT NULL AND bb IS NOT NULL", "pt", "change")
def pre_post_ratio(spark, d):
    c = pt(spark, d).groupBy("tag").agg(F.sum(F.when(F.col("days") < 0, F.col("pct"))).alias("bb"), F.sum(F.when(F.col("days") >= 0, F.col("pct"))).alias("aa"))
    return c.dropna().select("tag", distributions.change(F.col("bb"), F.col("aa")).alias("change"))


@query("AGG39", "WITH c AS (SELECT tag, CAST(year(creationdate) AS INTEGER) AS year, count(*) AS n FROM pt GROUP BY 1, 2), r AS (SELECT *, (n - lag(n) OVER (PARTITION BY tag ORDER BY year)) / lag(n) OVER (PARTITION BY tag ORDER BY year) AS rate FROM c) SELECT tag, year, n, rate, rate - lag(rate) OVER (PARTITION BY tag ORDER BY year) AS rate_change FROM r", "pt", "rate rate_change")
def yearly_rates(spark, d):
    w = Window.partitionBy("tag").orderBy("year")
    c = pt(spark, d).groupBy("tag", F.year("creationdate").alias("year")).agg(F.count("*").alias("n"))
    r = c.withColumn("rate", distributions.change(F.lag("n").over(w), F.col("n")))
    return r.withColumn("rate_change", F.col("rate") - F.lag("rate").over(w))


@query("AGG40", "SELECT language, count(*) FILTER (days < 0) AS pre_posts, ln(1 + count(*) FILTER (days < 0)) AS intensity, count(*) AS total FROM dated GROUP BY 1", "dated", "intensity")
def intensity(spark, d):
    pre = F.count_if(F.col("days") < 0)
    return dated(spark, d).groupBy("language").agg(pre.alias("pre_posts"), F.log1p(pre).alias("intensity"), F.count("*").alias("total"))


@query("AGG41", "SELECT quantile_cont(y, 0.01) AS q01, quantile_cont(y, 0.99) AS q99 FROM panel", "panel", "q01 q99")
def clip_limits(spark, d):
    q = panel(spark, d).agg(F.percentile("y", F.array(F.lit(0.01), F.lit(0.99))).alias("q"))
    return q.select(F.get("q", F.lit(0)).alias("q01"), F.get("q", F.lit(1)).alias("q99"))


@query("AGG42", "SELECT CAST(floor(days / 28.0) AS INTEGER) AS bin, avg(cc) AS cc, avg(nloc) AS nloc FROM (SELECT id, days, max(cc) AS cc, max(nloc) AS nloc FROM pm GROUP BY 1, 2) GROUP BY 1", "pm", "cc nloc")
def max_then_mean(spark, d):
    top = pm(spark, d).groupBy("id", "days").agg(F.max("cc").alias("cc"), F.max("nloc").alias("nloc"))
    return top.groupBy(F.floor(F.col("days") / 28).cast("int").alias("bin")).agg(F.avg("cc").alias("cc"), F.avg("nloc").alias("nloc"))


@query("AGG43", "SELECT language, w, quantile_cont(cc, 0.75) - quantile_cont(cc, 0.25) AS iqr, var_samp(cc) AS vr, median(cc) AS med FROM pm GROUP BY 1, 2", "pm", "iqr vr med")
def dispersion_panel(spark, d):
    rows = pm(spark, d)
    q = quantiles.quantiles(rows.groupBy("language", "w", "cc").agg(F.count("*").alias("times")), ["language", "w"], "cc", {"low": 0.25, "med": 0.5, "high": 0.75}, "times")
    out = rows.groupBy("language", "w").agg(F.var_samp("cc").alias("vr"))
    return quantiles.same(out, q, ["language", "w"]).select("language", "w", (F.col("high") - F.col("low")).alias("iqr"), "vr", "med")


_GROUPS = "pre AS (SELECT tag, round(sum(pct), 6) AS v FROM pt WHERE days < 0 GROUP BY 1), g AS (SELECT tag, CASE WHEN row_number() OVER (ORDER BY v DESC, tag) <= floor(count(*) OVER () * 0.2) THEN 'top' WHEN row_number() OVER (ORDER BY v DESC, tag) > count(*) OVER () - floor(count(*) OVER () * 0.2) THEN 'bottom' ELSE 'middle' END AS grp FROM pre)"


def _groups(spark, d):
    return distributions.top_bottom(_pre_weight(spark, d), "tag", "v").select("tag", "grp")


@query("AGG44", f"WITH {_GROUPS}, s AS (SELECT language, grp, sum(pct) FILTER (days < 0) AS before, sum(pct) FILTER (days >= 0) AS after FROM pt JOIN g ON pt.tag = g.tag GROUP BY 1, 2) SELECT language, grp, before / sum(before) OVER (PARTITION BY grp) AS before, after / sum(after) OVER (PARTITION BY grp) AS after FROM s", "pt", "before after")
def share_by_group(spark, d):
    s = pt(spark, d).join(_groups(spark, d), "tag").groupBy("language", "grp").agg(F.sum(F.when(F.col("days") < 0, F.col("pct"))).alias("before"), F.sum(F.when(F.col("days") >= 0, F.col("pct"))).alias("after"))
    w = Window.partitionBy("grp")
    return s.select("language", "grp", (F.col("before") / F.sum("before").over(w)).alias("before"), (F.col("after") / F.sum("after").over(w)).alias("after"))


@query("AGG45", "WITH s AS (SELECT tag, sum(pct) FILTER (days < 0) AS b, sum(pct) FILTER (days >= 0) AS a FROM pt GROUP BY 1) SELECT tag, b / sum(b) OVER () AS before, a / sum(a) OVER () AS after FROM s WHERE a IS NOT NULL AND b IS NOT NULL", "pt", "before after")
def global_share(spark, d):
    s = pt(spark, d).groupBy("tag").agg(F.sum(F.when(F.col("days") < 0, F.col("pct"))).alias("b"), F.sum(F.when(F.col("days") >= 0, F.col("pct"))).alias("a")).dropna()
    w = Window.partitionBy(F.lit(1))
    return s.select("tag", (F.col("b") / F.sum("b").over(w)).alias("before"), (F.col("a") / F.sum("a").over(w)).alias("after"))


@query("AGG46", "WITH s AS (SELECT language, tag, bool_or(days < -900) AS b, bool_or(days >= 1100) AS a FROM pt GROUP BY 1, 2) SELECT language, 100.0 * count(*) FILTER (a AND NOT b) / count(*) AS new_pct, 100.0 * count(*) FILTER (a AND b) / count(*) AS retained_pct, 100.0 * count(*) FILTER (b AND NOT a) / count(*) AS gone_pct FROM s WHERE a OR b GROUP BY 1", "pt", "new_pct retained_pct gone_pct")
def tag_turnover(spark, d):
    s = pt(spark, d).groupBy("language", "tag").agg(F.bool_or(F.col("days") < -900).alias("b"), F.bool_or(F.col("days") >= 1100).alias("a")).where("a or b")
    life = s.withColumn("x", distributions.lifecycle(F.col("b"), F.col("a")))
    pct = lambda k: 100 * F.count_if(F.col("x") == k) / F.count("*")
    return life.groupBy("language").agg(pct(2).alias("new_pct"), pct(1).alias("retained_pct"), pct(0).alias("gone_pct"))


@query("AGG46_lists", "WITH s AS (SELECT language, tag, bool_or(days < -900) AS b, bool_or(days >= 1100) AS a FROM pt GROUP BY 1, 2) SELECT language, coalesce(string_agg(tag, ',' ORDER BY tag) FILTER (a AND NOT b), '') AS new_tags, coalesce(string_agg(tag, ',' ORDER BY tag) FILTER (a AND b), '') AS retained_tags, coalesce(string_agg(tag, ',' ORDER BY tag) FILTER (b AND NOT a), '') AS gone_tags FROM s WHERE a OR b GROUP BY 1", "pt")
def tag_turnover_lists(spark, d):
    s = pt(spark, d).groupBy("language", "tag").agg(F.bool_or(F.col("days") < -900).alias("b"), F.bool_or(F.col("days") >= 1100).alias("a")).where("a or b")
    life = s.withColumn("x", distributions.lifecycle(F.col("b"), F.col("a")))
    names = lambda k: F.array_join(F.sort_array(F.collect_list(F.when(F.col("x") == k, F.col("tag")))), ",")
    return life.groupBy("language").agg(names(2).alias("new_tags"), names(1).alias("retained_tags"), names(0).alias("gone_tags"))


# ---- windows


@query("WIN1", "SELECT nation, q, pushers, pushers / sum(pushers) OVER (PARTITION BY q) AS share FROM (SELECT c_nationkey AS nation, CAST(year(o_orderdate) * 10 + quarter(o_orderdate) AS INTEGER) AS q, count(DISTINCT o_custkey) AS pushers FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)", "", "share")
def quarter_share(spark, d):
    return _pushers(spark, d).withColumn("share", F.col("pushers") / F.sum("pushers").over(Window.partitionBy("q")))


@query("WIN2", "WITH a AS (SELECT language, rel_week, y - avg(y) OVER (PARTITION BY language) AS v FROM panel) SELECT language, rel_week, v - avg(v) OVER (PARTITION BY rel_week) AS v FROM a", "panel", "v", 6)
def demeaned(spark, d):
    a = panel(spark, d).select("language", "rel_week", (F.col("y") - F.avg("y").over(Window.partitionBy("language"))).alias("v"))
    return a.withColumn("v", F.col("v") - F.avg("v").over(Window.partitionBy("rel_week")))


@query("WIN3", "SELECT language, rel_week, CASE WHEN count(y) OVER x >= 3 THEN avg(y) OVER x END AS m FROM panel WINDOW x AS (PARTITION BY language ORDER BY rel_week ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING)", "panel", "m")
def centred_8(spark, d):
    w = Window.partitionBy("language").orderBy("rel_week").rowsBetween(-4, 3)
    return panel(spark, d).select("language", "rel_week", F.when(F.count("y").over(w) >= 3, F.avg("y").over(w)).alias("m"))


@query("WIN4", "SELECT language, rel_week, CASE WHEN count(y) OVER x = 10 THEN avg(y) OVER x END AS m FROM panel WINDOW x AS (PARTITION BY language ORDER BY rel_week ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)", "panel", "m")
def centred_10(spark, d):
    w = Window.partitionBy("language").orderBy("rel_week").rowsBetween(-5, 4)
    return panel(spark, d).select("language", "rel_week", F.when(F.count("y").over(w) == 10, F.avg("y").over(w)).alias("m"))


_R2 = "(1 - regr_r2(y, rel_week) OVER x)"


@query("WIN5", f"SELECT language, rel_week, CASE WHEN count(*) OVER x = 8 THEN regr_slope(y, rel_week) OVER x END AS slope, CASE WHEN count(*) OVER x = 8 THEN regr_slope(y, rel_week) OVER x / avg(y) OVER x END AS relative, CASE WHEN count(*) OVER x = 8 THEN 1 - sqrt(1 - {_R2}) * (1 + {_R2} / 2 + 3 * {_R2} ** 2 / 8) END AS p, CASE WHEN count(*) OVER x = 8 THEN min(rel_week) OVER x END AS start, count(*) OVER x AS n FROM panel WINDOW x AS (PARTITION BY language ORDER BY rel_week ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)", "panel", "slope relative p", 8)
def rolling_line(spark, d):
    """Lines over eight weeks. p is that of Student's t with six degrees of freedom, which is a polynomial of r."""
    w = Window.partitionBy("language").orderBy("rel_week").rowsBetween(-7, 0)
    y, x = F.col("y"), F.col("rel_week").cast("double")
    n, slope, rest = F.count("*").over(w), F.regr_slope(y, x).over(w), 1 - F.regr_r2(y, x).over(w)
    p = 1 - F.sqrt(1 - rest) * (1 + rest / 2 + 3 * rest**2 / 8)
    full = lambda c: F.when(n == 8, c)
    return panel(spark, d).select("language", "rel_week", full(slope).alias("slope"), full(slope / F.avg("y").over(w)).alias("relative"), full(p).alias("p"), full(F.min("rel_week").over(w)).alias("start"), n.alias("n"))


@query("WIN6", "SELECT id, cc, nloc FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cc DESC, nloc) AS r FROM metrics) WHERE r = 1", "metrics")
def head(spark, d):
    w = Window.partitionBy("id").orderBy(F.desc("cc"), "nloc")
    return metrics(spark, d).withColumn("r", F.row_number().over(w)).where("r = 1").select("id", "cc", "nloc")


@query("WIN7", "SELECT tag, CAST(row_number() OVER (ORDER BY n DESC, tag) - 1 AS INTEGER) AS rank FROM (SELECT tag, count(*) AS n FROM pt WHERE days < 0 GROUP BY 1)", "pt")
def topic_rank(spark, d):
    n = pt(spark, d).where("days < 0").groupBy("tag").agg(F.count("*").alias("n"))
    return n.select("tag", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "tag")) - 1).alias("rank"))


@query("WIN8", "SELECT language, max_by(y, rel_week) AS last_y FROM panel GROUP BY 1", "panel", "last_y")
def last_value(spark, d):
    return panel(spark, d).groupBy("language").agg(F.max_by("y", "rel_week").alias("last_y"))


@query("WIN9", "SELECT id, nloc, cc, CAST(row_number() OVER (PARTITION BY id ORDER BY nloc, cc) - 1 AS INTEGER) AS pos FROM (SELECT DISTINCT * FROM metrics)", "metrics")
def file_key(spark, d):
    w = Window.partitionBy("id").orderBy("nloc", "cc")
    return metrics(spark, d).distinct().select("id", "nloc", "cc", (F.row_number().over(w) - 1).alias("pos"))


# ---- order, samples, sets


@query("TOP1", "SELECT id, creationdate FROM posts ORDER BY creationdate, id LIMIT 1", "posts")
def first_post(spark, d):
    return posts(spark, d).select("id", "creationdate").orderBy("creationdate", "id").limit(1)


_TOPIC_TOTALS = "n AS (SELECT tag, count(*) AS v FROM pt WHERE days >= -336 AND days < 0 GROUP BY 1)"


def _totals(spark, d):
    return pt(spark, d).where("days >= -336 and days < 0").groupBy("tag").agg(F.count("*").alias("v"))


@query("TOP2", f"WITH {_TOPIC_TOTALS}, r AS (SELECT tag, row_number() OVER (ORDER BY v DESC, tag) AS r, count(*) OVER () AS k FROM n) SELECT tag, CASE WHEN r <= 10 THEN 'top' ELSE 'bottom' END AS grp FROM r WHERE r <= 10 OR r > k - 10", "pt")
def ten_and_ten(spark, d):
    return distributions.top_bottom(_totals(spark, d), "tag", "v", n=10).where("grp != 'middle'").select("tag", "grp")


@query("TOP3", f"WITH {_TOPIC_TOTALS}, r AS (SELECT tag, row_number() OVER (ORDER BY v DESC, tag) AS r, count(*) OVER () AS k FROM n) SELECT tag, CASE WHEN r <= 10 THEN 'top' WHEN r > k - 10 THEN 'bottom' ELSE 'middle' END AS grp FROM r", "pt")
def three_buckets(spark, d):
    return distributions.top_bottom(_totals(spark, d), "tag", "v", n=10).select("tag", "grp")


@query("TOP4", f"WITH {_GROUPS} SELECT tag, grp FROM g WHERE grp <> 'middle'", "pt")
def fifths(spark, d):
    return _groups(spark, d).where("grp != 'middle'")


@query("TOP6", f"WITH {_GROUPS} SELECT tag FROM g WHERE grp = 'middle'", "pt")
def middle(spark, d):
    return _groups(spark, d).where("grp = 'middle'").select("tag")


_CHURN = "tot AS (SELECT tag, round(sum(pct) FILTER (days < 0), 6) AS b, round(sum(pct) FILTER (days >= 0), 6) AS a FROM pt GROUP BY 1), r AS (SELECT tag, row_number() OVER (ORDER BY b DESC, tag) AS rb, row_number() OVER (ORDER BY a DESC, tag) AS ra, count(*) OVER () AS n FROM tot WHERE a IS NOT NULL AND b IS NOT NULL), gr AS (SELECT tag, CASE WHEN rb <= floor(n * 0.2) THEN 'top' WHEN rb > n - floor(n * 0.2) THEN 'bottom' ELSE 'middle' END AS before, CASE WHEN ra <= floor(n * 0.2) THEN 'top' WHEN ra > n - floor(n * 0.2) THEN 'bottom' ELSE 'middle' END AS after FROM r)"


@query("TOP6_churn", f"WITH {_CHURN} SELECT before AS grp, count(*) AS members, count(*) FILTER (before <> after) AS gone FROM gr GROUP BY 1", "pt")
def churn(spark, d):
    """How many tags of the top, middle and bottom group before the event are in another one after it."""
    when = lambda c: F.round(F.sum(F.when(c, F.col("pct"))), 6)
    totals = pt(spark, d).groupBy("tag").agg(when(F.col("days") < 0).alias("b"), when(F.col("days") >= 0).alias("a")).dropna()
    before = distributions.top_bottom(totals, "tag", "b").select("tag", "a", F.col("grp").alias("before"))
    both = distributions.top_bottom(before, "tag", "a")
    return both.groupBy(F.col("before").alias("grp")).agg(F.count("*").alias("members"), F.count_if(F.col("before") != F.col("grp")).alias("gone"))


@query("TOP7", "WITH s AS (SELECT tag, sum(pct) FILTER (days < 0) AS b, sum(pct) FILTER (days >= 0) AS a FROM pt GROUP BY 1) SELECT tag, round(abs(a - b), 6) AS gap FROM s ORDER BY gap DESC, tag LIMIT 5", "pt", "gap")
def largest_gap(spark, d):
    s = pt(spark, d).groupBy("tag").agg(F.sum(F.when(F.col("days") < 0, F.col("pct"))).alias("b"), F.sum(F.when(F.col("days") >= 0, F.col("pct"))).alias("a"))
    return s.select("tag", F.round(F.abs(F.col("a") - F.col("b")), 6).alias("gap")).orderBy(F.desc("gap"), "tag").limit(5)


@query("SMP1", "SELECT id, CAST(creationdate AS DATE) AS day FROM (SELECT *, row_number() OVER (PARTITION BY CAST(creationdate AS DATE) ORDER BY md5(concat_ws('|', '7', CAST(id AS VARCHAR))), id) AS r FROM posts) WHERE r <= 3", "posts")
def per_day(spark, d):
    return annotation.sample_per(posts(spark, d), [F.to_date("creationdate")], 3, seed=7).select("id", F.to_date("creationdate").alias("day"))


@query("SMP2", "SELECT id, CAST(50000 + dense_rank() OVER (ORDER BY CAST(creationdate AS DATE)) - 1 AS INTEGER) AS ver FROM posts", "posts")
def run_ids(spark, d):
    return annotation.with_run(posts(spark, d), F.to_date("creationdate"), 50000).select("id", "ver")


@query("SMP3", "SELECT id FROM posts ORDER BY md5(concat_ws('|', '1', CAST(id AS VARCHAR))), id LIMIT 50", "posts")
def uniform(spark, d):
    return posts(spark, d).select("id").orderBy(annotation.draw_key(1, "id"), "id").limit(50)


def _golden(spark, d):
    return annotation.golden_set(votes(spark, d).where("draw <= 4"), 4, 2).withColumnRenamed("label", "answer")


def _targets(spark, d):
    return posts(spark, d).where("id % 50 = 0").select("id")


@query("SMP4", """WITH g AS (SELECT id AS shot_id, label FROM votes WHERE draw <= 4 GROUP BY 1, 2 HAVING count(*) = 4 OR (count(*) = 3 AND label = 2)),
  r AS (SELECT p.id AS eval_id, CAST(k AS INTEGER) AS draw, shot_id, label, md5(concat_ws('|', '0', CAST(p.id AS VARCHAR), CAST(k AS VARCHAR), CAST(shot_id AS VARCHAR))) AS h FROM posts p, (SELECT unnest([1, 2]) AS k), g WHERE p.id % 50 = 0 AND shot_id <> p.id),
  s AS (SELECT *, row_number() OVER (PARTITION BY eval_id, draw, label ORDER BY h) AS n FROM r)
  SELECT eval_id, draw, shot_id, label, CAST(row_number() OVER (PARTITION BY eval_id, draw ORDER BY label, h) AS INTEGER) AS pos FROM s WHERE n <= 4""", "posts votes")
def shots(spark, d):
    return annotation.few_shots(_golden(spark, d), _targets(spark, d), 4, 2)


@query("SMP5", "SELECT p.id AS eval_id, count(*) AS shots FROM posts p, (SELECT unnest(range(1, 6)) AS k), (SELECT unnest(range(0, 12)) AS s) WHERE p.id % 50 = 0 GROUP BY 1", "posts")
def draws(spark, d):
    return annotation.few_shots_by_place(_golden(spark, d), _targets(spark, d), 4, 5).groupBy("eval_id").agg(F.count("*").alias("shots"))


@query("SMP6", """WITH g AS (SELECT id AS shot_id, row_number() OVER (ORDER BY id) - 1 AS n FROM (SELECT id FROM votes WHERE draw <= 4 GROUP BY id, label HAVING count(*) = 4 OR (count(*) = 3 AND label = 2))),
  d AS (SELECT p.id AS eval_id, CAST(k AS INTEGER) AS pos, CAST(('0x' || substr(md5(concat_ws('|', '0', CAST(p.id AS VARCHAR), CAST(k AS VARCHAR))), 1, 12)) AS BIGINT) % (SELECT count(*) FROM g) AS n FROM posts p, (SELECT unnest(range(1, 13)) AS k) WHERE p.id % 50 = 0)
  SELECT eval_id, pos, shot_id FROM d JOIN g ON d.n = g.n""", "posts votes")
def replaced(spark, d):
    return annotation.with_replacement(_golden(spark, d), _targets(spark, d), 12)


@query("SMP7", "SELECT id, CAST(floor(days / 364.0) AS INTEGER) AS period FROM (SELECT *, row_number() OVER (PARTITION BY floor(days / 364.0) ORDER BY md5(concat_ws('|', '3', CAST(id AS VARCHAR))), id) AS r FROM dated) WHERE r <= 54", "dated")
def per_period(spark, d):
    period = F.floor(F.col("days") / 364).cast("int")
    return annotation.sample_per(dated(spark, d), [period], 54, seed=3).select("id", period.alias("period"))


@query("SRT1", "SELECT language, rel_week, y FROM panel", "panel", "y")
def sorted_panel(spark, d):
    return panel(spark, d).select("language", "rel_week", "y").orderBy("language", "rel_week")


_SIDES = "b AS (SELECT DISTINCT tag, language FROM pt WHERE days < -1230), a AS (SELECT DISTINCT tag, language FROM pt WHERE days >= 1140)"


def _sides(spark, d):
    rows = pt(spark, d)
    return rows.where("days < -1230").select("tag", "language").distinct(), rows.where("days >= 1140").select("tag", "language").distinct()


@query("SET1", "SELECT id, 'a' AS src FROM posts WHERE id % 2 = 0 UNION ALL SELECT id, 'b' AS src FROM posts WHERE id % 3 = 0", "posts")
def union_all(spark, d):
    p = posts(spark, d).select("id")
    return p.where("id % 2 = 0").withColumn("src", F.lit("a")).unionByName(p.where("id % 3 = 0").withColumn("src", F.lit("b")))


@query("SET2", f"WITH {_SIDES} SELECT * FROM b INTERSECT SELECT * FROM a", "pt")
def retained(spark, d):
    b, a = _sides(spark, d)
    return b.intersect(a)


@query("SET3", f"WITH {_SIDES} SELECT *, 'gone' AS side FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'new' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b)", "pt")
def gone_and_new(spark, d):
    b, a = _sides(spark, d)
    return b.subtract(a).withColumn("side", F.lit("gone")).union(a.subtract(b).withColumn("side", F.lit("new")))


@query("SET4", f"WITH {_SIDES} SELECT tag FROM b UNION SELECT tag FROM a", "pt")
def node_set(spark, d):
    b, a = _sides(spark, d)
    return b.select("tag").union(a.select("tag")).distinct()


@query("SET5", "SELECT t.id, array_to_string(list_sort(list_filter(list(DISTINCT tag), lambda x: x NOT IN ('Brand#1', 'Brand#2'))), ',') AS rest FROM tags t GROUP BY 1", "tags")
def array_difference(spark, d):
    sets = tags(spark, d).groupBy("id").agg(F.sort_array(F.collect_set("tag")).alias("t"))
    return sets.select("id", F.array_join(F.array_except("t", F.array(F.lit("Brand#1"), F.lit("Brand#2"))), ",").alias("rest"))


@query("SET7", "SELECT year FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders) INTERSECT SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) FROM lineitem")
def common_years(spark, d):
    # Each side's few years first: an intersection joins all rows of both before it makes them distinct.
    years = lambda name, day: table(spark, d, name).select(F.year(day).alias("year")).distinct()
    return years("orders", "o_orderdate").intersect(years("lineitem", "l_shipdate"))


@query("FLT21", "WITH c AS (SELECT c_nationkey AS nation, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3) SELECT nation, n FROM c WHERE year = 1998 AND quarter = 1")
def snapshot(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    counts = rows.groupBy(F.col("c_nationkey").alias("nation"), F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).agg(F.count("*").alias("n"))
    return counts.where("year = 1998 and quarter = 1").select("nation", "n").orderBy(F.desc("n"), "nation")


@query("AGG18", "SELECT label AS topic, count(*) AS n FROM embeddings GROUP BY 1")
def dispatched_topics(spark, d):
    return distributions.topic_counts(table(spark, d, "embeddings").select(F.col("label").alias("topic")), [])


@query("WIN10", "SELECT language, rel_week, CAST(coalesce(sum(n_func) OVER (PARTITION BY language ORDER BY rel_week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM panel", "panel")
def running_total(spark, d):
    w = Window.partitionBy("language").orderBy("rel_week").rowsBetween(Window.unboundedPreceding, -1)
    return panel(spark, d).select("language", "rel_week", F.coalesce(F.sum("n_func").over(w), F.lit(0).cast("long")).alias("before"))


@query("UDF13", "SELECT id, owner, sum(price) OVER (PARTITION BY owner ORDER BY creationdate, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reputation FROM posts", "posts", "reputation", 2)
def reputation(spark, d):
    """The sum of an owner's events up to each of them: an as-of value, by month so that an owner of very many events is no single task."""
    return rollups.running_total(posts(spark, d), "owner", ["creationdate", "id"], F.date_trunc("month", "creationdate"), "price", "reputation").select("id", "owner", "reputation")
