"""Closed-form statistics and matrix estimators as registered queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, dist, numbers
from ..operators import closed, panels, rollups, smooth, solve
from ..sources.adapters import EVENT, PLACEBO, posts
from .registry import query
from .relational import dated, panel, pm, pt, weekly

#: A line's pieces in SQL, for a condition.
def _line(prefix: str, y: str, x: str, when: str) -> str:
    c = f"CASE WHEN {when} THEN {y} END"
    return f"CAST(regr_count({c}, {x}) AS BIGINT) AS {prefix}n, regr_slope({c}, {x}) AS {prefix}slope, regr_intercept({c}, {x}) AS {prefix}icpt, regr_avgx({c}, {x}) AS {prefix}xm, regr_sxx({c}, {x}) AS {prefix}sxx, regr_syy({c}, {x}) * (1 - coalesce(regr_r2({c}, {x}), 0)) AS {prefix}rss, regr_r2({c}, {x}) AS {prefix}r2"


def _t_p(t: str, df: str) -> str:
    """Two-sided p of Student's t with whole degrees of freedom in SQL: its finite series."""
    cos2 = f"({df} / ({df} + ({t}) ** 2))"
    even = f"list_sum(list_transform(range(0, CAST({df} AS BIGINT) // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0)) / sqrt(pi()) * {cos2} ** k))"
    odd = f"list_sum(list_transform(range(0, CAST({df} AS BIGINT) // 2), lambda k: exp(lgamma(k + 1.0) - lgamma(k + 1.5)) * sqrt(pi()) / 2 * {cos2} ** k))"
    return f"(1 - CASE WHEN CAST({df} AS BIGINT) % 2 = 0 THEN sqrt(1 - {cos2}) * {even} ELSE 2 / pi() * (acos(sqrt({cos2})) + sqrt(1 - {cos2}) * sqrt({cos2}) * coalesce({odd}, 0)) END)"


def _z_p(z: str) -> str:
    """Two-sided p of a normal value in SQL, by the series of erf."""
    return f"CASE WHEN {z} = 0 THEN 1 WHEN abs({z}) > 8 THEN 0 ELSE 1 - exp(-1 * ({z}) * ({z}) / 2) * list_sum(list_transform(range(0, 200), lambda n: exp((2 * n + 1) * ln(abs({z}) / sqrt(2)) - lgamma(n + 1.5)))) END"


def _t_quantiles(table: str, p: float = 0.975) -> str:
    """tq AS (df, tq) for the degrees of freedom df of a table, by bisection in SQL."""
    inside = _t_p("((lo + hi) / 2)", "df")
    half = f"CASE WHEN {inside} > {2 * (1 - p)}"
    return f"tq AS (WITH RECURSIVE r AS (SELECT DISTINCT df, CAST(0 AS DOUBLE) AS lo, CAST(64 AS DOUBLE) AS hi, 0 AS i FROM {table} WHERE df > 0 UNION ALL SELECT df, {half} THEN (lo + hi) / 2 ELSE lo END, {half} THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM r WHERE i < 60) SELECT df, (lo + hi) / 2 AS tq FROM r WHERE i = 60)"


def _panel_t(spark, d):
    return panel(spark, d).withColumnRenamed("rel_week", "t")


@query("DAT1", "SELECT id, CAST(floor(days / 7.0) AS INTEGER) AS rel_week FROM dated", "dated")
def rel_week(spark, d):
    return dated(spark, d).select("id", F.col("w").alias("rel_week"))


@query("DAT2", "SELECT id, CAST(floor(days / 28.0) AS INTEGER) AS bin FROM dated", "dated")
def four_week_bin(spark, d):
    return posts(spark, d).select("id", dates.rel_bin(F.col("creationdate"), EVENT, 28).alias("bin"))


@query("DAT3", "SELECT event_id, CAST(date_trunc('week', ts) AS DATE) AS monday FROM events")
def monday(spark, d):
    from ..sources.adapters import table

    return table(spark, d, "events").select("event_id", dates.week_start(F.col("ts")).alias("monday"))


@query("DAT4", "SELECT id, CAST(floor((date_diff('day', DATE '1998-06-03', CAST(date_trunc('week', creationdate) AS DATE)) / 7.0) / 4) AS INTEGER) AS event_bin FROM posts", "posts")
def event_bin(spark, d):
    return posts(spark, d).select("id", dates.event_bin(F.col("creationdate"), EVENT).alias("event_bin"))


@query("DAT5", "SELECT w, CAST(CASE WHEN w >= 0 THEN floor(w / 4.0) ELSE floor((w + 1) / 4.0) - 1 END AS INTEGER) AS month_bin FROM (SELECT DISTINCT w FROM pm)", "pm")
def month_bin(spark, d):
    return pm(spark, d).select("w").distinct().select("w", dates.month_bin(F.col("w")).alias("month_bin"))


@query("DAT6", "SELECT w, CAST(greatest(least(floor(w / 12.0), 12), -8) AS INTEGER) AS quarter_bin FROM (SELECT DISTINCT w FROM pm)", "pm")
def quarter_bin(spark, d):
    return pm(spark, d).select("w").distinct().select("w", dates.quarter_bin(F.col("w")).alias("quarter_bin"))


@query("DAT7", "SELECT id, strftime(creationdate, '%Y-%m-%d') AS day FROM posts", "posts")
def day_text(spark, d):
    return posts(spark, d).select("id", dates.day_text(F.col("creationdate")).alias("day"))


@query("DAT8", "SELECT id, CAST(creationdate AS TIMESTAMP) = creationdate AS same FROM posts", "posts")
def parsed(spark, d):
    text = F.when(F.col("id") % 3 == 0, F.date_format("creationdate", "yyyy-MM-dd'T'HH:mm:ss")).when(F.col("id") % 3 == 1, F.date_format("creationdate", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("creationdate", "yyyy-MM-dd"))
    return posts(spark, d).select("id", (dates.parse_mixed(text).cast("timestamp_ntz") == F.col("creationdate")).alias("same"))


@query("DAT9", "SELECT id, CAST((year(creationdate) - (SELECT min(year(creationdate)) FROM posts)) * 4 + quarter(creationdate) - 1 AS INTEGER) AS q FROM posts", "posts")
def quarter_index(spark, d):
    p = posts(spark, d)
    first = p.agg(F.min(F.year("creationdate")).alias("first"))
    return p.join(F.broadcast(first)).select("id", dates.quarter_index(F.col("creationdate"), F.col("first")).alias("q"))


@query("DAT10", "SELECT id, CAST(floor((50000 + id) / 10000.0) AS BIGINT) AS bucket FROM posts", "posts")
def run_bucket(spark, d):
    return posts(spark, d).select("id", dates.run_bucket(F.col("id") + 50000).alias("bucket"))


@query("STR20", "SELECT id, year(creationdate) || 'Q' || quarter(creationdate) AS period FROM posts", "posts")
def period(spark, d):
    return posts(spark, d).select("id", dates.period_label(F.col("creationdate")).alias("period"))


@query("MTH1", "SELECT id, nloc, cc, ln(1 + cc) AS v FROM metrics", "metrics", "v")
def log_one_plus(spark, d):
    from ..sources.adapters import metrics

    return metrics(spark, d).select("id", "nloc", "cc", F.log1p("cc").alias("v"))


@query("MTH2", "SELECT c_custkey AS id, ln(1 + abs(coalesce(c_acctbal, 0))) AS v FROM customer", "", "v")
def signed_log(spark, d):
    from ..sources.adapters import table

    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), numbers.signed_log(F.col("c_acctbal")).alias("v"))


_ITS = f"its AS (SELECT language, {_line('b_', 'y', 'rel_week', 'rel_week < 0')}, {_line('c_', 'y', 'rel_week', 'rel_week >= 0')} FROM panel GROUP BY language)"


@query("MTH3", f"WITH {_ITS} SELECT language, (exp(c_icpt - b_icpt) - 1) * 100 AS level_pct, (exp(52 * (c_slope - b_slope)) - 1) * 100 AS yearly_pct FROM its", "panel", "level_pct yearly_pct", 6)
def percent(spark, d):
    p = closed.its_points(_panel_t(spark, d), ["language"])
    return p.select("language", numbers.percent_effect(F.col("level")).alias("level_pct"), numbers.percent_effect(F.col("slope"), 52).alias("yearly_pct"))


@query("MTH4", f"SELECT language, slope, slope - 1.96 * se AS ci_low, slope + 1.96 * se AS ci_high FROM (SELECT language, slope, sqrt(rss / (n - 2) / sxx) AS se FROM (SELECT language, {_line('', 'y', 'rel_week', 'TRUE')} FROM panel GROUP BY 1))", "panel", "slope ci_low ci_high", 8)
def interval(spark, d):
    o = closed.ols(panel(spark, d), ["language"], "y", "rel_week")
    low, high = numbers.interval(F.col("slope"), F.col("se"))
    return o.select("language", "slope", low.alias("ci_low"), high.alias("ci_high"))


@query("MTH5", "SELECT language, rel_week, CAST(rel_week >= 0 AS INTEGER) AS post, CAST(rel_week >= 0 AS INTEGER) * rel_week AS post_t FROM panel", "panel")
def post_terms(spark, d):
    post = (F.col("rel_week") >= 0).cast("int")
    return panel(spark, d).select("language", "rel_week", post.alias("post"), (post * F.col("rel_week")).alias("post_t"))


@query("MTH6", "SELECT tag, CAST(row_number() OVER (ORDER BY tag) - 1 - count(*) OVER () // 2 AS BIGINT) AS x FROM (SELECT DISTINCT tag FROM tags)", "tags")
def centred_index(spark, d):
    from ..sources.adapters import tags

    w = Window.partitionBy(F.lit(1))
    return tags(spark, d).select("tag").distinct().select("tag", (F.row_number().over(w.orderBy("tag")) - 1 - F.floor(F.count("*").over(w) / 2)).cast("long").alias("x"))


@query("MTH8", "SELECT tag, 10 + 40 * CASE WHEN max(n) OVER () = min(n) OVER () THEN 0.5 ELSE (n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ()) END AS size FROM (SELECT tag, count(*) AS n FROM tags GROUP BY 1)", "tags", "size")
def scaled(spark, d):
    from ..sources.adapters import tags

    return tags(spark, d).groupBy("tag").agg(F.count("*").alias("n")).select("tag", numbers.scaled(F.col("n")).alias("size"))


@query("MTH9", "SELECT p_partkey, round_even(p_retailprice / 8, 2) AS v FROM part", "", "v", 6)
def half_even(spark, d):
    from ..sources.adapters import table

    return table(spark, d, "part").select("p_partkey", F.bround(F.col("p_retailprice") / 8, 2).alias("v"))


_OLS = f"o AS (SELECT language, n, slope, icpt, r2, sqrt(rss / (n - 2) / sxx) AS se FROM (SELECT language, {_line('', 'y', 'rel_week', 'TRUE')} FROM panel GROUP BY 1))"


@query("PRJ5", f"WITH {_OLS}, z AS (SELECT language, slope, abs(slope / se) AS t FROM o) SELECT language, CASE WHEN t > 3.2905 THEN '***' WHEN t > 2.5758 THEN '**' WHEN t > 1.95996 THEN '*' WHEN t > 1.64485 THEN '†' ELSE '(n.s.)' END AS stars, CASE WHEN t < 1.95996 THEN 'none' WHEN slope > 0 THEN 'up' ELSE 'down' END AS side FROM z", "panel")
def significance(spark, d):
    o = closed.ols(panel(spark, d), ["language"], "y", "rel_week").withColumn("p", dist.normal_p_col(F.col("t")))
    return o.select("language", numbers.stars(F.col("p")).alias("stars"), numbers.sign_class(F.col("slope"), F.col("p")).alias("side"))


_STUDY = "study AS (SELECT tag, regr_slope(y, w) AS effect, sqrt(regr_syy(y, w) * (1 - regr_r2(y, w)) / (count(*) - 2) / regr_sxx(y, w)) AS se FROM (SELECT tag, w, count(*) AS y FROM pt GROUP BY 1, 2) GROUP BY 1)"
_META = "m AS (SELECT count(*) AS k, sum(1 / se ** 2) AS w, sum(1 / se ** 4) AS ww, sum(effect / se ** 2) AS we, sum(effect ** 2 / se ** 2) AS wee FROM study WHERE se > 0), q AS (SELECT *, we / w AS fixed, sqrt(1 / w) AS fixed_se, wee - we * we / w AS q FROM m), h AS (SELECT *, greatest(0, 100 * (q - (k - 1)) / q) AS i2, greatest(0, (q - (k - 1)) / (w - ww / w)) AS tau2 FROM q)"


def studies(spark, d):
    """(tag, effect, se): the weekly trend of each tag's posts."""
    cells = pt(spark, d).groupBy("tag", "w").agg(F.count("*").alias("y"))
    return closed.ols(cells, ["tag"], "y", "w").select("tag", F.col("slope").alias("effect"), "se")


@query("PRJ6", f"WITH {_STUDY}, {_META} SELECT CASE WHEN i2 < 25 THEN 'low' WHEN i2 < 50 THEN 'moderate' WHEN i2 < 75 THEN 'substantial' ELSE 'considerable' END AS class FROM h", "pt")
def heterogeneity(spark, d):
    return closed.meta(studies(spark, d), []).select(numbers.heterogeneity(F.col("i2")).alias("class"))


@query("PRJ7", "WITH s AS (SELECT language, regr_slope(y, rel_week) / avg(y) AS r FROM panel GROUP BY 1) SELECT language, CASE WHEN r > power(1.00001, 0.25) - 1 THEN 'Rising' WHEN r < 1 - power(1.00001, 0.25) THEN 'Declining' ELSE 'Stable' END AS trend FROM s", "panel")
def trend(spark, d):
    s = panel(spark, d).groupBy("language").agg((F.regr_slope(F.col("y"), F.col("rel_week").cast("double")) / F.avg("y")).alias("r"))
    return s.select("language", numbers.trend_class(F.col("r"), 0.00001).alias("trend"))


@query("STA1", f"WITH {_OLS} SELECT language, n, slope, icpt, r2, se, slope / se AS t, {_t_p('slope / se', '(n - 2)')} AS p FROM o", "panel", "slope icpt r2 se t p", 6)
def ols(spark, d):
    o = closed.ols(panel(spark, d), ["language"], "y", "rel_week")
    return o.select("language", "n", "slope", "icpt", "r2", "se", "t", dist.t_p_col(F.col("t"), F.col("n") - 2).alias("p"))


@query("STA2", "WITH s AS (SELECT language, count(*) AS n, sum(n_func) AS w, sum(n_func * rel_week) AS wx, sum(n_func * y) AS wy, sum(n_func * rel_week * rel_week) AS wxx, sum(n_func * rel_week * y) AS wxy, sum(n_func * y * y) AS wyy FROM panel GROUP BY 1), c AS (SELECT *, (wxy - wx * wy / w) / (wxx - wx * wx / w) AS slope FROM s) SELECT language, n, slope, (wy - slope * wx) / w AS icpt, sqrt((wyy - wy * wy / w - slope * (wxy - wx * wy / w)) / (n - 2) / (wxx - wx * wx / w)) AS se FROM c", "panel", "slope icpt se", 6)
def wls(spark, d):
    return closed.wls(panel(spark, d).withColumn("x", F.col("rel_week").cast("double")).withColumn("wt", F.col("n_func").cast("double")), ["language"], "y", "x", "wt")


@query("STA3", f"WITH {_OLS} SELECT language, slope, icpt, sqrt(r2) * sign(slope) AS r, {_t_p('slope / se', '(n - 2)')} AS p, se FROM o", "panel", "slope icpt r p se", 6)
def linregress(spark, d):
    o = closed.ols(panel(spark, d), ["language"], "y", "rel_week")
    return o.select("language", "slope", "icpt", (F.sqrt("r2") * F.signum("slope")).alias("r"), dist.t_p_col(F.col("t"), F.col("n") - 2).alias("p"), "se")


@query("STA4", f"WITH l AS (SELECT *, n - 2 AS df FROM (SELECT language, {_line('', 'y', 'rel_week', 'TRUE')} FROM panel GROUP BY 1)), {_t_quantiles('l')}, f AS (SELECT language, x, df, icpt + slope * x AS fit, sqrt(rss / (n - 2) * (1 / n + (x - xm) ** 2 / sxx)) AS se FROM l, (SELECT unnest([-100, 0, 100]) AS x)) SELECT language, x, fit, se, fit - tq * se AS low, fit + tq * se AS high FROM f JOIN tq ON f.df = tq.df", "panel", "fit se low high", 6)
def prediction(spark, d):
    l = panel(spark, d).groupBy("language").agg(*closed.line(F.col("y"), F.col("rel_week"))).withColumn("q", dist.t_quantile_col(F.lit(0.975), F.col("n") - 2))
    g = l.withColumn("x", F.explode(F.array(F.lit(-100), F.lit(0), F.lit(100))))
    f = g.select("language", "x", (F.col("icpt") + F.col("slope") * F.col("x")).alias("fit"), closed.mean_se(F.col("x")).alias("se"), "q")
    return f.select("language", "x", "fit", "se", (F.col("fit") - F.col("q") * F.col("se")).alias("low"), (F.col("fit") + F.col("q") * F.col("se")).alias("high"))


@query("STA5", "SELECT language, regr_slope(y, rel_week) AS slope, regr_intercept(y, rel_week) AS icpt FROM panel GROUP BY 1", "panel", "slope icpt", 6)
def polyfit(spark, d):
    return panel(spark, d).groupBy("language").agg(*closed.line(F.col("y"), F.col("rel_week"))).select("language", "slope", "icpt")


def _chow_sql(when: str, table: str, x: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"SELECT {keys}b_n AS n_pre, c_n AS n_post, ((a_rss - b_rss - c_rss) / 2) / ((b_rss + c_rss) / (a_n - 4)) AS f, 2 AS df1, a_n - 4 AS df2, c_icpt - b_icpt AS level_change, c_slope - b_slope AS slope_change FROM (SELECT {keys}{_line('a_', 'y', x, 'TRUE')}, {_line('b_', 'y', x, when)}, {_line('c_', 'y', x, f'NOT ({when})')} FROM {table}{group})"


@query("STA6", _chow_sql("rel_week < 0", "panel", "rel_week", "language"), "panel", "f level_change slope_change", 6)
def chow(spark, d):
    return closed.chow(panel(spark, d), ["language"], "y", "rel_week", F.col("rel_week") < 0)


@query("STA6_p", f"SELECT language, power(1 + 2 * f / df2, -df2 / 2) AS p FROM ({_chow_sql('rel_week < 0', 'panel', 'rel_week', 'language')})", "panel", "p", 6)
def chow_p(spark, d):
    """With two degrees of freedom above, the F distribution has a closed form, which the SQL uses."""
    c = closed.chow(panel(spark, d), ["language"], "y", "rel_week", F.col("rel_week") < 0)
    return c.select("language", dist.f_p_col(F.col("f"), F.col("df1"), F.col("df2")).alias("p"))


@query("STA7", f"WITH l AS (SELECT *, n - 2 AS df FROM (SELECT language, rel_week >= 0 AS s, {_line('', 'y', 'rel_week', 'TRUE')} FROM panel GROUP BY 1, 2)), {_t_quantiles('l')}, f AS (SELECT p.language, p.rel_week, df, icpt + slope * p.rel_week AS fit, sqrt(rss / df * (1 / n + (p.rel_week - xm) ** 2 / sxx)) AS se FROM panel p JOIN l ON p.language = l.language AND (p.rel_week >= 0) = l.s) SELECT language, rel_week, fit, se, fit - tq * se AS low, fit + tq * se AS high FROM f JOIN tq ON f.df = tq.df", "panel", "fit se low high", 6)
def segment_band(spark, d):
    side = panel(spark, d).withColumn("s", F.col("rel_week") >= 0)
    l = side.groupBy("language", "s").agg(*closed.line(F.col("y"), F.col("rel_week"))).withColumn("q", dist.t_quantile_col(F.lit(0.975), F.col("n") - 2))
    f = side.join(l, ["language", "s"]).select("language", "rel_week", (F.col("icpt") + F.col("slope") * F.col("rel_week")).alias("fit"), closed.mean_se(F.col("rel_week")).alias("se"), "q")
    return f.select("language", "rel_week", "fit", "se", (F.col("fit") - F.col("q") * F.col("se")).alias("low"), (F.col("fit") + F.col("q") * F.col("se")).alias("high"))


@query("STA8", _chow_sql("t < 0", "weekly", "t"), "weekly", "f level_change slope_change", 6)
def chow_total(spark, d):
    return closed.chow(weekly(spark, d), [], "y", "t", F.col("t") < 0)


@query("STA9", _chow_sql("t < 26", "weekly", "t"), "weekly", "f level_change slope_change", 6)
def chow_at(spark, d):
    return closed.chow(weekly(spark, d), [], "y", "t", F.col("t") < 26)


def _series_errors(rows: str, lags: int = 4) -> str:
    """co (k, b0 .. b3) and vh, v3, vp (k, v0 .. v3): two weighted lines for each series k of rows (k, t, y, w) in SQL, with the variances of HAC, HC3 and classical errors."""
    parts = range(4)
    return f"""rs AS ({rows}), se AS (SELECT k, t >= 0 AS post, count(*) AS n, sum(w) AS sw, sum(w * t) / sum(w) AS tm, sum(w * y) / sum(w) AS ym FROM rs GROUP BY 1, 2),
  sx AS (SELECT rs.k, post, max(n) AS n, max(sw) AS sw, max(tm) AS tm, max(ym) AS ym, sum(w * (t - tm) ** 2) AS sxx, sum(w * (t - tm) * (y - ym)) AS sxy FROM rs JOIN se ON rs.k = se.k AND (t >= 0) = post GROUP BY 1, 2),
  ln AS (SELECT *, sxy / sxx AS b, ym - sxy / sxx * tm AS a FROM sx),
  co AS (SELECT x.k, x.n + z.n AS n, x.a AS b0, x.b AS b1, z.a - x.a AS b2, z.b - x.b AS b3, 1 / x.sw + x.tm ** 2 / x.sxx AS c0, 1 / x.sxx AS c1, 1 / x.sw + x.tm ** 2 / x.sxx + 1 / z.sw + z.tm ** 2 / z.sxx AS c2, 1 / x.sxx + 1 / z.sxx AS c3 FROM ln x JOIN ln z ON x.k = z.k AND NOT x.post AND z.post),
  ro AS (SELECT rs.k, t, post, y - a - b * t AS e, w * (y - a - b * t) * (1 / sw - tm * (t - tm) / sxx) AS pa, w * (y - a - b * t) * (t - tm) / sxx AS pb, 1 / sw + (t - tm) ** 2 / sxx AS h FROM rs JOIN ln ON rs.k = ln.k AND (t >= 0) = post),
  fl AS (SELECT k, e, h, row_number() OVER (PARTITION BY k ORDER BY t) AS i, CASE WHEN post THEN 0 ELSE pa END AS p0, CASE WHEN post THEN 0 ELSE pb END AS p1, CASE WHEN post THEN pa ELSE -1 * pa END AS p2, CASE WHEN post THEN pb ELSE -1 * pb END AS p3 FROM ro),
  vh AS (SELECT a.k, {", ".join(f"sum(a.p{i} * b.p{i} * (1 - abs(a.i - b.i) / {lags + 1}.0)) AS v{i}" for i in parts)} FROM fl a JOIN fl b ON a.k = b.k AND abs(a.i - b.i) <= {lags} GROUP BY 1),
  v3 AS (SELECT k, {", ".join(f"sum((p{i} / (1 - h)) ** 2) AS v{i}" for i in parts)} FROM fl GROUP BY 1),
  vp AS (SELECT co.k, {", ".join(f"max(c{i}) * sum(e * e) / (max(n) - 4) AS v{i}" for i in parts)} FROM fl JOIN co ON fl.k = co.k GROUP BY 1)"""


def _series_terms(variances: str) -> str:
    """(k, term, coef, se) of co and one of the tables of variances."""
    return " UNION ALL ".join(f"SELECT co.k, '{name}' AS term, b{i} AS coef, sqrt(v{i}) AS se FROM co JOIN {variances} v ON co.k = v.k" for i, name in enumerate(("const", "time", "post", "post_time")))


def _bins_hac(rows: str, lags: int, ref: str) -> str:
    """te (k, bin, coef, se): weighted means of bins against a reference bin for rows (k, t, bin, y, w) in SQL, HAC errors in the order of t."""
    return f"""bw AS ({rows}), bm AS (SELECT k, bin, sum(w) AS sw, sum(w * y) / sum(w) AS m FROM bw GROUP BY 1, 2), rf AS (SELECT k, {ref} AS ref FROM bm GROUP BY 1),
  bf AS (SELECT bw.k, bw.bin, row_number() OVER (PARTITION BY bw.k ORDER BY t) AS i, w * (y - m) / sw AS g FROM bw JOIN bm ON bw.k = bm.k AND bw.bin = bm.bin),
  bp AS (SELECT a.k, a.bin AS x, b.bin AS y, sum(a.g * b.g * (1 - abs(a.i - b.i) / {lags + 1}.0)) AS s FROM bf a JOIN bf b ON a.k = b.k AND abs(a.i - b.i) <= {lags} GROUP BY 1, 2, 3),
  bv AS (SELECT bp.k, bm.bin, sum(CASE WHEN x = y THEN s ELSE -1 * s END) AS v FROM bm JOIN rf ON bm.k = rf.k JOIN bp ON bp.k = bm.k AND x IN (bm.bin, ref) AND y IN (bm.bin, ref) WHERE bm.bin <> ref GROUP BY 1, 2),
  te AS (SELECT bv.k, bv.bin, b.m - r.m AS coef, sqrt(v) AS se FROM bv JOIN bm b ON b.k = bv.k AND b.bin = bv.bin JOIN rf ON rf.k = bv.k JOIN bm r ON r.k = bv.k AND r.bin = ref WHERE v > 0)"""


def _regression(rows: str, size: int, name: str = "") -> str:
    """rg (k, t, x, y) and ft (k, inv, b), its regressions on `size` columns in a list x, in SQL; in {name}rg and {name}ft."""
    at = f"(SELECT CAST(unnest(range(1, {size + 1})) AS BIGINT)"
    return f"""{name}rg AS ({rows}),
  {name}mo AS (SELECT k, i, list(a ORDER BY j) AS r, max(q) AS q FROM (SELECT k, i, j, sum(x[i] * x[j]) AS a, sum(x[i] * y) AS q FROM {name}rg, {at} AS i), {at} AS j) GROUP BY 1, 2, 3) GROUP BY 1, 2),
  {name}gj AS (SELECT k, CAST(1 AS BIGINT) AS s, list(list_append(list_concat(r, list_transform(range(1, {size + 1}), lambda c: CASE WHEN c = i THEN CAST(1 AS DOUBLE) ELSE 0 END)), q) ORDER BY i) AS m FROM {name}mo GROUP BY k
    UNION ALL SELECT k, s + 1, list_transform(m, lambda r, i: CASE WHEN i = s THEN list_transform(r, lambda v: v / m[s][s]) ELSE list_transform(r, lambda v, j: v - r[s] * m[s][j] / m[s][s]) END) FROM {name}gj WHERE s <= {size}),
  {name}ft AS (SELECT k, list_transform(m, lambda r: r[{size + 1}:{2 * size}]) AS inv, list_transform(m, lambda r: r[{2 * size + 1}]) AS b FROM {name}gj WHERE s > {size})"""


@query("STA10", f"WITH {_ITS} SELECT language, b_n + c_n AS n_obs, b_icpt AS const, b_slope AS pre_trend, c_icpt - b_icpt AS level, c_slope - b_slope AS slope FROM its", "panel", "const pre_trend level slope", 6)
def its_points(spark, d):
    return closed.its_points(_panel_t(spark, d), ["language"])


_PLAIN = "SELECT language AS k, rel_week AS t, y, CAST(1 AS DOUBLE) AS w FROM panel WHERE y IS NOT NULL"


@query("STA10_hac", f"WITH {_series_errors(_PLAIN)}, te AS ({_series_terms('vh')}) SELECT k AS language, term, coef, se, coef / se AS z, {_z_p('(coef / se)')} AS p FROM te", "panel", "coef se z p", 6)
def its_hac(spark, d):
    return solve.its(_panel_t(spark, d), "language", cov="hac", lags=4)


@query("STA11", f"WITH {_ITS}, n AS (SELECT language, CAST(sum(n_func) AS BIGINT) AS n_func FROM panel GROUP BY 1) SELECT its.language, n_func, b_n + c_n AS n_obs, b_slope AS pre_trend, c_icpt - b_icpt AS level, (exp(52 * (c_slope - b_slope)) - 1) * 100 AS yearly FROM its JOIN n ON its.language = n.language", "panel", "pre_trend level yearly", 6)
def its_record(spark, d):
    p = _panel_t(spark, d)
    n = p.groupBy("language").agg(F.sum("n_func").alias("n_func"))
    return closed.its_points(p, ["language"]).join(n, "language").select("language", "n_func", "n_obs", "pre_trend", "level", numbers.percent_effect(F.col("slope"), 52).alias("yearly"))


@query("STA11_record", f"WITH {_series_errors(_PLAIN)}, n AS (SELECT language, CAST(sum(n_func) AS BIGINT) AS n_func, count(*) AS n_obs FROM panel GROUP BY 1), z AS (SELECT co.k, b1, b2, b3, sqrt(v2) AS s2, sqrt(v3) AS s3, b1 / sqrt(v1) AS z1, b2 / sqrt(v2) AS z2, b3 / sqrt(v3) AS z3 FROM co JOIN vh ON co.k = vh.k), r AS (SELECT k AS language, b1 AS pre_trend, {_z_p('z1')} AS pre_trend_p, b2 AS level, s2 AS level_se, {_z_p('z2')} AS level_p, b3 AS slope, s3 AS slope_se, {_z_p('z3')} AS slope_p FROM z) SELECT r.*, (exp(level) - 1) * 100 AS level_pct, (exp(52 * slope) - 1) * 100 AS yearly, (exp(52 * (slope - 1.96 * slope_se)) - 1) * 100 AS yearly_low, (exp(52 * (slope + 1.96 * slope_se)) - 1) * 100 AS yearly_high, n_func, n_obs, slope_p < 0.05 AS significant FROM r JOIN n ON r.language = n.language", "panel", "pre_trend pre_trend_p level level_se level_p slope slope_se slope_p level_pct yearly yearly_low yearly_high", 6)
def its_full_record(spark, d):
    """Level and slope change with HAC errors, p, the yearly effect in percent with its interval, and whether it is significant."""
    p = _panel_t(spark, d)
    fits = solve.its(p, "language", cov="hac", lags=4)
    of = lambda term, c: F.max(F.when(F.col("term") == term, F.col(c)))
    r = fits.groupBy("language").agg(of("time", "coef").alias("pre_trend"), of("time", "p").alias("pre_trend_p"), of("post", "coef").alias("level"), of("post", "se").alias("level_se"), of("post", "p").alias("level_p"), of("post_time", "coef").alias("slope"), of("post_time", "se").alias("slope_se"), of("post_time", "p").alias("slope_p"))
    low, high = numbers.interval(F.col("slope"), F.col("slope_se"))
    r = r.withColumns({"level_pct": numbers.percent_effect(F.col("level")), "yearly": numbers.percent_effect(F.col("slope"), 52), "yearly_low": numbers.percent_effect(low, 52), "yearly_high": numbers.percent_effect(high, 52)})
    n = p.groupBy("language").agg(F.sum("n_func").alias("n_func"), F.count("*").alias("n_obs"))
    return r.join(n, "language").withColumn("significant", F.col("slope_p") < 0.05)


def _pooled_errors(weight: str, lags: int = 8) -> str:
    """co, with the pooled coefficients b0 to b3, and psi, each row's influence on them, in SQL; vc, vh, vd: cluster, HAC and Driscoll-Kraay variances."""
    lagged = lambda t: ", ".join(f"sum(a.p{i} * b.p{i} * (1 - abs(a.i - b.i) / {lags + 1}.0)) AS v{i}" for i in range(4)) + f" FROM {t} a JOIN {t} b ON abs(a.i - b.i) <= {lags}"
    sums = ", ".join(f"sum(p{i}) AS p{i}" for i in range(4))
    return f"""x AS (SELECT language, rel_week AS t, CAST({weight} AS DOUBLE) AS w, y, CAST(rel_week AS DOUBLE) AS x1, CASE WHEN rel_week >= 0 THEN CAST(1 AS DOUBLE) ELSE 0 END AS x2, CAST(greatest(rel_week, 0) AS DOUBLE) AS x3 FROM panel WHERE y IS NOT NULL),
  mm AS (SELECT language, sum(w) AS sw, sum(w * y) / sum(w) AS my, sum(w * x1) / sum(w) AS m1, sum(w * x2) / sum(w) AS m2, sum(w * x3) / sum(w) AS m3 FROM x GROUP BY 1),
  d AS (SELECT x.language, t, w, y - my AS y, x1 - m1 AS x1, x2 - m2 AS x2, x3 - m3 AS x3 FROM x JOIN mm ON x.language = mm.language),
  s AS (SELECT count(*) AS n, sum(w * x1 * x1) AS a, sum(w * x1 * x2) AS b, sum(w * x1 * x3) AS c, sum(w * x2 * x2) AS e, sum(w * x2 * x3) AS f, sum(w * x3 * x3) AS i, sum(w * x1 * y) AS p, sum(w * x2 * y) AS q, sum(w * x3 * y) AS r FROM d),
  iv AS (SELECT n, p, q, r, (e * i - f * f) / z AS i11, (c * f - b * i) / z AS i12, (b * f - c * e) / z AS i13, (a * i - c * c) / z AS i22, (b * c - a * f) / z AS i23, (a * e - b * b) / z AS i33 FROM (SELECT *, a * (e * i - f * f) - b * (b * i - c * f) + c * (b * f - c * e) AS z FROM s)),
  cf AS (SELECT *, i11 * p + i12 * q + i13 * r AS b1, i12 * p + i22 * q + i23 * r AS b2, i13 * p + i23 * q + i33 * r AS b3 FROM iv),
  co AS (SELECT cf.*, language AS l0, sw AS sw0, m1 AS f1, m2 AS f2, m3 AS f3, my - b1 * m1 - b2 * m2 - b3 * m3 AS b0 FROM cf, mm WHERE language = (SELECT min(language) FROM mm)),
  u AS (SELECT language, t, w * (y - b1 * x1 - b2 * x2 - b3 * x3) AS u, x1, x2, x3, co.* FROM d, co),
  pr AS (SELECT *, u * (i11 * x1 + i12 * x2 + i13 * x3) AS p1, u * (i12 * x1 + i22 * x2 + i23 * x3) AS p2, u * (i13 * x1 + i23 * x2 + i33 * x3) AS p3 FROM u),
  psi AS (SELECT language, t, CASE WHEN language = l0 THEN u / sw0 ELSE 0 END - f1 * p1 - f2 * p2 - f3 * p3 AS p0, p1, p2, p3 FROM pr),
  cl AS (SELECT {sums} FROM psi GROUP BY language),
  vc AS (SELECT 'cluster' AS cov, {", ".join(f"sum(p{i} * p{i}) * max(k) AS v{i}" for i in range(4))}, sum(p2 * p3) * max(k) AS v23 FROM cl, (SELECT g / (g - 1.0) * (n - 1.0) / (n - g - 3) AS k FROM s, (SELECT count(*) AS g FROM mm))),
  o AS (SELECT row_number() OVER (ORDER BY language, t) AS i, p0, p1, p2, p3 FROM psi),
  tm AS (SELECT row_number() OVER (ORDER BY t) AS i, {sums} FROM psi GROUP BY t),
  vh AS (SELECT 'hac' AS cov, {lagged('o')}), vd AS (SELECT 'driscoll_kraay' AS cov, {lagged('tm')})"""


def _pooled_table(tables: str) -> str:
    each = " UNION ALL ".join(f"SELECT cov, '{name}' AS term, b{i} AS coef, sqrt(v{i}) AS se FROM co, ve" for i, name in enumerate(("const", "time", "post", "post_time")))
    return f"ve AS ({' UNION ALL '.join(f'SELECT cov, v0, v1, v2, v3 FROM {t}' for t in tables.split())}), te AS ({each}) SELECT cov, term, coef, se, coef / se AS z, {_z_p('(coef / se)')} AS p FROM te"


def _curve(log: bool) -> str:
    e, v = ("(exp(d) - 1) * 100", "100 * exp(d) * sqrt(v)") if log else ("d", "sqrt(v)")
    return f"gr AS (SELECT CAST(unnest(range(-52, 157, 4)) AS INTEGER) AS t), cu AS (SELECT t, CASE WHEN t >= 0 THEN b2 + t * b3 ELSE 0 END AS d, CASE WHEN t >= 0 THEN v2 + t * t * v3 + 2 * t * v23 ELSE 0 END AS v FROM gr, co, vc) SELECT t, {e} AS effect, {v} AS se FROM cu"


def _two_way(tables: str, key: str = "") -> str:
    """The event study of cells (k, language, bin, y, w), which tables ends with, for each k in SQL: elimination of the bins' moments in a recursion of lists."""
    return f"""WITH RECURSIVE {tables}, ce AS (SELECT * FROM cells WHERE y IS NOT NULL),
  en AS (SELECT k, language, sum(w) AS sw, sum(w * y) / sum(w) AS my FROM ce GROUP BY 1, 2),
  bn AS (SELECT k, bin, row_number() OVER (PARTITION BY k ORDER BY bin) AS i FROM (SELECT DISTINCT k, bin FROM ce WHERE bin <> -1)),
  sz AS (SELECT ce.k, count(*) AS n, count(DISTINCT language) AS g, (SELECT count(*) FROM bn WHERE bn.k = ce.k) AS m FROM ce GROUP BY ce.k),
  g AS (SELECT ce.k, ce.language, i, w, sw, y - my AS y FROM ce JOIN en ON ce.k = en.k AND ce.language = en.language JOIN bn ON ce.k = bn.k AND ce.bin = bn.bin),
  mo AS (SELECT p.k, p.i, q.i AS j, sum(CASE WHEN p.i = q.i THEN p.w ELSE 0 END - p.w * q.w / p.sw) AS a FROM g p JOIN g q ON p.k = q.k AND p.language = q.language GROUP BY ALL),
  rw AS (SELECT r.k, r.i, list_concat(list(coalesce(a, 0) ORDER BY c.i), list(CASE WHEN r.i = c.i THEN CAST(1 AS DOUBLE) ELSE 0 END ORDER BY c.i)) AS r FROM bn r JOIN bn c ON r.k = c.k LEFT JOIN mo ON mo.k = r.k AND mo.i = r.i AND mo.j = c.i GROUP BY 1, 2),
  rh AS (SELECT k, i, sum(w * y) AS q FROM g GROUP BY 1, 2),
  gj AS (SELECT rw.k, CAST(1 AS BIGINT) AS s, list(list_append(r, q) ORDER BY rw.i) AS m FROM rw JOIN rh ON rw.k = rh.k AND rw.i = rh.i GROUP BY rw.k
    UNION ALL SELECT k, s + 1, list_transform(m, lambda r, i: CASE WHEN i = s THEN list_transform(r, lambda v: v / m[s][s]) ELSE list_transform(r, lambda v, j: v - r[s] * m[s][j] / m[s][s]) END) FROM gj WHERE s <= len(m)),
  so AS (SELECT k, i, m[i] AS r, m[i][len(m[i])] AS b FROM (SELECT k, m, CAST(unnest(range(1, len(m) + 1)) AS BIGINT) AS i FROM gj WHERE s > len(m))),
  fm AS (SELECT g.k, g.language, sum(w * b) / max(sw) AS fb FROM g JOIN so ON g.k = so.k AND g.i = so.i GROUP BY 1, 2),
  sc AS (SELECT g.k, g.language, g.i, w * (y - b + fb) AS s FROM g JOIN so ON g.k = so.k AND g.i = so.i JOIN fm ON g.k = fm.k AND g.language = fm.language),
  pi AS (SELECT so.k, so.i, sc.language, sum(so.r[sz.m + sc.i] * sc.s) AS p FROM so JOIN sc ON so.k = sc.k JOIN sz ON sz.k = so.k GROUP BY 1, 2, 3),
  va AS (SELECT pi.k, pi.i, sqrt(sum(p * p) * max(g / (g - 1.0) * (n - 1.0) / (n - g - m))) AS se FROM pi JOIN sz ON pi.k = sz.k GROUP BY 1, 2),
  fi AS (SELECT so.k, CAST(bin AS INTEGER) AS bin, b AS coef, se FROM so JOIN va ON so.k = va.k AND so.i = va.i JOIN bn ON bn.k = so.k AND bn.i = so.i)
  SELECT {f"k AS {key}, " if key else ""}bin, coef, se, coef / se AS z, {_z_p('(coef / se)')} AS p FROM fi UNION ALL SELECT {f"k AS {key}, " if key else ""}-1, 0, 0, 0, 1 FROM sz"""


#: The pooled fit with an effect per language: normal equations of the within-language differences, solved by determinants.
_POOLED = """x AS (SELECT language, rel_week, n_func, y, CAST(rel_week AS DOUBLE) AS x1, CASE WHEN rel_week >= 0 THEN CAST(1 AS DOUBLE) ELSE 0 END AS x2, CAST(greatest(rel_week, 0) AS DOUBLE) AS x3 FROM panel),
  mm AS (SELECT language, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3 FROM x GROUP BY 1),
  w AS (SELECT y - my AS y, x1 - m1 AS x1, x2 - m2 AS x2, x3 - m3 AS x3 FROM x JOIN mm ON x.language = mm.language),
  s AS (SELECT count(*) AS n, sum(x1 * x1) AS a, sum(x1 * x2) AS b, sum(x1 * x3) AS c, sum(x2 * x2) AS e, sum(x2 * x3) AS f, sum(x3 * x3) AS i, sum(x1 * y) AS p, sum(x2 * y) AS q, sum(x3 * y) AS r FROM w),
  co AS (SELECT n, (p * (e * i - f * f) - b * (q * i - f * r) + c * (q * f - e * r)) / z AS pre_trend, (a * (q * i - f * r) - p * (b * i - f * c) + c * (b * r - q * c)) / z AS level, (a * (e * r - q * f) - b * (b * r - q * c) + p * (b * f - e * c)) / z AS slope FROM (SELECT *, a * (e * i - f * f) - b * (b * i - c * f) + c * (b * f - c * e) AS z FROM s))"""


@query("STA12_points", f"WITH {_POOLED} SELECT * FROM co", "panel", "pre_trend level slope", 6)
def pooled_points(spark, d):
    return closed.pooled_points(_panel_t(spark, d), "language")


@query("STA12", f"WITH {_pooled_errors('1')}, {_pooled_table('vc')}", "panel", "coef se z p", 6)
def pooled_cluster(spark, d):
    return panels.pooled(_panel_t(spark, d), "language", kinds=("cluster",))


@query("STA13", f"WITH {_POOLED}, g AS (SELECT rel_week AS t, n_func, (exp(y - (my - pre_trend * m1 - level * m2 - slope * m3) - pre_trend * x1) - 1) * 100 AS e FROM x JOIN mm ON x.language = mm.language, co) SELECT t, avg(e) AS effect, sum(n_func * e) / sum(n_func) AS weighted FROM g GROUP BY 1", "panel", "effect weighted", 6)
def counterfactual(spark, d):
    """Observed values against what the pooled fit says without the event."""
    p = _panel_t(spark, d).withColumn("x1", F.col("t").cast("double")).withColumn("x2", (F.col("t") >= 0).cast("double")).withColumn("x3", F.greatest(F.col("t"), F.lit(0)).cast("double"))
    w = Window.partitionBy("language")
    mean = lambda c: F.avg(c).over(w)
    fit = closed.pooled_points(p, "language").select(F.col("pre_trend").alias("b1"), F.col("level").alias("b2"), F.col("slope").alias("b3"))
    rows = p.select("t", "y", "n_func", "x1", *(mean(c).alias(f"m_{c}") for c in ("y", "x1", "x2", "x3"))).join(F.broadcast(fit))
    without = F.col("m_y") - F.col("b1") * F.col("m_x1") - F.col("b2") * F.col("m_x2") - F.col("b3") * F.col("m_x3") + F.col("b1") * F.col("x1")
    return rows.withColumn("e", numbers.percent_effect(F.col("y") - without)).groupBy("t").agg(F.avg("e").alias("effect"), rollups.weighted_mean("e", "n_func").alias("weighted"))


@query("STA14", f"WITH {_pooled_errors('1')}, {_curve(True)}", "panel", "effect se", 6)
def effect_curve(spark, d):
    return panels.effect_curve(_panel_t(spark, d), "language", list(range(-52, 157, 4)))


@query("STA15", f"WITH {_pooled_errors('1')}, {_curve(False)}", "panel", "effect se", 6)
def linear_curve(spark, d):
    return panels.effect_curve(_panel_t(spark, d), "language", list(range(-52, 157, 4)), log=False)


@query("STA16", f"WITH s AS (SELECT w, stddev_samp(v) AS y FROM (SELECT id, w, max(ln(1 + cc)) AS v FROM pm GROUP BY 1, 2) GROUP BY 1) SELECT b_n + c_n AS n_obs, b_icpt AS const, b_slope AS pre_trend, c_icpt - b_icpt AS level, c_slope - b_slope AS slope FROM (SELECT {_line('b_', 'y', 'w', 'w < 0')}, {_line('c_', 'y', 'w', 'w >= 0')} FROM s)", "pm", "const pre_trend level slope", 6)
def its_dispersion(spark, d):
    return closed.its_points(_dispersion(spark, d), [])


def _dispersion(spark, d):
    """(t, y): the weekly spread of the posts' largest values."""
    return pm(spark, d).groupBy("id", "w").agg(F.max(F.log1p("cc")).alias("v")).groupBy(F.col("w").alias("t")).agg(F.stddev_samp("v").alias("y"))


_SPREAD = "SELECT 'all' AS k, w AS t, stddev_samp(v) AS y, CAST(1 AS DOUBLE) AS w FROM (SELECT id, w, max(ln(1 + cc)) AS v FROM pm GROUP BY 1, 2) GROUP BY w HAVING count(*) > 1"


@query("STA16_errors", f"WITH {_series_errors(_SPREAD, 12)}, te AS (SELECT *, 'hac' AS errors FROM ({_series_terms('vh')}) UNION ALL SELECT *, 'classical' FROM ({_series_terms('vp')})) SELECT term, coef, se, coef / se AS z, {_z_p('(coef / se)')} AS p, errors FROM te", "pm", "coef se z p", 6)
def its_dispersion_errors(spark, d):
    """The same with HAC errors over 12 lags and with classical ones."""
    s = _dispersion(spark, d).withColumn("series", F.lit("all"))
    kinds = {"hac": {"cov": "hac", "lags": 12}, "classical": {"cov": "classical"}}
    hac, plain = (solve.its(s, "series", **k).drop("series").withColumn("errors", F.lit(n)) for n, k in kinds.items())
    return hac.unionByName(plain)


_WIDTHS = "SELECT struct_pack(language := language, model := 'wls_hac8') AS k, rel_week AS t, y, CAST(n_func AS DOUBLE) AS w FROM panel WHERE y IS NOT NULL UNION ALL SELECT struct_pack(language := language, model := 'hc3_' || x), rel_week, y, 1 FROM panel, (SELECT unnest([52, 78, 104, 130]) AS x) WHERE y IS NOT NULL AND rel_week BETWEEN -x AND x"


@query("STA17", f"WITH {_series_errors(_WIDTHS, 8)}, te AS (SELECT * FROM ({_series_terms('vh')}) WHERE k.model = 'wls_hac8' UNION ALL SELECT * FROM ({_series_terms('v3')}) WHERE k.model <> 'wls_hac8') SELECT k.language AS language, term, coef, se, coef / se AS z, {_z_p('(coef / se)')} AS p, k.model AS model FROM te", "panel", "coef se z p", 6)
def its_variants(spark, d):
    return solve.its_models(_panel_t(spark, d), "language", (52, 78, 104, 130))


@query("STA18", f"WITH {_ITS}, v AS (SELECT sum(b_rss + c_rss) / sum(b_n + c_n - 4) AS s2 FROM its) SELECT language, b_slope AS before, sqrt(s2 / b_sxx) AS before_se, c_slope AS after, sqrt(s2 / c_sxx) AS after_se FROM its, v", "panel", "before before_se after after_se", 6)
def saturated(spark, d):
    """Slopes of the saturated pooled model; its residual variance is one for all languages."""
    l = _panel_t(spark, d).groupBy("language").agg(*closed.line(F.col("y"), F.col("t"), "b_", F.col("t") < 0), *closed.line(F.col("y"), F.col("t"), "c_", F.col("t") >= 0))
    s2 = l.agg((F.sum(F.col("b_rss") + F.col("c_rss")) / F.sum(F.col("b_n") + F.col("c_n") - 4)).alias("s2"))
    return l.join(F.broadcast(s2)).select("language", F.col("b_slope").alias("before"), F.sqrt(F.col("s2") / F.col("b_sxx")).alias("before_se"), F.col("c_slope").alias("after"), F.sqrt(F.col("s2") / F.col("c_sxx")).alias("after_se"))


@query("STA19", f"WITH {_pooled_errors('n_func')}, {_pooled_table('vc vh vd')}", "panel", "coef se z p", 6)
def three_errors(spark, d):
    return panels.pooled(_panel_t(spark, d), "language", weights="n_func", lags=8)


def _bins(spark, d, event: str = EVENT, size: int = 4):
    rows = pm(spark, d).withColumn("bin", F.floor(dates.rel_bin(F.col("creationdate"), event) / size).cast("int"))
    cells = rows.groupBy("language", "bin").agg(F.avg(F.log1p("cc")).alias("y"), F.count("*").alias("n_func"))
    return cells.where(F.col("bin").between(-28, 39))


_BINS = "bins AS (SELECT language, CAST(floor(floor(days / 7.0) / 4) AS INTEGER) AS bin, avg(ln(1 + cc)) AS y, count(*) AS n_func FROM pm WHERE floor(floor(days / 7.0) / 4) BETWEEN -28 AND 39 GROUP BY 1, 2)"
_COEF = "e AS (SELECT bins.language, bin, y - r.ry AS coef FROM bins JOIN (SELECT language, y AS ry FROM bins WHERE bin = -1) r ON bins.language = r.language)"


@query("STA20", _two_way(f"{_BINS}, cells AS (SELECT 1 AS k, language, bin, y, n_func AS w FROM bins)"), "pm", "coef se z p", 6)
def event_study(spark, d):
    return panels.studies(_bins(spark, d), [], "language", "bin", weights="n_func")


def _binned(spark, d, size: int = 4):
    """The weekly panel with bins of so many weeks."""
    return _panel_t(spark, d).withColumn("bin", F.floor(F.col("t") / size).cast("int")).where(F.col("bin").between(-28, 39))


def _study(spark, d):
    e = closed.bin_study(_binned(spark, d), ["language"], "bin", "y", "n_func")
    return e.withColumn("p", F.when(F.col("bin") == -1, F.lit(1.0)).otherwise(dist.t_p_col(F.col("t"), F.col("df"))))


_CELLS = "wk AS (SELECT language, CAST(floor(rel_week / 4.0) AS INTEGER) AS bin, y, n_func AS w FROM panel WHERE floor(rel_week / 4.0) BETWEEN -28 AND 39), ce AS (SELECT language, bin, count(*) AS n, sum(w) AS w, sum(w * y) / sum(w) AS m, sum(w * y * y) - sum(w * y) ** 2 / sum(w) AS ss FROM wk GROUP BY 1, 2), v AS (SELECT language, CAST(sum(n) - count(*) AS BIGINT) AS df, sum(ss) / (sum(n) - count(*)) AS s2, max(CASE WHEN bin = -1 THEN m END) AS rm, max(CASE WHEN bin = -1 THEN w END) AS rw FROM ce GROUP BY 1)"
_EFF = f"{_CELLS}, ef AS (SELECT ce.language, bin, m - rm AS coef, CASE WHEN bin = -1 THEN 0 ELSE sqrt(s2 * (1 / w + 1 / rw)) END AS se, df FROM ce JOIN v ON ce.language = v.language WHERE rm IS NOT NULL), e AS (SELECT *, CASE WHEN bin = -1 THEN 1 ELSE {_t_p('coef / nullif(se, 0)', 'df')} END AS p FROM ef)"


@query("STA21", f"WITH {_EFF} SELECT language, bin, coef, se, p FROM e", "panel", "coef se p", 6)
def per_language_study(spark, d):
    return _study(spark, d).select("language", "bin", "coef", "se", "p")


_BINNED = "SELECT language AS k, rel_week AS t, CAST(floor(rel_week / 4.0) AS INTEGER) AS bin, y, CAST(n_func AS DOUBLE) AS w FROM panel WHERE y IS NOT NULL AND floor(rel_week / 4.0) BETWEEN -28 AND 39"


@query("STA21_hac", f"WITH {_bins_hac(_BINNED, 3, '-1')} SELECT k AS language, bin, coef, se, coef / se AS z, {_z_p('(coef / se)')} AS p FROM te", "panel", "coef se z p", 6)
def per_language_study_hac(spark, d):
    return solve.bin_study_hac(_binned(spark, d), "language", "bin", "t", 3, weights="n_func")


@query("STA22", _two_way(f"{_BINS}, cells AS (SELECT 1 AS k, language, bin, y, 1 AS w FROM bins)"), "pm", "coef se z p", 6)
def two_way_study(spark, d):
    return panels.studies(_bins(spark, d), [], "language", "bin")


@query("STA23", "WITH c AS (SELECT CAST(floor(floor(days / 7.0) / 12) AS INTEGER) AS bin, avg(ln(1 + cc)) AS y FROM pm WHERE floor(floor(days / 7.0) / 12) <> -1 GROUP BY 1) SELECT bin, y - (SELECT arg_min(y, bin) FROM c) AS coef FROM c", "pm", "coef", 6)
def coarse_study(spark, d):
    c = pm(spark, d).groupBy(F.floor(F.col("w") / 12).cast("int").alias("bin")).agg(F.avg(F.log1p("cc")).alias("y")).where("bin != -1")
    first = c.agg(F.min_by("y", "bin").alias("base"))
    return c.join(F.broadcast(first)).select("bin", (F.col("y") - F.col("base")).alias("coef"))


_COARSE = "SELECT 'all' AS k, t, CAST(floor(t / 12.0) AS INTEGER) AS bin, y, CAST(1 AS DOUBLE) AS w FROM weekly WHERE floor(t / 12.0) <> -1"


@query("STA23_hac", f"WITH {_bins_hac(_COARSE, 8, 'min(bin)')} SELECT bin, coef, se, coef / se AS z, {_z_p('(coef / se)')} AS p FROM te", "weekly", "coef se z p", 6)
def coarse_study_hac(spark, d):
    rows = weekly(spark, d).withColumn("bin", F.floor(F.col("t") / 12).cast("int")).where("bin != -1").withColumn("series", F.lit("all"))
    return solve.bin_study_hac(rows, "series", "bin", "t", 8, ref=None).drop("series")


_PRE = "s AS (SELECT language, regr_slope(coef, bin) AS trend, avg(coef) / (stddev_samp(coef) / sqrt(count(*))) AS t, count(*) AS n FROM e WHERE bin < 0 GROUP BY 1)"


@query("STA24", f"WITH {_EFF}, {_PRE}, k AS (SELECT *, {_t_p('t', '(n - 1)')} AS p FROM s) SELECT language, trend, t, n, p, least(p * count(*) OVER (), 1.0) AS p_adjusted FROM k", "panel", "trend t p p_adjusted", 5)
def pre_trends(spark, d):
    e = _study(spark, d).where("bin < 0")
    s = e.groupBy("language").agg(F.regr_slope(F.col("coef"), F.col("bin").cast("double")).alias("trend"), closed.one_sample_t(F.col("coef")).alias("t"), F.count("*").alias("n"))
    s = s.withColumn("p", dist.t_p_col(F.col("t"), F.col("n") - 1))
    return s.withColumn("p_adjusted", numbers.bonferroni(F.col("p"), F.count("*").over(Window.partitionBy(F.lit(1)))))


@query("STA25", f"WITH {_EFF} SELECT language, avg(CASE WHEN p < 0.05 THEN 1.0 ELSE 0.0 END) AS share, avg(CASE WHEN p < 0.05 THEN 1.0 ELSE 0.0 END) > 0.2 AS warn FROM e WHERE bin < -1 GROUP BY 1", "panel", "share", 6)
def pre_share(spark, d):
    share = F.avg(F.coalesce(F.col("p") < 0.05, F.lit(False)).cast("double"))
    return _study(spark, d).where("bin < -1").groupBy("language").agg(share.alias("share"), (share > 0.2).alias("warn"))


@query("STA26", f"WITH {_EFF} SELECT language, avg(coef) AS mean, median(coef) AS med, count(*) FILTER (p < 0.05) AS significant, count(*) FILTER (coef > 0) AS positive, regr_slope(coef, bin) AS trend, max_by(coef, bin) AS last FROM e WHERE bin > 0 GROUP BY 1", "panel", "mean med trend last", 6)
def post_summary(spark, d):
    e = _study(spark, d).where("bin > 0")
    return e.groupBy("language").agg(F.avg("coef").alias("mean"), F.median("coef").alias("med"), F.count_if(F.col("p") < 0.05).alias("significant"), F.count_if(F.col("coef") > 0).alias("positive"), F.regr_slope(F.col("coef"), F.col("bin").cast("double")).alias("trend"), F.max_by("coef", "bin").alias("last"))


@query("STA27", f"WITH {_BINS}, {_COEF} SELECT language, avg(coef) FILTER (bin < 0) AS pre, avg(coef) FILTER (bin >= 0) AS post FROM e GROUP BY 1 HAVING count(*) FILTER (bin < 0) >= 3 AND count(*) FILTER (bin >= 0) >= 3", "pm", "pre post", 6)
def language_summary(spark, d):
    e = closed.bin_effects(_bins(spark, d), ["language"], "bin", "y", "n_func")
    pre, post = F.col("bin") < 0, F.col("bin") >= 0
    out = e.groupBy("language").agg(F.avg(F.when(pre, F.col("coef"))).alias("pre"), F.avg(F.when(post, F.col("coef"))).alias("post"), F.count_if(pre).alias("a"), F.count_if(post).alias("b"))
    return out.where("a >= 3 and b >= 3").select("language", "pre", "post")


@query("STA28", _two_way(f"{_BINS}, cells AS (SELECT o.language AS k, bins.language, bin, y, n_func AS w FROM bins, (SELECT DISTINCT language FROM bins) o WHERE o.language <> bins.language)", "left_out"), "pm", "coef se z p", 6)
def left_out(spark, d):
    return panels.studies(_bins(spark, d), [], "language", "bin", weights="n_func", left_out=True)


@query("STA29", _two_way(f"pb AS (SELECT language, cc, CAST(floor(floor(date_diff('day', DATE '{PLACEBO}', CAST(creationdate AS DATE)) / 7.0) / 4) AS INTEGER) AS bin FROM pm), cells AS (SELECT 1 AS k, language, bin, avg(ln(1 + cc)) AS y, count(*) AS w FROM pb WHERE bin BETWEEN -28 AND 12 GROUP BY 2, 3)"), "pm", "coef se z p", 6)
def placebo_study(spark, d):
    cells = _bins(spark, d, PLACEBO).where("bin <= 12")
    return panels.studies(cells, [], "language", "bin", weights="n_func")


@query("STA30", "WITH x AS (SELECT unnest([-78, -52, -26, 0]) AS brk), l AS (SELECT brk, " + ", ".join(_line(p, "y", "t", w) for p, w in (("a_", "TRUE"), ("b_", "t < brk"), ("c_", "t >= brk"))) + " FROM weekly, x GROUP BY 1) SELECT brk, b_n AS n_pre, c_n AS n_post, ((a_rss - b_rss - c_rss) / 2) / ((b_rss + c_rss) / (a_n - 4)) AS f FROM l WHERE b_n >= 20 AND c_n >= 20", "weekly", "f", 6)
def placebo_chow(spark, d):
    rows = weekly(spark, d).withColumn("brk", F.explode(F.array(*map(F.lit, (-78, -52, -26, 0)))))
    return closed.chow(rows, ["brk"], "y", "t", F.col("t") < F.col("brk")).where("n_pre >= 20 and n_post >= 20").select("brk", "n_pre", "n_post", "f")


@query("STA31", _two_way("zs AS (SELECT CAST(unnest([2, 8, 13]) AS INTEGER) AS size), cells AS (SELECT size AS k, language, CAST(floor(rel_week / CAST(size AS DOUBLE)) AS INTEGER) AS bin, sum(n_func * y) / sum(n_func) AS y, sum(n_func) AS w FROM panel, zs WHERE floor(rel_week / CAST(size AS DOUBLE)) BETWEEN -28 AND 39 GROUP BY 1, 2, 3)", "size"), "panel", "coef se z p", 6)
def bin_sizes(spark, d):
    """Bins of several widths, all from one weekly panel of weighted means."""
    rows = _panel_t(spark, d).withColumn("size", F.explode(F.array(*map(F.lit, (2, 8, 13))))).withColumn("bin", F.floor(F.col("t") / F.col("size")).cast("int"))
    cells = rows.groupBy("size", "language", "bin").agg(rollups.weighted_mean("y", "n_func").alias("y"), F.sum("n_func").alias("n_func")).where(F.col("bin").between(-28, 39))
    return panels.studies(cells, ["size"], "language", "bin", weights="n_func")


_DID = "w AS (SELECT tag, language, w AS t, CAST(count(*) AS DOUBLE) AS y, tag IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5') AS tr FROM pt GROUP BY 1, 2, 3)"


def _did_rows(spark, d):
    rows = pt(spark, d).groupBy("tag", "language", F.col("w").alias("t")).agg(F.count("*").cast("double").alias("y"))
    return rows, F.col("tag").isin(*(f"Brand#{i}" for i in range(1, 6)))


def _did_sql(by: str) -> str:
    keys = f"{by}, " if by else ""
    cells = {"p": "tr AND t >= 0", "q": "tr AND t < 0", "r": "NOT tr AND t >= 0", "s": "NOT tr AND t < 0"}
    lines = ", ".join(_line(f"{k}_", "y", "t", v) for k, v in cells.items())
    group = f" GROUP BY {by}" if by else ""
    rss, n, inv = (" + ".join(f"{f}".replace("#", k) for k in cells) for f in ("#_rss", "#_n", "1 / #_sxx"))
    return f"WITH {_DID}, l AS (SELECT {keys}{lines} FROM w{group}), e AS (SELECT {keys}{n} AS n, (p_slope - q_slope) - (r_slope - s_slope) AS effect, sqrt(({rss}) / ({n} - 8) * ({inv})) AS se FROM l) SELECT *, effect / se AS t FROM e"


@query("STA32", _did_sql(""), "pt", "effect se t", 5)
def did(spark, d):
    rows, treated = _did_rows(spark, d)
    return closed.did(rows, [], "y", "t", treated)


@query("STA33", _did_sql("language"), "pt", "effect se t", 5)
def did_by_language(spark, d):
    rows, treated = _did_rows(spark, d)
    return closed.did(rows, ["language"], "y", "t", treated)


@query("STA34", f"WITH {_STUDY}, {_META} SELECT k, fixed, fixed_se, q, i2, tau2, (SELECT sum(effect / (se ** 2 + tau2)) / sum(1 / (se ** 2 + tau2)) FROM study WHERE se > 0) AS random, (SELECT sqrt(1 / sum(1 / (se ** 2 + tau2))) FROM study WHERE se > 0) AS random_se FROM h", "pt", "fixed fixed_se q i2 tau2 random random_se", 6)
def meta(spark, d):
    return closed.meta(studies(spark, d), [])


@query("STA35", f"WITH {_STUDY}, r AS (SELECT effect / se AS y, 1 / se AS x FROM study WHERE se > 0), l AS (SELECT {_line('', 'y', 'x', 'TRUE')} FROM r), g AS (SELECT n, icpt AS intercept, sqrt(rss / (n - 2) * (1 / n + xm ** 2 / sxx)) AS se FROM l WHERE n >= 10) SELECT *, intercept / se AS t, {_t_p('intercept / se', '(n - 2)')} AS p FROM g", "pt", "intercept se t p", 5)
def egger(spark, d):
    return closed.egger(studies(spark, d), []).withColumn("p", dist.t_p_col(F.col("t"), F.col("n") - 2))


@query("STA36", f"WITH {_ITS}, r AS (SELECT panel.language, rel_week, y - CASE WHEN rel_week < 0 THEN b_icpt + b_slope * rel_week ELSE c_icpt + c_slope * rel_week END AS e FROM panel JOIN its ON panel.language = its.language), g AS (SELECT *, e - lag(e) OVER (PARTITION BY language ORDER BY rel_week) AS de FROM r) SELECT language, sum(de ** 2) / sum(e ** 2) AS dw FROM g GROUP BY 1", "panel", "dw", 6)
def durbin_watson(spark, d):
    return closed.durbin_watson(closed.its_residuals(_panel_t(spark, d), ["language"]), ["language"], "t", "resid")


_ITS_X = "CAST(1 AS DOUBLE), CAST(t AS DOUBLE), CASE WHEN t >= 0 THEN CAST(1 AS DOUBLE) ELSE 0 END, CAST(greatest(t, 0) AS DOUBLE)"
_TESTS = f"""er AS (SELECT k, t, e, {", ".join(f"coalesce(lag(e, {i}) OVER (PARTITION BY k ORDER BY t), 0) AS l{i}" for i in range(1, 5))} FROM ro),
  {_regression(f"SELECT k, t, [{_ITS_X}, l1, l2, l3, l4] AS x, e AS y FROM er", 8, "g")}, {_regression(f"SELECT k, t, [{_ITS_X}] AS x, e * e AS y FROM er", 4, "p")},
  gb AS (SELECT r.k, count(*) - sum((y - list_dot_product(x, b)) ** 2) / var_pop(y) AS bg FROM grg r JOIN gft f ON r.k = f.k GROUP BY 1),
  pb AS (SELECT r.k, count(*) - sum((y - list_dot_product(x, b)) ** 2) / var_pop(y) AS bp FROM prg r JOIN pft f ON r.k = f.k GROUP BY 1),
  dw AS (SELECT k, sum(CASE WHEN t > first THEN (e - l1) ** 2 ELSE 0 END) / sum(e * e) AS dw FROM (SELECT *, min(t) OVER (PARTITION BY k) AS first FROM er) GROUP BY 1)"""


@query("STA36_tests", f"WITH RECURSIVE {_series_errors(_PLAIN)}, {_TESTS} SELECT dw.k AS language, dw, bg, exp(-1 * bg / 2) * (1 + bg / 2) AS bg_p, bp, {_z_p('sqrt(bp)')} + sqrt(2 * bp / pi()) * exp(-1 * bp / 2) AS bp_p FROM dw JOIN gb ON dw.k = gb.k JOIN pb ON dw.k = pb.k", "panel", "dw bg bg_p bp bp_p", 6)
def diagnostics(spark, d):
    return solve.diagnostics(_panel_t(spark, d), "language")


_RHO = "r AS (SELECT language, y, n_func, rank() OVER (PARTITION BY language ORDER BY y) + (count(*) OVER (PARTITION BY language, y) - 1) / 2 AS ry, rank() OVER (PARTITION BY language ORDER BY n_func) + (count(*) OVER (PARTITION BY language, n_func) - 1) / 2 AS rn FROM panel WHERE y IS NOT NULL), c AS (SELECT language, count(*) AS n, corr(y, n_func) AS pearson, corr(ry, rn) AS spearman FROM r GROUP BY 1)"


@query("STA37", f"WITH {_RHO} SELECT language, pearson, {_t_p('pearson * sqrt((n - 2) / (1 - pearson ** 2))', '(n - 2)')} AS pearson_p, spearman, {_t_p('spearman * sqrt((n - 2) / (1 - spearman ** 2))', '(n - 2)')} AS spearman_p FROM c", "panel", "pearson pearson_p spearman spearman_p", 6)
def correlations(spark, d):
    p = panel(spark, d)
    one = lambda f, name: f(p, ["language"], "y", "n_func").select("language", F.col("r").alias(name), dist.t_p_col(F.col("t"), F.col("n") - 2).alias(f"{name}_p"))
    return one(closed.pearson, "pearson").join(one(closed.spearman, "spearman"), "language")


@query("STA38", f"WITH {_OLS}, k AS (SELECT language, {_t_p('slope / se', '(n - 2)')} AS p FROM o) SELECT language, p, least(p * count(*) OVER (), 1.0) AS p_adjusted FROM k", "panel", "p p_adjusted", 6)
def bonferroni(spark, d):
    o = closed.ols(panel(spark, d), ["language"], "y", "rel_week")
    o = o.select("language", dist.t_p_col(F.col("t"), F.col("n") - 2).alias("p"))
    return o.withColumn("p_adjusted", numbers.bonferroni(F.col("p"), F.count("*").over(Window.partitionBy(F.lit(1)))))


@query("STA39", f"WITH l AS (SELECT *, n - 2 AS df FROM (SELECT {_line('', 'y', 't', 'TRUE')} FROM weekly)), {_t_quantiles('l')}, f AS (SELECT x, df, icpt + slope * x AS fit, sqrt(rss / df * (1 / n + (x - xm) ** 2 / sxx)) AS se FROM l, (SELECT CAST(unnest([-150, -100, -50, 0, 50, 100, 150]) AS INTEGER) AS x)) SELECT x, fit - tq * se AS low, fit, fit + tq * se AS high FROM f JOIN tq ON f.df = tq.df", "weekly", "low fit high", 6)
def mean_band(spark, d):
    l = weekly(spark, d).agg(*closed.line(F.col("y"), F.col("t")))
    g = l.withColumn("x", F.explode(F.sequence(F.lit(-150), F.lit(150), F.lit(50))))
    fit, half = F.col("icpt") + F.col("slope") * F.col("x"), dist.t_quantile_col(F.lit(0.975), F.col("n") - 2) * closed.mean_se(F.col("x"))
    return g.select("x", (fit - half).alias("low"), fit.alias("fit"), (fit + half).alias("high"))


@query("STA40", "WITH g AS (SELECT entity, t, md5(concat_ws('|', '5', entity, CAST(t AS VARCHAR))) AS h FROM (SELECT language AS entity, rel_week AS t FROM panel)), n AS (SELECT *, sqrt(-2 * ln((CAST(('0x' || substr(h, 1, 8)) AS BIGINT) + 1) / 4294967297.0)) * cos(2 * pi() * (CAST(('0x' || substr(h, 9, 8)) AS BIGINT) + 1) / 4294967297.0) AS e FROM g) SELECT entity, t, 0.9 + 0.001 * t + CASE WHEN t >= 0 THEN 0.05 + 0.002 * t ELSE 0 END + 0.02 * e AS y FROM n", "panel", "y", 8)
def synthetic(spark, d):
    """Series of known coefficients in the cells that the panel has: what the estimators must find again."""
    return closed.synthetic_series(panel(spark, d), "language", "rel_week", 0.9, 0.001, 0.05, 0.002, 0.02, 5)


@query("STA41", "WITH k AS (SELECT unnest([-104, -52, 0, 52]) AS s) SELECT s AS start, regr_slope(y, t) AS slope, count(*) AS n FROM weekly, k WHERE t >= s AND t < s + 78 GROUP BY 1", "weekly", "slope", 6)
def moving_fits(spark, d):
    rows = weekly(spark, d).withColumn("start", F.explode(F.array(*map(F.lit, (-104, -52, 0, 52))))).where("t >= start and t < start + 78")
    return rows.groupBy("start").agg(F.regr_slope(F.col("y"), F.col("t").cast("double")).alias("slope"), F.count("*").alias("n"))


def _lowess_sql(rounds: int) -> str:
    """The smoother in SQL: r0 has the rows, o0, o1, ... the smoothed values of the rounds, w1, w2, ... the robust weights between them."""
    out = ["r0 AS (SELECT language, CAST(rel_week AS DOUBLE) AS x, y, row_number() OVER (PARTITION BY language ORDER BY rel_week, y) AS i, least(count(*) OVER (PARTITION BY language), greatest(2, floor(0.2 * count(*) OVER (PARTITION BY language) + 1e-10))) AS k FROM panel WHERE y IS NOT NULL)", "w0 AS (SELECT language, i, CAST(1 AS DOUBLE) AS r FROM r0)"]
    for n in range(rounds + 1):
        out += [
            f"n{n} AS (SELECT a.language, a.i, a.x AS ax, b.x, b.y, w.r, abs(b.x - a.x) AS d FROM r0 a JOIN r0 b ON a.language = b.language AND abs(a.i - b.i) < a.k JOIN w{n} w ON w.language = b.language AND w.i = b.i QUALIFY row_number() OVER (PARTITION BY a.language, a.i ORDER BY abs(b.x - a.x), b.i) <= a.k)",
            f"g{n} AS (SELECT *, greatest(0, 1 - (d / greatest(max(d) OVER (PARTITION BY language, i), 1e-12)) ** 3) ** 3 * r AS w FROM n{n})",
            f"m{n} AS (SELECT language, i, sum(w) AS w, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM g{n} GROUP BY 1, 2)",
            f"s{n} AS (SELECT g.language, g.i, max(ax) AS ax, max(my) AS my, max(mx) AS mx, sum(g.w * (x - mx) ** 2) AS sxx, sum(g.w * (x - mx) * (y - my)) AS sxy FROM g{n} g JOIN m{n} m ON g.language = m.language AND g.i = m.i WHERE m.w > 0 GROUP BY 1, 2)",
            f"o{n} AS (SELECT r0.language, r0.i, r0.x, r0.y, coalesce(my + CASE WHEN sxx > 1e-12 THEN sxy / sxx ELSE 0 END * (ax - mx), {f'p.o' if n else 'r0.y'}) AS o FROM r0 LEFT JOIN s{n} s ON s.language = r0.language AND s.i = r0.i{f' JOIN o{n - 1} p ON p.language = r0.language AND p.i = r0.i' if n else ''})",
            f"w{n + 1} AS (SELECT language, i, CASE WHEN med > 0 THEN greatest(0, 1 - (abs(y - o) / (6 * med)) ** 2) ** 2 ELSE 1 END AS r FROM (SELECT *, median(abs(y - o)) OVER (PARTITION BY language) AS med FROM o{n}))",
        ]
    return f"WITH {', '.join(out[:-1])} SELECT language, x AS t, o AS smooth FROM o{rounds}"


@query("STA42", _lowess_sql(3), "panel", "smooth", 6)
def smoothed(spark, d):
    return smooth.lowess(_panel_t(spark, d), "language", "t", "y")


_KNOTS = "SELECT language AS k, rel_week AS t, [CAST(1 AS DOUBLE), CAST(rel_week AS DOUBLE), CAST(greatest(rel_week, 0) AS DOUBLE), CAST(greatest(rel_week - 52, 0) AS DOUBLE), CAST(greatest(rel_week - 104, 0) AS DOUBLE)] AS x, y FROM panel WHERE y IS NOT NULL"
_SPLINE = f"""{_regression(_KNOTS, 5)}, fl AS (SELECT r.k, row_number() OVER (PARTITION BY r.k ORDER BY t) AS i, list_transform(inv, lambda v: list_dot_product(v, x) * (y - list_dot_product(x, b))) AS p FROM rg r JOIN ft f ON r.k = f.k),
  vh AS (SELECT a.k, c, sum(a.p[c] * b.p[c] * (1 - abs(a.i - b.i) / 5.0)) AS v FROM fl a JOIN fl b ON a.k = b.k AND abs(a.i - b.i) <= 4, (SELECT CAST(unnest(range(1, 6)) AS BIGINT) AS c) GROUP BY 1, 2),
  te AS (SELECT ft.k, c, b[c] AS coef, sqrt(v) AS se FROM ft JOIN vh ON ft.k = vh.k)"""


@query("STA43", f"WITH RECURSIVE {_SPLINE} SELECT k AS language, ['const', 't', 'after_0', 'after_52', 'after_104'][c] AS term, coef, se, coef / se AS z, {_z_p('(coef / se)')} AS p FROM te", "panel", "coef se z p", 6)
def spline(spark, d):
    return solve.spline(_panel_t(spark, d), "language")


@query("STA44", f"WITH {_ITS}, s AS (SELECT language, c_slope - b_slope AS effect, 1 / ((b_rss + c_rss) / (b_n + c_n - 4) * (1 / b_sxx + 1 / c_sxx)) AS w FROM its), i AS (SELECT language, ln(1 + count(*)) AS v FROM dated WHERE days < 0 GROUP BY 1), j AS (SELECT w, v, effect FROM s JOIN i ON s.language = i.language), a AS (SELECT sum(w) AS w, sum(w * v) AS wx, sum(w * effect) AS wy, sum(w * v * v) AS wxx, sum(w * v * effect) AS wxy, count(*) AS n FROM j) SELECT n, (wxy - wx * wy / w) / (wxx - wx * wx / w) AS slope FROM a", "panel dated", "slope", 4)
def meta_regression(spark, d):
    p = _panel_t(spark, d)
    l = p.groupBy("language").agg(*closed.line(F.col("y"), F.col("t"), "b_", F.col("t") < 0), *closed.line(F.col("y"), F.col("t"), "c_", F.col("t") >= 0))
    var = (F.col("b_rss") + F.col("c_rss")) / (F.col("b_n") + F.col("c_n") - 4) * (1 / F.col("b_sxx") + 1 / F.col("c_sxx"))
    s = l.select("language", (F.col("c_slope") - F.col("b_slope")).alias("effect"), (1 / var).alias("w"))
    i = dated(spark, d).where("days < 0").groupBy("language").agg(F.log1p(F.count("*")).alias("v"))
    return closed.wls(s.join(i, "language"), [], "effect", "v", "w").select("n", "slope")
