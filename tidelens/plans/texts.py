"""Text functions, tag networks and prompts as registered queries."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import functions as F

from ..complexity import metrics
from ..complexity.languages import LANGUAGES
from ..functions import dates, text
from ..operators import annotation, network
from ..sources.adapters import posts, table, tags, votes
from .registry import query
from .relational import _golden, _targets, pt


def _html(spark, d):
    return table(spark, d, "pages").select("page_id", "url", "html")


_PY = '<pre class="lang-py prettyprint-override"><code>'


def _body():
    """A post about a page that quotes the whole page as code, or in its text: the test pages themselves hold no code blocks."""
    show = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page, url = show(F.col("html")), show(F.col("url"))
    one = F.concat(F.lit("<p>see "), url, F.lit("</p><pre><code>"), page, F.lit("</code></pre>"))
    two = F.concat(one, F.lit("<p>and</p>" + _PY), url, F.lit("</code></pre><p>end</p>"))
    return F.when(F.col("page_id") % 3 == 0, two).when(F.col("page_id") % 3 == 1, one).otherwise(F.concat(F.lit("<p>"), page, F.lit("</p>")))


def _body_sql(page: str, url: str) -> str:
    one = f"'<p>see ' || {url} || '</p><pre><code>' || {page} || '</code></pre>'"
    return f"CASE page_id % 3 WHEN 0 THEN {one} || '<p>and</p>{_PY}' || {url} || '</code></pre><p>end</p>' WHEN 1 THEN {one} ELSE '<p>' || {page} || '</p>' END"


_SHOWN = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_BODY = f"b AS (SELECT page_id, {_body_sql(_SHOWN.format('html'), _SHOWN.format('url'))} AS body FROM pages)"
#: The same without its entities.
_PLAIN = f"u AS (SELECT page_id, {_body_sql('html', 'url')} AS body FROM pages)"
_CODE = f"regexp_extract_all(body, '(?s)(?:<pre><code>|{_PY})(.*?)</code></pre>', 1)"


@query("STR1", "SELECT page_id, md5(regexp_replace(html, '<[^>\\n]*>', '', 'g')) AS h FROM pages")
def remove_tags(spark, d):
    return _html(spark, d).select("page_id", F.md5(text.remove_tags(F.col("html"))).alias("h"))


def _entities_sql(column: str) -> str:
    """en (page_id, u): a column of pages with its HTML entities replaced, in SQL; values are code points, for white space does not survive here."""
    replaced, keys, values = text.REPLACED, ", ".join(f"'{k}'" for k in html5), [[ord(c) for c in v] for v in html5.values()]
    size = max(map(len, text.LEGACY))
    begins = ", ".join(f"CASE WHEN length(b) > {n} THEN array_to_string(list_transform(v[list_position(k, substr(b, 1, {n}))], lambda c: chr(c)), '') || substr(b, {n + 1}) END" for n in range(size, 1, -1))
    return f"""nm AS (SELECT [{keys}] AS k, {values} AS v, {list(replaced)} AS rk, {[ord(v) for v in replaced.values()]} AS rv),
  sr AS (SELECT page_id, {column} AS s FROM pages),
  ms AS (SELECT page_id, i, m, substr(m, 2) AS b FROM (SELECT page_id, unnest(regexp_extract_all(s, '{text.REFERENCE}')) AS m, generate_subscripts(regexp_extract_all(s, '{text.REFERENCE}'), 1) AS i FROM sr)),
  dg AS (SELECT *, ltrim(regexp_replace(b, '^#[xX]?|;$', '', 'g'), '0') AS d FROM ms),
  cd AS (SELECT *, CASE WHEN b NOT LIKE '#%' THEN NULL WHEN d = '' THEN 0 WHEN length(d) > 8 THEN 1114112 WHEN b ILIKE '#x%' THEN CAST('0x' || d AS BIGINT) ELSE CAST(d AS BIGINT) END AS c FROM dg),
  ch AS (SELECT page_id, i, CASE WHEN c IS NULL THEN coalesce(array_to_string(list_transform(v[list_position(k, b)], lambda c: chr(c)), ''), {begins}, m)
    WHEN list_contains(rk, c) THEN chr(rv[list_position(rk, c)]) WHEN c BETWEEN 55296 AND 57343 OR c > 1114111 THEN chr(65533)
    WHEN c BETWEEN 1 AND 8 OR c = 11 OR c BETWEEN 14 AND 31 OR c = 127 OR c BETWEEN 64976 AND 65007 OR c & 65534 = 65534 THEN '' ELSE chr(CAST(c AS INTEGER)) END AS x FROM cd, nm),
  al AS (SELECT page_id, list(x ORDER BY i) AS x FROM ch GROUP BY 1),
  en AS (SELECT sr.page_id, array_to_string(list_transform(string_split_regex(s, '{text.REFERENCE}'), lambda g, i: g || coalesce(al.x[i], '')), '') AS u FROM sr LEFT JOIN al ON al.page_id = sr.page_id)"""


@query("STR2", f"WITH {_entities_sql('html')} SELECT page_id, md5(u) AS h FROM en")
def unescape(spark, d):
    return _html(spark, d).select("page_id", F.md5(text.unescape(F.col("html"))).alias("h"))


@query("STR2_basic", "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&')) AS h FROM pages")
def unescape_basic(spark, d):
    return _html(spark, d).select("page_id", F.md5(text.unescape_basic(F.col("html"))).alias("h"))


_NO_TAGS = "regexp_replace(html, '<[^>\\n]*>', '', 'g')"


@query("STR3", f"WITH {_entities_sql(_NO_TAGS)} SELECT page_id, md5(u) AS h FROM en")
def clean(spark, d):
    return _html(spark, d).select("page_id", F.md5(text.clean_html(F.col("html"))).alias("h"))


@query("STR4", f"WITH {_BODY} SELECT page_id, replace(regexp_replace(body, '<pre( class=\"[^\"]*\")?><code>', '```python' || chr(10), 'g'), '</code></pre>', '```') AS fenced FROM b")
def fenced(spark, d):
    return _html(spark, d).select("page_id", text.fence_code(_body()).alias("fenced"))


@query("STR5", f"WITH {_BODY} SELECT page_id, regexp_replace(body, ';+(\\S)', '\\1', 'g') AS scrubbed FROM b")
def scrubbed(spark, d):
    return _html(spark, d).select("page_id", text.scrub_semicolons(_body()).alias("scrubbed"))


@query("STR6", "SELECT p_partkey, '<Title>' || coalesce(CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END, 'None') || '</Title>. <Question>' || p_type || '</Question> ' AS q FROM part")
def question(spark, d):
    title = F.when(F.col("p_partkey") % 5 != 0, F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", text.question_text(title, F.col("p_type")).alias("q"))


def _sections(spark, d):
    return _html(spark, d).select("page_id", _body().alias("body")).withColumn("s", text.code_sections("body"))


@query("STR7", f"WITH {_PLAIN} SELECT page_id, len({_CODE}) AS n, array_to_string({_CODE}, '|') AS code FROM u")
def sections(spark, d):
    return _sections(spark, d).select("page_id", F.size("s").cast("long").alias("n"), F.array_join("s.span_str", "|").alias("code"))


@query("STR8", f"WITH {_PLAIN} SELECT page_id, contains(body, '<pre><code>') OR contains(body, '{_PY}') AS has_code FROM u")
def has_code(spark, d):
    return _html(spark, d).select("page_id", text.has_sections(_body()).alias("has_code"))


@query("STR9", f"WITH {_PLAIN} SELECT page_id, regexp_replace(body, '(?s)(<pre><code>|{_PY})(.*?)(</code></pre>)', '\\1' || repeat(chr(10), 3) || '\\3', 'g') AS prose FROM u")
def prose(spark, d):
    whole = _sections(spark, d).withColumn("u", text.unescape(F.col("body")))
    return whole.select("page_id", text.prose_text(F.col("u"), F.col("s")).alias("prose"))


@query("STR10", f"WITH {_PLAIN} SELECT page_id, array_to_string({_CODE}, repeat(chr(10), 3)) AS code FROM u")
def code(spark, d):
    return _sections(spark, d).select("page_id", text.code_text(F.col("s")).alias("code"))


@query("STR11", f"WITH {_PLAIN}, x AS (SELECT page_id, unnest({_CODE}) AS src FROM u) SELECT * FROM x WHERE src <> ''")
def sources(spark, d):
    return _sections(spark, d).select("page_id", F.explode_outer("s.span_str").alias("src")).where("src != ''")


_TAGTEXT = "tt AS (SELECT id, string_agg('<' || tag || '>', '' ORDER BY tag) AS tags FROM tags GROUP BY id)"


def _tag_text(spark, d):
    return tags(spark, d).groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_set("tag")), lambda t: F.concat(F.lit("<"), t, F.lit(">"))), "").alias("tags"))


@query("STR12", f"WITH {_TAGTEXT} SELECT id, array_to_string(regexp_extract_all(tags, '<(.*?)>', 1), ',') AS names FROM tt", "tags")
def tag_names(spark, d):
    return _tag_text(spark, d).select("id", F.array_join(text.tag_list(F.col("tags")), ",").alias("names"))


def _answers(spark, d):
    v = votes(spark, d)
    said = F.concat(F.lit("So <Difficulty Level> "), F.col("label").cast("string"), F.lit(" </Difficulty Level>"))
    return v.select("id", "draw", F.when(F.col("draw") == 5, F.lit("no idea")).otherwise(said).alias("result_long"))


_ANSWERS = "a AS (SELECT id, draw, CASE WHEN draw = 5 THEN 'no idea' ELSE 'So <Difficulty Level> ' || label || ' </Difficulty Level>' END AS result_long FROM votes)"


@query("STR13", f"WITH {_ANSWERS} SELECT id, draw, try_cast(nullif(regexp_extract(result_long, '<Difficulty Level>\\s*(\\d)\\s*', 1), '') AS INTEGER) AS level FROM a", "votes")
def level(spark, d):
    return _answers(spark, d).select("id", "draw", text.level_of(F.col("result_long")).alias("level"))


@query("STR14", f"WITH {_ANSWERS} SELECT id, draw, regexp_replace(result_long, '[^0-9]', '', 'g') AS digits, regexp_replace(result_long, '[^012]', '', 'g') AS levels FROM a", "votes")
def digits(spark, d):
    return _answers(spark, d).select("id", "draw", text.keep_chars(F.col("result_long"), "0-9").alias("digits"), text.keep_chars(F.col("result_long"), "012").alias("levels"))


@query("STR15", f"WITH {_ANSWERS} SELECT id, draw, replace(result_long, '<Difficulty Level>', '') AS r FROM a", "votes")
def literal(spark, d):
    return _answers(spark, d).select("id", "draw", F.replace("result_long", F.lit("<Difficulty Level>"), F.lit("")).alias("r"))


@query("STR16", "SELECT l_orderkey, l_linenumber, CAST(l_orderkey AS INTEGER) AS id FROM lineitem")
def file_id(spark, d):
    name = F.concat_ws("_", F.col("l_linenumber").cast("string"), F.concat(F.col("l_orderkey").cast("string"), F.lit(".py")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.id_of_file(name).alias("id"))


@query("STR18", "SELECT s_suppkey, CAST(regexp_extract(s_name, '(\\d+)', 1) AS BIGINT) AS n FROM supplier")
def first_number(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", text.first_number(F.col("s_name")).alias("n"))


@query("STR19", "SELECT p_partkey, split_part(replace(p_name, ' ', '/'), '/', 1) AS a, split_part(replace(p_name, ' ', '/'), '/', 2) AS b FROM part")
def split_key(spark, d):
    parts = F.split(F.replace("p_name", F.lit(" "), F.lit("/")), "/")
    return table(spark, d, "part").select("p_partkey", F.get(parts, F.lit(0)).alias("a"), F.get(parts, F.lit(1)).alias("b"))


@query("JSN1", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.m.n') AS missing FROM events")
def safe_get(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.m.n").alias("missing"))


# ---- networks


@query("ARR1", "SELECT x.id, x.tag AS a, y.tag AS b FROM tags x JOIN tags y ON x.id = y.id AND x.tag < y.tag", "tags")
def tag_pairs(spark, d):
    return network.pairs(tags(spark, d))


@query("ARR2", "SELECT id, tag FROM tags", "tags")
def exploded(spark, d):
    return tags(spark, d).groupBy("id").agg(F.collect_list("tag").alias("t")).select("id", F.explode("t").alias("tag"))


@query("ARR3", "SELECT id, string_agg(tag, ',' ORDER BY tag) AS tags FROM tags GROUP BY id", "tags")
def listed(spark, d):
    return tags(spark, d).groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("tag")), ",").alias("tags"))


_EGO = "eg AS (SELECT * FROM pt WHERE id IN (SELECT id FROM tags WHERE tag = 'Brand#5')), pr AS (SELECT x.id, x.tag AS a, y.tag AS b, x.language, x.days FROM eg x JOIN eg y ON x.id = y.id AND x.tag < y.tag), ed AS (SELECT a, b, count(*) AS weight FROM pr GROUP BY 1, 2)"


def _ego_pairs(spark, d):
    e = network.ego(tags(spark, d), "Brand#5")
    return e, network.pairs(e).join(posts(spark, d).select("id", "language", "creationdate"), "id")


def _ego_edges(spark, d):
    return network.edges(_ego_pairs(spark, d)[1])


@query("NET1", f"WITH {_EGO} SELECT language, a, b, count(*) AS weight FROM pr GROUP BY 1, 2, 3", "pt tags")
def ego_edges(spark, d):
    return network.edges(_ego_pairs(spark, d)[1], "language")


@query("NET2", f"WITH {_EGO}, n AS (SELECT tag, count(DISTINCT id) AS n FROM eg GROUP BY 1) SELECT a, b, weight, x.n AS n_a, y.n AS n_b, weight / (x.n + y.n - weight) AS jaccard FROM ed JOIN n x ON a = x.tag JOIN n y ON b = y.tag", "pt tags", "jaccard")
def jaccard(spark, d):
    e, p = _ego_pairs(spark, d)
    return network.jaccard(network.edges(p), network.node_counts(e))


@query("JOI12", f"WITH {_EGO}, n AS (SELECT tag, count(DISTINCT id) AS n FROM eg GROUP BY 1) SELECT a, b, x.n AS n_a, y.n AS n_b FROM ed LEFT JOIN n x ON a = x.tag LEFT JOIN n y ON b = y.tag", "pt tags")
def two_lookups(spark, d):
    e, p = _ego_pairs(spark, d)
    return network.jaccard(network.edges(p), network.node_counts(e)).select("a", "b", "n_a", "n_b")


@query("SET6", f"WITH {_EGO}, l AS (SELECT a, b, bool_or(days <= 0) AS before, bool_or(days > 0) AS after FROM pr GROUP BY 1, 2) SELECT a, b, CASE WHEN before AND after THEN 1 WHEN after THEN 2 ELSE 0 END AS lifecycle FROM l", "pt tags")
def pair_lifecycle(spark, d):
    days = dates.days_since(F.col("creationdate"), "1998-06-03")
    return network.pair_lifecycle(_ego_pairs(spark, d)[1], days <= 0, days > 0)


@query("NET3", "WITH s AS (SELECT tag, language, bool_or(days < -1230) AS b, bool_or(days >= 1140) AS a FROM pt GROUP BY 1, 2) SELECT tag, language, CASE WHEN a AND b THEN 1 WHEN a THEN 2 ELSE 0 END AS tag_level FROM s WHERE a OR b", "pt")
def node_flags(spark, d):
    from ..operators.distributions import lifecycle

    s = pt(spark, d).groupBy("tag", "language").agg(F.bool_or(F.col("days") < -1230).alias("b"), F.bool_or(F.col("days") >= 1140).alias("a")).where("a or b")
    return s.select("tag", "language", lifecycle(F.col("b"), F.col("a")).alias("tag_level"))


@query("NET4", f"WITH {_EGO}, s AS (SELECT a AS node, weight FROM ed UNION ALL SELECT b, weight FROM ed) SELECT node, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS weighted_degree FROM s GROUP BY 1", "pt tags")
def degrees(spark, d):
    return network.degrees(_ego_edges(spark, d))


@query("NET4_summary", f"WITH {_EGO}, s AS (SELECT a AS node FROM ed UNION SELECT b FROM ed), k AS (SELECT count(*) AS nodes FROM s) SELECT nodes, count(*) AS edges, 2.0 * count(*) / (nodes * (nodes - 1)) AS density, avg(weight) AS mean_weight FROM ed, k GROUP BY nodes", "pt tags", "density mean_weight")
def summary(spark, d):
    return network.summary(_ego_edges(spark, d))


_ALL = "st AS (SELECT a, b, count(*) AS weight FROM (SELECT x.id, x.tag AS a, y.tag AS b FROM tags x JOIN tags y ON x.id = y.id AND x.tag < y.tag) GROUP BY 1, 2)"


@query("NET5", f"WITH {_ALL}, s AS (SELECT a AS n, b AS o FROM st UNION ALL SELECT b, a FROM st), k AS (SELECT n AS node, count(*) AS k FROM s GROUP BY 1), t AS (SELECT x.n AS node, count(*) AS t FROM s x JOIN s y ON x.n = y.n AND x.o < y.o JOIN st ON st.a = x.o AND st.b = y.o GROUP BY 1) SELECT k.node, CASE WHEN k < 2 THEN 0 ELSE 2.0 * coalesce(t, 0) / (k * (k - 1)) END AS clustering FROM k LEFT JOIN t ON k.node = t.node", "tags", "clustering")
def clustering(spark, d):
    return network.clustering(network.edges(network.pairs(tags(spark, d))))


#: Power iteration on a matrix of lists, to the digits that are compared.
_EIGEN = f"""WITH RECURSIVE {_EGO}, nm AS (SELECT node, row_number() OVER (ORDER BY node) AS i FROM (SELECT a AS node FROM ed UNION SELECT b FROM ed)),
  sd AS (SELECT a, b, weight FROM ed UNION ALL SELECT b, a, weight FROM ed),
  mx AS (SELECT list(r ORDER BY i) AS m FROM (SELECT x.i, list(CAST(coalesce(weight, 0) + CASE WHEN x.i = y.i THEN 1 ELSE 0 END AS DOUBLE) ORDER BY y.i) AS r FROM nm x CROSS JOIN nm y LEFT JOIN sd ON sd.a = x.node AND sd.b = y.node GROUP BY x.i)),
  it AS (SELECT 0 AS k, m, list_transform(m, lambda r: CAST(1 AS DOUBLE)) AS v FROM mx UNION ALL SELECT k + 1, m, list_transform(u, lambda c: c / sqrt(list_dot_product(u, u))) FROM (SELECT k, m, list_transform(m, lambda r: list_dot_product(r, v)) AS u FROM it WHERE k < 200)),
  ev AS (SELECT node, round(v[i], 6) AS centrality FROM it, nm WHERE k = 200)"""


@query("NET6", f"{_EIGEN} SELECT node, centrality FROM ev", "pt tags")
def eigenvector(spark, d):
    return network.eigenvector(_ego_edges(spark, d)).withColumn("centrality", F.round("centrality", 6))


@query("NET7")
def communities(spark, d):
    return network.communities(_ego_edges(spark, d))


@query("NET7_modularity")
def modularity(spark, d):
    e = network.kept(_ego_edges(spark, d), "edges")  # read twice
    return network.modularity(e, network.communities(e)).withColumn("modularity", F.round("modularity", 6))


@query("TOP5", f"{_EIGEN} SELECT node, centrality FROM ev ORDER BY centrality DESC, node LIMIT 11", "pt tags")
def central_nodes(spark, d):
    return network.eigenvector(_ego_edges(spark, d)).withColumn("centrality", F.round("centrality", 6)).orderBy(F.desc("centrality"), "node").limit(11)


@query("NET8", f"{_EIGEN}, tp AS (SELECT node FROM ev ORDER BY centrality DESC, node LIMIT 11) SELECT a, b, weight FROM ed WHERE a IN (SELECT node FROM tp) AND b IN (SELECT node FROM tp)", "pt tags")
def central_graph(spark, d):
    e = _ego_edges(spark, d)
    return network.induced(e, central_nodes(spark, d).select("node"))


# ---- prompts


_SYSTEM = "Rate the question as 0, 1 or 2."


def _prompts(spark, d, limit: int = 2000):
    labelled = table(spark, d, "documents").join(F.broadcast(_golden(spark, d)), F.col("doc_id") == F.col("id")).select("id", "answer", "text")
    questions = _targets(spark, d).select("id", F.concat(F.lit("Question "), F.col("id").cast("string")).alias("text"))
    return annotation.prompts(labelled, questions, _SYSTEM, limit, 1, 2)


#: The prompts in SQL: t has their tokens and messages, each as role:content, joined by a separator.
_PROMPTS = f"""g AS (SELECT id AS shot_id, label FROM votes WHERE draw <= 4 GROUP BY 1, 2 HAVING count(*) = 4 OR (count(*) = 3 AND label = 2)),
  gd AS (SELECT shot_id, label, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS n FROM g JOIN documents ON doc_id = shot_id),
  r AS (SELECT p.id AS eval_id, CAST(k AS INTEGER) AS draw, gd.*, md5(concat_ws('|', '0', CAST(p.id AS VARCHAR), CAST(k AS VARCHAR), CAST(shot_id AS VARCHAR))) AS h FROM posts p, (SELECT unnest([1, 2]) AS k), gd WHERE p.id % 50 = 0 AND shot_id <> p.id),
  s AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY eval_id, draw, label ORDER BY h) = 1),
  t AS (SELECT eval_id, draw, 8 + 2 + sum(n + 1) AS tokens, 2 + 2 * count(*) AS n, {len(_SYSTEM)} + sum(length(text) + 1) + length('Question ' || eval_id) AS chars,
    'system:{_SYSTEM}' || chr(30) || string_agg('user:' || text || chr(30) || 'assistant:' || label, chr(30) ORDER BY label, h) || chr(30) || 'user:Question ' || eval_id AS said FROM s GROUP BY 1, 2)"""


@query("UDF12", "SELECT n_nationkey, 'You grade questions about ' || n_name || '. Choose one of 0 (basic), 1 (middle), 2 (advanced) and answer as <Difficulty Level>n</Difficulty Level>, nothing else.' AS prompt FROM nation")
def templates(spark, d):
    levels = {0: "basic", 1: "middle", 2: "advanced"}
    return table(spark, d, "nation").select("n_nationkey", annotation.system_prompt("tagged", F.col("n_name"), levels).alias("prompt"))


@query("UDF7", f"WITH {_PROMPTS} SELECT eval_id, draw, tokens + 384 <= 700 AS fits FROM t", "posts votes")
def token_budget(spark, d):
    return _prompts(spark, d, 700).select("eval_id", "draw", "fits")


@query("UDF8", f"WITH {_PROMPTS} SELECT eval_id, draw, CAST(n AS INTEGER) AS n, md5(said) AS h FROM t WHERE tokens + 384 <= 2000", "posts votes")
def prompt_messages(spark, d):
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), chr(30))
    return _prompts(spark, d).where("fits").select("eval_id", "draw", F.size("messages").alias("n"), F.md5(said).alias("h"))


@query("UDF9", f"WITH {_PROMPTS} SELECT eval_id, draw, '<Difficulty Level> ' || (chars % 3) || ' </Difficulty Level>' AS result, CAST(chars % 3 AS INTEGER) AS level FROM t WHERE tokens + 384 <= 2000", "posts votes")
def answered(spark, d):
    def client():
        return lambda batch: [f"<Difficulty Level> {sum(len(m['content']) for m in messages) % 3} </Difficulty Level>" for messages in batch]

    return annotation.answer(_prompts(spark, d).where("fits"), client).withColumn("level", text.level_of(F.col("result")))


# ---- complexity


_KEYS = ["conv_id", "turn"]


def _words(spark, d):
    """(conv_id, turn, text, words): runs of a to z of every whole turn, dealt to all cores: to measure a snippet costs far more than to send it."""
    rows = table(spark, d, "conversations").repartition(spark.sparkContext.defaultParallelism, *_KEYS)
    return rows.select(*_KEYS, "text", F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0)).alias("words"))


_WORDS = "wd AS (SELECT conv_id, turn, text, regexp_extract_all(text, '[a-z]+') AS words, len(regexp_extract_all(text, '[a-z]+')) AS n, (conv_id + turn) % 4 AS k FROM conversations)"


def _snippets(spark, d):
    """A snippet per turn, in four shapes: each word becomes a branch, a loop or, in the last shape, the text is no code."""
    k = (F.col("conv_id") + F.col("turn")) % 4
    each = lambda before, after, between: F.array_join(F.transform("words", lambda w: F.concat(F.lit(before + "w_"), w, F.lit(after))), between)
    java = F.concat(F.lit("class K { int f(int a) { "), each("if (a > 0) { ", "(); }", " "), F.lit(" return a; } }"))
    python = F.concat(F.lit("def f(a):\n"), each("    if a and ", ":\n        a += 1", "\n"), F.lit("\n    return a\n"))
    go = F.concat(F.lit("package p\nfunc f(a int) int { "), each("for a > 0 { ", "() }", " "), F.lit(" return a }"))
    src = F.when(k == 0, java).when(k == 1, python).when(k == 2, go).otherwise(F.concat(F.lit("def f(: "), "text"))
    return _words(spark, d).select(*_KEYS, F.when(k == 0, "java").when(k == 2, "go").otherwise("python").alias("language"), src.alias("src"))


@query("UDF1", f"WITH {_WORDS} SELECT conv_id, turn, 'f' AS function, CAST(CASE WHEN k = 1 THEN 2 * n ELSE n END AS INTEGER) AS complexity, CAST(CASE WHEN k = 1 THEN 1 + 2 * n ELSE 1 + n END AS INTEGER) AS cyclomatic FROM wd WHERE k <> 3")
def snippet_functions(spark, d):
    return metrics.function_metrics(_snippets(spark, d), _KEYS).select(*_KEYS, "function", "complexity", "cyclomatic")


@query("UDF2", f"WITH {_WORDS} SELECT conv_id, turn, '(top)' AS function, CAST(n AS INTEGER) AS complexity FROM wd WHERE n > 0")
def top_level(spark, d):
    """A snippet without a function is measured as a whole."""
    src = F.array_join(F.transform("words", lambda w: F.concat(F.lit("if (a) { w_"), w, F.lit("(); }"))), "\n")
    rows = _words(spark, d).select(*_KEYS, F.lit("c").alias("language"), src.alias("src"))
    return metrics.function_metrics(rows, _KEYS).select(*_KEYS, "function", "complexity")


@query("UDF3", f"WITH {_WORDS} SELECT conv_id, turn, k <> 3 AS ok FROM wd")
def syntax_gate(spark, d):
    return metrics.syntax_ok(_snippets(spark, d), _KEYS)


@query("UDF4", f"WITH {_WORDS} SELECT conv_id, turn, CAST(CASE WHEN k = 1 THEN 1 + 2 * n ELSE 1 + n END AS INTEGER) AS cyclomatic, 1 AS parameter_count FROM wd WHERE k <> 3")
def cyclomatic(spark, d):
    return metrics.function_metrics(_snippets(spark, d), _KEYS).select(*_KEYS, "cyclomatic", "parameter_count")


@query("UDF6", f"WITH {_WORDS} SELECT conv_id, turn FROM wd WHERE k = 3")
def rejected(spark, d):
    return metrics.not_measured(_snippets(spark, d), _KEYS)


def _reports(spark, d):
    """What an external tool would say of a turn: a function for each word, with an inner one; odd turns are no report."""
    unit = F.struct(F.lit("unit").alias("kind"), F.transform("words", lambda w: F.struct(F.lit("function").alias("kind"), w.alias("name"), F.struct(F.struct(F.length(w).alias("sum")).alias("cognitive")).alias("metrics"), F.array(F.struct(F.lit("function").alias("kind"), F.lit("in").alias("name"))).alias("spaces"))).alias("spaces"))
    return _words(spark, d).select(*_KEYS, F.when(F.col("turn") % 2 == 0, F.to_json(unit)).otherwise(F.col("text")).alias("report"))


@query("JSN2", f"WITH {_WORDS}, x AS (SELECT conv_id, turn, unnest(words) AS name FROM wd WHERE turn % 2 = 0) SELECT conv_id, turn, name, CAST(length(name) AS DOUBLE) AS cognitive_sum FROM x")
def report_rows(spark, d):
    return metrics.report_functions(_reports(spark, d), _KEYS).select(*_KEYS, "name", "cognitive_sum")


@query("UDF5", f"WITH {_WORDS} SELECT conv_id, turn, CAST(n AS BIGINT) AS functions FROM wd WHERE turn % 2 = 0 AND n > 0")
def report_counts(spark, d):
    return metrics.report_functions(_reports(spark, d), _KEYS).groupBy(*_KEYS).agg(F.count("*").alias("functions"))


@query("MAP1", "SELECT conv_id, turn, conv_id || '_' || turn || CASE (conv_id + turn) % 4 WHEN 0 THEN '.java' WHEN 2 THEN '.go' ELSE '.py' END AS file FROM conversations")
def file_names(spark, d):
    ext = F.create_map(*(F.lit(x) for n, g in LANGUAGES.items() for x in (n, g.ext)))
    return _snippets(spark, d).select(*_KEYS, F.concat(F.concat_ws("_", *_KEYS), F.lit("."), F.element_at(ext, F.col("language"))).alias("file"))


def _asked(questions, attempt: int):
    """Three answers to each question, by its hash: another attempt gives others."""
    rows = questions.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(3))))
    h = F.md5(F.concat_ws("|", F.col("id"), F.lit(attempt), F.col("draw")))
    return rows.select("id", "draw", (F.conv(F.substring(h, 1, 4), 16, 10).cast("int") % 2).alias("label"))


@query("UDF11", """WITH l AS (SELECT id, attempt, CAST(('0x' || substr(md5(concat_ws('|', CAST(id AS VARCHAR), CAST(attempt AS VARCHAR), CAST(draw AS VARCHAR))), 1, 4)) AS INTEGER) % 2 AS label FROM (SELECT id, attempt, unnest(range(1, 4)) AS draw FROM (SELECT doc_id AS id, unnest(range(1, 5)) AS attempt FROM labels))),
  u AS (SELECT id, attempt, min(label) AS label FROM l GROUP BY 1, 2 HAVING count(DISTINCT label) = 1), f AS (SELECT id, min(attempt) AS attempt, arg_min(label, attempt) AS label FROM u GROUP BY 1)
  SELECT doc_id AS id, label, CAST(attempt AS INTEGER) AS attempt FROM (SELECT DISTINCT doc_id FROM labels) LEFT JOIN f ON doc_id = f.id""")
def retried(spark, d):
    """Questions are asked again until their answers agree, four times at most; what never does has no label."""
    questions = table(spark, d, "labels").select(F.col("doc_id").alias("id")).distinct()
    return annotation.until_unanimous(questions, _asked, 3, 4)
