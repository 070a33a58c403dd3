"""Operators on tiny frames with answers worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tidelens.functions import dates, numbers, text
from tidelens.operators import annotation, distributions, network, rollups
from tidelens.sources import readers, schemas, writers


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def ts(value):
    return F.lit(value).cast("timestamp_ntz")


@pytest.mark.parametrize(("day", "week"), [("1998-06-03", 0), ("1998-06-02", -1), ("1998-05-27", -1), ("1998-05-26", -2), ("1998-06-10 23:59:59", 1)])
def test_relative_weeks_floor(spark, day, week):
    assert one(spark, dates.rel_bin(ts(day), "1998-06-03")) == week


def test_month_bins(spark):
    got = [r.v for r in spark.createDataFrame([(i, w) for i, w in enumerate((-5, -2, -1, 0, 3, 4))], "i int, w int").orderBy("i").select(dates.month_bin(F.col("w")).alias("v")).collect()]
    assert got == [-2, -2, -1, 0, 0, 1]


def test_mixed_dates(spark):
    for s, want in (("2020-01-02T03:04:05", 3), ("2020-01-02 03:04:05", 3), ("2020-01-02", 0), ("x", None)):
        got = one(spark, dates.parse_mixed(F.lit(s)))
        assert (got.hour if got else None) == want


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<pre><code>a &lt; b</code></pre>", ["a < b"]),
        ("x<pre><code>1</code></pre>y<pre class=\"lang-py prettyprint-override\"><code>2</code></pre>z", ["1", "2"]),
        ("<pre><code>open", []),
        ("</code></pre>", []),
        (None, []),
        ("é<pre><code>ü</code></pre>", ["ü"]),
    ],
)
def test_code_sections(body, want):
    assert [s for _, _, s in text.sections_of(body)] == want


def test_text_functions(spark):
    assert one(spark, text.remove_tags(F.lit("a<b>c<d\n>e"))) == "ac<d\n>e"
    assert one(spark, text.clean_html(F.lit("&lt;b&gt;<i>x</i> &amp;amp;"))) == "<b>x &amp;"
    assert one(spark, text.scrub_semicolons(F.lit("a;b; c;;d;"))) == "ab; cd;"
    assert one(spark, text.question_text(F.lit(None).cast("string"), F.lit("b"))).startswith("<Title>None</Title>. <Question>b")
    assert one(spark, text.tag_list(F.lit("<a><c#><a>"))) == ["a", "c#", "a"]
    assert one(spark, text.level_of(F.lit("x <Difficulty Level> 2 </Difficulty Level>"))) == 2
    assert one(spark, text.level_of(F.lit("none"))) is None
    assert one(spark, text.id_of_file(F.lit("12_345.py"))) == 345
    assert one(spark, text.id_of_file(F.lit("bad"))) is None


def test_fractions_and_empty_totals(spark):
    df = spark.createDataFrame([("a", "1", 30), ("a", "2", 40), ("a", "3", 30), ("z", "1", 0)], "g string, k string, n int")
    assert {(r.g, r.k): round(r.p, 9) for r in distributions.fractions(df, ["g"]).collect()} == {("a", "1"): 0.3, ("a", "2"): 0.4, ("a", "3"): 0.3}


def test_gini_by_all_pairs(spark):
    values = [1.0, 2.0, 2.0, 7.0, 0.0]
    want = sum(abs(a - b) for a in values for b in values) / 25 / 2 / (sum(values) / 5)
    for scale in (1, 10):
        got = distributions.gini(spark.createDataFrame([("g", v * scale) for v in values], "g string, v double"), ["g"], "v").first().gini
        assert math.isclose(got, want)


def test_cdf_and_ccdf(spark):
    rows = distributions.cdf(spark.createDataFrame([(1, 0.2), (2, 0.3), (3, 0.5)], "k int, p double"), [], "k").orderBy("k").collect()
    assert [round(r.cdf, 9) for r in rows] == [0, 0.2, 0.5] and all(math.isclose(r.cdf + r.ccdf, 1) for r in rows)


def test_top_and_bottom_of_few(spark):
    df = spark.createDataFrame([(c, i) for i, c in enumerate("abcd")], "k string, v int")
    assert {r.grp for r in distributions.top_bottom(df, "k", "v").collect()} == {"middle"}
    got = {r.k: r.grp for r in distributions.top_bottom(df, "k", "v", n=1).collect()}
    assert got == {"a": "bottom", "b": "middle", "c": "middle", "d": "top"}


def test_grid_fills_missing_cells(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "w int, l string, n int")
    assert {(r.w, r.l): r.n for r in rollups.grid(df, "w", "l", ["n"], 0).collect()} == {(1, "a"): 5, (1, "b"): 0, (2, "a"): 0, (2, "b"): 6}


def test_rollup_options(spark):
    df = spark.createDataFrame([(1, 0), (1, 3), (2, 1)], "id int, cc int")
    assert {r.id: r.value for r in rollups.per_post(df, "max").collect()} == {1: math.log(4), 2: math.log(2)}
    assert {r.id: r.value for r in rollups.per_post(df, "std").collect()}[2] is None
    with pytest.raises(ValueError, match="rollup"):
        rollups.per_post(df, "mode")


def test_samples_are_repeatable(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)] + [(99, 7)], "id int, day int")
    a = annotation.sample_per(df, ["day"], 4, seed=1)
    assert sorted(r.id for r in a.collect()) == sorted(r.id for r in annotation.sample_per(df.repartition(7), ["day"], 4, seed=1).collect())
    assert {r.day: r.n for r in a.groupBy("day").agg(F.count("*").alias("n")).collect()} == {0: 4, 1: 4, 2: 4, 7: 1}


def test_votes(spark):
    v = spark.createDataFrame([(1, 0)] * 5 + [(2, 1)] * 4 + [(2, 0)] + [(3, 1), (3, 2)] + [(4, None)] * 5, "id int, label int")
    assert {r.id for r in annotation.consistent(v, 5).collect()} == {1, 4}
    assert {r.id for r in annotation.unanimous(v).collect()} == {1, 4}
    assert {r.id: r.label for r in annotation.plurality(v).collect()} == {1: 0, 2: 1, 3: 1, 4: None}


def test_prompts_fit_and_order(spark):
    golden = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "id long, answer int")
    targets = spark.createDataFrame([(1,), (9,)], "id long")
    shots = annotation.few_shots(golden, targets, 1, 2)
    assert all(r.eval_id != r.shot_id for r in shots.collect())
    said = lambda df: df.withColumn("text", F.concat(F.lit("text "), F.col("id")))
    p = annotation.prompts(said(golden), said(targets), "sys", 400, 1, 2)
    got = {(r.eval_id, r.draw): r for r in p.collect()}
    m = got[9, 1].messages
    assert [x.role for x in m] == ["system", *["user", "assistant"] * 3, "user"] and m[-1].content == "text 9" and got[9, 1].fits
    drawn = sorted((r.pos, r.shot_id, r.label) for r in shots.collect() if (r.eval_id, r.draw) == (9, 1))
    assert [x.content for x in m[1:-1]] == [c for _, i, a in drawn for c in (f"text {i}", str(a))]
    none = annotation.prompts(said(golden), said(targets), "sys", 390, 1, 2).collect()
    assert len(none) == 4 and not any(r.fits or r.messages for r in none)
    assert annotation.first_that_fits(p).count() == 2
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan and "BatchEvalPython" not in plan


def test_network(spark):
    tags = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (3, "d"), (4, "c"), (4, "d")], "id int, tag string")
    e = network.edges(network.pairs(tags))
    assert {(r.a, r.b): r.weight for r in e.collect()} == {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1, ("c", "d"): 1}
    j = {(r.a, r.b): r.jaccard for r in network.jaccard(e, network.node_counts(tags)).collect()}
    assert j["a", "b"] == 1.0 and math.isclose(j["a", "c"], 1 / 3)
    assert {r.node: round(r.clustering, 6) for r in network.clustering(e).collect()} == {"a": 1, "b": 1, "c": 0.333333, "d": 0}
    assert {r.node for r in network.communities(e).where("community = 0").collect()} >= {"a", "b"}
    c = {r.node: r.centrality for r in network.eigenvector(e).collect()}
    assert math.isclose(sum(v * v for v in c.values()), 1) and min(c, key=c.get) == "d"


def test_classes(spark):
    assert [one(spark, numbers.stars(F.lit(p))) for p in (0.0001, 0.005, 0.03, 0.08, 0.5)] == ["***", "**", "*", "†", "(n.s.)"]
    assert one(spark, numbers.percent_effect(F.lit(0.0))) == 0


def test_round_trips(spark, tmp_path):
    rows = [(1, "2020-01-01", "t", "<a>", 'say "x",\nline é')]
    df = spark.createDataFrame(rows, schemas.QUESTIONS)
    for write, read in ((writers.json_lines, lambda p: spark.read.schema(schemas.QUESTIONS).json(p)), (writers.csv, lambda p: readers.csv_columns(spark, p, schemas.QUESTIONS))):
        path = f"{tmp_path}/{write.__name__}"
        write(df, path)
        assert list(map(tuple, read(path).collect())) == rows
    assert readers.results(spark, f"{tmp_path}/none").collect() == []
    (tmp_path / "a.json").write_text('[["1", "x"], ["2", null]]')
    assert list(map(tuple, readers.json_rows(spark, f"{tmp_path}/a.json", ["id", "v"]).collect())) == [("1", "x"), ("2", None)]
    (tmp_path / "b.json").write_text('[{"id": 1, "title": "é"}, {"id": 2}]')
    assert [(r.id, r.title) for r in readers.any_of(spark, f"{tmp_path}/b.json", schemas.QUESTIONS, ["id", "title"]).collect()] == [(1, "é"), (2, None)]


def test_graph_file(spark, tmp_path):
    e = spark.createDataFrame([("a", "b & c", 2)], "a string, b string, weight int")
    writers.gexf(e, spark.createDataFrame([("a",), ("b & c",)], "node string"), f"{tmp_path}/g.gexf")
    import xml.etree.ElementTree as ET

    def parsed(folder):
        return ET.fromstring("".join(p.read_text() for p in sorted((tmp_path / folder).glob("part-*"))).encode())

    root = parsed("g.gexf")
    assert [x.attrib for x in root.findall(".//{*}node")] == [{"id": "0", "label": "a"}, {"id": "1", "label": "b & c"}]
    assert [x.attrib for x in root.findall(".//{*}edge")] == [{"id": "0", "source": "0", "target": "1", "weight": "2.0"}]

    # In many parts: none coalesced, so that each part is a task's.
    odd = ['quo"te', "new\nline", "<tag>", "é", ""]
    big = spark.range(3000).selectExpr("concat('n', lpad(id, 5, '0')) AS a", "concat('n', lpad(id * 7 % 3001 + 3000, 5, '0')) AS b", "id + 1 AS weight")
    names = big.select("a").union(big.select("b")).distinct().toDF("node").union(spark.createDataFrame([(x,) for x in odd], "node string"))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        writers.gexf(big, names, f"{tmp_path}/big")
    finally:
        spark.conf.unset(key)
    assert len(list((tmp_path / "big").glob("part-*"))) > 2
    root = parsed("big")
    label = [x.attrib["label"] for x in root.findall(".//{*}node")]
    assert label == sorted(r.node for r in names.collect()) and [int(x.attrib["id"]) for x in root.findall(".//{*}node")] == list(range(len(label)))
    found = [x.attrib for x in root.findall(".//{*}edge")]
    assert [int(x["id"]) for x in found] == list(range(3000))
    assert {(label[int(x["source"])], label[int(x["target"])], float(x["weight"])) for x in found} == {(r.a, r.b, float(r.weight)) for r in big.collect()}


def test_jdbc_reader_options(spark):
    r = readers.jdbc(spark, "jdbc:postgresql://h/db", "posts", "u", "p", "s", ("id", 0, 100, 4))
    with pytest.raises(Exception):  # noqa: B017 - no driver here; the reader itself is lazy
        r.load()


def test_running_total_of_periods(spark):
    """Against plain sums, with a null key, a key of one period and ties of the first order column."""
    from pyspark.sql import functions as F

    from tidelens.operators import rollups

    rows = [(i, "a" if i % 3 else None, i // 4, float(i)) for i in range(40)] + [(100 + i, "b", 1, 2.0) for i in range(5)]
    df = spark.createDataFrame(rows, "id int, k string, day int, v double")
    got = {r.id: r.total for r in rollups.running_total(df, "k", ["day", "id"], F.floor(F.col("day") / 3), "v", "total").collect()}
    assert got == {i: sum(v for j, q, d, v in rows if q == k and (d, j) <= (day, i)) for i, k, day, _ in rows}


def test_asked_until_answers_agree(spark):
    """Only what has not agreed is asked again, and what never does has no label."""
    from pyspark.sql import functions as F

    from tidelens.operators import annotation

    asked = []

    def ask(questions, attempt):
        asked.append((attempt, sorted(r.id for r in questions.collect())))
        rows = questions.withColumn("draw", F.explode(F.array(F.lit(1), F.lit(2))))
        return rows.select("id", "draw", F.when(F.col("id") <= attempt, F.lit(7)).otherwise(F.col("draw")).alias("label"))

    df = spark.createDataFrame([(1,), (2,), (9,)], "id int")
    got = {r.id: (r.label, r.attempt) for r in annotation.until_unanimous(df, ask, 2, 3).collect()}
    assert got == {1: (7, 1), 2: (7, 2), 9: (None, None)}
    assert asked == [(1, [1, 2, 9]), (2, [2, 9]), (3, [9])]
