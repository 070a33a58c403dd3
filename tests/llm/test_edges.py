"""Every operator: nulls in any column, empty and long texts, repeated rows, clashing names, empty tables."""

import pytest
from public_tokenizers import path

from tidelens.llm import bitsliced, bpe, language, packing, quality_model, quality_rules, secrets, simhash, toxicity, warc

LONG = "one two three four five six seven eight nine ten eleven. " * 4000
ROWS = [
    (1, "a short text with some ten words in it, yes indeed", "en", None, 5),
    (1, "a short text with some ten words in it, yes indeed", "en", None, 5),
    (2, None, None, "s", None),
    (3, "", "en", "s", 1),
    (None, "no id here but words enough for all the rules to pass", "en", "s", 1),
    (4, " \n\t ", None, "s", 1),
    (5, LONG, "en", "s", 1),
    (6, "漢字 и слова é " * 20, "fr", "s", 1),
]
#: Names that the operators' own columns and working columns have.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["score", "kept", "n_tokens", "fp", "component_id", "spans", "all", "t", "y", "h", "i", "sequence_id", "lang_pred", "_spans", "key", "u"]

OPERATORS = {
    "rules": lambda d: quality_rules.quality_rules(d),
    "quality": lambda d: quality_model.score_quality(d, None),
    "bpe": lambda d: bpe.encode_documents(d, path("byte_bpe_50k.json")),
    "toxicity": lambda d: toxicity.score_toxicity(d, None),
    "language": lambda d: language.identify(d, None),
    "secrets": lambda d: secrets.scan(d),
    "simhash": lambda d: simhash.near_duplicates(d),
}


def frame(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in CLASH})


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each(spark, name):
    got = OPERATORS[name](frame(spark, ROWS)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in ROWS)
    same = [r for r in got if r.doc_id == 1]
    assert same[0] == same[1]


@pytest.mark.parametrize("kind", ["smallint", "int", "decimal(12,0)", "string"])
def test_kinds_of_ids(spark, kind):
    rows = frame(spark, ROWS)
    df = rows.withColumn("doc_id", rows.doc_id.cast(kind))
    for name, f in OPERATORS.items():
        assert sorted(str(r.doc_id) for r in f(df).collect()) == sorted(str(r[0]) for r in ROWS), name
    if kind == "string":
        texts = spark.createDataFrame([("b", "same words here and there"), ("a10", "same words here and there"), ("a9", "other")], "doc_id string, text string")
        assert {r.doc_id: r.component_id for r in simhash.near_duplicates(texts).collect()} == {"b": "a10", "a10": "a10", "a9": "a9"}
        with pytest.raises(ValueError, match="whole numbers"):
            simhash.first_of_each(df)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](frame(spark, [])).collect() == []


@pytest.mark.parametrize("keep", [quality_rules.quality_filter, lambda d: language.language_filter(d, None), simhash.first_of_each, secrets.redact])
def test_filters_keep_the_columns(spark, keep):
    df = frame(spark, ROWS)
    out = keep(df)
    assert out.columns == df.columns and [t for _, t in out.dtypes] == [t for _, t in df.dtypes]
    out.collect()
    assert keep(frame(spark, [])).collect() == []


@pytest.fixture(scope="module")
def fitted(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    return {"quality": quality_model.fit(docs, labels), "toxicity": toxicity.fit(docs, labels), "language": language.fit(docs)}


SCORE = {"quality": quality_model.score_quality, "toxicity": toxicity.score_toxicity, "language": language.identify}


@pytest.mark.parametrize("name", SCORE)
def test_fitted_models(spark, fitted, name):
    """Null, empty, blank, very long, repeated and tied texts, a table without a row, and columns of clashing names."""
    words = ("seldom " * 9 + "again. ") * 13_000  # over 1 MB, with sentences of ten words
    tied = [(i, "one and the same text", "en", "s", 1) for i in range(20, 30)]
    rows = [*ROWS, (6, words, "en", "s", 1), (7, "word " * 100_000, None, None, None), (8, "12 34 !", "en", "s", 1), *tied]
    got = SCORE[name](frame(spark, rows), fitted[name]).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows)
    assert all(0 <= r.score <= 1 for r in got)
    score = {}
    for r in got:
        score.setdefault(r.doc_id, set()).add(r.score)
    assert len(score[1]) == 1 and len(set.union(*(score[i] for i in range(20, 30)))) == 1
    assert score[2] == score[3]  # null as empty
    if name == "language":
        assert {r.lang_pred for r in got if r.doc_id in (2, 3, 4, 8)} == {"und"} and {r.score for r in got if r.doc_id in (2, 3, 4, 8)} == {0.0}
        kept = language.language_filter(frame(spark, rows), fitted[name], 0.0).collect()
        assert len(kept) == len(rows) - 4
        assert language.language_filter(frame(spark, []), fitted[name]).collect() == []
    else:
        assert all(r.predicted == (r.score >= 0.5) for r in got)
    assert SCORE[name](frame(spark, []), fitted[name]).collect() == []


def test_pipeline_on_an_empty_table(spark, sf, tmp_path):
    import corpus_pipeline

    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns[:3] == ["doc_id", "start", "length"] and out.collect() == []


def test_pipeline_edges(spark, sf, tmp_path):
    """The stages on a table of such rows with clashing names, and on one without a row."""
    import corpus_pipeline

    whole = spark.read.parquet(f"{sf}/documents.parquet")
    extra = frame(spark, ROWS)
    docs = whole.unionByName(extra.select(*whole.columns)).withColumns({c: _lit(c) for c in CLASH})
    for rows, least in ((docs, 100), (extra.limit(0), 0)):
        folder = f"{tmp_path}/{least}"
        for name, stage in corpus_pipeline.STAGES:
            before = rows
            stage(spark, rows, sf).write.parquet(f"{folder}-{name}")
            rows = spark.read.parquet(f"{folder}-{name}")
            assert name == "packing" or rows.columns == before.columns
        assert rows.count() >= least


def _lit(c):
    from pyspark.sql import functions as F

    return F.lit(c)


def test_fits_without_labels(spark):
    docs = frame(spark, ROWS)
    labels = spark.createDataFrame([(1, 1, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality_model.fit(docs, labels) is None
    assert toxicity.fit(docs, labels) is None
    assert language.fit(frame(spark, [])) is None


def test_packing_edges(spark):
    got = packing.pack(frame(spark, ROWS), path("byte_bpe_50k.json")).collect()
    assert {r.doc_id for r in got} == {r[0] for r in ROWS}
    assert [(r.length, r.doc_tokens) for r in got if r.doc_id in (2, 3)] == [(1, 1), (1, 1)]
    assert packing.pack(frame(spark, []), path("byte_bpe_50k.json")).collect() == []


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, None), (40, [nan, 1.0]), (60, [None, 1.0]), (80, [inf, 0.0]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0]), (3, []), (None, [1.0, 1.0]), (100, [-1.0, 0.01, 0.5])]
    got = bitsliced.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as rank", "2 as id", "3 as q", "4 as block")).collect()
    mine = [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: (r.query_id, r.rank)) if r.query_id == 0]
    assert mine == [(1, 1, 4096), (2, 1, 4096), (3, 2, 4096), (4, 3, 0), (5, 100, -4096)]
    assert {r.query_id for r in got} == {0, 100}
    assert bitsliced.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_archive_edges(spark):
    rows = [(1, None, None), (None, "x y", ""), (3, "http://a.b:99/x?y", "h"), (3, "http://a.b:99/x?y", "h"), (4, "http://[", "h"), (None, None, "zz"), (5, "http://q/\t\n", "long " * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as key", "2 as sha", "3 as file")
    got = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_pages(spark, df).collect()), key=str)
    want = [(0, 0, "revisit", 1), (0, 2, "response", None), (1, 0, "response", None), (3, 1, "revisit", 4), (3, 1, "revisit", 4), (4, 1, "response", None), (5, 1_500_000, "response", None)]
    assert got == sorted(want, key=str)
    assert warc.archive_pages(spark, df.limit(0)).collect() == []


def test_batches_of_many_rows(spark):
    """More rows than are converted at a time, in one partition."""
    rows = [(i, f"row {i} " + "word " * (i % 7), "en", "s", 1) for i in range(2500)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    assert {r.doc_id: r.n_words for r in quality_rules.quality_rules(df).collect()} == {i: 2 + i % 7 for i in range(2500)}
    got = packing.pack(df, path("byte_bpe_50k.json")).toPandas()
    assert sorted(got.doc_id.unique()) == list(range(2500))
