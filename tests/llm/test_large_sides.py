"""What happens beyond the sizes that are broadcast: the same results, and only possible hits are shuffled."""

import numpy as np
from pyspark.sql import functions as F

from tidelens.llm import common, simhash, warc


def test_filter_of_ids(spark):
    rng = np.random.default_rng(1)
    inside = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 5000)] + [0, -1, 2**62 + 1]
    keys = spark.createDataFrame([(x,) for x in inside], "k long").repartition(3)
    others = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 5000)]
    df = spark.createDataFrame([(x,) for x in [*inside, *others, None]], "k long").repartition(2)
    got = {r.k: r.m for r in df.select("k", common.perhaps(keys, "k", 20)(F.col("k")).alias("m")).collect()}
    assert all(got[x] for x in inside) and sum(got[x] for x in set(others) - set(inside)) < 100
    none = df.select(common.perhaps(keys.limit(0), "k", 20)(F.col("k")).alias("m")).where("m").count()
    assert none == 0


def test_pages(spark, sf, monkeypatch):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    pages = pages.unionByName(pages.where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 1_000_000))
    want = sorted(map(tuple, warc.archive_pages(spark, pages).collect()), key=repr)
    monkeypatch.setattr(warc, "GROUPS_SENT", 0)
    assert sorted(map(tuple, warc.archive_pages(spark, pages).collect()), key=repr) == want
    assert {r[3] for r in want} == {"response", "revisit"}


def test_near_duplicates(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 400")
    docs = docs.unionByName(docs.limit(5).withColumn("doc_id", F.lit(None).cast("long")))
    want = sorted((repr(r) for r in simhash.first_of_each(docs).collect()))
    monkeypatch.setattr(simhash, "IDS_SENT", 0)
    assert sorted((repr(r) for r in simhash.first_of_each(docs).collect())) == want and len(want) < 405
