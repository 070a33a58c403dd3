"""Exact quantiles by rank selection, against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelens.operators import quantiles

SHARES = {"min": 0.0, "q1": 0.01, "q25": 0.25, "med": 0.5, "q75": 0.75, "q99": 0.99, "max": 1.0}


def same(a, b):
    return a == b or math.isclose(a, b, rel_tol=1e-12)


@pytest.mark.parametrize(("buckets", "most"), [(4096, 1_000_000), (64, 5)])
def test_against_numpy(spark, buckets, most):
    rng = np.random.default_rng(3)
    groups = {
        "normal": rng.normal(size=400),
        "wide": np.sign(rng.normal(size=200)) * 10.0 ** rng.uniform(-30, 30, 200),
        "whole": rng.integers(0, 5, 300).astype(float),
        "one": np.array([3.5]),
        "two": np.array([1.0, 2.0]),
        "same": np.full(50, 7.0),
        "skewed": np.r_[np.zeros(500), 1e300, -1e300],
        None: rng.exponential(size=77),
    }
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("normal", None), ("empty", None), ("whole", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r.g: r for r in quantiles.quantiles(df, ["g"], "v", SHARES, buckets=buckets, most=most).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        for name, q in SHARES.items():
            assert same(got[k][name], float(np.quantile(x, q))), (k, name)


def test_infinite_values_weights_and_no_group(spark):
    inf = float("inf")
    df = spark.createDataFrame([(-inf, 2), (1.0, 3), (2.0, 1), (inf, 4), (9.0, 0), (None, 5)], "v double, n int")
    r = quantiles.quantiles(df, [], "v", {"a": 0.0, "b": 0.3, "c": 0.5, "d": 1.0}, "n").first()
    assert (r.a, r.b, r.d) == (-inf, 1.0, inf) and r.c == 1.5
    assert quantiles.quantiles(df.limit(0), [], "v", {"a": 0.5}).collect() == []
    only = spark.createDataFrame([(inf,), (inf,)], "v double")
    assert quantiles.quantiles(only, [], "v", {"a": 0.5}).first().a == inf


def test_one_group_of_ten_million_rows(spark):
    """Different values throughout; a round's counts are all that is shuffled."""
    n = 10_000_000
    df = spark.range(n).select(F.lit("all").alias("g"), ((F.col("id") * 7_368_787) % n).cast("double").alias("v"))
    r = quantiles.quantiles(df, ["g"], "v", {"q25": 0.25, "med": 0.5, "q99": 0.99}).first()
    assert [r.q25, r.med, r.q99] == [float(np.quantile(np.array([0, n - 1]), q)) for q in (0.25, 0.5, 0.99)]
