"""Exact quantiles of groups of any size, by rank selection.

A round deals the values of an interval of each group into a fixed number of equal buckets and
counts them; running sums over the buckets say which one holds a wanted rank. Where that
bucket has one value the rank is found. Where it is small its values are counted one by
one, and otherwise it is the next round's interval. So only counts are shuffled, at most
`buckets` rows per group and task, and nothing that a task holds grows with a group.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.adapters import scratch

BUCKETS, MOST, SENT = 4096, 1_000_000, 100_000


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", more: Column | None = None) -> DataFrame:
    """left with right's other columns, for equal keys; null keys are equal. more: a further condition."""
    named = right.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    on = [left[k].eqNullSafe(named[f"_{k}"]) for k in keys] + ([] if more is None else [more])
    return (left.join(named, on, how) if on else left.crossJoin(named)).drop(*(f"_{k}" for k in keys))


def quantiles(df: DataFrame, by: list[str], column: str, shares: dict[str, float], weight: str | None = None, buckets: int = BUCKETS, most: int = MOST) -> DataFrame:
    """(by, name of each share): quantiles by linear interpolation between the two nearest ranks.

    shares: names and shares from 0 to 1. weight: a column of whole numbers, how often a row counts. Null and NaN
    values take no part; infinite ones do. A group without a value has no row; null keys are a group;
    a table without a row gives none. df is read once per round, and once before the first:
    give it as something cheap to read again.
    """
    spark = df.sparkSession
    n = F.lit(1) if weight is None else F.col(weight)
    rows = df.select(*by, F.col(column).cast("double").alias("_x"), n.cast("long").alias("_n")).where("_x IS NOT NULL AND NOT isnan(_x) AND _n > 0")
    folder = f"{scratch(spark)}/quantiles-{uuid.uuid4().hex}"

    def kept(d: DataFrame, name: str) -> DataFrame:
        d.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    finite = F.when(F.abs("_x") != float("inf"), F.col("_x"))
    groups = kept(rows.groupBy(*by).agg(F.sum("_n").alias("_total"), F.min(finite).alias("_lo"), F.max(finite).alias("_hi")), "groups").where("_total > 0")
    ranks = [F.floor(F.lit(q) * (F.col("_total") - 1)).cast("long") for q in shares.values()]
    wanted = F.array_distinct(F.concat(F.array(*ranks), F.transform(F.array(*ranks), lambda r: F.least(r + 1, F.col("_total") - 1))))
    targets = groups.select(*by, "_lo", "_hi", F.lit(0).cast("long").alias("_before"), F.explode(wanted).alias("_rank"))
    found: list[DataFrame] = []
    small_enough = groups.count() <= SENT
    step = 0

    def inside(intervals: DataFrame) -> DataFrame:
        """The rows of each interval, with its bounds; a group's intervals do not overlap."""
        marked = intervals.groupBy(*by).agg(F.collect_set(F.struct(F.col("_lo").alias("l"), F.col("_hi").alias("h"))).alias("_i"))
        x = F.col("_x")
        at = F.filter("_i", lambda i: i["l"].isNull() | ((x >= i["l"]) & (x <= i["h"])) | (F.lit(step == 0) & (F.abs(x) == float("inf"))))
        if not by:
            marked = F.broadcast(marked)  # one row
        return same(rows, F.broadcast(marked) if small_enough else marked, by).withColumn("_i", F.get(at, F.lit(0))).where("_i IS NOT NULL").select(*by, "_x", "_n", F.col("_i.l").alias("_lo"), F.col("_i.h").alias("_hi"))

    while True:
        place = F.least(F.floor((F.col("_x") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * buckets), F.lit(buckets - 1))
        bucket = F.when(F.col("_x") == float("-inf"), -1).when(F.col("_x") == float("inf"), buckets).when(F.col("_hi") > F.col("_lo"), place).otherwise(0)
        dealt = inside(targets).groupBy(*by, "_lo", "_hi", bucket.cast("int").alias("_b")).agg(F.sum("_n").alias("_c"), F.min("_x").alias("_min"), F.max("_x").alias("_max"))
        before = F.sum("_c").over(Window.partitionBy(*by, "_lo", "_hi").orderBy("_b")) - F.col("_c")
        cells = dealt.withColumn("_s", before)
        holds = (F.col("_rank") - F.col("_before") >= F.col("_s")) & (F.col("_rank") - F.col("_before") < F.col("_s") + F.col("_c"))
        hit = kept(same(targets, cells, [*by, "_lo", "_hi"], more=holds).select(*by, "_rank", F.col("_min").alias("_lo"), F.col("_max").alias("_hi"), (F.col("_before") + F.col("_s")).alias("_before"), "_c"), f"round-{step}")
        found.append(hit.where("_lo = _hi").select(*by, "_rank", F.col("_lo").alias("_value")))
        targets = hit.where("_lo < _hi").drop("_c")
        largest = hit.where("_lo < _hi").agg(F.max("_c")).first()[0]
        step += 1
        if largest is None:
            break
        if largest <= most:
            order = Window.partitionBy(*by, "_lo", "_hi").orderBy("_x")
            each = inside(targets).groupBy(*by, "_lo", "_hi", "_x").agg(F.sum("_n").alias("_c"))
            each = each.withColumn("_s", F.sum("_c").over(order) - F.col("_c"))
            found.append(same(targets, each, [*by, "_lo", "_hi"], more=holds).select(*by, "_rank", F.col("_x").alias("_value")))
            break
    values = found[0]
    for f in found[1:]:
        values = values.unionByName(f)
    values = values.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_v"))  # two per share at most

    def quantile(q: float) -> Column:
        exact = F.lit(q) * (F.col("_total") - 1)
        low, part = F.floor(exact).cast("long"), exact - F.floor(exact)
        a, b = F.element_at("_v", low), F.element_at("_v", F.least(low + 1, F.col("_total") - 1))
        return F.when((part == 0) | (a == b), a).otherwise(a + (b - a) * part)

    return same(groups.select(*by, "_total"), values, by).select(*by, *(quantile(q).alias(name) for name, q in shares.items()))
