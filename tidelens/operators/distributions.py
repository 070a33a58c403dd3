"""Shares over a key domain, and what is measured on them.

A distribution is long: (group, key, value). Everything is an aggregation or a window per
group; the domain of keys (topics, tags) is a small dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hard_counts(df: DataFrame, group: list[str], key: str, domain: DataFrame) -> DataFrame:
    """(group, key, n) for every key of the domain, 0 where it is absent."""
    counts = df.groupBy(*group, key).agg(F.count("*").alias("n"))
    groups = df.select(*group).distinct() if group else df.sparkSession.range(1).select()
    full = groups.join(F.broadcast(domain.agg(F.collect_set(key).alias("_k")))).select(*group, F.explode("_k").alias(key))
    return full.join(counts, [*group, key], "left").fillna(0, ["n"])


def soft_counts(df: DataFrame, group: list[str], vector: str) -> DataFrame:
    """(group, topic, n): the sum of topic vectors, place by place."""
    return df.select(*group, F.posexplode(vector).alias("topic", "_x")).groupBy(*group, "topic").agg(F.sum("_x").alias("n"))


def topic_counts(df: DataFrame, group: list[str], domain: DataFrame | None = None) -> DataFrame:
    """Soft counts if the posts carry topic vectors, hard counts if they carry one topic."""
    if "topic_info" in df.columns:
        return soft_counts(df, group, "topic_info")
    return hard_counts(df, group, "topic", domain if domain is not None else df.select("topic").distinct())


def fractions(df: DataFrame, group: list[str], value: str = "n", name: str = "p") -> DataFrame:
    """value over its group's total; groups of total 0 go."""
    total = F.sum(value).over(Window.partitionBy(*(group or [F.lit(1)])))
    return df.withColumn("_t", total).where("_t != 0").withColumn(name, F.col(value) / F.col("_t")).drop("_t")


def gini(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Half the mean absolute difference over the mean, by ranks in place of all pairs."""
    w = Window.partitionBy(*(group or [F.lit(1)]))
    ranked = df.withColumn("_i", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count("*").over(w))
    top = F.sum((2 * F.col("_i") - F.col("_n") - 1) * F.col(value))
    return ranked.groupBy(*group).agg(F.try_divide(top, F.first("_n") * F.sum(value)).alias("gini"))


def entropy(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Shannon entropy in nats of the normalised values; 0 log 0 is 0."""
    p = fractions(df, group, value, "_p")
    return p.groupBy(*group).agg(F.sum(F.when(F.col("_p") > 0, -F.col("_p") * F.ln("_p")).otherwise(0.0)).alias("entropy"))


def cdf(df: DataFrame, group: list[str], key: str, p: str = "p") -> DataFrame:
    """cdf: the sum over strictly smaller keys; ccdf: over this and larger ones."""
    w = Window.partitionBy(*(group or [F.lit(1)])).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("cdf", F.coalesce(F.sum(p).over(w), F.lit(0.0))).withColumn("ccdf", 1 - F.col("cdf"))


def top_bottom(totals: DataFrame, key: str, value: str, share: float | None = 0.2, n: int | None = None) -> DataFrame:
    """(key, value, rank, grp): top, bottom or middle by value, ties by key; int(share * keys) or n at each end, none for 0."""
    w = Window.partitionBy(F.lit(1))
    out = totals.withColumn("rank", F.row_number().over(w.orderBy(F.desc(value), key))).withColumn("_n", F.count("*").over(w))
    k = F.lit(n) if n is not None else F.floor(F.col("_n") * share)
    grp = F.when(F.col("rank") <= k, "top").when(F.col("rank") > F.col("_n") - k, "bottom").otherwise("middle")
    return out.withColumn("grp", grp).drop("_n")


def lower_and_rest(totals: DataFrame, key: str, value: str, share: float = 0.2) -> DataFrame:
    """(key, value, grp): the lowest floor(share * n) keys and all the rest."""
    w = Window.partitionBy(F.lit(1))
    out = totals.withColumn("_r", F.row_number().over(w.orderBy(value, key))).withColumn("_n", F.count("*").over(w))
    return out.withColumn("grp", F.when(F.col("_r") <= F.floor(F.col("_n") * share), "lowest").otherwise("rest")).drop("_r", "_n")


def change(before: Column, after: Column) -> Column:
    """Relative change; null where there was nothing before."""
    return F.try_divide(after - before, before)


def lifecycle(before: Column, after: Column) -> Column:
    """1 retained, 2 new, 0 gone."""
    return F.when(before & after, 1).when(after, 2).otherwise(0)
