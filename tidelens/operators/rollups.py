"""Aggregations from function metrics to posts, weeks and entity-week panels.

Each is one hash aggregation with partial sums before the shuffle; shares are windows
over the aggregated result, never a join of the input with its own totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import quantiles

ROLLUPS = {"mean": F.avg, "max": F.max, "std": F.stddev_samp, "median": F.median}


def per_post(metrics: DataFrame, option: str, value: str = "cc", key: str = "id") -> DataFrame:
    """(key, value): mean, max, std, median or sum of log(1+x) per post."""
    if option == "sum":
        return metrics.groupBy(key).agg(F.sum(F.log1p(value)).alias("value"))
    if option not in ROLLUPS:
        raise ValueError(f"unknown rollup {option!r}")
    return metrics.groupBy(key).agg(ROLLUPS[option](F.log1p(value)).alias("value"))


def by_bin(df: DataFrame, bin_: Column, name: str, *keys: str, **aggs: Column) -> DataFrame:
    """One row per bin and keys."""
    return df.groupBy(*keys, bin_.alias(name)).agg(*(c.alias(k) for k, c in aggs.items()))


def panel(df: DataFrame, bin_: Column, value: str = "cc", entity: str = "language", min_cell: int = 1, min_entity: int = 1) -> DataFrame:
    """(entity, rel_week, y, y_sd, raw_mean, raw_sd, n_func): entities and cells with enough functions only."""
    log = F.log1p(value)
    cells = df.groupBy(entity, bin_.alias("rel_week")).agg(F.avg(log).alias("y"), F.stddev_samp(log).alias("y_sd"), F.avg(value).alias("raw_mean"), F.stddev_samp(value).alias("raw_sd"), F.count("*").alias("n_func"))
    if min_entity > 1:
        cells = cells.withColumn("_all", F.sum("n_func").over(Window.partitionBy(entity))).where(F.col("_all") >= min_entity).drop("_all")
    return cells.where(F.col("n_func") >= min_cell) if min_cell > 1 else cells


def covered(cells: DataFrame, entity: str = "language", bin_: str = "rel_week", least: int = 50) -> DataFrame:
    """Cells of entities with at least `least` bins before the event and as many from it on."""
    w = Window.partitionBy(entity)
    out = cells.withColumn("_pre", F.count_if(F.col(bin_) < 0).over(w)).withColumn("_post", F.count_if(F.col(bin_) >= 0).over(w))
    return out.where((F.col("_pre") >= least) & (F.col("_post") >= least)).drop("_pre", "_post")


def bin_covered(cells: DataFrame, bin_: str, entity: str, entities: int = 10, functions: int = 50, n: str = "n_func") -> DataFrame:
    """Cells of at least `functions` functions in bins that `entities` entities share."""
    big = cells.where(F.col(n) >= functions)
    shared = big.groupBy(bin_).agg(F.count_distinct(entity).alias("_e")).where(F.col("_e") >= entities).select(bin_)
    return big.join(shared, bin_, "left_semi")


def reference_bin(bins: DataFrame, bin_: str, wanted: int = -1) -> Column:
    """Aggregate: the wanted bin if it is there, else the largest negative one."""
    return F.coalesce(F.max(F.when(F.col(bin_) == wanted, F.col(bin_))), F.max(F.when(F.col(bin_) < 0, F.col(bin_))))


def shares(df: DataFrame, group: list[str], key: str, weight: Column | None = None, scale: float = 100.0, name: str = "share") -> DataFrame:
    """(group, key, n, share): what each key has of its group, in percent."""
    n = F.count("*") if weight is None else F.sum(weight)
    out = df.groupBy(*group, key).agg(n.alias("n"))
    total = F.sum("n").over(Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1)))
    return out.withColumn(name, F.try_divide(F.col("n"), total) * scale)


def grid(df: DataFrame, left: str, right: str, values: list[str], fill: float = 0.0) -> DataFrame:
    """df completed to every pair of its left and right values; missing cells get fill.

    Both value sets are dimensions (bins, levels, languages): the grid is their product
    by intent, and df joins it once.
    """
    full = df.select(left).distinct().join(F.broadcast(df.agg(F.collect_set(right).alias("_r")))).select(left, F.explode("_r").alias(right))
    return full.join(df, [left, right], "left").fillna(fill, values)


def describe(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    x = F.col(column)
    # How often each value occurs is far less to read again than df, where values repeat.
    times = df.groupBy(*by, column).agg(F.count("*").alias("_times"))
    q = quantiles.quantiles(times, by, column, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, "_times")
    out = df.groupBy(*by).agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    return quantiles.same(out, q, by, "left").select(*by, "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def weighted_mean(x: str, w: str) -> Column:
    return F.try_divide(F.sum(F.col(x) * F.col(w)), F.sum(w))


def weighted_sem(df: DataFrame, by: list[str], x: str, w: str) -> DataFrame:
    """(by, mean, sem): sqrt(weighted variance / n), null for a single row. Weighted moments in one aggregation, so a large group is many partial sums."""
    xc, wc = F.col(x).cast("double"), F.col(w).cast("double")
    m = df.groupBy(*by).agg(F.count("*").alias("_n"), F.sum(wc).alias("_w"), F.sum(wc * xc).alias("_wx"), F.sum(wc * xc * xc).alias("_wxx"))
    mean = F.col("_wx") / F.col("_w")
    variance = F.greatest(F.lit(0.0), F.col("_wxx") / F.col("_w") - mean * mean)
    return m.select(*by, mean.alias("mean"), F.when(F.col("_n") > 1, F.sqrt(variance / F.col("_n"))).alias("sem"))


def pivot_counts(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    return df.groupBy(row).pivot(column, values).count().fillna(0)


def empty_cells(df: DataFrame, row: str, column: str) -> DataFrame:
    """How many pairs of a row value and a column value never occur."""
    return df.agg((F.count_distinct(row) * F.count_distinct(column) - F.count_distinct(row, column)).alias("empty_cells"))


def running_total(df: DataFrame, key: str, order: list[str], period: Column, value: str, name: str) -> DataFrame:
    """df with the sum of value over the key's rows up to each one, in the given order, the first part of which gives the period.

    Rows are summed inside a period of a key, and the periods before are added: a key with very many rows
    is spread over as many tasks as it has periods.
    """
    rows = df.withColumn("_p", period)
    inside = Window.partitionBy(key, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    earlier = rows.groupBy(key, "_p").agg(F.sum(value).alias("_s")).select(F.col(key).alias("_k"), F.col("_p").alias("_q"), F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_b"))
    same = F.col(key).eqNullSafe(F.col("_k")) & F.col("_p").eqNullSafe(F.col("_q"))
    return rows.withColumn("_i", F.sum(value).over(inside)).join(earlier, same).withColumn(name, F.col("_i") + F.col("_b")).drop("_i", "_b", "_p", "_k", "_q")
