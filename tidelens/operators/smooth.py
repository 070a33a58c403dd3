"""Local regression as windows over sorted rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.adapters import scratch
from . import quantiles


def lowess(panel: DataFrame, by: str, x: str, y: str, share: float = 0.2, rounds: int = 3) -> DataFrame:
    """(by, x, smooth): local lines with tricube weights, made robust by bisquare rounds.

    A row's k nearest, k being `share` of its group's rows, are among the k - 1 rows on either side in the order of
    x, so a round is one window of at most 2k - 1 rows and the work n times k. Of rows at one distance
    the earlier in the order of x, then y, is nearer. Rounds are written, for each reads the last one's residuals. Null
    values take no part; a row whose neighbours all have lost their weight keeps its value of the round before.
    """
    spark, folder = panel.sparkSession, f"{scratch(panel.sparkSession)}/lowess-{uuid.uuid4().hex}"
    order = Window.partitionBy(by).orderBy("_x", "_y")
    rows = panel.select(by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna(subset=["_x", "_y"])
    n = F.count("*").over(Window.partitionBy(by))
    rows = rows.withColumns({"_i": F.row_number().over(order), "_k": F.least(n, F.greatest(F.lit(2), F.floor(share * n + 1e-10))).cast("int")})
    rows = rows.withColumns({"_r": F.lit(1.0), "_out": F.col("_y")})

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    rows = kept(rows, "rows")
    reach = (rows.agg(F.max("_k")).first()[0] or 1) - 1
    frame = Window.partitionBy(by).orderBy("_i").rowsBetween(-reach, reach)

    def line() -> Column:
        """The value at _x of the weighted line through the k nearest of _near, null without weight."""
        near = F.slice(F.array_sort(F.transform("_near", lambda p: F.struct(F.abs(p["x"] - F.col("_x")).alias("d"), p["i"].alias("i"), p["x"].alias("x"), p["y"].alias("y"), p["r"].alias("r")))), 1, F.col("_k"))
        bind = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
        total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, p: s + f(p))

        def weighed(points: Column) -> Column:
            far = F.greatest(F.element_at(points, -1)["d"], F.lit(1e-12))
            cube = lambda v: v * v * v
            return F.transform(points, lambda p: F.struct((cube(F.greatest(F.lit(0.0), 1 - cube(p["d"] / far))) * p["r"]).alias("w"), p["x"].alias("x"), p["y"].alias("y")))

        def fitted(p: Column) -> Column:
            w = F.struct(total(p, lambda v: v["w"]).alias("w"), total(p, lambda v: v["w"] * v["x"]).alias("x"), total(p, lambda v: v["w"] * v["y"]).alias("y"))
            return bind(w, lambda s: F.when(s["w"] > 0, bind(F.struct((s["x"] / s["w"]).alias("x"), (s["y"] / s["w"]).alias("y")), lambda m: through(p, m))))

        def through(p: Column, m: Column) -> Column:
            sxx = total(p, lambda v: v["w"] * (v["x"] - m["x"]) * (v["x"] - m["x"]))
            sxy = total(p, lambda v: v["w"] * (v["x"] - m["x"]) * (v["y"] - m["y"]))
            return m["y"] + bind(sxx, lambda q: F.when(q > 1e-12, sxy / q).otherwise(F.lit(0.0))) * (F.col("_x") - m["x"])

        return bind(near, lambda a: bind(weighed(a), fitted))

    for k in range(rounds + 1):
        near = F.collect_list(F.struct(F.col("_i").alias("i"), F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_r").alias("r"))).over(frame)
        rows = kept(rows.withColumn("_near", near).withColumn("_out", F.coalesce(line(), "_out")).drop("_near"), f"round-{k}")
        if k < rounds:
            rows = rows.withColumn("_e", F.abs(F.col("_y") - F.col("_out")))
            middle = quantiles.quantiles(rows, [by], "_e", {"_s": 0.5})
            part = F.col("_e") / (6 * F.col("_s"))
            robust = F.when(F.col("_s") > 0, F.pow(F.greatest(F.lit(0.0), 1 - part * part), F.lit(2.0))).otherwise(F.lit(1.0))
            rows = quantiles.same(rows, middle, [by]).withColumn("_r", robust).drop("_e", "_s")
    return rows.select(by, F.col("_x").alias(x), F.col("_out").alias("smooth"))
