"""Consecutive numbers over a whole frame, without a window over all of it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.adapters import scratch


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with the place of each row in the given order, from 0.

    Rows are dealt by ranges of the order and written; a row's number is that in its range and the rows of the ranges before,
    which are one line each. The order should tell all rows apart, else equal ones get their numbers in any order.
    """
    spark, folder = df.sparkSession, f"{scratch(df.sparkSession)}/numbered-{uuid.uuid4().hex}"
    df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).write.parquet(folder)
    rows = spark.read.parquet(folder)
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return rows.withColumn(name, place.cast("long")).join(F.broadcast(before), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")
