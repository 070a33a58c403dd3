"""The test tables in the roles of posts, function metrics, tags and owners."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "1998-06-03"
PLACEBO = "1997-06-03"


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a new temporary one on a single machine, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def posts(spark: SparkSession, d: str) -> DataFrame:
    """(id, creationdate, language, owner, price)."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("creationdate"), F.col("o_orderpriority").alias("language"), F.col("o_custkey").alias("owner"), F.col("o_totalprice").alias("price"))


def metrics(spark: SparkSession, d: str) -> DataFrame:
    """(id, cc, nloc): one row per function of a post."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").cast("int").alias("cc"), F.col("l_linenumber").alias("nloc"))


def tag_sets(spark: SparkSession, d: str) -> DataFrame:
    """(id, tags): the distinct tags of each post, one shuffle by id that later steps can reuse."""
    part = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("tag"))
    return table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("tag").alias("tags"))


def tags(spark: SparkSession, d: str) -> DataFrame:
    """(id, tag): distinct tags of posts."""
    return tag_sets(spark, d).select("id", F.explode("tags").alias("tag"))


def votes(spark: SparkSession, d: str, draws: int = 5) -> DataFrame:
    """(id, draw, gold, label): answers 0..2 drawn by md5, gold from the labels."""
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") + F.col("toxic")).alias("gold"))
    rows = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    return rows.withColumn("label", F.conv(F.substring(F.md5(F.concat_ws("|", F.col("id"), F.expr("draw div 3"))), 1, 4), 16, 10).cast("int") % 3)
