"""Resumable work: restarts, repeats, other checkpoints, and a batch that fails."""

import pytest
from pyspark.sql import functions as F

from tidelens.streaming import daily

SCHEMA = "id long, v long"


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def test_resumable_work(spark, tmp_path):
    source, f = tmp_path / "in", str(tmp_path)
    worked = []

    def run(state, work=lambda df: df.select("id", (F.col("v") * 2).alias("v"))):
        stream = daily.source(spark, f"{source}/*", SCHEMA, 1)
        daily.run_available(stream, work, f"{f}/done", f"{f}/out", f"{f}/{state}").awaitTermination()
        worked.append(sorted(r.id for r in spark.read.parquet(f"{f}/out").select("id").collect()))

    put(spark, source, "a", [(1, 10), (2, 20), (2, 20), (3, 30)])  # a key twice in one batch
    put(spark, source, "b", [(2, 20), (4, 40)])  # and again in the next
    run("first")
    assert worked[-1] == [1, 2, 3, 4]
    put(spark, source, "c", [(1, 10), (5, 50), (5, 50)])
    run("first")
    run("first")
    assert worked[-1] == [1, 2, 3, 4, 5]
    put(spark, source, "d", [(6, 60), (3, 30)])
    run("second")  # knows the others by the done table, reads everything again
    assert worked[-1] == [1, 2, 3, 4, 5, 6]
    run("first")
    assert worked[-1] == [1, 2, 3, 4, 5, 6, 6]  # checkpoints do not learn of each other once they run

    put(spark, source, "e", [(7, 70)])

    def fails(df):
        df.write.mode("overwrite").parquet(f"{f}/seen")
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run("second", fails)
    run("second")
    run("second")
    assert worked[-1] == [1, 2, 3, 4, 5, 6, 6, 7]
    out = spark.read.parquet(f"{f}/out")
    assert {(r.id, r.v) for r in out.collect()} == {(i, 20 * i) for i in range(1, 8)}


def test_keys_are_looked_up_without_python(spark, tmp_path):
    """A call per key took too long; a null key counts once too, for a new checkpoint as well."""
    source, f = tmp_path / "in", str(tmp_path)
    put(spark, source, "a", [(None, 1), (None, 1), (1, 1)])
    for state in ("first", "second"):
        q = daily.run_available(daily.source(spark, f"{source}/*", SCHEMA), lambda b: b.select("id"), f"{f}/done", f"{f}/out", f"{f}/{state}")
        q.awaitTermination()
        plan = q._jsq.explainInternal(False)
        assert "StreamingDeduplicate" in plan and "Pandas" not in plan and "PySpark" not in plan
        assert sorted((r.id for r in spark.read.parquet(f"{f}/out").select("id").collect()), key=str) == [1, None]
