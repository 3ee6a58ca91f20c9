"""No task holds a unit, however its rows lay before: behind a join by unit too they are dealt out by slab."""

import pytest
from pyspark.sql import functions as F

from kelvinlake.operators import series, slabs


@pytest.fixture
def unhelped(spark):
    """Joins are not turned into broadcasts, plans are not changed as they run."""
    kept = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in kept.items():
        spark.conf.set(k, v)
    yield spark
    for k in kept:
        spark.conf.unset(k)


def test_windows_behind_joins_by_unit(unhelped):
    n = 40_000
    t = unhelped.range(n).select(F.concat(F.lit("u"), F.col("id") % 1).alias("equipment_id"), F.col("id").alias("row_ord"), (F.col("id") * 60_000).alias("ts_ms"), F.when(F.col("id") % 5 != 0, F.col("id").cast("double")).alias("energy"))
    most = lambda df: max(r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect())
    assert most(slabs.scan(slabs.slabbed(t, 1_000), before={"p": F.col("energy")})) < 0.6 * n
    numbers = t.withColumn("rn", (F.col("row_ord") + 1).cast("int")).join(t.select("equipment_id").distinct(), "equipment_id")
    assert most(slabs.scan(slabs.by_number(numbers, 1_000), before={"p": F.col("energy")}, order=("rn",))) < 0.6 * n
    assert most(slabs.framed(numbers, 48, lambda w: {"lag": F.lag("energy", 48).over(w)}, 1_000)) < 0.6 * n


def test_large_tables_get_a_task_a_slab(spark, monkeypatch):
    monkeypatch.setattr(slabs, "SLAB_ROWS", 1_000)
    t = spark.range(20_000).select(F.lit("u").alias("equipment_id"), F.col("id").alias("row_ord"), (F.col("id") * 60_000).alias("ts_ms"))
    assert slabs.slabbed(t).rdd.getNumPartitions() == 20


def test_cells_between_values_of_one_time(spark):
    """As the SQL has it, a division by no time gives nothing, and the value before is carried on."""
    rows = [("u", 1, 0, 1.0), ("u", 2, 60_000, 5.0), ("u", 3, 60_000, None), ("u", 4, 60_000, 9.0), ("u", 5, 120_000, 2.0)]
    t = spark.createDataFrame(rows, "equipment_id string, row_ord long, ts_ms long, energy double")
    assert [r["energy"] for r in series.impute(t).orderBy("row_ord").collect()] == [1.0, 5.0, 5.0, 9.0, 2.0]
