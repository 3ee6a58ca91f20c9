"""Published runs, release of intermediate tables, progress."""

import os

import pytest
from pyspark.sql import functions as F

from kelvinlake.plans import catalog, pipeline
from kelvinlake.tables import released, settle


def tables(spark):
    return {"a": spark.range(7).withColumn("x", F.array(F.struct("id"))), "none": spark.range(0).withColumn("s", F.lit("t"))}


def test_a_run_is_published_read_and_removed(spark, tmp_path):
    folder = str(tmp_path / "runs")
    assert catalog.runs(spark, folder) == []
    first, second = catalog.publish(spark, tables(spark), folder, "r1"), catalog.publish(spark, {"a": spark.range(2)}, folder, "r2")
    assert catalog.runs(spark, folder) == [first, second]
    assert {k: t["rows"] for k, t in catalog.manifest(spark, folder, "r1")["tables"].items()} == {"a": 7, "none": 0}
    back = catalog.opened(spark, folder, "r1")
    assert back["a"].schema.simpleString() == tables(spark)["a"].schema.simpleString() and back["none"].columns == ["id", "s"]
    assert {(r["name"], r["n_rows"], r["whole"]) for r in catalog.verified(spark, folder, "r1").collect()} == {("a", 7, True), ("none", 0, True)}
    assert catalog.views(spark, folder, prefix="last_") == ["last_a"] and spark.table("last_a").count() == 2
    with pytest.raises(catalog.CatalogError):
        catalog.publish(spark, tables(spark), folder, "r1")
    spark.range(3).write.mode("append").parquet(f"{folder}/r1/a")
    assert {(r["name"], r["whole"]) for r in catalog.verified(spark, folder, "r1").collect()} == {("a", False), ("none", True)}
    catalog.remove(spark, folder, "r1")
    assert catalog.runs(spark, folder) == ["r2"] and not os.path.exists(f"{folder}/r1")


def test_a_run_without_a_manifest_is_none(spark, tmp_path):
    folder = str(tmp_path)
    bad = {"a": spark.range(3), "b": spark.range(3).select(F.raise_error(F.lit("fault")).alias("x"))}
    with pytest.raises(Exception, match="fault"):
        catalog.publish(spark, bad, folder, "broken")
    assert catalog.runs(spark, folder) == [] and os.path.exists(f"{folder}/broken/a")
    with pytest.raises(catalog.CatalogError):
        catalog.opened(spark, folder)
    catalog.publish(spark, {"a": spark.range(3)}, folder, "broken")  # the name is free
    assert catalog.runs(spark, folder) == ["broken"]


def test_intermediate_tables_go(spark):
    with pytest.raises(ValueError), released(spark):
        kept = settle(spark.range(3), "x").inputFiles()[0].removeprefix("file://")
        assert os.path.exists(kept)
        raise ValueError
    assert not os.path.exists(kept)


def test_a_published_analysis_tells_its_progress(spark, tmp_path):
    n, ms = 400, 1_800_000
    energy = F.when(F.col("id").between(300, 306), 400.0).otherwise(100 + F.col("id") % 48 + F.col("id") % 7)
    rows = spark.range(n).select(F.lit("u").alias("equipment_id"), (F.col("id") * ms).alias("ts_ms"), F.col("id").alias("row_ord"), energy.alias("energy"))
    rows = rows.withColumns({"hour": F.pmod(F.col("ts_ms"), F.lit(86_400_000)) / 3_600_000, "dow": F.pmod(F.floor(F.col("ts_ms") / 86_400_000) + 4, F.lit(7)).cast("int"), "load": F.col("energy") * 2 + F.col("row_ord") % 5})
    told = []
    name = pipeline.publish_run(rows, str(tmp_path), progress=lambda stage, share: told.append((stage, share)))
    shares = [x for _, x in told]
    assert [s for s, _ in told] == list(pipeline.STEPS) and shares == sorted(shares) and (shares[0], shares[-1]) == (0.0, 1.0)
    assert all(r["whole"] for r in catalog.verified(spark, str(tmp_path), name).collect())
    assert catalog.opened(spark, str(tmp_path), name)["points"].count() == n
