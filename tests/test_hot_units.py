"""Rows are not dealt out by unit to meet a row of their unit: the few rows go to the many."""

import pytest
from pyspark.sql import functions as F

from kelvinlake.operators import models, series, slabs
from kelvinlake.plans import pipeline
from kelvinlake.tables import settle

N = 40_000


@pytest.fixture
def points(spark):
    """Scored rows of one unit; plans are not changed as they run, and only small tables are broadcast."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "64k"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    rn = (F.col("id") + 1).cast("int")
    run = F.when(F.col("id") % 1_000 < 3, rn - (F.col("id") % 1_000).cast("int"))
    t = spark.range(N).select(
        F.lit("u").alias("equipment_id"), F.col("id").alias("row_ord"), (F.col("id") * 60_000).alias("ts_ms"), rn.alias("rn"), F.lit(1.0).alias("hour"), F.rand(1).alias("energy"), (F.col("id") % 97 / 97).alias("resid_z"),
        (F.col("id") % 89 / 89).alias("score"), run.alias("s"), (run + 2).alias("e"),
    )
    yield settle(t, "points")
    for k in conf:
        spark.conf.unset(k)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("of", [series.exposure, series.spearman_trend, lambda x: pipeline.split_by_data(x)[0], lambda x: series.downsample(x, "energy", 20)])
def test_rows_meet_their_unit_where_they_are(points, of):
    assert "SortMergeJoin" not in plan(of(points))


def test_rows_outside_runs_are_not_joined(points):
    eps = series.episodes(points)
    out = series.row_severity(points, eps)
    most = max(r["count"] for r in out.groupBy(F.spark_partition_id().alias("task")).count().collect())
    assert most < 0.6 * N
    flagged = out.filter("flagged")
    assert (out.count(), flagged.count(), eps.count()) == (N, 120, 40) and out.filter("not flagged and severity <> 'normal'").isEmpty()
    assert flagged.filter("severity not in ('watch', 'alert', 'action')").isEmpty()


def test_scored_rows_get_a_task_a_slab(points, spark, monkeypatch):
    monkeypatch.setattr(slabs, "SLAB_ROWS", 2_000)
    r = points.drop("s", "e", "score").withColumn("raw", F.lit(0.5))
    out = series.scored(r, points.filter("s is not null").select("equipment_id", "s", "e").distinct())
    assert out.rdd.getNumPartitions() == 20 and out.filter("s is not null").count() == 120


def test_rows_before_peaks_are_not_broadcast(points):
    """The wanted rows are 49 for each episode, so a small file of episodes does not make them small."""
    eps = settle(points.filter("s is not null").select(F.concat_ws("-", "equipment_id", "rn").alias("id"), "equipment_id", F.col("rn").alias("peak_rn")), "episodes")
    for rows in (0, N):
        near = series.around(points, eps, rows=rows)
        assert "Broadcast" not in plan(near)
    sizes = near.select(F.size("rows").alias("n")).agg(F.count("n"), F.sum("n")).first()
    assert tuple(sizes) == (120, 49 * 120 - (48 + 47 + 46))


def test_rows_meet_their_numbers_and_scores_by_shuffle(points, spark, monkeypatch):
    """A few columns of a wide table, and scores that compress well, are estimated below the threshold, however many rows they hold."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    numbered = series.numbered_as(points.select("equipment_id", "row_ord", "energy"), points, ["equipment_id", "row_ord"], N)
    assert "Broadcast" not in plan(numbered) and numbered.count() == N
    seen = []
    monkeypatch.setattr(pipeline, "model_features", lambda z: z)
    monkeypatch.setattr(models, "fit_units", lambda f: f)
    monkeypatch.setattr(models, "score_units", lambda f, m: f.select("equipment_id", "rn", F.lit(0.1).alias("forest"), F.lit(0.0).alias("pred")))

    def stop(rows):
        seen.append(plan(rows))
        raise StopIteration

    monkeypatch.setattr(series, "calibrated", stop)
    with pytest.raises(StopIteration):
        pipeline.score(points, pipeline.Options(model="learned"))
    assert "Broadcast" not in seen[0]


def test_draws_of_many_units_are_not_broadcast(points, spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    unit, rn = F.concat(F.lit("u"), F.col("id") % 40), (F.floor(F.col("id") / 40) + 1).cast("int")
    few = settle(spark.range(40 * 104).select(unit.alias("equipment_id"), rn.alias("rn"), F.array(F.rand(1)).alias("if_x"), F.array(F.rand(2)).alias("mlp_x"), F.rand(3).alias("y")), "features")
    fitted = models.fit_units(few)
    assert "Broadcast" not in plan(fitted) and fitted.filter("part >= 0").count() == 40 * models.TREES
