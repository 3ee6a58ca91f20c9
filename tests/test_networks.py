"""The network learns from all rows of a unit, whatever the number of its shards."""

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelvinlake.operators import models


@pytest.fixture(scope="module")
def rows(spark):
    x = [(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10_001)) / 5000 - 1).alias(f"x{k}") for k in range(4)]
    t = spark.range(6000).select(F.when(F.col("id") < 4000, "a").otherwise("b").alias("equipment_id"), F.col("id").cast("int").alias("rn"), *x)
    y = F.abs("x0") * 2 - F.col("x1") + F.when(F.col("x2") > 0, F.col("x3")).otherwise(0.0)
    return t.select("equipment_id", "rn", F.array("x0", "x1", "x2", "x3").alias("mlp_x"), y.alias("y"))


def test_fit_does_not_depend_on_shards(rows):
    got = rows.collect()
    x, y = np.array([r["mlp_x"] for r in got]), np.array([r["y"] for r in got])
    unit = np.array([r["equipment_id"] for r in got])
    losses = {}
    for shard in (100_000, 700):
        fitted = {r["equipment_id"]: pickle.loads(r["model"]) for r in models.fit_networks(rows, shard).collect()}
        assert set(fitted) == {"a", "b"}
        for u, w in fitted.items():
            losses[u, shard] = ((models.predict(w, x[unit == u]) - y[unit == u]) ** 2).mean() / y[unit == u].var()
    assert max(losses.values()) < 0.06
    assert all(abs(losses[u, 700] - losses[u, 100_000]) < 0.04 for u in "ab")


def test_weights_keep_their_shapes():
    w = models.fresh_network(16, 3)
    assert all((a == b).all() for a, b in zip(w, models.shaped(models.flat(w))))


def test_short_units_have_no_network(spark):
    t = spark.createDataFrame([("a", i, [1.0, 2.0], 1.0) for i in range(19)], "equipment_id string, rn int, mlp_x array<double>, y double")
    assert models.fit_networks(t).count() == 0
