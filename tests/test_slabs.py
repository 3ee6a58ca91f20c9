"""Series windows over slabs equal windows over whole units, wherever slabs begin; order statistics equal sorted values."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kelvinlake.functions import scalar as S
from kelvinlake.operators import selection, series, slabs
from kelvinlake.tables import shared_folder


def ordered():
    return Window.partitionBy("equipment_id").orderBy("ts_ms", "row_ord")


@pytest.fixture(scope="module")
def t(spark):
    rnd = random.Random(3)
    rows, k = [], 0
    for unit, n in (("a", 320), ("b", 60), ("c", 1)):
        at = 0
        for _ in range(n):
            at += rnd.choice([1800_000] * 8 + [0, 5_400_000, 30 * 86_400_000])
            k += 1
            rows.append((unit, k, at, rnd.choice([None, 1.0, 2.0, 2.0]) if rnd.random() < 0.3 else rnd.random() * 9, None if rnd.random() < 0.5 else float(rnd.randint(0, 3)), float(at // 3_600_000 % 24)))
    df = spark.createDataFrame(rows, "equipment_id string, row_ord long, ts_ms long, energy double, load double, hour double")
    return df.repartition(5).cache()


def rows_of(df, *cols):
    return sorted(map(tuple, df.select("equipment_id", "row_ord", *cols).collect()))


@pytest.mark.parametrize("size", [1, 7, 50, 10**6])
def test_scan(t, size):
    W = ordered()
    got = slabs.scan(slabs.slabbed(t, size), before={"p": F.col("load")}, after={"n": F.col("load")}, upto={"k": F.lit(1), "s": F.col("row_ord")})
    back = Window.partitionBy("equipment_id").orderBy(F.desc("ts_ms"), F.desc("row_ord")).rowsBetween(Window.unboundedPreceding, -1)
    want = t.withColumns({"p": F.last("load", True).over(W.rowsBetween(Window.unboundedPreceding, -1)), "n": F.last("load", True).over(back), "k": F.count(F.lit(1)).over(W), "s": F.sum("row_ord").over(W)})
    assert rows_of(got, "p", "n", "k", "s") == rows_of(want, "p", "n", "k", "s")


@pytest.mark.parametrize("size", [48, 60, 10**6])
def test_frames_with_halo(t, size):
    W = ordered()
    w = W.rowsBetween(-47, 0)
    columns = lambda w: {"lag48": F.lag("row_ord", 48).over(w), "mean": F.avg("energy").over(w.rowsBetween(-47, 0)), "n": F.count("energy").over(w.rowsBetween(-12, -1))}
    got = slabs.framed(slabs.numbered(t, size), 48, columns, size)
    want = t.withColumns({"lag48": F.lag("row_ord", 48).over(W), "mean": F.avg("energy").over(w), "n": F.count("energy").over(W.rowsBetween(-12, -1))})
    assert rows_of(got, "lag48", "mean", "n") == rows_of(want, "lag48", "mean", "n")


def analysed(t):
    filled = series.impute(t)
    rolled = series.rolling(filled)
    raw = filled.withColumn("raw", F.col("energy") / 9)
    limits = raw.select("equipment_id").distinct().withColumns({"threshold": F.lit(0.9), "rescue": F.lit(0.95)})
    scored = series.scored(raw, series.islands(raw, limits))
    near = series.nearest(t, t.select("equipment_id", (F.floor(F.col("ts_ms") / S.DAY_MS) * S.DAY_MS).alias("at_ms")).distinct())
    return [
        rows_of(filled, "energy", "load", "rn"), rows_of(rolled, "roll_mean", "roll_std", "roll_load"), rows_of(scored, "s", "e", "score"), rows_of(series.frozen(t, "load"), "frozen", "stuck"),
        rows_of(series.intervals(t), "gap"), sorted(map(tuple, near.collect())), sorted(map(tuple, series.downsample(t, "energy", 20).withColumn("mean", F.round("mean", 9)).collect())),
    ]


def test_analysis_is_the_same_for_any_slab(t, monkeypatch):
    whole = analysed(t)
    assert sum(r[2] is not None for r in whole[2]) > 5
    for size in (40,):
        monkeypatch.setattr(slabs, "SLAB_ROWS", size)
        assert analysed(t) == whole


def test_one_unit_is_many_tasks(spark):
    """No task holds a unit: each window partition of the plan is a slab."""
    n = 400_000
    t = spark.range(n).select(F.lit("u").alias("equipment_id"), F.col("id").alias("row_ord"), (F.col("id") * 60_000).alias("ts_ms"), F.when(F.col("id") % 5 != 0, F.col("id").cast("double")).alias("energy"))
    parts = slabs.slabbed(t, 10_000).groupBy("slab").count().collect()
    assert len(parts) == 40 and max(r["count"] for r in parts) == 10_000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = slabs.scan(slabs.slabbed(t, 10_000), before={"p": F.col("energy")})
        sizes = out.groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(r["count"] for r in sizes) < 0.6 * n
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def ranked(values, how, share):
    values = sorted(values)
    if how == "upper":
        return values[min(len(values) - 1, int(share * len(values)))]
    at = share * (len(values) - 1)
    k = int(at)
    return values[k] if at == k else (values[k] + values[k + 1]) / 2 if at - k == 0.5 else values[k] * (1 - at + k) + values[k + 1] * (at - k)


DRAWS = {
    "uniform": lambda r: r.random(),
    "tail": lambda r: 10 ** r.uniform(-200, 200) * r.choice([-1, 1]),
    "few": lambda r: float(r.randint(0, 3)),
    "one": lambda r: 4.25,
    "crowded": lambda r: 1e9 if r.random() < 0.01 else 1 + r.random() * 1e-9,
    "wide": lambda r: r.choice([-1.7e308, 1.7e308, 0.0, 5e-324, r.random()]),
}


@pytest.mark.parametrize("few", [20, 10**6])
def test_exact_ranks(spark, few, monkeypatch):
    rnd = random.Random(few)
    monkeypatch.setattr(selection, "BUCKETS", 64)
    values = {k: [f(rnd) for _ in range(rnd.randint(150, 201))] for k, f in DRAWS.items()} | {"single": [2.0], "pair": [1.0, 4.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("none", None), ("one", None), ("one", float("nan"))], "k string, v double").repartition(4)
    wanted = {"mid": ("linear", 0.5), "high": ("linear", 0.975), "upper": ("upper", 0.5), "least": ("linear", 0.0), "most": ("linear", 1.0)}
    got = {r["k"]: r for r in selection.exact(df, ["k"], F.col("v"), wanted, few).collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        for name, w in wanted.items():
            assert got[k][name] == ranked(vs, *w), (k, name)
    alone = selection.exact(df.filter("k = 'uniform'"), [], F.col("v"), {"mid": ("linear", 0.5)}, few).collect()
    assert [r["mid"] for r in alone] == [ranked(values["uniform"], "linear", 0.5)]
    assert selection.exact(df.filter("k = 'none'"), ["k"], F.col("v"), wanted, few).count() == 0


def test_shared_folder_is_named_on_a_cluster(spark):
    kept = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark, "spark://host:7077") == kept
    spark.conf.unset("spark.checkpoint.dir")
    try:
        if spark.conf.get("spark.checkpoint.dir", None) is None:
            for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
                with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
                    shared_folder(spark, master)
            assert shared_folder(spark).endswith("/scratch")
    finally:
        spark.conf.set("spark.checkpoint.dir", kept)
