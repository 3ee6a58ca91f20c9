"""A telemetry fixture of three units over nine measures, made by Spark: deterministic noise from hashes of (unit, slot)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelvinlake.functions import scalar as S
from kelvinlake.sources.contract import MEASURES, NAME_OF

#: Fixed values: (days, share of the load, daily jitter of efficiency) of each unit; gap windows (unit, day, slot, rows) at
#: 48 slots a day; how many cells of each measure are missing.
UNITS = {"CHILLER-01": (128, 0.42, 0.02), "CHILLER-02": (262, 0.36, 0.015), "CHILLER-03": (208, 0.22, 0.025)}
GAPS = (("CHILLER-03", 128, 25, 14), ("CHILLER-02", 250, 29, 6), ("CHILLER-03", 9, 6, 16), ("CHILLER-01", 61, 23, 18), ("CHILLER-02", 29, 45, 3), ("CHILLER-03", 68, 7, 12), ("CHILLER-01", 45, 16, 13), ("CHILLER-01", 51, 25, 15))
MISSING = {"flow": 40, "cooling": 5, "load": 19, "energy": 9, "humidity": 20, "wind": 23, "pressure": 12}
DECIMALS = {"flow": 2, "cooling": 2, "load": 1, "energy": 2, "outside": 1, "dew": 1, "humidity": 1, "wind": 2, "pressure": 2}
START_MS, SLOT_MS, SLOTS = 1566086400000, 1_800_000, 48
#: What the fixture hides: (name, unit, first day, day after the last).
FAULTS = (("spike", "CHILLER-01", 60.0, 60.5), ("condenser", "CHILLER-01", 88.0, 91.6), ("degradation", "CHILLER-02", 172.0, 262.0), ("imbalance", "CHILLER-03", 72.0, 73.5), ("frozen", "CHILLER-03", 85.0, 85.5))


def noise(name: str, *by: str) -> Column:
    """A standard normal value for each value of the columns and name (Box-Muller on two hashes)."""
    u = lambda k: (F.pmod(F.xxhash64(F.lit(name), F.lit(k), *by), F.lit(1 << 30)) + 0.5) / (1 << 30)
    return F.sqrt(-2 * F.log(u(1))) * F.cos(2 * math.pi * u(2))


def fault_windows(spark: SparkSession) -> DataFrame:
    rows = [(u, n, START_MS + int(a * S.DAY_MS), START_MS + int(b * S.DAY_MS)) for n, u, a, b in FAULTS]
    return spark.createDataFrame(rows, "equipment_id string, name string, from_ms long, to_ms long")


def slots(spark: SparkSession) -> DataFrame:
    """(equipment_id, share, jitter, slot) without the gap windows."""
    units = spark.createDataFrame([(u, *v) for u, v in UNITS.items()], "equipment_id string, days int, share double, jitter double")
    gaps = spark.createDataFrame(GAPS, "equipment_id string, day int, first int, n int")
    first = F.col("day") * SLOTS + F.col("first")
    lost = gaps.select("equipment_id", F.explode(F.sequence(first, F.least(first + F.col("n"), (F.col("day") + 1) * SLOTS) - 1)).alias("slot"))
    rows = units.select("equipment_id", "share", "jitter", F.explode(F.expr(f"sequence(0, days * {SLOTS} - 1)")).alias("slot"))
    return rows.join(F.broadcast(lost), ["equipment_id", "slot"], "left_anti")


def without_cells(rows: DataFrame) -> DataFrame:
    """rows with MISSING cells of each measure emptied: those of the least hashes, found by a top-k and joined."""
    for measure, n in MISSING.items():
        picked = rows.select("equipment_id", "slot").orderBy(F.xxhash64(F.lit(measure), "equipment_id", "slot"), "equipment_id", "slot").limit(n)
        rows = rows.join(F.broadcast(picked.withColumn("_lost", F.lit(True))), ["equipment_id", "slot"], "left").withColumn(measure, F.when(F.col("_lost").isNull(), F.col(measure))).drop("_lost")
    return rows


def demo(spark: SparkSession) -> DataFrame:
    """A series under the contract: half-hourly rows with gaps, missing cells and the faults of FAULTS."""
    own = ("equipment_id", "slot")
    rows = slots(spark).withColumns({"day": F.col("slot") / SLOTS, "date": F.floor(F.col("slot") / SLOTS), "hour": (F.col("slot") % SLOTS) / 2, "ts_ms": F.lit(START_MS) + F.col("slot").cast("long") * SLOT_MS})
    rows = rows.withColumn("dow", F.pmod(F.floor(F.col("ts_ms") / S.DAY_MS) + 4, F.lit(7)).cast("int"))
    year = 2 * math.pi * F.col("date") / 365
    outside = 52 + 26 * F.cos(year) + 7 * F.sin(2 * math.pi**2 * (F.col("hour") / 24 - 0.42)) + 1.4 * noise("outside", *own)
    rows = rows.withColumn("outside", outside).withColumn("dew", F.col("outside") - (14 + 6 * F.sin(year)) + 1.1 * noise("dew", *own))
    celsius = lambda c: (F.col(c) - 32) / 1.8
    rows = rows.withColumns({
        "humidity": S.clamp(100 * S.vapour_pressure(celsius("dew")) / S.vapour_pressure(celsius("outside")) + 3 * noise("humidity", *own), 22.0, 96.0),
        "wind": S.clamp(3.2 + 2.6 * noise("wind", *own) + 1.6 * F.sin(2 * math.pi * F.col("date") / 7), 0.2, 11.0),
        "pressure": S.clamp(29.9 + 0.13 * F.sin(2 * math.pi * F.col("date") / 9) + 0.05 * noise("pressure", *own), 29.2, 30.5),
    })
    demand = 260 * (0.58 + 0.42 * F.cos(year)) * (0.78 + 0.22 * F.sin(2 * math.pi * (F.col("hour") - 9) / 24)) * F.when(F.col("dow").isin(0, 6), 0.86).otherwise(1.0)
    rows = rows.withColumn("load", F.col("share") * F.greatest(F.lit(1.0), demand * (1 + 0.025 * noise("load", *own))))
    within = {n: (F.col("equipment_id") == u) & (F.col("day") >= a) & (F.col("day") < b) for n, u, a, b in FAULTS}
    by_fault = lambda values, other: F.coalesce(*(F.when(within[n], v) for n, v in values.items()), F.lit(other))
    flow = (0.0215 * F.col("load") + 0.12 + 0.06 * noise("flow", *own)) * by_fault({"condenser": F.lit(1.08), "imbalance": F.lit(0.6)}, 1.0)
    cooling = 26.3 + 0.011 * F.col("load") + 0.09 * (F.col("outside") - 75) + 0.35 * noise("cooling", *own) + by_fault({"condenser": F.lit(4.5), "imbalance": F.lit(1.8), "frozen": F.lit(1.5)}, 0.0)
    rows = rows.withColumns({"flow": flow, "cooling": cooling, "_still": within["frozen"]})
    # the frozen sensor repeats the value it held when it stopped
    held = F.first("flow").over(Window.partitionBy("equipment_id", "_still").orderBy("slot"))
    rows = rows.withColumn("flow", F.when(F.col("_still"), held).otherwise(F.col("flow")))
    efficiency = (1 + F.col("jitter") * noise("efficiency", "equipment_id", "date")) * by_fault({"spike": F.lit(1.85), "condenser": F.lit(1.22), "degradation": 1 + 0.17 * S.smoothstep((F.col("day") - 172) / 90), "imbalance": F.lit(0.82), "frozen": F.lit(0.86)}, 1.0)
    power = F.greatest(F.lit(0.6), 3 + 0.62 * F.col("load") * efficiency + 0.05 * F.greatest(F.lit(0.0), F.col("outside") - 75))
    rows = rows.withColumn("energy", F.greatest(F.lit(0.25), 0.5 * power + 0.15 * noise("energy", *own)))
    rows = without_cells(rows.withColumns({m: F.round(m, d) for m, d in DECIMALS.items()}))
    return rows.select("equipment_id", F.col("slot").cast("long").alias("row_ord"), "ts_ms", "hour", "dow", *MEASURES)


def write_csv(t: DataFrame, path: str) -> None:
    """A series as a contract CSV in one file, by time and unit."""
    at = F.date_format(F.timestamp_millis("ts_ms").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp")
    rows = t.orderBy("ts_ms", "equipment_id").select(at, "equipment_id", *(F.col(m).alias(n) for m, n in NAME_OF.items()))
    rows.coalesce(1).write.option("header", True).csv(path)
