"""Structured Streaming: deduplication, daily roll-up, sessions and trailing features of a telemetry stream."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kelvinlake.sources import contract
from kelvinlake.tables import settle, shared_folder


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New files named events.parquet in the folder (a file source reads folders)."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("at", F.col("ts").cast("timestamp"))


def deduped(s: DataFrame, delay: str = "1 day") -> DataFrame:
    """One row for each event_id within the watermark."""
    return s.withWatermark("at", delay).dropDuplicatesWithinWatermark(["event_id"])


def daily(s: DataFrame, delay: str = "2 days") -> DataFrame:
    w = s.withWatermark("at", delay).groupBy("event_type", F.window("at", "1 day")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select("event_type", F.unix_millis(F.col("window.start")).alias("day_ms"), "n", F.floor(F.col("total") * 100 + 0.5).alias("cents"))


def sessions(s: DataFrame, gap: str = "7 hours", delay: str = "2 days") -> DataFrame:
    w = s.withWatermark("at", delay).groupBy("event_type", F.session_window("at", gap)).agg(F.count(F.lit(1)).alias("n"))
    return w.select("event_type", F.unix_millis(F.col("session_window.start")).alias("start_ms"), "n")


def telemetry_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of (equipment_id, ts_ms, row_ord, energy)."""
    batch = contract.telemetry(spark, sf_dir)  # what it derives from an event is the same on a stream
    e = event_stream(spark, sf_dir)
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    energy = F.when(F.col("event_id") % 17 != 0, F.col("value")).cast(batch.schema["energy"].dataType)
    return e.select(F.col("event_type").alias("equipment_id"), ms.alias("ts_ms"), F.col("event_id").alias("row_ord"), energy.alias("energy"))


FEATURES = "equipment_id string, ts_ms long, row_ord long, filled double, lag1 double, lag48 double, roll_mean double"


def features(s: DataFrame, window: int = 48) -> DataFrame:
    """FEATURES of each row as it comes: energy carried forward over missing cells, its lags by 1 and `window` rows and
    its mean over the last `window`, null before there are as many. A unit's state is its last value, its last time and
    `window` values. Rows older than the unit's last are late and left out; what follows a gap is not known yet, so
    nothing is interpolated."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_ms, ring = state.get if state.exists else (-(2**62), [])
        rows = pd.concat(list(batches)).sort_values(["ts_ms", "row_ord"])
        rows = rows[rows["ts_ms"] > last_ms]
        if rows.empty:
            return
        before = np.array([np.nan if v is None else v for v in ring], float)
        filled = pd.Series(np.concatenate([before, rows["energy"].to_numpy(float)])).ffill()
        n = len(before)
        out = rows[["ts_ms", "row_ord"]].assign(equipment_id=key[0], filled=filled[n:].to_numpy(), lag1=filled.shift(1)[n:].to_numpy(), lag48=filled.shift(window)[n:].to_numpy(), roll_mean=filled.rolling(window, min_periods=1).mean()[n:].to_numpy())
        out.loc[np.arange(n, n + len(out)) < window - 1, "roll_mean"] = np.nan
        kept = [None if np.isnan(v) else float(v) for v in filled[-window:]]
        state.update((int(rows["ts_ms"].iloc[-1]), kept))
        yield out[[c.split()[0] for c in FEATURES.split(", ")]]

    out = s.groupBy("equipment_id").applyInPandasWithState(update, FEATURES, "last_ms long, ring array<double>", "append", GroupStateTimeout.NoTimeout)
    return out.select("equipment_id", "ts_ms", "row_ord", *(F.nullif(F.nanvl(c, F.lit(None).cast("double")), F.lit(None).cast("double")).alias(c) for c in ("filled", "lag1", "lag48", "roll_mean")))


#: Rows of a file that fed() writes, about.
FILE_ROWS = 500_000


def fed(rows: DataFrame, parts: int, heartbeat: str, late: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """(a stream of rows(equipment_id, ts_ms, ...), the parts they came in): written to the shared folder in `parts` parts by
    time, one a trigger, with rows for which `late` holds in the part behind theirs; a heartbeat of no unit, 400 days and the
    length of the series on, ends it. A part is a file for each FILE_ROWS rows."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    span = settle(rows.agg(F.min("ts_ms").alias("_lo"), F.max("ts_ms").alias("_hi"), F.count(F.lit(1)).alias("_n")), "feed")
    files = max(1, -(-span.first()["_n"] // (parts * FILE_ROWS)))
    span = span.drop("_n")
    at = F.floor((F.col("ts_ms") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1) * parts).cast("int")
    dealt = rows.join(F.broadcast(span), F.lit(True)).withColumn("part", at + F.when(late, 1).otherwise(0))  # one row
    end = span.select(*(F.lit(heartbeat).alias(c) if c == "equipment_id" else (F.col("_hi") * 2 - F.col("_lo") + 400 * 86_400_000).alias(c) if c == "ts_ms" else F.lit(0 if c == "row_ord" else None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns))
    for i in range(parts + 1):
        part = dealt.filter(F.col("part") == i).select(*rows.columns)
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.parquet(f"{path}/{i}")
    end.coalesce(1).write.parquet(f"{path}/{parts + 1}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(path)
    return stream, dealt


def drained(out: DataFrame, name: str, mode: str, keys: int | None = None) -> DataFrame:
    """Runs a stream over what is there into Parquet and returns a read of it. Table and stream state lie in the folder that
    driver and executors share. mode `append`: rows are final when they come, and state ends with the watermark. keys: how many the
    stream's state is kept for, where that is known; every trigger opens a store for each part of the state, so there are four a
    key at most."""
    spark = out.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = out.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", min(int(usual), 4 * keys if keys else int(usual)))
    try:
        running = writer.format("parquet").option("path", f"{path}/table").start()  # with settings of its own from here on
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    running.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/table")
