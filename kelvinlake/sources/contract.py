"""The telemetry contract: columns, header resolution, CSV ingest and the adapter for event tables.

A series has equipment_id, row_ord (order of arrival), ts_ms (wall clock as epoch milliseconds), hour (with its fraction),
dow (Sunday 0) and the nine measures under short names; null means missing.
"""

from __future__ import annotations

import csv
import os
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Measurement names of the contract with their units, in order.
UNITS = {
    "Chilled Water Rate": "l/s",
    "Cooling Water Temperature": "°C",
    "Building Load": "RT",
    "Chiller Energy Consumption": "kWh",
    "Outside Temperature": "°F",
    "Dew Point": "°F",
    "Humidity": "%",
    "Wind Speed": "m/s",
    "Pressure": "inHg",
}
#: The measures' names in a series, in the same order.
MEASURES = ("flow", "cooling", "load", "energy", "outside", "dew", "humidity", "wind", "pressure")
NAME_OF = dict(zip(MEASURES, UNITS))
TARGET = "Chiller Energy Consumption"
REQUIRED = ("timestamp", "equipment_id", TARGET)
QUOTING = {"quote": '"', "escape": '"'}
KEYS = ("equipment_id", "row_ord", "ts_ms", "hour", "dow")
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
#: A fraction is one to three digits, read as that many milliseconds, with or without seconds before it.
TIMESTAMP = r"^\s*(\d{4})-(\d{1,2})-(\d{1,2})[T ](\d{1,2}):(\d{2})(?::(\d{2}))?(?:\.(\d{1,3}))?"


class DatasetError(ValueError):
    """The input does not follow the contract."""


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed (local mode, tests)."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


# --- headers and cells --------------------------------------------------------------------------------------------


def normal_name(name: str) -> str:
    return re.sub(r"[\s_-]+", "", re.sub(r"\(.*?\)", "", name.strip().lower()))


def resolve_columns(headers: list[str]) -> tuple[dict[str, str], list[str]]:
    """(contract column -> first header that matches, absent columns); an absent required one is an error."""
    by_name: dict[str, str] = {}
    for h in headers:
        by_name.setdefault(normal_name(h), h)
    wanted = ["timestamp", "equipment_id", *UNITS]
    found = {c: by_name[normal_name(c)] for c in wanted if normal_name(c) in by_name}
    if lost := [c for c in REQUIRED if c not in found]:
        raise DatasetError(f"missing required columns {lost}; found {', '.join(h.strip() for h in headers) or '(none)'}")
    return found, [c for c in wanted if c not in found]


def safe_double(c: Column) -> Column:
    """The number a cell holds; null for blank, malformed or non-finite ones."""
    v = F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))
    return F.when(F.abs(v) < float("inf"), v)


def timestamp_parts(c: Column) -> dict[str, Column]:
    """ts_ms (fields out of range roll over; fraction and zone ignored), hour with its fraction, dow with Sunday 0."""
    part = lambda i: F.regexp_extract(c, TIMESTAMP, i).try_cast("int")
    months = (part(1) - 1970) * 12 + part(2) - 1
    first = F.add_months(F.lit("1970-01-01").cast("date"), months)
    days = F.datediff(first, F.lit("1970-01-01").cast("date")) + part(3) - 1
    ms = ((days.cast("long") * 24 + part(4)) * 60 + part(5)) * 60000 + F.coalesce(part(6), F.lit(0)) * 1000
    ok = c.rlike(TIMESTAMP)
    return {
        "ts_ms": F.when(ok, ms),
        "hour": F.when(ok, part(4) + part(5) / 60 + F.coalesce(part(7), F.lit(0)) / 3_600_000),
        "dow": F.when(ok, F.pmod(F.floor(ms / 86400000) + 4, F.lit(7)).cast("int")),
    }


# --- CSV ----------------------------------------------------------------------------------------------------------


def read_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """A contract CSV as strings under contract names, with row_ord in file order. Absent columns are null.

    Blank lines between rows are rows of nulls, those behind the last row are none. By default a row is a line, and the
    file is split between tasks; multiline reads cells that hold line ends, one task a file. Missing cells of short rows
    are null, cells beyond the header are ignored.
    """
    first = spark.read.text(path).first()
    line = first["value"] if first else ""
    headers = next(csv.reader([line.removeprefix("\ufeff").rstrip("\r")]), [])
    found, absent = resolve_columns(headers)
    names = [f"c{i}" for i in range(len(headers))]
    if multiline:
        rows = _with_blanks(spark, path, names)
    else:
        lines = _body(spark.read.text(path))
        cells = F.from_csv(F.rtrim(F.col("value"), F.lit("\r")), ", ".join(f"{c} string" for c in names), QUOTING)
        rows = lines.select("row_ord", cells.alias("cells")).select("row_ord", *(F.col("cells")[c].alias(c) for c in names))
    at = {h: f"c{i}" for i, h in reversed(list(enumerate(headers)))}
    blank = F.forall(F.array(*names), lambda x: F.trim(F.coalesce(x, F.lit(""))) == "")
    last = rows.filter(~blank).agg(F.max("row_ord").alias("last"))
    kept = rows.join(F.broadcast(last), F.lit(True)).filter("row_ord <= last")  # one row
    cells = [F.col(at[h]).alias(c) for c, h in found.items()] + [F.lit(None).cast("string").alias(c) for c in absent]
    return kept.select("row_ord", *cells)


def _body(text: DataFrame) -> DataFrame:
    """(row_ord, value): the lines of text files in order, without the first one of each file. Lines that repeat the header stay."""
    files = len(text.inputFiles())
    lines = text.select(F.monotonically_increasing_id().alias("row_ord"), "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"))
    if files == 1:
        return lines.filter("row_ord > 0").select("row_ord", "value")
    heads = lines.filter("_from = 0").groupBy("_file").agg(F.min("row_ord").alias("row_ord"))
    return lines.join(heads.select("row_ord"), "row_ord", "left_anti").select("row_ord", "value")


def _with_blanks(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Rows of a file with line ends inside quotes. The reader skips blank lines, so those that lie between rows are
    counted on the text: a line is blank if it holds nothing and an even number of quotes stands before it."""
    raw = spark.read.options(header="true", mode="PERMISSIVE", **QUOTING).option("multiLine", True).csv(path)
    rows = raw.toDF(*names).withColumn("row_ord", F.monotonically_increasing_id())
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    before = F.coalesce(F.sum("quotes").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    outside = lines.withColumn("before", before)
    filled = F.trim("value") != ""
    blanks = outside.filter((F.col("before") % 2 == 0) & ~filled).join(F.broadcast(outside.agg(F.max(F.when(filled, F.col("at"))).alias("end"))), F.lit(True)).filter("at < end")
    nulls = [F.lit(None).cast("string").alias(c) for c in names]
    return rows.unionByName(blanks.select(*nulls, (-1 - F.col("at")).alias("row_ord")))


def clean(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(series, quality counts): bad rows out, numbers parsed, the first row of each (unit, time) kept."""
    parts = timestamp_parts(F.col("timestamp"))
    unit = F.trim("equipment_id")
    good = parts["ts_ms"].isNotNull() & (F.coalesce(unit, F.lit("")) != "")
    cells = [safe_double(F.col(f"`{c}`")).alias(m) for m, c in NAME_OF.items()]
    rows = raw.select("row_ord", good.alias("good"), unit.alias("equipment_id"), *(v.alias(k) for k, v in parts.items()), *cells)
    first = Window.partitionBy("equipment_id", "ts_ms").orderBy("row_ord")
    kept = rows.filter("good").withColumn("nth", F.row_number().over(first)).filter("nth = 1").select(*KEYS, *MEASURES)
    counts = rows.agg(F.count_if(~F.col("good")).alias("bad_rows"), F.count_if("good").alias("good_rows"))
    both = counts.join(F.broadcast(kept.agg(F.count(F.lit(1)).alias("rows"))), F.lit(True))  # one row each
    return kept, both.select("bad_rows", "rows", (F.col("good_rows") - F.col("rows")).alias("duplicates"))


def load(spark: SparkSession, path: str, multiline: bool = False) -> tuple[DataFrame, DataFrame]:
    """clean() of a CSV; a file without rows, or without any good one, is an error."""
    raw = read_csv(spark, path, multiline)
    if raw.isEmpty():
        raise DatasetError("there is a header but there are no observations")
    t, counts = clean(raw)
    if t.isEmpty():
        raise DatasetError("no row has both a timestamp and a unit")
    return t, counts


def observed(t: DataFrame) -> DataFrame:
    """t with a flag o_<measure> for each cell that the source held; imputation fills the cells, the flags stay."""
    return t.withColumns({f"o_{m}": F.col(m).isNotNull() for m in MEASURES if m in t.columns})


def units_dimension(spark: SparkSession) -> DataFrame:
    """(column, name, unit) of the nine measures."""
    return spark.createDataFrame([(m, n, UNITS[n]) for m, n in NAME_OF.items()], "column string, name string, unit string")


# --- adapter ------------------------------------------------------------------------------------------------------


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as telemetry: a unit for each event type. Measures without a counterpart are derived, so that
    each kind occurs: cooling stands still on some days, wind has missing cells, pressure is constant, dew is absent."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    n, user = F.col("event_id"), F.col("user_id")
    return e.select(
        F.col("event_type").alias("equipment_id"),
        n.alias("row_ord"),
        ms.alias("ts_ms"),
        (F.pmod(ms, F.lit(86_400_000)) / 3_600_000).alias("hour"),
        F.pmod(F.floor(ms / 86_400_000) + 4, F.lit(7)).cast("int").alias("dow"),
        (user % 25).cast("double").alias("flow"),
        F.when(F.dayofmonth("ts") % 9 == 0, 25.0).otherwise((user * 7 + n) % 40 / 2.0 + 15).alias("cooling"),
        (F.get_json_object("props", "$.k").cast("double") + n % 7 * 0.013).alias("load"),
        F.when(n % 17 != 0, F.col("value")).alias("energy"),
        (F.floor(ms / 3_600_000) % 24 + user % 7).cast("double").alias("outside"),
        F.lit(None).cast("double").alias("dew"),
        (n % 61 + 30).cast("double").alias("humidity"),
        F.when(n % 29 != 0, (n % 23) / 2.0).alias("wind"),
        F.lit(29.9).alias("pressure"),
    )


#: The same for DuckDB.
TELEMETRY_SQL = """t AS (
  SELECT event_type AS equipment_id, event_id AS row_ord, epoch_us(ts) // 1000 AS ts_ms,
         ((epoch_us(ts) // 1000) % 86400000) / 3600000 AS hour, CAST((epoch_us(ts) // 1000 // 86400000 + 4) % 7 AS INT) AS dow,
         CAST(user_id % 25 AS DOUBLE) AS flow,
         CASE WHEN day(ts) % 9 = 0 THEN 25.0::DOUBLE ELSE (user_id * 7 + event_id) % 40 / 2.0::DOUBLE + 15 END AS cooling,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) + event_id % 7 * 0.013::DOUBLE AS load,
         CASE WHEN event_id % 17 <> 0 THEN value END AS energy,
         CAST((epoch_us(ts) // 3600000000) % 24 + user_id % 7 AS DOUBLE) AS outside, NULL::DOUBLE AS dew,
         CAST(event_id % 61 + 30 AS DOUBLE) AS humidity,
         CASE WHEN event_id % 29 <> 0 THEN (event_id % 23) / 2.0::DOUBLE END AS wind, 29.9::DOUBLE AS pressure
  FROM events)"""
