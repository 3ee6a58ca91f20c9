"""Published runs: one folder a run, with a manifest that names its tables, their schemas and their rows.

A run is there once its manifest is: tables are written first, then the manifest under another name, which is renamed.
A reader therefore sees whole runs only, and a run that failed leaves a folder without a manifest, which remove() takes away.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kelvinlake.tables import file_system

MANIFEST = "manifest.json"


class CatalogError(RuntimeError):
    """No such run, or a table whose rows are not those of the manifest."""


def publish(spark: SparkSession, result: dict[str, DataFrame], folder: str, run: str | None = None) -> str:
    """Write the tables of result and their manifest to folder/run; returns the run's name, by default its time and a random
    part. Rows are counted as they are written. A name that is published already is an error."""
    run = run or f"{int(time.time() * 1000):013d}-{uuid.uuid4().hex[:8]}"
    fs, path = file_system(spark, f"{folder}/{run}/{MANIFEST}")
    if fs.exists(path):
        raise CatalogError(f"run {run} is published in {folder} already")
    tables = {}
    for name, df in result.items():
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/{run}/{name}")
        tables[name] = {"rows": seen.get.get("n", 0), "schema": df.schema.jsonValue()}
    _, draft = file_system(spark, f"{folder}/{run}/{MANIFEST}.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps({"run": run, "tables": tables}).encode()))
    out.close()
    if not fs.rename(draft, path):
        raise CatalogError(f"run {run} was published in {folder} by another job")
    return run


def runs(spark: SparkSession, folder: str) -> list[str]:
    """Names of the published runs in order."""
    fs, path = file_system(spark, folder)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
    return sorted(n for n in names if fs.exists(file_system(spark, f"{folder}/{n}/{MANIFEST}")[1]))


def manifest(spark: SparkSession, folder: str, run: str | None = None) -> dict:
    """The manifest of a run, by default of the last one."""
    there = runs(spark, folder)
    if not there or (run or there[-1]) not in there:
        raise CatalogError(f"no run {run or ''} in {folder}")
    fs, path = file_system(spark, f"{folder}/{run or there[-1]}/{MANIFEST}")
    data = spark._jvm.org.apache.commons.io.IOUtils.toString(fs.open(path), "UTF-8")
    return json.loads(data)


def opened(spark: SparkSession, folder: str, run: str | None = None) -> dict[str, DataFrame]:
    """The tables of a published run, with the schemas of its manifest."""
    m = manifest(spark, folder, run)
    return {k: spark.read.schema(StructType.fromJson(t["schema"])).parquet(f"{folder}/{m['run']}/{k}") for k, t in m["tables"].items()}


def verified(spark: SparkSession, folder: str, run: str | None = None) -> DataFrame:
    """(name, n_rows, whole): the rows of each table as read back, and whether the manifest says the same."""
    m, out = manifest(spark, folder, run), None
    for k, t in opened(spark, folder, m["run"]).items():
        one = t.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(k).alias("name"), "n_rows", (F.col("n_rows") == m["tables"][k]["rows"]).alias("whole"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "name string, n_rows long, whole boolean")
    return out


def views(spark: SparkSession, folder: str, run: str | None = None, prefix: str = "") -> list[str]:
    """A temporary view for each table of a run; returns their names."""
    tables = opened(spark, folder, run)
    for k, t in tables.items():
        t.createOrReplaceTempView(f"{prefix}{k}")
    return [f"{prefix}{k}" for k in tables]


def remove(spark: SparkSession, folder: str, run: str) -> None:
    """Take a run away, published or not; its manifest goes first, so no reader finds half of it."""
    fs, path = file_system(spark, f"{folder}/{run}/{MANIFEST}")
    fs.delete(path, False)
    fs.delete(path.getParent(), True)
