"""Tables of intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, master: str | None = None) -> str:
    """The folder named in spark.checkpoint.dir, or else one in the warehouse. A warehouse on a local disk is an error on a
    cluster (master: that of the session): each machine would see files of its own."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    master = master or spark.sparkContext.master
    scheme = warehouse.split(":", 1)[0] if ":" in warehouse else spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file").split(":", 1)[0]
    if scheme == "file" and not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"{master}: set spark.checkpoint.dir to a folder that driver and executors share; the warehouse {warehouse} is a local one")
    return f"{warehouse}/scratch"


def file_system(spark: SparkSession, path: str) -> tuple:
    """The file system that holds path, and path in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


#: Paths written by settle() within each released() that is open.
_written: list[list[str]] = []


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Tables that settle() writes within are removed at its end, also after an error: results that read them must have been
    written elsewhere by then."""
    paths: list[str] = []
    _written.append(paths)
    try:
        yield
    finally:
        _written.remove(paths)
        for path in paths:
            fs, at = file_system(spark, path)
            fs.delete(at, True)


def settle(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """df written to the shared folder and read back: later plans start there, and lost executors cost no more than the read.
    Tables stay for as long as results that read them, or to the end of a released(); each has its own name, and who owns the
    folder clears it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _written[-1:]:
        paths.append(path)
    df.write.parquet(path, **({"compression": codec} if codec else {}))
    return spark.read.schema(df.schema).parquet(path)
