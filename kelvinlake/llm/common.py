"""What the operators of this subpackage share: table access, shared scratch tables, text conventions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvinlake.sources.contract import ship
from kelvinlake.tables import shared_folder

#: Characters of the class [\x20\x09-\x0D]: what ends a word and what is stripped from a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Stands in for a null doc_id inside joins and maxima; below every id in use.
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends in files that outlive executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop(table: DataFrame) -> None:
    """Remove the files of a table of cut() that nothing reads any more, and let go what only finished rounds needed: shuffle files
    stay on the executors' disks until the driver's garbage is collected, which a large heap puts off."""
    jvm, session = table.sparkSession._jvm, table.sparkSession._jsparkSession
    path = jvm.org.apache.hadoop.fs.Path(table.written_to)
    path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)
    jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key that one row in HOT holds, or more, is joined by broadcast: at most HOT keys can.
HOT = 1024


def join_keys(rows: DataFrame, per_key: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """rows joined (inner) to a table with one row a key, whose weight column counts the rows of the key.

    Keys with a HOTth of all rows or more (so a bounded number, whose hashes are fetched) are joined by broadcast, so
    that no task gets all rows of a key; the others are shuffled. Each row passes one of the two joins.
    """
    code = F.xxhash64(*keys)
    found = [r[0] for r in per_key.filter(F.col(weight) * HOT >= total).select(code).collect()]
    columns = [*rows.columns, *(c for c in per_key.columns if c not in keys)]
    if not found:
        return rows.join(per_key, keys).select(*columns)
    hot = code.isin(found)
    heavy = rows.filter(hot).join(F.broadcast(per_key.filter(hot)), keys)
    return heavy.unionByName(rows.filter(~hot).join(per_key.filter(~hot), keys)).select(*columns)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone. lower() does the same, faster, where all characters are ASCII."""
    plain = F.octet_length(c) == F.char_length(c)
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def words(text: str) -> list[bytes]:
    r"""Words [^\x20\x09-\x0D]+ with A-Z lower-cased, as UTF-8; bytes.split() and lower() know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split()
