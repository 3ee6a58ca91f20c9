"""Series windows over slabs of time, so one unit is many tasks.

A slab is a stretch of one unit's time; its rows are one window partition. What a row needs from before its slab (or from
behind it) is carried by summaries: one row a slab, scanned in order within each unit, and joined back. Frames of a bounded
number of rows are taken over blocks of row numbers that begin with a halo of the rows before them. Results do not depend
on where slabs begin. A unit's summaries are one task; there is one for each SLAB_ROWS rows of it, if these lie evenly.

Rows are dealt to tasks by slab explicitly: behind a join or grouping by unit they lie by unit, which Spark takes as good
enough for windows over (unit, slab), so that a task would hold whole units.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from kelvinlake.tables import settle

#: Rows of a slab, about, and of a block.
SLAB_ROWS = 100_000
UNIT = "equipment_id"
TIME = ("ts_ms", "row_ord")


def tasks(spark: SparkSession, rows: int) -> list[int]:
    """What repartition() of a table of so many rows is given before its keys: a task for each SLAB_ROWS, where that is more than the usual number."""
    n = -(-rows // SLAB_ROWS)
    return [n] if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else []


def slabbed(t: DataFrame, rows: int | None = None, at: str = "ts_ms") -> DataFrame:
    """t with `slab`: stretches of equal length of `at`, as many a unit as give `rows` rows each where they lie evenly. A slab's
    rows lie in one task; there is a task for each SLAB_ROWS rows of the table, where that is more than the usual number."""
    span = t.groupBy(UNIT).agg(F.min(at).alias("_from"), F.max(at).alias("_to"), F.count(F.lit(1)).alias("_rows"))
    width = F.floor((F.col("_to") - F.col("_from")) / F.ceil(F.col("_rows") / (rows or SLAB_ROWS))) + 1
    span = settle(span.select(UNIT, "_from", width.alias("_width"), "_rows"), "spans")
    total = span.agg(F.sum("_rows")).first()[0] or 0
    out = t.join(span.drop("_rows"), UNIT).withColumn("slab", F.floor((F.col(at) - F.col("_from")) / F.col("_width"))).drop("_from", "_width")
    return out.repartition(*tasks(t.sparkSession, total), UNIT, "slab")


def _order(order: tuple[str | Column, ...]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def scan(t: DataFrame, before: dict[str, Column] | None = None, after: dict[str, Column] | None = None, upto: dict[str, Column] | None = None, order: tuple = TIME) -> DataFrame:
    """t, of slabbed(), with columns over the whole series of each row's unit:

    before: the last value that is not null in the rows before; after: the first in the rows behind; upto: the sum of the
    rows up to it, itself included. Rows of a unit stand in the order given (a total one), slabs in theirs. `slab` is kept.
    """
    before, after, upto = before or {}, after or {}, upto or {}
    place = F.struct(*_order(order))
    held = lambda v: F.when(v.isNotNull(), place)
    parts = [F.max_by(v, held(v)).alias(k) for k, v in before.items()] + [F.min_by(v, held(v)).alias(k) for k, v in after.items()] + [F.sum(v).alias(k) for k, v in upto.items()]
    units = Window.partitionBy(UNIT)
    earlier, later = (units.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("slab"), F.desc("slab")))
    carry = {k: F.last(k, True).over(earlier) for k in before} | {k: F.last(k, True).over(later) for k in after} | {k: F.coalesce(F.sum(k).over(earlier), F.lit(0)) for k in upto}
    summary = t.groupBy(UNIT, "slab").agg(*parts).select(UNIT, "slab", *(c.alias(f"_{k}") for k, c in carry.items()))
    slab = Window.partitionBy(UNIT, "slab")
    up = slab.orderBy(*_order(order))
    down = slab.orderBy(*(c.desc() for c in _order(order)))
    own = {k: F.last(v, True).over(up.rowsBetween(Window.unboundedPreceding, -1)) for k, v in before.items()}
    own |= {k: F.last(v, True).over(down.rowsBetween(Window.unboundedPreceding, -1)) for k, v in after.items()}
    own |= {k: F.coalesce(F.sum(v).over(up.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) for k, v in upto.items()}
    inner = {k: f"_own_{k}" for k in own}
    rows = t.withColumns({inner[k]: c for k, c in own.items()}).join(summary, [UNIT, "slab"])
    whole = {k: F.coalesce(inner[k], F.col(f"_{k}")) for k in (*before, *after)} | {k: F.col(inner[k]) + F.col(f"_{k}") for k in upto}
    kept = [c for c in t.columns if c not in whole]
    return rows.select(*kept, *(c.alias(k) for k, c in whole.items()))


def numbered(t: DataFrame, rows: int | None = None) -> DataFrame:
    """t with rn, the place of each row in its unit's time, from 1 on."""
    return scan(slabbed(t, rows), upto={"rn": F.lit(1)}).drop("slab").withColumn("rn", F.col("rn").cast("int"))


def by_number(t: DataFrame, rows: int | None = None, total: int = 0) -> DataFrame:
    """t(rn) with `slab`: stretches of row numbers. total: the rows of t, where the usual number of tasks may be too few for them."""
    return t.withColumn("slab", F.floor((F.col("rn") - 1) / (rows or SLAB_ROWS))).repartition(*tasks(t.sparkSession, total), UNIT, "slab")


def framed(t: DataFrame, back: int, columns: Callable[[WindowSpec], dict[str, Column]], rows: int | None = None) -> DataFrame:
    """t(rn) with columns(w), where w orders the rows of a block by rn and reaches back `back` rows at least wherever the unit has
    them: the last `back` rows of each block stand before the next one as well, and go again."""
    size = max(rows or SLAB_ROWS, back)
    twice = (F.col("rn") - 1) % size >= size - back
    copies = F.explode(F.when(twice, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_halo")
    blocks = t.select("*", copies).withColumn("_block", F.floor((F.col("rn") - 1) / size) + F.col("_halo")).repartition(UNIT, "_block")
    w = Window.partitionBy(UNIT, "_block").orderBy("rn")
    return blocks.withColumns(columns(w)).filter("_halo = 0").drop("_halo", "_block")
