"""Exact order statistics of large groups by refinement of histograms.

Each round counts the values of every group in BUCKETS buckets between the bounds known so far, with the least and the
largest of each bucket, and keeps the bucket that holds the wanted rank: its own least and largest are the new bounds.
Where one value fills the bucket it is the result; where FEW values or less are left, their ranks decide. So nothing sorts
a whole group, and no task or map holds all its distinct values. Odd rounds divide the bounds evenly, even rounds by
logarithms, so that neither long tails nor crowded values hold it up. Values are exact, whatever the buckets are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelvinlake.tables import settle

BUCKETS, FEW = 1024, 250_000

#: (how, share): `linear` interpolates at share x (n - 1), `upper` takes the value of rank floor(share x n) from 0 on.
Wanted = dict[str, tuple[str, float]]


def _place(how: str, share: float) -> Column:
    at = share * (F.col("_n") - 1) if how == "linear" else F.floor(share * F.col("_n"))
    return F.least(at.cast("double"), (F.col("_n") - 1).cast("double"))


def _bucket(v: Column, even: bool) -> Column:
    lo, hi = F.col("_lo"), F.col("_hi")
    if even:
        share = F.when(hi - lo < float("inf"), (v - lo) / (hi - lo)).otherwise(F.lit(0.0))
    else:
        smooth = lambda x: F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log2(F.abs(x)) + 1100))  # noqa: E731  ascends over all doubles
        share = F.when(smooth(hi) > smooth(lo), (smooth(v) - smooth(lo)) / (smooth(hi) - smooth(lo))).otherwise(F.lit(0.0))
    return F.least(F.greatest(F.floor(share * BUCKETS), F.lit(0)), F.lit(BUCKETS - 1)).cast("int")


def exact(t: DataFrame, keys: list[str], value: Column, wanted: Wanted, few: int | None = None) -> DataFrame:
    """(keys, a column for each wanted statistic) of the values of t that are numbers; groups without any are left out.

    t is read once for the groups' sizes, once for each round (none where groups are of `few` values or less) and once for
    the last ranks: make it a table if it is dear. Bounds and ranks of the groups are a table after each round.
    """
    few = few or FEW
    cells = t.select(*keys, value.cast("double").alias("_v")).filter("_v is not null and not isnan(_v)")
    sizes = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), _place(*w).alias("at")) for k, w in wanted.items()))).alias("w")
    now = sizes.select(*keys, "_n", "_lo", "_hi", each)
    now = now.select(*keys, F.col("w.name").alias("_name"), F.col("w.at").alias("_at"), F.floor("w.at").alias("_k"), "_lo", "_hi", F.col("_n").alias("_left"), F.lit(0).cast("long").alias("_below"), F.lit(None).cast("double").alias("_next"))
    now = settle(now, "ranks")
    open_ = (F.col("_left") > few) & (F.col("_lo") < F.col("_hi"))

    def met(targets: DataFrame) -> DataFrame:
        joined = cells.join(targets, keys) if keys else cells.join(F.broadcast(targets), F.lit(True))  # without keys: a row for each statistic
        return joined.filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))

    turn = 0
    while now.filter(open_).limit(1).count():
        state = [*keys, "_name"]
        w = Window.partitionBy(*state).orderBy("_bucket")
        seen = met(now.filter(open_)).groupBy(*state, _bucket(F.col("_v"), turn % 2 == 0).alias("_bucket")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), *(F.first(c).alias(c) for c in ("_at", "_k", "_below", "_next")))
        seen = seen.withColumns({"_upto": F.col("_below") + F.sum("_c").over(w), "_behind": F.coalesce(F.lead("_low").over(w), "_next")})
        own = (F.col("_k") < F.col("_upto")) & (F.col("_k") >= F.col("_upto") - F.col("_c"))
        narrowed = seen.filter(own).select(*state, "_at", "_k", F.col("_low").alias("_lo"), F.col("_high").alias("_hi"), F.col("_c").alias("_left"), (F.col("_upto") - F.col("_c")).alias("_below"), F.col("_behind").alias("_next"))
        now = settle(now.filter(~open_).unionByName(narrowed), "ranks")
        turn += 1
    state = [*keys, "_name"]
    single = now.filter("_lo = _hi").select(*state, "_at", "_k", F.col("_lo").alias("_v"), (F.col("_below") + F.col("_left")).alias("_upto"), "_next")
    w = Window.partitionBy(*state).orderBy("_v")
    ranks = met(now.filter("_lo < _hi")).groupBy(*state, "_v").agg(F.count(F.lit(1)).alias("_c"), *(F.first(c).alias(c) for c in ("_at", "_k", "_below", "_next")))
    ranks = ranks.withColumns({"_upto": F.col("_below") + F.sum("_c").over(w), "_next": F.coalesce(F.lead("_v").over(w), "_next")})
    found = ranks.filter((F.col("_k") < F.col("_upto")) & (F.col("_k") >= F.col("_upto") - F.col("_c"))).select(*state, "_at", "_k", "_v", "_upto", "_next")
    # the value of rank k, and towards the one of rank k + 1
    following = F.when(F.col("_upto") > F.col("_k") + 1, F.col("_v")).otherwise(F.coalesce("_next", "_v"))
    part = F.col("_at") - F.col("_k")
    both = single.unionByName(found).withColumn("_x", F.when(part == 0, F.col("_v")).when(part == 0.5, (F.col("_v") + following) / 2).otherwise(F.col("_v") * (1 - part) + following * part))
    return both.groupBy(*keys).agg(*(F.max(F.when(F.col("_name") == k, F.col("_x"))).alias(k) for k in wanted))
