"""Per-unit time-series operators: quality, imputation, robust statistics, features, scores, episodes and roll-ups.

Windows over a unit's whole series go by slabs of its time (operators.slabs), medians and quantiles by refined histograms
(operators.selection), so a unit of any size is many tasks. Inputs follow sources.contract: equipment_id, row_ord, ts_ms,
hour, dow and any of its measures; null means missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from kelvinlake.functions import scalar as S
from kelvinlake.operators import slabs
from kelvinlake.operators.selection import exact
from kelvinlake.sources.contract import MEASURES
from kelvinlake.tables import settle

TARGET, LOAD = "energy", "load"


def by_unit() -> WindowSpec:
    return Window.partitionBy("equipment_id")


def measures(t: DataFrame) -> list[str]:
    """Those of the contract's measures that t has, in contract order."""
    return [m for m in MEASURES if m in t.columns]


# --- quality ------------------------------------------------------------------------------------------------------


def intervals(t: DataFrame) -> DataFrame:
    """t with `gap`, the time since the unit's row before; null for its first."""
    rows = slabs.scan(slabs.slabbed(t), before={"_prev": F.col("ts_ms")})
    return rows.withColumn("gap", F.col("ts_ms") - F.col("_prev")).drop("_prev", "slab")


def interval_median(t: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, median_ms): the upper median of the intervals."""
    return exact(intervals(t), keys, F.col("gap"), {"median_ms": ("upper", 0.5)}).withColumn("median_ms", F.col("median_ms").cast("long"))


def gap_report(t: DataFrame) -> DataFrame:
    """(median_ms, gaps, longest_h): a gap is longer than 1.5 medians and an hour; half an hour is the median of none."""
    med = interval_median(t, []).agg(F.coalesce(F.min("median_ms"), F.lit(1_800_000)).alias("median_ms"))
    g = intervals(t).join(F.broadcast(med), F.lit(True))  # one row
    gap = F.col("gap") > F.greatest(1.5 * F.col("median_ms"), F.lit(3_600_000))
    return g.groupBy("median_ms").agg(F.count_if(gap).alias("gaps"), F.coalesce(S.half_up(F.max(F.when(gap, F.col("gap"))) / 3_600_000, 1), F.lit(0.0)).alias("longest_h"))


def nominal_minutes(t: DataFrame) -> DataFrame:
    """One row: the upper median interval of the first unit, in minutes, 1 at least; 30 where it has one row."""
    first = t.join(F.broadcast(t.agg(F.min("equipment_id").alias("equipment_id"))), "equipment_id")
    return interval_median(first, ["equipment_id"]).agg(F.greatest(F.lit(1.0), F.floor(F.coalesce(F.min("median_ms"), F.lit(1_800_000)) / 60000 + 0.5)).alias("nominal"))


def missing_counts(t: DataFrame) -> DataFrame:
    """(column, n): missing cells of each measure that has any; a measure that is missing everywhere is told apart."""
    one = t.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col(m).isNull()).alias(m) for m in measures(t)))
    long = one.unpivot(["rows"], measures(t), "column", "n")
    return long.filter("n > 0").select("column", "n", (F.col("n") == F.col("rows")).alias("absent"))


def quality(t: DataFrame, counts: DataFrame) -> DataFrame:
    """One row: the quality report of clean()'s series and counts."""
    by_column = F.struct("column", "n", "absent")
    miss = missing_counts(t).agg(F.array_sort(F.collect_list(by_column)).alias("m"))  # nine at most
    miss = miss.select(F.map_from_entries(F.transform(F.filter("m", lambda x: ~x["absent"]), lambda x: F.struct(x["column"], x["n"]))).alias("missing_by_column"), F.transform(F.filter("m", lambda x: x["absent"]), lambda x: x["column"]).alias("missing_columns"))
    span = t.agg(F.count(F.lit(1)).alias("row_count"), F.countDistinct("equipment_id").alias("equipment_count"), F.min("ts_ms").alias("period_start"), F.max("ts_ms").alias("period_end"))
    out = span
    for one in (miss, gap_report(t).select("gaps", "longest_h"), counts.select("bad_rows", "duplicates")):
        out = out.join(F.broadcast(one), F.lit(True))  # one row each
    return out


# --- imputation and features --------------------------------------------------------------------------------------


def impute(t: DataFrame, nominal: DataFrame | None = None) -> DataFrame:
    """t with rn (each row's place in its unit's time, from 1 on) and its gaps filled: interpolated over spans of at most four
    nominal intervals, else carried forward, else back."""
    have = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col("ts_ms").alias("at"))) for c in measures(t)}
    out = slabs.scan(slabs.slabbed(t), {f"p_{c}": h for c, h in have.items()}, {f"n_{c}": h for c, h in have.items()}, {"rn": F.lit(1)})
    out = out.join(F.broadcast(nominal_minutes(t) if nominal is None else nominal), F.lit(True))  # one row
    filled = {}
    for c in have:
        p, n = F.col(f"p_{c}"), F.col(f"n_{c}")
        near = p.isNotNull() & n.isNotNull() & (n["at"] > p["at"]) & (n["at"] - p["at"] <= 4 * F.col("nominal") * 60000)
        line = p["v"] + (n["v"] - p["v"]) * ((F.col("ts_ms") - p["at"]) / (n["at"] - p["at"]))
        filled[c] = F.coalesce(c, F.when(near, line), p["v"], n["v"])
    return out.withColumns(filled | {"rn": F.col("rn").cast("int")}).select(*(c for c in t.columns if c != "rn"), "rn")


def unit_stats(t: DataFrame) -> DataFrame:
    """One row a unit: median m_<measure> and scaled MAD s_<measure> of each measure; null where it has no values. t is read
    several times: make it a table if it is dear."""
    cols = measures(t)
    cells = lambda of: t.select("equipment_id", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in of))).alias("c")).select("equipment_id", "c.*")
    half = {"m": ("linear", 0.5)}
    mid = settle(exact(cells(cols), ["equipment_id", "column"], F.col("x"), half), "medians")
    away = cells(cols).join(mid, ["equipment_id", "column"])
    spread = exact(away, ["equipment_id", "column"], F.abs(F.col("x") - F.col("m")), half).select("equipment_id", "column", (1.4826 * F.col("m")).alias("s"))
    both = mid.join(spread, ["equipment_id", "column"])
    pick = lambda c, v: F.max(F.when(F.col("column") == c, F.col(v))).alias(f"{v}_{c}")
    units = t.select("equipment_id").distinct()
    return settle(units.join(both.groupBy("equipment_id").agg(*(pick(c, v) for v in ("m", "s") for c in cols)), "equipment_id", "left"), "stats")


def usable(c: str) -> Column:
    """Of a row with unit_stats(): the measure has values that vary."""
    return F.coalesce(F.col(f"s_{c}") > 1e-9, F.lit(False))


def robust_stats(t: DataFrame) -> DataFrame:
    """(equipment_id, column, m, s, usable): median and scaled MAD; constant columns are not usable, those without values left out."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("m"), F.col(f"s_{c}").alias("s"), usable(c).alias("usable")) for c in measures(t)))).alias("c")
    return unit_stats(t).select("equipment_id", cells).select("equipment_id", "c.*").filter("m is not null")


def standardise(t: DataFrame) -> DataFrame:
    """t with unit_stats() and the robust z of each measure, clamped to 6 either way; null where the measure is missing or not usable."""
    out = t.join(unit_stats(t), "equipment_id")
    return out.withColumns({f"z_{c}": F.when(usable(c), S.clamp((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}"), -6.0, 6.0)) for c in measures(t)})


def placed(t: DataFrame) -> DataFrame:
    """t with rn, the place of each row in its unit's time, where it has none."""
    return t if "rn" in t.columns else slabs.numbered(t)


def lags(z: DataFrame) -> DataFrame:
    return slabs.framed(placed(z), 48, lambda w: {f"lag{n}": F.coalesce(F.lag(f"z_{TARGET}", n).over(w), F.lit(0.0)) for n in (1, 48)})


def trailing_mean(t: DataFrame, column: str, n: int, name: str) -> DataFrame:
    """t with the mean of a column over the n rows before each."""
    return slabs.framed(placed(t), n, lambda w: {name: F.avg(column).over(w.rowsBetween(-n, -1))})


def rolling(t: DataFrame, n: int = 48) -> DataFrame:
    """Means of energy and load and population deviation of energy over the last n rows, the current one included;
    before row n the own value and 0."""

    def columns(w: WindowSpec) -> dict[str, Column]:
        w, rn = w.rowsBetween(1 - n, 0), F.col("rn")
        mean = lambda c: F.when(rn >= n, F.avg(c).over(w)).otherwise(F.col(c))
        out = {"roll_mean": mean(TARGET), "roll_std": F.when(rn >= n, F.stddev_pop(TARGET).over(w)).otherwise(0.0)}
        return out | ({"roll_load": mean(LOAD)} if LOAD in t.columns else {})

    return slabs.framed(placed(t), n, columns)


# --- scores -------------------------------------------------------------------------------------------------------


def quantiles(t: DataFrame, value: str, at: dict[str, float]) -> DataFrame:
    """(equipment_id, a column for each name): linearly interpolated quantiles."""
    return exact(t, ["equipment_id"], F.col(value), {k: ("linear", p) for k, p in at.items()})


def linear_prediction(z: DataFrame) -> DataFrame:
    """z with `pred`: z_energy by least squares on z_load of the unit, 0 where load is not usable."""
    fit = z.groupBy("equipment_id").agg(F.regr_slope(f"z_{TARGET}", f"z_{LOAD}").alias("a"), F.regr_intercept(f"z_{TARGET}", f"z_{LOAD}").alias("b"))
    return z.join(settle(fit, "fits"), "equipment_id").withColumn("pred", F.coalesce(F.col("a") * F.col(f"z_{LOAD}") + F.col("b"), F.lit(0.0))).drop("a", "b")


def calibrated(y: DataFrame) -> DataFrame:
    """y(z_energy, pred) with rn, bin, hour_med, bin_med and resid_z: the residual, less the hour's and the prediction
    bin's median over trained rows, over its robust scale. Rows of the warm-up are scaled only."""
    y = placed(y).withColumns({"hour_bucket": F.least(F.lit(23), F.floor("hour").cast("int")), "r0": F.col(f"z_{TARGET}") - F.col("pred")})
    learned = F.col("rn") > S.WARMUP
    range_ = y.groupBy("equipment_id").agg(F.min(F.when(learned, F.col("pred"))).alias("_lo"), F.max(F.when(learned, F.col("pred"))).alias("_hi"))
    y = y.join(settle(range_, "ranges"), "equipment_id").withColumn("bin", S.bin8(F.col("pred"), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    y = settle(y, "residuals")
    for value, key, name, less in (("r0", "hour_bucket", "hour_med", "r1"), ("r1", "bin", "bin_med", "r2")):
        med = settle(exact(y.filter(learned), ["equipment_id", key], F.col(value), {name: ("linear", 0.5)}), "medians")
        y = y.join(med, ["equipment_id", key], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
        y = y.withColumn(less, F.when(learned, F.col(value) - F.col(name)).otherwise(F.col(value)))
    scale = settle(exact(y.filter(learned), ["equipment_id"], F.abs("r2"), {"scale": ("upper", 0.5)}), "scales")
    y = y.join(scale, "equipment_id", "left")
    by = F.coalesce(F.nullif(1.4826 * F.col("scale"), F.lit(0.0)), F.lit(1.0))
    return y.withColumn("resid_z", F.col("r2") / by).drop("scale", "r0", "r1", "r2")


def linear_residual(z: DataFrame) -> DataFrame:
    return calibrated(linear_prediction(z))


def raw_scores(r: DataFrame, forest: Column | None = None, forest_weight: float = 0.25, residual_weight: float = 0.75) -> DataFrame:
    return r.withColumn("raw", S.fuse(forest if forest is not None else F.lit(0.0), F.coalesce("resid_z", F.lit(0.0)), forest_weight, residual_weight))


def thresholds(r: DataFrame, mode: str = "quantile", quantile: float = 0.975) -> DataFrame:
    """(equipment_id, threshold, rescue). positional: the value at that share of the active rows in time order."""
    active = r.filter(f"rn > {S.WARMUP} and raw > 1e-9")
    at = {"t": quantile, "g": 0.99}
    if mode == "quantile":
        q = quantiles(active, "raw", at)
    else:
        n = settle(active.groupBy("equipment_id").agg(F.count(F.lit(1)).alias("_n")), "sizes")
        k = slabs.scan(slabs.by_number(active), upto={"_k": F.lit(1)}, order=("rn",)).join(n, "equipment_id")
        near = lambda p: F.greatest(F.lit(0.0), 1 - F.abs(F.col("_k") - 1 - p * (F.col("_n") - 1)))
        q = k.groupBy("equipment_id").agg(*(F.sum(F.col("raw") * near(p)).alias(name) for name, p in at.items()))
    units = r.select("equipment_id").distinct()
    out = units.join(q, "equipment_id", "left").select("equipment_id", F.coalesce(F.when(F.col("t").isNotNull(), F.greatest(F.lit(0.35), "t")), F.lit(0.6)).alias("threshold"), F.coalesce("g", F.lit(0.9)).alias("rescue"))
    return settle(out, "thresholds")


def islands(r: DataFrame, limits: DataFrame, join_window: int = S.JOIN_WINDOW) -> DataFrame:
    """Runs of candidates joined over up to join_window rows: (equipment_id, s, e); single rows only above rescue."""
    c = r.select("equipment_id", "ts_ms", "row_ord", "rn", "raw").join(limits, "equipment_id").filter(f"rn > {S.WARMUP} and raw > threshold")
    c = slabs.scan(slabs.by_number(c), before={"_prev": F.col("rn")}, order=("rn",))
    c = c.withColumn("new", F.when(F.col("rn") - F.col("_prev") > join_window + 1, 1).otherwise(0))
    c = slabs.scan(c, upto={"island": F.col("new")}, order=("rn",))
    runs = c.groupBy("equipment_id", "island").agg(F.min("rn").alias("s"), F.max("rn").alias("e"), F.min_by("raw", "rn").alias("first_raw"), F.first("rescue").alias("rescue"))
    return runs.filter("e - s >= 1 or first_raw > rescue").select("equipment_id", "s", "e")


def scored(r: DataFrame, runs: DataFrame) -> DataFrame:
    """r with run bounds s and e (null outside), score with the run's boost; warm-up rows score 0. r is counted: make it a table."""
    # a run's start is carried forward to its rows, in place of a range join
    starts = runs.select("equipment_id", F.col("s").alias("rn"), F.struct("s", "e").alias("run"))
    total = r.count()
    dealt = r.repartition(*slabs.tasks(r.sparkSession, total), "equipment_id", "rn")
    marked = slabs.scan(slabs.by_number(dealt.join(starts, ["equipment_id", "rn"], "left"), total=total), before={"_open": F.col("run")}, order=("rn",)).withColumn("run", F.coalesce("run", "_open"))
    inside = F.col("rn") <= F.col("run.e")
    out = marked.select(*r.columns, F.when(inside, F.col("run.s")).alias("s"), F.when(inside, F.col("run.e")).alias("e"))
    boost = 0.03 * F.least(F.lit(1.0), (F.col("e") - F.col("s") + 1) / 10)
    return out.withColumn("score", F.when(F.col("rn") <= S.WARMUP, 0.0).when(F.col("s").isNotNull(), S.clamp(F.col("raw") + boost, 0.0, 1.0)).otherwise(F.col("raw")))


def episodes(x: DataFrame) -> DataFrame:
    """One row for each run of scored(): times, duration, peak (first of equals) and severity relative to the unit. x is read once."""
    runs = x.filter("s is not null").groupBy("equipment_id", "s", "e").agg(
        F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.max("score").alias("top"), F.max_by(F.struct("rn", "ts_ms", "hour", "resid_z"), F.struct("score", -F.col("rn"))).alias("at")
    )
    runs = runs.select("equipment_id", "s", "e", "start_ms", "end_ms", "top", F.col("at.rn").alias("peak_rn"), F.col("at.ts_ms").alias("peak_ms"), F.col("at.hour").alias("peak_hour"), F.col("at.resid_z").alias("peak_resid_z"))
    runs = settle(runs, "runs")
    floors = settle(quantiles(runs, "top", {"high": 0.9, "mid": 0.6}), "floors")
    runs = runs.join(floors, "equipment_id")
    severity = F.when(F.col("top") >= F.greatest(F.lit(0.8), "high"), "action").when(F.col("top") >= F.greatest(F.lit(0.7), "mid"), "alert").otherwise("watch")
    out = runs.withColumns({"severity": severity, "id": F.concat_ws("-", "equipment_id", "start_ms"), "hours": S.half_up((F.col("end_ms") - F.col("start_ms")) / 3_600_000, 1), "peak": S.half_up(F.col("top"), 3)})
    return out.drop("high", "mid")


def row_severity(x: DataFrame, eps: DataFrame) -> DataFrame:
    """x with `flagged` and `severity` of each row: that of its run, else normal. Rows outside runs are not joined: they would
    all meet at their unit and null."""
    label = F.coalesce("severity", F.lit("normal"))
    runs = x.filter("s is not null").join(eps.select("equipment_id", "s", "severity"), ["equipment_id", "s"], "left")
    runs = runs.withColumns({"flagged": F.col("severity").isNotNull(), "severity": label})
    return runs.unionByName(x.filter("s is null").withColumns({"flagged": F.lit(False), "severity": F.lit("normal")}))


# --- roll-ups -----------------------------------------------------------------------------------------------------


def energy_stats(t: DataFrame) -> DataFrame:
    """Total and mean of energy as measured, rounded; 0 where there is none."""
    return t.groupBy("equipment_id").agg(S.half_up(F.coalesce(F.sum(TARGET), F.lit(0.0))).alias("total"), S.half_up(F.coalesce(F.avg(TARGET), F.lit(0.0)), 1).alias("mean"))


def exposure(x: DataFrame) -> DataFrame:
    """Share of the unit's last 30 days of rows with a score of 0.7 or more."""
    last = settle(x.groupBy("equipment_id").agg(F.max("ts_ms").alias("last")), "lasts")
    recent = x.join(last, "equipment_id").filter(F.col("ts_ms") >= F.col("last") - 30 * S.DAY_MS)
    return recent.groupBy("equipment_id").agg(F.avg((F.col("score") >= 0.7).cast("int")).alias("exposure"))


def daily(x: DataFrame) -> DataFrame:
    """Means of imputed energy and of the residual by epoch day."""
    return x.groupBy("equipment_id", F.floor(F.col("ts_ms") / S.DAY_MS).alias("day")).agg(F.avg(TARGET).alias("energy"), F.avg("resid_z").alias("resid_z"))


def seasonal(d: DataFrame) -> DataFrame:
    """Median of the 45 daily rows around each."""
    return d.withColumn("seasonal", F.percentile("energy", F.lit(0.5)).over(Window.partitionBy("equipment_id").orderBy("day").rowsBetween(-22, 22)))


def trend(d: DataFrame) -> DataFrame:
    """(equipment_id, slope, drift): OLS slope of the last 90 daily residuals (0 below 14), mean of the last 30."""
    back = d.withColumn("back", F.row_number().over(Window.partitionBy("equipment_id").orderBy(F.desc("day"))))
    last = back.filter("back <= 90")
    slope = F.when(F.count(F.lit(1)) < 14, 0.0).otherwise(F.regr_slope("resid_z", 90 - F.col("back")))
    return last.groupBy("equipment_id").agg(F.coalesce(slope, F.lit(0.0)).alias("slope"), F.coalesce(F.avg(F.when(F.col("back") <= 30, F.col("resid_z"))), F.lit(0.0)).alias("drift"))


def spearman_trend(x: DataFrame) -> DataFrame:
    """(equipment_id, n, trend): rank correlation of every 4th residual of the last 4320 rows with time; 0 for under 240 rows."""
    n = settle(x.groupBy("equipment_id").agg(F.count(F.lit(1)).alias("n")), "sizes")
    v = x.join(n, "equipment_id").filter(F.col("rn") > F.col("n") - F.least("n", F.lit(4320)))
    v = v.withColumn("k", F.col("rn") - (F.col("n") - F.least("n", F.lit(4320))) - 1).filter("k % 4 = 0")
    tie = Window.partitionBy("equipment_id", "resid_z")
    v = v.withColumn("rank", F.rank().over(by_unit().orderBy("resid_z")) + (F.count(F.lit(1)).over(tie) - 1) / 2)
    r = v.groupBy("equipment_id").agg(F.corr("rank", F.col("k").cast("double")).alias("r"), F.max("n").alias("n"))
    return r.select("equipment_id", "n", F.when(F.col("n") < 240, 0.0).otherwise(F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0))).alias("trend"))


def unit_reports(x: DataFrame, d: DataFrame) -> DataFrame:
    """(equipment_id, n, exposure, trend, slope, drift, health, maintenance, horizon_days) from scored() points and daily()."""
    u = exposure(x).join(spearman_trend(x), "equipment_id").join(trend(d), "equipment_id")
    u = u.withColumn("health", S.health(F.col("exposure"), F.col("trend"), F.col("n")))
    return u.withColumns({"maintenance": S.maintenance(F.col("health"), F.col("slope"), F.col("drift")), "horizon_days": S.horizon_days(F.col("slope"))})


def fleet_kpis(units: DataFrame, energy: DataFrame) -> DataFrame:
    """One row: sum of rounded totals of all units, mean health of those that have one (0 for none), units below 60."""
    u = energy.join(units.select("equipment_id", "health"), "equipment_id", "left")
    return u.agg(F.sum("total").alias("total"), S.half_up(F.coalesce(F.avg("health"), F.lit(0.0))).alias("health"), F.count_if(F.col("health") < 60).alias("at_risk"))


def ordered(rows: DataFrame, order: list[Column], settle) -> DataFrame:
    """rows with `place`, their number from 1 on in an order over all of them, without gathering them in one task: dealt out
    by range, numbered within each part, moved on by the sizes of the parts before. settle(df, name) writes a table and
    reads it, so that both steps see the same parts."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = settle(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ordered")
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row a part
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = parts.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    return within.join(F.broadcast(before), "part").withColumn("place", F.col("k") + F.col("before")).drop("part", "k", "before")


# --- explanation --------------------------------------------------------------------------------------------------


def numbered_as(t: DataFrame, x: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """t, of so many rows, with the row numbers rn of x, which has the same keys. They meet by shuffle, never by broadcast: a share of a
    file's size does not tell how many rows a few columns hold."""
    dealt = t.repartition(*slabs.tasks(t.sparkSession, rows), *keys)
    return dealt.join(x.select(*keys, "rn").hint("merge"), keys)


def around(x: DataFrame, eps: DataFrame, back: int = 48, rows: int = 0) -> DataFrame:
    """(id, rows): the rows of x at each episode's peak (back 0) and up to `back` before it, latest first.

    Found by an equi-join on (unit, row number), so nothing is held for the rows that are no neighbours of a peak. The wanted rows
    are back + 1 for each episode, which the size of eps does not tell, so they are never broadcast: both sides are shuffled.
    rows: those of x, where the usual number of tasks may be too few for them.
    """
    wanted = eps.select("id", "equipment_id", "peak_rn", F.explode(F.sequence(F.lit(0), F.lit(back))).alias("back"))
    wanted = wanted.select("id", "equipment_id", (F.col("peak_rn") - F.col("back")).alias("rn"), "back")
    cols = measures(x)
    if rows:
        x = x.repartition(*slabs.tasks(x.sparkSession, rows), "equipment_id", "rn")
    near = x.select("equipment_id", "rn", *cols).join(wanted.hint("merge"), ["equipment_id", "rn"])
    return near.groupBy("id", "equipment_id").agg(F.array_sort(F.collect_list(F.struct("back", *cols))).alias("rows"))


def middle(a: Column) -> Column:
    """Median of an array without nulls."""
    s, n = F.array_sort(a), F.size(a)
    return (F.try_element_at(s, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(s, F.floor(n / 2).cast("int") + 1)) / 2


def deviations(near: DataFrame, stats: DataFrame, cols: list[str], trail: int = 24) -> DataFrame:
    """(id, equipment_id, column, nth, z, value, base, direction, weight, n_frozen, stuck): every measure at each peak.

    z: against the median and scaled MAD of the `trail` rows before (the unit's own scale where that is 0), 2 decimals;
    nth: place by |z|, ties in contract order; weight: |z| over the largest; n_frozen: rows up to the peak that hold its
    value; measures that are missing at the peak are left out. stats: unit_stats() of the imputed series.
    """
    now = F.element_at("rows", 1)
    prior = lambda c: F.filter(F.transform(F.filter("rows", lambda r: r["back"].between(1, trail)), lambda r: r[c]), lambda v: v.isNotNull())
    # the first row that differs from the peak's value ends the frozen run
    differs = lambda c: F.filter("rows", lambda r: F.coalesce(F.abs(r[c] - now[c]) >= 1e-9, F.lit(True)))
    span = F.element_at("rows", -1)["back"] + 1
    cells = F.array(*(F.struct(F.lit(i).alias("order"), F.lit(c).alias("column"), now[c].alias("value"), prior(c).alias("prior"), F.coalesce(F.try_element_at(differs(c), F.lit(1))["back"], span).alias("n_frozen"), F.coalesce(F.nullif(F.col(f"s_{c}"), F.lit(0.0)), F.lit(1e-9)).alias("own")) for i, c in enumerate(cols)))
    long = near.join(stats, "equipment_id").select("id", "equipment_id", F.explode(cells).alias("c")).select("id", "equipment_id", "c.*").filter(F.col("value").isNotNull())
    long = long.withColumn("base", middle(F.col("prior"))).filter("base is not null")
    long = long.withColumn("mad", 1.4826 * middle(F.transform("prior", lambda v: F.abs(v - F.col("base")))))
    exact = (F.col("value") - F.col("base")) / F.when(F.col("mad") > 1e-9, F.col("mad")).otherwise(F.col("own"))
    long = long.withColumn("exact", exact).withColumns({"z": S.half_up(F.col("exact"), 2), "stuck": (F.col("n_frozen") >= 12) & (F.col("own") > 1e-9)})
    w = Window.partitionBy("id")
    long = long.withColumns({"nth": F.row_number().over(w.orderBy(F.desc(F.abs("z")), "order")), "weight": S.half_up(F.abs("z") / F.greatest(F.lit(1e-9), F.max(F.abs("z")).over(w)), 2)})
    return long.select("id", "equipment_id", "column", "nth", "z", S.half_up(F.col("value"), 2).alias("value"), S.half_up(F.col("base"), 2).alias("base"), F.when(F.col("exact") > 0, "high").otherwise("low").alias("direction"), "weight", "n_frozen", "stuck")


def frozen(t: DataFrame, column: str, back: int = 48) -> DataFrame:
    """How many rows up to each hold its value without a break, itself included, back + 1 at most; 12 or more is a stuck sensor."""
    rows = slabs.framed(placed(t), 1, lambda w: {"_moved": F.coalesce(F.abs(F.col(column) - F.lag(column).over(w)) >= 1e-9, F.lit(True))})
    start = F.when(F.col("_moved"), F.col("rn"))
    runs = slabs.scan(slabs.by_number(rows), before={"_start": start}, order=("rn",))
    n = F.col("rn") - F.coalesce(start, F.col("_start")) + 1
    out = runs.withColumn("frozen", F.when(F.col(column).isNull(), 0).otherwise(F.least(n, F.lit(back + 1))))
    return out.withColumn("stuck", F.col("frozen") >= 12).drop("_start", "_moved", "slab")


# --- views --------------------------------------------------------------------------------------------------------


def downsample(t: DataFrame, column: str, buckets: int) -> DataFrame:
    """Mean, least and largest of row buckets of equal size, without those that hold no value; up to 2 x buckets rows pass through."""
    n = F.col("_n")
    size = F.when(n <= 2 * buckets, 1).otherwise(F.ceil(n / buckets))
    sizes = settle(t.groupBy("equipment_id").agg(F.count(F.lit(1)).alias("_n")), "sizes")
    b = placed(t).join(sizes, "equipment_id").withColumn("bucket", F.floor((F.col("rn") - 1) / size))
    out = b.groupBy("equipment_id", "bucket").agg(F.min("ts_ms").alias("ts_ms"), F.avg(column).alias("mean"), F.min(column).alias("lo"), F.max(column).alias("hi"))
    return out.filter("mean is not null")


def smoothed(b: DataFrame, value: str = "mean", order: str = "bucket") -> DataFrame:
    """b with value' = (value' before + 2 value) / 3 along each unit's buckets (a few hundred, held as an array)."""
    rest = [c for c in b.columns if c != "equipment_id"]
    series_ = b.groupBy("equipment_id").agg(F.array_sort(F.collect_list(F.struct(order, *(c for c in rest if c != order)))).alias("a"))
    step = lambda acc, x: F.concat(acc, F.array(F.coalesce((F.element_at(acc, -1) + 2 * x[value]) / 3, x[value])))
    soft = F.when(F.size("a") > 0, F.aggregate(F.slice("a", 2, F.size("a")), F.array(F.element_at("a", 1)[value]), step))
    return series_.select("equipment_id", F.explode(F.arrays_zip("a", soft.alias("soft"))).alias("z")).select("equipment_id", "z.a.*", F.col("z.soft").alias("soft"))


def domain(b: DataFrame) -> DataFrame:
    """(equipment_id, lo, hi): the least and largest of buckets, 0 and 1 for none, with 8 % of the range added either way."""
    d = b.groupBy("equipment_id").agg(F.coalesce(F.min("lo"), F.lit(0.0)).alias("lo"), F.coalesce(F.max("hi"), F.lit(1.0)).alias("hi"))
    pad = 0.08 * F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.col("hi") - F.col("lo"))
    return d.select("equipment_id", (F.col("lo") - pad).alias("lo"), (F.col("hi") + pad).alias("hi"))


def degrade_view(d: DataFrame, width: int = 260) -> DataFrame:
    """Daily rows of seasonal() in at most `width` strides: smoothed mean, least and largest energy and mean seasonal level."""
    size = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(by_unit()) / width))
    b = d.withColumn("bucket", F.floor((F.row_number().over(by_unit().orderBy("day")) - 1) / size))
    out = b.groupBy("equipment_id", "bucket").agg(F.min("day").alias("day"), F.avg("energy").alias("mean"), F.min("energy").alias("lo"), F.max("energy").alias("hi"), F.avg("seasonal").alias("seasonal"))
    return smoothed(out.filter("mean is not null"))


def nearest(t: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked (equipment_id, at_ms) the row_ord nearest in time, the later one of equals: two as-of passes in one window."""
    rows = t.select("equipment_id", F.col("ts_ms").alias("at"), "row_ord", F.lit(0).alias("ask"))
    both = rows.unionByName(asked.select("equipment_id", F.col("at_ms").alias("at"), F.lit(None).cast("long").alias("row_ord"), F.lit(1).alias("ask")))
    both = slabs.slabbed(both, at="at")
    have = F.when(F.col("ask") == 0, F.struct("at", "row_ord"))
    # rows at the asked time stand before it on the way up, and behind it on the way down
    both = slabs.scan(both, before={"p": have}, order=("at", "ask", "row_ord"))
    near = slabs.scan(both, after={"n": have}, order=("at", -F.col("ask"), "row_ord")).filter("ask = 1")
    later = F.col("p").isNull() | (F.col("n.at") - F.col("at") <= F.col("at") - F.col("p.at"))
    return near.select("equipment_id", F.col("at").alias("at_ms"), F.when(F.col("n").isNotNull() & later, F.col("n.row_ord")).otherwise(F.col("p.row_ord")).alias("row_ord"))


def _days(lo: Column, hi: Column) -> Column:
    return F.explode(F.sequence(F.floor(lo / S.DAY_MS), F.floor(hi / S.DAY_MS)))


def overlapping(eps: DataFrame, windows: DataFrame) -> DataFrame:
    """(equipment_id, name, id) of episodes that overlap windows(equipment_id, name, from_ms, to_ms); both meet by unit and day."""
    a = eps.select("equipment_id", "id", "start_ms", "end_ms", _days(F.col("start_ms"), F.col("end_ms")).alias("day"))
    b = windows.withColumn("day", _days(F.col("from_ms"), F.col("to_ms")))
    return a.join(b, ["equipment_id", "day"]).filter("start_ms < to_ms and end_ms > from_ms").select("equipment_id", "name", "id").distinct()


def nearby(eps: DataFrame, windows: DataFrame, days: int = 3) -> DataFrame:
    """(equipment_id, name, id) of episodes that start or end within `days` of windows; they meet by unit and day."""
    edges = eps.select("equipment_id", "id", F.explode(F.array("start_ms", "end_ms")).alias("at")).withColumn("day", F.floor(F.col("at") / S.DAY_MS))
    wide = windows.select("equipment_id", "name", (F.col("from_ms") - days * S.DAY_MS).alias("lo"), (F.col("to_ms") + days * S.DAY_MS).alias("hi"))
    wide = wide.withColumn("day", _days(F.col("lo"), F.col("hi")))
    return edges.join(wide, ["equipment_id", "day"]).filter("at between lo and hi").select("equipment_id", "name", "id").distinct()


def containing(asked: DataFrame, eps: DataFrame) -> DataFrame:
    """(equipment_id, at_ms, id): for each asked time the first episode that holds it, ends included."""
    a = asked.select("equipment_id", "at_ms", F.floor(F.col("at_ms") / S.DAY_MS).alias("day"))
    b = eps.select("equipment_id", "id", "start_ms", "end_ms", _days(F.col("start_ms"), F.col("end_ms")).alias("day"))
    return a.join(b, ["equipment_id", "day"]).filter("at_ms between start_ms and end_ms").groupBy("equipment_id", "at_ms").agg(F.min_by("id", "start_ms").alias("id"))


def window_means(t: DataFrame, windows: DataFrame, column: str = TARGET) -> DataFrame:
    """(equipment_id, name, inside, n, before): mean of a column within each window, rows there, and its mean on the day that
    begins three days before it."""
    j = t.join(settle(windows, "windows"), "equipment_id")
    inside = (F.col("ts_ms") >= F.col("from_ms")) & (F.col("ts_ms") < F.col("to_ms"))
    start = F.col("from_ms") - 3 * S.DAY_MS
    base = (F.col("ts_ms") >= start) & (F.col("ts_ms") < start + S.DAY_MS)
    return j.filter(inside | base).groupBy("equipment_id", "name").agg(F.avg(F.when(inside, F.col(column))).alias("inside"), F.count_if(inside).alias("n"), F.avg(F.when(base, F.col(column))).alias("before"))
