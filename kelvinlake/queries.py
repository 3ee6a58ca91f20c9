"""Queries over the driver's events table as telemetry, with SQL of the same results."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvinlake.functions import scalar as S
from kelvinlake.functions import text
from kelvinlake.operators import explain, series
from kelvinlake.plans import catalog, pipeline
from kelvinlake.sources.contract import MEASURES, NAME_OF, TELEMETRY_SQL, UNITS, clean, observed, safe_double, telemetry, timestamp_parts, units_dimension
from kelvinlake.sources.demo import MISSING, demo, fault_windows
from kelvinlake.streaming import ordered, stream
from kelvinlake.tables import shared_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(spark, sf_dir)
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(c: Column | str, digits: int = 6) -> Column:
    return S.half_up(F.col(c) if isinstance(c, str) else c, digits)


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.prepared(telemetry(spark, sf_dir))[0]


def raws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw scores of the linear model with the scales of the measures, as a table: thresholds, runs and points read it."""
    r = series.raw_scores(series.linear_residual(prepared(spark, sf_dir)))
    return pipeline.settle(r.select("equipment_id", "row_ord", "ts_ms", "hour", *MEASURES, *(f"s_{c}" for c in MEASURES), "rn", "resid_z", "raw"), "raw")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = raws(spark, sf_dir)
    return series.scored(r, series.islands(r, series.thresholds(r)))


def deviated(t: DataFrame, x: DataFrame, eps: DataFrame) -> DataFrame:
    """Deviations of the measures of t at the peaks of the episodes of the points x."""
    n = t.count()
    raw = series.numbered_as(t.select("equipment_id", "row_ord", *MEASURES), x, ["equipment_id", "row_ord"], n)
    stats = pipeline.settle(x.groupBy("equipment_id").agg(*(F.first(f"s_{c}").alias(f"s_{c}") for c in MEASURES)), "stats")
    return pipeline.settle(series.deviations(series.around(raw, eps, rows=n), stats, list(MEASURES)), "deviations")


def explained(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, episodes, deviations at their peaks)."""
    x = pipeline.settle(points(spark, sf_dir), "points")
    eps = pipeline.settle(series.episodes(x), "episodes")
    return x, eps, deviated(telemetry(spark, sf_dir), x, eps)


def tagged_of(t: DataFrame, x: DataFrame, eps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(episodes with tags, deviations)."""
    dev = deviated(t, x, eps)
    return explain.tag_episodes(eps, dev, pipeline.settle(series.spearman_trend(x), "trends")), dev


def tagged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    x = pipeline.settle(points(spark, sf_dir), "points")
    return tagged_of(telemetry(spark, sf_dir), x, pipeline.settle(series.episodes(x), "episodes"))


# --- SQL pieces ---------------------------------------------------------------------------------------------------

W = "PARTITION BY equipment_id ORDER BY ts_ms, row_ord"
R6 = "floor(({}) * 1e6 + 0.5) / 1e6".format
R2 = "floor(({}) * 100 + 0.5) / 100".format
T = f"WITH {TELEMETRY_SQL}"
NOMINAL = f"""g AS (SELECT equipment_id, ts_ms - lag(ts_ms) OVER ({W}) AS gap FROM t),
nom AS (SELECT greatest(1, floor(list_sort(list(gap))[count(*) // 2 + 1] / 60000 + 0.5)) AS nominal FROM g WHERE gap IS NOT NULL AND equipment_id = (SELECT min(equipment_id) FROM t))"""


def _near(c: str) -> str:
    have = f"CASE WHEN {c} IS NOT NULL THEN struct_pack(v := {c}, at := ts_ms) END"
    return f"last_value({have} IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p_{c}, first_value({have} IGNORE NULLS) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n_{c}"


def _filled(c: str) -> str:
    return f"coalesce({c}, CASE WHEN n_{c}.at - p_{c}.at <= 4 * nominal * 60000 THEN p_{c}.v + (n_{c}.v - p_{c}.v) * ((ts_ms - p_{c}.at) / (n_{c}.at - p_{c}.at)) END, p_{c}.v, n_{c}.v) AS {c}"


#: Imputed series of the units with enough rows.
IMP = f"""{NOMINAL}, big AS (SELECT * FROM t WHERE equipment_id IN (SELECT equipment_id FROM t GROUP BY 1 HAVING count(*) >= {S.MIN_DATA})),
near AS (SELECT big.*, nominal, {", ".join(map(_near, MEASURES))} FROM big, nom),
imp AS (SELECT equipment_id, row_ord, ts_ms, hour, {", ".join(map(_filled, MEASURES))} FROM near)"""


def _stats(source: str) -> str:
    return f"""med AS (SELECT equipment_id, {", ".join(f"median({c}) AS m_{c}" for c in MEASURES)} FROM {source} GROUP BY ALL),
stats AS (SELECT equipment_id, {", ".join(f"any_value(m_{c}) AS m_{c}, 1.4826 * median(abs({c} - m_{c})) AS s_{c}" for c in MEASURES)} FROM {source} JOIN med USING (equipment_id) GROUP BY ALL)"""


Z = f"""{IMP}, {_stats("imp")}, z AS (SELECT imp.*, stats.* EXCLUDE (equipment_id), {", ".join(f"CASE WHEN s_{c} > 1e-9 AND {c} IS NOT NULL THEN least(greatest(({c} - m_{c}) / s_{c}, -6.0), 6.0) END AS z_{c}" for c in MEASURES)} FROM imp JOIN stats USING (equipment_id) WHERE s_energy > 1e-9)"""
RES = f"""{Z}, zz AS (SELECT *, row_number() OVER ({W}) AS rn FROM z),
fit AS (SELECT equipment_id, regr_slope(z_energy, z_load) AS a, regr_intercept(z_energy, z_load) AS b FROM zz GROUP BY ALL),
y0 AS (SELECT zz.*, coalesce(a * z_load + b, 0) AS pred, z_energy - coalesce(a * z_load + b, 0) AS r0, least(23, floor(hour)) AS hb FROM zz JOIN fit USING (equipment_id)),
y1 AS (SELECT *, coalesce(median(r0) FILTER (rn > 96) OVER (PARTITION BY equipment_id, hb), 0) AS hm,
  min(pred) FILTER (rn > 96) OVER (PARTITION BY equipment_id) AS lo, max(pred) FILTER (rn > 96) OVER (PARTITION BY equipment_id) AS hi FROM y0),
y2 AS (SELECT *, least(greatest(floor((pred - lo) / (CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END) * 8), 0), 7) AS bin, CASE WHEN rn > 96 THEN r0 - hm ELSE r0 END AS r1 FROM y1),
y3 AS (SELECT *, coalesce(median(r1) FILTER (rn > 96) OVER (PARTITION BY equipment_id, bin), 0) AS bm FROM y2),
y4 AS (SELECT *, CASE WHEN rn > 96 THEN r1 - bm ELSE r1 END AS r2 FROM y3),
sc AS (SELECT equipment_id, 1.4826 * list_sort(list(abs(r2)))[count(*) // 2 + 1] AS sc FROM y4 WHERE rn > 96 GROUP BY ALL),
res AS (SELECT y4.*, r2 / (CASE WHEN coalesce(sc, 0) = 0 THEN 1.0 ELSE sc END) AS resid_z FROM y4 LEFT JOIN sc USING (equipment_id))"""
RAW = f"{RES}, raws AS (SELECT *, least(greatest(0.75 * (1 - exp(-0.5 * pow(coalesce(resid_z, 0) / 1.8, 2))), 0.0), 1.0) AS raw FROM res)"
THR = f"""{RAW}, act AS (SELECT *, row_number() OVER ({W}) - 1 AS k, count(*) OVER (PARTITION BY equipment_id) AS n FROM raws WHERE rn > 96 AND raw > 1e-9),
thr AS (SELECT u.equipment_id, coalesce(greatest(0.35, q.t), 0.6) AS threshold, coalesce(q.g, 0.9) AS rescue FROM (SELECT DISTINCT equipment_id FROM raws) u
  LEFT JOIN (SELECT equipment_id, quantile_cont(raw, 0.975) AS t, quantile_cont(raw, 0.99) AS g FROM act GROUP BY ALL) q USING (equipment_id))"""
RUNS = f"""{THR}, cand AS (SELECT raws.*, rescue, rn - lag(rn) OVER ({W}) AS step FROM raws JOIN thr USING (equipment_id) WHERE rn > 96 AND raw > threshold),
isl AS (SELECT *, sum(CASE WHEN step > 13 THEN 1 ELSE 0 END) OVER ({W}) AS island FROM cand),
runs AS (SELECT equipment_id, min(rn) AS s, max(rn) AS e FROM isl GROUP BY equipment_id, island HAVING max(rn) - min(rn) >= 1 OR arg_min(raw, rn) > any_value(rescue))"""
SCORED = f"""{RUNS}, pts AS (SELECT raws.*, runs.s, runs.e,
  CASE WHEN rn <= 96 THEN 0.0 WHEN runs.s IS NOT NULL THEN least(greatest(raw + 0.03 * least(1.0, (runs.e - runs.s + 1) / 10.0), 0.0), 1.0) ELSE raw END AS score
  FROM raws LEFT JOIN runs ON raws.equipment_id = runs.equipment_id AND rn BETWEEN runs.s AND runs.e)"""
EPS = f"""{SCORED}, ep0 AS (SELECT equipment_id, s, e, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, max(score) AS peak FROM pts WHERE s IS NOT NULL GROUP BY ALL),
fl AS (SELECT equipment_id, greatest(0.8, quantile_cont(peak, 0.9)) AS hi, greatest(0.7, quantile_cont(peak, 0.6)) AS mid FROM ep0 GROUP BY ALL),
eps AS (SELECT ep0.* REPLACE (floor(peak * 1000 + 0.5) / 1000 AS peak), CASE WHEN peak >= hi THEN 'action' WHEN peak >= mid THEN 'alert' ELSE 'watch' END AS severity, equipment_id || '-' || start_ms AS id,
  floor((end_ms - start_ms) / 3600000 * 10 + 0.5) / 10 AS hours FROM ep0 JOIN fl USING (equipment_id))"""
DAILY = f"{SCORED}, daily AS (SELECT equipment_id, ts_ms // 86400000 AS day, avg(energy) AS energy, avg(resid_z) AS resid_z FROM pts GROUP BY ALL)"
TREND = f"""{DAILY}, back AS (SELECT *, row_number() OVER (PARTITION BY equipment_id ORDER BY day DESC) AS b FROM daily),
trend AS (SELECT equipment_id, coalesce(CASE WHEN count(*) < 14 THEN 0.0 ELSE regr_slope(resid_z, 90 - b) END, 0.0) AS slope, coalesce(avg(resid_z) FILTER (b <= 30), 0.0) AS drift FROM back WHERE b <= 90 GROUP BY ALL)"""
SPEAR = f"""sp0 AS (SELECT *, count(*) OVER (PARTITION BY equipment_id) AS n FROM pts),
sp1 AS (SELECT equipment_id, n, resid_z, rn - (n - least(n, 4320)) - 1 AS k FROM sp0 WHERE rn > n - least(n, 4320)),
sp2 AS (SELECT *, rank() OVER (PARTITION BY equipment_id ORDER BY resid_z) + (count(*) OVER (PARTITION BY equipment_id, resid_z) - 1) / 2.0 AS rk FROM sp1 WHERE k % 4 = 0),
spear AS (SELECT equipment_id, max(n) AS n, CASE WHEN max(n) < 240 THEN 0.0 ELSE coalesce(corr(rk, k::DOUBLE), 0.0) END AS trend FROM sp2 GROUP BY ALL)"""
EXPO = """expo AS (SELECT equipment_id, avg(CASE WHEN score >= 0.7 THEN 1 ELSE 0 END) AS exposure FROM (SELECT *, max(ts_ms) OVER (PARTITION BY equipment_id) AS last FROM pts) WHERE ts_ms >= last - 30 * 86400000::BIGINT GROUP BY ALL)"""
UNITS_SQL = f"""{TREND}, {SPEAR}, {EXPO}, hl AS (SELECT *, CASE WHEN n < 96 THEN 100 ELSE CAST(least(greatest(floor(100 - (55 * exposure + 30 * greatest(trend, 0.0)) + 0.5), 5), 100) AS INT) END AS health FROM expo JOIN spear USING (equipment_id) JOIN trend USING (equipment_id)),
units AS (SELECT *, CASE WHEN health < 70 OR drift > 1.2 OR slope > 0.015 THEN 'due' WHEN drift > 0.7 OR slope > 0.008 THEN 'recommended' WHEN slope > 0.003 OR drift > 0.3 THEN 'plan' ELSE 'ok' END AS maintenance,
  CAST(CASE WHEN slope > 0 THEN least(greatest(floor(1.5 / slope), 7), 365) ELSE 365 END AS INT) AS horizon_days FROM hl)"""
RANK = "CASE severity WHEN 'action' THEN 3 WHEN 'alert' THEN 2 WHEN 'watch' THEN 1 ELSE 0 END"

#: Peaks, what the measures were before them, and how they deviate.
DEV = f"""{EPS}, rawn AS (SELECT t.*, rn FROM t JOIN raws USING (equipment_id, row_ord)),
peaks AS (SELECT eps.id, eps.equipment_id, eps.e - eps.s + 1 AS len, pts.rn AS prn, pts.hour AS phour, pts.resid_z AS prz FROM eps JOIN (SELECT * FROM pts WHERE s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY equipment_id, s ORDER BY score DESC, rn) = 1) pts USING (equipment_id, s)),
lng AS ({" UNION ALL ".join(f"SELECT equipment_id, rn, {i} AS ord, '{c}' AS col, {c} AS x FROM rawn" for i, c in enumerate(MEASURES))}),
own AS ({" UNION ALL ".join(f"SELECT equipment_id, '{c}' AS col, CASE WHEN coalesce(s_{c}, 0) = 0 THEN 1e-9 ELSE s_{c} END AS own FROM stats" for c in MEASURES)}),
cur AS (SELECT p.*, ord, col, x AS v FROM peaks p JOIN lng l ON p.equipment_id = l.equipment_id AND p.prn = l.rn WHERE x IS NOT NULL),
base AS (SELECT id, col, median(x) AS base FROM cur JOIN lng USING (equipment_id, col) WHERE rn BETWEEN prn - 24 AND prn - 1 AND x IS NOT NULL GROUP BY ALL),
mads AS (SELECT id, col, 1.4826 * median(abs(x - base)) AS mad FROM cur JOIN base USING (id, col) JOIN lng USING (equipment_id, col) WHERE rn BETWEEN prn - 24 AND prn - 1 AND x IS NOT NULL GROUP BY ALL),
froz AS (SELECT id, col, prn - coalesce(max(rn) FILTER (x IS NULL OR abs(x - v) >= 1e-9), greatest(prn - 49, 0)) AS n_frozen FROM cur JOIN lng USING (equipment_id, col) WHERE rn BETWEEN prn - 48 AND prn GROUP BY id, col, prn),
dev0 AS (SELECT cur.*, base, (v - base) / CASE WHEN mad > 1e-9 THEN mad ELSE own END AS exact, n_frozen, n_frozen >= 12 AND own > 1e-9 AS stuck FROM cur JOIN base USING (id, col) JOIN mads USING (id, col) JOIN froz USING (id, col) JOIN own USING (equipment_id, col)),
dev AS (SELECT *, {R2("exact")} AS z, row_number() OVER (PARTITION BY id ORDER BY abs({R2("exact")}) DESC, ord) AS nth, CASE WHEN exact > 0 THEN 'high' ELSE 'low' END AS direction FROM dev0),
devw AS (SELECT *, {R2("abs(z) / greatest(1e-9, max(abs(z)) OVER (PARTITION BY id))")} AS weight FROM dev)"""
_PICK = ", ".join(f"max(z) FILTER (col = '{c}' AND nth <= 4) AS {a}" for c, a in (("energy", "en"), ("load", "ld"), ("flow", "cwr"), ("cooling", "cwt")))
#: A row for each tag of each episode, in order.
TAGS = f"""{DEV}, {SPEAR}, ctx AS (SELECT p.id, p.len, p.prn, p.phour, p.prz, sp.n, sp.trend, {_PICK}, bool_or(stuck) AS stuck FROM peaks p LEFT JOIN dev USING (id) JOIN spear sp ON sp.equipment_id = p.equipment_id GROUP BY ALL),
tags AS (SELECT id, unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]) AS place_of, unnest(['sensor_stuck', 'high_consumption_low_load', 'cooling_water_drift', 'flow_imbalance', 'transient_spike', 'offhours_standby', 'degradation_trend', 'concurrent_context_shift', 'contextual_energy_spike']) AS tag,
  unnest([stuck, en > 2.2 AND abs(ld) < 1.2, cwt > 1.8 AND prz > 1.8 AND len >= 8, abs(cwr) > 1.8 AND (ld IS NULL OR abs(ld) < 1.5), len <= 2 AND en > 3.5, (phour >= 22 OR phour < 6) AND en > 1.6 AND (ld IS NULL OR ld < 0.4),
  trend > 0.35 AND prn - 1 > 0.4 * n, prz > 2 AND (abs(ld) > 2 OR abs(cwr) > 2 OR abs(cwt) > 2), en > 2.2 AND NOT coalesce(en > 2.2 AND abs(ld) < 1.2, false)]) AS holds FROM ctx)"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_ADVICE = ", ".join(f"({i}, {_quoted(t)}, {_quoted(p)}, {_quoted(a)})" for i, (t, p, a, _) in enumerate(explain.ADVICE))
RECS = f"""{TAGS}, advice(place, tag, priority, action) AS (VALUES {_ADVICE}),
recs AS (SELECT id, place_of, place, priority, action FROM tags JOIN advice USING (tag) WHERE holds
  UNION ALL SELECT id, 1000, 0, {_quoted(explain.ESCALATE[0])}, {_quoted(explain.ESCALATE[1])} FROM eps WHERE severity = 'action'
  UNION ALL SELECT id, 0, 0, {_quoted(explain.FALLBACK[0])}, {_quoted(explain.FALLBACK[1])} FROM eps WHERE severity <> 'action' AND id NOT IN (SELECT id FROM tags WHERE holds)),
once AS (SELECT * FROM recs QUALIFY row_number() OVER (PARTITION BY id, action ORDER BY place_of, place) = 1)"""

# --- ingest and quality -------------------------------------------------------------------------------------------


@query("ts_parse_fields", "SELECT event_id, epoch_us(date_trunc('second', ts)) // 1000 AS ts_ms, floor((hour(ts) + minute(ts) / 60 + (event_id % 1000) / 3600000) * 1e9 + 0.5) / 1e9 AS hour, CAST(dayofweek(ts) AS INT) AS dow FROM events")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    p = timestamp_parts(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"), F.lit("Z")))
    return e.select("event_id", p["ts_ms"].alias("ts_ms"), r6(p["hour"], 9).alias("hour"), p["dow"].alias("dow"))


@query("safe_double", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 5 <> 0 THEN CAST(user_id AS VARCHAR) END AS DOUBLE) AS x FROM events")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    cell = F.when(F.col("event_id") % 10 == 0, "Infinity").when(F.col("event_id") % 5 == 0, "1.0d").otherwise(F.col("user_id").cast("string"))
    return e.select("event_id", safe_double(cell).alias("x"))


def raw_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as the strings of a contract CSV: some without a valid timestamp, some without a unit, some twice."""
    t = telemetry(spark, sf_dir)
    at = F.date_format(F.timestamp_millis("ts_ms").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")
    cells = t.select("row_ord", F.when(F.col("row_ord") % 13 == 0, "n/a").otherwise(at).alias("timestamp"), F.when(F.col("row_ord") % 31 == 0, " ").otherwise(F.concat(F.lit(" "), "equipment_id")).alias("equipment_id"), *(F.col(m).cast("string").alias(n) for m, n in NAME_OF.items()))
    return cells.unionByName(cells.filter("row_ord % 7 = 0").withColumn("row_ord", F.col("row_ord") + 1_000_000_000))


CELLS = f"{T}, c0 AS (SELECT *, ts_ms // 1000 * 1000 AS ms FROM t), c AS (SELECT * FROM c0 UNION ALL SELECT * REPLACE (row_ord + 1000000000 AS row_ord) FROM c0 WHERE row_ord % 7 = 0), ok AS (SELECT *, (row_ord % 1000000000) % 13 <> 0 AND (row_ord % 1000000000) % 31 <> 0 AS good FROM c)"


@query("ingest_clean", f"{CELLS} SELECT equipment_id, row_ord, ms AS ts_ms, dow, flow, load, energy, wind FROM ok WHERE good QUALIFY row_number() OVER (PARTITION BY equipment_id, ms ORDER BY row_ord) = 1")
def _(spark, d):
    return clean(raw_cells(spark, d))[0].select("equipment_id", "row_ord", "ts_ms", "dow", "flow", "load", "energy", "wind")


@query("ingest_bad_rows", f"{CELLS}, k AS (SELECT DISTINCT equipment_id, ms FROM ok WHERE good) SELECT count(*) FILTER (NOT good) AS bad_rows, (SELECT count(*) FROM k) AS rows, count(*) FILTER (good) - (SELECT count(*) FROM k) AS duplicates FROM ok")
def _(spark, d):
    return clean(raw_cells(spark, d))[1]


@query("ingest_dedupe_first", f"{T}, u AS (SELECT * FROM t UNION ALL SELECT * REPLACE (row_ord + 1000000000 AS row_ord, load + 1 AS load) FROM t WHERE load > 50) SELECT equipment_id, ts_ms, row_ord, load FROM u QUALIFY row_number() OVER (PARTITION BY equipment_id, ts_ms ORDER BY row_ord) = 1")
def _(spark, d):
    t = telemetry(spark, d)
    u = t.unionByName(t.filter("load > 50").withColumns({"row_ord": F.col("row_ord") + 1_000_000_000, "load": F.col("load") + 1}))
    nth = F.row_number().over(series.Window.partitionBy("equipment_id", "ts_ms").orderBy("row_ord"))
    return u.withColumn("nth", nth).filter("nth = 1").select("equipment_id", "ts_ms", "row_ord", "load")


@query("observed_cells", f"{T} SELECT equipment_id, {', '.join(f'count(*) FILTER ({m} IS NOT NULL) AS {m}' for m in MEASURES)} FROM t GROUP BY ALL")
def _(spark, d):
    return observed(telemetry(spark, d)).groupBy("equipment_id").agg(*(F.count_if(f"o_{m}").alias(m) for m in MEASURES))


@query("quality_missing", f"{T}, n AS ({' UNION ALL '.join(f'''SELECT '{m}' AS "column", count(*) FILTER ({m} IS NULL) AS n, count(*) AS rows FROM t''' for m in MEASURES)}) SELECT \"column\", n, n = rows AS absent, floor(100.0::DOUBLE * n / rows * 1000 + 0.5) / 1000 AS percent FROM n WHERE n > 0")
def _(spark, d):
    t = telemetry(spark, d)
    rows = t.agg(F.count(F.lit(1)).alias("rows"))
    return series.missing_counts(t).join(F.broadcast(rows), F.lit(True)).select("column", "n", "absent", text.missing_share(F.col("n"), F.col("rows")).alias("percent"))


@query("quality_period", f"{T} SELECT count(*) AS row_count, count(DISTINCT equipment_id) AS equipment_count, min(ts_ms) AS period_start, max(ts_ms) AS period_end FROM t")
def _(spark, d):
    t = telemetry(spark, d)
    return series.quality(t, clean(raw_cells(spark, d))[1]).select("row_count", "equipment_count", "period_start", "period_end")


GAPS = f"{T}, g AS (SELECT ts_ms - lag(ts_ms) OVER ({W}) AS gap FROM t), m AS (SELECT list_sort(list(gap))[count(*) // 2 + 1] AS median_ms FROM g WHERE gap IS NOT NULL)"


@query("quality_gaps", f"{GAPS} SELECT median_ms, count(*) FILTER (gap > greatest(1.5 * median_ms, 3600000)) AS gaps, coalesce(floor(max(gap) FILTER (gap > greatest(1.5 * median_ms, 3600000)) / 3600000 * 10 + 0.5) / 10, 0.0) AS longest_h FROM g, m GROUP BY median_ms")
def _(spark, d):
    return series.gap_report(telemetry(spark, d))


@query("cadence_upper_median", f"{T}, g AS (SELECT equipment_id, ts_ms - lag(ts_ms) OVER ({W}) AS gap FROM t) SELECT equipment_id, list_sort(list(gap))[count(*) // 2 + 1] AS median_ms FROM g WHERE gap IS NOT NULL GROUP BY ALL")
def _(spark, d):
    return series.interval_median(telemetry(spark, d), ["equipment_id"])


@query("insufficient_units", f"{T}, d AS (SELECT equipment_id || '-' || (ts_ms // 86400000 % 31) AS equipment_id FROM t) SELECT equipment_id, count(*) AS n FROM d GROUP BY ALL HAVING n < 120")
def _(spark, d):
    """Each day of a unit as a unit of its own."""
    name = F.concat_ws("-", "equipment_id", F.expr("ts_ms div 86400000 % 31"))
    return pipeline.split_by_data(telemetry(spark, d).withColumn("equipment_id", name))[1].select("equipment_id", "n")


@query("impute_linear_ffill", f"{T}, {IMP} SELECT equipment_id, row_ord, {R6('energy')} AS energy, {R6('wind')} AS wind, dew FROM imp")
def _(spark, d):
    return series.impute(telemetry(spark, d)).select("equipment_id", "row_ord", r6("energy").alias("energy"), r6("wind").alias("wind"), "dew")


# --- statistics and features --------------------------------------------------------------------------------------


_STAT_ROWS = " UNION ALL ".join(f"SELECT equipment_id, '{c}' AS \"column\", {R6(f'm_{c}')} AS m, {R6(f's_{c}')} AS s, coalesce(s_{c} > 1e-9, false) AS usable FROM stats WHERE m_{c} IS NOT NULL" for c in MEASURES)


@query("robust_stats", f"{T}, {_stats('t')} {_STAT_ROWS}")
def _(spark, d):
    return series.robust_stats(telemetry(spark, d)).select("equipment_id", "column", r6("m").alias("m"), r6("s").alias("s"), "usable")


@query("usable_columns", f"{T}, {_stats('t')}, u AS ({_STAT_ROWS}) SELECT equipment_id, count(*) FILTER (usable) AS n FROM u GROUP BY ALL")
def _(spark, d):
    return series.robust_stats(telemetry(spark, d)).groupBy("equipment_id").agg(F.count_if("usable").alias("n"))


@query("robust_z", f"{T}, {Z} SELECT equipment_id, row_ord, {', '.join(f'{R6(f'z_{c}')} AS z_{c}' for c in MEASURES)} FROM z")
def _(spark, d):
    return prepared(spark, d).select("equipment_id", "row_ord", *(r6(f"z_{c}").alias(f"z_{c}") for c in MEASURES))


@query("cyclic_time", f"{T} SELECT row_ord, " + ", ".join(f"{R6(f'{f}({a} * 2 * pi())')} AS {n}_{f}" for n, a in (("hour", "(ts_ms % 86400000) / 3600000 / 24"), ("dow", "((ts_ms // 86400000 + 4) % 7) / 7"), ("doy", "(ts_ms % 31557600000) / 31557600000")) for f in ("sin", "cos")) + " FROM t")
def _(spark, d):
    return telemetry(spark, d).select("row_ord", *(r6(v).alias(k) for k, v in S.cyclic(F.col("ts_ms")).items()))


@query("lags", f"{T}, {Z} SELECT equipment_id, row_ord, {R6(f'coalesce(lag(z_energy, 1) OVER ({W}), 0)')} AS lag1, {R6(f'coalesce(lag(z_energy, 48) OVER ({W}), 0)')} AS lag48 FROM z")
def _(spark, d):
    return series.lags(prepared(spark, d)).select("equipment_id", "row_ord", r6("lag1").alias("lag1"), r6("lag48").alias("lag48"))


ROLL = f"OVER ({W} ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)"
ROLLED = f"""row_number() OVER ({W}) AS rn, avg(energy) {ROLL} AS m48, stddev_pop(energy) {ROLL} AS d48, avg(load) {ROLL} AS l48"""


R9 = "floor(({}) * 1e9 + 0.5) / 1e9".format  # means over 48 and 12 rows lie on no half of this


@query("rolling_48", f"{T}, {IMP}, ro AS (SELECT *, {ROLLED}, avg(energy) OVER ({W} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS before FROM imp) SELECT equipment_id, row_ord, {R9('CASE WHEN rn >= 48 THEN m48 ELSE energy END')} AS roll_mean, {R6('CASE WHEN rn >= 48 THEN d48 ELSE 0 END')} AS roll_std, {R9('CASE WHEN rn >= 48 THEN l48 ELSE load END')} AS roll_load, {R9('before')} AS before FROM ro")
def _(spark, d):
    out = series.trailing_mean(series.rolling(series.impute(telemetry(spark, d))), "energy", 12, "before")
    return out.select("equipment_id", "row_ord", r6("roll_std").alias("roll_std"), *(r6(c, 9).alias(c) for c in ("roll_mean", "roll_load", "before")))


_CLAMPED = "CASE WHEN {0} IS NOT NULL THEN least(greatest({0}, -6.0), 6.0) END".format


@query("model_inputs", f"{T}, {Z}, ro AS (SELECT *, {ROLLED}, coalesce(lag(z_energy, 48) OVER ({W}), 0) AS lag48 FROM z) SELECT equipment_id, rn, {R6(_CLAMPED('((CASE WHEN rn >= 48 THEN m48 ELSE energy END - m_energy) / s_energy)'))} AS roll_mean_z, {R6(_CLAMPED('(CASE WHEN rn >= 48 THEN d48 ELSE 0 END / s_energy)'))} AS roll_std_z, {R6(_CLAMPED('((CASE WHEN rn >= 48 THEN l48 ELSE load END - m_load) / s_load)'))} AS roll_load_z, {R6('lag48')} AS lag48, {R6('coalesce(z_cooling, 0)')} AS z_cooling, 18 AS n_if, 16 AS n_mlp FROM ro")
def _(spark, d):
    """The forest's inputs by their places; 18 and 16 inputs in all."""
    f = pipeline.model_features(prepared(spark, d))
    at = {n: i for i, n in enumerate(pipeline.feature_names(list(MEASURES))[0])}
    return f.select("equipment_id", F.col("rn").cast("long").alias("rn"), *(r6(F.col("if_x")[at[c]]).alias(c) for c in ("roll_mean_z", "roll_std_z", "roll_load_z", "lag48", "z_cooling")), F.size("if_x").alias("n_if"), F.size("mlp_x").alias("n_mlp"))


@query("feature_counts", f"{T}, {Z}, u AS (SELECT {' + '.join(f'any_value(coalesce(s_{c} > 1e-9, false)::INT)' for c in MEASURES)} AS n, any_value(coalesce(s_load > 1e-9, false)::INT) AS l FROM z GROUP BY equipment_id) SELECT CAST(max(n + 8 + l) AS INT) AS forest, CAST(max(n - 1 + 8) AS INT) AS network FROM u")
def _(spark, d):
    return pipeline.model_features(prepared(spark, d)).agg(F.max("width_if").alias("forest"), F.max("width_mlp").alias("network"))


@query("residual_linear", f"{T}, {RES} SELECT equipment_id, row_ord, CAST(hb AS INT) AS hour_bucket, CAST(bin AS INT) AS bin, {R6('hm')} AS hour_med, {R6('bm')} AS bin_med, {R6('resid_z')} AS resid_z FROM res")
def _(spark, d):
    return series.linear_residual(prepared(spark, d)).select("equipment_id", "row_ord", "hour_bucket", "bin", r6("hour_med").alias("hour_med"), r6("bin_med").alias("bin_med"), r6("resid_z").alias("resid_z"))


# --- scores and episodes ------------------------------------------------------------------------------------------


@query("fusion_score", f"{T}, {SCORED} SELECT equipment_id, row_ord, {R6('raw')} AS raw, {R6('score')} AS score, s IS NOT NULL AS flagged FROM pts")
def _(spark, d):
    return points(spark, d).select("equipment_id", "row_ord", r6("raw").alias("raw"), r6("score").alias("score"), F.col("s").isNotNull().alias("flagged"))


@query("score_threshold", f"{T}, {THR} SELECT equipment_id, {R6('threshold')} AS threshold, {R6('rescue')} AS rescue FROM thr")
def _(spark, d):
    return series.thresholds(raws(spark, d)).select("equipment_id", r6("threshold").alias("threshold"), r6("rescue").alias("rescue"))


@query("threshold_positional", f"{T}, {THR} SELECT equipment_id, {R6('greatest(0.35, sum(raw * greatest(0.0, 1 - abs(k - 0.975 * (n - 1)))))')} AS threshold, {R6('sum(raw * greatest(0.0, 1 - abs(k - 0.99 * (n - 1))))')} AS rescue FROM act GROUP BY equipment_id")
def _(spark, d):
    return series.thresholds(raws(spark, d), "positional").select("equipment_id", r6("threshold").alias("threshold"), r6("rescue").alias("rescue"))


@query("runs_islands", f"{T}, {RUNS} SELECT * FROM runs")
def _(spark, d):
    r = raws(spark, d)
    return series.islands(r, series.thresholds(r)).select("equipment_id", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"))


@query("episodes", f"{T}, {DEV} SELECT eps.id, eps.equipment_id, start_ms, end_ms, hours, severity, {R6('peak')} AS peak, prn AS peak_rn FROM eps JOIN peaks USING (id)")
def _(spark, d):
    return series.episodes(points(spark, d)).select("id", "equipment_id", "start_ms", "end_ms", "hours", "severity", r6("peak").alias("peak"), F.col("peak_rn").cast("long").alias("peak_rn"))


@query("episode_by_id", f"{T}, {EPS} SELECT id, severity, {R6('peak')} AS peak FROM eps WHERE id = (SELECT max(id) FROM eps)")
def _(spark, d):
    e = pipeline.settle(series.episodes(points(spark, d)), "episodes")
    wanted = e.agg(F.max("id")).first()[0]
    return e.filter(F.col("id") == wanted).select("id", "severity", r6("peak").alias("peak"))


@query("row_severity", f"{T}, {EPS} SELECT pts.equipment_id, coalesce(severity, 'normal') AS severity, count(*) AS n FROM pts LEFT JOIN eps USING (equipment_id, s) GROUP BY ALL")
def _(spark, d):
    x = pipeline.settle(points(spark, d), "points")
    return series.row_severity(x, series.episodes(x)).groupBy("equipment_id", "severity").agg(F.count(F.lit(1)).alias("n"))


ORDER = f"{RANK} DESC, peak DESC, equipment_id, start_ms"


def _fleet_order() -> list[Column]:
    return [F.desc(S.severity_rank(F.col("severity"))), F.desc("peak"), F.col("equipment_id"), F.col("start_ms")]


@query("fleet_episode_order", f"{T}, {EPS} SELECT id, row_number() OVER (ORDER BY {ORDER}) AS place FROM eps")
def _(spark, d):
    return series.ordered(series.episodes(points(spark, d)), _fleet_order(), pipeline.settle).select("id", F.col("place").cast("long").alias("place"))


@query("severity_counts", f"{T}, {EPS} SELECT severity, count(*) AS n FROM eps GROUP BY ALL")
def _(spark, d):
    return series.episodes(points(spark, d)).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query("severity_filter", f"{T}, {EPS} SELECT id, {R6('peak')} AS peak FROM eps WHERE severity = 'watch'")
def _(spark, d):
    return series.episodes(points(spark, d)).filter("severity = 'watch'").select("id", r6("peak").alias("peak"))


@query("priority_queue", f"{T}, {EPS} SELECT id, severity FROM eps ORDER BY severity = 'watch', {ORDER} LIMIT 7")
def _(spark, d):
    return series.episodes(points(spark, d)).orderBy(F.col("severity") == "watch", *_fleet_order()).limit(7).select("id", "severity")


@query("unit_top8", f"{T}, {EPS} SELECT equipment_id, id, row_number() OVER (PARTITION BY equipment_id ORDER BY start_ms) AS nth FROM eps QUALIFY nth <= 8")
def _(spark, d):
    nth = F.row_number().over(series.by_unit().orderBy("start_ms"))
    return series.episodes(points(spark, d)).withColumn("nth", nth).filter("nth <= 8").select("equipment_id", "id", F.col("nth").cast("long").alias("nth"))


@query("unit_first_episode", f"{T}, {EPS} SELECT equipment_id, arg_min(id, start_ms) AS first, arg_max(id, struct_pack(a := {RANK}, b := peak, c := -start_ms)) AS worst FROM eps GROUP BY ALL")
def _(spark, d):
    """The card of a unit: its first episode, and the one that is worst."""
    order = F.struct(S.severity_rank(F.col("severity")).alias("a"), F.col("peak").alias("b"), (-F.col("start_ms")).alias("c"))
    return series.episodes(points(spark, d)).groupBy("equipment_id").agg(F.min_by("id", "start_ms").alias("first"), F.max_by("id", order).alias("worst"))


# --- units and fleet ----------------------------------------------------------------------------------------------


@query("energy_stats", f"{T} SELECT equipment_id, floor(coalesce(sum(energy), 0) + 0.5) AS total, floor(coalesce(avg(energy), 0) * 10 + 0.5) / 10 AS mean FROM t GROUP BY ALL")
def _(spark, d):
    return series.energy_stats(telemetry(spark, d))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pipeline.settle(points(spark, sf_dir), "points")
    return series.unit_reports(p, series.daily(p))


@query("health_maintenance", f"{T}, {UNITS_SQL} SELECT equipment_id, {R6('exposure')} AS exposure, {R6('trend')} AS trend, {R6('slope')} AS slope, {R6('drift')} AS drift, health, maintenance, horizon_days FROM units")
def _(spark, d):
    return reports(spark, d).select("equipment_id", *(r6(c).alias(c) for c in ("exposure", "trend", "slope", "drift")), "health", "maintenance", "horizon_days")


@query("fleet_kpis", f"{T}, {UNITS_SQL}, en AS (SELECT equipment_id, floor(sum(energy) + 0.5) AS total FROM t GROUP BY ALL) SELECT sum(total) AS total, floor(avg(health) + 0.5) AS health, count(*) FILTER (health < 60) AS at_risk FROM en LEFT JOIN units USING (equipment_id)")
def _(spark, d):
    return series.fleet_kpis(reports(spark, d), series.energy_stats(telemetry(spark, d)))


@query("unit_labels", f"{T}, {UNITS_SQL} SELECT equipment_id, CASE WHEN maintenance = 'ok' THEN 'PM: on track' ELSE 'PM: ' || maintenance || ' · ~' || greatest(1, ceil(horizon_days / 7)::INT) || 'w' END AS label, CASE WHEN health >= 75 THEN 'ok' WHEN health >= 55 THEN 'warn' ELSE 'danger' END AS band FROM units")
def _(spark, d):
    return reports(spark, d).select("equipment_id", text.maintenance_label(F.col("maintenance"), F.col("horizon_days")).alias("label"), text.health_band(F.col("health")).alias("band"))


@query("episode_labels", f"{T}, {EPS} SELECT id, strftime(make_timestamp(start_ms * 1000), '%d %b %Y, %H:%M') AS at, strftime(make_timestamp(start_ms * 1000), '%b %y') AS axis, upper(severity[1]) || severity[2:] AS severity, CASE WHEN hours < 1 THEN floor(hours * 60 + 0.5)::INT || ' min' WHEN hours < 48 THEN regexp_replace(printf('%.1f', hours), '\\.0$', '') || ' h' ELSE regexp_replace(printf('%.1f', round(hours / 24, 1)), '\\.0$', '') || ' d' END AS duration FROM eps")
def _(spark, d):
    e = series.episodes(points(spark, d))
    return e.select("id", text.time_label(F.col("start_ms")).alias("at"), text.axis_label(F.col("start_ms")).alias("axis"), text.severity_label(F.col("severity")).alias("severity"), text.duration_label(F.col("hours")).alias("duration"))


@query("daily_rollup", f"{T}, {DAILY} SELECT equipment_id, day, {R6('energy')} AS energy, {R6('resid_z')} AS resid_z, {R6('quantile_cont(energy, 0.5) OVER (PARTITION BY equipment_id ORDER BY day ROWS BETWEEN 22 PRECEDING AND 22 FOLLOWING)')} AS seasonal FROM daily")
def _(spark, d):
    return series.seasonal(series.daily(points(spark, d))).select("equipment_id", "day", *(r6(c).alias(c) for c in ("energy", "resid_z", "seasonal")))


# --- explanation --------------------------------------------------------------------------------------------------


@query("contributors_top4", f"{T}, {DEV} SELECT id, nth, col AS \"column\", direction, z, {R2('v')} AS value, {R2('base')} AS base, weight FROM devw WHERE nth <= 4")
def _(spark, d):
    return explained(spark, d)[2].filter("nth <= 4").select("id", F.col("nth").cast("long").alias("nth"), "column", "direction", "z", "value", "base", "weight")


@query("evidence_top3", f"{T}, {DEV}, dim(col, unit) AS (VALUES {', '.join(f'({_quoted(m)}, {_quoted(UNITS[n])})' for m, n in NAME_OF.items())}) SELECT id, nth, col AS \"column\", {R2('v')} AS observed, {R2('base')} AS expected, unit, z FROM dev JOIN dim USING (col) WHERE nth <= 3")
def _(spark, d):
    return explain.evidence(explained(spark, d)[2]).withColumn("nth", F.col("nth").cast("long"))


@query("column_units", f"SELECT * FROM (VALUES {', '.join(f'({_quoted(m)}, {_quoted(n)}, {_quoted(UNITS[n])}, {_quoted(n.replace(' ', '_').lower())})' for m, n in NAME_OF.items())}) AS x(\"column\", name, unit, slug)")
def _(spark, d):
    return units_dimension(spark).withColumn("slug", text.slug(F.col("name")))


@query("sensor_stuck", f"{T}, m AS (SELECT *, coalesce(abs(cooling - lag(cooling) OVER ({W})) >= 1e-9, true)::INT AS moved FROM t), r AS (SELECT *, sum(moved) OVER ({W}) AS run FROM m) SELECT equipment_id, row_ord, CAST(CASE WHEN cooling IS NULL THEN 0 ELSE least(49, row_number() OVER (PARTITION BY equipment_id, run ORDER BY ts_ms, row_ord)) END AS INT) AS frozen FROM r")
def _(spark, d):
    return series.frozen(telemetry(spark, d), "cooling").select("equipment_id", "row_ord", "frozen")


@query("pattern_tags", f"{T}, {TAGS} SELECT id, row_number() OVER (PARTITION BY id ORDER BY place_of) AS nth, tag FROM tags WHERE holds UNION ALL SELECT id, 1, 'unclassified' FROM eps WHERE id NOT IN (SELECT id FROM tags WHERE holds)")
def _(spark, d):
    eps = tagged(spark, d)[0]
    return eps.select("id", F.posexplode(explain.shown_tags(F.col("tags"))).alias("at", "tag")).select("id", (F.col("at") + 1).cast("long").alias("nth"), "tag")


@query("recommendations_top4", f"{T}, {RECS} SELECT id, row_number() OVER (PARTITION BY id ORDER BY place_of, place) AS nth, priority, action FROM once QUALIFY nth <= 4")
def _(spark, d):
    return explain.recommend(tagged(spark, d)[0]).select("id", F.col("nth").cast("long").alias("nth"), "priority", "action")


#: One decimal, halves away from zero (of two-decimal values quarters alone are halves), whole from 100 on.
_FIX = "CASE WHEN abs({0}) >= 100 THEN CAST(floor({0} + 0.5) AS BIGINT)::VARCHAR WHEN {0} * 4 = floor({0} * 4) AND {0} * 2 <> floor({0} * 2) THEN printf('%.1f', {0} + sign({0}) * 0.01) ELSE printf('%.1f', {0}) END".format
_AT = "strftime(make_timestamp(peak_ms * 1000), '%d %b %Y, %H:%M')"
NARRATIVES = f"""{TAGS}, cells AS (SELECT id, col, nth, direction, z, {R2('v')} AS value, {R2('base')} AS base FROM dev WHERE nth <= 4),
names(col, name) AS (VALUES {", ".join(f"({_quoted(m)}, {_quoted(n)})" for m, n in NAME_OF.items())}),
also AS (SELECT id, string_agg(said, ', ' ORDER BY nth) AS also FROM (SELECT id, nth, name || ' is ' || direction || ' by ' || {_FIX('abs(z)')} || ' σ' AS said FROM cells JOIN names USING (col) WHERE col <> 'energy' AND abs(z) >= 1.2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY nth) <= 2) GROUP BY id),
en AS (SELECT id, value AS ev, base AS eb, z AS ez FROM cells WHERE col = 'energy'),
spot AS (SELECT p.id, p.equipment_id, ts_ms AS peak_ms FROM peaks p JOIN pts ON pts.equipment_id = p.equipment_id AND pts.rn = p.prn),
has AS (SELECT id, bool_or(holds AND tag = 'degradation_trend') AS slow, bool_or(holds AND tag = 'transient_spike') AS brief, bool_or(holds AND tag = 'sensor_stuck') AS stuck FROM tags GROUP BY id)
SELECT spot.id, concat_ws(' ', coalesce(equipment_id || ' used ' || {_FIX('ev')} || ' kWh in one interval at ' || {_AT} || ', ' || CASE WHEN ez > 0 THEN 'more' ELSE 'less' END || ' than the median of the 24 before, ' || {_FIX('eb')} || ' kWh (' || CASE WHEN ez > 0 THEN '+' ELSE '−' END || {_FIX('abs(ez)')} || ' σ).',
  equipment_id || ' left its usual operation at ' || {_AT} || '.'), 'At the same time ' || also || '.',
  CASE WHEN slow THEN 'Residuals have risen over the past months, which is how a slow loss of efficiency looks.' END, CASE WHEN brief AND NOT coalesce(slow, false) THEN 'It lasted two intervals at most, so an operating event is likelier than a fault.' END,
  CASE WHEN stuck THEN 'A channel repeats one value for hours: suspect the sensor or its transmission.' END) AS narrative
FROM spot LEFT JOIN en USING (id) LEFT JOIN also USING (id) LEFT JOIN has USING (id)"""


@query("narrative", f"{T}, {NARRATIVES}")
def _(spark, d):
    eps, dev = tagged(spark, d)
    return explain.narrate(eps, dev.filter("nth <= 4"))


@query("integrity", f"{T}, {TAGS}, c AS (SELECT DISTINCT id FROM dev WHERE nth <= 4) SELECT (SELECT count(*) FROM pts WHERE row_ord % 50 = 3) AS bad_points, (SELECT count(*) FROM eps WHERE start_ms % 3 = 0 OR end_ms % 4 = 1 OR s % 5 = 2 OR e % 6 = 5 OR id NOT IN (SELECT id FROM c)) AS bad_episodes")
def _(spark, d):
    """Counts of faults planted into results: scores that are not finite, peaks, narratives and advice taken away."""
    x = pipeline.settle(points(spark, d), "points")
    eps = pipeline.settle(series.episodes(x), "episodes")
    eps, dev = tagged_of(telemetry(spark, d), x, eps)
    score = F.when(F.col("row_ord") % 50 != 3, F.col("score")).when(F.col("row_ord") % 100 == 3, F.lit(float("nan")))
    gone = eps.filter("s % 5 = 2").select("id")
    return pipeline.integrity({
        "points": x.withColumn("score", score),
        "episodes": eps.withColumn("peak", F.when(F.col("start_ms") % 3 != 0, F.col("peak")).otherwise(F.lit(float("inf")))),
        "narratives": explain.narrate(eps, dev.filter("nth <= 4")).join(eps.select("id", "end_ms"), "id").withColumn("narrative", F.when(F.col("end_ms") % 4 != 1, F.col("narrative")).otherwise("")),
        "recommendations": explain.recommend(eps).join(gone, "id", "left_anti"),
        "contributors": dev.filter("nth <= 4").join(eps.filter("e % 6 = 5").select("id"), "id", "left_anti"),
    })


@query("run_catalog", f"{T} SELECT 'series' AS name, count(*) AS n_rows, true AS whole FROM t UNION ALL SELECT 'energy', count(DISTINCT equipment_id), true FROM t")
def _(spark, d):
    """Tables of a run that is published, then read back and compared with its manifest."""
    t = telemetry(spark, d)
    folder = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    return catalog.verified(spark, folder, catalog.publish(spark, {"series": t, "energy": series.energy_stats(t)}, folder))


@query("report_json", f"{T}, {EPS} SELECT 'severities' AS kind, CAST(json_object('watch', count(*) FILTER (severity = 'watch'), 'alert', count(*) FILTER (severity = 'alert'), 'action', count(*) FILTER (severity = 'action')) AS VARCHAR) AS json FROM eps UNION ALL SELECT 'episode', CAST(json_object('id', id, 'severity', severity) AS VARCHAR) FROM eps")
def _(spark, d):
    eps = pipeline.settle(series.episodes(points(spark, d)), "episodes")
    none = {k: eps.limit(0).select("id") for k in ("fleet", "metadata", "units")}
    return pipeline.json_report({**none, "episodes": eps.select("id", "severity"), "narratives": eps.select("id").limit(0)})


@query("learned_units")
def _(spark, d):
    return pipeline.run(telemetry(spark, d), pipeline.Options(model="learned"))["units"]


@query("learned_episodes")
def _(spark, d):
    return pipeline.run(telemetry(spark, d), pipeline.Options(model="learned"))["episodes"].select("id", "severity", "peak", "hours", "tags")


# --- the fixture --------------------------------------------------------------------------------------------------


@query("demo_rows", "SELECT * FROM (VALUES ('CHILLER-01', 6098), ('CHILLER-02', 12567), ('CHILLER-03', 9942)) AS x(equipment_id, n)")
def _(spark, d):
    return demo(spark).groupBy("equipment_id").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("demo_missing", "SELECT * FROM (VALUES " + ", ".join(f"('{m}', {n}::BIGINT)" for m, n in MISSING.items()) + ') AS x("column", n)')
def _(spark, d):
    return series.missing_counts(demo(spark)).select("column", "n")


@query("demo_windows")
def _(spark, d):
    """Energy within the fixture's faults, and three days before each."""
    return series.window_means(demo(spark), fault_windows(spark)).select("equipment_id", "name", r6("inside", 1).alias("inside"), "n", r6("before", 1).alias("before"))


# --- views --------------------------------------------------------------------------------------------------------

DOWN = f"b AS (SELECT *, (row_number() OVER ({W}) - 1) // (CASE WHEN count(*) OVER (PARTITION BY equipment_id) <= 520 THEN 1 ELSE ceil(count(*) OVER (PARTITION BY equipment_id) / 260) END)::BIGINT AS bucket FROM t), down AS (SELECT equipment_id, bucket, min(ts_ms) AS ts_ms, avg(energy) AS mean, min(energy) AS lo, max(energy) AS hi FROM b GROUP BY equipment_id, bucket HAVING avg(energy) IS NOT NULL)"


@query("downsample_bucket", f"{T}, {DOWN} SELECT equipment_id, bucket, ts_ms, {R6('mean')} AS mean, lo, hi FROM down")
def _(spark, d):
    return series.downsample(telemetry(spark, d), "energy", 260).select("equipment_id", "bucket", "ts_ms", r6("mean").alias("mean"), "lo", "hi")


@query("range_after_downsample", f"{T}, {DOWN} SELECT equipment_id, bucket, {R6('mean')} AS mean FROM down WHERE make_timestamp(ts_ms * 1000) BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'")
def _(spark, d):
    at = F.timestamp_millis("ts_ms").cast("timestamp_ntz")
    return series.downsample(telemetry(spark, d), "energy", 260).filter(at.between(F.expr("timestamp_ntz'2024-01-05'"), F.expr("timestamp_ntz'2024-01-12'"))).select("equipment_id", "bucket", r6("mean").alias("mean"))


@query("smoothed_sparkline", f"{T}, {DOWN}, k AS (SELECT *, row_number() OVER (PARTITION BY equipment_id ORDER BY bucket) - 1 AS k FROM down) SELECT a.equipment_id, a.bucket, {R6('sum(b.mean * CASE WHEN b.k = 0 THEN 1 ELSE 2 / 3::DOUBLE END * pow(1 / 3::DOUBLE, a.k - b.k))')} AS soft FROM k a JOIN k b ON a.equipment_id = b.equipment_id AND b.k <= a.k GROUP BY ALL")
def _(spark, d):
    return series.smoothed(series.downsample(telemetry(spark, d), "energy", 260)).select("equipment_id", "bucket", r6("soft").alias("soft"))


@query("degrade_view", f"{T}, {DAILY}, se AS (SELECT *, quantile_cont(energy, 0.5) OVER (PARTITION BY equipment_id ORDER BY day ROWS BETWEEN 22 PRECEDING AND 22 FOLLOWING) AS seasonal FROM daily), de AS (SELECT *, (row_number() OVER (PARTITION BY equipment_id ORDER BY day) - 1) // greatest(1, ceil(count(*) OVER (PARTITION BY equipment_id) / 12))::BIGINT AS bucket FROM se), dg AS (SELECT equipment_id, bucket, min(day) AS day, avg(energy) AS mean, min(energy) AS lo, max(energy) AS hi, avg(seasonal) AS seasonal FROM de GROUP BY ALL), kk AS (SELECT *, row_number() OVER (PARTITION BY equipment_id ORDER BY bucket) - 1 AS k FROM dg), so AS (SELECT a.equipment_id, a.bucket, sum(b.mean * CASE WHEN b.k = 0 THEN 1 ELSE 2 / 3::DOUBLE END * pow(1 / 3::DOUBLE, a.k - b.k)) AS soft FROM kk a JOIN kk b ON a.equipment_id = b.equipment_id AND b.k <= a.k GROUP BY ALL) SELECT equipment_id, day, {R6('soft')} AS soft, {R6('lo')} AS lo, {R6('hi')} AS hi, {R6('seasonal')} AS seasonal FROM dg JOIN so USING (equipment_id, bucket)")
def _(spark, d):
    v = series.degrade_view(series.seasonal(series.daily(points(spark, d))), 12)
    return v.select("equipment_id", "day", *(r6(c).alias(c) for c in ("soft", "lo", "hi", "seasonal")))


@query("y_domain", f"{T}, {DOWN}, dm AS (SELECT equipment_id, min(lo) AS lo, max(hi) AS hi FROM down GROUP BY ALL) SELECT equipment_id, {R6('lo - 0.08 * (hi - lo)')} AS lo, {R6('hi + 0.08 * (hi - lo)')} AS hi FROM dm")
def _(spark, d):
    return series.domain(series.downsample(telemetry(spark, d), "energy", 260)).select("equipment_id", r6("lo").alias("lo"), r6("hi").alias("hi"))


_STEP = "CASE WHEN raw / power < 1.5 THEN 1 WHEN raw / power < 3.5 THEN 2 WHEN raw / power < 7.5 THEN 5 ELSE 10 END * power"


@query("axis_ticks", f"{T}, {DOWN}, dm AS (SELECT equipment_id, min(lo) AS lo, max(hi) AS hi FROM down GROUP BY ALL), pw AS (SELECT *, (hi - lo) / 5 AS raw, pow(10, floor(log10((hi - lo) / 5))) AS power FROM dm), st AS (SELECT *, {_STEP} AS step FROM pw), tk AS (SELECT equipment_id, unnest(range(ceil(lo / step)::BIGINT, floor(hi / step + 1e-6)::BIGINT + 1)) * step AS tick FROM st) SELECT equipment_id, {R6('tick')} AS tick FROM tk")
def _(spark, d):
    b = series.downsample(telemetry(spark, d), "energy", 260).groupBy("equipment_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return b.select("equipment_id", F.explode(text.ticks(F.col("lo"), F.col("hi"), 5)).alias("tick")).select("equipment_id", r6("tick").alias("tick"))


_SIG = lambda x, digits: f"regexp_replace(format('{{:,.{digits}f}}', round({x}, {digits})), '\\.?0+$', '')" if digits else f"format('{{:,.0f}}', round({x}, 0))"


@query("format_labels", f"{T}, e AS (SELECT row_ord, energy * (CASE row_ord % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 1000000 END) AS kwh, humidity, ts_ms FROM t WHERE energy IS NOT NULL) SELECT row_ord, CASE WHEN abs(kwh) >= 1e6 THEN {_SIG('kwh / 1e6', 2)} || ' GWh' WHEN abs(kwh) >= 1e3 THEN {_SIG('kwh / 1e3', 1)} || ' MWh' ELSE {_SIG('kwh', 0)} || ' kWh' END AS energy, {_SIG('humidity', 0)} || '%' AS percent, strftime(make_timestamp(ts_ms * 1000), '%-d %b %Y') AS day FROM e")
def _(spark, d):
    t = telemetry(spark, d).filter("energy is not null")
    kwh = F.col("energy") * F.when(F.col("row_ord") % 3 == 0, 1.0).when(F.col("row_ord") % 3 == 1, 1000.0).otherwise(1e6)
    return t.select("row_ord", text.energy_label(kwh).alias("energy"), text.percent_label(F.col("humidity")).alias("percent"), text.day_label(F.col("ts_ms")).alias("day"))


@query("range_query", f"{T} SELECT equipment_id, row_ord, energy FROM t WHERE make_timestamp(ts_ms * 1000) BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' AND equipment_id = 'click'")
def _(spark, d):
    lo, hi = (F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01', timestamp_ntz'{x}')") for x in ("2024-01-05", "2024-01-12"))
    return telemetry(spark, d).filter(F.col("ts_ms").between(lo, hi) & (F.col("equipment_id") == "click")).select("equipment_id", "row_ord", "energy")


ASKED = "asked AS (SELECT DISTINCT equipment_id, (ts_ms // 86400000) * 86400000 + 43200000 AS at_ms FROM t)"


def asked(t: DataFrame) -> DataFrame:
    return t.select("equipment_id", (F.floor(F.col("ts_ms") / S.DAY_MS) * S.DAY_MS + 43_200_000).alias("at_ms")).distinct()


@query("nearest_ts", f"{T}, {ASKED} SELECT equipment_id, at_ms, arg_min(row_ord, struct_pack(a := abs(ts_ms - at_ms), b := -ts_ms, c := -row_ord)) AS row_ord FROM asked JOIN t USING (equipment_id) GROUP BY equipment_id, at_ms")
def _(spark, d):
    t = telemetry(spark, d)
    return series.nearest(t, asked(t))


@query("point_in_band", f"{T}, {EPS}, {ASKED.replace('asked AS (SELECT DISTINCT equipment_id, (ts_ms // 86400000) * 86400000 + 43200000', 'asked AS (SELECT DISTINCT equipment_id, ts_ms // 3600000 * 3600000')} SELECT equipment_id, at_ms, arg_min(id, start_ms) AS id FROM asked JOIN eps USING (equipment_id) WHERE at_ms BETWEEN start_ms AND end_ms GROUP BY ALL")
def _(spark, d):
    hours = telemetry(spark, d).select("equipment_id", (F.floor(F.col("ts_ms") / 3_600_000) * 3_600_000).alias("at_ms")).distinct()
    return series.containing(hours, series.episodes(points(spark, d)))


BANDS = "w AS (SELECT equipment_id, 'week' || (day // 7) AS name, day * 86400000 AS from_ms, (day + 1) * 86400000 AS to_ms FROM (SELECT DISTINCT equipment_id, ts_ms // 86400000 AS day FROM t) WHERE day % 7 = 0)"


def bands(t: DataFrame) -> DataFrame:
    days = t.select("equipment_id", F.floor(F.col("ts_ms") / S.DAY_MS).alias("day")).distinct().filter("day % 7 = 0")
    return days.select("equipment_id", F.concat(F.lit("week"), F.expr("day div 7")).alias("name"), (F.col("day") * S.DAY_MS).alias("from_ms"), ((F.col("day") + 1) * S.DAY_MS).alias("to_ms"))


@query("band_overlap", f"{T}, {EPS}, {BANDS} SELECT eps.equipment_id, name, id FROM eps JOIN w ON eps.equipment_id = w.equipment_id AND start_ms < to_ms AND end_ms > from_ms")
def _(spark, d):
    return series.overlapping(series.episodes(points(spark, d)), bands(telemetry(spark, d)))


@query("nearby_episodes", f"{T}, {EPS}, {BANDS} SELECT eps.equipment_id, name, id FROM eps JOIN w ON eps.equipment_id = w.equipment_id AND (start_ms BETWEEN from_ms - 259200000 AND to_ms + 259200000 OR end_ms BETWEEN from_ms - 259200000 AND to_ms + 259200000)")
def _(spark, d):
    return series.nearby(series.episodes(points(spark, d)), bands(telemetry(spark, d)))


@query("window_means", f"{T}, w AS (SELECT DISTINCT equipment_id, 'mid' AS name, 1705276800000 AS from_ms, 1705536000000 AS to_ms FROM t) SELECT equipment_id, name, {R6('avg(energy) FILTER (ts_ms >= from_ms AND ts_ms < to_ms)')} AS inside, count(*) FILTER (ts_ms >= from_ms AND ts_ms < to_ms) AS n, {R6('avg(energy) FILTER (ts_ms >= from_ms - 259200000 AND ts_ms < from_ms - 172800000)')} AS before FROM t JOIN w USING (equipment_id) GROUP BY ALL")
def _(spark, d):
    t = telemetry(spark, d)
    w = t.select("equipment_id").distinct().select("equipment_id", F.lit("mid").alias("name"), F.lit(1705276800000).alias("from_ms"), F.lit(1705536000000).alias("to_ms"))
    return series.window_means(t, w).select("equipment_id", "name", r6("inside").alias("inside"), "n", r6("before").alias("before"))


# --- streams ------------------------------------------------------------------------------------------------------


def event_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream in two files by time, with a heartbeat that closes the last windows."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    rows = e.select(F.col("event_type").alias("equipment_id"), ms.alias("ts_ms"), F.col("event_id").alias("row_ord"), "value")
    s, _ = stream.fed(rows, 2, ordered.HEARTBEAT, F.lit(False), "event-feed")
    return s.select(F.col("equipment_id").alias("event_type"), F.timestamp_millis("ts_ms").alias("at"), "value")


@query("stream_daily", "SELECT event_type, epoch_ms(date_trunc('day', ts)) AS day_ms, count(*) AS n, floor(sum(value) * 100 + 0.5)::BIGINT AS cents FROM events GROUP BY ALL")
def _(spark, d):
    return stream.drained(stream.daily(event_feed(spark, d)), "stream_daily", "append")


@query("stream_sessions", "WITH g AS (SELECT event_type, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 7 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts) AS k FROM g) SELECT event_type, epoch_us(min(ts)) // 1000 AS start_ms, count(*) AS n FROM s GROUP BY event_type, k")
def _(spark, d):
    return stream.drained(stream.sessions(event_feed(spark, d)), "stream_sessions", "append")


@query("stream_dedupe", "SELECT event_id, event_type FROM events")
def _(spark, d):
    """A stream in which every event arrives twice."""
    s = stream.event_stream(spark, d)
    return stream.drained(stream.deduped(s.unionByName(s)).select("event_id", "event_type"), "stream_dedupe", "append")


@query("stream_features", f"""{T}, f AS (SELECT *, last_value(energy IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM t)
SELECT equipment_id, row_ord, {R6('filled')} AS filled, {R6(f'lag(filled, 1) OVER ({W})')} AS lag1, {R6(f'lag(filled, 48) OVER ({W})')} AS lag48, {R6(f'CASE WHEN row_number() OVER ({W}) >= 48 THEN avg(filled) {ROLL} END')} AS roll_mean FROM f""")
def _(spark, d):
    out = stream.features(stream.telemetry_stream(spark, d))
    return stream.drained(out, "stream_features", "append").select("equipment_id", "row_ord", *(r6(c).alias(c) for c in ("filled", "lag1", "lag48", "roll_mean")))


def _late(rows: DataFrame) -> Column:
    return F.pmod(F.xxhash64("row_ord"), F.lit(9)) == 0


def _keys(rows: DataFrame) -> int:
    """The units, and the heartbeat."""
    return rows.select("equipment_id").distinct().count() + 1


def _delay(rows: DataFrame) -> str:
    """Twenty days, or two of four parts of a series that is longer than forty."""
    days = rows.agg(F.ceil((F.max("ts_ms") - F.min("ts_ms")) / (2 * S.DAY_MS)).alias("days")).first()["days"]
    return f"{max(20, (days or 0) + 1)} days"


@query("stream_impute", ORACLES["impute_linear_ffill"])
def _(spark, d):
    """Fed in four files by time, a ninth of the rows one file late: the watermark's delay spans two files."""
    t = telemetry(spark, d).select("equipment_id", "ts_ms", "row_ord", "energy", "wind", "dew")
    nominal = series.nominal_minutes(t).first()["nominal"]
    s, _ = stream.fed(t, 4, ordered.HEARTBEAT, _late(t), "telemetry-feed")
    out = ordered.imputed(s, ["energy", "wind", "dew"], nominal, _delay(t), 3 * S.DAY_MS)
    return stream.drained(out, "stream_impute", "append", _keys(t)).select("equipment_id", "row_ord", r6("energy").alias("energy"), r6("wind").alias("wind"), "dew")


@query("stream_episodes", f"{T}, {DEV} SELECT eps.id, eps.equipment_id, start_ms, end_ms, hours, {R6('peak')} AS peak, prn AS peak_rn FROM eps JOIN peaks USING (id)")
def _(spark, d):
    """Runs of a stream of raw scores, fed as stream_impute is."""
    r = raws(spark, d)
    scores = r.select("equipment_id", "ts_ms", "row_ord", "raw").join(series.thresholds(r), "equipment_id")
    s, _ = stream.fed(scores.select("equipment_id", "ts_ms", "row_ord", "raw", "threshold", "rescue"), 4, ordered.HEARTBEAT, _late(scores), "score-feed")
    out = stream.drained(ordered.runs(s, _delay(r)), "stream_episodes", "append", _keys(r))
    return out.select("id", "equipment_id", "start_ms", "end_ms", "hours", r6("peak").alias("peak"), "peak_rn")
