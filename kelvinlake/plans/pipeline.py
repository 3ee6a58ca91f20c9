"""The whole analysis of a telemetry table: a catalog of DataFrames."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvinlake.functions import scalar as S
from kelvinlake.operators import explain, models, series
from kelvinlake.plans import catalog
from kelvinlake.sources import contract
from kelvinlake.sources.contract import DatasetError, ship
from kelvinlake.tables import released, settle

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Options:
    """model: `linear` (DataFrame functions only) or `learned` (isolation forest and network). threshold: `quantile`, or
    `positional` (the value at that place of the active rows in time order)."""

    model: str = "linear"
    threshold: str = "quantile"
    threshold_quantile: float = 0.975
    forest_weight: float = 0.25
    residual_weight: float = 0.75
    join_window: int = S.JOIN_WINDOW


def split_by_data(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units with MIN_DATA rows or more, (equipment_id, n, reason) of the others)."""
    n = t.groupBy("equipment_id").agg(F.count(F.lit(1)).alias("n"))
    few = n.filter(F.col("n") < S.MIN_DATA).withColumn("reason", F.concat(F.lit("only "), F.col("n").cast("string"), F.lit(f" observations, {S.MIN_DATA} are needed")))
    few = settle(few, "few")
    return t.join(few, "equipment_id", "left_anti"), few


def prepared(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(imputed and standardised series of the units that can be analysed, reports of the others). t: a series as measured;
    the nominal interval is that of its first unit, whether or not that can be analysed."""
    enough, few = split_by_data(t)
    filled = settle(series.impute(enough, series.nominal_minutes(t)), "imputed")
    z = settle(series.standardise(filled), "standardised")
    no_energy = z.filter(~series.usable(series.TARGET)).groupBy("equipment_id").agg(F.count(F.lit(1)).alias("n")).withColumn("reason", F.lit("no energy values that vary"))
    return z.filter(series.usable(series.TARGET)), few.unionByName(no_energy)


def feature_names(cols: list[str]) -> tuple[list[str], list[str]]:
    """Names of the forest's and the network's inputs where all of cols are usable."""
    cyclic = [f"{k}_{n}" for k in ("hour", "dow", "doy") for n in ("sin", "cos")]
    dynamics = [c for c in (("roll_mean_z", "roll_std_z", "lag1", "lag48") if series.TARGET in cols else ())]
    forest = [f"z_{c}" for c in cols] + cyclic[:4] + dynamics + (["roll_load_z"] if series.LOAD in cols else [])
    network = [f"z_{c}" for c in cols if c != series.TARGET] + cyclic + dynamics[2:]
    return forest, network


def model_features(z: DataFrame) -> DataFrame:
    """if_x, mlp_x and y of each row of prepared(); width_if and width_mlp count the inputs that the unit's measures allow.
    An input of a measure that the unit cannot use is 0 in all its rows, so the models learn nothing from it."""
    cols = series.measures(z)
    rows = series.rolling(series.lags(z)).withColumns(S.cyclic(F.col("ts_ms"), F.col("hour")))
    e, ld = series.TARGET, series.LOAD
    rolled = {"roll_mean_z": S.clamp((F.col("roll_mean") - F.col(f"m_{e}")) / F.col(f"s_{e}"), -6.0, 6.0), "roll_std_z": S.clamp(F.col("roll_std") / F.col(f"s_{e}"), -6.0, 6.0)}
    if ld in cols:
        rolled["roll_load_z"] = F.when(series.usable(ld), S.clamp((F.col("roll_load") - F.col(f"m_{ld}")) / F.col(f"s_{ld}"), -6.0, 6.0))
    rows = rows.withColumns(rolled)
    if_x, mlp_x = (F.array(*(F.coalesce(c, F.lit(0.0)) for c in names)) for names in feature_names(cols))
    n = sum((series.usable(c).cast("int") for c in cols), F.lit(0))
    load = series.usable(ld).cast("int") if ld in cols else F.lit(0)
    return rows.select("equipment_id", "rn", if_x.alias("if_x"), mlp_x.alias("mlp_x"), F.col(f"z_{e}").alias("y"), (n + 8 + load).alias("width_if"), (n - 1 + 8).alias("width_mlp"))


def score(z: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(points with score and run bounds, thresholds) of prepared()."""
    if options.model == "learned":
        features = settle(model_features(z), "features")
        learned = settle(models.score_units(features, settle(models.fit_units(features), "models")), "learned")
        rows = z.join(learned.hint("merge"), ["equipment_id", "rn"])  # a row for each of z, however small its file
        r = series.raw_scores(series.calibrated(rows), F.col("forest"), options.forest_weight, options.residual_weight)
    else:
        r = series.raw_scores(series.linear_residual(z), None, options.forest_weight, options.residual_weight)
    keep = [c for c in r.columns if c[:2] not in ("m_", "s_")]
    r = settle(r.select(*keep), "raw")
    limits = settle(series.thresholds(r, options.threshold, options.threshold_quantile), "thresholds")
    return series.scored(r, series.islands(r, limits, options.join_window)), limits


#: Called with a stage's name and the share of the work that is done, from 0 to 1.
Progress = Callable[[str, float], None]
STEPS = ("imputation and features", "scores", "points", "episodes", "reports", "explanation", "done")


def _steps(progress: Progress | None) -> Callable[[str], None]:
    def at(name: str) -> None:
        log.info(name)
        if progress:
            progress(name, STEPS.index(name) / (len(STEPS) - 1))

    return at


def run(t: DataFrame, options: Options = Options(), progress: Progress | None = None) -> dict[str, DataFrame]:
    """The catalog of results of a series as measured:

    points, episodes (with tags), units (a report for every unit, the insufficient ones included), daily, degrade,
    contributors, evidence, recommendations, narratives, fleet (one row), metadata (one row). progress hears of each stage as it
    begins, and of the end.
    """
    ship(t.sparkSession)
    at = _steps(progress)
    at("imputation and features")
    z, insufficient = prepared(t)
    insufficient = settle(insufficient, "insufficient")
    if z.isEmpty():
        reasons = "; ".join(f"{r['equipment_id']}: {r['reason']}" for r in insufficient.orderBy("equipment_id").limit(20).collect())
        raise DatasetError(f"no unit could be analysed ({reasons})")
    at("scores")
    x, limits = score(z, options)
    at("points")
    points = settle(x, "points")  # every result below reads it
    at("episodes")
    eps = settle(series.episodes(points), "episodes")
    at("reports")
    days = settle(series.seasonal(series.daily(points)), "daily")
    reports = settle(series.unit_reports(points, days), "units")
    at("explanation")
    # explanation is of the cells as measured, with scales of the imputed series
    cols = series.measures(t)
    n = points.count()
    raw = series.numbered_as(t.select("equipment_id", "ts_ms", "row_ord", *cols), points, ["equipment_id", "ts_ms", "row_ord"], n)
    stats = settle(z.groupBy("equipment_id").agg(*(F.first(f"s_{c}").alias(f"s_{c}") for c in cols)), "stats")
    dev = settle(series.deviations(series.around(raw, eps, rows=n), stats, cols), "deviations")
    top = dev.filter("nth <= 4")
    eps = settle(explain.tag_episodes(eps, dev, reports), "tagged")
    energy = series.energy_stats(t)
    units = energy.join(reports, "equipment_id", "left").join(limits.select("equipment_id", "threshold"), "equipment_id", "left").join(insufficient.select("equipment_id", F.col("n").alias("_n"), "reason"), "equipment_id", "left")
    units = units.withColumns({"n": F.coalesce("n", "_n"), "threshold": F.coalesce("threshold", F.lit(0.0)), "trend": S.half_up(F.coalesce("trend", F.lit(0.0)), 3), "slope": S.half_up(F.col("slope"), 3), "drift": S.half_up(F.col("drift"), 2), "insufficient": F.col("reason").isNotNull()}).drop("_n")
    fleet = series.fleet_kpis(reports, energy)
    severities = severity_totals(eps)
    n_if, n_mlp = (len(x) for x in feature_names(cols))
    if options.model == "learned":
        widths = model_features(z).agg(F.max("width_if").alias("forest_features"), F.max("width_mlp").alias("network_features"))
    else:
        widths = t.sparkSession.createDataFrame([(n_if, n_mlp)], "forest_features int, network_features int")
    fixed = {**models.HYPER, **{k: getattr(options, k) for k in ("forest_weight", "residual_weight", "threshold_quantile", "join_window", "model")}}
    at("done")
    return {
        "points": points, "episodes": eps, "units": units, "daily": days, "degrade": series.degrade_view(days), "contributors": top,
        "evidence": explain.evidence(top), "recommendations": explain.recommend(eps), "narratives": explain.narrate(eps, top),
        "fleet": fleet.join(F.broadcast(severities), F.lit(True)), "metadata": widths.withColumns({k: F.lit(v) for k, v in fixed.items()}), "thresholds": limits,
    }


def publish_run(t: DataFrame, folder: str, options: Options = Options(), progress: Progress | None = None) -> str:
    """run() published in folder (see catalog), its intermediate tables removed; returns the run's name."""
    spark = t.sparkSession
    with released(spark):
        return catalog.publish(spark, run(t, options, progress), folder)


def run_csv(spark: SparkSession, path: str, options: Options = Options(), multiline: bool = False, progress: Progress | None = None) -> dict[str, DataFrame]:
    """run() of a contract CSV, with its quality report (one row) added."""
    t, counts = contract.load(spark, path, multiline)
    t = settle(t, "series")
    return {"quality": series.quality(t, counts), **run(t, options, progress)}


def integrity(result: dict[str, DataFrame]) -> DataFrame:
    """One row: points without a finite score, and episodes without a finite peak, narrative, recommendation or contributor."""
    finite = lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))
    points = result["points"].agg(F.count_if(~finite("score")).alias("bad_points"))
    has = {k: result[k].select("id").distinct().withColumn(f"_{k}", F.lit(True)) for k in ("recommendations", "contributors")}
    eps = result["episodes"].join(result["narratives"], "id", "left")
    for h in has.values():
        eps = eps.join(h, "id", "left")
    bad = ~finite("peak") | (F.coalesce(F.length("narrative"), F.lit(0)) == 0) | F.col("_recommendations").isNull() | F.col("_contributors").isNull()
    return points.join(F.broadcast(eps.agg(F.count_if(bad).alias("bad_episodes"))), F.lit(True))  # one row each


def report(result: dict[str, DataFrame], k: int = 8) -> Iterator[str]:
    """Lines of a console report: units, and the first k episodes of each in time order. Rows come to the driver a part at a
    time; all of them do."""
    for r in result["units"].orderBy("equipment_id").toLocalIterator():
        yield f"{r['equipment_id']}: {r['reason']}" if r["insufficient"] else f"{r['equipment_id']}: health {r['health']}, trend {r['trend']}, threshold {r['threshold']:.3f}"
    nth = F.row_number().over(series.Window.partitionBy("equipment_id").orderBy("start_ms"))
    first = result["episodes"].withColumn("nth", nth).filter(F.col("nth") <= k).orderBy("equipment_id", "nth")
    for r in first.toLocalIterator():
        yield f"  {r['severity']:6} {r['id']} {r['hours']} h, peak {r['peak']} [{', '.join(r['tags'])}]"


def severity_totals(eps: DataFrame) -> DataFrame:
    """One row: episodes of each severity."""
    return eps.agg(*(F.count_if(F.col("severity") == s).alias(s) for s in ("watch", "alert", "action")))


def json_report(result: dict[str, DataFrame]) -> DataFrame:
    """(kind, json): a JSON object for the data's quality (where there is a report of it), the fleet, the metadata and the severity
    totals, and one for each unit and each episode with its narrative; to be written as text."""
    whole = {k: result[k] for k in ("quality", "fleet", "metadata") if k in result}
    whole |= {"severities": severity_totals(result["episodes"]), "unit": result["units"], "episode": result["episodes"].join(result["narratives"], "id", "left")}
    out = None
    for kind, rows in whole.items():
        one = rows.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*rows.columns)).alias("json"))
        out = one if out is None else out.unionByName(one)
    return out
