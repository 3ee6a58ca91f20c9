import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from kelvinlake import queries
from kelvinlake.functions import scalar as S
from kelvinlake.functions import text
from kelvinlake.operators import explain, models, series, selection
from kelvinlake.plans import pipeline
from kelvinlake.queries import ORACLES, QUERIES
from kelvinlake.sources import contract
from kelvinlake.sources.demo import demo, fault_windows, write_csv

DATA = "/root/testdata/sf0.001"
HALF = 1_800_000


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for f in os.listdir(DATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


@pytest.fixture(scope="module")
def shared():
    """What many queries begin with is made once for this module."""
    with pytest.MonkeyPatch.context() as m:
        for name in ("prepared", "raws", "points", "explained", "tagged", "reports"):

            def kept(spark, sf_dir, f=getattr(queries, name), known={}):  # noqa: B006
                if sf_dir not in known:
                    out = f(spark, sf_dir)
                    known[sf_dir] = tuple(pipeline.settle(x, "kept") for x in out) if isinstance(out, tuple) else pipeline.settle(out, "kept")
                return known[sf_dir]

            kept.__defaults__ = (getattr(queries, name), {})
            m.setattr(queries, name, kept)
        yield


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, shared, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda df: sorted(df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None), key=str)
    assert rows(got) == rows(want)


def line(spark, cells, unit="u", **more):
    """A series of one unit at half-hours; cells: energy, or (energy, load)."""
    rows = []
    for i, c in enumerate(cells):
        e, ld = c if isinstance(c, tuple) else (c, float(i % 5))
        rows.append((unit, i, i * HALF, i % 48 / 2, 4, None if e is None else float(e), None if ld is None else float(ld)))
    return spark.createDataFrame(rows, "equipment_id string, row_ord long, ts_ms long, hour double, dow int, energy double, load double").withColumns({k: F.lit(v) for k, v in more.items()})


# --- CSV ----------------------------------------------------------------------------------------------------------

HEAD = " Timestamp ,Equipment-ID,Building Load (RT),chiller_energy_consumption (kWh),Building Load,extra"


@pytest.mark.parametrize("multiline", [False, True])
def test_csv_traps(spark, tmp_path, multiline):
    rows = ['2020-01-01 00:00,U1,10,5.0,99,x', '2020-01-01T00:00:00.250Z, U1 ,11,6.0,99', '2020-01-01 00:30:59,U1,,abc,99,x,more,cells', "", "bad-ts,U1,1,1,9", "2020-01-01 01:00, ,1,1,9", '"2020-13-01 00:00","U1","12",7', "2020-01-01 24:15,U1,13,8", "2020-01-01 00:45.5,U1,1,1", ",,,,", "2020-01-02 00:00,\"U\"\"2\",1,1", ",, ,", "", ""]
    (tmp_path / "f.csv").write_text("\n".join([HEAD, *rows]))
    t, counts = contract.clean(contract.read_csv(spark, str(tmp_path / "f.csv"), multiline))
    assert counts.first().asDict() == {"bad_rows": 4, "rows": 6, "duplicates": 1}  # a blank line, a row of blanks, a bad time, no unit
    day = 1577836800000
    got = {(r["equipment_id"], r["ts_ms"]): r for r in t.collect()}
    assert got["U1", day]["load"] == 10.0 and got["U1", day]["energy"] == 5.0 and got["U1", day]["flow"] is None
    assert got["U1", day + 1859000]["hour"] == 0.5 and got["U1", day + 1859000]["energy"] is None
    assert ("U1", day + 86_400_000 + 900_000) in got and ("U1", 1609459200000) in got and ('U"2', day + 86_400_000) in got
    assert abs(got["U1", day + 2_700_000]["hour"] - (0.75 + 5 / 3_600_000)) < 1e-12  # one digit is five milliseconds
    assert {r["equipment_id"]: r["dow"] for r in t.collect()} == {"U1": 5, 'U"2': 4} or got["U1", day]["dow"] == 3


def test_csv_line_ends_in_cells(spark, tmp_path):
    (tmp_path / "f.csv").write_text(HEAD + '\n"2020-01-01 00:00","U\n\n1",10,5\n\n2020-01-01 00:30,U2,1,1\n')
    t, counts = contract.clean(contract.read_csv(spark, str(tmp_path / "f.csv"), multiline=True))
    assert counts.first()["bad_rows"] == 1 and {r["equipment_id"] for r in t.collect()} == {"U\n\n1", "U2"}


@pytest.mark.parametrize(("body", "said"), [("", "none"), ("a,b\n1,2\n", "missing required"), (HEAD + "\n", "no observations"), (HEAD + "\n\n\n", "no observations"), (HEAD + "\nnever,U1,1,1\n", "timestamp")])
def test_csv_errors(spark, tmp_path, body, said):
    (tmp_path / "f.csv").write_text(body)
    with pytest.raises(contract.DatasetError, match=said):
        contract.load(spark, str(tmp_path / "f.csv"))


def test_quality_report(spark, tmp_path):
    rows = [f"2020-01-01 {h:02}:00,U1,{'' if h == 3 else h},{h}" for h in range(8)] + ["2020-01-01 20:00,U1,1,1", "2020-01-01 20:00,U1,2,2", "x,U1,1,1"]
    (tmp_path / "f.csv").write_text("\n".join([HEAD, *rows]))
    q = series.quality(*contract.load(spark, str(tmp_path / "f.csv"))).first()
    assert q["missing_by_column"] == {"load": 1} and sorted(q["missing_columns"]) == sorted(set(contract.MEASURES) - {"load", "energy"})
    assert (q["row_count"], q["equipment_count"], q["gaps"], q["longest_h"], q["bad_rows"], q["duplicates"]) == (9, 1, 1, 13.0, 1, 1)


# --- missing values and statistics, by hand -----------------------------------------------------------------------


def test_clamp_keeps_nulls(spark):
    r = spark.range(1).select(*(S.clamp(F.lit(v).cast("double"), -6.0, 6.0).alias(k) for k, v in {"a": None, "b": 7.0, "c": -7.0, "d": 1.5}.items())).first()
    assert tuple(r) == (None, 6.0, -6.0, 1.5)


def test_impute(spark):
    t = line(spark, [(v, 1.0) for v in [None, 1, None, None, 4, None, None, None, None, 9, None]], dew=None).withColumn("dew", F.col("dew").cast("double"))
    got = series.impute(t).orderBy("row_ord").collect()
    assert [r["energy"] for r in got] == [1, 1, 2, 3, 4, 4, 4, 4, 4, 9, 9] and all(r["dew"] is None for r in got)


def test_standardise_by_hand(spark):
    z = series.standardise(line(spark, [(1, 7.0), (2, 7.0), (3, 7.0), (4, 7.0), (None, 7.0), (100, None)])).orderBy("row_ord").collect()
    # median 3, deviations 2 1 0 1 97: MAD 1
    assert [r["z_energy"] for r in z] == [(v - 3) / 1.4826 if v not in (None, 100) else None if v is None else 6.0 for v in (1, 2, 3, 4, None, 100)]
    assert all(r["z_load"] is None for r in z)  # constant


def test_missing_readings_are_not_extreme(spark):
    """Imputed rows score like their neighbours; a unit of constant energy is reported, not analysed."""
    rng = random.Random(1)
    cells = [(50 + 10 * (i % 7) + rng.random(), i % 7 + rng.random() / 10) for i in range(400)]
    holes = {150, 151, 260, 301}
    t = line(spark, [(None, ld) if i in holes else (e, ld) for i, (e, ld) in enumerate(cells)]).unionByName(line(spark, [5.0] * 200, "flat")).unionByName(line(spark, [1.0, 2.0] * 30, "short"))
    result = pipeline.run(t)
    raw = {r["row_ord"]: r["raw"] for r in result["points"].collect()}
    assert len(raw) == 400 and max(raw[i] for i in holes) < 0.76
    units = {r["equipment_id"]: r for r in result["units"].collect()}
    assert units["flat"]["insufficient"] and "vary" in units["flat"]["reason"] and units["flat"]["health"] is None and units["flat"]["total"] == 1000
    assert "only 60" in units["short"]["reason"] and units["short"]["n"] == 60 and not units["u"]["insufficient"]
    assert pipeline.integrity(result).first().asDict() == {"bad_points": 0, "bad_episodes": 0}


def test_no_unit_can_be_analysed(spark):
    with pytest.raises(contract.DatasetError, match="only 10 observations"):
        pipeline.run(line(spark, [1.0] * 10))


def test_upper_median_and_medians(spark):
    t = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 10.0), ("a", 20.0), ("a", None), ("b", 5.0), ("c", None)], "equipment_id string, v double")
    both = selection.exact(t, ["equipment_id"], F.col("v"), {"m": ("linear", 0.5), "u": ("upper", 0.5)})
    got = {r["equipment_id"]: (r["m"], r["u"]) for r in both.collect()}
    assert got == {"a": (6.0, 10.0), "b": (5.0, 5.0)}
    q = series.quantiles(t.filter("v is not null"), "v", {"q": 0.25}).collect()
    assert {r["equipment_id"]: r["q"] for r in q} == {"a": 1.75, "b": 5.0}


def test_formulas(spark):
    one = spark.range(1).select(
        S.fuse(F.lit(0.6), F.lit(1.8)).alias("f"), S.health(F.lit(0.1), F.lit(0.2), F.lit(500)).alias("h"), S.health(F.lit(1.0), F.lit(1.0), F.lit(95)).alias("young"), S.half_up(F.lit(-2.5)).alias("r"),
        S.horizon_days(F.lit(0.01)).alias("d"), S.maintenance(F.lit(90), F.lit(0.01), F.lit(0.0)).alias("m"), S.bin8(F.lit(8.0), F.lit(0.0), F.lit(8.0)).alias("top"), S.bin8(F.lit(3.0), F.lit(3.0), F.lit(3.0)).alias("flat"),
    ).first()
    assert (round(one["f"], 6), one["h"], one["young"], one["r"], one["d"], one["m"], one["top"], one["flat"]) == (0.432602, 89, 100, -2, 150, "recommended", 7, 0)


def test_labels(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert [one(text.duration_label(F.lit(h))) for h in (0.5, 1.0, 36.5, 48.0, 100.0)] == ["30 min", "1 h", "36.5 h", "2 d", "4.2 d"]
    assert [one(text.energy_label(F.lit(k))) for k in (12.4, 1234.0, 2_345_678.0)] == ["12 kWh", "1.2 MWh", "2.35 GWh"]
    assert [one(text.fixed(F.lit(v))) for v in (0.15, 0.25, 0.35, -0.25, 99.95, 100.5)] == ["0.1", "0.3", "0.3", "-0.3", "100.0", "101"]
    assert one(text.time_label(F.lit(1577836800000))) == "01 Jan 2020, 00:00" and one(text.day_label(F.lit(1577836800000))) == "1 Jan 2020"
    assert one(text.percent_label(F.lit(12.4))) == "12%" and one(text.significant(F.lit(None).cast("double"))) == "-"
    assert [round(x, 6) for x in one(text.ticks(F.lit(0.3), F.lit(2.2), 5))] == [0.5, 1.0, 1.5, 2.0] and one(text.ticks(F.lit(1.0), F.lit(1.0), 5)) == [1.0]
    assert one(text.maintenance_label(F.lit(None).cast("string"), F.lit(1))) == "PM: n/a" and one(text.severity_label(F.lit("normal"))) == "Nominal"
    assert one(S.smoothstep(F.lit(0.5))) == 0.5 and one(explain.label(F.lit("sensor_stuck"))) == "Frozen sensor"


# --- scores -------------------------------------------------------------------------------------------------------


def test_islands_match_a_loop(spark):
    rng, rows, want = random.Random(5), [], set()
    for u in range(20):
        raw = [rng.random() if rng.random() < 0.2 else 0.0 for _ in range(400)]
        rows += [(f"u{u}", i, i + 1, x) for i, x in enumerate(raw)]
    r = spark.createDataFrame(rows, "equipment_id string, ts_ms long, rn int, raw double").withColumn("row_ord", F.col("ts_ms"))
    found = series.thresholds(r)
    limits = {x["equipment_id"]: (x["threshold"], x["rescue"]) for x in found.collect()}
    for u, (threshold, rescue) in limits.items():
        own, start, last = {rn: x for e, _, rn, x in rows if e == u}, None, None
        for rn in range(1, 402):
            if rn <= 400 and rn > 96 and own[rn] > threshold:
                start, last = (rn if start is None else start), rn
            elif start is not None and (rn - last > 12 or rn == 401):
                if last > start or own[start] > rescue:
                    want.add((u, start, last))
                start = None
    assert {tuple(x) for x in series.islands(r, found).select("equipment_id", "s", "e").collect()} == want


def test_thresholds_without_active_rows(spark):
    r = spark.createDataFrame([("u", i, i + 1, i, 0.0) for i in range(130)], "equipment_id string, ts_ms long, rn int, row_ord long, raw double")
    assert tuple(series.thresholds(r).first()) == ("u", 0.6, 0.9)


def test_order_over_many_parts(spark):
    rows = [(i, (i * 7919) % 1000) for i in range(3000)]
    out = series.ordered(spark.createDataFrame(rows, "id int, v int"), [F.desc("v"), F.col("id")], pipeline.settle)
    assert {r["id"]: r["place"] for r in out.collect()} == {i: k + 1 for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}


def test_forest_by_hand():
    import numpy as np

    assert models.path_norm(1) == 1.0 and round(models.path_norm(2), 6) == 0.154431
    tree = (0, 0.5, 1, (0, 2.0, 3, 1))  # one point below 0.5; else three below 2; else one
    x = np.array([[0.0], [1.0], [9.0]])
    assert np.allclose(models.lengths(tree, x), [1 + 1, 2 + models.path_norm(3), 2 + 1])
    assert np.allclose(models.forest_scores([tree], 5, x), 2 ** (-models.lengths(tree, x) / models.path_norm(5)))
    assert models.grow(np.ones((9, 2)), 5, np.random.default_rng(0)) == 9


def test_learned_models_do_not_depend_on_shards(spark, monkeypatch):
    rng = random.Random(3)
    t = line(spark, [(50 + 9 * (i % 48) ** 0.5 + rng.random() + (80 if i == 300 else 0), i % 48 + rng.random()) for i in range(400)])
    f = pipeline.settle(pipeline.model_features(series.standardise(t)), "f")
    fitted = pipeline.settle(models.fit_units(f), "m")
    assert fitted.count() == models.TREES + 1
    one = {r["rn"]: (round(r["forest"], 9), round(r["pred"], 9)) for r in models.score_units(f, fitted).collect()}
    monkeypatch.setattr(models, "SHARD", 64)
    many = {r["rn"]: (round(r["forest"], 9), round(r["pred"], 9)) for r in models.score_units(f, fitted).collect()}
    assert one == many and len(one) == 400 and sum(v[0] >= one[301][0] for v in one.values()) < 100


# --- explanation --------------------------------------------------------------------------------------------------


def test_deviations_by_hand(spark):
    cells = [(10.0 + (i % 3), 5.0) for i in range(60)]
    cells[50] = (20.0, None)
    x = line(spark, cells).withColumn("rn", (F.col("row_ord") + 1).cast("int")).withColumn("flow", F.lit(4.0))
    eps = spark.createDataFrame([("e", "u", 51)], "id string, equipment_id string, peak_rn int")
    stats = spark.createDataFrame([("u", 0.0, 0.0, 1.5)], "equipment_id string, s_flow double, s_load double, s_energy double")
    got = {r["column"]: r for r in series.deviations(series.around(x, eps), stats, ["flow", "load", "energy"]).collect()}
    assert set(got) == {"flow", "energy"}  # load is missing at the peak
    e, f = got["energy"], got["flow"]
    # the 24 before hold 10, 11, 12 eight times each: median 11, MAD 1
    assert (e["base"], e["z"], e["nth"], e["weight"], e["direction"], e["n_frozen"]) == (11.0, round(9 / 1.4826, 2), 1, 1.0, "high", 1)
    assert (f["z"], f["nth"], f["direction"], f["n_frozen"], f["stuck"]) == (0.0, 2, "low", 49, False)  # constant in all its series


def test_recommendations(spark):
    eps = spark.createDataFrame([("a", "action", ["transient_spike", "sensor_stuck"]), ("b", "watch", []), ("c", "action", []), ("d", "action", ["flow_imbalance", "sensor_stuck", "transient_spike"])], "id string, severity string, tags array<string>")
    got = {}
    for r in explain.recommend(eps).orderBy("id", "nth").collect():
        got.setdefault(r["id"], []).append(r["priority"])
    assert got == {"a": ["low", "high", "medium", "high"], "b": ["medium"], "c": ["high"], "d": ["high", "low", "high", "medium"]}  # the escalation is cut


def test_pattern_rules(spark):
    none = F.lit(None).cast("double")
    base = {"en": none, "ld": none, "cwr": none, "cwt": none, "rz": F.lit(0.0), "run": F.lit(5), "hour": F.lit(12.0), "trend": F.lit(0.0), "share": F.lit(0.1), "stuck": F.lit(False)}
    tags = lambda **k: spark.range(1).select(explain.pattern_tags(**{**base, **{n: F.lit(v) for n, v in k.items()}}).alias("t")).first()["t"]
    assert tags() == [] and tags(stuck=True) == ["sensor_stuck"]
    assert tags(en=2.5, ld=0.5) == ["high_consumption_low_load"] and tags(en=2.5) == ["contextual_energy_spike"]
    assert tags(cwt=2.0, rz=2.0, run=8) == ["cooling_water_drift"] and tags(cwt=2.0, rz=2.0, run=7) == []
    assert tags(cwr=-2.0) == ["flow_imbalance"] and tags(cwr=-2.0, ld=1.6) == []
    assert tags(en=4.0, run=2) == ["transient_spike", "contextual_energy_spike"]
    assert tags(en=1.7, hour=5.5) == ["offhours_standby"] and tags(en=1.7, hour=6.0) == []
    assert tags(trend=0.4, share=0.5) == ["degradation_trend"] and tags(rz=2.5, cwt=2.5, run=1) == ["concurrent_context_shift"]


def test_smoothing(spark):
    b = spark.createDataFrame([("u", i, float(v), float(v), float(v)) for i, v in enumerate([3, 6, 0])], "equipment_id string, bucket int, mean double, lo double, hi double")
    assert [round(r["soft"], 9) for r in series.smoothed(b).orderBy("bucket").collect()] == [3, 5, round(5 / 3, 9)]


# --- the fixture, from CSV to episodes ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def smoke(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("demo") / "csv")
    write_csv(demo(spark), path)
    return pipeline.run_csv(spark, path, pipeline.Options(model="learned"))


def test_fixture_quality(smoke):
    q = smoke["quality"].first()
    assert (q["row_count"], q["equipment_count"], q["gaps"], q["longest_h"], q["bad_rows"], q["duplicates"], q["missing_columns"]) == (28607, 3, 8, 9.5, 0, 0, [])
    assert q["missing_by_column"] == {"flow": 40, "cooling": 5, "load": 19, "energy": 9, "humidity": 20, "wind": 23, "pressure": 12}
    m = smoke["metadata"].first()
    assert (m["forest_features"], m["network_features"], m["trees"], m["hidden"]) == (18, 16, 80, 24)


def test_fixture_faults_are_found(spark, smoke):
    hits = {r["name"] for r in series.overlapping(smoke["episodes"], fault_windows(spark)).collect()}
    assert hits == {"spike", "condenser", "degradation", "imbalance", "frozen"}
    assert {r["name"] for r in series.nearby(smoke["episodes"], fault_windows(spark)).collect()} == hits
    assert pipeline.integrity(smoke).first().asDict() == {"bad_points": 0, "bad_episodes": 0}
    tags = {t for r in smoke["episodes"].collect() for t in r["tags"]}
    assert {"sensor_stuck", "concurrent_context_shift"} <= tags
    assert any(x.startswith("CHILLER-02: health") for x in pipeline.report(smoke))
    fleet = smoke["fleet"].first()
    assert fleet["watch"] + fleet["alert"] + fleet["action"] == smoke["episodes"].count() and fleet["total"] > 0


def test_fixture_narratives(smoke):
    said = [r["narrative"] for r in smoke["narratives"].collect()]
    assert all(x and "None" not in x for x in said) and any("σ" in x and "kWh" in x for x in said) and any("suspect the sensor" in x for x in said)


def test_demo_frozen_window(spark):
    held = demo(spark).filter("equipment_id = 'CHILLER-03' and row_ord between 85 * 48 and 85 * 48 + 23 and flow is not null")
    assert held.select("flow").distinct().count() == 1


def test_stream_features_over_batches(spark, tmp_path):
    """Two files read one at a time give what one batch gives; a late row is left out."""
    from kelvinlake.streaming import stream

    t = line(spark, [None if i % 10 == 3 else float(i) for i in range(120)]).select("equipment_id", "ts_ms", "row_ord", "energy")
    t.filter("row_ord < 70").coalesce(1).write.parquet(f"{tmp_path}/in")
    t.filter("row_ord >= 70 or row_ord = 5").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in")
    got = {r["row_ord"]: r for r in stream.drained(stream.features(s), "features", "append").collect()}
    want, last = [], None
    for i in range(120):
        last = last if i % 10 == 3 else float(i)
        want.append(last)
    assert len(got) == 120 and [got[i]["filled"] for i in range(120)] == want
    assert got[100]["lag1"] == want[99] and got[100]["lag48"] == want[52] and abs(got[100]["roll_mean"] - sum(want[53:101]) / 48) < 1e-9 and got[46]["roll_mean"] is None
