"""Header lines, and reports of any length."""

import json

import pytest

from kelvinlake.plans import pipeline
from kelvinlake.sources import contract

HEAD = "timestamp,equipment_id,Chiller Energy Consumption"


@pytest.mark.parametrize("multiline", [False, True])
def test_a_header_line_in_the_body_is_a_bad_row(spark, tmp_path, multiline):
    (tmp_path / "a.csv").write_text(f"{HEAD}\n2020-01-01 00:00,u,1\n{HEAD}\n2020-01-01 00:30,u,2\n", encoding="utf-8")
    t, counts = contract.load(spark, str(tmp_path / "a.csv"), multiline)
    assert t.count() == 2 and counts.first()["bad_rows"] == 1


def test_each_file_of_a_folder_has_a_header(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(f"{HEAD}\n2020-01-0{i + 1} 00:00,u,1\n{HEAD}\n", encoding="utf-8")
    t, counts = contract.load(spark, str(tmp_path))
    assert t.count() == 3 and 2 <= counts.first()["bad_rows"] <= 3  # a last line is none where nothing follows it


def test_report_is_not_cut(spark):
    n = 1500
    units = spark.range(n).selectExpr("concat('u', id) AS equipment_id", "90 AS health", "0.0D AS trend", "0.5D AS threshold", "false AS insufficient", "'' AS reason")
    eps = spark.range(n).selectExpr("concat('u', id) AS equipment_id", "concat('u', id, '-0') AS id", "0L AS start_ms", "'watch' AS severity", "1.0D AS hours", "0.5D AS peak", "array('unclassified') AS tags")
    result = {"units": units, "episodes": eps, "narratives": eps.selectExpr("id", "'text' AS narrative")}
    assert sum(1 for _ in pipeline.report(result)) == 2 * n
    rows = pipeline.json_report(result).collect()
    assert len(rows) == 2 * n + 1
    assert [json.loads(r["json"]) for r in rows if r["kind"] == "severities"] == [{"watch": n, "alert": 0, "action": 0}]
    assert json.loads(next(r["json"] for r in rows if r["kind"] == "episode"))["narrative"] == "text"
