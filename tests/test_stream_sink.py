"""Streams end in files of the shared folder, not in the driver."""

import pytest

from kelvinlake.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["stream_dedupe", "stream_daily", "stream_sessions"])
def test_stream_result_lies_in_shared_files(spark, name):
    got = QUERIES[name](spark, SF)
    root = spark.conf.get("spark.checkpoint.dir")
    files = got.inputFiles()
    assert files and all(f"{root}/{name}-" in f for f in files)
    events = spark.read.parquet(f"{SF}/events.parquet").count()
    assert (got.count() if name == "stream_dedupe" else got.agg({"n": "sum"}).first()[0]) == events
