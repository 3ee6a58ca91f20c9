"""Operators use all of their input: what a cap, a sample or a switch once left out."""

import numpy as np

from pyspark.sql import functions as F

from kelvinlake.llm import lm_score, url_filter


def test_lm_learns_from_all_training_windows(spark):
    rows = [(i, " ".join(f"w{i * j % 97}" for j in range(i % 60))) for i in range(300)]
    table, code = lm_score.coded(spark.createDataFrame(rows, "doc_id long, text string"))
    train = table.filter("train")
    sizes = train.selectExpr("octet_length(ids) div 2 as n").toPandas()["n"].to_numpy(np.int64)
    _, seen = lm_score.train(train, code)
    assert seen == len(lm_score.windows(sizes)[0]) > len(sizes) > 200

    ids, sizes = np.arange(400) % 7, np.array([1, 4, 200, 15, 180])
    turns = [lm_score.share(ids, sizes, k).tolist() for k in range(lm_score.ROUNDS)]
    assert sorted(sum(turns, [])) == list(range(len(lm_score.windows(sizes)[0]))) and all(turns)


URLS = "page_id long, url string"


def test_url_shares_of_rare_sites(spark):
    sites = range(10_000, 15_000)
    labelled = [(i, f"https://s{i}.com/{'de' if i % 2 else 'fr'}/a") for i in sites]
    asked = [(100_000 + i, f"https://s{i}.com/xx/a") for i in sites]
    got = url_filter.judge_urls(spark.createDataFrame(labelled + asked, URLS)).filter("page_id >= 100000").collect()
    assert len(got) == 5_000 and all((r["verdict"] == "block") == bool(r["page_id"] % 2) for r in got)


def test_url_fit_sample_is_not_filled_by_copies(spark):
    urls = [(i, f"https://a{i}.com/fr/a") for i in range(400)]
    low = spark.createDataFrame(urls, URLS).orderBy(F.xxhash64("url")).first()["url"]
    blocked = [(50_000 + i, f"https://b.com/de/{i:04}") for i in range(4_000)]
    pages = [(100_000 + i, low) for i in range(url_filter.FIT_ROWS)] + blocked + [(1, "https://b.com/xx/0001")]
    before = F.xxhash64("url") < F.xxhash64(F.lit(low))
    early = {r["page_id"] for r in spark.createDataFrame(blocked, URLS).filter(before).collect()}
    pages = [p for p in pages if p[0] not in early]
    got = url_filter.judge_urls(spark.createDataFrame(pages, URLS)).filter("page_id = 1").first()
    assert got["verdict"] == "block"
