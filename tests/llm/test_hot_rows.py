"""Rows that repeat an id or a key."""

import corpus_pipeline
from kelvinlake.llm import packing, toxicity

SF = "/root/testdata/sf0.001"


def test_a_labelled_id_that_repeats_counts_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"bad word {i}") for i in range(500)] + [(i, f"fine text {i}") for i in range(2, 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 30)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "count_terms", lambda t, f=toxicity.count_terms: seen.append(t.count()) or f(t))
    toxicity.fit_toxicity(docs, labels)
    assert seen == [29]


def test_null_ids_with_one_text_leave_one_row(spark):
    text = "some words that stand in every row of this table"
    docs = spark.createDataFrame([(None, text, "en", "s", 1)] * 300 + [(4, "quite another text with other words in it", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted((r["doc_id"] is None, r["text"]) for r in got) == sorted([(True, text), (False, "quite another text with other words in it")])


def test_step_groups_of_many_windows_differ(spark):
    docs = spark.createDataFrame([(1, "a b c " * 200_000)], "doc_id long, text string")
    rows = packing.pack_documents(docs).select("tier", "step_group", "sequence_id").distinct().collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["step_group"], set()).add(r["tier"])
    assert all(len(t) == 1 for t in groups.values()) and len(groups) > 5
