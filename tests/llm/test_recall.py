"""Recall of the whole near-duplicate join just above its threshold, at the constants that ship."""

import random

from kelvinlake.llm import near_dedup


def test_recall_of_pairs_at_the_threshold(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(7))
    rows, pairs = [], []
    for i in range(500):
        a = [word() for _ in range(rnd.randint(60, 200))]
        n = len(a) - 3
        k = max(k for k in range(1, n) if 100 * (n - k) >= 80 * (n + k))  # shingles that differ
        if 100 * (n - k) > 82 * (n + k):
            continue
        b = a[: len(a) - k] + [word() for _ in range(k)]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
        pairs.append(2 * i)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    found = sum(got[i] == got[i + 1] for i in pairs)
    assert len(pairs) > 300 and found >= 0.999 * len(pairs)
    assert len(set(got.values())) == 2 * len(pairs) - found  # and nothing else
