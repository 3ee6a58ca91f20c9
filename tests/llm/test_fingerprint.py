"""Bottom-k sketches against exact sets, and each row's next against a plain sort."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from kelvinlake.llm import fingerprint as fp

SF = "/root/testdata/sf0.001"


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    ws = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in ws]
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def exact(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    """rows (doc_id, text) with distinct ids -> doc_id: (n_chars, edited text, next text)."""
    ordered = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for i, (d, t) in enumerate(ordered):
        nxt = ordered[(i + 1) % len(ordered)][1]
        half = len(t) // 2
        out[d] = (len(t), t[: len(t) - half] + nxt[:half], t, nxt)
    return out


def check(got, rows):
    want = brute(rows)
    assert len(got) == len(want)
    off = []
    for r in got:
        n, edited, text, nxt = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == fp.fingerprint(text) and r["edited_fingerprint"] == fp.fingerprint(edited)
        for name, other in (("near_edited", edited), ("near_next", nxt)):
            assert 0 <= r[name] <= 1
            off.append(r[name] - exact(text, other))
            if len(shingles(text)) < fp.K and len(shingles(other)) < fp.K:
                assert len(shingles(text) | shingles(other)) > fp.K or abs(off[-1]) < 1e-12
    assert abs(np.mean(off)) < 0.01 and max(map(abs, off)) < 0.25


def test_query_against_exact_sets(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(fp.op13_fingerprint(spark, SF).collect(), rows)


def test_edits_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(c.sql(fp.EDITS_SQL).fetchall()) == sorted(map(tuple, fp.fingerprint_edits(spark, SF).collect()))


def test_ids_far_apart_null_and_large(spark):
    rnd = random.Random(4)
    base = 2**53
    ids = [None, -(2**63), 2**63 - 1, *(base + i for i in range(40)), *rnd.sample(range(-(10**12), 10**12), 60), 0]
    texts = ["", None, "one", "A b c d E", "a b c d e f", "é \U0001f600 中 x y z w v", " \t\n "]
    rows = [(d, rnd.choice(texts) if i % 3 else f"w{i} common words of text {i}") for i, d in enumerate(ids)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, part int, code string")
    check(fp.edit_trial(df.repartition(3)).collect(), rows)


def test_single_row_and_no_rows(spark):
    assert fp.edit_trial(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    r = fp.edit_trial(spark.createDataFrame([(7, "abcd")], "doc_id long, text string")).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and r["near_next"] == 1.0


@pytest.mark.parametrize("hot", [7, None])
def test_an_id_that_holds_most_rows_is_spread(spark, hot):
    rows = [(hot, f"text number {i} of the hot one") for i in range(600)] + [(i + 100, f"other {i}") for i in range(100)] + [(i - 900, f"low {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    parts = fp._parted(df, 8).groupBy("part").count().collect()
    assert max(r["count"] for r in parts) < 300
    got = fp.edit_trial(df).collect()
    assert len(got) == len(rows)
    # the order is a cycle over all rows: hashes of edited texts are those of one cyclic order
    heads = fp._parted(df, 8).orderBy("part", *fp._order()).select("doc_id", "text").collect()
    want = []
    for i, r in enumerate(heads):
        nxt = heads[(i + 1) % len(heads)]["text"]
        want.append(hashlib.sha256(fp.edited(r["text"], nxt).encode()).hexdigest())
    assert sorted(r["edited_sha256"] for r in got) == sorted(want)
    ids = [r["doc_id"] for r in heads]
    assert ids == sorted(ids, key=lambda d: (d is None, -(d or 0)))


def test_estimates_and_merging(spark):
    rnd = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)]
    text = [rnd.choice(vocabulary) for _ in range(6000)]
    a, b = " ".join(text[:4000]), " ".join(text[1000:])
    x, y = (fp.bottom(fp.shingle_hashes(t)) for t in (a, b))
    assert abs(fp.size_estimate(x) / len(shingles(a)) - 1) < 0.3
    likeness, in_b, in_a = fp.estimates(x, y)
    both = len(shingles(a) & shingles(b))
    assert abs(likeness - exact(a, b)) < 0.14 and abs(in_b - both / len(shingles(a))) < 0.25 and abs(in_a - both / len(shingles(b))) < 0.25
    docs = spark.createDataFrame([(1, " ".join(text[:3000])), (2, " ".join(text[2996:])), (3, None)], "doc_id long, text string").repartition(3)
    prints = fp.fingerprints(docs).selectExpr("doc_id % 1 AS part", "fingerprint")
    whole = fp.merged(prints, "part").first()
    assert whole["fingerprint"] == fp.fingerprint(" ".join(text))
    pairs = spark.createDataFrame([(fp.packed(x), fp.packed(y)), (fp.packed(x), fp.packed(x)), ("", ""), ("", fp.packed(x)), (None, "")], "fingerprint string, other_fingerprint string")
    assert [r["likeness"] for r in fp.compared(pairs).collect()] == [likeness, 1.0, 1.0, 0.0, 1.0]
