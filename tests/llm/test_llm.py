import base64
import hashlib
import json
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from kelvinlake.llm import bpe, embedding_dedup, line_dedup, lm_score, near_dedup, packing, quality, secret_scan, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
ROWS = [
    (1, f"{LONG}\nown one", "en", "a", 60), (2, f"  {LONG.upper()} \nown two", "en", "a", 60), (3, f"{LONG}\nown three", None, "a", 60), (3, f"{LONG}\nown three", None, "a", 60),
    (4, None, "en", None, None), (5, "", "en", "b", 0), (None, f"{LONG}\nx", "en", "b", 50), (6, "word " * 30000, "en", "b", 150000), (7, "short", "en", "b", 5),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_line_dedup(docs, none):
    got = {(r["row"]["doc_id"], r["kept_text"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert (3, f"{LONG}\nown three", 0) in got and (1, "own one", 1) in got and (2, "own two", 1) in got and (None, "x", 1) in got and (4, None, 0) in got
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_long_bitmaps(spark):
    lines = [f"this is a shared line number {i}" if i % 3 == 0 else f"own {i}" for i in range(200)]
    d = spark.createDataFrame([(i, "\n".join(x + (f" {i}" if x.startswith("own") else "") for x in lines)) for i in range(4)], "doc_id long, text string")
    got = {r["row"]["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(d).collect()}
    assert got == {0: 67, 1: 67, 2: 67, 3: 0}


def components(texts, k):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    root[i] = root[j] = min(root[i], root[j])
    return [len(s) for s in sets], root


def test_near_dedup(spark, docs, none):
    rng, texts = random.Random(3), []
    for g in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(60)]
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(60)] = f"x{rng.randrange(9999)}"
            texts.append(" ".join(copy))
    texts += ["one two", "one  Two", "", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes, want = components(texts, 4)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(d, shingle=4).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == want and [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    edge = near_dedup.near_duplicates(docs).collect()
    assert len(edge) == len(ROWS) and near_dedup.near_duplicates(none).count() == 0
    assert all(not r["kept"] for r in edge if r["doc_id"] is None)


def test_chosen_paths_reach_recall():
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(300):
        x = rng.integers(0, 2**63, 900, dtype=np.uint64)
        a, b = near_dedup.minwise(x[:800]), near_dedup.minwise(np.concatenate([x[:711], x[800:889]]))
        for tree in range(near_dedup.TREES):
            two, second = near_dedup.children(np.full(2, tree, np.uint64), np.stack([a, b]))
            if two[0, 0] == two[1, 0] or (second[0] and two[0, 1] == two[1, 1]):
                break
        else:
            missed += 1
    assert missed == 0


def test_secrets(docs, none):
    head = base64.urlsafe_b64encode(json.dumps({"alg": "HS256"}).encode()).decode().rstrip("=")
    ssh = base64.b64encode(b"\0\0\0\x0bssh-ed25519\0\0\0\x20" + bytes(32)).decode()
    der = base64.b64encode(b"\x30\x2e\x02\x01\x00\x30\x05\x06\x03\x2b\x65\x70\x04\x22\x04\x20" + bytes(32)).decode()
    text = f'token = "{"0a" * 20}" AKIA{"B" * 16} passwd:token:abcdef é {head}.e30.sig {ssh} {der} {"A" * 60}'
    kinds = Counter(s["kind"] for s in secret_scan.find_spans(text))
    assert kinds == {"assign": 1, "hex": 1, "access": 1, "jwt": 1, "ssh": 1, "der": 1}
    assert "AKIA" not in secret_scan.mask(text) and secret_scan.mask("plain words") == "plain words" and secret_scan.mask(None) is None
    assert secret_scan.scan_secrets(docs).count() == len(ROWS) and secret_scan.scan_secrets(none).count() == 0
    for s in secret_scan.find_spans(text):
        if s["kind"] == "jwt":
            assert text[s["start"] : s["end"]] == f"{head}.e30.sig"


def test_lm_base_score_and_windows(spark, docs, none):
    got = lm_score.score_documents(docs).toPandas()
    c, n = Counter(), 0
    for i, t, *_ in ROWS:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            c.update((t or "").lower().split() + ["<end>"])
    n, v = sum(c.values()), len(c)
    want = sorted(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in (t or "").lower().split() + ["<end>"]) for _, t, *_ in ROWS)
    assert np.allclose(sorted(got["base_score"]), want) and (got["train_tokens"] == n).all() and np.isfinite(got["score"]).all()
    assert lm_score.score_documents(none).count() == 0
    start, size, scored = lm_score.windows(np.array([1, 24, 25, 60]))
    assert sum(size - scored) == 1 + 24 + 25 + 60 and max(size) == lm_score.WINDOW


def lm_setting(seed=0):
    rng = np.random.default_rng(seed)
    code = lm_score.Coding(np.bincount(rng.zipf(1.4, 20_000) % 3000, minlength=lm_score.IDS).astype(float))
    m = {k: v.astype(float) for k, v in lm_score.initial(code.start).items()}
    return rng, code, m


def test_lm_gradients():
    rng, code, m = lm_setting()
    ids = rng.zipf(1.4, (4, lm_score.WINDOW)) % 3000
    x, cls, leaf, live = rng.integers(0, lm_score.BUCKETS, ids.shape), code.cls[ids], code.leaf[ids], rng.random(ids.shape) < 0.8
    g, _ = lm_score.gradients(m, x, cls, leaf, live)
    for k, at in (("a", (1, 2)), ("a", (1, 20)), ("a", (3, 40)), ("o", (0, 5)), ("c", (2, 2)), ("b", (3,)), ("e", (x[0, 0], 1)), ("p", (2, 3)), ("w", (cls[0, 0], 2, 1)), ("l", (cls[0, 0], leaf[0, 0]))):
        m[k][at] += 1e-5
        up = lm_score.gradients(m, x, cls, leaf, live)[1]
        m[k][at] -= 2e-5
        down = lm_score.gradients(m, x, cls, leaf, live)[1]
        m[k][at] += 1e-5
        assert abs(g[k][at] - (up - down) / 2e-5) < 1e-6


def plain_score(m, code, ids):
    """One sequence by loops over its ids: each from the window that scores it, attention and both softmaxes written out."""
    size, total = lm_score.DIM, 0.0
    stride = lm_score.WINDOW - lm_score.OVERLAP
    given = [lm_score.END, *ids[:-1]]
    for t, i in enumerate(ids):
        first = 0 if t < lm_score.WINDOW else (t - lm_score.OVERLAP) // stride * stride
        h = [m["e"][code.bucket[x]] + m["p"][k] for k, x in enumerate(given[first : t + 1])]
        q, keys, values = h[-1] @ m["a"][:, :size], [x @ m["a"][:, size : 2 * size] for x in h], [x @ m["a"][:, 2 * size :] for x in h]
        weights = np.exp([q @ k for k in keys])
        top = h[-1] + (weights / weights.sum() @ np.array(values)) @ m["o"]
        z, c = top @ m["c"] + m["b"], code.cls[i]
        w = top @ m["w"][c] + m["l"][c]
        total += z[c] - np.log(np.exp(z).sum()) + w[code.leaf[i]] - np.log(np.exp(w).sum()) + code.within[i] * np.log(10)
    return total / np.log(10)


def test_lm_score_by_brute_force():
    rng, code, m = lm_setting(3)
    # one id's chance: classes, leaves and shares of a leaf add up to one
    assert abs(sum(10 ** code.within[(code.cls == 5) & (code.leaf == lm_score.LEAVES - 1)]) - 1) < 1e-9
    sizes = np.array([1, 5, lm_score.WINDOW, lm_score.WINDOW + 1, 100])
    seqs = [np.append(rng.zipf(1.4, n - 1) % 3000, lm_score.END) for n in sizes]
    got = lm_score.sequence_scores(m, code, np.concatenate(seqs), sizes)
    assert np.allclose(got, [plain_score(m, code, s.tolist()) for s in seqs])


def test_lm_beats_the_unigram_where_context_tells(spark):
    """Held-out texts that keep to one of four sets of syllables: the model's score is above the base score."""
    rng = random.Random(1)
    sets = [("na", "ter"), ("ing", "lo"), ("che", "ver"), ("und", "est")]
    word = lambda s: "".join(rng.choice(s) for _ in range(rng.randint(4, 6)))
    rows = [(i, " ".join(word(s) for _ in range(120))) for i in range(400) for s in [rng.choice(sets)]]
    out = lm_score.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert out["sum(score)"] > out["sum(base_score)"]


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(20, 24))
    x = np.concatenate([base, base + 0.05 * rng.normal(size=(20, 24)), base[:3], np.zeros((1, 24))]).astype(np.float32)
    rows = [(i, [float(v) for v in e], int(i % 20 % 3)) for i, e in enumerate(x)] + [(90, None, 1), (91, [float("nan")] * 24, 1), (92, [1.0] * 24, None), (93, [1.0, None], 1), (None, [float(v) for v in x[0]], 0)]
    got = {r["vec_id"]: r for r in embedding_dedup.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    v = x[:43].astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    lab = np.array([i % 20 % 3 for i in range(43)])
    links = (v @ v.T >= 0.98) & (lab[:, None] == lab) & ~np.eye(43, dtype=bool)
    assert [got[i]["n_links"] for i in range(1, 20)] == links[1:20].sum(1).tolist()
    assert got[0]["n_links"] == links[0].sum() + 1 and got[90]["n_links"] == got[91]["n_links"] == got[92]["n_links"] == got[43]["n_links"] == 0
    assert got[None]["component_id"] == 0 and got[90]["kept"]
    assert embedding_dedup.similar_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_quality(docs, none):
    text = "a b c d a b c x x\n a\n a"
    s = dict(zip([c.split()[0] for c in quality.STATS.split(", ")], quality.text_stats(text)))
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    three = Counter(zip(w, w[1:], w[2:]))
    cover = {i + k for i in range(len(w) - 2) for k in range(3) if three[tuple(w[i : i + 3])] > 1}
    assert (s["n_words"], s["word_chars"], s["n_repeat_words"], s["n_dup_lines"]) == (len(w), sum(map(len, w)), len(cover), 1)
    assert quality.judge_quality(docs).count() == len(ROWS) and quality.judge_quality(none).count() == 0


def test_bpe_round_trip():
    from tokenizers import Tokenizer

    t, b = Tokenizer.from_file(bpe.VOCABULARY), bpe.loaded(bpe.VOCABULARY)
    rng = random.Random(1)
    texts = ["", "a" * 999, "<|endoftext|>x"] + ["".join(rng.choice(["a", " the", "\n", " ", "é", "中", "'s", "12", "<|endoftext|>", "😀"]) for _ in range(40)) for _ in range(200)]
    for text, pieces in zip(texts, b.encode_batch(texts)):
        ids = [i for p in pieces for i in p]
        assert ids == t.encode(text, add_special_tokens=False).ids and b.decode(ids) == t.decode(ids, skip_special_tokens=False)


def test_bpe_and_packing_tables(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.VOCABULARY)
    for r in bpe.round_trip(docs).collect():
        text = next(x or "" for i, x, *_ in ROWS if i == r["doc_id"])
        ids = t.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    p = packing.pack_documents(docs).toPandas().sort_values(["sequence_id", "offset"])
    for _, s in p.groupby("sequence_id"):
        assert s["offset"].tolist() == (s["length"].cumsum() - s["length"]).tolist() and s["length"].sum() <= 2048
    assert p["length"].sum() == sum(len(t.encode(x or "").ids) + 1 for _, x, *_ in ROWS)
    six = p[p["doc_id"] == 6].sort_values("start")
    ids = np.array(t.encode(ROWS[7][1]).ids + [1], "<u4")
    assert all(zlib.crc32(ids[a : a + n]) == crc for a, n, crc in zip(six["start"], six["length"], six["ids_crc32"]))
    assert bpe.round_trip(none).count() == 0 and packing.pack_documents(none).count() == 0


def test_toxicity(spark, docs, none):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(30)) + (" idiot scum" if i % 5 == 0 else "")) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(d, labels)
    p = {r["doc_id"]: r["toxicity"]["p_toxic"] for r in toxicity.grade_toxicity(d, model).collect()}
    assert sum((p[i] >= 0.5) != (i % 5 == 0) for i in range(300, 400)) == 0
    empty = toxicity.fit_toxicity(none, labels)
    assert all(r["toxicity"]["severity"] == 0 for r in toxicity.grade_toxicity(docs, empty).collect())


def test_urls(spark):
    rows = [(1, "http://A.example.ORG/es/1?x=1"), (2, None), (3, "no scheme"), (4, "x://b.com/fr/2"), (5, "x://b.com/de/2"), (6, "x://org"), (7, "x://notorg/"), (7, "x://notorg/")]
    got = {r["page_id"]: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert [got[i]["rule"] for i in (2, 3, 4, 5, 6, 7)] == [None, None, "com/fr/", "com/de/", None, None]
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    assert ((url_filter.Trees(x[:1500], y[:1500]).probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95


CLASHING = DOCS + ", row string, toxicity string, secret_spans int, _id long, text_key long, kept boolean, keep string"


def clashing(rows):
    return [(*r, "r", "t", 1, 2, 3, True, "k") for r in rows]


@pytest.mark.parametrize("rows", [[], ROWS, [(1, None, None, None, None), (1, "", "", "", 0), (None, None, None, None, None)]], ids=["empty", "mixed", "blank"])
def test_pipeline_stages_on_odd_tables(spark, tmp_path, rows):
    spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(clashing(rows), CLASHING)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    kept = docs.collect()
    assert len(kept) <= len(rows) and all((r["row"], r["_id"], r["kept"]) == ("r", 2, True) for r in kept)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.filter("start = 0").count() == len(kept)


def test_pipeline_by_brute_force(spark, tmp_path):
    """run() against plain forms of its stages: what stays, and that the windows hold the masked texts' ids."""
    from tokenizers import Tokenizer

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    shared = "this very line is found in many documents of the corpus"
    rows = []
    for i in range(160):
        text = " ".join(word() for _ in range(60))
        if i % 5 == 1 and (i - 1) % 8:
            ws = rows[-1][1].split("\n")[0].split()
            ws[rng.randrange(len(ws))] = "changed"
            text = " ".join(ws)
        text += f"\n{shared}" * (i % 3 == 0) + " vilely scum" * (i % 8 == 0) + f"\npassword = hunter{i:04}" * (i % 7 == 2)
        rows.append((i, text))
    rows += [(None, rows[3][1]), (300, rows[5][1]), (301, None)]
    labels = [(i, 1, int(i % 8 == 0)) for i in range(0, 120)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "cast(length(text) as long) n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs = [(i, t) for i, t in rows if "vilely" not in (t or "")]
    holders = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            k = x.strip(" \t\n\x0b\x0c\r").lower()
            if len(k) >= 20:
                holders.setdefault(k, set()).add(-1 if i is None else i)
    gone = lambda x, i: len(h := holders.get(x.strip().lower(), ())) >= 3 and max(h) != i
    docs = [(i, t if t is None else "\n".join(x for x in t.split("\n") if not gone(x, i))) for i, t in docs]
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0))
    docs = [docs[k] for k in order]
    _, root = components([t for _, t in docs], 5)
    docs = [d for k, d in enumerate(docs) if root[k] == k]
    t = Tokenizer.from_file(packing.public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: np.array(t.encode(secret_scan.mask(x) or "", add_special_tokens=False).ids + [1], "<u4") for i, x in docs}
    assert len(want) < 130 and any("[SECRET]" in (secret_scan.mask(x) or "") for _, x in docs)

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == set(want)
    assert all(zlib.crc32(want[r["doc_id"]][r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] and r["doc_tokens"] == len(want[r["doc_id"]]) for r in out)
    assert sum(r["length"] for r in out) == sum(map(len, want.values()))


@pytest.mark.parametrize("name", ["op2_near_dedup", "op3_line_dedup", "op6_embedding_dedup", "url_rules", "quality_counts"])
def test_sql(spark, name):
    from kelvinlake.llm.queries import ORACLES, QUERIES

    c = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        c.sql(f"create view {table} as select * from '/root/testdata/sf0.001/{table}.parquet'")
    got, want = QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), c.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(got.astype(str).itertuples(index=False, name=None)) == sorted(want[got.columns].astype(str).itertuples(index=False, name=None))


def test_near_dedup_intersections():
    rng = np.random.default_rng(4)
    pool = np.unique(rng.integers(0, 2**48, 6000, dtype=np.uint64))
    sets = [np.sort(rng.choice(pool[:n], n // 2, replace=False)) for n in [40] * 40 + [len(pool)] * 30 + [2]]
    same = near_dedup.intersections(sets)
    assert all(same[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(len(sets)) for j in range(i + 1, len(sets)))


def test_near_dedup_large_nodes(spark, monkeypatch):
    """Near copies around 0.8 in nodes that branch and are dealt into blocks, against all pairs."""
    for name, value in {"PAIRED": 4, "LEAF": 12, "DEPTH": 2}.items():
        monkeypatch.setattr(near_dedup, name, value)
    rng = random.Random(8)
    text = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        own = list(text)
        for _ in range(rng.randint(2, 7)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    sets = [near_dedup.shingle_set(t, 4) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same = len(np.intersect1d(sets[i], sets[j]))
            if 100 * same >= 80 * (len(sets[i]) + len(sets[j]) - same):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()}
    assert 1 < len(set(root)) < len(rows) and got == dict(enumerate(root))


def test_line_dedup_very_long_and_hot(spark):
    """Texts of 60,000 lines in linear time; a line that most rows repeat, which is broadcast to its rows."""
    n = 60_000
    long = [(i, "\n".join(f"shared line with number {j}" if j % 2 else f"own {i} {j}" for j in range(n))) for i in range(3)]
    hot = [(100 + i, "\n".join(["this line stands in every document"] * 3 + [f"and this one only in {i:05}"])) for i in range(50)]
    got = {r["row"]["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(long + hot, "doc_id long, text string")).collect()}
    assert [got[i]["n_dropped"] for i in range(3)] == [n // 2, n // 2, 0]
    assert got[0]["kept_text"] == "\n".join(f"own 0 {j}" for j in range(0, n, 2)) and got[2]["kept_text"] == long[2][1]
    assert all(got[100 + i]["n_dropped"] == 3 and got[100 + i]["kept_text"] == f"and this one only in {i:05}" for i in range(49)) and got[149]["n_dropped"] == 0


def test_near_dedup_without_ids(spark):
    """Rows without doc_id link and bridge like others; rows that share an id and not a text stay apart."""
    words = [f"w{i}" for i in range(60)]
    near = lambda *at: " ".join(f"x{i}" if i in at else w for i, w in enumerate(words))
    rows = [(1, near()), (None, near(59)), (None, near(0, 59)), (2, near(0, 1, 59)), (3, "another text " + " ".join(f"y{i}" for i in range(50))), (3, near(58, 59)), (None, " ".join(f"z{i}" for i in range(40))), (None, " ".join(f"z{i}" for i in range(40)))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()
    assert sorted(((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got)) == [(0, 0, False), (0, 0, False), (0, 1, False), (0, 1, False), (1, 1, True), (2, 1, False), (3, 1, False), (3, 3, True)]


# --- against plain, independent forms -----------------------------------------------------------------------------


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else b"\x82" + n.to_bytes(2, "big")) + body


def ssh(body):
    return len(body).to_bytes(4, "big") + body


def keys():
    algorithm = der(0x30, der(6, b"\x2b\x65\x70"))
    public = ssh(b"ssh-ed25519") + ssh(bytes(32))
    return {
        "pkcs8": ("der", der(0x30, der(2, b"\0") + algorithm + der(4, der(4, bytes(range(32)))))),
        "encrypted": ("der", der(0x30, algorithm + der(4, bytes(range(48))))),
        "rsa": ("der", der(0x30, b"".join(der(2, b"\1" * n) for n in (1, 128, 3, 128, 64, 64, 64, 64, 64)))),
        "sec1": ("der", der(0x30, der(2, b"\1") + der(4, bytes(32)) + der(0xA0, der(6, b"\x2a\x86")))),
        "ssh": ("ssh", public),
        "file": ("ssh", b"openssh-key-v1\0" + ssh(b"none") + ssh(b"none") + ssh(b"") + (1).to_bytes(4, "big") + ssh(public) + ssh(bytes(100))),
    }


@pytest.mark.parametrize("name", list(keys()))
def test_keys_in_every_writing(name):
    kind, data = keys()[name]
    kinds = lambda text: {s["kind"] for s in secret_scan.find_spans(text)} - {"hex", "assign"}
    text = base64.b64encode(data).decode()
    rows = lambda end: end.join(text[i : i + 64] for i in range(0, len(text), 64))
    assert kinds(text) == kinds(data.hex()) == kinds(data.hex().upper()) == {kind}
    assert kind in kinds("see\n" + rows("\n") + "\nand more words")
    for end in ("\n", "\\n"):
        assert "pem" in kinds(f"-----BEGIN SOME KEY-----{end}Comment: mine{end}{end}{rows(end)}{end}-----END SOME KEY-----")
    for bad in (data[:-3], data + b"\0", data[:1] + b"\x7f" + data[2:]):
        assert not kinds(base64.b64encode(bad).decode()) and not kinds(bad.hex())
    assert not kinds("-----BEGIN SOME KEY-----\n" + base64.b64encode(bytes(300)).decode() + "\n-----END SOME KEY-----")


def plain_spans(text):
    """The base kinds by a scan of characters, without patterns."""
    out, n, low = [], len(text), text.lower()
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    i = 0
    while i < n:
        hit = None
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(word, i) and text[i : i + len(word)].isascii():
                j = i + len(word)
                j += j < n and text[j] in "\"'"
                while j < n and text[j] == " ":
                    j += 1
                if j < n and text[j] in ":=":
                    j += 1
                    while j < n and text[j] == " ":
                        j += 1
                    k = j + (j < n and text[j] in "\"'")
                    end = k
                    while end < n and text[end] in value:
                        end += 1
                    if end > k:
                        hit = (end, end - k >= 6)
                break
        if hit:
            out += [(i, 0, "assign", hit[0])] * hit[1]
        i = hit[0] if hit else i + 1
    for kind, rank, first, rest, least in (("access", 1, "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), ("hex", 2, "", "0123456789abcdef", 24)):
        i = 0
        while i < n:
            end = i + len(first)
            if text.startswith(first, i):
                while end < n and text[end] in rest:
                    end += 1
            if text.startswith(first, i) and end > i + len(first):
                out += [(i, rank, kind, end)] * (end - i >= least)
                i = end
            else:
                i += 1
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_secret_query_by_brute_force(spark, tmp_path):
    rng = random.Random(11)
    bits = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", " ", "=", ":", '"', "'", "AKIA", "ABCDEFGH12345678", "0a1b2c3d4e5f", "deadbeef" * 3, "é", "\n", "x", "value1", "-", "ſecret"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(60)))) for i in range(400)] + [(None, "token=abcdef"), (900, None), (901, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r["doc_id"] or -1, r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in secret_scan.op4_secret_scan(spark, str(tmp_path)).collect()))
    want = []
    for i, text in rows:
        spans = plain_spans(text or "")
        want.append((i or -1, spans.count("assign:"), spans.count("access:"), spans.count("hex:"), hashlib.sha256(spans.encode()).hexdigest()))
    assert got == sorted(want)


def test_packing_query_by_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "of", "<|endoftext|>"]) for _ in range(int(rng.lognormvariate(5, 1))))) for i in range(600)] + [(None, "no id"), (700, None), (701, "words " * 9000)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    out = packing.op10_packing(spark, str(tmp_path)).toPandas().sort_values(["sequence_id", "offset"])
    t = Tokenizer.from_file(packing.public_tokenizers.path("byte_bpe_50k.json"))
    ids_of = {i: t.encode(x or "", add_special_tokens=False).ids + [1] for i, x in rows}
    for i, own in out[out["doc_id"].notna()].groupby("doc_id"):
        own = own.sort_values("start")
        assert own["start"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() == len(ids_of[i])
        assert all(n == len(ids_of[i]) and zlib.crc32(np.array(ids_of[i][a : a + k], "<u4")) == c for a, k, c, n in zip(own["start"], own["length"], own["ids_crc32"], own["doc_tokens"]))
    sizes = out.groupby("sequence_id")["length"].sum()
    assert set(sizes[:-1]) <= {2048, 1024, 512, 256} and len(sizes) > 60 and len(set(sizes)) > 2
    assert all(s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] for _, s in out.groupby("sequence_id"))
    cut = out[out["doc_tokens"] <= 2048].groupby("doc_id").size()
    assert (cut > 1).mean() < 0.2


def test_quality_query_by_brute_force(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice(["one", "two", "THREE", "fo#ur", " ", "\n", "\t", "é", "$%", "one two\none two\n", "\x0b"]) for _ in range(rng.randrange(200)))) for i in range(120)] + [(None, "a b c a b c"), (500, None), (501, ""), (502, "x " * 30_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        three = Counter(zip(w, w[1:], w[2:]))
        cover = {k + j for k in range(len(w) - 2) for j in range(3) if three[tuple(w[k : k + 3])] > 1}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        want.append((i or -1, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover), failed))
    out = quality.op7_quality(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or -1, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out) == sorted(want)
    assert not any(r["kept"] and r["base_failed"] for r in out)


def test_url_query_by_brute_force(spark, tmp_path):
    rng = random.Random(7)
    bits = ["http", "://", "example", ".", "org", "com", "/", "es", "en", "fr", "de", "1", "?", "#", "É", "EXAMPLE", "net"]
    urls = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(300)] + [f"x://{h}{p}" for h in ("org", "a.org", "example.org", "b.example.org", "com", "a.com", "aorg") for p in ("", "/", "/es/1", "/en/1", "/en/2", "/fr/x", "/de/y?q#f")] + [None, ""]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    for r in url_filter.op1_url_filter(spark, str(tmp_path)).collect():
        rest = (urls[r["page_id"]] or "").partition("://")[2]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(rule, verdict) for rule, verdict in url_filter.RULES for name, _, tail in [rule.partition("/")] if (host == name or host.endswith("." + name)) and path.startswith("/" + tail)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (verdict or r["verdict"]) and r["verdict"] in ("allow", "block")


def test_toxicity_by_brute_force(spark, tmp_path):
    """The grades of the query from sigmoids over each text's own terms; and the fit against its loss at other weights."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    rows = [(i, " ".join(word() for _ in range(20)) + " vilely" * (i % 4 == 0) + " Scum-like fools" * (i % 8 == 0)) for i in range(300)] + [(None, "vilely"), (900, None), (901, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(240)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.fit_toxicity(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert {"vilely", "vile*", "scum", "fools", "fool*"} <= set(model.terms) and (np.diff(model.thresholds) >= 0).all()
    for r in toxicity.op9_toxicity(spark, str(tmp_path)).collect():
        text = next(t for i, t in rows if i == r["doc_id"]) or ""
        ws = {w for w in re.findall(r"[^\W\d_]+", text.lower())}
        held = {t for w in ws for t in [w, *(w[:k] + "*" for k in (4, 5, 6) if len(w) > k)]} & set(model.terms)
        above = 1 / (1 + np.exp(model.thresholds - sum(model.weights[model.terms[t]] for t in held)))
        assert abs(r["p_toxic"] - above[0]) < 1e-5 and abs(r["severity"] - above.sum()) < 1e-5 and r["toxic"] == (above[0] >= 0.5)
        assert r["grade"] == int(np.floor(above.sum() + 0.5)) and (r["doc_id"] is None or r["toxic"] == (text != "" and r["doc_id"] % 4 == 0))


def test_embeddings_keep_their_precision(spark):
    """Double vectors whose cosine differs from the threshold beyond single precision; labels beyond 32 bits."""
    angle = np.arccos(0.98)
    pairs = [(float(np.cos(angle * k)), float(np.sin(angle * k))) for k in (1 - 1e-9, 1 + 1e-9)]
    rows = [(0, [1.0, 0.0], 2**40), (1, list(pairs[0]), 2**40), (2, [1.0, 0.0], 2**41), (3, list(pairs[1]), 2**41), (4, [1.0, 0.0], 7)]
    got = embedding_dedup.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {0: (1, 0), 1: (1, 0), 2: (0, 2), 3: (0, 3), 4: (0, 4)}


def test_embedding_tiles(spark, monkeypatch):
    """Dense cells of several tiles, in few dimensions, against all pairs."""
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    monkeypatch.setattr(embedding_dedup, "STRIP", 7)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 4)).astype(np.float32)
    rows = [(i, [float(c) for c in v], "ab"[i % 2]) for i, v in enumerate(x)]
    v = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = (v @ v.T >= 0.98) & (np.arange(400)[:, None] % 2 == np.arange(400) % 2) & ~np.eye(400, dtype=bool)
    root = np.arange(400)
    for _ in range(400):
        least = np.array([root[[i, *np.flatnonzero(links[i])]].min() for i in range(400)])
        if (least == root).all():
            break
        root = least
    got = {r["vec_id"]: r for r in embedding_dedup.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")).collect()}
    assert [got[i]["n_links"] for i in range(400)] == links.sum(1).tolist() and [got[i]["component_id"] for i in range(400)] == root.tolist()


def test_join_keys_is_an_inner_join(spark):
    """A hot key (half of all rows), rare keys, keys without a partner on either side."""
    from kelvinlake.llm.common import join_keys

    rows = spark.createDataFrame([(i, 0 if i % 2 else i, b"x") for i in range(4000)], "id int, k int, raw binary")
    per_key = rows.groupBy("k").count().withColumnRenamed("count", "n").filter("k % 3 = 0 or k = 2").unionByName(spark.createDataFrame([(-5, 1)], "k int, n long"))
    got = join_keys(rows, per_key, ["k"], "n", 4000)
    assert got.columns == ["id", "k", "raw", "n"]
    assert sorted(map(tuple, got.select("id", "k", "n").collect())) == sorted(map(tuple, rows.join(per_key, "k").select("id", "k", "n").collect()))
