"""op5 does no work twice, and none that no score needs."""

import numpy as np

from kelvinlake.llm import lm_score
from kelvinlake.llm.common import words


def test_context_positions_have_no_output():
    """Positions that are context alone give keys and values, but no hidden states; gradients through them are right."""
    rng = np.random.default_rng(5)
    code = lm_score.Coding(np.bincount(rng.zipf(1.4, 20_000) % 3000, minlength=lm_score.IDS).astype(float))
    m = {k: v.astype(float) for k, v in lm_score.initial(code.start).items()}
    ids = rng.zipf(1.4, (5, lm_score.WINDOW)) % 3000
    x, cls, leaf, live = rng.integers(0, lm_score.BUCKETS, ids.shape), code.cls[ids], code.leaf[ids], np.ones(ids.shape, bool)
    live[:4, : lm_score.OVERLAP] = False
    states = lm_score.hidden(m, x, np.array([4]))[-1]
    assert len(states) == live.sum()
    g, _ = lm_score.gradients(m, x, cls, leaf, live)
    for k, at in (("a", (1, 2)), ("a", (1, 20)), ("a", (3, 40)), ("o", (0, 5)), ("e", (x[0, 0], 1)), ("e", (x[4, 0], 1)), ("p", (2, 3)), ("p", (9, 3)), ("w", (cls[0, 9], 2, 1)), ("l", (cls[0, 9], leaf[0, 9]))):
        m[k][at] += 1e-5
        up = lm_score.gradients(m, x, cls, leaf, live)[1]
        m[k][at] -= 2e-5
        down = lm_score.gradients(m, x, cls, leaf, live)[1]
        m[k][at] += 1e-5
        assert abs(g[k][at] - (up - down) / 2e-5) < 1e-6


def test_blocks_hold_words_by_their_places(spark):
    """The blocks' table has no texts, yet gives back every word; a task whose texts fill more than a block begins another."""
    rows = [(i, " ".join(f"W{(i + j) % 60}" for j in range(600_000))) for i in range(16)] + [(100, None), (101, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    table = lm_score.in_blocks(docs, 3)
    assert "text" not in table.columns
    got = table.toPandas()
    listed = got[got["slice"].notna()]
    assert listed["block"].nunique() > 1
    place, n = {}, {}
    for block, own in listed.groupby("block"):
        at = np.frombuffer(b"".join(own["at"]), "<u4")
        assert sorted(at) == list(range(len(at)))
        place[block] = dict(zip(at.tolist(), [w for x in own["words"] for w in x.split(b" ")]))
        for w, c in zip(place[block].values(), np.frombuffer(b"".join(own["n"]), "<u4").tolist()):
            n[w] = n.get(w, 0) + c
    want, text = {}, dict(rows)
    for _, r in got[got["slice"].isna()].iterrows():
        ws = [place[r["block"]][i] for i in np.frombuffer(r["seq"], "<u4").tolist()] if r["seq"] else []
        assert ws == words(text[r["doc_id"]] or "")
        for w in set(ws) if r["train"] else ():
            want[w] = want.get(w, 0) + ws.count(w)
    assert n == want and len(got[got["slice"].isna()]) == len(rows)
