"""Operators on rows in order: results do not depend on batches or late rows, and state stays bounded."""

import pickle
import random

import pytest

from kelvinlake.functions import scalar as S
from kelvinlake.streaming.ordered import Imputation, Runs


def fed(processor, rows, seed, delay):
    """Rows in batches of random sizes and order, none later than `delay` behind the latest before its batch; a watermark after each. Yields (results, bytes of state)."""
    rnd = random.Random(seed)
    own, waiting, watermark, top = processor.fresh(), [], 0, 0
    out, sizes = [], []
    late = sorted(rows, key=lambda r: (r[0] + rnd.randint(0, delay), r[1]))  # the order of arrival
    at = 0
    while at < len(late):
        batch = late[at : at + rnd.randint(1, 40)]
        at += len(batch)
        assert all(r[0] > watermark for r in batch)
        waiting += batch
        top = max(top, *(r[0] for r in batch))
        watermark = max(watermark, top - delay - 1)
        done = sorted((r for r in waiting if r[0] <= watermark), key=lambda r: r[:2])
        waiting = [r for r in waiting if r[0] > watermark]
        out += processor.advance("u", own, done, watermark)
        sizes.append(len(pickle.dumps((own, waiting))))
    out += processor.advance("u", own, sorted(waiting, key=lambda r: r[:2]), top + 400 * S.DAY_MS)
    return out, sizes


def filled(rows, i, span):
    """The rule of imputation, cell by cell."""
    out = []
    for k, r in enumerate(rows):
        p = next((x for x in reversed(rows[:k]) if x[2 + i] is not None), None)
        n = next((x for x in rows[k + 1 :] if x[2 + i] is not None), None)
        if r[2 + i] is not None:
            out.append(r[2 + i])
        elif p and n and n[0] - p[0] <= span:
            out.append(p[2 + i] + (n[2 + i] - p[2 + i]) * ((r[0] - p[0]) / (n[0] - p[0])))
        else:
            out.append((p or n or r)[2 + i])
    return out


@pytest.mark.parametrize("seed", range(6))
def test_imputation(seed):
    rnd = random.Random(seed)
    rows, at = [], 1
    for k in range(800):
        at += rnd.choice([1, 30, 30, 30, 200]) * 60_000
        rows.append((at, k, None if rnd.random() < 0.4 or 200 < k < 230 else rnd.random(), None if k < 3 or k % 2 else float(k), None))
    got, sizes = fed(Imputation(["a", "b", "c"], 30.0), rows, seed, 3 * 3_600_000)
    want = list(zip([r[0] for r in rows], *(filled(rows, i, 4 * 30 * 60_000) for i in range(3))))
    assert sorted((r[1], *r[3:]) for r in got) == want
    # rows without any value of c wait for it a day and no longer, so state levels off
    assert max(sizes[len(sizes) // 2 :]) < 1.5 * max(sizes[: len(sizes) // 2])


def runs_of(rows, threshold, rescue, join=12):
    cand = [k for k, r in enumerate(rows, 1) if k > S.WARMUP and r[2] is not None and r[2] > threshold]
    groups = []
    for k in cand:
        if groups and k - groups[-1][-1] <= join + 1:
            groups[-1].append(k)
        else:
            groups.append([k])
    out = []
    for g in groups:
        s, e = g[0], g[-1]
        if s == e and rows[s - 1][2] <= rescue:
            continue
        score = {k: min(1.0, (rows[k - 1][2] if rows[k - 1][2] is not None else -1.0) + 0.03 * min(1.0, (e - s + 1) / 10)) for k in range(s, e + 1)}
        peak = max(score, key=lambda k: (score[k], -k))
        out.append(("u", s, e, rows[s - 1][0], rows[e - 1][0], score[peak], peak, rows[peak - 1][0]))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs(seed):
    rnd = random.Random(seed)
    rows, level = [], 0.3
    for k in range(3000):
        level = rnd.choice([level, level, level, 0.3, 0.9, 0.99]) if k % 3 == 0 else level
        raw = None if rnd.random() < 0.02 else min(1.0, level * rnd.choice([1, 1, 0.5, 1.005]))
        rows.append((1 + k * 1_800_000, k, raw, 0.85, 0.95))
    got, sizes = fed(Runs(idle_ms=400 * S.DAY_MS), rows, seed, 5 * 3_600_000)
    assert got == runs_of(rows, 0.85, 0.95) and len(got) > 10
    assert max(sizes) < 20_000


def test_a_long_run_is_kept_small():
    rows = [(1 + k * 60_000, k, 0.9, 0.5, 0.95) for k in range(20_000)]
    got, sizes = fed(Runs(idle_ms=400 * S.DAY_MS), rows, 1, 600_000)
    assert [(r[1], r[2]) for r in got] == [(97, 20_000)] and max(sizes) < 20_000


def test_many_open_rows_stay_linear():
    """Rows whose cells no value reaches wait together: each was gone through again for every row behind it, which took more than 45 s."""
    import time

    rows = [(1 + k * 10_000, k, float(k), None) for k in range(20_000)]
    p, got, began = Imputation(["a", "b"], 30.0), [], time.process_time()
    own = p.fresh()
    for lo in range(0, len(rows), 1_000):
        got += p.advance("u", own, rows[lo : lo + 1_000], rows[lo : lo + 1_000][-1][0])
    got += p.advance("u", own, [], 400 * S.DAY_MS)
    assert sorted((r[2], *r[3:]) for r in got) == [(k, float(k), None) for k in range(20_000)]
    assert time.process_time() - began < 15


def test_cells_between_values_of_one_time():
    rows = [(60_000, 1, 5.0), (60_000, 2, None), (60_000, 3, 9.0)]
    got, _ = fed(Imputation(["a"], 30.0), rows, 1, 1)
    assert sorted((r[2], r[3]) for r in got) == [(1, 5.0), (2, 5.0), (3, 9.0)]


class Handle:
    """A unit's state, as the processor sees it, with the number of pieces that were read since the last look."""

    def __init__(self):
        self.value, self.pieces, self.timers = None, {}, set()

    def getValueState(self, name, schema):
        handle = self

        class Value:
            exists = staticmethod(lambda: handle.value is not None)
            get = staticmethod(lambda: handle.value)
            update = staticmethod(lambda v: setattr(handle, "value", v))

        return Value()

    def getMapState(self, name, key, value):
        handle = self

        class Map:
            updateValue = staticmethod(lambda k, v: handle.pieces.__setitem__(k, v))
            getValue = staticmethod(lambda k: handle.pieces[k])
            removeKey = staticmethod(lambda k: handle.pieces.pop(k))

        return Map()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def test_waiting_rows_lie_outside_of_memory(monkeypatch):
    """What is unpickled with a unit's state does not grow with its waiting rows, and rows are handed on some at a time."""
    import pandas as pd

    from kelvinlake.streaming import ordered

    monkeypatch.setattr(ordered, "CHUNK", 500)
    seen = []

    class Watched(Imputation):
        def advance_frame(self, unit, own, rows, upto):
            seen.append(len(rows))
            return super().advance_frame(unit, own, rows, upto)

    p, handle = Watched(["a"], 30.0), Handle()
    p.init(handle)
    rows = pd.DataFrame({"ts_ms": [1 + k * 60_000 for k in range(10_000)], "row_ord": range(10_000), "a": [None if k % 7 == 0 else float(k) for k in range(10_000)]})
    mixed = rows.sample(frac=1.0, random_state=3)

    class Watermark:
        def __init__(self, at):
            self.getCurrentWatermarkInMs = lambda: at

    assert list(p.handleInputRows(("u",), iter([mixed[:6_000], mixed[6_000:]]), Watermark(0))) == []
    assert len(handle.value[0]) < 20_000 and len(handle.pieces) > 100
    got = pd.concat(list(p.handleExpiredTimer(("u",), Watermark(400_000_030), None)) + list(p.handleExpiredTimer(("u",), Watermark(10**12), None)))
    assert got["row_ord"].tolist() == list(range(10_000)) and not handle.pieces and max(seen) < 700
    assert got["a"].iloc[7] == pytest.approx(7.0) and got["a"].iloc[0] == 1.0
