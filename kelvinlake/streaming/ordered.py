"""Operators that need a unit's rows in the order of their times, on streams: imputation with look-ahead, and runs.

Rows wait in a unit's state until the watermark has passed them, so that rows that come late (within its delay) still stand
in their place; then they are handed on in order. Event-time timers wake units that get no more rows. A unit's state holds
the rows within the delay, and what the operator says it keeps; nothing grows with the length of the stream. The rows lie in
the state store by slices of time and come into memory about CHUNK at a time, a slice at least. A heartbeat, a row of no
unit far ahead, moves the watermark on and drains all units.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from kelvinlake.functions import scalar as S

HEARTBEAT = "\u0000heartbeat"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows that are put away, and taken in order, at once; and the length of a slice.
CHUNK, SLICE_MS = 100_000, 3_600_000


class InOrder(StatefulProcessor):
    """columns: names of the input's columns behind equipment_id, ts_ms and row_ord first; output: names of the result's."""

    columns: list[str]
    output: list[str]

    def fresh(self) -> dict:
        """The operator's own state of a unit at first."""
        raise NotImplementedError

    def advance(self, unit: str, own: dict, rows: list[tuple], upto: int) -> Iterator[tuple]:
        """Takes rows in order, all of times up to `upto`, behind which others follow; yields results."""
        raise NotImplementedError

    def advance_frame(self, unit: str, own: dict, rows: pd.DataFrame, upto: int) -> pd.DataFrame:
        """advance() of a frame of ts_ms, row_ord and the columns."""
        columns = [rows[c].astype(object).where(rows[c].notna(), None).tolist() for c in self.columns]
        out = list(self.advance(unit, own, list(zip(rows["ts_ms"].tolist(), rows["row_ord"].tolist(), *columns)), upto))
        return pd.DataFrame(out, columns=self.output)

    def waits_for(self, own: dict) -> int | None:
        """The time at whose passing something is to be given out though no row comes."""
        raise NotImplementedError

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("unit", "data binary")
        self.slices = handle.getMapState("slices", "slice long, n int", "data binary")

    def _put(self, held: dict, rows: pd.DataFrame) -> None:
        """Puts rows away by slices. held["slices"]: how many pieces each slice lies in, and its least time."""
        for at, piece in rows.groupby(rows["ts_ms"] // SLICE_MS, sort=False):
            n, least = held["slices"].get(at, (0, None))
            first = int(piece["ts_ms"].min())
            self.slices.updateValue((int(at), n), (pickle.dumps([piece[c].to_numpy() for c in ("ts_ms", "row_ord", *self.columns)]),))
            held["slices"][int(at)] = (n + 1, first if least is None else min(least, first))

    def _taken(self, held: dict, at: int, upto: int) -> pd.DataFrame:
        """The rows of a slice up to a time in order; those behind it are put away again."""
        pieces = []
        for i in range(held["slices"].pop(at)[0]):
            pieces.append(pickle.loads(self.slices.getValue((at, i))[0]))
            self.slices.removeKey((at, i))
        names = ("ts_ms", "row_ord", *self.columns)
        rows = pd.DataFrame({c: np.concatenate([p[i] for p in pieces]) for i, c in enumerate(names)})
        done = rows["ts_ms"] <= upto
        if not done.all():
            self._put(held, rows[~done])
            rows = rows[done]
        return rows.sort_values(["ts_ms", "row_ord"], kind="stable")

    def _step(self, key: tuple, batches: Iterator[pd.DataFrame], upto: int) -> Iterator[pd.DataFrame]:
        held = pickle.loads(self.state.get()[0]) if self.state.exists() else {"slices": {}, "own": self.fresh(), "timer": None}
        waiting, n = [], 0
        for pdf in batches:
            waiting.append(pdf)
            n += len(pdf)
            if n >= CHUNK:
                self._put(held, pd.concat(waiting))
                waiting, n = [], 0
        if waiting:
            self._put(held, pd.concat(waiting))
        none = pd.DataFrame({c: [] for c in ("ts_ms", "row_ord", *self.columns)}).astype({"ts_ms": "int64", "row_ord": "int64"})
        ready, n = [none], 0
        for at in sorted(a for a, (_, least) in held["slices"].items() if least <= upto):
            ready.append(self._taken(held, at, upto))
            n += len(ready[-1])
            if n >= CHUNK:
                yield from self._given(key[0], held["own"], ready, min(upto, (at + 1) * SLICE_MS - 1))
                ready, n = [none], 0
        yield from self._given(key[0], held["own"], ready, upto)
        times = [t for t in (min((least for _, least in held["slices"].values()), default=None), self.waits_for(held["own"])) if t is not None]
        if held["timer"] is not None and held["timer"] > upto:
            self.handle.deleteTimer(held["timer"])
        held["timer"] = max(min(times), upto + 1, 1) if times else None
        if held["timer"] is not None:
            self.handle.registerTimer(held["timer"])
        self.state.update((pickle.dumps(held),))

    def _given(self, unit: str, own: dict, ready: list[pd.DataFrame], upto: int) -> Iterator[pd.DataFrame]:
        rows = pd.concat(ready[1:] or ready)
        out = self.advance_frame(unit, own, rows, upto)
        if len(out):
            yield out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] == HEARTBEAT:
            return
        yield from self._step(key, rows, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._step(key, iter(()), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def in_order(s: DataFrame, processor: InOrder, schema: str, delay: str) -> DataFrame:
    """processor over the stream s(equipment_id, ts_ms, row_ord, its columns), of rows that come up to `delay` late."""
    s.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # the only one that keeps timers
    timed = s.withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", delay)
    return timed.groupBy("equipment_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="eventTime")


# --- imputation ---------------------------------------------------------------------------------------------------


class Imputation(InOrder):
    """Missing cells wait for the next value or until four nominal intervals after the last one; then they are interpolated or
    carry it on. Those before the first value wait for it for `lead_ms`, and stay missing behind that."""

    def __init__(self, measures: list[str], nominal_minutes: float, lead_ms: int = S.DAY_MS):
        self.columns = measures
        self.output = ["equipment_id", "ts_ms", "row_ord", *measures]
        self.span, self.lead = int(4 * nominal_minutes * 60_000), lead_ms

    def fresh(self) -> dict:
        n = len(self.columns)
        # the last value of each measure and its time; rows with cells that wait: times, row_ords, cells, which of them wait
        return {"last": [None] * n, "open": (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, n)), np.zeros((0, n), bool))}

    def advance(self, unit: str, own: dict, rows: list[tuple], upto: int) -> Iterator[tuple]:
        pdf = pd.DataFrame(rows, columns=["ts_ms", "row_ord", *self.columns]).astype({"ts_ms": "int64", "row_ord": "int64"})
        out = self.advance_frame(unit, own, pdf, upto)
        columns = [out[c].astype(object).where(out[c].notna(), None).tolist() for c in self.output]
        yield from zip(*columns)

    def advance_frame(self, unit: str, own: dict, rows: pd.DataFrame, upto: int) -> pd.DataFrame:
        new = rows["ts_ms"].to_numpy(np.int64)
        fresh_cells = np.stack([rows[c].to_numpy(float) for c in self.columns], axis=1)
        at, order, cells, waits = (np.concatenate(x) for x in zip(own["open"], (new, rows["row_ord"].to_numpy(np.int64), fresh_cells, np.isnan(fresh_cells))))
        begin = len(at) - len(new)
        for i in range(len(self.columns)):
            known = begin + np.flatnonzero(~waits[begin:, i])
            asked = np.flatnonzero(waits[:, i])
            if len(asked):
                waits[asked, i] = self._fill(own["last"][i], at, cells[:, i], known, asked, upto)
            if len(known):
                own["last"][i] = (float(cells[known[-1], i]), int(at[known[-1]]))
        done = ~waits.any(axis=1)
        own["open"] = (at[~done], order[~done], cells[~done], waits[~done])
        out = pd.DataFrame({"equipment_id": unit, "ts_ms": at[done], "row_ord": order[done]})
        return out.assign(**{c: cells[done, i] for i, c in enumerate(self.columns)})[self.output]

    def _fill(self, last: tuple | None, at: np.ndarray, cells: np.ndarray, known: np.ndarray, asked: np.ndarray, upto: int) -> np.ndarray:
        """Fills cells at the places asked from those known, in order, and the last value before these; returns which still wait."""
        value = np.concatenate([[np.nan if last is None else last[0]], cells[known], [np.nan]])
        time = np.concatenate([[0 if last is None else last[1]], at[known], [0]])
        p = np.searchsorted(known, asked)  # the value before each, 0 for `last`; the one behind it is the next
        before, after, since, until, own = value[p], value[p + 1], time[p], time[p + 1], at[asked]
        has_before, has_after = (p > 0) | (last is not None), p < len(known)
        span = until - since
        near = has_before & has_after & (span > 0) & (span <= self.span)
        with np.errstate(invalid="ignore"):
            line = before + (after - before) * ((own - since) / np.where(near, span, 1))
        early = ~has_before & has_after & (until <= own + self.lead)
        cells[asked] = np.where(near, line, np.where(has_before, before, np.where(early, after, np.nan)))
        over = np.where(has_before, upto + 1 > since + self.span, upto + 1 > own + self.lead)
        return ~has_after & ~over

    def waits_for(self, own: dict) -> int | None:
        at, _, _, waits = own["open"]
        due = [own["last"][i][1] + self.span if own["last"][i] else int(at[waits[:, i]].min()) + self.lead for i in range(len(self.columns)) if waits[:, i].any()]
        return min(due, default=None)


def imputed(s: DataFrame, measures: list[str], nominal_minutes: float, delay: str = "1 day", lead_ms: int = S.DAY_MS) -> DataFrame:
    """The stream s with its cells filled as series.impute() fills them; rows come out once all their cells are known."""
    schema = "equipment_id string, ts_ms long, row_ord long, " + ", ".join(f"{m} double" for m in measures)
    out = in_order(s, Imputation(measures, nominal_minutes, lead_ms), schema, delay)
    number = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return out.select("equipment_id", "ts_ms", "row_ord", *(number(m) for m in measures))


# --- runs ---------------------------------------------------------------------------------------------------------


class Runs(InOrder):
    """Runs of candidates (raw above threshold, behind the warm-up), joined over up to `join` rows; a run is closed when that many
    rows and one more have passed, or at a timer once nothing can follow; single rows need more than `rescue`.

    A run is kept as its bounds, its largest raw score, and for each boost it may get the first row that reaches 1 with it;
    the rows behind its last candidate, `join` at most, wait to be part of it."""

    columns = ["raw", "threshold", "rescue"]
    output = ["equipment_id", "s", "e", "start_ms", "end_ms", "top", "peak_rn", "peak_ms"]

    def __init__(self, join: int = S.JOIN_WINDOW, idle_ms: int = 7 * S.DAY_MS):
        self.join, self.idle = join, idle_ms

    def fresh(self) -> dict:
        return {"rn": 0, "run": None, "tail": [], "last_ms": 0}

    @staticmethod
    def boost(length: int) -> float:
        return 0.03 * min(1.0, length / 10)

    def _take(self, run: dict, rn: int, at: int, raw: float) -> None:
        run["e"], run["end_ms"] = rn, at
        if raw > run["top"]:
            run["top"], run["peak"] = raw, (rn, at)
        for k in range(1, 11):
            if run["full"][k - 1] is None and raw + self.boost(k) >= 1.0:
                run["full"][k - 1] = (rn, at)

    def _closed(self, unit: str, own: dict) -> Iterator[tuple]:
        run = own["run"]
        own["run"], own["tail"] = None, []
        n = run["e"] - run["s"] + 1
        if n == 1 and run["top"] <= run["rescue"]:
            return
        peak = run["full"][min(n, 10) - 1] or run["peak"]
        yield unit, run["s"], run["e"], run["start_ms"], run["end_ms"], min(1.0, run["top"] + self.boost(n)), *peak

    def advance(self, unit: str, own: dict, rows: list[tuple], upto: int) -> Iterator[tuple]:
        for at, _, raw, threshold, rescue in rows:
            own["rn"] += 1
            own["last_ms"] = at
            rn = own["rn"]
            if rn > S.WARMUP and raw is not None and raw > threshold:
                if own["run"] and rn - own["run"]["e"] > self.join + 1:
                    yield from self._closed(unit, own)
                if own["run"] is None:
                    own["run"] = {"s": rn, "start_ms": at, "rescue": rescue, "top": -1.0, "peak": None, "full": [None] * 10}
                for r in own["tail"]:
                    self._take(own["run"], *r)
                self._take(own["run"], rn, at, raw)
                own["tail"] = []
            elif own["run"]:
                if rn - own["run"]["e"] > self.join:
                    yield from self._closed(unit, own)
                else:
                    own["tail"].append((rn, at, -1.0 if raw is None else raw))
        if own["run"] and upto >= own["last_ms"] + self.idle:
            yield from self._closed(unit, own)

    def waits_for(self, own: dict) -> int | None:
        return own["last_ms"] + self.idle if own["run"] else None


def runs(s: DataFrame, delay: str = "1 day", join: int = S.JOIN_WINDOW, idle_ms: int = 7 * S.DAY_MS) -> DataFrame:
    """The stream s(equipment_id, ts_ms, row_ord, raw, threshold, rescue) -> its runs with their peaks, each once it is closed: by
    the rows behind it, or by `idle_ms` without any."""
    schema = "equipment_id string, s long, e long, start_ms long, end_ms long, top double, peak_rn long, peak_ms long"
    out = in_order(s, Runs(join, idle_ms), schema, delay)
    return out.withColumns({"id": F.concat_ws("-", "equipment_id", "start_ms"), "hours": S.half_up((F.col("end_ms") - F.col("start_ms")) / 3_600_000, 1), "peak": S.half_up(F.col("top"), 3)})
