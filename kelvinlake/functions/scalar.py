"""Scalar expressions of the analysis: rounding, clamping, scoring and the fixture's physics. Null means missing and stays null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WARMUP, JOIN_WINDOW, MIN_DATA, DAY_MS = 96, 12, 120, 86_400_000
YEAR_MS = 31_557_600_000


def half_up(c: Column, digits: int = 0) -> Column:
    """Round half towards +infinity."""
    return F.floor(c * 10**digits + 0.5) / 10**digits


def clamp(c: Column, lo: float, hi: float) -> Column:
    """c held within lo and hi; null for null (least and greatest alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def bin8(v: Column, lo: Column, hi: Column) -> Column:
    """One of eight equal-width bins; a range of width 0 counts as width 1."""
    width = F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo)
    return clamp(F.floor((v - lo) / width * 8), 0, 7).cast("int")


def residual_anomaly(z: Column) -> Column:
    return 1 - F.exp(-0.5 * F.pow(z / 1.8, F.lit(2)))


def fuse(forest: Column, z: Column, forest_weight: float = 0.25, residual_weight: float = 0.75) -> Column:
    return clamp(forest_weight * F.least(forest, F.lit(0.55)) + residual_weight * residual_anomaly(z), 0.0, 1.0)


def cyclic(ts_ms: Column, hour: Column | None = None) -> dict[str, Column]:
    """Sine and cosine of hour, weekday (Sunday 0) and Julian-year phase."""
    hour = F.pmod(ts_ms, F.lit(DAY_MS)) / 3600000 if hour is None else hour
    dow = F.pmod(F.floor(ts_ms / DAY_MS) + 4, F.lit(7))
    turn = {"hour": hour / 24, "dow": dow / 7, "doy": (ts_ms % YEAR_MS) / YEAR_MS}
    return {f"{k}_{n}": f(v * (2 * math.pi)) for k, v in turn.items() for n, f in (("sin", F.sin), ("cos", F.cos))}


def health(exposure: Column, trend: Column, n: Column) -> Column:
    """5 to 100; a series within the warm-up is healthy."""
    score = clamp(half_up(100 - (55 * exposure + 30 * F.greatest(trend, F.lit(0.0)))), 5, 100)
    return F.when(n < WARMUP, 100).otherwise(score).cast("int")


def maintenance(score: Column, slope: Column, drift: Column) -> Column:
    """due, recommended, plan or ok; the first that holds."""
    due = (score < 70) | (drift > 1.2) | (slope > 0.015)
    return F.when(due, "due").when((drift > 0.7) | (slope > 0.008), "recommended").when((slope > 0.003) | (drift > 0.3), "plan").otherwise("ok")


def horizon_days(slope: Column) -> Column:
    return F.when(slope > 0, clamp(F.floor(1.5 / slope), 7, 365)).otherwise(365).cast("int")


def severity_rank(c: Column) -> Column:
    return F.when(c == "action", 3).when(c == "alert", 2).when(c == "watch", 1).otherwise(0)


def smoothstep(x: Column) -> Column:
    t = clamp(x, 0.0, 1.0)
    return t * t * (3 - 2 * t)


def vapour_pressure(celsius: Column) -> Column:
    """Saturation vapour pressure up to a constant factor (Magnus formula)."""
    return F.exp(17.625 * celsius / (243.04 + celsius))
