"""Labels and number formats of reports, as column expressions."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kelvinlake.functions.scalar import half_up


def _at(ms: Column) -> Column:
    return F.timestamp_millis(ms.cast("long")).cast("timestamp_ntz")


def time_label(ms: Column) -> Column:
    """Wall clock of epoch milliseconds: 05 Mar 2020, 14:30."""
    return F.date_format(_at(ms), "dd MMM yyyy, HH:mm")


def day_label(ms: Column) -> Column:
    return F.date_format(_at(ms), "d MMM yyyy")


def axis_label(ms: Column) -> Column:
    return F.date_format(_at(ms), "MMM yy")


def significant(v: Column, digits: int = 1) -> Column:
    """Thousands separated, at most so many decimals, none that are zero; a dash for a missing value."""
    text = F.format_number(F.round(v, digits), digits)
    if digits:
        text = F.regexp_replace(text, r"\.?0+$", "")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), "-").otherwise(text)


def duration_label(hours: Column) -> Column:
    minutes = F.concat(half_up(hours * 60).cast("long").cast("string"), F.lit(" min"))
    return F.when(hours < 1, minutes).when(hours < 48, F.concat(significant(hours), F.lit(" h"))).otherwise(F.concat(significant(hours / 24), F.lit(" d")))


def energy_label(kwh: Column) -> Column:
    scaled = lambda by, digits, unit: F.concat(significant(kwh / by, digits), F.lit(unit))
    return F.when(F.abs(kwh) >= 1e6, scaled(1e6, 2, " GWh")).when(F.abs(kwh) >= 1e3, scaled(1e3, 1, " MWh")).otherwise(scaled(1.0, 0, " kWh"))


def percent_label(v: Column) -> Column:
    return F.concat(significant(v, 0), F.lit("%"))


def missing_share(n: Column, rows: Column) -> Column:
    """Percentage of missing cells, three decimals."""
    return half_up(100.0 * n / rows, 3)


def severity_label(c: Column) -> Column:
    return F.when(c.isin("action", "alert", "watch"), F.initcap(c)).otherwise("Nominal")


def maintenance_label(status: Column, horizon: Column) -> Column:
    """Status with its horizon in weeks, one at least; nothing to do is on track, an unknown status n/a."""
    weeks = F.greatest(F.lit(1), F.ceil(horizon / 7)).cast("string")
    return F.when(status.isNull(), "PM: n/a").when(status == "ok", "PM: on track").otherwise(F.concat(F.lit("PM: "), status, F.lit(" · ~"), weeks, F.lit("w")))


def health_band(h: Column) -> Column:
    return F.when(h.isNull(), "none").when(h >= 75, "ok").when(h >= 55, "warn").otherwise("danger")


def slug(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"\s+", "_"))


def fixed(c: Column, digits: int = 1) -> Column:
    """The double's exact value with so many decimals, halves away from zero; whole from 100 on, halves up."""

    def run(values: pd.Series) -> pd.Series:
        step = Decimal(1).scaleb(-digits)
        return values.map(lambda v: str(Decimal(v).quantize(step, ROUND_HALF_UP)), na_action="ignore").astype(object).where(values.notna(), None)

    return F.when(F.abs(c) >= 100, half_up(c).cast("long").cast("string")).otherwise(F.pandas_udf(run, "string")(c))


def ticks(lo: Column, hi: Column, most: int) -> Column:
    """Multiples of 1, 2, 5 or 10 times a power of ten within lo and hi, about `most` of them; lo alone where there is no range."""
    raw = (hi - lo) / most
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    step = power * F.when(raw / power < 1.5, 1).when(raw / power < 3.5, 2).when(raw / power < 7.5, 5).otherwise(10)
    first = F.ceil(lo / step)
    many = F.transform(F.sequence(first.cast("long"), F.floor(hi / step + 1e-6).cast("long")), lambda k: k * step)
    return F.when(hi > lo, many).otherwise(F.array(lo))
