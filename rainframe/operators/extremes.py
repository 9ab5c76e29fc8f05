"""Precipitation extremes by period: totals, wettest days, heavy days, very wet days, dry and wet spells.

The ones without a window are one aggregation; percentiles of a cell are exact and join back on cell_id."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import period
from ..functions.missing import finite, ratio
from .select import time_range
from .windows import longest_run, rolling

V = F.col


def _keys(df: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in ("product", "cell_id") if c in df.columns)


def _by_period(pr: DataFrame, freq: str, label: str, **made: Column) -> DataFrame:
    return pr.groupBy(*_keys(pr), period("time", freq, label).alias("period")).agg(*(c.alias(k) for k, c in made.items()))


def _ready(pr: DataFrame) -> DataFrame:
    return pr.select(*_keys(pr), "time", finite("value").alias("value"))


def rx1day(pr: DataFrame, freq: str = "year", label: str = "start") -> DataFrame:
    """Wettest day."""
    return _by_period(_ready(pr), freq, label, rx1day=F.max("value"))


def rx5day(pr: DataFrame, freq: str = "year", label: str = "start", window: int = 5) -> DataFrame:
    """Wettest run of `window` days; runs cross period ends and belong to the period of their last day."""
    return _by_period(rolling(_ready(pr), window), freq, label, rx5day=F.max("value"))


def prcptot(pr: DataFrame, freq: str = "year", label: str = "start", wet_threshold: float = 1.0) -> DataFrame:
    """Total of wet days; NULL where none is wet."""
    return _by_period(_ready(pr), freq, label, prcptot=F.sum(F.when(V("value") >= wet_threshold, V("value"))))


def sdii(pr: DataFrame, freq: str = "year", label: str = "start", wet_threshold: float = 1.0) -> DataFrame:
    """Mean of wet days."""
    wet = F.when(V("value") >= wet_threshold, V("value"))
    return _by_period(_ready(pr), freq, label, sdii=ratio(F.sum(wet), F.count(wet)))


def r10mm(pr: DataFrame, freq: str = "year", label: str = "start", threshold: float = 10.0) -> DataFrame:
    """Days of at least threshold; missing days are none."""
    return _by_period(_ready(pr), freq, label, r10mm=F.count_if(V("value") >= threshold))


def r20mm(pr: DataFrame, freq: str = "year", label: str = "start", threshold: float = 20.0) -> DataFrame:
    return _by_period(_ready(pr), freq, label, r20mm=F.count_if(V("value") >= threshold))


def percentile_threshold(pr: DataFrame, q: float, base_period: tuple | None = None, wet_threshold: float | None = 1.0) -> DataFrame:
    """threshold of each cell: the q-quantile, interpolated, of its values (of at least wet_threshold) in the base period."""
    rows = _ready(time_range(pr, *base_period) if base_period else pr)
    v = V("value") if wet_threshold is None else F.when(V("value") >= wet_threshold, V("value"))
    return rows.groupBy(*_keys(rows)).agg(F.percentile(v, q).alias("threshold"))


def _beyond(pr: DataFrame, q: float, name: str, freq: str, label: str, base_period, wet_threshold) -> DataFrame:
    limits = percentile_threshold(pr, q, base_period, wet_threshold)
    return _by_period(_ready(pr).join(limits, list(_keys(pr))), freq, label, **{name: F.sum(F.when(V("value") > V("threshold"), V("value")))})


def r95p(pr: DataFrame, freq: str = "year", label: str = "start", base_period: tuple | None = None, wet_threshold: float | None = 1.0) -> DataFrame:
    """Total of days over the cell's 95th percentile."""
    return _beyond(pr, 0.95, "r95p", freq, label, base_period, wet_threshold)


def r99p(pr: DataFrame, freq: str = "year", label: str = "start", base_period: tuple | None = None, wet_threshold: float | None = 1.0) -> DataFrame:
    return _beyond(pr, 0.99, "r99p", freq, label, base_period, wet_threshold)


def _spell(pr: DataFrame, event: Column, name: str) -> DataFrame:
    rows = _ready(pr).withColumn("year", F.year("time"))
    keys = (*_keys(rows), "year")
    known = rows.groupBy(*keys).agg(F.count("value").alias("_n"))
    runs = longest_run(rows, event, keys, name=name)
    return runs.join(known, list(keys)).withColumn(name, F.when(V("_n") > 0, V(name))).drop("_n")


def cdd(pr: DataFrame, dry_threshold: float = 1.0) -> DataFrame:
    """year and the longest run of days under dry_threshold in it; missing days end a run; NULL where all are missing."""
    return _spell(pr, V("value") < dry_threshold, "cdd")


def cwd(pr: DataFrame, wet_threshold: float = 1.0) -> DataFrame:
    """year and the longest run of days of at least wet_threshold."""
    return _spell(pr, V("value") >= wet_threshold, "cwd")


INDICES = {f.__name__: f for f in (rx1day, rx5day, prcptot, sdii, r10mm, r20mm, r95p, r99p, cdd, cwd)}


def compute(pr: DataFrame, indices: Iterable[str] | None = None, params: dict[str, dict] | None = None) -> DataFrame:
    """A row per cell and year with the asked indices (default all), each with its own parameters.

    All but the spells come from one aggregation by cell and year, over one window for runs of days and one set of percentiles by
    cell; a kind of spell is a window more."""
    names = list(indices or INDICES)
    if unknown := [n for n in names if n not in INDICES]:
        raise KeyError(f"unknown indices: {', '.join(unknown)}")
    params = {n: dict((params or {}).get(n, {})) for n in names}
    keys = [*_keys(pr), "year"]
    rows = _ready(pr).withColumn("year", F.year("time"))
    v = V("value")
    of = lambda n, what, default: params[n].pop(what, default)
    plain = all(not {"freq", "label", "base_period"} & p.keys() for p in params.values())
    if not plain:  # periods or base periods of their own: each by itself
        out = None
        for n in names:
            one = INDICES[n](pr, **params[n])
            if "year" not in one.columns:
                one = one.withColumn("year", F.year("period")).drop("period")
            out = one if out is None else out.join(one, keys, "full_outer")
        return out.select(*keys, *names)
    days = {}
    if "rx1day" in names:
        days["rx1day"] = F.max(v)
    for n in ("prcptot", "sdii"):
        if n in names:
            wet = F.when(v >= of(n, "wet_threshold", 1.0), v)
            days[n] = F.sum(wet) if n == "prcptot" else ratio(F.sum(wet), F.count(wet))
    for n, t in (("r10mm", 10.0), ("r20mm", 20.0)):
        if n in names:
            days[n] = F.count_if(v >= of(n, "threshold", t))
    limits = {n: (q, of(n, "wet_threshold", 1.0)) for n, q in (("r95p", 0.95), ("r99p", 0.99)) if n in names}
    base = rows
    if limits:
        cut = rows.groupBy(*_keys(pr)).agg(*(F.percentile(v if wet is None else F.when(v >= wet, v), q).alias(f"_{n}") for n, (q, wet) in limits.items()))
        base = rows.join(cut, list(_keys(pr)))
        days |= {n: F.sum(F.when(v > V(f"_{n}"), v)) for n in limits}
    if "rx5day" in names:
        n = of("rx5day", "window", 5)
        w = Window.partitionBy(*_keys(pr)).orderBy("time").rowsBetween(1 - n, 0)
        base = base.withColumn("_run", F.when(F.count("value").over(w) == n, F.sum("value").over(w)))
        days["rx5day"] = F.max("_run")
    spells = {n: (v < of(n, "dry_threshold", 1.0)) if n == "cdd" else (v >= of(n, "wet_threshold", 1.0)) for n in ("cdd", "cwd") if n in names}
    out = base.groupBy(*keys).agg(F.count("value").alias("_n"), *(c.alias(n) for n, c in days.items()))
    for n, event in spells.items():
        runs = longest_run(rows, event, tuple(keys), name=n)
        out = out.join(runs, keys).withColumn(n, F.when(V("_n") > 0, V(n)))
    if left := {n: p for n, p in params.items() if p}:
        raise TypeError(f"unknown parameters: {left}")
    return out.select(*keys, *names)
