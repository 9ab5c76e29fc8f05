"""Scores of a simulated against an observed value, as aggregate expressions.

All are algebraic, so Spark aggregates them partially before it shuffles, and any selection of them over any
grouping is one pass. Pairs with a missing side do not count."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import correlation, paired, ratio

CONTINUOUS = ("BIAS", "MAE", "MSE", "RMSE", "CORR", "KGE", "NSE")
EVENT = ("POD", "FAR", "CSI", "FBIAS", "HSS")
DEFAULT = ("BIAS", "MAE", "RMSE", "CORR", "KGE", "NSE")
CLASSIC = ("BIAS", "MAE", "RMSE", "CORR", "KGE", "POD", "FAR", "CSI", "FBIAS")


def contingency(obs: Column, sim: Column, threshold: float) -> dict[str, Column]:
    """Counts of hits, misses, false alarms and correct negatives; an event is a value of at least threshold."""
    o, s = obs >= threshold, sim >= threshold
    return {"hits": F.count_if(o & s), "misses": F.count_if(o & ~s), "false_alarms": F.count_if(~o & s), "correct_negatives": F.count_if(~o & ~s)}


def scores(names: Iterable[str] | None = None, threshold: float | None = None, obs: str | Column = "obs", sim: str | Column = "sim") -> dict[str, Column]:
    """Aggregate expressions by upper-case name. Event scores are NULL where no threshold is given; scores that are not
    defined for the pairs at hand (none, one, a constant side) are NULL."""
    asked = [n.upper() for n in (names if names is not None else DEFAULT)]
    if unknown := [n for n in asked if n not in CONTINUOUS + EVENT]:
        raise ValueError(f"unknown metrics: {', '.join(unknown)}")
    o, s = paired(*(F.col(c) if isinstance(c, str) else c for c in (obs, sim)))
    n, d = F.count(o), s - o
    r = correlation(o, s)
    spread, level = ratio(F.stddev_samp(s), F.stddev_samp(o)), ratio(F.avg(s), F.avg(o))
    out = {
        "BIAS": F.avg(d),
        "MAE": F.avg(F.abs(d)),
        "MSE": F.avg(d * d),
        "RMSE": F.sqrt(F.avg(d * d)),
        "CORR": r,
        "KGE": 1 - F.sqrt((r - 1) * (r - 1) + (spread - 1) * (spread - 1) + (level - 1) * (level - 1)),
        "NSE": F.when(n >= 2, 1 - ratio(F.sum(d * d), F.var_pop(o) * n)),
    }
    if threshold is None:
        out |= dict.fromkeys(EVENT, F.lit(None).cast("double"))
    else:
        h, m, f, c = (x.cast("double") for x in contingency(o, s, threshold).values())
        out |= {"POD": ratio(h, h + m), "FAR": ratio(f, h + f), "CSI": ratio(h, h + m + f), "FBIAS": ratio(h + f, h + m), "HSS": ratio(2 * (h * c - m * f), (h + m) * (m + c) + (h + f) * (f + c))}
    return {k: out[k] for k in asked}


def columns(names: Iterable[str] | None = None, threshold: float | None = None, **pair) -> list[Column]:
    """The scores as aliased columns for agg()."""
    return [c.alias(k) for k, c in scores(names, threshold, **pair).items()]
