"""Calendar periods, groups and features of a time column, and whole-period time ranges."""

from __future__ import annotations

import datetime as dt
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import as_col

#: Names of period lengths that callers may know from other tools: fixed values.
PERIODS = {"month": "month", "m": "month", "me": "month", "ms": "month", "quarter": "quarter", "q": "quarter", "qs": "quarter", "qe": "quarter", "q-dec": "quarter", "year": "year", "a": "year", "y": "year", "ye": "year", "ys": "year", "as": "year", "yearly": "year", "monthly": "month"}
SEASONS = {"DJF": (12, 1, 2), "MAM": (3, 4, 5), "JJA": (6, 7, 8), "SON": (9, 10, 11)}
NAMED_SEASONS = {"Spring": (3, 4, 5), "Summer": (6, 7, 8), "Autumn": (9, 10, 11), "Winter": (12, 1, 2)}


def period_unit(name: str) -> str:
    if name.lower() not in PERIODS:
        raise ValueError(f"unknown period {name!r}: month, quarter or year")
    return PERIODS[name.lower()]


def period(time: Column | str, unit: str, label: str = "start") -> Column:
    """First (or last) day of the period that holds time."""
    unit = period_unit(unit)
    first = F.to_date(F.date_trunc(unit, as_col(time)))
    if label == "start":
        return first
    if label != "end":
        raise ValueError("label must be start or end")
    return F.date_sub(F.to_date(F.add_months(first, {"month": 1, "quarter": 3, "year": 12}[unit])), 1)


def season(time: Column | str) -> Column:
    """DJF, MAM, JJA or SON; December goes with the January and February of its own calendar year."""
    m = F.month(as_col(time))
    return F.coalesce(*(F.when(m.isin(*months), F.lit(s)) for s, months in SEASONS.items()))


def group_label(time: Column | str, by: str) -> Column:
    made = {"none": lambda: F.lit("all"), "month": lambda: F.month(as_col(time)), "season": lambda: season(time), "year": lambda: F.year(as_col(time))}
    if by not in made:
        raise ValueError(f"unknown group {by!r}: none, month, season or year")
    return made[by]()


def cycle_features(time: Column | str) -> dict[str, Column]:
    """Day of year and month as angles."""
    day, month = F.dayofyear(as_col(time)) * (2 * math.pi / 365.25), F.month(as_col(time)) * (2 * math.pi / 12)
    return {"doy_sin": F.sin(day), "doy_cos": F.cos(day), "month_sin": F.sin(month), "month_cos": F.cos(month)}


def block(time: Column | str, first: Column | dt.date, days: int) -> Column:
    """Number of the block of `days` days since `first`."""
    return F.floor(F.date_diff(F.to_date(as_col(time)), first if isinstance(first, Column) else F.lit(first)) / days).cast("int")


def bounds(start: str | dt.date | None, end: str | dt.date | None) -> tuple[dt.datetime | None, dt.datetime | None]:
    """Start, and first moment after the end. A partial date stands for its whole period: an end of 2001 takes in all of 2001."""
    return (None if start is None else _edges(start)[0]), (None if end is None else _edges(end)[1])


def _edges(text: str | dt.date) -> tuple[dt.datetime, dt.datetime]:
    if isinstance(text, dt.datetime):
        return text, text + dt.timedelta(microseconds=1)
    if isinstance(text, dt.date):
        text = text.isoformat()
    if not (m := re.fullmatch(r"(\d{4})(?:-?(\d\d)(?:-?(\d\d))?)?", text.strip())):
        at = dt.datetime.fromisoformat(text)
        return at, at + dt.timedelta(microseconds=1)
    y, mo, d = (int(x) if x else None for x in m.groups())
    low = dt.datetime(y, mo or 1, d or 1)
    if d:
        return low, low + dt.timedelta(days=1)
    if mo:
        return low, dt.datetime(y + mo // 12, mo % 12 + 1, 1)
    return low, dt.datetime(y + 1, 1, 1)


def within(time: Column | str, start=None, end=None) -> Column:
    """A filter on whole periods, with both ends included; it reaches the scan as plain comparisons."""
    low, high = bounds(start, end)
    keep = F.lit(True)
    if low is not None:
        keep = keep & (as_col(time) >= F.lit(low).cast("timestamp_ntz"))
    if high is not None:
        keep = keep & (as_col(time) < F.lit(high).cast("timestamp_ntz"))
    return keep
