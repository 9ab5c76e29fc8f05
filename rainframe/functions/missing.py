"""The missing-value law: NULL is missing, and no operator returns NaN or an infinity.

Spark orders NaN above all numbers and counts it as present, so values are cleaned once with finite(), and
every division yields NULL where its divisor is zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """c as a double, NULL unless it is a finite number."""
    v = as_col(c).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b in doubles, NULL where b is zero."""
    return as_col(a).cast("double") / F.nullif(as_col(b).cast("double"), F.lit(0.0))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r over rows in which both are present, NULL if either side is constant."""
    a, b = paired(a, b)
    return F.covar_samp(a, b) / F.nullif(F.stddev_samp(a) * F.stddev_samp(b), F.lit(0.0))


def paired(a: Column, b: Column) -> tuple[Column, Column]:
    """Both, NULL wherever either is."""
    return F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)


def isclose(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def at_least_zero(c: Column) -> Column:
    """c, or 0 where it is negative; NULL stays NULL, which greatest() would pass over."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


def clean(df: DataFrame, *columns: str) -> DataFrame:
    """df with finite() applied to the columns."""
    return df.withColumns({c: finite(c) for c in columns})


def require(df: DataFrame, *columns: str) -> None:
    if lost := [c for c in columns if c not in df.columns]:
        raise KeyError(f"no such columns: {', '.join(lost)}; there are {', '.join(df.columns)}")
