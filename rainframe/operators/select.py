"""Selection: boxes, time ranges, months, names, and columns by role."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import within
from ..functions.missing import require

#: What axes are called elsewhere: fixed values.
LATITUDE, LONGITUDE = ("lat", "latitude", "lati", "y"), ("lon", "longitude", "long", "x")


def standard_axes(df: DataFrame) -> DataFrame:
    """df with its latitude and longitude columns named lat and lon."""
    names = {}
    for want, known in (("lat", LATITUDE), ("lon", LONGITUDE)):
        if want not in df.columns and (found := [c for c in df.columns if c.lower() in known]):
            names[found[0]] = want
    return df.withColumnsRenamed(names)


def box(df: DataFrame, min_lon: float, max_lon: float, min_lat: float, max_lat: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows inside the box, edges included."""
    require(df, lon, lat)
    return df.where(F.col(lat).between(min_lat, max_lat) & F.col(lon).between(min_lon, max_lon))


def time_range(df: DataFrame, start=None, end=None, time: str = "time") -> DataFrame:
    """Rows from start to end, both included as whole periods; either may be open."""
    if start is None and end is None:
        return df
    require(df, time)
    return df.where(within(time, start, end))


def months(df: DataFrame, wanted: Iterable[int], time: str = "time") -> DataFrame:
    return df.where(F.month(time).isin(*wanted))


def rename(df: DataFrame, mapping: dict[str, str] | None) -> DataFrame:
    """Unknown names raise; Spark itself would pass over them."""
    if not mapping:
        return df
    require(df, *mapping)
    return df.withColumnsRenamed(mapping)


def numeric_columns(df: DataFrame, but: Iterable[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in set(but)]


def main_variable(df: DataFrame, preferred: str | None = None, keys: Iterable[str] = ("product", "time", "cell_id", "lat", "lon", "lat_idx", "lon_idx")) -> str:
    """The preferred column if it is there, else the only numeric one that is no key, else the first."""
    if preferred is not None:
        require(df, preferred)
        return preferred
    found = numeric_columns(df, keys)
    if not found:
        raise ValueError("no numeric column beside the keys")
    return found[0]


def to_numbers(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Columns as doubles, NULL where they hold no number."""
    columns = list(columns)
    require(df, *columns)
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})
