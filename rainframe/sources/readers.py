"""Readers of grids and tables, named reader settings, and the format that a path holds.

Text and Parquet go through Spark's own readers. Flat binary rasters come as whole files and are decoded in Arrow batches.
GeoTIFF is decoded in runs of strips or tiles, NetCDF and HDF5 in blocks of time steps, all without a library. HDF4 and
GRIB are recognised but not decoded here: convert them to Parquet first; the error says so."""

from __future__ import annotations

import copy
import importlib
import json
import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import finite
from .geotiff import read_geotiff
from .gridfile import read_file_grids

#: Formats by file ending: fixed values.
ENDINGS = {"nc": "netcdf", "nc4": "netcdf", "tif": "geotiff", "tiff": "geotiff", "grb": "grib", "grb2": "grib", "grib": "grib", "grib2": "grib", "h5": "hdf", "hdf5": "hdf", "hdf": "hdf", "he5": "hdf", "bin": "raw", "dat": "raw", "raw": "raw", "parquet": "parquet", "csv": "csv"}
LIBRARY = {"grib": "cfgrib"}
_registry: dict[str, dict] = {}


def register(name: str, spec: dict) -> None:
    _registry[name] = copy.deepcopy(spec)


def registered(name: str) -> dict:
    if name not in _registry:
        raise KeyError(f"no reader named {name!r}; known: {', '.join(sorted(_registry)) or 'none'}")
    return copy.deepcopy(_registry[name])


def reader_names() -> list[str]:
    return sorted(_registry)


def detect(path: str, names: Iterable[str] | None = None) -> str:
    """Format of a file by its ending; of a folder by the names in it (GeoTIFF before NetCDF before GRIB)."""
    if names is not None:
        kinds = {detect(n) for n in names}
        return next((k for k in ("geotiff", "netcdf", "grib") if k in kinds), "unknown_dir")
    low = path.lower().rstrip("/")
    if low.endswith(".nc.gz"):
        return "netcdf_gz"
    return ENDINGS.get(low.rpartition(".")[2], "unknown")


def need(library: str, what: str) -> object:
    try:
        return importlib.import_module(library)
    except ImportError as e:
        raise ImportError(f"{what} needs the Python package {library} on the driver and the executors") from e


#: Patterns of dates in file names, with their formats: fixed values.
DATES = ((r"(\d{8})", "yyyyMMdd"), (r"(\d{4}-\d{2}-\d{2})", "yyyy-MM-dd"), (r"(\d{6})", "yyyyMM"))


def date_in_name(name: Column, pattern: str | None = None) -> Column:
    """The first date that a name holds, as a timestamp; NULL without one."""
    found = [(pattern, fmt) for _, fmt in DATES] if pattern else DATES
    tries = [F.try_to_timestamp(F.nullif(F.regexp_extract(name, p, 1), F.lit("")), F.lit(f)) for p, f in found]
    return F.coalesce(*tries).cast("timestamp_ntz")


def read_table(spark: SparkSession, path: str, time: str | None = "time", time_format: str | None = None, schema: str | None = None) -> DataFrame:
    """A table of stations or metrics from CSV (with a header) or Parquet. Without a schema all CSV columns but time stay text
    until a column is cast; no pass over the data guesses types."""
    if detect(path) == "parquet":
        df = spark.read.parquet(path)
    elif path.lower().endswith((".xls", ".xlsx")):
        need("openpyxl", "reading a workbook")
        df = spark.createDataFrame(pd.read_excel(path))
    else:
        df = spark.read.csv(path, header=True, schema=schema)
    if time is None:
        return df
    if time not in df.columns:
        raise KeyError(f"no column {time!r} in {path}")
    if isinstance(df.schema[time].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return df.withColumn(time, F.col(time).cast("timestamp_ntz"))
    parse = F.try_to_timestamp(F.col(time), F.lit(time_format)) if time_format else F.try_to_timestamp(F.col(time))
    return df.withColumn(time, parse.cast("timestamp_ntz"))


def read_cube(spark: SparkSession, path: str, value: str = "value", product: str | None = None) -> DataFrame:
    """A long cube from Parquet: (product,) time, cell_id, value, cleaned of NaN and infinities. Only those columns are read."""
    df = spark.read.parquet(path)
    keys = [c for c in ("product", "time", "cell_id") if c in df.columns]
    out = df.select(*keys, finite(value).alias("value"))
    return out if product is None else out.withColumn("product", F.lit(product))


META_LINE = re.compile(r"^\s*([^=:]+?)\s*[=:]\s*(.*?)\s*$")


def parse_meta(text: str) -> dict[str, str]:
    """key=value or key: value lines; blank lines and those behind # count for nothing; values stay text."""
    out = {}
    for line in text.splitlines():
        if line.strip() and not line.lstrip().startswith("#"):
            sign = "=" if "=" in line else ":"
            if sign in line:
                key, _, value = line.partition(sign)
                out[key.strip()] = value.strip()
    return out


def read_meta(spark: SparkSession, path: str) -> dict:
    """Metadata of a raster, as JSON or as lines; a missing file is an error."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return json.loads(text) if text.lstrip().startswith("{") else parse_meta(text)


def meta_axis(meta: dict, name: str, size: int) -> np.ndarray:
    """Coordinates from a list, from start and step, or plain numbers."""
    if name in meta:
        axis = np.asarray(meta[name], float)
        if len(axis) != size:
            raise ValueError(f"{name} has {len(axis)} coordinates; the shape has {size}")
        return axis
    if f"{name}_start" in meta:
        return float(meta[f"{name}_start"]) + float(meta[f"{name}_step"]) * np.arange(size)
    return np.arange(size, dtype=float)


def read_binary(spark: SparkSession, path: str, meta: dict, pattern: str | None = None) -> DataFrame:
    """path (a file, folder or glob of flat rasters) as time, time_idx, cell_id, lat, lon, value. meta: shape ((time,) lat, lon),
    dtype (float32), order (C), nodata, coordinates or start and step, time. Without times in meta, a file's name gives
    one. A file of another size than the shape's is an error."""
    shape = tuple(int(n) for n in (meta["shape"] if not isinstance(meta["shape"], str) else meta["shape"].split(",")))
    if len(shape) not in (2, 3):
        raise ValueError("the shape must be (lat, lon) or (time, lat, lon)")
    n_t, n_lat, n_lon = (1, *shape) if len(shape) == 2 else shape
    kind, order, nodata = np.dtype(meta.get("dtype", "float32")), meta.get("order", "C"), meta.get("nodata")
    lat, lon = meta_axis(meta, "lat", n_lat), meta_axis(meta, "lon", n_lon)
    times = [meta["time"]] if isinstance(meta.get("time"), str) else meta.get("time")

    def decode(batches):
        for b in batches:
            for name, at, raw in zip(b["path"], b["at"], b["content"]):
                if len(raw) != n_t * n_lat * n_lon * kind.itemsize:
                    raise ValueError(f"{name} has {len(raw)} bytes; the shape asks for {n_t * n_lat * n_lon * kind.itemsize}")
                cube = np.frombuffer(raw, kind).reshape((n_t, n_lat, n_lon), order=order).astype(float)
                for i in range(n_t):
                    v = cube[i].ravel()
                    v = np.where(np.isfinite(v) & (v != float(nodata) if nodata is not None else True), v, np.nan)
                    t = pd.Timestamp(times[i]) if times else at
                    yield pd.DataFrame({"time": t, "time_idx": i, "cell_id": np.arange(n_lat * n_lon), "lat": np.repeat(lat, n_lon), "lon": np.tile(lon, n_lat), "value": pd.Series(v).astype(object).where(np.isfinite(v), None)})

    files = spark.read.format("binaryFile").load(path).select("path", date_in_name(F.element_at(F.split("path", "/"), -1), pattern).alias("at"), "content")
    return files.mapInPandas(decode, "time timestamp_ntz, time_idx int, cell_id bigint, lat double, lon double, value double")


def read_grid(spark: SparkSession, path: str, product: str | None = None, meta: dict | None = None, **hints) -> DataFrame:
    """path by its format; settings registered for product win over what the path says."""
    spec = (registered(product) if product is not None else {}) | hints
    kind = spec.pop("format", None) or detect(path)
    if kind == "parquet":
        return read_cube(spark, path, **spec)
    if kind == "raw":
        if not (meta := meta or spec.get("meta")):
            raise ValueError("a flat raster needs meta")
        return read_binary(spark, path, meta, spec.get("pattern"))
    if kind == "geotiff":
        return read_geotiff(spark, path, **spec)
    if kind in ("netcdf", "netcdf_gz", "hdf"):
        return read_file_grids(spark, path, **spec)
    raise ValueError(f"no reader for {path} ({kind}); convert it to Parquet with {LIBRARY[kind]} first" if kind in LIBRARY else f"no reader for {path} ({kind})")


def scope() -> dict:
    """What is read and what is brought into line, in words."""
    return {"formats": ["NetCDF", "HDF", "GRIB", "GeoTIFF", "raw binary"], "steps": ["variable names", "coordinate names and order", "missing values", "unit normalization", "time axis"]}
