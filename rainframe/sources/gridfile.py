"""Files of grids (classic NetCDF, NetCDF-4 and other HDF5) as a Spark data source, `rainframe_grid`.

A partition is a block of time steps of one file, cut where the file's chunks end; its task reads those steps only and gives out one Arrow
batch for each. The files' headers are read when the scan is planned; filters on time, pushed by Spark or given as since and until, then
leave out blocks."""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from . import hdf5, netcdf
from .bytes_at import Bytes
from .netcdf import AXES, decode_times, pick, real

SCHEMA = "time timestamp_ntz, time_idx int, cell_id bigint, lat double, lon double, value double"
BLOCK = 32 << 20  # bytes of values in a partition
#: Patterns of dates in file names, with their formats: fixed values.
DATES = ((r"(\d{8})", "%Y%m%d"), (r"(\d{4}-\d{2}-\d{2})", "%Y-%m-%d"), (r"(\d{6})", "%Y%m"))


def date_of(name: str, pattern: str | None = None) -> dt.datetime | None:
    """The first date that a file's name holds."""
    for own, form in DATES:
        if found := re.search(pattern or own, name):
            try:
                return dt.datetime.strptime(found[1], form)
            except ValueError:
                continue
    return None


class _Grid(NamedTuple):
    """A data set of HDF5 as a variable with named axes."""

    dims: tuple[str, ...]
    attributes: dict
    shape: tuple[int, ...]
    kind: np.dtype
    steps: int
    read: object

    @property
    def values(self) -> np.ndarray:
        return self.read()


def variables_of(source: Bytes, name: str, group: str | None = None) -> dict[str, netcdf.Variable | _Grid]:
    """All variables of a file by name, without their values. HDF5: data sets of the group, by their path in it; the names lat, lon and time
    (or their like) at the end of a path are axes, and shapes tell which axis is which."""
    if source.at(0, 3) == b"CDF":
        return netcdf.parse(source, name)
    file = hdf5.File(source, name)
    inside = f"{group.strip('/')}/" if group else ""
    sets = {path[len(inside) :]: hdf5.Dataset(file, path) for path in file.sets if path.startswith(inside)}
    own = {axis: next((k for k, d in sets.items() if k.rpartition("/")[2].lower() in known and len(d.shape) == 1), None) for axis, known in AXES.items()}
    lengths = {axis: sets[k].shape[0] if k else None for axis, k in own.items()}
    out = {}
    for key, d in sets.items():
        if not isinstance(d.kind, np.dtype):
            continue
        axis = next((a for a, k in own.items() if k == key), None)
        dims = (axis,) if axis else hdf5.axes_of(d.shape, lengths) or tuple(f"{key}_{i}" for i in range(len(d.shape)))
        out[axis or key] = _Grid(dims, d.attributes, d.shape, d.kind, d.steps, d.read)
    return out


class Opened:
    """The grid of a file: its times, axes and steps."""

    def __init__(self, path: str, var: str | None, group: str | None, pattern: str | None):
        self.source = Bytes(path)
        variables = variables_of(self.source, path, group)
        self.grid, axes = pick(variables, var, path)
        self.order = [self.grid.dims.index(axes[a]) for a in ("time", "lat", "lon") if axes[a]]
        self.timed = axes["time"] is not None
        axis = lambda a: real(variables[d].values, variables[d].attributes) if (d := axes[a]) in variables else np.arange(self.grid.shape[self.grid.dims.index(d)], dtype=float)
        self.lat, self.lon = axis("lat"), axis("lon")
        self.times = [date_of(path.rpartition("/")[2], pattern)]
        if self.timed:
            if axes["time"] not in variables:
                raise ValueError(f"{path} has no times for its axis {axes['time']}")
            self.times = decode_times(variables[axes["time"]].values, variables[axes["time"]].attributes)
        self.first = not self.timed or self.order[0] == 0  # whether time is the axis by which values are read

    def blocks(self, size: int) -> Iterator[tuple[int, int]]:
        n = len(self.times)
        if not (self.timed and self.first):
            yield 0, n
            return
        step = self.grid.kind.itemsize * int(np.prod(self.grid.shape[1:], dtype=np.int64))
        chunk = max(1, self.grid.steps)
        each = max(chunk, size // max(1, step) // chunk * chunk)
        yield from ((a, min(a + each, n)) for a in range(0, n, each))

    def steps(self, a: int, b: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each step's values by cell, NaN where missing; a chunk of steps is held at once."""
        together = max(1, self.grid.steps) if self.timed and self.first else b - a
        for s in range(a, b, max(1, together)):
            e = min(s + together, b)
            raw = self.grid.read(s, e) if self.timed and self.first else self.grid.read()
            cube = raw.transpose([*self.order, *(i for i in range(raw.ndim) if i not in self.order)])
            cube = cube[(Ellipsis, *[0] * (cube.ndim - len(self.order)))]
            for i in range(s, e):
                v = cube[i - s if self.first else i] if self.timed else cube
                yield i, real(v, self.grid.attributes).ravel()


class Block(InputPartition):
    def __init__(self, path: str, a: int, b: int):
        super().__init__((path, a, b))


class GridReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.since = pd.Timestamp(options["since"]) if options.get("since") else None
        self.until = pd.Timestamp(options["until"]) if options.get("until") else None

    def _open(self, path: str) -> Opened:
        o = self.options
        return Opened(path, o.get("var") or None, o.get("group") or None, o.get("pattern") or None)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of time narrow the blocks; Spark still tests every row."""
        for f in filters:
            if getattr(f, "attribute", None) == ("time",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                t = pd.Timestamp(f.value).tz_localize(None)
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.since = t if self.since is None else max(self.since, t)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.until = t if self.until is None else min(self.until, t)
            yield f

    def _wanted(self, times: list) -> bool:
        known = [t for t in times if t is not None and t is not pd.NaT]
        if not known:
            return True
        return (self.since is None or max(known) >= self.since) and (self.until is None or min(known) <= self.until)

    def partitions(self) -> list[Block]:
        def blocks(path: str) -> list[Block]:
            opened = self._open(path)
            try:
                return [Block(path, a, b) for a, b in opened.blocks(int(self.options.get("block", BLOCK))) if self._wanted(opened.times[a:b])]
            finally:
                opened.source.close()

        with ThreadPoolExecutor(16) as pool:
            return [b for found in pool.map(blocks, json.loads(self.options["paths"])) for b in found]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        path, a, b = partition.value if partition is not None else (None, 0, 0)
        if path is None:
            return
        opened = self._open(path)
        lat, lon = np.repeat(opened.lat, len(opened.lon)), np.tile(opened.lon, len(opened.lat))
        for i, v in opened.steps(a, b):
            t = pa.array([opened.times[i]], pa.timestamp("us")).take(pa.array(np.zeros(len(v), np.int64)))
            value = pa.array(v, mask=~np.isfinite(v))
            yield pa.RecordBatch.from_arrays([t, pa.array(np.full(len(v), i, np.int32)), pa.array(np.arange(len(v))), pa.array(lat), pa.array(lon), value], ["time", "time_idx", "cell_id", "lat", "lon", "value"])
        opened.source.close()


class GridSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rainframe_grid"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GridReader:
        return GridReader(dict(self.options))


def read_file_grids(spark: SparkSession, path: str, var: str | None = None, pattern: str | None = None, group: str | None = None, since: str | None = None, until: str | None = None, block: int = BLOCK) -> DataFrame:
    """path (a file, folder or glob) as time, time_idx, cell_id, lat, lon, value; cells are numbered along the grid's axes, latitude
    first. Without an axis of time a file's name gives one. A file without a time step gives no row. since, until: blocks of steps that
    lie outside are not read, and their rows are left out; filters on time do the same, for which the session's setting to push filters to
    Python sources is turned on."""
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the reader takes filters on time
    spark.dataSource.register(GridSource)
    paths = sorted(spark.read.format("binaryFile").load(path).inputFiles())
    options = {"paths": json.dumps(paths), "var": var or "", "pattern": pattern or "", "group": group or "", "since": since or "", "until": until or "", "block": str(block)}
    out = spark.read.format("rainframe_grid").options(**options).load()
    if since:
        out = out.where(F.col("time") >= F.lit(since).cast("timestamp_ntz"))
    return out.where(F.col("time") <= F.lit(until).cast("timestamp_ntz")) if until else out
