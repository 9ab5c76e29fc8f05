"""Spatial resampling. A target grid's neighbours and weights are one small table, made once per pair of grids; the cube
meets it in an equi-join on cell_id and is summed."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import written
from ..functions.missing import finite
from .align import axis_ticks
from .resample import HOW

KEYS = ("product", "time")


def resolution(ticks: list[float]) -> float:
    """Median step of an axis."""
    if len(ticks) < 2:
        raise ValueError("a resolution needs two coordinates")
    return float(np.median(np.abs(np.diff(sorted(ticks)))))


def target_axis(ticks: list[float], step: float) -> list[float]:
    """From the least tick on, in steps, to the greatest (half a step beyond at most)."""
    return np.arange(min(ticks), max(ticks) + step / 2, step).tolist()


def grid(spark, lats: list[float], lons: list[float]) -> DataFrame:
    """cell_id, lat_idx, lon_idx, lat, lon of all pairs of the two axes, numbered row by row."""
    n, m = len(lats), len(lons)
    cells = spark.range(n * m).select(F.col("id").alias("cell_id"), F.floor(F.col("id") / m).cast("int").alias("lat_idx"), (F.col("id") % m).cast("int").alias("lon_idx"))
    at = lambda i, axis: F.element_at(F.array(*map(F.lit, map(float, axis))), F.col(i) + 1)
    return cells.withColumns({"lat": at("lat_idx", lats), "lon": at("lon_idx", lons)})


def _neighbours(spark, source: list[float], target: list[float], method: str, name: str) -> DataFrame:
    """target index, source tick and weight along one axis; targets beyond the source have none."""
    src, rows = np.array(sorted(source)), []
    for i, t in enumerate(target):
        if not src[0] <= t <= src[-1]:
            continue
        k = int(np.searchsorted(src, t))
        if src[k] == t:
            rows.append((i, float(src[k]), 1.0))
        elif method == "nearest":
            rows.append((i, float(src[k] if src[k] - t <= t - src[k - 1] else src[k - 1]), 1.0))
        else:
            w = (t - src[k - 1]) / (src[k] - src[k - 1])
            rows += [(i, float(src[k - 1]), float(1 - w)), (i, float(src[k]), float(w))]
    return spark.createDataFrame(rows, f"{name}_idx int, {name} double, w_{name} double")


def weights(cells: DataFrame, lats: list[float], lons: list[float], method: str = "linear") -> DataFrame:
    """cell_id of the source, target (lat_idx * len(lons) + lon_idx) and w, separable bilinear or nearest."""
    spark = cells.sparkSession
    by_lat = _neighbours(spark, axis_ticks(cells, "lat"), lats, method, "lat")
    by_lon = _neighbours(spark, axis_ticks(cells, "lon"), lons, method, "lon")
    met = cells.select("cell_id", "lat", "lon").join(F.broadcast(by_lat), "lat").join(F.broadcast(by_lon), "lon")
    return met.select("cell_id", (F.col("lat_idx").cast("long") * len(lons) + F.col("lon_idx")).alias("target"), (F.col("w_lat") * F.col("w_lon")).alias("w"))


def interpolate(cube: DataFrame, cells: DataFrame, lats: list[float], lons: list[float], method: str = "linear", value: str = "value") -> DataFrame:
    """cube on the target grid, cell_id numbering it row by row. NULL where a neighbour with weight is missing; targets
    outside the source have no row."""
    if method not in ("linear", "bilinear", "nearest"):
        raise ValueError(f"unknown method {method!r}")
    keys = [c for c in KEYS if c in cube.columns]
    w = weights(cells, lats, lons, "nearest" if method == "nearest" else "linear").where("w > 0")
    need = w.groupBy("target").agg(F.count("*").alias("need"))
    v = finite(value)
    met = cube.join(w, "cell_id").groupBy(*keys, "target").agg(F.sum(F.col("w") * v).alias("_s"), F.count(v).alias("_n"))
    return met.join(need, "target").select(*keys, F.col("target").alias("cell_id"), F.when(F.col("_n") == F.col("need"), F.col("_s")).alias(value))


def coarsen_factor(ticks: list[float], step: float) -> int:
    ratio = step / resolution(ticks)
    if round(ratio) < 1 or not math.isclose(ratio, round(ratio), rel_tol=1e-5, abs_tol=1e-6):
        raise ValueError(f"the target resolution must be a whole multiple of the source's: {ratio:g}")
    return round(ratio)


def coarsen(cube: DataFrame, cells: DataFrame, k_lat: int, k_lon: int, how: str = "mean", value: str = "value") -> DataFrame:
    """cube over blocks of k_lat by k_lon cells, by index arithmetic; an incomplete last row or column of blocks is dropped."""
    keys = [c for c in KEYS if c in cube.columns]
    n_lat, n_lon = cells.agg(F.max("lat_idx") + 1, F.max("lon_idx") + 1).first()
    met = cube.join(cells.select("cell_id", F.floor(F.col("lat_idx") / k_lat).cast("int").alias("lat_block"), F.floor(F.col("lon_idx") / k_lon).cast("int").alias("lon_block")), "cell_id")
    met = met.where((F.col("lat_block") < n_lat // k_lat) & (F.col("lon_block") < n_lon // k_lon))
    return met.groupBy(*keys, "lat_block", "lon_block").agg(HOW[how](finite(value)).alias(value))


def coarse_cells(cells: DataFrame, k_lat: int, k_lon: int) -> DataFrame:
    """lat_block, lon_block and the mean coordinates of each whole block."""
    n_lat, n_lon = cells.agg(F.max("lat_idx") + 1, F.max("lon_idx") + 1).first()
    blocks = cells.groupBy(F.floor(F.col("lat_idx") / k_lat).cast("int").alias("lat_block"), F.floor(F.col("lon_idx") / k_lon).cast("int").alias("lon_block")).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return blocks.where((F.col("lat_block") < n_lat // k_lat) & (F.col("lon_block") < n_lon // k_lon))


def resample(cube: DataFrame, cells: DataFrame, target_resolution: float | None = None, target_grid: tuple[list[float], list[float]] | None = None, method: str = "linear", value: str = "value") -> DataFrame:
    """Either a resolution or a grid (latitudes, longitudes). linear, bilinear and nearest interpolate; mean, sum, max and min
    take blocks, for which a resolution must be given."""
    if (target_resolution is None) == (target_grid is None):
        raise ValueError("give either target_resolution or target_grid")
    lats, lons = axis_ticks(cells, "lat"), axis_ticks(cells, "lon")
    if method in HOW:
        if target_grid is not None:
            raise ValueError(f"{method} needs target_resolution")
        return coarsen(cube, cells, coarsen_factor(lats, target_resolution), coarsen_factor(lons, target_resolution), method, value)
    to = target_grid or (target_axis(lats, target_resolution), target_axis(lons, target_resolution))
    return interpolate(cube, cells, *to, method, value)


def _in_blocks(rows: DataFrame, keys: list[str], size: int, columns: list[str], of: list[str]) -> DataFrame:
    """keys, _block, and the columns of about `size` rows of a key as arrays; rows alike in `of` are in one block."""
    n = rows.groupBy(*keys).agg(F.ceil(F.count("*") / size).alias("_n"))
    dealt = (rows.join(n, keys) if keys else rows.crossJoin(n)).withColumn("_block", F.pmod(F.xxhash64(*of), F.col("_n")))
    held = dealt.groupBy(*keys, "_block").agg(F.collect_list(F.struct(*columns)).alias("_s"))
    return held.select(*keys, "_block", *(F.col(f"_s.{c}").alias(c) for c in columns))


SIDE_BY_SIDE = 32  # keys whose samples are weighted together


def idw(samples: DataFrame, cells: DataFrame, power: float = 2.0, eps: float = 1e-12, keys: tuple[str, ...] = (), value: str = "value", block: int = 2048) -> DataFrame:
    """Inverse-distance weighting in planar degrees of samples (keys, lat, lon, value) at cells, over all samples of a key.

    Samples of one place weigh alike, so they are summed and counted first, however many they are. Blocks of places meet
    blocks of cells in the tasks, where a place's distance to a cell is worked out once for some SIDE_BY_SIDE keys; numerators and denominators
    of each cell are summed over the blocks. The work grows with places times cells, as the method's does. Cells without coordinates are NULL."""
    kind = [f.name for f in samples.select(*keys).schema]
    rows = samples.select(*keys, F.col("lat").cast("double").alias("_lat"), F.col("lon").cast("double").alias("_lon"), finite(value).alias("_v")).where("_v is not null and _lat is not null and _lon is not null")
    own = F.xxhash64(F.to_json(F.struct(F.lit(0).alias("_all"), *kind), {"ignoreNullFields": "false"}))
    places = written(rows.groupBy(*keys, "_lat", "_lon").agg(F.sum("_v").alias("_v"), F.count("*").cast("double").alias("_m")).withColumn("_k", own), "idw-places")
    named = places.select("_k", *kind).distinct()
    together = -(-max(1, n := named.count()) // SIDE_BY_SIDE)
    dealt = places.select(F.pmod("_k", F.lit(together)).alias("_deal"), "_k", "_lat", "_lon", "_v", "_m")
    points = _in_blocks(dealt, ["_deal"], block * max(1, min(n, SIDE_BY_SIDE)), ["_k", "_lat", "_lon", "_v", "_m"], ["_lat", "_lon"]).drop("_deal", "_block")
    at = cells.select(F.col("cell_id").cast("long").alias("cell_id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    targets = _in_blocks(at, [], block, ["cell_id", "lat", "lon"], ["cell_id", "lat", "lon"])

    def spread(batches):
        held, now = {}, None  # sums of the block of cells at hand, by key

        def out():
            for k, (top, low) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), k)), now[1], pa.array(top), pa.array(low)], ["_k", "cell_id", "_top", "_low"])

        for b in batches:
            for i in range(b.num_rows):
                if now is None or now[0] != b.column("_block")[i].as_py():
                    yield from out()
                    held, now = {}, (b.column("_block")[i].as_py(), b.column("cell_id")[i].values)
                x, y = (b.column(c)[i].values.to_numpy(zero_copy_only=False).astype(float) for c in ("lat", "lon"))
                k, p, q, v, m = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("_k", "_lat", "_lon", "_v", "_m"))
                place, of_place = np.unique(p + 1j * q, return_inverse=True)
                key, of_key = np.unique(k, return_inverse=True)
                sums = np.zeros((len(place), 2 * len(key)))
                sums[of_place, of_key] = v
                sums[of_place, of_key + len(key)] = m
                made = np.zeros((len(x), 2 * len(key)))
                for j in range(0, len(place), 256):
                    w = np.subtract.outer(x, place.real[j : j + 256])
                    w *= w
                    d = np.subtract.outer(y, place.imag[j : j + 256])
                    d *= d
                    w += d
                    w += eps
                    if power != 2:
                        w **= power / 2
                    np.reciprocal(w, out=w)
                    made += w @ sums[j : j + 256]
                for j, name in enumerate(key.tolist()):
                    top, low = held.get(name, (0.0, 0.0))
                    held[name] = top + made[:, j], low + made[:, j + len(key)]
        yield from out()

    parts = targets.crossJoin(points).mapInArrow(spread, "_k bigint, cell_id bigint, _top double, _low double")
    made = parts.groupBy("_k", "cell_id").agg(finite(F.sum("_top") / F.nullif(F.sum("_low"), F.lit(0.0))).alias(value))
    return made.join(F.broadcast(named) if n <= 10_000 else named, "_k").select(*kind, "cell_id", value)
