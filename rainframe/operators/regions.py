"""Regions: polygons, the cells inside them, and means over them.

Polygons meet grid cells once, when the zone table (cell_id, zone_id, zone_name) is made; all later work is
an equi-join on cell_id."""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.missing import finite
from ..functions.projections import Projection, crs_of, to_degrees

REGIONS = "region_id bigint, name string, rings array<array<struct<x:double,y:double>>>, attrs map<string,string>"
#: Points that all polygons together may have: they are sent to the tasks whole.
MOST_POINTS = 5_000_000


def read_geojson(spark: SparkSession, path: str, name_field: str | None = None, id_field: str | None = None) -> DataFrame:
    """Regions from a GeoJSON file in longitude and latitude, or in what its crs names, turned to them; names and ids from fields,
    else the row's number."""
    document = json.loads(spark.read.text(path, wholetext=True).first()[0])
    features = document["features"]
    rows = []
    for i, f in enumerate(features):
        attrs, shape = f.get("properties") or {}, f["geometry"]
        parts = shape["coordinates"] if shape["type"] == "MultiPolygon" else [shape["coordinates"]]
        for want in (name_field, id_field):
            if want is not None and want not in attrs:
                raise KeyError(f"no field {want!r} in {sorted(attrs)}")
        rings = [[(float(x), float(y)) for x, y, *_ in ring] for part in parts for ring in part]
        rows.append((int(attrs[id_field]) if id_field else i, str(attrs[name_field]) if name_field else str(i), rings, {k: str(v) for k, v in attrs.items() if v is not None}))
    return in_degrees(spark.createDataFrame(rows, REGIONS), crs_of(document))


def in_degrees(regions: DataFrame, crs: Projection) -> DataFrame:
    """Regions with their rings turned to longitude and latitude."""
    if crs.kind is None and crs.degrees == 1.0:
        return regions

    def turned(p):
        lon, lat = to_degrees(crs, p["x"], p["y"])
        return F.struct(lon.alias("x"), lat.alias("y"))

    return regions.withColumn("rings", F.transform("rings", lambda r: F.transform(r, turned)))


def read_regions(spark: SparkSession, path: str, name_field: str | None = None, id_field: str | None = None) -> DataFrame:
    """Regions from a shapefile (.shp) or a GeoJSON file."""
    from ..sources.shapes import read_shapefile

    return (read_shapefile if path.lower().endswith(".shp") else read_geojson)(spark, path, name_field, id_field)


def fields(regions: DataFrame) -> list[str]:
    return sorted(r[0] for r in regions.select(F.explode(F.map_keys("attrs")).alias("k")).distinct().collect())


def field_values(regions: DataFrame, field: str) -> DataFrame:
    """Distinct non-null values of a field, in order."""
    return regions.select(F.col("attrs")[field].alias(field)).dropna().distinct().orderBy(field)


def with_field(regions: DataFrame, field: str, values: Iterable[str]) -> DataFrame:
    """Regions whose field is among the values; none is an error."""
    found = regions.where(F.col("attrs")[field].isin(*map(str, values)))
    if found.isEmpty():
        raise ValueError(f"no region whose {field} is among {list(values)}")
    return found


def inside(x: np.ndarray, y: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """Points in a polygon by the even-odd rule over all its rings; holes are rings like the others. Of points on an edge, those
    on lower and left ones are inside."""
    odd = np.zeros(len(x), bool)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, np.roll(ring, -1, axis=0)):
            if y1 != y2:
                odd ^= ((y1 <= y) != (y2 <= y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return odd


def containment(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """cell_id and region_id, name of every region that holds the cell's centre."""
    points = regions.agg(F.sum(F.aggregate("rings", F.lit(0), lambda n, r: n + F.size(r)))).first()[0] or 0
    if points > MOST_POINTS:
        raise ValueError(f"the regions have {points} points; {MOST_POINTS} can be sent to the tasks")
    shapes = [(r.region_id, r.name, [np.array([(p.x, p.y) for p in ring]) for ring in r.rings]) for r in regions.collect()]

    def place(batches):
        for b in batches:
            x, y = b["lon"].to_numpy(float), b["lat"].to_numpy(float)
            for i, name, rings in shapes:
                flat = np.concatenate(rings)
                near = np.flatnonzero((x >= flat[:, 0].min()) & (x <= flat[:, 0].max()) & (y >= flat[:, 1].min()) & (y <= flat[:, 1].max()))
                hit = near[inside(x[near], y[near], rings)]
                if len(hit):
                    yield pd.DataFrame({"cell_id": b["cell_id"].to_numpy()[hit], "region_id": i, "name": name})

    return cells.select("cell_id", "lat", "lon").mapInPandas(place, "cell_id bigint, region_id bigint, name string")


def zone_table(cells: DataFrame, regions: DataFrame, field: str | None = None) -> DataFrame:
    """cell_id, zone_id (1.. in the order of the names) and zone_name. Polygons of one name (or value of field) are one zone; a
    cell in several zones is in the first of them; cells outside all have no row."""
    named = regions if field is None else regions.withColumn("name", F.col("attrs")[field]).where("name is not null")
    labels = named.select(F.col("name").alias("zone_name")).distinct()
    ids = labels.select("zone_name", F.row_number().over(Window.orderBy("zone_name")).alias("zone_id"))
    held = containment(cells, named).select("cell_id", F.col("name").alias("zone_name")).join(ids, "zone_name")
    return held.groupBy("cell_id").agg(F.min(F.struct("zone_id", "zone_name")).alias("z")).select("cell_id", "z.zone_id", "z.zone_name")


def clip(cube: DataFrame, zones: DataFrame, drop: bool = True, value: str = "value") -> DataFrame:
    """Rows of cells in any zone; without drop, other rows stay and lose their value."""
    held = zones.select("cell_id").distinct()
    if drop:
        return cube.join(held, "cell_id", "left_semi")
    return cube.join(held.withColumn("_in", F.lit(True)), "cell_id", "left").withColumn(value, F.when(F.col("_in"), F.col(value))).drop("_in")


def zone_mean(cube: DataFrame, zones: DataFrame, value: str = "value", keys: tuple[str, ...] = ("product", "time")) -> DataFrame:
    """Plain mean over the cells of each zone at each time."""
    keys = tuple(c for c in keys if c in cube.columns)
    return cube.join(zones.select("cell_id", "zone_name"), "cell_id").groupBy("zone_name", *keys).agg(F.avg(finite(value)).alias(value))
