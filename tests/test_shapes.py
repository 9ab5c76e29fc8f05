import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainframe.functions import projections
from rainframe.functions.projections import Projection, from_epsg, from_wkt, to_degrees
from rainframe.operators import regions
from rainframe.sources import shapes

CLARKE = {"a": 6378206.4, "e2": 0.00676866}
GEOGRAPHIC = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'
UTM = f'PROJCS["WGS_1984_UTM_Zone_48N",{GEOGRAPHIC},PROJECTION["Transverse_Mercator"],PARAMETER["False_Easting",500000.0],PARAMETER["False_Northing",0.0],PARAMETER["Central_Meridian",105.0],PARAMETER["Scale_Factor",0.9996],PARAMETER["Latitude_Of_Origin",0.0],UNIT["Meter",1.0]]'
RECORDS = [  # rings, name, number, share, day, flag
    ([[(101.2, 31.3), (103.8, 31.3), (103.8, 33.7), (101.2, 33.7), (101.2, 31.3)], [(102.0, 32.0), (102.0, 32.5), (102.5, 32.5), (102.0, 32.0)]], "b", 7, 0.25, "20010203", "T"),
    (None, "empty", 8, None, "", "?"),
    ([[(99.0, 29.0), (102.3, 29.0), (102.3, 31.3), (99.0, 31.3), (99.0, 29.0)]], "größe", 9, 1.5, "20011231", "F"),
    ([[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]], "gone", 10, 1.0, "", "F"),
]


def write(folder, records, prj=None, kind=5, deleted=("gone",), turn=lambda x, y: (x, y), cpg="UTF-8"):
    """A shapefile by its published layout."""
    shp, shx, at = b"", b"", 50
    for i, (rings, *_) in enumerate(records):
        if rings is None:
            body = struct.pack("<i", 0)
        else:
            points = [turn(*p) for r in rings for p in r]
            firsts = np.cumsum([0, *(len(r) for r in rings[:-1])])
            body = struct.pack("<i4d2i", kind, *np.min(points, axis=0), *np.max(points, axis=0), len(rings), len(points)) + firsts.astype("<i4").tobytes() + np.array(points, "<f8").tobytes()
            if kind == 15:
                body += np.zeros(2 + len(points), "<f8").tobytes()
        shp += struct.pack(">2i", i + 1, len(body) // 2) + body
        shx += struct.pack(">2i", at, len(body) // 2)
        at += 4 + len(body) // 2
    head = lambda n: struct.pack(">i5ii", 9994, 0, 0, 0, 0, 0, 50 + n // 2) + struct.pack("<2i8d", 1000, kind, *[0.0] * 8)
    (folder / "r.shp").write_bytes(head(len(shp)) + shp)
    (folder / "r.shx").write_bytes(head(len(shx)) + shx)
    columns = [("NAME", b"C", 12, 0), ("CODE", b"N", 6, 0), ("SHARE", b"N", 8, 3), ("DAY", b"D", 8, 0), ("FLAG", b"L", 1, 0)]
    width = 1 + sum(c[2] for c in columns)
    dbf = struct.pack("<B3BIHH20x", 3, 101, 1, 1, len(records), 32 + 32 * len(columns) + 1, width)
    dbf += b"".join(n.encode().ljust(11, b"\0") + t + bytes(4) + bytes([size, places]) + bytes(14) for n, t, size, places in columns) + b"\r"
    for _, name, code, share, day, flag in records:
        text = lambda v, n: str("" if v is None else v).encode()[:n].rjust(n)
        dbf += (b"*" if name in deleted else b" ") + name.encode().ljust(12) + text(code, 6) + text(share, 8) + day.encode().ljust(8) + flag.encode()
    (folder / "r.dbf").write_bytes(dbf + b"\x1a")
    (folder / "r.cpg").write_text(cpg)
    if prj:
        (folder / "r.prj").write_text(prj)
    return str(folder / "r.shp")


def rings(df):
    return {r.region_id: [[(p.x, p.y) for p in ring] for ring in r.rings] for r in df.collect()}


@pytest.mark.parametrize(("kind", "block"), [(5, 1), (5, 1 << 20), (15, 200)])
def test_records_in_blocks(spark, tmp_path, kind, block):
    got = shapes.read_shapefile(spark, write(tmp_path, RECORDS, GEOGRAPHIC, kind), "NAME", "CODE", block=block)
    assert {r.region_id: (r.name, r.attrs) for r in got.collect()} == {
        7: ("b", {"NAME": "b", "CODE": "7", "SHARE": "0.25", "DAY": "2001-02-03", "FLAG": "True"}),
        8: ("empty", {"NAME": "empty", "CODE": "8"}),
        9: ("größe", {"NAME": "größe", "CODE": "9", "SHARE": "1.5", "DAY": "2001-12-31", "FLAG": "False"}),
    }
    assert rings(got) == {7: RECORDS[0][0], 8: [], 9: RECORDS[2][0]}


def test_as_from_geojson(spark, tmp_path):
    whole = [RECORDS[0], RECORDS[2]]
    text = {"type": "FeatureCollection", "features": [{"properties": {"NAME": n}, "geometry": {"type": "Polygon", "coordinates": r}} for r, n, *_ in whole]}
    (tmp_path / "r.geojson").write_text(json.dumps(text))
    a = regions.read_geojson(spark, str(tmp_path / "r.geojson"), "NAME")
    b = regions.read_regions(spark, write(tmp_path, whole), "NAME")
    assert rings(a) == rings(b) and a.select("name").collect() == b.orderBy("region_id").select("name").collect() and a.schema == b.schema


def utm(lon, lat, lon0=105.0):
    """Forward transverse Mercator by its series in the third flattening, with coefficients of its own; the worked example below is from the other series."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    p, d = math.radians(lat), math.radians(lon - lon0)
    e = 2 * math.sqrt(n) / (1 + n)
    t = math.sinh(math.atanh(math.sin(p)) - e * math.atanh(e * math.sin(p)))
    xi, eta = math.atan2(t, math.cos(d)), math.atanh(math.sin(d) / math.sqrt(1 + t * t))
    x = eta + sum(c * math.cos(2 * (j + 1) * xi) * math.sinh(2 * (j + 1) * eta) for j, c in enumerate(alpha))
    y = xi + sum(c * math.sin(2 * (j + 1) * xi) * math.cosh(2 * (j + 1) * eta) for j, c in enumerate(alpha))
    return 500000 + 0.9996 * big * x, 0.9996 * big * y


def test_a_projected_file_lands_on_the_same_cells(spark, tmp_path):
    (tmp_path / "p").mkdir()
    plain = shapes.read_shapefile(spark, write(tmp_path, RECORDS, GEOGRAPHIC), "NAME")
    turned = shapes.read_shapefile(spark, write(tmp_path / "p", RECORDS, UTM, turn=utm), "NAME")
    flat = lambda df: np.array([p for _, rs in sorted(rings(df).items()) for r in rs for p in r])
    assert np.abs(flat(plain) - flat(turned)).max() < 1e-7
    # no centre lies on an edge: there, rounding of the projection decides
    cells = spark.range(900).select(F.col("id").alias("cell_id"), (28.57 + 0.2 * F.floor(F.col("id") / 30)).alias("lat"), (98.55 + 0.2 * (F.col("id") % 30)).alias("lon"))
    held = [sorted(map(tuple, regions.zone_table(cells, r.where("size(rings) > 0")).collect())) for r in (plain, turned)]
    assert held[0] == held[1] and len(held[0]) > 100


#: Worked examples of Snyder's manual: kind, parameters, x, y, longitude, latitude. Fixed values.
EXAMPLES = [
    ("transverse", {"central_meridian": -75.0, "scale_factor": 0.9996}, 127106.5, 4484124.4, -73.5, 40.5),
    ("lambert", {"standard_parallel_1": 33.0, "standard_parallel_2": 45.0, "latitude_of_origin": 23.0, "central_meridian": -96.0}, 1894410.9, 1564649.5, -75.0, 35.0),
    ("albers", {"standard_parallel_1": 29.5, "standard_parallel_2": 45.5, "latitude_of_center": 23.0, "longitude_of_center": -96.0}, 1885472.7, 1535925.0, -75.0, 35.0),
    ("mercator", {"central_meridian": -180.0}, 11688673.7, 4139145.6, -75.0, 35.0),
]


@pytest.mark.parametrize(("kind", "parameters", "x", "y", "lon", "lat"), EXAMPLES)
def test_worked_examples(spark, kind, parameters, x, y, lon, lat):
    p = Projection(kind, parameters=parameters, **CLARKE)
    got = spark.range(1).select(*to_degrees(p, F.lit(x), F.lit(y))).first()
    assert got[0] == pytest.approx(lon, abs=2e-6) and got[1] == pytest.approx(lat, abs=2e-6)


def test_known_numbers_and_units(spark):
    at = lambda p, x, y: tuple(spark.range(1).select(*to_degrees(p, F.lit(x), F.lit(y))).first())
    assert at(from_epsg(3857), 20037508.342789244 / 2, 0.0) == pytest.approx((90.0, 0.0), abs=1e-9)
    assert at(from_epsg(32648), *utm(106.0, 30.0)) == pytest.approx((106.0, 30.0), abs=1e-8)
    x, y = utm(106.0, 30.0)
    assert at(from_epsg(32748), x, 10000000.0 - y) == pytest.approx((106.0, -30.0), abs=1e-8)
    feet = from_wkt(UTM.replace('UNIT["Meter",1.0]', 'UNIT["Foot",0.3048]').replace('"False_Easting",500000.0', '"False_Easting",0.0'))
    assert at(feet, (x - 500000) / 0.3048, y / 0.3048) == pytest.approx((106.0, 30.0), abs=1e-8)
    assert at(from_epsg(4326), 3.0, 4.0) == (3.0, 4.0)


def test_what_is_not_known_is_an_error(spark, tmp_path):
    for text, match in [(GEOGRAPHIC.replace("D_WGS_1984", "D_Pulkovo_1942"), "datum"), (UTM.replace("Transverse_Mercator", "Krovak"), "krovak"), (GEOGRAPHIC.replace('"Greenwich",0.0', '"Paris",2.337'), "meridian"), ("LOCAL_CS[]", "datum")]:
        with pytest.raises(ValueError, match=match):
            from_wkt(text)
    with pytest.raises(ValueError):
        from_epsg(27700)
    path = write(tmp_path, RECORDS, kind=3)
    with pytest.raises(Exception, match="polygons"):
        shapes.read_shapefile(spark, path).collect()
    with pytest.raises(KeyError):
        shapes.read_shapefile(spark, path, "NONE")
    (tmp_path / "r.shx").unlink()
    with pytest.raises(FileNotFoundError):
        shapes.read_shapefile(spark, path)


def test_no_record(spark, tmp_path):
    got = shapes.read_shapefile(spark, write(tmp_path, []), "NAME")
    assert got.count() == 0 and got.schema == spark.createDataFrame([], regions.REGIONS).schema


def test_geojson_in_metres(spark, tmp_path):
    corner = [(0.0, 0.0), (1e6, 0.0), (1e6, 1e6), (0.0, 0.0)]
    text = {"crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::3857"}}, "features": [{"properties": {}, "geometry": {"type": "Polygon", "coordinates": [corner]}}]}
    (tmp_path / "m.geojson").write_text(json.dumps(text))
    got = rings(regions.read_geojson(spark, str(tmp_path / "m.geojson")))[0][0]
    assert got[1] == pytest.approx((math.degrees(1e6 / 6378137), 0.0), abs=1e-9) and got[0] == pytest.approx((0, 0), abs=1e-9)
    assert projections.crs_of({"crs": {"properties": {"name": "urn:ogc:def:crs:OGC:1.3:CRS84"}}}).kind is None and projections.crs_of({}).kind is None
