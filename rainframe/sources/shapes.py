"""Shapefiles as regions, without a library: blocks of records are decoded in the tasks, and projected coordinates become degrees by
column expressions.

The index (.shx) says where records stand, so a task reads only its own bytes of the shapes (.shp) and of their fields (.dbf)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.projections import Projection, from_wkt
from ..operators.regions import REGIONS, in_degrees
from .bytes_at import Bytes

POLYGONS = (5, 15, 25)  # plain, with heights, with measures
BLOCK = 8 << 20  # bytes of shapes in a block, or one shape
RAW = "n bigint, rings array<array<struct<x:double,y:double>>>, attrs map<string,string>"


def blocks(index: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """First and last (not included) records of runs of about `size` bytes; index: a row of place and length for each record."""
    upto = np.cumsum(index[:, 1])
    a = 0
    while a < len(index):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + size, "right")))
        yield a, b
        a = b


def rings_of(shape: bytes, where: str) -> list[np.ndarray] | None:
    """The rings of a polygon's record, as arrays of points; None for an empty shape."""
    kind = struct.unpack_from("<i", shape)[0]
    if kind == 0:
        return None
    if kind not in POLYGONS:
        raise ValueError(f"{where} has shapes of type {kind}; regions are polygons")
    n_parts, n_points = struct.unpack_from("<2i", shape, 36)
    firsts = np.frombuffer(shape, "<i4", n_parts, 44)
    points = np.frombuffer(shape, "<f8", 2 * n_points, 44 + 4 * n_parts).reshape(-1, 2)
    return np.split(points, firsts[1:])


class Fields:
    """The records of a .dbf file."""

    def __init__(self, source: Bytes, encoding: str):
        self.source, self.encoding = source, encoding
        self.count, self.head, self.width = struct.unpack("<IHH", source.at(4, 8))
        head, self.fields, at = source.at(0, self.head), [], 1
        for i in range(32, self.head - 1, 32):
            if head[i] == 0x0D:
                break
            size = head[i + 16]
            self.fields.append((head[i : i + 11].split(b"\0")[0].decode(encoding), chr(head[i + 11]), at, size, head[i + 17]))
            at += size

    def rows(self, a: int, b: int) -> Iterator[dict[str, str] | None]:
        """Values as text by name, missing ones left out; None for a deleted record."""
        raw = self.source.at(self.head + a * self.width, (b - a) * self.width)
        for i in range(b - a):
            row = raw[i * self.width : (i + 1) * self.width]
            yield None if row[:1] == b"*" else {name: v for name, kind, at, size, places in self.fields if (v := self._value(row[at : at + size], kind, places)) is not None}

    def _value(self, raw: bytes, kind: str, places: int) -> str | None:
        text = raw.decode(self.encoding, "replace").strip("\0 ")
        if not text or text[0] == "*" and kind in "NF":
            return None
        if kind in "NF":
            return str(float(text)) if places or "." in text or "e" in text.lower() else str(int(text))
        if kind == "D":
            return None if text == "0" * 8 else f"{text[:4]}-{text[4:6]}-{text[6:]}"
        if kind == "L":
            return {"t": "True", "y": "True", "f": "False", "n": "False"}.get(text[0].lower())
        return text


def _beside(path: str, ending: str) -> Bytes | None:
    for e in (ending, ending.upper()):
        try:
            return Bytes(path[:-4] + e)
        except FileNotFoundError:
            continue
    return None


def _decoder(path: str, encoding: str):
    def decode(batches):
        shapes, table = Bytes(path), _beside(path, ".dbf")
        fields = Fields(table, encoding) if table else None
        for batch in batches:
            for a, b, places, sizes in zip(batch["a"], batch["b"], batch["places"], batch["sizes"]):
                raw = shapes.at(int(places[0]), int(places[-1] + sizes[-1] - places[0])) if np.all(np.diff(places) > 0) else None
                out = []
                for i, attrs in enumerate(fields.rows(a, b) if fields else [{}] * (b - a)):
                    if attrs is None:
                        continue
                    own = raw[places[i] - places[0] :][: sizes[i]] if raw is not None else shapes.at(int(places[i]), int(sizes[i]))
                    rings = rings_of(own[8:], path)
                    out.append((a + i, [[{"x": x, "y": y} for x, y in r.tolist()] for r in rings or []], attrs))
                if out:
                    yield pd.DataFrame(out, columns=["n", "rings", "attrs"])

    return decode


def read_shapefile(spark: SparkSession, path: str, name_field: str | None = None, id_field: str | None = None, crs: Projection | None = None, block: int = BLOCK) -> DataFrame:
    """Regions from a shapefile (its .shp; .shx beside it, .dbf, .prj and .cpg where there are any), in longitude and latitude.

    Names and ids come from fields, else they are the record's number. The .prj says how coordinates become degrees, unless crs does;
    without both they are degrees. Deleted records are left out, empty shapes have no ring, a file without a record gives no region;
    a field that is not there is an error."""
    path = spark.read.format("binaryFile").load(path).inputFiles()[0]
    held = _beside(path, ".shx")
    if held is None:
        raise FileNotFoundError(f"{path} has no index (.shx) beside it")
    index = np.frombuffer(held.at(100, held.size - 100), ">i4").reshape(-1, 2).astype(np.int64) * 2
    index[:, 1] += 8  # a record's head
    if crs is None:
        text = _beside(path, ".prj")
        crs = from_wkt(text.at(0, text.size).decode()) if text else Projection(None)
    page = _beside(path, ".cpg")
    encoding = page.at(0, page.size).decode().strip() if page else "utf-8"
    encoding = f"cp{encoding}" if encoding.isdigit() else encoding
    if name_field is not None or id_field is not None:
        table = _beside(path, ".dbf")
        known = [f[0] for f in Fields(table, encoding).fields] if table else []
        for want in (name_field, id_field):
            if want is not None and want not in known:
                raise KeyError(f"no field {want!r} in {sorted(known)}")
    parts = [(a, b, index[a:b, 0].tolist(), index[a:b, 1].tolist()) for a, b in blocks(index, block)]
    todo = spark.createDataFrame(parts, "a bigint, b bigint, places array<bigint>, sizes array<bigint>").repartition(max(1, len(parts)))
    rows = todo.mapInPandas(_decoder(path, encoding), RAW)
    number = F.col("attrs")[id_field].cast("double").cast("bigint") if id_field else F.col("n")
    name = F.col("attrs")[name_field] if name_field else F.col("n").cast("string")
    return in_degrees(rows, crs).select(number.alias("region_id"), name.alias("name"), "rings", "attrs").to(spark.createDataFrame([], REGIONS).schema)
