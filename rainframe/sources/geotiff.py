"""GeoTIFF without a library: directories, strips and tiles, and the affine transform, from bytes.

A row of the plan is a run of strips or tiles of one file; its task reads and unpacks those only. Classic and big files in both byte
orders; plain, LZW, Deflate and PackBits data; horizontal and floating-point differences; chunky and planar bands. JPEG and the like are
errors, as are files of complex numbers."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bytes_at import Bytes
from .gridfile import SCHEMA, date_of

#: Numbers of tags and kinds of values: fixed values of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, STRIP_SIZES = 256, 257, 258, 259, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FORMAT = 284, 317, 322, 323, 324, 325, 339
SCALE, TIE, MATRIX, KEYS, NODATA = 33550, 33922, 34264, 34735, 42113
KINDS = {1: "u1", 2: "S1", 3: "u2", 4: "u4", 6: "i1", 8: "i2", 9: "i4", 11: "f4", 12: "f8", 13: "u4", 16: "u8", 17: "i8", 18: "u8"}
RASTER_TYPE, PIXEL_IS_POINT = 1025, 2
BLOCK = 16 << 20  # bytes of values in a run, or one strip or tile
MOST_TASKS = 50_000  # of more runs a task takes several, one after another


class Tiff:
    """The first image of a file. A chunk is a strip or a tile, numbered as the file does."""

    def __init__(self, source: Bytes, name: str):
        self.source, self.name = source, name
        head = source.at(0, 16)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2])
        kind = struct.unpack(self.order + "H", head[2:4])[0] if self.order and len(head) >= 8 else None
        if kind not in (42, 43):
            raise ValueError(f"{name} is no TIFF file")
        big = kind == 43
        at = struct.unpack(self.order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
        self.tags = self._directory(at, big)
        self.width, self.height = self._one(WIDTH), self._one(HEIGHT)
        self.bands = self._one(SAMPLES, 1)
        bits, form = set(self._all(BITS, [1]).tolist()), self._one(FORMAT, 1)
        if len(bits) > 1 or (b := bits.pop()) not in (8, 16, 32, 64) or form not in (1, 2, 3):
            raise ValueError(f"{name} holds values that are not read here (bits {sorted(self._all(BITS, [1]).tolist())}, format {form})")
        self.kind = np.dtype(f"{self.order}{'uif'[form - 1]}{b // 8}")
        self.packing, self.predictor = self._one(COMPRESSION, 1), self._one(PREDICTOR, 1)
        if self.packing not in (1, 5, 8, 32773, 32946) or self.predictor not in (1, 2, 3):
            raise ValueError(f"{name} is compressed in a way that is not read here ({self.packing}, {self.predictor})")
        self.planar = self._one(PLANAR, 1) == 2
        self.tiled = TILES in self.tags
        self.chunk_width = self._one(TILE_WIDTH) if self.tiled else self.width
        self.chunk_height = self._one(TILE_HEIGHT) if self.tiled else min(self._one(ROWS, self.height), self.height)
        self.across, self.down = -(-self.width // self.chunk_width), -(-self.height // self.chunk_height)
        self.places, self.sizes = self._all(TILES if self.tiled else STRIPS), self._all(TILE_SIZES if self.tiled else STRIP_SIZES)
        text = bytes(self._all(NODATA, np.zeros(0, "S1"))).split(b"\0")[0].strip()
        self.nodata = float(text) if text else None

    def _directory(self, at: int, big: bool) -> dict[int, np.ndarray]:
        entry, inline, count = (20, 8, "Q") if big else (12, 4, "H")
        size = 8 if big else 2
        n = struct.unpack(self.order + count, self.source.at(at, size))[0]
        raw, out = self.source.at(at + size, n * entry), {}
        for i in range(n):
            tag, kind, many = struct.unpack_from(self.order + ("HHQ" if big else "HHI"), raw, i * entry)
            if kind not in KINDS:
                continue
            own = np.dtype(KINDS[kind]).newbyteorder(self.order)
            held = raw[(i + 1) * entry - inline : (i + 1) * entry]
            if many * own.itemsize > inline:
                held = self.source.at(struct.unpack(self.order + ("Q" if big else "I"), held)[0], many * own.itemsize)
            out[tag] = np.frombuffer(held, own, many)
        return out

    def _all(self, tag: int, default=None) -> np.ndarray:
        if tag not in self.tags and default is None:
            raise ValueError(f"{self.name} lacks the tag {tag}")
        return self.tags[tag] if tag in self.tags else np.asarray(default)

    def _one(self, tag: int, default: int | None = None) -> int:
        return int(self._all(tag, None if default is None else [default])[0])

    def affine(self) -> tuple[float, float, float, float, float, float]:
        """a, b, c, d, e, f of x = a * column + b * row + c and y = d * column + e * row + f, for corners of pixels. Without a place on
        earth columns and rows are numbers."""
        if MATRIX in self.tags:
            m = self.tags[MATRIX].astype(float)
            a, b, c, d, e, f = m[0], m[1], m[3], m[4], m[5], m[7]
        elif SCALE in self.tags and TIE in self.tags:
            (sx, sy), (i, j, _, x, y) = self.tags[SCALE].astype(float)[:2], self.tags[TIE].astype(float)[:5]
            a, b, c, d, e, f = sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy
        else:
            return 1.0, 0.0, 0.0, 0.0, 1.0, 0.0
        keys = self.tags.get(KEYS, np.zeros(4, int)).astype(int).reshape(-1, 4)[1:]
        if any(k[0] == RASTER_TYPE and k[1] == 0 and k[3] == PIXEL_IS_POINT for k in keys):  # the tie is a pixel's centre
            c, f = c - (a + b) / 2, f - (d + e) / 2
        return tuple(map(float, (a, b, c, d, e, f)))

    def runs(self, size: int) -> Iterator[tuple[int, int]]:
        """Runs of a band's chunks, of about size bytes once unpacked."""
        own = self.chunk_width * self.chunk_height * self.kind.itemsize * (1 if self.planar else self.bands)
        each, n = max(1, size // max(1, own)), self.across * self.down
        yield from ((a, min(a + each, n)) for a in range(0, n, each))

    def chunk(self, k: int, band: int) -> tuple[int, int, np.ndarray]:
        """First row and column of the k-th chunk of a band, and its values inside the image. Chunks that were never written are
        without data."""
        row, col = k // self.across * self.chunk_height, k % self.across * self.chunk_width
        high = self.chunk_height if self.tiled else min(self.chunk_height, self.height - row)
        many = 1 if self.planar else self.bands
        shape = (high, self.chunk_width, many)
        i = k + (band * self.across * self.down if self.planar else 0)
        if self.sizes[i] == 0:
            values = np.full(shape, np.nan if self.nodata is None else self.nodata)
        else:
            raw = self._unpacked(self.source.at(int(self.places[i]), int(self.sizes[i])), int(np.prod(shape)) * self.kind.itemsize)
            if len(raw) < np.prod(shape) * self.kind.itemsize:
                raise ValueError(f"{self.name} ends within strip or tile {i}")
            values = self._summed(raw, shape)
        return row, col, values[: self.height - row, : self.width - col, 0 if self.planar else band]

    def _unpacked(self, raw: bytes, size: int) -> bytes:
        if self.packing == 5:
            return lzw(raw, size)
        if self.packing in (8, 32946):
            return zlib.decompressobj().decompress(raw, size)
        return packbits(raw, size) if self.packing == 32773 else raw

    def _summed(self, raw: bytes, shape: tuple[int, int, int]) -> np.ndarray:
        """Values from bytes, with differences between neighbours in a row undone."""
        high, wide, many = shape
        if self.predictor == 3:  # bytes of equal weight stand together, heaviest first, and differ byte by byte
            rows = np.frombuffer(raw, "u1", high * wide * many * self.kind.itemsize).reshape(high, -1, many)
            whole = np.cumsum(rows, axis=1, dtype="u1").reshape(high, self.kind.itemsize, wide * many)
            return np.ascontiguousarray(whole.transpose(0, 2, 1)).view(self.kind.newbyteorder(">")).reshape(shape)
        values = np.frombuffer(raw, self.kind, high * wide * many).reshape(shape)
        if self.predictor == 2:
            values = np.cumsum(values.view(f"{self.order}u{self.kind.itemsize}"), axis=1, dtype=f"u{self.kind.itemsize}").view(self.kind.newbyteorder("="))
        return values


def packbits(raw: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(raw) and len(out) < size:
        n = raw[i]
        if n < 128:
            out += raw[i + 1 : i + 2 + n]
            i += n + 2
        else:
            out += raw[i + 1 : i + 2] * (257 - n) if n > 128 else b""
            i += 2 if n > 128 else 1
    return bytes(out)


def lzw(raw: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, highest bit first, that grow one code early; 256 clears the table, 257 ends."""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, last, bits, held, many, at = list(first), [], b"", 9, 0, 0, 0
    length = 0
    while length < size:
        while many < bits and at < len(raw):
            held, many, at = held << 8 | raw[at], many + 8, at + 1
        if many < bits:
            break
        many -= bits
        code, held = held >> many, held & (1 << many) - 1
        if code == 257:
            break
        if code == 256:
            table, bits, last = list(first), 9, b""
            continue
        if code > len(table) or code == len(table) and not last:
            raise ValueError("a code of LZW stands before its entry")
        own = table[code] if code < len(table) else last + last[:1]
        out.append(own)
        length += len(own)
        if last:
            table.append(last + own[:1])
        last = own
        bits = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)[:size]


def _decode(batches, band: int, nodata: float | None):
    for batch in batches:
        for path, at, a, b in zip(*(batch.column(c).to_pylist() for c in ("path", "time", "a", "b"))):
            source = Bytes(path)
            tiff = Tiff(source, path)
            ax, bx, cx, ay, by, cy = tiff.affine()
            gone = nodata if nodata is not None else tiff.nodata
            for k in range(a, b):
                row, col, values = tiff.chunk(k, band - 1)
                v = values.astype(float).ravel()
                missing = ~np.isfinite(v)
                if gone is not None:  # as the file's own kind holds it
                    missing |= v == (float(tiff.kind.type(gone)) if tiff.kind.kind == "f" else gone)
                r, c = np.repeat(np.arange(row, row + values.shape[0]), values.shape[1]), np.tile(np.arange(col, col + values.shape[1]), values.shape[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at], pa.timestamp("us")).take(pa.array(np.zeros(len(v), np.int64))), pa.array(np.zeros(len(v), np.int32)), pa.array(r * tiff.width + c), pa.array(ay * (c + 0.5) + by * (r + 0.5) + cy), pa.array(ax * (c + 0.5) + bx * (r + 0.5) + cx), pa.array(v, mask=missing)],
                    ["time", "time_idx", "cell_id", "lat", "lon", "value"],
                )
            source.close()


def _runs(batches, band: int, pattern: str | None, size: int):
    for batch in batches:
        for path in batch.column("path").to_pylist():
            source = Bytes(path)
            tiff = Tiff(source, path)
            if not 1 <= band <= tiff.bands:
                raise ValueError(f"{path} has {tiff.bands} bands; {band} was asked for")
            runs = list(tiff.runs(size))
            source.close()
            n = len(runs)
            yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([date_of(path.rpartition("/")[2], pattern)] * n, pa.timestamp("us")), pa.array([a for a, _ in runs]), pa.array([b for _, b in runs])], ["path", "time", "a", "b"])


def read_geotiff(spark: SparkSession, path: str, pattern: str | None = None, nodata: float | None = None, band: int = 1, block: int = BLOCK) -> DataFrame:
    """A file, folder or glob of rasters as time, time_idx, cell_id (row * columns + column), lat, lon, value: centres of pixels by the
    transform, times from the files' names (NULL without one). nodata wins over the file's own; such values, NaN and infinities are NULL.

    Headers are read in tasks, once to count and once to deal out runs of strips or tiles of about `block` bytes; no task holds a whole
    file. The count gives the number of tasks, as runs are small rows of which adaptive execution would put many into one."""
    files = spark.read.format("binaryFile").load(path).select("path")  # the contents are not read
    runs = files.mapInArrow(lambda it: _runs(it, band, pattern, block), "path string, time timestamp_ntz, a bigint, b bigint")
    return runs.repartition(max(1, min(runs.count(), MOST_TASKS))).mapInArrow(lambda it: _decode(it, band, nodata), SCHEMA)
