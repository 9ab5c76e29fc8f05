import datetime as dt
import struct
import zlib

import numpy as np
import pytest

from rainframe.sources import geotiff, readers

SIZES = {"H": 2, "I": 4, "Q": 8, "d": 8, "s": 1}
KINDS = {"s": 2, "H": 3, "I": 4, "d": 12, "Q": 16}


def lzw(raw):
    """As the format's description has it: codes grow after entry 511, 1023 and 2047, and the table is cleared at 4094."""
    out, held, many = bytearray(), 0, 0

    def put(code, bits):
        nonlocal held, many
        held, many = held << bits | code, many + bits
        while many >= 8:
            many -= 8
            out.append(held >> many & 255)
        held &= (1 << many) - 1

    fresh = lambda: {bytes([i]): i for i in range(256)}
    table, n, bits, run = fresh(), 258, 9, b""
    put(256, 9)
    for byte in raw:
        if run + bytes([byte]) in table:
            run += bytes([byte])
            continue
        put(table[run], bits)
        table[run + bytes([byte])] = n
        bits = 9 if n < 511 else 10 if n < 1023 else 11 if n < 2047 else 12
        n += 1
        if n == 4095:
            put(256, 12)
            table, n, bits = fresh(), 258, 9
        run = bytes([byte])
    if run:
        put(table[run], bits)
        n += 1
        bits = 9 if n <= 511 else 10 if n <= 1023 else 11 if n <= 2047 else 12
    put(257, bits)
    if many:
        put(0, 8 - many)
    return bytes(out)


def packbits(raw):
    out, i = bytearray(), 0
    while i < len(raw):
        n = 1
        while n < 128 and i + n < len(raw) and raw[i + n] == raw[i]:
            n += 1
        if n > 1:
            out += bytes([257 - n, raw[i]])
        else:
            while n < 128 and i + n < len(raw) and raw[i + n] != raw[i + n - 1]:
                n += 1
            out += bytes([n - 1]) + raw[i : i + n]
        i += n
    return bytes(out)


PACK = {1: bytes, 5: lzw, 8: zlib.compress, 32773: packbits}


def tiff(bands, order="<", big=False, tile=None, rows=None, packing=1, predictor=1, planar=False, place=((100.0, 40.0), (0.5, 0.25)), point=False, nodata=None, empty=()):
    """A file by its published layout. bands: (band, row, column); tile: (rows, columns) of a tile; empty: chunks never written."""
    n, high, wide = bands.shape
    kind = bands.dtype.newbyteorder(order)
    th, tw = tile or (rows or high, wide)
    chunks = []
    for group in [bands[i : i + 1] for i in range(n)] if planar else [bands]:
        for r in range(0, high, th):
            for c in range(0, wide, tw):
                own = group[:, r : r + th, c : c + tw].transpose(1, 2, 0)
                if tile:
                    own = np.pad(own, ((0, th - own.shape[0]), (0, tw - own.shape[1]), (0, 0)))
                if predictor == 2:
                    bits = own.view(f"u{own.dtype.itemsize}") if own.flags.c_contiguous else np.ascontiguousarray(own).view(f"u{own.dtype.itemsize}")
                    raw = np.diff(bits, axis=1, prepend=np.zeros_like(bits[:, :1])).astype(f"{order}u{own.dtype.itemsize}").tobytes()
                elif predictor == 3:
                    flat = np.ascontiguousarray(own).astype(own.dtype.newbyteorder(">")).reshape(len(own), -1)
                    planes = flat.view("u1").reshape(len(own), -1, own.dtype.itemsize).transpose(0, 2, 1).reshape(len(own), -1)
                    raw = np.diff(planes, axis=1, prepend=np.zeros_like(planes[:, :1])).tobytes()
                else:
                    raw = own.astype(kind).tobytes()
                chunks.append(b"" if len(chunks) in empty else PACK[packing](raw))
    wide_kind = "Q" if big else "I"
    start = 16 if big else 8
    places = np.cumsum([start, *map(len, chunks)])[:-1].tolist()
    tags = {256: ("I", [wide]), 257: ("I", [high]), 258: ("H", [kind.itemsize * 8] * n), 259: ("H", [packing]), 277: ("H", [n]), 284: ("H", [2 if planar else 1]), 317: ("H", [predictor]), 339: ("H", [{"u": 1, "i": 2, "f": 3}[kind.kind]] * n)}
    tags |= {322: ("I", [tw]), 323: ("I", [th]), 324: (wide_kind, places), 325: (wide_kind, [len(c) for c in chunks])} if tile else {278: ("I", [th]), 273: (wide_kind, places), 279: (wide_kind, [len(c) for c in chunks])}
    if place:
        (x, y), (sx, sy) = place
        tags |= {33550: ("d", [sx, sy, 0.0]), 33922: ("d", [0.0, 0.0, 0.0, x, y, 0.0]), 34735: ("H", [1, 1, 0, 1, 1025, 0, 1, 2 if point else 1])}
    if nodata is not None:
        tags[42113] = ("s", str(nodata).encode() + b"\0")
    body = b"".join(chunks)
    at = start + len(body)
    entry, inline = (20, 8) if big else (12, 4)
    after = at + (8 if big else 2) + entry * len(tags) + (8 if big else 4)
    directory, outside = struct.pack(order + ("Q" if big else "H"), len(tags)), b""
    for tag, (k, values) in sorted(tags.items()):
        raw = values if k == "s" else struct.pack(f"{order}{len(values)}{k}", *values)
        directory += struct.pack(order + ("HHQ" if big else "HHI"), tag, KINDS[k], len(values))
        if len(raw) <= inline:
            directory += raw.ljust(inline, b"\0")
        else:
            directory += struct.pack(order + wide_kind, after + len(outside))
            outside += raw
    head = struct.pack(order + "2sHHHQ", b"II" if order == "<" else b"MM", 43, 8, 0, at) if big else struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, at)
    return head + body + directory + bytes(8 if big else 4) + outside


def grid(kind="f4", bands=1, seed=3):
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 250, (bands, 37, 29)) / (4 if kind[0] == "f" else 1)).astype(kind)


LAYOUTS = [
    {},
    {"order": ">", "rows": 5},
    {"big": True, "tile": (16, 16)},
    {"packing": 5, "rows": 7},
    {"packing": 5, "tile": (16, 32), "predictor": 2, "kind": "i2"},
    {"packing": 8, "tile": (16, 16), "predictor": 3},
    {"packing": 8, "tile": (16, 16), "predictor": 3, "kind": "f8", "order": ">"},
    {"packing": 8, "predictor": 2, "kind": "u1", "rows": 10, "bands": 3},
    {"packing": 8, "predictor": 2, "kind": "i4", "order": ">"},
    {"packing": 32773, "kind": "u1"},
    {"planar": True, "bands": 2, "tile": (16, 16), "big": True, "order": ">"},
    {"bands": 3, "tile": (16, 16), "packing": 5},
]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(layout):
    layout = dict(layout)
    bands = grid(layout.pop("kind", "f4"), layout.pop("bands", 1))
    held = geotiff.Tiff(geotiff.Bytes(tiff(bands, **layout)), "t")
    for band in range(len(bands)):
        got = np.full(bands.shape[1:], -1.0)
        for k in range(held.across * held.down):
            r, c, v = held.chunk(k, band)
            got[r : r + v.shape[0], c : c + v.shape[1]] = v
        assert np.array_equal(got, bands[band])
    for size in (1, 5000, 1 << 20):
        runs = list(held.runs(size))
        assert [k for a, b in runs for k in range(a, b)] == list(range(held.across * held.down))


def test_codes_of_lzw():
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]  # the example of the format's description
    bits = "".join(f"{c:09b}" for c in codes).ljust(88, "0")
    assert geotiff.lzw(int(bits, 2).to_bytes(11, "big"), 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    rng = np.random.default_rng(1)
    for raw in (b"", b"a" * 100000, rng.integers(0, 256, 60000).astype("u1").tobytes(), rng.integers(0, 3, 60000).astype("u1").tobytes()):
        assert geotiff.lzw(lzw(raw), len(raw)) == raw
    with pytest.raises(ValueError, match="before its entry"):
        geotiff.lzw(int(f"{256:09b}{300:09b}".ljust(24, "0"), 2).to_bytes(3, "big"), 4)


def test_a_stack_of_files(spark, tmp_path):
    first, second = grid("f4"), grid("f4", seed=4)
    first[0, 0, 0], first[0, 1, 1], first[0, 2, 2] = -9999, np.nan, np.inf
    (tmp_path / "pr_20010203.tif").write_bytes(tiff(first, tile=(16, 16), packing=8, nodata=-9999))
    (tmp_path / "pr_2001-02-04.tif").write_bytes(tiff(second, rows=4, order=">"))
    df = readers.read_grid(spark, str(tmp_path / "*.tif"), block=2000)
    rows = df.collect()
    assert df.rdd.getNumPartitions() > 1 and len(rows) == 2 * 37 * 29
    for day, bands in ((dt.datetime(2001, 2, 3), first), (dt.datetime(2001, 2, 4), second)):
        own = {r.cell_id: r for r in rows if r.time == day}
        assert sorted(own) == list(range(37 * 29))
        flat = bands[0].ravel()
        for i in (0, 30, 60, 61, 500, 1072):
            want = None if not np.isfinite(flat[i]) or flat[i] == -9999 else flat[i]
            assert own[i].value == want and own[i].lat == 40.0 - 0.25 * (i // 29 + 0.5) and own[i].lon == 100.0 + 0.5 * (i % 29 + 0.5)
    given = geotiff.read_geotiff(spark, str(tmp_path / "pr_20010203.tif"), nodata=float(first[0, 0, 1]))
    assert given.where("cell_id = 1").first().value is None and given.where("cell_id = 0").first().value == -9999


def test_places_and_bands(spark, tmp_path):
    bands = grid("u1", 2)
    (tmp_path / "a.tif").write_bytes(tiff(bands, point=True, planar=True))
    (tmp_path / "b.tif").write_bytes(tiff(bands, place=None))
    at = {r.cell_id: r for r in geotiff.read_geotiff(spark, str(tmp_path / "a.tif"), band=2).collect()}
    assert (at[30].lon, at[30].lat, at[30].value, at[30].time) == (100.5, 39.75, bands[1, 1, 1], None)
    at = {r.cell_id: r for r in geotiff.read_geotiff(spark, str(tmp_path / "b.tif")).collect()}
    assert (at[30].lon, at[30].lat, at[30].value) == (1.5, 1.5, bands[0, 1, 1])
    with pytest.raises(Exception, match="bands"):
        geotiff.read_geotiff(spark, str(tmp_path / "a.tif"), band=3).collect()


def test_chunks_never_written():
    bands = grid("f4")
    held = geotiff.Tiff(geotiff.Bytes(tiff(bands, tile=(16, 16), empty=(1,))), "t")
    assert np.isnan(held.chunk(1, 0)[2]).all() and np.isfinite(held.chunk(0, 0)[2]).all()
    held = geotiff.Tiff(geotiff.Bytes(tiff(bands, tile=(16, 16), empty=(1,), nodata=-1)), "t")
    assert (held.chunk(1, 0)[2] == -1).all()


def test_what_is_not_read_is_an_error():
    good = tiff(grid("f4"), packing=8)
    with pytest.raises(ValueError, match="no TIFF"):
        geotiff.Tiff(geotiff.Bytes(b"GIF89a" + good), "t")
    with pytest.raises(ValueError, match="no TIFF"):
        geotiff.Tiff(geotiff.Bytes(b""), "t")
    jpeg = good.replace(struct.pack("<HHIHH", 259, 3, 1, 8, 0), struct.pack("<HHIHH", 259, 3, 1, 7, 0))
    with pytest.raises(ValueError, match="compressed"):
        geotiff.Tiff(geotiff.Bytes(jpeg), "t")
    cut = geotiff.Tiff(geotiff.Bytes(tiff(grid("f4"))), "t")
    cut.sizes = cut.sizes - 8
    with pytest.raises(ValueError, match="ends within"):
        cut.chunk(0, 0)
