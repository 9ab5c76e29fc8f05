import datetime as dt
import gzip
import struct

import numpy as np
import pytest

from rainframe.sources import netcdf, readers

KINDS = {"i2": 3, "f4": 5, "f8": 6}


def name(s):
    raw = s.encode()
    return struct.pack(">I", len(raw)) + raw + b"\0" * (-len(raw) % 4)


def attributes(a):
    if not a:
        return struct.pack(">II", 0, 0)
    out = struct.pack(">II", 12, len(a))
    for k, v in a.items():
        if isinstance(v, str):
            out += name(k) + struct.pack(">I", 2) + name(v)
        else:
            kind = v.dtype.str[1:]
            raw = v.astype(">" + kind).tobytes()
            out += name(k) + struct.pack(">II", KINDS[kind], v.size) + raw + b"\0" * (-len(raw) % 4)
    return out


def classic(dims, variables, records=None, streamed=False, version=1):
    """A classic file by its published layout. dims: name -> length (0: grows); variables: name -> (dims, attributes, array)."""
    names = list(dims)
    grows = {k for k, (d, _, _) in variables.items() if d and dims[d[0]] == 0}
    pad = len(grows) > 1
    size = lambda raw, k: raw + b"\0" * (-len(raw) % 4) if pad or k not in grows else raw
    data = {k: [size(part.tobytes(), k) for part in (np.split(v, len(v)) if k in grows and len(v) else [v])] for k, (_, _, v) in variables.items()}
    begins = {k: 0 for k in variables}
    where = ">I" if version == 1 else ">Q"

    def header():
        out = b"CDF" + bytes([version]) + struct.pack(">I", 0xFFFFFFFF if streamed else records or 0)
        out += struct.pack(">II", 10, len(dims)) + b"".join(name(k) + struct.pack(">I", n) for k, n in dims.items()) + attributes({"title": "made up"})
        out += struct.pack(">II", 11, len(variables))
        for k, (d, a, v) in variables.items():
            out += name(k) + struct.pack(">I", len(d)) + b"".join(struct.pack(">I", names.index(x)) for x in d) + attributes(a) + struct.pack(">II", KINDS[v.dtype.str[1:]], len(data[k][0]) if data[k] else 0) + struct.pack(where, begins[k])
        return out

    at = len(header())
    for k in [*(k for k in variables if k not in grows), *(k for k in variables if k in grows)]:
        begins[k] = at
        at += len(data[k][0]) if data[k] else 0
    body = b"".join(data[k][0] for k in variables if k not in grows)
    body += b"".join(data[k][i] for i in range(records or 0) for k in variables if k in grows)
    return header() + body


LAT, LON = np.array([10.0, 10.5], ">f8"), np.array([1.0, 2.0, 3.0], ">f4")
TIMES = np.array([0.0, 1.5], ">f8")
PACKED = np.array([[[1, -9, 3], [4, 5, 6]], [[7, 8, 9], [-9, 11, 12]]], ">i2")
MARKS = {"_FillValue": np.array([-9], ">i2"), "scale_factor": np.array([0.5], ">f8"), "add_offset": np.array([1.0], ">f8")}


def records_file(**how):
    dims = {"time": 0, "lat": 2, "lon": 3}
    own = {"lat": (["lat"], {}, LAT), "lon": (["lon"], {}, LON), "time": (["time"], {"units": "days since 2001-1-2 06:00:00", "calendar": "standard"}, TIMES), "pr": (["time", "lat", "lon"], MARKS, PACKED)}
    return classic(dims, own, 2, **how)


WANT = [(dt.datetime(2001, 1, 2, 6), c, v) for c, v in enumerate([1.5, None, 2.5, 3, 3.5, 4])] + [(dt.datetime(2001, 1, 3, 18), c, v) for c, v in enumerate([4.5, 5, 5.5, None, 6.5, 7])]


@pytest.mark.parametrize("how", [{}, {"streamed": True}, {"version": 2}])
def test_growing_variables(spark, tmp_path, how):
    (tmp_path / "a.nc").write_bytes(records_file(**how))
    rows = readers.read_grid(spark, str(tmp_path / "a.nc")).collect()
    assert [(r.time, r.cell_id, r.value) for r in sorted(rows, key=lambda r: (r.time, r.cell_id))] == WANT
    assert {(r.lat, r.lon) for r in rows if r.cell_id == 5} == {(10.5, 3.0)}


def test_packed_files_and_a_chosen_variable(spark, tmp_path):
    (tmp_path / "a.nc.gz").write_bytes(gzip.compress(records_file()))
    assert readers.read_grid(spark, str(tmp_path / "a.nc.gz"), var="pr").count() == 12
    with pytest.raises(Exception, match="no grid 'x'"):
        readers.read_grid(spark, str(tmp_path / "a.nc.gz"), var="x").collect()


def test_fixed_axes_in_another_order_and_times_from_names(spark, tmp_path):
    v = np.arange(6, dtype=">f4").reshape(3, 2)
    for day in ("20010102", "20010103"):
        (tmp_path / f"pr_{day}.nc").write_bytes(classic({"longitude": 3, "latitude": 2}, {"longitude": (["longitude"], {}, LON), "latitude": (["latitude"], {}, LAT), "pr": (["longitude", "latitude"], {}, v)}))
    rows = readers.read_grid(spark, str(tmp_path / "*.nc")).collect()
    assert {r.time for r in rows} == {dt.datetime(2001, 1, 2), dt.datetime(2001, 1, 3)} and len(rows) == 12
    assert {(r.lat, r.lon): r.value for r in rows} == {(float(a), float(o)): float(v[j, i]) for i, a in enumerate(LAT) for j, o in enumerate(LON)}


def test_no_time_step_and_one_growing_variable():
    dims = {"time": 0, "lat": 1, "lon": 1}
    alone = classic(dims, {"pr": (["time", "lat", "lon"], {}, np.array([[[1]], [[2]], [[3]]], ">i2"))}, 3)
    assert netcdf.parse(alone)["pr"].values.ravel().tolist() == [1, 2, 3]
    none = classic(dims, {"time": (["time"], {}, np.zeros(0, ">f8")), "pr": (["time", "lat", "lon"], {}, np.zeros((0, 1, 1), ">i2"))}, 0)
    assert netcdf.parse(none)["pr"].values.shape == (0, 1, 1)


def test_what_is_not_decoded(spark, tmp_path):
    (tmp_path / "a.nc").write_bytes(b"\x89HDF\r\n\x1a\n")
    with pytest.raises(Exception, match="cut short"):
        readers.read_grid(spark, str(tmp_path / "a.nc")).collect()
    with pytest.raises(ValueError, match="not a classic"):
        netcdf.parse(b"")
    with pytest.raises(ValueError, match="calendar"):
        netcdf.decode_times(TIMES, {"units": "days since 2001-01-01", "calendar": "julian"})
    with pytest.raises(ValueError, match="months"):
        netcdf.decode_times(TIMES, {"units": "months since 2001-01-01"})


@pytest.mark.parametrize("calendar", ["noleap", "365_day", "all_leap", "366_day", "360_day"])
def test_calendars_whose_years_are_alike(calendar):
    """Every day of four years, numbered by hand, comes back; days that the usual calendar lacks are None."""
    months = netcdf.ALIKE[calendar]
    days = [(y, m + 1, d + 1) for y in range(1999, 2003) for m in range(12) for d in range(months[m])]
    at = days.index((2000, 2, 27))
    got = netcdf.decode_times(np.arange(len(days)) - at + 0.25, {"units": "days since 2000-02-27 06:00", "calendar": calendar})

    def usual(y, m, d):
        try:
            return dt.datetime(y, m, d, 12)
        except ValueError:
            return None

    assert got == [usual(*x) for x in days]
    assert netcdf.decode_times(np.array([36.0]), {"units": "hours since 2000-12-30", "calendar": calendar})[0] == (dt.datetime(2001, 1, 1, 12) if calendar == "360_day" else dt.datetime(2000, 12, 31, 12))
