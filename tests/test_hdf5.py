import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainframe.sources import gridfile, hdf5, readers
from rainframe.sources.bytes_at import Bytes

from .hdf5_files import Writer
from .test_netcdf import classic

LAT, LON = np.array([10.0, 10.5]), np.array([1.0, 2.0, 3.0], ">f4")
DAYS = {"units": "days since 2001-01-01", "calendar": "standard"}


def rain(n_t=10):
    v = np.arange(n_t * 6, dtype="<f4").reshape(n_t, 2, 3) / 4
    v[1, 0, 2] = -9999
    return v


def netcdf4(values, new=False, chunk=(3, 2, 2), filters=(2, 1), group=None, turned=False, **how):
    w = Writer(new)
    cube = values.transpose(0, 2, 1).copy() if turned else values
    links = {"lat": w.dataset(LAT), "lon": w.dataset(LON, (2,), filters=(1,)), "time": w.dataset(np.arange(len(values), dtype="<i4"), None, DAYS)}
    links["pr"] = w.dataset(cube, chunk, {"_FillValue": np.array([-9999], "<f4")}, filters, **how)
    return w.done(w.group({group: w.group(links)} if group else links))


def expect(values):
    return [(dt.datetime(2001, 1, 1) + dt.timedelta(t), c, None if v == -9999 else float(v)) for t, step in enumerate(values) for c, v in enumerate(step.ravel())]


def read(spark, path, **how):
    return [(r.time, r.cell_id, r.value) for r in readers.read_grid(spark, str(path), **how).orderBy("time", "cell_id").collect()]


@pytest.mark.parametrize("how", [{}, {"new": True}, {"chunk": None, "filters": ()}, {"chunk": (4, 1, 3), "filters": (2, 1, 3)}, {"chunk": (10, 3, 2), "turned": True}, {"filters": ()}])
def test_layouts_equal_what_was_written(spark, tmp_path, how):
    (tmp_path / "a.nc4").write_bytes(netcdf4(rain(), **how))
    assert read(spark, tmp_path / "a.nc4") == expect(rain())


def test_group_and_missing_chunks(spark, tmp_path):
    (tmp_path / "a.h5").write_bytes(netcdf4(rain(), group="Grid", fill=-9999, skip={(1, 0, 0)}))
    want = rain()
    want[3:6, :, :2] = -9999
    assert read(spark, tmp_path / "a.h5", group="Grid") == expect(want)


def test_a_file_of_many_steps_is_read_by_several_tasks_and_a_filter_reads_its_blocks_only(spark, tmp_path):
    values = rain(40)
    (tmp_path / "a.nc4").write_bytes(netcdf4(values))
    plain = classic({"time": 0, "lat": 2, "lon": 3}, {"lat": (["lat"], {}, LAT.astype(">f8")), "lon": (["lon"], {}, LON), "time": (["time"], DAYS, np.arange(40, dtype=">f8")), "pr": (["time", "lat", "lon"], {"_FillValue": np.array([-9999], ">f4")}, values.astype(">f4"))}, 40)
    (tmp_path / "b.nc").write_bytes(plain)
    for name in ("a.nc4", "b.nc"):
        df = gridfile.read_file_grids(spark, str(tmp_path / name), block=6 * 24)
        assert df.rdd.getNumPartitions() == 7  # blocks of six steps
        assert df.count() == 240
        late = df.where(F.col("time") >= F.lit("2001-02-05").cast("timestamp_ntz"))
        assert late.count() == 30 and gridfile.read_file_grids(spark, str(tmp_path / name), block=6 * 24, since="2001-01-08", until="2001-01-12").rdd.getNumPartitions() == 1
        opened = gridfile.Opened(str(tmp_path / name), None, None, None)
        assert list(opened.blocks(6 * 24)) == [(i, min(i + 6, 40)) for i in range(0, 40, 6)]


def test_filters_leave_out_blocks(tmp_path):
    import json

    (tmp_path / "a.nc4").write_bytes(netcdf4(rain(40)))
    reader = gridfile.GridReader({"paths": json.dumps([str(tmp_path / "a.nc4")]), "block": str(6 * 24)})
    left = list(reader.pushFilters([gridfile.GreaterThan(("time",), dt.datetime(2001, 1, 20)), gridfile.LessThanOrEqual(("time",), dt.datetime(2001, 1, 26)), gridfile.EqualTo(("cell_id",), 3)]))
    assert len(left) == 3 and [p.value[1:] for p in reader.partitions()] == [(18, 24), (24, 30)]


def test_only_the_steps_asked_for_are_read(tmp_path):
    (tmp_path / "a.nc4").write_bytes(netcdf4(rain(40)))
    opened = gridfile.Opened(str(tmp_path / "a.nc4"), None, None, None)
    asked, at = [], opened.source.at
    opened.source.at = lambda o, n: asked.append(n) or at(o, n)
    got = dict(opened.steps(12, 18))
    assert sorted(got) == list(range(12, 18)) and got[13].tolist() == rain(40)[13].ravel().tolist()
    file = hdf5.File(Bytes(str(tmp_path / "a.nc4")))
    assert len(hdf5.Dataset(file, "pr").read(12, 18)) == 6


def test_ambiguous_and_undecoded(spark, tmp_path):
    w = Writer()
    (tmp_path / "a.h5").write_bytes(w.done(w.group({"lat": w.dataset(LAT), "lon": w.dataset(LON), "p": w.dataset(np.zeros((2, 3))), "q": w.dataset(np.ones((2, 3)))})))
    with pytest.raises(Exception, match="name one"):
        read(spark, tmp_path / "a.h5")
    assert {v for _, _, v in read(spark, tmp_path / "a.h5", var="q")} == {1.0}
    w = Writer()
    bad = w.dataset(np.zeros((2, 3)), (2, 3), filters=(7,))
    with pytest.raises(ValueError, match="filter 7"):
        hdf5.Dataset(hdf5.File(Bytes(w.done(w.group({"p": bad})))), "p")
    with pytest.raises(ValueError, match="not an HDF5"):
        hdf5.File(Bytes(b"other"))
    assert hdf5.axes_of((3, 2), {"lat": 2, "lon": 3}) == ("lon", "lat") and hdf5.axes_of((4, 3, 2), {"lat": 2, "lon": 3}) == ("time", "lon", "lat")
    assert hdf5.axes_of((2, 2), {"lat": 2, "lon": 2}) == ("lat", "lon") and hdf5.axes_of((2,), {}) is None
