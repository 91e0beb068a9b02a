"""Classic netCDF: round trips, hand-built files with records and scaled values, windows that reach the partitions."""

import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isobath.operators import profiles
from isobath.sources import environment, netcdf


def text(s):
    raw = s.encode()
    return struct.pack(">i", len(raw)) + raw.ljust(-(-len(raw) // 4) * 4, b"\0")


def pad(raw):
    return raw.ljust(-(-len(raw) // 4) * 4, b"\0")


def records_file(streamed=False):
    """CDF-1 by hand: time(record), lat(2), lon(3); t(time) double, s(time, lat, lon) scaled short, lat(lat) float."""
    none = struct.pack(">ii", 0, 0)
    values = np.arange(4 * 6).reshape(4, 2, 3).astype(">i2")
    values[1, 0, 2] = -999

    def head(begin):
        out = b"CDF\x01" + struct.pack(">i", -1 if streamed else 4)
        out += struct.pack(">ii", 10, 3) + b"".join(text(d) + struct.pack(">i", n) for d, n in (("time", 0), ("lat", 2), ("lon", 3)))
        out += struct.pack(">ii", 12, 1) + text("title") + struct.pack(">ii", 2, 5) + pad(b"small")
        out += struct.pack(">ii", 11, 3)
        out += text("lat") + struct.pack(">ii", 1, 1) + none + struct.pack(">iii", 5, 8, begin)
        out += text("time") + struct.pack(">ii", 1, 0) + none + struct.pack(">iii", 6, 8, begin + 8)
        scaled = struct.pack(">ii", 12, 3) + text("scale_factor") + struct.pack(">iid", 6, 1, 0.5) + text("add_offset") + struct.pack(">iid", 6, 1, 10.0) + text("_FillValue") + struct.pack(">iih", 3, 1, -999) + b"\0\0"
        return out + text("s") + struct.pack(">iiii", 3, 0, 1, 2) + scaled + struct.pack(">iii", 3, 12, begin + 16)

    begin = len(head(0))
    data = np.array([44.0, 45.0], ">f4").tobytes()
    for k in range(4):
        data += np.array([100.0 + k], ">f8").tobytes() + pad(values[k].tobytes())
    return head(begin) + data, values


@pytest.mark.parametrize("streamed", [False, True])
def test_records_scaling_and_fill(spark, tmp_path, streamed):
    raw, values = records_file(streamed)
    (tmp_path / "x.nc").write_bytes(raw)
    rows = netcdf.read(spark, str(tmp_path / "x.nc"), cells=4).collect()
    want = {(100.0 + k, 44.0 + i, j): None if values[k, i, j] == -999 else values[k, i, j] * 0.5 + 10 for k in range(4) for i in range(2) for j in range(3)}
    assert {(r.time, r.lat, r.lon): r.s for r in rows} == want and len(rows) == 24
    some = netcdf.read(spark, f"file://{tmp_path}", ["s"], {"time": (101.0, 102.5), "lon": (1, 2)}).filter("lat = 45")
    assert {(r.time, r.lat, r.lon): r.s for r in some.collect()} == {k: v for k, v in want.items() if k[0] in (101, 102) and k[1] == 45 and k[2] > 0}
    assert some.select("s").count() == 4


def test_gebco_round_trip(spark, tmp_path):
    rows = [(float(lon), float(lat), -100.0 * i - 50.0 * j) for i, lon in enumerate((9, 10, 11)) for j, lat in enumerate((44, 45))]
    df = spark.createDataFrame(rows, "longitude double, latitude double, elevation double")
    netcdf.write(df, str(tmp_path / "grid"), ["latitude", "longitude"], files=2)
    assert not [f for f in (tmp_path / "grid").iterdir() if f.name.startswith("_")]
    got = environment.raster_file(spark, str(tmp_path / "grid"), (9.0, 10.5), (44.0, 44.5))
    assert {tuple(r) for r in got.collect()} == {r for r in rows if r[0] < 10.5 and r[1] == 44}
    netcdf.write(df.limit(2), str(tmp_path / "grid"), ["latitude", "longitude"], mode="overwrite")
    assert netcdf.read(spark, str(tmp_path / "grid")).filter("elevation is not null").count() == 2


def test_profile_feeds_the_assembler(spark, tmp_path):
    depth, temp = [0.0, 50.0, 100.0, 200.0], [20.0, 15.0, 10.0, 4.0]
    rows = [(lat, lon, z, t + lat - 45.0) for lat in (45.0, 46.0) for lon in (10.0, 12.0) for z, t in zip(depth, temp, strict=True)]
    netcdf.write(spark.createDataFrame(rows, "lat double, lon double, depth double, temperature double"), str(tmp_path / "woa"), ["lat", "lon", "depth"], files=1)
    p = environment.profile_file(spark, str(tmp_path / "woa"), lon=10.4, lat=45.3, variable="temperature", vertical="depth")
    assert [tuple(r) for r in p.collect()] == list(zip(depth, temp, strict=True))
    grid = spark.createDataFrame([(1, 25.0)], "k int, depth double")
    got = profiles.interpolate(p.withColumn("k", F.lit(1)), grid, "k", "depth", "temperature").first()
    assert abs(got.temperature - 17.5) < 1e-10
    assert netcdf.nearest(str(tmp_path / "woa"), {"lat": 45.5, "lon": 13.0}) == {"lat": 45.0, "lon": 12.0}


def test_window_reaches_the_partitions(spark, tmp_path):
    df = spark.range(200).select((F.col("id") % 20).alias("x"), F.floor(F.col("id") / 20).cast("int").alias("y"), (F.col("id") * 2).cast("float").alias("v"))
    netcdf.write(df, str(tmp_path / "g"), ["y", "x"], files=5)
    every = netcdf.read(spark, str(tmp_path / "g"), cells=20)
    assert every.rdd.getNumPartitions() == 10 and every.count() == 200
    few = netcdf.read(spark, str(tmp_path / "g"), cells=20).filter((F.col("y") >= 3) & (F.col("y") < 5) & (F.col("x") > 17))
    assert few.rdd.getNumPartitions() == 2 and {(r.x, r.y, r.v) for r in few.collect()} == {(x, y, 2.0 * (20 * y + x)) for x in (18, 19) for y in (3, 4)}
    assert "Filter" not in few._jdf.queryExecution().executedPlan().toString().replace("Filters", "")
    assert netcdf.read(spark, str(tmp_path / "g"), window={"y": (50, None)}).collect() == []
    assert dict(every.dtypes) == {"y": "int", "x": "bigint", "v": "float"}


@pytest.mark.parametrize("kind", ["byte", "short", "int", "bigint", "float", "double"])
def test_types_and_nulls(spark, tmp_path, kind):
    df = spark.createDataFrame([(1.0, 5), (2.0, None), (3.0, -7)], "x double, v int").withColumn("v", F.col("v").cast(kind))
    netcdf.write(df, str(tmp_path / "t"), ["x"], files=1)
    back = netcdf.read(spark, str(tmp_path / "t"))
    assert back.schema["v"].dataType == df.schema["v"].dataType and sorted(map(tuple, back.collect())) == [(1.0, 5), (2.0, None), (3.0, -7)]


def test_reads_of_any_box_equal_slicing():
    raw, values = records_file()
    grid = np.arange(4 * 3 * 5, dtype=np.float64).reshape(4, 3, 5)
    fixed = netcdf.file_bytes(["a", "b", "c"], [np.arange(4.0), np.arange(3.0), np.arange(5.0)], {"v": grid.reshape(-1)}, dict.fromkeys("abcv", 6))
    for data, name, want in ((raw, "s", values), (fixed, "v", grid)):
        file = pa.BufferReader(data)
        head = netcdf.read_header(file)
        n = want.shape
        boxes = [[(a, b) for a in range(m) for b in range(a, m + 1)] for m in n]
        for x in boxes[0]:
            for y in boxes[1]:
                for z in boxes[2]:
                    got = netcdf.read_slab(file, head, head.variables[name], [x, y, z])
                    assert (got == want[x[0] : x[1], y[0] : y[1], z[0] : z[1]]).all()


def test_errors(spark, tmp_path):
    (tmp_path / "bad.nc").write_bytes(b"HDF not classic")
    for path, error in (("bad.nc", "no classic netCDF"), ("none", "no netCDF file")):
        with pytest.raises(Exception, match=error):
            netcdf.read(spark, str(tmp_path / path)).collect()
    raw, _ = records_file()
    (tmp_path / "x.nc").write_bytes(raw)
    with pytest.raises(Exception, match="no variable q"):
        netcdf.read(spark, str(tmp_path / "x.nc"), ["q"]).collect()
    with pytest.raises(Exception, match="different dimensions"):
        netcdf.read(spark, str(tmp_path / "x.nc"), ["s", "lat"]).collect()
    (tmp_path / "cut.nc").write_bytes(raw[:90])
    with pytest.raises(Exception, match="ends inside its header"):
        netcdf.read(spark, str(tmp_path / "cut.nc")).collect()
    twice = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, v double")
    with pytest.raises(Exception, match="two rows at one place"):
        netcdf.write(twice, str(tmp_path / "t"), ["x"], files=1)
    assert not (tmp_path / "t").exists() or list((tmp_path / "t").iterdir()) == []
    with pytest.raises(Exception, match="no type of the format"):
        netcdf.write(twice.withColumn("v", F.lit("a")), str(tmp_path / "t"), ["x"], files=1)
