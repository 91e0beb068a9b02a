"""Classic netCDF (CDF-1, CDF-2, CDF-5) as a Spark data source, read and written in parallel without a reader package.

``spark.read.format("isobath_netcdf")`` takes a file or a folder of files. A row is a place of the grid: a column for
each dimension, with the coordinate if the file has a variable of that name and the index otherwise, and one for each
variable on these dimensions. Fill values are null; ``scale_factor`` and ``add_offset`` are applied.

Comparisons of dimension columns with constants become ranges of indices, by filters where
``spark.sql.python.filterPushdown.enabled`` is on (``register`` sets it) and by the option ``window`` always. Only
slabs inside the window become partitions, of about ``cells`` places each, and a task reads the bytes of its own slab
by position; the driver sees headers and coordinates. A grid may thus be far larger than a machine.

``df.write.format("isobath_netcdf").option("dims", "lat,lon")`` writes a file a task, on the product of the coordinates
that its rows have; a place without a row is a fill value, and two rows at one place are an error. Deal rows to tasks by
ranges of the first dimension. Files appear when all tasks are done, and none are left by tasks that fail.

Files are reached through Arrow's file systems (local and mounted folders, S3, GCS, HDFS), by URI or absolute path.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

FORMAT = "isobath_netcdf"
CELLS = 1 << 20
BATCH = 1 << 16
# Fixed values of the format: types by number, their fill values, and the tags of its lists.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
FILLS = {1: -127, 3: -32767, 4: -2147483647, 5: 9.969209968386869e36, 6: 9.969209968386869e36, 10: -9223372036854775806}
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
_SPARK = {">i1": T.ByteType(), ">i2": T.ShortType(), ">i4": T.IntegerType(), ">f4": T.FloatType(), ">f8": T.DoubleType(), ">u1": T.ShortType(), ">u2": T.IntegerType(), ">u4": T.LongType(), ">i8": T.LongType(), ">u8": T.DecimalType(20, 0)}
_NUMBER = {T.ByteType(): 1, T.ShortType(): 3, T.IntegerType(): 4, T.FloatType(): 5, T.DoubleType(): 6, T.LongType(): 10}


def open_fs(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a URI or an absolute path, and the path in it."""
    return arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else arrow_fs.FileSystem.from_uri(path.replace(":/", ":///", 1))


@dataclass
class Variable:
    name: str
    dims: list[str]
    kind: int
    begin: int
    attributes: dict
    record: bool = False

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(TYPES[self.kind])

    @property
    def scaled(self) -> bool:
        return "scale_factor" in self.attributes or "add_offset" in self.attributes

    def spark_type(self) -> T.DataType:
        if self.kind == 2:
            raise ValueError(f"variable {self.name} holds text")
        return T.DoubleType() if self.scaled else _SPARK[TYPES[self.kind]]


@dataclass
class Header:
    dims: dict[str, int] = field(default_factory=dict)
    variables: dict[str, Variable] = field(default_factory=dict)
    attributes: dict = field(default_factory=dict)
    record_bytes: int = 0

    def inner(self, v: Variable) -> int:
        """Values of a variable behind one index of its first dimension."""
        return math.prod(self.dims[d] for d in v.dims[1:])

    def stride(self, v: Variable) -> int:
        """Bytes from one index of the first dimension to the next."""
        return self.record_bytes if v.record else self.inner(v) * v.dtype.itemsize


class _Cursor:
    """Reads a header from the start of a file, fetching more as it goes."""

    def __init__(self, file, step: int = 1 << 16):
        self.file, self.step, self.data, self.at = file, step, b"", 0

    def take(self, n: int) -> bytes:
        while len(self.data) < self.at + n:
            more = self.file.read_at(max(self.step, n), len(self.data))
            if not more:
                raise ValueError("the file ends inside its header")
            self.data += more
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, size: int = 4) -> int:
        return int.from_bytes(self.take(size), "big")


def _padded(n: int) -> int:
    return -(-n // 4) * 4


def read_header(file) -> Header:
    """The header of an open file; ValueError if it is no classic netCDF."""
    c = _Cursor(file)
    magic = c.take(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
        raise ValueError("no classic netCDF file")
    wide = 8 if magic[3] == 5 else 4
    place = 4 if magic[3] == 1 else 8
    records = c.number(wide)
    text = lambda: (c.take(_padded(n := c.number(wide)))[:n]).decode()

    def items(tag: int, one):
        found = c.number()
        n = c.number(wide)
        if n and found != tag:
            raise ValueError(f"list {found} where {tag} belongs")
        return [one() for _ in range(n)]

    def attribute():
        name, kind, n = text(), c.number(), c.number(wide)
        dtype = np.dtype(TYPES[kind])
        raw = c.take(_padded(n * dtype.itemsize))[: n * dtype.itemsize]
        if kind == 2:
            return name, raw.decode(errors="replace")
        values = np.frombuffer(raw, dtype).tolist()
        return name, values[0] if n == 1 else values

    head = Header()
    order = items(DIMENSION, lambda: (text(), c.number(wide)))
    head.dims = dict(order)
    head.attributes = dict(items(ATTRIBUTE, attribute))

    def variable():
        name = text()
        dims = [order[c.number(wide)][0] for _ in range(c.number(wide))]
        attributes = dict(items(ATTRIBUTE, attribute))
        kind, _, begin = c.number(), c.number(wide), c.number(place)
        return Variable(name, dims, kind, begin, attributes, bool(dims) and head.dims[dims[0]] == 0)

    head.variables = {v.name: v for v in items(VARIABLE, variable)}
    growing = [v for v in head.variables.values() if v.record]
    sizes = [head.inner(v) * v.dtype.itemsize for v in growing]
    head.record_bytes = sizes[0] if len(sizes) == 1 else sum(map(_padded, sizes))
    for name, n in order:
        if n == 0:
            if records == 256**wide - 1:  # written as a stream: the size tells
                records = (file.size() - min(v.begin for v in growing)) // head.record_bytes if head.record_bytes else 0
            head.dims[name] = records
    return head


def read_slab(file, head: Header, v: Variable, window: list[tuple[int, int]]) -> np.ndarray:
    """The stored values at ranges of indices, one a dimension, by as few reads as their layout allows."""
    sizes = [head.dims[d] for d in v.dims]
    if not sizes:
        return np.frombuffer(file.read_at(v.dtype.itemsize, v.begin), v.dtype).reshape(())
    shape = [hi - lo for lo, hi in window]
    out = np.empty(shape, v.dtype)
    if not out.size:
        return out
    # dimensions from `full` on are taken whole, so what lies behind one index before them is one run of bytes
    full = len(sizes)
    while full > 1 and window[full - 1] == (0, sizes[full - 1]):
        full -= 1
    size, stride = v.dtype.itemsize, head.stride(v)
    if full == 1 and not v.record:
        raw = file.read_at(shape[0] * stride, v.begin + window[0][0] * stride)
        return np.frombuffer(raw, v.dtype).reshape(shape)
    run = math.prod(sizes[full:]) * size
    steps = [stride] + [math.prod(sizes[k + 1 :]) * size for k in range(1, len(sizes))]
    length = shape[full - 1] * run if full > 1 else run
    for index in np.ndindex(*(shape[: full - 1] if full > 1 else shape[:1])):
        at = v.begin + sum((window[k][0] + i) * steps[k] for k, i in enumerate(index))
        if full > 1:
            at += window[full - 1][0] * steps[full - 1]
        out[index] = np.frombuffer(file.read_at(length, at), v.dtype).reshape(out[index].shape)
    return out


def decoded(values: np.ndarray, v: Variable) -> pa.Array:
    """Stored values as an Arrow column: missing ones null, scaled ones as doubles."""
    flat = values.reshape(-1)
    missing = np.zeros(len(flat), bool)
    for name in ("_FillValue", "missing_value"):
        if name in v.attributes:
            for x in np.atleast_1d(v.attributes[name]):
                missing |= np.isnan(flat) if isinstance(x, float) and math.isnan(x) else flat == np.asarray(x, v.dtype)
    plain = flat.astype(flat.dtype.newbyteorder("="))
    if v.scaled:
        plain = plain.astype(np.float64) * v.attributes.get("scale_factor", 1.0) + v.attributes.get("add_offset", 0.0)
    column = pa.array(plain, mask=missing)
    return column.cast(pa.decimal128(20, 0)) if v.kind == 11 and not v.scaled else column.cast(_ARROW[v.spark_type()])


_ARROW = {T.ByteType(): pa.int8(), T.ShortType(): pa.int16(), T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.FloatType(): pa.float32(), T.DoubleType(): pa.float64()}


def coordinate(file, head: Header, dim: str) -> np.ndarray:
    """The coordinates of a dimension: its variable's values, else its indices."""
    v = head.variables.get(dim)
    if v is None or v.dims != [dim]:
        return np.arange(head.dims[dim], dtype=np.int64)
    column = decoded(read_slab(file, head, v, [(0, head.dims[dim])]), v)
    return column.to_numpy(zero_copy_only=False)


def _files(path: str) -> list[str]:
    """The netCDF files at a path, in order."""
    system, at = open_fs(path)
    if system.get_file_info(at).type == arrow_fs.FileType.File:
        return [at]
    found = system.get_file_info(arrow_fs.FileSelector(at, recursive=True, allow_not_found=True))
    hidden = lambda x: any(p[:1] in "_." for p in x.path[len(at) :].split("/") if p)
    return sorted(x.path for x in found if x.is_file and x.path.endswith((".nc", ".cdf")) and not hidden(x))


@dataclass
class Slab(D.InputPartition):
    """Ranges of indices of one file."""

    path: str
    window: list[tuple[int, int]]


class NetcdfSource(D.DataSource):
    """Options: path; variables (names, by comma; all on the dimensions of the first otherwise); window (JSON: dimension to [low, high]); cells."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        paths = _files(self.options["path"])
        if not paths:
            raise FileNotFoundError(f"no netCDF file at {self.options['path']}")
        system, _ = open_fs(self.options["path"])
        with system.open_input_file(paths[0]) as file:
            head = read_header(file)
        dims, chosen = chosen_variables(head, self.options.get("variables"))
        axis = lambda d: head.variables[d].spark_type() if d in head.variables and head.variables[d].dims == [d] else T.LongType()
        return T.StructType([T.StructField(d, axis(d)) for d in dims] + [T.StructField(v.name, v.spark_type()) for v in chosen])

    def reader(self, schema: T.StructType) -> NetcdfReader:
        return NetcdfReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> NetcdfWriter:
        return NetcdfWriter(self.options["path"], [d.strip() for d in self.options["dims"].split(",")], schema, overwrite)


def is_classic(path: str) -> bool:
    """Whether there is a file at the path in the classic format."""
    system, at = open_fs(path)
    if system.get_file_info(at).type != arrow_fs.FileType.File:
        return False
    with system.open_input_file(at) as file:
        return file.read_at(3, 0) == b"CDF"


def chosen_variables(head: Header, names: str | None) -> tuple[list[str], list[Variable]]:
    """The dimensions and variables of the rows."""
    if names:
        chosen = [n.strip() for n in names.split(",")]
        if missing := [n for n in chosen if n not in head.variables]:
            raise ValueError(f"no variable {', '.join(missing)}; the file has {', '.join(head.variables)}")
        found = [head.variables[n] for n in chosen]
    else:
        grid = [v for v in head.variables.values() if v.dims and v.dims != [v.name] and v.kind != 2]
        if not grid:
            raise ValueError("no variable on a grid")
        found = [v for v in grid if v.dims == grid[0].dims]
    if any(v.dims != found[0].dims for v in found):
        raise ValueError("variables on different dimensions; read them one by one")
    return found[0].dims, found


class NetcdfReader(D.DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.options, self.names = options, schema.fieldNames()
        self.bounds: list[tuple[str, str, float]] = []
        for d, (low, high) in json.loads(options.get("window", "{}")).items():
            self.bounds += [(d, ">=", low)] * (low is not None) + [(d, "<=", high)] * (high is not None)

    def pushFilters(self, filters):
        ops = {D.EqualTo: "=", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}
        paths = _files(self.options["path"])
        dims: list[str] = []
        if paths:
            with open_fs(self.options["path"])[0].open_input_file(paths[0]) as file:
                dims = chosen_variables(read_header(file), self.options.get("variables"))[0]
        for f in filters:
            if type(f) in ops and len(f.attribute) == 1 and f.attribute[0] in dims and isinstance(f.value, (int, float)):
                self.bounds.append((f.attribute[0], ops[type(f)], f.value))
            elif not (isinstance(f, D.IsNotNull) and f.attribute[0] in dims):
                yield f

    def _indices(self, values: np.ndarray, dim: str) -> np.ndarray:
        """Which indices of a dimension lie in the window."""
        ok = np.ones(len(values), bool)
        compare = {"=": np.equal, ">": np.greater, ">=": np.greater_equal, "<": np.less, "<=": np.less_equal}
        for d, op, x in self.bounds:
            if d == dim:
                ok &= compare[op](values, x)
        return np.flatnonzero(ok)

    def _slabs(self, path: str) -> list[Slab]:
        system, _ = open_fs(self.options["path"])
        with system.open_input_file(path) as file:
            head = read_header(file)
            dims, _ = chosen_variables(head, self.options.get("variables"))
            inside = [self._indices(coordinate(file, head, d), d) if any(b[0] == d for b in self.bounds) else np.arange(head.dims[d]) for d in dims]
        if any(not len(i) for i in inside):
            return []
        window = [(int(i[0]), int(i[-1]) + 1) for i in inside]
        most, out = int(self.options.get("cells", CELLS)), [window]
        for k in range(len(dims)):  # cut the outer dimensions as finely as the cells a slab may have ask for
            inner = math.prod(hi - lo for lo, hi in window[k + 1 :])
            step = max(1, most // inner)
            out = [[*w[:k], (a, min(a + step, w[k][1])), *w[k + 1 :]] for w in out for a in range(w[k][0], w[k][1], step)]
            if inner <= most:
                break
        return [Slab(path, w) for w in out]

    def partitions(self) -> list[Slab]:
        with ThreadPoolExecutor(16) as pool:
            found = [s for slabs in pool.map(self._slabs, _files(self.options["path"])) for s in slabs]
        return found or [Slab("", [])]  # Spark wants a partition

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = open_fs(self.options["path"])
        with system.open_input_file(partition.path) as file:
            head = read_header(file)
            dims, chosen = chosen_variables(head, self.options.get("variables"))
            axes = {}
            for d, (lo, hi) in zip(dims, partition.window, strict=True):
                v = head.variables.get(d)
                own = v is not None and v.dims == [d]
                axes[d] = decoded(read_slab(file, head, v, [(lo, hi)]), v) if own else pa.array(np.arange(lo, hi, dtype=np.int64))
            keep = [self._indices(axes[d].to_numpy(zero_copy_only=False), d) for d in dims]
            shape = [hi - lo for lo, hi in partition.window]
            places = np.ravel_multi_index(np.ix_(*keep), shape).reshape(-1) if any(len(k) < n for k, n in zip(keep, shape, strict=True)) else None
            columns = {v.name: decoded(read_slab(file, head, v, partition.window), v) for v in chosen if v.name in self.names}
        for a in range(0, math.prod(shape) if places is None else len(places), BATCH):
            at = np.arange(a, min(a + BATCH, math.prod(shape))) if places is None else places[a : a + BATCH]
            index = dict(zip(dims, np.unravel_index(at, shape), strict=True))
            yield pa.record_batch([axes[n].take(pa.array(index[n])) if n in index else columns[n].take(pa.array(at)) for n in self.names], names=self.names)


@dataclass
class Written(D.WriterCommitMessage):
    name: str | None


def file_bytes(dims: list[str], axes: list[np.ndarray], variables: dict[str, np.ndarray], kinds: dict[str, int]) -> bytes:
    """A file of one grid: its coordinates and variables; with 64-bit integers it is CDF-5, else CDF-2."""
    version = 5 if 10 in kinds.values() else 2
    wide = 8 if version == 5 else 4
    n = lambda x, size=wide: int(x).to_bytes(size, "big")
    name = lambda text: n(len(text.encode())) + text.encode().ljust(_padded(len(text.encode())), b"\0")
    every = {**dict(zip(dims, axes, strict=True)), **variables}
    data = {k: x.astype(TYPES[kinds[k]]).tobytes() for k, x in every.items()}
    if version == 2 and any(len(x) >= 2**32 - 4 for x in data.values()):
        raise ValueError("a variable of a file must be smaller than 4 GiB; deal rows to more tasks")

    def header(begin: int) -> bytes:
        out = b"CDF" + bytes([version]) + n(0) + n(DIMENSION, 4) + n(len(dims))
        for d, x in zip(dims, axes, strict=True):
            out += name(d) + n(len(x))
        out += n(0, 4) + n(0) + n(VARIABLE, 4) + n(len(every))
        for k in every:
            own = [dims.index(k)] if k in dims else range(len(dims))
            out += name(k) + n(len(own)) + b"".join(map(n, own))
            if k in dims:
                out += n(0, 4) + n(0)
            else:
                dtype = np.dtype(TYPES[kinds[k]])
                out += n(ATTRIBUTE, 4) + n(1) + name("_FillValue") + n(kinds[k], 4) + n(1) + np.array(FILLS[kinds[k]], dtype).tobytes().ljust(_padded(dtype.itemsize), b"\0")
            size = _padded(len(data[k]))
            out += n(kinds[k], 4) + n(size) + n(begin, 8)
            begin += size
        return out

    head = header(len(header(0)))
    return head + b"".join(x.ljust(_padded(len(x)), b"\0") for x in data.values())


class NetcdfWriter(D.DataSourceArrowWriter):
    """Tasks write into a hidden folder; the commit moves their files into place and drops the folder."""

    def __init__(self, path: str, dims: list[str], schema: T.StructType, overwrite: bool):
        self.path, self.dims, self.overwrite, self.token = path, dims, overwrite, uuid.uuid4().hex
        if missing := [d for d in dims if d not in schema.fieldNames()]:
            raise ValueError(f"no column {', '.join(missing)}")
        unfit = [f.name for f in schema if f.dataType not in _NUMBER]
        if unfit:
            raise ValueError(f"columns {', '.join(unfit)} are of no type of the format")
        self.kinds = {f.name: _NUMBER[f.dataType] for f in schema}

    def _folder(self) -> tuple[arrow_fs.FileSystem, str]:
        system, at = open_fs(self.path)
        return system, f"{at}/_temporary-{self.token}"

    def write(self, iterator) -> Written:
        batches = [b for b in iterator if b.num_rows]
        if not batches:
            return Written(None)
        table = pa.Table.from_batches(batches).combine_chunks()
        places = []
        for d in self.dims:
            if table[d].null_count:
                raise ValueError(f"a row has no {d}")
            places.append(np.unique(table[d].to_numpy(), return_inverse=True))
        axes = [axis for axis, _ in places]
        shape = [len(a) for a in axes]
        at = np.ravel_multi_index([i.reshape(-1) for _, i in places], shape)
        if len(np.unique(at)) < len(at):
            raise ValueError("two rows at one place of the grid")
        variables = {}
        for k, kind in self.kinds.items():
            if k not in self.dims:
                grid = np.full(math.prod(shape), FILLS[kind], np.dtype(TYPES[kind]).newbyteorder("="))
                column = table[k].combine_chunks()
                held = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
                grid[at[held]] = column.drop_null().to_numpy(zero_copy_only=False)
                variables[k] = grid
        system, folder = self._folder()
        system.create_dir(folder, recursive=True)
        name = f"part-{uuid.uuid4().hex}.nc"
        with system.open_output_stream(f"{folder}/{name}") as out:
            out.write(file_bytes(self.dims, axes, variables, self.kinds))
        return Written(name)

    def commit(self, messages) -> None:
        system, folder = self._folder()
        at = folder.rsplit("/", 1)[0]
        if self.overwrite:
            for f in _files(self.path):
                system.delete_file(f)
        system.create_dir(at, recursive=True)
        for m in messages:
            if m is not None and m.name:
                system.move(f"{folder}/{m.name}", f"{at}/{m.name}")
        self.abort(messages)

    def abort(self, messages) -> None:
        system, folder = self._folder()
        if system.get_file_info(folder).type == arrow_fs.FileType.Directory:
            system.delete_dir(folder)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let filters reach Python data sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NetcdfSource)


def read(spark: SparkSession, path: str, variables: list[str] | None = None, window: dict[str, tuple[float | None, float | None]] | None = None, cells: int = CELLS) -> DataFrame:
    """Rows of a file or folder; window: inclusive bounds by dimension, of which either may be None."""
    register(spark)
    reader = spark.read.format(FORMAT).option("cells", cells).option("window", json.dumps({k: list(v) for k, v in (window or {}).items()}))
    return (reader.option("variables", ",".join(variables)) if variables else reader).load(path)


def write(df: DataFrame, path: str, dims: list[str], files: int | None = None, mode: str = "append") -> None:
    """A file for each range of the first dimension."""
    register(df.sparkSession)
    dealt = df.repartitionByRange(files, dims[0]) if files else df.repartitionByRange(dims[0])
    dealt.write.format(FORMAT).option("dims", ",".join(dims)).mode(mode).save(path)


def nearest(path: str, at: dict[str, float]) -> dict[str, float]:
    """For each dimension the coordinate nearest to a value over all files, the smaller of two; only coordinates are read."""
    system, _ = open_fs(path)
    best: dict[str, tuple[float, float]] = {}
    for name in _files(path):
        with system.open_input_file(name) as file:
            head = read_header(file)
            for d, x in at.items():
                values = coordinate(file, head, d)
                if len(values):
                    found = min((abs(float(v) - x), float(v)) for v in values[np.argsort(np.abs(values - x), kind="stable")[:2]])
                    best[d] = min(best.get(d, found), found)
    return {d: v for d, (_, v) in best.items()}


def raster(spark: SparkSession, path: str, lon: tuple[float, float], lat: tuple[float, float], variable: str = "elevation") -> DataFrame:
    """(lon, lat, value) of a window of a raster; its axes may be called longitude and latitude."""
    names = _axes(path)
    rows = read(spark, path, [variable], {names["lon"]: lon, names["lat"]: lat})
    return rows.withColumnsRenamed({names["lon"]: "lon", names["lat"]: "lat"}).select("lon", "lat", variable)


def profile(spark: SparkSession, path: str, lon: float, lat: float, variable: str, vertical: str, time: float | None = None) -> DataFrame:
    """(vertical, value) of the grid's column nearest to a point and, if given, a time; ascending."""
    names = _axes(path)
    point = nearest(path, {names["lon"]: lon, names["lat"]: lat} | ({"time": time} if time is not None else {}))
    return read(spark, path, [variable], {d: (v, v) for d, v in point.items()}).select(vertical, variable).orderBy(vertical)


def _axes(path: str) -> dict[str, str]:
    paths = _files(path)
    if not paths:
        raise FileNotFoundError(f"no netCDF file at {path}")
    with open_fs(path)[0].open_input_file(paths[0]) as file:
        dims = read_header(file).dims
    return {short: short if short in dims else long for short, long in (("lon", "longitude"), ("lat", "latitude"))}
