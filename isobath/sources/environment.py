"""Environmental inputs: rasters, depth and pressure profiles, elevation models.

Tables are read by Spark with the window pushed to the scan, classic netCDF by the data source of ``netcdf``.
netCDF-4, GRIB and GeoTIFF files need a reader package that may be missing; the error then names the extra to install.
Files are never downloaded.
"""

from __future__ import annotations

import importlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isobath.sources import netcdf

_READERS = {".nc": ("xarray", "netcdf"), ".grib": ("cfgrib", "grib"), ".grb": ("cfgrib", "grib"), ".tif": ("rasterio", "raster"), ".tiff": ("rasterio", "raster")}


def require(module: str, extra: str, dataset: str):
    try:
        return importlib.import_module(module)
    except ImportError as missing:
        raise ImportError(f"reading {dataset} needs {module}: install the extra '{extra}'") from missing


def _suffix(path: str) -> str:
    return "." + path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""


def _decoded(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file in a format of its own, decoded where the task runs."""
    module, extra = _READERS[_suffix(path)]
    require(module, extra, path)

    def run(batches):
        import io

        xarray = importlib.import_module("xarray")
        for pdf in batches:
            for content in pdf["content"]:
                yield xarray.open_dataset(io.BytesIO(content)).to_dataframe().reset_index()[[c.split()[0] for c in schema.split(", ")]].astype(float)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A columnar table, or a decoded file by its suffix; classic netCDF needs no reader package."""
    if _suffix(path) == ".nc" and netcdf.is_classic(path):
        return netcdf.read(spark, path).select(*[c.split()[0] for c in schema.split(", ")])
    return _decoded(spark, path, schema) if _suffix(path) in _READERS else spark.read.parquet(path)


def raster_window(raster: DataFrame, lon: tuple[float, float], lat: tuple[float, float]) -> DataFrame:
    """Rows (lon, lat, ..) in a window, ends included."""
    return raster.filter(F.col("lon").between(*lon) & F.col("lat").between(*lat))


def raster_file(spark: SparkSession, path: str, lon: tuple[float, float], lat: tuple[float, float], variable: str = "elevation") -> DataFrame:
    """(lon, lat, elevation) of a window of a classic netCDF raster; only the window's bytes are read."""
    return netcdf.raster(spark, path, lon, lat, variable)


def profile_file(spark: SparkSession, path: str, lon: float, lat: float, variable: str, vertical: str, time: float | None = None) -> DataFrame:
    """The profile of a classic netCDF grid nearest to a point and, if given, a time, ascending."""
    return netcdf.profile(spark, path, lon, lat, variable, vertical, time)


def nearest_labels(table: DataFrame, at: dict[str, float]) -> DataFrame:
    """Rows whose coordinates are the nearest labels to the given ones, each axis by itself, the smaller of two."""
    labels = table.agg(*[F.min(F.struct(F.abs(F.col(c) - v).alias("d"), F.col(c).alias("x")))["x"].alias(f"_{c}") for c, v in at.items()])
    same = None
    for c in at:
        one = F.col(c) == F.col(f"_{c}")
        same = one if same is None else same & one
    return table.join(F.broadcast(labels), same).drop(*[f"_{c}" for c in at])


def profile_at(table: DataFrame, at: dict[str, float], vertical: str) -> DataFrame:
    """The vertical profile of the nearest point, ascending."""
    return nearest_labels(table, at).orderBy(vertical)


def pixel_window(pixels: DataFrame, row_off: int, col_off: int, height: int, width: int) -> DataFrame:
    return pixels.filter((F.col("row") >= row_off) & (F.col("row") < row_off + height) & (F.col("col") >= col_off) & (F.col("col") < col_off + width))


def affine(transform: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """x and y of a pixel (col, row) under the six coefficients of a raster."""
    a, b, c, d, e, f = transform
    return a * F.col("col") + b * F.col("row") + c, d * F.col("col") + e * F.col("row") + f


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """A partitioned columnar table."""
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
