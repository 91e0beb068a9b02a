"""Queries that write files of a scientific format and read parts of them back."""

from __future__ import annotations

from isobath.plans.relational import rounded
from isobath.plans.views import view, view_sql
from isobath.sources import netcdf, storage
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def _netcdf_window(spark, sf_dir):
    """All columns of layers as netCDF files, of which a window in depth of the upper half of the columns is read back."""
    grid = view(spark, sf_dir, "layer").select("column_id", F.col("layer").cast("int").alias("layer"), "cond", "heat")
    path = storage.Store(spark, "netcdf").folder
    netcdf.write(grid, path, ["column_id", "layer"])
    half = grid.agg(F.floor(F.max("column_id") / 2)).first()[0] or 0
    back = netcdf.read(spark, path, ["cond", "heat"], {"column_id": (half, None)})
    some = back.filter((F.col("layer") >= 5) & (F.col("layer") < 20) & F.col("cond").isNotNull())
    return rounded(some.withColumn("layer", F.col("layer").cast("long")), 9, "cond", "heat")


QUERIES["netcdf_window"] = _netcdf_window
ORACLES["netcdf_window"] = f"""WITH l AS (SELECT * FROM {view_sql('layer')} v)
SELECT column_id, layer, round(cond, 9) AS cond, round(heat, 9) AS heat FROM l WHERE layer >= 5 AND layer < 20 AND column_id >= (SELECT floor(max(column_id) / 2e0) FROM l)"""


def _netcdf_profile(spark, sf_dir):
    """The column of layers nearest to a place between two of them."""
    grid = view(spark, sf_dir, "layer").select(F.col("column_id").cast("double").alias("lon"), (F.col("column_id") % 7).cast("double").alias("lat"), (100.0 * F.col("layer")).alias("depth"), F.col("cond").alias("temperature"))
    path = storage.Store(spark, "netcdf").folder
    netcdf.write(grid.filter("lat = 3"), path, ["lat", "lon", "depth"])
    return rounded(netcdf.profile(spark, path, 6.4, 3.2, "temperature", "depth").filter("temperature is not null"), 9, "temperature")


QUERIES["netcdf_profile"] = _netcdf_profile
ORACLES["netcdf_profile"] = f"""WITH l AS (SELECT * FROM {view_sql('layer')} v WHERE column_id % 7 = 3)
SELECT 1e2 * layer AS depth, round(cond, 9) AS temperature FROM l WHERE column_id = (SELECT column_id FROM l ORDER BY abs(column_id - 64e-1), column_id LIMIT 1)"""
