"""Operators over profiles, columns and histories: interpolation, ducts, masks, geotherms, maturity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# EASY%Ro, twenty parallel reactions: activation energies 34, 36, .. 72 kcal/mol, and their weights.
EASYRO_WEIGHTS = (0.03, 0.03, 0.04, 0.04, 0.05, 0.05, 0.06, 0.04, 0.04, 0.07, 0.06, 0.06, 0.06, 0.05, 0.05, 0.04, 0.03, 0.02, 0.02, 0.01)
EASYRO_RATE, GAS_CONSTANT, SECONDS_A_MYR = 1.0e13, 0.0019872041, 1.0e6 * 365.25 * 86400.0


def interpolate(profile: DataFrame, grid: DataFrame, key: str, z: str, v: str) -> DataFrame:
    """Linear interpolation of (key, z, v) at the (key, z) of grid, clamped at the ends.

    Grid and nodes are sorted together per key, up and down; a running window each way brings each grid point its
    neighbours, so a long profile costs two sorts instead of an interval join's pairs. (A frame that ends at the last
    row would be summed up anew for every row.)
    """
    nodes = profile.select(key, z, F.col(v).alias("_v"), F.lit(0).alias("_grid"))
    both = nodes.unionByName(grid.select(key, z, F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_grid")))
    order = Window.partitionBy(key).orderBy(z, "_grid")
    node = F.when(F.col("_grid") == 0, F.struct(F.col(z).alias("z"), F.col("_v").alias("v")))
    below = F.last(node, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy(key).orderBy(F.col(z).desc(), F.col("_grid").desc())
    above = F.last(node, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    part = (F.col(z) - F.col("_b.z")) / (F.col("_a.z") - F.col("_b.z"))
    value = F.when(F.col("_b").isNull(), F.col("_a.v")).when(F.col("_a").isNull() | (F.col("_b.z") == F.col(z)), F.col("_b.v")).otherwise(F.col("_b.v") + part * (F.col("_a.v") - F.col("_b.v")))
    return both.withColumn("_b", below).withColumn("_a", above).filter("_grid = 1").select(key, z, value.alias(v))


def check_ascending(profile: DataFrame, key: str, z: str) -> DataFrame:
    """The profile; evaluation fails where a key has under two nodes or two at one depth."""
    nodes = Window.partitionBy(key)
    bad = (F.count("*").over(nodes) < 2) | F.coalesce(F.lead(z).over(nodes.orderBy(z)) == F.col(z), F.lit(False))
    return profile.withColumn(z, F.when(bad, F.raise_error(F.lit("a profile needs two or more strictly ascending nodes")).cast("double")).otherwise(F.col(z)))


def assemble_field(profile: DataFrame, depths: DataFrame, ranges: DataFrame, v: str = "v") -> DataFrame:
    """(range_m, z, v) profiles on the grid depths (iz, z) by ranges (ir, range_m): node = iz * n_range + ir.

    Bilinear: along depth within each profile, then along range at each depth.
    """
    columns = profile.select("range_m").distinct().crossJoin(F.broadcast(depths))
    at_depth = interpolate(profile, columns, "range_m", "z", v).join(F.broadcast(depths), "z")
    targets = depths.select("iz").crossJoin(F.broadcast(ranges))
    field = interpolate(at_depth, targets.select("iz", "range_m"), "iz", "range_m", v).join(F.broadcast(ranges), "range_m")
    n = ranges.agg(F.count("*").alias("n"))
    return field.crossJoin(F.broadcast(n)).select((F.col("iz") * F.col("n") + F.col("ir")).alias("node"), "iz", "ir", v)


def seabed_mask(grid: DataFrame, floor: DataFrame, terrain: bool = False) -> DataFrame:
    """grid (ir, z, ..) with outside: below the floor (ir, depth), or above it for terrain."""
    outside = F.col("z") < F.col("depth") if terrain else F.col("z") > F.col("depth")
    return grid.join(floor.select("ir", "depth"), "ir").withColumn("outside", outside)


def apply_mask(value: Column, mask: Column, fill: float) -> Column:
    return F.when(mask, F.lit(fill)).otherwise(value)


def duct_layers(profile: DataFrame, key: str, z: str, m: str, tolerance: float = 0.0) -> DataFrame:
    """A row per interval with its gradient and whether modified refractivity falls with height."""
    order = Window.partitionBy(key).orderBy(z)
    gradient = (F.lead(m).over(order) - F.col(m)) / (F.lead(z).over(order) - F.col(z))
    return profile.withColumn("gradient", gradient).filter(F.col("gradient").isNotNull()).withColumn("duct", F.col("gradient") < -tolerance)


def geotherm(layers: DataFrame, surface_temp: float = 10.0, surface_heat_flow: float = 0.060) -> DataFrame:
    """(column_id, layer, dz, cond, heat) with depth and temperature at each layer's bottom, by running sums."""
    order = Window.partitionBy("column_id").orderBy("layer")
    done = order.rowsBetween(Window.unboundedPreceding, 0)
    lost = F.coalesce(F.sum(F.col("heat") * F.col("dz")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    staged = layers.withColumn("flow", F.lit(surface_heat_flow) - lost)
    step = (F.col("flow") * F.col("dz") - 0.5 * F.col("heat") * F.col("dz") * F.col("dz")) / F.col("cond")
    return staged.withColumn("step", step).select("column_id", "layer", F.sum("dz").over(done).alias("depth"), (F.lit(surface_temp) + F.sum("step").over(done)).alias("temperature"))


def easy_ro(history: DataFrame, key: str = "horizon") -> DataFrame:
    """Vitrinite reflectance of (key, t_ma, temp_c): twenty Arrhenius reactions over each horizon's steps."""
    spark = history.sparkSession
    reactions = spark.createDataFrame([(34.0 + 2.0 * i, w) for i, w in enumerate(EASYRO_WEIGHTS)], "energy double, weight double")
    order = Window.partitionBy(key).orderBy("t_ma")
    kelvin = F.col("temp_c") + 273.15
    steps = history.select(key, (F.col("t_ma") - F.lag("t_ma").over(order)).alias("dt"), (0.5 * (kelvin + F.lag(F.col("temp_c")).over(order) + 273.15)).alias("mid")).filter("dt is not null")
    rate = F.lit(EASYRO_RATE) * F.exp(-F.col("energy") / (F.lit(GAS_CONSTANT) * F.col("mid"))) * F.col("dt") * F.lit(SECONDS_A_MYR)
    each = steps.crossJoin(F.broadcast(reactions)).groupBy(key, "energy").agg(F.sum(rate).alias("integral"), F.first("weight").alias("weight"))
    done = F.sum(F.col("weight") * (1.0 - F.exp(-F.col("integral"))))
    return each.groupBy(key).agg(F.exp(F.lit(-1.6) + 3.7 * done).alias("ro"))


def simpson_fresnel(values: DataFrame, v: str = "v", intervals: int = 2000) -> DataFrame:
    """values with the Fresnel integrals fresnel_c and fresnel_s of v, by Simpson's rule inside each row."""
    h = F.col(v) / float(intervals)

    def integral(f):
        def weigh(acc, i):
            t = i.cast("double") * h
            w = F.when((i == 0) | (i == intervals), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
            return acc + w * f(t * t * (0.5 * math.pi))

        return F.aggregate(F.sequence(F.lit(0), F.lit(intervals)), F.lit(0.0), weigh) * h / 3.0

    return values.withColumn("fresnel_c", integral(F.cos)).withColumn("fresnel_s", integral(F.sin))
