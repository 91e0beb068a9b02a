"""Four-electrode surveys by superposition of poles: schedules with electrodes at infinity, joined null-safely."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Source and receiver of a measurement's four poles, and the sign with which each counts.
POLES = (("a", "m", 1.0), ("b", "m", -1.0), ("a", "n", -1.0), ("b", "n", 1.0))


def layered_pole(r: Column, rho: float, below: float, depth: float, images: int = 20) -> Column:
    """Surface potential of a unit current at distance r over a layer of ``rho`` and ``depth`` on a half-space, by images."""
    k = (below - rho) / (below + rho)
    mirrored = [2.0 * k**n / F.sqrt(r * r + (2.0 * n * depth) ** 2) for n in range(1, images + 1)]
    return rho / (2.0 * math.pi) * (1.0 / r + reduce(lambda x, y: x + y, mirrored))


def pole_pairs(schedule: DataFrame) -> DataFrame:
    """(row, source, receiver, sign): the four poles of each measurement; an electrode at infinity is null."""
    each = F.array(*[F.struct(F.col(s).alias("source"), F.col(r).alias("receiver"), F.lit(sign).alias("sign")) for s, r, sign in POLES])
    return schedule.select("row", F.explode(each).alias("p")).select("row", "p.*")


def pole_table(pairs: DataFrame, electrodes: DataFrame, potential) -> DataFrame:
    """(source, receiver, v, g) of each distinct pair: potential(r) and 1 / r, both 0 where one end is at infinity.

    Each pair is worked out once, however many measurements share it. An electrode that is not in the table counts as an
    error, not as infinity: v and g are then null, and so is what is summed from them.
    """
    asked = pairs.select("source", "receiver").distinct()
    at = lambda end: electrodes.select(F.col("electrode").alias(end), F.col("x").alias(f"x_{end}"), F.col("y").alias(f"y_{end}"))
    placed = asked.join(at("source"), "source", "left").join(at("receiver"), "receiver", "left")
    r = F.sqrt(F.pow(F.col("x_source") - F.col("x_receiver"), 2) + F.pow(F.col("y_source") - F.col("y_receiver"), 2))
    far = F.col("source").isNull() | F.col("receiver").isNull()
    return placed.select("source", "receiver", F.when(far, 0.0).otherwise(potential(r)).alias("v"), F.when(far, 0.0).otherwise(1.0 / r).alias("g"))


def measured(schedule: DataFrame, poles: DataFrame, current: float = 1.0) -> DataFrame:
    """(row, v, factor, apparent): voltage, geometric factor and apparent resistivity of schedule (row, a, b, m, n).

    Poles meet the schedule by null-safe equality, so electrodes at infinity find their row of zeros. A measurement with a
    pole that the table lacks, or of no geometric factor, has nulls.
    """
    p = pole_pairs(schedule)
    met = p.join(poles.withColumnsRenamed({"source": "s", "receiver": "t"}), p["source"].eqNullSafe(F.col("s")) & p["receiver"].eqNullSafe(F.col("t")), "left")
    whole = F.count("v") == len(POLES)
    sums = met.groupBy("row").agg(F.when(whole, current * F.sum(F.col("sign") * F.col("v"))).alias("v"), F.when(whole, F.sum(F.col("sign") * F.col("g"))).alias("g"))
    factor = F.when(F.abs("g") > 1e-12, 2.0 * math.pi / F.col("g"))
    return sums.select("row", "v", factor.alias("factor"), (factor * F.col("v") / current).alias("apparent"))
