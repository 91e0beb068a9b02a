"""Sums over spectral lines, relaxation mechanisms and rain coefficients, as joins with small dimensions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobath.functions import atmosphere

BLOCK = 1024


def lines_table(spark: SparkSession, rows, first: str) -> DataFrame:
    """A dimension table of lines: f0 and the given coefficients c1, c2, .."""
    n = len(rows[0]) - 1
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join([f"{first} double", *[f"c{i + 1} double" for i in range(n)]]))


def gaseous(air: DataFrame, oxygen=atmosphere.OXYGEN_LINES, vapour=atmosphere.VAPOUR_LINES) -> DataFrame:
    """air (obs_id, f_ghz, p_hpa, e_hpa, t_k) to oxygen_db, vapour_db, total_db per km.

    The lines are a parameter of at most hundreds of rows; a task takes all of them for a block of rows at once, and
    nothing is exchanged. Rows with a null input stay, with nulls; repeated rows stay.
    """
    base = air.select("obs_id", "f_ghz", "p_hpa", "e_hpa", (F.lit(300.0) / F.col("t_k")).alias("theta"))
    base = base.select("obs_id", *[F.col(c).cast("double").alias(c) for c in base.columns[1:]])
    schema = T.StructType([*base.schema, T.StructField("o", T.DoubleType()), T.StructField("w", T.DoubleType())])
    kinds = [(shape, [np.array(c, float)[None, :] for c in zip(*lines, strict=True)]) for shape, lines in ((atmosphere.oxygen_line, oxygen), (atmosphere.vapour_line, vapour))]

    def run(batches):
        for batch in batches:
            sums = [[np.zeros(0)], [np.zeros(0)]]
            for a in range(0, batch.num_rows, BLOCK):
                given = [batch.column(k).slice(a, BLOCK).to_numpy(zero_copy_only=False)[:, None] for k in range(1, 5)]
                for own, (shape, line) in zip(sums, kinds, strict=True):
                    own.append(shape(*given, line).sum(axis=1))
            # a null input became NaN on its way
            yield pa.record_batch([*batch.columns, *[pa.array(np.concatenate(x), from_pandas=True) for x in sums]], names=schema.names)

    summed = base.mapInArrow(run, schema)
    args = [F.col(c) for c in ("f_ghz", "p_hpa", "e_hpa", "theta")]
    dry = atmosphere.specific(F.col("f_ghz"), F.col("o") + atmosphere.dry_continuum(*args))
    wet = atmosphere.specific(F.col("f_ghz"), F.col("w"))
    return summed.select("obs_id", dry.alias("oxygen_db"), wet.alias("vapour_db"), (dry + wet).alias("total_db"))


def rain_attenuation(rain: DataFrame, table: DataFrame, polarisation: str = "h") -> DataFrame:
    """rain (obs_id, f_ghz, rain_mm_h) to attenuation (dB/km): log k and alpha are linear in log f, clamped."""
    if polarisation.lower()[:1] not in ("h", "v") or polarisation.lower() not in ("h", "v", "horizontal", "vertical"):
        raise ValueError("polarisation must be h or v")
    k, a = ("c1", "c2") if polarisation.lower()[0] == "h" else ("c3", "c4")
    order = Window.partitionBy(F.lit(1)).orderBy("f")
    nodes = table.select(F.log("f").alias("x0"), F.log(k).alias("y0"), F.col(a).alias("a0"), F.log(F.lead("f").over(order)).alias("x1"), F.log(F.lead(k).over(order)).alias("y1"), F.lead(a).over(order).alias("a1"), F.min("f").over(Window.partitionBy(F.lit(1))).alias("lo"), F.max("f").over(Window.partitionBy(F.lit(1))).alias("hi")).filter("x1 is not null")
    x = F.least(F.greatest(F.log("f_ghz"), F.log("lo")), F.log("hi"))
    inside = (x >= F.col("x0")) & ((x < F.col("x1")) | ((x == F.col("x1")) & (F.log("hi") == F.col("x1"))))
    part = (x - F.col("x0")) / (F.col("x1") - F.col("x0"))
    kk = F.exp(F.col("y0") + part * (F.col("y1") - F.col("y0")))
    return rain.join(F.broadcast(nodes), inside).select("obs_id", atmosphere.rain(kk, F.col("a0") + part * (F.col("a1") - F.col("a0")), F.col("rain_mm_h")).alias("attenuation"))


def q_of_omega(frequencies: DataFrame, mechanisms: DataFrame) -> DataFrame:
    """Q at each omega of a generalised standard linear solid (a, omega_l)."""
    w, wl = F.col("omega"), F.col("omega_l")
    real = F.sum(F.col("a") * w * w / (wl * wl + w * w))
    lost = F.sum(F.col("a") * w * wl / (wl * wl + w * w))
    return frequencies.crossJoin(F.broadcast(mechanisms)).groupBy("omega").agg(((1.0 + real) / lost).alias("q"))
