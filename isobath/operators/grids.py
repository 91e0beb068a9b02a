"""Structured grids in long form: stencils by windows, sparse operators as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gradient(field: DataFrame, value: str, axis: str, others: list[str], spacing: float = 1.0, name: str = "gradient") -> DataFrame:
    """Central difference along an axis, zero at the edges."""
    order = Window.partitionBy(*others).orderBy(axis)
    difference = (F.lead(value).over(order) - F.lag(value).over(order)) / (2.0 * spacing)
    return field.withColumn(name, F.coalesce(difference, F.lit(0.0)))


def cross_gradient(field: DataFrame, a: str, b: str, axes: list[str], spacing: float = 1.0) -> DataFrame:
    """Components of grad a x grad b: one over two axes, three over three."""
    made = field
    for m in (a, b):
        for axis in axes:
            made = gradient(made, m, axis, [o for o in axes if o != axis], spacing, f"_{m}_{axis}")
    g = lambda m, k: F.col(f"_{m}_{axes[k]}")
    planes = [(0, 1)] if len(axes) == 2 else [(1, 2), (2, 0), (0, 1)]
    return made.withColumns({f"cross_{n}": g(a, p) * g(b, q) - g(a, q) * g(b, p) for n, (p, q) in enumerate(planes)}).drop(*[f"_{m}_{x}" for m in (a, b) for x in axes])


def divergence(field: DataFrame, components: dict[str, str], spacing: float = 1.0) -> DataFrame:
    """Sum of the axes' derivatives of their components (axis to column)."""
    axes, made = list(components), field
    for axis, column in components.items():
        made = gradient(made, column, axis, [o for o in axes if o != axis], spacing, f"_{axis}")
    return made.withColumn("divergence", sum((F.col(f"_{a}") for a in axes[1:]), F.col(f"_{axes[0]}"))).drop(*[f"_{a}" for a in axes])


def faces(field: DataFrame, node: str, axes: list[str], keep: list[str]) -> DataFrame:
    """A row per interior face: axis, nodes a and b, and the kept columns of both as a_.. and b_.."""
    parts = None
    for axis in axes:
        order = Window.partitionBy(*[o for o in axes if o != axis]).orderBy(axis)
        nxt = F.lead(F.struct(F.col(node).alias("n"), *keep)).over(order)
        rows = field.withColumn("_b", nxt).filter("_b is not null").select(F.lit(axis).alias("axis"), F.col(node).alias("a"), F.col("_b.n").alias("b"), *[F.col(k).alias(f"a_{k}") for k in keep], *[F.col(f"_b.{k}").alias(f"b_{k}") for k in keep])
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


def divergence_form(field: DataFrame, node: str, kappa: str, axes: list[str], spacing: float = 1.0) -> DataFrame:
    """(r, c, v) of -div(kappa grad): face conductivities are means; rows of the rim are identity."""
    weight = 0.5 * (F.col(f"a_{kappa}") + F.col(f"b_{kappa}")) / (spacing * spacing)
    f = faces(field, node, axes, [kappa]).select("a", "b", weight.alias("w"))
    edge = None
    for axis in axes:
        at = (F.col(axis) == F.col(f"_lo_{axis}")) | (F.col(axis) == F.col(f"_hi_{axis}"))
        edge = at if edge is None else edge | at
    extent = field.agg(*[F.min(a).alias(f"_lo_{a}") for a in axes], *[F.max(a).alias(f"_hi_{a}") for a in axes])
    rim = field.crossJoin(F.broadcast(extent)).withColumn("rim", edge).select(F.col(node).alias("r"), "rim")
    entries = f.select(F.explode(F.array(*[F.struct(F.col(r).alias("r"), F.col(c).alias("c"), (s * F.col("w")).alias("v")) for r, c, s in (("a", "a", 1.0), ("a", "b", -1.0), ("b", "b", 1.0), ("b", "a", -1.0))])).alias("e")).select("e.*")
    inner = entries.join(rim.filter("not rim").select("r"), "r", "left_semi")
    return inner.unionByName(rim.filter("rim").select("r", F.col("r").alias("c"), F.lit(1.0).alias("v"))).groupBy("r", "c").agg(F.sum("v").alias("v"))


def helmholtz(field: DataFrame, node: str, slowness2: str, axes: list[str], omega: float, spacing: float = 1.0) -> DataFrame:
    """(r, c, v) of -lap - omega^2 s^2, the rim identity."""
    lap = divergence_form(field.withColumn("_one", F.lit(1.0)), node, "_one", axes, spacing)
    off = lap.filter("r <> c").select("r").distinct()
    diagonal = field.select(F.col(node).alias("r"), F.col(node).alias("c"), (-omega * omega * F.col(slowness2)).alias("v")).join(off, "r", "left_semi")
    return lap.unionByName(diagonal).groupBy("r", "c").agg(F.sum("v").alias("v"))


def matvec(coo: DataFrame, x: DataFrame) -> DataFrame:
    """(r, y) of the operator (r, c, v) on (node, u); repeated entries add up."""
    return coo.join(x, F.col("c") == F.col("node")).groupBy("r").agg(F.sum(F.col("v") * F.col("u")).alias("y"))


def roughness(field: DataFrame, node: str, value: str, axes: list[str], spacing: float = 1.0) -> DataFrame:
    """Sum of squared differences over all faces, by axis."""
    d = (F.col(f"b_{value}") - F.col(f"a_{value}")) / spacing
    return faces(field, node, axes, [value]).groupBy("axis").agg(F.sum(d * d).alias("roughness"), F.count("*").alias("faces"))


def conjugate_gradient(coo: DataFrame, rhs: DataFrame, write, tolerance: float = 1e-8, most: int = 200) -> DataFrame:
    """Solution (node, u) of a symmetric positive definite operator; rhs is (node, f).

    One sparse product and two sums a step; write(df) stores the state, which cuts the lineage.
    """
    state = write(rhs.select("node", F.lit(0.0).alias("u"), F.col("f").alias("res"), F.col("f").alias("p")))
    rr = state.agg(F.sum(F.col("res") * F.col("res"))).first()[0] or 0.0
    limit = tolerance * tolerance * rr
    for _ in range(most):
        if rr <= limit or rr == 0.0:
            break
        ap = matvec(coo, state.select("node", F.col("p").alias("u"))).withColumnRenamed("r", "node")
        both = write(state.join(ap, "node"))
        alpha = rr / both.agg(F.sum(F.col("p") * F.col("y"))).first()[0]
        half = both.select("node", (F.col("u") + alpha * F.col("p")).alias("u"), (F.col("res") - alpha * F.col("y")).alias("res"), "p")
        rr, last = half.agg(F.sum(F.col("res") * F.col("res"))).first()[0], rr
        state = write(half.withColumn("p", F.col("res") + (rr / last) * F.col("p")))
    return state.select("node", "u")
