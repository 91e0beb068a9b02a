"""Sums of far-reaching kernels over an octree of cells: distant boxes count by a few sources each, near cells one by one."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobath.functions import potential
from isobath.sources.storage import Store

BITS = 21
AXES = "xyz"


@dataclass
class Interactions:
    """Which sources serve which stations: lists (level, t, s) of boxes, sources and stations by (level, box), boxes with sizes."""

    lists: DataFrame
    sources: DataFrame
    boxes: DataFrame
    stations: DataFrame
    side: float
    low: tuple[float, float, float]
    store: Store


def _pack(parts: list[Column]) -> Column:
    return reduce(lambda key, part: F.shiftleft(key, BITS).bitwiseOR(part), [p.cast("long") for p in parts])


def _unpack(key: Column) -> list[Column]:
    return [F.shiftright(key, BITS * k).bitwiseAND(F.lit((1 << BITS) - 1)) for k in (2, 1, 0)]


def _parent(key: Column, levels: int = 1) -> Column:
    return _pack([F.shiftright(part, levels) for part in _unpack(key)])


def _chebyshev(order: int) -> list[float]:
    return [math.cos(math.pi * (2 * k + 1) / (2 * order)) for k in range(order)]


def _weights(u: Column, order: int) -> Column:
    """Values at u, from -1 to 1, of the polynomials that are one at one Chebyshev place and zero at the others."""
    places = _chebyshev(order)
    one = lambda k: reduce(lambda a, b: a * b, [(u - c) / (places[k] - c) for j, c in enumerate(places) if j != k], F.lit(1.0))
    return F.array(*[one(k) for k in range(order)])


def _condense(rows: DataFrame, properties: list[str], level: int, side: float, low: tuple, order: int) -> tuple[DataFrame, DataFrame]:
    """(boxes of more than order^3 rows, their order^3 sources): strengths that give every polynomial below the order the same sum."""
    half = side / 2 ** (level + 1)
    full = rows.groupBy("box").agg(F.count("*").alias("rows")).filter(F.col("rows") > order**3).select("box")
    centre = {a: F.lit(low[k]) + (2.0 * part + 1.0) * half for k, (a, part) in enumerate(zip(AXES, _unpack(F.col("box")), strict=True))}
    spread = rows.join(full, "box", "left_semi")
    for a in AXES:
        spread = spread.withColumn(f"_w{a}", _weights((F.col(a) - centre[a]) / half, order))
    spread = spread.drop(*AXES)
    for a in AXES:
        spread = spread.select("*", F.posexplode(f"_w{a}").alias(f"_k{a}", f"_v{a}")).drop(f"_w{a}")
    weight = F.col("_vx") * F.col("_vy") * F.col("_vz")
    summed = spread.groupBy("box", *[f"_k{a}" for a in AXES]).agg(*[F.sum(F.col(p) * weight).alias(p) for p in properties])
    places = F.array(*[F.lit(c) for c in _chebyshev(order)])
    at = [(centre[a] + F.get(places, F.col(f"_k{a}")) * half).alias(a) for a in AXES]
    return full, summed.select("box", *at, *properties)


def interactions(stations: DataFrame, cells: DataFrame, properties: list[str], theta: float = 0.5, order: int = 4, deepest: int = 20) -> Interactions:
    """The octree of the cells and the lists of boxes that serve each box of stations.

    Boxes are split until none holds more than order^3 places, or down to ``deepest``. From the leaves up, a box with more
    than order^3 sources is given order^3 new ones on its Chebyshev grid; others keep what they hold, so no level has more
    sources than the cells have places. From the root down, a pair of boxes is served where its source box holds at most
    order^3 places or half its side is at most theta times the gap between the two; else the children of both meet, by
    equality of parents. A box meets a number of boxes that theta bounds, so pairs grow with the boxes at each level.
    """
    if not 0 < theta <= 0.5:
        raise ValueError("theta must be above 0 and at most 0.5")
    if order < 2 or not 1 <= deepest < BITS:
        raise ValueError(f"order must be 2 or more, deepest from 1 to {BITS - 1}")
    store = Store(stations.sparkSession, "tree")
    xyz = [F.col(a).cast("double").alias(a) for a in AXES]
    strengths = [F.sum(F.coalesce(F.col("volume") * F.col(p), F.lit(0.0)).cast("double")).alias(p) for p in properties]
    # cells at one place are one source
    placed = store(cells.dropna(subset=list(AXES)).select(*xyz, "volume", *properties).groupBy(*AXES).agg(*strengths))
    seen = stations.dropna(subset=list(AXES)).select("obs_id", *xyz)
    ends = placed.select(*AXES).unionByName(seen.select(*AXES)).agg(*[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))]).first()
    low = tuple(ends[f"lo_{a}"] or 0.0 for a in AXES)
    side = max([(ends[f"hi_{a}"] or 0.0) - lo for a, lo in zip(AXES, low, strict=True)]) * (1 + 1e-9) or 1.0
    # a place on the far face, or rounded past it, belongs to the last box
    fine = _pack([F.least(F.floor((F.col(a) - low[k]) / side * 2.0**deepest), F.lit(2**deepest - 1)) for k, a in enumerate(AXES)])
    at = store(placed.withColumn("fine", fine))
    n = at.count()
    most = order**3
    depth = min(deepest, max(0, math.floor(math.log(max(n, 1) / most, 8))))
    crowd = lambda level: at.groupBy(_parent(F.col("fine"), deepest - level).alias("box")).count().agg(F.max("count")).first()[0] or 0
    while depth < deepest and crowd(depth) > most:
        depth += 1

    total = [F.sum(F.abs(p)).alias(f"size_{p}") for p in properties]
    rows = at.select(_parent(F.col("fine"), deepest - depth).alias("box"), *AXES, *properties)
    boxes = store(rows.groupBy("box").agg(F.count("*").alias("n"), *total))
    levels, sources = {depth: boxes}, {depth: store(rows)}
    for level in range(depth - 1, -1, -1):
        up = sources[level + 1].withColumn("box", _parent(F.col("box")))
        full, fresh = _condense(up, properties, level, side, low, order)
        sources[level] = store(up.join(full, "box", "left_anti").unionByName(fresh))
        sums = [F.sum(c).alias(c) for c in ("n", *[f"size_{p}" for p in properties])]
        levels[level] = store(levels[level + 1].groupBy(_parent(F.col("box")).alias("box")).agg(*sums))

    steps = F.explode(F.array(*[F.lit(k) for k in range(depth + 1)])).alias("level")
    keyed = seen.withColumn("fine", fine).select("*", steps)
    lift = F.when(F.col("level") == depth, _parent(F.col("fine"), deepest - depth))
    for level in range(depth):
        lift = lift.when(F.col("level") == level, _parent(F.col("fine"), deepest - level))
    homes = store(keyed.select("obs_id", *AXES, "level", lift.alias("t")))
    targets = homes.select("level", "t").distinct()

    served, meeting = [], levels[0].select("box", "n").crossJoin(targets.filter("level = 0").limit(1).select("t"))
    for level in range(depth + 1):
        gaps = [F.greatest(F.abs(a - b) - 1, F.lit(0)).cast("double") for a, b in zip(_unpack(F.col("t")), _unpack(F.col("box")), strict=True)]
        apart = 2.0 * theta * F.sqrt(reduce(lambda a, b: a + b, [g * g for g in gaps])) >= 1.0
        judged = store(meeting.withColumn("done", apart | (F.col("n") <= most) | F.lit(level == depth)))
        served.append(judged.filter("done").select(F.lit(level).alias("level"), "t", F.col("box").alias("s")))
        if level < depth:
            below = targets.filter(F.col("level") == level + 1).select(F.col("t").alias("child"), _parent(F.col("t")).alias("t"))
            parts = levels[level + 1].select(F.col("box").alias("part"), F.col("n"), _parent(F.col("box")).alias("box"))
            meeting = judged.filter("not done").select("t", "box").join(below, "t").join(parts, "box").select(F.col("part").alias("box"), "n", F.col("child").alias("t"))
    levelled = lambda found: reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("level"), "*") for k, df in found.items()])
    return Interactions(reduce(DataFrame.unionByName, served), levelled(sources), levelled(levels), homes, side, low, store)


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """A left join on obs_id in which null is an obs_id like others."""
    other = right.withColumnRenamed("obs_id", "_id")
    return left.join(other, F.col("obs_id").eqNullSafe(F.col("_id")), "left").drop("_id")


def forward(
    stations: DataFrame,
    cells: DataFrame,
    kernels: dict[str, tuple[Callable[..., Column], str]],
    theta: float = 0.5,
    order: int = 4,
    limits: dict[str, tuple[int, float]] | None = None,
    deepest: int = 20,
) -> DataFrame:
    """``fields.forward`` in some n log n pairs: kernel(d, r, volume) times a property, summed over cells, per obs_id.

    Kernels must be linear in volume and smooth away from the cell. ``limits`` names, for kernels that are derivatives of
    1 / r, their number of derivatives m and their factor f; ``<name>_bound`` is then a sure bound of the error, rounding
    apart: the sum, over the boxes that serve a station by order^3 sources of their own, of
    f * strength * (1 + L + L^2) * (order + m)! / order! * h^order / 2^(order - 1) / gap^(order + m + 1), with h half the
    box's side, gap the station's distance from the box and L the interpolation's Lebesgue constant.

    Cells with a null coordinate count for nothing, a null property or volume is no strength. Stations with a null
    coordinate, or without any cell, get nulls. Rows of equal obs_id add up. What the tree wrote is deleted but for the result.
    """
    limits = limits or {}
    if unknown := limits.keys() - kernels.keys():
        raise ValueError(f"limits of no kernel: {', '.join(sorted(unknown))}")
    properties = sorted({p for _, p in kernels.values()})
    tree = interactions(stations, cells, properties, theta, order, deepest)
    d = [F.col(f"s{a}") - F.col(a) for a in AXES]
    homes = tree.stations.select("obs_id", *[F.col(a).alias(f"s{a}") for a in AXES], "level", "t")
    # sources join the boxes' lists before the stations do: a list is shorter than its stations
    met = tree.lists.join(tree.sources.withColumnRenamed("box", "s"), ["level", "s"]).join(homes, ["level", "t"])
    sums = [F.sum(kernel(d, potential.distance(d), F.lit(1.0)) * F.col(p)).alias(name) for name, (kernel, p) in kernels.items()]
    out = _beside(stations.select("obs_id").distinct(), met.groupBy("obs_id").agg(*sums))
    if limits:
        lebesgue = 2.0 / math.pi * math.log(order + 1) + 1.0
        spread = 1.0 + lebesgue + lebesgue**2
        h = F.lit(tree.side / 2.0) / F.pow(F.lit(2.0), F.col("level"))
        beyond = [F.greatest(F.abs(F.col(f"s{a}") - (F.lit(tree.low[k]) + (2.0 * part + 1.0) * h)) - h, F.lit(0.0)) for k, (a, part) in enumerate(zip(AXES, _unpack(F.col("s")), strict=True))]
        gap = F.sqrt(reduce(lambda a, b: a + b, [g * g for g in beyond]))
        whole = tree.boxes.filter(F.col("n") > order**3).withColumnRenamed("box", "s")
        deep = tree.boxes.agg(F.max("level")).first()[0] or 0
        rows = tree.lists.filter(F.col("level") < deep).join(whole, ["level", "s"]).join(homes, ["level", "t"])
        rows = rows.withColumns({"_h": h, "_gap": gap})
        each = [
            F.sum(abs(f) * spread * math.factorial(order + m) / math.factorial(order) / 2.0 ** (order - 1) * F.col(f"size_{kernels[name][1]}") * F.pow("_h", F.lit(float(order))) / F.pow("_gap", F.lit(float(order + m + 1)))).alias(f"{name}_bound")
            for name, (m, f) in limits.items()
        ]
        out = _beside(out, rows.groupBy("obs_id").agg(*each))
        out = out.withColumns({f"{name}_bound": F.when(F.col(name).isNotNull(), F.coalesce(f"{name}_bound", F.lit(0.0))) for name in limits})
    result = tree.store(out)
    tree.store.drop(tree.lists, tree.sources, tree.boxes, tree.stations)
    return result
