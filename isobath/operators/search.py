"""Searches by equality of keys: interval joins by buckets of adaptive width, sums over intervals by running sums, exact nearest neighbours by a tree of boxes."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobath.sources.storage import Store


def _level(width: Column) -> Column:
    """The power of two at or above a width: an interval of it touches two buckets of that size at most."""
    return F.when(width > 0, F.ceil(F.log2(width))).otherwise(F.lit(-1000)).cast("int")


def interval_join(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, key: list[str] | None = None, least: float = 1e-6, salts: int = 1) -> DataFrame:
    """Every point with every interval [low, high] that holds it: columns of both, whose names must differ but for key's.

    An interval is dealt to the one or two buckets, of the power of two at or above its own width, that it touches, and a
    point to one bucket of each width that occurs; so wide intervals are no burden to narrow ones, and the join is by
    equality of (key, level, bucket). With ``salts`` points of a bucket are spread over so many copies of its intervals, for
    buckets that hold a large part of all points. Widths under ``least`` count as that. Nulls join nothing; intervals with
    high under low hold nothing.
    """
    key = key or []
    if clash := (set(points.columns) & set(intervals.columns)) - set(key):
        raise ValueError(f"columns on both sides: {', '.join(sorted(clash))}")
    held = intervals.filter((F.col(high) >= F.col(low)) & F.col(low).isNotNull())
    level = _level(F.greatest(F.col(high) - F.col(low), F.lit(least)))
    held = held.withColumn("_level", level).withColumn("_size", F.pow(F.lit(2.0), F.col("_level")))
    first, last = F.floor(F.col(low) / F.col("_size")), F.floor(F.col(high) / F.col("_size"))
    dealt = held.withColumn("_bucket", F.explode(F.sequence(first, last))).drop("_size")
    # a level is a power of two between least and the widest interval: a few dozen numbers
    levels = sorted(r[0] for r in held.select("_level").distinct().collect())
    spread = points.filter(F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")))
    spread = spread.withColumn("_bucket", F.floor(F.col(at) / F.pow(F.lit(2.0), F.col("_level"))))
    if salts > 1:
        spread = spread.withColumn("_salt", F.pmod(F.xxhash64(*points.columns), F.lit(salts)))
        dealt = dealt.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    on = [*key, "_level", "_bucket", *["_salt"] * (salts > 1)]
    met = spread.join(dealt, on).filter((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high)))
    return met.drop("_level", "_bucket", "_salt")


def interval_sums(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, sums: tuple[str, ...] = ()) -> DataFrame:
    """The rows of intervals that hold points, with their number n, the sums of whole-number columns and the smallest ``at`` as first.

    What an interval holds is the difference of running sums at its ends, so no pairs are made, however many points wide
    intervals hold. Points are summed up by place and sorted into ranges; ends go to the range they fall in, before or
    after the points at their own place, and a running window in each range and the totals of the ranges before give the sums.
    Only integers are summed, as differences of running sums of fractions would lose digits. Nulls and intervals with high
    under low hold nothing; equal rows stay as many as they are.
    """
    if clash := {"n", "first", *sums} & set(intervals.columns):
        raise ValueError(f"columns on both sides: {', '.join(sorted(clash))}")
    if bad := [c for c in sums if dict(points.dtypes)[c] not in ("tinyint", "smallint", "int", "bigint")]:
        raise ValueError(f"not whole numbers: {', '.join(bad)}")
    spark, held = points.sparkSession, ["_n", *[f"_{c}" for c in sums]]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    store = Store(spark, "intervals")
    given = points.filter(F.col(at).isNotNull()).groupBy((F.col(at).cast("double") + 0.0).alias("_x"))
    placed = given.agg(F.count("*").alias("_n"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"_{c}") for c in sums])
    placed = store(placed.repartitionByRange(parts, "_x").withColumn("_part", F.spark_partition_id()))
    # a row a range
    ranges = placed.groupBy("_part").agg(F.min("_x").alias("_least"), *[F.sum(c).alias(c) for c in held]).orderBy("_least").collect()
    before, starts, total = [], [], [0] * len(held)
    for k, r in enumerate(ranges):
        starts.append(r["_least"])
        before.append((r["_part"], *total, ranges[k + 1]["_least"] if k + 1 < len(ranges) else None))
        total = [a + r[c] for a, c in zip(total, held, strict=True)]
    ends = intervals.filter(F.col(high) >= F.col(low)).select(F.col(low).cast("double").alias("_low"), F.col(high).cast("double").alias("_high")).distinct()
    if not ranges:
        return intervals.select("*", F.lit(0).cast("long").alias("n"), *[F.lit(0).cast("long").alias(c) for c in sums], F.lit(0.0).alias("first")).limit(0)
    numbers = F.array(*[F.lit(int(r["_part"])) for r in ranges])
    nth = F.greatest(F.size(F.filter(F.array(*[F.lit(float(x)) for x in starts]), lambda x: x <= F.col("_x"))), F.lit(1))
    side = F.explode(F.array(F.struct((F.col("_low") + 0.0).alias("_x"), F.lit(0).alias("_side")), F.struct((F.col("_high") + 0.0).alias("_x"), F.lit(2).alias("_side")))).alias("_e")
    dealt = ends.select("_low", "_high", side).select("_low", "_high", "_e.*").withColumn("_part", F.element_at(numbers, nth))
    both = placed.withColumn("_side", F.lit(1)).unionByName(dealt, allowMissingColumns=True)
    up = Window.partitionBy("_part").orderBy("_x", "_side").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("_part").orderBy(F.col("_x").desc(), F.col("_side").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = both.withColumns({f"{c}_up": F.coalesce(F.sum(c).over(up), F.lit(0)) for c in held}).withColumn("_next", F.last(F.when(F.col("_side") == 1, F.col("_x")), ignorenulls=True).over(down))
    offsets = spark.createDataFrame(before, ", ".join(["_part int", *[f"{c}_off long" for c in held], "_after double"]))
    known = run.filter(F.col("_side") != 1).join(F.broadcast(offsets), "_part")
    sign = F.when(F.col("_side") == 2, 1).otherwise(-1)
    inside = [F.sum(sign * (F.col(f"{c}_up") + F.col(f"{c}_off"))).alias(c) for c in held]
    first = F.min(F.when(F.col("_side") == 0, F.coalesce("_next", "_after"))).alias("_first")
    found = known.groupBy("_low", "_high").agg(*inside, first).filter(F.col("_n") > 0)
    made = intervals.withColumns({"_low": F.col(low).cast("double"), "_high": F.col(high).cast("double")}).join(found, ["_low", "_high"])
    return made.select(*intervals.columns, F.col("_n").alias("n"), *[F.col(f"_{c}").alias(c) for c in sums], F.col("_first").alias("first"))


def _distance(axes: list[str]) -> Column:
    d = [F.col(f"p_{a}") - F.col(f"c_{a}") for a in axes]
    return reduce(lambda x, y: x + y, [x * x for x in d])


#: Boxes that every point looks at first, at most; members of the fullest box at which the boxes are fine enough.
FIRST_BOXES, FULL_BOX = 16, 16


def _bounds(axes: list[str]) -> tuple[Column, Column, Column]:
    """Squares of: the distance under which a box (lo, hi) holds nothing, that within which it holds one cell, and all.

    The box is tight, so each of its faces touches a cell: one lies no farther than the farthest corner of its nearest face.
    """
    square = lambda x: x * x
    p, lo, hi = ([F.col(f"{n}_{a}") for a in axes] for n in ("p", "lo", "hi"))
    total = lambda xs: reduce(lambda x, y: x + y, xs)
    low = total([square(F.greatest(b - x, x - t, F.lit(0.0))) for x, b, t in zip(p, lo, hi, strict=True)])
    edge = [square(F.greatest(F.abs(x - b), F.abs(x - t))) for x, b, t in zip(p, lo, hi, strict=True)]
    face = [square(F.least(F.abs(x - b), F.abs(x - t))) for x, b, t in zip(p, lo, hi, strict=True)]
    one = [total([face[j] if i == j else edge[j] for j in range(len(axes))]) for i in range(len(axes))]
    return low, F.least(*one) if len(one) > 1 else one[0], total(edge)


def _promising(seen: DataFrame, axes: list[str], k: int) -> DataFrame:
    """The rows (obs_id, p_.., n, lo_.., hi_..) whose box may hold one of the k cells nearest to its point."""
    point = Window.partitionBy("obs_id")
    rows = seen.withColumns(dict(zip(("_low", "_one", "_all"), _bounds(axes), strict=True)))
    if k == 1:
        rows = rows.withColumn("_bound", F.min("_one").over(point))
    else:
        # k boxes with a cell each within "_one", or boxes with k cells together within "_all"
        rows = rows.withColumn("_boxes", F.row_number().over(point.orderBy("_one"))).withColumn("_held", F.sum("n").over(point.orderBy("_all").rowsBetween(Window.unboundedPreceding, 0)))
        rows = rows.withColumn("_bound", F.least(F.min(F.when(F.col("_boxes") >= k, F.col("_one"))).over(point), F.min(F.when(F.col("_held") >= k, F.col("_all"))).over(point)))
    return rows.filter(F.col("_low") <= F.col("_bound") * (1.0 + 1e-9))


def nearest(points: DataFrame, cells: DataFrame, k: int = 1, axes: tuple[str, ...] = ("x", "y", "z"), size: float | None = None, most: int = 40) -> DataFrame:
    """(obs_id, cell_id, rank, distance) of the k nearest cells of every point, the smaller id of equal ones first.

    Space is halved along each axis again and again, and of every box that holds a cell the tight bounds and the number of
    cells are kept. A point goes down from the large boxes: at each level it keeps those that may hold one of its k cells,
    as the others begin behind k cells that are sure, and meets their halves by equality. So a point far from all
    cells looks at few boxes a level as well. The finest boxes, of ``size`` or such that they hold some k cells where they lie
    evenly and a few more where not, are opened. ``most`` is the greatest number of levels. Of cells at
    one place only the k of smallest id can be among the nearest, so no others are kept.

    Rows of equal obs_id must be one point. Points and cells with a null coordinate are left out. With fewer than k cells
    all are ranked.
    """
    axes = list(axes)
    spark = points.sparkSession
    store = Store(spark, "nearest")
    p = points.select("obs_id", *[F.col(a).cast("double").alias(f"p_{a}") for a in axes]).dropna(subset=[f"p_{a}" for a in axes]).dropDuplicates(["obs_id"])
    placed = cells.select("cell_id", *[F.col(a).cast("double").alias(f"c_{a}") for a in axes]).dropna(subset=[f"c_{a}" for a in axes])
    there = Window.partitionBy(*[f"c_{a}" for a in axes]).orderBy("cell_id")
    c = store(placed.withColumn("place", F.row_number().over(there)).filter(F.col("place") <= max(k, 1)).drop("place"))
    ends = c.agg(F.count("*").alias("n"), *[f(f"c_{a}").alias(f"{n}_{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if not ends.n or k < 1:
        return p.select("obs_id", F.lit(None).cast("long").alias("cell_id"), F.lit(0).cast("long").alias("rank"), F.lit(0.0).alias("distance")).limit(0)
    wanted = min(k, ends.n)
    spans = [s for a in axes if (s := ends[f"hi_{a}"] - ends[f"lo_{a}"]) > 0]
    span = max(spans, default=1.0)
    fine = size or (math.prod(spans) * wanted / ends.n) ** (1 / len(spans)) if spans else 1.0
    deep = max(0, min(most, math.ceil(math.log2(span / fine)) + (3 if size is None else 0)))
    boxed = c.withColumns({f"b_{a}": F.least(F.floor((F.col(f"c_{a}") - ends[f"lo_{a}"]) / span * float(2**deep)), F.lit(2**deep - 1)).cast("long") for a in axes})
    keys = [f"b_{a}" for a in axes]
    at = lambda df, level: df.withColumns({b: F.floor(F.col(b) / 2.0 ** (deep - level)) for b in keys})
    every = boxed.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(deep)))).withColumns({b: F.floor(F.col(b) / F.pow(F.lit(2.0), deep - F.col("level"))) for b in keys})
    tree = every.groupBy("level", *keys).agg(F.count("*").alias("n"), *[f(f"c_{a}").alias(f"{n}_{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))])
    tree.write.partitionBy("level").parquet(f"{store.folder}/boxes")
    tree = spark.read.parquet(f"{store.folder}/boxes")
    # a row a level: how many boxes it has and how many cells the fullest holds
    levels = sorted(tuple(r) for r in tree.groupBy("level").agg(F.count("*"), F.max("n")).collect())
    first = max(level for level, boxes, _ in levels if level == 0 or boxes <= FIRST_BOXES)
    last = max(first, next((level for level, _, full in levels if full <= max(FULL_BOX, wanted)), deep))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    own = lambda level: tree.filter(F.col("level") == level).drop("level")
    looking = _promising(p.repartition(parts, "obs_id").crossJoin(F.broadcast(own(first))), axes, wanted)
    kept = ["obs_id", *[f"p_{a}" for a in axes]]
    for level in range(first + 1, last + 1):
        halves = own(level).withColumns({f"up_{b}": F.floor(F.col(b) / 2.0) for b in keys})
        above = looking.select(*kept, *[F.col(b).alias(f"up_{b}") for b in keys])
        looking = _promising(above.join(halves, [f"up_{b}" for b in keys]), axes, wanted)
    met = looking.select(*kept, *keys).join(at(boxed, last), keys).select("obs_id", "cell_id", _distance(axes).alias("s"))
    best = met.withColumn("rank", F.row_number().over(Window.partitionBy("obs_id").orderBy("s", "cell_id"))).filter(F.col("rank") <= wanted)
    return best.select("obs_id", "cell_id", F.col("rank").cast("long").alias("rank"), F.sqrt("s").alias("distance"))
