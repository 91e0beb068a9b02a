"""Event-time operators over series: as-of joins, gap sessions, summaries over grouping sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """left with the last value of right at or before its time, by one sort of both sides per key."""
    l = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType))  # noqa: E741
    r = right.select(key, time, F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    both = l.unionByName(r, allowMissingColumns=True)
    known = Window.partitionBy(key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(f"asof_{value}", F.last("_v", ignorenulls=True).over(known)).filter("_side = 1").drop("_side", "_v")


def sessions(events: DataFrame, key: str, time: str, gap_seconds: int) -> DataFrame:
    """Sessions of events that follow each other within a gap: key, session, events, start, end."""
    order = Window.partitionBy(key).orderBy(time)
    seconds = F.unix_timestamp(F.col(time).cast("timestamp"))
    cut = F.coalesce((seconds - F.lag(seconds).over(order) > gap_seconds).cast("long"), F.lit(0).cast("long"))
    numbered = events.withColumn("_cut", cut).withColumn("session", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.count("*").alias("events"), F.min(time).alias("start"), F.max(time).alias("end"))


def summary(table: DataFrame, groups: list[str], value: str, sets: str = "cube") -> DataFrame:
    """count, sum and mean over all grouping sets (cube), the nested ones (rollup) or just the groups."""
    if sets not in ("cube", "rollup", "groups"):
        raise ValueError("sets must be cube, rollup or groups")
    grouped = {"cube": table.cube, "rollup": table.rollup, "groups": table.groupBy}[sets](*groups)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
