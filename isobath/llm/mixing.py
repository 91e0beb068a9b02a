"""Mixing sources to target weights.

Tokens are summed per source, the sums give each source's repetition rate, and a document is taken
floor(rate) times plus one further copy with probability equal to the fraction. The draw is a hash
of seed and doc_id, so reruns and retried tasks agree.

Nulls: a null text has size 0; null sources form one source that sorts last; rows without doc_id draw by
their text. Rows with equal doc_id, and equal texts without one, draw alike. An empty table gives an empty
result. A text of any length counts whole. Columns of docs pass through ``mix`` untouched, whatever their names; ``rates`` replaces those that are
named like one it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobath.llm.shared import materialise, n_words, shielded, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SEED = "mix"


def _in_order(df: DataFrame, *order: Column) -> DataFrame:
    """df range-partitioned by an order and written with the number of the partition, so that sums can run over it."""
    return materialise(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "order")


def _running(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """The sums over all rows before each row in the order, of a table made by _in_order: windows run inside the
    partitions, and over one row a partition for what comes before each."""
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = df.groupBy("part").agg(*[F.sum(x).alias(n) for n, x in sums.items()])
    offsets = parts.select("part", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"before_{n}") for n in sums])
    local = df.select("*", *[F.coalesce(F.sum(x).over(inside), F.lit(0)).alias(n) for n, x in sums.items()])
    return local.join(offsets, "part").withColumns({n: F.col(n) + F.col(f"before_{n}") for n in sums}).drop("part", *[f"before_{n}" for n in sums])


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target of a table with source and size.

    Targets are min(cap * size, level * weight); the level at which they add up to the share comes from
    running sums over the sources in the order in which they reach their cap. However many sources there are,
    they are ranked and summed by partitions; the driver gets the level alone.
    """
    by_name = F.col("source").asc_nulls_last()
    named = _in_order(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), by_name)
    ranked = _running(named, [by_name], rank=F.lit(1))
    weighed = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    reach = F.col("source_size") / F.col("weight")
    placed = _in_order(weighed.withColumn("reach", reach), F.col("reach"), F.col("rank"))
    total, weight = placed.agg(F.sum("source_size"), F.sum("weight")).first()
    if total is None:
        return placed.select("source", "source_size", F.lit(0.0).alias("target"))
    summed = _running(placed, [F.col("reach"), F.col("rank")], before=F.col("source_size"), lighter=F.col("weight"))
    level = (F.lit(share) * F.lit(total) - F.lit(cap) * F.col("before")) / (F.lit(weight) - F.col("lighter"))
    free = summed.withColumn("level", level).filter(F.lit(cap) * F.col("source_size") >= F.col("level") * F.col("weight"))
    chosen = free.agg(F.min_by("level", F.struct("reach", "rank"))).first()[0]
    target = F.least(F.lit(cap) * F.col("source_size"), F.lit(float("inf") if chosen is None else chosen) * F.col("weight"))
    return placed.select("source", "source_size", target.cast("double").alias("target"))


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """Uniform in [0, 1) from 52 bits of a hash of seed and doc_id, or of the text where there is no doc_id."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def _rated(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> tuple[DataFrame, list[Column]]:
    """docs under hidden names with size, source_size, target and copies; and the columns of docs."""
    hidden, back = shielded(docs)
    own = {c: F.col(h) for c, h in zip(docs.columns, hidden, strict=True)}
    sized = docs.toDF(*hidden).withColumn("size", n_words(own["text"]))
    targets = materialise(source_targets(sized.select(own["source"].alias("source"), "size"), weights, share, cap), "mix")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = draw(own["doc_id"], own["text"], seed) < rate - F.floor(rate)
    rated = sized.join(targets, own["source"].eqNullSafe(F.col("source"))).withColumn("copies", F.floor(rate) + extra.cast("long"))
    return rated, back


def rates(docs: DataFrame, **options) -> DataFrame:
    """docs with size, source_size, target and copies (how many times the mix takes the row)."""
    rated, back = _rated(docs, **options)
    added = ["size", "source_size", "target", "copies"]
    return rated.select(*[x for c, x in zip(docs.columns, back, strict=True) if c not in added], *added)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: every row of docs as often as the mix takes it, with copy = 0, 1, ..; a copy column of docs stays instead."""
    rated, back = _rated(docs, **options)
    taken = rated.filter(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
    return taken.select(*back, *([] if "copy" in docs.columns else ["copy"]))


def op5_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return rates(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mix_sql(documents: str = "documents") -> str:
    """DuckDB: one row per document with its size, target and copies."""
    return f"""
WITH sized AS (
  SELECT *, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM {documents}),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rk FROM per_source),
weighed AS (SELECT *, CASE rk % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM ranked),
levels AS (
  SELECT *, CAST(source_size AS DOUBLE) / weight AS reach,
    (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
      - 2.0::DOUBLE * coalesce(CAST(sum(source_size) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0))
      / CAST(sum(weight) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighed),
chosen AS (SELECT level FROM levels WHERE 2.0::DOUBLE * source_size >= level * weight ORDER BY reach, rk LIMIT 1),
targets AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce((SELECT level FROM chosen) * weight, 'inf'::DOUBLE)) AS target FROM levels),
rated AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))), 1, 13))::BIGINT AS DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
mixed AS (SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM rated)
"""


ORACLE = mix_sql() + "SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken FROM mixed"
