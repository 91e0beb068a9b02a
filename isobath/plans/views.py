"""Inputs of the queries: projections of the driver's tables, the same text for Spark and for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name: (table, expressions, filter)
VIEWS: dict[str, tuple[str, list[str], str | None]] = {
    "ctd": ("lineitem", ["l_orderkey AS obs_id", "2e0 + 28e0 * l_quantity / 50e0 AS t_c", "25e0 + 150e0 * l_discount AS s_ppt", "l_extendedprice / 15e0 AS depth_m", "l_linenumber AS band"], None),
    "air": ("orders", ["o_orderkey AS obs_id", "500e0 + o_totalprice / 1000e0 AS p_hpa", "250e0 + CAST(o_orderkey % 60 AS DOUBLE) AS t_k", "CAST(o_custkey % 100 AS DOUBLE) / 100e0 AS humidity", "1e0 + CAST(o_custkey % 99 AS DOUBLE) AS f_ghz", "1e0 + o_totalprice / 5000e0 AS rain_mm_h"], None),
    "rock": ("part", ["p_partkey AS obs_id", "5e-2 + 25e-2 * p_size / 50e0 AS phi", "p_retailprice / 60e0 AS k_dry", "366e-1 AS k_min", "CASE WHEN p_partkey % 2 = 0 THEN 22e-1 ELSE 133e-3 END AS k_fl", "CAST(p_size AS DOUBLE) AS size", "CAST(p_partkey % 4 AS BIGINT) AS kind"], None),
    "station": ("supplier", ["s_suppkey AS obs_id", "200e0 * (s_suppkey % 10) AS x", "200e0 * CAST(floor(s_suppkey / 10) AS BIGINT) AS y", "50e0 AS z"], None),
    "scene": ("supplier", ["s_suppkey AS obs_id", "5e-1 + CAST(CAST(floor(abs(s_acctbal)) AS BIGINT) % 101 AS DOUBLE) / 1e2 AS p"], None),
    "cell": ("part", ["p_partkey AS cell_id", "CAST(p_partkey % 20 AS BIGINT) AS i", "CAST(floor(p_partkey / 20) AS BIGINT) % 10 AS j", "CAST(floor(p_partkey / 200) AS BIGINT) AS k", "100e0 * (p_partkey % 20) AS x", "200e0 * (CAST(floor(p_partkey / 20) AS BIGINT) % 10) AS y", "-100e0 * (CAST(floor(p_partkey / 200) AS BIGINT) + 1) AS z", "1e6 AS volume", "p_retailprice - 950e0 AS rho", "p_size / 1000e0 AS kappa"], None),
    "trace": ("events", ["user_id AS trace_id", "CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) - 1 AS t_idx", "CAST(value AS DOUBLE) AS y"], None),
    "layer": ("customer", ["CAST(floor(c_custkey / 30) AS BIGINT) AS column_id", "CAST(c_custkey % 30 AS BIGINT) AS layer", "100e0 AS dz", "15e-1 + abs(c_acctbal) / 5000e0 AS cond", "1e-6 * CAST(c_custkey % 3 AS DOUBLE) AS heat"], None),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns, condition = VIEWS[name]
    df = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    return (df.filter(condition) if condition else df).selectExpr(*columns)


def view_sql(name: str) -> str:
    source, columns, condition = VIEWS[name]
    return f"(SELECT {', '.join(columns)} FROM {source}{f' WHERE {condition}' if condition else ''})"
