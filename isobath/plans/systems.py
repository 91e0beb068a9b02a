"""Queries of sparse systems on the grid of parts, 40 places wide, against closed solutions by eigenfunctions.

The operator is -lap + 2 a d/dx, which is not symmetric, with identity on the rim; its eigenfunctions are
rho^i sin(pi k i / 39) sin(pi l j / (n - 1)), rho^2 = (1 + a) / (1 - a), those of its adjoint have rho^-i.
"""

from __future__ import annotations

from isobath.operators import sparse
from isobath.sources.storage import Store
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}
WIDTH = 40
DRIFT = 0.05
SHIFT = (0.02, 0.05)
MODES = ((1, 1), (2, 1), (3, 2))

_g = "sqrt(1e0 - 25e-4)"
_rho = "sqrt(105e-2 / 95e-2)"
#: The grid and the amplitudes of the modes; the same text for Spark and for the oracle.
_GRID = f"SELECT p_partkey AS node, CAST(p_partkey % {WIDTH} AS BIGINT) AS i, CAST(floor(p_partkey / {WIDTH}e0) AS BIGINT) AS j FROM part"
_SIZES = "SELECT avg(p_retailprice) / 1e3 AS a1, avg(CAST(p_size AS DOUBLE)) / 5e1 AS a2, max(CAST(p_size AS DOUBLE)) / 1e2 AS a3, floor(max(p_partkey) / 4e1) AS last FROM part"


def _mode(k: int, sign: int) -> str:
    x, y = MODES[k]
    return f"(a{k + 1} * power({_rho}, {sign} * i) * sin(pi() * {x} * i / 39e0) * sin(pi() * {y} * j / last))"


def _value(k: int) -> str:
    x, y = MODES[k]
    return f"(4e0 - 2e0 * {_g} * cos(pi() * {x} / 39e0) - 2e0 * cos(pi() * {y} / last))"


def grid(spark, sf_dir) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = part.selectExpr("p_partkey AS node", f"CAST(p_partkey % {WIDTH} AS BIGINT) AS i", f"CAST(floor(p_partkey / {WIDTH}e0) AS BIGINT) AS j")
    return rows.crossJoin(part.selectExpr("avg(p_retailprice) / 1e3 AS a1", "avg(CAST(p_size AS DOUBLE)) / 5e1 AS a2", "max(CAST(p_size AS DOUBLE)) / 1e2 AS a3", "floor(max(p_partkey) / 4e1) AS last"))


def operator(cells: DataFrame, shift: tuple[float, float] | None = None) -> DataFrame:
    """(r, c, v[, v_i]): five entries a place inside, one on the rim."""
    inside = (F.col("i") > 0) & (F.col("i") < WIDTH - 1) & (F.col("j") > 0) & (F.col("j") < F.col("last"))
    centre, lost = (4.0, 0.0) if shift is None else (4.0 - shift[0], -shift[1])
    near = [(0, centre), (-1, -1.0 - DRIFT), (1, -1.0 + DRIFT), (-WIDTH, -1.0), (WIDTH, -1.0)]
    entries = F.when(inside, F.array(*[F.struct((F.col("node") + d).alias("c"), F.lit(v).alias("v")) for d, v in near]))
    rows = cells.select(F.col("node").alias("r"), inside.alias("inside"), F.explode(F.coalesce(entries, F.array(F.struct(F.col("node").alias("c"), F.lit(1.0).alias("v"))))).alias("e"))
    coo = rows.select("r", "e.c", "e.v", *[F.when(F.col("inside") & (F.col("r") == F.col("e.c")), lost).otherwise(0.0).alias("v_i")] * (shift is not None))
    return coo


def _sparse_solve(spark, sf_dir):
    cells = grid(spark, sf_dir)
    rhs = cells.selectExpr("node", f"{' + '.join(_mode(k, 1) for k in range(3))} AS f")
    found = sparse.solve(operator(cells), rhs, sparse.grid_tiles(cells, ["j", "i"]), tolerance=1e-11)
    return found.table.select("node", (F.round("u", 4) + 0.0).alias("u"))


QUERIES["sparse_solve"] = _sparse_solve
ORACLES["sparse_solve"] = f"SELECT node, round({' + '.join(f'{_mode(k, 1)} / {_value(k)}' for k in range(3))}, 4) + 0e0 AS u FROM ({_GRID}) g, ({_SIZES}) s"


def _sparse_adjoint(spark, sf_dir):
    """The adjoint of the operator with absorption, inside the rim."""
    cells = grid(spark, sf_dir)
    inside = cells.filter(f"i > 0 AND i < {WIDTH - 1} AND j > 0 AND j < last")
    rhs = inside.selectExpr("node", f"{' + '.join(_mode(k, -1) for k in range(2))} AS f")
    found = sparse.solve(operator(cells, SHIFT), rhs, tolerance=1e-10, turned=True, store=Store(spark, "sparse"))
    return inside.select("node").join(found.table, "node").select("node", *[(F.round(c, 4) + 0.0).alias(c) for c in ("u", "u_i")])


_size = lambda k: f"(power({_value(k)} - 2e-2, 2) + 25e-4)"
QUERIES["sparse_adjoint"] = _sparse_adjoint
ORACLES["sparse_adjoint"] = f"""SELECT node, round({' + '.join(f'{_mode(k, -1)} * ({_value(k)} - 2e-2) / {_size(k)}' for k in range(2))}, 4) + 0e0 AS u,
  round({' + '.join(f'{_mode(k, -1)} * -5e-2 / {_size(k)}' for k in range(2))}, 4) + 0e0 AS u_i
FROM ({_GRID}) g, ({_SIZES}) s WHERE i > 0 AND i < {WIDTH - 1} AND j > 0 AND j < last"""
