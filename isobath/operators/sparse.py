"""Sparse linear systems on edge tables: BiCGSTAB with a multilevel preconditioner, complex entries, adjoint solves.

An operator is a table (r, c, v) and, if complex, v_i; repeated entries add up and every row must have a diagonal entry
that is not zero. A vector is (node, f) and, if complex, f_i. Nothing is asked of symmetry or definiteness.

A product is one join and one sum by row. The operator is dealt to buckets of its columns once, so only the vector and the
partial sums move; what a node carries along rides on its diagonal entry and costs no join of its own.

The preconditioner takes nodes together into tiles, tiles into larger tiles, until at most ``MOST_COARSE`` are left, whose
matrix is inverted by one task (a bounded one). Constants on tiles are smoothed by one damped Jacobi step of the
operator; a coarser operator is the Galerkin product, two joins. A cycle smooths, corrects by the coarser level and
smooths again, so iterations do not grow with the grid.

Each half step is stored, which cuts its lineage; the driver sees some sums a step. The adjoint solve is the same loop
on turned, conjugated edges.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobath.operators import fronts
from isobath.sources.storage import Store

MOST_COARSE = 256
SIDE = 3
DAMPING = 2.0 / 3.0
ENTRIES_A_BUCKET = 500_000

Parts = tuple[Column, "Column | None"]


@dataclass
class Solution:
    """(node, u[, u_i]), steps taken and the norm of what is left over the right-hand side's."""

    table: DataFrame
    steps: int
    residual: float


def parts(name: str, wide: bool) -> Parts:
    return F.col(name), F.col(f"{name}_i") if wide else None


def named(value: Parts, name: str) -> list[Column]:
    return [v.alias(n) for v, n in zip(value, (name, f"{name}_i"), strict=True) if v is not None]


def names(name: str, wide: bool) -> list[str]:
    return [name, f"{name}_i"] if wide else [name]


def times(a: Parts, b: Parts) -> Parts:
    if a[1] is None and b[1] is None:
        return a[0] * b[0], None
    ai, bi = (F.lit(0.0) if x[1] is None else x[1] for x in (a, b))
    return a[0] * b[0] - ai * bi, a[0] * bi + ai * b[0]


def scaled(k: complex, a: Parts) -> Parts:
    return (F.lit(k.real) * a[0], None) if a[1] is None else times((F.lit(k.real), F.lit(k.imag)), a)


def plus(*terms: Parts) -> Parts:
    return reduce(lambda a, b: (a[0] + b[0], None if a[1] is None else a[1] + b[1]), terms)


def summed(a: Parts) -> Parts:
    return F.sum(a[0]), None if a[1] is None else F.sum(a[1])


def inner(a: Parts, b: Parts) -> Parts:
    """The sum of conj(a) b."""
    return summed(times((a[0], None if a[1] is None else -a[1]), b))


def adjoint(coo: DataFrame) -> DataFrame:
    """The edges turned around, conjugated if complex."""
    wide = "v_i" in coo.columns
    return coo.select(F.col("c").alias("r"), F.col("r").alias("c"), "v", *[(-F.col("v_i")).alias("v_i")] * wide)


def grid_tiles(field: DataFrame, axes: list[str], side: int = SIDE, most: int = MOST_COARSE) -> list[DataFrame]:
    """(node, tile) of each level for nodes with integer places on axes: tiles of side**len(axes), until at most ``most`` are left."""
    ends = field.agg(F.count("*"), *[f(a) for a in axes for f in (F.min, F.max)]).first()
    if any(e is None for e in ends) or not axes:
        return []
    low, size = list(ends[1::2]), [b - a + 1 for a, b in zip(ends[1::2], ends[2::2], strict=True)]

    place = [F.col(a) - b for a, b in zip(axes, low, strict=True)]
    level, out = field.select("node", *[p.cast("long").alias(f"x{k}") for k, p in enumerate(place)]), []
    while math.prod(size) > most:
        size = [-(-n // side) for n in size]
        up = [F.floor(F.col(f"x{k}") / side) for k in range(len(axes))]
        made = level.select("node", _mixed(up, size).cast("long").alias("tile"), *[u.cast("long").alias(f"x{k}") for k, u in enumerate(up)])
        out.append(made.select("node", "tile"))
        level = made.select(F.col("tile").alias("node"), *[f"x{k}" for k in range(len(axes))]).distinct()
    return out


def _mixed(values: list[Column], sizes: list[int]) -> Column:
    """One number for a place on several axes."""
    out = values[0]
    for v, n in zip(values[1:], sizes[1:], strict=True):
        out = out * n + v
    return out


def inverse(a: np.ndarray) -> np.ndarray:
    """The inverse of a small matrix by elimination with row exchanges: whole-row steps, no threads of a library inside a task."""
    n = len(a)
    work = np.hstack([a, np.eye(n, dtype=a.dtype)])
    for k in range(n):
        best = k + int(np.abs(work[k:, k]).argmax())
        if work[best, k] == 0:
            raise ValueError("the coarsest operator is singular")
        work[[k, best]] = work[[best, k]]
        work[k] /= work[k, k]
        factor = work[:, k].copy()
        factor[k] = 0
        work -= factor[:, None] * work[k]
    return work[:, n:]


class Level:
    """An operator with its smoother and, but on the coarsest level, the way to a coarser one."""

    def __init__(self, store: Store, coo: DataFrame, tiles: list[DataFrame], most: int):
        self.store, self.wide = store, "v_i" in coo.columns
        added = store(coo.groupBy("r", "c").agg(*[F.sum(x).alias(x) for x in names("v", self.wide)]))
        size = F.col("v") * F.col("v") + (F.col("v_i") * F.col("v_i") if self.wide else F.lit(0.0))
        own = F.max(F.when(F.col("r") == F.col("c"), size)).alias("own")
        seen = added.groupBy("r").agg(own, F.count("*").alias("n")).agg(F.sum("n").alias("entries"), F.count("*").alias("nodes"), F.count_if((F.col("own") > 0).isNull() | (F.col("own") == 0)).alias("bad")).first()
        if seen.bad:
            raise ValueError(f"{seen.bad} rows without a diagonal")
        n = -(-(seen.entries or 1) // ENTRIES_A_BUCKET)
        self.edges = store.bucketed(added, "c", n)
        own = self.edges.filter("r = c")
        over = (F.col("v") / size, -F.col("v_i") / size if self.wide else None)
        self.over = store.bucketed(own.select(F.col("r").alias("node"), *named(over, "d")), "node", n)
        self.next = self.inverse = None
        if tiles:
            self.prolong = store.bucketed(self._smoothed(tiles[0]), "node", n)
            self.next = Level(store, self._galerkin(), tiles[1:], most)
        elif seen.nodes <= most:
            self.inverse = store(self._inverted())

    def _smoothed(self, tiles: DataFrame) -> DataFrame:
        """(node, tile, w): constants on tiles after a damped Jacobi step of the operator's real part."""
        real = self.edges.join(self.over.select(F.col("node").alias("r"), F.col("d").alias("over")), "r")
        step = real.join(tiles.select(F.col("node").alias("c"), "tile"), "c").select(F.col("r").alias("node"), "tile", (-DAMPING * F.col("over") * F.col("v")).alias("w"))
        return tiles.select("node", "tile", F.lit(1.0).alias("w")).unionByName(step).groupBy("node", "tile").agg(F.sum("w").alias("w")).filter("w <> 0")

    def _galerkin(self) -> DataFrame:
        p = self.prolong
        v, w = parts("v", self.wide), (F.col("w"), None)
        half = self.edges.join(p.withColumnRenamed("node", "c"), "c").groupBy("r", "tile").agg(*named(summed((v[0] * w[0], None if v[1] is None else v[1] * w[0])), "v"))
        half = half.select("r", F.col("tile").alias("c"), *names("v", self.wide))
        both = half.join(p.withColumnRenamed("node", "r"), "r")
        return both.groupBy(F.col("tile").alias("r"), "c").agg(*[F.sum(F.col(x) * F.col("w")).alias(x) for x in names("v", self.wide)])

    def _inverted(self) -> DataFrame:
        """(r, c, v[, v_i]) of the inverse of a small operator, made in one task."""
        wide, columns = self.wide, ["r", "c", *names("v", self.wide)]

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            nodes = np.unique(rows["r"])
            a = np.zeros((len(nodes), len(nodes)), complex if wide else float)
            a[np.searchsorted(nodes, rows["r"]), np.searchsorted(nodes, rows["c"])] = rows["v"] + 1j * rows["v_i"] if wide else rows["v"]
            inv = inverse(a).reshape(-1)
            return pd.DataFrame({"r": np.repeat(nodes, len(nodes)), "c": np.tile(nodes, len(nodes)), "v": inv.real} | ({"v_i": inv.imag} if wide else {}))

        return self.edges.select(*columns).groupBy(F.lit(0).alias("all")).applyInPandas(run, self.edges.select(*columns).schema)

    def product(self, vectors: DataFrame, name: str, out: str, carry: list[str]) -> DataFrame:
        """vectors (node, name, carry..) with out, the operator times name."""
        met = self.edges.join(vectors.withColumnRenamed("node", "c"), "c")
        own = [F.max(F.when(F.col("r") == F.col("c"), F.col(x))).alias(x) for x in dict.fromkeys(names(name, self.wide) + carry)]
        return met.groupBy(F.col("r").alias("node")).agg(*named(summed(times(parts("v", self.wide), parts(name, self.wide))), out), *own)

    def relaxed(self, of: DataFrame, value: Parts, out: str) -> DataFrame:
        """of with out = damped value over the diagonal; of has no column d."""
        d = parts("d", self.wide)
        return of.join(self.over, "node").select(*of.columns, *named(scaled(DAMPING, times(value, d)), out))

    def cycle(self, vectors: DataFrame) -> DataFrame:
        """(node, r) to (node, z), z near the solution of the operator for r."""
        w = self.wide
        r, z = parts("r", w), parts("z", w)
        if self.inverse is not None:
            met = self.inverse.join(vectors.withColumnRenamed("node", "c").withColumnsRenamed({"r": "f", "r_i": "f_i"}), "c")
            return met.groupBy(F.col("r").alias("node")).agg(*named(summed(times(parts("v", w), parts("f", w))), "z"))
        if self.next is None:
            return self.relaxed(vectors, r, "z").select("node", *names("z", w))
        first = self.product(self.relaxed(vectors.select("node", *names("r", w)), r, "z").withColumnsRenamed({"r": "f", "r_i": "f_i"}), "z", "y", names("f", w))
        first = self.store(first)
        left = plus(parts("f", w), scaled(-1.0, parts("y", w)))
        down = self.prolong.join(first.select("node", *named(left, "q")), "node").groupBy("tile").agg(*[F.sum(F.col("w") * F.col(x)).alias(y) for x, y in zip(names("q", w), names("r", w), strict=True)])
        coarse = self.next.cycle(down.withColumnRenamed("tile", "node"))
        up = self.prolong.join(coarse.select(F.col("node").alias("tile"), *[F.col(x).alias(y) for x, y in zip(names("z", w), names("e", w), strict=True)]), "tile").groupBy("node").agg(*[F.sum(F.col("w") * F.col(x)).alias(x) for x in names("e", w)])
        e = tuple(None if x is None else F.coalesce(x, F.lit(0.0)) for x in parts("e", w))
        second = first.join(up, "node", "left").select("node", *names("f", w), *named(plus(z, e), "z"))
        third = self.product(second, "z", "y", names("f", w))
        fixed = self.relaxed(third, plus(parts("f", w), scaled(-1.0, parts("y", w))), "e")
        return fixed.select("node", *named(plus(z, parts("e", w)), "z"))


def _number(row, name: str, wide: bool) -> complex | float:
    return complex(row[name], row[f"{name}_i"]) if wide else row[name]


def solve(coo: DataFrame, rhs: DataFrame, tiles: list[DataFrame] | None = None, tolerance: float = 1e-10, most: int = 200, turned: bool = False, store: Store | None = None, most_coarse: int = MOST_COARSE) -> Solution:
    """The solution u of A u = f, or of the adjoint operator's system if ``turned``.

    Where blocks of neighbouring numbers hold the operator (``fronts``, 4 * most_coarse unknowns a group), they are eliminated; a
    step is then a pass over the blocks. Everything else is iterated.
    tiles are the levels of the preconditioner, as of ``grid_tiles``; without them it is Jacobi's. ArithmeticError if
    ``most`` steps do not reach the tolerance. The solution is read from the store's folder, which the caller may close.
    """
    store = store or Store(coo.sparkSession, "sparse")
    wide = "v_i" in coo.columns or "f_i" in rhs.columns
    widened = lambda df, x: df if not wide or f"{x}_i" in df.columns else df.withColumn(f"{x}_i", F.lit(0.0))
    coo, rhs = widened(adjoint(coo) if turned else coo, "v"), widened(rhs, "f")
    found = fronts.solve(store, coo, rhs, tolerance, most, 4 * most_coarse)
    if found:
        return Solution(*found)
    level = Level(store, coo, tiles or [], most_coarse)
    cols = lambda *xs: [y for x in xs for y in names(x, wide)]
    part = lambda x: parts(x, wide)
    # nodes that the right-hand side leaves out have 0 there
    f = level.over.select("node").join(rhs.groupBy("node").agg(*[F.sum(x).alias(x) for x in cols("f")]), "node", "left")
    f = f.select("node", *[F.coalesce(x, F.lit(0.0)).alias(x) for x in cols("f")])
    zero = (F.lit(0.0), F.lit(0.0) if wide else None)
    state = store(f.select("node", *named(zero, "x"), *named(part("f"), "r"), *named(part("f"), "s0"), *named(part("f"), "p")))
    size = state.agg(*named(inner(part("r"), part("r")), "rr")).first()["rr"] or 0.0
    rho, left, step = size, size, 0
    limit = tolerance * tolerance * size

    def half(table: DataFrame, of: str, z: str, az: str) -> DataFrame:
        """table with z, the preconditioner on a column, and az, the operator on that."""
        given = table.select("node", *[F.col(x).alias(y) for x, y in zip(cols(of), cols("r"), strict=True)])
        found = level.product(level.cycle(given), "z", "az", [])
        renamed = {x: y for a, b in (("z", z), ("az", az)) for x, y in zip(cols(a), cols(b), strict=True)}
        return store(table.join(found.withColumnsRenamed(renamed), "node"))

    while left > limit:
        if step == most:
            raise ArithmeticError(f"{most} steps leave {math.sqrt(left / size):.1e} of the right-hand side")
        step += 1
        first = half(state, "p", "ph", "v")
        alpha = rho / _number(first.agg(*named(inner(part("s0"), part("v")), "sv")).first(), "sv", wide)
        now = first.select("node", *cols("x", "p", "s0", "ph", "v"), *named(plus(part("r"), scaled(-alpha, part("v"))), "s"))
        both = half(now, "s", "sh", "t")
        sums = both.agg(*[c for a, b, n in (("t", "t", "tt"), ("t", "s", "ts"), ("s", "s", "ss"), ("s0", "s", "zs"), ("s0", "t", "zt")) for c in named(inner(part(a), part(b)), n)]).first()
        tt, ts, ss, zs, zt = (_number(sums, n, wide) for n in ("tt", "ts", "ss", "zs", "zt"))
        omega = ts / tt if tt else 0.0
        left = max(0.0, float(np.real(ss) - abs(ts) ** 2 / np.real(tt))) if tt else float(np.real(ss))
        after = zs - omega * zt
        x = plus(part("x"), scaled(alpha, part("ph")), scaled(omega, part("sh")))
        r = plus(part("s"), scaled(-omega, part("t")))
        if left > limit and (not omega or abs(after) < 1e-14 * math.sqrt(size * left)):  # a new start from what is left
            state, rho = both.select("node", *named(x, "x"), *named(r, "r"), *named(r, "s0"), *named(r, "p")), left
        else:
            beta = (after / rho) * (alpha / omega) if left > limit else 0.0
            p = plus(r, scaled(beta, plus(part("p"), scaled(-omega, part("v")))))
            state, rho = both.select("node", *named(x, "x"), *named(r, "r"), *cols("s0"), *named(p, "p")), after
    solution = state.select("node", *[F.col(x).alias(y) for x, y in zip(cols("x"), cols("u"), strict=True)])
    return Solution(solution, step, math.sqrt(left / size) if size else 0.0)
