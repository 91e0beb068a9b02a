"""Sparse systems on edge tables against dense solutions: not symmetric, complex, adjoint."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobath.operators import sparse


def system(spark, m, drift, shift=0j):
    rows = []
    for n in range(m * m):
        i, j = divmod(n, m)
        if i in (0, m - 1) or j in (0, m - 1):
            rows.append((n, n, 1.0, 0.0))
        else:
            rows += [(n, n, 4.0 - shift.real, -shift.imag), (n, n - m, -1.0 - drift, 0.0), (n, n + m, -1.0 + drift, 0.0), (n, n - 1, -1.0, 0.0), (n, n + 1, -0.5, 0.0), (n, n + 1, -0.5, 0.0)]
    dense = np.zeros((m * m, m * m), complex)
    for r, c, v, w in rows:
        dense[r, c] += v + 1j * w
    coo = spark.createDataFrame(rows, "r long, c long, v double, v_i double")
    f = np.random.default_rng(m).normal(size=m * m)
    rhs = spark.createDataFrame([(k, float(x)) for k, x in enumerate(f)], "node long, f double")
    field = spark.range(m * m).select(F.col("id").alias("node"), F.floor(F.col("id") / m).alias("i"), (F.col("id") % m).alias("j"))
    return coo if shift else coo.drop("v_i"), rhs, field, dense, f


@pytest.mark.parametrize(("m", "shift", "turned"), [(18, 0j, False), (9, 0.02 + 0.05j, True)])
def test_solutions_and_steps(spark, m, shift, turned):
    coo, rhs, field, dense, f = system(spark, m, 0.2, shift)
    tiles = sparse.grid_tiles(field, ["i", "j"], most=16)
    assert len(tiles) == (1 if m == 9 else 2)
    found = sparse.solve(coo, rhs, tiles, tolerance=1e-6, turned=turned)
    want = np.linalg.solve(dense.conj().T if turned else dense, f)
    got = np.zeros(m * m, complex)
    for r in found.table.collect():
        got[r.node] = complex(r.u, r.u_i) if shift else r.u
    assert np.abs(got - want).max() < 1e-4 * np.abs(want).max()
    assert found.steps <= 9 and found.residual <= 1e-6  # alike on both grids


def test_edges(spark):
    coo = spark.createDataFrame([(0, 0, 2.0), (1, 1, 4.0), (0, 1, 1.0)], "r long, c long, v double")
    found = sparse.solve(coo, spark.createDataFrame([(0, 3.0), (0, 1.0)], "node long, f double"))
    assert {r.node: round(r.u, 9) for r in found.table.collect()} == {0: 2.0, 1: 0.0}
    zero = sparse.solve(coo, spark.createDataFrame([], "node long, f double"))
    assert zero.steps == 0 and {r.u for r in zero.table.collect()} == {0.0}
    with pytest.raises(ValueError, match="without a diagonal"):
        sparse.solve(spark.createDataFrame([(0, 0, 2.0), (1, 0, 4.0)], "r long, c long, v double"), coo.select(F.col("r").alias("node"), F.col("v").alias("f")))
    with pytest.raises(ValueError, match="singular"):
        sparse.inverse(np.ones((2, 2)))
    a = np.random.default_rng(1).normal(size=(40, 40)) + 1j * np.eye(40)
    assert np.abs(sparse.inverse(a) @ a - np.eye(40)).max() < 1e-9
    hard, rhs, *_ = system(spark, 8, 0.0)
    with pytest.raises(ArithmeticError, match="1 steps leave"):
        sparse.solve(hard, rhs, most=1, most_coarse=1)


def strip(spark, width, length, complex_too, seed=5):
    """A strip with uneven entries, gaps in its numbers, repeated edges and edges to places that do not exist."""
    rng = np.random.default_rng(seed)
    ids = np.array([n + 1_000 * (n // 300) - 50 for n in range(width * length) if n % 97 != 5])
    known, rows = set(ids.tolist()), []
    for n in ids.tolist():
        rows += [(n, n, 3.0 + rng.random(), 0.5), (n, n, 1.0, 0.0)]
        rows += [(n, n + d, float(rng.normal() * 0.6), float(rng.normal() * 0.2)) for d in (-width, -1, 1, width) if rng.random() < 0.9]
    rows = [e for e in rows if e[1] in known or not complex_too]  # turned around, these would be rows without a diagonal
    dense = np.zeros((len(ids), len(ids)), complex)
    for r, c, v, w in rows:
        if c in known:
            dense[np.searchsorted(ids, r), np.searchsorted(ids, c)] += v + 1j * w * complex_too
    coo = spark.createDataFrame(rows, "r int, c int, v double, v_i double")
    f = rng.normal(size=len(ids))
    rhs = spark.createDataFrame([*zip(ids.tolist(), f.tolist()), (7_000_000, 5.0)], "node int, f double")
    return coo if complex_too else coo.drop("v_i"), rhs, ids, dense, f


@pytest.mark.parametrize(("complex_too", "turned"), [(False, False), (True, True)])
def test_strips_are_eliminated_by_blocks(spark, monkeypatch, complex_too, turned):
    from isobath.operators import fronts

    coo, rhs, ids, dense, f = strip(spark, 4, 200, complex_too)
    monkeypatch.setattr(sparse.Level, "__init__", lambda *a: pytest.fail("iterated"))
    found = sparse.solve(coo, rhs, tolerance=1e-12, turned=turned, most_coarse=10)  # blocks of 16 numbers, groups of 40
    want = np.linalg.solve(dense.conj().T if turned else dense, f)
    got = {r.node: complex(r.u, r.u_i) if complex_too else r.u for r in found.table.collect()}
    assert found.table.schema["node"].dataType.simpleString() == "int" and sorted(got) == ids.tolist()
    x = np.array([got[n] for n in ids.tolist()])
    assert np.abs(x - want).max() < 1e-10 * np.abs(want).max()
    left = f - (dense.conj().T if turned else dense) @ x
    assert found.steps <= 2 and np.isclose(found.residual, np.linalg.norm(left) / np.linalg.norm(f), rtol=0.5, atol=1e-15)
    # a pass that is not good enough is followed by another, or by an end
    rough = fronts._solved
    monkeypatch.setattr(fronts, "_solved", lambda a, b: rough(a, b) * (1 + 1e-6))
    again = sparse.solve(coo, rhs, tolerance=1e-12, turned=turned, most_coarse=10)
    assert again.steps >= 1 and again.residual <= 1e-12
    with pytest.raises(ArithmeticError, match="0 steps leave 1.0e"):
        sparse.solve(coo, rhs, most=0, turned=turned, most_coarse=10)


def test_wide_or_singular_blocks_are_iterated(spark):
    from isobath.operators import fronts
    from isobath.sources.storage import Store

    coo, rhs, ids, dense, f = strip(spark, 40, 15, False)
    store = Store(spark, "fronts")
    assert fronts.solve(store, coo, rhs, 1e-9, 10, front=60) is None  # a rim of 40 places or more
    assert fronts.solve(store, coo, rhs, 1e-9, 10, front=1_024) is not None
    # blocks of two numbers; 1 and 2 are coupled but singular without 0 and 3
    rows = [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 1e-300), (1, 2, 0.0), (2, 2, 1.0), (2, 3, 1.0), (3, 2, 1.0), (3, 3, 1.0)]
    assert fronts.solve(store, spark.createDataFrame(rows, "r long, c long, v double"), spark.createDataFrame([(k, 1.0) for k in range(4)], "node long, f double"), 1e-9, 10, front=4) is None
    words = spark.createDataFrame([("a", "a", 2.0), ("b", "b", 4.0), ("a", "b", 1.0)], "r string, c string, v double")
    found = sparse.solve(words, spark.createDataFrame([("a", 4.0)], "node string, f double"))
    assert {r.node: round(r.u, 9) for r in found.table.collect()} == {"a": 2.0, "b": 0.0}
    store.close()
