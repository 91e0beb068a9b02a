"""What the plans of joins and windows must not hold, so that their work grows with their input; results against plain versions."""

import numpy as np


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_interpolation_looks_ahead_by_running_frames(spark):
    from isobath.operators import profiles

    rng = np.random.default_rng(0)
    z = np.sort(rng.uniform(0, 100, 2000))
    v, at = rng.normal(size=2000), [-1.0, 0.0, float(z[7]), *map(float, rng.uniform(0, 100, 50)), 101.0]
    nodes = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(z, v, strict=True)], "k long, z double, v double")
    out = profiles.interpolate(nodes, spark.createDataFrame([(1, a) for a in at], "k long, z double"), "k", "z", "v")
    assert "unboundedfollowing" not in plan(out)
    got = dict(out.select("z", "v").collect())
    assert all(np.isclose(got[a], np.interp(a, z, v)) for a in at)


def test_near_sends_no_repeated_rows_by_the_driver(spark):
    from isobath.operators import fields

    cells = spark.range(60).selectExpr("id AS cell_id", "double(id % 5) AS x", "double(id div 5) AS y", "0e0 AS z", "double(id) AS v")
    out = fields.tiles(cells, 1.5, "v")
    assert "Broadcast" not in plan(out)
    at = [(i % 5, i // 5) for i in range(60)]
    for tile, members, mean in out.collect():
        inside = [j for j in range(60) if (at[j][0] - at[tile][0]) ** 2 + (at[j][1] - at[tile][1]) ** 2 <= 2.25]
        assert members == len(inside) and np.isclose(mean, np.mean(inside))


def test_points_far_from_all_cells_look_at_few(spark):
    """On a long column of cells: six halvings do, where six growing rings did not reach the cells."""
    from isobath.operators import search

    cells = spark.range(4000).selectExpr("id AS cell_id", "double(id % 4) AS x", "0e0 AS y", "-double(id div 4) AS z")
    points = spark.range(300).selectExpr("id AS obs_id", "double(id % 4) AS x", "1e3 + 1e2 * id AS y", "-double(id) AS z")
    out = search.nearest(points, cells, 2, most=6)
    rows = out.collect()
    assert len(rows) == 600
    got = {(r.obs_id, r["rank"]): (r.cell_id, r.distance) for r in rows}
    xyz = np.array([(i % 4, 0, -(i // 4)) for i in range(4000)], float)
    for i in range(300):
        s = ((xyz - (i % 4, 1e3 + 1e2 * i, -i)) ** 2).sum(1)
        for rank, j in enumerate(sorted(range(4000), key=lambda j: (s[j], j))[:2], 1):
            assert got[i, rank][0] == j and np.isclose(got[i, rank][1], np.sqrt(s[j]))


def test_interval_sums_make_no_pairs(spark):
    import random

    from isobath.operators import search

    rng = random.Random(2)
    pts = [(k, float(rng.randrange(-40, 40)) / 2) for k in range(400)] + [(900, None), (None, 3.0)]
    bands = [(k, *sorted((rng.randrange(-50, 50) / 2, rng.randrange(-50, 50) / 2))) for k in range(150)] + [(200, 5.0, 5.0), (200, 5.0, 5.0), (201, 6.0, 2.0), (202, None, 1.0), (203, 1.0, None), (204, -99.0, -98.0), (205, -1e9, 1e9)]
    points, frame = spark.createDataFrame(pts, "p long, at double"), spark.createDataFrame(bands, "b long, low double, high double")
    want = []
    for b, lo, hi in bands:
        if None not in (lo, hi) and (inside := [(k or 0, x) for k, x in pts if x is not None and lo <= x <= hi]):
            want.append((b, len(inside), sum(k for k, _ in inside), min(x for _, x in inside)))
    out = search.interval_sums(points, frame, "at", "low", "high", ("p",))
    assert sorted(out.select("b", "n", "p", "first").collect()) == sorted(want)
    assert search.interval_sums(points.limit(0), frame, "at", "low", "high", ("p",)).collect() == []


def test_forward_meets_in_bounded_blocks(spark, monkeypatch):
    from isobath.functions import potential
    from isobath.operators import fields

    for name, value in (("STATIONS", 7), ("CELLS", 40), ("FEW_CELLS", 10)):
        monkeypatch.setattr(fields, name, value)
    rng = np.random.default_rng(1)
    s, c, m = rng.normal(size=(30, 3)) * 100, rng.normal(size=(200, 3)) * 100, rng.normal(size=200)
    stations = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(s)] + [(0, *map(float, s[0])), (99, None, 0.0, 0.0)], "obs_id long, x double, y double, z double")
    cells = spark.createDataFrame([(k, *map(float, x), 2.0, float(y) if k % 9 else None) for k, (x, y) in enumerate(zip(c, m, strict=True))] + [(900, None, 0.0, 0.0, 1.0, 1.0)], "cell_id long, x double, y double, z double, volume double, rho double")
    out = fields.forward(stations, cells, {"gz": (potential.gravity, "rho")}, "cells")
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    d = s[:, None] - c[None]
    want = (np.where(np.arange(200) % 9, m, 0.0) * potential.gravity([d[..., k] for k in range(3)], np.sqrt((d**2).sum(2)), 2.0)).sum(1)
    want[0], got = 2 * want[0], {r.obs_id: r for r in out.collect()}
    assert got.keys() == set(range(30)) and all(np.isclose(got[k].gz, want[k]) and got[k].cells == 200 * (2 if k == 0 else 1) for k in got)
    nothing = fields.forward(stations, cells.filter("rho IS NULL"), {"gz": (potential.gravity, "rho")}).collect()
    assert len(nothing) == 30 and all(r.gz is None for r in nothing)
    assert fields.forward(stations, cells.limit(0), {"gz": (potential.gravity, "rho")}).collect() == []


def test_smoothing_one_number_takes_no_matrices(monkeypatch):
    """Equal to the matrix form of two equal independent states, which has the same q and r; no solver is called."""
    from isobath.operators import inference

    y = np.cumsum(np.random.default_rng(4).normal(size=80)) + np.random.default_rng(5).normal(size=80)
    for most in (1, 5):
        both = inference.kalman_smooth(np.stack([y, y], 1), 0.9 * np.eye(2), most=most)
        with monkeypatch.context() as m:
            m.setattr(np.linalg, "solve", None)
            one = inference.kalman_smooth(y, np.array([[0.9]]), most=most)
        assert np.allclose(one[0][:, 0], both[0][:, 0]) and np.allclose(one[1][:, 0], both[1][:, 0])
        assert np.allclose(one[2:4], both[2:4]) and np.isclose(2 * one[4], both[4])
    assert [np.shape(x) for x in inference.kalman_smooth(np.array([3.0]), np.array([[0.9]]), most=1)[:2]] == [(1, 1), (1, 1)]
