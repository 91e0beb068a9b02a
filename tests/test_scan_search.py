"""Scans over long series against the recursion, and searches against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobath.operators import scan, search
from isobath.streaming.kalman import scalar_filter


def recursion(y, a, q, r):
    out, _ = scalar_filter(enumerate(y), None, a, q, r)
    m, p = np.array([x[1] for x in out]), np.array([x[2] for x in out])
    sm, sp = m.copy(), p.copy()
    for t in range(len(y) - 2, -1, -1):
        e = p[t] * a / (a * a * p[t] + q)
        sm[t] += e * (sm[t + 1] - a * m[t])
        sp[t] += e * e * (sp[t + 1] - (a * a * p[t] + q))
    return m, p, sm, sp


@pytest.mark.parametrize("chunk", [3, 50, 10_000])
def test_scan_equals_the_recursion(spark, chunk):
    rng = np.random.default_rng(chunk)
    series = {s: rng.normal(size=n) * 10 for s, n in enumerate([1, 2, 3, 7, 100, 301])}
    rows = [(s, t - 5, float(v)) for s, y in series.items() for t, v in enumerate(y)] + [(None, 1, 1.0), (2, None, 1.0), (4, 3000, None)]
    traces = spark.createDataFrame(rows, "series long, t long, y double").repartition(5)
    filtered = scan.kalman_filter(traces, 0.9, 2.0, 3.0, chunk)
    smooth = scan.kalman_smooth(filtered, 0.9, 2.0, chunk)
    for table, at in ((filtered, 0), (smooth, 2)):
        got = {}
        for r in table.collect():
            got.setdefault(r.series, {})[r.t + 5] = (r.mean, r.variance)
        assert got.keys() == series.keys()
        for s, y in series.items():
            want = recursion(y, 0.9, 2.0, 3.0)[at : at + 2]
            assert sorted(got[s]) == list(range(len(y)))
            assert np.allclose([got[s][t] for t in range(len(y))], np.array(want).T, rtol=1e-9, atol=1e-9)
    assert scan.kalman_filter(traces.limit(0)).collect() == []


def test_one_long_series_over_many_tasks(spark):
    n = 300_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("series"), F.col("id").alias("t"), F.sin(F.col("id") / 100.0).alias("y"))
    out = scan.kalman_filter(rows, 0.99, 0.1, 1.0, 10_000)
    last = {r.t: (r.mean, r.variance) for r in out.filter("t in (0, 9999, 10000, 150001, 299999)").collect()}
    m, p, *_ = recursion(np.sin(np.arange(n) / 100.0), 0.99, 0.1, 1.0)
    assert all(np.allclose(last[t], (m[t], p[t])) for t in (0, 9999, 10000, 150001, 299999))
    most = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < n


def test_interval_join_against_between(spark):
    rng = random.Random(1)
    ivals = [(k, *sorted((rng.uniform(-50, 50), rng.uniform(-50, 50)))) if k % 3 else (k, x := rng.uniform(-50, 50), x + rng.random() ** 6) for k in range(200)]
    ivals += [(900, 5.0, 5.0), (901, 6.0, 2.0), (902, None, 3.0), (903, 1.0, None), (904, -1e6, 1e6)]
    pts = [(k, rng.uniform(-60, 60)) for k in range(300)] + [(800, 5.0), (801, None), (802, 5.0)]
    points, bands = spark.createDataFrame(pts, "p long, at double"), spark.createDataFrame(ivals, "b long, low double, high double")
    want = sorted((p, b) for p, x in pts for b, lo, hi in ivals if None not in (x, lo, hi) and lo <= x <= hi)
    for salts in (1, 4):
        met = search.interval_join(points, bands, "at", "low", "high", salts=salts)
        assert sorted((r.p, r.b) for r in met.collect()) == want
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    keyed = search.interval_join(points.withColumn("k", F.col("p") % 3), bands.withColumn("k", F.col("b") % 3), "at", "low", "high", ["k"])
    assert sorted((r.p, r.b) for r in keyed.collect()) == [(p, b) for p, b in want if p % 3 == b % 3]
    assert search.interval_join(points, bands.limit(0), "at", "low", "high").collect() == []
    with pytest.raises(ValueError, match="both sides"):
        search.interval_join(points, bands.withColumnRenamed("b", "p"), "at", "low", "high")


@pytest.mark.parametrize(("k", "dims"), [(1, 3), (4, 2), (500, 2)])
def test_nearest_against_brute_force(spark, k, dims):
    rng = random.Random(k)
    cells = [(i, *(rng.randrange(20) for _ in range(dims))) for i in range(120)] + [(200 + i, *[7] * dims) for i in range(30)] + [(300, *[5000] * dims), (301, *[None] * dims)]
    points = [(i, *(rng.uniform(-5, 25) for _ in range(dims))) for i in range(40)] + [(90, *[-3000.5] * dims), (91, *[7] * dims), (92, *[None] * dims)]
    names = "xyz"[:dims]
    frame = lambda rows, i: spark.createDataFrame([tuple(None if x is None else float(x) if n else x for n, x in enumerate(r)) for r in rows], ", ".join([f"{i} long", *[f"{a} double" for a in names]]))
    out = search.nearest(frame(points, "obs_id"), frame(cells, "cell_id"), k, tuple(names))
    got = {}
    for r in out.collect():
        got.setdefault(r.obs_id, []).append((r["rank"], round(r.distance**2, 6), r.cell_id))
    for i, *p in points:
        if p[0] is None:
            assert i not in got
            continue
        want = sorted((sum((x - y) ** 2 for x, y in zip(p, c, strict=True)), j) for j, *c in cells if c[0] is not None)[:k]
        assert sorted(got[i]) == [(n, round(s, 6), j) for n, (s, j) in enumerate(want, 1)]
    assert search.nearest(frame(points, "obs_id"), frame(cells[:0] + [(1, *[None] * dims)], "cell_id"), k, tuple(names)).collect() == []


def test_electrodes_at_infinity_and_missing_ones(spark):
    from isobath.operators import electrodes

    places = {k: (10.0 * k, float(k % 3)) for k in range(8)}
    rows = [(1, 0, 1, 2, 3), (2, 0, None, 2, 3), (3, 0, None, 2, None), (4, 5, 4, 6, None), (5, None, None, 1, 2), (6, 0, 99, 2, 3), (7, 0, 1, 2, 3)]
    schedule = spark.createDataFrame(rows, "row long, a long, b long, m long, n long")
    table = spark.createDataFrame([(k, *p) for k, p in places.items()], "electrode long, x double, y double")
    poles = electrodes.pole_table(electrodes.pole_pairs(schedule), table, lambda r: 50.0 / (2 * np.pi * r))
    assert poles.count() == len({(s, r) for _, a, b, m, n in rows for s in (a, b) for r in (m, n)})
    got = {r["row"]: r for r in electrodes.measured(schedule, poles, 2.0).collect()}

    def v(i, j):
        return 0.0 if i is None or j is None else 2.0 * 50.0 / (2 * np.pi * np.hypot(places[i][0] - places[j][0], places[i][1] - places[j][1]))

    for k, a, b, m, n in rows:
        if 99 in (a, b, m, n):
            assert got[k].v is None and got[k].apparent is None
            continue
        want = v(a, m) - v(b, m) - v(a, n) + v(b, n)
        assert np.isclose(got[k].v, want) and (got[k].apparent is None if want == 0 else np.isclose(got[k].apparent, 50.0))
    assert "NestedLoop" not in electrodes.measured(schedule, poles)._jdf.queryExecution().executedPlan().toString()
