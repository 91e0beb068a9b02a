"""Far-field trees against direct sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobath.functions import potential
from isobath.operators import fields, tree

B = fields.direction(65.0, 10.0)
KERNELS = {
    "gz": (potential.gravity, "rho"),
    "txz": (lambda d, r, v: potential.gravity_gradient(d, r, v, "xz"), "rho"),
    "tmi": (lambda d, r, v: potential.magnetic_total(d, r, v, B), "kappa"),
}
LIMITS = {"gz": (1, 1e5 * potential.BIG_G), "txz": (2, potential.EOTVOS * potential.BIG_G), "tmi": (2, 50_000.0 / (4.0 * np.pi))}


def places(n, seed):
    """Cells evenly, and a quarter of them in a crowd of a fiftieth of the width."""
    rng = np.random.default_rng(seed)
    xyz = rng.uniform(0, 1000, (n, 3))
    xyz[: n // 4] = xyz[0] + 20 * rng.normal(size=(n // 4, 3))
    return xyz, rng.uniform(1, 3, n), rng.normal(size=n) + 1, rng.uniform(0, 0.01, n)


def tables(spark, n, m, seed=1):
    xyz, volume, rho, kappa = places(n, seed)
    cells = spark.createDataFrame([(k, *map(float, p), float(v), float(a), float(b)) for k, (p, v, a, b) in enumerate(zip(xyz, volume, rho, kappa, strict=True))], "cell_id long, x double, y double, z double, volume double, rho double, kappa double")
    rng = np.random.default_rng(seed + 100)
    spots = rng.uniform(-100, 1100, (m, 3))
    stations = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(spots)], "obs_id long, x double, y double, z double")
    return stations, cells


def by_id(df):
    return {r.obs_id: r.asDict() for r in df.collect()}


@pytest.mark.parametrize(("order", "theta", "least"), [(2, 0.5, 0.2), (3, 0.3, 0.02), (4, 0.5, 0.02)])
def test_errors_stay_within_their_bounds(spark, order, theta, least):
    stations, cells = tables(spark, 1500, 40)
    exact = by_id(fields.forward(stations, cells, KERNELS))
    near = by_id(tree.forward(stations, cells, KERNELS, theta, order, LIMITS))
    assert near.keys() == exact.keys()
    for name in KERNELS:
        error = np.array([abs(near[k][name] - exact[k][name]) for k in exact])
        bound = np.array([near[k][f"{name}_bound"] for k in exact])
        size = np.sqrt(np.mean([exact[k][name] ** 2 for k in exact]))
        assert (error <= bound + 1e-9 * size).all(), name
        assert bound.max() > 0 and 0 < error.max() < least * size, (name, error.max() / size)


def test_every_cell_serves_every_station_once(spark):
    """A kernel that is one everywhere counts the cells; condensed sources keep the sum."""
    stations, cells = tables(spark, 500, 30, 5)
    out = tree.forward(stations, cells.withColumn("one", 1.0 / F.col("volume")), {"n": (lambda d, r, v: v * F.lit(1.0), "one")}, order=2)
    assert all(abs(r.n - 500) < 1e-6 for r in out.collect()) and out.count() == 30


def test_pairs_grow_little_faster_than_places(spark):
    work = []
    for n in (500, 4000):
        stations, cells = tables(spark, n, n, 3)
        t = tree.interactions(stations, cells, ["rho"], order=2)
        met = t.lists.join(t.sources.withColumnRenamed("box", "s"), ["level", "s"]).join(t.stations.select("obs_id", "level", "t"), ["level", "t"])
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan
        work.append(met.count())
    assert work[1] < 0.3 * 4000 * 4000 and work[1] < 24 * work[0]  # the full product grows 64 times


def test_nulls_ties_and_empty_tables(spark):
    schema = "cell_id long, x double, y double, z double, volume double, rho double, s string"
    rows = [(k, 5.0, 5.0, -5.0, 2.0, 1.0, None) for k in range(300)]  # one place, many cells
    rows += [(None, 1.0, 2.0, 3.0, 1.0, 1.0, "a"), (1, None, 2.0, 3.0, 1.0, 1.0, "a"), (2, 1.0, 2.0, 4.0, None, 1.0, "a"), (2, 1.0, 2.0, 4.0, 1.0, None, "a")]
    cells = spark.createDataFrame(rows, schema)
    stations = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 7), (1, 0.0, 0.0, 0.0, 7), (2, None, 0.0, 0.0, 7), (None, 9.0, 9.0, 9.0, 7), (3, 5.0, 5.0, -5.0, 7)], "obs_id long, x double, y double, z double, level int")
    gz = {"gz": (potential.gravity, "rho")}
    exact, near = (by_id(f(stations, cells, gz)) for f in (fields.forward, tree.forward))
    assert exact.keys() == {1, 3, None} and near.keys() == {1, 2, 3, None} and near[2]["gz"] is None
    assert all(np.isclose(near[k]["gz"], exact[k]["gz"], rtol=1e-9, atol=0) for k in (1, 3, None))
    assert [r.gz for r in tree.forward(stations.filter("obs_id = 3"), cells.limit(0), gz).collect()] == [None]
    assert tree.forward(stations.limit(0), cells, gz, limits={"gz": (1, 1.0)}).collect() == []
    one = tree.forward(stations.filter("obs_id = 3"), cells.filter("x = 5"), gz, limits={"gz": (1, 1.0)}).first()
    assert one.gz == 0 and one.gz_bound == 0
    with pytest.raises(ValueError, match="theta"):
        tree.forward(stations, cells, gz, theta=0.6)
    with pytest.raises(ValueError, match="no kernel"):
        tree.forward(stations, cells, gz, limits={"g": (1, 1.0)})
    with pytest.raises(ValueError, match="deepest"):
        tree.interactions(stations, cells, ["rho"], deepest=21)
