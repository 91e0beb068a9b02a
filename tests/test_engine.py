"""Every registered query against its SQL on the smallest tables; streams against batches; operator contracts."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobath.operators import fields, grids, inference, misfits, profiles, series
from isobath.operators.dynamics import Evolution
from isobath.plans import registry
from isobath.sources import environment
from isobath.streaming import kalman

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def normal(rows):
    return sorted(tuple(None if x is None or x != x else round(float(x), 6) if isinstance(x, float) else x for x in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    rows = [tuple(r[c] for c in sorted(got.columns)) for r in got.collect()]
    assert rows
    if name in registry.ORACLES:
        found = duck.execute(registry.ORACLES[name])
        order = sorted(range(len(found.description)), key=lambda i: found.description[i][0])
        assert sorted(got.columns) == [found.description[i][0] for i in order]
        want = normal(tuple(r[i] for i in order) for r in found.fetchall())
        assert str(normal(rows)) == str(want)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(s, t, float((s * 7 + t * t) % 13)) for s in range(3) for t in range(30)]
    schema = "series long, t long, y double"
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 10 == part], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = kalman.filter_stream(stream, 0.9, 1.0, 4.0).writeStream.format("memory").queryName("filtered").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = {(r.series, r.t): (r.mean, r.variance) for r in kalman.filter_batch(spark.createDataFrame(rows, schema), 0.9, 1.0, 4.0).collect()}
    got = {(r.series, r.t): (r.mean, r.variance) for r in spark.table("filtered").collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_smoothing_lowers_noise(spark):
    rng = np.random.default_rng(0)
    truth = np.sin(np.arange(60) / 8.0)
    noisy = truth + 0.3 * rng.normal(size=60)
    df = spark.createDataFrame([(1, t, [float(y)]) for t, y in enumerate(noisy)], "series long, t long, y array<double>")
    out = inference.fit_state_space(df, Evolution(np.array([[0.0]])), most=30).orderBy("t").collect()
    assert np.mean((np.array([r["mean"][0] for r in out]) - truth) ** 2) < 0.5 * np.mean((noisy - truth) ** 2)
    with pytest.raises(TypeError):
        inference.fit_state_space(df, "diffusion")
    ahead = inference.forecast(spark.createDataFrame([(1, [2.0])], "series long, mean array<double>"), Evolution(np.array([[-0.5]]), "exact"), 1.0, 2).orderBy("ahead").collect()
    assert np.allclose([r["mean"][0] for r in ahead], 2 * np.exp([-0.5, -1.0]))


def test_gauss_newton_and_fusion(spark):
    x = np.linspace(0, 1, 20)
    model = lambda v: (v[0] * np.exp(-v[1] * x), np.stack([np.exp(-v[1] * x), -v[0] * x * np.exp(-v[1] * x)], axis=1))
    got, sd = inference.gauss_newton(model, model([2.0, 1.5])[0], [1.0, 0.5], noise=0.01, beta=1e-9, most=40, rtol=1e-12)
    assert np.allclose(got, [2.0, 1.5], atol=1e-3) and np.all(sd > 0)
    evidence = spark.createDataFrame([("a", 0, 0, 1.0, 0.5), ("b", 0, 0, 1.0, 0.25), ("b", 0, 1, 1.0, 0.25)], "name string, row int, i int, h double, r double")
    readings = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 3.0)], "name string, row int, y double")
    lam, eta = np.zeros((2, 2)), np.zeros(2)
    for r in inference.information(evidence).collect():
        lam[r.i, r.j] = r["lambda"]
    for r in inference.information_vector(evidence, readings).collect():
        eta[r.i] = r.eta
    h = np.array([[1.0, 0.0], [1.0, 1.0]])
    w = np.diag([2.0, 4.0])
    mean, cov = inference.fuse(np.zeros(2), np.eye(2), lam, eta)
    assert np.allclose(cov, np.linalg.inv(np.eye(2) + h.T @ w @ h)) and np.allclose(mean, cov @ h.T @ w @ [1.0, 3.0])


def test_conjugate_gradient(spark, tmp_path):
    n = 12
    nodes = spark.range(n * n).select(F.col("id").alias("node"), F.floor(F.col("id") / n).alias("i"), (F.col("id") % n).alias("j"), F.lit(1.0).alias("k"))
    coo = grids.divergence_form(nodes, "node", "k", ["i", "j"])
    inner = coo.filter("r <> c").select("r").distinct()
    symmetric = coo.join(inner.select(F.col("r").alias("c")), "c", "left_semi").unionByName(coo.join(inner, "r", "left_anti"))
    rhs = nodes.join(inner.select(F.col("r").alias("node")), "node", "left").select("node", F.when((F.col("i") % (n - 1) != 0) & (F.col("j") % (n - 1) != 0), 1.0).otherwise(0.0).alias("f"))
    count = iter(range(10**6))

    def write(df):
        path = f"{tmp_path}/{next(count)}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    got = {r.node: r.u for r in grids.conjugate_gradient(symmetric.cache(), rhs, write, 1e-6, 40).collect()}
    from isobath.operators.solvers import poisson

    assert np.allclose([got[i] for i in range(n * n)], poisson((n, n), 1.0).ravel(), atol=1e-4)


def test_contracts(spark, tmp_path):
    pairs = spark.createDataFrame([(1, t, float(t), float(t)) for t in range(5)], "pair long, t long, p double, o double")
    with pytest.raises(ValueError):
        misfits.misfit(pairs, "l3")
    assert all(abs(misfits.misfit(pairs, k).first().misfit) < 1e-9 for k in ("l2", "w2", "envelope"))
    bad = spark.createDataFrame([(1, 0.0, 1.0), (1, 0.0, 2.0)], "key long, z double, v double")
    with pytest.raises(Exception, match="strictly ascending"):
        profiles.check_ascending(bad, "key", "z").collect()
    with pytest.raises(ValueError):
        series.summary(pairs, ["pair"], "p", "all")
    with pytest.raises(ImportError, match="extra 'netcdf'"):
        environment.read_table(spark, "/nowhere/x.nc", "lon double")
    cells = spark.createDataFrame([(i, float(i % 10), float(i // 10), 0.0) for i in range(100)], "cell_id long, x double, y double, z double")
    close = {(r.a, r.b) for r in fields.near(cells, cells, 1.5).collect()}
    assert sum(a == 44 for a, _ in close) == 9 and sum(a == 0 for a, _ in close) == 4
    x, y = environment.affine((2.0, 0.0, 10.0, 0.0, -2.0, 50.0))
    assert tuple(spark.createDataFrame([(3, 4)], "col int, row int").select(x, y).first()) == (16.0, 42.0)
    environment.write_table(cells, f"{tmp_path}/t", ["y"])
    assert environment.read_table(spark, f"{tmp_path}/t", "").count() == 100
