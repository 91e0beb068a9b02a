"""Sums over pairs by their displacements against the pairs themselves."""

import numpy as np

from isobath.functions import potential
from isobath.operators import fields
from isobath.operators.lattice import Lattice


def places():
    """Stations and cells on uneven grids with gaps and repeated places, in no order."""
    rng = np.random.default_rng(3)
    s = np.stack(np.meshgrid([0.0, 200.0, 500.0, 600.0], np.arange(60) * 200.0, [50.0, 80.0], indexing="ij"), -1).reshape(-1, 3)
    c = np.stack(np.meshgrid(np.arange(12) * 100.0, np.arange(8) * 200.0, -100.0 * np.arange(1, 14), indexing="ij"), -1).reshape(-1, 3)
    s, c = rng.permutation(s)[:450], rng.permutation(c)[:1200]
    return np.vstack([s, s[:5]]), np.vstack([c, c[:7]]), rng.normal(size=1207)


def direct(kernel, s, c, volume, mass):
    d = [s[:, a, None] - c[None, :, a] for a in range(3)]
    return kernel(d, potential.distance(d), volume) @ mass


def test_repeated_displacements_are_worked_out_once():
    s, c, mass = places()
    seen, counts = [], np.arange(len(c)) % 9 > 0
    b = fields.direction(60.0, 5.0)
    kernels = [lambda d, r, v, n=n: potential.gravity_gradient(d, r, v, n) for n in ("xx", "xy", "zz")]
    kernels += [lambda d, r, v, n=n: potential.magnetic_gradient(d, r, v, b, n) for n in ("xx", "yz")]
    kernels += [lambda d, r, v, n=n: potential.magnetic_vector(d, r, v, b, n) for n in "xz"]
    kernels.append(lambda d, r, v: potential.magnetic_total(d, r, v, b))

    def counting(d, r, v):
        seen.append(r.size)
        return potential.gravity(d, r, v)

    got = fields.block_sums(s, c, np.full(len(c), 2e6), [(k, mass, counts) for k in [*kernels, counting]])
    for k, found in zip([*kernels, potential.gravity], got, strict=True):
        assert np.allclose(found, direct(k, s, c, 2e6, np.where(counts, mass, 0.0)), rtol=1e-10, atol=1e-12)
    assert 0 < sum(seen) < len(s) * len(c) / 5


def test_places_without_a_grid_or_of_several_volumes_go_pair_by_pair():
    s, c, mass = places()
    volume = np.where(np.arange(len(c)) % 2, 1e6, 3e6)
    everything = np.ones(len(c), bool)
    (got,) = fields.block_sums(s, c, volume, [(potential.gravity, mass, everything)])
    assert np.allclose(got, direct(potential.gravity, s, c, volume, mass), rtol=1e-10)
    spread = s + np.random.default_rng(1).normal(size=s.shape)
    assert Lattice(spread, c).cheapest() is None
    (got,) = fields.block_sums(spread, c, np.full(len(c), 1e6), [(potential.gravity, mass, everything)])
    assert np.allclose(got, direct(potential.gravity, spread, c, 1e6, mass), rtol=1e-10)
    assert not Lattice(np.array([[np.inf, 0.0, 0.0]]), c).dense


def test_information_multiplies_layers_in_blocks(spark, monkeypatch):
    from isobath.operators import inference

    for name, value in (("LAYERS", 5), ("PANEL", 64), ("SLAB", 2), ("STATIONS", 100)):
        monkeypatch.setattr(fields, name, value)
    s, c, _ = places()
    s, c = s[:200], c[:400]
    rows = [(k % 190, *map(float, x)) for k, x in enumerate(s)] + [(None, 0.0, 0.0, 0.0), (500, None, 0.0, 0.0)]
    stations = spark.createDataFrame(rows, "obs_id long, x double, y double, z double")
    layer = (-c[:, 2] / 100).astype(int)
    for volume in (np.full(len(c), 1e6), 1e6 + np.arange(len(c))):
        cells = spark.createDataFrame([(*map(float, x), float(v) if k != 4 else None, int(k)) for x, v, k in zip(c, volume, layer, strict=True)] + [(None, 0.0, 0.0, 1.0, 3)], "x double, y double, z double, volume double, k long")
        out = fields.information(stations, cells, potential.gravity, "k", 0.01)
        text = out._jdf.queryExecution().toString()
        assert "NestedLoop" not in text and "Cartesian" not in text and "SortMergeJoin" not in text
        d = [s[:, a, None] - c[None, :, a] for a in range(3)]
        g = potential.gravity(d, potential.distance(d), volume)
        h = np.array([[g[np.arange(200) % 190 == o][:, layer == k].sum() for k in range(1, 14)] for o in range(190)])
        got = {(r.i, r.j): r["lambda"] for r in out.collect()}
        assert len(got) == out.count() == 169 and got.keys() == {(i, j) for i in range(1, 14) for j in range(1, 14)}
        for (i, j), v in got.items():
            assert v is None if 4 in (i, j) else np.isclose(v, h[:, i - 1] @ h[:, j - 1] / 0.01, rtol=1e-9)
        evidence = spark.createDataFrame([("g", o, k + 1, float(h[o, k]), 0.01) for o in range(190) for k in range(13)], "name string, row long, i long, h double, r double")
        assert all(np.isclose(r["lambda"], got[r.i, r.j], rtol=1e-9) for r in inference.information(evidence).collect() if 4 not in (r.i, r.j))
    assert fields.information(stations.limit(0), cells, potential.gravity, "k", 0.01).collect() == []
    assert fields.information(stations, cells.limit(0), potential.gravity, "k", 0.01).collect() == []


def test_information_holds_small_matrices_and_sends_no_sums(spark, monkeypatch):
    assert 8 * fields.LAYERS**2 <= 1 << 26
    monkeypatch.setattr(fields, "LAYERS", 2)
    s, c, _ = places()
    s, c = s[:60], c[:400]
    layer = (-c[:, 2] / 100).astype(int)
    stations = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(s)], "obs_id long, x double, y double, z double")
    cells = spark.createDataFrame([(*map(float, x), 1e6, int(k)) for x, k in zip(c, layer, strict=True)], "x double, y double, z double, volume double, k long")
    out = fields.information(stations, cells, potential.gravity, "k", 0.01)
    assert "FlatMapGroupsInArrow" not in out._jdf.queryExecution().toString()
    h = np.stack([direct(potential.gravity, s, c[layer == k], 1e6, np.ones((layer == k).sum())) for k in range(1, 14)], 1)
    got = {(r.i, r.j): r["lambda"] for r in out.collect()}
    assert len(got) == 169 and all(np.isclose(v, h[:, i - 1] @ h[:, j - 1] / 0.01, rtol=1e-9) for (i, j), v in got.items())


def test_information_of_many_layers_follows_from_that_of_few(spark, monkeypatch):
    from isobath.sources import storage

    for name, value in (("LAYERS", 150), ("PANEL", 128), ("SLAB", 16)):
        monkeypatch.setattr(fields, name, value)
    s = np.array([(200.0 * i, 200.0 * j, 50.0) for j in range(30) for i in range(10)])
    c = np.array([(100.0 * i, 200.0 * j, -100.0 * (k + 1)) for k in range(400) for j in range(3) for i in range(4)])
    layer = np.repeat(np.arange(400) * 7 - 20, 12)
    stations = spark.createDataFrame([(k % 290, *map(float, x)) for k, x in enumerate(s)], "obs_id long, x double, y double, z double")
    rows = [(*map(float, x), None if k == 1 else 1e6, int(k)) for x, k in zip(c, layer, strict=True)]
    products, looked = [], fields._products
    monkeypatch.setattr(fields, "_products", lambda s, c, *sizes: products.append(sizes[1]) or looked(s, c, *sizes))
    rng = np.random.default_rng(1)
    noisy = [(float(x), float(y), float(z), float(v), 0 if k < 300 else int(k)) for k, (x, y, z, v) in enumerate(np.c_[rng.normal(size=(700, 3)) * 2e3, rng.uniform(1e5, 1e6, 700)])]
    for cells, most in ((rows, 150), (noisy, None)):
        given = spark.createDataFrame(cells, "x double, y double, z double, volume double, k long")
        out = fields.information(stations, given, potential.gravity, "k", 0.01, storage.Store(spark, "layers")).toPandas()
        assert products.pop() <= (most or 401) and not products
        x, v, k = (np.array([r[n] if r[n] is not None else np.nan for r in cells], float) for n in (slice(0, 3), 3, 4))
        names = np.unique(k).astype(int)
        d = [s[:, a, None] - x[None, :, a] for a in range(3)]
        g = potential.gravity(d, potential.distance(d), v)
        h = np.stack([g[:, k == n].sum(1) for n in names], 1)
        h[:10] += h[290:]
        want = h[:290].T @ h[:290] / 0.01
        got = out.pivot(index="i", columns="j", values="lambda")
        assert len(out) == len(names) ** 2 and (got.index == names).all() and (got.columns == names).all()
        length = np.sqrt(np.diag(want))
        assert (np.isnan(got.to_numpy()) == np.isnan(want)).all() and np.isnan(want).sum() == (799 if most else 0)
        assert np.nanmax(np.abs(got.to_numpy() - want) / np.outer(length, length)) < 1e-12
    assert fields.information(stations.limit(0), given, potential.gravity, "k", 0.01, storage.Store(spark, "layers")).collect() == []


def test_skeleton_keeps_what_is_no_sum_of_others():
    from isobath.operators import skeleton

    rng = np.random.default_rng(2)
    few = rng.normal(size=(200, 5)) * [1e-9, 1.0, 1e3, 1e6, 1e9]
    m = np.c_[few, few @ rng.normal(size=(5, 90)), np.zeros(200)]
    r = skeleton.reduced(m)
    at, weights = skeleton.skeleton(r)
    length = np.maximum(np.linalg.norm(m, axis=0), 1.0)
    assert len(r) < 50 and len(at) == 5 and np.abs((m - m[:, at] @ weights) / length).max() < 1e-12
    assert skeleton.reduced(rng.normal(size=(200, 96))) is None and skeleton.reduced(np.full((200, 96), np.inf)) is None
    m[:, 7] += 1e-9 * length[7] * rng.normal(size=200)
    assert len(skeleton.skeleton(skeleton.reduced(m))[0]) == 6
