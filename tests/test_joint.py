import math

import numpy as np
import pandas as pd
import pytest

from isobath.operators import dynamics, fields, inference, joint, misfits


def test_field_through_a_diffusion_equals_the_linear_posterior():
    n, shape, seen = 15, (15,), [3, 7, 11]
    q = joint.walk("q", n, 0.5, 3.0)
    solve = lambda v, ops: ops.solve(*ops.divergence_form(np.ones(shape), shape, 0.2), n, v)
    a = np.stack([solve(e, joint.toolbox()) for e in np.eye(n)], axis=1)[seen]
    y = np.array([0.3, 0.8, 0.2])
    found = joint.fit([joint.Observation(y, [q], forward=lambda p, ops: solve(p.q, ops), observe=lambda u, p, ops: u[seen], scale=0.02)])
    cov = np.linalg.inv(a.T @ a / 0.02**2 + q.weight())
    mean, sd = found.posterior("q")
    assert np.allclose(mean, cov @ a.T @ y / 0.02**2, atol=1e-5) and np.allclose(sd, np.sqrt(np.diag(cov)), rtol=1e-5)


def test_poisson_rate_and_free_scale_have_known_curvatures():
    y = np.array([3, 5, 2, 6, 4])
    rate = joint.Unknown("rate", support="positive", start=1.0)
    mean, sd = joint.fit([joint.Observation(y, [rate], forward=lambda p, ops: p.rate * np.ones(5), family="poisson")]).posterior("rate")
    assert abs(mean[0] - 4) < 1e-4 and abs(sd[0] - 4 / math.sqrt(20)) < 1e-3
    z = np.array([1.0, 2.0, 4.0, 5.0])
    level, scale = joint.Unknown("level"), joint.Unknown("scale", support="positive", start=1.0)
    found = joint.fit([joint.Observation(z, [level], forward=lambda p, ops: p.level * np.ones(4), scale=scale)])
    assert abs(found.posterior("level")[0][0] - 3) < 1e-4 and abs(found.posterior("scale")[0][0] - z.std()) < 1e-4
    assert abs(found.posterior("level")[1][0] - z.std() / 2) < 1e-3


def test_complex_data_unit_unknowns_and_shared_unknowns():
    share = joint.Unknown("share", support="unit", start=0.5)
    wave = np.exp(1j * np.arange(6))
    both = [joint.Observation(0.3 * wave, [share], forward=lambda p, ops: p.share * wave, scale=0.1), joint.Observation([0.6], [share], forward=lambda p, ops: np.array([2 * p.share]), scale=0.1)]
    found = joint.fit(both, "gauss_newton")
    mean, sd = found.posterior("share")
    assert abs(mean[0] - 0.3) < 1e-6 and abs(sd[0] - 0.1 / math.sqrt(10)) < 1e-5
    assert abs(found.log_likelihood - (-6 * (2 * math.log(0.1) + math.log(math.pi)) - math.log(0.1) - 0.5 * math.log(2 * math.pi))) < 1e-6


@pytest.mark.parametrize("kind", ["l2", "envelope", "w2", "xcorr"])
def test_misfits_of_a_gather_find_the_delay(kind):
    t = np.arange(80) * 0.1
    pulse = lambda d: np.exp(-((t - 3 - d) ** 2))
    delay = joint.Unknown("delay", start=0.2)
    seen = np.stack([pulse(0.5), 2 * pulse(0.5)])
    one = joint.Observation(seen, [delay], forward=lambda p, ops: np.stack([pulse(p.delay), 2 * pulse(p.delay)]), misfit=kind, scale=0.1)
    found = joint.fit([one], "map")
    assert found.cov is None and abs(found.posterior("delay")[0][0] - 0.5) < 0.02
    with pytest.raises(ValueError):
        joint.fit([one], "gauss_newton")


def test_array_misfits_equal_table_misfits(spark):
    rng = np.random.default_rng(1)
    p, o = rng.normal(size=(2, 40))
    rows = spark.createDataFrame(pd.DataFrame({"pair": 1, "t": np.arange(40), "p": p, "o": o}))
    for kind in ("l2", "envelope", "xcorr", "w2"):
        assert abs(misfits.misfit(rows, kind).first().misfit - joint.MISFITS[kind](p, o)) < 1e-9


def test_what_does_not_fit_is_refused():
    u = joint.Unknown("u")
    model = lambda p, ops: np.array([p.v])
    with pytest.raises(AttributeError, match="declared: u"):
        joint.fit([joint.Observation([1.0], [u], forward=model)])
    for wrong in (dict(forward=model, rhs=model), dict(), dict(rhs=model), dict(forward=model, family="cauchy"), dict(forward=model, family="poisson", misfit="l2"), dict(forward=model, misfit="l3"), dict(forward=model, scale=u)):
        with pytest.raises(ValueError):
            joint.Observation([1.0], [u], **wrong)
    with pytest.raises(TypeError):
        joint.Observation([1.0], ["u"], forward=model)
    with pytest.raises(ValueError):
        joint.fit([joint.Observation([1.0], [], forward=lambda p, ops: np.ones(1))])
    with pytest.raises(ValueError):
        joint.fit([joint.Observation([1.0], [u, joint.Unknown("u")], forward=model)])
    with pytest.raises(ValueError):
        joint.Unknown("x", support="odd")
    with pytest.raises(KeyError):
        joint.fit([joint.Observation([1.0], [u], forward=lambda p, ops: np.array([p.u]))]).posterior("w")
    with pytest.raises(TypeError):
        joint.StateSpace("diffusion")


def test_state_space_front_end(spark):
    op = dynamics.diffusion(0.1, 4)
    rows = spark.createDataFrame([(1, t, [1.0 + 0.1 * t, 0.5, 0.2, 0.1]) for t in range(5)], "series long, t long, y array<double>")
    assert joint.StateSpace(op, "heat").fit(rows, 0.1, most=2).count() == 5


def test_coarse_tiles_read_means_with_their_weights(spark):
    cells = spark.createDataFrame([(i, float(i), 0.0, 0.0, float(i * i)) for i in range(6)], "cell_id long, x double, y double, z double, v double")
    keys = spark.createDataFrame([(1,), (1,), (4,)], "cell_id long")
    evidence, readings = fields.tile_readings(keys, cells, 1.5, "v")
    assert sorted((r.row, r.i, round(r.h, 6)) for r in evidence.collect()) == [(str(c), c + d, round(1 / 3, 6)) for c in (1, 4) for d in (-1, 0, 1)]
    assert sorted((r.row, round(r.y, 6)) for r in readings.collect()) == [("1", round(5 / 3, 6)), ("4", round(50 / 3, 6))]
    lam = {(r.i, r.j): r["lambda"] for r in inference.information(evidence).collect()}
    assert abs(lam[(0, 2)] - 1 / 9) < 1e-12 and (2, 3) not in lam
    with pytest.raises(ValueError):
        fields.tile_readings(keys, cells, 1.5, "v", "odd")
