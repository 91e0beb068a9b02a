import math

import numpy as np
import pytest

from isobath.operators import dynamics as D
from isobath.operators import inversion as I
from isobath.operators import waves as W


def test_likelihoods(spark):
    rows = spark.createDataFrame([(1, 1.0, 0.5), (1, 2.0, 2.5), (2, 0.0, 3.0)], "k int, y double, pred double")
    got = {r.k: r.loglik for r in I.log_likelihood(rows, ["k"], "gaussian", 0.5).collect()}
    assert abs(got[1] - (2 * (-0.5 * math.log(2 * math.pi) - math.log(0.5)) - 1.0)) < 1e-12
    got = {r.k: r.loglik for r in I.log_likelihood(rows, ["k"], "poisson").collect()}
    assert abs(got[2] + 3.0) < 1e-12
    with pytest.raises(ValueError):
        I.log_likelihood(rows, ["k"], "cauchy")
    assert [r.residual for r in I.residuals(rows, 0.5).collect()] == [1.0, -1.0, -6.0]


def test_diffusivity_and_growth():
    rng = np.random.default_rng(0)
    x = np.linspace(0, 1, 24)
    for true in (0.5, 2.0):
        a = D.diffusion(true, 24, scheme="exact").transition(0.02)
        y = [np.cos(math.pi * x) + 0.5 * np.cos(2 * math.pi * x)]
        for _ in range(40):
            y.append(a @ y[-1])
        d, sd = I.fit_diffusivity(np.array(y) + 1e-3 * rng.normal(size=(41, 24)), dt=0.02)
        assert abs(d / true - 1) < 0.1 and sd < 0.01
    lap = D.laplacian_matrix(24, 1 / 23)
    step = lambda u, p: u + 0.0005 * (p[0] * lap @ u + p[1] * u * (1 - u))
    y = [0.2 + 0.1 * np.cos(math.pi * x)]
    for _ in range(60):
        y.append(step(y[-1], [0.4, 2.5]))
    p, _ = I.fit_parameters(np.array(y), step, [1.0, 1.0])
    assert np.allclose(p, [0.4, 2.5], rtol=0.05)


def test_tomography_finds_the_slow_block():
    true = np.full((12, 12), 0.1)
    true[4:8, 4:8] = 0.14
    sources, receivers = [(i, 0) for i in range(0, 12, 2)], [(i, 11) for i in range(0, 12, 2)]
    sources += [(0, j) for j in (3, 6, 9)]
    times = [[W.eikonal(true, s, 1.0, 2)[r] for r in receivers] for s in sources]
    got = I.tomography(times, sources, receivers, (12, 12), noise=0.02, beta=1.0, most=6, bounds=(0.05, 0.3))
    assert np.corrcoef(got.ravel(), true.ravel())[0, 1] > 0.6


def test_cross_gradients_tie_models():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(5, 6)), rng.normal(size=(5, 6))
    t, j = I.cross_gradient_penalty(a, b)
    for k in (7, 40):
        e = np.zeros(60)
        e[k] = 1e-6
        moved = I.cross_gradient_penalty(a + e[:30].reshape(5, 6), b + e[30:].reshape(5, 6))[0]
        assert np.allclose((moved - t) / 1e-6, j[:, k], atol=1e-4)
    assert np.allclose(I.cross_gradient_penalty(a, 2 * a + 1)[0], 0)
    true = np.zeros((6, 6))
    true[2:4, 2:4] = 1.0
    full, part = np.eye(36), rng.normal(size=(12, 36))
    run = lambda m: lambda x: (m @ x, m)
    datas = [full @ true.ravel(), part @ (2 * true).ravel()]
    free = I.joint_inversion([run(full), run(part)], datas, [np.zeros(36), np.zeros(36)], (6, 6), [0.01, 0.01], [1e-3, 1e-3])
    tied = I.joint_inversion([run(full), run(part)], datas, [np.zeros(36), np.full(36, 0.1)], (6, 6), [0.01, 0.01], [1e-3, 1e-3], weight=100.0, most=30)
    close = lambda m: np.corrcoef(m.ravel(), true.ravel())[0, 1]
    assert close(tied[1]) > close(free[1])


def test_shape_and_scene():
    goal = np.tanh(np.linspace(-2, 2, 30))
    got = I.shape_optimize(np.zeros(30), lambda v: (float(np.sum((np.tanh(v) - goal) ** 2)), 2 * (np.tanh(v) - goal) * (1 - np.tanh(v) ** 2)))
    assert np.allclose(np.tanh(got), goal, atol=1e-4)
    z = (np.arange(300) + 1) * 1.0
    duct = I.soft_duct(z, 40.0)
    assert np.all(np.diff(duct[:30]) < 0) and np.all(np.diff(duct[60:]) > 0)
    scene = I.Propagation(z, 2.0, 20.0, 60, 20.0, np.where(z > 220, np.exp(-(((z - 220) / 40) ** 2) * 0.2), 1.0))
    index = lambda h: 1 + 5e-6 * I.soft_duct(z, h)
    h, sd = I.fit_scene(scene.loss(index(42.0)), index, scene, 41.0)
    assert abs(h - 42.0) < 1.0 and sd > 0


def test_fusion_of_two_surveys():
    rng = np.random.default_rng(0)
    cells = np.array([[100.0 * i, 100.0 * j, -100.0] for i in range(6) for j in range(6)])
    obs = cells + [0, 0, 150.0]
    field = I.JointField(cells, 1e6, 300.0, 0.06, 0.7)
    rho, kappa = np.zeros(36), np.zeros(36)
    rho[14], kappa[14] = 600.0, 0.12
    down = np.array([0.0, 0.0, -1.0])
    gh, mh = field.gravity(obs, 0 * rho, 1.0)[0][:, :36], field.magnetic(obs, 0 * rho, down, 1.0)[0][:, 36:]
    g = field.gravity(obs, gh @ rho + 0.001 * rng.normal(size=36), 0.001)
    m = field.magnetic(obs, mh @ kappa + 0.1 * rng.normal(size=36), down, 0.1)
    mean, sd = field.reason([g, m])
    assert np.corrcoef(mean[:36], rho)[0, 1] > 0.5 and np.argmax(mean[36:]) == 14
    assert np.all(sd <= field.reason([g])[1] + 1e-12)
    with pytest.raises(ValueError):
        I.JointField(cells, correlation=1.5)


def test_field_from_sensors():
    n, steps, dt = 12, 8, 0.5
    op = D.diffusion(0.15, n, length=float(n - 1))
    truth = [np.sin(np.linspace(0, math.pi, n))]
    for _ in range(steps - 1):
        truth.append(op.transition(dt) @ truth[-1])
    truth = np.array(truth)
    sensors = [(c, t, truth[t, c], 0.02) for t in (0, 4) for c in (0, 2, 5, 8, 11)]
    mean, sd = I.field_from_sensors(op, dt, steps, sensors)
    assert mean.shape == (steps, n) and np.corrcoef(mean.ravel(), truth.ravel())[0, 1] > 0.9
    assert sd[0, 0] < sd[0, 1]
