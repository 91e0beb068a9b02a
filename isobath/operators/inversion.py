"""Fitting physical models: likelihoods as aggregations, and inversions built on Gauss-Newton.

Residuals and likelihoods are sums over long tables, so they aggregate where the data are. Inversions whose
model fits one machine run as kernels; many of them run side by side through ``dynamics.per_scenario``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobath.operators import waves
from isobath.operators.dynamics import Evolution, laplacian_matrix
from isobath.operators.inference import gauss_newton


def log_likelihood(rows: DataFrame, key: list[str], family: str = "gaussian", scale: float = 1.0) -> DataFrame:
    """Sum of log densities of y given pred per key; a Poisson rate is at least 1e-12 and log y! is left out.

    family is gaussian, complex (columns y_re, y_im, pred_re, pred_im) or poisson.
    """
    half = -0.5 * math.log(2 * math.pi) - math.log(scale)
    if family == "gaussian":
        d = (F.col("y") - F.col("pred")) / scale
        term = half - 0.5 * d * d
    elif family == "complex":
        a, b = ((F.col(f"y_{c}") - F.col(f"pred_{c}")) / scale for c in ("re", "im"))
        term = 2 * half - 0.5 * (a * a + b * b)
    elif family == "poisson":
        rate = F.greatest(F.col("pred"), F.lit(1e-12))
        term = F.col("y") * F.log(rate) - rate
    else:
        raise ValueError("family must be gaussian, complex or poisson")
    return rows.groupBy(*key).agg(F.sum(term).alias("loglik"))


def residuals(rows: DataFrame, scale: float = 1.0) -> DataFrame:
    return rows.withColumn("residual", (F.col("y") - F.col("pred")) / scale)


def fit_diffusivity(snapshots: np.ndarray, length: float = 1.0, bc: str = "neumann", scheme: str = "exact", dt: float = 1.0, low: float = 1e-4, high: float = 1e2) -> tuple[float, float]:
    """Diffusivity and noise of (T, n) snapshots: golden section over log D of the one-step residuals."""
    y = np.asarray(snapshots, float)
    g = laplacian_matrix(y.shape[1], length / (y.shape[1] - 1), bc)

    def cost(x):
        a = Evolution(math.exp(x) * g, scheme).transition(dt)
        return float(np.mean((y[1:] - y[:-1] @ a.T) ** 2))

    ratio, a, b = (math.sqrt(5) - 1) / 2, math.log(low), math.log(high)
    grid = np.linspace(a, b, 25)
    k = int(np.argmin([cost(x) for x in grid]))
    a, b = grid[max(k - 1, 0)], grid[min(k + 1, 24)]
    for _ in range(60):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if cost(c) < cost(d) else (c, b)
    x = 0.5 * (a + b)
    return math.exp(x), math.sqrt(cost(x))


def fit_parameters(snapshots: np.ndarray, transition: Callable[[np.ndarray, np.ndarray], np.ndarray], start, most: int = 60) -> tuple[np.ndarray, float]:
    """Positive parameters of y[t + 1] = transition(y[t], p), fitted in their logarithms."""
    y = np.asarray(snapshots, float)

    def forward(x):
        run = lambda v: np.concatenate([transition(row, np.exp(v)) for row in y[:-1]])
        f = run(x)
        return f, np.stack([(run(x + 1e-6 * e) - run(x - 1e-6 * e)) / 2e-6 for e in np.eye(len(x))], axis=1)

    x, _ = gauss_newton(forward, y[1:].ravel(), np.log(np.asarray(start, float)), 1.0, 1e-12, most=most, rtol=1e-10)
    return np.exp(x), float(np.sqrt(np.mean((forward(x)[0] - y[1:].ravel()) ** 2)))


def tomography(times, sources, receivers, shape, h: float = 1.0, start=None, noise: float = 1.0, beta: float = 1.0, most: int = 8, bounds=None) -> np.ndarray:
    """Slowness from first arrivals (source, receiver): rays through the eikonal field are the Jacobian."""
    times = np.asarray(times, float)
    d = np.array([[np.hypot(*(np.subtract(s, r))) * h for r in receivers] for s in sources])
    base = np.full(shape, float(np.sum(times) / np.sum(d))) if start is None else np.asarray(start, float)
    node = np.arange(base.size).reshape(shape)
    rough = []
    for axis in range(2):
        a, b = (np.take(node, range(k, shape[axis] - 1 + k), axis).ravel() for k in (0, 1))
        m = np.zeros((len(a), base.size))
        m[np.arange(len(a)), a], m[np.arange(len(a)), b] = -1 / h, 1 / h
        rough.append(m)

    def forward(x):
        s = x.reshape(shape)
        f, j = [], np.zeros((times.size, base.size))
        for k, source in enumerate(sources):
            t = waves.eikonal(s, source, h, 2)
            for n, r in enumerate(receivers):
                f.append(t[r])
                for c, length in waves.trace_ray(t, h, r, source).items():
                    j[k * len(receivers) + n, c] += length
        return np.array(f), j

    lo, hi = bounds or (1e-6, np.inf)
    return gauss_newton(forward, times.ravel(), base.ravel(), noise, beta, np.vstack(rough), lower=lo, upper=hi, most=most)[0].reshape(shape)


def cross_gradient_penalty(m1: np.ndarray, m2: np.ndarray, h: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """t = grad m1 x grad m2 on a plane, and its Jacobian by (m1, m2) flattened."""
    shape = m1.shape

    def matrix(axis):
        n = shape[axis]
        one = np.zeros((n, n))
        for i in range(1, n - 1):
            one[i, i + 1], one[i, i - 1] = 0.5 / h, -0.5 / h
        return np.kron(one, np.eye(shape[1])) if axis == 0 else np.kron(np.eye(shape[0]), one)

    dx, dy = matrix(0), matrix(1)
    a, b = m1.ravel(), m2.ravel()
    t = (dx @ a) * (dy @ b) - (dy @ a) * (dx @ b)
    j = np.hstack([(dy @ b)[:, None] * dx - (dx @ b)[:, None] * dy, (dx @ a)[:, None] * dy - (dy @ a)[:, None] * dx])
    return t, j


def joint_inversion(forwards, datas, starts, shape, noises, betas, weight: float = 0.0, h: float = 1.0, most: int = 10) -> list[np.ndarray]:
    """Two or more models whose gradients should align: one Gauss-Newton over all, pairs tied by cross gradients."""
    sizes = [np.size(s) for s in starts]
    cuts = np.cumsum([0, *sizes])
    ties = [(i, j) for i in range(len(starts)) for j in range(i + 1, len(starts))] if weight else []

    def forward(x):
        parts = [x[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        f, j = [], []
        for k, (run, part) in enumerate(zip(forwards, parts, strict=True)):
            value, jac = run(part)
            row = np.zeros((len(value), cuts[-1]))
            row[:, cuts[k] : cuts[k + 1]] = jac
            f.append(value)
            j.append(row)
        for a, b in ties:
            t, jac = cross_gradient_penalty(parts[a].reshape(shape), parts[b].reshape(shape), h)
            row = np.zeros((len(t), cuts[-1]))
            row[:, cuts[a] : cuts[a + 1]], row[:, cuts[b] : cuts[b + 1]] = jac[:, : sizes[a]], jac[:, sizes[a] :]
            f.append(t)
            j.append(row)
        return np.concatenate(f), np.vstack(j)

    data = np.concatenate([*[np.ravel(d) for d in datas], *[np.zeros(int(np.prod(shape))) for _ in ties]])
    noise = np.concatenate([*[np.full(np.size(d), s) for d, s in zip(datas, noises, strict=True)], *[np.full(int(np.prod(shape)), 1 / math.sqrt(weight)) for _ in ties]])
    rough = np.diag(np.concatenate([np.full(n, math.sqrt(b)) for n, b in zip(sizes, betas, strict=True)]))
    x, _ = gauss_newton(forward, data, np.concatenate([np.ravel(s) for s in starts]), noise, 1.0, rough, most=most)
    return [x[a:b].reshape(np.shape(s)) for a, b, s in zip(cuts[:-1], cuts[1:], starts, strict=True)]


def shape_optimize(phi0, objective: Callable[[np.ndarray], tuple[float, np.ndarray]], precision=None, most: int = 200, memory: int = 8) -> np.ndarray:
    """Level set that minimises objective(phi) -> (value, gradient) plus half phi P phi, by limited-memory BFGS."""
    x = np.ravel(np.asarray(phi0, float)).copy()

    def cost(v):
        value, grad = objective(v.reshape(np.shape(phi0)))
        pv = 0.0 if precision is None else precision @ v
        return float(value) + (0.5 * float(v @ pv) if precision is not None else 0.0), np.ravel(grad) + pv

    f, g = cost(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(most):
        q, coefs = g.copy(), []
        for s, y in reversed(past):
            coefs.append((s @ q) / (s @ y))
            q -= coefs[-1] * y
        if past:
            s, y = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(coefs), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        step = 1.0
        while step > 1e-12:
            trial = x - step * q
            f_new, g_new = cost(trial)
            if f_new <= f - 1e-4 * step * float(g @ q):
                break
            step /= 2
        else:
            break
        if (trial - x) @ (g_new - g) > 1e-14:
            past = [*past[-memory + 1 :], (trial - x, g_new - g)]
        done = f - f_new < 1e-12 * max(1.0, abs(f))
        x, f, g = trial, f_new, g_new
        if done:
            break
    return x.reshape(np.shape(phi0))


def soft_duct(z, height: float, m0: float = 350.0, gradient: float = 0.118, strength: float = 1.0, blend: float = 5.0) -> np.ndarray:
    """Modified refractivity that falls below a duct's height and rises above it, with a smooth turn."""
    above = 0.5 * (1 + np.tanh((np.asarray(z) - height) / blend))
    below = m0 - strength * np.asarray(z)
    return (1 - above) * below + above * (m0 - strength * height + gradient * (np.asarray(z) - height))


@dataclass(frozen=True)
class Propagation:
    """A range-marched scene: depths z, wave number, steps, source."""

    z: np.ndarray
    k0: float
    dr: float
    steps: int
    z_source: float
    absorb: np.ndarray | float = 1.0

    def loss(self, index) -> np.ndarray:
        psi = waves.parabolic(waves.starter(self.z, self.z_source, self.k0, 8.0 / self.k0), index, self.k0, self.z[1] - self.z[0], self.dr, self.steps, self.absorb)[-1]
        return -20 * np.log10(np.abs(psi) / math.sqrt(self.dr * self.steps) + 1e-30)


def fit_scene(observed, index_of: Callable[[float], np.ndarray], scene: Propagation, start: float, noise: float = 1.0, prior_sd: float = 50.0, most: int = 20, step: float = 1e-2) -> tuple[float, float]:
    """One environmental parameter (a duct's height, a sound-speed anomaly) from a received loss pattern, and its deviation."""
    def forward(x):
        run = lambda v: scene.loss(index_of(float(v)))
        return run(x[0]), ((run(x[0] + step) - run(x[0] - step)) / (2 * step))[:, None]

    x, sd = gauss_newton(forward, np.asarray(observed), [start], noise, 1.0 / prior_sd**2, most=most, rtol=1e-8)
    return float(x[0]), float(sd[0])


class JointField:
    """Density and susceptibility of cells under one Gaussian prior, read by gravity and magnetics."""

    def __init__(self, cells: np.ndarray, volume: float = 1e6, rho_sd: float = 200.0, kappa_sd: float = 0.05, correlation: float = 0.0):
        if not -1 < correlation < 1:
            raise ValueError("a correlation lies between -1 and 1")
        self.cells, self.volume, n = np.asarray(cells, float), volume, len(cells)
        both = np.array([[rho_sd**2, correlation * rho_sd * kappa_sd], [correlation * rho_sd * kappa_sd, kappa_sd**2]])
        self.mean, self.cov, self.n = np.zeros(2 * n), np.kron(both, np.eye(n)), n

    def _d(self, obs):
        d = np.asarray(obs, float)[:, None, :] - self.cells[None]
        return d, np.maximum(np.linalg.norm(d, axis=2), 1e-6)

    def gravity(self, obs, data, noise_sd: float):
        d, r = self._d(obs)
        h = 1e5 * 6.674e-11 * self.volume * d[:, :, 2] / r**3
        return np.hstack([h, 0 * h]), np.asarray(data, float), noise_sd**2

    def magnetic(self, obs, data, direction, noise_sd: float, field_nt: float = 50_000.0):
        d, r = self._d(obs)
        along = (d @ np.asarray(direction)) / r
        h = field_nt / (4 * math.pi) * self.volume * (3 * along**2 - 1) / r**3
        return np.hstack([0 * h, h]), np.asarray(data, float), noise_sd**2

    def reason(self, evidence) -> tuple[np.ndarray, np.ndarray]:
        """Posterior mean and deviations, first of density then of susceptibility."""
        h = np.vstack([e[0] for e in evidence])
        y = np.concatenate([e[1] for e in evidence])
        r = np.concatenate([np.full(len(e[1]), e[2]) for e in evidence])
        gain = np.linalg.solve(h @ self.cov @ h.T + np.diag(r), h @ self.cov).T
        return self.mean + gain @ (y - h @ self.mean), np.sqrt(np.maximum(np.diag(self.cov - gain @ h @ self.cov), 0.0))


def field_from_sensors(operator: Evolution, dt: float, steps: int, sensors: list[tuple[int, int, float, float]], x0_mean=0.0, x0_sd: float = 1.0, process_sd: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation (steps, n) of a field that evolves by an operator, given (cell, step, value, sd) readings.

    A Kalman filter forth and a smoother back; steps without a reading are only predicted.
    """
    a, n = operator.transition(dt), operator.n
    x, p = np.broadcast_to(np.asarray(x0_mean, float), (n,)).copy(), x0_sd**2 * np.eye(n)
    guess, done = [], []
    for t in range(steps):
        if t:
            x, p = a @ x, a @ p @ a.T + (process_sd**2 + 1e-12) * np.eye(n)
        guess.append((x, p))
        for cell, step, value, sd in sensors:
            if step == t:
                gain = p[:, cell] / (p[cell, cell] + sd**2)
                x, p = x + gain * (value - x[cell]), p - np.outer(gain, p[cell])
        done.append((x, p))
    smooth = [done[-1]]
    for t in range(steps - 2, -1, -1):
        j = np.linalg.solve(guess[t + 1][1] + 1e-12 * np.eye(n), a @ done[t][1]).T
        smooth.insert(0, (done[t][0] + j @ (smooth[0][0] - guess[t + 1][0]), done[t][1] + j @ (smooth[0][1] - guess[t + 1][1]) @ j.T))
    return np.array([m for m, _ in smooth]), np.sqrt(np.array([np.maximum(np.diag(c), 0.0) for _, c in smooth]))

