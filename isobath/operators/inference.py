"""Estimation: Kalman smoothing per series, least squares from aggregated normal equations, linear fusion."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobath.operators.dynamics import Evolution


def kalman_smooth(y: np.ndarray, a: np.ndarray, h: np.ndarray | None = None, most: int = 100, tol: float = 1e-6):
    """Smoothed means and variances, q, r and log-likelihood of x' = A x + q noise, y = H x + r noise (EM in q, r)."""
    y = np.atleast_2d(np.asarray(y, float).T).T
    steps, m = y.shape
    n = len(a)
    h = np.eye(n) if h is None else np.atleast_2d(h)
    if h.shape != (m, n):
        raise ValueError("H must have a row per observed value and a column per state")
    if n == m == 1:
        return _smooth_numbers(y[:, 0].tolist(), float(a[0][0]), float(h[0, 0]), max(float(np.var(y)), 1e-6), most, tol)
    eye, scale = np.eye(n), max(float(np.var(y)), 1e-6)
    start, cov, q, r, last = np.linalg.lstsq(h, y[0], rcond=None)[0], scale * np.eye(n), 0.1 * scale, 0.5 * scale, None
    for _ in range(most):
        guess, filtered, like = [], [], 0.0
        x, p = start, cov
        for t in range(steps):
            x, p = a @ x, a @ p @ a.T + q * eye
            guess.append((x, p))
            s = h @ p @ h.T + r * np.eye(m)
            gain, gap = np.linalg.solve(s, h @ p).T, y[t] - h @ x
            like -= 0.5 * (m * math.log(2 * math.pi) + np.linalg.slogdet(s)[1] + gap @ np.linalg.solve(s, gap))
            x, p = x + gain @ gap, (eye - gain @ h) @ p
            filtered.append((x, p))
        smooth, lag = [filtered[-1]], []
        for t in range(steps - 2, -1, -1):
            (xf, pf), (xp, pp), (xs, ps) = filtered[t], guess[t + 1], smooth[-1]
            j = np.linalg.solve(pp, a @ pf).T
            smooth.append((xf + j @ (xs - xp), pf + j @ (ps - pp) @ j.T))
            lag.append(j @ ps)
        smooth, lag = smooth[::-1], lag[::-1]
        spread = 0.0
        for t in range(1, steps):
            (x0, p0), (x1, p1) = smooth[t - 1], smooth[t]
            now, before, cross = p1 + np.outer(x1, x1), p0 + np.outer(x0, x0), lag[t - 1] + np.outer(x1, x0)
            spread += np.trace(now - a @ cross.T - cross @ a.T + a @ before @ a.T)
        error = sum(float((y[t] - h @ x) @ (y[t] - h @ x)) + np.trace(h @ p @ h.T) for t, (x, p) in enumerate(smooth))
        q, r = max(spread / (n * max(steps - 1, 1)), 1e-10), max(error / (m * steps), 1e-10)
        start, cov = smooth[0]
        if last is not None and abs(like - last) < tol:
            break
        last = like
    return np.array([x for x, _ in smooth]), np.array([np.diag(p) for _, p in smooth]), q, r, like


def _smooth_numbers(y: list[float], a: float, h: float, scale: float, most: int, tol: float):
    """kalman_smooth of one state seen as one value: the same steps on plain numbers instead of matrices of one entry."""
    steps, x, p, q, r, last = len(y), y[0] / h if h else 0.0, scale, 0.1 * scale, 0.5 * scale, None
    for _ in range(most):
        guess, filtered, like = [], [], 0.0
        for value in y:
            x, p = a * x, a * p * a + q
            guess.append((x, p))
            s, gap = h * p * h + r, value - h * x
            gain = h * p / s
            like -= 0.5 * (math.log(2 * math.pi) + math.log(s) + gap * gap / s)
            x, p = x + gain * gap, (1.0 - gain * h) * p
            filtered.append((x, p))
        xs, ps = filtered[-1]
        means, variances, spread = [xs], [ps], 0.0
        for (xf, pf), (xp, pp) in zip(filtered[-2::-1], guess[:0:-1], strict=True):
            j, x1, p1 = a * pf / pp, xs, ps
            xs, ps = xf + j * (x1 - xp), pf + j * (p1 - pp) * j
            spread += p1 + x1 * x1 - 2.0 * a * (j * p1 + x1 * xs) + a * (ps + xs * xs) * a
            means.append(xs)
            variances.append(ps)
        means, variances = means[::-1], variances[::-1]
        error = sum((v - h * m) * (v - h * m) + h * s * h for v, m, s in zip(y, means, variances, strict=True))
        q, r = max(spread / max(steps - 1, 1), 1e-10), max(error / steps, 1e-10)
        x, p = means[0], variances[0]
        if last is not None and abs(like - last) < tol:
            break
        last = like
    return np.array(means)[:, None], np.array(variances)[:, None], q, r, like


def fit_state_space(traces: DataFrame, operator: Evolution, dt: float = 1.0, h: np.ndarray | None = None, most: int = 100) -> DataFrame:
    """(series, t, y ARRAY) to smoothed means and variances per step with the series' q, r and log-likelihood."""
    if not isinstance(operator, Evolution):
        raise TypeError("operator must be an Evolution")
    a = operator.transition(dt)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        mean, var, q, r, like = kalman_smooth(np.stack(pdf["y"].to_numpy()), a, h, most)
        return pd.DataFrame({"series": pdf["series"], "t": pdf["t"], "mean": list(mean), "variance": list(var), "process_var": q, "observation_var": r, "loglik": like})

    return traces.groupBy("series").applyInPandas(run, "series long, t long, mean array<double>, variance array<double>, process_var double, observation_var double, loglik double")


def forecast(last: DataFrame, operator: Evolution, dt: float, steps: int) -> DataFrame:
    """(series, mean ARRAY) to its means 1 .. steps ahead."""
    a = operator.transition(dt)

    def run(batches):
        for pdf in batches:
            rows = []
            for s, u in zip(pdf["series"], pdf["mean"], strict=True):
                x = np.asarray(u)
                for k in range(1, steps + 1):
                    x = a @ x
                    rows.append((s, k, x.copy()))
            yield pd.DataFrame(rows, columns=["series", "ahead", "mean"])

    return last.select("series", "mean").mapInPandas(run, "series long, ahead int, mean array<double>")


def normal_equations(rows: DataFrame, key: list[str], columns: list[str], target: str, weight: str | None = None) -> DataFrame:
    """J^T W J and J^T W y per key as columns a_i_j and b_i; one pass with map-side sums."""
    w = F.col(weight) if weight else F.lit(1.0)
    sums = [F.sum(w * F.col(a) * F.col(b)).alias(f"a_{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if j >= i]
    return rows.groupBy(*key).agg(*sums, *[F.sum(w * F.col(a) * F.col(target)).alias(f"b_{i}") for i, a in enumerate(columns)], F.count("*").alias("n"))


def solve_two(sums: DataFrame, names: tuple[str, str]) -> DataFrame:
    """The solution of two unknowns from normal_equations."""
    det = F.col("a_0_0") * F.col("a_1_1") - F.col("a_0_1") * F.col("a_0_1")
    return sums.withColumn(names[0], (F.col("a_1_1") * F.col("b_0") - F.col("a_0_1") * F.col("b_1")) / det).withColumn(names[1], (F.col("a_0_0") * F.col("b_1") - F.col("a_0_1") * F.col("b_0")) / det)


def gauss_newton(forward, data, x0, noise=1.0, beta: float = 1.0, roughness=None, ref=None, lower=None, upper=None, most: int = 12, halvings: int = 25, rtol: float = 1e-4):
    """Model and its standard deviations of a regularised least-squares problem; forward(x) gives (f, J)."""
    x = np.asarray(x0, float).copy()
    ref = x.copy() if ref is None else np.asarray(ref, float)
    r = np.eye(len(x)) if roughness is None else np.asarray(roughness, float)
    w = 1.0 / np.broadcast_to(np.asarray(noise, float), np.shape(data)) ** 2
    clip = lambda v: np.clip(v, -np.inf if lower is None else lower, np.inf if upper is None else upper)

    def cost(v):
        f = forward(v)[0]
        d = r @ (v - ref)
        return 0.5 * float((f - data) @ (w * (f - data))) + 0.5 * beta * float(d @ d)

    best = cost(x)
    hessian = np.eye(len(x))
    for _ in range(most):
        f, j = forward(x)
        hessian = j.T @ (w[:, None] * j) + beta * r.T @ r
        step = np.linalg.solve(hessian, j.T @ (w * (data - f)) - beta * r.T @ (r @ (x - ref)))
        for k in range(halvings):
            trial = clip(x + step / 2.0**k)
            value = cost(trial)
            if value < best:
                break
        else:
            break
        done = best - value < rtol * abs(best)
        x, best = trial, value
        if done:
            break
    return x, np.sqrt(np.diag(np.linalg.inv(hessian)))


def information(evidence: DataFrame) -> DataFrame:
    """(i, j, lambda) of rows (name, row, i, h, r): sum over all evidence of h_i h_j / r, a join within a reading."""
    other = evidence.select("name", "row", F.col("i").alias("j"), F.col("h").alias("hj"))
    return evidence.join(other, ["name", "row"]).groupBy("i", "j").agg(F.sum(F.col("h") * F.col("hj") / F.col("r")).alias("lambda"))


def information_vector(evidence: DataFrame, readings: DataFrame) -> DataFrame:
    """(i, eta) = sum of h_i y / r."""
    return evidence.join(readings, ["name", "row"]).groupBy("i").agg(F.sum(F.col("h") * F.col("y") / F.col("r")).alias("eta"))


def fuse(mean: np.ndarray, cov: np.ndarray, lam: np.ndarray, eta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of a Gaussian prior and the summed information of its evidence."""
    posterior = np.linalg.inv(np.linalg.inv(cov) + lam)
    return posterior @ (np.linalg.solve(cov, mean) + eta), posterior


def pointwise(prior: DataFrame, evidence: DataFrame, readings: DataFrame) -> DataFrame:
    """(i, mean, variance) after evidence each reading of which sees one cell: sums per cell, no matrix."""
    seen = evidence.join(readings, ["name", "row"]).groupBy("i").agg(F.sum(F.col("h") * F.col("h") / F.col("r")).alias("lambda"), F.sum(F.col("h") * F.col("y") / F.col("r")).alias("eta"))
    variance = 1.0 / (1.0 / F.col("variance") + F.coalesce("lambda", F.lit(0.0)))
    return prior.join(seen, "i", "left").select("i", (variance * (F.col("mean") / F.col("variance") + F.coalesce("eta", F.lit(0.0)))).alias("mean"), variance.alias("variance"))
