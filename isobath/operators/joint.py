"""Joint fits: unknowns that several observations share, each seen through a solver.

An ``Observation`` says how unknowns become predicted data (a forward model, or a rate of change that is
integrated) and how data scatter about them. ``fit`` finds the posterior of all unknowns at once; ``fit_groups``
runs one such problem per group of a table, side by side. The models are numpy functions.

Unknowns are sought on an unbounded scale (logarithm of positive ones, logit of those in the unit interval),
where their prior is flat or Gaussian; means and deviations are carried back to first order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from types import SimpleNamespace
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from isobath.operators import inference, misfits, solvers
from isobath.operators.dynamics import Evolution, fixed_step, laplacian_matrix
from isobath.operators.inversion import shape_optimize

#: support: (to the natural scale, from it, slope of the first)
SCALES: dict[str, tuple[Callable, Callable, Callable]] = {
    "real": (lambda x: x, lambda v: v, np.ones_like),
    "positive": (np.exp, np.log, np.exp),
    "unit": (lambda x: 1 / (1 + np.exp(-x)), lambda v: np.log(v / (1 - v)), lambda x: np.exp(-x) / (1 + np.exp(-x)) ** 2),
}
MISFITS: dict[str, Callable[[np.ndarray, np.ndarray], float]] = {
    "l2": lambda p, o: float((p - o) @ (p - o)),
    "envelope": misfits.envelope_gap,
    "xcorr": lambda p, o: misfits.peak_shift(p, o) or 0.0,
    "w1": misfits.transport,
    "w2": misfits.transport,
}


class Toolbox(Protocol):
    """What a model may use besides numpy: grid operators, solves and integration."""

    def divergence_form(self, kappa, shape, spacing=1.0, pinned=None): ...
    def solve(self, rows, cols, vals, n: int, b) -> np.ndarray: ...
    def integrate(self, rhs, y0, grid, method: str = "rk4") -> np.ndarray: ...


class Forward(Protocol):
    def __call__(self, p: Values, ops: Toolbox) -> np.ndarray: ...


class Observe(Protocol):
    def __call__(self, solution: np.ndarray, p: Values, ops: Toolbox) -> np.ndarray: ...


class Slope(Protocol):
    def __call__(self, u: np.ndarray, t: float, p: Values, ops: Toolbox) -> np.ndarray: ...


def toolbox() -> Toolbox:
    """The tools by name; solve picks the band of its operator."""

    def solve(rows, cols, vals, n, b):
        return solvers.block_solve(rows, cols, vals, n, b, max(1, int(np.max(np.abs(np.asarray(rows) - np.asarray(cols))))))

    return SimpleNamespace(divergence_form=solvers.divergence_form, laplacian=laplacian_matrix, solve=solve, integrate=fixed_step)


class Values:
    """Unknowns by name, as the models see them."""

    def __init__(self, known: dict[str, Any]):
        self.__dict__.update(known)

    def __getattr__(self, name: str):
        raise AttributeError(f"no unknown is called {name!r}; declared: {', '.join(sorted(self.__dict__)) or 'none'}")


@dataclass(frozen=True, eq=False)
class Unknown:
    """A number or a vector to be found; start is on the natural scale, precision on the unbounded one."""

    name: str
    size: int = 1
    support: str = "real"
    start: Any = None
    precision: Any = None

    def __post_init__(self):
        if not self.name:
            raise ValueError("an unknown needs a name")
        if self.support not in SCALES:
            raise ValueError(f"support must be one of {', '.join(SCALES)}")
        if self.size < 1:
            raise ValueError("an unknown has a size of at least one")

    def centre(self) -> np.ndarray:
        if self.start is None:
            return np.zeros(self.size)
        return np.broadcast_to(SCALES[self.support][1](np.asarray(self.start, float)), (self.size,)).astype(float)

    def weight(self) -> np.ndarray:
        if self.precision is None:
            return np.zeros((self.size, self.size))
        given = np.asarray(self.precision, float)
        return given if given.ndim == 2 else np.diag(np.broadcast_to(given, (self.size,)))


def walk(name: str, size: int, step_sd: float, level_sd: float) -> Unknown:
    """A field on a line whose steps have a deviation, held near zero by a wide one."""
    d = np.diff(np.eye(size), axis=0)
    return Unknown(name, size, precision=d.T @ d / step_sd**2 + np.eye(size) / level_sd**2)


@dataclass(eq=False)
class Observation:
    """Data y of a model of unknowns.

    Either forward(p, ops) gives the solution, or rhs(u, t, p, ops) is integrated from y0 (a value, or y0(p, ops))
    over times; observe(solution, p, ops) picks what was seen. family is gaussian with a scale (a number, or a
    positive Unknown), for complex data too, or poisson. misfit (a name or a function of prediction and data)
    replaces the squared differences of a real gaussian, trace by trace where y is a gather.
    """

    y: Any
    unknowns: Sequence[Unknown] = ()
    forward: Forward | None = None
    rhs: Slope | None = None
    y0: Any = None
    times: Any = None
    method: str = "rk4"
    observe: Observe | None = None
    scale: float | Unknown = 1.0
    family: str = "gaussian"
    misfit: str | Callable | None = None
    ops: Toolbox = field(default_factory=toolbox)

    def __post_init__(self):
        self.y = np.asarray(self.y)
        if self.family not in ("gaussian", "poisson"):
            raise ValueError("family must be gaussian or poisson")
        if (self.forward is None) == (self.rhs is None):
            raise ValueError("an observation has either a forward model or a rate of change")
        if self.rhs is not None and (self.y0 is None or self.times is None):
            raise ValueError("a rate of change needs y0 and times")
        if self.misfit is not None and (self.family != "gaussian" or np.iscomplexobj(self.y)):
            raise ValueError("a misfit replaces the squares of real gaussian data")
        if isinstance(self.misfit, str) and self.misfit not in MISFITS:
            raise ValueError(f"unknown misfit {self.misfit!r}: one of {', '.join(MISFITS)}")
        if not all(isinstance(u, Unknown) for u in self.unknowns):
            raise TypeError("unknowns must be Unknown objects")
        if isinstance(self.scale, Unknown) and (self.scale.support != "positive" or self.scale.size != 1):
            raise ValueError("a scale is one positive unknown")

    def all_unknowns(self) -> list[Unknown]:
        return [*self.unknowns, *([self.scale] if isinstance(self.scale, Unknown) else [])]

    def predict(self, p: Values) -> np.ndarray:
        if self.forward is not None:
            solution = self.forward(p, self.ops)
        else:
            start = self.y0(p, self.ops) if callable(self.y0) else self.y0
            solution = self.ops.integrate(lambda t, u: self.rhs(u, t, p, self.ops), start, np.asarray(self.times, float), self.method)
        return np.asarray(solution if self.observe is None else self.observe(solution, p, self.ops))

    def deviation(self, p: Values) -> float:
        return float(getattr(p, self.scale.name)) if isinstance(self.scale, Unknown) else float(self.scale)

    @property
    def has_residuals(self) -> bool:
        return self.family == "gaussian" and self.misfit is None

    def residual(self, p: Values) -> np.ndarray:
        """Data minus prediction in deviations; real and imaginary parts in turn."""
        d = ((self.y - self.predict(p)) / self.deviation(p)).ravel()
        return np.concatenate([d.real, d.imag]) if np.iscomplexobj(d) else d

    def distance(self, pred: np.ndarray) -> float:
        measure = MISFITS[self.misfit] if isinstance(self.misfit, str) else self.misfit
        traces = lambda a: np.asarray(a, float).reshape(a.shape[0], -1) if a.ndim > 1 else np.asarray(a, float)[None]
        return float(sum(measure(p, o) for p, o in zip(traces(pred), traces(self.y), strict=True)))

    def log_likelihood(self, p: Values) -> float:
        if self.family == "poisson":
            rate = np.maximum(self.predict(p), 1e-12)
            return float(np.sum(self.y * np.log(rate) - rate))
        sd = self.deviation(p)
        if not 0 < sd < math.inf:
            return -math.inf
        if self.misfit is not None:
            squares = self.distance(self.predict(p)) / sd**2
        else:
            r = self.residual(p)
            squares = float(r @ r)
        each = 2 * math.log(sd) + math.log(math.pi) if np.iscomplexobj(self.y) else math.log(sd) + 0.5 * math.log(2 * math.pi)
        return -0.5 * squares - self.y.size * each


@dataclass
class Fit:
    """Unknowns found, with the covariance on the unbounded scale (none for a mode alone)."""

    unknowns: list[Unknown]
    x: np.ndarray
    cov: np.ndarray | None
    log_likelihood: float

    def posterior(self, name: str) -> tuple[np.ndarray, np.ndarray | None]:
        """Mean and deviation on the natural scale."""
        at = 0
        for u in self.unknowns:
            if u.name == name:
                part = slice(at, at + u.size)
                there, _, slope = SCALES[u.support]
                sd = None if self.cov is None else np.sqrt(np.maximum(np.diag(self.cov)[part], 0.0)) * np.abs(slope(self.x[part]))
                return there(self.x[part]), sd
            at += u.size
        raise KeyError(f"no unknown is called {name!r}; there are {', '.join(u.name for u in self.unknowns)}")


def _slopes(f: Callable[[np.ndarray], np.ndarray], x: np.ndarray, step: float) -> np.ndarray:
    """Central differences of f, a column per unknown."""
    moves = step * np.maximum(1.0, np.abs(x))
    return np.stack([(f(x + h * e) - f(x - h * e)) / (2 * h) for h, e in zip(moves, np.eye(len(x)), strict=True)], axis=-1)


def fit(observations: Sequence[Observation], how: str = "laplace", most: int = 100) -> Fit:
    """The posterior of all unknowns of the observations; equal names must be one and the same unknown.

    gauss_newton needs residuals and fixed scales, map gives the mode only, laplace the mode and its curvature
    (by Gauss-Newton where it can).
    """
    if how not in ("gauss_newton", "map", "laplace"):
        raise ValueError("how must be gauss_newton, map or laplace")
    named: dict[str, Unknown] = {}
    for u in (u for o in observations for u in o.all_unknowns()):
        if named.setdefault(u.name, u) is not u:
            raise ValueError(f"two unknowns are called {u.name!r}")
    if not named:
        raise ValueError("there is nothing to find: no observation has unknowns")
    unknowns = list(named.values())
    cuts = np.cumsum([0, *[u.size for u in unknowns]])
    centre, weight = np.concatenate([u.centre() for u in unknowns]), np.zeros((cuts[-1], cuts[-1]))
    for u, a, b in zip(unknowns, cuts[:-1], cuts[1:], strict=True):
        weight[a:b, a:b] = u.weight()

    def values(x):
        parts = {u.name: SCALES[u.support][0](x[a:b]) for u, a, b in zip(unknowns, cuts[:-1], cuts[1:], strict=True)}
        return Values({n: v if named[n].size > 1 else v[0] for n, v in parts.items()})

    def likelihood(x):
        p = values(x)
        return sum(o.log_likelihood(p) for o in observations)

    linear = all(o.has_residuals and not isinstance(o.scale, Unknown) for o in observations)
    if linear:
        def short(x):
            p = values(x)
            return -np.concatenate([o.residual(p) for o in observations])

        size, turn = np.linalg.eigh(weight)
        root = np.sqrt(np.maximum(size, 0.0))[:, None] * turn.T
        x, _ = inference.gauss_newton(lambda v: (short(v), _slopes(short, v, 1e-6)), np.zeros(len(short(centre))), centre, 1.0, 1.0, root, most=most, rtol=1e-13)
        j = _slopes(short, x, 1e-6)
        curvature = j.T @ j + weight
    elif how == "gauss_newton":
        raise ValueError("Gauss-Newton needs residuals: gaussian data, no misfit, fixed scales")
    else:
        def cost(v):
            """The search halves a step that leads to no number."""
            return -likelihood(v) + 0.5 * float((v - centre) @ weight @ (v - centre))

        slope = lambda v: _slopes(cost, v, 1e-6)
        with np.errstate(over="ignore", invalid="ignore"):
            x = shape_optimize(centre, lambda v: (cost(v), slope(v)), most=most)
        curvature = _slopes(lambda v: _slopes(cost, v, 1e-4), x, 1e-4) if how == "laplace" else None
    cov = None if how == "map" else np.linalg.inv(0.5 * (curvature + curvature.T))
    return Fit(unknowns, x, cov, likelihood(x))


def fit_groups(rows: DataFrame, key: str, build: Callable[[pd.DataFrame], Sequence[Observation]], how: str = "laplace", most: int = 100) -> DataFrame:
    """(key, unknown, k, mean, sd, loglik): one joint fit per group of rows; build(rows of a group) gives its observations.

    A group is held by one task, as its model is; groups run side by side.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = fit(build(pdf), how, most)
        out = []
        for u in found.unknowns:
            mean, sd = found.posterior(u.name)
            out += [(pdf[key].iloc[0], u.name, k, float(mean[k]), None if sd is None else float(sd[k]), found.log_likelihood) for k in range(u.size)]
        return pd.DataFrame(out, columns=[key, "unknown", "k", "mean", "sd", "loglik"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandas(run, f"`{key}` {kind}, unknown string, k long, mean double, sd double, loglik double")


@dataclass(frozen=True)
class StateSpace:
    """A linear evolution seen with noise, as a model of series."""

    operator: Evolution
    name: str | None = None

    def __post_init__(self):
        if not isinstance(self.operator, Evolution):
            raise TypeError("operator must be an Evolution")

    def fit(self, traces: DataFrame, dt: float = 1.0, h: np.ndarray | None = None, most: int = 100) -> DataFrame:
        return inference.fit_state_space(traces, self.operator, dt, h, most)

    def forecast(self, last: DataFrame, dt: float, steps: int) -> DataFrame:
        return inference.forecast(last, self.operator, dt, steps)
