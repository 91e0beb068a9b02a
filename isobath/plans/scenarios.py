"""Queries that run one kernel per parameter, and of sources and series.

A kernel's numbers are those of its discrete system, which SQL states in closed form (eigenvectors of the stencils,
Green's functions as sums of modes), by iteration, or step by step on a line of nodes.
"""

from __future__ import annotations

import math

import numpy as np

from isobath.functions import energy
from isobath.operators import dynamics, induction, inversion, series, solvers, waves
from isobath.plans.relational import rounded
from isobath.plans.views import view, view_sql
from isobath.sources import environment
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def scenario(name: str, columns: dict[str, int], kernel, sql: str) -> None:
    """kernel(p) returns the numbers named in columns (with their decimals); sql states them over k(p).

    p comes from the suppliers' balances; a kernel runs once for each value and its numbers join the stations.
    """

    def run(spark, sf_dir):
        scenes = view(spark, sf_dir, "scene")
        schema = ", ".join(["p double", *[f"{c} double" for c in columns]])
        made = dynamics.per_scenario(scenes.select("p").distinct(), lambda r: [(r["p"], *map(float, kernel(r["p"])))], schema)
        return scenes.join(made, "p").select("obs_id", *[(F.round(c, d) + 0.0).alias(c) for c, d in columns.items()])

    QUERIES[name] = run
    shown = ", ".join(f"round({c}, {d}) + 0e0 AS {c}" for c, d in columns.items())
    ORACLES[name] = f"WITH RECURSIVE scenes AS (SELECT * FROM {view_sql('scene')} v), k AS (SELECT DISTINCT p FROM scenes), {sql} SELECT obs_id, {shown} FROM scenes JOIN r USING (p)"


def _sine(n: int, dims: int) -> np.ndarray:
    x, out = np.sin(math.pi * np.linspace(0, 1, n)), np.ones(())
    for _ in range(dims):
        out = np.multiply.outer(out, x)
    return out


def _simple(*columns: str) -> str:
    return f"r AS (SELECT p, {', '.join(columns)} FROM k)"


#: Second differences of the lowest sine over n nodes, times -1: the SQL of their eigenvalue.
def _eigen(nodes: int, h: str, dims: int = 2) -> str:
    return f"({dims}e0 * (2e0 - 2e0 * cos(pi() / {nodes - 1}e0)) / ({h} * {h}))"


def _poisson(p):
    u = solvers.poisson((21, 21), (1 + p) * _sine(21, 2), p, 0.0, 0.05)
    return u[10, 10], u.sum()


_L = _eigen(21, "5e-2")
scenario("poisson_2d", {"middle": 8, "total": 6}, _poisson, _simple(f"(1 + p) / (p * {_L}) AS middle", f"(1 + p) / (p * {_L}) / power(tan(pi() / 40e0), 2) AS total"))


def _elasticity(p):
    """A displacement x (1 - x) y (1 - y) along x, which the differences represent exactly."""
    x = np.linspace(0, 1, 13)
    q, one = x * (1 - x), np.ones(13)
    force = 2 * p * ((1 + 2 * p) * np.outer(one, q) + p * np.outer(q, one)), -(1 + p) * p * np.outer(1 - 2 * x, 1 - 2 * x)
    u = solvers.elasticity((13, 13), force, 1.0, p, 1 / 12)
    return u[0][6, 6], u[0][3, 6], u[0].sum()


scenario("elasticity", {"middle": 8, "aside": 8, "total": 7}, _elasticity, _simple("p / 16e0 AS middle", "p * 3e0 / 64e0 AS aside", "p * power(143e0 / 72e0, 2) AS total"))


def _coupled(p):
    f = _sine(13, 2)
    u = solvers.coupled(f.shape, [f, 2 * p * f], [p, p], [[2.0, -1.0], [-1.0, 3.0]], 0.0, 0.1)
    return u[0][6, 6], u[1][6, 6]


scenario("coupled_pde", {"first": 8, "second": 8}, _coupled, f"m AS (SELECT p, p * {_eigen(13, '1e-1')} AS m FROM k), r AS (SELECT p, (m + 3 + 2 * p) / ((m + 2) * (m + 3) - 1) AS first, ((m + 2) * 2 * p + 1) / ((m + 2) * (m + 3) - 1) AS second FROM m)")


def _screened(p):
    charge, shape = {20: 0.01}, (41,)
    lin, one = (solvers.poisson_boltzmann(1.0, 4.0 * c, charge, shape, 0.1) for c in (p, 1.0))
    full = solvers.poisson_boltzmann(1.0, 4.0 * p, {1: 20.0}, (3,), 0.1, linear=False)
    return 1e3 * lin[20], 1e3 * lin[10], 1e6 * solvers.reaction_field_energy(lin, one, charge), full[1]


_green = lambda at, c: f"1e-3 * sinh({at} * acosh(1 + 2e-2 * {c})) * sinh(20 * acosh(1 + 2e-2 * {c})) / (sinh(acosh(1 + 2e-2 * {c})) * sinh(40 * acosh(1 + 2e-2 * {c})))"
_newton = lambda f, df, start="0e0", most=40: f"it(p, u, n) AS (SELECT p, {start}, 0 FROM k UNION ALL SELECT p, u - ({f}) / ({df}), n + 1 FROM it WHERE n < {most}), root AS (SELECT p, u FROM it WHERE n = {most})"
scenario(
    "screened_electrostatics", {"middle": 6, "quarter": 6, "energy": 6, "nonlinear": 8}, _screened,
    f"{_newton('2e2 * u + 4e0 * p * sinh(u) - 2e2', '2e2 + 4e0 * p * cosh(u)')}, r AS (SELECT p, 1e3 * {_green(20, 'p')} AS middle, 1e3 * {_green(10, 'p')} AS quarter, 1e6 * 5e-3 * ({_green(20, 'p')} - {_green(20, '1e0')}) AS energy, u AS nonlinear FROM root)",
)


def _ions(p):
    phi, c = solvers.ion_equilibrium([1, -1], [p, p], 3, 1.0, 1.0, 0.0, 1.0, 0.0)
    return phi[1], c[0][1], c[1][1]


scenario("ion_equilibrium", {"phi": 8, "cations": 8, "anions": 8}, _ions, f"{_newton('2e0 * u - 1e0 + 2e0 * p * sinh(u)', '2e0 + 2e0 * p * cosh(u)')}, r AS (SELECT p, u AS phi, p * exp(-u) AS cations, p * exp(u) AS anions FROM root)")


def _resistivity(p):
    shape, schedule = (7, 7, 7), [(171, None, 172, None), (171, 173, 170, 172)]
    pole, four = solvers.dc_resistivity(np.full(shape, math.log(p)), shape, schedule, log_data=False)
    return pole, four, solvers.geometric_factor(shape, schedule[1:])[0] * four


_modes3 = "f AS (SELECT i, 2e0 - 2e0 * cos(pi() * i / 6e0) AS l, sin(pi() * i / 2e0) AS s3, sin(pi() * i / 3e0) AS s2, sin(pi() * i * 2e0 / 3e0) AS s4, sin(pi() * i * 5e0 / 6e0) AS s5 FROM range(1, 6) t(i))"
scenario(
    "dc_resistivity", {"pole": 8, "quadrupole": 8, "apparent": 8}, _resistivity,
    f"{_modes3}, g AS (SELECT sum(a.s3 * a.s3 * b.s3 * b.s3 * c.s3 * c.s4 / (a.l + b.l + c.l)) / 27e0 AS pole, sum(a.s3 * a.s3 * b.s3 * b.s3 * (c.s3 - c.s5) * (c.s2 - c.s4) / (a.l + b.l + c.l)) / 27e0 AS four FROM f a, f b, f c), r AS (SELECT p, pole / p AS pole, four / p AS quadrupole, 1e0 / p AS apparent FROM k, g)",
)


def _polarisation(p):
    z = solvers.induced_polarisation(1.0, 0.3, 0.1 * p, 0.5, (7, 7), [(24, None, 25, None)], 3.0)[0]
    return z.real, z.imag


scenario(
    "induced_polarisation", {"re": 8, "im": 8}, _polarisation,
    f"{_modes3}, g AS (SELECT sum(a.s3 * a.s3 * b.s3 * b.s4 / (a.l + b.l)) / 9e0 AS one FROM f a, f b), b AS (SELECT p, sqrt(15e-2 * p) AS b FROM k), d AS (SELECT p, 1 - 3e-1 * (1 + b) / ((1 + b) * (1 + b) + b * b) AS sr, 3e-1 * b / ((1 + b) * (1 + b) + b * b) AS si FROM b), r AS (SELECT p, one * sr / (sr * sr + si * si) AS re, -one * si / (sr * sr + si * si) AS im FROM d, g)",
)


def _half_space(h: str) -> str:
    """A uniform half-space's discrete field decays by one root a node."""
    return f"w AS (SELECT p, 2e2 * pi() * 4e-7 * pi() AS wm, 2e2 * pi() * 4e-7 * pi() * 5e-2 * p * {h} * {h} AS a FROM k), q AS (SELECT p, wm, sqrt(a * a * a * a / 16e0 + a * a) AS m, a FROM w), r AS (SELECT p, wm * {h} * {h} / m AS rho_a, degrees(atan2(sqrt((m - a * a / 4e0) / 2e0), sqrt((m + a * a / 4e0) / 2e0))) AS phase FROM q)"


def _mt(p):
    rho, phase = solvers.mt_2d(np.full((40, 7), 0.05 * p), (40, 7), 100.0, 20.0)
    return rho[3], phase[3]


scenario("mt_2d", {"rho_a": 6, "phase": 6}, _mt, _half_space("2e1"))
scenario("mt_3d", {"rho_a": 5, "phase": 5}, lambda p: induction.magnetotelluric(np.full((3, 3, 14), 0.05 * p), 100.0, 30.0), _half_space("3e1"))


def _modes(p):
    k, _ = solvers.normal_modes(np.full(100, 1500.0), 100.0, 40.0 + 20.0 * p, 1800.0, 1000 / 1500)
    return k[0], k[1]


# modes are sines of n * angle between (m - 1/2) pi and m pi; the bottom's row decides by bisection
_k2 = "(w / 15e2) * (w / 15e2) - (2 - 2 * cos(x))"
_bottom = f"2 * (sin(99 * x) - sin(100 * x)) - 4e0 / 3e0 * sqrt({_k2} - (w / 18e2) * (w / 18e2)) * sin(100 * x) + (2 - 2 * cos(x)) * sin(100 * x)"
_at = lambda x: "(" + _bottom.replace("x)", f"{x})").replace("x ", f"{x} ") + ")"
scenario(
    "normal_modes", {"first": 8, "second": 8}, _modes,
    f"""b(p, w, m, lo, hi, n) AS (SELECT p, 2 * pi() * (40 + 20 * p), m, (m - 5e-1) * pi() / 100, m * pi() / 100, 0 FROM k, (VALUES (1), (2)) t(m)
UNION ALL SELECT p, w, m, CASE WHEN sign({_at('mid')}) = sign({_at('lo')}) THEN mid ELSE lo END, CASE WHEN sign({_at('mid')}) = sign({_at('lo')}) THEN hi ELSE mid END, n + 1 FROM (SELECT *, (lo + hi) / 2 AS mid FROM b WHERE n < 50) q),
r AS (SELECT p, max(CASE WHEN m = 1 THEN sqrt({_k2.replace('x)', 'lo)')}) END) AS first, max(CASE WHEN m = 2 THEN sqrt({_k2.replace('x)', 'lo)')}) END) AS second FROM b WHERE n = 50 GROUP BY p)""",
)


def _wavenumber(p):
    w = 20 * math.pi * p
    got = 1e4 * solvers.wavenumber_field(w, 1500.0, 300.0, 50.0, 5e-3, 400, 3.0)[0]
    point = 1e4 * solvers.sommerfeld(w / 1500, math.hypot(300, 50))
    return got.real, got.imag, point.real, point.imag


scenario(
    "wavenumber_integration", {"re": 6, "im": 6, "point_re": 6, "point_im": 6}, _wavenumber,
    """w AS (SELECT p, 20 * pi() * p / 1500 AS k0, 3 * (20 * pi() * p / 1500) / 400 AS dk, CAST(ceil(3995e-1 * (3 * (20 * pi() * p / 1500) / 400) * 300) AS BIGINT) + 40 AS nt FROM k),
j AS (SELECT p, k0, dk, i, (i + 5e-1) * dk AS kr, avg(cos((i + 5e-1) * dk * 300 * sin((t + 5e-1) * pi() / nt))) AS j0 FROM w, range(400) a(i), range(200) b(t) WHERE t < nt GROUP BY p, k0, dk, i),
g AS (SELECT *, k0 * k0 * (1 - 25e-6) - kr * kr AS u, 1e-2 * k0 * k0 AS v FROM j), m AS (SELECT *, sqrt(u * u + v * v) AS m FROM g), q AS (SELECT *, sqrt((m + u) / 2) AS gr, sqrt((m - u) / 2) AS gi FROM m),
e AS (SELECT p, k0, kr * dk * j0 * exp(-50 * gi) / (4 * pi() * m) AS c, gr, gi, cos(50 * gr) AS cs, sin(50 * gr) AS sn FROM q),
r AS (SELECT p, 1e4 * sum(c * (gi * cs - gr * sn)) AS re, 1e4 * sum(c * (gi * sn + gr * cs)) AS im, 1e4 * cos(k0 * sqrt(925e2)) / (4 * pi() * sqrt(925e2)) AS point_re, 1e4 * sin(k0 * sqrt(925e2)) / (4 * pi() * sqrt(925e2)) AS point_im FROM e GROUP BY p, k0)""",
)


def _rate(p):
    return solvers.rate_radial(p, 1.0, 50.0, 400), solvers.debye_factor(1.0, 50.0, lambda r: -p / r, 2001)


scenario(
    "encounter_rate", {"rate": 7, "factor": 8}, _rate,
    "a AS (SELECT p, 4 * pi() * p / sum((49e0 / 399e0) / power(1 + (i + 5e-1) * 49e0 / 399e0, 2)) AS rate FROM k, range(399) t(i) GROUP BY p), b AS (SELECT p, 1e0 / sum((49e0 / 2000e0) * CASE WHEN i IN (0, 2000) THEN 5e-1 ELSE 1e0 END * exp(-p / (1 + i * 49e0 / 2000e0)) / power(1 + i * 49e0 / 2000e0, 2)) AS factor FROM k, range(2001) t(i) GROUP BY p), r AS (SELECT * FROM a JOIN b USING (p))",
)


def _plates(p):
    return solvers.beam_static(np.full(101, p), 2.0, 3.0).max(), solvers.plate_static(p * _sine(31, 2), 1 / 30, 2.0)[15, 15]


scenario("beam_plate_static", {"beam": 9, "plate": 9}, _plates, _simple("p * 5 * 16 / (384 * 3) + 4e-4 * p * 4 / (96 * 3) AS beam", f"p / (2 * power({_eigen(31, '(1e0 / 30e0)')}, 2)) AS plate"))


def _guided(p):
    found = [(k, c) for f, k, c in solvers.guided_modes(1e6 * p, 0.002, 6300.0, 3200.0, 2700.0, 12) if f == "SH"]
    return len(found), sum(k for k, _ in found), min(c for _, c in found)


scenario(
    "guided_modes", {"modes": 0, "wavenumbers": 5, "slowest": 5}, _guided,
    "m AS (SELECT p, 2e6 * pi() * p AS w, power(2e6 * pi() * p / 3200, 2) - 6 / power(2e-3 / 12, 2) * (1 - cos(n * pi() / 12)) / (2 + cos(n * pi() / 12)) AS k2 FROM k, range(13) t(n)), r AS (SELECT p, CAST(count(*) AS DOUBLE) AS modes, sum(sqrt(k2)) AS wavenumbers, min(w / sqrt(k2)) AS slowest FROM m WHERE k2 > 0 AND w / sqrt(k2) <= 15000 GROUP BY p)",
)

# leapfrog of a mode that starts with two equal states: amplitude after n steps, by the angle a step turns
_swing = lambda n: f"(cos({n} * o) + (cos(o) - 1) / sin(o) * sin({n} * o))"
_angle = lambda s: f"o AS (SELECT p, acos(1 - ({s}) / 2) AS o FROM k)"


def _wave(p):
    mode = _sine(21, 2)
    now, before, _ = waves.wave(mode, mode, p * p, 0.05, 0.01, 30)
    return now[10, 10], before[10, 10]


scenario("wave_2d", {"now": 8, "before": 8}, _wave, f"{_angle(f'1e-4 * p * p * {_L}')}, r AS (SELECT p, {_swing(30)} AS now, {_swing(29)} AS before FROM o)")


def _wave3(p):
    mode = _sine(9, 3)
    return (waves.wave(mode, mode, p * p, 0.125, 0.02, 25)[0][4, 4, 4],)


scenario("wave_3d", {"now": 8}, _wave3, f"{_angle('4e-4 * p * p * ' + _eigen(9, '125e-3', 3))}, r AS (SELECT p, {_swing(25)} AS now FROM o)")


def _heat2(p):
    x = np.cos(math.pi * (np.arange(24) + 0.5) / 24)
    return waves.heat(np.multiply.outer(x, x), p, 1 / 24, 2e-4, 40)[0, 0], waves.stable_dt(p, 1 / 24, 2)


scenario("heat_2d", {"corner": 8, "limit_dt": 9}, _heat2, _simple("power(cos(pi() / 48e0), 2) * power(1 - 2e-4 * p * 2 * (2 - 2 * cos(pi() / 24e0)) * 576, 40) AS corner", "9e-1 / (576 * 4 * p) AS limit_dt"))

_rk = lambda z: f"(1 + ({z}) + ({z}) * ({z}) / 2 + ({z}) * ({z}) * ({z}) / 6 + ({z}) * ({z}) * ({z}) * ({z}) / 24)"


def _flow(p):
    x = np.arange(16) * 2 * math.pi / 16
    v = np.array([np.sin(x)[:, None] * np.cos(x), -np.cos(x)[:, None] * np.sin(x)])
    return (waves.kinetic_energy(waves.spectral_flow(v, 0.1 * p, 0.02, 20)),)


scenario("spectral_flow", {"energy": 7}, _flow, _simple(f"pi() * pi() * power({_rk('-4e-3 * p')}, 40) AS energy"))


def _buoyant(p):
    t = np.cos(np.arange(16) * 2 * math.pi / 16)[:, None] * np.ones(16)
    v, t = waves.spectral_flow(np.zeros((2, 16, 16)), 0.3 * p, 0.05, 20, temperature=t, kappa=0.2 * p, buoyancy=0.5)
    return v[1][0, 0], t[0, 0]


scenario("boussinesq_flow", {"rise": 8, "temperature": 8}, _buoyant, _simple(f"25e-3 * (power({_rk('-15e-3 * p')}, 20) - power({_rk('-1e-2 * p')}, 20)) / (-5e-3 * p) AS rise", f"power({_rk('-1e-2 * p')}, 20) AS temperature"))


def _vortex(p):
    w, psi = waves.vorticity_flow(_sine(21, 2), 0.05 * p, 0.05, 2e-3, 20)
    return w[10, 10], psi[10, 10]


scenario("vorticity_flow", {"vorticity": 8, "stream": 8}, _vortex, _simple(f"power(1 - 1e-4 * p * {_L}, 20) AS vorticity", f"power(1 - 1e-4 * p * {_L}, 20) / {_L} AS stream"))


def _quantum(p):
    psi = waves.schrodinger(p * np.exp(2j * np.arange(32) * 2 * math.pi / 32), p, 0.01, 50)
    return psi[3].real, psi[3].imag, waves.norm(psi)


scenario("schrodinger", {"re": 8, "im": 8, "norm": 8}, _quantum, _simple("p * cos(12 * pi() / 32 - 5e-1 * (2 + p)) AS re", "p * sin(12 * pi() / 32 - 5e-1 * (2 + p)) AS im", "2 * pi() * p * p AS norm"))

_side = "(2 * sqrt(14e-1) / 4e-1 * (power({u}, 1e0 / 7e0) - 1))", "(({u} - 1e-1 * p) * sqrt(2 / (24e-1 * 125e-3) / ({u} + 1e-1 * p / 6)))"
_jump = lambda u: f"({_side[0].format(u=u)} + {_side[1].format(u=u)})"
scenario(
    "riemann_star", {"rho": 8, "u": 8, "pressure": 8}, lambda p: waves.riemann((1.0, 0.0, 1.0), (0.125, 0.0, 0.1 * p), [0.5])[0],
    f"b(p, lo, hi, n) AS (SELECT p, 1e-12, 2e0, 0 FROM k UNION ALL SELECT p, CASE WHEN {_jump('mid')} < 0 THEN mid ELSE lo END, CASE WHEN {_jump('mid')} < 0 THEN hi ELSE mid END, n + 1 FROM (SELECT *, (lo + hi) / 2 AS mid FROM b WHERE n < 60) q), r AS (SELECT p, power(lo, 1 / 14e-1) AS rho, 5e-1 * ({_side[1].format(u='lo')} - {_side[0].format(u='lo')}) AS u, lo AS pressure FROM b WHERE n = 60)",
)


def _gas(p):
    out = waves.euler([1.0, 1.0, 0.125, 0.125], np.zeros(4), [1.0, 1.0, 0.1 * p, 0.1 * p], 0.1, 0.01)
    return out[0][1], out[1][1], out[2][1], out[0][2]


scenario(
    "euler_step", {"rho": 9, "u": 9, "pressure": 9, "rho_right": 9}, _gas,
    "s AS (SELECT p, greatest(sqrt(14e-1), sqrt(14e-1 * 1e-1 * p / 125e-3)) AS s FROM k), f AS (SELECT p, 5e-1 * s * 875e-3 AS f0, 5e-1 * (1 + 1e-1 * p) AS f1, 5e-1 * s * (1 - 1e-1 * p) / 4e-1 AS f2 FROM s), q AS (SELECT p, 1 - 1e-1 * f0 AS rho, 1e-1 * (1 - f1) AS m, 1 / 4e-1 - 1e-1 * f2 AS e, 125e-3 + 1e-1 * f0 AS rho_right FROM f), r AS (SELECT p, rho, m / rho AS u, 4e-1 * (e - 5e-1 * m * m / rho) AS pressure, rho_right FROM q)",
)


def _cavity(p):
    s = np.sin(math.pi * np.arange(10) / 9)
    e = np.zeros((3, 10, 10, 10))
    e[2] = p * (s[:, None] * s)[:, :, None] * np.ones(10)
    return (waves.maxwell(e, np.zeros_like(e), 0.1, 0.05, 20, mu=1 + p)[0][2][4, 4, 4],)


scenario("maxwell", {"field": 8}, _cavity, f"{_angle('25e-4 / (1 + p) * ' + _eigen(10, '1e-1'))}, r AS (SELECT p, p * {_swing(20)} * power(sin(4 * pi() / 9), 2) AS field FROM o)")


def _arrivals(p):
    t = waves.eikonal(np.full((13, 13), p), (3, 4), 1.0, 1)
    return t[3, 12], t[4, 5], t[5, 5], t[5, 6]


scenario(
    "eikonal", {"along": 8, "diagonal": 8, "knight": 8, "two": 8}, _arrivals,
    "a AS (SELECT p, 1 + sqrt(5e-1) AS d FROM k), b AS (SELECT p, d, 5e-1 * (d + 2 + sqrt(2 - (2 - d) * (2 - d))) AS q FROM a), r AS (SELECT p, 8 * p AS along, p * d AS diagonal, p * q AS knight, p * 5e-1 * (2 * q + sqrt(2e0)) AS two FROM b)",
)


def _parabolic(p):
    z, k0 = (np.arange(200) + 1) * 0.5, 0.6 * p
    out = waves.parabolic(np.sin(5 * math.pi / 100.5 * z), 1.0, k0, 0.5, 5.0, 20)[-1]
    return out[49].real, out[49].imag, waves.starter(z, 25.0, k0)[39]


scenario(
    "parabolic_march", {"re": 8, "im": 8, "start": 8}, _parabolic,
    "a AS (SELECT p, 6e-1 * p AS k0, 5 * pi() / 1005e-1 AS kz FROM k), r AS (SELECT p, sin(25 * kz) * cos(100 * (sqrt(k0 * k0 - kz * kz) - k0)) AS re, sin(25 * kz) * sin(100 * (sqrt(k0 * k0 - kz * kz) - k0)) AS im, (exp(-25 * k0 * k0 / 2) - exp(-2025 * k0 * k0 / 2)) * sqrt(k0) AS start FROM a)",
)


def _drops(p):
    x = np.arange(16) * 2 * math.pi / 16
    u, v = np.sin(x)[:, None] * np.cos(x), -np.cos(x)[:, None] * np.sin(x)
    out = waves.two_phase(np.ones((16, 16)), u, v, 2 * math.pi / 16, 0.02, 5, mu=(0.1 * p, 0.1 * p))
    return out[1][4, 0], waves.drop((32, 32), (16.0, 16.0), 8.0 * p, 1.0, 2.0)[16, 20], waves.film((3, 9), 4.0 * p, 1.0, 2.0)[1, 3]


scenario("two_phase", {"velocity": 8, "drop": 8, "film": 8}, _drops, _simple("power(1 - 2e-3 * p * 2 * (2 - 2 * cos(pi() / 8)) / power(pi() / 8, 2), 5) AS velocity", "tanh((8 * p - 4) / 2) AS drop", "tanh((4 * p - 3) / 2) AS film"))


def _line(fields: dict[str, str], steps: list[dict[str, str]], rounds: int, n: int) -> str:
    """A march along a line of nodes i = 0 .. n - 1: each step a pass of window expressions; {lag:x} and {lead:x} are neighbours."""
    w = "OVER (PARTITION BY p ORDER BY i)"
    sql = f"SELECT p, i, {', '.join(f'{v} AS {f}' for f, v in fields.items())} FROM k, range({n}) t(i)"
    for k in range(rounds):
        for step in steps:
            made = {}
            for f, e in step.items():
                for g in fields:
                    e = e.replace("{lag:" + g + "}", f"lag({g}) {w}").replace("{lead:" + g + "}", f"lead({g}) {w}")
                made[f] = e.replace("{k}", str(k))
            keep = [f for f in fields if f not in made]
            sql = f"SELECT p, i, {', '.join([*keep, *[f'{e} AS {f}' for f, e in made.items()]])} FROM ({sql}) z"
    return f"line AS ({sql})"


def _elastic(p):
    v, s, _ = waves.elastic((11, 1, 1), 4 * p, 4 * p, p, p, 2 * p, 1.0, 1.0, 0.1, 5, waves.moment_source((5, 0, 0), np.eye(3), np.ones(5), 0.1, 1.0))
    return v[0][4, 0, 0], v[0][6, 0, 0], s[0][5, 0, 0]


_back = lambda f: f"CASE WHEN i = 0 THEN 0e0 ELSE {f} - {{lag:{f}}} END"
_ahead = lambda f, n=11: f"CASE WHEN i = {n - 1} THEN 0e0 ELSE {{lead:{f}}} - {f} END"
scenario(
    "elastic_waves", {"behind": 9, "ahead": 9, "stress": 9}, _elastic,
    f"{_line({'v': '0e0', 's': '0e0'}, [{'s': f's + 4e-1 * p * ({_back(chr(118))}) - CASE WHEN i = 5 THEN 1e-1 ELSE 0e0 END'}, {'v': f'v + 1e-1 * ({_ahead(chr(115))})'}], 5, 11)}, r AS (SELECT p, max(CASE WHEN i = 4 THEN v END) AS behind, max(CASE WHEN i = 6 THEN v END) AS ahead, max(CASE WHEN i = 5 THEN s END) AS stress FROM line GROUP BY p)",
)


def _porous(p):
    def push(k, v, q, stress, pore):
        if k == 0:
            stress[5] += 1.0
            pore[4] += 0.5

    v, q, stress, pore = waves.biot(11, 1.0, 0.05, 4, 3.0 * p, 1.0, 0.6, 2.0, 2.0, 1.0, 3.0, 0.7, push)
    return v[4], q[5], stress[5], pore[5]


# det = 2 * 3 - 1 = 5; half the drag's factor = 0.5 * 0.05 * 0.7 * 2 / 5; wave modulus = 3 p + 4 / 3 + 0.72
scenario(
    "poroelastic", {"solid": 9, "relative": 9, "stress": 9, "pore": 9}, _porous,
    f"""{_line({'v': '0e0', 'q': '0e0', 'o': '0e0', 's': '0e0', 'f': '0e0'}, [
        {'o': 'q', 'q': f'(q * (1 - 7e-3) + 5e-2 * (-2 * ({_ahead("f")}) - ({_ahead("s")})) / 5) / (1 + 7e-3)'},
        {'v': f'v + (5e-2 * ({_ahead("s")}) - (q - o)) / 2'},
        {'s': f's + 5e-2 * ((3 * p + 4e0 / 3e0 + 72e-2) * ({_back("v")}) + 12e-1 * ({_back("q")})) + CASE WHEN {{k}} = 0 AND i = 5 THEN 1e0 ELSE 0e0 END', 'f': f'f - 1e-1 * (6e-1 * ({_back("v")}) + ({_back("q")})) + CASE WHEN {{k}} = 0 AND i = 4 THEN 5e-1 ELSE 0e0 END'},
    ], 4, 11)}, r AS (SELECT p, max(CASE WHEN i = 4 THEN v END) AS solid, max(CASE WHEN i = 5 THEN q END) AS relative, max(CASE WHEN i = 5 THEN s END) AS stress, max(CASE WHEN i = 5 THEN f END) AS pore FROM line GROUP BY p)""",
)


def _lossy(p):
    out = waves.viscoacoustic(11, 1.0, 1.0, 1.0, 0.2, 5, [0.1 * p], [2.0], 5, waves.ricker(np.arange(5) * 0.2, 1.0), 6)
    return out[3], out[4]


_pulse = "((1 - 2 * power(pi() * ({k} * 2e-1 - 1), 2)) * exp(-power(pi() * ({k} * 2e-1 - 1), 2)))"
scenario(
    "viscoacoustic", {"last": 9, "next_to_last": 9}, lambda p: _lossy(p)[::-1],
    f"""{_line({'v': '0e0', 'u': '0e0', 'm': '0e0', 'o': '0e0', 'd': '0e0', 'held': '0e0'}, [
        {'v': f'v - 2e-1 * ({_ahead("u")})'},
        {'d': _back('v'), 'o': 'm', 'm': f'(m * (1 - 2e-1) - 4e-2 * p * ({_back("v")})) / (1 + 2e-1)'},
        {'held': 'u', 'u': f'u - 2e-1 * (1 + 1e-1 * p) * d - 1e-1 * (o + m) + CASE WHEN i = 5 THEN 2e-1 * {_pulse} ELSE 0e0 END'},
    ], 5, 11)}, r AS (SELECT p, max(CASE WHEN i = 6 THEN u END) AS last, max(CASE WHEN i = 6 THEN held END) AS next_to_last FROM line GROUP BY p)""",
)


def _bending(p):
    x, mode = np.sin(math.pi * np.linspace(0, 1, 21)), _sine(11, 2)
    return waves.beam(x, x, p, 2.0, 0.05, 5e-4, 40)[0][10], waves.plate(mode, mode, p, 1.5, 0.1, 1e-3, 40)[0][5, 5], waves.plate_dt(p, 1.5, 0.1)


_b1 = _eigen(21, "5e-2", 1)
scenario(
    "bending_waves", {"beam": 8, "plate": 8, "limit_dt": 9}, _bending,
    f"b AS (SELECT p, acos(1 - 25e-8 * p / 2 * power({_b1}, 2) / 2) AS o FROM k), c AS (SELECT p, acos(1 - 1e-6 * p / 15e-1 * power({_eigen(11, '1e-1')}, 2) / 2) AS o FROM k), r AS (SELECT b.p, (SELECT {_swing(40)} FROM (SELECT b.o) x(o)) AS beam, (SELECT {_swing(40)} FROM (SELECT c.o) x(o)) AS plate, 1e-2 / (8 * sqrt(b.p / 15e-1)) AS limit_dt FROM b JOIN c ON b.p = c.p)",
)


def _helmholtz(p):
    u = solvers.helmholtz_pml(p, (21, 21), _sine(21, 2), 3.0, 0.05, width=5, strength=0.0)
    return (u[10, 10].real,)


scenario("helmholtz_field", {"middle": 8}, _helmholtz, _simple(f"1e0 / ({_L} - 9 * p) AS middle"))


def _tau(p):
    weights, wl = solvers.tau_fit(50.0 * p, 2.0, 8.0, 1, 3)
    return 1e3 * weights[0], wl[0]


scenario("tau_fit", {"weight": 7, "omega": 7}, _tau, "b AS (SELECT p, w * 2 / (4 + w * w) AS b FROM k, (VALUES (2e0), (4e0), (8e0)) t(w)), r AS (SELECT p, 1e3 * sum(b) / (50 * p) / sum(b * b) AS weight, 4 * pi() AS omega FROM b GROUP BY p)")


def _modal(p):
    field = solvers.modal_pressure(np.array([0.2 * p, 0.15 * p]), np.array([[0.1, 0.14], [0.12, -0.05]]), 1, [1000.0])[0, 0]
    return 1e4 * field.real, 1e4 * field.imag, solvers.transmission_loss(field)


scenario(
    "modal_field", {"re": 7, "im": 7, "loss": 6}, _modal,
    "m AS (SELECT p, k * p * 1000 AS x, a * b / sqrt(k * p * 1000) AS w FROM k q, (VALUES (2e-1, 1e-1, 14e-2), (15e-2, 12e-2, -5e-2)) t(k, a, b)), c AS (SELECT p, sum(w * cos(x + pi() / 4)) / sqrt(8 * pi()) AS re, sum(w * sin(x + pi() / 4)) / sqrt(8 * pi()) AS im FROM m GROUP BY p), r AS (SELECT p, 1e4 * re AS re, 1e4 * im AS im, -20 * log10(sqrt(re * re + im * im) * 4 * pi() + 1e-30) AS loss FROM c)",
)


def _fit(p):
    a = dynamics.diffusion(p, 16, scheme="exact").transition(0.02)
    y = [np.cos(math.pi * np.linspace(0, 1, 16))]
    for _ in range(10):
        y.append(a @ y[-1])
    return (inversion.fit_diffusivity(np.array(y), dt=0.02)[0],)


scenario("diffusivity_fit", {"diffusivity": 5}, _fit, _simple("p AS diffusivity"))


def _sensors(p):
    """One reading of the middle of three cells after one step."""
    op = dynamics.diffusion(0.15, 3, length=2.0, scheme="explicit")
    mean, dev = inversion.field_from_sensors(op, 0.5, 2, [(1, 1, p, 0.3)])
    return mean[1][1], mean[0][0], dev[1][1]


scenario("sensor_field", {"read": 7, "before": 7, "deviation": 7}, _sensors, "a AS (SELECT p, 2 * 75e-3 * 75e-3 + 85e-2 * 85e-2 AS v FROM k), r AS (SELECT p, v / (v + 9e-2) * p AS read, 75e-3 / (v + 9e-2) * p AS before, sqrt(v - v * v / (v + 9e-2)) AS deviation FROM a)")


def _flow3(p):
    x = np.arange(8) * 2 * math.pi / 8
    flat = np.array([np.sin(x)[:, None] * np.cos(x), -np.cos(x)[:, None] * np.sin(x), np.zeros((8, 8))])
    v, pressure = waves.flow_3d(np.repeat(flat[..., None], 8, axis=-1), 0.2 * p, 2 * math.pi / 8, 0.05, 6)
    return v[0][2, 0, 3], pressure[1, 2, 0] - pressure[0, 0, 0], np.abs(waves.divergence_3d(v, 2 * math.pi / 8)).sum() + v[1][0, 2, 5]


# the pressure's centred gradient is what advection leaves of the field before the last step
_f3 = "(1 - 1e-2 * p * 2 * (2 - 2 * cos(pi() / 4)) / power(pi() / 4, 2))"
scenario(
    "flow_3d", {"velocity": 8, "pressure": 8, "across": 8}, _flow3,
    _simple(f"power({_f3}, 6) AS velocity", f"power({_f3}, 10) * (sin(pi() / 4) / (pi() / 4)) / (sin(pi() / 2) / (pi() / 4)) / 2 * ((cos(pi() / 2) + cos(pi())) - 2) AS pressure", f"-power({_f3}, 6) AS across"),
)


def _box(p):
    return solvers.rate_box(p, 0.4, (7, 7, 7), 1.0), energy.debye_length([1.0, -2.0], [p, 0.5 * p], 2.0)


scenario(
    "absorbing_box", {"rate": 8, "screening": 8}, _box,
    f"{_modes3}, g AS (SELECT sum(power(a.s3 * b.s3 * c.s3, 2) / (a.l + b.l + c.l)) / 27e0 AS g FROM f a, f b, f c), r AS (SELECT p, p / g AS rate, sqrt(2 / (3 * p)) AS screening FROM k, g)",
)


def _fem(p):
    """Values a + x + p y on the rim of a skewed mesh: linear elements hold them inside."""
    n, rng = 6, np.random.default_rng(2)
    x, y = (c.ravel() / (n - 1) for c in np.meshgrid(range(n), range(n), indexing="ij"))
    inner = (x > 0) & (x < 1) & (y > 0) & (y < 1)
    x, y = x + inner * rng.uniform(-0.05, 0.05, n * n), y + inner * rng.uniform(-0.05, 0.05, n * n)
    quads = np.array([[i * n + j, (i + 1) * n + j, (i + 1) * n + j + 1, i * n + j + 1] for i in range(n - 1) for j in range(n - 1)])
    tri = np.concatenate([quads[:, [0, 1, 2]], quads[:, [0, 2, 3]]])
    u = solvers.fem_poisson(np.stack([x, y], axis=1), tri, 2.0, 0.0, {int(i): 0.3 + x[i] + p * y[i] for i in np.flatnonzero(~inner)})
    moved = u - x - p * y
    # one element patch: a unit square cut into four around its middle
    four = solvers.fem_poisson([[0, 0], [1, 0], [1, 1], [0, 1], [0.5, 0.5]], [[0, 1, 4], [1, 2, 4], [2, 3, 4], [3, 0, 4]], p, 3.0, dict.fromkeys(range(4), 0.0))
    return moved[14], moved.sum() + p, four[4]


# middle of the patch: the load is a third of the area, the stiffness 4 p
scenario("fem_poisson", {"level": 8, "total": 7, "middle": 8}, _fem, _simple("3e-1 AS level", "108e-1 + p AS total", "3e0 / 3e0 / (4 * p) AS middle"))


def _window(p):
    return solvers.mode_window(2 * math.pi * 50 * p, [1500.0, 1480.0, 1510.0], 1800.0)


scenario("mode_window", {"slow": 9, "fast": 9}, _window, _simple("1e2 * pi() * p / 1800 AS slow", "1e2 * pi() * p / 1480 AS fast"))


def _layered(p):
    w = 2 * math.pi * 20 * p
    g = solvers.layered_green(np.array([0.05 * p + 0.002j]), w, [(60.0, 1500.0, 1000.0), (40.0, 1500.0, 1000.0)], (1800.0, 1500.0), 30.0, 80.0)[0]
    h = solvers.layered_green(np.array([0.05 * p + 0.002j]), w, [(100.0, 1500.0, 1000.0)], (1800.0, 1500.0), 80.0, 30.0)[0]
    return g.real, g.imag, h.real, h.imag


#: Vertical wavenumbers of the water (gr, gi) and of the half-space (dr, di), which decays downwards.
_vertical = """a AS (SELECT p, power(2 * pi() * 20 * p / 1500, 2) - power(5e-2 * p, 2) + 4e-6 AS u, -2e-4 * p AS v, power(2 * pi() * 20 * p / 1800, 2) - power(5e-2 * p, 2) + 4e-6 AS u2 FROM k),
b AS (SELECT *, sqrt(u * u + v * v) AS m, sqrt(u2 * u2 + v * v) AS m2 FROM a),
c AS (SELECT p, sqrt((m + u) / 2) AS gr, sign(v) * sqrt((m - u) / 2) AS gi, -sqrt((m2 + u2) / 2) AS dr, sqrt((m2 - u2) / 2) AS di FROM b)"""


def _sin(d: str) -> tuple[str, str]:
    return f"(sin({d} * gr) * cosh({d} * gi))", f"(cos({d} * gr) * sinh({d} * gi))"


def _cos(d: str) -> tuple[str, str]:
    return f"(cos({d} * gr) * cosh({d} * gi))", f"(-sin({d} * gr) * sinh({d} * gi))"


def _times(a: tuple[str, str], b: tuple[str, str]) -> tuple[str, str]:
    return f"({a[0]} * {b[0]} - {a[1]} * {b[1]})", f"({a[0]} * {b[1]} + {a[1]} * {b[0]})"


def _minus(a: tuple[str, str], b: tuple[str, str]) -> tuple[str, str]:
    return f"({a[0]} - {b[0]})", f"({a[1]} - {b[1]})"


_gamma = ("gr", "gi")
_i_beta = ("(-2e0 / 3e0 * di)", "(2e0 / 3e0 * dr)")
# sin(g 30) (g cos(g 20) - i b sin(g 20)) / (g (g cos(g 100) - i b sin(g 100))), b the half-space's wavenumber by density
_top = _times(_sin("30"), _minus(_times(_gamma, _cos("20")), _times(_i_beta, _sin("20"))))
_low = _times(_gamma, _minus(_times(_gamma, _cos("100")), _times(_i_beta, _sin("100"))))
scenario(
    "layered_waveguide", {"re": 6, "im": 6, "swapped_re": 6, "swapped_im": 6}, _layered,
    f"{_vertical}, t AS (SELECT p, {_top[0]} AS tr, {_top[1]} AS ti, {_low[0]} AS lr, {_low[1]} AS li FROM c), r AS (SELECT p, (tr * lr + ti * li) / (lr * lr + li * li) AS re, (ti * lr - tr * li) / (lr * lr + li * li) AS im, (tr * lr + ti * li) / (lr * lr + li * li) AS swapped_re, (ti * lr - tr * li) / (lr * lr + li * li) AS swapped_im FROM t)",
)


def _raster(spark, sf_dir):
    r = view(spark, sf_dir, "cell").select((F.col("x") / 100.0).alias("lon"), (F.col("y") / 100.0).alias("lat"), F.col("z").alias("depth"), F.col("rho").alias("value"))
    return environment.raster_window(r, (3.0, 12.0), (2.0, 10.0)).groupBy("lon", "lat").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


QUERIES["raster_window"] = _raster
ORACLES["raster_window"] = f"SELECT x / 100e0 AS lon, y / 100e0 AS lat, CAST(count(*) AS BIGINT) AS n, round(avg(rho), 6) AS mean FROM {view_sql('cell')} v WHERE x / 100e0 BETWEEN 3 AND 12 AND y / 100e0 BETWEEN 2 AND 10 GROUP BY 1, 2"


def _nearest_profile(spark, sf_dir):
    r = view(spark, sf_dir, "cell").select("x", "y", (-F.col("z")).alias("depth"), "rho")
    return rounded(environment.profile_at(r, {"x": 733.0, "y": 690.0}, "depth"), 6, "rho")


QUERIES["nearest_profile"] = _nearest_profile
ORACLES["nearest_profile"] = f"WITH c AS (SELECT * FROM {view_sql('cell')} v) SELECT x, y, -z AS depth, round(rho, 6) AS rho FROM c WHERE x = (SELECT x FROM c ORDER BY abs(x - 733e0), x LIMIT 1) AND y = (SELECT y FROM c ORDER BY abs(y - 690e0), y LIMIT 1)"


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _sessions(spark, sf_dir):
    return series.sessions(_events(spark, sf_dir), "user_id", "ts", 3600 * 12).select("user_id", F.col("session").cast("long").alias("session"), "events")


QUERIES["event_sessions"] = _sessions
ORACLES["event_sessions"] = "SELECT user_id, CAST(session AS BIGINT) AS session, CAST(count(*) AS BIGINT) AS events FROM (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM (SELECT *, CASE WHEN floor(epoch(ts)) - lag(floor(epoch(ts))) OVER (PARTITION BY user_id ORDER BY ts) > 43200 THEN 1 ELSE 0 END AS cut FROM events) a) b GROUP BY user_id, session"


def _asof(spark, sf_dir):
    """The last clearly larger reading at or before each reading."""
    e = _events(spark, sf_dir).select("user_id", "ts", "value")
    high = e.filter("value > 400")
    return rounded(series.asof(e, high, "user_id", "ts", "value"), 6, "value", "asof_value").drop("ts").groupBy("user_id").agg(F.count("asof_value").alias("known"), F.round(F.sum("asof_value"), 4).alias("total"))


QUERIES["asof_join"] = _asof
ORACLES["asof_join"] = "SELECT user_id, CAST(count(v) AS BIGINT) AS known, round(sum(v), 4) AS total FROM (SELECT user_id, last_value(CASE WHEN value > 400 THEN round(value, 6) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM events) q GROUP BY user_id"


def _cube(spark, sf_dir):
    made = rounded(series.summary(view(spark, sf_dir, "cell").select("i", "k", "rho"), ["i", "k"], "rho"), 4, "total", "mean")
    return made.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("i", "k")})


QUERIES["cube_summary"] = _cube
ORACLES["cube_summary"] = f"SELECT coalesce(i, -1) AS i, coalesce(k, -1) AS k, CAST(count(*) AS BIGINT) AS n, round(sum(rho), 4) AS total, round(avg(rho), 4) AS mean FROM {view_sql('cell')} v GROUP BY CUBE (i, k)"
