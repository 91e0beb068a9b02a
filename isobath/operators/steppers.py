"""Time stepping inside a row: a packed field is an array, a step is a transform over it, and the march is a fold.

All steps of a scenario run in one expression, without a shuffle per step; scenarios are the unit of
parallelism. A stencil is a function (u, i, n) -> new value, with ``at`` to reach the neighbours.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Stencil = Callable[[Column, Column, Column], Column]


def at(u: Column, i: Column, n: Column, bc: str) -> Column:
    """u[i] with the boundary rule for i outside: periodic, neumann (edge value) or dirichlet (0)."""
    if bc == "periodic":
        return F.get(u, F.pmod(i, n).cast("int"))
    if bc == "neumann":
        return F.get(u, F.greatest(F.least(i, n - 1), F.lit(0)).cast("int"))
    if bc == "dirichlet":
        return F.coalesce(F.get(u, i.cast("int")), F.lit(0.0))
    raise ValueError("bc must be periodic, neumann or dirichlet")


def let(body: Callable[[Column], Column], **values: Column) -> Column:
    """body(values as a struct), each value computed once: inside a lambda, repeated parts would be expanded."""
    return F.element_at(F.transform(F.array(F.struct(*[v.alias(n) for n, v in values.items()])), body), 1)


def march(fields: DataFrame, u: str, steps: int, stencil: Stencil) -> DataFrame:
    """fields with u after so many steps; a stencil may have ``prepare``, which each cell passes once a step."""
    prepare = getattr(stencil, "prepare", None)

    def step(acc, _):
        if prepare is None:
            return F.transform(acc, lambda _x, i: stencil(acc, i, F.size(acc)))
        return let(lambda s: F.transform(s["ready"], lambda _x, i: stencil(s["ready"], i, F.size(s["ready"]))), ready=F.transform(acc, prepare))

    return fields.withColumn(u, F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col(u), step))


def diffusion(ratio: float, bc: str = "neumann") -> Stencil:
    """Explicit heat flow; ratio = diffusivity * dt / dx^2, stable up to 0.5."""
    return lambda u, i, n: at(u, i, n, bc) + ratio * (at(u, i - 1, n, bc) - 2.0 * at(u, i, n, bc) + at(u, i + 1, n, bc))


def advection(courant: float, bc: str = "periodic") -> Stencil:
    """First-order upwind, by the sign of the Courant number."""
    if courant >= 0:
        return lambda u, i, n: at(u, i, n, bc) - courant * (at(u, i, n, bc) - at(u, i - 1, n, bc))
    return lambda u, i, n: at(u, i, n, bc) - courant * (at(u, i + 1, n, bc) - at(u, i, n, bc))


def advection_diffusion(courant: float, ratio: float, bc: str = "periodic") -> Stencil:
    move, spread = advection(courant, bc), diffusion(ratio, bc)
    return lambda u, i, n: move(u, i, n) + spread(u, i, n) - at(u, i, n, bc)


def burgers(nu: float, dx: float, dt: float, bc: str = "periodic") -> Stencil:
    """Conservative central differences of u_t + (u^2/2)_x = nu u_xx."""

    def step(u, i, n):
        left, here, right = at(u, i - 1, n, bc), at(u, i, n, bc), at(u, i + 1, n, bc)
        return here + dt * (nu * (left - 2.0 * here + right) / (dx * dx) - (right * right - left * left) / (4.0 * dx))

    return step


def kdv(dx: float, dt: float, nonlinearity: float = 6.0, dispersion: float = 1.0) -> Stencil:
    def step(u, i, n):
        far, left, here, right, far2 = (at(u, i + k, n, "periodic") for k in (-2, -1, 0, 1, 2))
        third = (far2 - 2.0 * right + 2.0 * left - far) / (2.0 * dx * dx * dx)
        return here - dt * (nonlinearity * here * (right - left) / (2.0 * dx) + dispersion * third)

    return step


def conservation_law(flux: Callable[[Column], Column], speed: Callable[[Column], Column], dx: float, dt: float, bc: str = "periodic") -> Stencil:
    """Rusanov's scheme; flux and speed are expressions of the value."""

    def face(a, b):
        return 0.5 * (flux(a) + flux(b)) - 0.5 * F.greatest(F.abs(speed(a)), F.abs(speed(b))) * (b - a)

    def step(u, i, n):
        left, here, right = at(u, i - 1, n, bc), at(u, i, n, bc), at(u, i + 1, n, bc)
        return here - dt / dx * (face(here, right) - face(left, here))

    return step


def shallow_water(dx: float, dt: float, gravity: float = 9.81) -> Stencil:
    """Rusanov's scheme for arrays of struct<h, q>, periodic."""

    def known(s):
        """h, q, velocity and signal speed of a cell."""
        h = F.greatest(s["h"], F.lit(1e-12))
        v = s["q"] / h
        return F.struct(s["h"].alias("h"), s["q"].alias("q"), (s["q"] * v + 0.5 * gravity * h * h).alias("p"), (F.abs(v) + F.sqrt(gravity * h)).alias("c"))

    def face(a, b):
        c = F.greatest(a["c"], b["c"])
        return 0.5 * (a["q"] + b["q"]) - 0.5 * c * (b["h"] - a["h"]), 0.5 * (a["p"] + b["p"]) - 0.5 * c * (b["q"] - a["q"])

    def step(u, i, n):
        cells = {name: F.get(u, F.pmod(i + k, n).cast("int")) for name, k in (("left", -1), ("here", 0), ("right", 1))}

        def advance(s):
            (m1, p1), (m0, p0) = face(s["here"], s["right"]), face(s["left"], s["here"])
            return F.struct((s["here"]["h"] - dt / dx * (m1 - m0)).alias("h"), (s["here"]["q"] - dt / dx * (p1 - p0)).alias("q"))

        return let(advance, **cells)

    step.prepare = known
    return step


def wave(courant2: float, damping: float = 0.0, bc: str = "dirichlet") -> Stencil:
    """Leapfrog for arrays of struct<u, w> (now, before); courant2 = (c dt / dx)^2, damping = gamma dt."""

    def step(u, i, n):
        now = F.get(u, i.cast("int"))
        if bc == "periodic":
            left, right = (F.get(u, F.pmod(i + k, n).cast("int"))["u"] for k in (-1, 1))
        else:
            left, right = (F.coalesce(F.get(u, (i + k).cast("int"))["u"], F.lit(0.0)) for k in (-1, 1))
        ahead = 2.0 * now["u"] - now["w"] + courant2 * (left - 2.0 * now["u"] + right) - damping * (now["u"] - now["w"])
        return F.struct(ahead.alias("u"), now["u"].alias("w"))

    return step


def black_scholes(sigma: float, rate: float, ds: float, dt: float) -> Stencil:
    """Explicit step backwards in time of an option's value on prices 0, ds, 2 ds, ..; no curvature at the far end."""

    def step(u, i, n):
        here, left, right = F.get(u, i.cast("int")), F.get(u, (i - 1).cast("int")), F.get(u, (i + 1).cast("int"))
        s = i.cast("double") * ds
        inner = 0.5 * sigma * sigma * s * s * (left - 2.0 * here + right) / (ds * ds) + rate * s * (right - left) / (2.0 * ds) - rate * here
        far = rate * s * (here - left) / ds - rate * here
        return here + dt * F.when(i == 0, -rate * here).when(i == n - 1, far).otherwise(inner)

    return step


def thomas(rhs: Column, lower: Column, diagonal: Column, upper: Column) -> Column:
    """Solution of a tridiagonal system of arrays: an elimination fold forth and a substitution fold back."""
    first = F.array().cast("array<struct<c: double, d: double>>")

    def forth(acc, i):
        last = F.when(F.size(acc) > 0, F.element_at(acc, -1))
        below = F.coalesce(F.get(lower, i) * last["c"], F.lit(0.0))
        m = F.get(diagonal, i) - below
        d = F.get(rhs, i) - F.coalesce(F.get(lower, i) * last["d"], F.lit(0.0))
        return F.concat(acc, F.array(F.struct((F.get(upper, i) / m).alias("c"), (d / m).alias("d"))))

    swept = F.aggregate(F.sequence(F.lit(0), F.size(rhs) - 1), first, forth)

    def back(acc, s):
        x = s["d"] - F.coalesce(s["c"] * F.when(F.size(acc) > 0, F.element_at(acc, 1)), F.lit(0.0))
        return F.concat(F.array(x), acc)

    return F.aggregate(F.reverse(swept), F.array().cast("array<double>"), back)


def layered_impedance(layers: DataFrame, frequencies: DataFrame, mu: float = 4e-7 * 3.141592653589793) -> DataFrame:
    """(column_id, freq, rho_a, phase) of plane waves over layers (column_id, layer, dz, sigma), the last one endless.

    Impedances fold from the bottom up inside each row; complex numbers are structs.
    """
    packed = layers.groupBy("column_id").agg(F.sort_array(F.collect_list(F.struct("layer", "dz", "sigma")), asc=False).alias("stack"))
    w = 2.0 * 3.141592653589793 * F.col("freq") * mu
    z = lambda re, im: F.struct(re.alias("re"), im.alias("im"))
    # intrinsic impedance sqrt(i w mu / sigma) has equal parts a; the wave number is a sigma (1 + i)
    part = lambda s: F.sqrt(w / (2.0 * s))

    def over(below, layer):
        def reflect(s):
            # r = (a(1+i) - Z) / (a(1+i) + Z)
            nr, ni, dr, di = s["a"] - s["re"], s["a"] - s["im"], s["a"] + s["re"], s["a"] + s["im"]
            size = dr * dr + di * di
            return let(turn, a=s["a"], x=s["x"], rr=(nr * dr + ni * di) / size, ri=(ni * dr - nr * di) / size)

        def turn(s):
            # turned and damped by exp(-2 k dz)
            c, d = F.exp(-s["x"]) * F.cos(s["x"]), F.exp(-s["x"]) * F.sin(s["x"])
            return let(close, a=s["a"], er=s["rr"] * c + s["ri"] * d, ei=s["ri"] * c - s["rr"] * d)

        def close(s):
            ur, ui, vr, vi = 1.0 - s["er"], -s["ei"], 1.0 + s["er"], s["ei"]
            size = vr * vr + vi * vi
            return let(lambda t: z(t["a"] * (t["qr"] - t["qi"]), t["a"] * (t["qr"] + t["qi"])), a=s["a"], qr=(ur * vr + ui * vi) / size, qi=(ui * vr - ur * vi) / size)

        a = part(layer["sigma"])
        return let(reflect, a=a, x=2.0 * a * layer["sigma"] * layer["dz"], re=below["re"], im=below["im"])

    bottom = F.element_at("stack", 1)["sigma"]
    start = z(part(bottom), part(bottom))
    rows = packed.crossJoin(F.broadcast(frequencies)).withColumn("z", F.aggregate(F.slice("stack", 2, F.size("stack")), start, over))
    re, im = F.col("z.re"), F.col("z.im")
    return rows.select("column_id", "freq", ((re * re + im * im) / w).alias("rho_a"), F.degrees(F.atan2(im, re)).alias("phase"))
