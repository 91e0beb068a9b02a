"""Rays: radar cross sections, two-ray and multipath fields, knife edges."""

from __future__ import annotations

import math

from isobath.functions.algebra import Complex, absolute, cos, log10, raise_error, sin, sqrt, where

LIGHT = 299_792_458.0


def wavelength(frequency, speed=LIGHT):
    return speed / frequency


def _sinc2(x):
    """(sin(pi x) / (pi x))^2."""
    y = where(absolute(x) < 1e-12, x * 0.0 + 1e-12, x) * math.pi
    return sin(y) / y * (sin(y) / y)


def cross_section(shape, wave, a, b, incidence=0.0):
    """Peak or tapered cross section (m^2) of plate, dihedral, trihedral or sphere."""
    tilt = cos(incidence) * cos(incidence)
    area = a * b / wave
    plate = 4.0 * math.pi * area * area * tilt * _sinc2(2.0 * a / wave * sin(incidence))
    forms = {"plate": plate, "dihedral": 8.0 * math.pi * area * area * tilt, "trihedral": 4.0 * math.pi / 3.0 * (a * a / wave) * (a * a / wave), "sphere": math.pi * a * a}
    out = raise_error(shape, "unknown shape")
    for name, form in forms.items():
        out = where(shape == name, form, out)
    return out


def ray(length, wave, gain=1.0) -> Complex:
    """gain exp(-j k r) / r for a real gain."""
    phase = length * (2.0 * math.pi) / wave
    return Complex(gain * cos(phase) / length, -gain * sin(phase) / length)


def two_ray(ht, hr, d, wave, reflection=-1.0):
    """Relative power over a flat ground."""
    direct, bounce = (sqrt(d * d + (ht + side * hr) * (ht + side * hr)) for side in (-1.0, 1.0))
    return (ray(direct, wave) + ray(bounce, wave, reflection)).power2()


def multipath(x0, z0, x1, z1, wave, reflection=-1.0, wall=None):
    """Relative power of direct, ground, wall and ground-wall paths; wall is (x, height, gain) or None.

    An image of the source stands for each path; a wall path counts if its ray meets the wall.
    """

    def path(xs, zs, gain):
        return ray(sqrt((x1 - xs) * (x1 - xs) + (z1 - zs) * (z1 - zs)), wave, gain)

    total = path(x0, z0, 1.0) + path(x0, -z0, reflection)
    if wall is not None:
        at, height, gain = wall
        xs = 2.0 * at - x0
        span = x1 - xs
        part = (at - xs) / where(absolute(span) > 1e-12, span, span * 0.0 + 1.0)
        for zs, g in ((z0, gain), (-z0, gain * reflection)):
            z = zs + part * (z1 - zs)
            hits = (absolute(span) > 1e-12) & (part >= 0.0) & (part <= 1.0) & (z >= 0.0) & (z <= height)
            other = path(xs, zs, g)
            total = total + Complex(where(hits, other.re, 0.0), where(hits, other.im, 0.0))
    return total.power2()


def knife_edge(c, s):
    """Loss (dB) behind an edge from the Fresnel integrals C and S of its parameter."""
    x, y = 0.5 - c, 0.5 - s
    size = sqrt(0.5 * (x * x + y * y))
    return 20.0 * log10(where(size > 1e-30, size, size * 0.0 + 1e-30))
