"""Reflection at the sea floor, the sea surface and the ground."""

from __future__ import annotations

import math

from isobath.functions.algebra import LN10, Complex, acos, cos, exp, least, log10, poly, sin, sqrt, where


def impedance(rho, c):
    return rho * c


def critical_angle(c1, c2):
    """Grazing angle (rad) below which a faster floor reflects totally; 0 if it is not faster."""
    return acos(least(c1 / c2, 1.0))


def _as_is(name, value):
    return value


def seabed_reflection(angle, c1, rho1, c2, rho2, loss_db_per_wavelength=0.0, keep=_as_is) -> Complex:
    """Rayleigh coefficient at a grazing angle; loss makes the floor's speed complex.

    keep(name, value) may store an intermediate value as a column.
    """
    delta = loss_db_per_wavelength * (LN10 / (40.0 * math.pi))
    floor = keep("floor", Complex(c2) / Complex(1.0 + 0.0 * c2, delta + 0.0 * c2))
    ratio = keep("ratio", floor * (cos(angle) / c1))
    below = keep("below", keep("square", 1.0 - ratio * ratio).root())
    into, back = keep("into", floor * (rho2 * sin(angle))), keep("back", below * (rho1 * c1))
    return (into - back) / (into + back)


def bottom_loss(reflection: Complex):
    """dB."""
    return -10.0 * log10(reflection.power2())


def surface_reflection() -> float:
    return -1.0


def roughness(k, sigma, angle):
    """Rayleigh's parameter of a rough surface."""
    return k * sigma * sin(angle)


# Abramowitz and Stegun 9.8.1 and 9.8.2.
_I0_SMALL = (1.0, 3.5156229, 3.0899424, 1.2067492, 0.2659732, 0.0360768, 0.0045813)
_I0_LARGE = (0.39894228, 0.01328592, 0.00225319, -0.00157565, 0.00916281, -0.02057706, 0.02635537, -0.01647633, 0.00392377)


def scaled_bessel_i0(x):
    """exp(-x) I0(x) for x >= 0, to 2e-7."""
    t2 = x / 3.75 * (x / 3.75)
    safe = where(x < 3.75, x * 0.0 + 3.75, x)
    return where(x < 3.75, exp(-x) * poly(t2, *_I0_SMALL), poly(3.75 / safe, *_I0_LARGE) / sqrt(safe))


def coherent_factor(k, sigma, angle, bessel: bool = False):
    """Loss of the mirror reflection on a rough surface: Eckart's, or with I0 Miller, Brown and Vegh's."""
    g = roughness(k, sigma, angle)
    x = 2.0 * g * g
    return scaled_bessel_i0(x) if bessel else exp(-x)


def radar_reflection(angle, eps: Complex, vertical: bool = False, keep=_as_is) -> Complex:
    """Fresnel coefficient of a lossy half-space at a grazing angle."""
    s, c = sin(angle), cos(angle)
    w = keep("w", keep("square", eps - c * c).root())
    near = keep("near", eps * s if vertical else Complex(s, 0.0 * s))
    return (near - w) / (near + w)
