"""Closed forms of potentials, conduction, waveguides, gas dynamics and quantum states."""

from __future__ import annotations

import math

from isobath.functions.algebra import Complex, ceil, cos, exp, greatest, power, sin, sqrt, tanh, where


def yukawa(r, q, eps, kappa):
    return q * exp(-kappa * r) / (4.0 * math.pi * eps * r)


def born(q, radius, eps_in, eps_out, eps0=1.0):
    """Solvation energy of an ion."""
    return q * q / (8.0 * math.pi * eps0 * radius) * (1.0 / eps_out - 1.0 / eps_in)


def diffusion_rate(d, a):
    """Encounter rate at a sphere without a potential."""
    return 4.0 * math.pi * d * a


def cole_cole(omega, sigma, m, tau, c) -> Complex:
    """Complex conductivity; (i w tau)^c in polar form, with w = 0 giving sigma (1 - m)."""
    still = omega <= 0.0
    size = where(still, 0.0, power(where(still, 1.0, omega) * tau, c))
    turned = Complex(1.0 + size * math.cos(0.5 * math.pi * c), size * math.sin(0.5 * math.pi * c))
    return (1.0 - Complex(m, 0.0 * m) / turned) * sigma


def apparent_conductivity(resistance: Complex, factor) -> Complex:
    return Complex(factor + 0.0 * resistance.re, 0.0 * resistance.re) / resistance


def level_material(phi, inside, outside, eps=0.1):
    """A material that passes smoothly from outside to inside where phi grows through 0."""
    return outside + (inside - outside) * (0.5 + 0.5 * tanh(phi / eps))


def pekeris(k, omega, depth, c1, c2, rho1, rho2):
    """Zero at the horizontal wavenumbers of the trapped modes."""
    up = sqrt(greatest(omega / c1 * (omega / c1) - k * k, 0.0))
    down = sqrt(greatest(k * k - omega / c2 * (omega / c2), 0.0))
    return up * cos(up * depth) + rho1 / rho2 * down * sin(up * depth)


def pekeris_modes(freq, depth, c1, c2):
    omega = 2.0 * math.pi * freq
    steepest = omega * math.sqrt(1.0 / (c1 * c1) - 1.0 / (c2 * c2))
    return ceil(steepest * depth / math.pi)


def field_direction(inclination_deg, declination_deg):
    """East, north, up of a magnetic field."""
    i, d = inclination_deg * (math.pi / 180.0), declination_deg * (math.pi / 180.0)
    return cos(i) * sin(d), cos(i) * cos(d), -sin(i)


def density(psi: Complex):
    return psi.power2()


def wave_function(p, rho, p_side, sound, gamma=1.4):
    """Velocity change through a shock (p above p_side) or a fan."""
    grow = (gamma - 1.0) / (gamma + 1.0)
    shock = (p - p_side) * sqrt(2.0 / ((gamma + 1.0) * rho) / (p + grow * p_side))
    fan = 2.0 * sound / (gamma - 1.0) * (power(p / p_side, (gamma - 1.0) / (2.0 * gamma)) - 1.0)
    return where(p > p_side, shock, fan)


def gas_state(rho, u, p, gamma=1.4):
    """(mass, momentum, energy, velocity, pressure)."""
    return rho, rho * u, p / (gamma - 1.0) + 0.5 * rho * u * u, u, p


def hll(m0, q0, e0, u0, p0, m1, q1, e1, u1, p1, gamma=1.4):
    """Fluxes of mass, momentum and energy between two gas states."""
    a0, a1 = sqrt(gamma * p0 / m0), sqrt(gamma * p1 / m1)
    slow = where(u0 - a0 < u1 - a1, u0 - a0, u1 - a1)
    fast = where(u0 + a0 > u1 + a1, u0 + a0, u1 + a1)
    left, right = (q0, q0 * u0 + p0, (e0 + p0) * u0), (q1, q1 * u1 + p1, (e1 + p1) * u1)
    out = []
    for f0, f1, s0, s1 in zip(left, right, (m0, q0, e0), (m1, q1, e1), strict=True):
        middle = (fast * f0 - slow * f1 + slow * fast * (s1 - s0)) / (fast - slow)
        out.append(where(slow >= 0.0, f0, where(fast <= 0.0, f1, middle)))
    return out


def debye_length(valences, concentrations, eps=1.0):
    """Screening length of ions with their bulk concentrations."""
    from isobath.functions.algebra import sqrt

    strength = sum(z * z * c for z, c in zip(valences, concentrations, strict=True))
    return sqrt(eps / strength)
