"""Sound in seawater: speed, pressure, absorption."""

from __future__ import annotations

import math

from isobath.functions.algebra import LN10, exp, poly, sin, sqrt

# Mackenzie (1981), nine terms.
MACKENZIE = {"T": (1448.96, 4.591, -5.304e-2, 2.374e-4), "S": 1.340, "D": (1.630e-2, 1.675e-7), "TS": -1.025e-2, "TD3": -7.139e-13}
# Chen-Millero coefficients by power of pressure (bar), each a polynomial in temperature.
PURE = ((1402.388, 5.03830, -5.81090e-2, 3.3432e-4, -1.47797e-6, 3.1419e-9), (0.153563, 6.8999e-4, -8.1829e-6, 1.3632e-7, -6.1260e-10), (3.1260e-5, -1.7111e-6, 2.5986e-8, -2.5353e-10, 1.0415e-12), (-9.7729e-9, 3.8513e-10, -2.3654e-12))
SALT = ((1.389, -1.262e-2, 7.166e-5, 2.008e-6, -3.21e-8), (9.4742e-5, -1.2583e-5, -6.4928e-8, 1.0515e-8, -2.0142e-10), (-3.9064e-7, 9.1061e-9, -1.6009e-10, 7.994e-12), (1.100e-10, 6.651e-12, -3.391e-13))
SALT32 = ((-1.922e-2, -4.42e-5), (7.3637e-5, 1.7950e-7))
SALT2 = ((1.727e-3,), (-7.9836e-6,))


def mackenzie(t, s, d):
    """Speed (m/s) at temperature (deg C), salinity (ppt), depth (m)."""
    ds = s - 35.0
    shallow = poly(t, *MACKENZIE["T"]) + ds * (MACKENZIE["S"] + MACKENZIE["TS"] * t)
    return shallow + d * (MACKENZIE["D"][0] + d * (MACKENZIE["D"][1] + t * (MACKENZIE["TD3"] * d)))


def unesco(t, s, p):
    """Speed (m/s) at temperature (deg C), salinity (ppt), gauge pressure (bar)."""
    pure, salt, salt32, salt2 = (poly(p, *[poly(t, *row) if len(row) > 1 else row[0] for row in block]) for block in (PURE, SALT, SALT32, SALT2))
    return pure + s * (salt + sqrt(s) * salt32 + s * salt2)


def surface_gravity(latitude):
    s2 = sin(latitude * (math.pi / 180.0)) * sin(latitude * (math.pi / 180.0))
    return 9.780318 * poly(s2, 1.0, 5.2788e-3, -2.36e-5)


def depth_to_pressure(depth, latitude=45.0):
    """Gauge pressure (bar), Leroy and Parthiot (1998)."""
    standard = depth * poly(depth, 1.00818e-2, 2.465e-8, -1.25e-13, 2.8e-19)
    bend = 2.0e-5 * depth
    return 10.0 * standard * (surface_gravity(latitude) - bend) / (9.80612 - bend)


def pressure_to_depth(pressure, latitude=45.0):
    """Depth (m) of a gauge pressure (bar); inverts depth_to_pressure to about a metre."""
    mpa = pressure / 10.0
    s2 = sin(latitude * (math.pi / 180.0)) * sin(latitude * (math.pi / 180.0))
    return mpa * poly(mpa, 9.72659e2, -2.2512e-1, 2.279e-4, -1.82e-7) / (9.7803 * (1.0 + 5.3e-3 * s2) + 1.092e-4 * mpa)


def thorp(f_khz):
    """Absorption (dB/km), Thorp (1967)."""
    f2 = f_khz * f_khz
    return 0.003 + f2 * (0.1 / (1.0 + f2) + 40.0 / (4100.0 + f2) + 2.75e-4)


def francois_garrison(f_khz, t=4.0, s=35.0, ph=8.0, d=0.0):
    """Absorption (dB/km) by boric acid, magnesium sulphate and cold water, Francois and Garrison (1982)."""
    f2 = f_khz * f_khz
    kelvin, speed = t + 273.0, 1412.0 + 3.21 * t + 1.19 * s + 0.0167 * d

    def relaxation(strength, at):
        return strength * at * f2 / (at * at + f2)

    boric = relaxation(8.686 / speed * exp(LN10 * (0.78 * ph - 5.0)), 2.8 * sqrt(s / 35.0) * exp(LN10 * (4.0 - 1245.0 / kelvin)))
    sulphate = relaxation(21.44 * s / speed * (1.0 + 0.025 * t) * poly(d, 1.0, -1.37e-4, 6.2e-9), 8.17 * exp(LN10 * (8.0 - 1990.0 / kelvin)) / (1.0 + 0.0018 * (s - 35.0)))
    water = poly(t, 4.937e-4, -2.59e-5, 9.11e-7, -1.50e-8) * poly(d, 1.0, -3.83e-5, 4.9e-10) * f2
    return boric + sulphate + water


def nepers(alpha_db):
    """Nepers per length of decibels per length."""
    return alpha_db * (LN10 / 20.0)


def quality_factor(alpha_db, f_hz, c, length_scale=1000.0):
    """Q of an absorption in dB per length_scale metres."""
    return math.pi * f_hz * length_scale / (c * nepers(alpha_db))


def modulus_fraction(alpha_db, f_hz, c, length_scale=1000.0):
    """1/Q: the imaginary part of the modulus over the real one."""
    return c * nepers(alpha_db) / (math.pi * f_hz * length_scale)


def lloyd_mirror(k, source_depth, z, r):
    """Pressure magnitude of a source and its image in the sea surface, far field."""
    from isobath.functions.algebra import absolute

    return 2.0 / r * absolute(sin(k * source_depth * z / r))
