"""Kernels of potential fields: what a unit of source at a displacement contributes."""

from __future__ import annotations

import math

from isobath.functions.algebra import greatest, sqrt

BIG_G = 6.674e-11
EOTVOS = 1e9
AXES = "xyz"


def distance(d):
    """Length of a displacement (observation minus cell), 1e-6 at least."""
    return greatest(sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]), 1e-6)


def gravity(d, r, volume):
    """Vertical attraction (mGal) per density."""
    return 1e5 * BIG_G * volume * d[2] / (r * r * r)


def _dot(b, d):
    return b[0] * d[0] + b[1] * d[1] + b[2] * d[2]


def magnetic_total(d, r, volume, b, field_nt=50_000.0):
    """Total-field anomaly (nT) per susceptibility along the field direction b."""
    along = _dot(b, d) / r
    return field_nt / (4.0 * math.pi) * volume * (3.0 * along * along - 1.0) / (r * r * r)


def component(name: str) -> tuple[int, ...]:
    """Axis numbers of a component like 'xz'; ValueError for other letters."""
    if not name or any(c not in AXES for c in name.lower()):
        raise ValueError(f"bad component {name!r}: use letters of {AXES}")
    return tuple(AXES.index(c) for c in name.lower())


def gravity_gradient(d, r, volume, name: str, units: str = "eotvos"):
    """Second derivative of the potential per density."""
    if units not in ("eotvos", "si"):
        raise ValueError(f"unknown units {units!r}: eotvos or si")
    i, j = component(name)
    trace = r * r if i == j else 0.0
    scale = BIG_G * (EOTVOS if units == "eotvos" else 1.0)
    return scale * volume * (3.0 * d[i] * d[j] - trace) / (r * r * r * r * r)


def magnetic_vector(d, r, volume, b, name: str, field_nt=50_000.0):
    """A component of the dipole's field (nT) per susceptibility."""
    (k,) = component(name)
    return field_nt / (4.0 * math.pi) * volume * (3.0 * _dot(b, d) * d[k] / (r * r) - b[k]) / (r * r * r)


def magnetic_gradient(d, r, volume, b, name: str, field_nt=50_000.0):
    """Derivative of a component of the dipole's field (nT/m) per susceptibility."""
    i, j = component(name)
    along, r2 = _dot(b, d), r * r
    symmetric = b[i] * d[j] + b[j] * d[i] + (along if i == j else 0.0)
    return field_nt / (4.0 * math.pi) * volume * 3.0 * (symmetric - 5.0 * along * d[i] * d[j] / r2) / (r2 * r2 * r)


def trace_free_zz(gxx, gyy):
    return -(gxx + gyy)
