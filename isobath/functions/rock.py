"""Elastic rock physics: fluid substitution, Biot-Gassmann, Thomsen parameters."""

from __future__ import annotations

from isobath.functions.algebra import greatest, sqrt


def saturated_modulus(k_dry, k_min, k_fluid, phi):
    """Gassmann's bulk modulus of the saturated rock."""
    frame = 1.0 - k_dry / k_min
    return k_dry + frame * frame / (phi / k_fluid + (1.0 - phi) / k_min - k_dry / (k_min * k_min))


def dry_modulus(k_sat, k_min, k_fluid, phi):
    """The inverse of saturated_modulus in k_dry."""
    a = phi * k_min / k_fluid
    return (k_sat * (a + 1.0 - phi) - k_min) / (a + k_sat / k_min - 1.0 - phi)


def moduli(vp, vs, rho):
    """Bulk and shear modulus."""
    shear = rho * vs * vs
    return rho * vp * vp - 4.0 / 3.0 * shear, shear


def velocities(k, mu, rho):
    return sqrt((k + 4.0 / 3.0 * mu) / rho), sqrt(mu / rho)


def substitute_fluid(vp, vs, rho, phi, k_min, k_in, rho_in, k_out, rho_out):
    """Velocities and density after one pore fluid replaces another."""
    k, mu = moduli(vp, vs, rho)
    k_new = saturated_modulus(dry_modulus(k, k_min, k_in, phi), k_min, k_out, phi)
    rho_new = rho + phi * (rho_out - rho_in)
    return (*velocities(k_new, mu, rho_new), rho_new)


def biot_moduli(k_solid, k_fluid, k_dry, mu, phi):
    """alpha, M, k_sat, H, C of a porous medium."""
    alpha = 1.0 - k_dry / k_solid
    m = 1.0 / (phi / k_fluid + (alpha - phi) / k_solid)
    k_sat = k_dry + alpha * alpha * m
    return alpha, m, k_sat, k_sat + 4.0 / 3.0 * mu, alpha * m


def biot_velocity(k_solid, k_fluid, k_dry, mu, phi, rho_solid, rho_fluid):
    """Undrained fast P velocity."""
    h = biot_moduli(k_solid, k_fluid, k_dry, mu, phi)[3]
    return sqrt(h / ((1.0 - phi) * rho_solid + phi * rho_fluid))


def thomsen(vp0, vs0, epsilon, delta, gamma, rho):
    """c11, c33, c44, c66, c13 of a medium with a vertical symmetry axis."""
    c33, c44 = rho * vp0 * vp0, rho * vs0 * vs0
    gap = c33 - c44
    c13 = sqrt(greatest(gap * gap + 2.0 * c33 * gap * delta, 0.0)) - c44
    return c33 + 2.0 * epsilon * c33, c33, c44, c44 + 2.0 * gamma * c44, c13


def voigt(c11, c33, c44, c66, c13):
    """The 6 x 6 stiffness as a list of rows."""
    c12 = c11 - 2.0 * c66
    block = [[c11, c12, c13], [c12, c11, c13], [c13, c13, c33]]
    shear = [c44, c44, c66]
    zero = c11 * 0.0
    return [[block[i][j] if i < 3 and j < 3 else shear[i - 3] if i == j else zero for j in range(6)] for i in range(6)]


def bond(cos, sin, axis: int = 1):
    """The 6 x 6 matrix that turns a Voigt stiffness about an axis, from the angle's cosine and sine.

    A symmetric tensor turns by R on both sides; entry (I, J) collects R R over both orders of the pair J.
    """
    a, b = (axis + 1) % 3, (axis + 2) % 3
    one, zero = cos * 0.0 + 1.0, cos * 0.0
    r = [[one if i == j == axis else zero for j in range(3)] for i in range(3)]
    r[a][a], r[b][b], r[a][b], r[b][a] = cos, cos, -sin, sin
    pairs = [(0, 0), (1, 1), (2, 2), (1, 2), (0, 2), (0, 1)]

    def entry(left, right):
        (i, j), (k, m) = left, right
        value = r[i][k] * r[j][m]
        return value if k == m else value + r[i][m] * r[j][k]

    return [[entry(left, right) for right in pairs] for left in pairs]


def rotate(stiffness, cos, sin, axis: int = 1):
    """M C M^T."""
    m = bond(cos, sin, axis)

    def dot(xs, ys):
        total = None
        for x, y in zip(xs, ys, strict=True):
            total = x * y if total is None else total + x * y
        return total

    half = [[dot(m[i], [stiffness[k][j] for k in range(6)]) for j in range(6)] for i in range(6)]
    return [[dot(half[i], m[j]) for j in range(6)] for i in range(6)]
