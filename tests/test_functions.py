"""Published check values and identities of the closed forms, on plain numbers."""

import math

import pytest

from isobath.functions import atmosphere, boundary, energy, ocean, potential, rock, scattering
from isobath.functions.algebra import Complex, Sql


def test_sound_speed():
    assert abs(ocean.mackenzie(25.0, 35.0, 1000.0) - 1550.744) < 1e-3
    assert abs(ocean.unesco(0.0, 35.0, 0.0) - 1449.14) < 0.2 and abs(ocean.unesco(30.0, 35.0, 0.0) - 1545.36) < 0.3
    assert abs(ocean.unesco(25.0, 35.0, 1000.0) - 1699.242) < 0.3
    assert abs(ocean.depth_to_pressure(1000.0) - 101.0) < 0.3
    assert abs(ocean.pressure_to_depth(ocean.depth_to_pressure(3000.0)) - 3000.0) < 3


def test_absorption():
    assert abs(ocean.thorp(1.0) - 0.063) < 0.003 and abs(ocean.thorp(10.0) - 1.082) < 0.03
    assert abs(ocean.francois_garrison(10.0) / ocean.thorp(10.0) - 1) < 0.3
    assert abs(ocean.quality_factor(1.0, 1e4, 1500.0) * ocean.modulus_fraction(1.0, 1e4, 1500.0) - 1) < 1e-12


def test_air():
    e = atmosphere.vapour_pressure(0.6, 15.0)
    assert abs(atmosphere.saturation_pressure(15.0) - 17.0457) < 1e-3
    assert abs(atmosphere.refractivity(1013.0, 288.15, e) - 318.7816) < 1e-3
    theta = 300 / 288.15
    dry = lambda f: atmosphere.specific(f, sum(atmosphere.oxygen_line(f, 1013.0, 0.0, theta, line) for line in atmosphere.OXYGEN_LINES) + atmosphere.dry_continuum(f, 1013.0, 0.0, theta))
    assert 7.5 < dry(60.0) < 30 and 0.004 < dry(10.0) < 0.02
    assert abs(atmosphere.rain(0.01217, 1.2571, 50.0) - 1.66) < 0.02


def test_gaseous_lines_against_the_table():
    # Rec. ITU-R P.676 Annex 1: f0 and strength of lines that a list of the strongest ones leaves out
    assert len(atmosphere.OXYGEN_LINES) == 44 and len(atmosphere.VAPOUR_LINES) == 34
    oxygen, vapour = ({line[0]: line[1:] for line in lines} for lines in (atmosphere.OXYGEN_LINES, atmosphere.VAPOUR_LINES))
    assert oxygen[53.066934] == (64.29, 5.201, 9.06, 1.349, 6.206) and oxygen[67.369601] == (18.56, 6.818, 8.11, -1.956, -6.475)
    assert oxygen[54.130025][0] == 227.3 and oxygen[834.145546] == (183.1, 0.145, 14.7, 0.0, 0.0)
    assert vapour[67.80396] == (0.0011, 8.732, 28.58, 0.69, 4.93, 0.82) and vapour[336.227764] == (0.001, 9.825, 26.93, 0.69, 4.74, 0.61)


def test_rock():
    assert abs(rock.saturated_modulus(15.0, 36.6, 2.2, 0.2) - 18.42912123) < 1e-6
    assert abs(rock.saturated_modulus(15.0, 36.6, 0.133, 0.2) - 15.22998478) < 1e-6
    assert abs(rock.dry_modulus(18.42912123, 36.6, 2.2, 0.2) - 15.0) < 1e-6
    same = rock.substitute_fluid(3.0, 1.6, 2.3, 0.2, 36.6, 2.2, 1.0, 2.2, 1.0)
    assert all(abs(a - b) < 1e-9 for a, b in zip(same, (3.0, 1.6, 2.3), strict=True))
    c = rock.thomsen(3.0, 1.5, 0.0, 0.0, 0.0, 2.0)
    assert abs(c[0] - c[1]) < 1e-12 and abs(c[4] - (c[1] - 2 * c[2])) < 1e-12
    stiff = rock.voigt(*rock.thomsen(3.0, 1.5, 0.2, 0.1, 0.15, 2.0))
    turned = rock.rotate(stiff, math.cos(math.pi / 2), math.sin(math.pi / 2), 1)
    assert abs(turned[0][0] - stiff[2][2]) < 1e-9 and abs(turned[2][2] - stiff[0][0]) < 1e-9
    back = rock.rotate(rock.rotate(stiff, math.cos(0.4), math.sin(0.4), 0), math.cos(0.4), -math.sin(0.4), 0)
    assert all(abs(back[i][j] - stiff[i][j]) < 1e-9 for i in range(6) for j in range(6))


def test_boundaries():
    grazing = boundary.critical_angle(1500.0, 1800.0)
    total = boundary.seabed_reflection(0.5 * grazing, 1500.0, 1000.0, 1800.0, 1500.0)
    assert abs(total.power2() - 1) < 1e-9
    normal = boundary.seabed_reflection(math.pi / 2, 1500.0, 1000.0, 1800.0, 1500.0)
    assert abs(normal.re - (2.7e6 - 1.5e6) / (2.7e6 + 1.5e6)) < 1e-9
    assert boundary.seabed_reflection(0.5 * grazing, 1500.0, 1000.0, 1800.0, 1500.0, 0.5).power2() < 1
    assert abs(boundary.scaled_bessel_i0(1.0) - 1.2660658777 * math.exp(-1)) < 1e-6 and abs(boundary.scaled_bessel_i0(5.0) - 27.2398718 * math.exp(-5)) < 1e-6
    assert abs(boundary.radar_reflection(1e-6, Complex(60.0, -20.0)).re + 1) < 1e-4


def test_scattering():
    assert abs(scattering.cross_section("plate", 0.03, 0.3, 0.2) - 4 * math.pi * 0.06**2 / 0.03**2) < 1e-6
    assert abs(scattering.cross_section("sphere", 0.03, 0.5, 0.0) - math.pi * 0.25) < 1e-12
    flat = scattering.multipath(0.0, 10.0, 100.0, 6.0, 0.3)
    assert abs(flat - scattering.two_ray(10.0, 6.0, 100.0, 0.3)) < 1e-15
    assert scattering.multipath(0.0, 10.0, 100.0, 6.0, 0.3, -1.0, (200.0, 50.0, -1.0)) != flat
    assert scattering.multipath(0.0, 10.0, 100.0, 6.0, 0.3, -1.0, (200.0, 0.1, -1.0)) == flat
    assert abs(scattering.knife_edge(0.0, 0.0) + 6.0206) < 1e-3


def test_energy_and_potential():
    assert abs(energy.pekeris_modes(50.0, 100.0, 1500.0, 1800.0) - math.ceil(2 * 50 * 100 / 1500 * math.sqrt(1 - (1500 / 1800) ** 2))) < 1e-9
    assert abs(energy.cole_cole(0.0, 2.0, 0.3, 0.1, 0.5).re - 1.4) < 1e-12
    still = energy.hll(*energy.gas_state(1.0, 0.3, 1.0), *energy.gas_state(1.0, 0.3, 1.0))
    assert abs(still[0] - 0.3) < 1e-12 and abs(still[1] - 1.09) < 1e-12
    d, b = (30.0, -40.0, 120.0), (0.3, 0.4, -math.sqrt(0.75))
    r = potential.distance(d)
    trace = sum(potential.gravity_gradient(d, r, 1e6, c) for c in ("xx", "yy", "zz"))
    assert abs(trace) < 1e-9
    h = 1e-3
    for i, a in enumerate("xyz"):
        for k, c in enumerate("xyz"):
            up, down = ([x + s * h * (n == k) for n, x in enumerate(d)] for s in (1, -1))
            slope = (potential.magnetic_vector(up, potential.distance(up), 1e6, b, a) - potential.magnetic_vector(down, potential.distance(down), 1e6, b, a)) / (2 * h)
            assert abs(potential.magnetic_gradient(d, r, 1e6, b, a + c) - slope) < 1e-4 * abs(slope) + 1e-6
            assert i >= 0
    with pytest.raises(ValueError):
        potential.gravity_gradient(d, r, 1.0, "xq")
    with pytest.raises(ValueError):
        potential.gravity_gradient(d, r, 1.0, "xx", "furlongs")


def test_sql_text():
    assert Sql.of(1.5) == "(1.5e0)" and Sql.of(1e-7) == "(1e-07)"
    assert Sql.of((Sql("a") + 1.0) * 2.0) == "((a + (1.0e0)) * (2.0e0))"
