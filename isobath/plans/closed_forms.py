"""Queries of the closed forms: one projection each, from which the oracle's text follows."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from isobath.functions import atmosphere, boundary, energy, ocean, rock, scattering
from isobath.functions.algebra import Complex, Sql, where
from isobath.plans.views import VIEWS, view, view_sql

QUERIES: dict = {}
ORACLES: dict = {}


def _columns(name: str) -> list[str]:
    return [e.rsplit(" AS ", 1)[1] for e in VIEWS[name][1]]


class Steps:
    """Named intermediate columns: without them, shared parts of an expression multiply in its tree."""

    def __init__(self, column):
        self.column, self.made = column, []

    def __call__(self, name: str, value):
        if isinstance(value, Complex):
            return Complex(self(f"{name}_re", value.re), self(f"{name}_im", value.im))
        self.made.append((name, value))
        return self.column(name)


def projection(name: str, source: str, key: list[str], make, digits: int = 6) -> None:
    """Register a query that adds the columns of make(columns, keep) to the key, rounded."""
    columns = _columns(source)

    def run(spark, sf_dir):
        steps = Steps(F.col)
        made = make(SimpleNamespace(**{c: F.col(c) for c in columns}), steps)
        df = view(spark, sf_dir, source)
        for n, v in steps.made:
            df = df.withColumn(n, F.lit(v) if isinstance(v, float) else v)
        return df.select(*key, *[F.round(F.lit(v) if isinstance(v, float) else v, digits).alias(n) for n, v in made.items()])

    steps = Steps(Sql)
    made = make(SimpleNamespace(**{c: Sql(c) for c in columns}), steps)
    text = f"{view_sql(source)} v"
    for n, v in steps.made:
        text = f"(SELECT *, {Sql.of(v)} AS {n} FROM {text}) v"
    QUERIES[name] = run
    ORACLES[name] = f"SELECT {', '.join([*key, *[f'round({Sql.of(v)}, {digits}) AS {n}' for n, v in made.items()]])} FROM {text}"


def _attenuation(v, keep):
    f = v.band * 10.0
    alpha = ocean.francois_garrison(f, v.t_c, v.s_ppt, 8.0, v.depth_m)
    return {"thorp": ocean.thorp(f), "francois_garrison": alpha, "nepers": ocean.nepers(alpha)}


def _quality(v, keep):
    f = v.band * 10.0
    alpha, c = ocean.thorp(f), ocean.mackenzie(v.t_c, v.s_ppt, v.depth_m)
    return {"q": ocean.quality_factor(alpha, 1000.0 * f, c), "modulus_fraction": ocean.modulus_fraction(alpha, 1000.0 * f, c)}


def _unesco(v, keep):
    p = ocean.depth_to_pressure(v.depth_m, 30.0 + v.s_ppt)
    return {"pressure_bar": p, "speed": ocean.unesco(v.t_c, v.s_ppt, p), "depth_back": ocean.pressure_to_depth(p, 30.0 + v.s_ppt), "gravity": ocean.surface_gravity(v.s_ppt)}


projection("sound_speed_unesco", "ctd", ["obs_id"], _unesco)
projection("sound_speed_gap", "ctd", ["obs_id"], lambda v, keep: {"gap": ocean.mackenzie(v.t_c, v.s_ppt, v.depth_m) - ocean.unesco(v.t_c, v.s_ppt, ocean.depth_to_pressure(v.depth_m))})
projection("seawater_absorption", "ctd", ["obs_id"], _attenuation)
projection("quality_factor", "ctd", ["obs_id"], _quality)


def _air(v, keep):
    e = atmosphere.vapour_pressure(v.humidity, v.t_k - 273.15)
    n = atmosphere.refractivity(v.p_hpa, v.t_k, e)
    z = 8.0 * v.p_hpa
    m = atmosphere.modified_refractivity(n, z)
    return {"saturation": atmosphere.saturation_pressure(v.t_k - 273.15), "vapour": e, "n": n, "m": m, "index": atmosphere.refractive_index(m), "standard": atmosphere.standard_refractivity(z)}


projection("refractivity_profile", "air", ["obs_id"], _air)


def _gassmann(v, keep):
    k = rock.saturated_modulus(v.k_dry, v.k_min, v.k_fl, v.phi)
    mu = 0.6 * v.k_dry
    rho = 2.65 - 1.6 * v.phi
    vp, vs = rock.velocities(k, mu, rho)
    bulk, shear = rock.moduli(vp, vs, rho)
    new_vp, new_vs, new_rho = rock.substitute_fluid(vp, vs, rho, v.phi, v.k_min, v.k_fl, 1.0, 0.9, 0.7)
    return {"k_sat": k, "k_dry_back": rock.dry_modulus(k, v.k_min, v.k_fl, v.phi), "vp": vp, "vs": vs, "bulk": bulk, "shear": shear, "vp_out": new_vp, "vs_out": new_vs, "rho_out": new_rho}


def _biot(v, keep):
    alpha, m, k, h, c = rock.biot_moduli(v.k_min, v.k_fl, v.k_dry, 0.6 * v.k_dry, v.phi)
    return {"alpha": alpha, "m": m, "k_sat": k, "h": h, "c": c, "velocity": rock.biot_velocity(v.k_min, v.k_fl, v.k_dry, 0.6 * v.k_dry, v.phi, 2.65, 1.0)}


def _thomsen(v, keep):
    c11, c33, c44, c66, c13 = rock.thomsen(3.0 + v.phi, 1.5, v.phi, 0.5 * v.phi, 0.2 * v.phi, 2.3)
    return {"c11": c11, "c33": c33, "c44": c44, "c66": c66, "c13": c13}


def _turned(v, keep):
    from isobath.functions.algebra import cos, sin

    stiff = rock.voigt(*rock.thomsen(3.0 + v.phi, 1.5, v.phi, 0.5 * v.phi, 0.2 * v.phi, 2.3))
    turned = rock.rotate(stiff, cos(v.phi * 4.0), sin(v.phi * 4.0), 1)
    return {f"c{i + 1}{j + 1}": turned[i][j] for i in range(6) for j in range(i, 6)}


projection("gassmann_substitution", "rock", ["obs_id"], _gassmann)
projection("biot_velocity", "rock", ["obs_id"], _biot)
projection("thomsen_cij", "rock", ["obs_id"], _thomsen)
projection("voigt_rotation", "rock", ["obs_id"], _turned, 4)


def _seabed(v, keep):
    angle = v.t_c / 30.0
    c1 = keep("c1", ocean.mackenzie(v.t_c, v.s_ppt, v.depth_m))
    r = boundary.seabed_reflection(angle, c1, 1000.0, 1450.0 + 10.0 * v.s_ppt, 1800.0, 0.5, keep)
    clear = boundary.seabed_reflection(angle, c1, 1000.0, 1450.0 + 10.0 * v.s_ppt, 1800.0, 0.0, lambda n, x: keep(f"clear_{n}", x))
    return {"re": r.re, "im": r.im, "loss_db": boundary.bottom_loss(r), "clear_power": clear.power2(), "critical": boundary.critical_angle(c1, 1450.0 + 10.0 * v.s_ppt), "impedance": boundary.impedance(1.025, c1), "surface": c1 * 0.0 + boundary.surface_reflection()}


def _rough(v, keep):
    k, sigma, angle = v.depth_m / 1000.0, v.s_ppt / 30.0, v.t_c / 30.0
    return {"g": boundary.roughness(k, sigma, angle), "eckart": boundary.coherent_factor(k, sigma, angle), "with_bessel": boundary.coherent_factor(k, sigma, angle, True)}


def _radar(v, keep):
    eps = Complex(40.0 + v.s_ppt, -10.0 - v.t_c)
    h, u = boundary.radar_reflection(v.t_c / 30.0, eps, False, keep), boundary.radar_reflection(v.t_c / 30.0, eps, True, lambda n, x: keep(f"u_{n}", x))
    return {"h_re": h.re, "h_im": h.im, "v_re": u.re, "v_im": u.im}


projection("seabed_reflection", "ctd", ["obs_id"], _seabed)
projection("roughness_factor", "ctd", ["obs_id"], _rough)
projection("radar_reflection", "ctd", ["obs_id"], _radar)


def _rcs(v, keep):
    shape = where(v.kind == 0, "plate", where(v.kind == 1, "dihedral", where(v.kind == 2, "trihedral", "sphere")))
    return {"rcs": scattering.cross_section(shape, 0.03, 0.1 + v.phi, 0.2 + v.phi, v.phi), "wavelength": scattering.wavelength(v.size * 1e9)}


projection("rcs_by_shape", "rock", ["obs_id"], _rcs, 5)
projection("two_ray", "ctd", ["obs_id"], lambda v, keep: {"power": 1e9 * scattering.two_ray(20.0, v.t_c, 100.0 + v.depth_m, 0.3)}, 5)
projection("multipath", "ctd", ["obs_id"], lambda v, keep: {"power": 1e6 * scattering.multipath(0.0, 20.0, 100.0 + v.depth_m / 100.0, v.t_c, 0.3, -1.0, (300.0, 25.0, -0.5))}, 5)
projection("lloyd_mirror", "ctd", ["obs_id"], lambda v, keep: {"pressure": ocean.lloyd_mirror(v.band * 0.2, 10.0, v.t_c, 100.0 + v.depth_m)}, 9)


def _energy(v, keep):
    z = energy.cole_cole(v.size, 0.01 + 0.1 * v.phi, v.phi, 0.2, 0.5)
    a = energy.apparent_conductivity(z, 12.0)
    return {
        "yukawa": energy.yukawa(1.0 + v.phi, 2.0, 3.0, v.phi), "born": energy.born(1.0, 1.0 + v.phi, 2.0, 80.0), "rate": energy.diffusion_rate(v.phi, v.k_dry), "re": z.re, "im": z.im, "a_re": a.re, "a_im": a.im,
        "level": energy.level_material(v.phi - 0.15, 2.0, 1.0), "pekeris": energy.pekeris(0.13 + 0.05 * v.phi, 314.159, 100.0, 1500.0, 1800.0, 1000.0, 1500.0), "modes": energy.pekeris_modes(10.0 * v.size, 100.0, 1500.0, 1800.0),
        "east": energy.field_direction(90.0 * v.phi, v.size)[0], "north": energy.field_direction(90.0 * v.phi, v.size)[1], "up": energy.field_direction(90.0 * v.phi, v.size)[2],
    }


projection("field_closed_forms", "rock", ["obs_id"], _energy)


def _riemann_wave(v, keep):
    return {"wave": energy.wave_function(0.3 + v.phi, 1.0, 0.4, 1.0), "hll_mass": energy.hll(*energy.gas_state(1.0, v.phi, 1.0), *energy.gas_state(0.125, 0.0, 0.1))[0], "hll_momentum": energy.hll(*energy.gas_state(1.0, v.phi, 1.0), *energy.gas_state(0.125, 0.0, 0.1))[1], "hll_energy": energy.hll(*energy.gas_state(1.0, v.phi, 1.0), *energy.gas_state(0.125, 0.0, 0.1))[2]}


projection("gas_waves", "rock", ["obs_id"], _riemann_wave)
