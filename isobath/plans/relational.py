"""Queries of operators that join, window or aggregate, each with SQL written on its own."""

from __future__ import annotations

import math

from isobath.functions import atmosphere, ocean, potential
from isobath.functions import scattering
from isobath.functions.algebra import Sql
from isobath.operators import fields, grids, profiles, spectra, tree
from isobath.plans.views import view, view_sql
from pyspark.sql import Window
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}
RADIUS = 250.0
B = fields.direction(60.0, 5.0)


def query(name: str, oracle: str | None = None):
    def put(run):
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return put


def rounded(df, digits: int, *columns: str):
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


_speed = Sql.of(ocean.mackenzie(Sql("t_c"), Sql("s_ppt"), Sql("depth_m")))


@query("sound_speed_bins", f"SELECT CAST(floor(depth_m / 1000e0) AS BIGINT) AS km, CAST(count(*) AS BIGINT) AS n, round(min({_speed}), 4) AS least, round(avg({_speed}), 4) AS mean, round(max({_speed}), 4) AS most FROM {view_sql('ctd')} v GROUP BY 1")
def sound_speed_bins(spark, sf_dir):
    c = ocean.mackenzie(F.col("t_c"), F.col("s_ppt"), F.col("depth_m"))
    bins = view(spark, sf_dir, "ctd").select(F.floor(F.col("depth_m") / 1000.0).cast("long").alias("km"), c.alias("c"))
    return bins.groupBy("km").agg(F.count("*").alias("n"), *[F.round(f("c"), 4).alias(n) for n, f in (("least", F.min), ("mean", F.avg), ("most", F.max))])


def _values(rows, names) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(Sql.of(float(x)) for x in r) + ')' for r in rows)}) AS t({', '.join(names)})"


_gas_args = [Sql(c) for c in ("f_ghz", "p_hpa", "e_hpa", "theta")]
_e_sql = Sql.of(atmosphere.vapour_pressure(Sql("humidity"), Sql("(t_k - 273.15e0)")))
_ox = Sql.of(atmosphere.oxygen_line(*_gas_args, [Sql(c) for c in ("f0", "c1", "c2", "c3", "c4", "c5")]))
_wv = Sql.of(atmosphere.vapour_line(*_gas_args, [Sql(c) for c in ("f0", "c1", "c2", "c3", "c4", "c5", "c6")]))
_dry = Sql.of(atmosphere.dry_continuum(*_gas_args))


@query(
    "gaseous_attenuation",
    f"""WITH a AS (SELECT obs_id, f_ghz, p_hpa, {_e_sql} AS e_hpa, 300e0 / t_k AS theta FROM {view_sql('air')} v),
o AS (SELECT obs_id, sum({_ox}) AS o FROM a, {_values(atmosphere.OXYGEN_LINES, ['f0', 'c1', 'c2', 'c3', 'c4', 'c5'])} GROUP BY obs_id),
w AS (SELECT obs_id, sum({_wv}) AS w FROM a, {_values(atmosphere.VAPOUR_LINES, ['f0', 'c1', 'c2', 'c3', 'c4', 'c5', 'c6'])} GROUP BY obs_id)
SELECT obs_id, round(182e-3 * f_ghz * (o + {_dry}), 6) AS oxygen_db, round(182e-3 * f_ghz * w, 6) AS vapour_db, round(182e-3 * f_ghz * (o + {_dry}) + 182e-3 * f_ghz * w, 6) AS total_db
FROM a JOIN o USING (obs_id) JOIN w USING (obs_id)""",
)
def gaseous_attenuation(spark, sf_dir):
    air = view(spark, sf_dir, "air").withColumn("e_hpa", atmosphere.vapour_pressure(F.col("humidity"), F.col("t_k") - 273.15))
    return rounded(spectra.gaseous(air), 6, "oxygen_db", "vapour_db", "total_db")


@query(
    "rain_attenuation",
    f"""WITH t AS (SELECT * FROM {_values(atmosphere.RAIN, ['f', 'kh', 'ah', 'kv', 'av'])}),
n AS (SELECT ln(f) AS x0, ln(kv) AS y0, av AS a0, ln(lead(f) OVER (ORDER BY f)) AS x1, ln(lead(kv) OVER (ORDER BY f)) AS y1, lead(av) OVER (ORDER BY f) AS a1 FROM t),
r AS (SELECT obs_id, rain_mm_h, least(greatest(ln(f_ghz), 0e0), ln(100e0)) AS x FROM {view_sql('air')} v)
SELECT obs_id, round(exp(y0 + (x - x0) / (x1 - x0) * (y1 - y0)) * power(rain_mm_h, a0 + (x - x0) / (x1 - x0) * (a1 - a0)), 6) AS attenuation
FROM r JOIN n ON x >= x0 AND (x < x1 OR (x = x1 AND x1 = ln(100e0)))""",
)
def rain_attenuation(spark, sf_dir):
    return rounded(spectra.rain_attenuation(view(spark, sf_dir, "air"), spectra.lines_table(spark, atmosphere.RAIN, "f"), "v"), 6, "attenuation")


_trace = view_sql("trace")


@query(
    "duct_layers",
    f"""WITH p AS (SELECT trace_id, 10e0 * t_idx AS z, y AS m FROM {_trace} v),
d AS (SELECT trace_id, (lead(m) OVER w - m) / (lead(z) OVER w - z) AS g FROM p WINDOW w AS (PARTITION BY trace_id ORDER BY z))
SELECT trace_id, CAST(count(*) FILTER (WHERE g < -1e0) AS BIGINT) AS ducts, CAST(count(*) AS BIGINT) AS intervals FROM d WHERE g IS NOT NULL GROUP BY trace_id""",
)
def duct_layers(spark, sf_dir):
    p = view(spark, sf_dir, "trace").select("trace_id", (10.0 * F.col("t_idx")).alias("z"), F.col("y").alias("m"))
    found = profiles.duct_layers(p, "trace_id", "z", "m", 1.0)
    return found.groupBy("trace_id").agg(F.sum(F.col("duct").cast("long")).alias("ducts"), F.count("*").alias("intervals"))


@query(
    "field_interp",
    f"""WITH p AS (SELECT trace_id, 10e0 * t_idx AS z, y AS v FROM {_trace} q),
g AS (SELECT trace_id, 7e0 * i - 20e0 AS z FROM (SELECT DISTINCT trace_id FROM p), range(120) r(i)),
n AS (SELECT trace_id, z AS z0, v AS v0, lead(z) OVER w AS z1, lead(v) OVER w AS v1, row_number() OVER w AS rn, count(*) OVER (PARTITION BY trace_id) AS nn FROM p WINDOW w AS (PARTITION BY trace_id ORDER BY z))
SELECT g.trace_id, g.z, round(CASE WHEN g.z < z0 THEN v0 WHEN z1 IS NULL THEN v0 ELSE v0 + (g.z - z0) / (z1 - z0) * (v1 - v0) END, 6) AS v
FROM g JOIN n ON g.trace_id = n.trace_id AND ((g.z >= z0 AND (g.z < z1 OR z1 IS NULL)) OR (rn = 1 AND g.z < z0))""",
)
def field_interp(spark, sf_dir):
    p = view(spark, sf_dir, "trace").select("trace_id", (10.0 * F.col("t_idx")).alias("z"), F.col("y").alias("v"))
    grid = p.select("trace_id").distinct().withColumn("z", F.explode(F.transform(F.sequence(F.lit(0), F.lit(119)), lambda i: 7.0 * i - 20.0)))
    return rounded(profiles.interpolate(profiles.check_ascending(p, "trace_id", "z"), grid, "trace_id", "z", "v"), 6, "v")


@query(
    "seabed_mask",
    f"""WITH floors AS (SELECT DISTINCT i AS ir, 300e0 + 10e0 * i AS depth FROM {view_sql('cell')} c)
SELECT cell_id, ir, -z > depth AS outside, round(CASE WHEN -z > depth THEN -9999e0 ELSE rho END, 6) AS filled FROM {view_sql('cell')} c JOIN floors ON i = ir""",
)
def seabed_mask(spark, sf_dir):
    grid = view(spark, sf_dir, "cell").select("cell_id", F.col("i").alias("ir"), (-F.col("z")).alias("z"), "rho")
    floor = grid.select("ir", (300.0 + 10.0 * F.col("ir")).alias("depth")).distinct()
    return profiles.seabed_mask(grid, floor).select("cell_id", "ir", "outside", F.round(profiles.apply_mask(F.col("rho"), F.col("outside"), -9999.0), 6).alias("filled"))


@query(
    "assemble_field",
    f"""WITH p AS (SELECT CAST(trace_id AS DOUBLE) * 100 AS range_m, 10e0 * t_idx AS z, y AS v FROM {_trace} q),
d AS (SELECT i AS iz, 5e0 * i AS z FROM range(60) t(i)), r AS (SELECT i AS ir, 293e0 * i AS range_m FROM range(50) t(i)),
n AS (SELECT range_m, z AS z0, v AS v0, lead(z) OVER w AS z1, lead(v) OVER w AS v1 FROM p WINDOW w AS (PARTITION BY range_m ORDER BY z)),
c AS (SELECT n.range_m, iz, CASE WHEN z1 IS NULL THEN v0 ELSE v0 + (z - z0) / (z1 - z0) * (v1 - v0) END AS v FROM d JOIN n ON z >= z0 AND (z < z1 OR z1 IS NULL)),
m AS (SELECT iz, range_m AS r0, v AS v0, lead(range_m) OVER w AS r1, lead(v) OVER w AS v1, row_number() OVER w AS rn FROM c WINDOW w AS (PARTITION BY iz ORDER BY range_m))
SELECT CAST(iz * 50 + ir AS BIGINT) AS node, CAST(iz AS BIGINT) AS iz, CAST(ir AS BIGINT) AS ir, round(CASE WHEN range_m < r0 OR r1 IS NULL THEN v0 ELSE v0 + (range_m - r0) / (r1 - r0) * (v1 - v0) END, 6) AS v
FROM r JOIN m ON (range_m >= r0 AND (range_m < r1 OR r1 IS NULL)) OR (rn = 1 AND range_m < r0)""",
)
def assemble_field(spark, sf_dir):
    p = view(spark, sf_dir, "trace").select((100.0 * F.col("trace_id")).alias("range_m"), (10.0 * F.col("t_idx")).alias("z"), F.col("y").alias("v"))
    depths = spark.range(60).select(F.col("id").alias("iz"), (5.0 * F.col("id")).alias("z"))
    ranges = spark.range(50).select(F.col("id").alias("ir"), (293.0 * F.col("id")).alias("range_m"))
    return rounded(profiles.assemble_field(p, depths, ranges), 6, "v")


@query(
    "geotherm",
    f"""WITH l AS (SELECT * FROM {view_sql('layer')} v),
f AS (SELECT *, 6e-2 - coalesce(sum(heat * dz) OVER (PARTITION BY column_id ORDER BY layer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS q FROM l)
SELECT column_id, layer, sum(dz) OVER w AS depth, round(10e0 + sum((q * dz - 5e-1 * heat * dz * dz) / cond) OVER w, 6) AS temperature FROM f WINDOW w AS (PARTITION BY column_id ORDER BY layer)""",
)
def geotherm(spark, sf_dir):
    return rounded(profiles.geotherm(view(spark, sf_dir, "layer")), 6, "temperature")


_reactions = ", ".join(f"({34.0 + 2.0 * i}e0, {w}e0)" for i, w in enumerate(profiles.EASYRO_WEIGHTS))


@query(
    "vitrinite_reflectance",
    f"""WITH h AS (SELECT trace_id AS horizon, CAST(t_idx AS DOUBLE) AS t, 20e0 + y / 3e0 + 273.15e0 AS k FROM {_trace} v),
s AS (SELECT horizon, t - lag(t) OVER w AS dt, 5e-1 * (k + lag(k) OVER w) AS mid FROM h WINDOW w AS (PARTITION BY horizon ORDER BY t)),
r AS (SELECT horizon, e, wt, sum(1e13 * exp(-e / ({profiles.GAS_CONSTANT}e0 * mid)) * dt * {profiles.SECONDS_A_MYR}e0) AS x FROM s, (VALUES {_reactions}) AS q(e, wt) WHERE dt IS NOT NULL GROUP BY horizon, e, wt)
SELECT horizon, round(exp(-16e-1 + 37e-1 * sum(wt * (1e0 - exp(-x)))), 6) AS ro FROM r GROUP BY horizon""",
)
def vitrinite_reflectance(spark, sf_dir):
    h = view(spark, sf_dir, "trace").select(F.col("trace_id").alias("horizon"), F.col("t_idx").cast("double").alias("t_ma"), (20.0 + F.col("y") / 3.0).alias("temp_c"))
    return rounded(profiles.easy_ro(h), 6, "ro")


@query(
    "knife_edge",
    f"""WITH v AS (SELECT i, i / 5e0 - 2e0 AS v FROM range(21) t(i)), w AS (SELECT i, v, k, v * k / 2000e0 AS t, CASE WHEN k IN (0, 2000) THEN 1e0 WHEN k % 2 = 1 THEN 4e0 ELSE 2e0 END AS wt FROM v, range(2001) t(k)),
f AS (SELECT i, v, sum(wt * cos(t * t * {0.5 * math.pi!r}e0)) * v / 6000e0 AS c, sum(wt * sin(t * t * {0.5 * math.pi!r}e0)) * v / 6000e0 AS s FROM w GROUP BY i, v)
SELECT CAST(i AS BIGINT) AS i, round(c, 6) AS fresnel_c, round(s, 6) AS fresnel_s, round({Sql.of(scattering.knife_edge(Sql('c'), Sql('s')))}, 6) AS loss_db FROM f""",
)
def knife_edge(spark, sf_dir):
    made = profiles.simpson_fresnel(spark.range(21).select(F.col("id").alias("i"), (F.col("id") / 5.0 - 2.0).alias("v")))
    return made.select("i", F.round("fresnel_c", 6).alias("fresnel_c"), F.round("fresnel_s", 6).alias("fresnel_s"), F.round(scattering.knife_edge(F.col("fresnel_c"), F.col("fresnel_s")), 6).alias("loss_db"))


_d = [Sql(f"d{c}") for c in "xyz"]
_pairs_sql = f"(SELECT *, greatest(sqrt(dx * dx + dy * dy + dz * dz), 1e-6) AS r FROM (SELECT s.obs_id, c.*, s.x - c.x AS dx, s.y - c.y AS dy, s.z - c.z AS dz FROM {view_sql('station')} s, {view_sql('cell')} c) q) p"
GG, MG = ("xx", "xy", "xz", "yy", "yz", "zz"), ("xx", "xy", "xz", "yy", "yz")



def _forward(name: str, kernels: dict, digits: int):
    columns = ", ".join(f"round(sum({Sql.of(k(_d, Sql('r'), Sql('volume')))} * {prop}), {digits}) AS {n}" for n, (k, prop) in kernels.items())
    ORACLES[name] = f"SELECT obs_id, {columns} FROM {_pairs_sql} GROUP BY obs_id"
    QUERIES[name] = lambda spark, sf_dir: rounded(fields.forward(view(spark, sf_dir, "station"), view(spark, sf_dir, "cell"), kernels), digits, *kernels)


_forward("gravity_anomaly", {"gz": (potential.gravity, "rho")}, 6)
_forward("magnetic_tmi", {"tmi": (lambda d, r, v: potential.magnetic_total(d, r, v, B), "kappa")}, 4)
_forward("gravity_gradients", {f"t{n}": (lambda d, r, v, n=n: potential.gravity_gradient(d, r, v, n), "rho") for n in GG}, 4)
_forward("magnetic_vector", {f"b{n}": (lambda d, r, v, n=n: potential.magnetic_vector(d, r, v, B, n), "kappa") for n in "xyz"}, 4)
_forward("magnetic_gradient", {f"b{n}": (lambda d, r, v, n=n: potential.magnetic_gradient(d, r, v, B, n), "kappa") for n in MG}, 5)


def _far_field(spark, sf_dir):
    """gravity_anomaly by the octree, to the digits that the distant boxes keep."""
    found = tree.forward(view(spark, sf_dir, "station"), view(spark, sf_dir, "cell"), {"gz": (potential.gravity, "rho")}, theta=0.3, order=5)
    return rounded(found, 3, "gz")


QUERIES["gravity_far_field"] = _far_field
ORACLES["gravity_far_field"] = ORACLES["gravity_anomaly"].replace(", 6) AS gz", ", 3) AS gz")


_zz = Sql.of(potential.gravity_gradient([Sql(f"d{c}") for c in "xyz"], Sql("r"), Sql("volume"), "zz"))


@query("trace_free_check", f"SELECT obs_id, CAST(count(*) AS BIGINT) AS cells, round(sum({_zz} * rho), 4) AS zz, round(sum({_zz} * rho), 4) AS left_of_xx_yy FROM {_pairs_sql} GROUP BY obs_id")
def trace_free_check(spark, sf_dir):
    """The gradient tensor has no trace: zz, and what xx and yy leave of it, both against zz in SQL."""
    g = potential.gravity_gradient
    kernels = {"zz": (lambda d, r, v: g(d, r, v, "zz"), "rho"), "left_of_xx_yy": (lambda d, r, v: potential.trace_free_zz(g(d, r, v, "xx"), g(d, r, v, "yy")), "rho")}
    made = fields.forward(view(spark, sf_dir, "station"), view(spark, sf_dir, "cell"), kernels, "cells")
    return rounded(made.select("obs_id", "cells", *kernels), 4, *kernels)


@query(
    "depth_weighting",
    f"""WITH c AS (SELECT * FROM {view_sql('cell')} v), l AS (SELECT lead(z) OVER (ORDER BY z) - z AS gap FROM (SELECT DISTINCT round(z, 6) AS z FROM c)),
e AS (SELECT coalesce(5e-1 * min(gap), 5e-1) AS eps FROM l), w AS (SELECT cell_id, power(abs(z - 50e0) + eps, -1e0) AS w FROM c, e)
SELECT cell_id, round(w / max(w) OVER (), 8) AS weight FROM w""",
)
def depth_weighting(spark, sf_dir):
    return fields.depth_weights(view(spark, sf_dir, "cell"), 50.0, 2.0).select("cell_id", F.round("weight", 8).alias("weight"))


_near = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


@query("tile_stats", f"SELECT a.cell_id AS tile, CAST(count(*) AS BIGINT) AS members, round(avg(b.rho), 6) AS mean FROM {view_sql('cell')} a, {view_sql('cell')} b WHERE {_near} <= {RADIUS}e0 GROUP BY a.cell_id")
def tile_stats(spark, sf_dir):
    return rounded(fields.tiles(view(spark, sf_dir, "cell"), RADIUS, "rho"), 6, "mean")


@query("nearest_cell", f"SELECT obs_id, CAST(cell_id AS BIGINT) AS cell_id, round(d, 6) AS distance FROM (SELECT a.obs_id, b.cell_id, {_near} AS d, row_number() OVER (PARTITION BY a.obs_id ORDER BY {_near}, b.cell_id) AS rn FROM {view_sql('station')} a, {view_sql('cell')} b) q WHERE rn = 1")
def nearest_cell(spark, sf_dir):
    return rounded(fields.nearest(view(spark, sf_dir, "station"), view(spark, sf_dir, "cell")), 6, "distance")


@query("tile_topk", f"SELECT obs_id, CAST(cell_id AS BIGINT) AS cell_id, CAST(rn AS BIGINT) AS rank, round(d, 6) AS distance FROM (SELECT a.obs_id, b.cell_id, {_near} AS d, row_number() OVER (PARTITION BY a.obs_id ORDER BY {_near}, b.cell_id) AS rn FROM {view_sql('station')} a, {view_sql('cell')} b) q WHERE rn <= 6")
def tile_topk(spark, sf_dir):
    return rounded(fields.top_tiles(view(spark, sf_dir, "station"), view(spark, sf_dir, "cell"), 6), 6, "distance")


@query(
    "ray_lengths",
    f"""WITH s AS (SELECT obs_id AS ray, x AS x0, y AS y0, lead(x) OVER (ORDER BY obs_id) AS x1, lead(y) OVER (ORDER BY obs_id) AS y1 FROM {view_sql('station')} v),
w AS (SELECT ray, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) / 63e0 AS len, greatest(least(round_even((x0 + (x1 - x0) * (k / 63e0)) / 90e0, 0), 19e0), 0e0) AS i, greatest(least(round_even((y0 + (y1 - y0) * (k / 63e0)) / 90e0, 0), 19e0), 0e0) AS j FROM s, range(64) t(k) WHERE x1 IS NOT NULL)
SELECT ray, CAST(i * 20 + j AS BIGINT) AS cell, round(count(*) * min(len), 6) AS length FROM w GROUP BY ray, i, j""",
)
def ray_lengths(spark, sf_dir):
    order = Window.orderBy("obs_id")
    s = view(spark, sf_dir, "station")
    rays = s.select(F.col("obs_id").alias("ray"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(order).alias("x1"), F.lead("y").over(order).alias("y1")).filter("x1 is not null")
    return rounded(fields.ray_lengths(rays, (20, 20), 90.0), 6, "length")


_AX = ("i", "j", "k")


def _grad_sql(value: str, axis: str) -> str:
    others = ", ".join(a for a in _AX if a != axis)
    w = f"OVER (PARTITION BY {others} ORDER BY {axis})"
    return f"coalesce((lead({value}) {w} - lag({value}) {w}) / 2e2, 0e0)"


_grads = ", ".join(f"{_grad_sql(m, a)} AS {m}_{a}" for m in ("rho", "kappa") for a in _AX)


@query("grid_gradient", f"SELECT cell_id, round(rho_i, 6) AS gi, round(rho_j, 6) AS gj, round(rho_k, 6) AS gk FROM (SELECT cell_id, {_grads} FROM {view_sql('cell')} c) q")
def grid_gradient(spark, sf_dir):
    made = view(spark, sf_dir, "cell")
    for a in _AX:
        made = grids.gradient(made, "rho", a, [o for o in _AX if o != a], 100.0, f"g{a}")
    return rounded(made.select("cell_id", "gi", "gj", "gk"), 6, "gi", "gj", "gk")


@query("cross_gradient", f"SELECT cell_id, round(rho_j * kappa_k - rho_k * kappa_j, 9) + 0e0 AS cross_0, round(rho_k * kappa_i - rho_i * kappa_k, 9) + 0e0 AS cross_1, round(rho_i * kappa_j - rho_j * kappa_i, 9) + 0e0 AS cross_2 FROM (SELECT cell_id, {_grads} FROM {view_sql('cell')} c) q")
def cross_gradient(spark, sf_dir):
    names = ["cross_0", "cross_1", "cross_2"]
    return rounded(grids.cross_gradient(view(spark, sf_dir, "cell"), "rho", "kappa", list(_AX), 100.0).select("cell_id", *names), 9, *names)


@query("divergence", f"SELECT cell_id, round(rho_i + kappa_j + rho_k, 6) AS divergence FROM (SELECT cell_id, {_grads} FROM {view_sql('cell')} c) q")
def divergence(spark, sf_dir):
    return rounded(grids.divergence(view(spark, sf_dir, "cell"), {"i": "rho", "j": "kappa", "k": "rho"}, 100.0).select("cell_id", "divergence"), 6, "divergence")


def _face_sql(values: str) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS axis, cell_id AS a, lead(cell_id) OVER (PARTITION BY {', '.join(o for o in _AX if o != a)} ORDER BY {a}) AS b, {values.format(w=f'OVER (PARTITION BY ' + ', '.join(o for o in _AX if o != a) + f' ORDER BY {a})')} FROM c" for a in _AX)


@query("roughness_norm", f"WITH c AS (SELECT * FROM {view_sql('cell')} v), f AS ({_face_sql('(lead(rho) {w} - rho) / 1e2 AS d')}) SELECT axis, round(sum(d * d), 6) AS roughness, CAST(count(*) AS BIGINT) AS faces FROM f WHERE b IS NOT NULL GROUP BY axis")
def roughness_norm(spark, sf_dir):
    return rounded(grids.roughness(view(spark, sf_dir, "cell"), "cell_id", "rho", list(_AX), 100.0), 6, "roughness")


_coo = f"""c AS (SELECT *, rho + 60e0 AS cond FROM {view_sql('cell')} v), f AS ({_face_sql('5e-1 * (lead(cond) {w} + cond) / 1e4 AS w')}),
x AS (SELECT min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1, min(k) AS k0, max(k) AS k1 FROM c),
rim AS (SELECT cell_id AS r, i IN (i0, i1) OR j IN (j0, j1) OR k IN (k0, k1) AS rim FROM c, x),
e AS (SELECT a AS r, a AS c, w AS v FROM f WHERE b IS NOT NULL UNION ALL SELECT a, b, -w FROM f WHERE b IS NOT NULL UNION ALL SELECT b, b, w FROM f WHERE b IS NOT NULL UNION ALL SELECT b, a, -w FROM f WHERE b IS NOT NULL),
coo AS (SELECT r, c, sum(v) AS v FROM (SELECT e.* FROM e JOIN rim USING (r) WHERE NOT rim UNION ALL SELECT r, r, 1e0 FROM rim WHERE rim) q GROUP BY r, c)"""


def _operator(spark, sf_dir):
    return grids.divergence_form(view(spark, sf_dir, "cell").withColumn("cond", F.col("rho") + 60.0), "cell_id", "cond", list(_AX), 100.0)


@query("divergence_form_coo", f"WITH {_coo} SELECT r, c, round(v, 9) AS v FROM coo")
def divergence_form_coo(spark, sf_dir):
    return rounded(_operator(spark, sf_dir), 9, "v")


@query("spmv_operator", f"WITH {_coo} SELECT coo.r, round(sum(v * kappa), 9) AS y FROM coo JOIN c ON coo.c = c.cell_id GROUP BY coo.r")
def spmv_operator(spark, sf_dir):
    x = view(spark, sf_dir, "cell").select(F.col("cell_id").alias("node"), F.col("kappa").alias("u"))
    return rounded(grids.matvec(_operator(spark, sf_dir), x), 9, "y")


def _mesh(spark, sf_dir):
    c = view(spark, sf_dir, "cell").filter("k = 0")
    nodes = c.select(F.col("cell_id").alias("node"), "x", "y")
    quads = c.filter("i < 19").select(F.col("cell_id").alias("a"), (F.col("cell_id") + 1).alias("b"), (F.col("cell_id") + 20).alias("c"), (F.col("cell_id") + 21).alias("d"), F.col("kappa"))
    quads = quads.join(nodes.select(F.col("node").alias("d")), "d", "left_semi")
    tri = quads.select(F.explode(F.array(F.struct(F.col("a").alias("n1"), F.col("b").alias("n2"), F.col("d").alias("n3"), "kappa"), F.struct(F.col("a").alias("n1"), F.col("d").alias("n2"), F.col("c").alias("n3"), "kappa"))).alias("t")).select("t.*")
    return nodes, tri


_tri = f"""c AS (SELECT * FROM {view_sql('cell')} v WHERE k = 0), q AS (SELECT c.cell_id AS a, c.kappa FROM c JOIN c d ON d.cell_id = c.cell_id + 21 WHERE c.i < 19),
tri AS (SELECT a AS n1, a + 1 AS n2, a + 21 AS n3, kappa FROM q UNION ALL SELECT a, a + 21, a + 20, kappa FROM q)"""


@query("boundary_nodes", f"WITH {_tri}, e AS (SELECT least(n1, n2) AS p, greatest(n1, n2) AS q FROM tri UNION ALL SELECT least(n2, n3), greatest(n2, n3) FROM tri UNION ALL SELECT least(n3, n1), greatest(n3, n1) FROM tri), r AS (SELECT p, q FROM e GROUP BY p, q HAVING count(*) = 1) SELECT CAST(p AS BIGINT) AS node FROM r UNION SELECT CAST(q AS BIGINT) FROM r")
def boundary_nodes(spark, sf_dir):
    return fields.boundary_nodes(_mesh(spark, sf_dir)[1])


@query(
    "fem_stiffness",
    f"""WITH {_tri}, n AS (SELECT cell_id, x, y FROM c),
g AS (SELECT t.*, p.x AS x1, p.y AS y1, q2.x AS x2, q2.y AS y2, r.x AS x3, r.y AS y3 FROM tri t JOIN n p ON p.cell_id = n1 JOIN n q2 ON q2.cell_id = n2 JOIN n r ON r.cell_id = n3),
b AS (SELECT *, abs(5e-1 * ((x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1))) AS area FROM g),
e AS (SELECT kappa, area, unnest([n1, n1, n1, n2, n2, n2, n3, n3, n3]) AS r, unnest([n1, n2, n3, n1, n2, n3, n1, n2, n3]) AS c,
  unnest([y2 - y3, y2 - y3, y2 - y3, y3 - y1, y3 - y1, y3 - y1, y1 - y2, y1 - y2, y1 - y2]) AS bi, unnest([y2 - y3, y3 - y1, y1 - y2, y2 - y3, y3 - y1, y1 - y2, y2 - y3, y3 - y1, y1 - y2]) AS bj,
  unnest([x3 - x2, x3 - x2, x3 - x2, x1 - x3, x1 - x3, x1 - x3, x2 - x1, x2 - x1, x2 - x1]) AS ci, unnest([x3 - x2, x1 - x3, x2 - x1, x3 - x2, x1 - x3, x2 - x1, x3 - x2, x1 - x3, x2 - x1]) AS cj FROM b)
SELECT CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, round(sum(kappa * (bi * bj + ci * cj) / (4e0 * area)), 9) AS v FROM e GROUP BY r, c""",
)
def fem_stiffness(spark, sf_dir):
    return rounded(fields.fem_stiffness(*_mesh(spark, sf_dir)), 9, "v")


@query(
    "q_of_omega",
    f"WITH m AS (SELECT i / 100e0 AS a, 10e0 * i AS wl FROM range(1, 6) t(i)), w AS (SELECT DISTINCT size AS omega FROM {view_sql('rock')} v) SELECT omega, round((1e0 + sum(a * omega * omega / (wl * wl + omega * omega))) / sum(a * omega * wl / (wl * wl + omega * omega)), 6) AS q FROM w, m GROUP BY omega",
)
def q_of_omega(spark, sf_dir):
    r = view(spark, sf_dir, "rock")
    mechanisms = spark.range(1, 6).select((F.col("id") / 100.0).alias("a"), (10.0 * F.col("id")).alias("omega_l"))
    return rounded(spectra.q_of_omega(r.select(F.col("size").alias("omega")).distinct(), mechanisms), 6, "q")
