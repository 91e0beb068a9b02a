"""Queries of steppers and misfits. The SQL unrolls a march into one window query per step."""

from __future__ import annotations

from isobath.operators import misfits, steppers
from isobath.plans.relational import rounded
from isobath.plans.views import view, view_sql
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}
STEPS = 8
_TRACE = view_sql("trace")


def packed(spark, sf_dir, scale: float = 500.0):
    t = view(spark, sf_dir, "trace").select("trace_id", "t_idx", (F.col("y") / scale).alias("y"))
    return t.groupBy("trace_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("t_idx", "y"))), lambda s: s["y"]).alias("u"))


def _march(name: str, stencil, step_sql: str, steps: int = STEPS, digits: int = 9, start: str = "y / 500e0") -> None:
    """step_sql uses u, l, r, ll, rr (neighbours, periodic), i and n."""

    def run(spark, sf_dir):
        done = steppers.march(packed(spark, sf_dir), "u", steps, stencil)
        long = done.select("trace_id", F.posexplode("u").alias("i", "v"))
        return long.select("trace_id", F.col("i").cast("long").alias("i"), F.round("v", digits).alias("u"))

    sql = f"(SELECT trace_id, t_idx AS i, count(*) OVER (PARTITION BY trace_id) AS n, {start} AS u FROM {_TRACE} v)"
    ends = "max(CASE WHEN i = {k} THEN u END) OVER (PARTITION BY trace_id)"
    for _ in range(steps):
        w = "OVER (PARTITION BY trace_id ORDER BY i)"
        near = f"coalesce(lag(u) {w}, {ends.format(k='n - 1')}) AS l, coalesce(lead(u) {w}, {ends.format(k='0')}) AS r, coalesce(lag(u, 2) {w}, CASE WHEN i = 0 THEN {ends.format(k='n - 2')} ELSE {ends.format(k='n - 1')} END) AS ll, coalesce(lead(u, 2) {w}, CASE WHEN i = n - 1 THEN {ends.format(k='1')} ELSE {ends.format(k='0')} END) AS rr"
        sql = f"(SELECT trace_id, i, n, {step_sql} AS u FROM (SELECT *, {near} FROM {sql} a) b)"
    QUERIES[name] = run
    ORACLES[name] = f"SELECT trace_id, i, round(u, {digits}) AS u FROM {sql} z"


_march("heat_steps", steppers.diffusion(0.2371828, "neumann"), "u + 2371828e-7 * (CASE WHEN i = 0 THEN u ELSE l END - 2e0 * u + CASE WHEN i = n - 1 THEN u ELSE r END)")
_march("advection_steps", steppers.advection(0.3141593), "u - 3141593e-7 * (u - l)")
_march("advection_diffusion_steps", steppers.advection_diffusion(0.3141593, 0.1732051), "u - 3141593e-7 * (u - l) + 1732051e-7 * (l - 2e0 * u + r)")
_march("burgers_steps", steppers.burgers(0.1, 1.0, 0.2), "u + 2e-1 * (1e-1 * (l - 2e0 * u + r) - (r * r - l * l) / 4e0)")
_march("kdv_steps", steppers.kdv(1.0, 0.02), "u - 2e-2 * (6e0 * u * (r - l) / 2e0 + (rr - 2e0 * r + 2e0 * l - ll) / 2e0)")
_march("conservation_law_steps", steppers.conservation_law(lambda u: 0.5 * u * u, lambda u: u, 1.0, 0.2), "u - 2e-1 * ((25e-2 * (u * u + r * r) - 5e-1 * greatest(abs(u), abs(r)) * (r - u)) - (25e-2 * (l * l + u * u) - 5e-1 * greatest(abs(l), abs(u)) * (u - l)))")
_march("black_scholes_steps", steppers.black_scholes(0.2, 0.05, 1.0, 0.0005), "u + 5e-4 * CASE WHEN i = 0 THEN -5e-2 * u WHEN i = n - 1 THEN 5e-2 * i * (u - l) - 5e-2 * u ELSE 2e-2 * i * i * (l - 2e0 * u + r) + 5e-2 * i * (r - l) / 2e0 - 5e-2 * u END")


def _two(name: str, stencil, first: str, second: str, start: tuple[str, str], steps_sql: tuple[str, str], faces: str, pack, steps: int = STEPS) -> None:
    """A march of two fields."""

    def run(spark, sf_dir):
        done = steppers.march(pack(packed(spark, sf_dir)), "s", steps, stencil)
        long = done.select("trace_id", F.posexplode("s").alias("i", "v"))
        return long.select("trace_id", F.col("i").cast("long").alias("i"), *[F.round(f"v.{c}", 8).alias(c) for c in (first, second)])

    sql = f"(SELECT trace_id, t_idx AS i, count(*) OVER (PARTITION BY trace_id) AS n, {start[0]} AS {first}, {start[1]} AS {second} FROM {_TRACE} v)"
    for _ in range(steps):
        w = "OVER (PARTITION BY trace_id ORDER BY i)"
        near = ", ".join(f"coalesce(lag({c}) {w}, max(CASE WHEN i = n - 1 THEN {c} END) OVER (PARTITION BY trace_id)) AS l{c}, coalesce(lead({c}) {w}, max(CASE WHEN i = 0 THEN {c} END) OVER (PARTITION BY trace_id)) AS r{c}" for c in (first, second))
        sql = f"(SELECT trace_id, i, n, {steps_sql[0]} AS {first}, {steps_sql[1]} AS {second} FROM (SELECT *{faces} FROM (SELECT *, {near} FROM {sql} a) b) c)"
    QUERIES[name] = run
    ORACLES[name] = f"SELECT trace_id, i, round({first}, 8) AS {first}, round({second}, 8) AS {second} FROM {sql} z"


def _c(h, q):
    return f"(abs({q} / {h}) + sqrt(981e-2 * {h}))"


def _face(h0, q0, h1, q1):
    c = f"greatest({_c(h0, q0)}, {_c(h1, q1)})"
    p = lambda h, q: f"({q} * ({q} / {h}) + 4905e-3 * {h} * {h})"
    return f"(5e-1 * ({q0} + {q1}) - 5e-1 * {c} * ({h1} - {h0}))", f"(5e-1 * ({p(h0, q0)} + {p(h1, q1)}) - 5e-1 * {c} * ({q1} - {q0}))"


_right, _left = _face("h", "q", "rh", "rq"), _face("lh", "lq", "h", "q")
_two("shallow_water_steps", steppers.shallow_water(1.0, 0.05), "h", "q", ("1e0 + y / 500e0", "0e0"), (f"h - 5e-2 * ({_right[0]} - {_left[0]})", f"q - 5e-2 * ({_right[1]} - {_left[1]})"), "", lambda df: df.withColumn("s", F.transform("u", lambda x: F.struct((x + 1.0).alias("h"), F.lit(0.0).alias("q")))))
_two("wave_steps", steppers.wave(0.25, 0.01), "u", "w", ("y / 500e0", "y / 500e0"), ("2e0 * u - w + 25e-2 * (CASE WHEN i = 0 THEN 0e0 ELSE lu END - 2e0 * u + CASE WHEN i = n - 1 THEN 0e0 ELSE ru END) - 1e-2 * (u - w)", "u"), "", lambda df: df.withColumn("s", F.transform("u", lambda x: F.struct(x.alias("u"), x.alias("w")))))


def _pairs(spark, sf_dir):
    """Each trace with the next one, over their common length."""
    t = view(spark, sf_dir, "trace")
    nxt = t.select((F.col("trace_id") - 1).alias("trace_id"), "t_idx", F.col("y").alias("o"))
    return t.join(nxt, ["trace_id", "t_idx"]).select(F.col("trace_id").alias("pair"), F.col("t_idx").alias("t"), F.col("y").alias("p"), "o")


_PAIRS = f"pr AS (SELECT a.trace_id AS pair, a.t_idx AS t, a.y AS p, b.y AS o FROM {_TRACE} a JOIN {_TRACE} b ON b.trace_id = a.trace_id + 1 AND b.t_idx = a.t_idx)"
QUERIES["l2_misfit"] = lambda spark, sf_dir: rounded(misfits.misfit(_pairs(spark, sf_dir), "l2"), 4, "misfit")
ORACLES["l2_misfit"] = f"WITH {_PAIRS} SELECT pair, round(sum((p - o) * (p - o)), 4) AS misfit FROM pr GROUP BY pair"
QUERIES["xcorr_misfit"] = lambda spark, sf_dir: rounded(misfits.misfit(_pairs(spark, sf_dir), "xcorr"), 6, "misfit")
ORACLES["xcorr_misfit"] = f"""WITH {_PAIRS}, r AS (SELECT a.pair, a.t - b.t AS lag, sum(a.p * b.o) AS r FROM pr a JOIN pr b USING (pair) GROUP BY a.pair, a.t - b.t),
w AS (SELECT *, lag(r) OVER (PARTITION BY pair ORDER BY lag) AS b, lead(r) OVER (PARTITION BY pair ORDER BY lag) AS a, row_number() OVER (PARTITION BY pair ORDER BY r DESC, lag) AS top FROM r),
k AS (SELECT pair, CASE WHEN b IS NULL THEN lag + 1 WHEN a IS NULL THEN lag - 1 ELSE lag END AS lag FROM w WHERE top = 1)
SELECT w.pair, round((lag + 5e-1 * (b - a) / (b - 2e0 * r + a - 1e-30)) * (lag + 5e-1 * (b - a) / (b - 2e0 * r + a - 1e-30)), 6) AS misfit FROM w JOIN k USING (pair, lag)"""
QUERIES["wasserstein_misfit"] = lambda spark, sf_dir: rounded(misfits.misfit(_pairs(spark, sf_dir), "w2"), 5, "misfit")
_dens = lambda c: f"SELECT pair, t, ({c} - min({c}) OVER (PARTITION BY pair) + 1e-12) / sum({c} - lo{c} + 1e-12) OVER (PARTITION BY pair) AS d FROM lo"
_quant = lambda d: f"SELECT pair, u, t - 1 + least(greatest((u - c0) / (c - c0 + 1e-30), 0e0), 1e0) AS q FROM (SELECT pair, u, t, c, c0, row_number() OVER (PARTITION BY pair, u ORDER BY CASE WHEN c >= u THEN 0 ELSE 1 END, CASE WHEN c >= u THEN t ELSE -t END) AS rn FROM (SELECT pair, t, sum(d) OVER w AS c, sum(d) OVER (PARTITION BY pair ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c0 FROM {d} WINDOW w AS (PARTITION BY pair ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) s JOIN us USING (pair) WHERE c0 IS NOT NULL) z WHERE rn = 1"
ORACLES["wasserstein_misfit"] = f"""WITH {_PAIRS}, lo AS (SELECT *, min(p) OVER (PARTITION BY pair) AS lop, min(o) OVER (PARTITION BY pair) AS loo FROM pr),
dp AS ({_dens('p')}), dd AS ({_dens('o')}), ms AS (SELECT pair, greatest(2 * count(*), 256) AS m FROM pr GROUP BY pair),
us AS (SELECT pair, (unnest(range(m)) + 5e-1) / m AS u FROM ms), qp AS ({_quant('dp')}), qo AS ({_quant('dd')})
SELECT pair, round(avg((qp.q - qo.q) * (qp.q - qo.q)), 5) AS misfit FROM qp JOIN qo USING (pair, u) GROUP BY pair"""
QUERIES["envelope_misfit"] = lambda spark, sf_dir: rounded(misfits.misfit(_pairs(spark, sf_dir), "envelope"), 4, "misfit")


ORACLES["envelope_misfit"] = f"""WITH {_PAIRS}, c AS (SELECT *, count(*) OVER (PARTITION BY pair) AS n FROM pr),
x AS (SELECT a.pair, a.t, a.n, a.p, a.o, b.p AS ps, b.o AS os, pi() * (a.t - b.t) / a.n AS x, (a.n - 1) // 2 AS top FROM c a JOIN c b USING (pair)),
h AS (SELECT pair, t, p, o, sum(ps * w) AS hp, sum(os * w) AS ho FROM (SELECT *, CASE WHEN x = 0 THEN 0e0 ELSE 2e0 / n * sin(top * x) * sin((top + 1) * x) / sin(x) END AS w FROM x) q GROUP BY pair, t, p, o)
SELECT pair, round(sum(power(sqrt(p * p + hp * hp) - sqrt(o * o + ho * ho), 2)), 4) AS misfit FROM h GROUP BY pair"""


def _poisson(spark, sf_dir):
    """-u'' = f on each trace's samples with u = 0 beyond both ends."""
    p = packed(spark, sf_dir)
    n = F.size("u")
    p = p.withColumn("lo", F.transform("u", lambda _x, i: F.when(i > 0, -1.0).otherwise(0.0))).withColumn("di", F.transform("u", lambda _x: F.lit(2.0))).withColumn("up", F.transform("u", lambda _x, i: F.when(i < n - 1, -1.0).otherwise(0.0)))
    solved = p.withColumn("x", steppers.thomas(F.col("u"), F.col("lo"), F.col("di"), F.col("up")))
    long = solved.select("trace_id", F.posexplode("x").alias("i", "v"))
    return long.select("trace_id", F.col("i").cast("long").alias("i"), F.round("v", 7).alias("u"))


QUERIES["poisson_1d"] = _poisson
ORACLES["poisson_1d"] = f"""WITH t AS (SELECT trace_id, t_idx + 1 AS i, y / 500e0 AS f, count(*) OVER (PARTITION BY trace_id) + 1 AS m FROM {_TRACE} v)
SELECT a.trace_id, a.i - 1 AS i, round(sum(b.f * least(a.i, b.i) * (a.m - greatest(a.i, b.i)) / a.m), 7) AS u FROM t a JOIN t b USING (trace_id) GROUP BY a.trace_id, a.i"""


def _mt(spark, sf_dir):
    layers = view(spark, sf_dir, "layer").select("column_id", "layer", "dz", (F.col("cond") / 100.0).alias("sigma"))
    freqs = spark.range(1, 6).select(F.pow(F.lit(10.0), F.col("id") - 3.0).alias("freq"))
    return rounded(steppers.layered_impedance(layers, freqs), 5, "rho_a", "phase", "freq")


QUERIES["layered_mt"] = _mt
_LAYER = view_sql("layer")
ORACLES["layered_mt"] = f"""WITH RECURSIVE l AS (SELECT column_id, layer, dz, cond / 100e0 AS s, max(layer) OVER (PARTITION BY column_id) AS deep FROM {_LAYER} v),
f AS (SELECT power(10e0, i - 3e0) AS freq, 2e0 * pi() * power(10e0, i - 3e0) * 4e-7 * pi() AS w FROM range(1, 6) t(i)),
g(column_id, freq, w, layer, re, im) AS (
  SELECT column_id, freq, w, layer, sqrt(w / (2e0 * s)), sqrt(w / (2e0 * s)) FROM l, f WHERE layer = deep
  UNION ALL
  SELECT column_id, freq, w, layer, a * (qr - qi), a * (qr + qi) FROM (
    SELECT *, (ur * vr + ui * vi) / (vr * vr + vi * vi) AS qr, (ui * vr - ur * vi) / (vr * vr + vi * vi) AS qi FROM (
      SELECT *, 1e0 - er AS ur, -ei AS ui, 1e0 + er AS vr, ei AS vi FROM (
        SELECT *, exp(-x) * (rr * cos(x) + ri * sin(x)) AS er, exp(-x) * (ri * cos(x) - rr * sin(x)) AS ei FROM (
          SELECT *, ((a - re) * (a + re) + (a - im) * (a + im)) / ((a + re) * (a + re) + (a + im) * (a + im)) AS rr, ((a - im) * (a + re) - (a - re) * (a + im)) / ((a + re) * (a + re) + (a + im) * (a + im)) AS ri FROM (
            SELECT l.column_id, g.freq, g.w, l.layer, g.re, g.im, sqrt(g.w / (2e0 * l.s)) AS a, 2e0 * sqrt(g.w / (2e0 * l.s)) * l.s * l.dz AS x FROM g JOIN l ON l.column_id = g.column_id AND l.layer = g.layer - 1) q1) q2) q3) q4) q5)
SELECT column_id, round(freq, 5) AS freq, round((re * re + im * im) / w, 5) AS rho_a, round(degrees(atan2(im, re)), 5) AS phase FROM g WHERE layer = 0"""
