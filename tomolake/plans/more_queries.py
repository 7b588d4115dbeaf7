"""Queries over calibrations, curves, bands, cores, masks, thin sections and relaxation, with their statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomolake.functions import physics as fx
from tomolake.operators import bands, calibrate, core, network, relaxation, sections, series, stats, stencil, textures
from tomolake.operators import components as comp
from tomolake.operators import labels as lab
from tomolake.operators import resample as res
from tomolake.operators import voxels as vox
from tomolake.plans import fixtures as fix
from tomolake.plans import voxel_queries  # noqa: F401  whose statements are used here
from tomolake.plans.fixtures import MAPS, PIXEL, POINTS, PORES, SERIES, VOX, dims, materials, voxels
from tomolake.plans.registry import ORACLES, query
from tomolake.sources.shared import written

S, D = SparkSession, DataFrame
WITH = f"WITH RECURSIVE {VOX}"

# --- stress curves: five tests over the suppliers, a line up to a knee, a plateau and a drop


def _curves(spark: S, d: str) -> D:
    s = fix.table(spark, d, "supplier")
    w = Window.partitionBy("test_id").orderBy("s_suppkey")
    c = s.withColumn("test_id", (F.col("s_suppkey") % 5).cast("long")).withColumn("step", F.row_number().over(w).cast("long"))
    i, knee = F.col("step"), 8 + F.col("test_id")
    stress = F.least(i, knee) * 50.0 - F.greatest(F.lit(0), i - knee - 4) * (6.0 * F.col("test_id"))
    wobble = (F.col("s_suppkey") % 7) * 0.01
    return c.select("test_id", "step", (i * 0.001).alias("axial"), (i * -0.0003).alias("lateral"), F.when(i <= knee, i * 0.0004).otherwise(knee * 0.0008 - i * 0.0004).alias("volumetric"), F.greatest(stress + wobble, F.lit(1.0)).alias("stress"))


CURVES = """c0 AS (SELECT CAST(s_suppkey % 5 AS BIGINT) AS test_id, s_suppkey, row_number() OVER (PARTITION BY s_suppkey % 5 ORDER BY s_suppkey) AS step FROM supplier),
c AS (SELECT test_id, step, step * 0.001::DOUBLE AS axial, step * -0.0003::DOUBLE AS side, CASE WHEN step <= 8 + test_id THEN step * 0.0004::DOUBLE ELSE (8 + test_id) * 0.0008::DOUBLE - step * 0.0004::DOUBLE END AS volumetric,
  greatest(least(step, 8 + test_id) * 50.0::DOUBLE - greatest(0, step - (8 + test_id) - 4) * (6.0::DOUBLE * test_id) + (s_suppkey % 7) * 0.01::DOUBLE, 1.0) AS stress FROM c0),
fit AS (SELECT test_id, regr_slope(stress, axial) AS m, regr_intercept(stress, axial) AS b FROM c WHERE step <= 5 GROUP BY test_id),
lim AS (SELECT c.test_id, coalesce(min(axial) FILTER (WHERE step > 5 AND n >= 10 AND abs(stress - (m * axial + b)) > 0.02 * abs(m * axial + b)), 0.002) AS lim
  FROM (SELECT *, count(*) OVER (PARTITION BY test_id) AS n FROM c) c JOIN fit USING (test_id) GROUP BY c.test_id),
few AS (SELECT c.*, lim, sum((axial <= lim)::INT) OVER (PARTITION BY test_id) < 5 AS few, max(stress) OVER (PARTITION BY test_id) AS top FROM c JOIN lim USING (test_id)),
e0 AS (SELECT test_id, regr_slope(stress, axial) AS m, regr_r2(stress, axial) AS r2 FROM few WHERE (few AND step <= 5) OR (NOT few AND axial <= lim) GROUP BY test_id),
sec AS (SELECT test_id, arg_min(stress / axial, step) AS secant FROM few WHERE stress >= top / 2 AND axial > 0 GROUP BY test_id),
e AS (SELECT test_id, least(greatest(CASE WHEN r2 < 0.9 THEN coalesce(secant, m) ELSE m END, 1e3), 2e5) AS youngs, r2 FROM e0 LEFT JOIN sec USING (test_id)),
pk AS (SELECT test_id, max(stress) AS peak_stress, arg_min(axial, step) FILTER (WHERE stress = top) AS peak_strain, min(step) FILTER (WHERE stress = top) AS peak_step, arg_max(volumetric, step) < max(volumetric) AS dilates FROM few GROUP BY test_id),
br AS (SELECT pk.*, CASE WHEN peak_stress > 0 THEN (peak_stress - low) / peak_stress ELSE 0 END AS brittleness, coalesce((peak_stress - low) / peak_stress >= 0.05, false) AS softens
  FROM pk JOIN (SELECT c.test_id, min(stress) AS low FROM c JOIN pk USING (test_id) WHERE step >= peak_step GROUP BY c.test_id) USING (test_id))"""


@query(f"WITH {CURVES} SELECT test_id, round(lim, 6) AS proportional_limit, round(youngs, 4) AS youngs, round(r2, 6) AS r2 FROM lim JOIN e USING (test_id)")
def k07_youngs_modulus(spark: S, d: str) -> D:
    """K06 and K07."""
    c = _curves(spark, d)
    e = calibrate.youngs_modulus(c)
    return calibrate.proportional_limit(c).withColumnRenamed("limit", "proportional_limit").join(e, "test_id").withColumn("youngs", F.round("youngs", 4))


@query(f"WITH {CURVES} SELECT test_id, round(least(greatest(-regr_slope(side, axial), 0), 0.499), 6) AS poisson FROM few WHERE axial <= lim AND axial > 0 GROUP BY test_id HAVING count(*) >= 5")
def k08_poisson_ratio(spark: S, d: str) -> D:
    return calibrate.poisson_ratio(_curves(spark, d))


@query(f"WITH {CURVES}, t AS (SELECT *, 3 * k AS k3 FROM (SELECT few.test_id, regr_slope(stress / 3, volumetric) AS k, count(*) AS n FROM few WHERE abs(volumetric) <= lim AND volumetric <> 0 GROUP BY few.test_id)), r AS (SELECT e.test_id, CASE WHEN n >= 5 AND k > 0 THEN least(greatest((3 * k - 2 * youngs / 2.5) / (6 * k + 2 * youngs / 2.5), 0), 0.499) END AS m, CASE WHEN dilates THEN 0.2125 ELSE 0.25 END AS own, brittleness AS br FROM e JOIN t USING (test_id) JOIN br USING (test_id)) SELECT test_id, round(coalesce(m, greatest(0.05, CASE WHEN br > 0.7 THEN least(own, 0.25) WHEN br < 0.3 THEN greatest(own, 0.3) ELSE own END)), 6) AS poisson FROM r")
def k08_poisson_from_moduli(spark: S, d: str) -> D:
    """The branch without lateral strains."""
    return calibrate.poisson_ratio(_curves(spark, d).withColumn("lateral", F.lit(None).cast("double")))


YIELD = """, gap AS (SELECT c.*, youngs, stress - youngs * (axial - 0.002) AS g, lag(stress - youngs * (axial - 0.002)) OVER w AS g0, lag(stress) OVER w AS s0 FROM c JOIN e USING (test_id) WINDOW w AS (PARTITION BY test_id ORDER BY step)),
y AS (SELECT gap.test_id, coalesce(arg_min(s0 + (stress - s0) * g0 / (g0 - g), step) FILTER (WHERE g0 > 0 AND g <= 0), arg_min(stress, step) FILTER (WHERE axial >= lim)) AS y FROM gap JOIN lim USING (test_id) GROUP BY gap.test_id)"""


@query(f"WITH {CURVES}{YIELD} SELECT test_id, round(y, 4) AS yield_strength, round(greatest(youngs * 0.0005, least(youngs * 0.01, CASE WHEN brittleness > 0.7 THEN greatest(y, 0.8 * peak_stress) WHEN brittleness < 0.3 THEN least(y, 0.6 * peak_stress) ELSE y END)), 4) AS bounded FROM y JOIN e USING (test_id) JOIN br USING (test_id)")
def k09_yield(spark: S, d: str) -> D:
    """K09 and W15, without and with its bounds."""
    c = written(_curves(spark, d), "curves")
    both = written(calibrate.yield_strength(c), "yields").join(calibrate.bounded_yield(c).withColumnRenamed("yield_strength", "bounded"), "test_id")
    return both.select("test_id", F.round("yield_strength", 4).alias("yield_strength"), F.round("bounded", 4).alias("bounded"))


@query(f"WITH {CURVES} SELECT test_id, round(peak_stress, 6) AS peak_stress, round(peak_strain, 6) AS peak_strain, round(brittleness, 6) AS brittleness, softens, dilates FROM br")
def k10_brittleness(spark: S, d: str) -> D:
    return calibrate.brittleness(_curves(spark, d))


FAILURES = "f AS (SELECT (s1 + s3) / 2 AS s, (s1 - s3) / 2 AS t FROM (SELECT 20 + (s_suppkey % 40) * 1.5 + {wobble} AS s1, 5 + (s_suppkey % 40) * 0.4 AS s3 FROM supplier))"


def _failures(spark: S, d: str, wobble: str) -> D:
    k = F.col("s_suppkey") % 40
    return fix.table(spark, d, "supplier").select((20 + k * 1.5 + F.expr(wobble)).cast("double").alias("sigma1"), (5 + k * 0.4).cast("double").alias("sigma3"))


@query("WITH " + FAILURES.format(wobble="(s_suppkey % 3) * 0.5") + ", q AS (SELECT count(*) AS n, regr_slope(t, s) AS m, regr_intercept(t, s) AS b, regr_r2(t, s) AS r2 FROM f) SELECT n, round(least(greatest(degrees(atan(m)), 15), 55), 6) AS friction_angle, round(least(greatest(b, 0.1), 100), 6) AS cohesion, round(r2, 6) AS r2 FROM q")
def k11_mohr_coulomb_line(spark: S, d: str) -> D:
    return calibrate.mohr_coulomb(_failures(spark, d, "(s_suppkey % 3) * 0.5"), as_line=True)


@query("WITH " + FAILURES.format(wobble="20 - (s_suppkey % 40) * 1.5 + (s_suppkey * 7) % 11 * 3") + ", q AS (SELECT count(*) AS n, regr_r2(t, s) AS r2, avg(s) AS m, exp(regr_intercept(ln(greatest(0.01, t)), ln(greatest(0.01, s)))) AS a, regr_slope(ln(greatest(0.01, t)), ln(greatest(0.01, s))) AS b FROM f), p AS (SELECT *, b * a * pow(m, b - 1) AS tan FROM q) SELECT n, round(least(greatest(degrees(atan(tan)), 15), 55), 6) AS friction_angle, round(least(greatest(greatest(0, a * pow(m, b) - tan * m), 0.1), 100), 6) AS cohesion, round(r2, 6) AS r2 FROM p")
def k11_mohr_coulomb_power(spark: S, d: str) -> D:
    """Failures far off a line: the tangent to the power law."""
    return calibrate.mohr_coulomb(_failures(spark, d, "20 - (s_suppkey % 40) * 1.5 + (s_suppkey * 7) % 11 * 3"), as_line=True)


STATES = "p AS (SELECT CAST(l_orderkey % 10 AS BIGINT) AS test_id, CAST(l_linenumber AS BIGINT) AS step, CAST(l_orderkey AS BIGINT) AS particle, CAST(l_quantity AS DOUBLE) AS y, 1.0 + l_suppkey % 3 AS volume, l_partkey % 4 <> 0 AS solid, CAST(l_extendedprice AS DOUBLE) AS force FROM lineitem), bx AS (SELECT t AS test_id, s AS step, 10.0 + s * 0.1 + t AS width, 20.0 - s AS height, 2000.0 - 3 * s * s AS volume FROM range(10) a(t), range(1, 8) b(s))"


@query("WITH " + STATES + ", s0 AS (SELECT test_id, min(step) AS s FROM p WHERE solid GROUP BY test_id), st AS (SELECT p.test_id, particle, y AS y0 FROM p JOIN s0 USING (test_id) WHERE solid AND step = s), m AS (SELECT p.test_id, step, avg(force / volume) AS stress, avg(y - y0) AS rise FROM p LEFT JOIN st USING (test_id, particle) WHERE solid GROUP BY p.test_id, step) SELECT bx.test_id, bx.step, round(coalesce(rise / 19.0, 0), 6) + 0.0 AS axial, round((width - (10.1 + bx.test_id)) / (10.1 + bx.test_id), 6) AS lateral, round((volume - 1997.0) / 1997.0, 6) + 0.0 AS volumetric, round(coalesce(stress, 7.5), 6) AS stress FROM bx LEFT JOIN m USING (test_id, step)")
def k12_state_curve(spark: S, d: str) -> D:
    """Particles are order lines, a state for each line number."""
    p = fix.table(spark, d, "lineitem").select((F.col("l_orderkey") % 10).alias("test_id"), F.col("l_linenumber").cast("long").alias("step"), F.col("l_orderkey").alias("particle"), F.col("l_quantity").cast("double").alias("y"), (1.0 + F.col("l_suppkey") % 3).alias("volume"), (F.col("l_partkey") % 4 != 0).alias("solid"), F.col("l_extendedprice").cast("double").alias("force"))
    b = spark.range(10).select(F.col("id").alias("test_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(7).cast("long"))).alias("step"))
    s = F.col("step")
    b = b.select("test_id", "step", (10.0 + s * 0.1 + F.col("test_id")).alias("width"), (20.0 - s).alias("height"), (2000.0 - 3 * s * s).alias("volume"))
    return calibrate.state_curve(p, b, 7.5)


# --- predictions from calibration points


@query(f"WITH {POINTS}, k AS (SELECT density AS kx, avg({{y}}) AS ky FROM pts WHERE poisson > 0 AND poisson < 0.5 GROUP BY density), sg AS (SELECT kx, ky, lead(kx) OVER o AS kx2, lead(ky) OVER o AS ky2 FROM k WINDOW o AS (ORDER BY kx)), w AS (SELECT CAST(p_partkey AS BIGINT) AS id, 1900 + p_size * 15.0 AS density FROM part), r AS (SELECT id, density, CASE WHEN density <= (SELECT min(kx) FROM k) THEN (SELECT arg_min(ky, kx) FROM k) WHEN density >= (SELECT max(kx) FROM k) THEN (SELECT arg_max(ky, kx) FROM k) ELSE ky + (ky2 - ky) * (density - kx) / (kx2 - kx) END AS y FROM w ASOF LEFT JOIN sg ON w.density >= sg.kx) SELECT id, round(density, 6) AS density, round(least(greatest(y, 0), 0.49), 6) AS poisson FROM r".format(y="poisson"))
def j14_poisson_by_density(spark: S, d: str) -> D:
    w = fix.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), (1900 + F.col("p_size") * 15.0).alias("density"))
    return calibrate.predict_by_density(w, fix.calibration(spark, d), "poisson").select("id", "density", "poisson")


@query(f"WITH {POINTS}, w AS (SELECT CAST(p_partkey AS BIGINT) AS id, 1900 + p_size * 15.0 AS density, (p_partkey % 12) + 0.4 AS pressure FROM part), c AS (SELECT w.id, w.density, p.density AS d, p.vp_vs AS r, row_number() OVER (PARTITION BY w.id ORDER BY abs(p.density - w.density), p.id) AS i FROM w JOIN pts p ON abs(p.pressure_mpa - w.pressure) <= 1), t AS (SELECT id, any_value(density) AS density, max(d) FILTER (WHERE i = 1) AS d1, max(r) FILTER (WHERE i = 1) AS r1, max(d) FILTER (WHERE i = 2) AS d2, max(r) FILTER (WHERE i = 2) AS r2 FROM c WHERE i <= 2 GROUP BY id) SELECT w.id, round(coalesce(r1 + coalesce(least(greatest(CASE WHEN d2 = d1 THEN 0 ELSE (t.density - d1) / (d2 - d1) END, 0), 1) * (r2 - r1), 0), sqrt(3.0)), 6) AS vp_vs FROM w LEFT JOIN t ON t.id = w.id")
def j16_vp_vs_by_density(spark: S, d: str) -> D:
    w = fix.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), (1900 + F.col("p_size") * 15.0).alias("density"), (F.col("p_partkey") % 12 + 0.4).alias("pressure_mpa"))
    return calibrate.predict_vp_vs(w, fix.calibration(spark, d)).select("id", "vp_vs")


# --- formulas


@query("WITH m(name, category, density) AS (VALUES " + ", ".join(f"('{n}', '{c}', {v})" for n, c, v in fx.DENSITIES) + "), k AS (SELECT name, category, density, row_number() OVER (ORDER BY name) - 1 AS i FROM m) SELECT CAST(p_partkey AS BIGINT) AS id, name, category, density FROM part JOIN k ON k.i = p_partkey % 25 WHERE category IN ('Rock', 'Mineral')")
def f30_density_library(spark: S, d: str) -> D:
    """Parts with a material of the library, of two categories: a broadcast of 25 rows."""
    m = spark.createDataFrame(fx.DENSITIES, "name string, category string, density double")
    named = m.withColumn("i", F.row_number().over(Window.orderBy("name")) - 1)
    p = fix.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), (F.col("p_partkey") % 25).alias("i"))
    return p.join(F.broadcast(named), "i").where(F.col("category").isin("Rock", "Mineral")).select("id", "name", "category", "density")


@query("WITH q AS (SELECT CAST(p_partkey AS BIGINT) AS id, CASE p_partkey % 6 WHEN 0 THEN 'Limestone' WHEN 1 THEN 'quartz' WHEN 2 THEN 'Granite' WHEN 3 THEN 'shale' WHEN 4 THEN 'Marble' END AS n, 2000.0 + p_size * 20 AS d FROM part), l(n, b, e0, e1, p0, p1, c0, c1, f0, f1, t0, t1) AS (VALUES ('Limestone', 2500, 40000, 0.02, 0.25, 0.0001, 7, 0.012, 35, 0.005, 5, 0.005), ('quartz', 2000, 15000, 0.015, 0.2, 0.0001, 3, 0.01, 30, 0.005, 2, 0.005), ('Granite', 2700, 50000, 0.02, 0.25, 0.0001, 15, 0.015, 45, 0.005, 8, 0.006), ('shale', 2200, 8000, 0.012, 0.3, 0.0001, 1.5, 0.01, 20, 0.005, 0.8, 0.005), ('other', 0, 25000, 0.015, 0.25, 0, 8, 0.003, 30, 0.001, 4, 0.001)) SELECT id, round(e0 + d * e1, 6) AS youngs, round(least(0.45, greatest(0.05, p0 + (d - b) * p1)), 6) AS poisson, round(c0 + (d - b) * c1, 6) AS cohesion, round(least(60, greatest(10, f0 + (d - b) * f1)), 6) AS friction_angle, round(t0 + (d - b) * t1, 6) AS tensile FROM q JOIN l ON l.n = CASE WHEN q.n IN ('Limestone', 'quartz', 'Granite', 'shale') THEN q.n ELSE 'other' END")
def f34_rock_properties(spark: S, d: str) -> D:
    k = F.col("p_partkey") % 6
    name = F.when(k == 0, "Limestone").when(k == 1, "quartz").when(k == 2, "Granite").when(k == 3, "shale").when(k == 4, "Marble")
    p = fix.table(spark, d, "part")
    return p.select(F.col("p_partkey").cast("long").alias("id"), *[v.alias(n) for n, v in fx.rock_properties(name, 2000.0 + F.col("p_size") * 20).items()])


@query(f"WITH {POINTS}, q AS (SELECT id, gray / 64 AS s, gray / 20000 AS e, CAST(1 + id % 3 AS DOUBLE) AS y, youngs / 20 AS m, density AS rho, pressure_mpa AS p, poisson AS nu FROM pts) SELECT id, round(CASE WHEN s <= y THEN 0.5 * s * e ELSE 0.5 * y * y / m END * 1000, 6) AS elastic, round(CASE WHEN e > y / m THEN (y + s) * 0.5 * (e - y / m) ELSE 0 END * 1000, 6) AS plastic, round(0.5 * rho * (s * s + e * e + p * p), 6) AS kinetic, round(((pow(s - (s + p + 1) / 3, 2) + pow(p - (s + p + 1) / 3, 2) + pow(1 - (s + p + 1) / 3, 2)) / 2 + s * s + p * p + 4) / (2 * 3.5), 6) AS strain, s - p / 10 >= 2 * 0.5 * cos(radians(30)) + (s + p / 10) * sin(radians(30)) OR p / 10 <= -1 AS fails, round(sqrt(m * nu / ((1 + nu) * (1 - 2 * nu)) / rho * 1e6 + 2 * m / (2 * (1 + nu)) / rho * 1e6), 4) AS vp, round(sqrt(m / (2 * (1 + nu)) / rho * 1e6), 4) AS vs, round(1e9 * greatest(1e-8, least(0.2 * 1e-6 / (1000 + rho), 1 / (20 * 1e6))), 6) AS step_ns, round((vp * vp - 2) / (2 * (vp * vp - 1)), 6) AS nu FROM (SELECT q.*, pts.vp_vs AS vp FROM q JOIN pts USING (id))")
def f15_energies_and_velocities(spark: S, d: str) -> D:
    """F10 to F12, F15, F16 and F23."""
    p = fix.calibration(spark, d)
    s, e, y, m = F.col("gray") / 64, F.col("gray") / 20000, (1 + F.col("id") % 3).cast("double"), F.col("youngs") / 20
    rho, pr, nu = F.col("density"), F.col("pressure_mpa"), F.col("poisson")
    tensor = {"xx": s, "yy": pr, "zz": F.lit(1.0), "xy": s, "xz": pr, "yz": F.lit(2.0)}
    return p.select("id", (1000 * fx.elastic_energy(s, e, y, m)).alias("elastic"), (1000 * fx.plastic_energy(s, e, y, m)).alias("plastic"), fx.kinetic_energy(rho, s, e, pr).alias("kinetic"), fx.strain_energy(tensor, F.lit(3.5)).alias("strain"), fx.mohr_coulomb_fails(s, pr / 10, 0.5, 30.0, 1.0).alias("fails"), F.round(fx.p_velocity(m * 1e6, nu, rho), 4).alias("vp"), F.round(fx.s_velocity(m * 1e6, nu, rho), 4).alias("vs"), (1e9 * fx.time_step(1e-6, 1000 + rho, 1e6)).alias("step_ns"), fx.poisson_from_vp_vs(F.col("vp_vs")).alias("nu"))


@query(f"WITH {PORES} SELECT id, round(least(0.5, greatest(0.01, radius / 100 * (1 - x / 5000))), 6) AS porosity, CASE WHEN id % 9 < 3 THEN 0.6 WHEN id % 9 < 6 THEN 1.0 ELSE 1.5 END AS strength, round(pow(10, 1.1 * log10(1 + x) + 0.2), 4) AS t2, round(least(1.0, greatest(0.0, (x * 600 + y * 800) / 1e6)), 6) AS progress, CASE WHEN x * 1e-6 < 1e-3 THEN printf('%.2f um', x * 1e-6 * 1e6) ELSE '' END AS label, CAST(trunc(radius / 300 * 1000) AS BIGINT) AS chart_x, CAST(trunc(z / 7 * 10) AS BIGINT) AS chart_y FROM pores")
def f20_transforms(spark: S, d: str) -> D:
    """F13, F20, F24, F32, F33 and F37."""
    p = fix.pores(spark, d)
    x, r = F.col("x"), F.col("radius")
    cx, cy = fx.chart_units(r / 300, F.col("z") / 7)
    along = fx.progress({"x": x, "y": F.col("y"), "z": F.col("z")}, (0.0, 0.0, 0.0), (600.0, 800.0, 0.0))
    return p.select("id", fx.strained_porosity(r / 100, x / 5000).alias("porosity"), fx.relaxation_strength(F.col("id") % 9).alias("strength"), F.round(fx.calibrated_t2(1 + x, F.lit(1.1), F.lit(0.2)), 4).alias("t2"), along.alias("progress"), fx.distance_text(x * 1e-6).alias("label"), cx.alias("chart_x"), cy.alias("chart_y"))


@query(WITH + ", q AS (SELECT volume_id, x, y, z, 1000 + gray * 8.0 AS rho FROM v WHERE label = 2), mm AS (SELECT avg(rho) AS mean FROM q), dd AS (SELECT max(z) + 1 AS d FROM v) SELECT volume_id, x, y, z, round(3000 * sqrt(rho / mean) * (1 - 0.1 * sqrt(pow(x - 12.5, 2) + pow(y - 12.5, 2) + pow(z - d / 2.0, 2)) / sqrt(12.5 * 12.5 * 2 + d * d / 4.0)), 6) AS velocity FROM q, mm, dd")
def f22_velocity_from_density(spark: S, d: str) -> D:
    q = voxels(spark, d).where("label = 2").withColumn("rho", 1000 + F.col("gray") * 8.0)
    mean = q.agg(F.avg("rho").alias("mean"))  # one row
    return q.crossJoin(F.broadcast(mean)).select("volume_id", "x", "y", "z", fx.velocity_from_density(F.col("rho"), F.col("mean"), 3000.0, dims(spark, d)).alias("velocity"))


@query(WITH + " SELECT m.id, round(coalesce(avg(v.gray * 10.0), 1000), 6) AS mean, round(25 * 25 * (SELECT d FROM dim) * 1e-9 * 1e9, 6) AS mm3, round(25 * 25 * (SELECT d FROM dim) * 1e-9 * 1000 * m.density, 6) AS grams FROM (SELECT id, density FROM m UNION ALL SELECT 9, 500.0) m LEFT JOIN v ON v.label = m.id GROUP BY m.id, m.density")
def a05_mean_density_and_mass(spark: S, d: str) -> D:
    """A05, with a material that no voxel has, and A33 with pixels of 1 mm."""
    m = materials(spark).unionByName(spark.createDataFrame([(9, 500.0)], "id long, density double"), allowMissingColumns=True)
    v = voxels(spark, d).withColumn("density", F.col("gray") * 10.0)
    w, h, depth = dims(spark, d)
    volume, mass = fx.total_mass(F.lit(w), F.lit(h), F.lit(depth), F.lit(1.0), F.col("density"))
    return stats.material_mean(v, m, "density").join(m.select("id", (volume * 1e9).alias("mm3"), (mass * 1000).alias("grams")), "id")


# --- bands, cores and masks

GAUSS = "o{n} AS (SELECT a, exp(-a * a / 2.0) AS wt FROM range(-3, 4) r(a))"


def _peaks_sql(rows: str, mirrored: bool) -> str:
    """CTEs after `rows` (view, slice, row, v): both kinds of peaks with a distance of 1, from the rows above each."""
    over = "max(v) OVER k - v + min(v) OVER k" if mirrored else "-v"
    return f"""pair AS (SELECT view, slice, row, 'bright' AS kind, v FROM {rows} UNION ALL SELECT view, slice, row, 'dark', {over} FROM {rows} WINDOW k AS (PARTITION BY view, slice)),
top AS (SELECT * FROM (SELECT *, v > lag(v) OVER k AND v > lead(v) OVER k AS peak, min(row) OVER (PARTITION BY view, slice, kind) AS r0, max(row) OVER (PARTITION BY view, slice, kind) AS r1 FROM pair WINDOW k AS (PARTITION BY view, slice, kind ORDER BY row)) WHERE peak),
span AS (SELECT t.view, t.slice, t.kind, t.row, t.v, coalesce(max(b.row) FILTER (WHERE b.row < t.row AND b.v > t.v), any_value(r0)) AS lo, coalesce(min(b.row) FILTER (WHERE b.row > t.row AND b.v > t.v), any_value(r1)) AS hi FROM top t JOIN pair b ON b.view = t.view AND b.slice = t.slice AND b.kind = t.kind GROUP BY ALL),
prom AS (SELECT s.view, s.slice, s.kind, s.row, s.v, s.v - greatest(min(b.v) FILTER (WHERE b.row <= s.row), min(b.v) FILTER (WHERE b.row >= s.row)) AS p FROM span s JOIN pair b ON b.view = s.view AND b.slice = s.slice AND b.kind = s.kind AND b.row BETWEEN lo AND hi GROUP BY s.view, s.slice, s.kind, s.row, s.v)"""


def _flags_sql(rows: str, prominence: float) -> str:
    kinds = ", ".join(f"CAST(EXISTS (SELECT 1 FROM prom p WHERE p.view = r.view AND p.slice = r.slice AND p.row = r.row AND p.kind = '{k}' AND (p.p >= {prominence} OR (p.v > 0 AND p.p >= 0.5 * p.v))) AS BIGINT) AS {k}" for k in ("dark", "bright"))
    return f"SELECT 1 AS volume_id, view, slice, row, round(v, 6) AS v, {kinds} FROM {rows} r"


def _smooth_sql(name: str, rows: str) -> str:
    return f"{name} AS (SELECT a.view, a.slice, a.row, sum(b.v * exp(-pow(b.row - a.row, 2) / 2.0)) / sum(exp(-pow(b.row - a.row, 2) / 2.0)) AS v FROM {rows} a JOIN {rows} b ON a.view = b.view AND a.slice = b.slice AND abs(a.row - b.row) <= 3 GROUP BY ALL)"


@query(WITH + ", vm AS (SELECT y, greatest(var_pop(gray / 255.0), 1e-6) AS u FROM v WHERE z BETWEEN 0 AND 9 GROUP BY x, y), pr AS (SELECT 'XY' AS view, 0 AS slice, y AS row, avg(u) AS v FROM vm GROUP BY y), " + _smooth_sql("sm", "pr") + ", " + _peaks_sql("sm", True) + " " + _flags_sql("sm", 0.002))
def x02_variance_bands(spark: S, d: str) -> D:
    """X02 with W05's mirrored form."""
    return bands.variance_bands(voxels(spark, d), "XY", 0, 9, 1.0, 0.002, 1)


_SLICES = "(SELECT 'XY' AS view, z AS slice, x AS i, y AS j, gray FROM v WHERE z = 2 UNION ALL SELECT 'XZ', y, x, z, gray FROM v WHERE y = 7 UNION ALL SELECT 'YZ', x, y, z, gray FROM v WHERE x = 11)"
X01 = f"""raw AS {_SLICES}, sums AS (SELECT view, slice, j, sum(gray) AS s FROM raw GROUP BY ALL), crop AS (SELECT view, slice, min(j) FILTER (WHERE s > 0.05 * top) AS j0 FROM (SELECT *, max(s) OVER (PARTITION BY view, slice) AS top FROM sums) GROUP BY ALL),
im AS (SELECT view, slice, i, j - j0 AS j, 1 - gray / 255.0::DOUBLE AS g FROM raw JOIN crop USING (view, slice) WHERE j >= j0), disk AS (SELECT a, b FROM range(-2, 3) p(a), range(-2, 3) q(b) WHERE a * a + b * b <= 4),
ero AS (SELECT t.view, t.slice, t.i, t.j, min(n.g) AS g FROM im t, disk, im n WHERE n.view = t.view AND n.slice = t.slice AND n.i = t.i + a AND n.j = t.j + b GROUP BY ALL),
dil AS (SELECT t.view, t.slice, t.i, t.j, max(n.g) AS g FROM ero t, disk, ero n WHERE n.view = t.view AND n.slice = t.slice AND n.i = t.i + a AND n.j = t.j + b GROUP BY ALL),
hat AS (SELECT im.view, im.slice, im.i, im.j, im.g - dil.g AS g FROM im JOIN dil USING (view, slice, i, j)),
sg AS (SELECT t.view, t.slice, t.i, t.j, sum(n.g * exp(-pow(n.i - t.i, 2) / 2.0)) / sum(exp(-pow(n.i - t.i, 2) / 2.0)) AS g FROM hat t JOIN hat n ON n.view = t.view AND n.slice = t.slice AND n.j = t.j AND abs(n.i - t.i) <= 3 GROUP BY ALL),
pr AS (SELECT view, slice, j AS row, sum(g) AS v FROM sg GROUP BY ALL), """


@query(WITH + ", " + X01 + _smooth_sql("sm", "pr") + ", " + _peaks_sql("sm", False) + " " + _flags_sql("sm", 0.05))
def x01_bands_of_three_views(spark: S, d: str) -> D:
    """X01, W05 and U04, the rows of S24's table."""
    return bands.three_views(voxels(spark, d), dims(spark, d), {"XY": 2, "XZ": 7, "YZ": 11}, radius=2, sigma=1.0, prominence=0.05, distance=1)


@query(WITH + ", pl AS (SELECT r, CAST(trunc(12 + cos(radians(t * 15)) * r) AS BIGINT) AS x, CAST(trunc(12 + sin(radians(t * 15)) * r) AS BIGINT) AS y FROM range(5, 10) p(r), range(24) q(t)), ring AS (SELECT r, CAST(floor(avg(gray)) AS DOUBLE) AS v FROM pl JOIN v USING (x, y) WHERE z = 3 GROUP BY r), mm AS (SELECT r, avg(v) OVER (ORDER BY r RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM ring) SELECT 1 AS volume_id, r, round(v, 6) AS v, round(s, 6) AS smooth, round(abs(s - lag(s) OVER (ORDER BY r)) / (r - lag(r) OVER (ORDER BY r)), 6) AS gradient FROM ring JOIN mm USING (r)")
def w09_ring_profile(spark: S, d: str) -> D:
    """W09 and W10."""
    return core.gradients(core.moving_mean(core.ring_means(voxels(spark, d), dims(spark, d), 3, 2), 1))


@query(WITH + ", pl AS (SELECT r, CAST(trunc(12 + cos(radians(t * 15)) * r) AS BIGINT) AS x, CAST(trunc(12 + sin(radians(t * 15)) * r) AS BIGINT) AS y FROM range(5, 10) p(r), range(24) q(t)), ring AS (SELECT r, CAST(floor(avg(gray)) AS DOUBLE) AS mean FROM pl JOIN v USING (x, y) WHERE z = 3 GROUP BY r), sm AS (SELECT a.r, avg(b.mean) AS mean FROM ring a JOIN ring b ON abs(a.r - b.r) <= 1 GROUP BY a.r), gr AS (SELECT b.r, abs(b.mean - a.mean) AS turn FROM sm a JOIN sm b ON b.r = a.r + 1) SELECT 1 AS volume_id, round(least(11.25, greatest(7.5, arg_max(r, (turn, -r)))), 6) AS radius FROM gr")
def g26_core_radius(spark: S, d: str) -> D:
    return core.core_radius(voxels(spark, d), dims(spark, d), 3, 2)


@query()
def g25_core_circle(spark: S, d: str) -> D:
    """Held against a plain version in the tests."""
    return core.core_circle(voxels(spark, d), dims(spark, d), "XY", 3)


@query(WITH + " SELECT volume_id, x, y, z, CASE WHEN gray < 40 AND (x + y) % 3 = 0 THEN 3 ELSE label END AS added, CASE WHEN gray < 40 AND (x + y) % 3 = 0 AND label = 1 THEN 0 ELSE label END AS removed FROM v")
def g23_interpolated_mask(spark: S, d: str) -> D:
    v = voxels(spark, d)
    mask = v.where("gray < 40 AND (x + y) % 3 = 0")
    key = ["volume_id", "x", "y", "z"]
    return lab.apply_mask(v, mask, 3).select(*key, F.col("label").alias("added")).join(lab.subtract_mask(v, mask, 1).select(*key, F.col("label").alias("removed")), key)


@query()
def g20_interpolation(spark: S, d: str) -> D:
    """G20 with G21 and G22; held against a plain version in the tests."""
    marks = voxels(spark, d).where("z IN (3, 9) AND x BETWEEN 8 AND 12 AND y BETWEEN 8 AND 12 AND gray < 128").select("volume_id", "x", "y", "z")
    return lab.interpolate_selection(marks, dims(spark, d))


@query(WITH + f", {MAPS}, n1 AS (SELECT a.map_id, a.x, a.y, CAST(sum(b.value) // count(*) AS BIGINT) AS value FROM maps a JOIN maps b ON a.map_id = b.map_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL) SELECT a.map_id, a.x, a.y, CAST(sum(b.value) // count(*) AS BIGINT) AS value FROM n1 a JOIN n1 b ON a.map_id = b.map_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL".replace("{MAPS}", MAPS))
def g30_smooth_map(spark: S, d: str) -> D:
    """Two passes over maps of 0 to 3."""
    return lab.smooth_map(fix.label_maps(spark, d), 2)


@query(WITH + " SELECT a.x AS key, m.name FROM (SELECT DISTINCT x, x % 6 AS id FROM v) a JOIN (SELECT id, CASE id WHEN 2 THEN 'Grain' ELSE name END AS name FROM m UNION ALL SELECT 4, 'New') m ON m.id = a.id")
def g18_materials_table(spark: S, d: str) -> D:
    """G18 over a table of materials that the volume's columns look up."""
    m = lab.rename_material(lab.add_material(materials(spark), "New", 0, 9), 2, "Grain")
    keys = voxels(spark, d).select("x", (F.col("x") % 6).alias("id")).distinct()
    return keys.join(F.broadcast(m.select("id", "name")), "id").select(F.col("x").alias("key"), "name")


# --- views, orders and sets of rows


@query("WITH t AS (SELECT CAST(c_custkey AS BIGINT) AS id, CASE c_custkey % 3 WHEN 0 THEN 'XY' WHEN 1 THEN 'XZ' ELSE 'YZ' END AS view, c_custkey % 24 AS slice FROM customer) SELECT id, view, slice, 'view' AS found FROM t WHERE view = 'XZ' AND slice = 7 UNION ALL SELECT id, view, slice, 'id' FROM t WHERE id IN (3, 17) UNION ALL SELECT id, view, slice, 'box' FROM t WHERE slice = 5 AND id % 2 = 0")
def p11_measurements_and_annotations(spark: S, d: str) -> D:
    """P11 and P13 over rows derived from the customers."""
    k = F.col("c_custkey")
    t = fix.table(spark, d, "customer").select(k.cast("long").alias("id"), F.when(k % 3 == 0, "XY").when(k % 3 == 1, "XZ").otherwise("YZ").alias("view"), (k % 24).alias("slice"))
    a = t.withColumns({"z": F.col("slice"), "type": F.when(F.col("id") % 2 == 0, "Box").otherwise("Point")})
    parts = [vox.of_view(t, "XZ", 7).withColumn("found", F.lit("view")), vox.by_id(t, 3, 17).withColumn("found", F.lit("id")), vox.annotations_of_slice(a, 5, "Box").select(*t.columns, F.lit("box").alias("found"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(WITH + " SELECT 1 AS volume_id, label, count(*) AS n, round(count(*) * 8.0, 6) AS um3, round(avg(CASE WHEN label = 1 THEN 1.0 ELSE 0 END), 6) AS pores, 0 AS blank FROM v GROUP BY label")
def p20_rescaled_volumes(spark: S, d: str) -> D:
    """A volume rescaled from 1 to 2 um, its label counts, fractions, and blank labels."""
    v = voxels(spark, d)
    volumes = vox.set_pixel_size(v.select("volume_id").distinct().withColumn("pixel_size", F.lit(PIXEL)), 1, 2e-6)
    n = v.groupBy("volume_id", "label").agg(F.count("*").alias("n")).join(volumes, "volume_id")
    n = n.join(sections.label_fraction(v, 1, "volume_id", "label"), ["volume_id", "label"])
    blank = vox.blank_labels(v).groupBy("volume_id").agg(F.max("label").alias("blank"))
    cube = F.col("pixel_size") * F.col("pixel_size") * F.col("pixel_size") * 1e18
    return n.join(blank, "volume_id").select("volume_id", "label", "n", (F.col("n") * cube).alias("um3"), F.col("fraction").alias("pores"), "blank")


@query(f"WITH {PORES}, k AS (SELECT id, CAST(radius AS BIGINT) AS n FROM pores), r AS (SELECT id, n, row_number() OVER (ORDER BY n DESC, id) AS a, row_number() OVER (ORDER BY n, id) AS b, row_number() OVER (ORDER BY id) AS c, row_number() OVER (ORDER BY id DESC) AS d FROM k) SELECT 'largest' AS kind, id, n FROM r WHERE a <= 9 UNION ALL SELECT 'smallest', id, n FROM r WHERE b <= 9 UNION ALL SELECT 'first', id, n FROM r WHERE c <= 9 UNION ALL SELECT 'last', id, n FROM r WHERE d <= 9")
def t01_particle_orders(spark: S, d: str) -> D:
    """T01's four orders: a top-k report over pores as particles."""
    p = fix.pores(spark, d).select(F.lit(1).alias("volume_id"), F.col("id").alias("component"), F.col("radius").cast("long").alias("voxel_count"))
    parts = [stats.top_particles(p, k, 9).select(F.lit(k).alias("kind"), F.col("component").alias("id"), F.col("voxel_count").alias("n")) for k in stats.PARTICLE_ORDERS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"WITH {SERIES} SELECT series_id, step, round(v, 6) AS v, coalesce(v < lag(v) OVER s AND v < lead(v) OVER s, false) AS is_trough FROM series WINDOW s AS (PARTITION BY series_id ORDER BY step)")
def w02_local_minima(spark: S, d: str) -> D:
    return series.local_minima(fix.series(spark, d), ["series_id"], "step")


# --- thin sections, relaxation and networks

MASK_LINKS = ", k AS (SELECT x, y, z, (z * 25 + y) * 25 + x AS i FROM v WHERE label = 1), c(i, component) AS (SELECT i, i FROM k UNION SELECT n.i, c.component FROM c JOIN k p ON p.i = c.i JOIN k n ON n.z = p.z AND abs(n.x - p.x) + abs(n.y - p.y) = 1 WHERE c.component < n.i)"


@query(WITH + MASK_LINKS + ", f AS (SELECT i, min(component) AS id FROM c GROUP BY i) SELECT 1 AS volume_id, z, id, round(avg(x) * 2.0, 6) AS x, round(avg(y) * 2.0, 6) AS y, round(sqrt(count(*) / pi()) * 2, 6) AS radius, round(count(*) * 4.0, 6) AS area, count(*) AS pixels FROM f JOIN k ON k.i = f.i GROUP BY z, id HAVING count(*) >= 5")
def c07_section_regions(spark: S, d: str) -> D:
    """Regions of every slice."""
    return sections.regions(voxels(spark, d).where("label = 1"), dims(spark, d), 2.0)


@query(f"WITH {PORES}, q AS (SELECT id, x, y, radius / 4 AS radius, pi() * radius * radius / 16 AS area FROM pores), t AS (SELECT a.id AS i, b.id AS j, greatest(0.1, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) - a.radius - b.radius) * 2 * 0.4 * least(a.radius, b.radius) AS area FROM q a JOIN q b ON a.id < b.id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) < least(3 * a.radius, 1.5 * (a.radius + b.radius))), n AS (SELECT id, count(*) AS connections FROM (SELECT i AS id FROM t UNION ALL SELECT j FROM t) GROUP BY id) SELECT q.id, coalesce(connections, 0) AS connections, round(((SELECT sum(area) FROM q) + (SELECT sum(area) FROM t)) / 1e6, 6) AS porosity FROM q LEFT JOIN n USING (id)")
def c16_section_network(spark: S, d: str) -> D:
    """The pores seen from above as one section."""
    r = F.col("radius") / 4
    p = fix.pores(spark, d).select("id", "x", "y", r.alias("radius"), (F.pi() * r * r).alias("area"))
    found = written(network.throat_counts_2d(p), "section")
    return found.select("id", "connections").crossJoin(F.broadcast(sections.section_porosity(p, found, 1e6)))


def _linked(spark: S, d: str) -> D:
    return fix.pores(spark, d).withColumn("connections", F.col("id") % 5)


X06 = f"""{PORES}, p3 AS (SELECT id, x, y, z, radius, id % 5 AS connections FROM pores), s2 AS (SELECT radius / 2 AS radius, id % 7 AS connections FROM pores WHERE id % 40 = 0), b AS (SELECT min(x - radius) AS x0, max(x + radius) AS x1, min(y - radius) AS y0, max(y + radius) AS y1, min(z - radius) AS z0, max(z + radius) AS z1 FROM p3),
o(o, name, nx, ny, nz, ux, uy, uz, vx, vy, vz) AS (VALUES {", ".join(str((o, name, *n, *u, *v)) for o, (name, n, u, v) in enumerate(sections.unit_vectors()))}),
g AS (SELECT ((o * 5 + i) * 5 + j) * 5 + k AS plane_id, name, i, j, o.*, x0 + (x1 - x0) * (i + 0.5) / 5 AS cx, y0 + (y1 - y0) * (j + 0.5) / 5 AS cy, z0 + (z1 - z0) * (k + 0.5) / 5 AS cz FROM o, b, range(5) a(i), range(5) c(j), range(5) e(k)),
cut AS (SELECT plane_id, name, i, j, p3.radius, connections FROM g JOIN p3 ON abs((x - cx) * nx + (y - cy) * ny + (z - cz) * nz) <= radius AND abs((x - cx) * ux + (y - cy) * uy + (z - cz) * uz) <= 150 AND abs((x - cx) * vx + (y - cy) * vy + (z - cz) * vz) <= 100),
b3 AS (SELECT plane_id, CAST(least(4, floor(CASE WHEN hi > lo THEN (radius - lo) / (hi - lo) ELSE 0.5 END * 5)) AS BIGINT) AS bin, 1.0 / n AS w FROM (SELECT *, min(radius) OVER q AS lo, max(radius) OVER q AS hi, count(*) OVER q AS n FROM cut WINDOW q AS (PARTITION BY plane_id))),
b2 AS (SELECT CAST(least(4, floor((radius - lo) / (hi - lo) * 5)) AS BIGINT) AS bin, 1.0 / n AS w FROM (SELECT *, min(radius) OVER () AS lo, max(radius) OVER () AS hi, count(*) OVER () AS n FROM s2)),
ap AS (SELECT plane_id, sum(abs(coalesce(h3, 0) - coalesce(h2, 0))) AS apart FROM (SELECT plane_id, t.bin, (SELECT sum(w) FROM b3 WHERE b3.plane_id = c.plane_id AND b3.bin = t.bin) AS h3, (SELECT sum(w) FROM b2 WHERE b2.bin = t.bin) AS h2 FROM (SELECT DISTINCT plane_id FROM cut) c, range(5) t(bin)) GROUP BY plane_id),
m AS (SELECT plane_id, any_value(name) AS name, any_value(i) AS i, any_value(j) AS j, count(*) AS n, avg(connections) AS c3 FROM cut GROUP BY plane_id), q2 AS (SELECT count(*) AS n2, avg(connections) AS c2 FROM s2),
sc AS (SELECT plane_id, name, i, j, n, 100 * (0.2 * least(1.0, n / n2::DOUBLE) + 0.4 * (1 - apart / 5) + 0.4 * CASE WHEN greatest(c2, c3) > 0 THEN 1 - abs(c2 - c3) / greatest(c2, c3) ELSE 0.5 END) AS score FROM m JOIN ap USING (plane_id), q2)"""


@query(f"WITH {X06} SELECT plane_id, n, round(score, 6) AS score FROM sc")
def c18_match_scores(spark: S, d: str) -> D:
    """J10, C17 and C18 over all nine orientations."""
    p = _linked(spark, d)
    section = p.where("id % 40 = 0").select((F.col("radius") / 2).alias("radius"), (F.col("id") % 7).alias("connections"))
    planes = sections.candidate_planes(p, 300.0, 200.0)
    return sections.match_scores(section, p, planes)


@query(f"WITH {X06}, r AS (SELECT *, row_number() OVER (PARTITION BY name, i, j ORDER BY round(score, 9) DESC, plane_id) AS rank FROM sc), t AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, plane_id) AS place FROM r WHERE rank = 1) SELECT plane_id, name AS orientation, n, round(score, 6) AS score FROM t WHERE place <= 10")
def x06_best_planes(spark: S, d: str) -> D:
    """A top-k report."""
    p = _linked(spark, d)
    section = p.where("id % 40 = 0").select((F.col("radius") / 2).alias("radius"), (F.col("id") % 7).alias("connections"))
    planes = sections.candidate_planes(p, 300.0, 200.0)
    scores = sections.match_scores(section, p, planes).withColumn("score", F.round("score", 9))
    return sections.best_planes(scores, planes, 10)


NMR = """, o AS (SELECT a, b, c, sqrt(a * a + b * b + c * c) AS dist FROM range(-5, 6) p(a), range(-5, 6) q(b), range(-5, 6) r(c) WHERE a <> 0 OR b <> 0 OR c <> 0),
ls AS (SELECT v.x, v.y, v.z, v.label, coalesce(min(CASE WHEN n.label <> v.label THEN dist END), 0) * 5e-6 AS size, avg(CASE WHEN dist = 1 THEN CASE WHEN n.label = v.label THEN 1.0 ELSE 0.0 END END) AS con FROM v CROSS JOIN o JOIN v n ON n.x = v.x + a AND n.y = v.y + b AND n.z = v.z + c WHERE v.label <> 0 GROUP BY v.label, v.x, v.y, v.z),
st AS (SELECT label, count(*) AS n, count(*) / (SELECT count(*) FROM v)::DOUBLE AS porosity, avg(size) AS size, avg(con) AS con FROM ls GROUP BY label)"""


@query(WITH + NMR + " SELECT 1 AS volume_id, label, n, round(porosity, 6) AS porosity, round(size * 1e6, 6) AS mean_pore_size_um, round(con, 6) AS mean_connectivity FROM st")
def a21_pore_structure(spark: S, d: str) -> D:
    """A21 with pixels of 5 um."""
    return stats.pore_structure(voxels(spark, d), 5, 5e-6, dims(spark, d)).select("volume_id", "label", "n", "porosity", (F.col("mean_pore_size") * 1e6).alias("mean_pore_size_um"), "mean_connectivity")


MATERIAL = [(1, 1.0, 100.0, 1.0, 1.5, 1.0), (2, 0.4, 900.0, 0.6, 2.0, 0.8), (3, 0.0, 10.0, 1.5, 1.0, 1.0)]
COMPONENTS = NMR + ", pr(label, density, mean, strength, tort, effect) AS (VALUES " + ", ".join(map(str, MATERIAL)) + "), gd AS (SELECT pow(10, i * log10(5000) / 31) AS t2 FROM range(32) r(i)), cp AS (SELECT st.label, t2 / w AS t2, amp, w FROM (SELECT st.label, t2, density * porosity * effect * exp(-pow(ln(t2) - ln(mean), 2) / (2 * pow(0.5 / strength, 2))) / (t2 * (0.5 / strength) * sqrt(2 * pi())) * exp(-(10e-6 / size) / t2) AS amp, tort * (2 - con) / sqrt(size / 10e-6) AS w FROM st JOIN pr USING (label), gd WHERE density > 0) st WHERE amp > 0)"


@query(WITH + COMPONENTS + " SELECT t, round(sum(amp * exp(-t / pow(10, 0.9 * log10(t2) + 0.1))), 6) AS magnetisation FROM cp, (VALUES (0.0::DOUBLE), (1.0), (10.0), (100.0), (1000.0)) tt(t) GROUP BY t")
def x04_relaxation_response(spark: S, d: str) -> D:
    """A21, F18, F20 and F19."""
    s = stats.pore_structure(voxels(spark, d), 5, 5e-6, dims(spark, d))
    m = spark.createDataFrame(MATERIAL, "label long, density double, relaxation_time double, relaxation_strength double, tortuosity double, porosity_effect double")
    return relaxation.response(relaxation.components(s, m), [0, 1, 10, 100, 1000], 0.9, 0.1)


@query(f"WITH {PORES}, t AS (SELECT 0.4 * least(a.radius, b.radius) AS r, a.x AS xa, b.x AS xb, a.id AS i, b.id AS j FROM pores a JOIN pores b ON b.id = a.id + 1), s AS (SELECT min(x) AS lo, max(x) AS hi, 2 * avg(radius) AS near, max(x + radius) - min(x - radius) AS sx, max(y + radius) - min(y - radius) AS sy, max(z + radius) - min(z - radius) AS sz, sum(4 / CAST(3 AS DOUBLE) * pi() * pow(radius, 3)) AS pv, sum(4 * pi() * pow(radius, 2)) AS ps, sum(volume) AS vol FROM pores), u AS (SELECT avg(r) AS mr, sum(pi() * r * r * 5.0) AS tv, sum(2 * pi() * r * 5.0) AS ts FROM t), f AS (SELECT sum(CASE WHEN (xa <= lo + near AND xa < hi - near) <> (xb <= lo + near AND xb < hi - near) THEN abs(pi() * pow(r * 1e-6, 4) / (8 * 0.001 * 5.0e-6) * (xa - xb) * 1e5) ELSE 0 END) AS flow FROM t, s), dk AS (SELECT flow * 0.001 * sx * 1e-6 / (sy * sz * 1e-12 * (hi - lo) * 1e5) / 9.869233e-13 AS k, (hi - lo) * 1e5 / (sx * 1e-6) AS g FROM f, s), fo AS (SELECT (sqrt(pow(0.001 / (k * 9.869233e-13), 2) + 4 * (1.75 / (vol / (sx * sy * sz) * 2 * mr * 1e-6) * 1000) * g) - 0.001 / (k * 9.869233e-13)) / (2 * (1.75 / (vol / (sx * sy * sz) * 2 * mr * 1e-6) * 1000)) * 0.001 / g / 9.869233e-13 AS k FROM dk, s, u), kc AS (SELECT least(0.999, greatest(0.001, (pv + tv) / (sx * sy * sz))) AS phi, (ps + ts) / (sx * sy * sz) AS sp FROM s, u), al AS (SELECT 'darcy' AS method, k FROM dk UNION ALL SELECT 'forchheimer', k FROM fo UNION ALL SELECT 'kozeny_carman', pow(phi, 3) / (5 * pow(sp, 2) * pow(1 - phi, 2)) * 1e-12 / 9.869233e-13 FROM kc) SELECT method, round(k, 6) AS permeability, round(k / 2.25, 6) AS corrected FROM al")
def x05_permeability_comparison(spark: S, d: str) -> D:
    """X05 with a pressure linear in x and a tortuosity of 1.5."""
    from tomolake.plans.table_queries import _chain

    p = fix.pores(spark, d)
    return network.permeability_comparison(p, _chain(spark, d), p.select(F.col("id").alias("pore_id"), (F.col("x") * 1e5).alias("pressure")), 0.001, 1000.0, 1.5)


HALF = [ORACLES[q].replace("1.4", "0.5") for q in ("r03_resample_gray", "r04_resample_labels")]


@query(f"SELECT volume_id, x, y, z, gray, label FROM ({HALF[0]}) JOIN ({HALF[1]}) USING (volume_id, x, y, z)")
def r05_resample_node(spark: S, d: str) -> D:
    """Gray and labels of one resampled volume."""
    return res.resample(voxels(spark, d), 0.5, dims(spark, d)).select("volume_id", "x", "y", "z", "gray", "label")


PARTICLES = ", k AS (SELECT x, y, z, (z * 25 + y) * 25 + x AS i FROM v WHERE label = 1), c(i, component) AS (SELECT i, i FROM k UNION SELECT n.i, c.component FROM c JOIN k p ON p.i = c.i JOIN k n ON abs(n.x - p.x) + abs(n.y - p.y) + abs(n.z - p.z) = 1 WHERE c.component < n.i), f AS (SELECT i, min(component) AS id FROM c GROUP BY i), nb AS (SELECT f.id, k.i, max(CASE WHEN v.label <> 1 THEN 1 ELSE 0 END) AS edge FROM f JOIN k ON k.i = f.i JOIN v ON abs(v.x - k.x) + abs(v.y - k.y) + abs(v.z - k.z) = 1 GROUP BY f.id, k.i)"


@query(WITH + PARTICLES + " SELECT 1 AS volume_id, f.id, round(count(*) * 8.0, 6) AS volume, round(cbrt(3 * count(*) * 8.0 / (4 * pi())), 6) AS radius, round(any_value(a.edges) * 1.5 * 4, 6) AS area, round(CAST(sum(x) // count(*) AS DOUBLE) * 2, 6) AS x, round(CAST(sum(y) // count(*) AS DOUBLE) * 2, 6) AS y, round(CAST(sum(z) // count(*) AS DOUBLE) * 2, 6) AS z FROM f JOIN k ON k.i = f.i JOIN (SELECT id, sum(edge) AS edges FROM nb GROUP BY id) a ON a.id = f.id GROUP BY f.id")
def c08_pores_from_particles(spark: S, d: str) -> D:
    """Components of material 1 as pores, with pixels of 2 um."""
    found = _labelled(spark, d)
    area = stats.surface_area(found.unionByName(voxels(spark, d).where("label <> 1").select("volume_id", "x", "y", "z", F.lit(-1).cast("long").alias("component"))), 2e-6, dims(spark, d))
    p = network.pores_from_particles(stats.particles(found, 2e-6), area, 2e-6)
    return p.select("volume_id", "id", "volume", "radius", "area", "x", "y", "z")


def _labelled(spark: S, d: str) -> D:
    return comp.separate_particles(voxels(spark, d), 1, dims(spark, d)).select("volume_id", "x", "y", "z", "component")


def _features_sql(name: str, source: str, by: str) -> str:
    """A CTE of the five features of matrices (by, i, j, p)."""
    sd = "sqrt(greatest(sum(p * {0} * {0}) - pow(sum(p * {0}), 2), 0))"
    both = f"({sd.format('i')} * {sd.format('j')})"
    return f"{name} AS (SELECT {by}, sum(p * (i - j) * (i - j)) AS f1, sum(p * abs(i - j)) AS f2, sum(p / (1 + (i - j) * (i - j))) AS f3, sum(p * p) AS f4, CASE WHEN {both} > 0 THEN (sum(p * i * j) - sum(p * i) * sum(p * j)) / {both} ELSE 0 END AS f5 FROM {source} GROUP BY {by})"


X03 = (
    ", dir(k, dx, dy) AS (VALUES (0, 1, 0), (1, 1, 1), (2, 0, 1), (3, -1, 1)), box AS (SELECT x, y, gray FROM v WHERE z = 2 AND x >= 3 AND x < 15 AND y >= 4 AND y < 16), rc AS (SELECT k, a.gray AS i, b.gray AS j, count(*) AS n FROM dir, box a, box b WHERE b.x = a.x + dx AND b.y = a.y + dy GROUP BY ALL), rm AS (SELECT k, i, j, floor(n * 1000000.0 / sum(n) OVER (PARTITION BY k)) / 1e6 AS p FROM rc), "
    + _features_sql("rf", "rm", "k")
    + ", ref AS (SELECT avg(f1) AS r1, avg(f2) AS r2, avg(f3) AS r3, avg(f4) AS r4, avg(f5) AS r5 FROM rf), pr AS (SELECT a.z, a.x, a.y, a.gray AS i, b.gray AS j FROM v a JOIN v b ON b.z = a.z AND b.y = a.y AND b.x = a.x + 1 WHERE a.z BETWEEN 1 AND 4), ce AS (SELECT z, cx, cy, i, j, floor(count(*) * 1000000.0 / 42) / 1e6 AS p FROM pr, range(3, 22, 2) q(cx), range(3, 22) r(cy) WHERE cx BETWEEN x - 2 AND x + 3 AND cy BETWEEN y - 3 AND y + 3 GROUP BY z, cx, cy, i, j), "
    + _features_sql("pf", "ce", "z, cx, cy")
    + ", hit AS (SELECT DISTINCT z, cx + a AS x, cy + b AS y FROM pf, ref, range(-1, 2) m(a), range(-1, 2) n(b) WHERE (f1 * r1 + f2 * r2 + f3 * r3 + f4 * r4 + f5 * r5) / (sqrt(f1 * f1 + f2 * f2 + f3 * f3 + f4 * f4 + f5 * f5) * sqrt(r1 * r1 + r2 * r2 + r3 * r3 + r4 * r4 + r5 * r5)) >= 0.99998) SELECT v.volume_id, v.x, v.y, v.z, CASE WHEN hit.x IS NOT NULL THEN 3 ELSE label END AS label FROM v LEFT JOIN hit ON hit.x = v.x AND hit.y = v.y AND hit.z = v.z"
)


@query(WITH + X03)
def x03_texture_classes(spark: S, d: str) -> D:
    """X03 over slices 1 to 4, by the features of a rectangle of slice 2."""
    v = voxels(spark, d)
    reference = textures.reference_features(v, (3, 4), (15, 16), 2)
    return textures.classify_texture(v, dims(spark, d), reference, 3, 0.99998, (1, 4)).select("volume_id", "x", "y", "z", "label")


# --- masks, points and fields


@query(WITH + MASK_LINKS + ", f AS (SELECT i, min(component) AS id FROM c GROUP BY i) SELECT 1 AS volume_id, z, id AS component, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM f JOIN k ON k.i = f.i GROUP BY z, id HAVING max(x) - min(x) + 1 > 2 AND max(y) - min(y) + 1 > 2")
def g35_mask_boxes(spark: S, d: str) -> D:
    mask = voxels(spark, d).where("label = 1").select("volume_id", "x", "y", "z", "label")
    return comp.mask_boxes(mask, dims(spark, d), 2)


@query(WITH + " SELECT volume_id, x, y, z FROM v WHERE gray < 40 OR (x + y) % 4 = 0")
def g34_merged_masks(spark: S, d: str) -> D:
    v = voxels(spark, d)
    masks = [v.where(c).select(F.lit(i).alias("mask_id"), "volume_id", "x", "y", "z", F.lit(1).alias("value")) for i, c in enumerate(("gray < 40", "(x + y) % 4 = 0"))]
    return lab.merge_masks(masks[0].unionByName(masks[1]))


@query(WITH + ", e AS (SELECT x, y, z, gray * 3 + x AS value FROM v), p AS (SELECT (z * 25 + y) * 25 + x AS id, x, y, z FROM v WHERE gray % 17 = 0), q AS (SELECT p.id, e.x, e.y, row_number() OVER (PARTITION BY p.id ORDER BY value DESC, e.y, e.x) AS i FROM p JOIN e ON e.z = p.z AND (e.x - p.x) * (e.x - p.x) + (e.y - p.y) * (e.y - p.y) <= 4) SELECT id, x, y FROM q WHERE i = 1")
def n16_snapped_points(spark: S, d: str) -> D:
    v = voxels(spark, d)
    edges = v.select("volume_id", "x", "y", "z", (F.col("gray") * 3 + F.col("x")).alias("value"))
    points = v.where("gray % 17 = 0").select(((F.col("z") * 25 + F.col("y")) * 25 + F.col("x")).alias("id"), "volume_id", "x", "y", "z")
    return stencil.snap_to_edge(edges, points, 2)


@query(WITH + " SELECT round(min(gray * 20.0), 6) AS min_v, round(max(gray * 20.0), 6) AS max_v, round(avg(gray * 20.0), 6) AS mean_v, count(*) AS n FROM v WHERE gray > 0")
def a26_velocity_statistics(spark: S, d: str) -> D:
    return stats.velocity_statistics(voxels(spark, d).select((F.col("gray") * 20.0).alias("v")))


@query(f"WITH {PORES}, b AS (SELECT min(x) - 0.01 AS ox, min(y) - 0.01 AS oy, min(z) - 0.01 AS oz FROM pores), c AS (SELECT CAST(floor((x - ox) * 0.01) AS BIGINT) AS cx, CAST(floor((y - oy) * 0.01) AS BIGINT) AS cy, CAST(floor((z - oz) * 0.01) AS BIGINT) AS cz, avg(radius) AS density FROM pores, b GROUP BY ALL), s AS (SELECT min(density) AS lo, max(density) AS hi FROM c) SELECT cx, cy, cz, round(density, 6) AS density, CAST(floor(255 * (density - lo) / (hi - lo)) AS BIGINT) AS gray FROM c, s")
def r10_points_to_grid(spark: S, d: str) -> D:
    return res.points_to_grid(fix.pores(spark, d).select("x", "y", "z", F.col("radius").alias("density")), 0.01)


@query(WITH + " SELECT i AS x, j AS y, CASE WHEN v.gray < 100 THEN 5 ELSE 0 END AS value FROM range(40) p(i), range(17) q(j) LEFT JOIN v ON v.z = 2 AND v.x = (i * 25) // 40 AND v.y = (j * 25) // 17")
def r11_resized_mask(spark: S, d: str) -> D:
    mask = voxels(spark, d).where("z = 2").select("x", "y", F.when(F.col("gray") < 100, 1).otherwise(0).alias("value"))
    return res.resize_mask(mask, (25, 25), (40, 17), 5)


@query(WITH + ", h AS (SELECT volume_id, z, gray // 32 AS b, count(*) AS n FROM v GROUP BY ALL), s AS (SELECT volume_id, z, b, n / sum(n) OVER (PARTITION BY volume_id, z) AS share FROM h) SELECT a.volume_id, a.z, round(sum(least(a.share, b.share)), 6) AS alike FROM s a JOIN s b ON b.volume_id = a.volume_id AND b.z = a.z + 1 AND b.b = a.b GROUP BY ALL")
def f25_histogram_intersection(spark: S, d: str) -> D:
    """what the gray histograms of each slice and the next have in common."""
    share = [(F.sum((F.expr("gray div 32") == k).cast("int")) / F.count("*")) for k in range(8)]
    h = voxels(spark, d).groupBy("volume_id", "z").agg(F.array(*share).alias("h"))
    after = h.select("volume_id", (F.col("z") - 1).alias("z"), F.col("h").alias("next"))
    return h.join(after, ["volume_id", "z"]).select("volume_id", "z", fx.intersection(F.col("h"), F.col("next")).alias("alike"))
