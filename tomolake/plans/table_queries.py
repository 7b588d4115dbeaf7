"""Queries over pores, boxes, calibration points, series, frames and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomolake.functions import physics as fx
from tomolake.operators import calibrate, network, relaxation, series, stats
from tomolake.plans import fixtures as fix
from tomolake.plans.fixtures import FRAMES, POINTS, PORES, SERIES, VOX
from tomolake.plans.registry import query
from tomolake.sources.shared import written
from tomolake.streaming import frames as fr

S, D = SparkSession, DataFrame
PAIRS = f"WITH {PORES}, q AS (SELECT avg(radius) AS mean FROM pores), pairs AS (SELECT a.id AS id1, b.id AS id2, a.radius AS r1, b.radius AS r2, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS distance FROM pores a JOIN pores b ON a.id < b.id AND abs(a.x - b.x) <= 100 AND abs(a.y - b.y) <= 100), ok AS (SELECT pairs.* FROM pairs, q WHERE distance <= 3 * mean AND (r1 + r2 - distance) / least(r1, r2) >= 0.1)"


@query(PAIRS + " SELECT id1, id2, round(r1, 6) AS r1, round(r2, 6) AS r2, round(distance, 6) AS distance FROM ok")
def j06_connectable_pairs(spark: S, d: str) -> D:
    """A range join on grid cells."""
    return network.connectable_pairs(fix.pores(spark, d))


@query(PAIRS + ", b AS (SELECT id1 AS id, id2 AS other, distance FROM ok UNION ALL SELECT id2, id1, distance FROM ok), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS rank FROM b) SELECT id, other, round(distance, 6) AS distance, rank FROM r WHERE rank <= 6")
def w06_nearest_lists(spark: S, d: str) -> D:
    return network.nearest_connectable(fix.pores(spark, d)).select("id", "other", "distance", "rank")


#: Throats where no pore has more than six candidates, as in the given pores.
OPEN = PAIRS.replace("WITH ", "WITH RECURSIVE ", 1) + ", bo AS (SELECT id1 AS id, id2 AS other, distance, r1, r2 FROM ok UNION ALL SELECT id2, id1, distance, r2, r1 FROM ok), t AS (SELECT id AS pore1, other AS pore2, distance, r1, r2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS rank FROM bo) WHERE rank <= 6 AND id < other)"


@query(OPEN + " SELECT pore1, pore2, round(distance, 6) AS distance, round(0.4 * least(r1, r2), 6) AS radius, round(greatest(0.1, distance - r1 - r2), 6) AS length, round(pi() * pow(0.4 * least(r1, r2), 2) * greatest(0.1, distance - r1 - r2), 6) AS volume FROM t")
def c09_throats(spark: S, d: str) -> D:
    """W07, F04 and C09; the cap on crowded pores is held against one pass in order in the tests."""
    return network.throats(fix.pores(spark, d))


@query(OPEN + ", e AS (SELECT pore1 AS a, pore2 AS b FROM t UNION ALL SELECT pore2, pore1 FROM t), r(id, root) AS (SELECT id, id FROM pores UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b), c AS (SELECT id, min(root) AS cluster FROM r GROUP BY id), n AS (SELECT a AS id, count(*) AS connections FROM e GROUP BY a) SELECT c.id, coalesce(connections, 0) AS connections, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM c LEFT JOIN n USING (id)")
def c14_connections_and_clusters(spark: S, d: str) -> D:
    """C14, T03."""
    p = fix.pores(spark, d)
    t = written(network.throats(p), "throats")
    return network.connection_counts(p, t).select("id", "connections").join(network.clusters(p, t).select("id", "cluster", "size"), "id")


SPARSE = PAIRS.replace("FROM part))", "FROM part)), small AS (SELECT id, x, y, z, radius / 3 AS radius FROM pores)").replace("FROM pores a JOIN pores b", "FROM small a JOIN small b").replace("avg(radius) AS mean FROM pores", "avg(radius) AS mean FROM small")
FLOW = f"""{SPARSE.replace("WITH ", "WITH RECURSIVE ", 1)}, bo AS (SELECT id1 AS id, id2 AS other, distance, r1, r2 FROM ok UNION ALL SELECT id2, id1, distance, r2, r1 FROM ok),
t AS (SELECT id AS pore1, other AS pore2, distance, r1, r2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS rank FROM bo) WHERE rank <= 6 AND id < other),
e AS (SELECT pore1 AS a, pore2 AS b FROM t UNION ALL SELECT pore2, pore1 FROM t), r(id, root) AS (SELECT id, id FROM small UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b),
c AS (SELECT id, min(root) AS cluster FROM r GROUP BY id), z AS (SELECT cluster, row_number() OVER (ORDER BY count(*) DESC, cluster) AS place FROM c GROUP BY cluster),
p AS (SELECT small.*, c.cluster, place FROM small JOIN c USING (id) JOIN z USING (cluster)), n AS (SELECT greatest(1, CAST(floor(count(*) * 0.1) AS BIGINT)) AS k FROM small),
side AS (SELECT cluster, i <= k AS inlet, j <= k AS outlet FROM (SELECT cluster, row_number() OVER (ORDER BY z, id) AS i, row_number() OVER (ORDER BY z DESC, id DESC) AS j FROM p), n),
open AS (SELECT count(*) AS n FROM (SELECT cluster FROM side GROUP BY cluster HAVING max(inlet) AND max(outlet))),
near AS (SELECT a.place, arg_min((a.id, b.id, a.radius, b.radius), (sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), b.id, a.id)) AS w, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))) AS distance FROM p a JOIN p b ON b.place < a.place, open WHERE open.n = 0 GROUP BY a.place),
al AS (SELECT pore1, pore2, distance, r1, r2 FROM t UNION ALL SELECT least(w[1], w[2]), greatest(w[1], w[2]), distance, w[3], w[4] FROM near)
SELECT pore1, pore2, round(distance, 6) AS distance, round(0.4 * least(r1, r2), 6) AS radius, round(greatest(0.1, distance - r1 - r2), 6) AS length, round(pi() * pow(0.4 * least(r1, r2), 2) * greatest(0.1, distance - r1 - r2), 6) AS volume FROM al"""


@query(FLOW)
def c10_flow_path(spark: S, d: str) -> D:
    """Pores of a third of the radius, which leave many clusters; no pore has more than six candidates then."""
    p = fix.pores(spark, d).withColumn("radius", F.col("radius") / 3)
    return network.enforce_flow_path(p, written(network.throats(p), "throats"))


@query()
def c13_tortuosity(spark: S, d: str) -> D:
    """C11, C12, C13 and T04."""
    p = fix.pores(spark, d)
    return network.tortuosity(p, written(network.throats(p), "throats"))


@query(f"WITH {PORES}, n AS (SELECT greatest(1, CAST(floor(count(*) * 0.1) AS BIGINT)) AS k FROM pores), r AS (SELECT id, row_number() OVER (ORDER BY z, id) AS i, row_number() OVER (ORDER BY z DESC, id DESC) AS j FROM pores) SELECT id, 'inlet' AS side FROM r, n WHERE i <= k UNION ALL SELECT id, 'outlet' FROM r, n WHERE j <= k")
def t05_inlets_outlets(spark: S, d: str) -> D:
    return network.inlets_outlets(fix.pores(spark, d))


@query(f"WITH {PORES}, s AS (SELECT min(x) AS lo, max(x) AS hi, 2 * avg(radius) AS near FROM pores) SELECT id, 'inlet' AS side FROM pores, s WHERE x <= lo + near UNION ALL SELECT id, 'outlet' FROM pores, s WHERE x >= hi - near")
def c11_boundary_pores(spark: S, d: str) -> D:
    return network.boundary_pores(fix.pores(spark, d), "x")


@query(f"WITH {PORES}, s AS (SELECT min(radius) AS lo, max(radius) AS hi, sum(volume) AS total FROM pores), k AS (SELECT CAST(floor((radius - lo) / ((hi - lo) / 10)) AS BIGINT) AS bin, count(*) AS n, sum(volume) AS volume FROM pores, s GROUP BY ALL) SELECT i AS bin, round(lo + i * ((hi - lo) / 10), 6) AS from_radius, coalesce(n, 0) AS n, round(coalesce(volume / total, 0), 6) AS share FROM range(10) r(i) CROSS JOIN s LEFT JOIN k ON k.bin = i")
def a13_pore_size_distribution(spark: S, d: str) -> D:
    return stats.pore_size_distribution(fix.pores(spark, d))


@query(f"WITH {PORES}, q AS (SELECT id AS i, id + 1 AS j FROM pores), t AS (SELECT 0.4 * least(a.radius, b.radius) AS radius, 5.0 AS length FROM q JOIN pores a ON a.id = q.i JOIN pores b ON b.id = q.j), p AS (SELECT sum(4 / CAST(3 AS DOUBLE) * pi() * pow(radius, 3)) AS pv, sum(4 * pi() * pow(radius, 2)) AS ps FROM pores), u AS (SELECT sum(pi() * pow(radius, 2) * length) AS tv, sum(2 * pi() * radius * length) AS ts FROM t), k AS (SELECT least(0.999, greatest(0.001, (pv + tv) / 1e9)) AS porosity, (ps + ts) / 1e9 AS s FROM p, u) SELECT round(porosity, 6) AS porosity, round(s, 6) AS specific_surface, round(pow(porosity, 3) / (5 * pow(s, 2) * pow(1 - porosity, 2)), 6) AS permeability FROM k")
def a15_kozeny_carman(spark: S, d: str) -> D:
    return stats.kozeny_carman(fix.pores(spark, d), _chain(spark, d), 1e9)


def _chain(spark: S, d: str) -> D:
    """Throats between pores of consecutive ids."""
    p = fix.pores(spark, d)
    a, b = (p.select(F.col("id").alias(f"pore{k}"), F.col("radius").alias(f"r{k}")) for k in (1, 2))
    t = a.join(b, F.col("pore2") == F.col("pore1") + 1)
    r = 0.4 * F.least("r1", "r2")
    return t.select("pore1", "pore2", r.alias("radius"), F.lit(5.0).alias("length"), (F.pi() * r * r * 5.0).alias("volume"))


@query(f"WITH {PORES}, t AS (SELECT 0.4 * least(a.radius, b.radius) AS radius FROM pores a JOIN pores b ON b.id = a.id + 1), s AS (SELECT count(*) AS n_pores, sum(volume) AS pore_volume, (max(x + radius) - min(x - radius)) * (max(y + radius) - min(y - radius)) * (max(z + radius) - min(z - radius)) AS box FROM pores), u AS (SELECT count(*) AS n_throats, sum(pi() * radius * radius * 5.0) AS throat_volume, avg(radius) AS mean_throat_radius, min(radius) AS min_throat_radius, max(radius) AS max_throat_radius FROM t) SELECT n_pores, n_throats, round(pore_volume, 4) AS pore_volume, round(throat_volume, 4) AS throat_volume, round(mean_throat_radius, 6) AS mean_throat_radius, round(min_throat_radius, 6) AS min_throat_radius, round(max_throat_radius, 6) AS max_throat_radius, round(least(1.0, (pore_volume + throat_volume) / box), 6) AS porosity, round(2.0 * n_throats / n_pores, 6) AS mean_connections FROM s, u")
def a11_network_properties(spark: S, d: str) -> D:
    """A11, A12 and A16."""
    s = stats.network_properties(fix.pores(spark, d), _chain(spark, d))
    return s.select("n_pores", "n_throats", F.round("pore_volume", 4).alias("pore_volume"), F.round("throat_volume", 4).alias("throat_volume"), "mean_throat_radius", "min_throat_radius", "max_throat_radius", "porosity", "mean_connections")


@query(f"WITH {PORES}, s AS (SELECT min(x) AS lo, max(x) AS hi, 2 * avg(radius) AS near, (max(x + radius) - min(x - radius)) * 1e-6 AS len, (max(y + radius) - min(y - radius)) * (max(z + radius) - min(z - radius)) * 1e-12 AS area, (max(x) - min(x)) * 10 AS drop FROM pores), f AS (SELECT id, x, radius, x <= lo + near AND NOT x >= hi - near AS inlet FROM pores, s), q AS (SELECT coalesce(sum(CASE WHEN a.inlet <> b.inlet THEN abs(pi() * pow(0.4 * least(a.radius, b.radius) * 1e-6, 4) / (8 * 0.001 * 5.0 * 1e-6) * (a.x - b.x) * 10) END), 0) AS flow FROM f a JOIN f b ON b.id = a.id + 1) SELECT round(flow * 1e12, 6) AS flow_e12, round(flow * 0.001 * len / (area * drop) / 9.869233e-13, 6) AS permeability FROM q, s")
def c15_flow_permeability(spark: S, d: str) -> D:
    """F05, F06, F07, A14, A17 and C15, with a pressure linear in x."""
    p = fix.pores(spark, d)
    found = network.flow_permeability(p, _chain(spark, d), p.select(F.col("id").alias("pore_id"), (F.col("x") * 10).alias("pressure")), 0.001)
    return found.select((F.col("flow") * 1e12).alias("flow_e12"), "permeability")


@query(f"WITH {PORES}, {VOX}, s AS (SELECT id, min(d2) AS d2 FROM (SELECT p.id, q.id AS qid, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) AS d2 FROM pores p JOIN pores q ON p.id % 2 = 1 AND q.id % 2 = 0 AND abs(p.x - q.x) <= 40 AND abs(p.y - q.y) <= 40) WHERE d2 < 1600 GROUP BY id), n AS (SELECT p.id, arg_min(q.radius, (q.x, q.y, q.z)) AS density FROM pores p JOIN s ON s.id = p.id JOIN pores q ON q.id % 2 = 0 AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) = s.d2 GROUP BY p.id) SELECT p.id, round(coalesce(n.density, 1000), 6) AS density FROM pores p LEFT JOIN n ON n.id = p.id WHERE p.id % 2 = 1")
def j11_nearest_sample(spark: S, d: str) -> D:
    p = fix.pores(spark, d)
    samples = p.where("id % 2 = 0").select("x", "y", "z", F.col("radius").alias("density"))
    return network.nearest_sample(p.where("id % 2 = 1").select("id", "x", "y", "z"), samples, 40.0, 1000.0).select("id", "density")


@query(f"WITH {PORES}, c AS (SELECT p.id, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) AS d2, q.radius AS r, row_number() OVER (PARTITION BY p.id ORDER BY (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z), q.x, q.y, q.z) AS i FROM pores p JOIN pores q ON p.id % 2 = 1 AND q.id % 2 = 0 AND abs(p.x - q.x) <= 60 AND abs(p.y - q.y) <= 60 AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) <= 3600), b AS (SELECT id, coalesce(max(CASE WHEN d2 = 0 THEN r END), sum(CASE WHEN d2 > 0 THEN r / d2 END) / sum(CASE WHEN d2 > 0 THEN 1 / d2 END)) AS density FROM c WHERE i <= 5 GROUP BY id) SELECT p.id, round(coalesce(density, 1000), 6) AS density FROM pores p LEFT JOIN b ON b.id = p.id WHERE p.id % 2 = 1")
def j12_interpolated_sample(spark: S, d: str) -> D:
    p = fix.pores(spark, d)
    samples = p.where("id % 2 = 0").select("x", "y", "z", F.col("radius").alias("density"))
    return network.interpolated_sample(p.where("id % 2 = 1").select("id", "x", "y", "z"), samples, 60.0, 1000.0).select("id", "density")


KNOTS = "knots AS (SELECT * FROM (VALUES (20.0, 1000.0), (90.0, 2100.0), (150.0, 2650.0), (230.0, 4100.0)) t(kx, ky)), seg AS (SELECT kx, ky, lead(kx) OVER (ORDER BY kx) AS kx2, lead(ky) OVER (ORDER BY kx) AS ky2 FROM knots)"


@query(f"WITH {VOX}, {KNOTS} SELECT volume_id, x, y, z, round(CASE WHEN gray <= 20 THEN 1000 WHEN gray >= 230 THEN 4100 ELSE (SELECT ky + (ky2 - ky) * (gray - kx) / (kx2 - kx) FROM seg WHERE kx <= gray AND gray < kx2) END, 6) AS density FROM v")
def j13_density_from_gray(spark: S, d: str) -> D:
    """Each voxel's gray between two points of a calibration."""
    knots = spark.createDataFrame([(20.0, 1000.0), (90.0, 2100.0), (150.0, 2650.0), (230.0, 4100.0)], "x double, y double")
    v = fix.voxels(spark, d).select("volume_id", F.col("x").alias("vx"), F.col("y").alias("vy"), "z", "gray")
    return network.bracket(v, knots, "gray").select("volume_id", F.col("vx").alias("x"), F.col("vy").alias("y"), "z", F.col("interpolated").alias("density"))


@query(f"WITH {VOX}, q AS (SELECT volume_id, x, y, z, least(1.0, greatest(0.0, ((x - 2) * 18.0 + (y - 3) * 12.0) / 468.0)) AS t FROM v) SELECT volume_id, x, y, z, round(sqrt(pow(x - (2 + t * 18), 2) + pow(y - (3 + t * 12), 2) + pow(z - 1.0, 2)), 6) AS distance FROM q")
def j17_path_distance(spark: S, d: str) -> D:
    return network.path_distance(fix.voxels(spark, d).select("volume_id", "x", "y", "z"), [(2, 3, 1), (20, 15, 1)])


FIT = "round(regr_slope({y}, {x}), 6) AS slope, round(regr_intercept({y}, {x}), 6) AS intercept, round(regr_r2({y}, {x}), 6) AS r2"


@query(f"WITH {POINTS} SELECT count(*) AS n, {FIT.format(x='gray', y='density')}, round(sqrt(var_pop(density) - pow(covar_pop(density, gray), 2) / var_pop(gray)), 6) AS rmse FROM pts")
def k01_density_line(spark: S, d: str) -> D:
    """A32 and K01."""
    return calibrate.density_line(fix.calibration(spark, d))


@query(f"WITH {POINTS} SELECT pressure_mpa AS pressure, count(*) AS n, round(regr_slope(youngs, density), 6) AS young_slope, round(regr_intercept(youngs, density), 4) AS young_intercept, round(regr_r2(youngs, density), 6) AS young_r2, round(regr_slope(poisson, vp_vs), 6) AS poisson_slope, round(regr_intercept(poisson, vp_vs), 6) AS poisson_intercept, round(regr_r2(poisson, vp_vs), 6) AS poisson_r2 FROM pts GROUP BY ALL HAVING count(*) >= 2")
def k02_pressure_models(spark: S, d: str) -> D:
    m = calibrate.pressure_models(fix.calibration(spark, d))
    return m.withColumn("young_intercept", F.round("young_intercept", 4))


@query(f"WITH {POINTS}, md AS (SELECT pressure_mpa AS pressure, regr_slope(youngs, density) AS a, regr_intercept(youngs, density) AS b FROM pts GROUP BY ALL HAVING count(*) >= 2), w AS (SELECT pressure_mpa + 0.3 AS target, density AS x FROM pts), n AS (SELECT target, arg_min(pressure, (abs(pressure - target), pressure)) AS pressure FROM (SELECT DISTINCT target FROM w), md GROUP BY target) SELECT w.target, round(x, 6) AS x, round(coalesce(a * x + b, 0), 3) AS predicted FROM w JOIN n USING (target) JOIN md USING (pressure)")
def k03_predictions(spark: S, d: str) -> D:
    """K03 and J15."""
    p = fix.calibration(spark, d)
    return calibrate.predict(p.select((F.col("pressure_mpa") + 0.3).alias("target"), F.col("density").alias("x")), calibrate.pressure_models(p), "young").withColumn("predicted", F.round("predicted", 3))


@query(f"WITH {POINTS} SELECT count(*) AS n, {FIT.format(x='log10(sim_t2)', y='log10(ref_t2)')}, round(sqrt(var_pop(log10(ref_t2)) - pow(covar_pop(log10(ref_t2), log10(sim_t2)), 2) / var_pop(log10(sim_t2))), 6) AS rmse FROM pts")
def k04_t2_calibration(spark: S, d: str) -> D:
    return calibrate.t2_calibration(fix.calibration(spark, d))


@query(f"WITH {POINTS}, f AS (SELECT count(*) AS n, 'linear' AS kind, {FIT.format(x='sim_amp', y='ref_amp')}, 0 AS turn FROM pts UNION ALL SELECT count(*), 'power', {FIT.format(x='log10(sim_amp)', y='log10(ref_amp)')}, 1 FROM pts) SELECT n, kind, slope, intercept, r2 FROM f ORDER BY r2 DESC, turn LIMIT 1")
def k05_amplitude_calibration(spark: S, d: str) -> D:
    return calibrate.amplitude_calibration(fix.calibration(spark, d))


@query(f"WITH {SERIES}, w AS (SELECT *, avg(abs(v)) OVER (PARTITION BY series_id ORDER BY step ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS e0 FROM series), " + ", ".join(f"w{i} AS (SELECT *, coalesce((lag(e{i - 1}) OVER s + 2 * e{i - 1} + lead(e{i - 1}) OVER s) / 4, e{i - 1}) AS e{i} FROM {'w' if i == 1 else f'w{i - 1}'} WINDOW s AS (PARTITION BY series_id ORDER BY step))" for i in (1, 2, 3)) + " SELECT series_id, step, round(v, 6) AS v, round(e3, 4) AS envelope FROM w3")
def w12_envelope(spark: S, d: str) -> D:
    return series.envelope(fix.series(spark, d), ["series_id"], "step").withColumn("envelope", F.round("envelope", 4))


@query(f"WITH {SERIES} SELECT series_id, step, round(v, 6) AS v, coalesce(v > lag(v) OVER s AND v > lead(v) OVER s, false) AS is_peak FROM series WINDOW s AS (PARTITION BY series_id ORDER BY step)")
def w02_local_maxima(spark: S, d: str) -> D:
    return series.local_maxima(fix.series(spark, d), ["series_id"], "step")


@query(f"WITH {SERIES}, o AS (SELECT a, exp(-a * a / 2.0) AS wt FROM range(-3, 4) r(a)) SELECT s.series_id, s.step, round(any_value(s.v), 6) AS v, round(sum(n.v * wt) / sum(wt), 6) AS smooth FROM series s, o, series n WHERE n.series_id = s.series_id AND n.step = s.step + a GROUP BY s.series_id, s.step")
def w01_gaussian_smooth(spark: S, d: str) -> D:
    return series.gaussian_smooth(fix.series(spark, d), 1.0, ["series_id"], "step")


@query()
def w03_peaks(spark: S, d: str) -> D:
    """W03, W04 and W16; held against a plain version in the tests."""
    found = series.peaks(fix.series(spark, d), ["series_id"], "step", 5.0, 3)
    return series.peak_spacing(found, ["series_id"], "step", 0.001)


@query(f"WITH RECURSIVE {SERIES}, s AS (SELECT *, step - min(step) OVER (PARTITION BY series_id) AS i FROM series), r(series_id, step, i, v, y, z) AS (SELECT series_id, step, i, v, 0.0::DOUBLE, 0.0::DOUBLE FROM s WHERE i = 0 UNION ALL SELECT s.series_id, s.step, s.i, s.v, 0.9 * (r.y + s.v - r.v), r.z + 0.3 * (0.9 * (r.y + s.v - r.v) - r.z) FROM r JOIN s ON s.series_id = r.series_id AND s.i = r.i + 1) SELECT series_id, step, round(y + 1e-9, 6) + 0.0 AS high_pass, round(z + 1e-9, 6) + 0.0 AS band_pass FROM r")
def w13_band_pass(spark: S, d: str) -> D:
    """W13; off the halves of the last place kept, on which values of few decimals fall."""
    found = series.band_pass(fix.series(spark, d), ["series_id"], "step", 0.9, 0.3)
    return found.select("series_id", "step", *[(F.col(c) + 1e-9).alias(c) for c in ("high_pass", "band_pass")])


@query(f"WITH {SERIES} SELECT series_id, step, round(v, 6) AS v, round(regr_slope(v, step) OVER (PARTITION BY series_id ORDER BY step ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS slope FROM series")
def w14_local_slope(spark: S, d: str) -> D:
    return series.local_slope(fix.series(spark, d), ["series_id"], "step", "step", "v")


@query(f"WITH {SERIES} SELECT series_id, step, count(*) OVER r AS n, round(sum(v) OVER r, 4) AS total FROM series WINDOW r AS (PARTITION BY series_id ORDER BY step ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)")
def v07_rolling_values(spark: S, d: str) -> D:
    s = series.rolling_values(fix.series(spark, d), ["series_id"], "step", "v", 100)
    total = F.aggregate("recent", F.lit(0.0), lambda a, x: a + x)
    return s.select("series_id", "step", F.size("recent").alias("n"), F.round(total, 4).alias("total"))


P = f"WITH {FRAMES}, f AS (SELECT *, max(abs(p_value)) OVER w AS tp, max(abs(s_value)) OVER w AS ts FROM frames WINDOW w AS (PARTITION BY run_id ORDER BY step ROWS UNBOUNDED PRECEDING)), p AS (SELECT run_id, min(CASE WHEN abs(p_value) > 1e-9 OR abs(p_value) > greatest(1e-10, 0.01 * tp) THEN step END) AS p_step FROM f GROUP BY run_id), s AS (SELECT f.run_id, p_step, min(CASE WHEN step >= p_step + 10 AND abs(s_value) > 0.15 * ts AND abs(s_value) > abs(p_value) AND step / p_step BETWEEN 1.3 AND 2.8 AND abs(step / p_step - 1.7) <= 0.05 * 1.7 THEN step END) AS s_step FROM f JOIN p ON p.run_id = f.run_id GROUP BY ALL)"


@query(P + ", q AS (SELECT run_id, p_step, s_step, coalesce(CASE WHEN p_step > 0 THEN 0.02 / (p_step * 1e-6) END, 5000) AS vp, coalesce(CASE WHEN s_step > 0 THEN 0.02 / (s_step * 1e-6) END, 2900) AS vs FROM s) SELECT run_id, p_step, s_step, round(vp, 6) AS vp, round(vs, 6) AS vs, round(vp / vs, 6) AS vp_vs FROM q")
def v06_arrivals_and_velocities(spark: S, d: str) -> D:
    """V04, V05, V06 and F11."""
    f = fix.frames(spark, d)
    return fr.velocities(fr.s_arrivals(f, fr.p_arrivals(f), 1.7), 0.02, 1e-6, 5000.0, 2900.0)


@query(f"WITH {FRAMES}, q AS (SELECT run_id, max(abs(p_value)) AS max_p, max(abs(s_value)) AS max_s FROM frames GROUP BY run_id), r AS (SELECT *, least(1.0, greatest(0.0, (log10(greatest(least(max_p, max_s), 1e-12)) + 12) / 12)) AS score FROM q) SELECT run_id, round(max_p, 6) AS max_p, round(max_s, 6) AS max_s, round(score, 6) AS score, CASE WHEN score >= 0.75 THEN 'good' WHEN score >= 0.4 THEN 'fair' ELSE 'poor' END AS quality FROM r")
def v08_signal_quality(spark: S, d: str) -> D:
    return fr.signal_quality(fix.frames(spark, d))


@query("WITH e AS (SELECT vec_id, label, embedding FROM embeddings), a AS (SELECT x.vec_id AS id1, y.vec_id AS id2, list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(y.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])))) AS cosine FROM e x JOIN e y ON y.vec_id = x.vec_id + 1) SELECT id1, id2, round(cosine, 6) AS cosine FROM a")
def f25_cosine(spark: S, d: str) -> D:
    """Each vector with the next."""
    e = fix.table(spark, d, "embeddings")
    a, b = (e.select(F.col("vec_id").alias(f"id{k}"), F.col("embedding").alias(f"e{k}")) for k in (1, 2))
    return a.join(b, F.col("id2") == F.col("id1") + 1).select("id1", "id2", fx.cosine(F.col("e1"), F.col("e2")).alias("cosine"))


@query(f"WITH {PORES} SELECT id, round(cbrt(3 * volume / (4 * pi())), 6) AS sphere, round(sqrt(volume / pi()), 6) AS disc, round(greatest(1.0, least(5000.0, 2 * radius / 3 * 1.15)), 6) AS t2, round(pow(0.25, 3) / pow(0.75, 2) / (pow(0.3, 3) / pow(0.7, 2)), 6) AS ratio, round(45 + radius / 2, 6) AS angle, round(sqrt(2 * (1 - radius / 200) / (1 - 2 * (radius / 200))), 6) AS vp_vs FROM pores")
def f03_rock_formulas(spark: S, d: str) -> D:
    """F03, F10, F13, F33 and F36 over the pores."""
    p = fix.pores(spark, d)
    r = F.col("radius")
    return p.select("id", fx.sphere_radius(F.col("volume")).alias("sphere"), fx.disc_radius(F.col("volume")).alias("disc"), fx.estimated_t2(r, F.lit(0.3)).alias("t2"), fx.permeability_ratio(F.lit(0.25), F.lit(0.3)).alias("ratio"), fx.failure_angle(r).alias("angle"), fx.vp_vs_from_poisson(r / 200).alias("vp_vs"))


@query("WITH t AS (SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderkey % 25 AS x1, (o_orderkey // 25) % 25 AS y1, (o_orderkey * 7) % 25 AS x2, (o_orderkey * 11) % 25 AS y2 FROM orders), q AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS metres, (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS l2 FROM t), u AS (SELECT *, CASE WHEN l2 > 0 THEN least(1.0, greatest(0.0, ((10 - x1) * (x2 - x1) + (12 - y1) * (y2 - y1)) / CAST(l2 AS DOUBLE))) ELSE 0.0 END AS s FROM q) SELECT id, round(metres, 6) AS distance, sqrt(pow(10 - (x1 + s * (x2 - x1)), 2) + pow(12 - (y1 + s * (y2 - y1)), 2)) <= 3 AS near FROM u")
def p12_measurements(spark: S, d: str) -> D:
    """Lines between places made from the order keys."""
    k = F.col("o_orderkey")
    t = fix.table(spark, d, "orders").select(k.cast("long").alias("id"), (k % 25).alias("x1"), (F.expr("o_orderkey div 25") % 25).alias("y1"), ((k * 7) % 25).alias("x2"), ((k * 11) % 25).alias("y2"))
    c = [F.col(n) for n in ("x1", "y1", "x2", "y2")]
    return t.select("id", fx.measured_distance(*c, 1.0).alias("distance"), (fx.near_segment(10, 12, *c) <= 3).alias("near"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(regexp_replace('stack_' || o_orderkey || '_b2.bmp', '[^0-9]', '', 'g') AS BIGINT) AS number, CASE o_orderkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE round(3.0 / 5.0, 6) END AS dx FROM orders")
def f26_text_parsing(spark: S, d: str) -> D:
    """F26 and F27."""
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.lit(" X-Axis ")).when(k % 3 == 1, F.lit("")).otherwise(F.lit("3, 0, 4"))
    return fix.table(spark, d, "orders").select(k.cast("long").alias("id"), fx.number_in_name(F.concat(F.lit("stack_"), k.cast("string"), F.lit("_b2.bmp"))).alias("number"), fx.direction(text)[0].alias("dx"))


@query(f"WITH {SERIES} SELECT t, round(sum(abs(v) * exp(-t / (1 + step))), 4) AS m FROM series, (SELECT CAST(i AS DOUBLE) AS t FROM range(1, 9) r(i)) GROUP BY t")
def f19_magnetisation_decay(spark: S, d: str) -> D:
    """Sum of decaying components at eight times: times are a bounded broadcast."""
    times = spark.range(1, 9).select(F.col("id").cast("double").alias("t"))
    s = fix.series(spark, d).crossJoin(F.broadcast(times))
    return s.groupBy("t").agg(F.round(F.sum(fx.decay(F.abs("v"), F.col("t"), 1 + F.col("step"))), 4).alias("m"))


@query(f"WITH {VOX} SELECT round(count(*) / sum(1 / CASE WHEN q.vel >= 500 THEN q.vel ELSE 3000 END), 6) AS velocity FROM (SELECT i, CAST(round(1 + i * (20 - 1) / 23.0) AS BIGINT) AS px, CAST(round(2 + i * (15 - 2) / 23.0) AS BIGINT) AS py FROM range(24) r(i)) p LEFT JOIN (SELECT x, y, z, gray * 20.0 AS vel FROM v) q ON q.x = px AND q.y = py AND q.z = 1")
def a35_path_velocity(spark: S, d: str) -> D:
    field = fix.voxels(spark, d).select("x", "y", "z", (F.col("gray") * 20.0).alias("v"))
    return stats.path_velocity(field, (1, 2, 1), (20, 15, 1), 3000.0)


@query(f"WITH {VOX}, f AS (SELECT gray * 20.0 AS vel FROM v WHERE gray > 0), h AS (SELECT CAST(least(99, greatest(0, floor((vel - 1500) / 30))) AS BIGINT) AS bin, count(*) AS n FROM f GROUP BY ALL) SELECT bin, n, round(n / CAST(max(n) OVER () AS DOUBLE), 6) AS level FROM h")
def a27_velocity_histogram(spark: S, d: str) -> D:
    field = fix.voxels(spark, d).select((F.col("gray") * 20.0).alias("v"))
    return stats.velocity_histogram(field, 3000.0)


@query(f"WITH {VOX}, t AS (SELECT x, y, z, sqrt(pow(gray / 255.0, 2) + pow(x / 25.0, 2) + pow(z / 25.0, 2)) AS s FROM v WHERE x = 10), q AS (SELECT min(s) AS lo, max(s) AS hi FROM t) SELECT 0 AS run_id, 0 AS step, y AS a, z AS b, round((s - lo) / (hi - lo), 6) AS level FROM t, q")
def v02_midplane_map(spark: S, d: str) -> D:
    """V02 and V03."""
    v = fix.voxels(spark, d)
    field = v.select(F.lit(0).cast("long").alias("run_id"), F.lit(0).cast("long").alias("step"), "x", "y", "z", (F.col("gray") / 255).alias("vx"), (F.col("x") / 25).alias("vy"), (F.col("z") / 25).alias("vz"))
    return fr.midplane_map(field, (1, 5, 5), (20, 6, 6))


@query(f"WITH {PORES}, k AS (SELECT *, row_number() OVER (ORDER BY radius DESC, id) AS i FROM pores) SELECT id, round(radius, 6) AS radius FROM k WHERE i <= 25")
def t07_largest(spark: S, d: str) -> D:
    """A top-k report."""
    return fix.pores(spark, d).orderBy(F.desc("radius"), "id").limit(25).select("id", "radius")


@query(f"WITH {VOX} SELECT 'union' AS kind, count(*) AS n FROM (SELECT x, y, z FROM v WHERE label = 1 UNION SELECT x, y, z FROM sel) UNION ALL SELECT 'difference', count(*) FROM (SELECT x, y, z FROM v WHERE label = 1 EXCEPT SELECT x, y, z FROM sel) UNION ALL SELECT 'intersection', count(*) FROM (SELECT x, y, z FROM v WHERE label = 1 INTERSECT SELECT x, y, z FROM sel) UNION ALL SELECT 'labels', count(DISTINCT label) FROM v")
def u01_mask_sets(spark: S, d: str) -> D:
    """U01, U02, U03 and U06."""
    v = fix.voxels(spark, d)
    a = v.where("label = 1").select("x", "y", "z")
    b = fix.selections(spark, d).select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("fixed").alias("z"))
    parts = [("union", a.unionByName(b).distinct()), ("difference", a.subtract(b)), ("intersection", a.intersect(b)), ("labels", v.select("label").distinct())]
    counts = [p.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, p in parts]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query(f"WITH {PORES}, q AS (SELECT id, x / 10 AS s1, (radius - 10) / 4 AS s3 FROM pores), t AS (SELECT *, (CASE WHEN s3 < 0 THEN 20 * cos(radians(30)) * (1 - 0.3 * least(1.0, abs(s3) / 5)) ELSE 20 * cos(radians(30)) + (s1 + s3) * sin(radians(30)) END) / (1 - sin(radians(30))) AS threshold FROM q), r AS (SELECT id, (s1 - s3) / threshold AS ratio FROM t) SELECT id, round(CASE WHEN ratio < 0.4 THEN ratio * 0.025 WHEN ratio < 0.7 THEN 0.01 + (ratio - 0.4) * 0.3 WHEN ratio < 0.9 THEN 0.1 + (ratio - 0.7) * 2 WHEN ratio < 1 THEN 0.5 + (ratio - 0.9) * 4 ELSE least(1.0, 0.9 + (ratio - 1) * 0.2) END, 6) AS probability FROM r")
def f17_fracture_probability(spark: S, d: str) -> D:
    p = fix.pores(spark, d)
    return p.select("id", fx.fracture_probability(F.col("x") / 10, (F.col("radius") - 10) / 4, 10.0, 30.0).alias("probability"))


@query(f"WITH {POINTS}, q AS (SELECT id, (pressure_mpa - 4) / 1000 AS e, poisson AS nu, youngs / (3 * (1 - 2 * poisson)) AS k, vp_vs / 10 AS phi, gray / 2560 AS perm FROM pts), b AS (SELECT *, e * (1 - 2 * nu) AS vol, least(0.99, greatest(0.01, 1 / (1 + phi * 2200 / k))) AS skempton FROM q) SELECT id, round(vol, 6) + 0.0 AS volumetric, round(CASE WHEN k < 0.01 THEN 0.9 ELSE least(1.0, greatest(0.5, 1 - k / 36000)) END, 6) AS biot, round(skempton, 6) AS skempton, round(greatest(0.0, 0.1 - vol * k * skempton * (1 - least(1.0, greatest(0.01, perm * 10)))), 6) AS pressure FROM b")
def f14_poroelastic(spark: S, d: str) -> D:
    p, e, nu = fix.calibration(spark, d), (F.col("pressure_mpa") - 4) / 1000, F.col("poisson")
    k, phi = F.col("youngs") / (3 * (1 - 2 * nu)), F.col("vp_vs") / 10
    return p.select("id", fx.volumetric_strain(e, nu).alias("volumetric"), fx.biot(k).alias("biot"), fx.skempton_b(phi, k).alias("skempton"), fx.pore_pressure(e, nu, k, phi, F.col("gray") / 2560).alias("pressure"))


COMPONENTS = f"WITH {PORES}, c AS (SELECT id, least(5000.0, greatest(1.0, 2 * radius / 3 * 1.15)) AS t2, radius AS amplitude, 1 + x / 1000 AS tortuosity FROM pores)"


def _components(spark: S, d: str) -> D:
    """A component for each pore."""
    return fix.pores(spark, d).select("id", fx.estimated_t2(F.col("radius"), F.lit(0.3)).alias("t2"), F.col("radius").alias("amplitude"), (1 + F.col("x") / 1000).alias("tortuosity"))


@query(COMPONENTS + ", g AS (SELECT CAST(i AS BIGINT) AS bin, pow(10, i * log10(5000) / 31) AS v FROM range(32) r(i)), n AS (SELECT id, amplitude, arg_min(bin, (abs(t2 - v), bin)) AS bin FROM c, g GROUP BY id, amplitude), s AS (SELECT bin, sum(amplitude) AS amount FROM n GROUP BY bin) SELECT bin, round(v, 6) AS t2, round(coalesce(amount, 0) / (SELECT sum(amplitude) FROM c), 6) AS share FROM g LEFT JOIN s USING (bin)")
def a24_t2_distribution(spark: S, d: str) -> D:
    return relaxation.t2_distribution(_components(spark, d))


@query(COMPONENTS + " SELECT round((SELECT sum(volume) / 1e9 FROM pores), 6) AS total_porosity, round(sum(amplitude * tortuosity) / sum(amplitude), 6) AS average_tortuosity, round(sum(amplitude * t2) / sum(amplitude), 6) AS average_t2 FROM c")
def a25_relaxation_summary(spark: S, d: str) -> D:
    p = fix.pores(spark, d).withColumn("volume", 4 / 3 * F.pi() * F.pow("radius", F.lit(3)))
    return relaxation.summary(_components(spark, d), p.groupBy((F.col("id") % 3).alias("material")).agg((F.sum("volume") / 1e9).alias("porosity")))


@query(f"WITH {PORES}, q AS (SELECT id, 1e5 * (1 + x) AS g, radius * 1e-6 AS r, z / 2000 AS phi FROM pores), k AS (SELECT id, g, r, r * r / 8 AS k, 1.75 / (CASE WHEN phi > 0 THEN phi ELSE 0.4 END * 2 * r) * 1000 AS a FROM q), v AS (SELECT *, (sqrt(pow(1e-3 / k, 2) + 4 * a * g) - 1e-3 / k) / (2 * a) AS velocity FROM k) SELECT id, round(2 * r * (k / 1e-3 * g) * 1000 / 1e-3, 6) AS reynolds, round(velocity, 6) AS velocity, round(velocity * 1e-3 / g * 1e12, 6) AS apparent_um2 FROM v")
def f08_apparent_permeability(spark: S, d: str) -> D:
    """A sample for each pore, of its radius; none has a permeability of its own."""
    samples = fix.pores(spark, d).select("id", (1e5 * (1 + F.col("x"))).alias("gradient"), (F.col("radius") * 1e-6).alias("throat_radius"), (F.col("z") / 2000).alias("porosity"), F.lit(None).cast("double").alias("permeability"))
    return network.apparent_permeability(samples, 1e-3, 1000.0).select("id", "reynolds", "velocity", (F.col("apparent") * 1e12).alias("apparent_um2"))


@query(f"WITH {PORES}, s AS (SELECT min(z) AS low, max(z) AS high FROM pores), t AS (SELECT id, (z - low) / (high - low) AS t FROM pores, s) SELECT id, round((2000 - t * 1500) * (1 + 0.2 * 0.5 * 4 * t * (1 - t)), 6) AS pressure FROM t")
def f09_axial_pressures(spark: S, d: str) -> D:
    return network.axial_pressures(fix.pores(spark, d), "z", 2000.0, 500.0, 0.5)


@query(f"WITH {POINTS}, q AS (SELECT id, pressure_mpa * 10 - 5 + gray / 8 AS p, greatest(1000.0, youngs) AS e FROM pts) SELECT id, round(1000 * greatest(p / e, CASE WHEN p <= 18 THEN p / e * (1 + 0.2 * p / 18) WHEN p <= 45 THEN 18 / e + (p - 18) / (0.15 * e) * (1 + 1.05 * pow((p - 18) / 12, 2)) ELSE 18 / e + 27 / (0.15 * e) * 2.05 + (p - 45) / (0.15 * e * (1 + 0.2 * sqrt(greatest(0.001, (p - 45) / 30)))) END), 6) AS millistrain FROM q")
def f35_strain_from_pressure(spark: S, d: str) -> D:
    pressure = F.col("pressure_mpa") * 10 - 5 + F.col("gray") / 8
    return fix.calibration(spark, d).select("id", (1000 * fx.strain_from_pressure(pressure, F.col("youngs"), 30.0)).alias("millistrain"))
