"""Calibration fits: grouped regressions and predictions from them."""

from __future__ import annotations

from math import radians, tan

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomolake.functions.physics import chart_units, vp_vs_from_poisson
from tomolake.operators.network import bracket, nearest_model
from tomolake.operators.stats import linear_fit
from tomolake.sources.shared import written


def density_line(points: DataFrame) -> DataFrame:
    """Line from gray to density; no rows under two points."""
    return linear_fit(points, F.col("gray"), F.col("density")).where("n >= 2")


def pressure_models(points: DataFrame) -> DataFrame:
    """Per pressure (to 0.1) with two points or more: Young's modulus by density and Poisson's ratio by Vp/Vs."""
    p = points.withColumn("pressure", F.bround("pressure_mpa", 1))
    young = linear_fit(p.where("youngs > 0"), F.col("density"), F.col("youngs"), "pressure").where("n >= 2")
    poisson = linear_fit(p.where("poisson > 0"), F.col("vp_vs"), F.col("poisson"), "pressure").where("n >= 2")
    both = young.select("pressure", "n", F.col("slope").alias("young_slope"), F.col("intercept").alias("young_intercept"), F.col("r2").alias("young_r2"))
    return both.join(poisson.select("pressure", F.col("slope").alias("poisson_slope"), F.col("intercept").alias("poisson_intercept"), F.col("r2").alias("poisson_r2")), "pressure", "left")


def predict(wanted: DataFrame, models: DataFrame, kind: str) -> DataFrame:
    """Predictions for (target pressure, x) from the model of the nearest pressure; Poisson's ratio within 0 and 0.5."""
    m = models.select("pressure", F.col(f"{kind}_slope").alias("slope"), F.col(f"{kind}_intercept").alias("intercept")).where("slope IS NOT NULL")
    y = F.col("slope") * F.col("x") + F.col("intercept")
    y = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(0.5), y)), F.lit(0.25)) if kind == "poisson" else F.coalesce(y, F.lit(0.0))
    return wanted.join(nearest_model(wanted.select("target").distinct(), m), "target", "left").select("target", "x", y.alias("predicted"))


def t2_calibration(points: DataFrame) -> DataFrame:
    """Line between the logarithms of simulated and reference relaxation times."""
    return linear_fit(points.where("sim_t2 > 0 AND ref_t2 > 0"), F.log10("sim_t2"), F.log10("ref_t2"))


def amplitude_calibration(points: DataFrame) -> DataFrame:
    """Linear or power law between amplitudes, by the higher R2; linear if equal."""
    line = linear_fit(points, F.col("sim_amp"), F.col("ref_amp")).select("n", F.lit("linear").alias("kind"), "slope", "intercept", "r2", F.lit(0).alias("turn"))
    floor = F.lit(1e-10)
    power = linear_fit(points, F.log10(F.greatest("sim_amp", floor)), F.log10(F.greatest("ref_amp", floor))).select("n", F.lit("power").alias("kind"), "slope", "intercept", "r2", F.lit(1).alias("turn"))
    return line.unionByName(power).orderBy(F.desc("r2"), "turn").limit(1).drop("turn")


def proportional_limit(curve: DataFrame) -> DataFrame:
    """(test_id, limit): axial strain of the first row that leaves the line of the first five by over 2 %; 0.002 else."""
    w = Window.partitionBy("test_id").orderBy("step")
    c = curve.withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("test_id")))
    fit = linear_fit(c.where("i <= 5"), F.col("axial"), F.col("stress"), "test_id").select("test_id", "slope", "intercept")
    off = F.abs(F.col("stress") - (F.col("slope") * F.col("axial") + F.col("intercept"))) > 0.02 * F.abs(F.col("slope") * F.col("axial") + F.col("intercept"))
    first = c.join(fit, "test_id").where(off & (F.col("i") > 5) & (F.col("n") >= 10)).groupBy("test_id").agg(F.min_by("axial", "i").alias("found"))
    return curve.select("test_id").distinct().join(first, "test_id", "left").select("test_id", F.coalesce("found", F.lit(0.002)).alias("limit"))


def youngs_modulus(curve: DataFrame) -> DataFrame:
    """Slope up to the proportional limit (the first five rows if fewer), within 1e3 and 2e5; below an R2 of 0.9 the
    secant at half of the greatest stress."""
    w = Window.partitionBy("test_id").orderBy("step")
    c = curve.join(written(proportional_limit(curve), "limits"), "test_id").withColumn("i", F.row_number().over(w))
    few = F.sum((F.col("axial") <= F.col("limit")).cast("int")).over(Window.partitionBy("test_id")) < 5
    c = c.withColumn("few", few)
    fit = linear_fit(c.where("(few AND i <= 5) OR (NOT few AND axial <= limit)"), F.col("axial"), F.col("stress"), "test_id")
    half = c.withColumn("top", F.max("stress").over(Window.partitionBy("test_id"))).where("stress >= top / 2 AND axial > 0").groupBy("test_id").agg(F.min_by(F.col("stress") / F.col("axial"), "i").alias("secant"))
    e = F.when(F.col("r2") < 0.9, F.coalesce("secant", "slope")).otherwise(F.col("slope"))
    return fit.join(half, "test_id", "left").select("test_id", F.least(F.greatest(e, F.lit(1e3)), F.lit(2e5)).alias("youngs"), "r2")


def yield_strength(curve: DataFrame, offset: float = 0.002) -> DataFrame:
    """(test_id, yield_strength): stress where the curve first crosses the elastic line moved by the offset, between two rows;
    else that of the first row at or beyond the proportional limit; else where the elastic line meets the tangent (over two
    rows to each side) at the peak, in curves of ten rows with three to each side of it; else the greatest stress."""
    # What has a row a test is written: else each use sorts the curves anew, all within one task where there are few tests.
    w = Window.partitionBy("test_id").orderBy("step")
    c = curve.join(written(youngs_modulus(curve), "moduli"), "test_id").withColumn("gap", F.col("stress") - F.col("youngs") * (F.col("axial") - offset))
    c = c.withColumns({"gap0": F.lag("gap").over(w), "stress0": F.lag("stress").over(w), "i": F.row_number().over(w) - 1, "slope": F.regr_slope("stress", "axial").over(w.rowsBetween(-2, 2))})
    c = written(c, "gaps")
    cross = c.where("gap0 > 0 AND gap <= 0").groupBy("test_id").agg(F.min_by(F.col("stress0") + (F.col("stress") - F.col("stress0")) * F.col("gap0") / (F.col("gap0") - F.col("gap")), "step").alias("found"))
    limit = c.join(written(proportional_limit(curve), "limits"), "test_id").where("axial >= limit").groupBy("test_id").agg(F.min_by("stress", "step").alias("at_limit"))
    peak = c.groupBy("test_id").agg(F.max("stress").alias("top"), F.count("*").alias("n"), F.first("youngs").alias("youngs"), F.max_by(F.struct("axial", "stress", "slope", "i"), F.struct("stress", -F.col("step"))).alias("p"))
    meets = F.try_divide(F.col("p.stress") - F.col("p.slope") * F.col("p.axial"), F.col("youngs") - F.col("p.slope"))
    tangent = F.when((F.col("n") >= 10) & F.col("p.i").between(3, F.col("n") - 3) & meets.between(0, F.col("p.axial")), F.col("youngs") * meets)
    positive = lambda x: F.when(x > 0, x)
    found = peak.join(cross, "test_id", "left").join(limit, "test_id", "left")
    return found.select("test_id", F.coalesce(positive(F.col("found")), positive(F.col("at_limit")), positive(tangent), "top").alias("yield_strength"))


def bounded_yield(curve: DataFrame) -> DataFrame:
    """yield_strength() as a calibration takes it: at least 0.8 of the peak of brittle tests, at most 0.6 of ductile ones'
    (brittleness above 0.7, below 0.3), and within 0.0005 and 0.01 of the modulus."""
    y, peak = F.col("yield_strength"), F.col("peak_stress")
    y = F.when(F.col("brittleness") > 0.7, F.greatest(y, 0.8 * peak)).when(F.col("brittleness") < 0.3, F.least(y, 0.6 * peak)).otherwise(y)
    both = written(yield_strength(curve), "yields").join(written(brittleness(curve), "brittleness"), "test_id").join(written(youngs_modulus(curve), "moduli"), "test_id")
    return both.select("test_id", F.greatest(F.col("youngs") * 0.0005, F.least(F.col("youngs") * 0.01, y)).alias("yield_strength"))


def poisson_ratio(curve: DataFrame, tests: DataFrame | None = None, least_rows: int = 5) -> DataFrame:
    """(test_id, poisson) of tests (test_id, confining, youngs, poisson, sigma1, sigma3; 0, the fit's, 0.25 and none by default).

    Where lateral strains are known, minus their slope on axial ones up to the proportional limit; where only volumetric
    ones are, from the bulk modulus (their slope of the mean stress) and the shear modulus; each within 0 and 0.499 and
    from `least_rows` rows. Else by rules: the test's own ratio, less if it dilates, moved by brittleness and by the
    stresses at failure.
    """
    c = curve.join(proportional_limit(curve), "test_id")
    given = curve.select("test_id").distinct().join(tests, "test_id", "left") if tests is not None else curve.select("test_id", *[F.lit(None).cast("double").alias(x) for x in ("confining", "youngs", "poisson", "sigma1", "sigma3")]).distinct()
    side = linear_fit(c.where("axial <= limit AND axial > 0"), F.col("axial"), -F.col("lateral"), "test_id").where(F.col("n") >= least_rows).select("test_id", F.col("slope").alias("side"))
    bulk = c.join(given.select("test_id", "confining"), "test_id").where("abs(volumetric) <= limit AND volumetric <> 0")
    bulk = linear_fit(bulk, F.col("volumetric"), F.coalesce("confining", F.lit(0.0)) + F.col("stress") / 3, "test_id").where(F.col("n") >= least_rows).select("test_id", F.col("slope").alias("bulk"))
    known = curve.groupBy("test_id").agg(F.count("lateral").alias("laterals"))
    t = given.join(known, "test_id").join(side, "test_id", "left").join(bulk, "test_id", "left").join(brittleness(curve), "test_id")
    t = t.join(youngs_modulus(curve).select("test_id", F.col("youngs").alias("fitted")), "test_id").withColumn("own", F.coalesce("poisson", F.lit(0.25)))
    shear = F.coalesce("youngs", "fitted") / (2 * (1 + F.col("own")))
    moduli = F.when((F.col("bulk") > 0) & (shear > 0), (3 * F.col("bulk") - 2 * shear) / (6 * F.col("bulk") + 2 * shear))
    rule = F.when(F.col("dilates"), 0.85 * F.col("own")).otherwise(F.col("own"))
    rule = F.when(F.col("brittleness") > 0.7, F.least(rule, F.lit(0.25))).when(F.col("brittleness") < 0.3, F.greatest(rule, F.lit(0.3))).otherwise(rule)
    ratio = (F.col("sigma1") - F.col("sigma3")) / F.greatest(F.lit(0.1), "sigma3")
    rule = F.when(ratio > 5, F.least(rule, F.lit(0.2))).when(ratio < 2, F.greatest(rule, F.lit(0.35))).otherwise(rule)
    measured = F.when(F.col("laterals") > 0, F.col("side")).otherwise(moduli)
    within = lambda x, low: F.least(F.greatest(x, F.lit(low)), F.lit(0.499))
    return t.select("test_id", F.coalesce(F.when(measured.isNotNull(), within(measured, 0.0)), within(rule, 0.05)).alias("poisson"))


def brittleness(curve: DataFrame) -> DataFrame:
    """Peak stress and strain, the drop after it over the peak, whether it softens (5 %) and dilates (volume falls back)."""
    peak = curve.groupBy("test_id").agg(F.max_by(F.struct("step", "axial", "stress"), F.struct("stress", -F.col("step"))).alias("p"), F.max_by("volumetric", "step").alias("last_v"), F.max("volumetric").alias("top_v"))
    after = curve.join(peak, "test_id").where("step >= p.step").groupBy("test_id").agg(F.min("stress").alias("least"), F.max("axial").alias("last"))
    drop = (F.col("p.stress") - F.col("least")) / F.col("p.stress")
    return peak.join(after, "test_id").select("test_id", F.col("p.stress").alias("peak_stress"), F.col("p.axial").alias("peak_strain"), F.when(F.col("p.stress") > 0, drop).otherwise(0.0).alias("brittleness"), F.coalesce(drop >= 0.05, F.lit(False)).alias("softens"), (F.col("last_v") < F.col("top_v")).alias("dilates"))


def mohr_coulomb(failures: DataFrame, as_line: bool = False, brittle: float | None = None, tensile: float | None = None) -> DataFrame:
    """Friction angle (degrees, within 15 and 55) and cohesion (within 0.1 and 100) from failures (sigma1, sigma3): one row.

    Three rows or more: the line through s = (s1 + s3) / 2, t = (s1 - s3) / 2; its slope is the sine of the angle and its
    intercept the cohesion times the cosine, or with as_line the angle's tangent and the cohesion themselves. With
    as_line and an R2 below 0.9, both are those of the tangent to a power law at the mean s. Fewer rows: from the greatest
    circle alone, moved by the test's brittleness and held above tensile / (2 cos) where a tensile strength is given.
    """
    r = failures.select(((F.col("sigma1") + F.col("sigma3")) / 2).alias("s"), ((F.col("sigma1") - F.col("sigma3")) / 2).alias("t")).where("s IS NOT NULL AND t IS NOT NULL")
    f = linear_fit(r, F.col("s"), F.col("t"))
    power = linear_fit(r, F.log(F.greatest(F.lit(0.01), "s")), F.log(F.greatest(F.lit(0.01), "t"))).select(F.exp("intercept").alias("a"), F.col("slope").alias("b"))
    mean = r.agg(F.avg("s").alias("mean"), F.max_by("s", "t").alias("centre"), F.max("t").alias("radius"))
    f = f.crossJoin(power).crossJoin(mean)  # a row each
    if as_line:
        tangent = F.col("b") * F.col("a") * F.pow("mean", F.col("b") - 1)
        bent = (F.col("r2") < 0.9) & tangent.isNotNull()
        phi = F.atan(F.when(bent, tangent).otherwise(F.col("slope")))
        cohesion = F.when(bent, F.greatest(F.lit(0.0), F.col("a") * F.pow("mean", F.col("b")) - tangent * F.col("mean"))).otherwise(F.col("intercept"))
    else:
        phi = F.asin(F.least(F.greatest("slope", F.lit(-0.999)), F.lit(0.999)))
        cohesion = F.col("intercept") / F.cos(phi)
    sine = F.col("radius") / (F.col("centre") + 0.1 * F.col("radius"))
    alone = F.asin(F.least(F.lit(1.0), sine))
    single = (F.col("radius") - F.col("centre") * sine) / F.greatest(F.cos(alone), F.lit(1e-9))
    turn = 1.1 if brittle is not None and brittle > 0.7 else 0.9 if brittle is not None and brittle < 0.3 else 1.0
    single, angle = single * (2 - turn), F.degrees(alone) * turn
    if tensile is not None:
        single = F.greatest(single, tensile / (2 * F.greatest(F.cos(alone), F.lit(1e-9))))
    many = F.col("n") >= 3
    out = f.select("n", F.when(many, F.degrees(phi)).otherwise(angle).alias("angle"), F.when(many, cohesion).otherwise(single).alias("c"), "r2")
    return out.where("n > 0").select("n", F.least(F.greatest("angle", F.lit(15.0)), F.lit(55.0)).alias("friction_angle"), F.least(F.greatest("c", F.lit(0.1)), F.lit(100.0)).alias("cohesion"), "r2")


def tension_cutoff(tensile_tests: DataFrame, cohesion: float, friction_degrees: float) -> DataFrame:
    """(cutoff): whether measured tensile strengths (strength) average below 0.8 of cohesion / tan(angle); null without any."""
    return tensile_tests.agg((F.avg("strength") < 0.8 * cohesion / tan(radians(friction_degrees))).alias("cutoff"))


def state_curve(particles: DataFrame, boxes: DataFrame, confining: float = 0.0, quantize: bool = False) -> DataFrame:
    """(test_id, step, axial, lateral, volumetric, stress) from states of particles (test_id, step, particle, y, volume, solid,
    force) and of their box (test_id, step, width, height, volume).

    Stress is the mean of force over volume of the solid ones, or the confining pressure without any. Axial strain is their
    mean rise since the first state, over its height; lateral and volumetric are the box's. quantize truncates strain
    to thousandths and stress to tenths.
    """
    first = F.min("step").over(Window.partitionBy("test_id"))
    p = particles.where("solid").withColumn("first", first)
    start = p.where("step = first").select("test_id", "particle", F.col("y").alias("y0"))
    moved = p.join(start, ["test_id", "particle"], "left").groupBy("test_id", "step").agg(F.avg(F.col("force") / F.col("volume")).alias("stress"), F.avg(F.col("y") - F.col("y0")).alias("rise"))
    b = boxes.withColumn("first", first)
    at = b.where("step = first").select("test_id", *[F.col(c).alias(f"{c}0") for c in ("width", "height", "volume")])
    c = b.join(at, "test_id").join(moved, ["test_id", "step"], "left")
    axial, stress = F.coalesce(F.try_divide(F.col("rise"), F.col("height0")), F.lit(0.0)), F.coalesce("stress", F.lit(confining))
    if quantize:
        axial, stress = chart_units(axial, stress)
        axial, stress = axial / 1000, stress / 10
    return c.select("test_id", "step", axial.alias("axial"), ((F.col("width") - F.col("width0")) / F.col("width0")).alias("lateral"), ((F.col("volume") - F.col("volume0")) / F.col("volume0")).alias("volumetric"), stress.alias("stress"))


def predict_by_density(wanted: DataFrame, points: DataFrame, kind: str) -> DataFrame:
    """wanted (density) with the property interpolated between the calibration points of the densities around it.

    Beyond the ends it is the end's; points of one density count as their mean. kind youngs, or poisson: from points
    with a ratio within 0 and 0.5, within 0 and 0.49, and 0.25 where there are fewer than two.
    """
    good = points.where("poisson > 0 AND poisson < 0.5 AND NOT isnan(poisson)") if kind == "poisson" else points
    knots = good.where(F.col(kind).isNotNull()).select(F.col("density").alias("x"), F.col(kind).cast("double").alias("y"))
    found = bracket(wanted, knots, "density").withColumnRenamed("interpolated", kind)
    if kind != "poisson":
        return found
    enough = knots.agg((F.count("*") >= 2).alias("enough"))
    clamped = F.least(F.greatest(kind, F.lit(0.0)), F.lit(0.49))
    return found.crossJoin(F.broadcast(enough)).withColumn(kind, F.when(F.col("enough"), clamped).otherwise(0.25)).drop("enough")


def predict_vp_vs(wanted: DataFrame, points: DataFrame, default_poisson: float = 0.25) -> DataFrame:
    """wanted (id, density, pressure_mpa) with vp_vs from the two points nearest in density within 1 MPa.

    Between the two by density, held at their values beyond; one point's own; without any the ratio of default_poisson. Distinct
    places are asked once at each pressure of points within 1 MPa, and see the two densities below and above; of points
    that share pressure and density only the two least ids can count.
    """
    p = points.select(F.col("pressure_mpa").alias("p"), F.col("density").alias("d"), F.col("id").alias("point"), F.col("vp_vs").alias("r")).where("p IS NOT NULL AND d IS NOT NULL AND NOT isnan(d)")
    two = p.withColumn("i", F.row_number().over(Window.partitionBy("p", "d").orderBy("point"))).where("i <= 2")
    knots = two.groupBy("p", "d").agg(F.collect_list(F.struct("point", "d", "r")).alias("knot"))
    near = Window.partitionBy("p").orderBy("d")
    knots = knots.withColumns({"below": F.concat("knot", F.coalesce(F.lag("knot").over(near), F.array())), "above": F.concat("knot", F.coalesce(F.lead("knot").over(near), F.array()))}).drop("knot")
    asked = wanted.select("density", "pressure_mpa").distinct().where("density IS NOT NULL AND NOT isnan(density)")
    cells = asked.withColumn("cell", F.explode(F.array(*[F.floor("pressure_mpa") + i for i in (-1, 0, 1)])))
    levels = p.select("p", F.floor("p").alias("cell")).distinct()
    met = cells.join(levels, "cell").where(F.abs(F.col("p") - F.col("pressure_mpa")) <= 1).select("density", "pressure_mpa", "p")
    none = F.lit(None).cast(knots.schema["below"].dataType)
    rows = knots.withColumn("asked", F.lit(0)).unionByName(met.select("p", F.col("density").cast("double").alias("d")).distinct().withColumns({"below": none, "above": none, "asked": F.lit(1)}))
    w = Window.partitionBy("p").orderBy("d", "asked")  # a point of the very density comes before it
    back = Window.partitionBy("p").orderBy(F.desc("d"), F.desc("asked"))
    rows = rows.withColumns({n: F.last(c, True).over(o.rowsBetween(Window.unboundedPreceding, 0)) for n, c, o in (("low", "below", w), ("high", "above", back))})
    seen = rows.where("asked = 1").select("p", F.col("d").alias("density"), F.explode(F.concat(F.coalesce("low", F.array()), F.coalesce("high", F.array()))).alias("k"))
    ranked = met.join(seen, ["p", "density"]).select("density", "pressure_mpa", "k.*").withColumn("i", F.row_number().over(Window.partitionBy("density", "pressure_mpa").orderBy(F.abs(F.col("d") - F.col("density")), "point"))).where("i <= 2")
    two = ranked.groupBy("density", "pressure_mpa").agg(*[F.max(F.when(F.col("i") == k, F.struct("d", "r"))).alias(f"p{k}") for k in (1, 2)])
    two = two.select(F.col("density").alias("__d"), F.col("pressure_mpa").alias("__p"), "p1", "p2")
    t = F.coalesce(F.try_divide(F.col("density") - F.col("p1.d"), F.col("p2.d") - F.col("p1.d")), F.lit(0.0))
    found = F.col("p1.r") + F.coalesce(F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * (F.col("p2.r") - F.col("p1.r")), F.lit(0.0))
    return wanted.join(two, (F.col("density") == F.col("__d")) & (F.col("pressure_mpa") == F.col("__p")), "left").withColumn("vp_vs", F.coalesce(found, vp_vs_from_poisson(F.lit(default_poisson)))).drop("p1", "p2", "__d", "__p")
