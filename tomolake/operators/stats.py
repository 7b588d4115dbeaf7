"""Aggregations over voxels, particles, pores and series."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product
from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomolake.operators.stencil import blocks, places

MILLIDARCY = 9.869233e-13  # m2 in a darcy, as the unit used for results


def material_statistics(voxels: DataFrame, materials: DataFrame, pixel_size: float) -> DataFrame:
    """Per material, also those without voxels: count, volume in um3, mm3, cm3, percent of all voxels."""
    counts = voxels.groupBy(F.col("label").alias("id")).agg(F.count("*").alias("n"))
    n = counts.where("id IS NOT NULL")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    s = materials.select("id", "name").join(n, "id", "left").crossJoin(F.broadcast(total)).withColumn("voxel_count", F.coalesce("n", F.lit(0)))
    cube = pixel_size**3
    return s.select("id", "name", "voxel_count", (F.col("voxel_count") * (cube * 1e18)).alias("volume_um3"), (F.col("voxel_count") * (cube * 1e9)).alias("volume_mm3"), (F.col("voxel_count") * (cube * 1e6)).alias("volume_cm3"), (F.when(F.col("total") > 0, 100.0 * F.col("voxel_count") / F.col("total")).otherwise(0.0)).alias("percent"))


def histogram(voxels: DataFrame) -> DataFrame:
    """Counts of all 256 gray values."""
    grays = voxels.sparkSession.range(256).toDF("gray")
    return grays.join(voxels.groupBy("gray").count(), "gray", "left").select("gray", F.coalesce("count", F.lit(0)).alias("n"))


def otsu_threshold(voxels: DataFrame) -> DataFrame:
    """The least gray value of maximal between-class variance; classes are values up to it and above it."""
    w = Window.orderBy("gray")  # over 256 rows
    h = histogram(voxels).withColumns({"wb": F.sum("n").over(w), "sb": F.sum(F.col("gray") * F.col("n")).over(w)})
    whole = Window.partitionBy()
    h = h.withColumns({"t": F.sum("n").over(whole), "s": F.sum(F.col("gray") * F.col("n")).over(whole)})
    wb, wf = F.col("wb").cast("double"), (F.col("t") - F.col("wb")).cast("double")
    gap = F.col("sb") / wb - (F.col("s") - F.col("sb")) / wf
    return h.where("wb > 0 AND wb < t").withColumn("v", F.round(wb * wf * gap * gap, 3)).agg(F.max_by("gray", F.struct("v", -F.col("gray"))).alias("threshold"))


def gray_statistics(voxels: DataFrame, *by: str) -> DataFrame:
    return voxels.groupBy(*by).agg(F.min("gray").alias("min_gray"), F.max("gray").alias("max_gray"), F.avg("gray").alias("mean_gray"), F.count("*").alias("n"))


def material_mean(voxels: DataFrame, materials: DataFrame, value: str = "gray", default: float = 1000.0) -> DataFrame:
    """(id, mean) of every material, the default where it has no voxels."""
    m = voxels.groupBy(F.col("label").alias("id")).agg(F.avg(value).alias("mean"))
    return materials.select("id").join(m, "id", "left").withColumn("mean", F.coalesce("mean", F.lit(default)))


PARTICLE_ORDERS = {"largest": [F.desc, "voxel_count"], "smallest": [F.asc, "voxel_count"], "first": [F.asc, "component"], "last": [F.desc, "component"]}


def top_particles(particles: DataFrame, order: str, n: int) -> DataFrame:
    """The first n particles by count or by id, falling or rising; of equal ones the least id."""
    direction, column = PARTICLE_ORDERS[order]
    return particles.orderBy(direction(column), "volume_id", "component").limit(n)


def region_mean(voxels: DataFrame, z: int, low: Sequence[int], high: Sequence[int], default: float = 128.0) -> DataFrame:
    """Mean gray of a half-open rectangle of a slice, the default where it is empty."""
    inside = (F.col("z") == z) & F.col("x").between(low[0], high[0] - 1) & F.col("y").between(low[1], high[1] - 1)
    return voxels.where(inside).agg(F.coalesce(F.avg("gray"), F.lit(default)).alias("mean_gray"))


def particles(components: DataFrame, pixel_size: float) -> DataFrame:
    """Per component: count, volume, floored centre and bounds."""
    n = F.count("*")
    centre = F.struct(*[F.floor(F.sum(a) / n).cast("long").alias(a) for a in "xyz"]).alias("center")
    bounds = F.struct(*[f(a).alias(f"{k}_{a}") for a in "xyz" for k, f in (("min", F.min), ("max", F.max))]).alias("bounds")
    return components.groupBy("volume_id", "component").agg(n.alias("voxel_count"), (n * (pixel_size**3 * 1e18)).alias("volume_um3"), (n * (pixel_size**3 * 1e9)).alias("volume_mm3"), centre, bounds)


def flat_particles(p: DataFrame) -> DataFrame:
    return p.select("volume_id", "component", "voxel_count", "volume_um3", "volume_mm3", *[F.col(f"center.{a}").alias(f"center_{a}") for a in "xyz"], *[F.col(f"bounds.{k}_{a}").alias(f"{k}_{a}") for a in "xyz" for k in ("min", "max")])


def _compared(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the core of an array padded by one: if a place has a neighbour, how many of its six can be compared, and how many of
    these are equal. Absent places are NaN, those without a value infinite."""
    core = block[1:-1, 1:-1, 1:-1]
    seen, known, equal = np.zeros(core.shape, bool), np.zeros(core.shape, np.int64), np.zeros(core.shape, np.int64)
    for axis, side in product(range(3), (0, 2)):
        at = [slice(1, -1)] * 3
        at[axis] = slice(side, side + core.shape[axis])
        there = block[tuple(at)]
        both = np.isfinite(core) & np.isfinite(there)
        seen |= ~np.isnan(there)
        known += both
        equal += both & (core == there)
    return seen, known, equal


def _neighbourly(rows: DataFrame, value: str, work: Callable[[int, tuple[int, int, int], np.ndarray, np.ndarray], pa.Table], schema: str, dims: Sequence[int], d: int) -> DataFrame:
    """work on chunks for _compared(): a chunk's values and the faces around travel packed, no voxel is sent to its neighbours."""
    v = rows.select("volume_id", *"xyz", F.coalesce(F.col(value).cast("double"), F.lit(float("inf"))).alias("value"))
    return blocks(v, work, schema, 1, dims, d, "value", pad=float("nan"), absent=float("nan"))


def surface_area(labelled: DataFrame, pixel_size: float, dims: Sequence[int], value: str = "component", d: int = 64) -> DataFrame:
    """Per component 1.5 pixel areas for each voxel with a neighbour of another value; the volume's edge isn't one."""

    def work(volume: int, corner: tuple[int, int, int], block: np.ndarray, present: np.ndarray) -> pa.Table:
        seen, known, equal = _compared(block)
        of = present & seen
        own, which = np.unique(block[1:-1, 1:-1, 1:-1][of], return_inverse=True)
        edges, some = (np.bincount(which, c[of], len(own)).astype(np.int64) for c in (equal < known, known > 0))
        return pa.table({"volume_id": np.full(len(own), volume), "own": own, "edges": pa.array(edges, pa.int64(), mask=some == 0)})

    kind = labelled.schema[value].dataType
    own = F.when(F.col("own") < float("inf"), F.col("own").cast(kind)).alias(value)
    edges = _neighbourly(labelled, value, work, "volume_id long, own double, edges long", dims, d).select("volume_id", own, "edges")
    return edges.groupBy("volume_id", value).agg((F.sum("edges") * (1.5 * pixel_size**2)).alias("area"))


def local_connectivity(voxels: DataFrame, dims: Sequence[int], d: int = 64) -> DataFrame:
    """Share of a voxel's neighbours within the volume that have its label."""

    def work(volume: int, corner: tuple[int, int, int], block: np.ndarray, present: np.ndarray) -> pa.Table:
        seen, known, equal = _compared(block)
        return places(volume, corner, present & seen, own=block[1:-1, 1:-1, 1:-1], known=known, equal=equal)

    found = _neighbourly(voxels, "label", work, "volume_id long, x long, y long, z long, own double, known long, equal long", dims, d)
    own = F.when(F.col("own") < float("inf"), F.col("own").cast(voxels.schema["label"].dataType)).alias("label")
    return found.select("volume_id", *"xyz", own, F.when(F.col("known") > 0, F.col("equal") / F.col("known")).alias("connectivity"))


def nearest_other(labels: np.ndarray, radius: int) -> np.ndarray:
    """Squared distance from each place of an array padded by the radius to the nearest of another label within its cube.

    Infinite if there is none; labels below 0 are no places. Along each axis in turn, a line keeps for each of its places the
    lower envelope of the two nearest labels that differ; of these at most one is a place's own. Three passes of
    2 r + 1 steps take the place of (2 r + 1)^3 neighbours.
    """
    none = np.iinfo(np.int32).max // 2
    own = labels.astype(np.int32)
    first, second = np.where(own >= 0, 0, none).astype(np.int32), np.full(own.shape, none, np.int32)
    a, b = own, np.full(own.shape, -1, np.int32)
    for axis in (2, 1, 0):
        n = first.shape[axis] - 2 * radius
        one, two = (np.full([n if k == axis else m for k, m in enumerate(first.shape)], none, np.int32) for _ in range(2))
        of_one, of_two = np.full(one.shape, -1, np.int32), np.full(one.shape, -1, np.int32)
        for step in sorted(range(-radius, radius + 1), key=abs):
            cut = tuple(slice(radius + step, radius + step + n) if k == axis else slice(None) for k in range(3))
            for far, label in ((first[cut] + step * step, a[cut]), (second[cut] + step * step, b[cut])):
                new = label >= 0
                same = new & (label == of_one)
                np.minimum(one, far, out=one, where=same)
                nearer = new & ~same & (far < one)
                two, of_two = np.where(nearer, one, two), np.where(nearer, of_one, of_two)
                one, of_one = np.where(nearer, far, one), np.where(nearer, label, of_one)
                next_ = new & ~same & ~nearer & (far < two)
                two, of_two = np.where(next_, far, two), np.where(next_, label, of_two)
        first, second, a, b = one, two, of_one, of_two
    core = own[radius : own.shape[0] - radius, radius : own.shape[1] - radius, radius : own.shape[2] - radius]
    best = np.where(a == core, second, first).astype(float)
    return np.where(best >= none, np.inf, best)


def _pore_size(block: np.ndarray, radius: int, pixel_size: float) -> np.ndarray:
    d2 = nearest_other(block, radius)
    return np.where(np.isinf(d2), 0.0, np.sqrt(d2)) * pixel_size


def local_pore_size(voxels: DataFrame, radius: int, pixel_size: float, dims: Sequence[int], d: int = 64) -> DataFrame:
    """Distance from each labelled voxel to the nearest of another label in its cube, times the pixel size; 0 if none."""

    def work(volume: int, corner: tuple[int, int, int], block: np.ndarray, present: np.ndarray) -> pa.Table:
        core = block[radius : block.shape[0] - radius, radius : block.shape[1] - radius, radius : block.shape[2] - radius]
        return places(volume, corner, present & (core != 0), label=core.astype(np.int64), pore_size=_pore_size(block, radius, pixel_size))

    return blocks(voxels, work, "volume_id long, x long, y long, z long, label long, pore_size double", radius, dims, d, "label", pad=-1, absent=-1)


def pore_structure(voxels: DataFrame, radius: int, pixel_size: float, dims: Sequence[int], d: int = 64) -> DataFrame:
    """Per material: voxels, share of the volume, mean local pore size and connectivity.

    Chunks send one row for each of their labels: counts and sums over their own voxels.
    """

    def work(volume: int, corner: tuple[int, int, int], block: np.ndarray, present: np.ndarray) -> pa.Table:
        core = tuple(slice(radius, m - radius) for m in block.shape)
        own, size = block[core], _pore_size(block, radius, pixel_size)
        alike, near = np.zeros(own.shape), np.zeros(own.shape)
        for axis in range(3):
            for step in (-1, 1):
                other = block[tuple(slice(c.start + step * (k == axis), c.stop + step * (k == axis)) for k, c in enumerate(core))]
                near += other >= 0
                alike += other == own
        label, at = np.unique(own[present].astype(np.int64), return_inverse=True)
        share = np.where(near > 0, alike / np.maximum(near, 1), 0.0)
        sums = [np.bincount(at, x[present], len(label)) for x in (size, share, (near > 0).astype(float))]
        return pa.table({"volume_id": np.full(len(label), volume), "label": label, "n": np.bincount(at, minlength=len(label)), "size": sums[0], "share": sums[1], "joined": sums[2]})

    s = blocks(voxels, work, "volume_id long, label long, n long, size double, share double, joined double", max(1, radius), dims, d, "label", pad=-1, absent=-1)
    s = s.groupBy("volume_id", "label").agg(*[F.sum(c).alias(c) for c in ("n", "size", "share", "joined")])
    total = s.groupBy("volume_id").agg(F.sum("n").alias("total"))
    means = [(F.col("size") / F.col("n")).alias("mean_pore_size"), F.try_divide("share", "joined").alias("mean_connectivity")]
    return s.join(total, "volume_id").where("label <> 0").select("volume_id", "label", "n", (F.col("n") / F.col("total")).alias("porosity"), *means)


def variance_map(voxels: DataFrame, view: str, first: int, last: int) -> DataFrame:
    """Population variance of gray / 255 for each pixel over slices first..last of the view, at least 1e-6."""
    from tomolake.operators.voxels import PLANE

    fixed, a, b = PLANE[view]
    rows = voxels.where(F.col(fixed).between(first, last))
    v = F.when(F.count("*") < 2, 1e-6).otherwise(F.greatest(F.var_pop(F.col("gray") / 255), F.lit(1e-6)))
    return rows.groupBy("volume_id", F.col(a).alias("a"), F.col(b).alias("b")).agg(v.alias("variance"))


def row_profile(voxels: DataFrame, how: str = "sum") -> DataFrame:
    f = {"sum": F.sum, "avg": F.avg}[how]
    return voxels.groupBy("volume_id", "z", "y").agg(f("gray").alias("v"))


def stretch(voxels: DataFrame) -> DataFrame:
    """Each slice's grays stretched to 0..255, truncated; 0 on a flat slice."""
    span = voxels.groupBy("volume_id", "z").agg(F.min("gray").alias("low"), F.max("gray").alias("high"))
    v = voxels.join(span, ["volume_id", "z"])
    return v.withColumn("gray", F.when(F.col("high") > F.col("low"), F.floor((F.col("gray") - F.col("low")) * 255 / (F.col("high") - F.col("low")))).otherwise(0).cast("long")).drop("low", "high")


def network_properties(pores: DataFrame, throats: DataFrame) -> DataFrame:
    """Totals and porosity: volumes over the box of the pores' centres, at most 1; a flat box gives way to a cube."""
    p = pores.agg(F.count("*").alias("n_pores"), F.sum("volume").alias("pore_volume"), F.avg("radius").alias("mean_radius"), *[(F.max(F.col(a) + F.col("radius")) - F.min(F.col(a) - F.col("radius"))).alias(f"s{a}") for a in "xyz"])
    t = throats.agg(F.count("*").alias("n_throats"), F.coalesce(F.sum("volume"), F.lit(0.0)).alias("throat_volume"), F.avg("radius").alias("mean_throat_radius"), F.min("radius").alias("min_throat_radius"), F.max("radius").alias("max_throat_radius"))
    box = F.col("sx") * F.col("sy") * F.col("sz")
    cube = F.pow(4 * F.col("mean_radius") * F.cbrt(F.col("n_pores").cast("double")), 3)
    solid = F.when(box > 0, box).otherwise(cube)
    return p.crossJoin(t).withColumn("porosity", F.when(solid > 0, F.least(F.lit(1.0), (F.col("pore_volume") + F.col("throat_volume")) / solid)).otherwise(0.0)).withColumn("mean_connections", F.when(F.col("n_pores") > 0, 2.0 * F.col("n_throats") / F.col("n_pores")).otherwise(0.0))


def pore_size_distribution(pores: DataFrame, bins: int = 10, include_max: bool = False) -> DataFrame:
    """Equal half-open bins of radius with count and share of volume; the largest radius is outside unless included."""
    span = pores.agg(F.min("radius").alias("low"), F.max("radius").alias("high"), F.sum("volume").alias("all"))
    span = span.withColumn("width", F.when((F.col("high") - F.col("low")) / bins < 0.001, 0.1).otherwise((F.col("high") - F.col("low")) / bins))
    b = F.floor((F.col("radius") - F.col("low")) / F.col("width"))
    b = F.when((F.col("radius") == F.col("high")) & F.lit(include_max), F.least(b, F.lit(bins - 1))).otherwise(b)
    n = pores.crossJoin(F.broadcast(span)).withColumn("bin", b).groupBy("bin").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))
    grid = pores.sparkSession.range(bins).toDF("bin").crossJoin(F.broadcast(span))
    return grid.join(n, "bin", "left").select("bin", (F.col("low") + F.col("bin") * F.col("width")).alias("from_radius"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("volume") / F.col("all"), F.lit(0.0)).alias("share"))


def kozeny_carman(pores: DataFrame, throats: DataFrame, solid_volume: float) -> DataFrame:
    """Permeability from the specific surface of spheres and cylinders and the porosity, kept within 0.001 and 0.999."""
    p = pores.agg(F.sum(4 / 3 * pi * F.pow("radius", F.lit(3.0))).alias("pv"), F.sum(4 * pi * F.pow("radius", F.lit(2.0))).alias("ps"))
    t = throats.agg(F.coalesce(F.sum(pi * F.pow("radius", F.lit(2.0)) * F.col("length")), F.lit(0.0)).alias("tv"), F.coalesce(F.sum(2 * pi * F.col("radius") * F.col("length")), F.lit(0.0)).alias("ts"))
    phi = F.least(F.lit(0.999), F.greatest(F.lit(0.001), (F.col("pv") + F.col("tv")) / solid_volume))
    s = (F.col("ps") + F.col("ts")) / solid_volume
    out = p.crossJoin(t).select(phi.alias("porosity"), s.alias("specific_surface"))
    return out.withColumn("permeability", F.pow("porosity", F.lit(3.0)) / (5 * F.pow("specific_surface", F.lit(2.0)) * F.pow(1 - F.col("porosity"), F.lit(2.0))))


def glcm(voxels: DataFrame, dx: int, dy: int) -> DataFrame:
    """Pairs of gray values at an offset within each slice, in parts per million (truncated)."""
    there = voxels.select("volume_id", (F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), "z", F.col("gray").alias("j"))
    pairs = voxels.select("volume_id", "x", "y", "z", F.col("gray").alias("i")).join(there, ["volume_id", "x", "y", "z"])
    n = pairs.groupBy("volume_id", "z", "i", "j").count()
    total = n.groupBy("volume_id", "z").agg(F.sum("count").alias("total"))
    return n.join(total, ["volume_id", "z"]).select("volume_id", "z", "i", "j", F.floor(F.col("count") * 1_000_000 / F.col("total")).cast("long").alias("ppm"))


def glcm_features(matrix: DataFrame, *by: str) -> DataFrame:
    """Contrast, dissimilarity, homogeneity, energy and correlation of each slice's matrix, or of each group's by other keys."""
    by = by or ("volume_id", "z")
    p, d = F.col("ppm") / 1e6, F.col("i") - F.col("j")
    s = matrix.groupBy(*by).agg(F.sum(p * d * d).alias("contrast"), F.sum(p * F.abs(d)).alias("dissimilarity"), F.sum(p / (1 + d * d)).alias("homogeneity"), F.sum(p * p).alias("energy"), F.sum(p * F.col("i")).alias("mi"), F.sum(p * F.col("j")).alias("mj"), F.sum(p * F.col("i") * F.col("i")).alias("ii"), F.sum(p * F.col("j") * F.col("j")).alias("jj"), F.sum(p * F.col("i") * F.col("j")).alias("ij"))
    si, sj = F.sqrt(F.greatest(F.col("ii") - F.col("mi") * F.col("mi"), F.lit(0.0))), F.sqrt(F.greatest(F.col("jj") - F.col("mj") * F.col("mj"), F.lit(0.0)))
    return s.select(*by, "contrast", "dissimilarity", "homogeneity", "energy", F.when(si * sj > 0, (F.col("ij") - F.col("mi") * F.col("mj")) / (si * sj)).otherwise(0.0).alias("correlation"))


def lbp_histogram(voxels: DataFrame) -> DataFrame:
    """Share of each local binary pattern of each slice's inner pixels: bit k is set where neighbour k is no darker."""
    ring = [(-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0)]
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(1 << k).alias("bit")) for k, (i, j) in enumerate(ring)])
    there = voxels.select("volume_id", "z", "gray", F.explode(offsets).alias("o"), "x", "y").select("volume_id", "z", (F.col("x") - F.col("o.i")).alias("x"), (F.col("y") - F.col("o.j")).alias("y"), F.col("gray").alias("n"), F.col("o.bit").alias("bit"))
    codes = voxels.join(there, ["volume_id", "z", "x", "y"]).groupBy("volume_id", "z", "x", "y").agg(F.count("*").alias("k"), F.sum(F.when(F.col("n") >= F.col("gray"), F.col("bit")).otherwise(0)).alias("code")).where("k = 8")
    n = codes.groupBy("volume_id", "z", "code").count()
    return n.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy("volume_id", "z"))).drop("count")


def histogram_moments(voxels: DataFrame) -> DataFrame:
    """Mean, deviation, skewness, excess kurtosis, energy and entropy (bits) of each slice's gray values."""
    n = voxels.groupBy("volume_id", "z", "gray").count()
    total = n.groupBy("volume_id", "z").agg(F.sum("count").alias("n"), (F.sum(F.col("gray") * F.col("count")) / F.sum("count")).alias("mean"))
    p = n.join(total, ["volume_id", "z"]).withColumn("p", F.col("count") / F.col("n")).withColumn("d", F.col("gray") - F.col("mean"))
    m = [F.sum(F.col("p") * F.pow("d", F.lit(float(k)))).alias(f"m{k}") for k in (2, 3, 4)]
    s = p.groupBy("volume_id", "z", "mean").agg(*m, F.sum(F.col("p") * F.col("p")).alias("energy"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))
    sd = F.sqrt("m2")
    return s.select("volume_id", "z", "mean", sd.alias("deviation"), F.when(sd > 0, F.col("m3") / F.pow(sd, F.lit(3.0))).otherwise(0.0).alias("skewness"), F.when(sd > 0, F.col("m4") / F.pow("m2", F.lit(2.0)) - 3).otherwise(0.0).alias("kurtosis"), "energy", "entropy")


def linear_fit(rows: DataFrame, x: Column, y: Column, *by: str) -> DataFrame:
    """Least-squares line per group: n, slope, intercept, r2, rmse; a constant x has slope 0 and the mean of y."""
    r = rows.select(*by, x.cast("double").alias("x"), y.cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    s = r.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.avg("y").alias("my"), F.var_pop("y").alias("vy"), F.var_pop("x").alias("vx"), F.covar_pop("x", "y").alias("c"))
    flat = (F.col("vx") <= 1e-24) | F.col("b").isNull()
    slope = F.when(flat, 0.0).otherwise(F.col("b"))
    left = F.greatest(F.col("vy") - F.when(flat, 0.0).otherwise(F.col("c") * F.col("c") / F.col("vx")), F.lit(0.0))
    return s.select(*by, "n", slope.alias("slope"), F.when(flat, F.col("my")).otherwise(F.col("a")).alias("intercept"), F.when(F.col("vy") > 1e-24, 1 - left / F.col("vy")).otherwise(1.0).alias("r2"), F.sqrt(left).alias("rmse"))


def path_velocity(field: DataFrame, start: Sequence[float], end: Sequence[float], default: float, least: float = 500.0) -> DataFrame:
    """Harmonic mean of velocities (x, y, z, v) at points of a straight path; slow or missing ones take the default."""
    d = sum((b - a) ** 2 for a, b in zip(start, end, strict=True)) ** 0.5
    n = max(10, int(-(-d // 1)))
    at = [F.round(F.lit(float(a)) + F.col("id") * ((b - a) / (n - 1))).cast("long").alias(c) for c, a, b in zip("xyz", start, end, strict=True)]
    points = field.sparkSession.range(n).select("id", *at)
    v = points.join(field, ["x", "y", "z"], "left").select(F.when(F.col("v") >= least, F.col("v")).otherwise(default).alias("v"))
    return v.agg((F.count("*") / F.sum(1 / F.col("v"))).alias("velocity"))


def velocity_statistics(field: DataFrame) -> DataFrame:
    return field.where("v > 0").agg(F.min("v").alias("min_v"), F.max("v").alias("max_v"), F.avg("v").alias("mean_v"), F.count("*").alias("n"))


def velocity_histogram(field: DataFrame, vp: float, bins: int = 100) -> DataFrame:
    """Bins over 0.5 to 1.5 times vp, ends taking what lies beyond, over the fullest bin."""
    b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("v") - 0.5 * vp) / (vp / bins))))
    n = field.where("v > 0").groupBy(b.cast("long").alias("bin")).count()
    return n.withColumn("level", F.col("count") / F.max("count").over(Window.partitionBy())).withColumnRenamed("count", "n")
