"""Thin sections: regions of an image as 2-D pores, planes through a pore network, and how well they match."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi, sqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomolake.operators.components import FOUR_2D, label_components
from tomolake.operators.network import connection_counts, plane_hits, throats_2d

#: Name, normal (made a unit), and the plane's own directions; tilted planes take theirs from the normal.
ORIENTATIONS = [
    ("XY", (0, 0, 1), (1, 0, 0), (0, 1, 0)), ("XZ", (0, 1, 0), (1, 0, 0), (0, 0, 1)), ("YZ", (1, 0, 0), (0, 1, 0), (0, 0, 1)),
    ("XY+30", (0, 0.5, 0.866), None, (0, 1, 0)), ("XZ+30", (0, 0.866, 0.5), None, (0, 0, 1)), ("YZ+30", (0.866, 0, 0.5), None, (0, 0, 1)),
    ("XY-30", (0, -0.5, 0.866), None, (0, 1, 0)), ("XZ-30", (0, 0.866, -0.5), None, (0, 0, 1)), ("YZ-30", (0.866, 0, -0.5), None, (0, 0, 1)),
]
BINS = 5


def regions(mask: DataFrame, dims: Sequence[int], scale: float = 1.0, least: int = 5) -> DataFrame:
    """2-D pores of a mask's places (volume_id, x, y, z), by slice: its 4-connected regions of `least` pixels or more.

    (volume_id, z, id, x, y, radius, area, pixels): centroid, radius of the disc of the same area, area; scaled.
    """
    found = label_components(mask.select("volume_id", "x", "y", "z", F.lit(1).cast("long").alias("label")), dims, FOUR_2D)
    r = found.groupBy("volume_id", "z", F.col("component").alias("id")).agg(F.count("*").alias("pixels"), F.avg("x").alias("cx"), F.avg("y").alias("cy")).where(F.col("pixels") >= least)
    return r.select("volume_id", "z", "id", (F.col("cx") * scale).alias("x"), (F.col("cy") * scale).alias("y"), (F.sqrt(F.col("pixels") / pi) * scale).alias("radius"), (F.col("pixels") * (scale * scale)).alias("area"), "pixels")


def section_network(pores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """2-D pores with their connections, and the throats between them."""
    t = throats_2d(pores)
    return connection_counts(pores, t.select(F.col("id1").alias("pore1"), F.col("id2").alias("pore2"))), t


def section_porosity(pores: DataFrame, throats: DataFrame, image_area: float) -> DataFrame:
    """(porosity): the area of pores and throats over the image's."""
    p, t = pores.agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("p")), throats.agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("t"))
    return p.crossJoin(t).select(((F.col("p") + F.col("t")) / image_area).alias("porosity"))  # a row each


def label_fraction(voxels: DataFrame, label: int, *by: str) -> DataFrame:
    """Share of the places that carry the label."""
    return voxels.groupBy(*by).agg(F.avg((F.col("label") == label).cast("double")).alias("fraction"))


def unit_vectors() -> list[tuple[str, tuple[float, ...], tuple[float, ...], tuple[float, ...]]]:
    """Name, normal and the two directions of each orientation."""
    out = []
    for name, n, u, v in ORIENTATIONS:
        n = _unit(n)
        if u is None:
            u = _cross(n, v)
            v = _cross(n, u)
        out.append((name, tuple(map(float, n)), _unit(u), _unit(v)))
    return out


def _unit(v: Sequence[float]) -> tuple[float, ...]:
    size = sqrt(sum(x * x for x in v))
    return tuple(x / size for x in v)


def _cross(a: Sequence[float], b: Sequence[float]) -> tuple[float, ...]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def candidate_planes(pores: DataFrame, width: float, height: float, samples: int = 5) -> DataFrame:
    """Planes for plane_hits(): nine orientations at the cell centres of a grid over the network's box; none if the section
    is wider than the box or higher than its taller other side. plane_id is orientation, then x, y, z of the cell."""
    box = pores.agg(*[f(e).alias(f"{k}{a}") for a in "xyz" for k, f, e in (("low", F.min, F.col(a) - F.col("radius")), ("high", F.max, F.col(a) + F.col("radius")))]).first()
    rows = []
    if box["lowx"] is not None and width <= box["highx"] - box["lowx"] and height <= max(box["highy"] - box["lowy"], box["highz"] - box["lowz"]):
        at = {a: [box[f"low{a}"] + (box[f"high{a}"] - box[f"low{a}"]) * (i + 0.5) / samples for i in range(samples)] for a in "xyz"}
        for o, (name, n, u, v) in enumerate(unit_vectors()):
            rows += [(((o * samples + i) * samples + j) * samples + k, name, i, j, k, (x, y, z), n, u, v, width / 2, height / 2) for i, x in enumerate(at["x"]) for j, y in enumerate(at["y"]) for k, z in enumerate(at["z"])]
    point = "struct<x: double, y: double, z: double>"
    return pores.sparkSession.createDataFrame([tuple(tuple(map(float, c)) if isinstance(c, tuple) else c for c in r) for r in rows], f"plane_id long, orientation string, i long, j long, k long, c {point}, n {point}, u {point}, v {point}, half_u double, half_v double")


def _shares(rows: DataFrame, *by: str) -> DataFrame:
    """Share of each of BINS equal bins of radius, the middle one where all radii are equal."""
    span = rows.groupBy(*by).agg(F.min("radius").alias("low"), F.max("radius").alias("high"), F.count("*").alias("total"))
    spanned = rows.join(span, list(by)) if by else rows.crossJoin(F.broadcast(span))  # one row without keys
    at = F.coalesce(F.try_divide(F.col("radius") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.5))
    n = spanned.withColumn("bin", F.least(F.lit(BINS - 1), F.floor(at * BINS))).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.first("total").alias("total"))
    return n.select(*by, "bin", (F.col("n") / F.col("total")).alias("share"))


def match_scores(section: DataFrame, pores: DataFrame, planes: DataFrame) -> DataFrame:
    """(plane_id, n, score): how well the pores (id, radius, connections) cut by each plane resemble the section's (radius,
    connections), within 0 and 100. Planes that cut none have no row.

    0.2 of the ratio of counts (at most 1), 0.4 of what the radius histograms have in common, 0.4 of that of the mean
    connections (0.5 where both are 0).
    """
    cut = plane_hits(pores, planes.drop("orientation", "i", "j", "k"), "radius", "connections").select("plane_id", "id", "radius", "connections")
    s = section.agg(F.count("*").alias("n2"), F.avg("connections").alias("c2"))
    grid = planes.select("plane_id").crossJoin(F.broadcast(planes.sparkSession.range(BINS).toDF("bin")))
    other = _shares(section.select("radius")).withColumnRenamed("share", "share2")
    apart = grid.join(_shares(cut.select("plane_id", "radius"), "plane_id"), ["plane_id", "bin"], "left").join(F.broadcast(other), "bin", "left")
    apart = apart.groupBy("plane_id").agg(F.sum(F.abs(F.coalesce("share", F.lit(0.0)) - F.coalesce("share2", F.lit(0.0)))).alias("apart"))
    m = cut.groupBy("plane_id").agg(F.count("*").alias("n"), F.avg("connections").alias("c")).join(apart, "plane_id").crossJoin(F.broadcast(s))
    count = F.least(F.lit(1.0), F.col("n") / F.col("n2"))
    linked = F.coalesce(1 - F.try_divide(F.abs(F.col("c2") - F.col("c")), F.greatest("c", "c2")), F.lit(0.5))
    score = 100 * (0.2 * count + 0.4 * (1 - F.col("apart") / BINS) + 0.4 * linked)
    return m.where("n2 > 0").select("plane_id", "n", F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)).alias("score"))


def best_planes(scores: DataFrame, planes: DataFrame, top: int) -> DataFrame:
    """The best plane along z of each orientation and place in x, y (the first of equal ones), then the `top` best of these."""
    s = scores.join(planes.select("plane_id", "orientation", "i", "j"), "plane_id")
    w = Window.partitionBy("orientation", "i", "j").orderBy(F.desc("score"), "plane_id")
    return s.withColumn("rank", F.row_number().over(w)).where("rank = 1").orderBy(F.desc("score"), "plane_id").limit(top).select("plane_id", "orientation", "n", "score")
