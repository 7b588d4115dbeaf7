"""Drill cores: their radius from rings of gray values, and their circle by shrinking one until it leaves the background."""

from __future__ import annotations

from collections.abc import Sequence
from math import cos, radians, sin

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomolake.operators.stencil import blocks
from tomolake.operators.voxels import plane

ANGLES = range(0, 360, 15)


def ring_means(voxels: DataFrame, dims: Sequence[int], z: int, margin: int = 10) -> DataFrame:
    """(volume_id, r, v): whole mean gray at 24 places of each ring about the slice's centre, from 5 on in 20 steps at most."""
    w, h, _ = dims
    top = min(w, h) // 2 - margin
    step = max(1, top // 20)
    places = [(r, int(w // 2 + cos(radians(a)) * r), int(h // 2 + sin(radians(a)) * r)) for r in range(5, top, step) for a in ANGLES]
    rings = voxels.sparkSession.createDataFrame([p for p in places if 0 <= p[1] < w and 0 <= p[2] < h], "r long, x long, y long")
    met = voxels.where(F.col("z") == z).join(F.broadcast(rings), ["x", "y"])  # a row for each of at most 480 places
    return met.groupBy("volume_id", "r").agg(F.floor(F.avg("gray")).cast("double").alias("v"))


def moving_mean(rings: DataFrame, step: int) -> DataFrame:
    """Each ring's mean with its neighbours one step in and out."""
    w = Window.partitionBy("volume_id").orderBy("r").rangeBetween(-step, step)
    return rings.withColumn("smooth", F.avg("v").over(w))


def gradients(rings: DataFrame) -> DataFrame:
    """Change from the ring before for each step of radius; null on the first."""
    w = Window.partitionBy("volume_id").orderBy("r")
    return rings.withColumn("gradient", F.abs(F.col("smooth") - F.lag("smooth").over(w)) / (F.col("r") - F.lag("r").over(w)))


def core_radius(voxels: DataFrame, dims: Sequence[int], z: int, margin: int = 10) -> DataFrame:
    """(volume_id, radius): the first ring of the steepest gradient beyond 15 % of the greatest radius, within 30 and 45 % of
    the shorter side; 35 % of it where no ring stands out."""
    side = float(min(dims[0], dims[1]))
    top = min(dims[0], dims[1]) // 2 - margin
    g = gradients(moving_mean(ring_means(voxels, dims, z, margin), max(1, top // 20)))
    g = g.withColumn("rings", F.count("*").over(Window.partitionBy("volume_id")))
    edge = g.where((F.col("gradient") > 0) & (F.col("r") > 0.15 * top) & (F.col("rings") > 2))
    found = edge.groupBy("volume_id").agg(F.max_by("r", F.struct("gradient", -F.col("r"))).cast("double").alias("found"))
    radius = F.least(F.greatest(F.coalesce("found", F.lit(0.35 * side)), F.lit(0.3 * side)), F.lit(0.45 * side))
    return voxels.select("volume_id").distinct().join(found, "volume_id", "left").select("volume_id", radius.alias("radius"))


def core_circle(voxels: DataFrame, dims: Sequence[int], view: str = "XY", at: int = 0, tolerance: int = 20, step: int = 5) -> DataFrame:
    """(volume_id, a, b, radius): the first circle, shrinking by `step`, none of whose 24 places has the background's gray.

    The background is the gray a tenth in from the corner. Where places have it, the centre moves away from their mean by
    a fifth of the way. Without such a circle the starting one at the plane's centre is returned. A slice is one group, of packed
    pieces put together to two bytes a pixel.
    """
    from tomolake.operators.voxels import PLANE

    _, a, b = PLANE[view]
    size = dict(zip("xyz", dims, strict=True))
    w, h = size[a], size[b]

    def run(volume: int, corner: tuple[int, int, int], block: np.ndarray, present: np.ndarray) -> pa.Table:
        image = block[0]
        first, reference = min(w, h) // 2, image[h // 10, w // 10]
        x, y, found = w // 2, h // 2, None
        for radius in range(first, first // 5 - 1, -step):
            px = np.trunc(x + radius * np.cos(np.radians(ANGLES))).astype(int)
            py = np.trunc(y + radius * np.sin(np.radians(ANGLES))).astype(int)
            inside = (px >= 0) & (px < w) & (py >= 0) & (py < h)
            px, py = px[inside], py[inside]
            same = np.abs(image[py, px].astype(int) - int(reference)) <= tolerance
            if not same.any():
                found = (x, y, radius)
                break
            move = lambda c, p: c - int((int(p[same].sum() // same.sum()) - c) / step)  # noqa: E731, B023
            x, y = max(radius, min(w - radius, move(x, px))), max(radius, min(h - radius, move(y, py)))
        x, y, radius = found or (w // 2, h // 2, first)
        return pa.table({"volume_id": [volume], "a": [int(x)], "b": [int(y)], "radius": [int(radius)]})

    flat = plane(voxels, view, at).select("volume_id", F.col("a").alias("x"), F.col("b").alias("y"), F.lit(0).cast("long").alias("z"), "gray")
    return blocks(flat, run, "volume_id long, a long, b long, radius long", 0, (w, h, 1), (w, h, 1), kind=np.int16)
