"""Texture classification: places whose surroundings have the gray co-occurrence features of a chosen rectangle."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomolake.functions.physics import cosine
from tomolake.operators.labels import relabel
from tomolake.operators.stats import glcm, glcm_features
from tomolake.operators.voxels import crop

FEATURES = ["contrast", "dissimilarity", "homogeneity", "energy", "correlation"]
DIRECTIONS = [(1, 0), (1, 1), (0, 1), (-1, 1)]


def reference_features(voxels: DataFrame, low: Sequence[int], high: Sequence[int], z: int) -> DataFrame:
    """One row of features of a half-open rectangle of a slice, averaged over four directions."""
    part = crop(voxels, (*low, z), (*high, z + 1))
    each = [glcm_features(glcm(part, dx, dy)) for dx, dy in DIRECTIONS]
    return reduce(DataFrame.unionByName, each).agg(*[F.avg(c).alias(c) for c in FEATURES])


def patch_features(voxels: DataFrame, dims: Sequence[int], patch: int = 7, step: int = 2) -> DataFrame:
    """(volume_id, z, x, y, features) of the patches wholly within a slice whose centre is every `step`-th column.

    Each pair of horizontal neighbours is sent to the centres of the patches that hold both, and counted there.
    """
    w, h, _ = dims
    r = patch // 2
    there = voxels.select("volume_id", "z", "y", (F.col("x") - 1).alias("x"), F.col("gray").alias("j"))
    pairs = voxels.select("volume_id", "z", "y", "x", F.col("gray").alias("i")).join(there, ["volume_id", "z", "y", "x"])
    at = pairs.withColumn("cx", F.explode(F.sequence(F.col("x") + 1 - r, F.col("x") + r))).where(F.col("cx").between(r, w - r - 1) & ((F.col("cx") - r) % step == 0))
    at = at.withColumn("cy", F.explode(F.sequence(F.col("y") - r, F.col("y") + r))).where(F.col("cy").between(r, h - r - 1))
    n = at.groupBy("volume_id", "z", "cx", "cy", "i", "j").count()
    ppm = n.withColumn("ppm", F.floor(F.col("count") * 1_000_000 / (patch * (patch - 1))).cast("long"))
    return glcm_features(ppm, "volume_id", "z", "cx", "cy").select("volume_id", "z", F.col("cx").alias("x"), F.col("cy").alias("y"), *FEATURES)


def classify_texture(voxels: DataFrame, dims: Sequence[int], reference: DataFrame, material: int, threshold: float, slices: tuple[int, int] | None = None, patch: int = 7) -> DataFrame:
    """voxels with the material on the 3 x 3 around each centre whose features have at least that cosine with the
    reference's, on slices first..last or on all. Other views: turn the volume first."""
    chosen = voxels if slices is None else voxels.where(F.col("z").between(*slices))
    own = reference.select(F.array(*FEATURES).alias("own"))  # one row
    alike = patch_features(chosen, dims, patch).crossJoin(F.broadcast(own)).where(cosine(F.array(*FEATURES), F.col("own")) >= threshold)
    around = F.sequence(F.lit(-1).cast("long"), F.lit(1).cast("long"))
    marks = alike.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around)).select("volume_id", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "z", F.lit(True).alias("__hit")).distinct()
    return relabel(voxels.join(marks, ["volume_id", "x", "y", "z"], "left"), F.col("__hit").isNotNull(), material).drop("__hit")
