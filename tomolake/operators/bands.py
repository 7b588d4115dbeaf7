"""Bands: row profiles of slices in three views, smoothed, with their bright and dark peaks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomolake.operators import series, stencil
from tomolake.operators.stats import variance_map
from tomolake.operators.voxels import PLANE

ROWS = ["volume_id", "view", "slice"]


def turned(voxels: DataFrame, dims: Sequence[int], view: str) -> tuple[DataFrame, tuple[int, int, int]]:
    """The volume with the view's slices along z, its columns along x and rows along y; and its dims."""
    fixed, a, b = PLANE[view]
    size = dict(zip("xyz", dims, strict=True))
    return voxels.select("volume_id", F.col(a).alias("x"), F.col(b).alias("y"), F.col(fixed).alias("z"), "gray"), (size[a], size[b], size[fixed])


def band_image(voxels: DataFrame, dims: Sequence[int], radius: int, sigma: float, crop_air: bool = True, invert: bool = True) -> DataFrame:
    """(volume_id, x, y, z, v): each slice without the air above it, inverted, its white top-hat, smoothed along rows; y
    counts from the first row left."""
    v = voxels
    if crop_air:
        v = v.join(stencil.air_crop_row(v), ["volume_id", "z"]).where("y >= row").withColumn("y", F.col("y") - F.col("row"))
    level = F.col("gray") / 255
    hat = stencil.white_top_hat(v.withColumn("v", 1 + (1 - level if invert else level)), radius, dims, value="v", absent=True)
    return stencil.row_gaussian(hat.withColumnRenamed("value", "v"), sigma, "v").withColumnRenamed("value", "v")


def with_peaks(profile: DataFrame, prominence: float, distance: int, mirrored: bool = False) -> DataFrame:
    """The profile (volume_id, view, slice, row, v) with flags dark and bright. Dark peaks are those of -v, or of the mirrored
    profile max - v + min."""
    bright = series.peaks(profile, ROWS, "row", prominence, distance)
    dark = series.dark_peaks(profile, ROWS, "row", prominence, distance, mirrored=mirrored)
    out = profile
    for name, found in (("dark", dark), ("bright", bright)):
        out = out.join(found.select(*ROWS, "row", F.lit(1).cast("long").alias(name)), [*ROWS, "row"], "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out.select(*ROWS, "row", "v", "dark", "bright")


def smoothed(profile: DataFrame, sigma: float) -> DataFrame:
    return series.gaussian_smooth(profile, sigma, ROWS, "row").select(*ROWS, "row", F.col("smooth").alias("v"))


def slice_bands(voxels: DataFrame, dims: Sequence[int], view: str, at: int | None = None, radius: int = 5, sigma: float = 1.0, prominence: float = 0.02, distance: int = 5, crop_air: bool = True, invert: bool = True) -> DataFrame:
    """Bands of one slice of a view, or of all: (volume_id, view, slice, row, v, dark, bright), v the smoothed row sum."""
    v, size = turned(voxels, dims, view)
    image = band_image(v if at is None else v.where(F.col("z") == at), size, radius, sigma, crop_air, invert)
    profile = image.groupBy("volume_id", F.lit(view).alias("view"), F.col("z").alias("slice"), F.col("y").alias("row")).agg(F.sum("v").alias("v"))
    return with_peaks(smoothed(profile, sigma), prominence, distance)


def three_views(voxels: DataFrame, dims: Sequence[int], at: dict[str, int], **how: object) -> DataFrame:
    """slice_bands() of one slice for each of several views, put together: the rows of a band table."""
    return reduce(DataFrame.unionByName, (slice_bands(voxels, dims, view, z, **how) for view, z in at.items()))


def variance_bands(voxels: DataFrame, view: str, first: int, last: int, sigma: float = 1.0, prominence: float = 0.02, distance: int = 5) -> DataFrame:
    """Bands of the variance over slices first..last of a view: row means, smoothed; slice is the first one."""
    m = variance_map(voxels, view, first, last)
    profile = m.groupBy("volume_id", F.lit(view).alias("view"), F.lit(first).cast("long").alias("slice"), F.col("b").alias("row")).agg(F.avg("variance").alias("v"))
    return with_peaks(smoothed(profile, sigma), prominence, distance, mirrored=True)
