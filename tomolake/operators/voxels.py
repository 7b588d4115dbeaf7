"""Voxel tables: lookups, planes, masks, crops and the two physical forms.

A voxel table has volume_id, x, y, z, gray, label, one row a voxel. The chunk form holds cubes of side d as bytes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomolake.operators.sizes import small

PLANE = {"XY": ("z", "x", "y"), "XZ": ("y", "x", "z"), "YZ": ("x", "y", "z")}  # fixed axis, then the plane's


def lookup(voxels: DataFrame, points: DataFrame, value: str = "gray") -> DataFrame:
    """points (volume_id, x, y, z) with the value there, 0 outside the volume."""
    key = ["volume_id", "x", "y", "z"]
    return points.join(voxels.select(*key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def plane(voxels: DataFrame, view: str, at: int) -> DataFrame:
    """One slice of each volume: the columns a and b are the plane's own coordinates."""
    fixed, a, b = PLANE[view]
    return voxels.where(F.col(fixed) == at).select("volume_id", F.col(a).alias("a"), F.col(b).alias("b"), "gray", "label")


def line(voxels: DataFrame, along: str, **fixed: int) -> DataFrame:
    """One line: its coordinate as i, in order."""
    for axis, at in fixed.items():
        voxels = voxels.where(F.col(axis) == at)
    return voxels.select("volume_id", F.col(along).alias("i"), "gray", "label").orderBy("volume_id", "i")


def threshold(low: int, high: int, column: str = "gray") -> Column:
    return F.col(column).between(low, high)


def material_mask(material: int) -> Column:
    return (F.col("label") == material).cast("int")


def inside_cylinder(centre: Sequence[float], radius: float, length: float, axis: str = "z") -> Column:
    """Within the radius of the axis through the centre, and half the length of the centre along it."""
    at = dict(zip("xyz", centre, strict=True))
    across = [c for c in "xyz" if c != axis]
    square = sum(((F.col(c) - at[c]) * (F.col(c) - at[c]) for c in across), F.lit(0.0))
    return (square <= radius * radius) & (F.abs(F.col(axis) - at[axis]) <= length / 2)


def of_view(measurements: DataFrame, view: str, at: int) -> DataFrame:
    """Measurements or annotations (view, slice) drawn on one slice of a view."""
    return measurements.where((F.col("view") == view) & (F.col("slice") == at))


def by_id(rows: DataFrame, *ids: int) -> DataFrame:
    return rows.where(F.col("id").isin(*ids))


def annotations_of_slice(annotations: DataFrame, z: int | None = None, kind: str | None = None) -> DataFrame:
    """Annotations (x, y, z, type) of a slice or all, of one kind (Point, Box) or any."""
    out = annotations if z is None else annotations.where(F.col("z") == z)
    return out if kind is None else out.where(F.col("type") == kind)


def set_pixel_size(volumes: DataFrame, volume_id: int, pixel_size: float) -> DataFrame:
    """volumes with another scale for one of them; units are worked out from it when asked for."""
    return volumes.withColumn("pixel_size", F.when(F.col("volume_id") == volume_id, F.lit(float(pixel_size))).otherwise(F.col("pixel_size")))


def blank_labels(voxels: DataFrame) -> DataFrame:
    return voxels.withColumn("label", F.lit(0).cast("long"))


def crop(voxels: DataFrame, low: Sequence[int], high: Sequence[int]) -> DataFrame:
    """Half-open box."""
    for axis, a, b in zip("xyz", low, high, strict=True):
        voxels = voxels.where((F.col(axis) >= a) & (F.col(axis) < b))
    return voxels


def material_bounds(voxels: DataFrame, dims: Sequence[int], margin: int = 1) -> DataFrame:
    """Bounding box of each material with a margin, clamped to the volume."""
    sides = [f for a, n in zip("xyz", dims, strict=True) for f in (F.greatest(F.min(a) - margin, F.lit(0)).alias(f"min_{a}"), F.least(F.max(a) + margin, F.lit(n - 1)).alias(f"max_{a}"))]
    return voxels.groupBy("volume_id", "label").agg(*sides)


def sub_volume(voxels: DataFrame, bounds: DataFrame, material: int) -> DataFrame:
    """The material's box: coordinates from its corner, other labels 0, and the original coordinates."""
    box = bounds.where(F.col("label") == material).drop("label")
    v = voxels.join(small(box), "volume_id")
    for a in "xyz":
        v = v.where(F.col(a).between(F.col(f"min_{a}"), F.col(f"max_{a}")))
    shifted = [(F.col(a) - F.col(f"min_{a}")).alias(a) for a in "xyz"]
    return v.select("volume_id", *shifted, "gray", F.when(F.col("label") == material, F.col("label")).otherwise(0).alias("label"), *[F.col(a).alias(f"orig_{a}") for a in "xyz"])


def write_back(voxels: DataFrame, sub: DataFrame, column: str) -> DataFrame:
    """The column of a sub-volume at its original place; elsewhere the volume's own."""
    back = sub.select("volume_id", *[F.col(f"orig_{a}").alias(a) for a in "xyz"], F.col(column).alias("__new"))
    return voxels.join(back, ["volume_id", "x", "y", "z"], "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def every_nth(voxels: DataFrame, n: int) -> DataFrame:
    """Labelled voxels at every n-th place of each axis."""
    return voxels.where((F.col("x") % n == 0) & (F.col("y") % n == 0) & (F.col("z") % n == 0) & (F.col("label") != 0))


def visible(voxels: DataFrame, materials: DataFrame) -> DataFrame:
    shown = materials.where("is_visible AND NOT is_exterior").select(F.col("id").alias("label"))
    return voxels.join(small(shown), "label", "left_semi")


def to_chunks(voxels: DataFrame, dims: Sequence[int], d: int = 64) -> DataFrame:
    """Chunk form: (volume_id, cx, cy, cz, d, gray binary, label binary), z-major, 0 beyond the volume's edge."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        at = ((pdf["z"] % d) * d + pdf["y"] % d) * d + pdf["x"] % d
        out = {}
        for c in ("gray", "label"):
            cube = np.zeros(d**3, np.uint8)
            cube[at] = pdf[c]
            out[c] = [cube.tobytes()]
        return pd.DataFrame({c: [pdf[c].iloc[0]] for c in ("volume_id", "cx", "cy", "cz")} | {"d": [d]} | out)

    keyed = voxels.withColumns({f"c{a}": F.floor(F.col(a) / d) for a in "xyz"})
    return keyed.groupBy("volume_id", "cx", "cy", "cz").applyInPandas(pack, "volume_id long, cx long, cy long, cz long, d long, gray binary, label binary")


def from_chunks(chunks: DataFrame, dims: Sequence[int]) -> DataFrame:
    """Long form of chunks, without the places beyond the volume's edge."""
    w, h, depth = dims

    def unpack(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                z, y, x = np.unravel_index(np.arange(r.d**3), (r.d, r.d, r.d))
                out = pd.DataFrame({"volume_id": r.volume_id, "x": x + r.cx * r.d, "y": y + r.cy * r.d, "z": z + r.cz * r.d, "gray": np.frombuffer(r.gray, np.uint8).astype(np.int64), "label": np.frombuffer(r.label, np.uint8).astype(np.int64)})
                yield out[(out["x"] < w) & (out["y"] < h) & (out["z"] < depth)]

    return chunks.mapInPandas(unpack, "volume_id long, x long, y long, z long, gray long, label long")
