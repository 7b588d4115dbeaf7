"""Connected components of voxels: local labels by chunk, merged over the faces of chunks.

Chunks travel as packed pieces (see stencil); after that only their faces and the pairs of labels that touch are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomolake.operators.graph import connected_components
from tomolake.operators.sizes import small
from tomolake.operators.stencil import blocks, places
from tomolake.sources.shared import written

SIX = [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
FOUR_2D = [(1, 0, 0), (0, 1, 0)]
EIGHT_2D = [*FOUR_2D, (1, 1, 0), (1, -1, 0)]
TWENTY_SIX = [o for o in product((-1, 0, 1), repeat=3) if o > (0, 0, 0)]


def _paired(a: np.ndarray, o: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Views of a [z, y, x] array: each place, and the place at the offset (x, y, z)."""
    here = tuple(slice(max(0, -c), a.shape[n] - max(0, c)) for n, c in enumerate(reversed(o)))
    there = tuple(slice(max(0, c), a.shape[n] - max(0, -c)) for n, c in enumerate(reversed(o)))
    return a[here], a[there]


def label_block(values: np.ndarray, offsets: Sequence[tuple[int, int, int]]) -> np.ndarray:
    """For each place of a block with a value above 0, the least index linked to it over equal values."""
    index = np.arange(values.size).reshape(values.shape)
    root = np.where(values > 0, index, values.size)
    links = [_paired(values, o) for o in offsets]
    links = [(a > 0) & (a == b) for a, b in links]
    while True:
        before = root.copy()
        for o, same in zip(offsets, links, strict=True):
            a, b = _paired(root, o)
            low = np.minimum(a, b)
            np.minimum(a, low, out=a, where=same)  # the views overlap: only ever lower
            np.minimum(b, low, out=b, where=same)
        flat = np.append(root.ravel(), values.size)
        root = flat[root]
        if (root == before).all():
            return root


def label_components(rows: DataFrame, dims: Sequence[int], offsets: Sequence[tuple[int, int, int]] = SIX, chunk: int = 64, value: str = "label") -> DataFrame:
    """rows (volume_id, x, y, z, value) with `component`, the least linear index z * W * H + y * W + x linked to each.

    Voxels link at the given offsets (one of each opposite pair) if their values are equal; values up to 0 are left
    out. Chunks are labelled in their tasks; only pairs of chunk labels that touch go into the distributed merge.
    """
    w, h, _ = dims
    mask = rows.where(F.col(value) > 0).select("volume_id", "x", "y", "z", F.col(value).cast("long").alias("value"))

    def work(volume: int, corner: tuple[int, int, int], block: np.ndarray, present: np.ndarray) -> pa.Table:
        values = block.astype(np.int64)
        z, y, x = np.unravel_index(np.where(present, label_block(values, offsets), 0), values.shape)
        return places(volume, corner, present, value=values, local=((z + corner[2]) * h + y + corner[1]) * w + x + corner[0])

    local = written(blocks(mask, work, "volume_id long, x long, y long, z long, value long, local long", 0, dims, chunk, "value"), "local_labels")
    # Only voxels on a chunk's faces can link to another chunk: they alone are sent to their neighbours.
    border = local.where(" OR ".join(f"pmod({a}, {chunk}) IN (0, {chunk - 1})" for a in "xyz"))
    o = F.array(*[F.struct(*[F.lit(c).alias(n) for n, c in zip("ijk", off, strict=True)]) for off in offsets])
    out = border.select("volume_id", "value", F.col("local").alias("a"), "x", "y", "z", F.explode(o).alias("o"))
    out = out.select("volume_id", "value", "a", *[(F.col(a) + F.col(f"o.{c}")).alias(a) for a, c in zip("xyz", "ijk", strict=True)], *[F.col(a).alias(f"p{a}") for a in "xyz"])
    crossing = " OR ".join(f"floor({a} / {chunk}) != floor(p{a} / {chunk})" for a in "xyz")
    faces = out.where(crossing).join(border.withColumnRenamed("local", "b"), ["volume_id", "x", "y", "z", "value"]).select("volume_id", "a", "b").distinct()
    pairs = faces.select(F.struct("volume_id", F.col("a").alias("i")).alias("a"), F.struct("volume_id", F.col("b").alias("i")).alias("b"))
    roots = connected_components(pairs).select(F.col("node.volume_id").alias("volume_id"), F.col("node.i").alias("local"), F.col("root.i").alias("root"))
    return local.join(small(roots), ["volume_id", "local"], "left").select("volume_id", "x", "y", "z", F.col("value").alias(value), F.coalesce("root", "local").alias("component"))


def separate_particles(voxels: DataFrame, material: int, dims: Sequence[int], flat: bool = False, conservative: bool = False, chunk: int = 64) -> DataFrame:
    """Components of a material: 6-connected in space, or 8-connected by slice; optionally without those of under 20
    voxels (10 pixels by slice)."""
    out = label_components(voxels.where(F.col("label") == material), dims, EIGHT_2D if flat else SIX, chunk)
    if not conservative:
        return out
    kept = out.groupBy("volume_id", "component").count().where(F.col("count") >= (10 if flat else 20)).drop("count")
    return out.join(kept, ["volume_id", "component"], "left_semi")


def remove_islands(voxels: DataFrame, dims: Sequence[int], least: int, material: int | None = None, chunk: int = 64) -> DataFrame:
    """voxels whose components of fewer than `least` voxels become exterior, for one material or all but the exterior."""
    chosen = voxels.where(F.col("label") > 0 if material is None else F.col("label") == material)
    found = label_components(chosen, dims, SIX, chunk)
    small = found.groupBy("volume_id", "component").count().where(F.col("count") < least).drop("count")
    gone = found.join(small, ["volume_id", "component"], "left_semi").select("volume_id", "x", "y", "z", F.lit(True).alias("__gone"))
    return voxels.join(gone, ["volume_id", "x", "y", "z"], "left").withColumn("label", F.when(F.col("__gone"), 0).otherwise(F.col("label"))).drop("__gone")


def exposed_faces(voxels: DataFrame, material: int) -> DataFrame:
    """A row for each face of the material's voxels that no voxel of it touches: x, y, z and direction; also at the edge."""
    dirs = {"-x": (-1, 0, 0), "+x": (1, 0, 0), "-y": (0, -1, 0), "+y": (0, 1, 0), "-z": (0, 0, -1), "+z": (0, 0, 1)}
    o = F.array(*[F.struct(F.lit(n).alias("d"), *[F.lit(c).alias(k) for k, c in zip("ijk", off, strict=True)]) for n, off in dirs.items()])
    mine = voxels.where(F.col("label") == material).select("volume_id", "x", "y", "z")
    faces = mine.select("volume_id", "x", "y", "z", F.explode(o).alias("o"))
    faces = faces.select("volume_id", "x", "y", "z", F.col("o.d").alias("direction"), *[(F.col(a) + F.col(f"o.{c}")).alias(f"n{a}") for a, c in zip("xyz", "ijk", strict=True)])
    return faces.join(mine.select("volume_id", *[F.col(a).alias(f"n{a}") for a in "xyz"]), ["volume_id", "nx", "ny", "nz"], "left_anti").select("volume_id", "x", "y", "z", "direction")


def mask_boxes(mask: DataFrame, dims: Sequence[int], least: int = 5) -> DataFrame:
    """Bounding boxes of a mask's 4-connected regions by slice, with both sides over the limit."""
    found = label_components(mask, dims, FOUR_2D)
    b = found.groupBy("volume_id", "z", "component").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))
    return b.where((F.col("w") > least) & (F.col("h") > least))
