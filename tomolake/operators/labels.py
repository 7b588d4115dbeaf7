"""Segmentation: updates of the label column, material tables, masks and boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomolake.operators.graph import dominated
from tomolake.operators.sizes import small
from tomolake.operators.voxels import PLANE

KEY = ["volume_id", "x", "y", "z"]


def relabel(voxels: DataFrame, when: Column, to: int | Column) -> DataFrame:
    return voxels.withColumn("label", F.when(when, to if isinstance(to, Column) else F.lit(to).cast("long")).otherwise(F.col("label")))


def on_slice(z: int | None) -> Column:
    return F.lit(True) if z is None else F.col("z") == z


def add_by_threshold(voxels: DataFrame, material: int, low: int, high: int, z: int | None = None) -> DataFrame:
    return relabel(voxels, F.col("gray").between(low, high) & on_slice(z), material)


def remove_by_threshold(voxels: DataFrame, material: int, low: int, high: int, z: int | None = None) -> DataFrame:
    return relabel(voxels, (F.col("label") == material) & F.col("gray").between(low, high) & on_slice(z), 0)


def _selected(voxels: DataFrame, selection: DataFrame, view: str) -> DataFrame:
    """voxels with the value marked on planes of the view (volume_id, fixed, a, b, value), null where none is."""
    fixed, a, b = PLANE[view]
    marks = selection.where("value <> 0").select("volume_id", F.col("fixed").alias(fixed), F.col("a").alias(a), F.col("b").alias(b), F.col("value").alias("__value"))
    return voxels.join(marks, KEY, "left")


def apply_selection(voxels: DataFrame, selection: DataFrame, view: str = "XY") -> DataFrame:
    """Marked places get the mark as label."""
    return _selected(voxels, selection, view).withColumn("label", F.coalesce("__value", "label")).drop("__value")


def subtract_selection(voxels: DataFrame, selection: DataFrame, view: str = "XY") -> DataFrame:
    """Marked places that carry the mark as label become exterior."""
    return _selected(voxels, selection, view).withColumn("label", F.when(F.col("__value") == F.col("label"), 0).otherwise(F.col("label"))).drop("__value")


def invert_selection(selection: DataFrame, places: DataFrame, material: int) -> DataFrame:
    """Places (volume_id, a, b) of a plane that aren't marked, marked with the material."""
    return places.join(selection.where("value <> 0"), ["volume_id", "a", "b"], "left_anti").withColumn("value", F.lit(material).cast("long"))


def move_selected(voxels: DataFrame, selection: DataFrame, source: int, target: int, view: str = "XY") -> DataFrame:
    return relabel(_selected(voxels, selection, view), F.col("__value").isNotNull() & (F.col("label") == source), target).drop("__value")


def move_by_threshold(voxels: DataFrame, source: int, target: int, low: int, high: int) -> DataFrame:
    return relabel(voxels, (F.col("label") == source) & F.col("gray").between(low, high), target)


def move_by_own_range(voxels: DataFrame, materials: DataFrame, source: int, target: int) -> DataFrame:
    """Moves the source's voxels that lie in the range of the target material."""
    span = materials.where(F.col("id") == target).select(F.col("min").alias("__low"), F.col("max").alias("__high"))
    v = voxels.crossJoin(F.broadcast(span.limit(1)))
    return relabel(v, (F.col("label") == source) & F.col("gray").between(F.col("__low"), F.col("__high")), target).drop("__low", "__high")


def move_all(voxels: DataFrame, source: int, target: int) -> DataFrame:
    return relabel(voxels, F.col("label") == source, target)


def merge_materials(voxels: DataFrame, materials: DataFrame, target: int, source: int) -> tuple[DataFrame, DataFrame]:
    return move_all(voxels, source, target), materials.where(F.col("id") != source)


def remove_material(voxels: DataFrame, materials: DataFrame, material: int) -> tuple[DataFrame, DataFrame]:
    """Material 0, the exterior, can't be removed."""
    if material == 0:
        return voxels, materials
    return move_all(voxels, material, 0), materials.where(F.col("id") != material)


def next_free_id(materials: DataFrame) -> DataFrame:
    """The least unused id from 1 to 254, null if there is none."""
    ids = materials.sparkSession.range(1, 255).toDF("id")
    return ids.join(small(materials.select("id").distinct()), "id", "left_anti").agg(F.min("id").alias("next_id"))


def add_material(materials: DataFrame, name: str, low: int, high: int) -> DataFrame:
    free = next_free_id(materials).select(F.col("next_id").alias("id"), F.lit(name).alias("name"), F.lit(low).cast("long").alias("min"), F.lit(high).cast("long").alias("max"), F.lit(False).alias("is_exterior"), F.lit(1000.0).alias("density"), F.lit(True).alias("is_visible"))
    return materials.unionByName(free.where("id IS NOT NULL"), allowMissingColumns=True)


def rename_material(materials: DataFrame, material: int, name: str) -> DataFrame:
    return materials.withColumn("name", F.when(F.col("id") == material, F.lit(name)).otherwise(F.col("name")))


def apply_ranges(voxels: DataFrame, materials: DataFrame) -> DataFrame:
    """Labels by gray range: of the ranges that hold a value the one with the least minimum (then id) wins; else 0.

    There are 256 gray values, so the ranges are resolved once for each and joined.
    """
    ranges = materials.where("NOT is_exterior AND max >= greatest(min, 0) AND min <= 255").select("id", "min", "max")
    grays = ranges.select("id", "min", F.explode(F.sequence(F.greatest("min", F.lit(0).cast("long")), F.least("max", F.lit(255).cast("long")))).alias("gray"))
    table = grays.groupBy("gray").agg(F.min_by("id", F.struct("min", "id")).alias("__id"))
    return voxels.join(F.broadcast(table), "gray", "left").withColumn("label", F.coalesce("__id", F.lit(0).cast("long"))).drop("__id")


def binarize(voxels: DataFrame, level: int, invert: bool = False) -> DataFrame:
    hit = F.col("gray") < level if invert else F.col("gray") >= level
    return voxels.withColumn("label", F.when(hit, 1).otherwise(0).cast("long"))


def extract_materials(voxels: DataFrame, wanted: Sequence[int], background: int = 0) -> DataFrame:
    """Wanted ids become 1, 2, ... in the list's order, all else the background."""
    names = F.create_map(*[F.lit(x).cast("long") for i, m in enumerate(wanted) for x in (m, i + 1)])
    return voxels.withColumn("label", F.coalesce(names[F.col("label")], F.lit(background).cast("long")))


def fill_between(marks: DataFrame, axis: str = "z") -> DataFrame:
    """Marked places and all between consecutive ones along the axis."""
    others = [c for c in "xyz" if c != axis]
    w = Window.partitionBy("volume_id", *others).orderBy(axis)
    spans = marks.select("volume_id", "x", "y", "z").distinct().withColumn("__next", F.coalesce(F.lead(axis).over(w) - 1, F.col(axis)))
    return spans.select("volume_id", *others, F.explode(F.sequence(axis, "__next")).alias(axis)).select(KEY)


def fan_lines(marks: DataFrame, axis: str = "z") -> DataFrame:
    """Lines between each marked place of a slice and the centroids of the marked slices before and after.

    A line has one place for each step along its longest side, coordinates rounded, halves to even.
    """
    others = [c for c in "xyz" if c != axis]
    centre = marks.groupBy("volume_id", axis).agg(*[F.floor(F.avg(c)).cast("long").alias(f"c_{c}") for c in others])
    w = Window.partitionBy("volume_id").orderBy(axis)
    out = None
    for move in (F.lead, F.lag):
        ends = centre.select("volume_id", F.col(axis), move(axis).over(w).alias(f"e_{axis}"), *[move(f"c_{c}").over(w).alias(f"e_{c}") for c in others]).where(f"e_{axis} IS NOT NULL")
        lines = marks.join(ends, ["volume_id", axis])
        n = F.greatest(*[F.abs(F.col(f"e_{c}") - F.col(c)) for c in "xyz"])
        points = lines.withColumn("__n", n).withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), "__n")))
        at = [F.when(F.col("__n") == 0, F.col(c)).otherwise(F.bround(F.col(c) + F.round((F.col(f"e_{c}") - F.col(c)) * F.col("__i") / F.col("__n"), 9)).cast("long")).alias(c) for c in "xyz"]
        part = points.select("volume_id", *at)
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def dilate(mask: DataFrame, radius: int, dims: Sequence[int]) -> DataFrame:
    """Places within the radius of a place of the mask, inside the volume."""
    ball = [(i, j, k) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) for k in range(-radius, radius + 1) if i * i + j * j + k * k <= radius * radius]
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i, j, k in ball])
    out = mask.select("volume_id", "x", "y", "z", F.explode(offsets).alias("o"))
    out = out.select("volume_id", (F.col("x") + F.col("o.i")).alias("x"), (F.col("y") + F.col("o.j")).alias("y"), (F.col("z") + F.col("o.k")).alias("z"))
    for a, n in zip("xyz", dims, strict=True):
        out = out.where(F.col(a).between(0, n - 1))
    return out.distinct()


def interpolate_selection(marks: DataFrame, dims: Sequence[int], axis: str = "z") -> DataFrame:
    """The places between marked slices: lines to the neighbours' centroids, one thick (two between centroids), then with
    the marks widened by 3 and smoothed over 3-cubes at 0.4. Two marked slices are needed for more than the marks' own."""
    others = [c for c in "xyz" if c != axis]
    centroids = marks.groupBy("volume_id", axis).agg(*[F.floor(F.avg(c)).cast("long").alias(c) for c in others]).select(KEY)
    lines = dilate(fan_lines(marks, axis), 1, dims).unionByName(dilate(fan_lines(centroids, axis), 2, dims))
    whole = marks.select(KEY).unionByName(lines).distinct()
    return smooth_mask(dilate(whole, 3, dims), 3, 0.4, dims)


def apply_mask(voxels: DataFrame, mask: DataFrame, material: int) -> DataFrame:
    """Places of the mask get the material."""
    hit = mask.select(*KEY, F.lit(True).alias("__hit")).distinct()
    return relabel(voxels.join(hit, KEY, "left"), F.col("__hit").isNotNull(), material).drop("__hit")


def subtract_mask(voxels: DataFrame, mask: DataFrame, material: int) -> DataFrame:
    """Places of the mask that carry the material become exterior."""
    hit = mask.select(*KEY, F.lit(True).alias("__hit")).distinct()
    return relabel(voxels.join(hit, KEY, "left"), F.col("__hit").isNotNull() & (F.col("label") == material), 0).drop("__hit")


def smooth_map(maps: DataFrame, passes: int = 1) -> DataFrame:
    """Each pixel of maps (map_id, x, y, value) as the whole mean of the 3 x 3 around it that exist, `passes` times."""
    w = Window.partitionBy("map_id", "y").orderBy("x").rangeBetween(-1, 1)
    m = maps.select("map_id", "x", "y", "value")
    for _ in range(passes):
        # Each pixel goes to its row and the rows beside it, where a window looks along x; nothing is joined.
        sent = m.select("map_id", "x", F.explode(F.array(*[F.col("y") + i for i in (-1, 0, 1)])).alias("y"), "value", F.col("y").alias("own"))
        seen = sent.withColumn("near", F.avg("value").over(w)).where("own = y")
        m = seen.groupBy("map_id", "x", "y").agg(F.floor(F.first("near") + 1e-9).cast("long").alias("value"))
    return m


def smooth_mask(mask: DataFrame, k: int, level: float, dims: Sequence[int]) -> DataFrame:
    """Places whose share of mask around them, weighted 1 / (1 + d2), reaches the level; outside places don't count.

    Only places with a mask voxel in their k-cube can have a share above 0, so the mask sends its weight out; the sum
    of all weights follows from the distances to the edges.
    """
    r = k // 2
    cube = [(i, j, m) for i in range(-r, r + 1) for j in range(-r, r + 1) for m in range(-r, r + 1)]
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(m).alias("k"), F.lit(1.0 / (1 + i * i + j * j + m * m)).alias("w")) for i, j, m in cube])
    sent = mask.select("volume_id", "x", "y", "z", F.explode(offsets).alias("o")).select("volume_id", (F.col("x") + F.col("o.i")).alias("x"), (F.col("y") + F.col("o.j")).alias("y"), (F.col("z") + F.col("o.k")).alias("z"), F.col("o.w").alias("w"))
    for a, n in zip("xyz", dims, strict=True):
        sent = sent.where(F.col(a).between(0, n - 1))
    hit = sent.groupBy("volume_id", "x", "y", "z").agg(F.sum("w").alias("hit"))
    w, h, d = dims
    total = F.aggregate(offsets, F.lit(0.0), lambda s, o: s + F.when((F.col("x") + o["i"]).between(0, w - 1) & (F.col("y") + o["j"]).between(0, h - 1) & (F.col("z") + o["k"]).between(0, d - 1), o["w"]).otherwise(0.0))
    return hit.where(F.col("hit") / total >= level - 1e-12).select(KEY)


def majority_vote(maps: DataFrame) -> DataFrame:
    """(x, y, value): the most frequent value of each pixel over maps (map_id, x, y, value), of equals that of the first map."""
    n = maps.groupBy("x", "y", "value").agg(F.count("*").alias("n"), F.min("map_id").alias("first"))
    return n.groupBy("x", "y").agg(F.max_by("value", F.struct("n", -F.col("first"))).alias("value"))


def weighted_average(maps: DataFrame, weights: dict[int, float]) -> DataFrame:
    w = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])[F.col("map_id").cast("int")]
    return maps.groupBy("x", "y").agg(F.floor(F.sum(w * F.col("value")) / F.sum(w) + 1e-9).cast("long").alias("value"))


def frequency_map(maps: DataFrame, target: int) -> DataFrame:
    return maps.groupBy("x", "y").agg(F.floor(255 * F.avg((F.col("value") == target).cast("double")) + 1e-9).cast("long").alias("value"))


def suppress_boxes(boxes: DataFrame, iou: float = 0.5) -> DataFrame:
    """Boxes (det_id, slice, x, y, w, h, score) that survive greedy non-maximum suppression within their slice.

    Of equal boxes of a slice only the strongest (score, then least id) can survive. Overlaps above the limit between
    the others are found by an equi-join on the tiles that boxes cover; a pair counts in the tile of its common corner. Then rounds
    decide, see dominated().
    """
    size = 32
    same = boxes.groupBy("slice", "x", "y", "w", "h").agg(F.max(F.struct("score", (-F.col("det_id")).alias("id"))).alias("top"))
    alone = same.select("slice", "x", "y", "w", "h", F.col("top.score").alias("score"), (-F.col("top.id")).alias("det_id"))
    cells = alone.withColumn("tx", F.explode(F.sequence(F.floor(F.col("x") / size), F.floor((F.col("x") + F.col("w")) / size)))).withColumn("ty", F.explode(F.sequence(F.floor(F.col("y") / size), F.floor((F.col("y") + F.col("h")) / size))))
    a, b = cells.alias("a"), cells.alias("b")
    overlap = F.greatest(F.lit(0), F.least(F.col("a.x") + F.col("a.w"), F.col("b.x") + F.col("b.w")) - F.greatest("a.x", "b.x")) * F.greatest(F.lit(0), F.least(F.col("a.y") + F.col("a.h"), F.col("b.y") + F.col("b.h")) - F.greatest("a.y", "b.y"))
    union = F.col("a.w") * F.col("a.h") + F.col("b.w") * F.col("b.h") - overlap
    before = (F.col("a.score") > F.col("b.score")) | ((F.col("a.score") == F.col("b.score")) & (F.col("a.det_id") < F.col("b.det_id")))
    corner = (F.floor(F.greatest("a.x", "b.x") / size) == F.col("a.tx")) & (F.floor(F.greatest("a.y", "b.y") / size) == F.col("a.ty"))
    pairs = a.join(b, (F.col("a.slice") == F.col("b.slice")) & (F.col("a.tx") == F.col("b.tx")) & (F.col("a.ty") == F.col("b.ty"))).where(corner & before & (overlap / union > iou))
    gone = dominated(pairs.select(F.col("a.det_id").alias("winner"), F.col("b.det_id").alias("loser")))
    kept = alone.join(gone.withColumnRenamed("node", "det_id"), "det_id", "left_anti").select("det_id")
    return boxes.join(kept, "det_id", "left_semi")


def label_boxes(voxels: DataFrame, boxes: DataFrame, material: int, least: float, view: str = "XY") -> DataFrame:
    """Half-open rectangles of selected boxes of at least that score get the material, on slices of the view."""
    fixed, a, b = PLANE[view]
    hits = boxes.where(F.col("selected") & (F.col("score") >= least))
    places = hits.where("w > 0 AND h > 0").select(F.col("slice").alias(fixed), F.explode(F.sequence(F.col("x"), F.col("x") + F.col("w") - 1)).alias(a), "y", "h").select(fixed, a, F.explode(F.sequence(F.col("y"), F.col("y") + F.col("h") - 1)).alias(b)).distinct().withColumn("__hit", F.lit(True))
    return relabel(voxels.join(places, ["x", "y", "z"], "left"), F.col("__hit").isNotNull(), material).drop("__hit")


def box_points(boxes: DataFrame) -> DataFrame:
    """(det_id, kind, px, py): centre, corners, and the outline in steps of max(5, shorter side / 8)."""
    step = F.greatest(F.lit(5), F.floor(F.least("w", "h") / 8)).cast("long")
    b = boxes.withColumn("step", step)
    x2, y2 = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    centre = b.select("det_id", F.lit("centre").alias("kind"), F.floor(F.col("x") + F.col("w") / 2).cast("long").alias("px"), F.floor(F.col("y") + F.col("h") / 2).cast("long").alias("py"))
    corners = b.select("det_id", F.lit("corner").alias("kind"), F.inline(F.array(*[F.struct(u.alias("px"), v.alias("py")) for u in (F.col("x"), x2) for v in (F.col("y"), y2)])))
    along = b.select("det_id", F.lit("outline").alias("kind"), F.explode(F.sequence("x", x2, "step")).alias("px"), F.array("y", y2).alias("ys")).select("det_id", "kind", "px", F.explode("ys").alias("py"))
    up = b.select("det_id", F.lit("outline").alias("kind"), F.array("x", x2).alias("xs"), F.explode(F.sequence("y", y2, "step")).alias("py")).select("det_id", "kind", F.explode("xs").alias("px"), "py")
    return centre.unionByName(corners).unionByName(along).unionByName(up).distinct()


def weighted_points(boxes: DataFrame, grid: int = 5) -> DataFrame:
    """(det_id, kind, px, py, weight): a grid over the box whose points weigh more towards its centre, and the box filled in
    steps of max(4, a tenth of the shorter side), each point of weight 1."""
    g = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(grid - max(abs(i - grid // 2), abs(j - grid // 2))).cast("long").alias("weight")) for i in range(grid) for j in range(grid)]))
    at = lambda a, side, k: (F.col(a) + F.col(side) * F.col(f"g.{k}") / (grid - 1)).cast("double")
    grids = boxes.withColumn("g", g).select("det_id", F.lit("grid").alias("kind"), at("x", "w", "i").alias("px"), at("y", "h", "j").alias("py"), "g.weight")
    step = F.greatest(F.lit(4), F.floor(F.least("w", "h") / 10)).cast("long")
    along = boxes.withColumn("step", step).withColumn("px", F.explode(F.sequence("x", F.col("x") + F.col("w"), "step"))).withColumn("py", F.explode(F.sequence("y", F.col("y") + F.col("h"), "step")))
    return grids.unionByName(along.select("det_id", F.lit("fill").alias("kind"), F.col("px").cast("double").alias("px"), F.col("py").cast("double").alias("py"), F.lit(1).cast("long").alias("weight")))


def merge_masks(masks: DataFrame) -> DataFrame:
    """Places marked in any of the masks (mask_id, volume_id, x, y, z, value)."""
    return masks.where("value <> 0").select(KEY).distinct()


def polygon_mask(pixels: DataFrame, points: Sequence[tuple[float, float]]) -> Column:
    """Even-odd rule for a pixel (x, y) against a polygon."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(points, [*points[1:], points[0]], strict=True):
        if y1 != y2:
            spans = (F.lit(float(y1)) > F.col("y")) != (F.lit(float(y2)) > F.col("y"))
            crossings += F.when(spans & (F.col("x") < F.lit(float(x1)) + (F.col("y") - y1) * (x2 - x1) / (y2 - y1)), 1).otherwise(0)
    return crossings % 2 == 1


def colour_distance_mask(rgb: tuple[int, int, int], tolerance: float) -> Column:
    square = sum(((F.col(c) - v) * (F.col(c) - v) for c, v in zip("rgb", rgb, strict=True)), F.lit(0))
    return F.sqrt(square.cast("double")) <= tolerance
