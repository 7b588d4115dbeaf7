"""Queries over the voxels: lookups, segmentation, statistics, filters, resampling and components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomolake.functions import physics as fx
from tomolake.operators import components as comp
from tomolake.operators import labels as lab
from tomolake.operators import resample, series, stats, stencil
from tomolake.operators import voxels as vox
from tomolake.plans.fixtures import BOXES, MAPS, PIXEL, VOX, boxes, dims, grays, label_maps, materials, selections, voxels
from tomolake.plans.registry import query
from tomolake.sources import containers, files
from tomolake.sources.shared import new_path

S, D = SparkSession, DataFrame
WITH = f"WITH RECURSIVE {VOX} "
ALL = "SELECT volume_id, x, y, z, gray, {} AS label FROM v"
JOINED = "SELECT v.volume_id, v.x, v.y, v.z, v.gray, {} AS label FROM v LEFT JOIN sel s ON v.x = s.x AND v.y = s.y AND v.z = s.z"


@query(WITH + "SELECT m.id, m.name, count(v.label) AS voxel_count, round(count(v.label) * 1.0, 6) AS volume_um3, round(count(v.label) * 1e-9, 6) AS volume_mm3, round(count(v.label) * 1e-12, 6) AS volume_cm3, round(100.0 * count(v.label) / (SELECT count(*) FROM v), 6) AS percent FROM m LEFT JOIN v ON v.label = m.id GROUP BY m.id, m.name")
def a01_material_statistics(spark: S, d: str) -> D:
    """Voxels are labelled by material ranges, then measured."""
    m = materials(spark)
    return stats.material_statistics(lab.apply_ranges(grays(spark, d), m), m, PIXEL)


@query(WITH + ALL.format("label"))
def g15_apply_ranges(spark: S, d: str) -> D:
    return lab.apply_ranges(grays(spark, d), materials(spark)).select("volume_id", "x", "y", "z", "gray", "label")


@query(WITH + ", p AS (SELECT volume_id, x + 20 AS x, y, z FROM v WHERE gray < 40) SELECT p.volume_id, p.x, p.y, p.z, coalesce(v.gray, 0) AS gray FROM p LEFT JOIN v ON p.x = v.x AND p.y = v.y AND p.z = v.z")
def p01_lookup(spark: S, d: str) -> D:
    v = voxels(spark, d)
    points = v.where("gray < 40").select("volume_id", (F.col("x") + 20).alias("x"), "y", "z")
    return vox.lookup(v, points).select("volume_id", "x", "y", "z", "gray")


@query(WITH + "SELECT volume_id, 'XY' AS view, x AS a, y AS b, gray, label FROM v WHERE z = 2 UNION ALL SELECT volume_id, 'XZ', x, z, gray, label FROM v WHERE y = 7 UNION ALL SELECT volume_id, 'YZ', y, z, gray, label FROM v WHERE x = 11")
def p02_planes(spark: S, d: str) -> D:
    v = voxels(spark, d)
    parts = [vox.plane(v, w, at).withColumn("view", F.lit(w)) for w, at in (("XY", 2), ("XZ", 7), ("YZ", 11))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(WITH + "SELECT volume_id, x AS i, gray, label FROM v WHERE y = 3 AND z = 1")
def p03_line(spark: S, d: str) -> D:
    return vox.line(voxels(spark, d), "x", y=3, z=1)


@query(WITH + "SELECT volume_id, x, y, z, gray BETWEEN 90 AND 140 AS hit, CASE WHEN label = 2 THEN 1 ELSE 0 END AS mask FROM v")
def p04_threshold_and_mask(spark: S, d: str) -> D:
    return voxels(spark, d).select("volume_id", "x", "y", "z", vox.threshold(90, 140).alias("hit"), vox.material_mask(2).alias("mask"))


@query(WITH + ALL.format("CASE WHEN (x - 12) * (x - 12) + (y - 12) * (y - 12) <= 100 AND abs(z - 1.5) <= 40 THEN label ELSE 0 END"))
def g24_core_extraction(spark: S, d: str) -> D:
    """P06 and G24."""
    v = voxels(spark, d)
    return lab.relabel(v, ~vox.inside_cylinder((12, 12, 1.5), 10, 80), 0)


@query(WITH + ", b AS (SELECT min(x) - 1 AS x0, min(y) - 1 AS y0, min(z) - 1 AS z0, max(x) + 1 AS x1, max(y) + 1 AS y1, max(z) + 1 AS z1 FROM v WHERE label = 1 AND x BETWEEN 5 AND 20) SELECT volume_id, x - greatest(x0, 0) AS x, y - greatest(y0, 0) AS y, z - greatest(z0, 0) AS z, gray, CASE WHEN label = 1 AND x BETWEEN 5 AND 20 THEN 1 ELSE 0 END AS label, x AS orig_x, y AS orig_y, z AS orig_z FROM v, b, dim WHERE x BETWEEN greatest(x0, 0) AND least(x1, w - 1) AND y BETWEEN greatest(y0, 0) AND least(y1, h - 1) AND z BETWEEN greatest(z0, 0) AND least(z1, d - 1)")
def p09_sub_volume(spark: S, d: str) -> D:
    """Box of a material with a margin, cropped and shifted."""
    v = voxels(spark, d)
    v = lab.relabel(v, (F.col("label") == 1) & ~F.col("x").between(5, 20), 0)
    return vox.sub_volume(v, vox.material_bounds(v, dims(spark, d)), 1)


@query(WITH + "SELECT volume_id, x, y, z, gray, label FROM v WHERE x >= 3 AND x < 15 AND y >= 2 AND y < 9 AND z >= 0 AND z < 2")
def p07_crop(spark: S, d: str) -> D:
    return vox.crop(voxels(spark, d), (3, 2, 0), (15, 9, 2))


@query(WITH + "SELECT volume_id, x, y, z, gray, label FROM v WHERE x % 3 = 0 AND y % 3 = 0 AND z % 3 = 0 AND label <> 0")
def p19_every_third(spark: S, d: str) -> D:
    return vox.every_nth(voxels(spark, d), 3)


@query(WITH + "SELECT volume_id, x, y, z, gray, label FROM v WHERE label IN (1, 2)")
def p21_visible_materials(spark: S, d: str) -> D:
    return vox.visible(voxels(spark, d), materials(spark)).select("volume_id", "x", "y", "z", "gray", "label")


@query(WITH + ALL.format("CASE WHEN gray BETWEEN 90 AND 140 THEN 3 ELSE label END"))
def g01_add_by_threshold(spark: S, d: str) -> D:
    return lab.add_by_threshold(voxels(spark, d), 3, 90, 140)


@query(WITH + ALL.format("CASE WHEN label = 2 AND gray BETWEEN 90 AND 140 THEN 0 ELSE label END"))
def g02_remove_by_threshold(spark: S, d: str) -> D:
    return lab.remove_by_threshold(voxels(spark, d), 2, 90, 140)


@query(WITH + ALL.format("CASE WHEN z = 1 AND gray BETWEEN 10 AND 99 THEN 3 WHEN z = 2 AND label = 2 AND gray <= 120 THEN 0 ELSE label END"))
def g03_on_one_slice(spark: S, d: str) -> D:
    return lab.remove_by_threshold(lab.add_by_threshold(voxels(spark, d), 3, 10, 99, z=1), 2, 0, 120, z=2)


@query(WITH + JOINED.format("coalesce(s.value, v.label)"))
def g04_apply_selection(spark: S, d: str) -> D:
    return lab.apply_selection(voxels(spark, d), selections(spark, d)).select("volume_id", "x", "y", "z", "gray", "label")


@query(WITH + JOINED.format("CASE WHEN s.value = v.label THEN 0 ELSE v.label END"))
def g05_subtract_selection(spark: S, d: str) -> D:
    return lab.subtract_selection(voxels(spark, d), selections(spark, d)).select("volume_id", "x", "y", "z", "gray", "label")


@query(WITH + JOINED.format("coalesce(s.value, v.label)"))
def g06_orthogonal_selection(spark: S, d: str) -> D:
    """The same marks kept by XZ planes."""
    marks = selections(spark, d).select("volume_id", F.col("b").alias("fixed"), "a", F.col("fixed").alias("b"), "value")
    return lab.apply_selection(voxels(spark, d), marks, "XZ").select("volume_id", "x", "y", "z", "gray", "label")


@query(WITH + "SELECT v.volume_id, v.x AS a, v.y AS b, 2 AS value FROM v LEFT JOIN sel s ON v.x = s.x AND v.y = s.y AND v.z = s.z WHERE v.z = 1 AND s.x IS NULL")
def g07_invert_selection(spark: S, d: str) -> D:
    places = voxels(spark, d).where("z = 1").select("volume_id", F.col("x").alias("a"), F.col("y").alias("b"))
    return lab.invert_selection(selections(spark, d).where("fixed = 1").select("volume_id", "a", "b", "value"), places, 2)


@query(WITH + JOINED.format("CASE WHEN s.value IS NOT NULL AND v.label = 1 THEN 3 ELSE v.label END"))
def g08_move_selected(spark: S, d: str) -> D:
    return lab.move_selected(voxels(spark, d), selections(spark, d), 1, 3).select("volume_id", "x", "y", "z", "gray", "label")


@query(WITH + ALL.format("CASE WHEN label = 2 AND gray BETWEEN 100 AND 120 THEN 3 WHEN label = 0 AND gray BETWEEN 160 AND 180 THEN 1 ELSE label END"))
def g09_move_by_threshold(spark: S, d: str) -> D:
    return lab.move_by_threshold(lab.move_by_threshold(voxels(spark, d), 2, 3, 100, 120), 0, 1, 160, 180)


@query(WITH + ALL.format("CASE WHEN label = 3 AND gray BETWEEN 64 AND 210 THEN 2 ELSE label END"))
def g10_move_by_own_range(spark: S, d: str) -> D:
    """Material 3's voxels in the range of material 2, which is widened to 210 here, move there."""
    wide = materials(spark).withColumn("max", F.when(F.col("id") == 2, 210).otherwise(F.col("max")))
    return lab.move_by_own_range(voxels(spark, d), wide, 3, 2).select("volume_id", "x", "y", "z", "gray", "label")


@query(WITH + "SELECT label AS id, count(*) AS n FROM (SELECT CASE WHEN label = 3 THEN 2 WHEN label = 1 THEN 0 ELSE label END AS label FROM v) GROUP BY label")
def g12_merge_and_remove(spark: S, d: str) -> D:
    """G11, G12 and G13; materials that are gone have no row."""
    v, m = lab.merge_materials(voxels(spark, d), materials(spark), 2, 3)
    v, m = lab.remove_material(v, m, 1)
    return v.groupBy(F.col("label").alias("id")).agg(F.count("*").alias("n")).join(m.select("id"), "id", "left_semi")


@query(WITH + "SELECT (SELECT min(i) FROM range(1, 255) r(i) WHERE i NOT IN (SELECT DISTINCT label FROM v)) AS next_id")
def g14_next_free_id(spark: S, d: str) -> D:
    return lab.next_free_id(voxels(spark, d).select(F.col("label").alias("id")))


@query(WITH + ", t AS (SELECT volume_id, x, y, z, CASE WHEN gray >= 128 THEN 1 ELSE 0 END AS high, CASE WHEN gray < 128 THEN 1 ELSE 0 END AS low FROM v) SELECT * FROM t")
def g16_binarize(spark: S, d: str) -> D:
    v = voxels(spark, d)
    b = lab.binarize(v, 128).withColumnRenamed("label", "high")
    return lab.binarize(b, 128, True).select("volume_id", "x", "y", "z", "high", F.col("label").alias("low"))


@query(WITH + ALL.format("CASE label WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 0 END"))
def g17_extract_materials(spark: S, d: str) -> D:
    return lab.extract_materials(voxels(spark, d), [3, 1])


@query(WITH + ", k AS (SELECT volume_id, x, y, z, lead(z) OVER (PARTITION BY volume_id, x, y ORDER BY z) AS n FROM v WHERE gray < 20) SELECT volume_id, x, y, unnest(range(z, coalesce(n, z + 1))) AS z FROM k")
def g19_fill_between(spark: S, d: str) -> D:
    return lab.fill_between(voxels(spark, d).where("gray < 20"))


@query(WITH + ", o AS (SELECT a, b, c FROM range(-2, 3) p(a), range(-2, 3) q(b), range(-2, 3) r(c) WHERE a * a + b * b + c * c <= 4) SELECT DISTINCT volume_id, x + a AS x, y + b AS y, z + c AS z FROM v, o, dim WHERE gray < 12 AND x + a BETWEEN 0 AND w - 1 AND y + b BETWEEN 0 AND h - 1 AND z + c BETWEEN 0 AND d - 1")
def g21_dilate(spark: S, d: str) -> D:
    return lab.dilate(voxels(spark, d).where("gray < 12"), 2, dims(spark, d))


@query(WITH + ", o AS (SELECT a, b, c, 1.0 / (1 + a * a + b * b + c * c) AS wt FROM range(-1, 2) p(a), range(-1, 2) q(b), range(-1, 2) r(c)), s AS (SELECT v.volume_id, v.x, v.y, v.z, sum(CASE WHEN n.label = 2 THEN wt ELSE 0 END) / sum(wt) AS share FROM v, o, v n WHERE n.x = v.x + a AND n.y = v.y + b AND n.z = v.z + c GROUP BY ALL) SELECT volume_id, x, y, z FROM s WHERE share >= 0.4 - 1e-12")
def g22_smooth_mask(spark: S, d: str) -> D:
    return lab.smooth_mask(voxels(spark, d).where("label = 2"), 3, 0.4, dims(spark, d))


@query(f"WITH {VOX}, {MAPS}, c AS (SELECT x, y, value, count(*) AS n, min(map_id) AS f FROM maps GROUP BY ALL), j AS (SELECT x, y, value, row_number() OVER (PARTITION BY x, y ORDER BY n DESC, f) AS r FROM c), q AS (SELECT x, y, CAST(floor(sum(value * (CASE map_id WHEN 1 THEN 1.0 WHEN 2 THEN 2.0 ELSE 0.5 END)) / 3.5 + 1e-9) AS BIGINT) AS weighted, CAST(floor(255.0 * avg(CASE WHEN value = 2 THEN 1.0 ELSE 0.0 END) + 1e-9) AS BIGINT) AS frequency FROM maps GROUP BY x, y) SELECT j.x, j.y, j.value AS majority, weighted, frequency FROM j JOIN q ON j.x = q.x AND j.y = q.y WHERE r = 1")
def g27_mask_fusion(spark: S, d: str) -> D:
    """G27, G28 and G29."""
    m = label_maps(spark, d)
    votes = lab.majority_vote(m).withColumnRenamed("value", "majority")
    weighted = lab.weighted_average(m, {1: 1.0, 2: 2.0, 3: 0.5}).withColumnRenamed("value", "weighted")
    return votes.join(weighted, ["x", "y"]).join(lab.frequency_map(m, 2).withColumnRenamed("value", "frequency"), ["x", "y"])


@query(f"WITH {VOX}, {BOXES} SELECT v.volume_id, v.x, v.y, v.z, v.gray, CASE WHEN EXISTS (SELECT 1 FROM boxes b WHERE b.selected AND b.score >= 1000 AND b.slice = v.z AND v.x >= b.x AND v.x < b.x + b.w AND v.y >= b.y AND v.y < b.y + b.h) THEN 3 ELSE v.label END AS label FROM v")
def g32_label_boxes(spark: S, d: str) -> D:
    return lab.label_boxes(voxels(spark, d), boxes(spark, d), 3, 1000.0).select("volume_id", "x", "y", "z", "gray", "label")


@query()
def g31_suppress_boxes(spark: S, d: str) -> D:
    """Greedy in score order: held against a brute-force version in the tests."""
    return lab.suppress_boxes(boxes(spark, d))


@query(f"WITH {BOXES} SELECT DISTINCT det_id, 'centre' AS kind, CAST(floor(x + w / 2) AS BIGINT) AS px, CAST(floor(y + h / 2) AS BIGINT) AS py FROM boxes UNION ALL SELECT DISTINCT det_id, 'corner', x + i * w, y + j * h FROM boxes, range(2) a(i), range(2) b(j) UNION ALL SELECT DISTINCT det_id, 'outline', px, py FROM (SELECT det_id, x AS px, y + j * h AS py FROM boxes, range(2) a(j) UNION ALL SELECT det_id, x + 5, y + j * h FROM boxes, range(2) a(j) WHERE w >= 5 UNION ALL SELECT det_id, x + i * w, y FROM boxes, range(2) a(i) UNION ALL SELECT det_id, x + i * w, y + 5 FROM boxes, range(2) a(i) WHERE h >= 5)")
def g33_box_points(spark: S, d: str) -> D:
    return lab.box_points(boxes(spark, d))


@query(f"WITH {BOXES} SELECT det_id, 'grid' AS kind, round(x + w * i / CAST(4 AS DOUBLE), 6) AS px, round(y + h * j / CAST(4 AS DOUBLE), 6) AS py, 5 - greatest(abs(i - 2), abs(j - 2)) AS weight FROM boxes, range(5) a(i), range(5) b(j) UNION ALL SELECT det_id, 'fill', x + i * 4.0, y + j * 4.0, 1 FROM boxes, range(2) a(i), range(2) b(j) WHERE i * 4 <= w AND j * 4 <= h")
def g33_weighted_points(spark: S, d: str) -> D:
    return lab.weighted_points(boxes(spark, d))


@query(WITH + ", n AS (SELECT gray, count(*) AS n FROM v GROUP BY gray) SELECT i AS gray, coalesce(n, 0) AS n FROM range(256) r(i) LEFT JOIN n ON n.gray = i")
def a02_histogram(spark: S, d: str) -> D:
    return stats.histogram(voxels(spark, d))


@query(WITH + ", k AS (SELECT i AS t, (SELECT count(*) FROM v WHERE gray <= i) AS wb, (SELECT count(*) FROM v WHERE gray > i) AS wf, (SELECT avg(gray) FROM v WHERE gray <= i) AS mb, (SELECT avg(gray) FROM v WHERE gray > i) AS mf FROM range(256) r(i)) SELECT t AS threshold FROM k WHERE wb > 0 AND wf > 0 ORDER BY round(CAST(wb AS DOUBLE) * wf * (mb - mf) * (mb - mf), 3) DESC, t LIMIT 1")
def a03_otsu(spark: S, d: str) -> D:
    return stats.otsu_threshold(voxels(spark, d))


@query(WITH + "SELECT round(coalesce((SELECT avg(gray) FROM v WHERE z = 1 AND x BETWEEN 2 AND 9 AND y BETWEEN 3 AND 11), 128), 6) AS mean_gray")
def a04_region_mean(spark: S, d: str) -> D:
    return stats.region_mean(voxels(spark, d), 1, (2, 3), (10, 12))


@query(WITH + "SELECT label, min(gray) AS min_gray, max(gray) AS max_gray, round(avg(gray), 6) AS mean_gray, count(*) AS n FROM v GROUP BY label")
def a06_gray_by_material(spark: S, d: str) -> D:
    """A05, A06 and A36."""
    return stats.gray_statistics(voxels(spark, d), "label")


LINKS = ", k AS (SELECT (z * 25 + y) * 25 + x AS i, x, y, z FROM v WHERE label = 1), e AS (SELECT a.i AS a, b.i AS b FROM k a JOIN k b ON abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.z = a.z UNION ALL SELECT a.i, b.i FROM k a JOIN k b ON a.x = b.x AND a.y = b.y AND b.z = a.z + 1 UNION ALL SELECT a.i, b.i FROM k a JOIN k b ON a.x = b.x AND a.y = b.y AND b.z = a.z - 1), r(i, root) AS (SELECT i, i FROM k UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.i WHERE r.root < e.b), c AS (SELECT i, min(root) AS component FROM r GROUP BY i)"


@query(WITH + LINKS + " SELECT 1 AS volume_id, k.x, k.y, k.z, 1 AS label, component FROM c JOIN k ON k.i = c.i")
def c02_components(spark: S, d: str) -> D:
    """Labels within chunks of 16, merged over their faces."""
    return comp.label_components(voxels(spark, d).where("label = 1"), dims(spark, d), chunk=16)


@query(WITH + LINKS + " SELECT 1 AS volume_id, component, count(*) AS voxel_count, round(count(*) * 1.0, 6) AS volume_um3, round(count(*) * 1e-9, 6) AS volume_mm3, CAST(sum(x) // count(*) AS BIGINT) AS center_x, CAST(sum(y) // count(*) AS BIGINT) AS center_y, CAST(sum(z) // count(*) AS BIGINT) AS center_z, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM c JOIN k ON k.i = c.i GROUP BY component HAVING count(*) >= 20")
def a08_particles(spark: S, d: str) -> D:
    """Particles of at least 20 voxels, measured."""
    found = comp.separate_particles(voxels(spark, d), 1, dims(spark, d), conservative=True)
    return stats.flat_particles(stats.particles(found, PIXEL))


FLAT = ", k AS (SELECT (z * 25 + y) * 25 + x AS i, x, y, z FROM v WHERE label = 1), e AS (SELECT a.i AS a, b.i AS b FROM k a JOIN k b ON a.z = b.z AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND a.i <> b.i), r(i, root) AS (SELECT i, i FROM k UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.i WHERE r.root < e.b), c AS (SELECT i, min(root) AS component FROM r GROUP BY i)"


@query(WITH + FLAT + " SELECT 1 AS volume_id, component, count(*) AS voxel_count, round(count(*) * 1.0, 6) AS volume_um3, round(count(*) * 1e-9, 6) AS volume_mm3, CAST(sum(x) // count(*) AS BIGINT) AS center_x, CAST(sum(y) // count(*) AS BIGINT) AS center_y, CAST(sum(z) // count(*) AS BIGINT) AS center_z, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM c JOIN k ON k.i = c.i GROUP BY component HAVING count(*) >= 10")
def a07_particles_2d(spark: S, d: str) -> D:
    """8-connected particles by slice, of at least 10 pixels."""
    found = comp.separate_particles(voxels(spark, d), 1, dims(spark, d), flat=True, conservative=True, chunk=16)
    return stats.flat_particles(stats.particles(found, PIXEL))


@query(WITH + "SELECT volume_id, x, y, z, CASE WHEN x BETWEEN 4 AND 21 AND label = 1 AND x BETWEEN 5 AND 20 AND gray % 2 = 0 THEN 255 ELSE gray END AS gray FROM v")
def p10_written_back(spark: S, d: str) -> D:
    """P10: even grays of a cropped material are brightened in the sub-volume and go back to their places."""
    v = voxels(spark, d)
    inner = lab.relabel(v, (F.col("label") == 1) & ~F.col("x").between(5, 20), 0)
    sub = vox.sub_volume(inner, vox.material_bounds(inner, dims(spark, d)), 1)
    sub = sub.withColumn("gray", F.when((F.col("label") == 1) & (F.col("gray") % 2 == 0), 255).otherwise(F.col("gray")))
    return vox.write_back(v, sub, "gray").select("volume_id", "x", "y", "z", "gray")


@query(WITH + LINKS + ", s AS (SELECT component FROM c GROUP BY component HAVING count(*) < 10), t AS (SELECT i FROM c JOIN s USING (component)) SELECT volume_id, x, y, z, gray, CASE WHEN t.i IS NULL THEN label ELSE 0 END AS label FROM v LEFT JOIN t ON t.i = (v.z * 25 + v.y) * 25 + v.x")
def c05_remove_islands(spark: S, d: str) -> D:
    return comp.remove_islands(voxels(spark, d), dims(spark, d), 10, material=1).select("volume_id", "x", "y", "z", "gray", "label")


FACES = ", o AS (SELECT * FROM (VALUES ('-x', -1, 0, 0), ('+x', 1, 0, 0), ('-y', 0, -1, 0), ('+y', 0, 1, 0), ('-z', 0, 0, -1), ('+z', 0, 0, 1)) t(direction, a, b, c))"


@query(WITH + FACES + " SELECT v.volume_id, direction, count(*) AS faces FROM v, o WHERE label = 2 AND NOT EXISTS (SELECT 1 FROM v n WHERE n.label = 2 AND n.x = v.x + a AND n.y = v.y + b AND n.z = v.z + c) GROUP BY ALL")
def c19_surface_faces(spark: S, d: str) -> D:
    """J19 and C19."""
    return comp.exposed_faces(voxels(spark, d), 2).groupBy("volume_id", "direction").agg(F.count("*").alias("faces"))


@query(WITH + FACES + ", q AS (SELECT v.volume_id, v.label, max(CASE WHEN n.label <> v.label THEN 1 ELSE 0 END) AS edge FROM v, o, v n WHERE n.x = v.x + a AND n.y = v.y + b AND n.z = v.z + c GROUP BY v.volume_id, v.label, v.x, v.y, v.z) SELECT volume_id, label, round(sum(edge) * 1.5, 6) AS area_um2 FROM q GROUP BY ALL")
def a10_surface_area(spark: S, d: str) -> D:
    return stats.surface_area(voxels(spark, d), PIXEL * 1e6, dims(spark, d), "label").withColumnRenamed("area", "area_um2")


@query(WITH + FACES + " SELECT v.volume_id, v.x, v.y, v.z, v.label, round(avg(CASE WHEN n.label = v.label THEN 1.0 ELSE 0.0 END), 6) AS connectivity FROM v, o, v n WHERE n.x = v.x + a AND n.y = v.y + b AND n.z = v.z + c GROUP BY v.volume_id, v.label, v.x, v.y, v.z")
def a22_local_connectivity(spark: S, d: str) -> D:
    """J04 and A22."""
    return stats.local_connectivity(voxels(spark, d), dims(spark, d))


@query(WITH + ", o AS (SELECT a, b, c, sqrt(a * a + b * b + c * c) AS dist FROM range(-5, 6) p(a), range(-5, 6) q(b), range(-5, 6) r(c) WHERE a <> 0 OR b <> 0 OR c <> 0) SELECT v.volume_id, v.x, v.y, v.z, v.label, round(coalesce(min(CASE WHEN n.label <> v.label THEN dist END), 0), 6) AS pore_size FROM v CROSS JOIN o LEFT JOIN v n ON n.x = v.x + a AND n.y = v.y + b AND n.z = v.z + c WHERE v.label <> 0 GROUP BY v.volume_id, v.label, v.x, v.y, v.z")
def a23_local_pore_size(spark: S, d: str) -> D:
    return stats.local_pore_size(voxels(spark, d), 5, 1.0, dims(spark, d), 16)


@query(WITH + "SELECT volume_id, x AS a, y AS b, round(greatest(var_pop(gray / 255.0), 1e-6), 6) AS variance FROM v WHERE z BETWEEN 0 AND 9 GROUP BY ALL")
def a20_variance_map(spark: S, d: str) -> D:
    return stats.variance_map(voxels(spark, d), "XY", 0, 9)


@query(WITH + ", s AS (SELECT volume_id, z, min(gray) AS lo, max(gray) AS hi FROM v GROUP BY ALL), t AS (SELECT v.volume_id, v.z, v.y, CAST(floor((gray - lo) * 255 / (hi - lo)) AS BIGINT) AS g FROM v JOIN s ON v.z = s.z) SELECT volume_id, z, y, CAST(sum(g) AS BIGINT) AS v FROM t GROUP BY ALL")
def a19_stretched_profile(spark: S, d: str) -> D:
    """A18 and A19."""
    return stats.row_profile(stats.stretch(voxels(spark, d)))


GLCM = ", p AS (SELECT a.volume_id, a.z, a.gray AS i, b.gray AS j, count(*) AS n FROM v a JOIN v b ON b.x = a.x + 1 AND b.y = a.y AND b.z = a.z GROUP BY ALL), q AS (SELECT volume_id, z, i, j, CAST(floor(n * 1000000 / sum(n) OVER (PARTITION BY z)) AS BIGINT) AS ppm FROM p)"


@query(WITH + GLCM + " SELECT * FROM q")
def a28_glcm(spark: S, d: str) -> D:
    return stats.glcm(voxels(spark, d), 1, 0)


@query(WITH + GLCM + ", f AS (SELECT volume_id, z, sum(ppm / 1e6 * (i - j) * (i - j)) AS contrast, sum(ppm / 1e6 * abs(i - j)) AS dissimilarity, sum(ppm / 1e6 / (1 + (i - j) * (i - j))) AS homogeneity, sum(ppm / 1e6 * ppm / 1e6) AS energy, sum(ppm / 1e6 * i) AS mi, sum(ppm / 1e6 * j) AS mj, sum(ppm / 1e6 * i * i) AS ii, sum(ppm / 1e6 * j * j) AS jj, sum(ppm / 1e6 * i * j) AS ij FROM q GROUP BY ALL) SELECT volume_id, z, round(contrast, 6) AS contrast, round(dissimilarity, 6) AS dissimilarity, round(homogeneity, 6) AS homogeneity, round(energy, 6) AS energy, round((ij - mi * mj) / (sqrt(ii - mi * mi) * sqrt(jj - mj * mj)), 6) AS correlation FROM f")
def a29_glcm_features(spark: S, d: str) -> D:
    return stats.glcm_features(stats.glcm(voxels(spark, d), 1, 0))


@query(WITH + ", o AS (SELECT * FROM (VALUES (-1, -1, 1), (0, -1, 2), (1, -1, 4), (1, 0, 8), (1, 1, 16), (0, 1, 32), (-1, 1, 64), (-1, 0, 128)) t(a, b, bit)), k AS (SELECT v.volume_id, v.z, v.x, v.y, count(*) AS n, CAST(sum(CASE WHEN n.gray >= v.gray THEN bit ELSE 0 END) AS BIGINT) AS code FROM v, o, v n WHERE n.z = v.z AND n.x = v.x + a AND n.y = v.y + b GROUP BY ALL), t AS (SELECT volume_id, z, code, count(*) AS c FROM k WHERE n = 8 GROUP BY ALL) SELECT volume_id, z, code, round(c / sum(c) OVER (PARTITION BY z), 6) AS share FROM t")
def a30_lbp_histogram(spark: S, d: str) -> D:
    return stats.lbp_histogram(voxels(spark, d))


@query(WITH + ", t AS (SELECT volume_id, z, gray, count(*) AS n FROM v GROUP BY ALL), p AS (SELECT volume_id, z, gray, n / sum(n) OVER (PARTITION BY z) AS p, sum(gray * n) OVER (PARTITION BY z) / sum(n) OVER (PARTITION BY z) AS mean FROM t), f AS (SELECT volume_id, z, mean, sum(p * pow(gray - mean, 2)) AS m2, sum(p * pow(gray - mean, 3)) AS m3, sum(p * pow(gray - mean, 4)) AS m4, sum(p * p) AS energy, -sum(p * log2(p)) AS entropy FROM p GROUP BY volume_id, z, mean) SELECT volume_id, z, round(mean, 6) AS mean, round(sqrt(m2), 6) AS deviation, round(m3 / pow(sqrt(m2), 3), 6) AS skewness, round(m4 / (m2 * m2) - 3, 6) AS kurtosis, round(energy, 6) AS energy, round(entropy, 6) AS entropy FROM f")
def a31_histogram_moments(spark: S, d: str) -> D:
    return stats.histogram_moments(voxels(spark, d))


CUBE = ", o AS (SELECT a, b, c FROM range(-1, 2) p(a), range(-1, 2) q(b), range(-1, 2) r(c)), near AS (SELECT v.volume_id, v.x, v.y, v.z, v.gray AS own, a, b, c, n.gray FROM v, o, dim, v n WHERE n.x = least(greatest(v.x + a, 0), w - 1) AND n.y = least(greatest(v.y + b, 0), h - 1) AND n.z = least(greatest(v.z + c, 0), d - 1))"


@query(WITH + CUBE + " SELECT volume_id, x, y, z, greatest(0, least(255, floor(sum(gray * exp(-(a * a + b * b + c * c) / 2.0)) / sum(exp(-(a * a + b * b + c * c) / 2.0)) + 0.5 + 1e-9))) AS value FROM near GROUP BY ALL")
def n02_gaussian_3d(spark: S, d: str) -> D:
    return stencil.gaussian_3d(voxels(spark, d), 3, 1.0, dims(spark, d), 16)


@query(WITH + CUBE + ", r AS (SELECT volume_id, x, y, z, gray, row_number() OVER (PARTITION BY volume_id, x, y, z ORDER BY gray) AS i FROM near) SELECT volume_id, x, y, z, CAST(gray AS DOUBLE) AS value FROM r WHERE i = 14")
def n05_median_3d(spark: S, d: str) -> D:
    return stencil.median(voxels(spark, d), 3, dims(spark, d), 16)


@query(WITH + CUBE + ", r AS (SELECT volume_id, x, y, z, gray, row_number() OVER (PARTITION BY volume_id, x, y, z ORDER BY gray) AS i FROM near WHERE c = 0) SELECT volume_id, x, y, z, CAST(gray AS DOUBLE) AS value FROM r WHERE i = 5")
def n04_median_2d(spark: S, d: str) -> D:
    return stencil.median(voxels(spark, d), 3, dims(spark, d), 16, flat=True)


@query(WITH + CUBE + " SELECT volume_id, x, y, z, floor(avg(gray) + 1e-9) AS value FROM near WHERE c = 0 GROUP BY ALL")
def n03_box_mean(spark: S, d: str) -> D:
    return stencil.box_mean_2d(voxels(spark, d), 3, dims(spark, d), 16)


@query(WITH + CUBE + ", e AS (SELECT volume_id, x, y, z, gray, exp(-(a * a + b * b + c * c) / 18.0 - (gray - own) * (gray - own) / 1250.0) AS wt FROM near) SELECT volume_id, x, y, z, greatest(0, least(255, floor(sum(wt * gray) / sum(wt) + 1e-9))) AS value FROM e GROUP BY ALL")
def n07_bilateral_3d(spark: S, d: str) -> D:
    return stencil.bilateral(voxels(spark, d), 3, 3.0, 25.0, dims(spark, d), 16)


@query(WITH + CUBE + ", e AS (SELECT volume_id, x, y, z, gray, exp(-(a * a + b * b) / 4.5 - (gray - own) * (gray - own) / 1800.0) AS wt FROM near WHERE c = 0) SELECT volume_id, x, y, z, greatest(0, least(255, floor(sum(wt * gray) / sum(wt) + 0.5 + 1e-9))) AS value FROM e GROUP BY ALL")
def n06_bilateral_2d(spark: S, d: str) -> D:
    return stencil.bilateral(voxels(spark, d), 3, 1.5, 30.0, dims(spark, d), 16, flat=True, rounded=True)


@query(WITH + CUBE + ", s AS (SELECT volume_id, x, y, z, any_value(own) AS own, greatest(0, least(255, floor(sum(gray * exp(-(a * a + b * b + c * c) / 2.0)) / sum(exp(-(a * a + b * b + c * c) / 2.0)) + 0.5 + 1e-9))) AS g FROM near GROUP BY volume_id, x, y, z) SELECT volume_id, x, y, z, greatest(0, least(255, floor(own + 1.5 * (own - g) + 1e-9))) AS value FROM s")
def n08_unsharp_3d(spark: S, d: str) -> D:
    return stencil.unsharp(voxels(spark, d), 3, 1.5, 1.0, dims(spark, d), 16)


@query(WITH + CUBE + ", s AS (SELECT volume_id, x, y, z, sum(CASE WHEN b = 0 THEN 2 ELSE 1 END * a * gray) AS gx, sum(CASE WHEN a = 0 THEN 2 ELSE 1 END * b * gray) AS gy FROM near WHERE c = 0 GROUP BY ALL) SELECT volume_id, x, y, z, CASE WHEN x BETWEEN 1 AND w - 2 AND y BETWEEN 1 AND h - 2 THEN least(255, floor(sqrt(gx * gx + gy * gy))) ELSE 0 END AS value FROM s, dim")
def n09_sobel_2d(spark: S, d: str) -> D:
    return stencil.sobel_2d(voxels(spark, d), dims(spark, d), 16)


@query(WITH + CUBE + ", s AS (SELECT volume_id, x, y, z, sum(CASE WHEN b = 0 THEN 2 ELSE 1 END * a * gray) AS gx, sum(CASE WHEN a = 0 THEN 2 ELSE 1 END * b * gray) AS gy, sum(CASE WHEN a = 0 AND b = 0 THEN 2 ELSE 1 END * c * gray) AS gz FROM near GROUP BY ALL), t AS (SELECT s.*, CASE WHEN x BETWEEN 1 AND w - 2 AND y BETWEEN 1 AND h - 2 AND z BETWEEN 1 AND d - 2 THEN sqrt(gx * gx + gy * gy + gz * gz) ELSE 0 END AS mag FROM s, dim) SELECT volume_id, x, y, z, floor(mag * 255 / (SELECT max(mag) FROM t) + 1e-9) AS value FROM t")
def n10_sobel_3d(spark: S, d: str) -> D:
    return stencil.sobel_3d(voxels(spark, d), dims(spark, d), 16)


@query(WITH + ", o AS (SELECT a, exp(-a * a / 8.0) AS wt FROM range(-6, 7) p(a)) SELECT v.volume_id, v.x, v.y, v.z, round(sum(n.gray * wt) / sum(wt), 6) AS value FROM v, o, v n WHERE n.x = v.x + a AND n.y = v.y AND n.z = v.z GROUP BY v.volume_id, v.x, v.y, v.z")
def n14_row_gaussian(spark: S, d: str) -> D:
    """A window along each row."""
    return stencil.row_gaussian(voxels(spark, d), 2.0)


@query()
def n12_non_local_means(spark: S, d: str) -> D:
    """Held against a plain numpy version in the tests."""
    return stencil.non_local_means(voxels(spark, d), 1, 2, 30.0, dims(spark, d), 32)


@query()
def n13_white_top_hat(spark: S, d: str) -> D:
    return stencil.white_top_hat(voxels(spark, d), 2, dims(spark, d), 16)


def _pass(table: str, source: str, axis: str, n: str) -> str:
    """A CTE of one pass of five weights along an axis, edges repeated, rounded to bytes."""
    others = [a for a in "xyz" if a != axis]
    return f"{table} AS (SELECT s.volume_id, s.x, s.y, s.z, greatest(0, least(255, floor(sum(t.gray * exp(-k * k / 2.88)) / sum(exp(-k * k / 2.88)) + 0.5 + 1e-9))) AS gray FROM {source} s, range(-2, 3) q(k), dim, {source} t WHERE t.{axis} = least(greatest(s.{axis} + k, 0), {n} - 1) AND t.{others[0]} = s.{others[0]} AND t.{others[1]} = s.{others[1]} GROUP BY s.volume_id, s.x, s.y, s.z)"


@query(WITH + f", {_pass('p1', 'v', 'x', 'w')}, {_pass('p2', 'p1', 'y', 'h')} SELECT volume_id, x, y, z, gray AS value FROM p2")
def n01_gaussian_2d(spark: S, d: str) -> D:
    return stencil.gaussian_2d(voxels(spark, d), 5, 1.2, dims(spark, d), 16)


@query(WITH + ", r AS (SELECT volume_id, z, y, sum(gray) AS s FROM v GROUP BY ALL), t AS (SELECT *, max(s) OVER (PARTITION BY z) AS top FROM r) SELECT volume_id, z, min(CASE WHEN s > 0.9 * top THEN y END) AS row FROM t GROUP BY ALL")
def n15_air_crop_row(spark: S, d: str) -> D:
    return stencil.air_crop_row(voxels(spark, d), 0.9)


@query(WITH + "SELECT volume_id, x // 2 AS x, y // 2 AS y, z // 2 AS z, CAST(sum(gray) // count(*) AS BIGINT) AS gray, 0 AS label FROM v, dim WHERE x // 2 < w // 2 AND y // 2 < h // 2 AND z // 2 < d // 2 GROUP BY ALL")
def r01_bin_volume(spark: S, d: str) -> D:
    return resample.bin_volume(voxels(spark, d), 2, dims(spark, d))


@query(WITH + ", f AS (SELECT volume_id, x // 2 AS x, y // 2 AS y, z, sum(gray) // count(*) AS g FROM v, dim WHERE x // 2 < w // 2 AND y // 2 < h // 2 GROUP BY ALL) SELECT volume_id, x, y, z // 2 AS z, CAST(sum(g) // count(*) AS BIGINT) AS gray FROM f, dim WHERE z // 2 < d // 2 GROUP BY ALL")
def r02_bin_slices(spark: S, d: str) -> D:
    return resample.bin_slices(voxels(spark, d), 2, dims(spark, d))


@query(WITH + ", n AS (SELECT w, h, d, CAST(floor(w * 1.4) AS BIGINT) AS ow, CAST(floor(h * 1.4) AS BIGINT) AS oh, CAST(floor(d * 1.4) AS BIGINT) AS od FROM dim), t AS (SELECT i AS x, j AS y, k AS z, i * CAST(w - 1 AS DOUBLE) / (ow - 1) AS sx, j * CAST(h - 1 AS DOUBLE) / (oh - 1) AS sy, k * CAST(d - 1 AS DOUBLE) / (od - 1) AS sz, w, h, d FROM n, range(0, (SELECT ow FROM n)) a(i), range(0, (SELECT oh FROM n)) b(j), range(0, (SELECT od FROM n)) c(k)), e AS (SELECT t.x, t.y, t.z, (CASE WHEN a = 1 THEN sx - floor(sx) ELSE 1 - sx + floor(sx) END) * (CASE WHEN b = 1 THEN sy - floor(sy) ELSE 1 - sy + floor(sy) END) * (CASE WHEN c = 1 THEN sz - floor(sz) ELSE 1 - sz + floor(sz) END) AS wt, v.gray FROM t, range(2) p(a), range(2) q(b), range(2) r(c), v WHERE v.x = least(floor(sx) + a, w - 1) AND v.y = least(floor(sy) + b, h - 1) AND v.z = least(floor(sz) + c, d - 1)) SELECT 1 AS volume_id, x, y, z, CAST(round_even(round(sum(wt * gray), 9), 0) AS BIGINT) AS gray FROM e GROUP BY x, y, z")
def r03_resample_gray(spark: S, d: str) -> D:
    return resample.resample_gray(voxels(spark, d), 1.4, dims(spark, d))


@query(WITH + ", n AS (SELECT w, h, d, CAST(floor(w * 1.4) AS BIGINT) AS ow, CAST(floor(h * 1.4) AS BIGINT) AS oh, CAST(floor(d * 1.4) AS BIGINT) AS od FROM dim) SELECT 1 AS volume_id, i AS x, j AS y, k AS z, label FROM n, range(0, (SELECT ow FROM n)) a(i), range(0, (SELECT oh FROM n)) b(j), range(0, (SELECT od FROM n)) c(k), v WHERE v.x = least(floor(i / CAST(1.4 AS DOUBLE)), w - 1) AND v.y = least(floor(j / CAST(1.4 AS DOUBLE)), h - 1) AND v.z = least(floor(k / CAST(1.4 AS DOUBLE)), d - 1)")
def r04_resample_labels(spark: S, d: str) -> D:
    return resample.resample_labels(voxels(spark, d), 1.4, dims(spark, d))


@query()
def r06_transform(spark: S, d: str) -> D:
    """R06 to R09; held against a plain numpy version in the tests."""
    n = dims(spark, d)
    m = resample.matrix((1.0, 1.0, 1.0), (0.1, 0.2, 0.3), (0.5, 0.0, -0.5))
    out = resample.output_dims(n, (1.0, 1.0, 1.0), m, True)
    return resample.transform(voxels(spark, d), m, out, n)


@query(WITH + ", r AS (SELECT *, z // 16 AS slab, row_number() OVER (PARTITION BY z // 16 ORDER BY z, y, x) - 1 AS i FROM v), q AS (SELECT *, i - row_number() OVER (PARTITION BY slab, label ORDER BY i) AS k FROM r) SELECT volume_id, slab, label AS value, min(i) AS start, count(*) AS length FROM q GROUP BY volume_id, slab, label, k")
def w08_run_lengths(spark: S, d: str) -> D:
    return series.run_lengths(voxels(spark, d))


@query(WITH + ", r AS (SELECT *, z // 16 AS slab, row_number() OVER (PARTITION BY z // 16 ORDER BY z, y, x) - 1 AS i FROM v) SELECT volume_id, slab, i, label AS value FROM r")
def w08_run_length_round_trip(spark: S, d: str) -> D:
    return series.from_run_lengths(series.run_lengths(voxels(spark, d)))


@query(WITH + "SELECT volume_id, x, y, z, gray, label FROM v")
def s10_chunk_round_trip(spark: S, d: str) -> D:
    n = dims(spark, d)
    both = vox.from_chunks(vox.to_chunks(voxels(spark, d), n, 16), n)
    return both.join(grays(spark, d).select("volume_id", "x", "y", "z"), ["volume_id", "x", "y", "z"], "left_semi")


@query(WITH + "SELECT 'volume' AS layout, x, y, z, gray AS value FROM v UNION ALL SELECT 'labels', x, y, z, CASE WHEN x < 25 AND y < 25 AND z < d THEN coalesce(label, 0) ELSE 0 END FROM dim, (SELECT a AS x, b AS y, c AS z FROM range(32) p(a), range(32) q(b), range(0, (SELECT ((d + 15) // 16) * 16 FROM dim)) r(c)) LEFT JOIN (SELECT x, y, z, label FROM v) USING (x, y, z) UNION ALL SELECT 'combined gray', x, y, z, gray FROM v UNION ALL SELECT 'combined labels', x, y, z, label FROM v UNION ALL SELECT 'material', id, lo, hi, CAST(ext AS BIGINT) FROM m")
def s05_container_round_trip(spark: S, d: str) -> D:
    """The voxels written as a volume, as labels and as a combined file, and read back by ranges of chunks."""
    n, side, folder = dims(spark, d), 16, new_path(spark, "containers")
    chunks = vox.to_chunks(voxels(spark, d), n, side)
    both = {c: chunks.select("cx", "cy", "cz", F.col(c).alias("payload")) for c in ("gray", "label")}
    kinds = [(r["id"], r["name"], r["argb"], r["min"], r["max"], r["is_exterior"]) for r in materials(spark).collect()]
    containers.write_file(f"{folder}/v", "volume", n, PIXEL, side, gray=both["gray"])
    containers.write_file(f"{folder}/l", "labels", n, PIXEL, side, labels=both["label"])
    containers.write_file(f"{folder}/c", "combined", n, PIXEL, side, both["gray"], both["label"], kinds)
    _, found, gray, label = containers.read_combined(spark, f"{folder}/c", side=side)
    parts = {"volume": containers.chunk_voxels(containers.read_chunks(spark, f"{folder}/v", split_bytes=4 * side**3), "value"), "labels": containers.chunk_voxels(containers.read_chunks(spark, f"{folder}/l", "labels", split_bytes=4 * side**3), "value"), "combined gray": gray.withColumnRenamed("gray", "value"), "combined labels": label.withColumnRenamed("label", "value")}
    out = found.select(F.lit("material").alias("layout"), F.col("id").cast("long").alias("x"), F.col("min").cast("long").alias("y"), F.col("max").cast("long").alias("z"), F.col("is_exterior").cast("long").alias("value"))
    for name, part in parts.items():
        out = part.select(F.lit(name).alias("layout"), "x", "y", "z", "value").unionByName(out)
    return out


@query(WITH + "SELECT volume_id, z, 'slice_' || lpad(CAST(z + 3 AS VARCHAR), 5, '0') || '.raw' AS name, 625 AS bytes, sha256(string_agg(chr(CAST(97 + gray % 26 AS INT)), '' ORDER BY y, x)) AS pixels FROM v GROUP BY volume_id, z")
def s13_slice_images(spark: S, d: str) -> D:
    """Names, sizes and hashed pixels of the slices' images; pixels are letters here, which text can hold."""
    letters = voxels(spark, d).withColumn("gray", 97 + F.col("gray") % 26)
    return files.slice_images(letters, 25, 25, digits=5, first=3).select("volume_id", "z", "name", F.octet_length("payload").alias("bytes"), F.sha2("payload", 256).alias("pixels"))


@query(WITH + "SELECT volume_id, x, y, z, label, CASE label WHEN 1 THEN 255 ELSE 0 END AS r, CASE label WHEN 2 THEN 255 ELSE 0 END AS g, CASE label WHEN 3 THEN 255 ELSE 0 END AS b FROM v")
def s12_label_colours(spark: S, d: str) -> D:
    """J02 and S12."""
    return files.label_colours(voxels(spark, d), materials(spark))


@query(WITH + ", c AS (SELECT volume_id, x, y, z, gray // 64 AS r, (gray // 32) % 2 AS gr, 0 AS b FROM v), t AS (SELECT DISTINCT r, gr, b FROM c WHERE r + gr + b > 0), k AS (SELECT *, row_number() OVER (ORDER BY r, gr, b) AS id FROM t) SELECT c.volume_id, c.x, c.y, c.z, 128 AS gray, coalesce(k.id, 0) AS label FROM c LEFT JOIN k ON c.r = k.r AND c.gr = k.gr AND c.b = k.b")
def s08_colours_to_labels(spark: S, d: str) -> D:
    c = grays(spark, d).select("volume_id", "x", "y", "z", F.expr("gray div 64").alias("r"), (F.expr("gray div 32") % 2).alias("g"), F.lit(0).cast("long").alias("b"))
    return files.colours_to_labels(c)[0]


@query(WITH + ", e AS (SELECT volume_id, x, y, z, gray, least(1.0, greatest(0.0, (gray - 20) / CAST(180 AS DOUBLE))) AS t FROM v) SELECT volume_id, x, y, z, CAST(greatest(0, least(255, floor(greatest(0.0, least(1.0, (t - 0.5) * 1.3 + 0.5)) * 255 + 1e-9) + 10)) AS BIGINT) AS gray FROM e")
def f01_brightness_contrast(spark: S, d: str) -> D:
    """F01 and X08."""
    return voxels(spark, d).select("volume_id", "x", "y", "z", fx.adjust(F.col("gray"), 20, 200, 10, 130).alias("gray"))


@query(WITH + "SELECT volume_id, x, y, z, CAST(floor(0.299 * gray + 0.587 * ((gray * 7) % 256) + 0.114 * ((gray * 13) % 256) + 1e-9) AS BIGINT) AS gray, sqrt((gray - 90) * (gray - 90) + ((gray * 7) % 256 - 80) * ((gray * 7) % 256 - 80) + ((gray * 13) % 256 - 70) * ((gray * 13) % 256 - 70)) <= 120 AS pore, 255 - gray AS complement, CAST(floor(gray * 0.75 + label * 0.25 + 1e-9) AS BIGINT) AS blended FROM v")
def s02_thin_section_pixels(spark: S, d: str) -> D:
    """A colour image made from the grays."""
    c = voxels(spark, d).select("volume_id", "x", "y", "z", "label", F.col("gray").alias("r"), ((F.col("gray") * 7) % 256).alias("g"), ((F.col("gray") * 13) % 256).alias("b"))
    return c.select("volume_id", "x", "y", "z", fx.grayscale(F.col("r"), F.col("g"), F.col("b")).alias("gray"), lab.colour_distance_mask((90, 80, 70), 120.0).alias("pore"), fx.complementary(F.col("r")).alias("complement"), fx.blend(F.col("r"), F.col("label"), 0.25).alias("blended"))


@query(WITH + ", a AS (SELECT label, min(gray) AS lo, max(gray) AS hi FROM v GROUP BY label) SELECT volume_id, x, y, z, round(CASE WHEN v.label <> 2 THEN 0 ELSE 2650 * (0.8 + 0.4 * (gray - lo) / CAST(hi - lo AS DOUBLE)) END, 6) AS density FROM v JOIN a ON v.label = a.label")
def x07_density_field(spark: S, d: str) -> D:
    """A06, F21 and X07."""
    v = voxels(spark, d)
    span = stats.gray_statistics(v, "label").select("label", "min_gray", "max_gray")
    density = F.when(F.col("label") == 2, fx.spread_density(F.col("gray"), F.col("min_gray"), F.col("max_gray"), 2650.0)).otherwise(0.0)
    return v.join(F.broadcast(span), "label").select("volume_id", "x", "y", "z", density.alias("density"))


@query(WITH + ", q AS (SELECT volume_id, x, y, z, unnest([(5.0, 2.0, 20.0, 8.0), (20.0, 8.0, 9.0, 21.0), (9.0, 21.0, 5.0, 2.0)]) AS e FROM v) SELECT volume_id, x, y, z, sum(CASE WHEN (e[2] > y) <> (e[4] > y) AND x < e[1] + (y - e[2]) * (e[3] - e[1]) / (e[4] - e[2]) THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM q GROUP BY ALL")
def p18_polygon_mask(spark: S, d: str) -> D:
    return voxels(spark, d).select("volume_id", "x", "y", "z", lab.polygon_mask(None, [(5, 2), (20, 8), (9, 21)]).alias("inside"))
