"""Input tables derived from the given ones: voxels from orders, pores from part, boxes from customer, series from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 25
PIXEL = 1e-6
#: id, name, argb, min, max, is_exterior, density, is_visible
MATERIALS = [(0, "Exterior", 0, 0, 0, True, 0.0, False), (1, "Pore", 0xFF0000, 0, 63, False, 1000.0, True), (2, "Matrix", 0x00FF00, 64, 159, False, 2650.0, True), (3, "Dense", 0x0000FF, 200, 255, False, 4000.0, False)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materials(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MATERIALS, "id long, name string, argb long, min long, max long, is_exterior boolean, density double, is_visible boolean")


def grays(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, g = F.col("o_orderkey"), F.floor("o_totalprice").cast("long") % 256
    return table(spark, sf_dir, "orders").select(F.lit(1).cast("long").alias("volume_id"), (k % SIDE).alias("x"), (F.expr(f"o_orderkey div {SIDE}") % SIDE).alias("y"), F.expr(f"o_orderkey div {SIDE * SIDE}").alias("z"), g.alias("gray"))


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("gray")
    label = F.when(g <= 63, 1).when(g <= 159, 2).when(g >= 200, 3).otherwise(0)
    return grays(spark, sf_dir).withColumn("label", label.cast("long"))


def dims(spark: SparkSession, sf_dir: str) -> tuple[int, int, int]:
    top = table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0] or 0
    return SIDE, SIDE, int(top) // (SIDE * SIDE) + 1


def pores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(k.cast("long").alias("id"), ((k * 7919) % 1000).cast("double").alias("x"), ((k * 104729) % 1000).cast("double").alias("y"), (F.expr("(p_partkey * 1299709) div 7") % 1000).cast("double").alias("z"), F.col("p_size").cast("double").alias("radius"))
    return p.withColumn("volume", 4.0 / 3.0 * F.pi() * F.col("radius") * F.col("radius") * F.col("radius"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.cast("long").alias("det_id"), (k % 24).alias("slice"), (k % 20).alias("x"), (F.expr("c_custkey div 20") % 20).alias("y"), (2 + k % 5).alias("w"), (2 + k % 4).alias("h"), F.col("c_acctbal").cast("double").alias("score"), (k % 2 == 0).alias("selected"))


def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks on XY planes: fixed is z."""
    return grays(spark, sf_dir).where("(x + 2 * y + 3 * z) % 5 = 0").select("volume_id", F.col("z").alias("fixed"), F.col("x").alias("a"), F.col("y").alias("b"), F.lit(2).cast("long").alias("value"))


def label_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three thresholds of all slices, places numbered over the slices by y."""
    g = grays(spark, sf_dir).withColumn("y", F.col("y") + SIDE * F.col("z"))
    t = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("map_id"), F.lit(t).alias("t")) for i, t in ((1, 64), (2, 96), (3, 128))]))
    return g.withColumn("m", t).select("m.map_id", "x", "y", F.when(F.col("gray") >= F.col("m.t"), F.col("m.map_id")).otherwise(0).cast("long").alias("value"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("series_id"), F.row_number().over(w).cast("long").alias("step"), F.col("value").cast("double").alias("v"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("run_id").orderBy("l_orderkey", "l_linenumber", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumn("run_id", F.col("l_orderkey") % 10)
    return rows.select("run_id", F.row_number().over(w).cast("long").alias("step"), (F.col("l_quantity") - 25).cast("double").alias("p_value"), (F.col("l_discount") * 100).cast("double").alias("s_value"))


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by supplier: pressures of nation keys, densities and moduli that follow the balance."""
    s = table(spark, sf_dir, "supplier")
    k, b = F.col("s_suppkey"), F.col("s_acctbal").cast("double")
    return s.select(k.cast("long").alias("id"), (F.col("s_nationkey") % 8).cast("double").alias("pressure_mpa"), (2000 + b / 20).alias("density"), (10000 + 3 * b + (k % 7) * 50).cast("double").alias("youngs"), (0.2 + (k % 11) / 100.0).cast("double").alias("poisson"), (1.5 + (k % 13) / 20.0).cast("double").alias("vp_vs"), (k % 256).cast("double").alias("gray"), (1 + k % 97).cast("double").alias("sim_t2"), (2 + (k % 97) * 3 + k % 5).cast("double").alias("ref_t2"), (1 + k % 31).cast("double").alias("sim_amp"), (3 + (k % 31) * 2 + k % 3).cast("double").alias("ref_amp"))


VOX = """g AS (SELECT CAST(1 AS BIGINT) AS volume_id, CAST(o_orderkey % 25 AS BIGINT) AS x, CAST((o_orderkey // 25) % 25 AS BIGINT) AS y,
  CAST(o_orderkey // 625 AS BIGINT) AS z, CAST(floor(o_totalprice) AS BIGINT) % 256 AS gray FROM orders),
v AS (SELECT *, CAST(CASE WHEN gray <= 63 THEN 1 WHEN gray <= 159 THEN 2 WHEN gray >= 200 THEN 3 ELSE 0 END AS BIGINT) AS label FROM g),
dim AS (SELECT 25 AS w, 25 AS h, max(z) + 1 AS d FROM g),
m AS (SELECT CAST(id AS BIGINT) AS id, name, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, ext, density, vis FROM (VALUES
  (0, 'Exterior', 0, 0, true, 0.0, false), (1, 'Pore', 0, 63, false, 1000.0, true), (2, 'Matrix', 64, 159, false, 2650.0, true), (3, 'Dense', 200, 255, false, 4000.0, false))
  AS t(id, name, lo, hi, ext, density, vis)),
sel AS (SELECT volume_id, x, y, z, 2 AS value FROM g WHERE (x + 2 * y + 3 * z) % 5 = 0)"""
PORES = """pores AS (SELECT *, 4.0 / 3.0 * pi() * radius * radius * radius AS volume FROM (SELECT CAST(p_partkey AS BIGINT) AS id, CAST((p_partkey * 7919) % 1000 AS DOUBLE) AS x, CAST((p_partkey * 104729) % 1000 AS DOUBLE) AS y,
  CAST((p_partkey * 1299709 // 7) % 1000 AS DOUBLE) AS z, CAST(p_size AS DOUBLE) AS radius FROM part))"""
BOXES = """boxes AS (SELECT CAST(c_custkey AS BIGINT) AS det_id, c_custkey % 24 AS slice, c_custkey % 20 AS x, (c_custkey // 20) % 20 AS y, 2 + c_custkey % 5 AS w, 2 + c_custkey % 4 AS h,
  CAST(c_acctbal AS DOUBLE) AS score, c_custkey % 2 = 0 AS selected FROM customer)"""
MAPS = """maps AS (SELECT map_id, x, y + 25 * z AS y, CASE WHEN gray >= t THEN map_id ELSE 0 END AS value FROM g, (VALUES (1, 64), (2, 96), (3, 128)) AS k(map_id, t))"""
SERIES = """series AS (SELECT CAST(user_id AS BIGINT) AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, CAST(value AS DOUBLE) AS v FROM events)"""
FRAMES = """frames AS (SELECT l_orderkey % 10 AS run_id, row_number() OVER (PARTITION BY l_orderkey % 10 ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS step,
  CAST(l_quantity - 25 AS DOUBLE) AS p_value, CAST(l_discount * 100 AS DOUBLE) AS s_value FROM lineitem)"""
POINTS = """pts AS (SELECT CAST(s_suppkey AS BIGINT) AS id, CAST(s_nationkey % 8 AS DOUBLE) AS pressure_mpa, 2000 + CAST(s_acctbal AS DOUBLE) / 20 AS density, CAST(10000 + 3 * CAST(s_acctbal AS DOUBLE) + (s_suppkey % 7) * 50 AS DOUBLE) AS youngs,
  0.2 + (s_suppkey % 11) / 100.0 AS poisson, 1.5 + (s_suppkey % 13) / 20.0 AS vp_vs, CAST(s_suppkey % 256 AS DOUBLE) AS gray, CAST(1 + s_suppkey % 97 AS DOUBLE) AS sim_t2,
  CAST(2 + (s_suppkey % 97) * 3 + s_suppkey % 5 AS DOUBLE) AS ref_t2, CAST(1 + s_suppkey % 31 AS DOUBLE) AS sim_amp, CAST(3 + (s_suppkey % 31) * 2 + s_suppkey % 3 AS DOUBLE) AS ref_amp FROM supplier)"""
