"""Readers and writers of volumes, materials, measurements, calibrations and logs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomolake.functions.physics import number_in_name
from tomolake.operators.sizes import small
from tomolake.operators.stencil import blocks
from tomolake.sources.containers import chunk_voxels, read_chunks

MEASUREMENT = "id long, name string, view string, slice long, x1 long, y1 long, x2 long, y2 long, distance double, unit string, text string, created string"


def header_violations(volumes: DataFrame) -> DataFrame:
    """Volumes whose dims, chunk side or pixel size are out of range: (volume_id, fault)."""
    faults = [("dimension", " OR ".join(f"{c} <= 0 OR {c} > 10000" for c in ("width", "height", "depth"))), ("chunk_dim", "chunk_dim < 16 OR chunk_dim > 512"), ("pixel_size", "pixel_size <= 0 OR pixel_size > 1")]
    found = F.filter(F.array(*[F.when(F.expr(f"coalesce({e}, true)"), F.lit(n)) for n, e in faults]), lambda f: f.isNotNull())
    return volumes.select("volume_id", F.explode(found).alias("fault"))


def read_raw_stack(spark: SparkSession, folder: str, width: int, height: int, pattern: str = "*.raw") -> DataFrame:
    """Slices of bytes, one file each, as voxels: z is the file's place by the number in its name, then by name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    order = files.select("path").withColumn("name", name).withColumn("z", F.row_number().over(Window.orderBy(number_in_name(F.col("name")), "name")) - 1)

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                if len(r.content) != width * height:
                    raise ValueError(f"{r.path}: {len(r.content)} bytes, not {width} x {height}")
                g = np.frombuffer(r.content, np.uint8).astype(np.int64)
                at = np.arange(len(g))
                yield pd.DataFrame({"volume_id": 1, "x": at % width, "y": at // width, "z": int(r.z), "gray": g, "label": 0})

    return files.select("path", "content").join(small(order.select("path", "z")), "path").mapInPandas(decode, "volume_id long, x long, y long, z long, gray long, label long")


def slice_images(voxels: DataFrame, width: int, height: int, prefix: str = "slice_", digits: int = 4, first: int = 0, value: str = "gray") -> DataFrame:
    """(name, payload): a slice's bytes, row by row, under a padded name. Slices are put together from packed pieces."""

    def pack(volume: int, corner: tuple[int, int, int], block: np.ndarray, present: np.ndarray) -> pa.Table:
        z = corner[2]
        return pa.table({"volume_id": [volume], "z": [z], "name": [f"{prefix}{first + z:0{digits}d}.raw"], "payload": pa.array([block.tobytes()], pa.binary())})

    return blocks(voxels, pack, "volume_id long, z long, name string, payload binary", 0, (width, height, 1 << 31), (width, height, 1), value, kind=np.uint8)


def colours_to_labels(pixels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels from colours (volume_id, x, y, z, r, g, b): black is 0, others by rank of (r, g, b), 254 at most; gray 128."""
    colours = pixels.select("r", "g", "b").where("r + g + b > 0").distinct().orderBy("r", "g", "b").limit(254)
    table = colours.withColumn("id", F.row_number().over(Window.orderBy("r", "g", "b")).cast("long"))
    v = pixels.join(F.broadcast(table), ["r", "g", "b"], "left").select("volume_id", "x", "y", "z", F.lit(128).cast("long").alias("gray"), F.coalesce("id", F.lit(0).cast("long")).alias("label"))
    return v, table


def label_colours(voxels: DataFrame, materials: DataFrame) -> DataFrame:
    """Voxels with their material's colour (argb), black where there is none."""
    m = materials.select(F.col("id").alias("label"), F.col("argb"))
    c = voxels.join(small(m), "label", "left").withColumn("argb", F.coalesce("argb", F.lit(0).cast("long")))
    return c.select("volume_id", "x", "y", "z", "label", *[F.shiftright(F.col("argb"), s).bitwiseAND(255).alias(n) for n, s in (("r", 16), ("g", 8), ("b", 0))])


def write_volume(voxels: DataFrame, path: str, d: int = 64) -> None:
    """Parquet by volume, sorted by chunk, so that boxes prune row groups; only the volumes written are replaced."""
    keyed = voxels.withColumns({f"c{a}": F.floor(F.col(a) / d) for a in "xyz"})
    keyed.repartition("volume_id", "cz", "cy", "cx").sortWithinPartitions("volume_id", "cz", "cy", "cx", "z", "y", "x").drop("cx", "cy", "cz").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("volume_id").parquet(path)


def read_volumes(spark: SparkSession, path: str, *volume_ids: int) -> DataFrame:
    v = spark.read.parquet(path)
    return v.where(F.col("volume_id").isin(*volume_ids)) if volume_ids else v


def write_csv(table: DataFrame, path: str) -> None:
    """With a header; structs become columns."""
    flat = [F.col(f"{n}.{c.name}").alias(f"{n}_{c.name}") for n in table.columns if hasattr(table.schema[n].dataType, "fields") for c in table.schema[n].dataType.fields]
    plain = [n for n in table.columns if not hasattr(table.schema[n].dataType, "fields")]
    table.select(*plain, *flat).write.mode("overwrite").csv(path, header=True)


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    m = spark.read.csv(path, header=True, quote='"', escape='"', schema=MEASUREMENT)
    return m.withColumn("created", F.to_timestamp("created", "yyyy-MM-dd HH:mm:ss"))


def read_calibration_xml(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", "CalibrationPoint")
    return (reader.schema(schema) if schema else reader).load(path)


def read_relaxation_csv(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of simulated and reference values; comments, the header and rows that don't parse are left out."""
    rows = spark.read.csv(path, comment="#", header=True, mode="DROPMALFORMED", schema="sim_t2 double, sim_amp double, ref_t2 double, ref_amp double, description string")
    return rows.where("sim_t2 IS NOT NULL AND sim_amp IS NOT NULL AND ref_t2 IS NOT NULL AND ref_amp IS NOT NULL")


def relaxation_log(lines: DataFrame, marker: str) -> DataFrame:
    """(t2, amplitude) from log lines (n, line) after the one with the marker: named values, pairs, or pairs in brackets."""
    number = r"([-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"
    shapes = [rf"T2\s*[=:]\s*{number}.*?[Aa]mp\w*\s*[=:]\s*{number}", rf"^\s*{number}[\s,;]+{number}\s*$", rf"\(\s*{number}\s*,\s*{number}\s*\)"]
    start = lines.where(F.col("line").contains(marker)).agg(F.min("n").alias("start"))
    after = lines.crossJoin(F.broadcast(start)).where("n > start")
    pick = lambda i: F.coalesce(*[F.nullif(F.regexp_extract("line", s, i), F.lit("")) for s in shapes]).try_cast("double")
    return after.select("n", pick(1).alias("t2"), pick(2).alias("amplitude")).where("t2 IS NOT NULL AND amplitude IS NOT NULL")


def unpivot(row: DataFrame, units: dict[str, str]) -> DataFrame:
    """Rows of parameter, value and unit from the columns of one row."""
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("parameter"), F.col(c).cast("double").alias("value"), F.lit(u).alias("unit")) for c, u in units.items()])))


MATERIAL = "id long, name string, argb long, min long, max long, is_exterior boolean, density double, is_visible boolean"


def write_materials(materials: DataFrame, path: str) -> None:
    materials.select(*[c.split()[0] for c in MATERIAL.split(", ")]).coalesce(1).write.mode("overwrite").parquet(path)


def read_materials(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MATERIAL).parquet(path)


def _csv(table: DataFrame, path: str, **columns: Column | str) -> None:
    table.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()]).write.mode("overwrite").csv(path, header=True, quoteAll=False)


def _fixed(column: str, places: int) -> Column:
    """A number with that many decimals, without separators of thousands."""
    return F.format_string(f"%.{places}f", F.col(column).cast("double"))


def write_statistics_csv(statistics: DataFrame, path: str) -> None:
    """material_statistics() in six columns."""
    _csv(statistics.orderBy("id"), path, **{"Material": "name", "Voxels": "voxel_count", "Volume (µm³)": "volume_um3", "Volume (mm³)": "volume_mm3", "Volume (cm³)": "volume_cm3", "Percentage": "percent"})


def write_particle_csv(particles: DataFrame, path: str) -> None:
    """particles() in sixteen columns, volumes with four and six decimals; bounds include both ends."""
    side = lambda a: F.col(f"bounds.max_{a}") - F.col(f"bounds.min_{a}") + 1
    at = {f"{k.title()}{a.upper()}": F.col(f"bounds.{k}_{a}") for k in ("min", "max") for a in "xyz"}
    centre = {f"Center{a.upper()}": F.col(f"center.{a}") for a in "xyz"}
    _csv(particles, path, ID="component", VoxelCount="voxel_count", VolumeMicrometers=_fixed("volume_um3", 4), VolumeMillimeters=_fixed("volume_mm3", 6), **centre, **at, Width=side("x"), Height=side("y"), Depth=side("z"))


def write_particle_result(particles: DataFrame, runs: DataFrame, path: str) -> None:
    """Particles and the run-length form of their labels, under one folder."""
    particles.write.mode("overwrite").parquet(f"{path}/particles")
    runs.write.mode("overwrite").parquet(f"{path}/runs")


def read_particle_result(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/particles"), spark.read.parquet(f"{path}/runs")


def write_network_csv(pores: DataFrame, throats: DataFrame, properties: DataFrame, path: str) -> None:
    """Pores (with connections), throats and one row of properties as three tables, numbers with two (four) decimals."""
    _csv(pores, f"{path}/pores", ID="id", **{"Volume (µm³)": _fixed("volume", 2), "Surface Area (µm²)": _fixed("area", 2), "Equivalent Radius (µm)": _fixed("radius", 2)}, **{f"{a.upper()} (µm)": _fixed(a, 2) for a in "xyz"}, Connections="connections")
    order = F.row_number().over(Window.partitionBy("pore1").orderBy("pore2"))
    _csv(throats.withColumn("id", F.concat_ws("-", "pore1", order.cast("string"))), f"{path}/throats", ID="id", **{"Pore1 ID": "pore1", "Pore2 ID": "pore2", "Radius (µm)": _fixed("radius", 2), "Length (µm)": _fixed("length", 2), "Volume (µm³)": _fixed("volume", 2)})
    _csv(properties, f"{path}/statistics", **{"Total Pore Volume (µm³)": _fixed("pore_volume", 2), "Total Throat Volume (µm³)": _fixed("throat_volume", 2), "Porosity": _fixed("porosity", 4)})


def write_network(path: str, **tables: DataFrame) -> None:
    """Tables of a network or of its permeability (pores, throats, properties, pressures, ...) as Parquet under one folder."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def read_network(spark: SparkSession, path: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{path}/{n}") for n in names]


def write_selected(rows: DataFrame, ids: DataFrame, path: str) -> None:
    """The rows whose id is among the ids, as CSV."""
    write_csv(rows.join(ids.select("id").distinct(), "id", "left_semi"), path)


def write_permeability_csv(results: DataFrame, pressures: DataFrame, path: str) -> None:
    """The compared methods, and each pore's pressure."""
    _csv(results, f"{path}/permeability", Method="method", **{"Permeability (D)": "permeability", "Corrected (D)": "corrected"})
    _csv(pressures, f"{path}/pressures", **{"Pore ID": "pore_id", "Pressure (Pa)": "pressure"})


def write_band_csv(bands: DataFrame, path: str) -> None:
    """Bands of any views (view, row, v, dark, bright), in order of view and row."""
    _csv(bands.orderBy("view", "slice", "row"), path, **{"Slice Type": "view", "Row/Col": "row", "Value": "v", "Dark Peak": "dark", "Bright Peak": "bright"})


def write_measurements(measurements: DataFrame, path: str) -> None:
    """Twelve columns; distance in m, um and mm; times as text."""
    d = F.col("distance")
    rows = measurements.withColumns({"um": d * 1e6, "mm": d * 1e3})
    places = {f"{k}{a.upper()}": f"{a}{i}" for i, k in ((1, "Start"), (2, "End")) for a in "xy"}
    _csv(rows, path, ID="id", Name="name", View="view", SliceIndex="slice", **places, **{"Distance(m)": _fixed("distance", 6), "Distance(µm)": _fixed("um", 2), "Distance(mm)": _fixed("mm", 2)}, Created=F.date_format("created", "yyyy-MM-dd HH:mm:ss"))


def write_calibration_xml(points: DataFrame, path: str) -> None:
    points.write.mode("overwrite").format("xml").option("rootTag", "CalibrationDataset").option("rowTag", "CalibrationPoint").save(path)


def write_parameters(row: DataFrame, units: dict[str, str], path: str) -> None:
    """One row as Parameter, Value, Unit."""
    _csv(unpivot(row, units), path, Parameter="parameter", Value="value", Unit="unit")


def acoustic_result(velocities: DataFrame) -> DataFrame:
    """Velocities with the dead time between the arrivals, in steps."""
    return velocities.withColumn("dead_time", F.col("s_step") - F.col("p_step"))


def velocity_series(receiver: DataFrame, spacing: float, velocity: float) -> DataFrame:
    """(time_ms, displacement, intensity) of steps (step, displacement, intensity): a step lasts spacing / (1.2 velocity)."""
    return receiver.select((F.col("step") * (spacing / (1.2 * velocity) * 1000)).alias("time_ms"), "displacement", F.coalesce("intensity", F.lit(0.0)).alias("intensity"))


def write_curve(curve: DataFrame, parameters: DataFrame, path: str) -> None:
    """A curve as CSV and JSON beside its row of parameters as JSON."""
    write_csv(curve, f"{path}/curve_csv")
    curve.write.mode("overwrite").json(f"{path}/curve_json")
    parameters.write.mode("overwrite").json(f"{path}/parameters_json")


def read_network_lines(lines: DataFrame) -> DataFrame:
    """One row of porosity, tortuosity, mean radius and mean connections from a sectioned export (n, line).

    Sections begin with # and end at a blank line or another #; running marks within the file tell them apart.
    """
    w = Window.orderBy("n")  # one exported file
    section = F.when(F.col("line").startswith("# Network Statistics"), "statistics").when(F.col("line").startswith("# Pores"), "pores").when(F.col("line").startswith("#") | (F.trim("line") == ""), "none")
    named = lines.withColumn("section", F.last(section, ignorenulls=True).over(w)).withColumn("p", F.split("line", ","))
    value = lambda key: F.max(F.when((F.col("section") == "statistics") & (F.size("p") == 2) & (F.trim(F.get("p", F.lit(0))) == key), F.trim(F.get("p", F.lit(1))).try_cast("double")))
    column = lambda i: F.avg(F.when((F.col("section") == "pores") & (F.size("p") >= 8), F.get("p", F.lit(i)).try_cast("double")))
    return named.agg(value("Porosity").alias("porosity"), value("Tortuosity").alias("tortuosity"), column(3).alias("mean_radius"), column(7).alias("mean_connections"))


def read_chunked_volume(spark: SparkSession, path: str, value: str = "gray") -> DataFrame:
    """(volume_id, x, y, z, value) of volume files in chunks, in ranges of chunks (see containers).

    A file whose size doesn't fit its header is an error. volume_id is the place of the file's path among the paths.
    """
    return chunk_voxels(read_chunks(spark, path), value)
