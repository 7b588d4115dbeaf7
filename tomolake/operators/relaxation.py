"""Relaxation components (t2, amplitude, tortuosity) put together: their distribution over a log grid, and a summary."""

from __future__ import annotations

from math import log10, pi, sqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomolake.functions.physics import calibrated_t2, decay

CRITICAL = 10e-6  # m, the pore size below which amplitudes fall


def log_grid(low: float, high: float, n: int) -> list[float]:
    step = (log10(high) - log10(low)) / (n - 1)
    return [10 ** (log10(low) + i * step) for i in range(n)]


def components(structure: DataFrame, properties: DataFrame, low: float = 1.0, high: float = 5000.0, n: int = 32) -> DataFrame:
    """(label, t2, amplitude, tortuosity) of each material at each value of the T2 grid.

    structure: label, porosity, mean_pore_size (m), mean_connectivity. properties, a table of materials: label, density of
    hydrogen, relaxation_time (ms), relaxation_strength, tortuosity, porosity_effect. The amplitude is a log-normal weight
    about the relaxation time, of width 0.5 / strength, lowered in pores that are small against 10 um; the
    tortuosity grows with missing connections and smaller pores and divides T2. Materials without hydrogen have none.
    """
    m = structure.join(properties.where("density > 0"), "label").withColumn("t2", F.explode(F.array(*map(F.lit, log_grid(low, high, n)))))
    size, t2, sigma = F.col("mean_pore_size"), F.col("t2"), 0.5 / F.col("relaxation_strength")
    off = F.log(t2) - F.log("relaxation_time")
    weight = F.exp(-off * off / (2 * sigma * sigma)) / (t2 * sigma * sqrt(2 * pi))
    small = F.when(size > 0, F.exp(-(CRITICAL / size) / t2)).otherwise(1.0)
    amplitude = F.col("density") * F.col("porosity") * weight * small * F.col("porosity_effect")
    winding = F.col("tortuosity") * (2 - F.col("mean_connectivity")) * F.when(size > 0, 1 / F.sqrt(size / CRITICAL)).otherwise(1.0)
    return m.select("label", (t2 / winding).alias("t2"), amplitude.alias("amplitude"), winding.alias("tortuosity")).where("amplitude > 0")


def response(components: DataFrame, times: list[float], slope: float | None = None, intercept: float = 0.0) -> DataFrame:
    """(t, magnetisation): the sum of the components' decay at each time (ms); with a slope, their T2 is calibrated first."""
    c = components if slope is None else components.withColumn("t2", calibrated_t2(F.col("t2"), F.lit(slope), F.lit(intercept)))
    at = c.withColumn("t", F.explode(F.array(*[F.lit(float(t)) for t in times])))
    return at.groupBy("t").agg(F.sum(decay(F.col("amplitude"), F.col("t"), F.col("t2"))).alias("magnetisation"))


def t2_distribution(components: DataFrame, low: float = 1.0, high: float = 5000.0, n: int = 32) -> DataFrame:
    """(bin, t2, share) for every value of the grid: amplitudes summed at the nearest value, over their total.

    Between two values equally near, the lower gets it; beyond the grid, its end. Rows with a null are left out; where
    amplitudes add up to nothing, shares are 0. Amplitudes are summed before the n rows of the grid meet in one window.
    """
    values = log_grid(low, high, n)
    grid, t2 = F.array(*map(F.lit, values)), F.col("t2")
    under = F.size(F.filter(grid, lambda v: v <= t2))
    between = F.when(F.get(grid, under) - t2 < t2 - F.get(grid, under - 1), under).otherwise(under - 1)
    nearest = F.when(under == 0, 0).when(under == n, n - 1).otherwise(between)
    sums = components.where("t2 IS NOT NULL AND amplitude IS NOT NULL").groupBy(nearest.cast("long").alias("bin")).agg(F.sum("amplitude").alias("amplitude"))
    every = components.sparkSession.range(n).withColumnRenamed("id", "bin")
    amount = F.coalesce("amplitude", F.lit(0.0))
    total = F.sum(amount).over(Window.partitionBy())  # of n rows
    return every.join(sums, "bin", "left").select("bin", F.get(grid, F.col("bin").cast("int")).alias("t2"), F.coalesce(F.try_divide(amount, F.when(total > 0, total)), F.lit(0.0)).alias("share"))


def summary(components: DataFrame, structure: DataFrame) -> DataFrame:
    """One row: total_porosity of the structure's rows; tortuosity and T2 weighted by amplitude (0 without any)."""
    weight = F.sum("amplitude")
    mean = {f"average_{c}": F.coalesce(F.try_divide(F.sum(F.col("amplitude") * F.col(c)), F.when(weight > 0, weight)), F.lit(0.0)) for c in ("tortuosity", "t2")}
    averages = components.agg(*[c.alias(k) for k, c in mean.items()])
    return structure.agg(F.coalesce(F.sum("porosity"), F.lit(0.0)).alias("total_porosity")).crossJoin(averages)  # one row each
