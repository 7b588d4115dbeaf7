"""Series: profiles, peaks, filters, run lengths and stress curves, as windows keyed by the series."""

from __future__ import annotations

from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomolake.operators.graph import dominated
from tomolake.sources.shared import written


def gaussian_smooth(profile: DataFrame, sigma: float, key: list[str], order: str, value: str = "v") -> DataFrame:
    """Weighted mean of a centred frame of floor(6 sigma) rows (made odd), weights renormalised at the ends."""
    size = int(6 * sigma)
    r = (size + 1 - size % 2) // 2
    w = Window.partitionBy(*key).orderBy(order)
    weights = [exp(-i * i / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    near = [F.lag(value, -i).over(w) if i <= 0 else F.lead(value, i).over(w) for i in range(-r, r + 1)]
    top = sum((F.coalesce(n * g, F.lit(0.0)) for n, g in zip(near, weights, strict=True)), F.lit(0.0))
    total = sum((F.when(n.isNotNull(), g).otherwise(0.0) for n, g in zip(near, weights, strict=True)), F.lit(0.0))
    return profile.withColumn("smooth", top / total)


def local_maxima(profile: DataFrame, key: list[str], order: str, value: str = "v") -> DataFrame:
    w = Window.partitionBy(*key).orderBy(order)
    return profile.withColumn("is_peak", F.coalesce((F.col(value) > F.lag(value).over(w)) & (F.col(value) > F.lead(value).over(w)), F.lit(False)))


def local_minima(profile: DataFrame, key: list[str], order: str, value: str = "v") -> DataFrame:
    w = Window.partitionBy(*key).orderBy(order)
    return profile.withColumn("is_trough", F.coalesce((F.col(value) < F.lag(value).over(w)) & (F.col(value) < F.lead(value).over(w)), F.lit(False)))


def dark_peaks(profile: DataFrame, key: list[str], order: str, prominence: float, distance: int, value: str = "v", mirrored: bool = False) -> DataFrame:
    """peaks() of the profile turned over: -value, or mirrored within its own range (max - value + min)."""
    w = Window.partitionBy(*key)
    over = F.max(value).over(w) - F.col(value) + F.min(value).over(w) if mirrored else -F.col(value)
    return peaks(profile.select(*key, order, over.alias(value)), key, order, prominence, distance, value)


class Ranges:
    """Maxima and minima of an array over windows of doubling length."""

    def __init__(self, x: np.ndarray) -> None:
        self.n, self.top, self.low, step = len(x), [x], [x], 1
        while 2 * step <= len(x):
            self.top.append(np.maximum(self.top[-1][:-step], self.top[-1][step:]))
            self.low.append(np.minimum(self.low[-1][:-step], self.low[-1][step:]))
            step *= 2

    def first_over(self, start: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The first place from start on with a value over h, n if there is none."""
        at = start.copy()
        for k in range(len(self.top) - 1, -1, -1):
            fits = at + (1 << k) <= self.n
            under = fits & (self.top[k][np.where(fits, at, 0)] <= h) if len(self.top[k]) else fits
            at += under << k
        return at

    def least(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Minima over [start, stop), infinite where that is empty."""
        out = np.full(len(start), np.inf)
        size = stop - start
        for k in range(len(self.low)):
            mine = (size >= 1 << k) & (size < 2 << k)
            out[mine] = np.minimum(self.low[k][start[mine]], self.low[k][stop[mine] - (1 << k)])
        return out


def _inner(rows: DataFrame, key: list[str], order: str, value: str) -> tuple[DataFrame, list[str], list]:
    """rows with columns of names of their own: k0, k1, ..., o and v; the names of the keys; and how keys and order are named back."""
    names = [f"k{n}" for n in range(len(key))]
    back = [F.col(n).alias(c) for n, c in zip([*names, "o"], [*key, order], strict=True)]
    return rows.select(*[F.col(c).alias(n) for c, n in zip(key, names, strict=True)], F.col(order).alias("o"), F.col(value).alias("v")), names, back


def peaks(profile: DataFrame, key: list[str], order: str, prominence: float, distance: int, value: str = "v") -> DataFrame:
    """Local maxima that stand out by the prominence (or by half of a positive height), at least `distance` rows apart, the
    higher first.

    Rows are dealt by ranges of key and order, so a long profile lies in many blocks. A peak's nearest higher value to either side
    is looked for in its own block; failing that, the first block with a higher maximum is known from one row a block, and
    the peak asks that block alone. Spacing is decided in rounds, see dominated().
    """
    rows, names, back = _inner(profile, key, order, value)
    return _peaks(rows, names, "o", prominence, distance, "v").select(*back, F.col("v").alias(value), "prominence")


def _peaks(profile: DataFrame, key: list[str], order: str, prominence: float, distance: int, value: str) -> DataFrame:
    types = dict(profile.dtypes)
    keys = ", ".join(f"{c} {types[c]}" for c in key)
    one = [*key, "block"]
    rows = written(profile.select(*key, order, F.col(value).alias("value"), F.col(value).cast("double").alias("x")).repartitionByRange(*key, order).withColumn("block", F.spark_partition_id()), "blocks")
    ends = rows.groupBy(*one).agg(F.count("*").alias("n"), F.max("x").alias("top"), F.min("x").alias("low"), F.min_by("x", order).alias("first"), F.max_by("x", order).alias("last"))
    all_ends = ends.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("block", "n", "top", "low", "first", "last"))).alias("blocks"))  # one for each block
    context = written(ends.select(*one).join(all_ends, key), "contexts")

    def sides(x: Ranges, mirrored: Ranges, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nearest higher places to the left (-1 if none) and right (n), and the minima on the way to them."""
        right, left = x.first_over(at + 1, h), x.n - 1 - mirrored.first_over(x.n - at, h)
        return left, right, x.least(left + 1, at + 1), x.least(at, right)

    def find(group: pa.Table, near: pa.Table) -> pa.Table:
        group = group.sort_by(order)
        v, blocks = group["x"].to_numpy(), near["blocks"][0].as_py()
        k = [b["block"] for b in blocks].index(near["block"][0].as_py())
        before = blocks[k - 1]["last"] if k else np.inf
        after = blocks[k + 1]["first"] if k + 1 < len(blocks) else np.inf
        wide = np.concatenate(([before], v, [after]))  # a profile's ends are no peaks
        at = np.flatnonzero((v > wide[:-2]) & (v > wide[2:]))
        h = v[at]
        left, right, low_left, low_right = sides(Ranges(v), Ranges(v[::-1]), at, h)
        top, low = (np.array([b[c] for b in blocks], float) for c in ("top", "low"))
        over = sides(Ranges(top), Ranges(top[::-1]), np.full(len(at), k), h)
        lows = Ranges(low)
        at_k = np.full(len(at), k)
        asked_left, asked_right = np.where(left < 0, over[0], -1), np.where(right == len(v), np.where(over[1] < len(blocks), over[1], -1), -1)
        low_left = np.where(left < 0, np.minimum(low_left, lows.least(over[0] + 1, at_k)), low_left)
        low_right = np.where(right == len(v), np.minimum(low_right, lows.least(at_k + 1, np.minimum(over[1], len(blocks)))), low_right)
        number = np.array([b["block"] for b in blocks])
        ask = lambda j: pa.array(np.where(j >= 0, number[j], -1), pa.int32())
        i = at + sum(b["n"] for b in blocks[:k])
        return pa.table({c: group[c].take(pa.array(at)) for c in (*key, order, "value")} | {"i": pa.array(i, pa.int64()), "h": h, "low_left": low_left, "low_right": low_right, "left": ask(asked_left), "right": ask(asked_right)})

    def answer(group: pa.Table, asked: pa.Table) -> pa.Table:
        v = group.sort_by(order)["x"].to_numpy()
        x, mirrored = Ranges(v), Ranges(v[::-1])
        h, zero = asked["h"].to_numpy(), np.zeros(asked.num_rows, np.int64)
        to_right = asked["side"].to_numpy() == 1
        low = np.where(to_right, x.least(zero, x.first_over(zero, h)), x.least(x.n - mirrored.first_over(zero, h), zero + x.n))
        return pa.table({c: asked[c] for c in (*key, "i", "side")} | {"low": low})

    found = written(rows.groupBy(*one).cogroup(context.groupBy(*one)).applyInArrow(find, f"{keys}, {order} {types[order]}, value {types[value]}, i long, h double, low_left double, low_right double, left int, right int"), "peaks")
    asked = written(found.select(*key, "i", "h", F.posexplode(F.array("left", "right")).alias("side", "block")).where("block >= 0"), "asked")
    told = rows.join(asked.select(*one).distinct(), one, "left_semi").groupBy(*one).cogroup(asked.groupBy(*one)).applyInArrow(answer, f"{keys}, i long, side int, low double")
    told = told.groupBy(*key, "i").agg(*[F.min(F.when(F.col("side") == k, F.col("low"))).alias(f"told{k}") for k in (0, 1)])
    out = F.col("h") - F.greatest(F.least("low_left", F.coalesce("told0", "low_left")), F.least("low_right", F.coalesce("told1", "low_right")))
    found = found.join(told, [*key, "i"], "left").withColumn("prominence", out).where((F.col("prominence") >= prominence) | ((F.col("h") > 0) & (F.col("prominence") >= 0.5 * F.col("h"))))
    if distance > 1:
        found = written(found, "prominent")
        node = found.select(*key, "i", "h", F.struct(*key, "i").alias("node"), F.floor(F.col("i") / distance).alias("bin"))
        other = node.select(*key, F.col("i").alias("j"), F.col("h").alias("g"), F.col("node").alias("loser"), F.explode(F.array(*[F.col("bin") + k for k in (-1, 0, 1)])).alias("bin"))
        near = node.join(other, [*key, "bin"]).where((F.abs(F.col("i") - F.col("j")) < distance) & ((F.col("h") > F.col("g")) | ((F.col("h") == F.col("g")) & (F.col("i") < F.col("j")))))
        gone = dominated(near.select(F.col("node").alias("winner"), "loser"))
        found = found.join(gone.select("node.*"), [*key, "i"], "left_anti")
    return found.select(*key, order, F.col("value").alias(value), "prominence")


def peak_spacing(found: DataFrame, key: list[str], order: str, pixel_mm: float) -> DataFrame:
    """Distance to the next peak in mm, 0 for the last."""
    w = Window.partitionBy(*key).orderBy(order)
    return found.withColumn("spacing_mm", F.coalesce((F.lead(order).over(w) - F.col(order)) * pixel_mm, F.lit(0.0)))


def run_lengths(voxels: DataFrame, slab: int = 16, value: str = "label") -> DataFrame:
    """Runs of equal value in scan order (z, y, x) within slabs of z: (volume_id, slab, start, value, length)."""
    w = Window.partitionBy("volume_id", "slab").orderBy("z", "y", "x")
    v = voxels.withColumn("slab", F.floor(F.col("z") / slab)).withColumn("i", F.row_number().over(w) - 1)
    v = v.withColumn("g", F.col("i") - F.row_number().over(Window.partitionBy("volume_id", "slab", value).orderBy("i")))
    return v.groupBy("volume_id", "slab", F.col(value).alias("value"), "g").agg(F.min("i").cast("long").alias("start"), F.count("*").alias("length")).drop("g")


def from_run_lengths(runs: DataFrame) -> DataFrame:
    return runs.select("volume_id", "slab", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("i"), "value")


def envelope(series: DataFrame, key: list[str], order: str, value: str = "v") -> DataFrame:
    """Mean absolute value over ten rows to each side, then three passes of (1, 2, 1) / 4 that keep the ends."""
    w = Window.partitionBy(*key).orderBy(order)
    s = series.withColumn("envelope", F.avg(F.abs(F.col(value))).over(w.rowsBetween(-10, 10)))
    for _ in range(3):
        s = s.withColumn("envelope", F.coalesce((F.lag("envelope").over(w) + 2 * F.col("envelope") + F.lead("envelope").over(w)) / 4, F.col("envelope")))
    return s


def recurrence(u: np.ndarray, a: float) -> np.ndarray:
    """y with y[i] = a y[i - 1] + u[i] and nothing before: the recurrence doubled, not stepped through."""
    y, step, power = u.astype(float), 1, float(a)
    while step < len(y) and power != 0:
        y[step:] += power * y[:-step]
        step, power = 2 * step, power * power
    return y


def band_pass(series: DataFrame, key: list[str], order: str, high: float, low: float, value: str = "v") -> DataFrame:
    """First-order high-pass y = a (y' + x - x'), then low-pass z = z' + b (y - z'); both are 0 in a series' first row.

    A parallel scan. Rows are dealt by ranges of key and order, so a long series lies in many blocks. What a block makes of
    the state it gets (y' - x' and z') is an affine map; the maps of a series' blocks, one row each, are applied in order, and
    each block then runs from the state before it.
    """
    rows, names, back = _inner(series, key, order, value)
    return _band_pass(rows, names, "o", high, low, "v").select(*back, "high_pass", "band_pass")


def _band_pass(series: DataFrame, key: list[str], order: str, high: float, low: float, value: str) -> DataFrame:
    types = dict(series.dtypes)
    blocks = written(series.select(*key, order, F.col(value).cast("double").alias("x")).repartitionByRange(*key, order).withColumn("block", F.spark_partition_id()), "blocks")
    keys = ", ".join(f"{c} {types[c]}" for c in key)

    def own(group: pa.Table, z: float, out: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = group["x"].to_numpy()
        drive = high * np.diff(x, prepend=0.0)
        drive[0] += high * z
        y = recurrence(drive, high)
        filtered = low * y
        filtered[0] += (1 - low) * out
        return x, y, recurrence(filtered, 1 - low)

    def measure(group: pa.Table) -> pa.Table:
        group = group.sort_by(order)
        x, y, out = own(group, 0.0, 0.0)
        unit = group.set_column(group.column_names.index("x"), "x", pa.array(np.zeros(len(x))))
        _, by_z, out_by_z = own(unit, 1.0, 0.0)
        row = {"first": x[0], "last": x[-1], "y": y[-1], "out": out[-1], "y_by_z": by_z[-1], "out_by_z": out_by_z[-1], "out_by_out": (1 - low) ** len(x)}
        return pa.table({c: group[c].slice(0, 1) for c in [*key, "block"]} | {n: [float(v)] for n, v in row.items()})

    def scan(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        z, out, states = -group["first"][0].as_py(), 0.0, []
        for r in group.drop_columns(key).to_pylist():  # one for each block of the series
            states.append((z, out))
            z, out = r["y"] + r["y_by_z"] * z - r["last"], r["out"] + r["out_by_z"] * z + r["out_by_out"] * out
        return pa.table({c: group[c] for c in [*key, "block"]} | {"z": [float(s[0]) for s in states], "before": [float(s[1]) for s in states]})

    def apply(group: pa.Table) -> pa.Table:
        group = group.sort_by(order)
        _, y, out = own(group, group["z"][0].as_py(), group["before"][0].as_py())
        return pa.table({c: group[c] for c in [*key, order]} | {"high_pass": y, "band_pass": out})

    maps = blocks.groupBy(*key, "block").applyInArrow(measure, f"{keys}, block int, first double, last double, y double, out double, y_by_z double, out_by_z double, out_by_out double")
    states = maps.groupBy(*key).applyInArrow(scan, f"{keys}, block int, z double, before double")
    return blocks.join(states, [*key, "block"]).groupBy(*key, "block").applyInArrow(apply, f"{keys}, {order} {types[order]}, high_pass double, band_pass double")


def local_slope(curve: DataFrame, key: list[str], order: str, x: str, y: str) -> DataFrame:
    """Slope of y on x over two rows to each side."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(-2, 2)
    return curve.withColumn("slope", F.regr_slope(F.col(y), F.col(x)).over(w))


def rolling_values(series: DataFrame, key: list[str], order: str, value: str, rows: int = 1000) -> DataFrame:
    """The last values up to each row, as an array of at most `rows`."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(1 - rows, 0)
    return series.withColumn("recent", F.collect_list(value).over(w))
