"""Frame series of simulation runs: arrivals and quality, as batches or as a stream with state by run."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tomolake.sources.shared import written

STEP = "run_id long, step long, p_value double, s_value double"


def read_frames(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Frames from a folder of Parquet files, pruned to the series' columns; as a stream, file by file."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(STEP).parquet(path)


def _level(share: float, floor: float, sure: float) -> float:
    """The magnitude over which a step is the first arrival.

    A step arrives over `sure`, or over `floor` and that share of the maximum so far. The first one over the lower of the two
    is itself the maximum so far, so with a share below 1 nothing before it matters.
    """
    if not 0 <= share < 1:
        raise ValueError("the share of the maximum so far must be below 1")
    return min(floor, sure)


def p_arrivals(frames: DataFrame, share: float = 0.01, floor: float = 1e-10, sure: float = 1e-9) -> DataFrame:
    """(run_id, p_step): the first step whose magnitude is over `sure` or over that share of the maximum so far."""
    hit = F.abs("p_value") > _level(share, floor, sure)
    return frames.groupBy("run_id").agg(F.min(F.when(hit, F.col("step"))).alias("p_step"))


def s_arrivals(frames: DataFrame, p: DataFrame, expected_ratio: float, share: float = 0.15, apart: int = 10, tolerance: float = 0.05) -> DataFrame:
    """(run_id, p_step, s_step): the first step at least `apart` after P whose S magnitude is over the share of its
    maximum so far and over P's magnitude, in a ratio of 1.3 to 2.8 to P within the tolerance of the expected one.

    Frames are dealt by ranges of run and step. A block's maximum so far is that of the blocks before it, known from one row
    a block, and its own: a long run lies in many tasks.
    """
    s, a = F.abs("s_value"), F.abs("p_value")
    blocks = written(frames.select("run_id", "step", "p_value", "s_value").repartitionByRange("run_id", "step").withColumn("block", F.spark_partition_id()), "blocks")
    before = Window.partitionBy("run_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tops = blocks.groupBy("run_id", "block").agg(F.max(s).alias("top")).select("run_id", "block", F.max("top").over(before).alias("before"))
    within = Window.partitionBy("run_id", "block").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    f = blocks.withColumn("own", F.max(s).over(within)).join(tops, ["run_id", "block"]).withColumn("top", F.greatest("own", "before")).join(p, "run_id")
    ratio = F.col("step") / F.col("p_step")
    hit = (F.col("step") >= F.col("p_step") + apart) & (s > share * F.col("top")) & (s > a) & ratio.between(1.3, 2.8) & (F.abs(ratio - expected_ratio) <= tolerance * expected_ratio)
    return f.groupBy("run_id", "p_step").agg(F.min(F.when(hit, F.col("step"))).alias("s_step"))


def velocities(arrivals: DataFrame, distance: float, dt: float, default_vp: float, default_vs: float) -> DataFrame:
    """Velocities from arrival steps; missing ones take the defaults."""
    v = lambda c, d: F.coalesce(F.when(F.col(c) > 0, distance / (F.col(c) * dt)), F.lit(d))
    out = arrivals.select("run_id", "p_step", "s_step", v("p_step", default_vp).alias("vp"), v("s_step", default_vs).alias("vs"))
    return out.withColumn("vp_vs", F.col("vp") / F.col("vs"))


def signal_quality(frames: DataFrame) -> DataFrame:
    """Greatest P and S magnitudes of a run, a score from 0 to 1 that grows with their logarithm, and its class."""
    m = frames.groupBy("run_id").agg(F.max(F.abs("p_value")).alias("max_p"), F.max(F.abs("s_value")).alias("max_s"))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.log10(F.greatest(F.least("max_p", "max_s"), F.lit(1e-12))) + 12) / 12))
    m = m.withColumn("score", score)
    return m.withColumn("quality", F.when(F.col("score") >= 0.75, "good").when(F.col("score") >= 0.4, "fair").otherwise("poor"))


def midplane_map(field: DataFrame, source: tuple[int, int, int], receiver: tuple[int, int, int]) -> DataFrame:
    """Speed on the plane halfway along the main axis from source to receiver (ties go to x, then y), scaled to 0..1."""
    from tomolake.operators.voxels import PLANE

    gaps = [abs(b - a) for a, b in zip(source, receiver, strict=True)]
    i = gaps.index(max(gaps))
    fixed = "xyz"[i]
    _, a, b = next(p for p in PLANE.values() if p[0] == fixed)
    at = (source[i] + receiver[i]) // 2
    m = field.where(F.col(fixed) == at).select("run_id", "step", F.col(a).alias("a"), F.col(b).alias("b"), F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") + F.col("vz") * F.col("vz")).alias("v"))
    span = m.groupBy("run_id", "step").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return m.join(span, ["run_id", "step"]).select("run_id", "step", "a", "b", F.when(F.col("high") > F.col("low"), (F.col("v") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0).alias("level"))


def stream_p_arrivals(frames: DataFrame, share: float = 0.01, floor: float = 1e-10, sure: float = 1e-9) -> DataFrame:
    """p_arrivals over a stream: each run keeps whether it has arrived, and emits once.

    Frames of a run must come in order of step over batches.
    """
    level = _level(share, floor, sure)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        arrived = state.get[0] if state.exists else False
        first = None
        for pdf in frames:
            hits = pdf.loc[pdf["p_value"].abs() > level, "step"]
            if len(hits):
                first = int(hits.min()) if first is None else min(first, int(hits.min()))
        if first is not None and not arrived:
            yield pd.DataFrame({"run_id": [key[0]], "p_step": [first]})
        state.update((arrived or first is not None,))

    return frames.groupBy("run_id").applyInPandasWithState(run, "run_id long, p_step long", "arrived boolean", "append", GroupStateTimeout.NoTimeout)
