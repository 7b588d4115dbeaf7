"""Near-duplicate embeddings by a forest of random-projection trees with spill overlap.

Each tree splits recursively along random directions at the median of a bounded sample; vectors within `spill` of a
threshold go to both sides. Every vector is routed down every tree. Leaves that still hold many vectors of a label, as the
sample is too small to tell them apart, are split on in rounds at medians of all their own rows, until none is over-full or
a split no longer makes it smaller (near copies). Vectors meet in the leaves, by label, where all
cosines are computed in double precision as one product of matrices; a pair that shares several leaves counts in the
first. Leaves return sums and links to the least vector of each local component, never pairs. A leaf with more than
`block` vectors of a label is compared in blocks, each pair of blocks in a task of its own, so all of it is compared.
Equal vectors of a label are one node with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomolake.llm.common import connected_components, written

LEAST_IN_NODE = 8
FIRST = 1 << 20  # a leaf of the sampled trees is numbered from here on, a split doubles the number
LAST = 1 << 61


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


class Forest:
    """Random-projection trees over unit vectors of one width."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int, spill: float, seed: int):
        rng = np.random.default_rng(seed)
        self.spill, self.roots, self.nodes, self.leaves = spill, [], [], 0
        for _ in range(trees):
            self.roots.append(self._grow(sample, depth, rng))

    def _grow(self, x: np.ndarray, depth: int, rng: np.random.Generator) -> int:
        """Index of a node; a leaf is -1 - its number."""
        if depth == 0 or len(x) < 2 * LEAST_IN_NODE:
            self.leaves += 1
            return -self.leaves
        direction = rng.standard_normal(x.shape[1])
        direction /= np.linalg.norm(direction)
        at = x @ direction
        threshold, index = float(np.median(at)), len(self.nodes)
        self.nodes.append(None)
        low = self._grow(x[at < threshold], depth - 1, rng)
        high = self._grow(x[at >= threshold], depth - 1, rng)
        self.nodes[index] = (direction, threshold, low, high)
        return index

    def route(self, x: np.ndarray) -> list[np.ndarray]:
        """The leaves of every vector, ascending."""
        who, where = [], []
        for root in self.roots:
            stack = [(root, np.arange(len(x)))]
            while stack:
                node, rows = stack.pop()
                if node < 0:
                    who.append(rows)
                    where.append(np.full(len(rows), -1 - node))
                    continue
                direction, threshold, low, high = self.nodes[node]
                at = x[rows] @ direction - threshold
                stack += [(low, rows[at < self.spill]), (high, rows[at >= -self.spill])]
        who, where = np.concatenate(who), np.concatenate(where)
        order = np.lexsort((where, who))
        return np.split(where[order], np.cumsum(np.bincount(who, minlength=len(x)))[:-1])


def _local_roots(mask: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Least id reachable over a symmetric mask."""
    root, top = ids.copy(), np.iinfo(np.int64).max
    while True:
        new = root.copy()
        for at in range(0, len(ids), 256):
            new[at : at + 256] = np.minimum(new[at : at + 256], np.where(mask[at : at + 256], root[None, :], top).min(axis=1))
        if (new == root).all():
            return root
        root = new


def split_on(routed: DataFrame, most: int, spill: float, seed: int) -> DataFrame:
    """routed (label, same, width, embedding, leaves, ...) with leaves of more than `most` vectors of a label split further.

    A round takes all over-full leaves at once: a direction drawn from the leaf's number, a threshold from the approximate
    median of its rows, both by shuffles on the leaf. Numbers of a leaf's children are its own doubled, and doubled plus one.
    """
    key, final = ["label", "width", "leaf"], None

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves, widths = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("leaf", "width"))
            at = np.zeros(len(leaves))
            for leaf, width in set(zip(leaves.tolist(), widths.tolist(), strict=True)):
                rows = np.flatnonzero((leaves == leaf) & (widths == width))
                direction = np.random.default_rng([seed, leaf]).standard_normal(width)
                at[rows] = unit(matrix(batch.column("embedding").take(pa.array(rows)), width)) @ (direction / np.linalg.norm(direction))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("label", "same", "width", "leaf")), pa.array(at)], ["label", "same", "width", "leaf", "at"])

    while True:
        counts = routed.select("label", "width", F.explode("leaves").alias("leaf")).groupBy(*key).count()
        full = counts.where((F.col("count") > most) & (F.col("leaf") < LAST))
        full = written(full if final is None else full.join(final, key, "left_anti"), "over_full")
        if full.isEmpty():
            return routed
        rows = routed.select("label", "same", "width", "embedding", F.explode("leaves").alias("leaf")).join(full, key).select("label", "same", "width", "leaf", "embedding")
        places = written(rows.mapInArrow(project, "label " + dict(routed.dtypes)["label"] + ", same string, width int, leaf long, at double"), "projected")
        cut = places.groupBy(*key).agg(F.percentile_approx("at", 0.5, 1000).alias("cut"))
        sides = places.join(cut, key).select("label", "same", "width", "leaf", (F.col("at") < F.col("cut") + spill).alias("low"), (F.col("at") >= F.col("cut") - spill).alias("high"))
        sizes = sides.groupBy(*key).agg(F.count("*").alias("n"), F.sum(F.col("low").cast("int")).alias("lows"), F.sum(F.col("high").cast("int")).alias("highs"))
        stuck = written(sizes.where(F.greatest("lows", "highs") > 0.9 * F.col("n")).select(key), "stuck")
        final = stuck if final is None else written(final.unionByName(stuck), "stuck")
        kids = F.filter(F.array(F.when(F.col("low"), F.col("leaf") * 2), F.when(F.col("high"), F.col("leaf") * 2 + 1)), lambda c: c.isNotNull())
        moved = sides.join(stuck, key, "left_anti").groupBy("label", "same", "width").agg(F.map_from_entries(F.collect_list(F.struct("leaf", kids.alias("kids")))).alias("moves"))
        after = routed.join(moved, ["label", "same", "width"], "left")
        leaves = F.when(F.col("moves").isNull(), F.col("leaves")).otherwise(F.array_sort(F.flatten(F.transform("leaves", lambda x: F.coalesce(F.col("moves")[x], F.array(x))))))
        routed = written(after.withColumn("leaves", leaves).select(routed.columns), "routed")


def near_vectors(vectors: DataFrame, cosine: float = 0.98, trees: int = 6, spill: float = 0.0125, leaf: int = 2048, block: int = 1024, most: int = 8192, sample_rows: int = 20_000, seed: int = 42, id_col: str = "vec_id") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Linked are vectors of one label and width with a cosine of at least `cosine`; n_links counts other rows,
    component_id is the least id reachable, kept says that the row leads its component. Vectors that are null, empty,
    zero or hold null or non-finite components, and rows without a label, link with nothing (0 links, a component of
    their own). So do rows without an id, whose component is null and which aren't kept. Repeated rows link. Other columns
    are left out, whatever their names; an empty table gives no rows. `most` vectors of a label are left in a leaf at the most,
    but for near copies that no split tells apart.
    """
    e = F.col("embedding")
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), "label", e.cast("array<double>").alias("embedding"))
    rows = rows.select("vec_id", "label", "embedding", F.coalesce(sound, F.lit(False)).alias("sound"), F.sha2(e.cast("string"), 256).alias("same"))
    nodes = rows.where("sound").groupBy("label", "same").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"))
    nodes = written(nodes.withColumn("width", F.size("embedding")), "nodes")
    sizes = {r["width"]: r["count"] for r in nodes.groupBy("width").count().collect()}
    forests = {}
    for width, n in sizes.items():
        share = min(1.0, sample_rows / n) * (1 << 20)
        picked = nodes.where((F.col("width") == width) & (F.pmod(F.xxhash64("same"), F.lit(1 << 20)) < share)).select("node", "embedding").toArrow()
        picked = picked.sort_by("node").combine_chunks()
        x = unit(matrix(picked.column("embedding"), width)) if picked.num_rows else np.zeros((0, width))
        forests[width] = Forest(x, max(0, int(np.ceil(np.log2(n / leaf)))) if n > leaf else 0, trees, spill, seed)
    shared = vectors.sparkSession.sparkContext.broadcast(forests)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("width").to_numpy(zero_copy_only=False)
            leaves: list = [None] * len(widths)
            for width in np.unique(widths):
                rows = np.flatnonzero(widths == width)
                for i, found in zip(rows, shared.value[width].route(unit(matrix(batch.column("embedding").take(pa.array(rows)), width))), strict=True):
                    leaves[i] = found
            leaves = [(x.astype(np.int64) + FIRST) for x in leaves]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.list_(pa.int64()))], [*batch.schema.names, "leaves"])

    routed = written(nodes.mapInArrow(route, "label " + dict(nodes.dtypes)["label"] + ", same string, node long, weight long, embedding array<double>, width int, leaves array<long>"), "routed")
    routed = split_on(routed, most, spill, seed)
    spread = routed.select("label", "width", F.explode("leaves").alias("leaf"), "node", "weight", "embedding", "leaves")
    large = routed.select("label", "width", F.explode("leaves").alias("leaf")).groupBy("label", "width", "leaf").count().where(F.col("count") > block)
    large = large.select("label", "width", "leaf", F.ceil(F.col("count") / block).cast("int").alias("parts"))
    spread = spread.join(large, ["label", "width", "leaf"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    spread = spread.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    spread = spread.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        leaf = int(pdf["leaf"].iloc[0])
        ids, weight, part = pdf["node"].to_numpy(np.int64), pdf["weight"].to_numpy(np.int64), pdf["part"].to_numpy()
        x = unit(np.stack(pdf["embedding"].to_numpy()).astype(np.float64))
        mask = x @ x.T >= cosine
        np.fill_diagonal(mask, False)
        if pdf["i"].iloc[0] != pdf["j"].iloc[0]:
            mask &= part[:, None] != part[None, :]
        live = mask.any(axis=1)
        if not live.any():
            return pd.DataFrame({"node": ids[:0], "links": ids[:0], "root": ids[:0]})
        ids, weight, mask = ids[live], weight[live], mask[np.ix_(live, live)]
        lists = [a[a < leaf] for a in pdf["leaves"].to_numpy()[live]]
        earlier = np.unique(np.concatenate(lists))
        met = np.zeros((len(ids), len(earlier)), np.float32)
        for i, a in enumerate(lists):
            met[i, np.searchsorted(earlier, a)] = 1
        return pd.DataFrame({"node": ids, "links": (mask & (met @ met.T == 0)) @ weight, "root": _local_roots(mask, ids)})

    found = written(spread.groupBy("label", "width", "leaf", "i", "j").applyInPandas(compare, "node long, links long, root long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
    named = nodes.select("label", "same", "node", "weight").join(links, "node", "left").join(roots, "node", "left")
    named = named.select("label", "same", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("root", "node").alias("component"))
    out = rows.drop("embedding").join(named.withColumn("sound", F.lit(True)), ["label", "same", "sound"], "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
