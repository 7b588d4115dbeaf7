"""Connected components and shortest paths on edge tables."""

from __future__ import annotations

from heapq import heapify, heappop, heappush
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomolake.sources.shared import drop_path, new_path, replaced, written

#: Nodes of a block, and sources that a task walks through it.
NODES = 1 << 14
SOURCES = 32


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge (a, b), of any orderable type; root is the least node reachable.

    Alternates the large-star and small-star steps on the edge table until it is a set of stars. A step is a
    map-side combined minimum and an equi-join, which adaptive execution splits where one node has many edges;
    each round is written to the shared folder. Self-loops and edges with a null end are ignored.
    """
    spark = edges.sparkSession
    e = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    path, mark = None, None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        old, path = path, new_path(spark, "stars")
        small.write.parquet(path)
        e = spark.read.schema(small.schema).parquet(path)
        if old:
            drop_path(spark, old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = now


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, distance) over undirected weighted edges (a, b, w), for each of the sources (source).

    Relaxes all frontiers at once and writes each round, until a round improves nothing.
    """
    both = written(edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "arcs")
    known = written(sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("distance")).distinct(), "distances")
    frontier = known
    while True:
        reached = frontier.join(both, F.col("node") == F.col("a")).groupBy("source", F.col("b").alias("node")).agg(F.min(F.col("distance") + F.col("w")).alias("new"))
        better = reached.join(known, ["source", "node"], "left").where("distance IS NULL OR new < distance - 1e-12")
        frontier = written(better.select("source", "node", F.col("new").alias("distance")), "frontier")
        if frontier.isEmpty():
            return known
        known = written(known.unionByName(frontier).groupBy("source", "node").agg(F.min("distance").alias("distance")), "distances")


def _ranged(rows: DataFrame, size: int, keys: list[str], name: str) -> tuple[DataFrame, int]:
    """rows in ranges of the keys of about the given size, numbered by the column `name`, and how many ranges there are."""
    n = -(-rows.count() // size) or 1
    return written(rows.repartitionByRange(n, *keys).withColumn(name, F.spark_partition_id()), name), n


def _reached(near: dict[Any, list], starts: list[tuple[float, Any]], limit: float) -> dict[Any, float]:
    """Distances below the limit over the arcs near (node: [(other, w)]) from starts (distance, node)."""
    best: dict[Any, float] = {}
    heapify(starts)
    while starts:
        d, node = heappop(starts)
        if node not in best:
            best[node] = d
            for other, w in near.get(node, ()):
                if other not in best and d + w < limit:
                    heappush(starts, (d + w, other))
    return best


def paths_within(edges: DataFrame, sources: DataFrame, targets: DataFrame, limit: float, places: DataFrame | None = None) -> DataFrame:
    """(source, node, distance) of the shortest paths shorter than the limit from the sources (source) to the targets (node).

    Edges are undirected (a, b, w), w not below 0. Nodes are dealt into blocks of about NODES by their place (places: node, place;
    near nodes should have near ones, which saves rounds and changes no result), sources into chunks of about SOURCES. A
    task walks the arcs of one block for one chunk, from where paths enter it to where they leave it, and a round takes all
    blocks that were entered anew or by shorter ways. What is kept is each source's distance to the nodes where paths enter
    a block; targets are read off once that no longer changes.
    """
    short = edges.where(F.col("w") < limit).where("a != b")
    arcs = written(short.select("a", "b", "w").unionByName(short.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.min("w").alias("w")), "arcs")
    nodes = arcs.select(F.col("a").alias("node")).distinct()
    nodes = nodes.withColumn("place", F.col("node")) if places is None else nodes.join(places.groupBy("node").agg(F.min("place").alias("place")), "node", "left")
    nodes, many = _ranged(nodes, NODES, ["place", "node"], "block")
    sources, targets = sources.select("source").distinct(), targets.select("node").distinct()
    start, chunks = _ranged(sources.join(nodes, F.col("source") == F.col("node")), SOURCES, ["place", "node"], "chunk")
    for end, block in (("a", "block"), ("b", "beyond")):
        arcs = arcs.join(nodes.select(F.col("node").alias(end), F.col("block").alias(block)), end)
    ends = targets.join(nodes, "node").groupBy("block").agg(F.collect_list("node").alias("ends"))
    packed = arcs.groupBy("block").agg(F.collect_list(F.struct("a", "b", "w", "beyond")).alias("arc")).select("block", "arc.a", "arc.b", "arc.w", "arc.beyond")
    packed = written(packed.join(ends, "block", "left"), "packed")
    kind = dict(nodes.dtypes)["node"]
    schema = f"chunk int, source {kind}, block int, node {kind}, distance double"
    tasks = max(chunks, edges.sparkSession.sparkContext.defaultParallelism)

    def walked(entries: DataFrame, leaving: bool) -> DataFrame:
        """Where paths from the entries enter other blocks, or the targets that they reach in their own."""

        def walk(key: tuple[pa.Scalar, ...], entered: pa.Table, blocks: pa.Table) -> pa.Table:
            chunk, block = (k.as_py() for k in key)
            near, out, starts, rows = {}, {}, {}, []
            for a, b, w, beyond in zip(*(blocks[c][0].as_py() for c in ("a", "b", "w", "beyond")), strict=True):
                if beyond == block:
                    near.setdefault(a, []).append((b, w))
                elif leaving:
                    out.setdefault(a, []).append((b, w, beyond))
            for source, node, distance in zip(*(entered[c].to_pylist() for c in ("source", "node", "distance")), strict=True):
                starts.setdefault(source, []).append((distance, node))
            wanted = [] if leaving else blocks["ends"][0].as_py() or []
            for source, first in starts.items():
                best = _reached(near, first, limit)
                rows += [(chunk, source, block, node, best[node]) for node in wanted if node in best and node != source]
                left: dict[Any, tuple[float, int]] = {}
                for a in out.keys() & best.keys():
                    for b, w, beyond in out[a]:
                        if best[a] + w < limit:
                            left[b] = min(left.get(b, (limit, beyond)), (best[a] + w, beyond))
                rows += [(chunk, source, beyond, node, d) for node, (d, beyond) in left.items()]
            return pa.table([pa.array([r[i] for r in rows], entered.schema.field(c).type) for i, c in enumerate(columns)], names=columns)

        columns = ["chunk", "source", "block", "node", "distance"]
        met = entries.select("chunk", "block").distinct().join(packed, "block").withColumnsRenamed({"chunk": "at_chunk", "block": "at_block"})
        # A task has little to read and much to walk: so many of them, whatever the size of their rows.
        came = entries.select(*columns).repartition(tasks, "chunk", "block").groupBy("chunk", "block")
        return came.cogroup(met.repartition(tasks, "at_chunk", "at_block").groupBy("at_chunk", "at_block")).applyInArrow(walk, schema)

    fresh = F.lit(limit > 0)
    known, path = replaced(start.where(fresh).select("chunk", "source", "block", "node", F.lit(0.0).alias("distance"), fresh.alias("fresh")), "entered")
    while many > 1 and not known.where("fresh").isEmpty():
        both = known.withColumn("fresh", F.lit(False)).unionByName(walked(known.where("fresh"), True).withColumn("fresh", F.lit(True)))
        # The shorter of what was known and what has arrived; at equal lengths what was known.
        shorter = both.groupBy("chunk", "source", "block", "node").agg(F.min(F.struct("distance", "fresh")).alias("m")).select("chunk", "source", "block", "node", "m.*")
        known, path = replaced(shorter, "entered", path)
    found = walked(known, False).select("source", "node", "distance")
    own = sources.join(targets, F.col("source") == F.col("node")).where(fresh).select("source", "node", F.lit(0.0).alias("distance"))
    return written(found.unionByName(own), "settled")


def dominated(pairs: DataFrame) -> DataFrame:
    """(node) of all that a pass from the strongest on drops, if it keeps what it meets and drops all that this dominates.

    pairs: (winner, loser), without circles. In rounds: who loses to nobody undecided stays, and all it dominates go, with
    their pairs. Of those left somebody always loses to nobody.
    """
    spark = pairs.sparkSession
    left, path = replaced(pairs.select("winner", "loser"), "undecided")
    gone = new_path(spark, "gone")
    left.select(F.col("loser").alias("node")).limit(0).write.parquet(gone)
    while not left.isEmpty():
        beaten = left.select(F.col("loser").alias("winner")).distinct()
        out, lost = replaced(left.join(beaten, "winner", "left_anti").select(F.col("loser").alias("node")).distinct(), "lost")
        out.write.mode("append").parquet(gone)
        for end in ("winner", "loser"):
            left = left.join(out.select(F.col("node").alias(end)), end, "left_anti")
        left, path = replaced(left.select("winner", "loser"), "undecided", path)
        drop_path(spark, lost)
    return spark.read.schema(pairs.select(F.col("loser").alias("node")).schema).parquet(gone)
