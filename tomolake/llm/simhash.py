"""Near-duplicate texts by SimHash fingerprints and a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes. Two that differ in at most two bits share at least six of them, so with the
bytes grouped in four neighbouring pairs, at least two pairs are equal as a whole. The index therefore posts each
distinct fingerprint under the six combinations of two pairs: every posting key holds four positional bytes. (A list
per single byte would hold 1/256 of all fingerprints and grow quadratically.) For each pair of fingerprints on a list
the shared positional bytes are tallied, pairs with at least six are retained, and the bits of those are verified.

A list longer than `hot` is not paired: its fingerprints link through the 65 values within one bit of each, since two
values lie within two bits of each other exactly when they have such a neighbour in common. That is exact as well, and
linear. Equal fingerprints collapse to one node before anything is compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomolake.llm.common import connected_components, numbered, slices, texts_of, written

BITS = 2
LEAST_BYTES = 8 - BITS
COMBINATIONS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
BLOCK = 1 << 15


def simhash(data: bytes, width: int = 3) -> bytes:
    """Eight bytes, the fingerprint of a text in UTF-8; zero where it has no word."""
    words = data.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return bytes(8)
    line, count = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:count].tolist()
    ends = ends[-count:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, count, BLOCK):
        h = np.fromiter((digest(line[i:j], 42) for i, j in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)), np.uint64, min(BLOCK, count - at))
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > count).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every row; null and empty texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = [int.from_bytes(simhash(x.as_buffer().to_pybytes() if x.is_valid else b""), "big", signed=True) for x in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps, pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def _pair(i: int) -> Column:
    return F.shiftrightunsigned("fp", 48 - 16 * i).bitwiseAND(0xFFFF)


def similar_links(nodes: DataFrame, hot: int = 64) -> DataFrame:
    """Links (a, b) between nodes (node long, fp long), one node for each distinct fp.

    From lists of at most `hot` nodes, every pair within BITS bits; from longer lists, links that connect the same
    nodes. No link joins fingerprints that are further apart.
    """
    keys = F.array(*[F.struct(F.lit(k).alias("k"), (_pair(i) * 65536 + _pair(j) + (k << 32)).alias("key")) for k, (i, j) in enumerate(COMBINATIONS)])
    posted = nodes.where("node IS NOT NULL").select("node", "fp", F.inline(keys))
    live = written(posted.join(posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"), "postings")
    cold = live.where(F.col("n") <= hot)
    x = F.col("fp").bitwiseXOR(F.col("fp2"))
    tally = reduce(add, [(F.shiftrightunsigned(x, 8 * i).bitwiseAND(0xFF) == 0).cast("int") for i in range(8)])
    same = [F.shiftrightunsigned(x, 48 - 16 * i).bitwiseAND(0xFFFF) == 0 for i in range(4)]
    first = F.coalesce(*[F.when(same[i] & same[j], k) for k, (i, j) in enumerate(COMBINATIONS)])
    pairs = cold.alias("l").join(cold.select("key", F.col("node").alias("node2"), F.col("fp").alias("fp2")), "key").where("node < node2")
    pairs = pairs.where(first == F.col("k")).where(tally >= LEAST_BYTES).where(F.bit_count(x) <= BITS).select(F.col("node").alias("a"), F.col("node2").alias("b"))
    crowd = live.where(F.col("n") > hot).select("node", "fp").distinct()
    near = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    balls = crowd.select("node", F.explode(near).alias("ball"))
    met = balls.groupBy("ball").agg(F.collect_set("node").alias("nodes")).where(F.size("nodes") > 1)  # 65 nodes at most
    stars = met.select(F.explode("nodes").alias("a"), F.array_min("nodes").alias("b")).where("a <> b").distinct()
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = 64) -> DataFrame:
    """(id, fp, component) of every row: component is the smallest id reachable over links of at most two bits.

    Null and empty texts share fingerprint zero and link like any others. Rows with a null id get the component of
    their fingerprint (null where no row of it has an id). Repeated rows stay repeated. An empty table gives no rows.
    """
    fps = written(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("id").alias("node"))
    roots = connected_components(similar_links(nodes, hot))
    named = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component"))
    return fps.join(named, "fp").select("id", "fp", "component")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, hot: int = 64) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, of several the first in a numbering of the rows.

    Rows are told apart by their number, not by doc_id: rows with repeated or null ids are judged each by its text. A
    row with a null doc_id stays only where no row of its component has an id. Null and empty texts are near-duplicates of
    each other. All columns pass through, whatever their names; an empty table stays empty.
    """
    rows, number = numbered(docs)
    found = near_duplicates(rows, number, hot=hot).select(F.col("id").alias(number), "component")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", number)
    led = rows.select(number, "doc_id").join(found, number)
    first = led.groupBy("component").agg(F.min(order).alias("least"), F.count("*").alias("n")).where("n > 1")
    # Only the numbers of rows that go meet the documents: where they are few, these aren't shuffled.
    gone = written(led.join(first, "component").where(F.col(f"least.{number}") != F.col(number)).select(number), "gone")
    return rows.join(gone, number, "left_anti").select(docs.columns)
