"""Token counts kept as additive totals by source, language and tokenizer version.

Changes come in batches: signed rows for inserts, deletes and revised counts. A batch is summed by group and written
under a name of its own attempt; one rename to the folder of its id commits it, which only one writer can do. Committing
an id again changes nothing, and an attempt that broke off is never read. Totals are one scan over the committed batches;
compaction puts their sum in the place of those read so far.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomolake.llm.common import drop_path, new_path, slices, texts_of, written

KEYS = ["source", "lang", "tokenizer_version"]
SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
DEFAULT_VERSIONS = {"byte_bpe_50k": "/opt/tokenizers/byte_bpe_50k.tiktoken", "byte_bpe_multi_50k": "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"}
#: Fixed value: how the two vocabularies divide a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space other than a space, followed by a space: such texts aren't divided at spaces.
MIXED = "[\t\n\x0b\x0c\r\x1c-\x1f\x85   -     　] "


@cache
def encoding(name: str, path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: pa.Array, encodings: list[tiktoken.Encoding]) -> np.ndarray:
    """Tokens of each text (rows) in each encoding (columns). Distinct words of the texts are encoded once."""
    lists = pc.split_pattern_regex(texts, " ")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(pc.list_flatten(lists))
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    index, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    owner = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(sizes) - sizes
    odd = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.match_substring_regex(texts, MIXED), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))).to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), len(encodings)), np.int64)
    for k, enc in enumerate(encodings):
        spaced = np.fromiter((len(enc.encode_ordinary(" " + w)) for w in words), np.int64, len(words))
        out[:, k] = np.bincount(owner, spaced[index], minlength=len(sizes))
        lead = index[np.minimum(first, max(0, len(index) - 1))] if len(index) else np.zeros(len(sizes), np.int64)
        bare = {i: len(enc.encode_ordinary(words[i])) for i in np.unique(lead).tolist()}
        out[:, k] += np.array([bare[i] - spaced[i] for i in lead.tolist()], np.int64).reshape(-1)
        for i in np.flatnonzero(odd):
            out[i, k] = len(enc.encode_ordinary(texts[int(i)].as_py()))
    return out


def token_counts(docs: DataFrame, versions: dict[str, str] = DEFAULT_VERSIONS) -> DataFrame:
    """doc_id, source, lang, digest of the text, and a column of token counts for each version. Null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encodings = [encoding(name, path) for name, path in versions.items()]
        for batch in slices(batches, "text"):
            counts = count_tokens(texts_of(batch, "text"), encodings)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "lang", "digest")), *(pa.array(counts[:, k]) for k in range(len(encodings)))], ["doc_id", "source", "lang", "digest", *versions])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.sha2("text", 256).alias("digest"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, source string, lang string, digest string, " + ", ".join(f"`{v}` long" for v in versions))


def inserts(counts: DataFrame, version: str, docs: str | Column = "1") -> DataFrame:
    """Signed rows that add documents with their counts under a version; docs: how many a row of counts stands for."""
    n = (F.expr(docs) if isinstance(docs, str) else docs).cast("long")
    return counts.select("source", "lang", F.lit(version).alias("tokenizer_version"), n.alias("n_docs"), (n * F.col(f"`{version}`")).alias("n_tokens"))


def deletes(counts: DataFrame, version: str, docs: str | Column = "1") -> DataFrame:
    return inserts(counts, version, docs).withColumns({"n_docs": -F.col("n_docs"), "n_tokens": -F.col("n_tokens")})


def revisions(counts: DataFrame, old: str, new: str, docs: str | Column = "1") -> DataFrame:
    """Signed rows that take counts back under one version and put them in under another (or corrected ones)."""
    return deletes(counts, old, docs).unionByName(inserts(counts, new, docs))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Rollup:
    """The totals under one folder, which all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "rollup")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self) -> list[str]:
        """Folders that were committed."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [x.getPath().getName() for x in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(n for n in found if n.startswith(("batch-", "sum-")))

    def _live(self) -> tuple[list[str], set[str]]:
        """Folders that make up the totals, and the names of all batches they stand for."""
        names = self._names()
        sums = [n for n in names if n.startswith("sum-")]
        if not sums:
            return names, set(names)
        held = {r["name"] for r in self.spark.read.parquet(f"{self.path}/{sums[-1]}/names").collect()}
        rest = {n for n in names if n.startswith("batch-")} - held
        return [f"{sums[-1]}/rows", *sorted(rest)], held | rest

    def _rename(self, attempt: str, name: str) -> bool:
        """False where the name is taken: of several writers one succeeds."""
        jvm = self.spark._jvm
        final = self._path(name)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self._path(attempt), final, self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError:
            if name in self._names():
                return False
            raise
        return True

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Adds a batch; False, and no change, if the id was committed before, also by another writer in the meantime.

        An id sent again with other sums is an error, as long as its batch has not been dropped after compaction.
        """
        attempt, name = f"_attempt-{uuid.uuid4().hex}", f"batch-{batch_id}"
        _summed(deltas).write.parquet(f"{self.path}/{attempt}")
        known = name in self._live()[1] or not self._rename(attempt, name)
        if known and name in self._names():
            now, before = (self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{n}") for n in (attempt, name))
            if not (now.exceptAll(before).isEmpty() and before.exceptAll(now).isEmpty()):
                raise ValueError(f"batch {batch_id} was committed with other counts")
        if known:
            drop_path(self.spark, f"{self.path}/{attempt}")
        return not known

    def compact(self) -> None:
        """Puts the sum of all committed batches in their place, under a name that sorts last; ids stay known."""
        paths, names = self._live()
        if len(paths) < 2:
            return
        sums = [n for n in self._names() if n.startswith("sum-")]
        attempt = f"_attempt-{uuid.uuid4().hex}"
        _summed(self._rows(paths)).write.parquet(f"{self.path}/{attempt}/rows")
        self.spark.createDataFrame([(n,) for n in sorted(names)], "name string").write.parquet(f"{self.path}/{attempt}/names")
        self._rename(attempt, f"sum-{int(sums[-1][4:]) + 1 if sums else 1:08d}")

    def _rows(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/{p}" for p in paths)) if paths else self.spark.createDataFrame([], SCHEMA)

    def totals(self) -> DataFrame:
        """KEYS, n_docs, n_tokens. Null sources and languages are groups of their own; groups that sum to nothing stay."""
        return _summed(self._rows(self._live()[0]))


def maintained_totals(docs: DataFrame, versions: dict[str, str] = DEFAULT_VERSIONS) -> DataFrame:
    """Totals after three batches: all documents come in under the first version; rows that repeat the text of one
    with a smaller doc_id (or the same, or any where theirs is null) go; the rest is counted anew under the second.
    The second batch is sent twice, and counts once.

    Null texts have no tokens and repeat nothing; empty texts repeat each other. Other columns of docs, whatever their
    names, are left out. An empty table has no totals.
    """
    spark, (old, new) = docs.sparkSession, list(versions)
    counts = written(token_counts(docs, versions), "token_counts")
    # Copies are summed within their text, source and language before texts meet: no text is a hot key of a join.
    named = counts.groupBy("digest", "source", "lang", "doc_id", *(f"`{v}`" for v in versions)).agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    groups = named.groupBy("digest", "source", "lang", *(f"`{v}`" for v in versions)).agg(F.sum("n").alias("n"), least.alias("least"))
    first = groups.where("digest IS NOT NULL").groupBy("digest").agg(F.min("least.doc_id").alias("first"), F.sum("n").alias("copies")).where("copies > 1")
    stay = F.when(F.col("copies").isNull(), F.col("n")).when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    groups = written(groups.join(first, "digest", "left").withColumn("stay", stay.cast("long")).drop("least", "first", "copies"), "groups")
    state = Rollup(spark)
    state.commit("1-inserts", inserts(groups, old, "n"))
    for _ in range(2):
        state.commit("2-deletes", deletes(groups.where("n > stay"), old, "n - stay"))
    state.commit("3-revisions", revisions(groups.where("stay > 0"), old, new, "stay"))
    return state.totals()
