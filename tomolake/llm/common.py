"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomolake.operators.graph import connected_components
from tomolake.sources.shared import drop_path, dropped_after, new_path, written

__all__ = ["SLICE", "connected_components", "drop_path", "dropped_after", "filtered", "fold", "give_back", "held_out", "new_path", "numbered", "open_fs", "slices", "texts_of", "written"]


#: Bytes of text that a task works on at a time.
SLICE = 1 << 20


@cache
def _libc() -> ctypes.CDLL | None:
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def give_back() -> None:
    """Freed memory goes back to the system: Python workers live on from task to task and stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_libc(), "malloc_trim", None)
    if trim:
        trim(0)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow file system and inner path of a URI, for tasks that read or write files of their own."""
    if urlparse(uri).scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(uri).path
    return pafs.FileSystem.from_uri(uri)


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; 0 marks held-out rows."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def held_out(doc_id: str = "doc_id") -> Column:
    """False for a null id: such a row has no label to learn from either."""
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], text: str, budget: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about `budget` bytes of text (one row at least), to bound memory.

    At the end of the task, memory is given back.
    """
    for batch in batches:
        n = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start, size = 0, 0
        for i in range(batch.num_rows):
            if i > start and size + n[i] > budget:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += int(n[i])
        if start < batch.num_rows:
            yield batch.slice(start)
    give_back()


def texts_of(batch: pa.RecordBatch, text: str) -> pa.Array:
    return pc.fill_null(batch.column(text), "")


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs written with a number for each row, in a column of a name that docs doesn't have; and that name."""
    name = "__row"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def filtered(docs: DataFrame, keep: Callable[[], Callable[[pa.Array], np.ndarray]], text: str = "text") -> DataFrame:
    """The rows of docs whose text keep() accepts: it is called once a task and returns a function of texts to flags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accept = keep()
        for batch in slices(batches, text):
            yield batch.filter(pa.array(accept(pc.cast(texts_of(batch, text), pa.string())), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
