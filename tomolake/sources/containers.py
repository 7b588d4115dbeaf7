"""Volumes in chunked binary files: a data source that reads ranges of chunks by their place, and a writer.

Three layouts, all little-endian, chunks of bytes one after the other in order of z, y, x, padded to whole chunks:

    volume    width, height, depth, chunk side, bits, pixel size, chunks along x, y, z; chunks
    labels    chunk side, chunks along x, y, z; chunks
    combined  width, height, depth, pixel size, materials, whether there are gray values; their chunks; labels as above

A file of any size is read in many tasks: the driver reads headers only and plans ranges of chunks; chunks that a box or a
pushed-down condition on cx, cy, cz rules out are never read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from typing import IO, Any
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tomolake.sources.shared import drop_path, new_path

#: The head of a volume and of labels, and the chunk side of gray values in combined files.
VOLUME_HEAD, LABELS_HEAD, COMBINED_SIDE = struct.Struct("<5id3i"), struct.Struct("<4i"), 256
CHUNKS = "volume_id long, file string, width int, height int, depth int, pixel_size double, side int, cx int, cy int, cz int, payload binary"
MATERIALS = "volume_id long, id int, name string, argb int, min int, max int, is_exterior boolean"
COPIED = 8 << 20


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if urlparse(uri).scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(uri).path
    return pafs.FileSystem.from_uri(uri)


@dataclass(frozen=True)
class Part:
    """Chunks of one kind within a file."""

    volume_id: int
    file: str
    dims: tuple[int, int, int]
    pixel_size: float
    side: int
    offset: int

    @property
    def counts(self) -> tuple[int, int, int]:
        return tuple(-(-n // self.side) for n in self.dims)

    @property
    def size(self) -> int:
        return int(np.prod(self.counts)) * self.side**3


@dataclass(frozen=True)
class Combined:
    gray: Part | None
    labels: Part
    materials: list[tuple]


def _checked(part: Part, size: int, exact: bool = True) -> Part:
    if min(part.dims) <= 0 or not 0 < part.side <= 1024:  # the size of the file bounds the dims
        raise ValueError(f"{part.file}: dims {part.dims} or a chunk side of {part.side} are out of range")
    if (part.offset + part.size != size) if exact else (part.offset + part.size > size):
        raise ValueError(f"{part.file}: {size} bytes don't fit {part.dims} in chunks of {part.side}")
    return part


def volume_head(volume_id: int, file: str, source: IO[bytes], size: int) -> Part:
    if size < VOLUME_HEAD.size:
        raise ValueError(f"{file}: {size} bytes don't fit a header")
    w, h, d, side, bits, pixel_size, *counts = VOLUME_HEAD.unpack(source.read(VOLUME_HEAD.size))
    part = _checked(Part(volume_id, file, (w, h, d), pixel_size, side, VOLUME_HEAD.size), size)
    if bits != 8 or tuple(counts) != part.counts or not 0 < pixel_size <= 1:
        raise ValueError(f"{file}: {bits} bits, pixels of {pixel_size} m or {counts} chunks don't fit {part.dims}")
    return part


def labels_head(volume_id: int, file: str, source: IO[bytes], size: int) -> Part:
    if size < LABELS_HEAD.size:
        raise ValueError(f"{file}: {size} bytes don't fit a header")
    side, *counts = LABELS_HEAD.unpack(source.read(LABELS_HEAD.size))
    return _checked(Part(volume_id, file, tuple(n * side for n in counts), 1e-6, side, LABELS_HEAD.size), size)


def combined_head(volume_id: int, file: str, source: IO[bytes], size: int, side: int = COMBINED_SIDE) -> Combined:
    """Materials and the places of both kinds of chunks; the head of the labels may be missing."""

    def take(kind: str) -> Any:
        form = struct.Struct("<" + kind)
        return form.unpack(source.read(form.size))

    w, h, d, pixel_size, n = take("3idi")
    materials = []
    for _ in range(n):
        length, shift = 0, 0
        while True:
            byte = take("B")[0]
            length, shift = length | (byte & 127) << shift, shift + 7
            if byte < 128:
                break
        name = source.read(length).decode()
        argb, low, high, exterior, i = take("iBB?B")
        materials.append((volume_id, i, name, argb, low, high, exterior))
    has_gray, at = take("?")[0], source.tell()
    gray = _checked(Part(volume_id, file, (w, h, d), pixel_size, side, at), size, exact=False) if has_gray else None
    at += gray.size if gray else 0
    labels = Part(volume_id, file, (w, h, d), pixel_size, side, at)
    if at + labels.size == size:
        return Combined(gray, labels, materials)
    source.seek(at)
    own, *counts = take("4i")
    labels = _checked(replace(labels, side=own, offset=at + LABELS_HEAD.size), size)
    if tuple(counts) != labels.counts:
        raise ValueError(f"{file}: {counts} chunks of labels don't fit {labels.dims}")
    return Combined(gray, labels, materials)


def heads(path: str, layout: str, side: int = COMBINED_SIDE) -> list[Part | Combined]:
    """The heads of the files at a path or in a folder, numbered from 1 in order of their paths."""
    fs, root = open_fs(path)
    info = fs.get_file_info(root)
    found = [info] if info.is_file else sorted((f for f in fs.get_file_info(pafs.FileSelector(root)) if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
    out = []
    for k, f in enumerate(found, 1):
        with fs.open_input_file(f.path) as source:
            out.append({"volume": volume_head, "labels": labels_head, "combined": combined_head}[layout](k, f.path, source, f.size, *([side] if layout == "combined" else [])))
    return out


@dataclass
class Chunks(InputPartition):
    """Chunks [first, stop) of a part, as far as they are among the wanted."""

    part: Part
    first: int
    stop: int


class VolumeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.layout, self.kind = options["path"], options.get("layout", "volume"), options.get("part", "gray")
        self.split_bytes, self.side = int(options.get("split_bytes", 64 << 20)), int(options.get("side", COMBINED_SIDE))
        self.box = [int(x) for x in options["box"].split(",")] if options.get("box") else None
        self.low, self.high = [0, 0, 0], [1 << 30] * 3  # of cx, cy, cz; high excluded

    def wanted(self, part: Part) -> np.ndarray:
        """The numbers of the chunks that the box and the conditions leave."""
        nx, ny, nz = part.counts
        low, high = list(self.low), [min(h, n) for h, n in zip(self.high, (nx, ny, nz), strict=True)]
        if self.box:
            low = [max(a, b // part.side) for a, b in zip(low, self.box[:3], strict=True)]
            high = [min(a, -(-b // part.side)) for a, b in zip(high, self.box[3:], strict=True)]
        x, y, z = (np.arange(a, max(a, b)) for a, b in zip(low, high, strict=True))
        return ((z[:, None, None] * ny + y[None, :, None]) * nx + x[None, None, :]).ravel()

    def partitions(self) -> list[Chunks]:
        out = []
        for head in heads(self.path, self.layout, self.side):
            part = head if isinstance(head, Part) else head.gray if self.kind == "gray" else head.labels
            if part is None:
                continue
            n, each = int(np.prod(part.counts)), max(1, self.split_bytes // part.side**3)
            starts = np.unique(self.wanted(part) // each)  # ranges that hold none aren't planned
            out += [Chunks(part, int(s) * each, min(n, (int(s) + 1) * each)) for s in starts]
        return out

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        part = partition.part
        nx, ny, _ = part.counts
        want = self.wanted(part)
        fs, _ = open_fs(self.path)
        with fs.open_input_file(part.file) as source:
            for i in want[(want >= partition.first) & (want < partition.stop)].tolist():
                source.seek(part.offset + i * part.side**3)
                row = {"volume_id": part.volume_id, "file": part.file, "width": part.dims[0], "height": part.dims[1], "depth": part.dims[2], "pixel_size": part.pixel_size, "side": part.side, "cx": i % nx, "cy": i // nx % ny, "cz": i // (nx * ny), "payload": source.read(part.side**3)}
                yield pa.RecordBatch.from_pylist([row], schema=_ARROW)


class PrunedReader(VolumeReader):
    """A reader for sessions with spark.sql.python.filterPushdown.enabled."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on cx, cy, cz narrow what is read; Spark applies all conditions again."""
        for f in filters:
            if getattr(f, "attribute", None) in (("cx",), ("cy",), ("cz",)):
                a = "xyz".index(f.attribute[0][1])
                least, stop = {EqualTo: lambda v: (v, v + 1), GreaterThan: lambda v: (v + 1, 1 << 30), GreaterThanOrEqual: lambda v: (v, 1 << 30), LessThan: lambda v: (0, v), LessThanOrEqual: lambda v: (0, v + 1), In: lambda v: (min(v), max(v) + 1) if v else (0, 0)}.get(type(f), lambda v: (0, 1 << 30))(f.value if hasattr(f, "value") else None)
                self.low[a], self.high[a] = max(self.low[a], least), min(self.high[a], stop)
            yield f


_ARROW = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in CHUNKS.split(", "))])


class VolumeFiles(DataSource):
    """spark.read.format("chunked_volume"): path, layout (volume, labels, combined), part (gray, labels), box, split_bytes, side."""

    @classmethod
    def name(cls) -> str:
        return "chunked_volume"

    def schema(self) -> str:
        return CHUNKS

    def reader(self, schema: Any) -> VolumeReader:
        return (PrunedReader if self.options.get("pushdown") == "true" else VolumeReader)(self.options)


def read_chunks(spark: SparkSession, path: str, layout: str = "volume", part: str = "gray", box: Sequence[int] | None = None, split_bytes: int = 64 << 20, side: int = COMBINED_SIDE) -> DataFrame:
    """A row for each chunk of the files. box: x, y, z from (included) and to (excluded); chunks it doesn't touch aren't read."""
    spark.dataSource.register(VolumeFiles)
    reader = spark.read.format("chunked_volume").options(layout=layout, part=part, split_bytes=str(split_bytes), side=str(side), pushdown=spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    return (reader.option("box", ",".join(map(str, box))) if box else reader).load(path)


def chunk_voxels(chunks: DataFrame, value: str = "gray") -> DataFrame:
    """(volume_id, x, y, z, value) of chunks, a slab of each at a time, without the padding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                volume, w, h, d, s, cx, cy, cz = (batch.column(c)[r].as_py() for c in ("volume_id", "width", "height", "depth", "side", "cx", "cy", "cz"))
                cube = np.frombuffer(batch.column("payload")[r].as_buffer(), np.uint8).reshape(s, s, s)
                nx, ny, nz = (min(s, n - c * s) for n, c in ((w, cx), (h, cy), (d, cz)))
                y, x = (a.ravel() for a in np.indices((ny, nx)))
                for k in range(nz):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), volume)), pa.array(x + cx * s), pa.array(y + cy * s), pa.array(np.full(len(x), k + cz * s)), pa.array(cube[k, :ny, :nx].ravel().astype(np.int64))], ["volume_id", "x", "y", "z", "value"])

    return chunks.drop("file", "pixel_size").mapInArrow(run, "volume_id long, x long, y long, z long, value long").withColumnRenamed("value", value)


def read_combined(spark: SparkSession, path: str, box: Sequence[int] | None = None, side: int = COMBINED_SIDE) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of combined files: headers, materials, gray values (no rows of files without) and labels as voxels."""
    found = heads(path, "combined", side)
    head = [(c.labels.volume_id, c.labels.file, *c.labels.dims, c.labels.pixel_size, c.gray is not None) for c in found]
    headers = spark.createDataFrame(head, "volume_id long, file string, width int, height int, depth int, pixel_size double, has_gray boolean")
    materials = spark.createDataFrame([m for c in found for m in c.materials], MATERIALS)
    return headers, materials, *(chunk_voxels(read_chunks(spark, path, "combined", p, box, side=side), v) for p, v in (("gray", "gray"), ("labels", "label")))


def _name(text: str) -> bytes:
    data = text.encode()
    n, head = len(data), b""
    while n > 127:
        head, n = head + bytes([n & 127 | 128]), n >> 7
    return head + bytes([n]) + data


def _written_parts(chunks: DataFrame, folder: str, counts: Sequence[int], parts: int) -> list[tuple[int, int, str]]:
    """Ranges of chunks (cx, cy, cz, payload) written as files of their own: first chunk, chunk after the last, name."""
    nx, ny, nz = counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        name, first, after, out = f"{root}/{uuid.uuid4().hex}", None, None, None
        for batch in batches:
            for at, payload in zip(batch.column("at").to_pylist(), batch.column("payload"), strict=True):
                if out is None:
                    out, first, after = fs.open_output_stream(name), at, at
                data = payload.as_buffer()
                for _ in range(after, at):
                    out.write(bytes(len(data)))  # chunks without a row
                out.write(data)
                after = at + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"first": first, "after": after, "name": name}])

    at = ((F.col("cz") * ny + F.col("cy")) * nx + F.col("cx")).cast("long")
    ranged = chunks.select(at.alias("at"), "payload").where(f"at < {nx * ny * nz}").repartitionByRange(parts, "at").sortWithinPartitions("at")
    return sorted((r["first"], r["after"], r["name"]) for r in ranged.mapInArrow(run, "first long, after long, name string").collect())


def write_file(path: str, layout: str, dims: Sequence[int], pixel_size: float, side: int, gray: DataFrame | None = None, labels: DataFrame | None = None, materials: Sequence[tuple] = (), parts: int = 64) -> None:
    """One file of a layout from chunks (cx, cy, cz, payload of side**3 bytes); missing chunks are zeros.

    materials: (id, name, argb, min, max, is_exterior). Ranges of chunks are written in parallel beside each other; one task then
    strings them together through a buffer of fixed size, under a temporary name until all is there.
    """
    spark = (gray if gray is not None else labels).sparkSession
    counts = [-(-n // side) for n in dims]
    label_head = LABELS_HEAD.pack(side, *counts)
    if layout == "volume":
        plan = [(VOLUME_HEAD.pack(*dims, side, 8, pixel_size, *counts), gray)]
    elif layout == "labels":
        plan = [(label_head, labels)]
    else:
        head = struct.pack("<3idi", *dims, pixel_size, len(materials)) + b"".join(_name(name) + struct.pack("<iBB?B", argb, low, high, exterior, i) for i, name, argb, low, high, exterior in materials)
        plan = [(head + struct.pack("<?", gray is not None), gray), (label_head, labels)]
    folder = new_path(spark, "chunk_ranges")
    pieces = [(head, _written_parts(chunks, f"{folder}/{k}", counts, parts) if chunks is not None else None) for k, (head, chunks) in enumerate(plan)]
    n, each = int(np.prod(counts)), side**3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            fs, root = open_fs(path)
            fs.create_dir(root.rpartition("/")[0], recursive=True)
            source_fs, _ = open_fs(folder)
            temporary = f"{root}.{uuid.uuid4().hex}.part"
            with fs.open_output_stream(temporary) as out:
                for head, ranges in pieces:
                    out.write(head)
                    at = 0
                    for first, after, name in [*ranges, (n, n, "")] if ranges is not None else []:
                        for _ in range(at, first):
                            out.write(bytes(each))
                        if name:
                            with source_fs.open_input_stream(name) as source:
                                while data := source.read(COPIED):
                                    out.write(data)
                        at = after
            fs.move(temporary, root)
            yield pa.RecordBatch.from_pylist([{"done": 1}])

    spark.range(0, 1, 1, 1).mapInArrow(run, "done long").collect()
    drop_path(spark, folder)
