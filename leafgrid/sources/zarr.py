"""Zarr arrays as a Spark data source: chunk grids with JSON metadata of formats 2 and 3, read by chunks and written by tasks that
own whole chunks."""

from __future__ import annotations

import gzip
import itertools
import json
import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from leafgrid.sources.folders import Folder
from leafgrid.sources.geotiff import span
from leafgrid.sources.windows import PushedWindow, wants

# Names of metadata files, of dimensions in attributes, and of the numbers that JSON lacks.
ARRAY_2, GROUP_2, ATTRIBUTES_2, NODE_3 = ".zarray", ".zgroup", ".zattrs", "zarr.json"
DIMENSIONS = "_ARRAY_DIMENSIONS"
SPECIAL = {"NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}


def _zstd():
    import zstandard

    return zstandard


PACK = {None: lambda d: d, "zlib": lambda d: zlib.compress(d, 1), "gzip": lambda d: gzip.compress(d, 5, mtime=0), "zstd": lambda d: _zstd().ZstdCompressor().compress(d)}
UNPACK = {None: lambda d: d, "zlib": zlib.decompress, "gzip": gzip.decompress, "zstd": lambda d: _zstd().ZstdDecompressor().decompressobj().decompress(d)}


@dataclass(frozen=True)
class Layout:
    """What the metadata of an array says."""

    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: np.dtype
    fill: float | int | bool = 0
    codec: str | None = "zlib"
    version: int = 2
    dims: tuple[str, ...] = ()
    order: tuple[int, ...] = ()  # of the axes in the chunks' bytes
    prefix: str = ""
    separator: str = "."
    attributes: dict = field(default_factory=dict)

    def __post_init__(self):
        if not self.dims:
            object.__setattr__(self, "dims", tuple(f"dim_{i}" for i in range(len(self.shape))))
        if not self.order:
            object.__setattr__(self, "order", tuple(range(len(self.shape))))

    @property
    def grid(self) -> tuple[int, ...]:
        return tuple(-(-s // c) for s, c in zip(self.shape, self.chunks, strict=True))

    def key(self, index: tuple[int, ...]) -> str:
        return self.prefix + self.separator.join(map(str, index)) if index else (self.prefix.rstrip("/") or "0")

    def empty(self) -> np.ndarray:
        return np.full(self.chunks, self.fill, self.dtype)

    def pack(self, chunk: np.ndarray) -> bytes:
        return PACK[self.codec](np.ascontiguousarray(chunk.astype(self.dtype, copy=False).transpose(self.order)).tobytes())

    def unpack(self, data: bytes | None) -> np.ndarray:
        """A chunk; one that isn't there holds the fill value. Chunks at the edges are whole in the file."""
        if data is None:
            return self.empty()
        raw = np.frombuffer(UNPACK[self.codec](data), self.dtype)
        return raw.reshape([self.chunks[a] for a in self.order]).transpose(np.argsort(self.order))

    def is_fill(self, values: np.ndarray) -> np.ndarray:
        return np.isnan(values) if isinstance(self.fill, float) and math.isnan(self.fill) else values == self.fill

    def is_empty(self, chunk: np.ndarray) -> bool:
        return bool(self.is_fill(chunk).all())

    def documents(self) -> dict[str, bytes]:
        """The metadata files of the array, by name."""
        fill = self.fill
        if isinstance(fill, float) and not math.isfinite(fill):
            fill = next(k for k, v in SPECIAL.items() if v == fill or (math.isnan(v) and math.isnan(fill)))
        dump = lambda d: json.dumps(d, indent=1).encode()
        if self.version == 2:
            codec = {"id": self.codec, **({"level": 1} if self.codec == "zlib" else {})} if self.codec else None
            array = {"zarr_format": 2, "shape": self.shape, "chunks": self.chunks, "dtype": self.dtype.str, "fill_value": fill, "order": "C", "compressor": codec, "filters": None, "dimension_separator": self.separator}
            return {ARRAY_2: dump(array), ATTRIBUTES_2: dump({**self.attributes, DIMENSIONS: self.dims})}
        codecs = [{"name": "bytes", "configuration": {"endian": "big" if self.dtype.str[0] == ">" else "little"}}]
        if self.codec:
            codecs.append({"name": self.codec, "configuration": {"level": 5}})
        grid = {"name": "regular", "configuration": {"chunk_shape": self.chunks}}
        node = {"zarr_format": 3, "node_type": "array", "shape": self.shape, "data_type": self.dtype.name, "chunk_grid": grid, "fill_value": fill, "codecs": codecs, "dimension_names": self.dims, "attributes": self.attributes}
        return {NODE_3: dump(node | {"chunk_key_encoding": {"name": "default", "configuration": {"separator": self.separator}}})}


def _number(fill, dtype: np.dtype):
    return dtype.type(0 if fill is None else SPECIAL.get(fill, fill) if isinstance(fill, str) else fill).item()


def _known(codec: str | None, path: str) -> str | None:
    if codec not in PACK:
        raise ValueError(f"{path}: chunks by {codec} can't be read; known are {', '.join(filter(None, PACK))} and none")
    return codec


def read_layout(folder: Folder, array: str) -> Layout:
    """The metadata of an array, of either format."""
    documents = {n: d.decode() for n in (ARRAY_2, ATTRIBUTES_2, NODE_3) if (d := folder.read(f"{array}/{n}")) is not None}
    if not documents.keys() & {ARRAY_2, NODE_3}:
        raise FileNotFoundError(f"no Zarr array at {folder.at(array)}")
    if ARRAY_2 not in documents and json.loads(documents[NODE_3]).get("node_type") != "array":
        raise ValueError(f"{folder.at(array)} is a group; name one of its arrays: {', '.join(arrays(folder))}")
    return read_layout_of(documents, folder.at(array))


def read_layout_of(documents: dict[str, str], path: str = "array") -> Layout:
    if ARRAY_2 in documents:
        m, attributes = json.loads(documents[ARRAY_2]), json.loads(documents.get(ATTRIBUTES_2, "{}"))
        if m.get("filters"):
            raise ValueError(f"{path}: filters {m['filters']} can't be read")
        dtype, n = np.dtype(m["dtype"]), len(m["shape"])
        dims = tuple(attributes.pop(DIMENSIONS, ()))
        order = tuple(range(n)) if m.get("order", "C") == "C" else tuple(reversed(range(n)))
        codec = _known(m["compressor"]["id"] if m.get("compressor") else None, path)
        return Layout(tuple(m["shape"]), tuple(m["chunks"]), dtype, _number(m.get("fill_value"), dtype), codec, 2, dims, order, "", m.get("dimension_separator", "."), attributes)
    m = json.loads(documents[NODE_3])
    if m["chunk_grid"]["name"] != "regular":
        raise ValueError(f"{path}: a {m['chunk_grid']['name']} grid can't be read")
    dtype, codec, order = np.dtype(m["data_type"]), None, ()
    for c in m["codecs"]:
        settings = c.get("configuration", {})
        match c["name"]:
            case "bytes":
                dtype = dtype.newbyteorder(">" if settings.get("endian") == "big" else "<")
            case "transpose":
                order = tuple(settings["order"])
            case name:
                codec = _known(name, path)
    encoding = m.get("chunk_key_encoding", {"name": "default"})
    plain, separator = encoding["name"] == "v2", encoding.get("configuration", {}).get("separator")
    dims = tuple(d or f"dim_{i}" for i, d in enumerate(m.get("dimension_names") or ()))
    prefix, separator = ("", separator or ".") if plain else (f"c{separator or '/'}", separator or "/")
    return Layout(tuple(m["shape"]), tuple(m["chunk_grid"]["configuration"]["chunk_shape"]), dtype, _number(m["fill_value"], dtype), codec, 3, dims, order, prefix, separator, m.get("attributes", {}))


def arrays(folder: Folder) -> list[str]:
    """The names of the arrays right below a group."""
    return [n for n in folder.names() if not n.startswith(".") and is_array(folder, n)]


def is_array(folder: Folder, name: str) -> bool:
    return folder.exists(f"{name}/{ARRAY_2}") or json.loads(folder.read(f"{name}/{NODE_3}") or b"{}").get("node_type") == "array"


def group_version(folder: Folder) -> int | None:
    """2 or 3, or None where there is no group."""
    if folder.exists(GROUP_2):
        return 2
    return 3 if json.loads(folder.read(NODE_3) or b"{}").get("node_type") == "group" else None


def open_group(path: str, mode: str = "a", version: int = 2, attributes: dict | None = None) -> int:
    """Opens a group and returns its format: r needs one, a makes one where there is none, w takes away what was there.

    An existing group keeps its format, so arrays that are added to it can be read by those who read the others.
    """
    folder = Folder(path)
    found = group_version(folder)
    if mode == "r" and found is None:
        raise FileNotFoundError(f"no Zarr group at {path}")
    if mode == "w" and folder.exists():
        if found is None and folder.names():
            raise ValueError(f"{path} holds something else than a Zarr group")
        folder.fs.delete_dir_contents(folder.root)
        found = None
    if found is None:
        own = attributes or {}
        files = {GROUP_2: {"zarr_format": 2}, ATTRIBUTES_2: own} if version == 2 else {NODE_3: {"zarr_format": 3, "node_type": "group", "attributes": own}}
        for name, document in reversed(files.items()):
            folder.write(name, json.dumps(document).encode())
    return found or version


@dataclass
class Chunks(InputPartition):
    """Chunks of one place: a single one, or one for each block of bands."""

    indexes: list[tuple[int, ...]]


class ZarrReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.array = Folder(options["path"]), options.get("array", "")
        self.layout = read_layout(self.folder, self.array)
        self.pixels = options.get("layout", "pixels" if len(self.layout.shape) in (2, 3) else "cells") == "pixels"
        self.positions = ("y", "x") if self.pixels else self.layout.dims
        size = self.layout.shape[-2:] if self.pixels else self.layout.shape
        wanted = {"y": options.get("rows"), "x": options.get("columns")}
        self.window = tuple(span(wanted.get(a), s) for a, s in zip(self.positions, size, strict=True))
        self.bands = [int(b) for b in options["bands"].split(",")] if options.get("bands") else None
        self.ignored = [float(v) for v in str(options["ignored"]).split(",")] if options.get("ignored") else []
        self.gaps = str(options.get("gaps", "false")).lower() == "true"

    def partitions(self):
        sides = self.layout.chunks[-len(self.window) :]
        met = [range(low // c, -(-high // c) if high > low else 0) for (low, high), c in zip(self.window, sides, strict=True)]
        places = list(itertools.product(*met))
        if not self.pixels or len(self.layout.shape) == 2:
            return [Chunks([p]) for p in places]
        size = self.layout.chunks[0]
        blocks = range(self.layout.grid[0]) if self.bands is None else sorted({b // size for b in self.bands})
        return [Chunks([(b, *p) for b in blocks]) for p in places]

    def _chunk(self, index: tuple[int, ...]) -> np.ndarray:
        return self.layout.unpack(self.folder.read(f"{self.array}/{self.layout.key(index)}"))

    def _nulled(self, values: np.ndarray) -> pa.Array:
        kind = pa.float64() if values.dtype.kind == "f" else pa.int64()
        gone = np.isin(values, np.array(self.ignored)) if self.ignored else np.zeros(values.shape, bool)
        gone |= np.isnan(values) if values.dtype.kind == "f" else False
        return pa.array(values.astype(kind.to_pandas_dtype()), kind, mask=gone)

    def read(self, part: Chunks | None):
        if part is None:  # Spark's stand-in for no partitions
            return
        yield from self._pixels(part.indexes) if self.pixels else self._cells(part.indexes[0])

    def _inside(self, index: tuple[int, ...]) -> tuple[list[int], list[tuple[int, int]]]:
        """The first position of a chunk, and the part of it that lies in the window."""
        firsts = [i * c for i, c in zip(index, self.layout.chunks[-len(index) :], strict=True)]
        size = self.layout.chunks[-len(index) :]
        return firsts, [(max(low, f) - f, min(high, f + c) - f) for (low, high), f, c in zip(self.window, firsts, size, strict=True)]

    def _pixels(self, indexes: list[tuple[int, ...]]) -> Iterator[pa.RecordBatch]:
        (top, left), ((y0, y1), (x0, x1)) = self._inside(indexes[0][-2:])
        flat = len(self.layout.shape) == 2
        parts = []
        for index in indexes:
            chunk = self._chunk(index)
            chunk = chunk[None] if flat else chunk[: self.layout.shape[0] - index[0] * self.layout.chunks[0]]
            if self.bands is not None and not flat:
                first = index[0] * self.layout.chunks[0]
                chunk = chunk[[b - first for b in sorted(set(self.bands)) if first <= b < first + len(chunk)]]
            parts.append(chunk[:, y0:y1, x0:x1])
        cube = np.concatenate(parts)
        if self.bands is not None and not flat:
            cube = cube[np.searchsorted(sorted(set(self.bands)), self.bands)]
        for y in range(y1 - y0):
            xs = np.flatnonzero(~self.layout.is_fill(cube[:, y]).all(axis=0)) if self.gaps else np.arange(x1 - x0)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(xs) + 1, dtype="i4") * len(cube)), self._nulled(cube[:, y, xs].T.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(xs), top + y0 + y)), pa.array(left + x0 + xs), values], ["y", "x", "v"])

    def _cells(self, index: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
        firsts, inside = self._inside(index)
        part = self._chunk(index)[tuple(slice(a, b) for a, b in inside)]
        step = 1 if part.ndim > 2 else max(1, len(part) if part.ndim else 1)
        for slab in range(0, len(part) if part.ndim else 1, step):
            values = part[slab : slab + step] if part.ndim else part
            places = [g.ravel() + f + a for g, f, (a, _) in zip(np.indices(values.shape), firsts, inside, strict=True)]
            if places:
                places[0] = places[0] + slab
            values = values.ravel()
            if self.gaps:
                there = ~self.layout.is_fill(values)
                places, values = [p[there] for p in places], values[there]
            yield pa.RecordBatch.from_arrays([*[pa.array(p) for p in places], self._nulled(values)], [*self.positions, "v"])


class PushedZarrReader(PushedWindow, ZarrReader):
    pass


@dataclass
class Finished(WriterCommitMessage):
    chunks: int


class ZarrWriter(DataSourceArrowWriter):
    """Rows b, cy, cx (the chunk), y, x and v, sorted by chunk; a task holds one chunk at a time."""

    def __init__(self, options, overwrite: bool):
        self.folder, self.array, self.overwrite = Folder(options["path"]), options["array"], overwrite
        self.layout = read_layout_of(json.loads(options["documents"]))
        self.null = float(options["null"]) if options.get("null") else self.layout.fill
        # A new array grows beside the old one; chunks that are added to an array go where they belong.
        self.target = f".{self.array}-{uuid.uuid4().hex}" if overwrite else self.array

    def write(self, iterator):
        n, key, chunk = 0, None, None
        h, w = self.layout.chunks[-2:]
        blank = self.layout.fill

        def close() -> int:
            if key is None or (self.overwrite and self.layout.is_empty(chunk)):
                return 0
            index, part = (key, chunk) if len(self.layout.shape) == 3 else (key[1:], chunk[0])
            self.folder.write(f"{self.target}/{self.layout.key(index)}", self.layout.pack(part))
            return 1

        for batch in iterator:
            keys = np.stack([batch.column(c).to_numpy() for c in ("b", "cy", "cx")], axis=1)
            starts = np.flatnonzero(np.any(np.diff(keys, axis=0, prepend=keys[:1] - 1), axis=1)).tolist() if len(keys) else []
            for a, z in zip(starts, [*starts[1:], len(keys)], strict=True):
                if tuple(keys[a].tolist()) != key:
                    n += close()
                    key, chunk = tuple(keys[a].tolist()), np.full((self.layout.chunks[0] if len(self.layout.shape) == 3 else 1, h, w), blank, self.layout.dtype)
                some = batch.slice(a, z - a)
                values = some.column("v").flatten().to_numpy(zero_copy_only=False).reshape(z - a, -1)
                values = np.where(np.isnan(values), self.null, values).astype(self.layout.dtype)
                chunk[: values.shape[1], some.column("y").to_numpy() - key[1] * h, some.column("x").to_numpy() - key[2] * w] = values.T
        return Finished(n + close())

    def commit(self, messages):
        """The metadata come last, then the new array takes the old one's name; a reader finds the one or the other."""
        if self.target != self.array:
            for name, document in self.layout.documents().items():
                self.folder.write(f"{self.target}/{name}", document)
            old = f".{self.array}-{uuid.uuid4().hex}"
            if self.folder.exists(self.array):
                self.folder.move(self.array, old)
            self.folder.move(self.target, self.array)
            if self.folder.exists(old):
                self.folder.remove(old)

    def abort(self, messages):
        if self.target != self.array and self.folder.exists(self.target):
            self.folder.remove(self.target)


class ZarrSource(DataSource):
    """``spark.dataSource.register(ZarrSource)``, then ``spark.read.format("zarr").option("array", name).load(group)``.

    Arrays of two or three dimensions are read as pixels: y, x, and v with the values of all bands, a partition for each
    chunk of positions. With layout=cells arrays of any dimensions give a row for each value: a column for each dimension and v.
    Options: bands (numbers, in order), rows and columns (from:to, without the end), ignored (values that are null; NaN always is),
    gaps (true: cells that hold the fill value, and pixels of which all bands that are read do, give no rows), pushdown. A chunk
    without a file holds the fill value. Chunks may be plain or packed by zlib, gzip or zstd; others, filters and sharded arrays
    are refused. Writing goes through :func:`write_zarr`.
    """

    @classmethod
    def name(cls):
        return "zarr"

    def schema(self):
        layout = read_layout(Folder(self.options["path"]), self.options.get("array", ""))
        kind = "double" if layout.dtype.kind == "f" else "long"
        if self.options.get("layout", "pixels" if len(layout.shape) in (2, 3) else "cells") == "pixels":
            return f"y long, x long, v array<{kind}>"
        return ", ".join([*[f"`{d}` long" for d in layout.dims], f"v {kind}"])

    def reader(self, schema):
        return (PushedZarrReader if wants(self.options) else ZarrReader)(self.options)

    def writer(self, schema, overwrite):
        return ZarrWriter(self.options, overwrite)


def _to_write(pixels: DataFrame, values: str, chunks: tuple[int, ...]) -> DataFrame:
    """b, cy, cx, y, x, v: each pixel's bands in the blocks of the chunks."""
    size, (h, w) = chunks[0] if len(chunks) == 3 else 1, chunks[-2:]
    v = F.col(values).cast("array<double>")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int")), lambda b: F.struct(b.cast("long").alias("b"), F.slice(v, b * size + 1, F.lit(size)).alias("v")))
    rows = pixels.where(F.size(v) > 0).select("y", "x", F.explode(blocks).alias("_block"))
    return rows.select("_block.b", F.floor(F.col("y") / h).alias("cy"), F.floor(F.col("x") / w).alias("cx"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "_block.v")


def write_zarr(pixels: DataFrame, path: str, array: str, values: str, chunks: tuple[int, ...] = (64, 512, 512), dtype: str = "float32", fill: float | None = None, codec: str | None = "zlib", version: int = 2, shape: tuple[int, ...] | None = None, mode: str = "overwrite", dims: tuple[str, ...] = ("band", "y", "x"), attributes: dict | None = None, null: float | None = None) -> None:
    """The array column ``values`` of pixels (y, x) as an array of a Zarr group, which keeps its other arrays and its format.

    Two ``chunks`` make a layer of two dimensions from arrays of one value. The shape is that of the pixels unless given. A
    place without a pixel holds ``fill`` (NaN for floats, else 0), and chunks of nothing else get no file; a null holds ``null``
    (unless given, ``fill`` too). Where the two differ, the option gaps gives back the pixels that were written and no others;
    no value may equal ``fill`` then. Of pixels at the same place one stays. A new array takes its name when it is whole. With mode append, the whole chunks that have pixels
    are written into an array of the same layout, or into a new one (then give the shape of all of it), which can be read from
    the start on; :func:`unfinished` tells what a write that was stopped has left to do.
    """
    spark = pixels.sparkSession
    spark.dataSource.register(ZarrSource)
    version = open_group(path, "a", version)
    kind = np.dtype(dtype).newbyteorder("<")
    if shape is None:
        height, width, bands, low = pixels.agg(F.max("y") + 1, F.max("x") + 1, F.max(F.size(values)), F.least(F.min("y"), F.min("x"))).first()
        if height is None or low < 0:
            raise ValueError("there are no pixels" if height is None else "positions must not be negative")
        shape = (bands, height, width)[-len(chunks) :]
    fill = (math.nan if kind.kind == "f" else 0) if fill is None else fill
    if version == 3:
        codec, prefix, separator = "gzip" if codec == "zlib" else codec, "c/", "/"  # format 3 knows zlib by its file format only
    else:
        prefix, separator = "", "."
    layout = Layout(tuple(shape), tuple(chunks), kind, fill, _known(codec, path), version, tuple(dims[-len(chunks) :]), (), prefix, separator, attributes or {})
    folder = Folder(path)
    if mode == "append":
        if array in arrays(folder):
            old = read_layout(folder, array)
            if (old.shape, old.chunks, old.dtype) != (layout.shape, layout.chunks, layout.dtype):
                raise ValueError(f"{array} has shape {old.shape} in chunks of {old.chunks} as {old.dtype}, not {layout.shape}, {layout.chunks}, {layout.dtype}")
            layout = old
        else:
            for name, document in layout.documents().items():
                folder.write(f"{array}/{name}", document)
    documents = {n: d.decode() for n, d in layout.documents().items()}
    rows = _to_write(pixels, values, layout.chunks).repartition("b", "cy", "cx").sortWithinPartitions("b", "cy", "cx")
    own = {} if null is None else {"null": repr(float(null))}
    rows.write.format("zarr").mode(mode).options(array=array, documents=json.dumps(documents), **own).save(path)


def unfinished(pixels: DataFrame, path: str, array: str) -> DataFrame:
    """The pixels whose chunks of an array aren't all there yet: what a write that was stopped has left to do."""
    folder = Folder(path)
    layout = read_layout(folder, array)
    there = set(folder.names(array, deep=True))
    blocks = layout.grid[0] if len(layout.shape) == 3 else 1
    h, w = layout.chunks[-2:]
    index = lambda b, cy, cx: (b, cy, cx) if len(layout.shape) == 3 else (cy, cx)
    done = [(cy, cx) for cy in range(layout.grid[-2]) for cx in range(layout.grid[-1]) if all(layout.key(index(b, cy, cx)) in there for b in range(blocks))]
    rows = pixels.withColumn("_cy", F.floor(F.col("y") / h)).withColumn("_cx", F.floor(F.col("x") / w))
    done = pixels.sparkSession.createDataFrame(done, "_cy long, _cx long")
    return rows.join(done, ["_cy", "_cx"], "left_anti").drop("_cy", "_cx")
