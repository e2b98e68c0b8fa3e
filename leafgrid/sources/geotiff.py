"""GeoTIFF rasters as a Spark data source: read by blocks, written as one file for each sheet of the scene.

The part of the format that rasters of labels, splits and predictions need: classic TIFF, strips or tiles, no compression or
DEFLATE with the horizontal or the floating-point predictor, bands side by side or one after another, and overviews: smaller
images in the same file.
"""

from __future__ import annotations

import math
import re
import struct
import uuid
import zlib
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from leafgrid.sources.windows import PushedWindow, wants

# Tags and field types of the format.
SUBFILE, WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR = 254, 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT = 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, GEO_KEYS, NODATA = 33550, 33922, 34735, 42113
FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
KINDS = {1: "u", 2: "i", 3: "f"}


def local(path: str) -> Path:
    """A path that open() takes; of URIs only those of files are such."""
    if "://" in path and not path.startswith("file:"):
        raise ValueError(f"{path} is in a file system that GeoTIFF files can't be opened in")
    return Path(re.sub(r"^file:/*", "/", path))


def read_directories(path: Path) -> tuple[str, list[dict[int, tuple]]]:
    """The byte order and the tags of each image in a file."""
    with path.open("rb") as f:
        order = {b"II": "<", b"MM": ">"}.get(f.read(2))
        magic, at = struct.unpack(f"{order or '<'}HI", f.read(6))
        if order is None or magic != 42:
            raise ValueError(f"{path} is not a classic TIFF file")
        images = []
        while at:
            f.seek(at)
            (n,) = struct.unpack(f"{order}H", f.read(2))
            entries, tags = f.read(12 * n), {}
            (at,) = struct.unpack(f"{order}I", f.read(4))
            for i in range(n):
                tag, kind, count = struct.unpack_from(f"{order}HHI", entries, 12 * i)
                if kind not in FIELDS:
                    continue
                one = FIELDS[kind]
                form = f"{order}{count}s" if one == "s" else order + one * count
                data = entries[12 * i + 8 : 12 * i + 12]
                if struct.calcsize(form) > 4:
                    f.seek(struct.unpack(f"{order}I", data)[0])
                    data = f.read(struct.calcsize(form))
                tags[tag] = struct.unpack_from(form, data)
            images.append(tags)
    return order, images


def read_tags(path: Path) -> tuple[str, dict[int, tuple]]:
    """The byte order and the tags of the first image."""
    order, images = read_directories(path)
    return order, images[0]


def span(text: str | None, size: int) -> tuple[int, int]:
    """From and to, without the end, of an option like 100:200; all of it for none."""
    low, _, high = (text or "").partition(":")
    return max(0, int(low or 0)), min(size, int(high or size))


@dataclass
class Block(InputPartition):
    """Blocks of the same place of a file, one for each band where bands lie one after another."""

    file: str
    top: int
    left: int
    numbers: list[int]


class Image:
    """One image of a file: its size, its blocks and how they are packed."""

    def __init__(self, path: Path, level: int = 0):
        self.path = path
        self.order, images = read_directories(path)
        if not 0 <= level < len(images):
            raise ValueError(f"{path} has {len(images) - 1} overviews, not {level}")
        t = images[level]
        self.height, self.width, self.bands = t[HEIGHT][0], t[WIDTH][0], t.get(SAMPLES, (1,))[0]
        self.packed, self.predictor, self.apart = t.get(COMPRESSION, (1,))[0], t.get(PREDICTOR, (1,))[0], t.get(PLANAR, (1,))[0] == 2
        if self.packed not in (1, 8, 32946) or self.predictor not in (1, 2, 3):
            raise ValueError(f"{path}: compression {self.packed} with predictor {self.predictor} is not supported")
        self.dtype = np.dtype(f"{KINDS[t.get(FORMAT, (1,))[0]]}{t[BITS][0] // 8}").newbyteorder(self.order)
        if TILES in t:
            self.rows, self.columns, self.at, self.sizes = t[TILE_HEIGHT][0], t[TILE_WIDTH][0], t[TILES], t[TILE_BYTES]
        else:
            self.rows, self.columns, self.at, self.sizes = min(t.get(STRIP_ROWS, (self.height,))[0], self.height), self.width, t[STRIPS], t[STRIP_BYTES]
        self.tiled = TILES in t
        text = images[0].get(NODATA, (b"",))[0].decode("ascii", "ignore").strip("\0 ")
        self.nodata = float(text) if text else None

    def blocks(self) -> list[tuple[int, int, list[int]]]:
        """Row and column of the first pixel of each place, and the numbers of its blocks."""
        places = [(y, x) for y in range(0, self.height, self.rows) for x in range(0, self.width, self.columns)]
        return [(y, x, [i + k * len(places) for k in range(self.bands)] if self.apart else [i]) for i, (y, x) in enumerate(places)]

    def _block(self, number: int, rows: int, samples: int) -> np.ndarray:
        with self.path.open("rb") as f:
            f.seek(self.at[number])
            data = f.read(self.sizes[number])
        data = data if self.packed == 1 else zlib.decompress(data)
        if self.predictor == 3:
            return _joined(data, rows, self.columns, samples, self.dtype)
        got = np.frombuffer(data, self.dtype, rows * self.columns * samples).reshape(rows, self.columns, samples)
        return np.cumsum(got, axis=1, dtype=self.dtype.newbyteorder("=")) if self.predictor == 2 else got

    def values(self, top: int, left: int, numbers: list[int]) -> np.ndarray:
        """Row, column and band of the blocks at a place as doubles; NaN for nodata."""
        height, width = min(self.rows, self.height - top), min(self.columns, self.width - left)
        rows = self.rows if self.tiled else height
        cube = np.concatenate([self._block(n, rows, 1 if self.apart else self.bands) for n in numbers], axis=2)[:height, :width].astype("f8")
        if self.nodata is not None:
            cube[cube == self.nodata] = np.nan
        return cube


class TiffReader(DataSourceReader):
    def __init__(self, options):
        path = local(options["path"])
        self.level = int(options.get("level", 0))
        # Sheets of a folder are alike: the first tells where the blocks of all are.
        self.sheets = {tuple(map(int, f.stem.split("_")[1:])): str(f) for f in sorted(path.glob("tile_*_*.tif"))} if path.is_dir() else {(0, 0): str(path)}
        if not self.sheets:
            raise FileNotFoundError(f"{path} has no sheets")
        one = Image(Path(next(iter(self.sheets.values()))), self.level)
        self.size, self.rows, self.columns, self.bands, self.blocks = (one.height, one.width), one.rows, one.columns, one.bands, one.blocks()
        whole = [(max(k[i] for k in self.sheets) + 1) * self.size[i] for i in (0, 1)]
        self.window = span(options.get("rows"), whole[0]), span(options.get("columns"), whole[1])

    def partitions(self):
        (top, bottom), (left, right) = self.window
        meets = lambda y, x, rows, columns: y < bottom and y + rows > top and x < right and x + columns > left
        out = []
        for (i, j), file in self.sheets.items():
            y0, x0 = i * self.size[0], j * self.size[1]
            if meets(y0, x0, *self.size):
                out += [Block(file, y0 + y, x0 + x, numbers) for y, x, numbers in self.blocks if meets(y0 + y, x0 + x, self.rows, self.columns)]
        return out

    def read(self, block: Block | None):
        if block is None:  # Spark's stand-in for no partitions
            return
        cube = Image(Path(block.file), self.level).values(block.top % self.size[0], block.left % self.size[1], block.numbers)
        (top, bottom), (left, right) = self.window
        first, last = max(left, block.left), min(right, block.left + cube.shape[1])
        offsets = pa.array(np.arange(last - first + 1, dtype="i4") * self.bands)
        for y in range(max(top, block.top), min(bottom, block.top + cube.shape[0])):
            values = pa.ListArray.from_arrays(offsets, pa.array(cube[y - block.top, first - block.left : last - block.left].ravel(), from_pandas=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(last - first, y)), pa.array(np.arange(first, last)), values], ["y", "x", "v"])


class PushedTiffReader(PushedWindow, TiffReader):
    pass


def _split(block: np.ndarray) -> bytes:
    """Predictor 3: a row's bytes by their weight, the highest of all values first, each less the one before it by samples."""
    rows, columns, samples = block.shape
    planes = block.astype(block.dtype.newbyteorder(">")).view("u1").reshape(rows, columns * samples, block.itemsize).transpose(0, 2, 1).reshape(rows, -1, samples)
    return np.diff(planes, axis=1, prepend=np.zeros((rows, 1, samples), "u1")).astype("u1").tobytes()


def _joined(data: bytes, rows: int, columns: int, samples: int, dtype: np.dtype) -> np.ndarray:
    planes = np.cumsum(np.frombuffer(data, "u1").reshape(rows, -1, samples), axis=1, dtype="u1").reshape(rows, dtype.itemsize, columns * samples)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(rows, columns, samples)


def pyramid(cube: np.ndarray, nodata: float | None, factors: tuple[int, ...]) -> list[np.ndarray]:
    """Means over blocks of factor by factor pixels, each level from the sums and counts of the level before; nodata where no pixel
    of a block has a value. Whole numbers are rounded."""
    known = np.ones(cube.shape, bool) if nodata is None else cube != nodata
    known &= ~np.isnan(cube) if cube.dtype.kind == "f" else True
    sums, counts, done, out = np.where(known, cube, 0).astype("f8"), known.astype("f8"), 1, []
    for factor in factors:
        if factor % done or factor <= done:
            raise ValueError(f"each factor must be a multiple of the one before, not {factors}")
        step, done = factor // done, factor
        pad = [(0, -sums.shape[0] % step), (0, -sums.shape[1] % step), (0, 0)]
        shape = [(sums.shape[0] + pad[0][1]) // step, step, (sums.shape[1] + pad[1][1]) // step, step, sums.shape[2]]
        sums, counts = (np.pad(a, pad).reshape(shape).sum(axis=(1, 3)) for a in (sums, counts))
        means = sums / np.maximum(counts, 1)
        out.append(np.where(counts > 0, means if cube.dtype.kind == "f" else np.rint(means), 0 if nodata is None else nodata).astype(cube.dtype))
    return out


def _blocks(image: np.ndarray, tile: int | None, predictor: int) -> list[bytes]:
    """The packed tiles of an image, those at the edges filled up; or strips of 64 rows."""
    if tile:
        image = np.pad(image, [(0, -image.shape[0] % tile), (0, -image.shape[1] % tile), (0, 0)], "edge")
    rows, columns = tile or 64, tile or image.shape[1]
    parts = (np.ascontiguousarray(image[y : y + rows, x : x + columns]) for y in range(0, image.shape[0], rows) for x in range(0, image.shape[1], columns))
    less = lambda p: np.diff(p, axis=1, prepend=np.zeros_like(p[:, :1])).astype(p.dtype)
    return [zlib.compress(_split(p) if predictor == 3 else less(p).tobytes() if predictor == 2 else p.tobytes()) for p in parts]


def encode(cube: np.ndarray, nodata: float | None = None, origin: tuple[float, float] = (0.0, 0.0), px: float = 1.0, epsg: int | None = None, tile: int | None = None, predictor: int = 1, factors: tuple[int, ...] = ()) -> bytes:
    """A raster (row, column, band) as a file, packed by DEFLATE: strips of 64 rows, or tiles of ``tile`` pixels a side (a multiple
    of 16). ``factors`` are those of overviews, smaller images behind the first. Predictor 2 is for whole numbers, 3 for floats."""
    cube = np.ascontiguousarray(cube.astype(cube.dtype.newbyteorder("<")))
    kind = {"u": 1, "i": 2, "f": 3}[cube.dtype.kind]
    if (tile or 16) % 16 or predictor not in ((1, 3) if kind == 3 else (1, 2)):
        raise ValueError(f"tiles of {tile} with predictor {predictor} can't hold {cube.dtype}")
    images = [cube, *pyramid(cube, nodata, factors)]
    blocks, at, directories = [], 8, []
    for level, image in enumerate(images):
        height, width, bands = image.shape
        packed = _blocks(image, tile, predictor)
        places = np.cumsum([at, *(len(b) for b in packed)]).tolist()
        at, blocks = places[-1], blocks + packed
        tags = [(SUBFILE, "I", [1])] if level else []
        tags += [(WIDTH, "I", [width]), (HEIGHT, "I", [height]), (BITS, "H", [8 * cube.itemsize] * bands), (COMPRESSION, "H", [8]), (PHOTOMETRIC, "H", [1])]
        sizes = [len(b) for b in packed]
        tags += [(SAMPLES, "H", [bands]), (PLANAR, "H", [1]), (FORMAT, "H", [kind] * bands)] + ([(PREDICTOR, "H", [predictor])] if predictor > 1 else [])
        tags += [(TILE_WIDTH, "I", [tile]), (TILE_HEIGHT, "I", [tile]), (TILES, "I", places[:-1]), (TILE_BYTES, "I", sizes)] if tile else [(STRIPS, "I", places[:-1]), (STRIP_ROWS, "I", [64]), (STRIP_BYTES, "I", sizes)]
        if not level:
            tags += [(PIXEL_SCALE, "d", [px, px, 0.0]), (TIEPOINT, "d", [0.0, 0.0, 0.0, *origin, 0.0])]
            if epsg:
                # Version, revision and number of keys; then a projected system, pixels as areas, its code.
                tags.append((GEO_KEYS, "H", [1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, epsg]))
        if nodata is not None:
            tags.append((NODATA, "s", [f"{nodata:g}\0".encode()]))
        directories.append(sorted(tags, key=lambda t: t[0]))
    start, out = at + at % 2, []
    for i, tags in enumerate(directories):
        out.append(_directory(tags, start, i + 1 < len(directories)))
        start += len(out[-1])
    first = at + at % 2
    return struct.pack("<2sHI", b"II", 42, first) + b"".join(blocks).ljust(first - 8, b"\0") + b"".join(out)


def _directory(tags: list[tuple[int, str, list]], start: int, more: bool) -> bytes:
    """The directory of an image that begins at ``start``; the next one, if there are more, comes right behind it."""
    code = {v: k for k, v in FIELDS.items()}
    entries, extra, free = b"", b"", start + 2 + 12 * len(tags) + 4
    for tag, one, values in tags:
        count = len(values[0]) if one == "s" else len(values)
        data = values[0] if one == "s" else struct.pack("<" + one * count, *values)
        if len(data) > 4:
            place, data = struct.pack("<I", free + len(extra)), data + b"\0" * (len(data) % 2)
            extra, data = extra + data, place
        entries += struct.pack("<HHI", tag, code[one], count) + data.ljust(4, b"\0")
    return struct.pack("<H", len(tags)) + entries + struct.pack("<I", free + len(extra) if more else 0) + extra


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class TiffWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.folder, self.tile, self.overwrite = local(options["path"]), int(options.get("tile", 512)), overwrite
        self.dtype, self.nodata = np.dtype(options.get("dtype", "float32")), float(options.get("nodata", -1))
        self.px, self.epsg = float(options.get("px", 1.0)), int(options["epsg"]) if "epsg" in options else None
        self.west, self.north = float(options.get("west", 0.0)), float(options.get("north", 0.0))
        factors = tuple(int(f) for f in options["overviews"].split(",")) if options.get("overviews") else ()
        if any(self.tile % f for f in factors):
            raise ValueError(f"sheets of {self.tile} pixels can't be divided by all of {factors}")
        self.how = {"tile": int(options["block"]) if options.get("block") else None, "predictor": int(options.get("predictor", 1)), "factors": factors}

    def write(self, iterator):
        """Rows come sorted by sheet; one sheet is held at a time, and its file gets its name when all tasks have ended."""
        self.folder.mkdir(parents=True, exist_ok=True)
        files, key, cube = [], None, None

        def close():
            if key is not None:
                origin = (self.west + key[1] * self.tile * self.px, self.north - key[0] * self.tile * self.px)
                hidden = self.folder / f".{uuid.uuid4().hex}"
                hidden.write_bytes(encode(cube, self.nodata, origin, self.px, self.epsg, **self.how))
                files.append((str(hidden), str(self.folder / f"tile_{key[0]}_{key[1]}.tif")))

        for batch in iterator:
            keys = np.stack([batch.column(c).to_numpy() for c in ("tile_y", "tile_x")], axis=1)
            starts = np.flatnonzero(np.any(np.diff(keys, axis=0, prepend=keys[:1] - 1), axis=1)).tolist() if len(keys) else []
            for a, z in zip(starts, [*starts[1:], len(keys)], strict=True):
                some = batch.slice(a, z - a)
                values = some.column("v").flatten().to_numpy(zero_copy_only=False).reshape(z - a, -1)
                if tuple(keys[a].tolist()) != key:
                    close()
                    key = tuple(keys[a].tolist())
                    cube = np.full((self.tile, self.tile, values.shape[1]), self.nodata, self.dtype)
                cube[some.column("y").to_numpy() - key[0] * self.tile, some.column("x").to_numpy() - key[1] * self.tile] = np.where(np.isnan(values), self.nodata, values)
        close()
        return Written(files)

    def commit(self, messages):
        """New tiles take the place of old ones one by one; old tiles without a new one go last, so none is ever missing."""
        new = [pair for m in messages if m for pair in m.files]
        for hidden, name in new:
            Path(hidden).replace(name)
        for old in self.folder.glob("tile_*.tif") if self.overwrite else ():
            if str(old) not in {name for _, name in new}:
                old.unlink()

    def abort(self, messages):
        for hidden, _ in (pair for m in messages if m for pair in m.files):
            Path(hidden).unlink(missing_ok=True)


class GeoTiffSource(DataSource):
    """``spark.dataSource.register(GeoTiffSource)``, then ``spark.read.format("geotiff").load(file)``: y, x and a value for
    each band, null for nodata.

    A folder that :func:`write_tiles` wrote is read as one scene. Options: level (0, or the number of an overview, whose pixels y
    and x then count), rows and columns (from:to, without the end; only the blocks of the window are read), pushdown (filters on y
    and x narrow the window, see :func:`leafgrid.sources.rasters.open_raster`). Paths must be open to all executors.
    """

    @classmethod
    def name(cls):
        return "geotiff"

    def schema(self):
        return "y long, x long, v array<double>"

    def reader(self, schema):
        return (PushedTiffReader if wants(self.options) else TiffReader)(self.options)

    def writer(self, schema, overwrite):
        return TiffWriter(self.options, overwrite)


def write_tiles(layer: DataFrame, folder: str, *values: str, tile: int = 512, block: int | None = None, overviews: tuple[int, ...] = (), mode: str = "overwrite", **options) -> None:
    """The columns ``values`` of a layer (y, x) as the bands of GeoTIFF files, one for each sheet of ``tile`` pixels a side with pixels.

    ``block``: the side of the tiles inside a file (without, strips). ``overviews``: factors of smaller images in the same files,
    means of the known pixels of each block, made level from level as a sheet is written; they must divide ``tile``, so that no
    block crosses sheets. Options: dtype (float32), nodata (-1; also where no pixel is), predictor, px, west, north, epsg. A
    task holds one sheet at a time.
    """
    layer.sparkSession.dataSource.register(GeoTiffSource)
    if overviews:
        options["overviews"] = ",".join(map(str, overviews))
    if block:
        options["block"] = block
    number = lambda axis: F.floor(F.col(axis) / tile).cast("long").alias(f"tile_{axis}")
    rows = layer.select(number("y"), number("x"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.array(*[F.col(v).cast("double") for v in values]).alias("v"))
    rows = rows.repartition("tile_y", "tile_x").sortWithinPartitions("tile_y", "tile_x")
    rows.write.format("geotiff").mode(mode).options(tile=tile, **options).save(folder)


def write_overviews(layer: DataFrame, folder: str, value: str, height: int, width: int, factors: tuple[int, ...] = (2, 4, 8, 16), px: float = 1.0, **options) -> None:
    """Means over blocks of k by k pixels, each k to its own folder ``overview_<k>`` of sheets; see :func:`write_tiles`.

    Blocks that the grid cuts off are left out. The layer is read once: all levels come from sums and counts of small blocks.
    """
    base = math.gcd(*factors)
    place = lambda k: [F.floor(F.col(a) / k).cast("long").alias(a) for a in "yx"]
    small = layer.groupBy(*place(base)).agg(F.sum(value).alias("total"), F.count(value).alias("n")).persist(StorageLevel.DISK_ONLY)
    for k in factors:
        blocks = small.groupBy(*place(k // base)).agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias(value))
        write_tiles(blocks.where((F.col("y") < height // k) & (F.col("x") < width // k)), f"{folder}/overview_{k}", value, px=px * k, **options)
    small.unpersist()
