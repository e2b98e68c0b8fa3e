"""Reader of ENVI cubes as a Spark data source: one partition for each tile, one row for each pixel."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from leafgrid.sources.geotiff import span
from leafgrid.sources.windows import PushedWindow, wants

#: Data type codes of the header.
DTYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 12: "u2", 13: "u4", 14: "i8", 15: "u8"}
#: The order of the axes in the file, for each interleave.
AXES = {"bsq": "bands lines samples", "bil": "lines bands samples", "bip": "lines samples bands"}


def parse_header(text: str) -> dict[str, str | list[str]]:
    """Lower-cased keys to text, or to a list for a value in braces, which may span lines."""
    found = re.findall(r"^[ \t]*([^=\n;]+?)[ \t]*=[ \t]*(\{[^}]*\}|[^\n]*)", text, re.M)
    return {k.lower(): [p.strip() for p in v[1:-1].split(",")] if v.startswith("{") else v.strip() for k, v in found}


@dataclass
class Tile(InputPartition):
    top: int
    left: int
    height: int
    width: int


class EnviReader(DataSourceReader):
    def __init__(self, options):
        self.header = Path(options["path"])
        self.data = Path(options.get("data") or self.header.with_suffix(options.get("suffix", ".img")))
        self.tile = int(options.get("tile", 512))
        head = parse_header(self.header.read_text())
        self.size = {k: int(head[k]) for k in ("lines", "samples", "bands")}
        self.dtype = np.dtype(DTYPES[int(head["data type"])]).newbyteorder("<>"[int(head.get("byte order", 0))])
        self.axes = AXES[head["interleave"].lower()].split()
        self.offset = int(head.get("header offset", 0))
        self.window = span(options.get("rows"), self.size["lines"]), span(options.get("columns"), self.size["samples"])
        self.bands = [int(b) for b in options["bands"].split(",")] if options.get("bands") else None
        ignored = options.get("ignored") or head.get("data ignore value")
        self.ignored = [float(v) for v in str(ignored).split(",")] if ignored else []

    def partitions(self):
        (top, bottom), (left, right), t = *self.window, self.tile
        return [Tile(y, x, min(t, bottom - y), min(t, right - x)) for y in range(top, bottom, t) for x in range(left, right, t)]

    def read(self, tile: Tile | None):
        if tile is None:  # Spark's stand-in for no partitions
            return
        cube = np.memmap(self.data, self.dtype, "r", self.offset, tuple(self.size[a] for a in self.axes))
        cube = cube.transpose([self.axes.index(a) for a in ("lines", "samples", "bands")])
        bands = len(self.bands) if self.bands is not None else self.size["bands"]
        for y in range(tile.top, tile.top + tile.height):
            row = cube[y, tile.left : tile.left + tile.width]
            row = np.array(row if self.bands is None else row[:, self.bands], "f4", order="C")  # the file's own memory is read-only
            row[np.isin(row, np.array(self.ignored, "f4"))] = np.nan
            values = pa.ListArray.from_arrays(pa.array(np.arange(tile.width + 1, dtype="i4") * bands), pa.array(row.ravel(), from_pandas=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(tile.width, y)), pa.array(np.arange(tile.left, tile.left + tile.width)), values], ["y", "x", "dn"])


class PushedEnviReader(PushedWindow, EnviReader):
    pass


class EnviSource(DataSource):
    """``spark.dataSource.register(EnviSource)``, then ``spark.read.format("envi_cube").load(header)``.

    Options: data (the file of values; else the header's name with ``suffix``, .img), tile (pixels a side, 512), bands (the
    numbers of those to read, in order), rows and columns (from:to, without the end). Only what is asked for is read from the
    file. Both files must lie where executors can open them. NaN is read as null, and so are the header's ignore value or those
    of the option ignored. With pushdown=true (see :func:`leafgrid.sources.rasters.open_raster`) filters on y and x narrow the window.
    """

    @classmethod
    def name(cls):
        return "envi_cube"

    def schema(self):
        return "y long, x long, dn array<float>"

    def reader(self, schema):
        return (PushedEnviReader if wants(self.options) else EnviReader)(self.options)


def band_rows(header: dict) -> list[tuple[int, float]]:
    """band and wl of a parsed header, for ``createDataFrame``."""
    return [(i, float(w)) for i, w in enumerate(header.get("wavelength", []))]
