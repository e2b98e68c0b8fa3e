"""An inbox of cubes as a stream, and sinks that hold each micro-batch once."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import DataStreamWriter

from leafgrid.sources.envi import DTYPES, EnviReader, parse_header
from leafgrid.sources.folders import Folder
from leafgrid.sources.geotiff import TiffReader
from leafgrid.sources.zarr import ZarrReader, is_array

READERS = {"envi_cube": EnviReader, "geotiff": TiffReader, "zarr": ZarrReader}


def _envi_is_whole(folder: Folder, name: str) -> bool:
    """Whether the header is there with a file of values as long as it says."""
    data = folder.size(os.path.splitext(name)[0] + ".img")
    head = parse_header((folder.read(name) or b"").decode())
    keys = ("samples", "lines", "bands", "data type")
    if data is None or not all(str(head.get(k, "")).isdigit() for k in keys):
        return False
    size = int(DTYPES[int(head["data type"])][1])
    for k in keys[:3]:
        size *= int(head[k])
    return data >= size + int(head.get("header offset", 0))


def arrived(folder: Folder, kind: str, array: str = "") -> list[str]:
    """The names of the cubes in an inbox that are there as a whole."""
    names = [n for n in folder.names() if not n.startswith(".")]
    if kind == "envi_cube":
        return [n for n in names if n.endswith(".hdr") and _envi_is_whole(folder, n)]
    if kind == "zarr":
        return [n for n in names if is_array(folder, f"{n}/{array}" if array else n)]
    return [n for n in names if n.endswith((".tif", ".tiff"))]


@dataclass
class CubePart(InputPartition):
    cube: str
    part: InputPartition


class InboxReader(DataSourceStreamReader):
    """The offset counts the entries of a log that the reader keeps in a shared folder: an entry names the cubes that one trigger
    found new. Offsets so stand for the same cubes after a restart, in whatever order files came."""

    def __init__(self, options):
        self.options = dict(options)
        self.kind = self.options.get("kind", "envi_cube")
        self.inbox, self.log = Folder(self.options["path"]), Folder(self.options["log"])
        self.most = int(self.options.get("max_cubes", 1 << 30))

    def _entries(self) -> list[str]:
        return [n for n in self.log.names() if n.endswith(".json")]

    def _cubes(self, start: int, end: int) -> list[str]:
        return [c for n in self._entries()[start:end] for c in json.loads(self.log.read(n))]

    def initialOffset(self):
        return {"entries": 0}

    def latestOffset(self):
        entries = self._entries()
        known = set(self._cubes(0, len(entries)))
        new = [c for c in arrived(self.inbox, self.kind, self.options.get("array", "")) if c not in known][: self.most]
        if new:
            self.log.write(f"{len(entries):09d}.json", json.dumps(new).encode())
        return {"entries": len(entries) + bool(new)}

    def _reader(self, cube: str):
        return READERS[self.kind]({**self.options, "path": self.inbox.at(cube)})

    def partitions(self, start, end):
        return [CubePart(c, p) for c in self._cubes(start["entries"], end["entries"]) for p in self._reader(c).partitions()]

    def read(self, partition: CubePart):
        for batch in self._reader(partition.cube).read(partition.part):
            y, x, values = batch.columns
            yield pa.RecordBatch.from_arrays([pa.array([partition.cube] * len(y), pa.string()), y, x, values.cast(pa.list_(pa.float64()))], ["cube", "y", "x", "v"])


class InboxSource(DataSource):
    """``spark.dataSource.register(InboxSource)``, then ``spark.readStream.format("cube_inbox").option("log", folder).load(inbox)``:
    cube (the name in the inbox), y, x and v (the values of all bands) of every cube, each once.

    Options: log (a shared folder of this reader alone, to be kept like the checkpoint), kind (envi_cube, geotiff or zarr), max_cubes
    (new ones in a trigger), and those of the kind's source. ENVI cubes count as there when the header and all values are, Zarr
    arrays when their metadata are. Cubes must stay until they are read and never change.
    """

    @classmethod
    def name(cls):
        return "cube_inbox"

    def schema(self):
        return "cube string, y long, x long, v array<double>"

    def streamReader(self, schema):
        return InboxReader(self.options)


def watch_inbox(spark: SparkSession, inbox: str, log: str, **options) -> DataFrame:
    """The stream of an inbox's pixels; see :class:`InboxSource`."""
    spark.dataSource.register(InboxSource)
    return spark.readStream.format("cube_inbox").options(log=log, **options).load(inbox)


def write_once(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> DataStreamWriter:
    """Writes what ``work`` makes of each micro-batch to its own folder ``batch=<number>`` below ``path``; ``start()`` it.

    A batch that is run again after a failure replaces its folder, so every row is there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
