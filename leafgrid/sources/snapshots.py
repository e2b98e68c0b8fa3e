"""Versions of a set of tables: each write goes to a folder of its own, and a manifest that gets its name last makes it visible.

A reader resolves one manifest and sees that version throughout, whatever is written meanwhile. A write that fails leaves the
versions before it as they were. Works on any file system that Hadoop opens.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = re.compile(r"^manifest-(\d{9})\.json$")


class Conflict(RuntimeError):
    """Another writer has made a version since the one that this write began from."""


class Files:
    """The few operations on files that are needed, by the JVM's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway, self.conf, self.root = spark._jvm, spark.sparkContext._gateway, spark.sparkContext._jsc.hadoopConfiguration(), root.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str = "") -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Writes a file under a hidden name and renames it; raises Conflict where the name is taken."""
        hidden = f".{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(hidden))
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.conf)
        none = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(self._path(hidden), self._path(name), none)
        except Py4JJavaError as e:
            self.remove(hidden)
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                raise Conflict(f"{name} is there already") from None
            raise

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


@dataclass(frozen=True)
class Version:
    """What a manifest says: the folders of each table, and attributes."""

    number: int = 0
    tables: dict[str, list[str]] = field(default_factory=dict)
    attributes: dict = field(default_factory=dict)
    written: float = 0.0


class Snapshots:
    """The versions of the tables below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.files = spark, Files(spark, path)

    def numbers(self) -> list[int]:
        return [int(m[1]) for n in self.files.names() if (m := MANIFEST.match(n))]

    def version(self, number: int | None = None) -> Version:
        """A version, the latest one if no number is given; a version without tables where there is none yet."""
        known = self.numbers()
        if number is None:
            if not known:
                return Version()
            number = known[-1]
        elif number not in known:
            raise ValueError(f"version {number} isn't there; known are {known}")
        return Version(**json.loads(self.files.read(f"manifest-{number:09d}.json")))

    def load(self, table: str, version: Version | int | None = None) -> DataFrame:
        """A table as of a version. Take several tables from one Version to have them fit together."""
        one = version if isinstance(version, Version) else self.version(version)
        if table not in one.tables:
            raise ValueError(f"version {one.number} has no table {table}; it has {sorted(one.tables)}")
        root = self.files.root
        return self.spark.read.option("basePath", f"{root}/data/{one.tables[table][0].split('/')[0]}").parquet(*[f"{root}/data/{f}" for f in one.tables[table]])

    def commit(self, tables: dict[str, list[str]], base: Version, attributes: dict | None = None, drop: tuple[str, ...] = ()) -> Version:
        """Makes the version after ``base``, with these tables in place of those of the same names, and without those of ``drop``.

        If another writer has made that version meanwhile this raises Conflict, and nothing has changed.
        """
        kept = {t: f for t, f in base.tables.items() if t not in drop}
        new = Version(base.number + 1, kept | tables, base.attributes | (attributes or {}), time.time())
        self.files.publish(f"manifest-{new.number:09d}.json", json.dumps(new.__dict__, sort_keys=True))
        return new

    def save(self, table: str, rows: DataFrame, by: tuple[str, ...] = (), attributes: dict | None = None) -> Version:
        """Writes a table whole and makes a version with it; ``by`` are columns that its folders are partitioned by.

        ``rows`` may read the table's own earlier version. A write that fails leaves a folder that no manifest names.
        """
        base, folder = self.version(), f"{table}-{uuid.uuid4().hex}"
        rows.write.partitionBy(*by).parquet(f"{self.files.root}/data/{folder}")
        return self.commit({table: [folder]}, base, attributes)

    def save_cube(self, table: str, pixels: DataFrame, run: str, tile: int = 512, rows_at_once: int = 4, attributes: dict | None = None) -> Version:
        """Writes pixels (y, x, ...) in strips of ``rows_at_once`` rows of tiles, each a job of its own, and makes a version with them.

        If it stops, the same call with the same ``run`` skips the strips that were finished; a strip's filter on y reaches the
        source of the pixels. Within a strip each tile is a folder, written by one task, sorted by row and column.
        """
        base, folder, side = self.version(), f"{table}-{run}", tile * rows_at_once
        low, high = pixels.agg(F.floor(F.min("y") / side), F.floor(F.max("y") / side)).first()
        strips = [f"{folder}/strip={k}" for k in range(low, high + 1)] if low is not None else []
        for k, strip in zip(range(low or 0, (low or 0) + len(strips)), strips, strict=True):
            if self.files.exists(f"data/{strip}/_SUCCESS"):
                continue
            some = pixels.where(F.col("y").between(k * side, (k + 1) * side - 1))
            some = some.withColumn("tile_y", F.floor(F.col("y") / tile).cast("int")).withColumn("tile_x", F.floor(F.col("x") / tile).cast("int"))
            some = some.repartition("tile_y", "tile_x").sortWithinPartitions("tile_y", "tile_x", "y", "x")
            some.write.mode("overwrite").partitionBy("tile_y", "tile_x").parquet(f"{self.files.root}/data/{strip}")
        full = [s for s in strips if any(not n.startswith(("_", ".")) for n in self.files.names(f"data/{s}"))]
        if not full:
            raise ValueError("there are no pixels")
        return self.commit({table: full}, base, {**(attributes or {}), f"{table}.tile": tile})

    def load_cube(self, table: str, version: Version | int | None = None, rows: tuple[int, int] | None = None, columns: tuple[int, int] | None = None) -> DataFrame:
        """The pixels of a region (bounds included) of a table by save_cube; only the tiles that it meets are read."""
        one = version if isinstance(version, Version) else self.version(version)
        df, tile = self.load(table, one), one.attributes[f"{table}.tile"]
        for axis, bounds in (("y", rows), ("x", columns)):
            if bounds:
                df = df.where(F.col(f"tile_{axis}").between(bounds[0] // tile, bounds[1] // tile) & F.col(axis).between(*bounds))
        return df.drop("strip", "tile_y", "tile_x")

    def history(self) -> DataFrame:
        """version, table, folders and time of every version that is kept."""
        found = [(v.number, t, len(f), v.written) for v in map(self.version, self.numbers()) for t, f in sorted(v.tables.items())]
        rows = self.spark.createDataFrame(found, "version long, table string, folders long, at double")
        return rows.withColumn("at", F.col("at").cast("timestamp"))

    def expire(self, keep: int = 1, older_than: float = 86_400.0) -> list[str]:
        """Takes away all but the last ``keep`` versions, and folders that none of these names and no version of the last
        ``older_than`` seconds did; writes that still go on must be younger. Returns the folders that went."""
        versions = [self.version(n) for n in self.numbers()]
        used = {f.split("/")[0] for v in versions[-keep:] for f in v.tables.values() for f in f}
        for v in versions[:-keep]:
            self.files.remove(f"manifest-{v.number:09d}.json")
        limit, gone = (time.time() - older_than) * 1000, []
        for name in self.files.names("data"):
            at = self.files.fs.getFileStatus(self.files._path(f"data/{name}")).getModificationTime()
            if name not in used and at <= limit:
                self.files.remove(f"data/{name}")
                gone.append(name)
        return gone
