"""Reader of polygon layers in GeoPackage files as a Spark data source: partitions are ranges of row ids."""

from __future__ import annotations

import sqlite3
import struct
from contextlib import closing
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

RING = ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))
#: Bytes of the envelope by its code in the header's flags.
ENVELOPE = (0, 32, 48, 48, 64)


def rings(blob: bytes | None) -> list[list[tuple[float, float]]] | None:
    """All rings of a stored polygon or multipolygon, without their closing points; null for none and for other shapes."""
    if not blob or blob[:2] != b"GP":
        return None
    out, _ = _shape(blob, 8 + ENVELOPE[(blob[3] >> 1) & 7])
    return out


def _shape(blob: bytes, at: int):
    order = "<" if blob[at] else ">"
    kind, count = struct.unpack_from(order + "II", blob, at + 1)
    # Both ways to mark a third and fourth ordinate: thousands, and the two top bits.
    ordinates = 2 + (0, 1, 1, 2)[kind % 2**28 // 1000] + (kind >> 31) + (kind >> 30 & 1)
    kind, at, out = kind % 2**28 % 1000, at + 9, []
    if kind not in (3, 6):
        return None, at
    for _ in range(count):
        if kind == 6:
            part, at = _shape(blob, at)
            out += part or []
            continue
        (n,) = struct.unpack_from(order + "I", blob, at)
        flat = struct.unpack_from(f"{order}{n * ordinates}d", blob, at + 4)
        at += 4 + n * ordinates * 8
        points = list(zip(flat[::ordinates], flat[1::ordinates]))
        out.append(points[:-1] if len(points) > 1 and points[0] == points[-1] else points)
    return out, at


@dataclass
class Rows(InputPartition):
    first: int
    last: int


class GeoPackageReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.rows, self.schema = options["path"], int(options.get("rows", 10000)), schema
        self.table, self.geometry = _layer(options)

    def partitions(self):
        with closing(sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)) as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        return [] if low is None else [Rows(i, min(high, i + self.rows - 1)) for i in range(low, high + 1, self.rows)]

    def read(self, part: Rows):
        names = [f.name for f in self.schema.fields[1:]]
        columns = ", ".join(f'"{self.geometry if n == "rings" else n}"' for n in names)
        shape, types = names.index("rings"), [f.dataType for f in self.schema.fields[1:]]
        with closing(sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)) as db:
            for fid, *row in db.execute(f'SELECT rowid, {columns} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (part.first, part.last)):
                row[shape] = rings(row[shape])
                yield (fid, *(str(v) if v is not None and isinstance(t, StringType) else v for v, t in zip(row, types)))


def _layer(options) -> tuple[str, str]:
    with closing(sqlite3.connect(f"file:{options['path']}?mode=ro", uri=True)) as db:
        layers = dict(db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY table_name").fetchall())
    table = options.get("layer") or next(iter(layers), None)
    if table not in layers:
        raise ValueError(f"no layer {table!r}; the file has {sorted(layers)}")
    return table, layers[table]


class GeoPackageSource(DataSource):
    """``spark.read.format("geopackage_polygons").option("layer", …).load(path)``: fid, the layer's attributes and rings.

    Options: layer (the first by name), rows (row ids a partition, 10,000). The file must lie where executors can open it.
    """

    @classmethod
    def name(cls):
        return "geopackage_polygons"

    def schema(self):
        table, geometry = _layer(self.options)
        with closing(sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)) as db:
            columns = db.execute(f'PRAGMA table_info("{table}")').fetchall()
        fields = [StructField("fid", LongType())]
        for _, name, kind, _, _, key in columns:
            if name == geometry:
                fields.append(StructField("rings", ArrayType(RING)))
            elif not key:
                kind = kind.upper()
                fields.append(StructField(name, LongType() if "INT" in kind or kind == "BOOLEAN" else DoubleType() if kind in ("REAL", "DOUBLE", "FLOAT") else StringType()))
        return StructType(fields)

    def reader(self, schema):
        return GeoPackageReader(self.options, schema)
