"""Opening the raster sources with filters pushed down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafgrid.sources.envi import EnviSource
from leafgrid.sources.geotiff import GeoTiffSource
from leafgrid.sources.zarr import ZarrSource

SOURCES = {source.name(): source for source in (EnviSource, GeoTiffSource, ZarrSource)}


def open_raster(spark: SparkSession, kind: str, path: str, condition: Column | str | None = None, **options) -> DataFrame:
    """The rows of a raster (kind: envi_cube, geotiff or zarr) that meet ``condition``; ``options`` are the source's.

    Of the condition, comparisons of positions (y, x, or an array's dimensions) with numbers are pushed down: tiles outside
    aren't read. Spark keeps pushed filters with the frame that was loaded, so frames with different filters over one load see
    one another's rows only; here each call loads a frame of its own, and filters put on the result are left to Spark.
    """
    spark.dataSource.register(SOURCES[kind])
    reader = spark.read.format(kind).options(**options)
    if condition is None:
        return reader.load(path)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = reader.option("pushdown", "true").load(path).where(condition)
    # Positions are never null; as an expression they take no more filters to the source.
    return rows.select(*[F.coalesce(F.col(f"`{f.name}`"), F.lit(0).cast("long")).alias(f.name) if f.dataType == T.LongType() and f.name != "v" else F.col(f"`{f.name}`") for f in rows.schema])
