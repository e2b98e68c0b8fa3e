"""Cube stores: Parquet folders partitioned by tile, so that readers of a region or of a few columns skip the rest.

A scene is a folder with the cube, the band dimension, attributes, and further layers by position, each a table of its own.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_folder(spark: SparkSession) -> str:
    """A new folder in the cluster's shared folder (spark.checkpoint.dir), deleted when the driver ends.

    A session in local mode may go without the setting; it gets a folder of its machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        shared = f"file://{tempfile.gettempdir()}/spark-leafgrid"
    path = f"{shared.rstrip('/')}/leafgrid-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def kept(rows: DataFrame) -> DataFrame:
    """The rows from a Parquet table in the cluster's shared folder: what several passes read is worked out once."""
    path = scratch_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def save_cube(pixels: DataFrame, path: str, tile: int = 512, mode: str = "overwrite") -> None:
    """Each tile (of ``tile`` pixels a side) becomes one folder, written by one task, sorted by row and column.

    A cube that is there is replaced when the new one is whole, so the pixels may come from it; see
    :mod:`leafgrid.sources.snapshots` for readers that must not notice.
    """
    rows = pixels.withColumn("tile_y", F.floor(F.col("y") / tile).cast("int")).withColumn("tile_x", F.floor(F.col("x") / tile).cast("int"))
    rows = rows.repartition("tile_y", "tile_x").sortWithinPartitions("tile_y", "tile_x", "y", "x").write.partitionBy("tile_y", "tile_x")
    if mode != "overwrite":
        rows.mode(mode).parquet(path)
        return
    new, old = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    jvm, conf = pixels.sparkSession._jvm, pixels.sparkSession.sparkContext._jsc.hadoopConfiguration()
    here, there, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, new, old))
    fs = here.getFileSystem(conf)
    try:
        rows.parquet(new)
        if fs.exists(here):
            fs.rename(here, aside)
        if not fs.rename(there, here):
            raise OSError(f"{new} can't be renamed to {path}")
    finally:
        fs.delete(there, True)
    fs.delete(aside, True)


def load_cube(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, columns: tuple[int, int] | None = None, tile: int = 512) -> DataFrame:
    """The pixels of a region (bounds included), reading only the tiles that it meets."""
    df = spark.read.parquet(path)
    for axis, bounds in (("y", rows), ("x", columns)):
        if bounds:
            df = df.where(F.col(f"tile_{axis}").between(bounds[0] // tile, bounds[1] // tile) & F.col(axis).between(*bounds))
    return df.drop("tile_y", "tile_x")


def pending(rows: DataFrame, written: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys aren't written yet."""
    return rows.join(written.select(*keys).distinct(), list(keys), "left_anti")


def append_new(rows: DataFrame, path: str, *keys: str, by: str | None = None) -> None:
    """Appends the rows whose keys the store at ``path`` doesn't have, so that a job that is run again adds nothing twice."""
    try:
        old = rows.sparkSession.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        rows = pending(rows, old, *keys)
    writer = rows.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def save_band_blocks(pixels: DataFrame, path: str, block: int = 4, array: str = "dn", mode: str = "overwrite") -> None:
    """A cube in blocks of ``block`` bands, each a folder: a reader of some bands opens their blocks only."""
    size = F.size(array)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / block).cast("int")), lambda b: F.struct(b.alias("block"), F.slice(array, b * block + 1, F.lit(block)).alias("values")))
    rows = pixels.where(size > 0).select("y", "x", F.explode(blocks).alias("b")).select("b.block", "y", "x", "b.values")
    rows.repartition("block", F.floor(F.col("y") / 512)).sortWithinPartitions("block", "y", "x").write.partitionBy("block").mode(mode).parquet(path)


def load_bands(spark: SparkSession, path: str, bands: list[int], block: int = 4) -> DataFrame:
    """y, x, band and v of some bands, from their blocks."""
    rows = spark.read.parquet(path).where(F.col("block").isin(sorted({b // block for b in bands})))
    long = rows.select("y", "x", F.posexplode("values").alias("at", "v"), "block").withColumn("band", F.col("block") * block + F.col("at"))
    return long.where(F.col("band").isin(bands)).select("y", "x", "band", "v")


def save_scene(pixels: DataFrame, bands: DataFrame, path: str, array: str = "refl", layout: str = "pixels", tile: int = 512, **attributes) -> None:
    """The cube (by pixels, or in blocks of bands), its bands (band, wl) and attributes, after checks.

    Every pixel must have as many values as there are bands, and a position of its own.
    """
    n, wrong, places = pixels.agg(F.count(F.lit(1)), F.count_if(F.size(array) != bands.count()), F.count_distinct("y", "x")).first()
    if wrong or places != n:
        raise ValueError(f"{wrong} pixels lack bands, {n - places} have no place of their own")
    if layout == "pixels":
        save_cube(pixels, f"{path}/cube", tile)
    else:
        save_band_blocks(pixels, f"{path}/cube", array=array)
    bands.coalesce(1).write.mode("overwrite").parquet(f"{path}/bands")
    one = [(json.dumps({**attributes, "layout": layout, "tile": tile, "array": array}, sort_keys=True),)]
    pixels.sparkSession.createDataFrame(one, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/attributes")


def add_layer(layer: DataFrame, path: str, name: str, mode: str = "overwrite") -> None:
    """A further table of a scene by position (y, x); the cube isn't written again."""
    save_cube(layer, f"{path}/{name}", attributes_of(layer.sparkSession, path)["tile"], mode)


def attributes_of(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/attributes").first().value)


def load_scene(spark: SparkSession, path: str, *layers: str, rows: tuple[int, int] | None = None, columns: tuple[int, int] | None = None) -> DataFrame:
    """Pixels of a scene with the layers asked for, null where a layer has none."""
    tile = attributes_of(spark, path)["tile"]
    out = load_cube(spark, f"{path}/cube", rows, columns, tile)
    for name in layers:
        out = out.join(load_cube(spark, f"{path}/{name}", rows, columns, tile), ["y", "x"], "left")
    return out
