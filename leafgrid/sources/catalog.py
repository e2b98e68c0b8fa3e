"""Catalog tables: layers bucketed by tile, which join by position without a shuffle, and tables of which single months are replaced."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tile_of(tile: int) -> Column:
    """One number for each tile of ``tile`` pixels a side."""
    return (F.floor(F.col("y") / tile) * F.lit(1 << 31) + F.floor(F.col("x") / tile)).cast("long")


def save_layer(layer: DataFrame, table: str, tile: int = 512, buckets: int = 200, path: str | None = None) -> None:
    """Pixels (y, x, ...) as a catalog table in ``buckets`` buckets of whole tiles, one file each, sorted by tile and position.

    This is the one shuffle of the layer; layers of the same ``tile`` and ``buckets`` join without another (see :func:`join_layers`).
    Take as many buckets as give files of some hundred megabytes of the largest layer. The table is replaced if it is there.
    """
    rows = layer.withColumn("tile", tile_of(tile)).repartition(buckets, "tile")
    writer = rows.write.bucketBy(buckets, "tile").sortBy("tile", "y", "x").mode("overwrite").option("tile_side", tile)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def layout_of(spark: SparkSession, table: str) -> tuple[int, int]:
    """The side of a layer's tiles and its number of buckets, as the catalog has them."""
    if not spark.catalog.tableExists(table):
        raise ValueError(f"the catalog has no table {table}")
    found = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
    sides = [p.partition("=")[2] for p in (found.get("Storage Properties") or "").strip("[]").split(", ") if p.startswith("tile_side=")]
    if found.get("Bucket Columns") != "[`tile`]" or not sides:
        raise ValueError(f"{table} is no layer in buckets of tiles")
    return int(sides[0]), int(found["Num Buckets"])


def join_layers(spark: SparkSession, *tables: str, tiles: list[tuple[int, int]] | None = None) -> DataFrame:
    """The pixels that all layers have, with the columns of all, joined bucket by bucket.

    ``tiles``: rows and columns of the tiles to read; only the buckets that hold them are opened. Buckets are by tile and the join
    by tile and position, which Spark takes as dealt alike when a setting allows it; this turns it on for the session.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    layouts = {t: layout_of(spark, t) for t in tables}
    if len(set(layouts.values())) > 1:
        raise ValueError(f"the layers differ in side of tiles and number of buckets: {layouts}")
    chosen = [(y << 31) + x for y, x in tiles] if tiles is not None else None
    read = lambda t: spark.table(t) if chosen is None else spark.table(t).where(F.col("tile").isin(chosen))
    out = read(tables[0])
    for table in tables[1:]:
        out = out.join(read(table).hint("merge"), ["tile", "y", "x"])
    return out.drop("tile")


def replace_months(rows: DataFrame, table: str, day: str, path: str | None = None) -> None:
    """Writes rows into a catalog table partitioned by ``month`` (the first of the month of the date column ``day``).

    Months that the rows have are replaced as a whole, and the others stay as they are, so a month can be run again. A table that
    isn't there is made. Rows without a date are an error, as no later run would replace them.
    """
    spark = rows.sparkSession
    if rows.where(F.col(day).isNull()).limit(1).count():
        raise ValueError(f"some rows have no {day}")
    rows = rows.withColumn("month", F.trunc(day, "month"))
    if not spark.catalog.tableExists(table):
        writer = rows.repartition("month").write.partitionBy("month")
        (writer.option("path", path) if path else writer).saveAsTable(table)
        return
    known = spark.table(table).columns
    if sorted(known) != sorted(rows.columns):
        raise ValueError(f"{table} has the columns {known}, not {rows.columns}")
    setting = "spark.sql.sources.partitionOverwriteMode"  # insertInto knows it as the session's only
    before = spark.conf.get(setting)
    spark.conf.set(setting, "dynamic")
    try:
        rows.select(*known).repartition("month").write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(setting, before)


def read_days(spark: SparkSession, table: str, day: str, first: date, last: date) -> DataFrame:
    """Rows from ``first`` to ``last``, both included; other months aren't read."""
    months = F.col("month").between(F.lit(first.replace(day=1)), F.lit(last.replace(day=1)))
    return spark.table(table).where(months & F.col(day).between(F.lit(first), F.lit(last))).drop("month")
