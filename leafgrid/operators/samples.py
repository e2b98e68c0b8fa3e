"""Samples, splits and orders that any run repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgrid.functions.columns import portable_hash
from leafgrid.operators.ranks import place_in_group


def stripes(pixels: DataFrame, n: int) -> DataFrame:
    """The pixels of ``n`` rows of the scene, from the first (0) to the last at even distances."""
    last = pixels.agg(F.max("y")).first()[0]
    chosen = sorted({i * last // (n - 1) if n > 1 else 0 for i in range(n)}) if last is not None else []
    return pixels.where(F.col("y").isin(chosen))


def stratified(rows: DataFrame, by: str, share: float, key: str = "id", seed: int = 42) -> DataFrame:
    """``rows`` with train: true for the first ``share`` of each class by a hash of ``key``."""
    if not 0 < share < 1:
        raise ValueError("the share must lie between 0 and 1")
    return place_in_group(rows, by, portable_hash(F.col(key), seed), key).withColumn("train", F.col("k") <= F.floor(F.col("m") * share)).drop("k", "m")


def capped(rows: DataFrame, n: int, key: Column, *ties: str, span: int = 1 << 32, few: int = 10_000) -> DataFrame:
    """The ``n`` rows with the smallest ``key`` (a hash in [0, span), spread evenly), and of equal ones those smallest in ``ties``.

    The key up to which rows are in is narrowed down by counts of 1,024 cells of the range that holds it; only the rows of the last
    cell, about ``few``, are sorted. So nothing of the sample's size goes through one task or the driver. Rows without a key
    are left out; a table of no more than ``n`` rows stays whole.
    """
    rows = rows.withColumn("_key", key).where("_key IS NOT NULL")
    low, width, below, inside = 0, span, 0, rows.count()
    if n >= inside:
        return rows.drop("_key")
    while inside > few and width > 1:
        side = -(-width // 1024)
        cells = rows.where(F.col("_key").between(low, low + width - 1)).groupBy(F.floor((F.col("_key") - low) / side).alias("cell")).count()
        for r in cells.orderBy("cell").collect():  # at most 1,024
            if below <= n < below + r["count"]:
                low, width, inside = low + r.cell * side, side, r["count"]
                break
            below += r["count"]
    last = rows.where(F.col("_key").between(low, low + width - 1)).orderBy("_key", *ties).limit(n - below)
    return rows.where(F.col("_key") < low).unionByName(last).drop("_key")


def split_of_groups(rows: DataFrame, by: str, key: str, shares: tuple[float, float] = (0.6, 0.2), seed: int = 42) -> DataFrame:
    """``rows`` (one for each group) with split_id: 1 for the first share of each class ``by`` in the order of a hash of ``key``, 2 for
    the next, 3 for the rest. Shares must be positive and leave something to the third."""
    if not all(0 < s < 1 for s in shares) or sum(shares) >= 1:
        raise ValueError(f"shares of train and validation must be positive and below 1 together, not {shares}")
    placed = place_in_group(rows, by, portable_hash(F.col(key), seed), key)
    train, val = (F.floor(F.col("m") * s) for s in shares)
    return placed.withColumn("split_id", F.when(F.col("k") <= train, 1).when(F.col("k") <= train + val, 2).otherwise(3)).drop("k", "m")


def first_of(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Of rows with the same ``by`` the one with the smallest ``order``, combined on the map side."""
    others = [c for c in rows.columns if c not in by]
    one = rows.groupBy(*by).agg(F.min_by(F.struct(*others), order).alias("one"))
    return one.select(*[F.col(c) if c in by else F.col("one")[c].alias(c) for c in rows.columns])


def in_order(rows: DataFrame, column: str, values: list) -> DataFrame:
    """``rows`` by a list of values, with place; values without a row are there too, and rows without a value are not."""
    kind = rows.schema[column].dataType.simpleString()
    order = rows.sparkSession.createDataFrame(list(enumerate(values)), f"place int, `{column}` {kind}")
    return F.broadcast(order).join(rows, column, "left").orderBy("place")
