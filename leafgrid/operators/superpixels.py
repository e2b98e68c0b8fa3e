"""Superpixels: k-means in windows of a few cells around each centre, connected labels, and small pieces joined to their neighbours.

A cell is a square of ``step`` pixels; a pixel may choose only among the centres that began in its own cell and the eight around it.
So a task needs no more than a tile and a border of one cell, and all pixels of a centre lie within three cells a side.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrid.operators.models import complete
from leafgrid.sources.catalog import save_layer
from leafgrid.sources.store import kept, scratch_folder

#: Numbers of pixels and tiles are row * PITCH + column.
PITCH = 1 << 31
SCHEMA = "y long, x long, superpixel long"


def superpixels(
    pixels: DataFrame, step: int = 16, compactness: float = 0.1, rounds: int = 10, least: int | None = None, array: str = "features", steps: int = 32, buckets: int | None = None, resolution: float = 1e6
) -> DataFrame:
    """Complete pixels with the number (y * 2^31 + x of its first pixel, row by row) of the connected superpixel of each: y, x, superpixel.

    The distance to a centre is the squared difference of the vectors plus (``compactness`` / ``step``)^2 times the squared
    distance in pixels; of equals the first centre, by its cell, is chosen. Centres begin as the means of their cells and move to
    the means of their pixels, at most ``rounds`` times. Then each connected piece (by sides) of a centre's pixels is a superpixel
    if it has ``least`` pixels (a quarter of a cell by default); a smaller one joins the neighbour with the longest common border, the
    first of equals, in turns: neighbours that have joined in this turn count from the next on. Pieces that no superpixel touches stay.

    Values are taken in steps of 1 / ``resolution``, so sums are exact, and neither the order of rows nor ``steps`` (cells to a
    tile's side) nor ``buckets`` (as many as the session's shuffle partitions by default) changes the result. Pixels are dealt into buckets once; a round moves centres only, one for each
    cell. Positions aren't negative and occur once; rows without a position or with an incomplete vector are left out.
    """
    spark = pixels.sparkSession
    rows = complete(pixels.where("y IS NOT NULL AND x IS NOT NULL"), array)
    rows = rows.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.transform(array, lambda v: F.round(v * resolution).cast("long")).alias("v"))
    rows = rows.withColumn("ci", F.floor(F.col("y") / step)).withColumn("cj", F.floor(F.col("x") / step))
    table = f"superpixels_{uuid.uuid4().hex}"
    save_layer(rows, table, step * steps, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), scratch_folder(spark))
    try:
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # candidates are dealt by tile, as the pixels are
        dealt = spark.table(table)
        short, long = dealt.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
        if short != long:
            raise ValueError(f"vectors have from {short} to {long} values")
        if long is None:
            return spark.createDataFrame([], SCHEMA)
        weight = (compactness * resolution / step) ** 2
        centres = kept(_means(dealt.withColumn("mi", F.col("ci")).withColumn("mj", F.col("cj")), long, "tile"))
        for _ in range(rounds):
            moved = kept(_means(_assign(dealt, centres, weight, steps), long))
            still = moved.exceptAll(centres).isEmpty()
            centres = moved
            if still:
                break
        pieces = kept(_pieces(_assign(dealt, centres, weight, steps).select("y", "x", "mi", "mj"), step, steps))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    return _join_small(pieces, step * step // 4 if least is None else least)


def _means(rows: DataFrame, size: int, *by: str) -> DataFrame:
    """Each centre's mean position and vector; the sums are of whole numbers. ``by``: what the rows are dealt by already."""
    n = F.count(F.lit(1)).cast("double")
    mean = lambda value: F.sum(value).cast("double") / n
    return rows.groupBy(*by, "mi", "mj").agg(mean(F.col("y")).alias("y"), mean(F.col("x")).alias("x"), F.array(*[mean(F.col("v")[i]) for i in range(size)]).alias("v")).drop(*by)


def _assign(dealt: DataFrame, centres: DataFrame, weight: float, steps: int) -> DataFrame:
    """Pixels with the cell (mi, mj) of the nearest centre. Each centre is sent to nine cells; the pixels stay in their buckets."""
    around = F.explode(F.array(*[F.struct((F.col("mi") + i).alias("ci"), (F.col("mj") + j).alias("cj")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    sent = centres.select(around.alias("cell"), F.struct("mi", "mj", "y", "x", "v").alias("centre")).select("cell.ci", "cell.cj", "centre")
    tile = (F.floor(F.col("ci") / steps) * F.lit(PITCH) + F.floor(F.col("cj") / steps)).cast("long")
    near = sent.groupBy("ci", "cj").agg(F.collect_list("centre").alias("near")).withColumn("tile", tile)

    def distance(c: Column) -> Column:
        apart = F.aggregate(F.zip_with("v", c["v"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda total, d: total + d)
        dy, dx = F.col("y") - c["y"], F.col("x") - c["x"]
        return apart + weight * (dy * dy + dx * dx)

    best = F.array_min(F.transform("near", lambda c: F.struct(distance(c).alias("d"), c["mi"].alias("mi"), c["mj"].alias("mj"))))
    return dealt.join(near.hint("shuffle_hash"), ["tile", "ci", "cj"]).withColumn("best", best).select("y", "x", "v", "best.mi", "best.mj")


def _pieces(assigned: DataFrame, step: int, steps: int) -> DataFrame:
    """The connected pieces of each centre's pixels: y, x, piece (its first pixel) and n (its pixels).

    A task labels the centres of ``steps`` by ``steps`` cells, whose pixels reach one cell further at most.
    """
    side = (steps + 2) * step

    def label(key: tuple, table: pa.Table) -> pa.Table:
        top, left = ((k.as_py() * steps - 1) * step for k in key)
        y, x, mi, mj = (table.column(c).to_numpy() for c in ("y", "x", "mi", "mj"))
        own = np.full((side, side), -1, np.int64)
        own[y - top, x - left] = mi % steps * steps + mj % steps
        first = np.arange(side * side).reshape(side, side)
        views = [(np.s_[:-1], np.s_[1:]), (np.s_[:, :-1], np.s_[:, 1:])]
        alike = [(own[a] == own[b]) & (own[a] >= 0) for a, b in views]
        while True:  # the least number spreads over alike neighbours, and along what they point to
            before = first.copy()
            for (a, b), same in zip(views, alike, strict=True):
                low = np.minimum(first[a], first[b])
                first[a] = np.where(same, low, first[a])
                first[b] = np.where(same, np.minimum(low, first[b]), first[b])
            first = first.ravel()[first]
            if (first == before).all():
                break
        at = first[y - top, x - left]
        n = np.bincount(at, minlength=1)
        return pa.table({"y": pa.array(y), "x": pa.array(x), "piece": pa.array((at // side + top) * PITCH + at % side + left), "n": pa.array(n[at])})

    block = assigned.withColumn("bi", F.floor(F.col("mi") / steps)).withColumn("bj", F.floor(F.col("mj") / steps))
    return block.groupBy("bi", "bj").applyInArrow(label, "y long, x long, piece long, n long")


def _join_small(pieces: DataFrame, least: int) -> DataFrame:
    """Pieces of fewer than ``least`` pixels take the superpixel that they share the longest border with, turn by turn.

    Only pixels of small pieces are sent to their neighbours, and a turn moves borders of small pieces only.
    """
    sides = F.explode(F.array(*[F.struct((F.col("y") + i).alias("y"), (F.col("x") + j).alias("x")) for i, j in ((-1, 0), (1, 0), (0, -1), (0, 1))]))
    asked = pieces.where(F.col("n") < least).select(sides.alias("at"), "piece").select("at.y", "at.x", "piece")
    met = asked.join(pieces.select("y", "x", F.col("piece").alias("other"), "n"), ["y", "x"]).where("piece <> other")
    borders = kept(met.groupBy("piece", "other").agg(F.count(F.lit(1)).alias("border"), F.when(F.first("n") >= least, F.col("other")).alias("target")))
    joined = None
    while True:
        shared = borders.where("target IS NOT NULL").groupBy("piece", "target").agg(F.sum("border").alias("border"))
        turn = kept(shared.groupBy("piece").agg(F.max(F.struct("border", (-F.col("target")).alias("last"))).alias("best")).select("piece", (-F.col("best.last")).alias("superpixel")))
        if turn.isEmpty():
            break
        joined = turn if joined is None else joined.unionByName(turn)
        reached = turn.select(F.col("piece").alias("other"), "superpixel")
        borders = kept(borders.join(turn, "piece", "left_anti").join(reached, "other", "left").select("piece", "other", "border", F.coalesce("target", "superpixel").alias("target")))
    if joined is None:
        return pieces.select("y", "x", F.col("piece").alias("superpixel"))
    return pieces.join(joined, "piece", "left").select("y", "x", F.coalesce("superpixel", "piece").alias("superpixel"))


def superpixel_means(pixels: DataFrame, labels: DataFrame, array: str = "features") -> DataFrame:
    """Each superpixel's pixels, middle and mean vector (over the values that are there): superpixel, n, y, x, mean."""
    rows = pixels.select("y", "x", F.col(array).alias("_v")).join(labels, ["y", "x"])
    size = pixels.agg(F.max(F.size(array)).alias("m")).first()["m"] or 0
    return rows.groupBy("superpixel").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"), F.avg("x").alias("x"), F.array(*[F.avg(F.try_element_at("_v", F.lit(i + 1))) for i in range(size)]).cast("array<double>").alias("mean"))
