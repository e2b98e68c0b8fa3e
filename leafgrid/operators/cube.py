"""Operators on pixel tables: y, x and an array of band values, with a band dimension of band and wl."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgrid.functions import columns as C
from leafgrid.operators.ranks import array_quantiles


def nearest_band(bands: DataFrame, target: float) -> DataFrame:
    """The band whose wavelength is nearest; of equals the first."""
    return bands.orderBy(F.abs(F.col("wl") - target), "band").limit(1)


def nearest_in_range(bands: DataFrame, low: float, high: float) -> DataFrame:
    """The band nearest to the middle of a range, from inside it if there is one."""
    inside = F.col("wl").between(low, high)
    return bands.orderBy((~inside).cast("int"), F.abs(F.col("wl") - (low + high) / 2), "band").limit(1)


def long_form(pixels: DataFrame, array: str = "refl", *keep: str) -> DataFrame:
    """One row for each pixel and band. For statistics at cube scale prefer the array functions."""
    return pixels.select("y", "x", *keep, F.posexplode(array).alias("band", "v"))


def band_statistics(pixels: DataFrame, where: Column | None = None, array: str = "refl") -> DataFrame:
    """Per band over chosen pixels: n, mean, sd (population), low, high and snr, in one pass with partial sums."""
    rows = long_form(pixels if where is None else pixels.where(where), array)
    sd = F.stddev_pop("v")
    return rows.groupBy("band").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), sd.alias("sd"), F.min("v").alias("low"), F.max("v").alias("high"), (F.avg("v") / F.when(sd > 0, sd)).alias("snr"))


def segments(bands: DataFrame, factor: float = 2.5) -> DataFrame:
    """Contiguous runs of bands: a gap of more than ``factor`` median steps begins a new one. Sees the band dimension only."""
    w = Window.orderBy("wl")
    steps = bands.withColumn("step", F.col("wl") - F.lag("wl").over(w))
    typical = steps.agg(F.percentile("step", F.lit(0.5)).alias("typical"))
    cut = F.when(F.col("step") > factor * F.col("typical"), 1).otherwise(0)
    # One row for the typical step; the band dimension is a few hundred rows.
    return steps.join(F.broadcast(typical)).withColumn("seg", F.sum(cut).over(w).cast("long")).drop("typical")


def lagged_correlation(pixels: DataFrame, lags: list[int], array: str = "refl", least: int = 10) -> DataFrame:
    """Correlation of each band with the one ``lag`` further on: band, lag, n, corr.

    A partition gives one row of sums for each band and lag, and the shuffle adds those; null for no more than ``least``
    pixels or for constant bands. All vectors must have as many values.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                for k in lags:
                    if k < x.shape[1]:
                        a, b = x[:, : x.shape[1] - k], x[:, k:]
                        both = ~(np.isnan(a) | np.isnan(b))
                        a, b = np.where(both, a, 0.0), np.where(both, b, 0.0)
                        total[k] = total.get(k, 0) + np.stack([both.sum(0), a.sum(0), b.sum(0), (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)])
        for k, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(t.shape[1]), pa.int32()), pa.array([k] * t.shape[1], pa.int32()), *map(pa.array, t)], ["band", "lag", "n", "sa", "sb", "saa", "sbb", "sab"])

    names = ["n", "sa", "sb", "saa", "sbb", "sab"]
    rows = pixels.where(F.col(array).isNotNull()).select(array).mapInArrow(sums, "band int, lag int, n double, sa double, sb double, saa double, sbb double, sab double")
    n, sa, sb, saa, sbb, sab = map(F.col, names)
    spread = (n * saa - sa * sa) * (n * sbb - sb * sb)
    return rows.groupBy("band", "lag").agg(*[F.sum(c).alias(c) for c in names]).select("band", "lag", n.cast("long").alias("n"), F.when((n > least) & (spread > 1e-12), (n * sab - sa * sb) / F.sqrt(spread)).alias("corr"))


def decorrelation_curve(corr: DataFrame, bands: DataFrame) -> DataFrame:
    """Per segment and lag the median distance and the median correlation of its pairs of bands: seg, lag, delta_nm, corr.

    ``corr`` is what lagged_correlation gives, ``bands`` has seg, band and wl; pairs across two segments don't count.
    """
    one = bands.select("seg", "band", "wl")
    other = bands.select(F.col("seg").alias("seg2"), F.col("band").alias("band2"), F.col("wl").alias("wl2"))
    pairs = corr.join(one, "band").join(other, (F.col("band2") == F.col("band") + F.col("lag")) & (F.col("seg") == F.col("seg2"))).where("corr IS NOT NULL")
    return pairs.groupBy("seg", "lag").agg(F.median(F.abs(F.col("wl2") - F.col("wl"))).alias("delta_nm"), F.median("corr").alias("corr"))  # the band dimension


def decorrelation_lengths(curve: DataFrame, thresholds: list[float]) -> DataFrame:
    """Where each segment's curve first falls through a threshold: seg, threshold, length, status, interpolated.

    Status: hit (between two lags, by linear interpolation), >=max (never so low; length is the largest distance), <=min (never
    so high; the smallest), no-data (fewer than two lags), nan (no crossing). ``interpolated`` is the crossing alone, null
    where the threshold lies outside the curve's ends.
    """
    w = Window.partitionBy("seg").orderBy("delta_nm")
    steps = curve.where("corr IS NOT NULL").select("seg", F.col("delta_nm").alias("x"), F.col("corr").alias("y"), F.lag("delta_nm").over(w).alias("x0"), F.lag("corr").over(w).alias("y0"))
    each = steps.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    t, y, y0 = F.col("threshold"), F.col("y"), F.col("y0")
    at = F.col("x0") + F.when(y0 > y, (y0 - t) / (y0 - y)).otherwise(0.0) * (F.col("x") - F.col("x0"))
    crossing = F.min_by(at, F.when((y0 >= t) & (y <= t), F.col("x")))
    got = each.groupBy("seg", "threshold").agg(
        F.count(F.lit(1)).alias("n"), F.min("y").alias("low"), F.max("y").alias("high"), F.min("x").alias("first"), F.max("x").alias("last"),
        F.max_by("y", "x").alias("y_last"), F.min_by("y", "x").alias("y_first"), F.when(F.count(F.when((y0 >= t) & (y <= t), 1)) > 0, crossing).alias("hit"),
    )
    status = F.when(F.col("n") < 2, "no-data").when(F.col("low") > t, ">=max").when(F.col("high") < t, "<=min").when(F.col("hit").isNotNull(), "hit").otherwise("nan")
    length = F.when(F.col("status") == ">=max", F.col("last")).when(F.col("status") == "<=min", F.col("first")).when(F.col("status") == "hit", F.col("hit"))
    return got.withColumn("status", status).select("seg", "threshold", length.alias("length"), "status", F.when(t.between(F.col("y_last"), F.col("y_first")), F.col("hit")).alias("interpolated"))


def stack_layers(*layers: DataFrame) -> DataFrame:
    """Layers joined by position (y, x): pixels that all of them have."""
    out = layers[0]
    for layer in layers[1:]:
        out = out.join(layer, ["y", "x"])
    return out


def coarsen(layer: DataFrame, k: int, value: str, height: int, width: int) -> DataFrame:
    """Means of k x k blocks; blocks that the grid cuts off are left out."""
    inside = (F.col("y") < height // k * k) & (F.col("x") < width // k * k)
    return layer.where(inside).groupBy((F.floor(F.col("y") / k)).cast("long").alias("by"), (F.floor(F.col("x") / k)).cast("long").alias("bx")).agg(F.avg(value).alias("mean"))


def box_valid(pixels: DataFrame, valid: Column, r: int = 2) -> DataFrame:
    """Whether the whole (2r+1)-square around each pixel is there and valid, by two one-dimensional windows: y, x, box_ok.

    Works on dense and sparse tables alike: a missing pixel doesn't count as valid. Only flags are moved.
    """
    rows = pixels.select("y", "x", F.coalesce(valid, F.lit(False)).cast("long").alias("_ok"))
    across = Window.partitionBy("y").orderBy("x").rangeBetween(-r, r)
    down = Window.partitionBy("x").orderBy("y").rangeBetween(-r, r)
    rows = rows.withColumn("_row", F.sum("_ok").over(across))
    return rows.select("y", "x", (F.sum("_row").over(down) == (2 * r + 1) ** 2).alias("box_ok"))


def patches(pixels: DataFrame, centre: Column, valid: Column, r: int = 2, array: str = "features", tile: int = 32) -> DataFrame:
    """Square patches around chosen centres whose whole square is valid: y, x, patch (channel, row, column).

    Pixels are dealt into tiles of ``tile`` pixels a side; those within ``r`` of a tile's border go to its neighbours too, so a
    pixel is sent 1 + 4 r / tile times or so. A task cuts a tile's patches at once. All vectors must have as many values.
    """
    side = 2 * r + 1
    tiles = lambda axis: F.explode(F.array_distinct(F.transform(F.array(F.lit(-r), F.lit(0), F.lit(r)), lambda d: F.floor((F.col(axis) + d) / tile).cast("long"))))
    rows = pixels.where(F.col(array).isNotNull()).select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col(array).cast("array<double>").alias("v"), F.coalesce(valid, F.lit(False)).alias("ok"), F.coalesce(centre, F.lit(False)).alias("centre"))
    spread = rows.withColumn("ty", tiles("y")).withColumn("tx", tiles("x"))

    def cut(key: tuple, table: pa.Table) -> pa.Table:
        top, left = (k.as_py() * tile for k in key)
        y, x = table.column("y").to_numpy() - top + r, table.column("x").to_numpy() - left + r
        v = table.column("v").combine_chunks()
        values = v.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        wide = tile + 2 * r
        grid = np.full((wide, wide, values.shape[1]), np.nan)
        grid[y, x] = values
        ok, centre = np.zeros((wide, wide), bool), np.zeros((wide, wide), bool)
        ok[y, x], centre[y, x] = table.column("ok").to_numpy(zero_copy_only=False), table.column("centre").to_numpy(zero_copy_only=False)
        whole = sliding_window_view(ok, (side, side)).all(axis=(2, 3))
        i, j = np.nonzero(whole & centre[r : r + tile, r : r + tile])
        found = sliding_window_view(grid, (side, side), axis=(0, 1))[i, j]
        nested = pa.array(found.ravel(), from_pandas=True)
        for n, size in ((found.size // side, side), (found.size // side**2, side), (len(i), values.shape[1])):
            nested = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), nested)
        return pa.table({"y": pa.array(i + top, pa.int64()), "x": pa.array(j + left, pa.int64()), "patch": nested})

    return spread.groupBy("ty", "tx").applyInArrow(cut, "y long, x long, patch array<array<array<double>>>")


def patches_of_split(pixels: DataFrame, split: int, valid: Column, r: int = 2, array: str = "features", column: str = "split_id", tile: int = 32) -> DataFrame:
    """Patches around the pixels of one split; pixels of other splits may lie in them. A split that gives no patch is an error."""
    found = patches(pixels, F.col(column) == split, valid, r, array, tile)
    if found.limit(1).count() == 0:
        raise ValueError(f"no pixel with {column} {split} has a whole patch")
    return found


def robust_fit(pixels: DataFrame, array: str = "features") -> DataFrame:
    """Per band: median and interquartile range, exact."""
    found = array_quantiles(pixels, array, [0.25, 0.5, 0.75])
    return found.select("band", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def robust_scale(pixels: DataFrame, fit: DataFrame, array: str = "features") -> DataFrame:
    """``pixels`` with the array scaled by median and interquartile range (1 where that is 0) of ``fit``, from robust_fit."""
    # One entry for each band.
    one = fit.agg(F.map_from_entries(F.collect_list(F.struct("band", F.struct("median", "iqr")))).alias("_fit"))
    scaled = F.transform(array, lambda v, i: (v - F.col("_fit")[i]["median"]) / F.when(F.col("_fit")[i]["iqr"] == 0, 1.0).otherwise(F.col("_fit")[i]["iqr"]))
    return pixels.join(F.broadcast(one)).withColumn(array, scaled).drop("_fit")


def ablate(features: str, which: list[int], means: Column) -> Column:
    """Chosen features replaced by their means."""
    return F.transform(features, lambda v, i: F.when(i.isin(*which), F.element_at(means, i + 1)).otherwise(v))


def boxes_to_pixels(boxes: DataFrame, px: float) -> DataFrame:
    """Pixels that axis-aligned boxes (id, value, x0, y0, x1, y1) touch; where boxes overlap the last id wins."""
    cells = boxes.select("id", "value", F.explode(F.sequence(F.floor(F.col("y0") / px).cast("long"), (F.ceil(F.col("y1") / px) - 1).cast("long"))).alias("y"), "x0", "x1")
    cells = cells.select("id", "value", "y", F.explode(F.sequence(F.floor(F.col("x0") / px).cast("long"), (F.ceil(F.col("x1") / px) - 1).cast("long"))).alias("x"))
    return cells.groupBy("y", "x").agg(F.max_by("value", "id").alias("value"))


def polygons_to_pixels(polygons: DataFrame, px: float) -> DataFrame:
    """Pixels whose centre lies in a polygon (id, value, rings of x and y); where polygons overlap the last id wins.

    A row of pixels meets the edges of all rings at sorted places, and lies inside between the first and second, third and
    fourth: so holes need no case of their own. Work goes by polygon and row.
    """
    return _cells_inside(polygons, px).groupBy("y", "x").agg(F.max_by("value", "id").alias("value"))


def _cells_inside(polygons: DataFrame, px: float) -> DataFrame:
    edge = lambda ring: F.transform(ring, lambda p, i: F.struct(p.x.alias("x0"), p.y.alias("y0"), ring[(i + 1) % F.size(ring)].x.alias("x1"), ring[(i + 1) % F.size(ring)].y.alias("y1")))
    first = lambda v: F.ceil(v / px - 0.5).cast("long")
    ys = F.transform(F.flatten("rings"), lambda p: p.y)
    rows = polygons.select("id", "value", F.flatten(F.transform("rings", edge)).alias("edges"), first(F.array_min(ys)).alias("top"), first(F.array_max(ys)).alias("bottom")).where("top < bottom")
    rows = rows.select("id", "value", "edges", F.explode(F.sequence("top", F.col("bottom") - 1)).alias("y")).withColumn("cy", (F.col("y") + 0.5) * px)
    met = F.filter("edges", lambda e: (e.y0 <= F.col("cy")) != (e.y1 <= F.col("cy")))
    rows = rows.select("id", "value", "y", F.array_sort(F.transform(met, lambda e: e.x0 + (F.col("cy") - e.y0) * (e.x1 - e.x0) / (e.y1 - e.y0))).alias("at")).where(F.size("at") > 1)
    spans = F.transform(F.sequence(F.lit(1), F.size("at") - 1, F.lit(2)), lambda i: F.struct(first(F.element_at("at", i)).alias("a"), first(F.element_at("at", i + 1)).alias("b")))
    return rows.select("id", "value", "y", F.explode(spans).alias("s")).where("s.a < s.b").select("id", "value", "y", F.explode(F.sequence("s.a", F.col("s.b") - 1)).alias("x"))


def polygons_touched(polygons: DataFrame, px: float) -> DataFrame:
    """Pixels whose inside meets a polygon (id, value, rings of x and y); where polygons overlap the last id wins.

    A pixel that no edge runs through is inside or outside as a whole, as its centre is; the others are found along the edges,
    row by row.
    """
    edge = lambda ring: F.transform(ring, lambda p, i: F.struct(p.x.alias("xa"), p.y.alias("ya"), ring[(i + 1) % F.size(ring)].x.alias("xb"), ring[(i + 1) % F.size(ring)].y.alias("yb")))
    edges = polygons.select("id", "value", F.explode(F.flatten(F.transform("rings", edge))).alias("e")).select("id", "value", *[(F.col(f"e.{c}") / px).alias(c) for c in ("xa", "ya", "xb", "yb")])
    low, high = F.least("ya", "yb"), F.greatest("ya", "yb")
    rows = edges.withColumn("last", (F.ceil(high) - 1).cast("long")).where(F.col("last") >= F.floor(low)).withColumn("y", F.explode(F.sequence(F.floor(low).cast("long"), "last")))
    at = lambda y: F.when(F.col("ya") == F.col("yb"), F.col("xa")).otherwise(F.col("xa") + (y - F.col("ya")) / F.when(F.col("ya") != F.col("yb"), F.col("yb") - F.col("ya")) * (F.col("xb") - F.col("xa")))
    flat = F.col("ya") == F.col("yb")
    one, two = at(F.greatest(low, F.col("y").cast("double"))), F.when(flat, F.col("xb")).otherwise(at(F.least(high, F.col("y") + 1.0)))
    rows = rows.select("id", "value", "y", F.floor(F.least(one, two)).cast("long").alias("from"), (F.ceil(F.greatest(one, two)) - 1).cast("long").alias("to")).where(F.col("from") <= F.col("to"))
    border = rows.select("id", "value", "y", F.explode(F.sequence("from", "to")).alias("x"))
    inside = _cells_inside(polygons, px)
    return border.unionByName(inside).groupBy("y", "x").agg(F.max_by("value", "id").alias("value"))


def to_map(grid: DataFrame, scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Every pixel of ``grid`` with its probability and class; -1 and 255 where ``scored`` has no row."""
    joined = grid.select("y", "x").join(scored.select("y", "x", "y_prob"), ["y", "x"], "left")
    return joined.select("y", "x", F.coalesce("y_prob", F.lit(-1.0)).alias("y_prob"), F.when(F.col("y_prob").isNull(), 255).when(F.col("y_prob") >= threshold, 1).otherwise(0).alias("class"))
