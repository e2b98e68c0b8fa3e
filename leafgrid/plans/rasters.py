"""Registered queries that take the supplied scene through raster files and stores and back."""

from __future__ import annotations

import math
import uuid
from datetime import date
from functools import reduce

from pyspark.sql import functions as F

from leafgrid.functions.columns import portable_hash
from leafgrid.functions.spectra import kernels, smoothed
from leafgrid.operators.samples import capped
from leafgrid.plans import views as V
from leafgrid.plans.queries import ORACLE_SQL, _masked, query
from leafgrid.plans.views import CELLS
from leafgrid.sources.catalog import join_layers, read_days, replace_months, save_layer
from leafgrid.sources.geotiff import write_tiles
from leafgrid.sources.rasters import open_raster
from leafgrid.sources.snapshots import Snapshots
from leafgrid.sources.store import scratch_folder
from leafgrid.sources.zarr import write_zarr
from leafgrid.streaming.inbox import watch_inbox, write_once
from leafgrid.streaming.stopping import watch_runs

#: What tells a place without a pixel from a pixel without a value in a Zarr array; reflectances are finite.
GAPS = {"fill": -math.inf, "null": math.nan}


@query(f"WITH {CELLS} SELECT y, x, band, r FROM refl WHERE y BETWEEN 3 AND 17 AND x >= 5")
def zarr_window(spark, sf):
    """The scene as a Zarr array, of which a window is read by the chunks that it meets."""
    path = scratch_folder(spark)
    write_zarr(V.pixels(spark, sf), path, "reflectance", "refl", (16, 8, 8), "float64", version=3, **GAPS)
    window = open_raster(spark, "zarr", path, "y between 3 and 17 and x >= 5", array="reflectance", gaps="true")
    return window.select("y", "x", F.posexplode("v").alias("band", "r")).withColumn("band", F.col("band").cast("long"))


@query(f"WITH {CELLS} SELECT band, count(*) AS n, count(r) AS known, round(avg(r), 6) AS mean FROM refl WHERE band IN (3, 40) GROUP BY band")
def zarr_bands(spark, sf):
    """Two bands of the scene from a Zarr array, as a row for each value: the chunks of their blocks alone are read."""
    path = scratch_folder(spark)
    write_zarr(V.pixels(spark, sf), path, "reflectance", "refl", (4, 64, 16), "float64", **GAPS)
    cells = open_raster(spark, "zarr", path, "band in (3, 40)", array="reflectance", layout="cells", gaps="true")
    return cells.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("known"), F.round(F.avg("v"), 6).alias("mean"))


@query(
    f"""WITH {CELLS}, px AS (SELECT y, x, max(CASE WHEN band = 12 THEN r END) AS nir FROM refl GROUP BY y, x), f(factor) AS (VALUES (2), (4), (8))
SELECT factor::BIGINT AS factor, y // factor AS y, x // factor AS x, round(avg(nir), 11) AS mean FROM px, f GROUP BY factor, y // factor, x // factor HAVING count(nir) > 0"""
)
def overviews(spark, sf):
    """The overviews of a band, made as its tiled GeoTIFF sheets are written, and read from them."""
    path = scratch_folder(spark)
    write_tiles(V.pixels(spark, sf).select("y", "x", F.element_at("refl", 13).alias("nir")), path, "nir", tile=64, block=16, overviews=(2, 4, 8), dtype="float64", predictor=3)
    levels = [open_raster(spark, "geotiff", path, level=i).select(F.lit(2**i).cast("long").alias("factor"), "y", "x", F.round(F.col("v")[0], 11).alias("mean")) for i in (1, 2, 3)]
    return levels[0].unionByName(levels[1]).unionByName(levels[2]).where("mean IS NOT NULL")


@query(f"WITH {CELLS} SELECT 'part' || (y % 3) AS cube, count(r) AS n, round(avg(r), 6) AS mean FROM refl WHERE band = 12 GROUP BY y % 3")
def inbox_scores(spark, sf):
    """Three cubes that come into an inbox, each scored once by a stream that is started anew after each."""
    path, px = scratch_folder(spark), V.pixels(spark, sf)
    for k in range(3):
        write_zarr(px.where(F.col("y") % 3 == k), f"{path}/inbox/part{k}", "reflectance", "refl", (16, 32, 32), "float64")
        stream = watch_inbox(spark, f"{path}/inbox", f"{path}/log", kind="zarr", array="reflectance", bands="12")
        nir = F.element_at("v", 1)
        score = lambda rows: rows.groupBy("cube").agg(F.count(nir).alias("n"), F.round(F.avg(nir), 6).alias("mean"))  # noqa: B023, E731
        write_once(stream, score, f"{path}/scores", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/scores").select("cube", "n", "mean")


@query(ORACLE_SQL["early_stop"])
def early_stop_stream(spark, sf):
    """The runs of the log judged by a stream, which a late row of another run closes."""
    path, events = scratch_folder(spark), V.read(spark, sf, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    events.write.parquet(f"{path}/log")
    last = events.agg(F.max("ts")).select(F.lit(-1).cast(events.schema["user_id"].dataType).alias("user_id"), F.lit(-1).cast(events.schema["event_id"].dataType).alias("event_id"), (F.col("max(ts)") + F.expr("INTERVAL 1 DAY")).alias("ts"), F.lit(0.0).cast(events.schema["value"].dataType).alias("value"))
    last.write.mode("append").parquet(f"{path}/log")
    judged = watch_runs(spark.readStream.schema(events.schema).parquet(f"{path}/log"), "value", "event_id", "ts", 5, "user_id")
    judged.writeStream.format("parquet").option("path", f"{path}/judged").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/judged").where("user_id >= 0").select("user_id", "event_id", "stale", "stop")


@query(f"WITH {CELLS}, px AS (SELECT DISTINCT vec_id, label FROM cells), t AS (SELECT 1 AS version, label FROM px WHERE label < 5 UNION ALL SELECT 2, label FROM px UNION ALL SELECT 3, label FROM px WHERE label <> 2) SELECT CAST(version AS BIGINT) AS version, label, count(*) AS n FROM t GROUP BY ALL")
def snapshot_versions(spark, sf):
    """Three versions of a scene's layer, the last made from the one before, each read as it was."""
    snaps, px = Snapshots(spark, scratch_folder(spark)), V.pixels(spark, sf).select("y", "x", "label")
    snaps.save("labels", px.where("label < 5"))
    snaps.save_cube("labels", px, "first", tile=16, rows_at_once=8)
    snaps.save("labels", snaps.load_cube("labels").where("label <> 2"))
    counts = [snaps.load("labels", v).groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(F.lit(v).cast("long").alias("version"), "label", "n") for v in (1, 2, 3)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(ORACLE_SQL["training_table"])
def bucketed_training_table(spark, sf):
    """The table that models are fitted on, from layers that lie in the catalog in buckets of tiles: no exchange joins them."""
    path, px, run = scratch_folder(spark), _masked(spark, sf), uuid.uuid4().hex
    split = px.select("y", "x", F.when(F.col("y") % 5 == 3, 2).when(F.col("y") % 5 == 4, 3).otherwise(1).alias("split_id"))
    layers = {"refl": px.select("y", "x", "refl"), "class": px.where("label < 8").select("y", "x", (F.col("label") % 4).alias("class")), "split": split, "veg": px.where("veg").select("y", "x")}
    for name, layer in layers.items():
        save_layer(layer, f"{name}_{run}", 16, 16, f"{path}/{name}")
    got = join_layers(spark, *[f"{name}_{run}" for name in layers])
    known = F.filter("refl", lambda v: v.isNotNull())
    return got.select("y", "x", "class", "split_id", F.round(F.aggregate(known, F.lit(0.0), lambda a, v: a + v), 6).alias("total"), F.size(known).cast("long").alias("n"))


@query(
    """WITH o AS (SELECT *, date_trunc('month', o_orderdate) AS m FROM orders), t AS (SELECT * FROM o WHERE m <> DATE '1995-03-01' OR o_orderstatus = 'F')
SELECT CAST(m AS DATE) AS month, count(*) AS n, round(sum(CAST(o_totalprice AS DOUBLE)), 2) AS total FROM t WHERE o_orderdate BETWEEN DATE '1995-01-17' AND DATE '1995-06-11' GROUP BY m"""
)
def replaced_month(spark, sf):
    """Orders by month in the catalog, of which one month is run again with other rows; then a range of days."""
    table, orders = f"orders_{uuid.uuid4().hex}", V.read(spark, sf, "orders").withColumn("day", F.col("o_orderdate").cast("date")).select("o_orderkey", "o_orderstatus", "o_totalprice", "day")
    replace_months(orders, table, "day", scratch_folder(spark))
    replace_months(orders.where("day BETWEEN '1995-03-01' AND '1995-03-31' AND o_orderstatus = 'F'"), table, "day")
    rows = read_days(spark, table, "day", date(1995, 1, 17), date(1995, 6, 11))
    return rows.groupBy(F.trunc("day", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("o_totalprice").cast("double")), 2).alias("total"))


#: Bands of the supplied scene between the water windows, and the windows of the fits.
_DRY, _WINDOW = [(0, 29), (33, 44), (48, 64)], 7


def _weights(derivative: int) -> str:
    rows = [(first + i, first + at + j, w) for first, end in _DRY for i, (at, weights) in enumerate(kernels(end - first, _WINDOW, 2, derivative, V.STEP_NM)) for j, w in enumerate(weights)]
    return ", ".join(f"({i}, {j}, {w!r}::DOUBLE)" for i, j, w in rows)


def _smooth_sql(derivative: int) -> str:
    return f"""WITH {CELLS}, k(band, seen, w) AS (VALUES {_weights(derivative)})
SELECT y, x, k.band::BIGINT AS band, CASE WHEN count(r) = {_WINDOW} THEN round(sum(r * w), 8) + 0.0::DOUBLE END AS v FROM refl JOIN k ON refl.band = k.seen GROUP BY y, x, k.band"""


def _smooth(spark, sf, derivative: int):
    px = V.pixels(spark, sf).select("y", "x", smoothed(F.col("refl"), _DRY, _WINDOW, 2, derivative, V.STEP_NM).alias("v"))
    rows = px.select("y", "x", F.posexplode("v").alias("band", "v")).select("y", "x", F.col("band").cast("long").alias("band"), F.round("v", 8).alias("v"))
    return rows.where(reduce(lambda a, b: a | b, [F.col("band").between(first, end - 1) for first, end in _DRY]))


@query(_smooth_sql(0))
def smoothed_spectra(spark, sf):
    """Spectra smoothed by parabolas over seven bands, each part between water windows by itself."""
    return _smooth(spark, sf, 0)


@query(_smooth_sql(1))
def spectral_slopes(spark, sf):
    """First derivatives by wavelength, by the same fits."""
    return _smooth(spark, sf, 1)


@query("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY ((l_orderkey * 8 + l_linenumber + 42) * 2654435761) % 4294967296, l_orderkey, l_linenumber LIMIT 200000")
def large_sample(spark, sf):
    """A sample of at most 200,000 rows, the same on every run."""
    rows = V.read(spark, sf, "lineitem").select(F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_linenumber").cast("long").alias("l_linenumber"))
    return capped(rows, 200_000, portable_hash(F.col("l_orderkey") * 8 + F.col("l_linenumber")), "l_orderkey", "l_linenumber")
