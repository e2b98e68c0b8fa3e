"""Stores, reports and streams on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafgrid.operators import metrics, models, reports
from leafgrid.plans import queries as Q
from leafgrid.sources.geotiff import GeoTiffSource, write_overviews
from leafgrid.sources.store import append_new, load_cube, pending, save_cube
from leafgrid.streaming.ingest import ingest

SF = "/root/testdata/sf0.001"


def test_store_reads_only_the_tiles_of_a_region(spark, tmp_path):
    px = spark.range(400).select(F.expr("id div 20").alias("y"), (F.col("id") % 20).alias("x"), F.array(F.col("id").cast("double")).alias("refl"))
    save_cube(px, str(tmp_path / "cube"), tile=8)
    got = load_cube(spark, str(tmp_path / "cube"), (3, 9), (17, 18), tile=8)
    assert {(r.y, r.x, r.refl[0]) for r in got.collect()} == {(y, x, 20.0 * y + x) for y in range(3, 10) for x in (17, 18)}
    assert {f.split("tile_y=")[1][:12] for f in got.inputFiles()} >= {"0/tile_x=2/p"}
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(tile_y" in plan.replace("(tile_x", "(tile_y")


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.range(10).withColumn("month", F.col("id") % 3)
    for _ in range(2):
        append_new(rows, path, "id", by="month")
    append_new(spark.range(8, 12).withColumn("month", F.lit(1).cast("long")), path, "id", by="month")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(12))
    assert pending(rows, rows.limit(0), "id").count() == 10 and pending(rows, rows, "id").count() == 0


def test_stream_into_a_store(spark, tmp_path):
    schema = "id long, v double"
    for i, ids in enumerate(([1, 2, 2], [2, 3])):
        spark.createDataFrame([(k, float(k)) for k in ids], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        ingest(stream, str(tmp_path / "out"), str(tmp_path / "state"), "id").trigger(availableNow=True).start().awaitTermination(60)
        assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3][: i + 2]


def test_extents_with_a_hole_far_from_the_origin(spark):
    square = lambda x, y, s: [{"x": x, "y": y}, {"x": x + s, "y": y}, {"x": x + s, "y": y + s}, {"x": x, "y": y + s}]
    far = 4e6
    rows = spark.createDataFrame([(1, [square(far, far, 4.0), square(far, far, 2.0)[::-1]]), (2, [square(0.0, 0.0, 0.0)])], "id int, rings array<array<struct<x:double,y:double>>>")
    a, b = reports.extents(rows).orderBy("id").collect()
    assert (a.x0, a.y0, a.x1, a.y1, a.area) == (far, far, far + 4, far + 4, 12.0)
    assert a.cx - far == pytest.approx((16 * 2 - 4 * 1) / 12) and a.cy - far == pytest.approx((16 * 2 - 4 * 1) / 12)
    assert b.area == 0 and b.cx is None


def test_controls_keep_or_drop_the_right_values(spark):
    patch = np.arange(1, 28, dtype=float).reshape(3, 3, 3)
    df = spark.createDataFrame([(i, patch.tolist()) for i in range(8)], "id long, patch array<array<array<double>>>")
    for r in df.select("id", reports.centre_only(F.col("patch"), 1).alias("c"), reports.permuted(F.col("patch"), F.col("id")).alias("p")).collect():
        want = np.zeros_like(patch)
        want[:, 1, 1] = patch[:, 1, 1]
        assert np.array_equal(np.array(r.c), want)
        assert sorted(np.array(r.p)[:, 0, 0]) == sorted(patch[:, 0, 0])
    assert df.select(reports.permuted(F.col("patch"), F.col("id"))[0][0][0].alias("k")).distinct().count() > 1


def test_averages_of_a_report(spark):
    scores = spark.createDataFrame([(1, 0.9), (1, 0.2), (0, 0.1), (0, 0.2), (0, 0.8), (0, 0.3)], "y_true int, y_prob double")
    got = {r.average: r for r in metrics.report_averages(metrics.classification_report(scores, 0.5)).collect()}
    assert got["macro"].precision == pytest.approx((1 / 2 + 3 / 4) / 2) and got["weighted"].recall == pytest.approx((2 * 1 / 2 + 4 * 3 / 4) / 6)
    assert got["macro"].support == 6


def test_draws_are_log_uniform_and_repeat():
    a, b = (reports.draws(200, {"r": (1e-4, 1.0)}) for _ in range(2))
    values = np.log10([t["r"] for t in a])
    assert a == b and -4 <= values.min() and values.max() <= 0 and abs(values.mean() + 2) < 0.3


def _learnable(spark):
    rng = np.random.default_rng(3)
    return spark.createDataFrame([(i, (rng.normal(size=3) + [2.0 * (i % 2), 0, 0]).tolist(), i % 2, i // 2 % 3) for i in range(240)], "id int, features array<double>, y_true int, fold int")


def test_search_prefers_the_weaker_penalty(spark):
    got = reports.search(_learnable(spark), [{"regParam": 100.0, "elasticNetParam": 1.0}, {"regParam": 1e-3, "elasticNetParam": 0.0}]).collect()
    assert [r.trial for r in got] == [1, 0] and got[0].mean_ap > 0.9 and 0 <= got[0].best_fold < 3


def test_every_kind_learns_and_the_first_feature_counts_most(spark):
    rows = _learnable(spark)
    got = reports.screen(rows.where("id < 160"), rows.where("id >= 160")).collect()
    assert {r.model for r in got} == set(models.KINDS) and min(r.roc_auc for r in got) > 0.8
    weights = {r.feature: r.importance for r in models.importances(rows).collect()}
    assert max(weights, key=weights.get) == 0 and sum(weights.values()) == pytest.approx(1)


def test_prediction_map_covers_the_scene(spark):
    got = Q.predict_map(spark, SF).toPandas()
    known = got[got["class"] != 255]
    assert len(got) == spark.read.parquet(f"{SF}/embeddings.parquet").count() and 0 < len(known) < len(got)
    assert known.y_prob.between(0, 1).all() and (got[got["class"] == 255].y_prob == -1).all()


def test_overviews_are_block_means(spark, tmp_path):
    spark.dataSource.register(GeoTiffSource)
    layer = spark.range(256).select(F.expr("id div 16").alias("y"), (F.col("id") % 16).alias("x"), F.col("id").cast("double").alias("v"))
    write_overviews(layer, str(tmp_path), "v", 16, 16, factors=(4, 8), tile=4)
    got = {(r.y, r.x): r.v[0] for r in spark.read.format("geotiff").load(str(tmp_path / "overview_4" / "tile_0_0.tif")).collect()}
    want = np.arange(256.0).reshape(4, 4, 4, 4).mean((1, 3))
    assert got == {(i, j): want[i, j] for i in range(4) for j in range(4)}
    assert (tmp_path / "overview_8" / "tile_0_0.tif").exists()
