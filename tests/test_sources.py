"""Sources and stores by round trip: GeoTIFF, ENVI windows, scenes, files of reports; maps of scores."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafgrid.operators import cube, models
from leafgrid.sources import files, store
from leafgrid.sources.envi import EnviSource
from leafgrid.sources.geotiff import GeoTiffSource, encode, read_tags, write_tiles


def test_map_of_scores(spark):
    grid = spark.range(4).select(F.lit(0).alias("y"), F.col("id").alias("x"))
    scored = spark.createDataFrame([(0, 1, 0.7), (0, 2, 0.2)], "y long, x long, y_prob double")
    got = {r.x: (r.y_prob, r["class"]) for r in cube.to_map(grid, scored).collect()}
    assert got == {0: (-1.0, 255), 1: (0.7, 1), 2: (0.2, 0), 3: (-1.0, 255)}


def test_windows_of_files(spark, tmp_path):
    for source in (GeoTiffSource, EnviSource):
        spark.dataSource.register(source)
    values = np.random.default_rng(4).integers(0, 50, (150, 9, 4)).astype("f4")
    (tmp_path / "a.tif").write_bytes(encode(values))
    part = spark.read.format("geotiff").options(rows="70:80", columns="2:5").load(str(tmp_path / "a.tif"))
    assert part.rdd.getNumPartitions() == 1
    assert {(r.y, r.x): r.v for r in part.collect()} == {(y, x): values[y, x].tolist() for y in range(70, 80) for x in range(2, 5)}
    for interleave, axes in (("bsq", (2, 0, 1)), ("bip", (0, 1, 2))):
        (tmp_path / "c.img").write_bytes(values.transpose(axes).tobytes())
        (tmp_path / "c.hdr").write_text(f"ENVI\nsamples = 9\nlines = 150\nbands = 4\ndata type = 4\ninterleave = {interleave}\nbyte order = 0\ndata ignore value = 7\n")
        part = spark.read.format("envi_cube").options(rows="3:6", columns=":4", bands="3,1", tile=2).load(str(tmp_path / "c.hdr"))
        assert part.rdd.getNumPartitions() == 4
        want = {(y, x): [None if v == 7 else v for v in values[y, x, [3, 1]].tolist()] for y in range(3, 6) for x in range(4)}
        assert {(r.y, r.x): r.dn for r in part.collect()} == want


def test_scene_with_layers(spark, tmp_path):
    path = str(tmp_path / "scene")
    px = spark.range(60).select(F.expr("id div 10").alias("y"), (F.col("id") % 10).alias("x"), F.array(*[F.col("id") * 10.0 + i for i in range(6)]).alias("refl"))
    bands = spark.createDataFrame([(i, 400.0 + i) for i in range(6)], "band long, wl double")
    store.save_scene(px, bands, path, tile=4, sensor="test")
    store.add_layer(px.where("x < 5").select("y", "x", F.element_at("refl", 1).alias("index")), path, "indices")
    assert store.attributes_of(spark, path)["sensor"] == "test"
    got = {(r.y, r.x): (r.refl[5], r["index"]) for r in store.load_scene(spark, path, "indices", rows=(2, 3)).collect()}
    assert got == {(y, x): (100.0 * y + 10 * x + 5, 100.0 * y + 10 * x if x < 5 else None) for y in (2, 3) for x in range(10)}
    with pytest.raises(ValueError, match="5 pixels lack bands, 5 have no place"):
        store.save_scene(px.union(px.limit(5).select("y", "x", F.array(F.lit(1.0)))), bands, path)
    store.save_scene(px, bands, str(tmp_path / "b"), layout="bands")
    some = store.load_bands(spark, str(tmp_path / "b" / "cube"), [5])
    assert re.search(r"PartitionFilters: \[[^\]]*block#", some._jdf.queryExecution().toString())
    assert {(r.y, r.x): r.v for r in some.collect()} == {(y, x): 100.0 * y + 10 * x + 5 for y in range(6) for x in range(10)}


def test_reports_in_files(spark, tmp_path):
    report = spark.createDataFrame([("test", 0.123456, None), ("val", 0.5, 1.0)], "split string, ap double, roc double")
    files.write_csv(report, str(tmp_path / "csv"))
    assert files.read_csv(spark, str(tmp_path / "csv"), report.schema).orderBy("split").collect() == report.collect()
    with pytest.raises(Exception, match="(?i)header|schema"):
        files.read_csv(spark, str(tmp_path / "csv"), "a string, b double, c double").collect()
    assert files.markdown(report.limit(1)) == "| split | ap | roc |\n| --- | --- | --- |\n| test | 0.123456 |  |\n"
    files.write_metrics(report, "split", str(tmp_path / "json"))
    (text,) = (tmp_path / "json").glob("part-*")
    assert json.loads(text.read_text()) == {"test": {"ap": 0.1235, "roc": None}, "val": {"ap": 0.5, "roc": 1.0}}
    (tmp_path / "info.json").write_text('{"best_thr": 0.3,\n "seed": 42}')
    assert files.read_json(spark, str(tmp_path / "info.json"), "best_thr double, seed int").first() == (0.3, 42)


def test_components_and_classifiers_are_read_back(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([((rng.normal(size=3) + [i % 2, 0, 0]).tolist(), i % 2) for i in range(80)], "features array<double>, y_true int")
    fit = models.pca_fit(rows, 2)
    files.save_components(spark, str(tmp_path / "pca"), *fit)
    assert files.load_components(spark, str(tmp_path / "pca")) == (fit[0], fit[1])
    for kind in ("logistic", "tree", "perceptron"):
        one = models.fit_classifier(rows, kind)
        one.save(spark, str(tmp_path / kind))
        other = models.load_classifier(spark, str(tmp_path / kind))
        scores = lambda m: sorted(r.y_prob for r in m.scores(rows).collect())
        assert scores(one) == scores(other) and other.info["kind"] == kind and other.iqr == one.iqr


@pytest.mark.parametrize("dtype, bands", [("float32", 1), ("uint8", 3), ("int16", 2)])
def test_geotiff_read(spark, tmp_path, dtype, bands):
    spark.dataSource.register(GeoTiffSource)
    cube = np.random.default_rng(2).integers(0, 100, (150, 37, bands)).astype(dtype)
    (tmp_path / "a.tif").write_bytes(encode(cube, 7, (500.0, 900.0), 0.5, 32618))
    df = spark.read.format("geotiff").load(str(tmp_path / "a.tif"))
    assert df.rdd.getNumPartitions() == 3
    got = np.full(cube.shape, np.nan)
    for r in df.collect():
        got[r.y, r.x] = [np.nan if v is None else v for v in r.v]
    assert np.array_equal(got, np.where(cube == 7, np.nan, cube.astype(float)), equal_nan=True)
    _, tags = read_tags(tmp_path / "a.tif")
    assert tags[33550][:2] == (0.5, 0.5) and tags[33922][3:5] == (500.0, 900.0) and tags[34735][-1] == 32618


def test_geotiff_tiles(spark, tmp_path):
    layer = spark.range(300).select(F.expr("id div 20").alias("y"), (F.col("id") % 20).alias("x"), F.when(F.col("id") % 7 > 0, F.col("id") * 0.5).alias("p"))
    write_tiles(layer, str(tmp_path / "out"), "p", tile=8, px=2.0, west=10.0, north=100.0)
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert names == sorted(f"tile_{i}_{j}.tif" for i in range(2) for j in range(3))
    _, tags = read_tags(tmp_path / "out" / "tile_1_2.tif")
    assert tags[33922][3:5] == (10.0 + 2 * 8 * 2.0, 100.0 - 8 * 2.0)
    got = {}
    for i in range(2):
        for j in range(3):
            for r in spark.read.format("geotiff").load(str(tmp_path / "out" / f"tile_{i}_{j}.tif")).collect():
                got[r.y + 8 * i, r.x + 8 * j] = r.v[0]
    assert {k: v for k, v in got.items() if v is not None} == {(r.y, r.x): r.p for r in layer.collect() if r.p is not None}


def test_other_files_are_refused(tmp_path):
    (tmp_path / "b.tif").write_bytes(b"not a tiff file")
    with pytest.raises(ValueError, match="classic TIFF"):
        read_tags(tmp_path / "b.tif")
