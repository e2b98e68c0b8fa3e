"""Models against numpy, data sources by round trip, and the streaming windows against the same table."""

import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafgrid.operators import cube, models
from leafgrid.plans import queries as Q
from leafgrid.sources.envi import AXES, EnviSource, band_rows, parse_header
from leafgrid.sources.geopackage import GeoPackageSource
from leafgrid.streaming.windows import tumbling_totals

SF = "/root/testdata/sf0.001"


def _features(spark):
    rows = models.complete(Q._all_bands(spark, SF)).orderBy("y", "x").collect()
    return np.array([r.features for r in rows]), [(r.y, r.x) for r in rows], np.array([r.label for r in rows])


def test_components(spark):
    x, at, _ = _features(spark)
    got = {(r.y, r.x): (r.pc1, r.pc2, r.pc3) for r in Q.QUERIES["pca_project"](spark, SF).collect()}
    values, vectors = np.linalg.eigh(np.cov(x.T))
    want = (x - x.mean(axis=0)) @ vectors[:, ::-1][:, :3]
    assert np.allclose(np.abs([got[p] for p in at]), np.abs(want), atol=1e-6)
    assert all(v == (None,) * 3 for p, v in got.items() if p not in set(at))
    assert np.allclose(models.pca_fit(Q._all_bands(spark, SF))[2], values[::-1][:3] / values.sum())


def test_unmix(spark):
    x, at, label = _features(spark)
    ends = np.array([x[label == c].mean(axis=0) for c in np.unique(label)])
    want = np.linalg.lstsq(ends.T, x.T, rcond=None)[0].T
    got = {(r.y, r.x): r for r in Q.QUERIES["unmix"](spark, SF).collect()}
    assert np.allclose([got[p].shares for p in at], want, atol=1e-6)
    assert [got[p].endmember for p in at] == [np.unique(label)[i] for i in want.argmax(axis=1)]


def test_clusters_are_nearest_means(spark):
    x, at, _ = _features(spark)
    got = {(r.y, r.x): r.cluster for r in Q.QUERIES["clusters"](spark, SF).collect()}
    own = np.array([got[p] for p in at])
    centres = np.array([x[own == c].mean(axis=0) for c in np.unique(own)])
    near = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
    assert len(centres) == 5 and (np.unique(own)[near] == own).mean() > 0.97


def test_selected_bands_keep_their_distance(spark):
    rows = Q.QUERIES["select_bands"](spark, SF).collect()
    kept = [r for r in rows if r.kept]
    assert len(rows) == Q._segmented(spark, SF).count() and len(kept) > 10 and {r.seg for r in kept} == set(Q._SPACINGS)
    apart = lambda r: Q._SPACINGS[r.seg].factor * Q._SPACINGS[r.seg].at(r.wl)
    for r in kept:
        others = [o for o in kept if o.band != r.band and o.seg == r.seg and (o.reason == "anchor" or o.score > r.score)]
        assert r.reason == "anchor" or all(abs(o.wl - r.wl) >= apart(r) for o in others)
    for r in rows:
        if r.reason == "too near":
            assert any(o.seg == r.seg and abs(o.wl - r.wl) < apart(r) for o in kept)


def test_select_bands_by_hand(spark):
    schema = "seg long, band long, wl double, score double, reason string, anchor_ok boolean"
    rows = [(0, i, 400.0 + 10 * i, s, "few valid" if i == 6 else None, i != 5) for i, s in enumerate([1.0, 5.0, 4.0, 3.0, 2.0, 1.5, 0.0])]
    bands = spark.createDataFrame([*rows, (1, 9, 900.0, 1.0, "low snr", True)], schema)
    pairs = spark.createDataFrame([(1, 3, 99, 0.9995), (1, 4, 99, 0.9999), (1, 2, 99, None), (3, 6, 99, -1.0)], "a long, b long, n long, corr double")
    rule = lambda **k: {0: models.Spacing(**{"length": 60.0, "factor": 0.3, "corr_limit": 0.999} | k)}
    choose = lambda anchors=(), **k: {r.band: (r.kept, r.reason) for r in models.select_bands(bands, pairs, rule(**k), anchors).collect()}
    # Spacing 18 nm; neighbours lie within 30 nm, so 1 and 4 are not compared.
    assert choose() == {1: (True, "score"), 2: (False, "too near"), 3: (False, "correlated"), 4: (True, "score"), 5: (False, "too near"), 0: (False, "too near"), 6: (False, "few valid"), 9: (False, "low snr")}
    # A longer length around band 4 brings band 1 into its neighbourhood.
    assert choose(windows=((440.0, 440.0, 62.0),))[4] == (False, "correlated")
    # Anchors: 452 is nearest to 5, which fails the weak limits; 461 is nearest to 6, which may be an anchor; 900's segment has no candidates.
    assert [k for k, v in choose((452.0, 461.0, 900.0)).items() if v == (True, "anchor")] == [6]
    assert choose((410.0, 430.0))[3] == (False, "correlated") and choose((410.0, 430.0))[1] == (True, "anchor")


def test_candidates_by_hand(spark):
    bands = spark.createDataFrame([(0, i, 400.0 + 10 * i, float(i), v) for i, v in enumerate([0.9, 0.9, 0.4, 0.9, 0.9, 0.9, 0.2, 0.9, 0.9, 0.9, 0.9])], "seg long, band long, wl double, snr double, valid_ratio double")
    got = {r.band: r for r in models.band_candidates(bands, F.lit(0.0), {0: models.Spacing(margins=(15.0, 5.0))}).collect()}
    assert [got[i].reason for i in range(11)] == ["margin", "margin", "few valid", None, None, None, "few valid", None, None, None, "margin"]
    assert [got[i].anchor_ok for i in range(11)] == [False, False, True, True, True, True, False, True, True, True, False]
    snr, valid = np.arange(11.0), np.array([0.9, 0.9, 0.4, 0.9, 0.9, 0.9, 0.2, 0.9, 0.9, 0.9, 0.9])
    want = (snr - snr.mean()) / (snr.std() + 1e-6) + 0.5 * (valid - valid.mean()) / (valid.std() + 1e-6)
    assert np.allclose([got[i].score for i in range(11)], want)


def test_canonical_correlations(spark):
    x, _, _ = _features(spark)
    parts = []
    for half in (x[:, :32], x[:, 32:]):
        values, vectors = np.linalg.eigh(np.cov(half.T))
        scores = (half - half.mean(axis=0)) @ vectors[:, ::-1][:, :3]
        parts.append(scores / scores.std(axis=0))
    want = np.linalg.svd(parts[0].T @ parts[1] / len(x), compute_uv=False)
    assert np.allclose([r.value for r in Q.QUERIES["cross_components"](spark, SF).orderBy("rank").collect()], want, atol=1e-6)


def test_classifiers_learn(spark):
    rows = {(r.model, r.split): r for r in Q.QUERIES["classifier_metrics"](spark, SF).collect()}
    assert len(rows) == 6 and all(rows[m, "train"].roc_auc > 0.6 for m in ("logistic", "boosted"))
    one = spark.createDataFrame([([1.0], 1)], "features array<double>, y_true int")
    with pytest.raises(ValueError):
        models.classifier_scores(one, one)


def test_polygon_with_a_hole(spark):
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    shapes = spark.createDataFrame([(1, 7, [square(0.0, 5.0), square(1.0, 4.0)]), (2, 9, [square(0.0, 1.0)]), (3, 9, [])], "id long, value long, rings array<array<struct<x double, y double>>>")
    got = {(r.y, r.x): r.value for r in cube.polygons_to_pixels(shapes, 1.0).collect()}
    want = {(y, x): 7 for y in range(5) for x in range(5) if not (1 <= y < 4 and 1 <= x < 4)} | {(0, 0): 9}
    assert got == want


@pytest.mark.parametrize("interleave", AXES)
def test_envi_round_trip(spark, tmp_path, interleave):
    cube_ = np.random.default_rng(0).random((7, 5, 3)).astype("f4")
    cube_[2, 2, 1] = np.nan
    order = [("lines", "samples", "bands").index(a) for a in AXES[interleave].split()]
    (tmp_path / "c.img").write_bytes(b"head" + cube_.transpose(order).astype(">f4").tobytes())
    head = f"ENVI\nsamples = 5\nlines = 7\nbands = 3\nheader offset = 4\ndata type = 4\ninterleave = {interleave}\nbyte order = 1\nWavelength = {{400.5,\n 500, 600 }}\n"
    (tmp_path / "c.hdr").write_text(head)
    assert band_rows(parse_header(head)) == [(0, 400.5), (1, 500.0), (2, 600.0)]
    spark.dataSource.register(EnviSource)
    rows = spark.read.format("envi_cube").option("tile", 3).load(str(tmp_path / "c.hdr"))
    got = np.full(cube_.shape, -1.0, "f4")
    for r in rows.collect():
        got[r.y, r.x] = [np.nan if v is None else v for v in r.dn]
    assert np.array_equal(got, cube_, equal_nan=True) and rows.where(F.exists("dn", lambda v: v.isNull())).count() == 1


def test_geopackage(spark, tmp_path):
    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 0.0)]
    body = struct.pack("<I", len(ring)) + b"".join(struct.pack("<dd", *p) for p in ring)
    polygon = struct.pack("<BII", 1, 3, 1) + body
    blob = lambda wkb: b"GP" + bytes([0, 1 | 1 << 1]) + bytes(4) + bytes(32) + wkb
    path = str(tmp_path / "plots.gpkg")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('plots', 'geom')")
    db.execute("CREATE TABLE plots (fid INTEGER PRIMARY KEY, geom BLOB, plot INTEGER, name TEXT, area REAL)")
    multi = struct.pack("<BII", 1, 6, 2) + polygon + polygon
    db.executemany("INSERT INTO plots VALUES (?, ?, ?, ?, ?)", [(1, blob(polygon), 5, "a", 1.5), (2, blob(multi), None, None, None), (9, None, 6, "c", 2.0)])
    db.commit()
    db.close()
    spark.dataSource.register(GeoPackageSource)
    rows = {r.fid: r for r in spark.read.format("geopackage_polygons").option("rows", 2).load(path).collect()}
    assert [tuple(p) for p in rows[1].rings[0]] == ring[:-1] and len(rows[2].rings) == 2 and rows[9].rings is None
    assert (rows[1].plot, rows[1].name, rows[1].area, rows[2].name) == (5, "a", 1.5, None)


def test_stream_gives_the_closed_windows(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{SF}/events.parquet*")
    job = tumbling_totals(stream, "1 day").writeStream.outputMode("append").format("memory").queryName("closed").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    job.awaitTermination(120)
    closed = {(r.start, r.event_type): (r.n, round(r.total, 6)) for r in spark.table("closed").collect()}
    want = {(r.start, r.event_type): (r.n, round(r.total, 6)) for r in tumbling_totals(events, "1 day").collect()}
    assert closed and all(want[k] == v for k, v in closed.items())


def test_models_see_every_band_of_every_pixel(spark):
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    px = Q._all_bands(spark, SF)
    assert models.complete(px).where(F.size("features") == 64).count() == n
    want = {r.band: r.m for r in cube.long_form(Q.V.pixels(spark, SF)).groupBy("band").agg(F.avg("v").alias("m")).collect()}
    pairs = Q.V.pixels(spark, SF).join(px.select("y", "x", "features"), ["y", "x"]).select("refl", "features").collect()
    assert all(f == (want[i] if v is None else v) or abs(f - want[i]) < 1e-12 for r in pairs for i, (v, f) in enumerate(zip(r.refl, r.features, strict=True)))
    assert Q.QUERIES["feature_importance"](spark, SF).count() == 64
    assert Q.QUERIES["pca_project"](spark, SF).where("pc1 IS NULL").count() == 0


def test_fill_leaves_pixels_without_values(spark):
    px = spark.createDataFrame([(1, [1.0, None, None]), (2, [3.0, 4.0, None]), (3, [None, None, None]), (4, None)], "id int, features array<double>")
    got = {r.id: r.features for r in models.fill(px, px).collect()}
    assert got == {1: [1.0, 4.0, 0.0], 2: [3.0, 4.0, 0.0], 3: [None] * 3, 4: None}
