"""Imagery operators: fixtures with known results, and all registered queries against DuckDB."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafgrid.functions import columns as C
from leafgrid.operators import cube, metrics, samples
from leafgrid.operators.ranks import exact_quantiles, place_in_group, running_totals
from leafgrid.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "nation customer part orders lineitem events embeddings".split()


def _grid(spark, n, channels=2, missing=()):
    rows = [(y, x, [None if (y, x, c) in missing else float(y * n + x + c) for c in range(channels)]) for y in range(n) for x in range(n)]
    return spark.createDataFrame(rows, "y long, x long, features array<double>")


def _ok():
    return F.forall("features", lambda v: v.isNotNull())


@pytest.mark.parametrize(("n", "missing", "centres"), [(10, (), 36), (10, ((5, 5, 0),), 11), (20, (), 256), (4, (), 0)])
def test_patch_centres(spark, n, missing, centres):
    assert cube.patches(_grid(spark, n, missing=missing), F.lit(True), _ok()).count() == centres


def test_patches_equal_a_loop(spark):
    n, missing = 9, {(6, 6, 1)}
    got = {(r["y"], r["x"]): r["patch"] for r in cube.patches(_grid(spark, n, missing=missing), F.lit(True), _ok()).collect()}
    a = np.array([[[np.nan if (y, x, c) in missing else y * n + x + c for x in range(n)] for y in range(n)] for c in range(2)])
    want = {(y, x): a[:, y - 2 : y + 3, x - 2 : x + 3] for y in range(2, n - 2) for x in range(2, n - 2) if not np.isnan(a[:, y - 2 : y + 3, x - 2 : x + 3]).any()}
    assert got.keys() == want.keys()
    for k in want:
        np.testing.assert_allclose(np.array(got[k]), want[k])


def test_sparse_tables_have_no_borders_inside(spark):
    some = _grid(spark, 7).where("NOT (y = 3 AND x = 3)")
    assert cube.patches(some, F.lit(True), _ok(), 1).count() == 25 - 9


@pytest.mark.parametrize(("wl", "low", "high", "band"), [([400, 550, 660, 800], 540, 560, 1), ([400, 500, 900], 600, 650, 1), ([700, 710, 730, 740], 705, 735, 1)])
def test_nearest_in_range(spark, wl, low, high, band):
    bands = spark.createDataFrame(list(enumerate(map(float, wl))), "band long, wl double")
    assert cube.nearest_in_range(bands, low, high).first()["band"] == band


def test_nan_is_null(spark):
    rows = spark.createDataFrame([(float("nan"),), (0.5,), (None,)], "v double")
    assert [r[0] for r in rows.select(C.above(C.denan(F.col("v")), 0.3)).collect()] == [False, True, False]
    assert rows.select(C.safe_div(F.lit(1.0), F.lit(0.0))).first()[0] is None


def test_perfect_scores(spark):
    s = spark.createDataFrame([(0, 0.1), (1, 0.9), (0, 0.2), (1, 0.8)], "y_true int, y_prob double")
    r = metrics.ranking_metrics(s).first()
    assert (r["average_precision"], r["roc_auc"]) == (1.0, 1.0)
    assert metrics.threshold_metrics(s, 0.5).first()["accuracy"] == 1.0


def test_one_class_only(spark):
    s = spark.createDataFrame([(0, 0.1), (0, 0.9)], "y_true int, y_prob double")
    r = metrics.ranking_metrics(s).first()
    assert r["average_precision"] is None and r["roc_auc"] is None


def test_threshold_of_separable_scores(spark):
    rng = np.random.default_rng(7)
    rows = [(0, float(v)) for v in rng.uniform(0, 0.4, 50)] + [(1, float(v)) for v in rng.uniform(0.6, 1, 50)]
    r = metrics.best_threshold(spark.createDataFrame(rows, "y_true int, y_prob double")).first()
    assert 0.1 <= r["threshold"] <= 0.9 and r["f1_macro"] == 1.0


def test_exact_quantiles_narrow_down(spark):
    rng = np.random.default_rng(8)
    rows = [("a", float(v)) for v in rng.normal(size=3000)] + [("b", float(v)) for v in rng.integers(0, 2, 999)] + [(None, 1e300), (None, -1e300), ("c", None), ("d", 5.0)]
    df, at = spark.createDataFrame(rows, "k string, v double"), [0.0, 0.013, 0.25, 0.5, 0.999, 1.0]
    got = {r.k: r.q for r in exact_quantiles(df, "v", at, "k", most=20).collect()}
    assert got.keys() == {"a", "b", None, "d"}
    for k, q in got.items():
        np.testing.assert_allclose(q, np.quantile([v for g, v in rows if g == k and v is not None], at))
    assert exact_quantiles(df.where("k = 'c'"), "v", [0.5]).first().q == [None]


def test_running_totals_and_places_in_cells(spark):
    rng = np.random.default_rng(9)
    rows = [(g, float(p), int(n)) for g in ("a", None) for p, n in zip(rng.permutation(500) / 7, rng.integers(0, 9, 500))]
    df = spark.createDataFrame(rows, "g string, p double, n long")
    want = {(g, p): (sum(m for h, q, m in rows if h == g and q >= p), sum(m for h, _, m in rows if h == g)) for g, p, _ in rows}
    got = running_totals(df, "p", ["n"], "g", cell_rows=60)
    assert {(r.g, r.p): (r.c_n, r.t_n) for r in got.collect()} == want
    ranked = place_in_group(df.withColumn("id", F.monotonically_increasing_id()), "g", F.round(F.col("p") * 7).cast("long"), "id", span=500, cell_rows=60)
    for g in ("a", None):
        own = [r for r in ranked.collect() if r.g == g]
        assert [r.k for r in sorted(own, key=lambda r: r.p)] == list(range(1, 501)) and {r.m for r in own} == {500}


def test_stripes_are_spread(spark):
    px = spark.range(101).select(F.col("id").alias("y"), F.lit(0).alias("x"))
    assert [r.y for r in samples.stripes(px, 5).orderBy("y").collect()] == [0, 25, 50, 75, 100]
    with pytest.raises(ValueError):
        samples.stratified(px, "x", 1.0, "y")


def test_touched_cells_of_polygons(spark):
    square = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]
    sliver = [(0.1, 5.1), (4.9, 5.2), (4.9, 5.3)]
    shapes = spark.createDataFrame([(1, 7, [square]), (2, 9, [sliver])], "id long, value long, rings array<array<struct<x double, y double>>>")
    got = {(r.y, r.x): r.value for r in cube.polygons_touched(shapes, 1.0).collect()}
    assert got == {(y, x): 7 for y in (1, 2) for x in (1, 2)} | {(5, x): 9 for x in range(5)}


def test_lengths_by_hand(spark):
    curve = [(0, 10.0, 0.99), (0, 20.0, 0.97), (0, 30.0, 0.93), (1, 10.0, 0.99), (1, 20.0, 0.98), (2, 10.0, 0.5), (2, 20.0, 0.4), (3, 10.0, 0.9), (4, 10.0, 0.9), (4, 20.0, 0.96)]
    got = {r.seg: (r.status, r.length, r.interpolated) for r in cube.decorrelation_lengths(spark.createDataFrame(curve, "seg long, delta_nm double, corr double"), [0.95]).collect()}
    assert got[0][0] == "hit" and got[0][1] == pytest.approx(25.0) and got[0][2] == pytest.approx(25.0)
    assert got[1] == (">=max", 20.0, None) and got[2] == ("<=min", 10.0, None) and got[3][0] == "no-data" and got[4] == ("nan", None, None)


def _comparable(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        text = frame[c].dtype == object or str(frame[c].dtype).startswith(("datetime", "str"))
        frame[c] = frame[c].astype(str).str.replace(" 00:00:00", "") if text else frame[c].astype(float)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", list(Q.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = Q.QUERIES[name](spark, SF).toPandas(), con.sql(Q.ORACLE_SQL[name]).df()
    pd.testing.assert_frame_equal(_comparable(got), _comparable(want), check_dtype=False, atol=2e-6)
