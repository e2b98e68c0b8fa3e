"""Least-squares smoothing, capped samples, splits and reports against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafgrid.functions.columns import portable_hash
from leafgrid.functions.spectra import kernels, smoothed
from leafgrid.operators import cube, reports, samples


@pytest.mark.parametrize(("window", "degree", "derivative"), [(5, 2, 0), (7, 3, 1), (5, 4, 2), (3, 0, 0)])
def test_smoothing_is_a_fit_in_each_window(spark, window, degree, derivative):
    r = np.random.default_rng(1)
    segments, step = [(1, 9), (11, 13), (14, 22)], 2.5
    rows = [[None if r.random() < 0.03 else float(v) for v in r.normal(size=23)] for _ in range(30)] + [[1.0] * 12, [], None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "id int, v array<double>")
    got = {x.id: x.s for x in df.select("id", smoothed(F.col("v"), segments, window, degree, derivative, step).alias("s")).collect()}
    for i, v in enumerate(rows):
        want = None if v is None else [None] * len(v)
        for first, end in segments:
            for b in range(first, min(end, len(v or ()))):
                at = min(max(first, b - window // 2), end - window)
                seen = v[at : at + window]
                if end - first >= window and len(seen) == window and None not in seen:
                    poly = np.polynomial.Polynomial.fit((np.arange(window) + at - b) * step, seen, degree)
                    want[b] = (poly.deriv(derivative) if derivative else poly)(0.0)
        if v:
            assert [x is None for x in got[i]] == [x is None for x in want]
            assert np.allclose([x for x in got[i] if x is not None], [x for x in want if x is not None], atol=1e-9)
    assert got[31] == [] and got[32] is None


def test_known_weights():
    assert np.allclose(np.array(kernels(9, 5, 2)[4][1]) * 35, [-3, 12, 17, 12, -3]) and kernels(9, 5, 2)[0][0] == 0 and kernels(9, 5, 2)[8][0] == 4
    for bad in ((9, 4, 2, 0), (9, 5, 5, 0), (9, 5, 2, 3), (4, 5, 2, 0)):
        with pytest.raises(ValueError, match="no fit|fewer"):
            kernels(*bad)


@pytest.mark.parametrize("few", [10_000, 50, 1])
@pytest.mark.parametrize("n", [0, 1, 137, 2999, 3000, 9000])
def test_capped_samples(spark, few, n):
    rows = spark.range(3000).select("id", (F.col("id") % 11).alias("k"))
    got = samples.capped(rows, n, portable_hash(F.col("id") % 600), "id", few=few)  # five rows share a key
    want = sorted(range(3000), key=lambda i: ((i % 600 + 42) * 2654435761 % 4294967296, i))[:n]
    assert sorted(r.id for r in got.collect()) == sorted(want) and got.columns == ["id", "k"]


def test_splits_of_groups(spark):
    groups = spark.range(50).select(F.col("id").alias("plot"), (F.col("id") % 3).alias("class"))
    got = samples.split_of_groups(groups, "class", "plot").collect()
    for c in range(3):
        order = sorted((r.plot for r in got if r["class"] == c), key=lambda p: ((p + 42) * 2654435761 % 4294967296, p))
        n = len(order)
        want = {p: 1 if k < int(n * 0.6) else 2 if k < int(n * 0.6) + int(n * 0.2) else 3 for k, p in enumerate(order)}
        assert {r.plot: r.split_id for r in got if r["class"] == c} == want
    for bad in ((0.8, 0.2), (0.0, 0.5), (0.5, -0.1), (1.2, 0.1)):
        with pytest.raises(ValueError, match="positive"):
            samples.split_of_groups(groups, "class", "plot", bad)


def test_a_split_without_patches_is_an_error(spark):
    px = spark.range(25).select(F.expr("id div 5").alias("y"), (F.col("id") % 5).alias("x"), F.array(F.col("id") * 1.0).alias("features"), F.when(F.col("id") == 12, 1).otherwise(2).alias("split_id"))
    assert [(r.y, r.x) for r in cube.patches_of_split(px, 1, F.lit(True)).collect()] == [(2, 2)]
    for split, valid in ((3, F.lit(True)), (1, F.col("x") < 4)):
        with pytest.raises(ValueError, match="has a whole patch"):
            cube.patches_of_split(px, split, valid)


def test_reports_are_turned_over(spark):
    report = spark.createDataFrame([("test", 0.5, 3), ("train", 0.75, None)], "split string, ap double, n long")
    got = {r["column"]: (r.test, r.train) for r in reports.transposed(report, "split").collect()}
    assert got == {"ap": (0.5, 0.75), "n": (3.0, None)}
    with pytest.raises(ValueError, match="each once"):
        reports.transposed(report.union(report), "split")
