"""Exact quantiles of places in arrays, whatever the sizes of spans, against numpy."""

import numpy as np
import pytest

from leafgrid.operators import cube, ranks
from leafgrid.operators.ranks import array_quantiles

AT = [0.0, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize(("most", "cells"), [(20_000, 1024), (3, 4), (1, 2)])
def test_array_quantiles(spark, monkeypatch, most, cells):
    monkeypatch.setattr(ranks, "CELLS", cells)
    r = np.random.default_rng(9)
    x = np.stack([r.normal(size=400), r.integers(0, 4, 400) * 1.0, np.full(400, 7.0), r.exponential(size=400) * 1e6, np.full(400, np.nan), np.where(r.random(400) < 0.7, np.nan, r.normal(size=400)), [-1e308, 1e308] * 200], axis=1)
    rows = [(None if i % 50 == 3 else [None if np.isnan(v) else float(v) for v in (row if i % 3 else row[:6])],) for i, row in enumerate(x)]
    got = {q.band: q.q for q in array_quantiles(spark.createDataFrame(rows, "f array<double>").repartition(5), "f", AT, most).collect()}
    kept = np.array([[np.nan if b >= len(row or ()) or row[b] is None else row[b] for b in range(7)] for (row,) in rows])
    assert set(got) == {0, 1, 2, 3, 5, 6}
    for band in set(got) - {6}:
        known = kept[~np.isnan(kept[:, band]), band]
        assert np.allclose(got[band], np.quantile(known, AT), rtol=1e-12, atol=0)
    assert got[6][0] == -1e308 and got[6][4] == 1e308


def test_no_values(spark):
    assert array_quantiles(spark.createDataFrame([], "f array<double>"), "f", AT).count() == 0
    rows = spark.createDataFrame([(0, 0, [None, 2.0]), (0, 1, []), (0, 2, None)], "y int, x int, f array<double>")
    assert [tuple(r) for r in cube.robust_fit(rows, "f").collect()] == [(1, 2.0, 0.0)]


def test_a_scan_is_not_exploded(spark):
    rows = spark.range(50).selectExpr("0 as y", "id as x", "array(id * 1.0D, id * 2.0D) as f")
    assert [tuple(r) for r in cube.robust_fit(rows, "f").orderBy("band").collect()] == [(0, 24.5, 24.5), (1, 49.0, 49.0)]
