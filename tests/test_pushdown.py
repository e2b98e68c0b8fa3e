"""Filters on positions that reach the raster sources: fewer partitions, the same rows."""

import numpy as np
import pytest

from leafgrid.sources.geotiff import encode
from leafgrid.sources.rasters import open_raster

H, W, B = 40, 30, 3


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    root = tmp_path_factory.mktemp("rasters")
    values = np.random.default_rng(8).integers(0, 90, (H, W, B)).astype("f4")
    (root / "a.tif").write_bytes(encode(values))
    (root / "c.img").write_bytes(values.tobytes())
    (root / "c.hdr").write_text(f"ENVI\nsamples = {W}\nlines = {H}\nbands = {B}\ndata type = 4\ninterleave = bip\nbyte order = 0\n")
    return root, values


CASES = [
    ("y between 5 and 12", lambda y, x: 5 <= y <= 12, 3),
    ("y > 34 and x < 10", lambda y, x: y > 34 and x < 10, 1),
    ("y = 20 and x >= 11 and x <=> 13", lambda y, x: y == 20 and x == 13, 1),
    ("y in (3, 38) and x = 1", lambda y, x: y in (3, 38) and x == 1, 4),
    ("y > 100", lambda y, x: False, 0),
    ("x < 10 and (y = 3 or x = 4)", lambda y, x: x < 10 and (y == 3 or x == 4), 4),
    ("y between 10 and 19 and v[1] > 40", None, 3),
    ("y != 7 and x between 20 and 29", lambda y, x: y != 7 and 20 <= x <= 29, 4),
]


@pytest.mark.parametrize(("condition", "meets", "tiles"), CASES)
def test_envi(spark, files, condition, meets, tiles):
    root, values = files
    got = open_raster(spark, "envi_cube", str(root / "c.hdr"), condition.replace("v[", "dn["), tile=10)
    meets = meets or (lambda y, x: 10 <= y <= 19 and values[y, x, 1] > 40)
    want = {(y, x): values[y, x].tolist() for y in range(H) for x in range(W) if meets(y, x)}
    assert {(r.y, r.x): r.dn for r in got.collect()} == want
    assert got.rdd.getNumPartitions() == max(1, tiles)  # Spark has a partition of nothing where there are none


@pytest.mark.parametrize(("condition", "meets", "tiles"), CASES)
def test_geotiff(spark, files, condition, meets, tiles):
    root, values = files
    meets = meets or (lambda y, x: 10 <= y <= 19 and values[y, x, 1] > 40)
    got = open_raster(spark, "geotiff", str(root / "a.tif"), condition)
    assert {(r.y, r.x): r.v for r in got.collect()} == {(y, x): values[y, x].tolist() for y in range(H) for x in range(W) if meets(y, x)}


def test_the_plan_has_no_filter_left(spark, files):
    plan = lambda condition: open_raster(spark, "envi_cube", str(files[0] / "c.hdr"), condition)._jdf.queryExecution().executedPlan().toString()
    assert ") Filter " not in plan("y between 5 and 12 and x < 7") and ") Filter " in plan("y in (1, 2)")


def test_a_window_by_options_is_narrowed_further(spark, files):
    got = open_raster(spark, "envi_cube", str(files[0] / "c.hdr"), "y >= 20", tile=10, rows="8:22")
    assert {r.y for r in got.collect()} == {20, 21} and got.rdd.getNumPartitions() == 3


def test_windows_of_one_file_stay_apart(spark, files):
    read = lambda condition=None: open_raster(spark, "envi_cube", str(files[0] / "c.hdr"), condition, tile=10)
    top, bottom, whole = read("y < 5"), read("y >= 30"), read()
    assert top.union(bottom).count() == 15 * W and top.count() == 5 * W and whole.count() == H * W
    assert top.alias("a").join(bottom.alias("b"), "x").count() == 5 * 10 * W
    # Filters on a window are Spark's; were they pushed, the last one would hold for both.
    assert top.where("y = 1").union(top.where("y > 2")).count() == 3 * W and top.count() == 5 * W
    assert ") Filter " in top.where("y = 1")._jdf.queryExecution().executedPlan().toString()
