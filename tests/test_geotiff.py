"""GeoTIFF files with tiles, predictors and overviews, as written here and as others lay them out."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafgrid.operators.cube import coarsen
from leafgrid.sources.geotiff import GeoTiffSource, Image, encode, pyramid, read_directories, write_tiles
from leafgrid.sources.rasters import open_raster


def _read(path, level=0):
    image = Image(path, level)
    out = np.full((image.height, image.width, image.bands), np.nan)
    for y, x, numbers in image.blocks():
        part = image.values(y, x, numbers)
        out[y : y + part.shape[0], x : x + part.shape[1]] = part
    return out


@pytest.mark.parametrize(("dtype", "predictor"), [("uint8", 1), ("uint8", 2), ("int16", 2), ("uint32", 2), ("float32", 1), ("float32", 3), ("float64", 3)])
@pytest.mark.parametrize("tile", [None, 16, 48])
@pytest.mark.parametrize("bands", [1, 3])
def test_round_trip(tmp_path, dtype, predictor, tile, bands):
    r = np.random.default_rng(3)
    cube = (r.normal(size=(70, 45, bands)) * 50).astype(dtype) if dtype[0] == "f" else r.integers(0, 250, (70, 45, bands)).astype(dtype)
    cube[5:9, 7:30] = 9
    path = tmp_path / "a.tif"
    path.write_bytes(encode(cube, 9, tile=tile, predictor=predictor, factors=(2, 4, 12)))
    _, images = read_directories(path)
    assert len(images) == 4 and [i.get(254) for i in images] == [None, (1,), (1,), (1,)] and all(sorted(i) == list(i) for i in images)
    for level, want in enumerate([cube, *pyramid(cube, 9, (2, 4, 12))]):
        assert np.array_equal(_read(path, level), np.where(want == 9, np.nan, want.astype(float)), equal_nan=True)
    with pytest.raises(ValueError, match="3 overviews, not 4"):
        Image(path, 4)


def test_levels_are_means_of_known_pixels():
    cube = np.random.default_rng(5).normal(size=(13, 10, 2))
    cube[np.random.default_rng(6).random(cube.shape) < 0.4] = -1
    for factor, level in zip((2, 4, 8), pyramid(cube, -1, (2, 4, 8)), strict=True):
        for y in range(level.shape[0]):
            for x in range(level.shape[1]):
                for b in range(2):
                    part = cube[y * factor : (y + 1) * factor, x * factor : (x + 1) * factor, b]
                    known = part[part != -1]
                    assert level[y, x, b] == (pytest.approx(known.mean()) if len(known) else -1)
    assert pyramid(np.array([[[1], [2]], [[2], [2]]], "u1"), None, (2,))[0].tolist() == [[[2]]]
    with pytest.raises(ValueError, match="multiple"):
        pyramid(cube, -1, (2, 3))


def test_what_can_not_be_held():
    for dtype, tile, predictor in (("f4", 16, 2), ("u1", 16, 3), ("u1", 20, 1)):
        with pytest.raises(ValueError, match="can't hold"):
            encode(np.zeros((4, 4, 1), dtype), tile=tile, predictor=predictor)
    with pytest.raises(ValueError, match="file system"):
        GeoTiffSource({"path": "s3://bucket/a.tif"}).reader(None)


def test_a_file_of_another_writer(tmp_path):
    """Big-endian, bands apart in tiles that aren't square, differences from left to right; the bytes are laid out by hand."""
    cube = np.random.default_rng(7).integers(0, 60000, (20, 40, 2)).astype(">u2")
    packed = []
    for b in range(2):
        for y in (0, 16):
            for x in (0, 32):
                part = np.zeros((16, 32), "u2")
                some = cube[y : y + 16, x : x + 32, b]
                part[: some.shape[0], : some.shape[1]] = some
                less = part.copy()
                less[:, 1:] -= part[:, :-1]
                packed.append(zlib.compress(less.astype(">u2").tobytes()))
    at = np.cumsum([8, *map(len, packed)]).tolist()
    start, n = at[-1], len(packed)
    entries = [(256, 3, 1, 40 << 16), (257, 3, 1, 20 << 16), (258, 3, 2, 16 << 16 | 16), (259, 3, 1, 8 << 16), (277, 3, 1, 2 << 16), (284, 3, 1, 2 << 16), (317, 3, 1, 2 << 16)]
    free = start + 2 + 12 * (len(entries) + 4) + 4
    entries += [(322, 3, 1, 32 << 16), (323, 3, 1, 16 << 16), (324, 4, n, free), (325, 4, n, free + 4 * n)]
    body = struct.pack(">H", len(entries)) + b"".join(struct.pack(">HHII", *e) for e in entries) + struct.pack(">I", 0)
    tail = struct.pack(f">{n}I", *at[:-1]) + struct.pack(f">{n}I", *map(len, packed))
    path = tmp_path / "b.tif"
    path.write_bytes(struct.pack(">2sHI", b"MM", 42, start) + b"".join(packed) + body + tail)
    assert np.array_equal(_read(path), cube.astype(float))


def test_sheets_are_read_as_one_scene(spark, tmp_path):
    height, width = 70, 50
    value = F.when(F.col("id") % 7 > 0, F.col("id") * 0.5)
    layer = spark.range(height * width).select(F.expr(f"id div {width}").alias("y"), (F.col("id") % width).alias("x"), value.alias("p"), (value * 2).alias("q")).cache()
    path = str(tmp_path / "out")
    write_tiles(layer, path, "p", "q", tile=32, block=16, overviews=(2, 4, 16), dtype="float64", predictor=3)
    assert sorted(f.name for f in (tmp_path / "out").iterdir()) == sorted(f"tile_{i}_{j}.tif" for i in range(3) for j in range(2))
    known = lambda df: {(r.y, r.x): tuple(r.v) for r in df.collect() if r.v[0] is not None}
    assert known(open_raster(spark, "geotiff", path)) == {(r.y, r.x): (r.p, r.q) for r in layer.collect() if r.p is not None}
    for level, factor in enumerate((2, 4, 16), 1):
        want = {(r.by, r.bx): r.mean for r in coarsen(layer, factor, "p", height + 96 - height, 64).collect() if r.mean is not None}
        got = known(open_raster(spark, "geotiff", path, level=level))
        assert {k: v[0] for k, v in got.items()} == {k: pytest.approx(v) for k, v in want.items()}
    some = open_raster(spark, "geotiff", path, "y between 40 and 45 and x < 20")
    assert some.rdd.getNumPartitions() == 2 and known(some) == {(r.y, r.x): (r.p, r.q) for r in layer.where("y between 40 and 45 and x < 20 and p is not null").collect()}
    with pytest.raises(Exception, match="can't be divided"):
        write_tiles(layer, path, "p", tile=24, overviews=(16,))
    with pytest.raises(Exception, match="no sheets"):
        (tmp_path / "none").mkdir()
        open_raster(spark, "geotiff", str(tmp_path / "none")).count()
