"""Zarr arrays: round trips in both formats, uneven edges, missing chunks, metadata by hand, pushed filters, groups and resumed writes."""

import gzip
import json
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from leafgrid.plans import rasters
from leafgrid.plans.queries import ORACLE_SQL
from leafgrid.sources import zarr
from leafgrid.sources.rasters import open_raster
from leafgrid.sources.zarr import Folder, ZarrSource, open_group, read_layout, unfinished, write_zarr

H, W, B = 23, 17, 5


@pytest.fixture(scope="module")
def px(spark):
    v = lambda i: F.when((F.col("id") + i) % 11 > 0, F.col("id") * 0.5 + i)
    return spark.range(H * W).select(F.expr(f"id div {W}").alias("y"), (F.col("id") % W).alias("x"), F.array(*[v(i) for i in range(B)]).alias("refl")).cache()


def _cube(rows, bands=B):
    out = np.full((H, W, bands), np.nan)
    for r in rows:
        out[r[0], r[1]] = [np.nan if v is None else v for v in r[2]]
    return out


@pytest.mark.parametrize(("version", "codec"), [(2, "zlib"), (2, None), (2, "zstd"), (3, "gzip"), (3, "zlib")])
def test_round_trip(spark, px, tmp_path, version, codec):
    path = str(tmp_path / "g")
    write_zarr(px.repartition(3), path, "reflectance", "refl", (2, 8, 6), codec=codec, version=version, attributes={"sensor": "test"})
    layout = read_layout(Folder(path), "reflectance")
    assert (layout.shape, layout.grid, layout.dims, layout.attributes) == ((B, H, W), (3, 3, 3), ("band", "y", "x"), {"sensor": "test"})
    got = open_raster(spark, "zarr", path, array="reflectance")
    assert got.rdd.getNumPartitions() == 9
    assert np.array_equal(_cube(got.collect()), _cube(px.collect()), equal_nan=True) and got.count() == H * W
    part = spark.read.format("zarr").options(array="reflectance", rows="7:9", columns="3:", bands="4,0").load(path)
    assert part.rdd.getNumPartitions() == 2 * 3
    want = {(r.y, r.x): [r.refl[4], r.refl[0]] for r in px.where("y between 7 and 8 and x >= 3").collect()}
    assert {(r.y, r.x): r.v for r in part.collect()} == want
    cells = open_raster(spark, "zarr", path, array="reflectance", layout="cells")
    assert cells.columns == ["band", "y", "x", "v"] and cells.rdd.getNumPartitions() == 27
    some = open_raster(spark, "zarr", path, "band = 3 and y > 20", array="reflectance", layout="cells")
    assert some.rdd.getNumPartitions() == 3 and {(r.y, r.x): r.v for r in some.collect()} == {(r.y, r.x): r.refl[3] for r in px.where("y > 20").collect()}


@pytest.mark.parametrize("version", [2, 3])
def test_missing_chunks_hold_the_fill_value(spark, px, tmp_path, version):
    path = str(tmp_path / "g")
    layer = px.where("y < 8 and x < 6 or y = 22 and x = 16").select("y", "x", F.array(F.col("y") * 10 + F.col("x")).alias("label"))
    write_zarr(layer, path, "label", "label", (8, 6), "uint8", fill=255, version=version, shape=(H, W))
    files = [n for n in Folder(path).names("label", deep=True) if n[-1].isdigit() and not (tmp_path / "g" / "label" / n).is_dir()]
    assert files == (["0.0", "2.2"] if version == 2 else ["c/0/0", "c/2/2"])
    got = {(r.y, r.x): r.v[0] for r in open_raster(spark, "zarr", path, array="label", ignored="255").collect()}
    assert len(got) == H * W and {k: v for k, v in got.items() if v is not None} == {(r.y, r.x): r.label[0] for r in layer.collect()}
    assert {r.v[0] for r in open_raster(spark, "zarr", path, "y = 15", array="label").collect()} == {255}


@pytest.mark.parametrize(("version", "dtype"), [(2, "float64"), (3, "float32")])
def test_places_without_a_pixel_are_told_from_nulls(spark, px, tmp_path, version, dtype):
    path, nothing = str(tmp_path / "g"), F.array(*[F.lit(None).cast("double")] * B)
    some = px.where("y < 16 and (y * 17 + x) % 7 > 0 or y = 22 and x = 3").withColumn("refl", F.when(F.col("x") == 4, nothing).otherwise(F.col("refl")))
    write_zarr(some, path, "refl", "refl", (2, 8, 6), dtype, version=version, fill=-np.inf, null=np.nan)
    want = {(r.y, r.x): r.refl for r in some.collect()}
    read = lambda condition=None, **how: open_raster(spark, "zarr", path, condition, array="refl", **how).collect()
    assert {(r.y, r.x): r.v for r in read(gaps="true")} == want
    assert len(read("y between 5 and 22", gaps="true", bands="3")) == len([k for k in want if k[0] >= 5])
    got = read("band in (1, 4)", layout="cells", gaps="true")
    assert len(got) == 2 * len(want) and {(r.band, r.y, r.x): r.v for r in got} == {(b, *k): v[b] for k, v in want.items() for b in (1, 4)}
    assert len(read()) == H * W


@pytest.mark.parametrize("name", ["zarr_bands", "zarr_window"])
def test_queries_of_a_scene_with_gaps(spark, tmp_path, name):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id % 7 > 0 and vec_id < 333")
    rows.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = sorted(map(tuple, getattr(rasters, name)(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(con.sql(ORACLE_SQL[name]).fetchall(), key=str)


def test_metadata_of_others(spark, tmp_path):
    """What other writers leave: bytes in Fortran order, big-endian, slashes in keys, transposed axes, old keys, scalars of attributes."""
    values = np.arange(5 * 7, dtype="i4").reshape(5, 7)
    a = tmp_path / "a"
    a.mkdir()
    (a / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [5, 7], "chunks": [3, 4], "dtype": ">i2", "fill_value": None, "order": "F", "compressor": {"id": "zlib", "level": 9}, "filters": None, "dimension_separator": "/"}))
    b = tmp_path / "b"
    (b / "c").mkdir(parents=True)
    node = {"zarr_format": 3, "node_type": "array", "shape": [5, 7], "data_type": "float64", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [3, 4]}}, "fill_value": "NaN", "attributes": {"unit": "m"}}
    node |= {"codecs": [{"name": "transpose", "configuration": {"order": [1, 0]}}, {"name": "bytes", "configuration": {"endian": "big"}}, {"name": "gzip", "configuration": {"level": 1}}], "chunk_key_encoding": {"name": "v2", "configuration": {"separator": "."}}}
    (b / "zarr.json").write_text(json.dumps(node))
    for i in range(2):
        (a / str(i)).mkdir()
        for j in range(2):
            chunk = np.zeros((3, 4))
            part = values[3 * i : 3 * i + 3, 4 * j : 4 * j + 4]
            chunk[: part.shape[0], : part.shape[1]] = part
            (a / str(i) / str(j)).write_bytes(zlib.compress(chunk.astype(">i2").tobytes(order="F")))
            if (i, j) != (1, 0):
                (b / f"{i}.{j}").write_bytes(gzip.compress(chunk.T.astype(">f8").tobytes()))
    assert {(r.y, r.x): r.v[0] for r in open_raster(spark, "zarr", str(a)).collect()} == {(y, x): values[y, x] for y in range(5) for x in range(7)}
    got = {(r.dim_0, r.dim_1): r.v for r in open_raster(spark, "zarr", str(b), layout="cells").collect()}
    assert got == {(y, x): None if y >= 3 and x < 4 else values[y, x] for y in range(5) for x in range(7)}
    assert zarr.read_layout(Folder(str(b)), "").attributes == {"unit": "m"}


def test_dimensions_of_one_array(spark, tmp_path):
    (tmp_path / "wl").mkdir()
    meta = {"zarr_format": 2, "shape": [10], "chunks": [4], "dtype": "<f4", "fill_value": "NaN", "order": "C", "compressor": None, "filters": None}
    (tmp_path / "wl" / ".zarray").write_text(json.dumps(meta))
    (tmp_path / "wl" / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": ["band"]}))
    (tmp_path / "wl" / "1").write_bytes(np.array([4, 5, 6, 7], "<f4").tobytes())
    got = open_raster(spark, "zarr", str(tmp_path), "band between 3 and 8", array="wl")
    assert got.rdd.getNumPartitions() == 3 and [r.v for r in got.orderBy("band").collect()] == [None, 4, 5, 6, 7, None]


@pytest.mark.parametrize("change", [{"compressor": {"id": "blosc"}}, {"filters": [{"id": "delta"}]}])
def test_unknown_codecs_are_refused(tmp_path, change):
    (tmp_path / "a").mkdir()
    meta = {"zarr_format": 2, "shape": [4], "chunks": [4], "dtype": "<f4", "fill_value": 0, "order": "C", "compressor": None, "filters": None}
    (tmp_path / "a" / ".zarray").write_text(json.dumps(meta | change))
    with pytest.raises(ValueError, match="can't be read"):
        read_layout(Folder(str(tmp_path)), "a")


def test_groups(spark, px, tmp_path):
    path = str(tmp_path / "g")
    with pytest.raises(FileNotFoundError):
        open_group(path, "r")
    assert open_group(path, "a", 3) == 3 and open_group(path, "a", 2) == 3 and open_group(path, "r") == 3
    write_zarr(px, path, "refl", "refl", (5, 8, 8))
    write_zarr(px.select("y", "x", F.array(F.lit(7)).alias("mask")), path, "mask", "mask", (16, 16), "uint8", version=2)
    folder = Folder(path)
    assert zarr.arrays(folder) == ["mask", "refl"] and read_layout(folder, "mask").version == 3  # the group's own format
    with pytest.raises(Exception, match="is a group; name one of its arrays: mask, refl"):
        spark.read.format("zarr").load(path)
    write_zarr(px.where("y < 4"), path, "refl", "refl", (5, 8, 8))
    assert read_layout(folder, "refl").shape == (B, 4, W) and zarr.arrays(folder) == ["mask", "refl"] and not [n for n in folder.names() if n.startswith(".")]
    assert open_group(path, "w", 2) == 2 and zarr.arrays(folder) == []
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "file").write_text("not a group")
    with pytest.raises(ValueError, match="something else"):
        open_group(str(tmp_path / "other"), "w")


def test_a_failed_write_leaves_the_old_array(spark, px, tmp_path):
    path = str(tmp_path / "g")
    write_zarr(px, path, "refl", "refl", (5, 8, 8))
    broken = px.withColumn("refl", F.when(F.col("y") == 20, F.array(F.raise_error(F.lit("lost")).cast("double"))).otherwise(F.col("refl")))
    with pytest.raises(Exception, match="lost"):
        write_zarr(broken, path, "refl", "refl", (5, 8, 8), shape=(B, H, W))
    assert np.array_equal(_cube(open_raster(spark, "zarr", path, array="refl").collect()), _cube(px.collect()), equal_nan=True)
    assert zarr.arrays(Folder(path)) == ["refl"]


def test_a_write_goes_on_where_it_stopped(spark, px, tmp_path):
    path = str(tmp_path / "g")
    how = {"chunks": (2, 8, 8), "shape": (B, H, W), "mode": "append"}
    write_zarr(px.where("y < 8"), path, "refl", "refl", **how)
    for n in ("1.0.2", "2.0.1"):  # as if a task had died between its chunks
        (tmp_path / "g" / "refl" / n).unlink()
    left = unfinished(px, path, "refl")
    assert {(r.y // 8, r.x // 8) for r in left.collect()} == {(i, j) for i in range(3) for j in range(3)} - {(0, 0)}
    times = {n: (tmp_path / "g" / "refl" / n).stat().st_mtime_ns for n in ("0.0.0", "2.0.0")}
    write_zarr(left, path, "refl", "refl", **how)
    assert times == {n: (tmp_path / "g" / "refl" / n).stat().st_mtime_ns for n in times}
    assert unfinished(px, path, "refl").count() == 0
    assert np.array_equal(_cube(open_raster(spark, "zarr", path, array="refl").collect()), _cube(px.collect()), equal_nan=True)
    with pytest.raises(ValueError, match="in chunks of"):
        write_zarr(px, path, "refl", "refl", (3, 8, 8), shape=(B, H, W), mode="append")


def test_no_pixels(spark, px, tmp_path):
    with pytest.raises(ValueError, match="no pixels"):
        write_zarr(px.where("false"), str(tmp_path / "g"), "refl", "refl")
    write_zarr(px.where("false"), str(tmp_path / "g"), "refl", "refl", shape=(B, 4, 4))
    assert {tuple(r.v) for r in open_raster(spark, "zarr", str(tmp_path / "g"), array="refl").collect()} == {(None,) * B}
    assert open_raster(spark, "zarr", str(tmp_path / "g"), "y > 3", array="refl").count() == 0


def test_register_alone(spark, px, tmp_path):
    spark.dataSource.register(ZarrSource)
    write_zarr(px, str(tmp_path / "g"), "refl", "refl", (5, 8, 8))
    assert spark.read.format("zarr").option("array", "refl").load(str(tmp_path / "g")).where("y = 3").count() == W
