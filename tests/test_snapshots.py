"""Versions of stores: failed and resumed writes, readers of one version, conflicts, expiry."""

import pytest
from pyspark.sql import functions as F

from leafgrid.sources import store
from leafgrid.sources.snapshots import Conflict, Snapshots


@pytest.fixture
def snaps(spark, tmp_path):
    return Snapshots(spark, f"file://{tmp_path}/store")


@pytest.fixture(scope="module")
def px(spark):
    return spark.range(600).select(F.expr("id div 20").alias("y"), (F.col("id") % 20).alias("x"), (F.col("id") * 0.5).alias("v"))


def test_readers_keep_their_version(spark, snaps):
    assert snaps.version().number == 0 and snaps.numbers() == []
    snaps.save("labels", spark.range(5), attributes={"sensor": "a"})
    first = snaps.version()
    old = snaps.load("labels", first)
    snaps.save("labels", spark.range(9), by=())
    snaps.save("splits", snaps.load("labels").where("id > 6"), attributes={"crs": 32618})
    assert old.count() == 5 and snaps.load("labels").count() == 9 and snaps.load("labels", 1).count() == 5
    now = snaps.version()
    assert (now.number, sorted(now.tables), now.attributes) == (3, ["labels", "splits"], {"sensor": "a", "crs": 32618})
    # A table may be made from its own earlier version.
    snaps.save("splits", snaps.load("splits").union(spark.range(1)))
    assert sorted(r.id for r in snaps.load("splits").collect()) == [0, 7, 8]
    with pytest.raises(ValueError, match="has no table splits"):
        snaps.load("splits", 2)
    with pytest.raises(ValueError, match="known are"):
        snaps.load("labels", 17)
    assert {(r.version, r.table) for r in snaps.history().collect()} == {(1, "labels"), (2, "labels"), *((v, t) for v in (3, 4) for t in ("labels", "splits"))}


def test_a_failed_write_changes_nothing(spark, snaps, px):
    snaps.save("cube", px, by=("y",))
    broken = px.withColumn("v", F.when(F.col("y") == 29, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        snaps.save("cube", broken)
    assert snaps.numbers() == [1] and snaps.load("cube").count() == 600
    left = set(snaps.files.names("data"))
    assert len(left) == 2 and snaps.expire(1, 1e6) == [] and snaps.load("cube").count() == 600
    gone = snaps.expire(1, -10.0)
    assert len(gone) == 1 and {f for f in left if f not in gone} == {snaps.version().tables["cube"][0]} and snaps.load("cube").count() == 600


def test_a_write_goes_on_where_it_stopped(spark, snaps, px, tmp_path):
    flag = tmp_path / "broken"
    flag.write_text("")
    fails = F.udf(lambda y: 1 / (y < 20 or not flag.exists()), "double")
    rows = px.withColumn("v", F.col("v") * fails("y"))
    with pytest.raises(Exception, match="ZeroDivision"):
        snaps.save_cube("cube", rows, "run1", tile=5, rows_at_once=1)
    assert snaps.numbers() == [] and snaps.version().tables == {}
    strips = lambda: {p.parent.name: p.stat().st_mtime_ns for p in (tmp_path / "store" / "data" / "cube-run1").glob("strip=*/_SUCCESS")}
    before = strips()
    assert set(before) == {f"strip={k}" for k in range(4)}
    flag.unlink()
    snaps.save_cube("cube", rows, "run1", tile=5, rows_at_once=1)
    after = strips()
    assert {k: after[k] for k in before} == before and len(after) == 6
    assert {(r.y, r.x): r.v for r in snaps.load_cube("cube").collect()} == {(r.y, r.x): r.v for r in px.collect()}
    part = snaps.load_cube("cube", rows=(7, 11), columns=(0, 3))
    assert {(r.y, r.x) for r in part.collect()} == {(y, x) for y in range(7, 12) for x in range(4)} and len(part.inputFiles()) == 24
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "tile_y" in plan
    with pytest.raises(ValueError, match="no pixels"):
        snaps.save_cube("cube", px.where("false"), "run2")


def test_of_two_writers_one_is_told(spark, snaps):
    snaps.save("a", spark.range(1))
    base = snaps.version()
    snaps.save("b", spark.range(2))
    with pytest.raises(Conflict):
        snaps.commit({"c": base.tables["a"]}, base)
    assert sorted(snaps.version().tables) == ["a", "b"] and not [n for n in snaps.files.names() if n.startswith(".")]
    snaps.commit({}, snaps.version(), drop=("a",))
    assert sorted(snaps.version().tables) == ["b"]


def test_versions_expire(spark, snaps):
    for n in range(1, 5):
        snaps.save("t", spark.range(n))
    assert len(snaps.expire(2, -10.0)) == 2 and snaps.numbers() == [3, 4] and snaps.load("t", 3).count() == 3
    snaps.save("t", spark.range(9))
    assert snaps.version().number == 5


def test_overwriting_a_cube_keeps_the_old_one_until_the_end(spark, px, tmp_path):
    path = f"file://{tmp_path}/cube"
    store.save_cube(px, path, 8)
    broken = px.withColumn("v", F.when(F.col("y") == 29, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        store.save_cube(broken, path, 8)
    assert store.load_cube(spark, path, tile=8).count() == 600
    store.save_cube(store.load_cube(spark, path, tile=8).where("y < 8"), path, 8)  # from its own rows
    assert store.load_cube(spark, path, tile=8).count() == 160 and [p.name for p in tmp_path.iterdir()] == ["cube"]
