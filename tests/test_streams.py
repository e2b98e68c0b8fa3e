"""Streams with offsets and states of their own: an inbox of cubes, and early stopping on a live log."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafgrid.operators.metrics import staleness
from leafgrid.sources.geotiff import encode
from leafgrid.sources.zarr import write_zarr
from leafgrid.streaming.inbox import watch_inbox, write_once
from leafgrid.streaming.stopping import watch_runs


def _put(folder, name, values):
    (folder / f"{name}.img").write_bytes(values.astype("f4").tobytes())
    h, w, b = values.shape
    (folder / f"{name}.hdr").write_text(f"ENVI\nsamples = {w}\nlines = {h}\nbands = {b}\ndata type = 4\ninterleave = bip\nbyte order = 0\n")


def test_every_cube_is_scored_once(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    cubes = {n: np.random.default_rng(i).integers(0, 9, (5 + i, 4, 2)) for i, n in enumerate("dacb")}
    score = lambda df: df.groupBy("cube").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v")[0] * 10 + F.col("v")[1]).alias("s"))
    fail = []

    def work(df):
        if fail:
            score(df).write.mode("overwrite").parquet(f"{tmp_path}/lost")  # some work is done before the batch dies
            raise RuntimeError("lost")
        return score(df)

    def go(**options):
        stream = watch_inbox(spark, str(inbox), f"{tmp_path}/log", tile=3, **options)
        return write_once(stream, work, f"{tmp_path}/out", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()

    found = lambda: sorted((r.cube, r.n, r.s) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = lambda *names: sorted((f"{n}.hdr", cubes[n].shape[0] * 4, float((cubes[n] * [10, 1]).sum())) for n in names)
    _put(inbox, "d", cubes["d"])
    _put(inbox, "c", cubes["c"])
    (inbox / "b.hdr").write_text("ENVI\nsamples = 4\n")  # still being written
    go().awaitTermination()
    assert found() == want("d", "c")
    _put(inbox, "a", cubes["a"])  # of a name before the others'
    fail.append(1)
    with pytest.raises(Exception, match="lost"):
        go().awaitTermination()
    _put(inbox, "b", cubes["b"])
    (inbox / "b.img").write_bytes(b"\0" * 8)  # not whole yet
    fail.clear()
    go().awaitTermination()
    assert found() == want("d", "c", "a")
    _put(inbox, "b", cubes["b"])
    go().awaitTermination()
    go().awaitTermination()
    assert found() == want("d", "c", "a", "b") and len(list((tmp_path / "log").glob("*.json"))) == 3


@pytest.mark.parametrize("kind", ["zarr", "geotiff"])
def test_other_kinds_of_cubes(spark, tmp_path, kind):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for i in range(3):
        if kind == "zarr":
            px = spark.range(12).select(F.expr("id div 4").alias("y"), (F.col("id") % 4).alias("x"), F.array(F.lit(float(i)), F.col("id") * 1.0).alias("v"))
            write_zarr(px, f"{inbox}/cube{i}", "r", "v", (2, 2, 4))
        else:
            (inbox / f"cube{i}.tif").write_bytes(encode(np.dstack([np.full((3, 4), i), np.arange(12).reshape(3, 4)]).astype("f4"), tile=16))
    options = {"array": "r"} if kind == "zarr" else {}
    stream = watch_inbox(spark, str(inbox), f"{tmp_path}/log", kind=kind, max_cubes=2, **options)
    query = write_once(stream, lambda df: df, f"{tmp_path}/out", f"{tmp_path}/checkpoint").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.cube[:5], r.y, r.x, *r.v) for r in got.collect()) == sorted((f"cube{i}", k // 4, k % 4, float(i), float(k)) for i in range(3) for k in range(12))
    assert got.select("batch").distinct().count() == 2


SCHEMA = "run string, epoch long, ts timestamp, ap double"


def _file(spark, folder, rows):
    spark.createDataFrame(rows, "run string, epoch long, sec long, ap double").select("run", "epoch", F.timestamp_seconds("sec").alias("ts"), "ap").coalesce(1).write.mode("append").parquet(str(folder))


def test_runs_stop_as_in_a_closed_log(spark, tmp_path):
    r = np.random.default_rng(2)
    rows = [(f"run{k}", e, 1000 + 10 * e + k, None if (e + k) % 9 == 0 else float(np.round(r.random(), 2))) for k in range(4) for e in range(1, 25)]
    want = staleness(spark.createDataFrame(rows, "run string, epoch long, sec long, ap double"), "ap", "epoch", 5, "run")
    want = {(x.run, x.epoch): (x.stale, x.stop) for x in want.collect()}
    source, flush = tmp_path / "in", [("flush", 1, 10**6, 0.5)]
    order = r.permutation(len(rows))

    def go():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
        got = watch_runs(stream, "ap", "epoch", "ts", 5, "run", late="200 seconds", silence_seconds=5000)
        got.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    early = [rows[i] for i in order if rows[i][1] <= 12]
    late = [rows[i] for i in order if rows[i][1] > 12]
    _file(spark, source, early)
    go()  # the state goes on after a restart
    _file(spark, source, early[:20])  # epochs that come again
    go()
    _file(spark, source, late)
    go()
    _file(spark, source, flush)
    go()
    got = [tuple(x) for x in spark.read.parquet(f"{tmp_path}/out").collect()]
    judged = [(x[0], x[1]) for x in got if not x[4]]
    assert len(judged) == len(set(judged)) and {(a, b): (c, d) for a, b, c, d, silent in got if not silent} == want
    assert {(a, b) for a, b, *_, silent in got if silent} == {(f"run{k}", 24) for k in range(4)}


def test_many_runs_share_states(spark, tmp_path):
    """A call of Python for each run took longer than its epochs did; first values may be null, and states go on after a restart."""
    value = lambda k, e: None if e == 1 or (k + e) % 5 == 0 else float((7 * k + 3 * e * e) % 11)
    rows = [(k, e, 1000 + 10 * e + k % 3, value(k, e)) for k in range(1500) for e in range(1, 9)]
    schema, out = "run int, epoch long, ts timestamp, ap double", []

    def go(some):
        log = spark.createDataFrame(some, "run int, epoch long, sec long, ap double").select("run", "epoch", F.timestamp_seconds("sec").alias("ts"), "ap")
        log.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = watch_runs(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "ap", "epoch", "ts", 3, "run")
        query = got.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        out.extend(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress)

    go([r for r in rows if r[1] <= 4])
    go([r for r in rows if r[1] > 4])
    go([(-1, 1, 10**6, 0.5)])
    assert 0 < max(out) <= 1024
    closed = staleness(spark.createDataFrame(rows, "run int, epoch long, sec long, ap double"), "ap", "epoch", 3, "run").select("run", "epoch", "stale", "stop")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.schema["run"].dataType.simpleString() == "int" and not got.where("silent").count()
    assert sorted(map(tuple, got.drop("silent").collect())) == sorted(map(tuple, closed.collect()))
