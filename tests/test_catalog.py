"""Catalog tables: joins of bucketed layers without a shuffle, months that are replaced."""

import re
import uuid
from datetime import date

import pytest
from pyspark.sql import functions as F

from leafgrid.operators.cube import stack_layers
from leafgrid.sources.catalog import join_layers, layout_of, read_days, replace_months, save_layer


@pytest.fixture
def name(spark):
    names = []

    def make():
        names.append(f"t_{uuid.uuid4().hex}")
        return names[-1]

    yield make
    for n in names:
        spark.sql(f"DROP TABLE IF EXISTS {n}")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_layers_join_without_a_shuffle(spark, name):
    px = spark.range(2400).select(F.expr("id div 60").alias("y"), (F.col("id") % 60).alias("x"), F.array(F.col("id") * 1.0).alias("refl"))
    layers = [px, px.where("x % 7 > 1").select("y", "x", (F.col("x") % 4).alias("class")), px.select("y", "x", (F.col("y") % 3).alias("split_id")), px.where("y > 3 and x < 50").select("y", "x", F.lit(True).alias("veg"))]
    tables = [name() for _ in layers]
    for layer, table in zip(layers, tables, strict=True):
        save_layer(layer, table, tile=8, buckets=6)
        assert len(spark.table(table).inputFiles()) <= 6 and layout_of(spark, table) == (8, 6)
    got = join_layers(spark, *tables)
    assert "Exchange" not in _plan(got) and _plan(got).count("SortMergeJoin") == 3
    want = stack_layers(*layers)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    assert got.rdd.getNumPartitions() == 6
    some = join_layers(spark, *tables, tiles=[(1, 2)])
    assert {(r.y, r.x) for r in some.collect()} == {(r.y, r.x) for r in want.collect() if r.y // 8 == 1 and r.x // 8 == 2}
    assert re.search(r"SelectedBucketsCount: 1 out of 6", some._jdf.queryExecution().explainString(some._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))


def test_layers_must_be_alike(spark, name):
    px = spark.range(10).select(F.lit(0).alias("y"), F.col("id").alias("x"))
    a, b, c = name(), name(), name()
    save_layer(px, a, 4, 2)
    save_layer(px, b, 4, 3)
    px.write.saveAsTable(c)
    with pytest.raises(ValueError, match="differ"):
        join_layers(spark, a, b)
    with pytest.raises(ValueError, match="no layer"):
        join_layers(spark, a, c)
    with pytest.raises(ValueError, match="has no table"):
        join_layers(spark, a, "t_none")
    save_layer(px.where("x < 3"), a, 4, 2)
    assert spark.table(a).count() == 3


def test_a_month_is_run_again(spark, name, tmp_path):
    table = name()
    day = lambda n: F.date_add(F.lit(date(2024, 1, 1)), n)
    rows = spark.range(120).select(F.col("id"), day(F.col("id").cast("int")).alias("day"), F.lit("first").alias("run"))
    replace_months(rows, table, "day", str(tmp_path / "t"))
    files = lambda: {p.parent.name: p.stat().st_mtime_ns for p in (tmp_path / "t").glob("month=*/*.parquet")}
    before = files()
    assert set(before) == {f"month=2024-0{m}-01" for m in (1, 2, 3, 4)}
    replace_months(rows.where("day between '2024-02-05' and '2024-02-20'").withColumn("run", F.lit("again")).select("run", "day", "id"), table, "day")
    after = files()
    assert {k for k in before if before[k] != after[k]} == {"month=2024-02-01"}
    got = {(r.run, r["count"]) for r in spark.table(table).groupBy("run").count().collect()}
    assert got == {("first", 120 - 29), ("again", 16)}
    some = read_days(spark, table, "day", date(2024, 2, 18), date(2024, 3, 2))
    assert [(r.day.isoformat(), r.run) for r in some.orderBy("day").collect()] == [("2024-02-18", "again"), ("2024-02-19", "again"), ("2024-02-20", "again"), ("2024-03-01", "first"), ("2024-03-02", "first")]
    assert len(some.inputFiles()) and re.search(r"PartitionFilters: \[[^\]]*month", _plan(some)) and some.columns == ["id", "day", "run"]
    replace_months(rows.where("id = 0").withColumn("day", F.lit(date(2025, 7, 1))), table, "day")
    assert len(files()) == 5
    with pytest.raises(ValueError, match="has the columns"):
        replace_months(rows.drop("run"), table, "day")
    with pytest.raises(ValueError, match="have no day"):
        replace_months(rows.withColumn("day", F.when(F.col("id") > 0, F.col("day"))), table, "day")
    replace_months(rows.where("false"), table, "day")
    assert spark.table(table).count() == 120 - 29 + 16 + 1
