"""The supplied tables read as field imagery: pixels, bands, scores, plots and transactions, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrid.functions import columns as C

#: A scene is 20 pixels wide; bands are 32.5 nm apart from 400 nm on.
WIDTH, FIRST_NM, STEP_NM = 20, 400.0, 32.5


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y, x, label and the arrays dn and refl, from embeddings; some values are made sentinels by their place."""
    at = lambda i: F.col("vec_id") * 64 + i
    dn = F.transform("embedding", lambda v, i: F.when(at(i) % 97 == 0, F.lit(15000.0)).when(at(i) % 89 == 0, F.lit(-1.0)).otherwise(F.floor((v.cast("double") + 0.3) * 20000).cast("double")))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.expr(f"vec_id div {WIDTH}").alias("y"), (F.col("vec_id") % WIDTH).alias("x"), F.col("label").cast("long").alias("label"), dn.alias("dn"))
    return rows.withColumn("refl", F.transform("dn", lambda v: C.reflectance(v)))


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """band and wl: as many as the longest vector has."""
    n = read(spark, sf_dir, "embeddings").agg(F.max(F.size("embedding")).alias("n"))
    rows = n.select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("band"))
    return rows.select(F.col("band").cast("long").alias("band"), (FIRST_NM + STEP_NM * F.col("band")).alias("wl"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y_true and y_prob from lineitem, with many ties, and a group."""
    rows = read(spark, sf_dir, "lineitem")
    return rows.select((F.col("l_returnflag") == "R").cast("int").alias("y_true"), (F.col("l_discount") * 10).alias("y_prob"), F.month("l_shipdate").cast("long").alias("entry"), F.col("l_linestatus").alias("model"))


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field plots from customer: class, plot, entry and replicate."""
    key = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(key.alias("id"), (F.col("c_nationkey") % 4).cast("long").alias("class"), (key % 24).alias("plot"), (F.col("c_nationkey") % 10 + 1).cast("long").alias("entry"), (key % 3).alias("rep"))


#: The same views in DuckDB's SQL, to stand after WITH.
CELLS = """cells AS (
  SELECT vec_id, vec_id // 20 AS y, vec_id % 20 AS x, CAST(label AS BIGINT) AS label, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS band FROM embeddings
), dn AS (
  SELECT vec_id, y, x, label, band, 400 + 32.5 * band AS wl,
         CASE WHEN (vec_id * 64 + band) % 97 = 0 THEN 15000.0::DOUBLE WHEN (vec_id * 64 + band) % 89 = 0 THEN -1.0::DOUBLE ELSE floor((v + 0.3::DOUBLE) * 20000) END AS dn FROM cells
), refl AS (
  SELECT vec_id, y, x, label, band, wl, dn, CASE WHEN dn NOT IN (-1, 15000) AND dn / 10000.0::DOUBLE BETWEEN 0 AND 1.2::DOUBLE THEN dn / 10000.0::DOUBLE END AS r FROM dn
)"""
BANDS = """bands AS (SELECT band, 400 + 32.5::DOUBLE * band AS wl FROM (SELECT unnest(range(max(len(embedding)))) AS band FROM embeddings))"""
SCORES = """scores AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true, l_discount * 10 AS y_prob, month(l_shipdate) AS entry, l_linestatus AS model FROM lineitem)"""
PLOTS = """plots AS (SELECT c_custkey AS id, CAST(c_nationkey % 4 AS BIGINT) AS class, c_custkey % 24 AS plot, CAST(c_nationkey % 10 + 1 AS BIGINT) AS entry, c_custkey % 3 AS rep FROM customer)"""
