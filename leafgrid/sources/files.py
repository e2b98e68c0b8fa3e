"""Small tables in files: CSV and JSON in, reports as CSV, Markdown and JSON out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A CSV file with a header; columns are found by position, and a header that doesn't fit the schema is an error."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False, mode="FAILFAST")


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON file of one object or of an array of them, whatever its lines."""
    return spark.read.json(path, schema=schema, multiLine=True, mode="FAILFAST")


def write_csv(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A report, which is small, as one CSV file in a folder."""
    report.coalesce(1).write.csv(path, header=True, mode=mode)


def markdown(report: DataFrame, most: int = 1000) -> str:
    """A report as a Markdown table; more than ``most`` rows are an error."""
    rows = report.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the report has more than {most} rows")
    said = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [report.columns, ["---"] * len(report.columns), *[[said(v) for v in r] for r in rows]]
    return "\n".join(f"| {' | '.join(line)} |" for line in lines) + "\n"


def write_metrics(metrics: DataFrame, by: str, path: str, digits: int = 4, mode: str = "overwrite") -> None:
    """Metrics as one JSON object: for each value of ``by`` its metrics, rounded. There must be few rows."""
    names = [c for c in metrics.columns if c != by]
    one = metrics.select(F.col(by).cast("string").alias("k"), F.struct(*[F.round(n, digits).alias(n) for n in names]).alias("v"))
    text = one.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))), {"ignoreNullFields": "false"}).alias("value"))
    text.coalesce(1).write.mode(mode).text(path)


def save_components(spark: SparkSession, path: str, means: list[float], parts: list[list[float]], shares: list[float]) -> None:
    """Components (see models.pca_fit) as a table of loadings, a JSON summary and a CSV file of variance shares."""
    rows = [(i, band, float(v)) for i, part in enumerate(parts, 1) for band, v in enumerate(part)]
    spark.createDataFrame(rows, "component int, band int, loading double").coalesce(1).write.mode("overwrite").parquet(f"{path}/loadings")
    total = [sum(shares[: i + 1]) for i in range(len(shares))]
    write_csv(spark.createDataFrame([(i + 1, float(s), float(t)) for i, (s, t) in enumerate(zip(shares, total, strict=True))], "component int, share double, cumulative double"), f"{path}/variance")
    summary = [(json.dumps({"means": means, "components": len(parts), "bands": len(means), "explained": total[-1] if total else 0.0}),)]
    spark.createDataFrame(summary, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/summary")


def load_components(spark: SparkSession, path: str) -> tuple[list[float], list[list[float]]]:
    """Means and components that save_components has written."""
    means = json.loads(spark.read.text(f"{path}/summary").first().value)["means"]
    rows = spark.read.parquet(f"{path}/loadings").orderBy("component", "band").collect()
    parts: dict[int, list[float]] = {}
    for r in rows:
        parts.setdefault(r.component, []).append(r.loading)
    return means, list(parts.values())
