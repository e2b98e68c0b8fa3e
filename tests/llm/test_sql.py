"""Registered text queries against their SQL; sizes that operators check."""

import duckdb
import pytest

from leafgrid.llm import decontaminate
from leafgrid.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[columns].convert_dtypes().astype(str).values))
    assert sorted(got.columns) == columns and rows(got) == rows(want)


def test_large_benchmarks_are_refused_before_they_are_collected(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_WORDS", 4)
    docs = spark.createDataFrame([(1, "one two three four five")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "One two-three, FOUR"), (2, None), (3, "")], "item_id long, text string")
    assert decontaminate.find_contamination(docs, items).first()["n_hit"] == 4
    with pytest.raises(ValueError, match="more than 4 words"):
        decontaminate.find_contamination(docs, items.union(spark.createDataFrame([(4, "five")], items.schema)))
