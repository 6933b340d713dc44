"""The corpus queries that have SQL, run as registered, against DuckDB on small tables."""

import duckdb
import pytest

from corpusloom.llm import oracle, registry
from corpusloom.llm.common import read

SF = "/root/testdata/sf0.001"


SQL = oracle.sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(SQL[name]).fetchdf()
    got = registry.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) == read(spark, SF, "documents").count()
    columns = sorted(got.columns)
    rows = lambda df: sorted(map(repr, df[columns].astype(str).itertuples(index=False)))
    assert rows(got) == rows(want)
