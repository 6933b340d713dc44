"""Spark results against DuckDB's, as multisets of rows by column name."""

from __future__ import annotations

from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        if Path(sf_dir, f"{table}.parquet").exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def differences(spark_df, con, sql: str) -> list:
    """Up to three (Spark row, DuckDB row) pairs that differ, or a note on shape."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    want = rows_of(names, found.fetchall())
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(names) != sorted(spark_df.columns):
        return [("columns", sorted(spark_df.columns), sorted(names))]
    if len(got) != len(want):
        return [("rows", len(got), len(want))] + [(a, b) for a, b in zip(got, want) if a != b][:2]
    return [(a, b) for a, b in zip(got, want, strict=True) if a != b][:3]
