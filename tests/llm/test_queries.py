"""Registered queries against their SQL twins in DuckDB, value by value."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from gaugeworks.llm import queries

SF = "/root/testdata/sf0.01"
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert {d[0]: str(d[1]) for d in cursor.description} == {f.name: TYPES[f.dataType.simpleString()] for f in df.schema.fields}
    want = Counter(tuple(dict(zip(names, row))[c] for c in columns) for row in cursor.fetchall())
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == want
