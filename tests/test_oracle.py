"""Every registered query against its SQL twin in DuckDB, value by value."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb
import pytest

from gaugeworks.plans import registry

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def plain(v):
    return "NaN" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF_DIR)
    sql = registry.ORACLES.get(name)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got, "no rows"
    if sql is None:
        return
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(v) for v in (dict(zip(names, row))[c] for c in columns)) for row in cur.fetchall())
    extra, missing = got - want, want - got
    assert not extra and not missing, (
        f"{sum(got.values())} rows against {sum(want.values())}; only in Spark {list(extra.items())[:3]}, "
        f"only in SQL {list(missing.items())[:3]}")
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    duck_types = {d[0]: str(d[1]) for d in cur.description}
    same = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert {c: same[t] for c, t in spark_types.items()} == duck_types
