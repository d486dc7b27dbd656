"""The corpus queries against their SQL, on the smallest tables."""

import duckdb
import pytest

from medialoom.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df, want = queries.queries()[name](spark, DIR), c.sql(queries.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    assert sorted(map(tuple, df.select(*order).collect()), key=repr) == sorted(want.select(*[duckdb.ColumnExpression(x) for x in order]).fetchall(), key=repr)
