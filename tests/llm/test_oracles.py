"""The corpus queries against their SQL, on the smallest tables."""

import duckdb
import pytest

from tests.llm.cases import SF
from tracelight.llm import queries


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_query_equals_oracle(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.execute(queries.oracles()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    rows = sorted(repr(tuple(r)) for r in df.select(columns).collect())
    assert rows and rows == sorted(repr(tuple(r[i] for i in at)) for r in result.fetchall())
