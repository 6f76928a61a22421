"""Queries of the text operators against their SQL in a second engine."""

import os

import pytest

from kinweave.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, name):
    c = pytest.importorskip("duckdb").connect()
    for table in os.listdir(DATA):
        c.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{table}{'/*.parquet' if os.path.isdir(f'{DATA}/{table}') else ''}'")
    wanted = c.execute(oracle_sql()[name]).df()
    got = queries()[name](spark, DATA).toPandas()[list(wanted.columns)]
    rows = lambda df: sorted(map(tuple, df.values.tolist()))
    assert rows(got) == rows(wanted)
