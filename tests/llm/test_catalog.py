"""Queries against their SQL, and that all of them stand in the entry points."""

import duckdb
import pytest

import __spark_entry__ as entry
from cellgauge.catalog.check import TABLES, compare
from cellgauge.llm.catalog import oracle_sql, queries
from tests.conftest import SF


def test_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {k.split("_")[0] for k in names}
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert compare(queries()[name](spark, SF).toPandas(), con.execute(oracle_sql()[name]).df()) is None
