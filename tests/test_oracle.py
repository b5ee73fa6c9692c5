"""Every query of the catalogue against DuckDB on the same tables."""

import pytest
from compare import connect, same

from tideline.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_duckdb(spark, data, con, name):
    same(QUERIES[name](spark, data), ORACLE_SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_gives_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_explodes_every_vector(spark, data, con):
    (want,) = con.execute("SELECT count(DISTINCT vec_id) FROM embeddings").fetchone()
    assert QUERIES["repeated_explode"](spark, data).select("vec_id").distinct().count() == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
