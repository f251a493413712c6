"""Each query of the engine against its SQL."""

import pytest

from rivulet import queries

from .oracle import rows, sql_rows


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, sf, name):
    assert rows(queries.QUERIES[name](spark, sf)) == sql_rows(queries.SQL[name], sf)


def test_entry_and_names():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
