"""Every query with SQL against DuckDB on the same tables."""

import __spark_entry__
import oracle
import pytest
from conftest import DATA

from rangeloom.plans import fold_queries, match_queries, point_queries, scene_queries, session_queries, sql_views, stream_queries, view_queries

SQL = {**point_queries.SQL, **stream_queries.SQL, **view_queries.SQL, **sql_views.SQL, **fold_queries.SQL, **session_queries.SQL, **scene_queries.SQL, **match_queries.SQL}
QUERIES = {**point_queries.QUERIES, **stream_queries.QUERIES, **view_queries.QUERIES, **sql_views.QUERIES, **fold_queries.QUERIES, **session_queries.QUERIES, **scene_queries.QUERIES, **match_queries.QUERIES}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    assert oracle.differences(spark, con, QUERIES[name], SQL[name], DATA) == ""


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
