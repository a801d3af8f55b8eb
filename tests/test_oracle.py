"""Every registered query against its DuckDB SQL on the given tables."""

import pytest

import __spark_entry__ as contract
from compare import duck_rows, spark_rows
from fixtures import SF_SMALL

QUERIES = contract.queries()
ORACLE = contract.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, name):
    columns, rows = spark_rows(QUERIES[name](spark, SF_SMALL))
    expected_columns, expected = duck_rows(ORACLE[name], SF_SMALL)
    assert columns == expected_columns
    assert rows == expected
    assert rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_queries_without_sql_give_rows(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert contract.entry(spark).count() == 45
