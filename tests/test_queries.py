"""Every registered query of the library gives the rows of its SQL."""

import pytest

from loomspan.plans import registry
from tests.conftest import DATA
from tests.oracle import rows_of, rows_of_sql

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    names, rows = rows_of(QUERIES[name](spark, DATA))
    if name in SQL:
        assert (names, rows) == rows_of_sql(SQL[name], DATA)


def test_entry_points(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
