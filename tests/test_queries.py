"""Every query of the library's own operators against its SQL on the smallest tables."""

import pytest

from quarrymill.plans import registry

from compare import database, rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, con, name):
    names, rows = rows_of(registry.QUERIES[name](spark, SF))
    if name in registry.ORACLE_SQL:
        assert (names, rows) == rows_of_sql(con, registry.ORACLE_SQL[name])
    else:
        assert rows


def test_entry_has_stable_columns(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
