"""Every registered query runs on the small tables and equals its SQL where there is one."""

import pytest
from support import FOLDER, differences, duck

from tallyframe import catalog

SQL = catalog.oracles()


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    try:
        df = catalog.queries()[name](spark, FOLDER)
    except ValueError as e:
        pytest.fail(str(e))
    if name in SQL:
        assert differences(df, con, SQL[name]) == ([], [])
    else:
        assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
