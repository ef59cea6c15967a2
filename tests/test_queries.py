"""Every query against its SQL, and that those without SQL run."""

import pytest

from compare import connect, differences
from conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def names():
    from spanforge.queries import ORACLES

    return sorted(ORACLES)


def others():
    from spanforge.queries import ORACLES, QUERIES

    return sorted(set(QUERIES) - set(ORACLES))


@pytest.mark.parametrize("name", names())
def test_query_gives_what_its_sql_gives(spark, con, name):
    from spanforge.queries import ORACLES, QUERIES

    assert differences(spark, QUERIES[name], ORACLES[name], con, SMALL) is None


@pytest.mark.parametrize("name", others())
def test_query_without_sql_runs(spark, name):
    from spanforge.queries import QUERIES

    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
